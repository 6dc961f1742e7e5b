"""Context for code chunks: imports and the enclosing class or function.

Documents become line tables whose strings, comments and bracket depth come from one pass in
order. Scopes and imports are running windows over the lines of one document; a document is
bounded by the file size cap. Every step is keyed by `doc_id`, and the text is placed by it once.
Both sides of a join on `doc_id` grow with the corpus, so these joins ask for a merge: Spark's guess
of their sizes from the size of the files is far too low and would broadcast them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from lodestone.functions import text as tx
from lodestone.operators import lexer

# Repeated groups are possessive throughout: the matcher recurses into the others, and a long
# line would overflow its stack.
# Which header starts a class or a function, and which line starts an import, per language.
_JS_METHOD = (
    r"^\s*(?!(?:if|for|while|switch|catch|with|function|return|else|do|try)\b)"
    r"(?:(?:public|private|protected|static|readonly|override|async|get|set)\s++(?=[*#\p{L}_$]))*+[*#]?"
    r"[\p{L}_$][\p{L}\p{N}_$]*+\s*+\([^();]*+(?:\([^()]*+\)[^();]*+)*+\)\s*+(?::[^{;=]++)?\{"
)
_JS = {
    "class": r"^\s*(?:export\s+)?(?:default\s+)?class\s+[\p{L}_$]",
    "function": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+[\p{L}_$]|" + _JS_METHOD,
    "import": r"^\s*import\b(?!\s*\()",
}
LANG_RULES = {
    "python": {
        "class": r"^\s*class\s+[\p{L}_]",
        "function": r"^\s*(?:async\s+)?def\s+[\p{L}_]",
        "import": r"^\s*(?:import\s+[\p{L}_]|from\s+(?!__future__\b)[\p{L}_.][\p{L}\p{N}_.]*\s+import\b)",
    },
    "javascript": _JS,
    "typescript": _JS,
    "java": {
        "class": r"^\s*(?:(?:public|protected|private|static|final|abstract|sealed|strictfp)\s++)*+class\s+[\p{L}_]",
        "function": (
            r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s++)*+"
            r"(?:<[^>]*>\s*)?"
            r"(?!(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp"
            r"|return|new|else|throw|if|for|while|switch|case|package|import|class|enum|interface|record)\b)"
            r"[\p{L}_][\p{L}\p{N}_.]*(?:<[^=;(]*>)?(?:\[\])*+\s+[\p{L}_][\p{L}\p{N}_]*\s*\([^=]*$"
        ),
        "import": r"^\s*import\s+[\p{L}_]",
    },
    "go": {
        "class": r"^\s*type\s+[\p{L}_(]",
        "function": r"^\s*func\s+[\p{L}_(]",
        "import": r"^\s*import\s*[\"(\p{L}_.]",
    },
    "rust": {
        "class": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+[\p{L}_]",
        "function": (
            r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default|extern(?:\s+\"[^\"]*+\")?)\s++)*+"
            r"fn\s+[\p{L}_]"
        ),
        "import": r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+[\p{L}_:{]",
    },
}

def _by_line(*keys: str) -> WindowSpec:
    return Window.partitionBy("doc_id", *keys).orderBy("line_no")


def _before() -> WindowSpec:
    return _by_line().rowsBetween(Window.unboundedPreceding, -1)


def _so_far(*keys: str) -> WindowSpec:
    return _by_line(*keys).rowsBetween(Window.unboundedPreceding, 0)


def _rule(name: str) -> Column:
    chosen = F.lit(False)
    for language, rules in LANG_RULES.items():
        chosen = F.when(F.col("language") == language, F.col("line" if name == "import" else "code").rlike(rules[name])).otherwise(chosen)
    return chosen


def code_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, language, text) of the documents in a language with rules."""
    return docs.select("doc_id", F.col("metadata.language").alias("language"), "text").where(
        F.col("language").isin(*LANG_RULES)
    )


def code_lines(sources: DataFrame) -> DataFrame:
    """One row per line: `line`, `code` (without strings and comments), whether the line starts
    `inside` one, `indent`, and the depth of braces and of all brackets before the line.
    """
    return lexer.lexed_lines(sources)


def scopes(lines: DataFrame) -> DataFrame:
    """(doc_id, language, kind, start_line, end_line, ...) of each class and function.

    A header at a level ends before the next line that closes this level. Python: a line
    closes every level from its own indentation to that of the line before; a scope keeps the
    blank lines that follow its body. Other languages:
    an unmatched closing brace closes the level it returns to. So the number of closing
    events is linear in the text, and a header finds its event in one running window per
    (document, level).
    """
    is_python = F.col("language") == "python"
    # stripped on the left only: the right end takes a pass over the line, and blank is blank
    has_code = tx.lstrip(F.col("code")) != ""
    kind = F.when(_rule("class"), F.lit("class")).when(_rule("function"), F.lit("function"))
    code = F.col("code")
    unmatched = _unmatched_braces(code)
    latest = lambda keep, value, frame: F.last(F.when(keep, value), ignorenulls=True).over(frame)
    flagged = (
        lines.withColumn("filled", tx.lstrip(F.col("line")) != "")
        .withColumn("body", has_code | F.col("inside"))
        .withColumn("structural", has_code & ~F.col("inside") & (~is_python | (F.col("bracket_depth") == 0)))
        .withColumn("kind", F.when(F.col("structural"), kind))
        .withColumn("_unmatched", F.when(~is_python, unmatched))
        .withColumn("_closers", F.coalesce("_unmatched.closers", F.lit(0)))
        .withColumn("_openers", F.coalesce("_unmatched.openers", F.lit(0)))
        .withColumn("_mark", F.when(F.col("kind").isNotNull(), F.lit("header")).otherwise(_first_mark(code)))
    )
    filled, body = F.col("filled"), F.col("body")
    seen = flagged.select(
        "*",
        F.lead("line", 1).over(_by_line()).alias("line_1"),
        F.lead("line", 2).over(_by_line()).alias("line_2"),
        latest(F.col("structural"), F.col("indent"), _before()).alias("_prev_indent"),
        latest(filled, body, _before()).alias("_after_body"),
        latest(filled, body, _so_far()).alias("_in_body"),
        F.last("_mark", ignorenulls=True).over(_below()).alias("_next_mark"),
    )
    # The first line with text after a body: the next line of code, or a comment above it.
    first_after = latest(filled & F.col("_after_body"), F.col("line_no"), _so_far())
    known = seen.withColumn("_next_text", first_after)
    reach = F.when(F.col("_in_body"), F.col("line_no")).otherwise(F.col("_next_text") - 1)
    whole = _by_line().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = known.withColumn("_tail", F.last(reach).over(whole))
    base = F.col("depth") - F.col("_closers")
    own_level = F.when(is_python, F.col("indent")).otherwise(base)
    closes = (
        F.when(
            is_python & F.col("structural") & (F.col("indent") <= F.col("_prev_indent")),
            F.sequence(F.col("indent"), F.greatest("_prev_indent", "indent")),
        )
        .when(~is_python & (F.col("_closers") > 0), F.sequence(base, F.greatest(F.col("depth") - 1, base)))
        .otherwise(F.array().cast("array<int>"))
    )
    ends_at = F.when(is_python, F.col("_next_text") - 1).otherwise(F.col("line_no"))
    no_body = ~is_python & (F.col("_openers") == 0) & (
        code.contains("{") | code.rlike(r";\s*$") | ~_goes_on()
    )
    closing = F.transform(closes, lambda level: F.struct(level.alias("level"), F.lit(True).alias("closes")))
    heading = F.when(
        F.col("kind").isNotNull(), F.array(F.struct(own_level.alias("level"), F.lit(False).alias("closes")))
    ).otherwise(F.array().cast("array<struct<level:int,closes:boolean>>"))
    events = placed.select(
        "doc_id", "language", "kind", "line_no", "line", "line_1", "line_2", "_tail",
        no_body.alias("_single"), ends_at.alias("_ends_at"),
        F.explode(F.concat(heading, closing)).alias("event"),
    ).select("*", "event.level", "event.closes")
    later = (
        Window.partitionBy("doc_id", "level")
        .orderBy(F.desc("line_no"), F.asc("closes"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    next_end = F.last(F.when(F.col("closes"), F.col("_ends_at")), ignorenulls=True).over(later)
    end_line = F.when(F.col("_single"), F.col("line_no")).otherwise(F.coalesce(next_end, "_tail"))
    return (
        events.withColumn("end_line", end_line)
        .where(~F.col("closes"))
        .select(
            "doc_id", "language", "kind", F.col("line_no").alias("start_line"), "end_line",
            "line", "line_1", "line_2",
        )
    )


def _unmatched_braces(code: Column) -> Column:
    """Struct of the closing braces of a line that close earlier ones, and the opening ones that stay open.

    One pass over the braces of the line with their running balance and its lowest value.
    """
    both = code.contains("{") & code.contains("}")
    steps = F.split(F.regexp_replace(code, r"[^{}]++", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("low"))

    def step(state: Column, brace: Column) -> Column:
        now = state["now"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.least(state["low"], now).alias("low"))

    counted = F.aggregate(
        steps, start, step, lambda s: F.struct((-s["low"]).alias("closers"), (s["now"] - s["low"]).alias("openers"))
    )
    plain = F.struct(tx.count_of(code, "}").cast("int").alias("closers"), tx.count_of(code, "{").cast("int").alias("openers"))
    return F.when(both, counted).otherwise(plain)


def _first_mark(code: Column) -> Column:
    """The first brace or semicolon of a line outside round and square brackets, NULL without one."""
    outside = F.regexp_replace(code, r"\([^()]*+\)|\[[^\[\]]*+\]", "")
    return F.nullif(F.regexp_extract(outside, r"[{};]", 0), F.lit(""))


def _below() -> WindowSpec:
    return (
        Window.partitionBy("doc_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    )


def _goes_on() -> Column:
    """The header goes on below: a parenthesis stays open, or the next mark of any line below is its brace.

    Go ends a statement at the line end, so its brace cannot follow on another line.
    """
    unclosed = tx.count_of(F.col("code"), "(") > tx.count_of(F.col("code"), ")")
    follows = (F.col("language") != "go") & F.coalesce(F.col("_next_mark") == "{", F.lit(False))
    return unclosed | follows


def enclosing_scope(chunks: DataFrame, scopes: DataFrame) -> DataFrame:
    """Nearest scope that starts above a chunk and reaches its last line, one per chunk.

    Interval containment within a document; only containing scopes become rows, so a chunk
    brings as many rows as the code is nested around it.
    """
    c = chunks.select("doc_id", "chunk_id", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    inside = (scopes["start_line"] < c["a"]) & (scopes["end_line"] >= c["b"])
    found = F.struct("start_line", "end_line", "kind")
    return (
        c.join(scopes.select("doc_id", "kind", "start_line", "end_line").hint("merge"), "doc_id")
        .where(inside)
        .groupBy("doc_id", "chunk_id")
        .agg(F.max(found).alias("scope"))
        .select("doc_id", "chunk_id", "scope.start_line", "scope.end_line", "scope.kind")
    )


def decorators(lines: DataFrame) -> DataFrame:
    """(doc_id, decorators): per document a map from line to the run of decorators above it."""
    is_deco = (F.col("language") == "python") & tx.lstrip(F.col("line")).startswith("@")
    marked = lines.withColumn("_deco", is_deco).withColumn(
        "_run", F.sum(F.when(F.col("_deco"), 0).otherwise(1)).over(_so_far())
    )
    entry = F.struct("line_no", tx.rstrip(F.col("line")).alias("line"))
    text = F.array_join(F.array_sort(F.collect_list(entry))["line"], "\n")
    runs = marked.where("_deco").groupBy("doc_id", "_run").agg(
        (F.max("line_no") + 1).alias("start_line"), text.alias("text")
    )
    pairs = F.collect_list(F.struct("start_line", "text"))
    return runs.groupBy("doc_id").agg(F.map_from_entries(pairs).alias("_decorators"))


def signatures(scopes: DataFrame, lines: DataFrame) -> DataFrame:
    """Scopes with their `signature`: up to three lines of the header."""
    within = lambda name, n: F.when(F.col("start_line") + n <= F.col("end_line"), F.col(name))
    l0, l1, l2 = F.col("line"), within("line_1", 1), within("line_2", 2)
    cut = tx.rstrip

    def until(mark: str) -> Column:
        return (
            F.when(l0.contains(mark), cut(l0))
            .when(F.coalesce(l1.contains(mark), F.lit(False)), F.concat_ws("\n", cut(l0), cut(l1)))
            .otherwise(F.concat_ws("\n", cut(l0), cut(l1), cut(l2)))
        )

    def first_with(*marks: str) -> Column:
        has = lambda l: F.coalesce(reduce(or_, [l.contains(m) for m in marks]), F.lit(False))
        return F.when(has(l0), cut(l0)).when(has(l1), cut(l1)).when(has(l2), cut(l2)).otherwise(l0)

    language = F.col("language")
    header = (
        F.when(language == "python", until(":"))
        .when(language.isin("javascript", "typescript", "java"), until("{"))
        .when(language == "go", first_with("func "))
        .when(language == "rust", first_with("fn ", "struct "))
        .otherwise(l0)
    )
    joined = scopes.join(decorators(lines).hint("merge"), "doc_id", "left")
    above = F.col("_decorators")[F.col("start_line")]
    return joined.withColumn("signature", F.concat_ws("\n", above, header)).drop(
        "line", "line_1", "line_2", "_decorators"
    )


def context_stub(signature: Column) -> Column:
    indent = F.regexp_extract(signature, r"\A([^\S\n]*)", 1)
    return F.concat(signature, F.lit("\n"), indent, F.lit("    # ..."))


def extract_imports(lines: DataFrame) -> DataFrame:
    """(doc_id, language, line_no, import_text): statements in order, nested and multi-line ones too.

    A statement goes on while its brackets stay open or a Python line ends in a backslash.
    """
    starts = _rule("import") & ~F.col("inside")
    marked = lines.withColumn("_start", starts).withColumn("_no", F.sum(F.when(starts, 1).otherwise(0)).over(_so_far()))
    within = _so_far("_no")
    carried = (F.col("language") == "python") & F.lag("line").over(_by_line("_no")).rlike(r"\\\s*\z")
    parts = (
        marked.where("_no > 0")
        .withColumn("_first", F.first("line_no").over(within))
        .withColumn("_goes_on", (F.col("bracket_depth") > F.first("bracket_depth").over(within)) | carried)
        .withColumn("_open", F.col("_start") | F.min(F.when(~F.col("_start"), F.col("_goes_on"))).over(within))
        .where("_open")
    )
    entry = F.struct("line_no", "line")
    text = F.array_join(F.array_sort(F.collect_list(entry))["line"], "\n")
    no_comment = (
        F.when(F.col("language") == "python", F.regexp_replace("_text", r"[^\S\n]+#[^\n]*", ""))
        .otherwise(F.regexp_replace("_text", r"(;|\)|[\"'])[^\S\n]*//[^\n]*", "$1"))
    )
    return (
        parts.groupBy("doc_id", "language", "_first").agg(text.alias("_text"))
        .select("doc_id", "language", F.col("_first").alias("line_no"), tx.strip(no_comment).alias("import_text"))
    )


def _import_items(statement: Column, language: Column) -> Column:
    """The part of a statement that lists what it brings in, split into single items."""
    flat = F.regexp_replace(statement, r"\\\n", " ")
    python = F.regexp_replace(flat, r"(?s)\A(?:from\s+\S+\s+)?import\b", "")
    script = F.regexp_extract(flat, r"(?s)\Aimport\b\s*(?:type\s+)?(.*?)\bfrom\s*[\"']", 1)
    java = F.regexp_replace(flat, r"(?s)\Aimport\s+(?:static\s+)?", "")
    go = F.regexp_replace(flat, r"(?s)\Aimport\b", "")
    rust = F.regexp_replace(flat, r"(?s)\A(?:pub(?:\([^)]*\))?\s+)?use\b", "")
    # `a::b::{self, c}` also brings in b.
    rust = F.regexp_replace(rust, r"([\p{L}_][\p{L}\p{N}_]*)::\{([^{}]*)\bself\b", "$1::{$2$1")
    body = (
        F.when(language == "python", python)
        .when(language.isin("javascript", "typescript"), script)
        .when(language == "java", java)
        .when(language == "go", go)
        .otherwise(rust)
    )
    go_items = F.split(body, r"[()\n;]")
    return F.when(language == "go", go_items).otherwise(F.split(body, r"[(),{};]"))


def _item_name(item: Column, language: Column) -> Column:
    """Alias if there is one, else the last name; empty for wildcards and path prefixes."""
    word = r"[\p{L}_$][\p{L}\p{N}_$]*"
    alias = F.regexp_extract(item, rf"\bas\s+({word})\s*\z", 1)
    last = F.regexp_extract(item, rf"({word})\s*\z", 1)
    plain = F.when(alias != "", alias).otherwise(last)
    go_alias = F.regexp_extract(item, rf"\A\s*({word}|\.)\s+[\"`]", 1)
    go_last = F.regexp_extract(item, rf"({word})[\"`]\s*\z", 1)
    go = F.when(go_alias.isin("_", "."), F.lit("")).when(go_alias != "", go_alias).otherwise(go_last)
    return F.when(language == "go", go).otherwise(F.when(plain.isin("_", "self"), F.lit("")).otherwise(plain))


def with_import_names(imports: DataFrame) -> DataFrame:
    """Imports with `names`, the array of identifiers each one brings in."""
    language = F.col("language")
    items = _import_items(F.col("import_text"), language)
    names = F.array_distinct(F.array_remove(F.transform(items, lambda i: _item_name(i, language)), ""))
    return imports.withColumn("names", names)


def import_names(imports: DataFrame) -> DataFrame:
    return with_import_names(imports).select("doc_id", "line_no", F.explode("names").alias("name"))


def _is_used(names: Column, content: Column) -> Column:
    return F.exists(
        names,
        lambda n: F.contains(content, F.concat(F.lit(" "), n))
        | F.contains(content, F.concat(n, F.lit("(")))
        | F.contains(content, F.concat(n, F.lit("."))),
    )


def _imports_per_document(imports: DataFrame) -> DataFrame:
    """One row per document; the list is bounded by the size of one file."""
    entry = F.struct("line_no", "import_text", "names")
    return with_import_names(imports).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(entry)).alias("imports")
    )


def _relevant(imports: Column, content: Column, smart: bool) -> Column:
    return F.filter(imports, lambda i: _is_used(i["names"], content)) if smart else imports


def filter_imports(chunks: DataFrame, imports: DataFrame, smart: bool = True) -> DataFrame:
    """(doc_id, chunk_id, line_no, import_text) of the imports a chunk uses.

    The imports of a document travel as one array, so only used ones become rows.
    """
    joined = chunks.select("doc_id", "chunk_id", "content").join(_imports_per_document(imports).hint("merge"), "doc_id")
    used = _relevant(F.col("imports"), F.col("content"), smart)
    return joined.select("doc_id", "chunk_id", F.explode(used).alias("i")).select(
        "doc_id", "chunk_id", "i.line_no", "i.import_text"
    )


def locate_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Fills `start_line` and `end_line` where the start is 0 or missing.

    The first occurrence of the chunk's first non-blank line lies in the first source line that
    contains it. No match gives (0, 0); a chunk without a document stays as it is. Only chunks
    without lines meet their text; the others pass.
    """
    content = F.col("content")
    first = tx.strip(F.regexp_extract(content, r"\A[\s\x1c-\x1f\x85\p{Z}]*([^\n]*)", 1))
    unplaced = F.coalesce("start_line", F.lit(0)) == 0
    joined = (
        chunks.where(unplaced).join(docs.select("doc_id", F.col("text").alias("_text")).hint("merge"), "doc_id", "left")
        .withColumn("_search", F.col("_text").isNotNull())
        .withColumn("_first", F.when(F.col("_search"), first))
        .withColumn("_at", F.when(F.col("_first") != "", F.call_function("instr", "_text", "_first")))
        .withColumn("_line", F.when(F.col("_at") > 0, tx.count_of(F.substr("_text", F.lit(1), F.col("_at") - 1), "\n")))
    )
    end = F.col("_line") + tx.count_of(content, "\n")
    located = {
        "start_line": F.when(F.col("_search"), F.coalesce("_line", F.lit(0))).otherwise(F.col("start_line")),
        "end_line": F.when(F.col("_search"), F.coalesce(end, F.lit(0))).otherwise(F.col("end_line")),
    }
    found = joined.select(*[
        located[c].cast("int").alias(c) if c in located else F.col(c) for c in chunks.columns
    ])
    return chunks.where(~unplaced).unionByName(found)


def enrich_chunks(
    chunks: DataFrame,
    docs: DataFrame,
    include_imports: bool = True,
    include_parent: bool = True,
    smart: bool = True,
) -> DataFrame:
    """Chunks with used imports and the enclosing signature put in front.

    Adds `original_code` and `context_enriched` to the metadata. A chunk without context or
    without a known document passes unchanged. One join per kind of context, on the document.
    """
    lines = code_lines(code_documents(docs))
    joined = locate_chunks(chunks, docs).repartition("doc_id")
    content = F.col("content")
    parts = []
    if include_imports:
        joined = joined.join(_imports_per_document(extract_imports(lines)).hint("merge"), "doc_id", "left")
        used = _relevant(F.col("imports"), content, smart)
        parts.append(F.array_join(F.transform(used, lambda i: i["import_text"]), "\n"))
    if include_parent:
        entry = F.struct("start_line", "end_line", context_stub(F.col("signature")).alias("stub"))
        nested = signatures(scopes(lines), lines).groupBy("doc_id").agg(F.collect_list(entry).alias("scopes"))
        joined = joined.join(nested.hint("merge"), "doc_id", "left")
        around = F.filter(
            "scopes",
            lambda s: (s["start_line"] < F.col("start_line")) & (s["end_line"] >= F.col("end_line")),
        )
        parts.append(F.array_max(around)["stub"])
    if not parts:
        return joined.select(*chunks.columns)
    context = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n\n")
    enriched = joined.withColumn("_context", context)
    has = F.col("_context") != ""
    metadata = F.col("metadata").withField("original_code", F.when(has, content)).withField(
        "context_enriched", F.when(has, F.lit(True))
    )
    text = F.when(has, F.concat_ws("\n\n", "_context", "content")).otherwise(content)
    return enriched.withColumn("metadata", metadata).withColumn("content", text).select(*chunks.columns)
