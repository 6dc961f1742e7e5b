"""Lexer state over lines, and code cut along its structure."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import enrich, lexer, structure


def docs_of(spark, files):
    rows = spark.createDataFrame(list(files.items()), "rel_path string, text string")
    return paths.with_document(rows.withColumn("repo_name", F.lit("r")))


def code_of(language, text):
    stack = []
    return [lexer.scan_line(line, stack, lexer.RULES[language]) for line in text.split("\n")], stack


@pytest.mark.parametrize("language, text, code", [
    ("javascript", "a = `x ${ f({b: `in ${y} }`}) } ' // no\n still } ` + 1; // c `", ["a =  f({b: y}) ", " + 1; "]),
    ("javascript", "b = /[/'\"]`/g.test(x) / 2 / 3;", ["b = .test(x) / 2 / 3;"]),
    ("typescript", "x = 'it\\\n s' + 1 /* { ' \n } */ {", ["x = ", " + 1 ", " {"]),
    ("javascript", "<p>Don't {x}</p>", ["<p>Don't {x}</p>"]),
    ("rust", "/* a /* b */ c\n */ f<'a>(x: &'a str, '{', '\\'') r#\"raw \" {\n \"# ; \"multi {\n\" }", ["", " f<'a>(x: &'a str, , ) ", " ; ", " }"]),
    ("python", "x = '''a # \"\"\" {\n ''' + \"{\" # }\nz = 'open {", ["x = ", " +  ", "z = 'open {"]),
    ("go", "s := `raw \\` + \"`\" // `\n/* ` */ {", ["s :=  +  ", " {"]),
    ("java", 's = """\n " { \\""" x\n """ + \'{\' + "//" { // }', ["s = ", "", " +  +  { "]),
])
def test_code_without_strings_and_comments(language, text, code):
    assert code_of(language, text) == (code, [])


@given(st.text(alphabet="ab'\"`$#{}/*\\r\n ", max_size=80), st.sampled_from(sorted(lexer.RULES)))
@settings(max_examples=400, deadline=None)
def test_any_text_ends_and_keeps_its_lines(text, language):
    code, _ = code_of(language, text)
    assert len(code) == text.count("\n") + 1
    for line, kept in zip(text.split("\n"), code, strict=True):
        assert all(line.count(c) >= kept.count(c) for c in set(kept))


def test_state_is_kept_across_batches_and_reset_between_documents(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        files = {f"m{i}.ts": "a = `{\n" * (i % 2) + "b {\n" * 7 for i in range(12)}
        rows = enrich.code_lines(enrich.code_documents(docs_of(spark, files))).groupBy("doc_id").agg(
            F.sum("depth").alias("depths"), F.sum(F.col("inside").cast("int")).alias("inside")
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.depths, r.inside) for r in rows) == [(0, 8)] * 6 + [(sum(range(8)), 0)] * 6


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 4)), min_size=1, max_size=9), st.integers(1, 4), st.integers(4, 20))
@settings(max_examples=300, deadline=None)
def test_cuts_are_the_cheapest(rows, lines, max_chars):
    sizes, prices = [r[0] for r in rows], [0, *[r[1] for r in rows[1:]]]
    n = len(rows)

    def allowed(cuts):
        spans = zip(cuts, [*cuts[1:], n], strict=True)
        return all(b - a == 1 or (b - a <= lines and sum(sizes[a:b]) + b - a - 1 <= max_chars) for a, b in spans)

    ways = [(0, *more) for k in range(n) for more in itertools.combinations(range(1, n), k)]
    least = min(sum(prices[c] for c in cuts) for cuts in ways if allowed(cuts))
    cuts = structure.cheapest_cuts(sizes, prices, lines, max_chars)
    assert allowed(cuts) and sum(prices[c] for c in cuts) == least


def test_prices_of_borders():
    sizes, blank = np.array([5, 0, 9, 7, 0, 5]), np.array([False, True, False, False, True, False])
    prices = structure.border_prices(sizes, blank, np.array([2]), np.array([4]), 40, 1500)
    assert prices.tolist() == [0, 3, 2, structure.PRICE_OF_FITTING_SCOPE + structure.PRICE_OF_DEPTH + 3, 3, 2]
    prices = structure.border_prices(sizes, blank, np.array([2]), np.array([4]), 40, 10)
    assert prices[3] == structure.PRICE_OF_DEPTH + 3


PYTHON = "import os\n\n" + "\n".join(
    f"@cached\n@twice(\n    {k})\ndef f{k}(a):\n" + "\n".join(f"    x{i} = '{{'" for i in range(k * 9 + 1)) + "\n" for k in range(6)
)
JAVA = "class A {\n" + "\n".join(
    f"  int f{k}() {{\n" + "\n".join(f"    call({i});" for i in range(k * 7)) + "\n  }" for k in range(1, 9)
) + "\n}\n"


def test_functions_that_fit_stay_whole(spark):
    files = {"a.py": PYTHON, "b.java": JAVA, "c.rb": "x\n\ny\n" * 90, "d.js": "var a = 1;" * 400 + "\nlet b;", "e.ts": "x"}
    docs = docs_of(spark, files)
    rows = structure.chunk_code_structured(docs).orderBy("doc_id", "chunk_no").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = enrich.scopes(enrich.code_lines(enrich.code_documents(docs))).collect()
    for doc_id, own in itertools.groupby(rows, key=lambda r: r.doc_id):
        own, text = list(own), texts[doc_id]
        lines = text.split("\n")
        joined = ""
        for a, b in zip([None, *own], own, strict=False):
            joined += b.content if a is None or a.start_line == b.start_line else "\n" + b.content
            assert len(b.content) <= 1500 and b.end_line - b.start_line < 40
        assert joined == text
        for s in spans:
            if s.doc_id == doc_id:
                end = max(i for i in range(s.start_line, s.end_line + 1) if lines[i].strip())
                body = "\n".join(lines[s.start_line:end + 1])
                if end - s.start_line < 40 and len(body) <= 1500:
                    assert sum(body in c.content for c in own) == 1
    python = [r.content for r in rows if r.metadata.file_path == "a.py"]
    assert any("@cached\n@twice(\n    3)\ndef f3" in c for c in python)
    assert [r.content for r in rows if r.metadata.file_path == "e.ts"] == ["x"]


def test_blank_and_null_documents(spark):
    docs = docs_of(spark, {"a.py": "", "b.py": " \n\t", "c.py": None})
    assert structure.chunk_code_structured(docs).collect() == []
