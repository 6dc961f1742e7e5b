"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from lodestone import config
from lodestone.operators import structure
from suite import samples, views

ORACLES: dict[str, str] = {}
WS = config.WHITESPACE
NL = "chr(10)"
HASH_DIM = 256


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _case(number: str, values: list[str]) -> str:
    arms = " ".join(f"when {i} then {_text(v)}" for i, v in enumerate(values))
    return f"case {number} {arms} end"


def _with(ctes: list[str], select: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + select


def _oracle(name: str, ctes: list[str], select: str) -> None:
    ORACLES[name] = _with(ctes, select)


# Files

VDOCS = f"""vdocs as (
  select doc_id, source as repo_name,
    concat({_case("doc_id % 7", views.FOLDERS)}, case when doc_id % 4 = 0 then concat(lang, '/') else '' end,
           'f', doc_id::varchar, {_case("doc_id % 16", views.SUFFIXES)}) as rel_path,
    text
  from documents)"""

_BEFORE, _AFTER = samples.IGNORE_FILE.split("{extra}")

VFILES = f"""vfiles as (
  select repo_name, rel_path,
    doc_id % 17 = 0 as bad_head, doc_id % 17 <> 0 and doc_id % 19 = 0 as bad_tail,
    case when doc_id % 17 <> 0 and doc_id % 19 <> 0 and doc_id % 5 = 0
         then replace(text, {NL}, chr(13) || {NL}) else text end as raw
  from vdocs
  union all
  select distinct repo_name, '.gitignore', false, false,
    concat({_text(_BEFORE)}, case when substr(repo_name, 4)::int % 2 = 0 then {_text(samples.EXTRA_PATTERNS[0])}
           else {_text(samples.EXTRA_PATTERNS[1])} end, {_text(_AFTER)})
  from vdocs),
facts as (
  select repo_name, rel_path, raw,
    strlen(raw) + case when bad_head or bad_tail then 1 else 0 end as length,
    bad_head or (bad_tail and length(raw) < 8192) as is_bin,
    bad_tail and length(raw) >= 8192 as late,
    case when bad_head then '\\xFF'::blob || encode(raw) when bad_tail then encode(raw) || '\\xFF'::blob
         else encode(raw) end as content,
    case when bad_head or bad_tail then null
         else regexp_replace(raw, '\\r\\n?', {NL}, 'g') end as text
  from vfiles)"""

FACTS = [VDOCS, VFILES]

PATTERNS = "known(kind, pattern, bare, regex, parity) as (values " + ", ".join(
    f"({_text(k)}, {_text(p)}, {_text(b)}, {_text(r)}, {'NULL::int' if parity is None else parity})"
    for k, p, b, r, parity in samples.PATTERNS
) + """),
rules as (
  select r.repo_name, k.* from (select distinct repo_name from vdocs) r
  join known k on k.parity is null or substr(r.repo_name, 4)::int % 2 = k.parity)"""

MATCHES = """matches as (
  select f.repo_name, f.rel_path, r.pattern, r.kind from vfiles f join rules r using (repo_name)
  where (r.regex is null and (f.rel_path = r.bare or list_contains(string_split(f.rel_path, '/'), r.bare)))
     or (r.regex is not null and (regexp_full_match(f.rel_path, r.regex)
         or len(list_filter(string_split(f.rel_path, '/'), lambda p: regexp_full_match(p, r.regex))) > 0))
     or (r.kind = 'dir' and (starts_with(f.rel_path, r.bare || '/') or string_split(f.rel_path, '/')[1] = r.bare)))"""

LEVELS = """entries as (
  select repo_name, rel_path, len(string_split(rel_path, '/')) as depth,
    unnest(range(1, len(string_split(rel_path, '/')) + 1)) as level from vfiles),
prefixes as (
  select *, string_split(rel_path, '/')[1:level] as parts, array_to_string(string_split(rel_path, '/')[1:level], '/') as prefix
  from entries),
levels as (
  select p.repo_name, p.rel_path, p.depth, min(p.level) as level from prefixes p join rules r using (repo_name)
  where (r.regex is null and (p.prefix = r.bare or list_contains(p.parts, r.bare)))
     or (r.regex is not null and (regexp_full_match(p.prefix, r.regex)
         or len(list_filter(p.parts, lambda x: regexp_full_match(x, r.regex))) > 0))
     or (r.kind = 'dir' and (starts_with(p.prefix, r.bare || '/') or p.parts[1] = r.bare))
  group by all),
pruning as (
  select f.repo_name, f.rel_path,
    case when l.level is null then 'keep' when l.level < l.depth then 'pruned' else 'gitignore' end as status
  from vfiles f left join levels l using (repo_name, rel_path))"""

RULES = FACTS + [PATTERNS]
PRUNING = RULES + [LEVELS]

REASONS = f"""reasons as (
  select f.*, case when p.status = 'gitignore' then 'gitignore' when f.is_bin then 'binary'
    when f.length / 1048576.0 > {views.MAX_MB} then 'too_large (' || printf('%.1f', f.length / 1048576.0) || 'MB)'
    end as skip_reason
  from facts f join pruning p using (repo_name, rel_path) where p.status <> 'pruned')"""

CLASSIFIED = PRUNING + [REASONS]

STATUS = f"""statuses as (
  select repo_name, rel_path, case when late then 'failed' when trim(text, {_text(WS)}) = '' then 'empty'
    else 'success' end as status
  from reasons where skip_reason is null)"""

_oracle("scan_files", FACTS, "select repo_name, rel_path, length::bigint as length, md5(content) as digest, null::varchar as read_error from facts")
_oracle("read_manifest", FACTS, "select repo_name, rel_path, length::bigint as length, md5(content) as digest from facts")
_oracle("ignore_patterns", RULES, "select repo_name, pattern from rules")
_oracle("read_text", FACTS, "select repo_name, rel_path, text, case when text is null then 'UnicodeDecodeError' end as error from facts")
for _kind in ("literal", "dir", "glob"):
    _oracle(f"ignore_{_kind}", RULES + [MATCHES], f"select repo_name, rel_path, pattern from matches where kind = '{_kind}'")
_oracle("prune_dirs", PRUNING, "select * from pruning")
_oracle("outside_root", [VDOCS], "select doc_id, doc_id % 3 = 0 as outside, case when doc_id % 3 <> 0 then rel_path end as rel_path from vdocs")
_oracle("is_binary", FACTS, 'select repo_name, rel_path, is_bin as "binary" from facts')
_oracle("too_large", FACTS, f"""select repo_name, rel_path, round(length / 1048576.0, 6) as size_mb,
  length / 1048576.0 > {views.MAX_MB} as "over",
  case when length / 1048576.0 > {views.MAX_MB} then 'too_large (' || printf('%.1f', length / 1048576.0) || 'MB)' end as reason
  from facts""")
_oracle("skip_reason", CLASSIFIED, "select repo_name, rel_path, skip_reason from reasons")
_oracle("skip_log", CLASSIFIED, "select repo_name, skip_reason, rel_path from reasons where skip_reason is not null")
_oracle("skip_stats", CLASSIFIED, """select repo_name, skip_reason, count(*) as n from reasons where skip_reason is not null group by all
  union all select repo_name, 'Total skipped', count(*) from reasons where skip_reason is not null group by all""")
_oracle("ingest_status", CLASSIFIED + [STATUS], "select * from statuses")
_oracle("ingest_summary", CLASSIFIED + [STATUS], """select repo_name, coalesce(a, 0) as attempted, coalesce(g, 0) as successful,
  coalesce(a - g, 0) as failed, round(100.0 * g / a, 1)::double as success_rate, pattern_count
  from (select repo_name, count(*) as pattern_count from rules group by all
    union all select max(repo_name) || '-empty', 0 from rules) left join (
    select repo_name, count(*) as a, count(*) filter (status <> 'failed') as g from statuses group by all)
  using (repo_name)""")

# Blank texts

_WHITE = "regexp_replace({0}, '[^\\s\\p{{Z}}]', '', 'g')"
_oracle("drop_blank", [VDOCS], f"""select doc_id, t as text from (
  select doc_id, case when doc_id % 8 = 0 then {_WHITE.format('text')} || '\u2003\u3000' else text end as t from vdocs)
  where trim(t, {_text(WS)}) <> ''""")
ASKED = f"""asked as (
  select item_id as query_id, case when item_id % 5 = 0 then {_WHITE.format('text')} else text end as query from benchmark)"""
_oracle("guard_query", [ASKED], f"""select query_id, query,
  case when trim(query, {_text(WS)}) = '' then 'empty_query' else 'ok' end as status from asked""")

# Projections

_LANG = "case lower(regexp_extract({0}, '^.+(\\.[^.]+)$', 1)) " + " ".join(
    f"when '{e}' then '{l}'" for e, l in config.LANGUAGE_BY_EXTENSION.items()
) + " end"
META = f"""meta as (
  select *, list_last(string_split(rel_path, '/')) as file_name,
    {_LANG.format("list_last(string_split(rel_path, '/'))")} as language,
    sha256(repo_name || '/' || rel_path) as sha
  from vdocs),
docs as (
  select *, case when language is null then 'text' else 'code' end as content_type from meta)"""
DOCS = [VDOCS, META]
_oracle("path_parts", DOCS, "select doc_id, rel_path, file_name, repo_name from docs")
_oracle("detect_language", DOCS, "select doc_id, language is not null as is_code, language, content_type from docs")
_oracle("build_metadata", DOCS, "select sha as doc_id, rel_path as file_path, file_name, repo_name, content_type, language from docs")
_oracle("unwrap_metadata", DOCS, """select doc_id, case when doc_id % 3 = 2 then 'Unknown' else rel_path end as file_path,
  case when doc_id % 3 = 2 then 'Unknown' else file_name end as file_name,
  case when doc_id % 3 = 2 then 'text' else content_type end as content_type,
  case when doc_id % 3 = 2 then '' else coalesce(language, '') end as language from docs""")
# Chunks


def _lines_of(text: str) -> str:
    return f"(length({text}) - length(replace({text}, {NL}, '')))"


def code_windows(source: str, name: str, lines: int = 40, overlap: int = 15) -> str:
    """Line windows of the table `source` (sha, repo_name, rel_path, text) as the CTE `name`."""
    step = lines - overlap
    return f"""{name}_w as (
  select sha, repo_name, rel_path, all_lines, unnest(range(0, 1 + greatest(0, ceil((len(all_lines) - {lines}) / {step}.0))::int)) as k
  from (select *, string_split(text, {NL}) as all_lines from {source})),
{name}_b as (
  select *, array_to_string(all_lines[{step} * k + 1 : {step} * k + {lines}], {NL}) as body from {name}_w),
{name}_p as (
  select *, unnest(range(0, greatest(length(body) - 1, 0) // 1500 + 1)) as j from {name}_b),
{name} as (
  select *, sha256(repo_name || '/' || rel_path || '#' || chunk_no) as chunk_id, first_line + {_lines_of('content')} as last_line from (
    select sha, repo_name, rel_path, row_number() over (partition by sha order by k, j) - 1 as chunk_no,
      {step} * k + {_lines_of('substr(body, 1, j * 1500)')} as first_line, substr(body, j * 1500 + 1, 1500) as content
    from {name}_p))"""


def text_windows(source: str, name: str) -> str:
    return f"""{name} as (
  select *, sha256(repo_name || '/' || rel_path || '#' || chunk_no) as chunk_id from (
    select sha, doc_id, repo_name, rel_path, language, k as chunk_no, substr(text, 824 * k + 1, 1024) as content from (
      select *, unnest(range(0, 1 + greatest(0, ceil((length(text) - 1024) / 824.0))::int)) as k from {source})))"""


WINDOWS = DOCS + [text_windows("docs", "chunks")]
_oracle("chunk_text_window", WINDOWS, "select chunk_id, repo_name, chunk_no::bigint as chunk_no, content from chunks")
_oracle("chunk_code", DOCS + [code_windows("docs", "cc")], """select chunk_id, repo_name, chunk_no::bigint as chunk_no,
  first_line::bigint as start_line, last_line::bigint as end_line, content from cc""")
BOTH = [
    "as_code as (select * from docs where language is not null)",
    "as_text as (select * from docs where language is null)",
    code_windows("as_code", "cc"), text_windows("as_text", "chunks"),
    """mixed as (
  select chunk_id, repo_name, chunk_no::bigint as chunk_no, first_line::bigint as start_line, last_line::bigint as end_line, content from cc
  union all select chunk_id, repo_name, chunk_no::bigint, -1, -1, content from chunks)""",
]
_oracle("chunk_docs", DOCS + BOTH, "select * from mixed")
_oracle("ingest_stream", DOCS[:1] + [META.replace("from vdocs", "from vdocs where doc_id % 11 <> 0")] + BOTH,
        "select chunk_id, chunk_no, content from mixed")
_oracle("index_roundtrip", WINDOWS, """select chunk_id, sha as doc_id, repo_name, chunk_no::bigint as chunk_no, content, rel_path as file_path,
  language from chunks""")
_oracle("index_count", WINDOWS, "select count(*) as n from chunks")
_oracle("index_sample", WINDOWS, "select chunk_id, content from chunks order by chunk_id limit 1")
_oracle("rebuild_index", WINDOWS, "select repo_name, count(*) as n from chunks group by all")

_oracle("chunk_text_sentence", DOCS + [f"""pieces as (
  select sha, row_number() over (partition by sha order by s, h) - 1 as i, substr(sentence, h * 1024 + 1, 1024) as piece from (
    select sha, s, sentences[s] as sentence, unnest(range(0, (length(sentences[s]) - 1) // 1024 + 1)) as h from (
      select sha, sentences, unnest(range(1, len(sentences) + 1)) as s from (
        select sha, regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+') as sentences from docs)))),
packed as (
  select sha, i, i as first, length(piece) as chars, [length(piece)] as fresh from pieces where i = 0
  union all
  select sha, i, case when fits then first else i - carry end,
    case when fits then chars + l else coalesce(list_sum(fresh[len(fresh) - carry + 1:]), 0) + l end,
    case when fits then list_append(fresh, l) else [l] end
  from (
    select p.sha, n.i, p.first, p.chars, p.fresh, length(n.piece) as l, p.chars + length(n.piece) <= 1024 as fits,
      list_max(list_filter(range(0, len(p.fresh) + 1),
        lambda m: coalesce(list_sum(p.fresh[len(p.fresh) - m + 1:]), 0) <= least(200, 1024 - length(n.piece)))) as carry
    from packed p join pieces n on n.sha = p.sha and n.i = p.i + 1)),
spans as (
  select sha, first, max(i) as last, row_number() over (partition by sha order by first, max(i)) - 1 as chunk_no
  from (select *, sum(opens) over (partition by sha order by i) as span from (
    select *, case when len(fresh) = 1 then 1 else 0 end as opens from packed)) group by sha, first, span)"""],
    """select sha256(d.repo_name || '/' || d.rel_path || '#' || s.chunk_no) as chunk_id, d.repo_name, s.chunk_no::bigint as chunk_no,
  string_agg(p.piece, '' order by p.i) as content
  from spans s join pieces p on p.sha = s.sha and p.i between s.first and s.last join docs d on d.sha = s.sha
  group by d.repo_name, d.rel_path, s.chunk_no""")

_oracle("locate_chunks", WINDOWS + [f"""wanted as (
  select *, trim(list_filter(string_split(content, {NL}), lambda l: trim(l, {_text(WS)}) <> '')[1], {_text(WS)}) as needle from chunks),
lines as (
  select sha, unnest(string_split(text, {NL})) as line, unnest(range(0, len(string_split(text, {NL})))) as line_no from docs),
hits as (
  select w.chunk_id, min(l.line_no) as line_no from wanted w join lines l using (sha) where contains(trim(l.line, {_text(WS)}), w.needle) group by all)"""],
    f"""select chunk_id, case when rel_path not like '%.log' then coalesce(line_no, 0)::bigint else -1 end as start_line,
  case when rel_path not like '%.log' then coalesce(line_no + {_lines_of('content')}, 0)::bigint else -1 end as end_line
  from chunks left join hits using (chunk_id)""")

# Code context

_FILL = "replace(replace({0}, '<K>', p_partkey::varchar), '<S>', p_size::varchar)"
_BODY = _case(f"p_partkey % {len(samples.FILES)}", [body for _, body in samples.FILES])
_EXT = _case(f"p_partkey % {len(samples.FILES)}", [e for e, _ in samples.FILES])
CODE = [
    f"""sources as (
  select 'parts' as repo_name, 'src/m' || p_partkey || '.' || {_EXT} as rel_path, {_FILL.format(_BODY)} as text, p_partkey, p_size from part),
code as (
  select *, sha256(repo_name || '/' || rel_path) as sha, {_LANG.format('rel_path')} as language from sources)""",
    "imports(language, line_no, stmt, names) as (values " + ", ".join(
        f"('{l}', {n}, {_text(s)}, [{', '.join(map(_text, names))}])" for l, n, s, names in samples.IMPORTS
    ) + ")",
    "spans(language, kind, s, e, sig) as (values " + ", ".join(
        f"('{l}', '{k}', {s}, {e}, {_text(sig)})" for l, k, s, e, sig in samples.SCOPES
    ) + ")",
    f"""found as (
  select c.sha, c.language, i.line_no, {_FILL.format('i.stmt')} as import_text, list_transform(i.names, lambda n: {_FILL.format('n')}) as names
  from code c join imports i using (language)),
nested as (
  select c.sha, c.language, kind, s, e, {_FILL.format('sig')} as sig from code c join spans using (language))""",
    code_windows("code", "cc", views.ENRICH_WINDOW["lines"], views.ENRICH_WINDOW["overlap"]),
    """used as (
  select c.chunk_id, f.line_no, f.import_text from cc c join found f using (sha)
  where len(list_filter(f.names, lambda n: contains(c.content, ' ' || n) or contains(c.content, n || '(') or contains(c.content, n || '.'))) > 0)""",
]


def _around(first: str, last: str) -> str:
    return f"""around as (
  select * from (
    select c.chunk_id, n.*, row_number() over (partition by c.chunk_id order by n.s desc) as nearest
    from cc c join nested n using (sha) where n.s < {first} and n.e >= {last}) where nearest = 1)"""


AROUND = _around("c.first_line", "c.last_line")
_oracle("extract_imports", CODE, "select sha as doc_id, language, line_no::bigint as line_no, import_text from found")
_oracle("import_names", CODE, "select sha as doc_id, line_no::bigint as line_no, unnest(names) as name from found")
_oracle("filter_imports", CODE, "select chunk_id, line_no::bigint as line_no, import_text from used")
_oracle("scopes", CODE, "select sha as doc_id, language, kind, s::bigint as start_line, e::bigint as end_line from nested")
_oracle("signature", CODE, "select sha as doc_id, s::bigint as start_line, sig as signature from nested")
_oracle("enclosing_scope", CODE + [AROUND], "select chunk_id, kind, s::bigint as start_line, e::bigint as end_line from around")
# A chunk that starts in line 0 is located again by its first non-blank line, which is line 0 here.
_oracle("enrich_chunks", CODE + [AROUND, f"""merged as (
  select chunk_id, string_agg(import_text, {NL} order by line_no) as block from used group by all),
parts as (
  select c.chunk_id, c.content, m.block, a.sig || {NL} || regexp_extract(a.sig, '^([ \\t]*)', 1) || '    # ...' as stub
  from cc c left join merged m using (chunk_id) left join around a using (chunk_id))"""],
    f"""select chunk_id, concat_ws({NL} || {NL}, block, stub, content) as content,
  case when block is not null or stub is not null then content end as original_code,
  block is not null or stub is not null as context_enriched from parts""")

_oracle("enrich_orphans", CODE + [AROUND, f"""merged as (
  select chunk_id, string_agg(import_text, {NL} order by line_no) as block from used group by all),
parts as (
  select c.chunk_id, c.content, m.block, a.sig || {NL} || regexp_extract(a.sig, '^([ \\t]*)', 1) || '    # ...' as stub
  from cc c join code using (sha) left join merged m on m.chunk_id = c.chunk_id and p_partkey % 3 <> 0
  left join around a on a.chunk_id = c.chunk_id and p_partkey % 3 <> 0)"""],
    f"""select chunk_id, concat_ws({NL} || {NL}, block, stub, content) as content,
  case when block is not null or stub is not null then content end as original_code,
  block is not null or stub is not null as context_enriched from parts""")

_STRINGS = r"""\"[^\"\\]*(\\.[^\"\\]*)*\""""
_oracle("code_lines", CODE[:1] + [f"""raw as (
  select sha, language, unnest(string_split(text, {NL})) as line, unnest(range(0, len(string_split(text, {NL})))) as line_no
  from code where language <> 'cpp'),
bare as (
  select *, case when language = 'python' then regexp_replace(regexp_replace(replace(line, '\"\"\"', '@@'), '{_STRINGS}', '', 'g'), '#.*', '')
    else regexp_replace(regexp_replace(line, '{_STRINGS}', '', 'g'), '//.*', '') end as code from raw),
states as (
  select *, coalesce(sum(case when language = 'python' then (length(code) - length(replace(code, '@@', ''))) / 2
      else contains(code, '/*')::int - contains(code, '*/')::int end)
    over (partition by sha order by line_no rows between unbounded preceding and 1 preceding), 0)::int as open from bare),
clean as (
  select *, case when language = 'python' and open % 2 = 1 then '' when language = 'python' then regexp_replace(code, '@@.*', '')
    when open > 0 then regexp_replace(code, '^.*?(\\*/|$)', '') else regexp_replace(code, '/\\*.*', '') end as live from states)"""],
    """select sha as doc_id, line_no::bigint as line_no, line, (length(line) - length(ltrim(line, ' ' || chr(9))))::bigint as indent,
  coalesce(sum(length(replace(live, '}', '')) - length(replace(live, '{', '')))
    over (partition by sha order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as depth from clean""")

# Vectors and search

TERMS = r"""terms as (
  select chunk_id, t as term, count(*) as tf, any_value(dl) as dl from (
    select chunk_id, unnest(ts) as t, len(ts) as dl from (
      select chunk_id, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}_]+'), lambda x: x <> '') as ts from chunks))
  group by all)"""
POSTINGS = WINDOWS + [TERMS]
QTERMS = r"""qterms as (
  select distinct query_id, term from (
    select query_id, unnest(regexp_split_to_array(lower(query), '[^\p{L}\p{N}_]+')) as term from asked) where term <> '')"""
ALL_ASKED = "asked as (select item_id as query_id, text as query from benchmark)"
BM25 = """size as (
  select count(*) as n, avg(dl) as avgdl from (select chunk_id, sum(tf) as dl from terms group by all)),
dfs as (select term, count(*) as df from terms group by all),
bm25 as (
  select query_id, chunk_id, score, rank from (
    select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (
      select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
      from qterms join terms using (term) join dfs using (term), size group by all)) where rank <= 3)"""


def _cells(dim: int) -> str:
    """Signed feature hashing of `terms` and `qterms` as sparse unit vectors in single precision."""
    def side(source: str, key: str, weight: str, name: str) -> str:
        digest = "('0x' || substr(md5(term), 1, 8))::bigint"
        return f"""{name}_raw as (
  select {key}, ({digest} // 2) % {dim} as bucket, sum({weight} * (1 - 2 * ({digest} % 2))) as v from {source} group by all),
{name} as (
  select {key}, bucket, (v / sqrt(sum(v * v) over (partition by {key})))::float::double as value from {name}_raw where v <> 0)"""

    return side("terms", "chunk_id", "tf", "cells") + ",\n" + side("qcounts", "query_id", "tf", "qcells")


QCOUNTS = r"""qcounts as (
  select query_id, term, count(*) as tf from (
    select query_id, unnest(regexp_split_to_array(lower(query), '[^\p{L}\p{N}_]+')) as term from asked) where term <> '' group by all)"""
DENSE = """norms as (select chunk_id, sqrt(sum(value * value)) as cn from cells group by all),
qnorms as (select query_id, sqrt(sum(value * value)) as qn from qcells group by all),
dots as (select query_id, chunk_id, sum(q.value * c.value) as dot from qcells q join cells c using (bucket) group by all),
pairs as (
  select query_id, chunk_id, round(coalesce(dot, 0) / coalesce(cn * qn, 1), 6) as score
  from (select query_id from qnorms) a cross join (select chunk_id from chunks) b
  left join dots using (query_id, chunk_id) left join norms using (chunk_id) left join qnorms using (query_id)),
dense as (
  select query_id, chunk_id, score, rank from (
    select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from pairs) where rank <= 3)"""
FUSED = """fused as (
  select query_id, chunk_id, round(sum(1.0 / (60 + rank)) * 61 / 2, 9)::double as score
  from (select query_id, chunk_id, rank from bm25 union all select query_id, chunk_id, rank from dense) group by all),
final as (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from fused)"""

_oracle("postings", POSTINGS, "select chunk_id, term, tf, dl from terms")
_oracle("corpus_stats", POSTINGS + [ALL_ASKED, QTERMS, BM25], "select term, df, n, round(avgdl, 6) as avgdl from dfs, size")
_oracle("bm25_topk", POSTINGS + [ALL_ASKED, QTERMS, BM25], "select query_id, chunk_id, score, rank from bm25")
ORACLES["bm25_topk_stored"] = ORACLES["bm25_topk"]
_oracle("embed_hash", POSTINGS + [ALL_ASKED, QCOUNTS, _cells(HASH_DIM)],
        "select chunk_id, bucket::bigint as bucket, round(value, 6) as value from cells")
ORACLES["embed_incremental"] = ORACLES["embed_hash"]
_oracle("check_dim", ["x as (select 1)"], "select vec_id, case when vec_id % 7 = 0 then len(embedding) = 65 else len(embedding) = 64 end as accepted from embeddings")
ORACLES["dense_topk"] = """select query_id, vec_id, score, rank from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
    select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) as score
    from embeddings q, embeddings c)) where rank <= 3"""
ORACLES["dense_topk_blocks"] = ORACLES["dense_topk"]
ORACLES["bm25_topk_blocks"] = ORACLES["bm25_topk"]
ORACLES["dense_topk_ivf"] = ORACLES["dense_topk"]
ORACLES["ivf_recall"] = """select 3 * count(*) as n, true as enough, count(*) as indexed from embeddings"""
SEARCH = POSTINGS + [ALL_ASKED, QTERMS, QCOUNTS, BM25, _cells(config.EMBEDDING_DIM), DENSE, FUSED]
_oracle("fuse_distribution", SEARCH[:-1] + ["""both_lists as (
  select 2.0 as weight, query_id, chunk_id, score from bm25 union all select 1.0, query_id, chunk_id, score from dense),
scaled as (
  select query_id, chunk_id, weight * case when deviation < 1e-9 then 0.5 else 0.5 + (score - mean) / (6 * deviation) end as part from (
    select *, avg(score) over (partition by weight, query_id) as mean, stddev_pop(score) over (partition by weight, query_id) as deviation
    from both_lists)),
summed as (
  select query_id, chunk_id, round(sum(part) / 3.0, 9)::double as score from scaled group by all)"""],
    """select query_id, chunk_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, chunk_id) as rank
  from summed""")
_oracle("rrf", SEARCH, "select query_id, chunk_id, score from fused")
_oracle("hybrid_search", SEARCH, """select query_id, rank, chunk_id, rel_path as file_path, list_last(string_split(rel_path, '/')) as file_name,
  case when language is null then 'text' else 'code' end as content_type, coalesce(language, '') as language, content, round(score, 3) as score
  from final join chunks using (chunk_id)""")
_oracle("result_count", POSTINGS + [ASKED, QTERMS, QCOUNTS, BM25, _cells(config.EMBEDDING_DIM), DENSE, FUSED], """select query_id, count(chunk_id) as n
  from asked left join final using (query_id) group by all""")

# What is shown

RESULTS = """results as (
  select query_id, rank, chunk_id, content, rel_path as file_path, list_last(string_split(rel_path, '/')) as file_name, repo_name,
    case when language is null then 'text' else 'code' end as content_type, language, score from final join chunks using (chunk_id))"""
SHOWN = POSTINGS + [ASKED, QTERMS, QCOUNTS, BM25, _cells(config.EMBEDDING_DIM), DENSE, FUSED, RESULTS]
_oracle("api_rows", SHOWN, """select query_id, rank, chunk_id, file_path, file_name, content_type, coalesce(language, '') as language, content,
  round(score, 3) as score from results""")
_HEAD = "'[' || rank || '] ' || file_path || case when language is null then '' else ' (' || language || ')' end"
_SCORE = "' | Score: ' || printf('%.3f', score)"
_oracle("display_header", SHOWN, f"select query_id, chunk_id, {_HEAD} as header from results union all select query_id, chunk_id, {_HEAD} || {_SCORE} from results")
_PREVIEW = "case when length({0}) > 500 then substr({0}, 1, 500) || '...' else {0} end"
_oracle("display_preview", DOCS, f"select doc_id, {_PREVIEW.format('text')} as preview from docs")
_oracle("display_metadata", DOCS, f"select doc_id, '  • file_path: ' || rel_path || {NL} || '  • repo_name: ' || repo_name as lines from docs")
_RULE = "repeat('━', 80)"
_oracle("display_block", SHOWN, f"""select query_id, rank, 'short' as form, concat_ws({NL}, {_RULE}, {_HEAD} || {_SCORE}, {_RULE}, {_PREVIEW.format('content')}) as block from results
  union all select query_id, rank, 'full', concat_ws({NL}, {_RULE}, {_HEAD}, {_RULE}, content, '', 'Metadata:',
    '  • file_path: ' || file_path, '  • file_name: ' || file_name, '  • repo_name: ' || repo_name,
    '  • content_type: ' || content_type, '  • language: ' || language) from results""")
_JSON = " || ',' || chr(10) || ".join(
    f"'      \"{c}\": ' || " + (f"to_json({v})" if c not in ("rank", "score") else v)
    for c, v in [
        ("rank", "rank::varchar"), ("file_path", "file_path"), ("file_name", "file_name"),
        ("language", "coalesce(language, '')"), ("content_type", "content_type"), ("content", "content"),
        ("score", "round(score, 3)::varchar"),
    ]
)
_oracle("response_json", SHOWN + [f"""listed as (
  select query_id, count(*) as n, string_agg('    {{' || {NL} || {_JSON} || {NL} || '    }}', ',' || {NL} order by rank) as body
  from results group by all)"""], f"""select query_id, coalesce(n, 0) as total_results,
  '{{' || {NL} || '  "query": ' || to_json(query) || ',' || {NL} || '  "total_results": ' || coalesce(n, 0)
  || ',' || {NL} || '  "results": ' || case when n is null then '[]' else '[' || {NL} || body || {NL} || '  ]' end || {NL} || '}}' as response
  from asked left join listed using (query_id)""")
_oracle("join_mode", SEARCH, "select query_id, chunk_id, score, rank from final")
ORACLES["hybrid_search_stored"] = ORACLES["hybrid_search"]
_oracle("responses_written", SEARCH + [RESULTS], """select query, total_results, rank, file_path, round(score, 3) as score
  from results join asked using (query_id) join (select query_id, count(*) as total_results from results group by all) using (query_id)""")

# Stored indexes

_STORED = """select chunk_id, sha as doc_id, repo_name, chunk_no::bigint as chunk_no, content, rel_path as file_path, language from chunks"""
_oracle("index_replace", [VDOCS, META.replace("from vdocs", "from vdocs where doc_id % 3 <> 0"), text_windows("docs", "chunks")], _STORED)
ORACLES["index_upsert"] = ORACLES["index_roundtrip"]
_oracle("list_indices", WINDOWS, "select unnest(['lodestone_first', 'lodestone_second']) as name, (select count(*) from chunks) as n")

# Two runs over a tree that changes

_oracle("snapshot_diff", FACTS + ["""numbered as (
  select repo_name, rel_path, regexp_extract(rel_path, 'f(\\d+)[^/]*$', 1)::bigint as k, content from facts where rel_path <> '.gitignore'),
old as (
  select repo_name, rel_path, sha256(content) as digest, octet_length(content) as size from numbered where k % 13 <> 0),
new as (
  select repo_name, case when k % 7 = 0 then 'moved/' || rel_path else rel_path end as rel_path,
    sha256(content || case when k % 3 = 0 then '\\x0Amore'::blob else ''::blob end) as digest,
    octet_length(content) + case when k % 3 = 0 then 5 else 0 end as size
  from numbered where k % 11 <> 0),
both_runs as (
  select coalesce(n.repo_name, o.repo_name) as repo_name, coalesce(n.rel_path, o.rel_path) as rel_path,
    coalesce(n.digest, o.digest) as digest, coalesce(n.size, o.size) as size,
    case when o.rel_path is null then 'added' when n.rel_path is null then 'deleted' when n.digest = o.digest then 'unchanged' else 'changed' end as change
  from new n full join old o on n.repo_name = o.repo_name and n.rel_path = o.rel_path),
ranked as (
  select *, row_number() over (partition by repo_name, digest, change order by rel_path) as place from both_runs where size > 0),
moves as (
  select a.repo_name, a.rel_path, d.rel_path as old_path from ranked a join ranked d on a.repo_name = d.repo_name and a.digest = d.digest
    and a.place = d.place and a.change = 'added' and d.change = 'deleted')"""],
    """select b.repo_name, b.rel_path, case when m.old_path is not null then 'renamed' else b.change end as change, m.old_path, b.digest
  from both_runs b left join moves m using (repo_name, rel_path)
  where not (b.change = 'deleted' and (b.repo_name, b.rel_path) in (select (repo_name, old_path) from moves))""")

# Generated code: the spans follow from the numbers of the part

_oracle("scopes_generated", ["""generated as (
  select sha256('generated/gen/m' || p_partkey || '.java') as doc_id, p_partkey % 31 as below from part)"""],
    """select doc_id, 'class' as kind, 0::bigint as start_line, (below + 6)::bigint as end_line from generated
  union all select doc_id, 'function', 1, below + 5 from generated""")

# Generated strings and comments: what a lexer finds follows from the numbers


def _lexeme_rows() -> str:
    rows = []
    for k, (extension, parts) in enumerate(samples.LEXEMES):
        offset = []
        for repeated, line, code, inside, depth in parts:
            at = " + ".join(["0", *offset])
            rows.append(
                f"select sha256('generated/lex/m' || p_partkey || '{extension}') as doc_id, ({at} + i - 1)::bigint as line_no, "
                f"replace({_text(code)}, '<K>', p_partkey::varchar) as code, {inside} as inside, ({depth})::bigint as depth "
                f"from (select p_partkey, p_size as d, unnest(range(1, {'p_size + 1' if repeated else '2'})) as i "
                f"from part where p_partkey % {len(samples.LEXEMES)} = {k})"
            )
            offset.append("d" if repeated else "1")
    return "\n  union all ".join(rows)


ORACLES["code_lines_stateful"] = _lexeme_rows()

# Generated modules: lines and scopes follow from the numbers, the cheapest cuts from a recursion over lines

_oracle("chunk_code_structured", ["""part_keys as (
  select p_partkey as k from part)""", f"""parts as (
  select p_partkey as k, p_partkey % 2 = 1 as java, unnest(range(0, p_size::bigint % 7 + 3)) as j from part),
bodies as (
  select *, unnest(range(1, k * (j + 3) % 47 + 2)) as i from parts),
rows_of as (
  select k, -1 as j, 0 as i, case when k % 2 = 1 then 'class C' || k || ' {{' else 'import os' end as line from part_keys
  union all select k, 1000, 0, '}}' from part_keys where k % 2 = 1
  union all select k, j, -1, '' from parts where (k + j) % 2 = 0
  union all select k, j, 0, case when java then '  int f' || j || '() {{' else 'def f' || j || '():' end from parts
  union all select k, j, i, case when i % 5 = 0 then '' else case when java then '  ' else '' end || '    x = '
    || case when k % 11 = 3 and i = 3 then repeat('y + ', 400) else '' end || i || case when java then ';' else '' end end from bodies
  union all select k, j, 1000, '  }}' from parts where java),
lines as materialized (
  select *, row_number() over (partition by k order by j, i) - 1 as line_no, length(line) as size from rows_of),
spans as materialized (
  select k, min(line_no) as s, max(line_no) as e, sum(size + 1) - 1 as chars from lines l
  where line_no <= (select max(m.line_no) from lines m where m.k = l.k and m.j = l.j and m.line <> '') and i >= 0 and j between 0 and 999
  group by k, j
  union all select k, 0, max(line_no), sum(size + 1) - 1 from lines where k % 2 = 1 group by k),
prices as materialized (
  select l.k, l.line_no, any_value(l.line) as line, any_value(l.size) as size,
    case when l.line_no = 0 then 0 else count(s.k) * {structure.PRICE_OF_DEPTH} + {structure.PRICE_OF_CUT}
      + count(s.k) filter (s.e - s.s < {config.CODE_CHUNK_LINES} and s.chars <= {config.CODE_CHUNK_CHARS}) * {structure.PRICE_OF_FITTING_SCOPE}
      + case when any_value(p.line) = '' then 0 else {structure.PRICE_OF_TEXT} end end as price
  from lines l left join spans s on s.k = l.k and s.s < l.line_no and s.e >= l.line_no left join lines p on p.k = l.k and p.line_no = l.line_no - 1
  group by l.k, l.line_no),
files as materialized (
  select k, count(*) as n, list(line order by line_no) as line, list(price order by line_no) as price,
    list_prepend(0, list(upto order by line_no)) as upto
  from (select *, sum(size + 1) over (partition by k order by line_no)::bigint as upto from prices) group by k),
ways(k, n, best, origin) as (
  select k, 0, [0::bigint], [0::bigint] from files
  union all
  select k, n + 1, list_append(best, pick.c), list_append(origin, pick.j) from (
    select w.k, w.n, best, origin, list_min(list_transform(
      list_filter(range(greatest(0, w.n + 1 - {config.CODE_CHUNK_LINES}), w.n + 1),
        lambda j: j = w.n or upto[w.n + 2] - upto[j + 1] - 1 <= {config.CODE_CHUNK_CHARS}),
      lambda j: {{'c': (best[j + 1] + price[j + 1])::bigint, 'j': j}})) as pick
    from ways w join files f on f.k = w.k where w.n < f.n)),
ended as materialized (select w.k, w.n, origin from ways w join files f on f.k = w.k and f.n = w.n),
cuts(k, first, after) as (
  select k, origin[n + 1], n from ended
  union all select c.k, origin[c.first + 1], c.first from cuts c join ended e on e.k = c.k where c.first > 0),
pieces as (
  select k, first, after - 1 as last, unnest(case when after - first = 1 and length(line[after]) > {config.CODE_CHUNK_CHARS}
    then list_transform(range(0, ceil(length(line[after]) / {config.CODE_CHUNK_CHARS})::bigint),
      lambda x: {{'p': x, 'body': substr(line[after], x * {config.CODE_CHUNK_CHARS} + 1, {config.CODE_CHUNK_CHARS})}})
    else [{{'p': 0::bigint, 'body': array_to_string(line[first + 1:after], {NL})}}] end) as piece
  from cuts join files using (k)),
numbered as (
  select *, row_number() over (partition by k order by first, piece.p) - 1 as chunk_no,
    'mod/m' || k || case when k % 2 = 1 then '.java' else '.py' end as rel_path from pieces)"""],
    """select sha256('generated/' || rel_path || '#' || chunk_no) as chunk_id, sha256('generated/' || rel_path) as doc_id,
  chunk_no::bigint as chunk_no, first::bigint as start_line, last::bigint as end_line, md5(piece.body) as digest from numbered""")
