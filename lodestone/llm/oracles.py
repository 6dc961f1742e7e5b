"""DuckDB SQL of the queries of this subpackage that SQL can express.

The others have none: fingerprints and SimHash need hashes DuckDB lacks, learnt models and
seeded choices are not SQL. Their tests compare with brute force or held-out labels.
"""

from __future__ import annotations

from lodestone.llm import merkle, minmax, phrases, rules, urls

_SPACE = "\\x20\\x09-\\x0D"


def _op2() -> str:
    tests = "\n  union all ".join(
        f"select stratum, '{rule}' as rule, {i} as i, {c} as cutoff, count(*) as n, "
        f"count(*) filter ({top} > {c} * {bottom}) as k from good group by stratum"
        for rule, (top, bottom) in rules.RULES.items() for i, c in enumerate(rules.CUTOFFS)
    )
    cuts = ", ".join(f"min(cutoff) filter (rule = '{rule}') as cut_{rule}" for rule in rules.RULES)
    rejected = " or ".join(
        f"coalesce({top} > cut_{rule} * {bottom}, false)" for rule, (top, bottom) in rules.RULES.items()
    )
    r = rules.RISK
    return f"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(lang, '(none)') as stratum, coalesce(text, '') as text from documents
), cut as (
  select rid, doc_id, stratum, text, regexp_extract_all(text, '[^{_SPACE}]+') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) as l
  from docs
), windows as (
  select rid, i, array_to_string(w[i:i + 4], ' ') as s from (select rid, w, unnest(range(1, len(w) - 3)) as i from cut)
), again as (
  select rid, i from (select rid, i, count(*) over (partition by rid, s) as n from windows) where n > 1
), covered as (
  select rid, count(distinct i + k) as n_repeat_words from again, range(0, 5) as t(k) group by rid
), counted as (
  select rid, doc_id, stratum, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    len(regexp_extract_all(text, '{rules.SYMBOLS}')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, len(regexp_extract_all(text, '{rules.MARKS}')) as n_marks, len(l) as n_lines
  from cut left join covered using (rid)
), measured as (
  select *, n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words as base_failed from counted
), good as (
  select * from measured where not base_failed
    and doc_id in (select doc_id from labels where quality is not null group by doc_id having max(quality) = 1)
), tests as (
  {tests}
), tails as (
  select *, case when k > n * {r} then 1.0 else list_sum(list_transform(range(0, k + 1), lambda j:
      exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({r}) + (n - j) * ln(1 - {r})))) end as tail,
    {len(rules.RULES)} * (select count(distinct stratum) from good) as m
  from tests
), chain as (
  select *, min(cast(tail <= {rules.DELTA} / m as int)) over (partition by stratum, rule order by i) as ok from tails
), limits as (
  select stratum, {cuts} from chain where ok = 1 group by stratum
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({rejected}) as kept
from measured left join limits using (stratum)"""


def _gram(size: int) -> str:
    value = str(size)
    for k in range(size):
        value = f"(({value} * 131 + c[i + {k}]) % 1000003)"
    return f"list_transform(range(1, len(c) - {size - 2}), lambda i: {value} % {urls.PLACES})"


def _places(table: str, columns: str) -> str:
    """Places of (host, path) of a table; `table` has columns host and path."""
    grams = ", ".join(_gram(n) for n in urls.GRAMS)
    return f"""select {columns}, list_distinct(list_concat({grams})) as pl from (
    select *, list_transform(range(1, length(s) + 1), lambda i: unicode(substr(s, i, 1))) as c from (
      select *, regexp_replace('^' || host || path || '$', '[0-9]', '0', 'g') as s from {table}))"""


def _host_path(table: str, columns: str) -> str:
    return f"""select {columns}, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from (select *, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from {table})"""


def _op10() -> str:
    rows = ", ".join(f"({label}, '{url}')" for label, url in urls.LABELLED)
    cases = lambda value: "case " + " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{value(v, h, p)}'"
        for v, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    ) + " end"
    return f"""
with recursive labelled(label, url) as (values {rows}),
lh as materialized ({_host_path("labelled", "label")}),
ex as materialized (select row_number() over (order by label, host, path) as i, cast(label as double) as y, pl
  from ({_places("lh", "label, host, path")})),
likes as (
  select a.i as i, list(len(list_intersect(a.pl, b.pl)) / sqrt(greatest(len(a.pl), 1)) / sqrt(greatest(len(b.pl), 1)) + 1.0 order by b.i) as row
  from ex a, ex b group by a.i),
m as materialized (select (select list(row order by i) from likes) as k, (select list(y order by i) from ex) as y),
descent(t, a) as (
  select 0, list_transform(y, lambda v: cast(0.0 as double)) from m
  union all
  select t + 1, list_transform(range(1, len(a) + 1), lambda i: a[i] * (1 - {urls.RATE} * {urls.DECAY})
      + {urls.RATE} * (y[i] - 1.0 / (1.0 + exp(-list_dot_product(k[i], a)))))
  from descent, m where t < {urls.STEPS}),
fitted as materialized (select i, a[i] as a, pl from ex, descent where t = {urls.STEPS}),
weights as materialized (
  select place, sum(a / sqrt(greatest(len(pl), 1))) as w from (select a, pl, unnest(pl) as place from fitted) group by place),
cut as materialized (select row_number() over () as rid, * from ({_host_path("pages", "page_id")})),
found as materialized ({_places("cut", "rid, page_id, host, path")}),
sums as (select rid, sum(w) as s from (select rid, unnest(pl) as place from found) join weights using (place) group by rid)
select page_id, host, path, {cases(lambda v, h, p: h + p)} as rule,
  coalesce({cases(lambda v, h, p: v)}, case when coalesce(s, 0) / sqrt(greatest(len(pl), 1)) + (select sum(a) from fitted) > 0
    then 'block' else 'allow' end) as verdict
from found left join sums using (rid)"""


def _op11() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sizes = range(1, phrases.MAX_WORDS + 1)
    grams = "\n  union all ".join(
        f"select lang, array_to_string(w[i:i + {n - 1}], ' ') as p, {n} as words from (select lang, w, unnest(range(1, len(w) - {n - 2})) as i from pieces)" for n in sizes
    )
    cut = f"cast(({phrases.SCALE}::hugeint * c.a * c.a) // (f.a::hugeint * g.a) as bigint)"
    return f"""
with pieces as materialized (
  select coalesce(lang, '{phrases.NO_LANGUAGE}') as lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from (
    select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents)
), counted as materialized (
  select lang, p, words, count(*) as a from (
  {grams}
  ) group by lang, p, words
), totals as (
  select lang, sum(a)::bigint as n from counted where words = 1 group by lang
), candidates as materialized (
  select *, string_split(p, ' ') as w from counted where words > 1 and a >= {phrases.MIN_COUNT}
), cuts as materialized (
  select lang, p, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as rest
  from (select *, unnest(range(1, words)) as k from candidates)
), weakest as (
  select c.lang, c.p, c.a, k, f.a as l, g.a as r, {cut} as score
  from cuts c join counted f on f.lang = c.lang and f.p = head join counted g on g.lang = c.lang and g.p = rest
  qualify row_number() over (partition by c.lang, c.p order by score, k) = 1
), inside as (
  select lang, array_to_string(w[i:i + size - 1], ' ') as p, max(a) as longer from (
    select *, unnest(range(1, words - size + 2)) as i from (select *, unnest(range(2, words)) as size from candidates))
  group by lang, w[i:i + size - 1]
), kept as (
  select w.*, w.p as phrase from weakest w left join inside i on w.lang = i.lang and w.p = i.p
  where longer is null or 100 * longer < {phrases.COVERED_PERCENT} * w.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join totals using (lang) qualify rank <= {phrases.TOP}"""


def _op12() -> str:
    def field(name: str) -> str:
        return f"coalesce(strlen(cast({name} as varchar)) || ':' || cast({name} as varchar), '-')"

    whole = " || ".join(field(f) for f in merkle.FIELDS)
    changed = whole.replace(field("text"), field("lowered"))
    run = f"partition by forest, tree, level, pos // {merkle.FANOUT} order by pos rows between"
    return f"""
with recursive crc(t) as materialized (
  select list(v order by i) from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) as v from range(256) r(i))
), docs as materialized (
  select row_number() over () as rid, *, translate(text, '{merkle.UPPER}', '{merkle.UPPER.lower()}') as lowered,
    coalesce('=' || source, '-') as key,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ord(x) as bigint))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc
  from documents, crc
), leaves as materialized (
  select rid, doc_id, key, sha256({whole}) as leaf,
    case when crc % {merkle.TAMPER_DIVISOR} = 0 then sha256({changed}) else sha256({whole}) end as claim
  from docs
), placed as materialized (
  select *, row_number() over (partition by key order by doc_id nulls first, leaf, rid) - 1 as pos, count(*) over (partition by key) as n
  from leaves
), low(tree, level, pos, n, digest) as (
  select key, 0, pos, n, leaf from placed
  union all
  select tree, level + 1, pos // {merkle.FANOUT}, max((n + {merkle.FANOUT - 1}) // {merkle.FANOUT}), sha256(string_agg(digest, '' order by pos))
  from low where n > 1 group by tree, level, pos // {merkle.FANOUT}
), subroots as materialized (
  select tree as key, digest, row_number() over (order by tree) - 1 as pos, count(*) over () as n from low where n = 1
), high(level, pos, n, digest) as (
  select 0, pos, n, digest from subroots
  union all
  select level + 1, pos // {merkle.FANOUT}, max((n + {merkle.FANOUT - 1}) // {merkle.FANOUT}), sha256(string_agg(digest, '' order by pos))
  from high where n > 1 group by level, pos // {merkle.FANOUT}
), nodes as (
  select 0 as forest, * from low union all select 1, '', * from high
), kin as materialized (
  select forest, tree, level, pos, n,
    coalesce(string_agg(digest, '') over ({run} unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(digest, '') over ({run} 1 following and unbounded following), '') as r
  from nodes
), walk(rid, forest, tree, level, pos, proof, hash) as (
  select rid, 0, key, 0, pos, '', claim from placed
  union all
  select rid, case when n > 1 then forest else forest + 1 end, case when n > 1 then tree else '' end,
    case when n > 1 then level + 1 else 0 end, case when n > 1 then w.pos // {merkle.FANOUT} else spos end,
    case when n > 1 then proof || l || r else proof end, case when n > 1 then sha256(l || hash || r) else hash end
  from walk w join kin using (forest, tree, level, pos) left join (select key, pos as spos from subroots) s on w.tree = s.key
  where forest < 1 or n > 1
)
select doc_id, leaf, s.digest as subroot, (select digest from high where n = 1) as root, sha256(proof) as proof_sha256,
  hash as folded_root, hash = (select digest from high where n = 1) as verified
from walk join kin using (forest, tree, level, pos) join placed p using (rid) join subroots s on p.key = s.key
where forest = 1 and kin.n = 1"""


def _op13() -> str:
    size = minmax.SHINGLE_WORDS
    return f"""
with recursive docs as materialized (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{merkle.UPPER}', '{merkle.UPPER.lower()}'), '[^{_SPACE}]+') as w from documents
), shingles as materialized (
  select distinct rid, hash(s) as h, s from (
    select rid, array_to_string(w[i:i + {size - 1}], ' ') as s from (
      select rid, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) as i from docs where len(w) > 0))
), sizes as materialized (
  select rid, count(*) as n from shingles group by rid
), pairs as materialized (
  select p.a, p.b from (
    select a.rid as a, b.rid as b, count(*) as common from shingles a join shingles b on a.h = b.h and a.s = b.s and a.rid < b.rid
    group by a.rid, b.rid) p(a, b, common)
  join sizes x on x.rid = p.a join sizes y on y.rid = p.b
  where 100 * common >= {minmax.PERCENT} * (x.n + y.n - common)
), reach(rid, other) as (
  select rid, rid from docs
  union
  select r.rid, l.b from reach r join (select a, b from pairs union all select b, a from pairs) l(a, b) on r.other = l.a
), lowest as (
  select r.rid, min(d.doc_id) as component_id from reach r join docs d on d.rid = r.other group by r.rid
)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id is not distinct from component_id as kept
from docs join lowest using (rid) left join sizes using (rid)"""


ORACLES: dict[str, str] = {
    "op2_quality_rules": _op2(), "op10_urls": _op10(), "op11_phrases": _op11(), "op12_merkle": _op12(),
    "op13_min_max_duplicates": _op13(),
}
