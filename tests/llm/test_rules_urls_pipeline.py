"""op2 and op10 against SQL, the pipeline stage by stage."""

import math
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import rules, simhash, urls
from lodestone.llm.oracles import ORACLES
from lodestone.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_sql(spark, name, folder):
    connection = duckdb.connect()
    for table in os.listdir(folder):
        connection.execute(f"create view {table.split('.')[0]} as select * from '{folder}/{table}'")
    ours = QUERIES[name](spark, folder)
    columns = sorted(ours.columns)
    theirs = connection.execute(ORACLES[name])
    found = [d[0] for d in theirs.description]
    assert sorted(found) == columns
    expected = sorted((tuple(row[found.index(c)] for c in columns) for row in theirs.fetchall()), key=repr)
    assert sorted((tuple(r) for r in ours.select(*columns).collect()), key=repr) == expected


def test_rules_measure_what_they_say(spark):
    texts = [
        "a b c d e x a b c d e", "a a a a a a a a", "a b c d e", "x\ny\nx\n \nx", "#$ ok |", None, "",
        " ".join(f"w{i % 7}" for i in range(30)), "é é é é é é", "one two three four five six seven eight nine ten",
    ]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in rules.measure(table, F.lit(None)).collect()}
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0D]+", t or "")
        runs = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        covered = {k + j for k, run in enumerate(runs) if runs.count(run) > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (
            len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines))
        ), t
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 10, 400, 3000) for k in (0, 1, 3, n // 50) if k <= n * 0.025]
    rows = spark.createDataFrame(cases, "n long, k long")
    for r in rows.select("n", "k", rules.binomial_tail(F.col("n"), F.col("k"), 0.025).alias("p")).collect():
        want = sum(math.comb(r.n, j) * 0.025**j * 0.975 ** (r.n - j) for j in range(r.k + 1))
        assert r.p == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_their_promise(spark):
    """Good texts of one stratum have many marks: there the rule may not use a strict cutoff."""
    draw = np.random.default_rng(4)
    rows = []
    for i in range(6000):
        loud = i % 2 == 0
        rows.append((i, "loud" if loud else "calm", 100, 500, 0, 0, 0, int(draw.binomial(100, 0.12 if loud else 0.001)), 1))
    table = spark.createDataFrame(
        rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_marks long, n_lines long"
    )
    got = {r.stratum: r for r in rules.certify(table).collect()}
    assert got["loud"].cut_marks > got["calm"].cut_marks
    for r in got.values():
        of = [x for x in rows if x[1] == r.stratum]
        assert sum(x[7] > r.cut_marks * x[2] for x in of) / len(of) < rules.RISK
        assert r.cut_symbols == min(rules.CUTOFFS)
    assert rules.certify(table.limit(40)).count() == 0


def test_op2_and_op10_stay_native(spark, sf_dir):
    for name in ("op2_quality_rules", "op10_urls"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_op2_odd_rows(odd, empty, odd_labels, no_labels):
    assert rules.judge(odd, odd_labels).count() == odd.count()
    rows = rules.judge(odd, no_labels).collect()
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert {r.doc_id for r in rows if r.kept} == {1, 6} - ({6} if next(r for r in rows if r.doc_id == 6).base_failed else set())
    assert rules.judge(empty, no_labels).count() == 0


def test_op10_hosts_paths_and_rules(spark):
    cases = {
        "http://NET/": ("net", "/", "net/", "block"), "http://a.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "x://b.example.com/de/": ("b.example.com", "/de/", "example.com/de/", "block"), "x://sub.org/fr/y": ("sub.org", "/fr/y", "org/fr/", "allow"),
        "http://example.net": ("example.net", "", None, None), "http://notnet/": ("notnet", "/", None, None), "no scheme/net/": ("", "", None, None),
        "a://h?x=://z/": ("h", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "http://a.net#/en/": ("a.net", "", None, None),
        "http://h/a\nb": ("h", "/a\nb", None, None), "http://\u00c9X.net/": ("\u00c9x.net", "/", "net/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    rows = {r.page_id: r for r in urls.judge(pages, urls.labelled_table(spark)).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict in ("allow", "block") and verdict in (None, rows[i].verdict)
    assert urls.judge(pages.limit(0), urls.labelled_table(spark)).count() == 0


def test_op10_model_tells_names_apart(spark):
    names = [("cheap-bets.example.com", "block"), ("casino-farm.example.org", "block"), ("reader.example.com", "allow"), ("mountain-hall.example.org", "allow")]
    pages = spark.createDataFrame([(i, f"https://{n}/en/1") for i, (n, _) in enumerate(names)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, urls.labelled_table(spark)).collect()}
    assert [got[i] for i in range(len(names))] == [v for _, v in names]
    none = urls.judge(pages, urls.labelled_table(spark).limit(0)).collect()
    assert all(r.verdict == "allow" for r in none)


def test_pipeline_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.doc_id for r in docs.select("doc_id").collect()]
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, [r.doc_id for r in docs.select("doc_id").collect()])
    assert len(seen["language_id"][1]) == len(texts)
    good = [d for d in seen["quality"][0] if d in labels and labels[d].quality == 1]
    bad = [d for d in seen["quality"][0] if d in labels and labels[d].quality == 0]
    kept = set(seen["quality"][1])
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.2 * len(bad)
    ids = sorted(seen["near_duplicates"][0])
    fps = np.array([simhash.fingerprint(texts[d]) for d in ids], np.uint64)
    label, near = np.array(ids), np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    assert sorted(seen["near_duplicates"][1]) == sorted(set(label.tolist()))
    assert set(seen["mixing"][1]) <= set(seen["near_duplicates"][1])
    assert set(seen["packing"][1]) == set(seen["mixing"][1])


def test_pipeline_odd_rows(spark, odd, empty, tmp_path):
    folder = str(tmp_path / "tables")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for label, table in (("odd", odd), ("empty", empty)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert name == "packing" or out.columns == table.columns
            out.write.parquet(str(tmp_path / label / name))
            docs = spark.read.parquet(str(tmp_path / label / name))
        assert (docs.count() > 0) == (label == "odd")


LONG_TEXTS = {
    "windows that repeat": "ab cd ef gh ij " * 100_000, "one word": "x" * 1_500_000, "lines": "line one two\n" * 100_000,
    "other words": " ".join(f"w{i}" for i in range(200_000)), "spaces": " " * 1_500_000, "marks": "!?#" * 400_000,
}


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n not in ("op10_urls", "op11_phrases")])
def test_very_long_texts(spark, tmp_path, name):
    """One row per document, or all ids, in time that grows with the text."""
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(LONG_TEXTS.values())]
    rows += [(100 + i, f"hello world number {i} and some more words to learn from", "en", "b", 50) for i in range(12)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(110)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = QUERIES[name](spark, folder).select("doc_id").collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    assert name == "op8_packing" or len(out) == len(rows)


def test_very_long_urls_and_repeated_rows(spark):
    long = "x://a.b/" + "path/to7" * 100_000
    rows = [(1, long), (1, long), (2, "x://example.net/en/" + "y" * 800_000), (3, None)]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.labelled_table(spark)).collect()
    assert sorted((r.page_id, len(r.path)) for r in out) == [(1, 800_001), (1, 800_001), (2, 800_004), (3, 0)]
    assert {r.verdict for r in out if r.page_id == 2} == {"allow"} and {r.verdict for r in out} <= {"allow", "block"}
