"""Search against brute force, on every physical path."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import embedding, fusion, keyword, reports, vector
from lodestone.plans import retrieve, sizing
from lodestone.sources import index_store

WORDS = ["red", "blue", "green", "fox", "dog", "café", "x_1", "the"]


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(5)
    rows = [(f"c{i:03d}", " ".join(rng.choice(WORDS[:7]) for _ in range(rng.randint(3, 30))) + " the") for i in range(200)]
    rows += [(f"copy{i:03d}", "the red fox the") for i in range(100)]
    rows += [("empty", "...")]
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    metadata = F.struct(
        F.concat("chunk_id", F.lit(".txt")).alias("file_path"), F.col("chunk_id").alias("file_name"),
        F.lit("r").alias("repo_name"), F.lit("text").alias("content_type"), F.lit(None).cast("string").alias("language"),
    )
    return embedding.embed(df.withColumn("metadata", metadata), "content", embedding.hash_embedder(32)).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(
        [(1, "red fox"), (2, "Red red FOX red"), (3, "unknown words"), (4, " \n"), (5, "the"), (6, None)],
        "query_id bigint, query string",
    )


def terms(text):
    return re.findall(r"\w+", (text or "").lower())


def bm25(rows, query, k):
    docs = {r.chunk_id: terms(r.content) for r in rows if terms(r.content)}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term in set(terms(query)):
        df = sum(term in d for d in docs.values())
        for name, d in docs.items():
            tf = d.count(term)
            if tf:
                weight = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avgdl))
                scores[name] = scores.get(name, 0) + weight
    ranked = sorted(scores, key=lambda name: (-round(scores[name], 6), name))[:k]
    return [(name, round(scores[name], 6)) for name in ranked]


def by_query(df, id_col="chunk_id"):
    found = {}
    for row in df.orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row[id_col], row.score))
    return found


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("stored", [True, False])
def test_bm25(spark, index, queries, monkeypatch, tmp_path, broadcast, stored):
    monkeypatch.setattr(keyword, "fits_broadcast", lambda df: broadcast)
    postings, size = keyword.postings(index), None
    if stored:
        index_store.write_postings(postings, str(tmp_path / "p"))
        postings, size = index_store.read_postings(spark, str(tmp_path / "p"))
    found = by_query(keyword.bm25_topk(queries, postings, 5, size))
    rows = index.collect()
    expected = {q.query_id: bm25(rows, q.query, 5) for q in queries.collect()}
    assert found == {q: hits for q, hits in expected.items() if hits}
    assert found[1] == found[2] and 3 not in found and 4 not in found


def test_both_ways_to_the_corpus_size(index):
    postings = keyword.postings(index)
    assert keyword.corpus_size(postings).first() == keyword.corpus_size_of(index).first()
    assert keyword.corpus_size(postings).first().n == 300


def test_stored_postings_are_pruned_by_bucket(spark, index, queries, tmp_path):
    index_store.write_postings(keyword.postings(index), str(tmp_path / "p"))
    stored, size = index_store.read_postings(spark, str(tmp_path / "p"))
    plan = keyword.bm25_topk(queries, stored, 3, size)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


@pytest.mark.parametrize("max_queries", [100, 0])
@pytest.mark.parametrize("k", [1, 3, 500])
def test_dense(spark, monkeypatch, max_queries, k):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8)).astype("float32")
    vectors = np.concatenate([base, base[:20], np.zeros((1, 8), "float32")])
    corpus = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(vectors)], "chunk_id string, embedding array<float>")
    corpus = corpus.unionByName(spark.createDataFrame([("none", None)], "chunk_id string, embedding array<float>")).repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(7, 8)))], "query_id bigint, embedding array<float>")
    monkeypatch.setattr(vector, "_QUERY_BLOCK", 2)
    found = by_query(vector.dense_topk(asked, corpus, k, max_queries=max_queries))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    wanted = np.array([r.embedding for r in asked.orderBy("query_id").collect()], dtype="float64")
    scores = np.round(unit(wanted) @ unit(vectors.astype("float64")).T, 6)
    for q in range(7):
        order = sorted(range(len(vectors)), key=lambda i: (-scores[q, i], f"v{i:03d}"))[:k]
        assert [name for name, _ in found[q]] == [f"v{i:03d}" for i in order]
        assert np.allclose([s for _, s in found[q]], scores[q, order], atol=1.1e-6)


def test_dense_without_queries(spark, index, queries):
    none = embedding.embed(queries.where("query_id > 100"), "query", embedding.hash_embedder(32))
    assert vector.dense_topk(none, index).count() == 0


def test_hybrid(index, queries):
    embedder = embedding.hash_embedder(32)
    results = retrieve.hybrid_search(index, queries, embedder=embedder).cache()
    rows = {q: [r for r in results.orderBy("rank").collect() if r.query_id == q] for q in range(1, 7)}
    assert 3 <= len(rows[1]) <= 6 and len(rows[3]) == 3 and not rows[4] and not rows[6]
    assert [r.chunk_id for r in rows[5]] == ["copy000", "copy001", "copy002"] and rows[5][0].score == 1.0
    for found in rows.values():
        assert len({r.chunk_id for r in found}) == len(found)
        assert [r.rank for r in found] == list(range(1, len(found) + 1))
    counts = {r.query_id: r.n for r in reports.result_count(queries, results).collect()}
    assert counts[4] == 0 and counts[1] == len(rows[1])
    answers = {r.query_id: r for r in reports.responses(queries, reports.api_rows(results)).collect()}
    import json

    body = json.loads(answers[1].response)
    assert body["query"] == "red fox" and body["total_results"] == len(body["results"])
    assert answers[1].response == json.dumps(body, indent=2, ensure_ascii=False)
    assert json.loads(answers[4].response)["results"] == []


def test_fusion_modes_and_values(spark):
    ranks = lambda ids: spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "query_id bigint, chunk_id string, rank int")
    lists = [ranks("abc"), ranks("ad")]
    fused = {r.chunk_id: r.score for r in fusion.rrf(lists).collect()}
    assert fused["a"] == 1.0 and fused["b"] == fused["d"] == round(61 / 62 / 2, 9)
    raw = {r.chunk_id: r.score for r in fusion.rrf(lists, normalize=False).collect()}
    assert raw["a"] == round(2 / 61, 9)
    assert [r.chunk_id for r in fusion.fuse(lists).orderBy("rank").collect()] == ["a", "b", "d", "c"]
    with pytest.raises(ValueError):
        fusion.fuse(lists, "concatenate")


def test_fusion_by_the_distribution_of_scores(spark):
    def hits(scores):
        rows = [(1, c, float(v), i + 1) for i, (c, v) in enumerate(scores)]
        return spark.createDataFrame(rows, "query_id bigint, chunk_id string, score double, rank int")

    first, second = hits([("a", 9), ("b", 5), ("c", 4)]), hits([("d", 0.7)])
    found = {r.chunk_id: r.score for r in fusion.by_distribution([first, second], [3, 1]).collect()}
    values = np.array([9.0, 5.0, 4.0])
    want = (0.5 + (values - 6) / (6 * values.std())) * 3 / 4
    assert found == pytest.approx(dict(zip("abcd", [*want, 0.125], strict=True)))
    same = fusion.fuse([hits([("x", 2), ("y", 2)]), hits([("y", 1), ("z", 1)])], "distribution").orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in same] == [("y", 0.5), ("x", 0.25), ("z", 0.25)]
    assert fusion.fuse([first.limit(0), second.limit(0)], "distribution").collect() == []
    heavy = {r.chunk_id: r.score for r in fusion.rrf([first, second], weights=[1, 3]).collect()}
    assert heavy["d"] == 0.75 and heavy["a"] == 0.25
    for weights in ([1], [1, -1], [0, 0]):
        with pytest.raises(ValueError):
            fusion.fuse([first, second], weights=weights)


def test_fixed_dimension(spark, index):
    assert embedding.check_dim(index, 32).count() == index.count()
    with pytest.raises(Exception, match="expected 31 dimensions"):
        embedding.check_dim(index, 31).select("embedding").collect()
    assert embedding.check_dim(index, 31, "reject").count() == index.count()


def test_users_model(spark):
    def load():
        return lambda texts: np.array([[len(t or ""), 1.0] for t in texts])

    rows = spark.createDataFrame([("ab",), ("",)], "t string")
    found = embedding.embed(rows, "t", embedding.model_embedder(load)).collect()
    assert [r.embedding for r in found] == [[2.0, 1.0], [0.0, 1.0]]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_of_a_hot_key(spark, broadcast, how):
    facts = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    rows = sizing.lookup_join(facts, small, "k", spread="id", how=how, broadcast=broadcast).collect()
    assert len(rows) == (101 if how == "inner" else 300)
    assert sum(r.v or 0 for r in rows) == 102


def test_size_probe(spark):
    assert sizing.fits_broadcast(spark.range(10))
    assert not sizing.fits_broadcast(spark.range(10), max_rows=9)
    assert not sizing.fits_broadcast(spark.range(10), max_bytes=20)
