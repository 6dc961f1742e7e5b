"""Posting blocks against the search on all postings."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import chunking, keyword
from lodestone.sources import index_store


def corpus(spark, n=240, seed=4):
    """Files of two repositories, one with most of them; a word in every file, words in few."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["common"] * draw.randint(1, 4) + [f"w{int(draw.paretovariate(0.6)) % 500}" for _ in range(draw.randint(3, 40))]
        if i % 40 == 7:
            words += [f"rare{i}"] * 3
        rows.append(("big" if i % 5 else "small", f"d{i % 7}/f{i}.md", " ".join(words)))
    return paths.with_document(spark.createDataFrame(rows, "repo_name string, rel_path string, text string"))


@pytest.fixture(scope="module")
def asked(spark):
    texts = ["common w1 w2", "rare7 common", "rare47 w3", "w499 w498 w12", "absent", " ", "common", "rare87 rare127 rare167 rare7"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect())


@pytest.mark.parametrize("k, first, chunks", [(1, 1, 4), (50, 2, 16), (3, 4, 256)])
def test_equal_to_the_search_on_all_postings(spark, asked, k, first, chunks):
    rows = chunking.chunk_text(corpus(spark), mode="window")
    postings = keyword.postings(rows)
    placed = postings.join(rows.select("chunk_id", "repo_name"), "chunk_id")
    blocks = keyword.posting_blocks(placed, "repo_name", chunks=chunks)
    found, report = keyword.bm25_topk_blocks(asked, blocks, k, first)
    assert rows_of(found) == rows_of(keyword.bm25_topk(asked, postings, k))
    counts = {r["query_id"]: (r["blocks"], r["read"]) for r in report.collect()}
    assert all(read <= n for n, read in counts.values())
    if chunks == 4:
        assert counts[7][1] < counts[7][0] and max(r["n"] for r in blocks.where("term = 'common'").collect()) < 20


def test_blocks_follow_every_write_of_an_index(spark, asked, tmp_path):
    docs = corpus(spark)
    path = str(tmp_path / "index")
    chunks = chunking.chunk_text(docs, mode="window")
    index_store.write_index(chunks, path, buckets=3, blocks=True)
    touched = F.substring_index("metadata.file_path", "/", 1).isin("d1", "d2")
    changed = docs.where(touched).withColumn("text", F.concat("text", F.lit(" rare7 fresh")))
    files = changed.select(F.col("metadata.repo_name").alias("repo_name"), F.col("metadata.file_path").alias("rel_path"))
    alive = changed.where("metadata.file_path not like 'd2/%'")
    index_store.upsert_files(spark, path, files, chunking.chunk_text(alive, mode="window"))
    now = chunking.chunk_text(docs.where(~touched).unionByName(alive), mode="window")
    want = keyword.bm25_topk(asked, keyword.postings(now))
    blocks = index_store.read_index_blocks(spark, path)
    assert rows_of(keyword.bm25_topk_blocks(asked, blocks)[0]) == rows_of(want)
    index_store.write_index(now.limit(0), path, repos=now.select("repo_name").distinct())
    assert keyword.bm25_topk_blocks(asked, index_store.read_index_blocks(spark, path))[0].collect() == []


def test_bounds_hold_for_every_chunk(spark, asked):
    rows = chunking.chunk_text(corpus(spark, 90), mode="window")
    placed = keyword.postings(rows).join(rows.select("chunk_id", "repo_name"), "chunk_id")
    blocks = keyword.posting_blocks(placed, "repo_name", chunks=8)
    bounds, terms, whole = keyword._block_bounds(asked, blocks, ["repo_name", "slot"])
    every = keyword._score_places(bounds, terms, blocks, whole, ["repo_name", "slot"])
    held = blocks.where("term is not null").select("repo_name", "slot", F.explode("entries.chunk_id").alias("chunk_id")).distinct()
    over = every.join(held, "chunk_id").join(bounds, ["query_id", "repo_name", "slot"]).where("score > ub + 1e-9")
    assert every.count() > 50 and over.count() == 0


def test_places_without_a_chance_are_not_read(spark, asked, tmp_path):
    path = str(tmp_path / "index")
    index_store.write_index(chunking.chunk_text(corpus(spark), mode="window"), path, buckets=4, blocks=True)
    blocks = index_store.read_index_blocks(spark, path)
    found, _ = keyword.bm25_topk_blocks(asked.where("query_id = 7"), blocks)
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    assert rows_of(found)
