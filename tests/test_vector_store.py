"""Vectors by content."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import embedding
from lodestone.sources import vector_store


@pytest.fixture
def counted(spark, tmp_path):
    """An embedder that leaves a line per text it is given."""
    log = str(tmp_path / "given")

    def load():
        def model(texts):
            with open(log, "a") as out:
                out.writelines(f"{len(t)} {t[:20]!r}\n" for t in texts)
            return np.array([[len(t), 1.0] for t in texts], np.float32).reshape(len(texts), 2)

        return model

    def given():
        try:
            with open(log) as lines:
                return sum(1 for _ in lines)
        except FileNotFoundError:
            return 0

    return embedding.model_embedder(load), given


def vectors_of(df):
    return {r.id: list(r.embedding) for r in df.collect()}


def test_each_content_is_embedded_once(spark, tmp_path, counted):
    model, given = counted
    path = str(tmp_path / "store")
    rows = [(i, f"text {i % 7} " * (1 + i % 3)) for i in range(60)] + [(100, None), (101, ""), (102, " ")] + [(200 + i, "hot") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, body string").repartition(6)
    contents = {r[1] or "" for r in rows}
    want = {i: [float(len(t or "")), 1.0] for i, t in rows}
    assert vectors_of(vector_store.embed_incremental(df, "body", path, "m", model)) == want
    assert given() == len(contents)
    assert vectors_of(vector_store.embed_incremental(df, "body", path, "m", model)) == want
    assert given() == len(contents), "the second run gives nothing to the model"
    more = df.union(spark.createDataFrame([(300, "new"), (301, "new")], df.schema))
    assert vectors_of(vector_store.embed_incremental(more, "body", path, "m", model)) == want | {300: [3.0, 1.0], 301: [3.0, 1.0]}
    assert given() == len(contents) + 1
    vector_store.embed_incremental(df, "body", path, "other", model)
    assert given() == 2 * len(contents) + 1
    assert vector_store.unused_vectors(df, "body", path, "m").count() == 1


def test_a_digest_stored_twice_gives_one_row(spark, tmp_path, counted):
    model, _ = counted
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "a"), (2, "a")], "id long, body string")
    vector_store.embed_incremental(df, "body", path, "m", model)
    again = spark.read.schema(vector_store.STORE_SCHEMA).parquet(path).collect()
    spark.createDataFrame(again, vector_store.STORE_SCHEMA).write.mode("append").partitionBy("model", "bucket").parquet(path)
    assert vectors_of(vector_store.embed_incremental(df, "body", path, "m", model)) == {1: [1.0, 1.0], 2: [1.0, 1.0]}


def test_empty(spark, tmp_path, counted):
    model, given = counted
    df = spark.createDataFrame([], "id long, body string")
    rows = vector_store.embed_incremental(df, "body", str(tmp_path / "store"), "m", model)
    assert rows.columns == ["id", "body", "embedding"] and rows.collect() == [] and given() == 0
    assert df.withColumn("x", F.lit(1)).count() == 0
