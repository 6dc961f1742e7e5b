"""The vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ivf, vector


@pytest.fixture(scope="module")
def clustered(spark):
    """600 vectors around 12 centres, a hot cluster with half of them, copies, a zero vector and none."""
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(12, 16))
    own = np.where(np.arange(600) % 2 == 0, 0, draw.integers(0, 12, 600))
    rows = centres[own] + 0.15 * draw.normal(size=(600, 16))
    rows[100:110] = rows[100]
    rows[200] = 0
    table = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(600, []), (601, None)]
    return spark.createDataFrame(table, "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ivf") / "index")
    ivf.build_index(clustered.repartition(5), path, id_col="vec_id", cells=12)
    return ivf.open_index(spark, path)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "vec_id", "score", "rank").collect())


def test_every_row_with_a_vector_is_indexed(index):
    stored = index.vectors()
    assert sorted(r["id"] for r in stored.collect()) == list(range(600))
    least = {r["cell"]: r["least"] for r in stored.groupBy("cell").agg(F.min("cosine").alias("least")).collect()}
    assert np.allclose([least[c] for c in index.cells.tolist()], index.least)


@pytest.mark.parametrize("max_queries", [2048, 0])
@pytest.mark.parametrize("k", [3, 700])
def test_exact(clustered, index, max_queries, k):
    asked = clustered.withColumnRenamed("vec_id", "query_id").where("query_id % 20 = 0 or query_id >= 599")
    want = vector.dense_topk(asked, clustered, k=k, id_col="vec_id")
    for probes in (1, 50):
        assert rows_of(ivf.search(index, asked, k=k, probes=probes, exact=True, max_queries=max_queries)) == rows_of(want)


def test_recall_and_probes(clustered, index):
    asked = clustered.withColumnRenamed("vec_id", "query_id")
    want = vector.dense_topk(asked, clustered, id_col="vec_id")
    probes = ivf.probes_for(index, asked.where("query_id % 20 = 0"), target=0.95)
    share = ivf.recall(ivf.search(index, asked, probes=probes), want, "vec_id").first()
    assert share["n"] == 1800 and share["recall"] >= 0.9 and probes < 12


def test_only_probed_cells_are_read(clustered, index):
    asked = clustered.withColumnRenamed("vec_id", "query_id").where("query_id = 7")
    cell = index.vectors().where("id = 7").first()["cell"]
    wanted = asked.select(F.col("query_id").cast("bigint"), F.lit(cell).alias("cell"), "embedding")
    for limit in (10, 0):
        plan = ivf._score(index, wanted, 3, limit)._jdf.queryExecution().toString()
        assert f" = {cell})]" in plan.split("PartitionFilters: ")[1]


def test_bounds_hold():
    draw = np.random.default_rng(2)
    unit = lambda n: ivf._unit(draw.normal(size=(n, 5)))
    centre, members, queries = unit(1), unit(40), unit(60)
    bounds = ivf.upper_bounds(queries @ centre.T, (members @ centre.T).min(keepdims=True)[0])
    assert ((queries @ members.T).max(axis=1) <= bounds[:, 0] + 1e-9).all()


def test_empty(spark, clustered, tmp_path):
    path = str(tmp_path / "none")
    ivf.build_index(clustered.limit(0), path, id_col="vec_id")
    index = ivf.open_index(spark, path)
    asked = clustered.withColumnRenamed("vec_id", "query_id")
    for exact in (False, True):
        assert ivf.search(index, asked, exact=exact).collect() == []


def test_no_queries_and_text_ids(spark, clustered, tmp_path):
    named = clustered.select(F.concat(F.lit("c"), "vec_id").alias("chunk_id"), "embedding").limit(50)
    ivf.build_index(named, str(tmp_path / "text"), cells=4)
    index = ivf.open_index(spark, str(tmp_path / "text"))
    asked = clustered.withColumnRenamed("vec_id", "query_id")
    assert ivf.search(index, asked.limit(0)).collect() == []
    assert ivf.search(index, asked.where("query_id = 7"), exact=True).first()["chunk_id"].startswith("c")
