"""op12 against trees built by hand."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle
from lodestone.llm.oracles import ORACLES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    values = [None if row[f] is None else str(row[f]) for f in merkle.FIELDS]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(nodes):
    """The top and, for every node, its (left, right) siblings up to the top."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, below = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at:at + 16]
            for k in range(len(run)):
                for i in spans[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            parents.append(sha("".join(run)))
            below.append([i for span in spans[at:at + 16] for i in span])
        nodes, spans = parents, below
    return nodes[0], paths


def expected(docs):
    rows = [r.asDict() for r in docs.collect()]
    first = lambda v: (v is not None, v if v is not None else 0)
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (first(r["doc_id"]), leaf_of(r))) for s in names}
    trees = {s: tree([leaf_of(r) for r in members[s]]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, more in zip(names, above, strict=True):
        subroot, paths = trees[s]
        for row, path in zip(members[s], paths, strict=True):
            hash_ = leaf_of(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"] is not None:
                lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row["text"])
                hash_ = leaf_of(row | {"text": lowered})
            for left, right in path + more:
                hash_ = sha(left + hash_ + right)
            siblings = sha("".join(a + b for a, b in path + more))
            out.append((row["doc_id"], leaf_of(row), subroot, root, siblings, hash_, hash_ == root))
    return sorted(out, key=repr)


def found(docs):
    return sorted((tuple(r) for r in merkle.audit(docs).collect()), key=repr)


def test_whole_table(spark, documents):
    rows = found(documents)
    assert rows == expected(documents)
    assert 0 < sum(not r[-1] for r in rows) < len(rows) / 4


def test_sql(spark, documents, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted((tuple(r) for r in duck.execute(ORACLES["op12_merkle"]).fetchall()), key=repr) == found(documents)


@pytest.mark.parametrize("sizes", [[1], [1] * 18, [300, 17, 16, 1]])
def test_shapes_of_trees(spark, sizes):
    """Lone leaves, last runs of one node, sources of other depths, more than 16 sources."""
    rows = [(s * 1000 - i, f"Text {i}", "en", f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs) == expected(docs)


def test_odd_rows(spark, odd):
    assert found(odd) == expected(odd)


def test_extra_columns_with_names_of_the_operator(spark, odd):
    more = odd.select("*", *[F.lit(1).alias(c) for c in ("digest", "place", "tree", "path", "_at", "a.b")])
    assert found(more) == expected(odd)


def test_empty(spark, empty):
    rows = merkle.audit(empty)
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows.collect() == []


def test_repeated_rows_and_ties_on_many_partitions(spark, odd):
    many = odd.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("n").repartition(7)
    assert found(many) == expected(many)


def test_one_source_is_not_one_task(spark):
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit("en").alias("lang"), F.col("id").alias("n_chars"),
        F.concat(F.lit("Text "), "id").alias("text"),
    )
    placed = merkle.numbered(docs.select("source", "doc_id"), ["source", "doc_id"])
    assert [r["place"] for r in placed.orderBy("doc_id").collect()] == list(range(5000))
    shares = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < 3000
    assert found(docs) == expected(docs)
