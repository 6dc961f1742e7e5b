"""The stored index and the incremental stream."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import chunking, embedding
from lodestone.sources import index_store, texts
from lodestone.streaming import ingest_stream as streaming


def chunks_of(spark, files):
    rows = spark.createDataFrame([(r, p, t) for (r, p), t in files.items()], "repo_name string, rel_path string, text string")
    return chunking.chunk_docs(paths.with_document(rows))


def stored(spark, path):
    return sorted((r.repo_name, r.metadata.file_path, r.content) for r in index_store.read_index(spark, path).collect())


A = {("a", "x.py"): "x = 1", ("a", "y.md"): "text", ("b", "z.go"): "func a() {}"}


def test_repeated_runs_and_modes(spark, tmp_path):
    path = str(tmp_path / "index")
    for _ in range(2):
        index_store.write_index(chunks_of(spark, A), path)
    assert len(stored(spark, path)) == 3
    index_store.write_index(chunks_of(spark, {("a", "x.py"): "x = 2"}), path, buckets=8)
    assert ("a", "x.py", "x = 2") in stored(spark, path) and ("b", "z.go", "func a() {}") in stored(spark, path)
    index_store.rebuild_index(chunks_of(spark, {("c", "q"): "new"}), path)
    assert stored(spark, path) == [("c", "q", "new")]
    assert index_store.index_count(index_store.read_index(spark, path)).first().n == 1
    with pytest.raises(ValueError):
        index_store.write_index(chunks_of(spark, A), path, mode="other")


def test_named_indices(spark, tmp_path):
    index_store.write_index(chunks_of(spark, A), str(tmp_path / "index"))
    index_store.register_index(spark, "code_index", str(tmp_path / "index"))
    assert "code_index" in [r.name for r in index_store.list_indices(spark).collect()]
    assert [r.name for r in index_store.list_indices(spark, "code_i*").collect()] == ["code_index"]
    assert spark.sql("select count(*) from code_index").first()[0] == 3


def test_repo_filter_prunes_partitions(spark, tmp_path):
    index_store.write_index(chunks_of(spark, A), str(tmp_path / "index"))
    plan = index_store.read_index(spark, str(tmp_path / "index")).where("repo_name = 'a'").select("content")
    text = plan._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(repo_name" in text and "embedding" not in text.split("ReadSchema")[1]


class Stream:
    def __init__(self, spark, base):
        self.spark, self.base, self.day = spark, base, 0

    def put(self, rows):
        self.day += 1
        df = self.spark.createDataFrame(
            [(r, p, bytearray(c) if c is not None else None, c is None) for r, p, c in rows],
            "repo_name string, rel_path string, content binary, deleted boolean",
        )
        df.select(
            "repo_name", "rel_path", F.octet_length("content").cast("bigint").alias("length"),
            F.to_timestamp(F.lit(f"2024-01-{self.day:02d}")).alias("mtime"), "content", "deleted",
        ).write.mode("append").parquet(f"{self.base}/in")

    def run(self, **options):
        query = streaming.ingest_stream(
            self.spark, f"{self.base}/in", f"{self.base}/index", f"{self.base}/check",
            embedding.hash_embedder(8), **options,
        )
        query.awaitTermination()
        return stored(self.spark, f"{self.base}/index")


def test_stream_follows_changes_and_deletions(spark, tmp_path):
    stream = Stream(spark, str(tmp_path))
    stream.put([("a", "x.py", b"x = 1"), ("a", "y.md", b"text"), ("b", "z.txt", b"old"), ("b", "bin", b"\xff")])
    assert stream.run(buckets=1) == [("a", "x.py", "x = 1"), ("a", "y.md", "text"), ("b", "z.txt", "old")]
    assert len(stream.run(buckets=1)) == 3
    stream.put([("a", "x.py", b"x = 2"), ("b", "z.txt", None)])
    assert stream.run(buckets=1) == [("a", "x.py", "x = 2"), ("a", "y.md", "text")]
    stream.put([("a", "y.md", b" \n"), ("a", "x.py", b"x = 3")])
    stream.put([("a", "x.py", b"x = 4"), ("b", "z.txt", b"back")])
    assert stream.run(buckets=1, max_files_per_trigger=1) == [("a", "x.py", "x = 4"), ("b", "z.txt", "back")]


def test_stream_equals_batch_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    files = [("r", f"f{i}.{e}", (f"text {i}. " * 300).encode()) for i, e in enumerate(["py", "md", "go", "txt"])]
    stream = Stream(spark, str(tmp_path))
    stream.put(files)
    found = stream.run()
    rows = spark.createDataFrame([(r, p, bytearray(c)) for r, p, c in files], "repo_name string, rel_path string, content binary")
    batch = chunking.chunk_docs(paths.with_document(texts.read_text(rows)))
    assert found == sorted((r.repo_name, r.metadata.file_path, r.content) for r in batch.collect())
    again = spark.read.schema(streaming.MANIFEST_SCHEMA).parquet(f"{tmp_path}/in")
    streaming.apply_batch(spark, again, f"{tmp_path}/index", embedding.hash_embedder(8))
    assert stored(spark, f"{tmp_path}/index") == found


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    stream = Stream(spark, str(tmp_path))
    stream.put([("a", f"f{i}.txt", b"one") for i in range(40)])
    stream.run(buckets=4)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    before = files()
    stream.put([("a", "f0.txt", b"two")])
    stream.run(buckets=4)
    after = files()
    assert len(set(before) & set(after)) == 3 and len(set(after) - set(before)) == 1


def test_responses_are_written_as_text(spark, tmp_path):
    rows = spark.createDataFrame([('{\n  "query": "a"\n}',)], "response string")
    texts.write_responses(rows, str(tmp_path / "out"))
    found = spark.read.text(str(tmp_path / "out"), wholetext=True).first()[0]
    assert found == '{\n  "query": "a"\n}\n\n'
    asked = texts.read_queries(spark.createDataFrame([(1, "q")], "n int, t string"), "n", "t").first()
    assert (asked.query_id, asked.query) == (1, "q")


def test_files_that_are_gone_leave_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    ten = {("a", f"f{i}.md"): f"text {i}" for i in range(10)}
    index_store.write_index(chunks_of(spark, {**ten, ("b", "x.md"): "other"}), path, postings=True)
    index_store.write_index(chunks_of(spark, {("a", "f0.md"): "text 0"}), path)
    assert stored(spark, path) == [("a", "f0.md", "text 0"), ("b", "x.md", "other")]
    postings, _ = index_store.read_index_postings(spark, path)
    assert {r.term for r in postings.collect()} == {"text", "0", "other"}
    none = chunks_of(spark, {("a", "f0.md"): "x"}).where("false")
    index_store.write_index(none, path, repos=spark.createDataFrame([("a",)], "repo_name string"))
    assert stored(spark, path) == [("b", "x.md", "other")]


def test_the_bucket_count_is_part_of_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    index_store.write_index(chunks_of(spark, A), path, buckets=3)
    assert index_store.stored_buckets(spark, path) == 3
    with pytest.raises(ValueError, match="3 buckets"):
        index_store.write_index(chunks_of(spark, A), path, buckets=8)
    changed = spark.createDataFrame([("a", "x.py")], "repo_name string, rel_path string")
    with pytest.raises(ValueError, match="3 buckets"):
        index_store.upsert_files(spark, path, changed, chunks_of(spark, A), buckets=8)
    index_store.upsert_files(spark, path, changed, chunks_of(spark, {("a", "x.py"): "x = 9"}))
    assert stored(spark, path) == [("a", "x.py", "x = 9"), ("a", "y.md", "text"), ("b", "z.go", "func a() {}")]
    index_store.rebuild_index(chunks_of(spark, A), path, buckets=8)
    assert index_store.stored_buckets(spark, path) == 8 and len(stored(spark, path)) == 3


@pytest.mark.parametrize("buckets", [1, 7, 16])
def test_stored_postings_know_their_buckets(spark, tmp_path, buckets):
    from lodestone.operators import keyword

    chunks = chunks_of(spark, {("a", f"f{i}.md"): f"alpha beta{i % 3} gamma{i}" for i in range(20)})
    asked = spark.createDataFrame([(1, "alpha beta1"), (2, "gamma7")], "query_id bigint, query string")
    want = sorted(map(tuple, keyword.bm25_topk(asked, keyword.postings(chunks)).collect()))
    path = str(tmp_path / f"p{buckets}")
    index_store.write_postings(keyword.postings(chunks), path, buckets=buckets)
    postings, size = index_store.read_postings(spark, path)
    assert want and sorted(map(tuple, keyword.bm25_topk(asked, postings, size=size).collect())) == want
    assert sorted(map(tuple, keyword.bm25_topk(asked, postings).collect())) == want


def _manifest(spark, rows):
    return spark.createDataFrame(
        [(r, p, len(c or b""), d, bytearray(c) if c is not None else None, c is None) for r, p, c, d in rows],
        "repo_name string, rel_path string, length bigint, day string, content binary, deleted boolean",
    ).select("repo_name", "rel_path", "length", F.to_timestamp("day").alias("mtime"), "content", "deleted")


def test_an_older_manifest_row_never_wins(spark, tmp_path):
    path = str(tmp_path / "index")
    index_store.create_index(spark, path, buckets=2)
    embedder = embedding.hash_embedder(4)
    new, old = "2024-02-02", "2024-02-01"
    streaming.apply_batch(spark, _manifest(spark, [("a", "x.md", b"new", new), ("a", "y.md", None, new)]), path, embedder)
    streaming.apply_batch(spark, _manifest(spark, [("a", "x.md", b"old", old), ("a", "y.md", b"old", old), ("a", "z.md", b"z", old)]), path, embedder)
    assert stored(spark, path) == [("a", "x.md", "new"), ("a", "z.md", "z")]


def test_equal_times_have_one_winner(spark):
    rows = [("a", "x", b"one", "2024-01-01"), ("a", "x", b"two", "2024-01-01"), ("a", "y", b"y", "2024-01-01"), ("a", "y", None, "2024-01-01")]
    picks = set()
    for order in (rows, rows[::-1]):
        picks.add(tuple(sorted((r.rel_path, bytes(r.content or b""), r.deleted) for r in streaming.latest_versions(_manifest(spark, order)).collect())))
    assert len(picks) == 1 and ("y", b"", True) in next(iter(picks))
