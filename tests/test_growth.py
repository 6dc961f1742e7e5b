"""Steps whose data must not outgrow the input."""

import datetime
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import chunking, embedding, enrich, ivf, keyword, lexer, structure, vector
from lodestone.plans import retrieve, sizing
from lodestone.sources import index_store
from lodestone.streaming import ingest_stream


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def code(spark):
    rows = [("r", f"m{i}.py", f"import os\nclass C{i}:\n    def f(self):\n        return os.sep\n") for i in range(30)]
    return paths.with_document(spark.createDataFrame(rows, "repo_name string, rel_path string, text string"))


def test_contexts_of_code_are_not_broadcast(code):
    """both sides grow with the corpus, whatever the size of the files suggests."""
    chunks = chunking.chunk_code(code, lines=2, overlap=0)
    lines = enrich.code_lines(enrich.code_documents(code))
    for found in (
        enrich.enclosing_scope(chunks, enrich.scopes(lines)), enrich.filter_imports(chunks, enrich.extract_imports(lines)),
        enrich.signatures(enrich.scopes(lines), lines), enrich.enrich_chunks(chunks, code), structure.chunk_code_structured(code),
    ):
        assert "BroadcastHashJoin" not in plan_of(found) and found.count()


def test_lines_are_spread_by_their_text(code):
    """partitions follow the text, which Spark would coalesce by its compressed size."""
    size = code.agg(F.sum(F.octet_length("text"))).first()[0]
    assert sizing.partitions_of(code, "text", max_bytes=100) == -(-size // 100)
    assert sizing.partitions_of(code, "text", min_bytes=size) == sizing.partitions_of(code.limit(0), "text") == 1


@pytest.mark.parametrize("k", [1, 4, 90])
def test_running_best(k):
    """only scores that reach the worst hit are merged, also for some of the queries."""
    draw = np.random.default_rng(k)
    unit = lambda n: np.round(ivf._unit(draw.normal(size=(n, 4))), 1)
    queries, rows = unit(6), unit(80)
    rows[40:] = rows[:40]
    running = vector._Running(np.arange(6), queries, k)
    chosen = [np.array([0, 1, 5]) if b % 3 == 2 else np.arange(6) for b in range(8)]
    for b, some in enumerate(chosen):
        running.add(np.array([f"n{i:02d}" * (1 + b % 2) for i in range(10 * b, 10 * b + 10)]), rows[10 * b:10 * b + 10], some)
    import pyarrow as pa

    got = running.result("id", pa.string()).to_pylist()
    for q in range(6):
        every = [(-round(float(queries[q] @ rows[i]) * 1e6), f"n{i:02d}" * (1 + i // 10 % 2)) for i in range(80) if q in chosen[i // 10]]
        mine = sorted((-round(r["score"] * 1e6), r["id"]) for r in got if r["query_id"] == q)
        assert mine == sorted(every)[:k]


def test_a_query_travels_once_per_block(spark, monkeypatch, tmp_path):
    """copies follow the number of blocks, not of cells or shuffle partitions."""
    draw = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(draw.normal(size=(300, 6)))], "vec_id long, embedding array<float>")
    asked = rows.withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(vector, "_QUERY_BLOCK", 100)
    cores = spark.sparkContext.defaultParallelism
    assert vector.blocks_of(asked) == (3, max(3, -(-2 * cores // 3)))
    index = ivf.build_index(rows, str(tmp_path / "x"), id_col="vec_id", cells=20)
    worst = asked.withColumn("worst", F.lit(-1.0))
    rest = ivf._rest(index, worst, 2)
    assert rest.count() == 300 and {int(np.unpackbits(np.frombuffer(r["mask"], np.uint8)).sum()) for r in rest.collect()} == {len(index.cells) - 2}
    want = sorted(map(tuple, vector.dense_topk(asked, rows, id_col="vec_id").collect()))
    assert sorted(map(tuple, ivf.search(index, asked, probes=1, exact=True, max_queries=0).select("query_id", "vec_id", "score", "rank").collect())) == want


def test_postings_are_counted_in_the_row(spark):
    """no table of terms is held; rows with one chunk id still are one chunk."""
    draw = random.Random(5)
    texts = [(f"c{i // 2 if i < 10 else i}", " ".join(draw.choice("abcdeÄ") * draw.randint(1, 2) for _ in range(draw.randint(0, 30)))) for i in range(60)]
    texts += [("none", None), ("blank", " . "), (None, "a b")]
    found = keyword.postings(spark.createDataFrame(texts, "chunk_id string, content string"))
    want: Counter = Counter()
    for name, text in texts:
        want.update((name, t) for t in (text or "").lower().replace(".", "").split())
    rows = found.collect()
    assert {(r.chunk_id, r.term): r.tf for r in rows} == dict(want) and len(rows) == len(want)
    once = {name: text.lower().split() for name, text in texts[10:60]}
    assert all(r.dl == len(once[r.chunk_id]) and r.leads == (once[r.chunk_id][0] == r.term) for r in rows if r.chunk_id in once)
    assert "Aggregate" not in plan_of(found)


@pytest.mark.parametrize("grouped", [True, False])
def test_pairs_of_query_and_chunk_stay_in_the_task(spark, monkeypatch, grouped):
    """Scores are summed and cut to k before anything is sorted or shuffled by query."""
    draw = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(draw.choices(words, k=n))
    chunks = spark.createDataFrame([(f"c{i:03d}", text(draw.randint(1, 9))) for i in range(400)], "chunk_id string, content string")
    asked = spark.createDataFrame([(i, text(4)) for i in range(9)] + [(99, "absent")], "query_id long, query string")
    postings = keyword.postings(chunks)
    monkeypatch.setattr(vector, "_CELLS", 100)
    ours = keyword.bm25_topk(asked, postings if grouped else postings.repartition(3), 5, grouped=grouped)
    assert not any("Aggregate" in line and "chunk_id" in line for line in plan_of(ours).splitlines())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, ours.select("query_id", "chunk_id", "score", "rank").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(keyword, "fits_broadcast", lambda df: False)
    assert got == sorted(map(tuple, keyword.bm25_topk(asked, postings, 5).select("query_id", "chunk_id", "score", "rank").collect()))


def test_texts_are_tokenized_and_embedded_once(spark):
    """Frequencies and scores read counts that are kept, and a text is embedded in one place only."""
    texts = [(f"c{i % 50}", " ".join(f"w{j % 7}" for j in range(i))) for i in range(60)] + [("none", None), ("blank", " . "), (None, "a b")]
    chunks = spark.createDataFrame(texts, "chunk_id string, content string")
    kept, size = keyword.kept_postings(chunks)
    want = keyword.postings(chunks)
    rows = lambda df: sorted(map(repr, df.select("chunk_id", "term", "tf", "dl", "leads").collect()))
    assert rows(kept) == rows(want) and size.first() == keyword.corpus_size_of(chunks).first()
    assert keyword.corpus_size(kept).first() == keyword.corpus_size(want).first()
    assert "Exchange" not in plan_of(kept) and "split(" not in plan_of(kept)
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w6")], "query_id long, query string")
    index = embedding.embed(chunks, "content", embedding.hash_embedder(16), spread_by="chunk_id")
    found = vector.dense_topk(embedding.embed(asked, "query", embedding.hash_embedder(16)), index)
    assert plan_of(found).count("ArrowEvalPython") == 1 and found.count()


def test_rows_without_a_vector_are_no_hits(spark):
    """the step itself leaves out missing and empty vectors, on both paths."""
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", []), ("d", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    for most in (10, 0):
        got = vector.dense_topk(asked, rows, max_queries=most).select("query_id", "chunk_id", "score").collect()
        assert sorted(map(tuple, got)) == [(1, "a", 1.0), (1, "d", 0.0)]


def test_digests_of_terms(spark):
    """a term is hashed once per batch, to the first 32 bits of its MD5 digest."""
    lists = pa.array([["a", "b", "a"], [], ["ü", "b"]], pa.list_(pa.string()))
    digest = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    want = [[digest(t) for t in terms] for terms in lists.to_pylist()]
    assert embedding._term_digests(lists).to_pylist() == want and embedding._term_digests(lists.slice(2)).to_pylist() == want[2:]


def _plain_cuts(sizes, prices, lines, max_chars):
    best = [(0, [])]
    for end in range(1, len(sizes) + 1):
        starts = [f for f in range(max(end - lines, 0), end) if f == end - 1 or sum(sizes[f:end]) + end - f - 1 <= max_chars]
        total, first = min((best[f][0] + prices[f], f) for f in starts)
        best.append((total, best[first][1] + [first]))
    return best[-1][1]


def test_cuts_take_time_in_proportion_to_the_lines(spark):
    """the cheapest start is kept from line to line, whatever the limits; equal ones as before."""
    draw = random.Random(7)
    for _ in range(400):
        n = draw.randint(0, 25)
        sizes, prices = [draw.choice([0, 3, 9, 40]) for _ in range(n)], [draw.randint(0, 3) for _ in range(n)]
        limits = draw.randint(1, 8), draw.randint(1, 60)
        assert structure.cheapest_cuts(sizes, prices, *limits) == _plain_cuts(sizes, prices, *limits)

    class Counted(list):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += 1
            return super().__getitem__(at)

    structure.cheapest_cuts(Counted([1] * 2000), [2] * 2000, 500, 10**6)
    assert Counted.reads <= 3 * 2000


def test_decorators_need_no_second_lexing(code):
    """the lines of a document are lexed once, and decorators still move a scope up."""
    assert plan_of(structure._scopes_per_document(code)).count("MapInArrow") == 1
    rows = [("r", "d.py", "import os\n@one\n@two(3)\ndef f():\n    return os.sep\n"), ("r", "e.java", "class E {\n  @X\n  int f() {\n    return 1;\n  }\n}")]
    docs = paths.with_document(code.sparkSession.createDataFrame(rows, "repo_name string, rel_path string, text string"))
    found = {r["doc_id"]: sorted(map(tuple, r["scopes"])) for r in structure._scopes_per_document(docs).collect()}
    assert sorted(found.values()) == [[(0, 5), (2, 4)], [(1, 5)]]


def test_content_of_a_batch_moves_once(spark):
    """the newest version of a file is found in one shuffle, without a join of its own."""
    schema = "repo_name string, rel_path string, length long, mtime timestamp, content binary, deleted boolean"
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [
        ("r", "a", 1, day(1), b"1", False), ("r", "a", 1, day(2), b"2", None), ("r", "a", 1, day(2), b"2", False), ("r", "b", 1, day(1), b"1", False),
        ("r", "b", 0, day(1), None, True), ("r", "c", 1, None, b"1", False), ("r", "c", 2, None, b"22", False), (None, "d", 1, day(1), b"1", False),
    ]
    found = ingest_stream.latest_versions(spark.createDataFrame(rows, schema))
    plan = plan_of(found)
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert sorted((r.rel_path, r.content and bytes(r.content), bool(r.deleted)) for r in found.collect()) == [("a", b"2", False), ("b", None, True), ("c", b"22", False)]


def test_terms_of_a_batch_are_counted_together(spark):
    """distinct terms in byte order with their counts, per list; none of one that is empty."""
    draw = random.Random(8)
    lists = [[draw.choice(["b", "a", "Ä", "ab", "\U0001f600", "z"]) for _ in range(draw.choice([0, 0, 1, 9]))] for _ in range(50)]
    want = [sorted(Counter(terms).items(), key=lambda item: item[0].encode()) for terms in lists]
    found = lambda part: [[(c["term"], c["tf"]) for c in row] for row in keyword._counts(part).to_pylist()]
    every = pa.array(lists, pa.list_(pa.string()))
    assert found(every) == want and found(every.slice(7, 20)) == want[7:27] and found(every.slice(0, 0)) == []
    assert found(pa.array([[], []], pa.list_(pa.string()))) == [[], []]
    kept, size, rows = keyword.kept_chunks(spark.createDataFrame([("c", "x y x"), ("c", None), ("d", "")], "chunk_id string, content string"), "content")
    assert sorted(map(tuple, kept.select("chunk_id", "term", "tf", "dl").collect())) == [("c", "x", 2, 3), ("c", "y", 1, 3)]
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == ["('c', 'x y x')", "('c', None)", "('d', '')"]
    assert "transform(" not in plan_of(kept) and tuple(size.first()) == (1, 3.0)


def test_a_posting_names_no_queries(spark):
    """The queries of a term are known in the task, so a posting is as wide with a hundred queries as with one."""
    chunks = spark.createDataFrame([(f"c{i:02d}", f"all w{i % 7}") for i in range(60)], "chunk_id string, content string")
    asked = spark.createDataFrame([(i, f"all w{i % 3}") for i in range(100)], "query_id long, query string")
    postings = keyword.postings(chunks)
    found = keyword.bm25_topk(asked, postings, 2, grouped=True)
    assert "collect_list(query_id" not in plan_of(found)
    want = {q: [f"c{i:02d}" for i in range(60) if i % 7 == q % 3][:2] for q in range(100)}
    assert {q: [r.chunk_id for r in sorted(found.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in want} == want


def test_shown_chunks_are_not_cut_again(spark):
    """The text of the hits comes from the table of counts; only the vector search places the texts beside it."""
    docs = paths.with_document(spark.createDataFrame([("r", f"f{i}.md", f"word{i % 5} and more {i}") for i in range(40)], "repo_name string, rel_path string, text string"))
    chunks = chunking.chunk_text(docs, mode="window")
    index = embedding.embed(chunks, "content", embedding.hash_embedder(16), spread_by="chunk_id")
    asked = spark.createDataFrame([(1, "word3 more"), (2, " ")], "query_id long, query string")
    found = retrieve.hybrid_search(index, asked, embedder=embedding.hash_embedder(16))
    assert plan_of(found).count("REPARTITION_BY_COL") == 1
    want = {r.chunk_id: (r.content, r.metadata) for r in chunks.collect()}
    rows = found.collect()
    assert {r.query_id for r in rows} == {1} and 3 <= len(rows) <= 6 and all(want[r.chunk_id] == (r.content, r.metadata) for r in rows)


def test_vectors_of_a_block_are_bounded():
    """Few queries no longer let a whole batch of vectors be widened at once."""
    rows = pa.record_batch([pa.array(range(5000)), embedding.as_list_array(np.ones((5000, 1536), np.float32))], ["id", "embedding"])
    sizes = [b.num_rows for b in vector._blocks(rows, 10, 1)]
    assert sum(sizes) == 5000 and max(sizes) * 1536 <= vector._BLOCK_VALUES


@pytest.mark.parametrize("most", [3, 10_000])
def test_stored_postings_name_a_chunk_once(spark, monkeypatch, tmp_path, most):
    """r04 F1: neither the stored table nor the shuffle of a search has the id of a chunk in each of its postings."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(15)]
    text = lambda n: " ".join(draw.choices(words, k=n))
    chunks = spark.createDataFrame(
        [(f"c{i:03d}", text(draw.randint(0, 9))) for i in range(200)] + [("c007", "w1 w2"), ("none", None)], "chunk_id string, content string"
    )
    asked = spark.createDataFrame([(i, text(4)) for i in range(9)] + [(99, "absent")], "query_id long, query string")
    monkeypatch.setattr(keyword, "_CELL_CHUNKS", most)
    postings = keyword.postings(chunks)
    rows = lambda df: sorted(map(repr, df.select("chunk_id", "term", "tf", "dl", F.coalesce("leads", F.lit(False))).collect()))
    best = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    every, want = rows(postings), best(keyword.bm25_topk(asked, postings, 5, grouped=True))
    for at, given in enumerate((postings, postings.repartition(3))):
        path = str(tmp_path / f"p{at}")
        index_store.write_postings(given, path, buckets=4)
        lists, size = index_store.read_postings(spark, path)
        names = [c for r in lists.where("chunk_ids is not null").collect() for c in r["chunk_ids"]]
        assert len(names) == len(set(names)) == len({r.chunk_id for r in postings.collect()})
        assert rows(keyword.unlisted(lists, lists)) == every and tuple(size.first())[:2] == tuple(keyword.corpus_size(postings).first())
        found = keyword.bm25_topk(asked, lists, 5, size)
        assert best(found) == want and "REPARTITION_BY_COL" in plan_of(found) and "hashpartitioning(chunk_id" not in plan_of(found)


def test_what_is_kept_with_an_index_names_a_chunk_once(spark, monkeypatch, tmp_path):
    """r04 F2, F4: postings and blocks of an index have no chunk ids in their entries, and their texts do not move to be counted."""
    draw = random.Random(10)
    words = [f"w{i}" for i in range(15)]
    text = lambda n: " ".join(draw.choices(words, k=n))
    docs = paths.with_document(spark.createDataFrame([(f"r{i % 2}", f"f{i}.md", text(9)) for i in range(60)], "repo_name string, rel_path string, text string"))
    chunks = chunking.chunk_text(docs, mode="window")
    asked = spark.createDataFrame([(i, text(4)) for i in range(9)] + [(99, "absent")], "query_id long, query string")
    best = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    want = best(keyword.bm25_topk(asked, keyword.postings(chunks), 4))
    path = str(tmp_path / "index")
    assert "REPARTITION_BY_COL" not in plan_of(keyword.postings_in_place(chunks, "repo_name"))
    index_store.write_index(chunks, path, buckets=2, postings=True, blocks=True)
    for _ in range(2):
        lists, size = index_store.read_index_postings(spark, path)
        blocks = index_store.read_index_blocks(spark, path)
        for kept in (lists, blocks):
            names = [c for r in kept.where("chunk_ids is not null").collect() for c in r["chunk_ids"]]
            assert len(names) == 60 and len(set(names)) == 60
        assert best(keyword.bm25_topk(asked, lists, 4, size)) == best(keyword.bm25_topk_blocks(asked, blocks, 4, 1)[0]) == want
        files = docs.where("metadata.repo_name = 'r1'").select("metadata.repo_name", F.col("metadata.file_path").alias("rel_path"))
        index_store.upsert_files(spark, path, files, chunks.where("repo_name = 'r1'"))
    # rows with one chunk id are one chunk, also in several places
    twice = chunks.unionByName(chunks.limit(3)).unionByName(chunks.limit(2).withColumn("metadata", F.col("metadata").withField("file_path", F.lit("other/place.md"))))
    index_store.write_index(twice, path, "overwrite")
    lists, size = index_store.read_index_postings(spark, path)
    monkeypatch.setattr(keyword, "fits_broadcast", lambda df: False)
    assert best(keyword.bm25_topk(asked, lists, 4, size)) == best(keyword.bm25_topk(asked, keyword.postings(index_store._stored(spark, path).where("chunk_no >= 0"), "repo_name"), 4))
    blocks = index_store.read_index_blocks(spark, path)
    assert keyword.bm25_topk_blocks(asked, blocks, 4, 1)[0].count()
    # a chunk that is there three times scores as often, and its place is not taken for worse
    index_store.write_index(chunks.unionByName(chunks.limit(20)).unionByName(chunks.limit(20)), path, "overwrite")
    lists, size = index_store.read_index_postings(spark, path)
    blocks = index_store.read_index_blocks(spark, path)
    assert best(keyword.bm25_topk_blocks(asked, blocks, 4, 1)[0]) == best(keyword.bm25_topk(asked, lists, 4, size))
    assert blocks.where("term is not null").agg(F.max("times")).first()[0] == 3


def test_an_update_compares_hashes_of_files(spark, monkeypatch):
    """r04 F4: the rows that stay are not shuffled by their file; a file with the hash of another one stays."""
    rows = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), (None, "a", 3), ("r", None, 4), ("s", "a", 5)], "repo_name string, _path string, n int")
    files = spark.createDataFrame([("r", "a"), (None, "b"), ("r", "x")], "repo_name string, _path string")
    found = index_store._without(rows, files)
    assert "SortMergeJoin" not in plan_of(found) and sorted(r.n for r in found.collect()) == [2, 3, 4, 5]
    monkeypatch.setattr(index_store.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    assert sorted(r.n for r in index_store._without(rows, files).collect()) == [2, 3, 4, 5]


def _plain_state(rows):
    stack, depth, brackets, out = [], 0, 0, []
    for language, number, line in rows:
        if number == 0:
            stack, depth, brackets = [], 0, 0
        inside = bool(stack) and not stack[-1].startswith("${")
        code = line if language not in lexer.RULES else lexer.scan_line(line, stack, lexer.RULES[language])
        out.append((code, inside, depth, brackets))
        braces = code.count("{") - code.count("}")
        depth += braces
        brackets += braces + code.count("(") - code.count(")") + code.count("[") - code.count("]")
    return out


def test_lines_without_marks_are_not_lexed(monkeypatch):
    """r04 F3: the state is kept from line to line as before, and plain lines outside strings and comments are not looked at."""
    draw = random.Random(11)
    parts = ["x = 1", "", "'", '"', '"""', "`", "${", "}", "{", "(", ")", "[", "]", "/*", "*/", "//", "#", "\\", "r#\"", "\"#", "a"]
    rows = []
    for _ in range(150):
        language = draw.choice([*lexer.RULES, "ruby"])
        plain = draw.random() < 0.5
        rows += [(language, i, "".join(draw.choices(parts[:2] if plain and draw.random() < 0.8 else parts, k=draw.randint(0, 4)))) for i in range(draw.randint(1, 20))]
    state, got, at = lexer.State(), [], 0
    while at < len(rows):
        part = rows[at:at + draw.randint(1, 40)]
        at += len(part)
        got += zip(*(a.to_pylist() for a in state.scan(*(pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.int32(), pa.string()))))))
    assert got == _plain_state(rows)
    calls = []
    monkeypatch.setattr(lexer, "scan_line", lambda line, stack, rules: calls.append(line) or line)
    lines = ["def f():", *["    x = 1"] * 50, "    y = (2)"]
    lexer.State().scan(pa.array(["python"] * 52), pa.array(range(52), pa.int32()), pa.array(lines))
    assert calls == ["def f():", "    y = (2)"]
