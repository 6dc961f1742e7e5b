"""One query per operator: each takes (spark, sf_dir) and returns flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone import config
from lodestone.functions import display, paths
from lodestone.operators import (
    chunking, embedding, enrich, filters, fusion, ignore, ivf, keyword, reports, structure, vector,
)
from lodestone.plans import ingest, rescan, retrieve, scratch
from lodestone.sources import index_store, texts, tree, vector_store
from lodestone.streaming import ingest_stream as streaming
from suite import views

QUERIES = {}
HASH_DIM = 256


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _bigints(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.col(name).cast("bigint"))
    return df


def _path(spark: SparkSession, label: str) -> str:
    return scratch.new_path(spark, label)


# Sources and sinks


@query
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _path(spark, "tree")
    views.write_tree(views.files(spark, sf_dir), root)
    repos = views.files(spark, sf_dir).select(F.concat(F.lit(f"{root}/"), "repo_name").alias("root")).distinct()
    found = tree.read_content(tree.list_files(repos))
    return found.select("repo_name", "rel_path", "length", F.md5("content").alias("digest"), "read_error")


@query
def ignore_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignore.load_ignore(texts.read_text(views.files(spark, sf_dir)))


@query
def read_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = _path(spark, "manifest")
    views.files(spark, sf_dir).write.parquet(uri)
    found = tree.read_manifest(spark, uri)
    return found.select("repo_name", "rel_path", "length", F.md5("content").alias("digest"))


@query
def read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.read_text(views.files(spark, sf_dir)).select("repo_name", "rel_path", "text", "error")


_window_chunks = views.window_chunks


def _stored_index(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    path = _path(spark, "index")
    for _ in range(times):
        index_store.write_index(_window_chunks(spark, sf_dir), path)
    return index_store.read_index(spark, path)


@query
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested twice: the second run replaces the same chunks."""
    rows = _stored_index(spark, sf_dir, times=2)
    return _bigints(rows.select(
        "chunk_id", "doc_id", "repo_name", "chunk_no", "content", "metadata.file_path", "metadata.language"
    ), "chunk_no")


@query
def index_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_store.index_count(_stored_index(spark, sf_dir))


@query
def index_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_store.index_sample(_stored_index(spark, sf_dir)).select("chunk_id", "content")


@query
def rebuild_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of other chunks is dropped and built again."""
    path = _path(spark, "index")
    index_store.write_index(chunking.chunk_code(views.corpus(spark, sf_dir)), path)
    index_store.rebuild_index(_window_chunks(spark, sf_dir), path)
    return index_store.read_index(spark, path).groupBy("repo_name").agg(F.count(F.lit(1)).alias("n"))


def _documents_where(spark: SparkSession, sf_dir: str, keep, text=None) -> DataFrame:
    """Window chunks of the documents that `keep` selects."""
    rows = views.documents(spark, sf_dir).where(keep)
    if text is not None:
        rows = rows.withColumn("text", text)
    return chunking.chunk_text(paths.with_document(rows), mode="window")


def _index_rows(spark: SparkSession, path: str) -> DataFrame:
    return _bigints(index_store.read_index(spark, path).select(
        "chunk_id", "doc_id", "repo_name", "chunk_no", "content", "metadata.file_path", "metadata.language"
    ), "chunk_no")


@query
def index_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are ingested, then the same repositories again without a third of them."""
    path = _path(spark, "index")
    index_store.write_index(_window_chunks(spark, sf_dir), path, buckets=4)
    repos = views.documents(spark, sf_dir).select("repo_name").distinct()
    index_store.write_index(_documents_where(spark, sf_dir, F.col("doc_id") % 3 != 0), path, repos=repos)
    return _index_rows(spark, path)


def _upserted(spark: SparkSession, path: str, sf_dir: str, write) -> None:
    """`write` stores all documents, a third in an older version; then that third is brought up to
    date. An update that assumes another number of buckets is refused."""
    changed = F.col("doc_id") % 3 == 0
    write(_documents_where(spark, sf_dir, F.lit(True), F.when(changed, F.upper("text")).otherwise(F.col("text"))))
    files = views.documents(spark, sf_dir).where(changed).select("repo_name", "rel_path")
    new = _documents_where(spark, sf_dir, changed)
    try:
        index_store.upsert_files(spark, path, files, new, buckets=3)
    except ValueError:
        index_store.upsert_files(spark, path, files, embedding.embed(new, "content", spread_by="chunk_id"))
    else:
        raise AssertionError("another number of buckets was accepted")


@query
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "index")
    _upserted(spark, path, sf_dir, lambda chunks: index_store.write_index(chunks, path, buckets=5))
    return _index_rows(spark, path)


@query
def list_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named indexes, found by pattern and asked by name."""
    path = _path(spark, "index")
    index_store.write_index(_window_chunks(spark, sf_dir), path)
    names = ["lodestone_first", "lodestone_second"]
    for name in names:
        index_store.register_index(spark, name, path)
    counts = [spark.table(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in names]
    return index_store.list_indices(spark, "lodestone_*").join(counts[0].unionByName(counts[1]), "name")


# Filters


def _matches(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    files = texts.read_text(views.files(spark, sf_dir))
    hits = ignore.pattern_matches(files, ignore.load_ignore(files))
    return hits.where(F.col("kind") == kind).drop("kind")


@query
def ignore_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, "literal")


@query
def ignore_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, "dir")


@query
def ignore_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, "glob")


@query
def prune_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = texts.read_text(views.files(spark, sf_dir))
    rules = ignore.compile_rules(ignore.load_ignore(files))
    status = F.coalesce("ignore_status", F.lit("keep"))
    return ignore.with_ignore_status(files, rules).select("repo_name", "rel_path", status.alias("status"))


@query
def outside_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third repository is mounted elsewhere."""
    docs = views.documents(spark, sf_dir)
    mount = F.when(F.col("doc_id") % 3 == 0, F.lit("/mnt/")).otherwise(F.lit("/data/"))
    path, root = F.concat(mount, "repo_name", F.lit("/"), "rel_path"), F.concat(F.lit("/data/"), "repo_name")
    return docs.select(
        "doc_id", paths.outside_root(path, root).alias("outside"), paths.rel_path(path, root).alias("rel_path")
    )


@query
def is_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).select(
        "repo_name", "rel_path", filters.is_binary(F.col("content")).alias("binary")
    )


@query
def too_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.col("length")
    over = filters.too_large(length, views.MAX_MB)
    return views.files(spark, sf_dir).select(
        "repo_name", "rel_path", F.round(paths.size_mb(length), 6).alias("size_mb"), over.alias("over"),
        F.when(over, filters.too_large_reason(length)).alias("reason"),
    )


def _classified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = views.files(spark, sf_dir)
    patterns = ignore.load_ignore(texts.read_text(files))
    return ingest.classify(files, patterns, views.MAX_MB), patterns


def _status(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    classified, patterns = _classified(spark, sf_dir)
    return reports.ingest_status(texts.read_text(ingest.to_process(classified))), patterns


@query
def skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)[0].select("repo_name", "rel_path", "skip_reason")


@query
def drop_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eighth document is reduced to its white space."""
    white = F.regexp_replace("text", r"[^\s\p{Z}]", "")
    text = F.when(F.col("doc_id") % 8 == 0, F.concat(white, F.lit(" 　"))).otherwise(F.col("text"))
    return filters.drop_blank(views.documents(spark, sf_dir).withColumn("text", text)).select("doc_id", "text")


@query
def guard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth query is reduced to its white space."""
    return filters.guard_query(views.partly_blank(spark, sf_dir))


# Projections


@query
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir)
    root = F.concat(F.lit("/data/"), "repo_name", F.lit("/"))
    rel = paths.rel_path(F.concat(root, "rel_path"), root)
    return docs.select(
        "doc_id", rel.alias("rel_path"), paths.file_name(rel).alias("file_name"),
        paths.repo_name(root).alias("repo_name"),
    )


@query
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("rel_path")
    return views.documents(spark, sf_dir).select(
        "doc_id", paths.is_code(path).alias("is_code"), paths.language(path).alias("language"),
        paths.content_type(path).alias("content_type"),
    )


@query
def build_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.corpus(spark, sf_dir).select("doc_id", "metadata.*")


@query
def unwrap_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the objects is nested, a third flat, a third empty."""
    docs = views.documents(spark, sf_dir)
    meta = paths.build_metadata(F.col("rel_path"), F.col("repo_name"))
    form = F.col("doc_id") % 3
    text = (
        F.when(form == 0, F.to_json(F.struct(meta.alias("metadata"), F.lit("x").alias("file_path"))))
        .when(form == 1, F.to_json(meta))
        .otherwise(F.lit("{}"))
    )
    return docs.select("doc_id", *display.unwrap_metadata(text))


@query
def api_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bigints(reports.api_rows(views.results(spark, sf_dir)), "rank")


def _head(rows: DataFrame, with_score: bool) -> DataFrame:
    score = F.col("score") if with_score else None
    fields = rows.select("*", *display.metadata_fields(F.col("metadata")))
    return fields.withColumn("header", display.header(F.col("rank"), F.col("file_path"), F.col("language"), score))


@query
def display_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.results(spark, sf_dir)
    plain, scored = _head(rows, False), _head(rows, True)
    return plain.unionByName(scored).select("query_id", "chunk_id", "header")


@query
def display_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.documents(spark, sf_dir).select("doc_id", display.preview(F.col("text")).alias("preview"))


@query
def display_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.create_map(
        F.lit("_node_type"), F.lit("x"), F.lit("file_path"), F.col("rel_path"), F.lit("_node_content"),
        F.col("text"), F.lit("repo_name"), F.col("repo_name"),
    )
    return views.documents(spark, sf_dir).select("doc_id", display.metadata_lines(meta).alias("lines"))


@query
def display_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.results(spark, sf_dir)
    short = reports.display_blocks(rows, show_scores=True).withColumn("form", F.lit("short"))
    full = reports.display_blocks(rows, show_metadata=True).withColumn("form", F.lit("full"))
    return _bigints(short.unionByName(full), "rank")


# Chunking


def _or(df: DataFrame, default, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.coalesce(name, F.lit(default)))
    return df


def _flat_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks without lines show -1."""
    rows = chunks.select("chunk_id", "repo_name", "chunk_no", "start_line", "end_line", "content")
    return _bigints(_or(rows, -1, "start_line", "end_line"), "chunk_no", "start_line", "end_line")


@query
def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_chunks(chunking.chunk_code(views.corpus(spark, sf_dir)))


@query
def chunk_text_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_chunks(_window_chunks(spark, sf_dir)).drop("start_line", "end_line")


@query
def chunk_text_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_chunks(chunking.chunk_text(views.corpus(spark, sf_dir))).drop("start_line", "end_line")


@query
def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_chunks(chunking.chunk_docs(views.corpus(spark, sf_dir), text_mode="window"))


# Code context


def _code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = views.code(spark, sf_dir)
    chunks = chunking.chunk_code(docs, **views.ENRICH_WINDOW)
    return docs, chunks, enrich.code_lines(enrich.code_documents(docs))


@query
def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _code(spark, sf_dir)[2]
    return _bigints(lines.select("doc_id", "line_no", "line", "indent", "depth"), "line_no", "indent", "depth")


@query
def locate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text chunks come without lines; chunks of log files lost their document."""
    docs = views.corpus(spark, sf_dir)
    known = docs.where(~F.endswith("metadata.file_name", F.lit(".log")))
    found = enrich.locate_chunks(_window_chunks(spark, sf_dir), known)
    rows = _or(found.select("chunk_id", "start_line", "end_line"), -1, "start_line", "end_line")
    return _bigints(rows, "start_line", "end_line")


@query
def extract_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bigints(enrich.extract_imports(_code(spark, sf_dir)[2]), "line_no")


@query
def import_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bigints(enrich.import_names(enrich.extract_imports(_code(spark, sf_dir)[2])), "line_no")


@query
def filter_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks, lines = _code(spark, sf_dir)
    used = enrich.filter_imports(chunks, enrich.extract_imports(lines))
    return _bigints(used.select("chunk_id", "line_no", "import_text"), "line_no")


@query
def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrich.scopes(_code(spark, sf_dir)[2])
    return _bigints(found.select("doc_id", "language", "kind", "start_line", "end_line"), "start_line", "end_line")


@query
def enclosing_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks, lines = _code(spark, sf_dir)
    found = enrich.enclosing_scope(chunks, enrich.scopes(lines))
    return _bigints(found.select("chunk_id", "kind", "start_line", "end_line"), "start_line", "end_line")


@query
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _code(spark, sf_dir)[2]
    found = enrich.signatures(enrich.scopes(lines), lines)
    return _bigints(found.select("doc_id", "start_line", "signature"), "start_line")


@query
def enrich_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks, _ = _code(spark, sf_dir)
    rows = enrich.enrich_chunks(chunks, docs)
    flat = rows.select("chunk_id", "content", "metadata.original_code", "metadata.context_enriched")
    return _or(flat, False, "context_enriched")


@query
def scopes_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep nesting on one line, braces far below their header: the spans follow from the numbers."""
    found = enrich.scopes(enrich.code_lines(enrich.code_documents(views.nested_code(spark, sf_dir))))
    return _bigints(found.select("doc_id", "kind", "start_line", "end_line"), "start_line", "end_line")


@query
def code_lines_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates, comments and strings over many lines, nested and with delimiters of other kinds inside."""
    lines = enrich.code_lines(enrich.code_documents(views.lexemes(spark, sf_dir)))
    return _bigints(lines.select("doc_id", "line_no", "code", "inside", "depth"), "line_no", "depth")


@query
def chunk_code_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.chunk_code_structured(views.modules(spark, sf_dir))
    rows = found.select("chunk_id", "doc_id", "chunk_no", "start_line", "end_line", F.md5("content").alias("digest"))
    return _bigints(rows, "chunk_no", "start_line", "end_line")


@query
def enrich_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every third file have lost their document and pass unchanged."""
    docs, chunks, _ = _code(spark, sf_dir)
    number = F.regexp_extract("metadata.file_name", r"m(\d+)\.", 1).cast("bigint")
    rows = enrich.enrich_chunks(chunks, docs.where(number % 3 != 0))
    flat = rows.select("chunk_id", "content", "metadata.original_code", "metadata.context_enriched")
    return _or(flat, False, "context_enriched")


# Vectors


@query
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each vector that are not zero."""
    vectors = embedding.embed(
        _window_chunks(spark, sf_dir), "content", embedding.hash_embedder(HASH_DIM), spread_by="chunk_id"
    )
    cells = vectors.select("chunk_id", F.posexplode("embedding").alias("bucket", "value")).where("value != 0")
    return cells.select(
        "chunk_id", F.col("bucket").cast("bigint").alias("bucket"),
        F.round(F.col("value").cast("double"), 6).alias("value"),
    )


@query
def embed_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three documents are embedded in a first run, all in a second one; vectors of another model stay apart."""
    path, model = _path(spark, "vectors"), embedding.hash_embedder(HASH_DIM)
    first = _documents_where(spark, sf_dir, F.col("doc_id") % 3 != 0)
    vector_store.embed_incremental(first, "content", path, "hash-256", model)
    vector_store.embed_incremental(first.limit(5), "content", path, "hash-8", embedding.hash_embedder(8))
    vectors = vector_store.embed_incremental(_window_chunks(spark, sf_dir), "content", path, "hash-256", model)
    cells = vectors.select("chunk_id", F.posexplode("embedding").alias("bucket", "value")).where("value != 0")
    return cells.select(
        "chunk_id", F.col("bucket").cast("bigint").alias("bucket"),
        F.round(F.col("value").cast("double"), 6).alias("value"),
    )


@query
def check_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector has lost its last value."""
    rows = views.table(spark, sf_dir, "embeddings").withColumn(
        "embedding",
        F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")),
    )
    good = embedding.check_dim(rows, 64, "keep").select("vec_id", F.lit(True).alias("accepted"))
    bad = embedding.check_dim(rows, 64, "reject").select("vec_id", F.lit(False).alias("accepted"))
    return good.unionByName(bad)


# Search


@query
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.postings(_window_chunks(spark, sf_dir)).select("chunk_id", "term", "tf", "dl")


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = keyword.kept_postings(_window_chunks(spark, sf_dir))
    stats = keyword.corpus_stats(found)
    return stats.withColumn("avgdl", F.round("avgdl", 6))


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _window_chunks(spark, sf_dir)
    kept, size = keyword.kept_postings(chunks)
    found = keyword.bm25_topk(views.asked(spark, sf_dir), kept, size=size, grouped=True)
    return _bigints(found, "rank")


@query
def bm25_topk_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search on stored postings, read by term bucket."""
    path = _path(spark, "postings")
    index_store.write_postings(keyword.postings(_window_chunks(spark, sf_dir)), path)
    stored, size = index_store.read_postings(spark, path)
    found = keyword.bm25_topk(views.asked(spark, sf_dir), stored, size=size)
    return _bigints(found, "rank")


@query
def bm25_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search on posting blocks kept with an index, after an update of a third of the files."""
    path = _path(spark, "index")
    _upserted(spark, path, sf_dir, lambda chunks: index_store.write_index(chunks, path, blocks=True))
    found, _ = keyword.bm25_topk_blocks(views.asked(spark, sf_dir), index_store.read_index_blocks(spark, path))
    return _bigints(found, "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows.withColumnRenamed("vec_id", "query_id"), rows


@query
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector asks for its nearest ones."""
    asked, rows = _vectors(spark, sf_dir)
    return _bigints(vector.dense_topk(asked, rows, id_col="vec_id"), "rank")


@query
def dense_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search on the path for more queries than may be sent to each task."""
    asked, rows = _vectors(spark, sf_dir)
    return _bigints(vector.dense_topk(asked, rows, id_col="vec_id", max_queries=0), "rank")


def _vector_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ivf.VectorIndex]:
    asked, rows = _vectors(spark, sf_dir)
    path = _path(spark, "vectors")
    ivf.build_index(rows, path, id_col="vec_id")
    return asked, ivf.open_index(spark, path)


@query
def dense_topk_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector asks a stored index, which goes on until no other cell can hold a better hit."""
    asked, index = _vector_index(spark, sf_dir)
    return _bigints(ivf.search(index, asked, exact=True), "rank")


@query
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probing alone against the exact search, for every vector of the table.

    The number of probes is fixed by every twentieth vector.
    """
    asked, index = _vector_index(spark, sf_dir)
    probes = ivf.probes_for(index, asked.where("query_id % 20 = 0"), target=0.95)
    share = ivf.recall(ivf.search(index, asked, probes=probes), vector.dense_topk(*_vectors(spark, sf_dir), id_col="vec_id"), "vec_id")
    stored = index.vectors().agg(F.count(F.lit(1)).alias("indexed"))
    return share.select("n", (F.col("recall") >= 0.9).alias("enough")).join(stored)


_embedded = views.embedded


def _lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    asked, index = views.asked(spark, sf_dir), _embedded(spark, sf_dir)
    dense = vector.dense_topk(embedding.embed(asked, "query"), index)
    kept, _ = keyword.kept_postings(index)
    return [keyword.bm25_topk(asked, kept, grouped=True), dense]


@query
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(_lists(spark, sf_dir))


@query
def fuse_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists fused by their scores; keyword hits weigh twice as much."""
    fused = fusion.fuse(_lists(spark, sf_dir), config.SCORE_JOIN_MODE, weights=[2, 1])
    return _bigints(fused.withColumn("score", F.round("score", 6)), "rank")


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.hybrid_search(_embedded(spark, sf_dir), views.asked(spark, sf_dir))
    return _bigints(reports.api_rows(found), "rank")


@query
def hybrid_search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested with vectors and postings, brought up to date, then searched as stored."""
    path = _path(spark, "index")

    def write(chunks: DataFrame) -> None:
        index_store.write_index(embedding.embed(chunks, "content", spread_by="chunk_id"), path, postings=True)

    _upserted(spark, path, sf_dir, write)
    postings, size = index_store.read_index_postings(spark, path)
    found = retrieve.hybrid_search(
        index_store.read_index(spark, path), views.asked(spark, sf_dir), postings=postings, size=size
    )
    return _bigints(reports.api_rows(found), "rank")


@query
def join_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of the settings; another one is refused."""
    lists = _lists(spark, sf_dir)
    try:
        fusion.fuse(lists, "concatenate")
    except ValueError:
        return _bigints(fusion.fuse(lists), "rank")
    raise AssertionError("an unknown join mode was accepted")


# Reports


@query
def skip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.skip_stats(_classified(spark, sf_dir)[0])


@query
def skip_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.skip_log(_classified(spark, sf_dir)[0])


@query
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)[0].select("repo_name", "rel_path", "status")


@query
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more repository has neither files nor patterns."""
    status, patterns = _status(spark, sf_dir)
    repos = views.files(spark, sf_dir).select("repo_name").distinct()
    more = repos.agg(F.concat(F.max("repo_name"), F.lit("-empty")).alias("repo_name"))
    return reports.ingest_summary(status, patterns, repos.unionByName(more))


@query
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per query, also for those that find nothing."""
    return reports.responses(views.partly_blank(spark, sf_dir), reports.api_rows(views.results(spark, sf_dir)))


@query
def responses_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries read from a table with other names, responses written and read back as text."""
    raw = views.table(spark, sf_dir, "benchmark")
    asked = texts.read_queries(raw, "item_id", "text")
    found = retrieve.hybrid_search(_embedded(spark, sf_dir), asked)
    path = _path(spark, "responses")
    texts.write_responses(reports.responses(asked, reports.api_rows(found)), path)
    stored = spark.read.option("lineSep", "\n\n").text(path).where("value <> ''")
    parsed = F.from_json("value", "query string, total_results bigint, results array<struct<rank bigint, file_path string, score double>>")
    rows = stored.select(parsed.alias("r")).select("r.query", "r.total_results", F.explode("r.results").alias("hit"))
    return rows.select("query", "total_results", "hit.rank", "hit.file_path", "hit.score")


@query
def result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth query is reduced to its white space and so finds nothing."""
    asked = views.partly_blank(spark, sf_dir)
    return reports.result_count(asked, retrieve.hybrid_search(_embedded(spark, sf_dir), asked))


def _rescanned(spark: SparkSession, sf_dir: str, folder: str) -> rescan.Difference:
    """The files of all documents, then the same tree with some added, changed, moved and taken out."""
    files = views.files(spark, sf_dir).where("rel_path <> '.gitignore'")
    number = F.regexp_extract("rel_path", r"f(\d+)[^/]*$", 1).try_cast("bigint")
    old = files.where(number % 13 != 0)
    content = F.when(number % 3 == 0, F.concat("content", F.lit("\nmore").cast("binary"))).otherwise(F.col("content"))
    path = F.when(number % 7 == 0, F.concat(F.lit("moved/"), "rel_path")).otherwise(F.col("rel_path"))
    new = files.where(number % 11 != 0).select("repo_name", path.alias("rel_path"), content.alias("content"))
    found = None
    for rows in (old, new):
        root = _path(spark, "tree")
        views.write_tree(rows, root)
        listing = tree.list_files(rows.select(F.concat(F.lit(f"{root}/"), "repo_name").alias("root")).distinct())
        before = spark.createDataFrame([], rescan.SNAPSHOT_SCHEMA) if found is None else found.snapshot
        found = rescan.difference(before, listing, folder, max_mb=None)
    return found


@query
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescanned(spark, sf_dir, _path(spark, "rescan")).changes


# Streaming


@query
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First every document, a third of them in an older version; then changes and deletions."""
    base = _path(spark, "stream")
    docs = views.documents(spark, sf_dir)
    changed, gone = F.col("doc_id") % 3 == 0, F.col("doc_id") % 11 == 0
    old_text = F.when(changed, F.upper("text")).otherwise(F.col("text"))

    def manifest(rows: DataFrame, text, day: str, deleted) -> None:
        content = F.encode(text, "UTF-8")
        rows.select(
            "repo_name", "rel_path", F.octet_length(content).cast("bigint").alias("length"),
            F.to_timestamp(F.lit(day)).alias("mtime"), content.alias("content"), deleted.alias("deleted"),
        ).write.mode("append").parquet(f"{base}/manifests")

    def run() -> None:
        streaming.ingest_stream(
            spark, f"{base}/manifests", f"{base}/index", f"{base}/checkpoint",
            embedding.hash_embedder(16), text_mode="window",
        ).awaitTermination()

    manifest(docs, old_text, "2024-01-01", F.lit(False))
    run()
    manifest(docs.where(changed | gone), F.col("text"), "2024-01-02", gone)
    run()
    rows = index_store.read_index(spark, f"{base}/index")
    return _bigints(rows.select("chunk_id", "chunk_no", "content"), "chunk_no")
