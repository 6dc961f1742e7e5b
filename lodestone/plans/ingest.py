"""Ingestion from end to end: files to classified files, documents, chunks and index rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone import config
from lodestone.functions import paths
from lodestone.operators import chunking, enrich, filters, ignore, reports
from lodestone.operators.embedding import Embedder, embed
from lodestone.plans import scratch
from lodestone.sources import tree
from lodestone.sources.texts import read_text


@dataclass(frozen=True)
class Ingestion:
    """The lazy tables of one run, and the scratch folder they read, if any.

    `close()`, or the end of a `with` block, drops that folder; the tables are of no use then.
    """

    repos: DataFrame
    patterns: DataFrame
    classified: DataFrame
    status: DataFrame
    docs: DataFrame
    chunks: DataFrame
    folder: str | None = None

    def close(self) -> None:
        if self.folder:
            scratch.drop(self.chunks.sparkSession, self.folder)

    def __enter__(self) -> Ingestion:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def skip_stats(self) -> DataFrame:
        return reports.skip_stats(self.classified)

    def summary(self) -> DataFrame:
        return reports.ingest_summary(self.status, self.patterns, self.repos)


def classify(files: DataFrame, patterns: DataFrame, max_mb: float = config.MAX_FILE_MB) -> DataFrame:
    """Files that the walk reaches with their skip reason; files below ignored folders are gone."""
    with_status = ignore.with_ignore_status(files, ignore.compile_rules(patterns))
    return filters.with_skip_reason(with_status, max_mb)


def to_process(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("skip_reason").isNull())


def chunk_files(
    decoded: DataFrame, embedder: Embedder | None = None, enrich_code: bool = False, text_mode: str = "sentence",
    spread: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(docs, chunks with vectors) of decoded files, whose texts need no `spread` when the files are spread already."""
    docs = paths.with_document(decoded.where(F.col("text").isNotNull()))
    chunks = chunking.chunk_docs(docs, text_mode)
    if enrich_code:
        chunks = enrich.enrich_chunks(chunks, docs)
    return docs, embed(chunks, "content", embedder, spread_by="chunk_id" if spread else None)


def ingest_files(files: DataFrame, max_mb: float = config.MAX_FILE_MB, **options) -> Ingestion:
    """Files with content, such as a manifest, to index rows."""
    patterns = ignore.load_ignore(read_text(files))
    classified = classify(files, patterns, max_mb)
    status = reports.ingest_status(read_text(to_process(classified)))
    docs, chunks = chunk_files(status, **options)
    return Ingestion(files.select("repo_name").distinct(), patterns, classified, status, docs, chunks)


def named_roots(roots: list[str] | dict[str, str]) -> list[tuple[str, str | None]]:
    """(root, repository name). A list names each root by its last part, a dict gives the names.

    The name is the key of rules, documents and chunks, so two roots may not share one.
    """
    if isinstance(roots, dict):
        named = [(root, name) for name, root in roots.items()]
        if any("/" in name for _, name in named):
            raise ValueError("a repository name holds no slash")
        return named
    trimmed = list(dict.fromkeys(root.rstrip("/") or "/" for root in roots))
    seen: dict[str, str] = {}
    for root in trimmed:
        name = root.rsplit("/", 1)[-1]
        if name in seen:
            raise ValueError(f"{seen[name]} and {root} have the same last part; give names: {{name: root}}")
        seen[name] = root
    return [(root, None) for root in trimmed]


def ingest_roots(
    spark: SparkSession, roots: list[str] | dict[str, str], max_mb: float = config.MAX_FILE_MB, **options
) -> Ingestion:
    """Trees on shared storage to index rows. A dict names roots that share their last part.

    The root ignore files are read first, so the walk does not enter an ignored folder. The
    trees are listed once and each file is opened once: the listing and the classified files,
    with the bytes of those to process, become tables in the shared folder. Ignored files are
    dropped before their content is read.
    """
    table = spark.createDataFrame(named_roots(roots), "root string, name string")
    folder = scratch.new_path(spark, "ingest")
    places = tree.named_roots(table)
    repos = places.select("repo_name").distinct()
    heads = places.select(
        "repo_name", "root", F.lit(config.IGNORE_FILE).alias("rel_path"), F.lit(0).cast("bigint").alias("length"),
        F.lit(None).cast("timestamp").alias("mtime"),
    )
    texts = read_text(tree.read_content(heads, max_mb=None)).select("repo_name", "rel_path", "text")
    patterns = scratch.materialize(ignore.load_ignore(texts), "patterns", folder)
    rules = ignore.compile_rules(patterns)

    def not_ignored(folders: DataFrame) -> DataFrame:
        status = ignore.with_ignore_status(folders, rules)
        return status.where(F.col("ignore_status").isNull()).select(*folders.columns)

    listing = tree.list_files(table, skip_dirs=[".git"], under=folder, prune=not_ignored)
    reached = ignore.with_ignore_status(listing, rules)
    ignored = reached.where(F.col("ignore_status").isNotNull())
    read = tree.read_content(reached.where(F.col("ignore_status").isNull()), max_mb)
    columns = ["repo_name", "rel_path", "length", "mtime", "content", "read_error", "ignore_status"]
    kept = read.withColumn("ignore_status", F.lit(None).cast("string")).select(columns)
    unread = ignored.withColumn("content", F.lit(None).cast("binary")).withColumn(
        "read_error", F.lit(None).cast("string")
    )
    classified = filters.with_skip_reason(kept.unionByName(unread.select(columns)), max_mb)
    content = F.when(F.col("skip_reason").isNull(), F.col("content"))
    classified = scratch.materialize(classified.withColumn("content", content), "classified", folder)
    status = reports.ingest_status(read_text(to_process(classified)))
    docs, chunks = chunk_files(status, **options)
    return Ingestion(repos, patterns, classified, status, docs, chunks, folder)
