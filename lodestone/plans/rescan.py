"""A scheduled run that finds by itself what changed in the trees since the last one.

The listing of a run is kept with the digest of each file. The next listing is compared with
it: a file of the same size and time keeps its digest and is not opened, so an unchanged tree
opens no file. The others are read; digests tell what is changed, and a file that is gone and
one that is new with the same digest are a rename. The result feeds the manifests of the stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestone import config
from lodestone.plans import scratch
from lodestone.plans.ingest import named_roots
from lodestone.sources import index_store, tree

SNAPSHOT_SCHEMA = "repo_name string, rel_path string, length bigint, mtime timestamp, digest string"
_FILE = ["repo_name", "rel_path"]
_COLUMNS = ["repo_name", "rel_path", "length", "mtime", "digest"]


@dataclass(frozen=True)
class Difference:
    """`changes`: (repo_name, rel_path, change, old_path, digest) of every file that is or was there;
    `read`: the files that were opened, with content; `snapshot`: what to keep for the next run."""

    changes: DataFrame
    read: DataFrame
    snapshot: DataFrame


def difference(old: DataFrame, listing: DataFrame, folder: str, max_mb: float | None = config.MAX_FILE_MB) -> Difference:
    """Compare a kept snapshot with a new listing (repo_name, root, rel_path, length, mtime).

    change: added, changed, deleted, renamed, unchanged, or unreadable for a file that cannot be
    opened. Of files with one digest that are gone and new, the first by path is renamed to the
    first, and so on; empty files are never renamed. Files over the size cap have no digest: they
    count as changed when their size or time is another. Tables go to `folder`.
    """
    before = old.select(*_FILE, *[F.col(c).alias(f"_{c}") for c in ("length", "mtime", "digest")], F.lit(True).alias("_was"))
    same = (F.col("length") == F.col("_length")) & (F.col("mtime") == F.col("_mtime"))
    listed = scratch.materialize(
        listing.join(before, _FILE, "left").withColumn("_same", F.coalesce(same, F.lit(False))), "listed", folder
    )
    suspects = listed.where(~F.col("_same")).select("repo_name", "root", "rel_path", "length", "mtime")
    read = scratch.materialize(tree.read_content(suspects, max_mb), "read", folder)
    fresh = read.select(
        *_FILE, F.col("length").alias("_read_length"), "read_error",
        F.when(~F.coalesce("truncated", F.lit(False)), F.sha2("content", 256)).alias("_fresh"),
    )
    now = listed.join(fresh, _FILE, "left")
    digest = F.when(F.col("_same"), F.col("_digest")).otherwise(F.col("_fresh"))
    equal = F.col("_same") | F.coalesce(F.col("_fresh") == F.col("_digest"), F.lit(False))
    change = (
        F.when(F.col("read_error").isNotNull(), F.lit("unreadable"))
        .when(F.col("_was").isNull(), F.lit("added")).when(equal, F.lit("unchanged")).otherwise(F.lit("changed"))
    )
    here = now.select(
        *_FILE, F.coalesce("_read_length", "length").alias("length"), "mtime", digest.alias("digest"), change.alias("change")
    )
    gone = old.join(listing.select(*_FILE), _FILE, "left_anti").select(*_COLUMNS, F.lit("deleted").alias("change"))
    every = scratch.materialize(here.unionByName(gone), "compared", folder)
    rank = F.row_number().over(Window.partitionBy("repo_name", "digest").orderBy("rel_path"))
    moved = every.where((F.col("digest").isNotNull()) & (F.col("length") > 0))
    # two ranks over the files that came and went, not over the trees
    came = moved.where("change = 'added'").select(*_FILE, "digest", rank.alias("_rank"))
    went = moved.where("change = 'deleted'").select("repo_name", F.col("rel_path").alias("old_path"), "digest", rank.alias("_rank"))
    pairs = came.join(went, ["repo_name", "digest", "_rank"]).select(*_FILE, "old_path")
    taken = pairs.select("repo_name", F.col("old_path").alias("rel_path"), F.lit(True).alias("_taken"))
    changes = every.join(pairs, _FILE, "left").join(taken, _FILE, "left").where(
        ~((F.col("change") == "deleted") & F.col("_taken").isNotNull())
    ).select(
        *_FILE, F.when(F.col("old_path").isNotNull(), F.lit("renamed")).otherwise(F.col("change")).alias("change"),
        "old_path", "digest",
    )
    kept = every.where("change <> 'deleted' and change <> 'unreadable'").select(*_COLUMNS)
    return Difference(scratch.materialize(changes, "changes", folder), read, kept)


def manifest(found: Difference, when: object) -> DataFrame:
    """Rows for the stream: files to index again with their content, and files that went.

    A rename takes out its old path and brings its new one. `when` is the time of the run, from
    which files that went are gone.
    """
    wanted = found.changes.where(F.col("change").isin("added", "changed", "renamed"))
    alive = found.read.join(wanted.select(*_FILE), _FILE, "left_semi").select(
        *_FILE, "length", "mtime", "content", F.lit(False).alias("deleted")
    )
    went = found.changes.where("change = 'deleted'").select(*_FILE).unionByName(
        found.changes.where("change = 'renamed'").select("repo_name", F.col("old_path").alias("rel_path"))
    )
    return alive.unionByName(went.select(
        *_FILE, F.lit(0).cast("bigint").alias("length"), F.lit(when).cast("timestamp").alias("mtime"),
        F.lit(None).cast("binary").alias("content"), F.lit(True).alias("deleted"),
    ))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The latest snapshot kept at `path`; none before the first run."""
    if not index_store._exists(spark, f"{path}/latest"):
        return spark.createDataFrame([], SNAPSHOT_SCHEMA)
    run = spark.read.parquet(f"{path}/latest").agg(F.max("run")).first()[0]
    return spark.read.schema(SNAPSHOT_SCHEMA).parquet(f"{path}/run-{run}")


def rescan(
    spark: SparkSession, roots: list[str] | dict[str, str], snapshot: str, manifests: str, when: object,
    max_mb: float | None = config.MAX_FILE_MB, prune=None,
) -> DataFrame:
    """List the trees, write what changed as one more manifest, keep the new snapshot; returns the counts per change.

    The snapshot is named last, so a run that breaks off before is done again from the same one;
    the stream takes a manifest twice without effect.
    """
    with scratch.run_folder(spark, "rescan") as folder:
        listing = tree.list_files(spark.createDataFrame(named_roots(roots), "root string, name string"), skip_dirs=[".git"], under=folder, prune=prune)
        found = difference(read_snapshot(spark, snapshot), listing, folder, max_mb)
        manifest(found, when).write.mode("append").parquet(manifests)
        counts = [tuple(r) for r in found.changes.groupBy("change").count().collect()]
        runs = spark.read.parquet(f"{snapshot}/latest").agg(F.max("run")).first()[0] if index_store._exists(spark, f"{snapshot}/latest") else 0
        found.snapshot.write.mode("overwrite").parquet(f"{snapshot}/run-{runs + 1}")
        spark.createDataFrame([(runs + 1,)], "run bigint").write.mode("append").parquet(f"{snapshot}/latest")
    return spark.createDataFrame(counts, "change string, n bigint")
