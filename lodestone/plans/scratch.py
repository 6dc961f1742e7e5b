"""Shared scratch folders for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Of scratch tables and the index: texts take about two thirds of what the default leaves.
COMPRESSION = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, as it is named.

    Without that setting a local session gets a folder of this machine; a cluster gets an
    error, since its executors would not share such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, under: str | None = None) -> DataFrame:
    """The rows written once to the shared folder, so that later steps do not compute them again.

    `under` is the folder of a run that its owner drops; without it the files stay.
    """
    path = new_path(df.sparkSession, label) if under is None else f"{under}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of this engine, on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def run_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """A folder for one run that goes when the run ends, failed or not."""
    path = new_path(spark, label)
    try:
        yield path
    finally:
        drop(spark, path)
