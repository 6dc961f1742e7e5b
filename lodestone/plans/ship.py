"""Sends the packages to Python workers that were started elsewhere."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
PACKAGES = ("lodestone", "suite")


def ship(spark: SparkSession) -> None:
    """Once per Spark context; Spark hands the archive to every executor."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="lodestone-src-"), "lodestone.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for package in PACKAGES:
            for source in sorted((ROOT / package).rglob("*.py")):
                target.write(source, source.relative_to(ROOT))
    context.addPyFile(archive)
    context._lodestone_shipped = True
