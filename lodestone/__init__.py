"""Code and text corpus ingestion with hybrid retrieval, as Spark jobs on tables."""

from lodestone import config

__all__ = ["config"]
