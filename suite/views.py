"""Tables the registered queries work on, derived from the given ones by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.functions import paths
from lodestone.operators import chunking, embedding
from lodestone.plans import retrieve, scratch
from suite import samples

MAX_MB = 0.01
ENRICH_WINDOW = {"lines": 8, "overlap": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PARTS_PER_TASK = 2000


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys and sizes of the parts, spread over tasks: a small file of many rows is one split, but many files of code."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return rows.repartition(-(-rows.count() // PARTS_PER_TASK) or 1, "p_partkey")


def _pick(number: Column, values: list[str]) -> Column:
    chosen = F.lit(values[-1])
    for i, value in reversed(list(enumerate(values[:-1]))):
        chosen = F.when(number == i, F.lit(value)).otherwise(chosen)
    return chosen


FOLDERS = ["src/", "build/", ".git/objects/", "lib/build/", "docs/", "", "pkg/_priv/"]
SUFFIXES = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".rs", ".go", ".cpp", ".c", ".php", ".RB", ".md", ".log",
    ".tar.gz", "",
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, repo_name, rel_path, text): each document as a file of the repository `source`."""
    number = F.col("doc_id")
    path = F.concat(
        _pick(number % 7, FOLDERS),
        F.when(number % 4 == 0, F.concat(F.col("lang"), F.lit("/"))).otherwise(F.lit("")),
        F.lit("f"), number.cast("string"),
        _pick(number % 16, SUFFIXES),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("repo_name"), path.alias("rel_path"), "text"
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and one ignore file per repository as bytes: some not UTF-8, some with CRLF."""
    docs = documents(spark, sf_dir)
    raw = F.encode("text", "UTF-8")
    bad = F.unhex(F.lit("FF"))
    content = (
        F.when(F.col("doc_id") % 17 == 0, F.concat(bad, raw))
        .when(F.col("doc_id") % 19 == 0, F.concat(raw, bad))
        .when(F.col("doc_id") % 5 == 0, F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8"))
        .otherwise(raw)
    )
    repo_number = F.substring("repo_name", 4, 9).cast("int")
    extra = F.when(repo_number % 2 == 0, F.lit(samples.EXTRA_PATTERNS[0])).otherwise(
        F.lit(samples.EXTRA_PATTERNS[1])
    )
    before, after = samples.IGNORE_FILE.split("{extra}")
    ignore = F.encode(F.concat(F.lit(before), extra, F.lit(after)), "UTF-8")
    columns = ["repo_name", "rel_path", "content"]
    rows = docs.withColumn("content", content).select(columns)
    ignores = docs.select("repo_name").distinct().select(
        "repo_name", F.lit(".gitignore").alias("rel_path"), ignore.alias("content")
    )
    every = rows.unionByName(ignores)
    return every.withColumn("length", F.octet_length("content").cast("bigint"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as `docs`."""
    return paths.with_document(documents(spark, sf_dir))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per part as `docs`."""
    key = F.col("p_partkey")
    kind = key % len(samples.FILES)
    text = _pick(kind, [body for _, body in samples.FILES])
    text = F.replace(text, F.lit("<K>"), key.cast("string"))
    text = F.replace(text, F.lit("<S>"), F.col("p_size").cast("string"))
    path = F.concat(F.lit("src/m"), key.cast("string"), F.lit("."), _pick(kind, [e for e, _ in samples.FILES]))
    rows = _parts(spark, sf_dir).select(
        F.lit("parts").alias("repo_name"), path.alias("rel_path"), text.alias("text")
    )
    return paths.with_document(rows)


def partly_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asked texts, every fifth reduced to its white space."""
    blank = F.regexp_replace("query", r"[^\s\p{Z}]", "")
    return asked(spark, sf_dir).withColumn(
        "query", F.when(F.col("query_id") % 5 == 0, blank).otherwise(F.col("query"))
    )


def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_text(corpus(spark, sf_dir), mode="window")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embed(window_chunks(spark, sf_dir), "content", spread_by="chunk_id")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over all chunks for the asked texts that are not blank, stored to be shown."""
    found = retrieve.hybrid_search(embedded(spark, sf_dir), partly_blank(spark, sf_dir))
    return scratch.materialize(found, "results")


def nested_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated Java file per part as `docs`: a header whose brace is up to 30 lines below it,
    and up to 50 nested braces on one line."""
    key, depth = F.col("p_partkey"), F.col("p_size").cast("int")
    below = (key % 31).cast("int")
    throws = F.when(
        below > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(below, F.lit(1))), lambda i: F.concat(F.lit("\n  throws X"), i.cast("string"), F.lit(","))), "")
    ).otherwise(F.lit(""))
    text = F.concat(
        F.lit("class C"), key.cast("string"), F.lit(" {\n  int g()"), throws, F.lit("\n  {\n    x = "),
        F.repeat(F.lit("{"), depth), F.repeat(F.lit("}"), depth), F.lit(";\n    return 1;\n  }\n}"),
    )
    path = F.concat(F.lit("gen/m"), key.cast("string"), F.lit(".java"))
    rows = _parts(spark, sf_dir).select(F.lit("generated").alias("repo_name"), path.alias("rel_path"), text.alias("text"))
    return paths.with_document(rows)


def lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated file per part as `docs`, with strings, comments and templates nested `p_size` deep."""
    key, depth = F.col("p_partkey"), F.col("p_size").cast("int")

    def lines(parts: list[tuple]) -> Column:
        each = [F.array_repeat(F.lit(line), depth if repeated else 1) for repeated, line, *_ in parts]
        return F.array_join(F.concat(*each), "\n")

    kind = key % len(samples.LEXEMES)
    text = F.lit(None).cast("string")
    for i, (_, parts) in enumerate(samples.LEXEMES):
        text = F.when(kind == i, lines(parts)).otherwise(text)
    path = F.concat(F.lit("lex/m"), key.cast("string"), _pick(kind, [e for e, _ in samples.LEXEMES]))
    rows = _parts(spark, sf_dir).select(
        F.lit("generated").alias("repo_name"), path.alias("rel_path"),
        F.replace(text, F.lit("<K>"), key.cast("string")).alias("text"),
    )
    return paths.with_document(rows)


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated module per part as `docs`: `p_size` % 7 + 3 functions of 1 to 47 lines, in Java
    inside a class, some after a blank line, every fifth line of a body blank, some lines very long."""
    key = F.col("p_partkey")
    java = key % 2 == 1
    pad = F.when(java, F.lit("  ")).otherwise(F.lit(""))

    def function(j: Column) -> Column:
        def line(i: Column) -> Column:
            long = F.when((key % 11 == 3) & (i == 3), F.repeat(F.lit("y + "), 400)).otherwise(F.lit(""))
            body = F.concat(pad, F.lit("    x = "), long, i.cast("string"), F.when(java, F.lit(";")).otherwise(F.lit("")))
            return F.when(i % 5 == 0, F.lit("")).otherwise(body)

        blank = F.when((key + j) % 2 == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        name = F.concat(F.lit("f"), j.cast("string"))
        header = F.when(java, F.concat(F.lit("  int "), name, F.lit("() {"))).otherwise(F.concat(F.lit("def "), name, F.lit("():")))
        closer = F.when(java, F.array(F.lit("  }"))).otherwise(F.array().cast("array<string>"))
        body = F.transform(F.sequence(F.lit(1), (key * (j + 3) % 47 + 1).cast("int")), line)
        return F.concat(blank, F.array(header), body, closer)

    functions = F.flatten(F.transform(F.sequence(F.lit(0), (F.col("p_size") % 7 + 2).cast("int")), function))
    first = F.when(java, F.concat(F.lit("class C"), key.cast("string"), F.lit(" {"))).otherwise(F.lit("import os"))
    last = F.when(java, F.array(F.lit("}"))).otherwise(F.array().cast("array<string>"))
    path = F.concat(F.lit("mod/m"), key.cast("string"), F.when(java, F.lit(".java")).otherwise(F.lit(".py")))
    rows = _parts(spark, sf_dir).select(
        F.lit("generated").alias("repo_name"), path.alias("rel_path"),
        F.array_join(F.concat(F.array(first), functions, last), "\n").alias("text"),
    )
    return paths.with_document(rows)


def _write_step(root: str):
    root = re.sub(r"\Afile:/+", "/", root)

    def step(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for row in batch.itertuples(index=False):
                path = f"{base}/{row.repo_name}/{row.rel_path}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path, compression=None) as handle:
                    handle.write(row.content)
            yield pd.DataFrame({"n": [len(batch)]})

    return step


def write_tree(rows: DataFrame, root: str) -> int:
    """Files of a table as a tree on a shared folder; how many."""
    written = rows.select("repo_name", "rel_path", "content").mapInPandas(_write_step(root), "n bigint")
    return written.agg(F.sum("n")).first()[0]
