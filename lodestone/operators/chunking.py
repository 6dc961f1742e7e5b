"""Documents cut into overlapping chunks, all inside the row of the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone import config
from lodestone.functions import paths, text as tx
from lodestone.operators.filters import drop_blank

_PIECES = "array<struct<start_line:int,end_line:int,content:string>>"
_SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+"


def _windows(total: Column, size: int, step: int) -> Column:
    """Numbers of the windows that cover `total` items; at least one."""
    extra = F.greatest(F.ceil((total - F.lit(size)) / F.lit(step)), F.lit(0))
    return F.sequence(F.lit(0), extra.cast("int"))


def _pieces(text: Column, size: int) -> Column:
    """A text in consecutive pieces of at most `size` characters, with their offsets."""
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / F.lit(size)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            (i * size).alias("offset"), F.substr(text, i * size + 1, F.lit(size)).alias("content")
        ),
    )


def _check(size: int, overlap: int) -> int:
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be at least 0 and below {size}")
    return size - overlap


def code_pieces(
    text: Column,
    lines: int = config.CODE_CHUNK_LINES,
    overlap: int = config.CODE_CHUNK_OVERLAP,
    max_chars: int = config.CODE_CHUNK_CHARS,
) -> Column:
    """Line windows; one that is too long becomes consecutive pieces, nothing is lost."""
    step = _check(lines, overlap)

    def located(body: Column, first: Column) -> Column:
        def piece(p: Column) -> Column:
            start = first + tx.count_of(F.substr(body, F.lit(1), p["offset"]), "\n")
            end = start + tx.count_of(p["content"], "\n")
            return F.struct(
                start.cast("int").alias("start_line"), end.cast("int").alias("end_line"),
                p["content"].alias("content"),
            )

        return F.transform(_pieces(body, max_chars), piece)

    def windows(all_lines: Column) -> Column:
        def window(k: Column) -> Column:
            body = F.array_join(F.slice(all_lines, k * step + 1, F.lit(lines)), "\n")
            return tx.let(body, lambda b: located(b, k * step))

        return F.flatten(F.transform(_windows(F.size(all_lines), lines, step), window))

    return tx.let(F.split(text, "\n"), windows).cast(_PIECES)


def _unlocated(contents: Column) -> Column:
    none = F.lit(None).cast("int")
    return F.transform(
        contents,
        lambda c: F.struct(none.alias("start_line"), none.alias("end_line"), c.alias("content")),
    ).cast(_PIECES)


def window_pieces(
    text: Column, size: int = config.TEXT_CHUNK_CHARS, overlap: int = config.TEXT_CHUNK_OVERLAP
) -> Column:
    """Character windows at a fixed step."""
    step = _check(size, overlap)
    cut = lambda k: F.substr(text, k * step + 1, F.lit(size))
    return _unlocated(F.transform(_windows(F.length(text), size, step), cut))


def sentence_pieces(
    text: Column, size: int = config.TEXT_CHUNK_CHARS, overlap: int = config.TEXT_CHUNK_OVERLAP
) -> Column:
    """Whole sentences packed up to `size`; the next chunk repeats trailing ones up to `overlap`.

    Only sentences that were new to the closed chunk are repeated, and only as far as the
    next sentence still fits, so each chunk brings new text.
    """
    _check(size, overlap)
    sentences = F.flatten(
        F.transform(
            F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0)),
            lambda s: F.transform(_pieces(s, size), lambda p: p["content"]),
        )
    )

    def carry(fresh: Column, length: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(True).alias("open"))

        def add(acc: Column, item: Column) -> Column:
            chars = acc["chars"] + item
            take = acc["open"] & (chars <= overlap) & (chars + length <= size)
            return F.struct(
                F.when(take, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
                F.when(take, chars).otherwise(acc["chars"]).alias("chars"),
                take.alias("open"),
            )

        return F.aggregate(F.reverse(fresh), start, add)

    none = F.array().cast("array<int>")
    start = F.struct(
        F.array().cast("array<struct<first:int,n:int>>").alias("closed"),
        F.lit(0).alias("first"), F.lit(0).alias("next"), F.lit(0).alias("chars"), none.alias("fresh"),
    )

    def pack(acc: Column, item: Column) -> Column:
        grown = F.struct(
            acc["closed"].alias("closed"), acc["first"].alias("first"), (acc["next"] + 1).alias("next"),
            (acc["chars"] + item).alias("chars"), F.concat(acc["fresh"], F.array(item)).alias("fresh"),
        )
        done = F.struct(acc["first"].alias("first"), (acc["next"] - acc["first"]).alias("n"))
        opened = tx.let(
            carry(acc["fresh"], item),
            lambda kept: F.struct(
                F.concat(acc["closed"], F.array(done)).alias("closed"),
                (acc["next"] - kept["n"]).alias("first"), (acc["next"] + 1).alias("next"),
                (kept["chars"] + item).alias("chars"), F.array(item).alias("fresh"),
            ),
        )
        return F.when(acc["chars"] + item <= size, grown).otherwise(opened)

    def finish(acc: Column) -> Column:
        done = F.struct(acc["first"].alias("first"), (acc["next"] - acc["first"]).alias("n"))
        return F.when(acc["next"] > acc["first"], F.concat(acc["closed"], F.array(done))).otherwise(
            acc["closed"]
        )

    def chunks(sentences: Column) -> Column:
        spans = F.aggregate(F.transform(sentences, lambda s: F.length(s)), start, pack, finish)
        join = lambda s: F.array_join(F.slice(sentences, s["first"] + 1, s["n"]), "")
        return F.transform(spans, join)

    return _unlocated(tx.let(sentences, chunks))


def text_pieces(text: Column, size: int, overlap: int, mode: str) -> Column:
    if mode == "sentence":
        return sentence_pieces(text, size, overlap)
    if mode == "window":
        return window_pieces(text, size, overlap)
    raise ValueError(f"unknown mode {mode!r}")


def _explode(docs: DataFrame, pieces: Column) -> DataFrame:
    """One row per piece, with the identity of its chunk and the link to its document."""
    cut = drop_blank(docs).select("doc_id", "metadata", F.posexplode(pieces).alias("chunk_no", "piece"))
    repo, path = F.col("metadata.repo_name"), F.col("metadata.file_path")
    return cut.select(
        paths.chunk_id(repo, path, F.col("chunk_no")).alias("chunk_id"),
        "doc_id", repo.alias("repo_name"), "chunk_no",
        "piece.start_line", "piece.end_line", "piece.content", "metadata",
    )


def chunk_code(
    docs: DataFrame,
    lines: int = config.CODE_CHUNK_LINES,
    overlap: int = config.CODE_CHUNK_OVERLAP,
    max_chars: int = config.CODE_CHUNK_CHARS,
) -> DataFrame:
    return _explode(docs, code_pieces(F.col("text"), lines, overlap, max_chars))


def chunk_text(
    docs: DataFrame,
    size: int = config.TEXT_CHUNK_CHARS,
    overlap: int = config.TEXT_CHUNK_OVERLAP,
    mode: str = "sentence",
) -> DataFrame:
    return _explode(docs, text_pieces(F.col("text"), size, overlap, mode))


def chunk_docs(docs: DataFrame, text_mode: str = "sentence") -> DataFrame:
    """Code with a known language by lines, everything else as text, in one pass."""
    text = F.col("text")
    code = (F.col("metadata.content_type") == "code") & F.col("metadata.language").isNotNull()
    as_text = text_pieces(text, config.TEXT_CHUNK_CHARS, config.TEXT_CHUNK_OVERLAP, text_mode)
    return _explode(docs, F.when(code, code_pieces(text)).otherwise(as_text))
