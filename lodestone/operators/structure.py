"""Code cut along its structure: the cheapest cuts of a document by dynamic programming.

Every border between two lines has a price: least of all the number of scopes that it cuts
although they would fit into a chunk, then how deep it lies, then that it is a cut at all and
that no blank line is there. The cuts with the lowest total price under the limits of a chunk
are found in one pass over the lines. A document is one row, bounded by the file size cap.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestone import config
from lodestone.functions import paths, text as tx
from lodestone.operators import enrich, lexer
from lodestone.operators.filters import drop_blank

#: Prices of a border. Each outweighs all lower ones together, for files up to the size cap.
PRICE_OF_FITTING_SCOPE = 10**12
PRICE_OF_DEPTH = 10**6
PRICE_OF_CUT = 2
PRICE_OF_TEXT = 1


def border_prices(
    sizes: np.ndarray, blank: np.ndarray, starts: np.ndarray, ends: np.ndarray, lines: int, max_chars: int
) -> np.ndarray:
    """What a cut before each line costs. Scopes reach from their first to their last line with text."""
    n = len(sizes)
    filled = np.flatnonzero(~blank)
    if len(filled):
        ends = np.maximum(filled[np.maximum(np.searchsorted(filled, ends, side="right") - 1, 0)], starts)
    before = np.concatenate(([0], np.cumsum(sizes + 1)))
    fits = (ends - starts < lines) & (before[ends + 1] - before[starts] - 1 <= max_chars)
    depth, fitting = np.zeros(n + 2, np.int64), np.zeros(n + 2, np.int64)
    for target, chosen in ((depth, np.ones(len(starts), bool)), (fitting, fits)):
        np.add.at(target, starts[chosen] + 1, 1)
        np.add.at(target, ends[chosen] + 1, -1)
    prices = np.cumsum(fitting)[:n] * PRICE_OF_FITTING_SCOPE + np.cumsum(depth)[:n] * PRICE_OF_DEPTH + PRICE_OF_CUT
    prices[1:] += np.where(blank[:-1], 0, PRICE_OF_TEXT)
    prices[:1] = 0
    return prices


def cheapest_cuts(sizes: Sequence[int], prices: Sequence[int], lines: int, max_chars: int) -> list[int]:
    """First lines of the chunks with the lowest total price; of equal ones the longest last chunk, and so on up.

    A chunk holds at most `lines` lines and `max_chars` characters, or one longer line.
    """
    # Where the last chunk may start only moves down, so the cheapest start is kept like the minimum of a sliding window:
    # `starts` holds those no later start beats, with rising totals.
    come_from, cost, low, chars = [0], 0, 0, -1
    starts: deque[tuple[int, int]] = deque()
    for end in range(1, len(sizes) + 1):
        total = cost + prices[end - 1]
        while starts and starts[-1][0] > total:
            starts.pop()
        starts.append((total, end - 1))
        chars += sizes[end - 1] + 1
        while low < end - 1 and (chars > max_chars or low < end - lines):
            chars -= sizes[low] + 1
            low += 1
        while starts[0][1] < low:
            starts.popleft()
        cost, origin = starts[0]
        come_from.append(origin)
    cuts, at = [], len(sizes)
    while at:
        at = come_from[at]
        cuts.append(at)
    return cuts[::-1]


def _cuts(lines: int, max_chars: int):
    @F.pandas_udf("array<int>")
    def cuts(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for sizes, blank, starts, ends in parts:
            found = []
            for row in zip(sizes, blank, starts, ends, strict=True):
                size, none, first, last = (np.asarray(v, kind) for v, kind in zip(row, (np.int64, bool, np.int64, np.int64), strict=True))
                prices = border_prices(size, none, first, last, lines, max_chars)
                found.append(cheapest_cuts(size.tolist(), prices.tolist(), lines, max_chars))
            yield pd.Series(found)

    return cuts


def _scopes_per_document(docs: DataFrame) -> DataFrame:
    """(doc_id, scopes): first lines, decorators included, and last lines of all scopes of a document."""
    sources = enrich.code_documents(docs)
    lines = enrich.code_lines(sources)
    # A decorator needs no lexer, and only some documents have one.
    marked = sources.where((F.col("language") == "python") & F.col("text").contains("@"))
    runs = enrich.decorators(lexer.numbered_lines(marked)).select("doc_id", F.transform(
        F.map_entries("_decorators"), lambda e: F.struct(e["key"].alias("line"), tx.count_of(e["value"], "\n").alias("more"))
    ).alias("above"))
    spans = enrich.scopes(lines).groupBy("doc_id").agg(F.collect_list(F.struct("start_line", "end_line")).alias("spans"))
    joined = spans.join(runs.hint("merge"), "doc_id", "left")

    def first(s: Column) -> Column:
        run = F.filter(F.coalesce("above", F.array().cast("array<struct<line:int,more:int>>")), lambda a: a["line"] == s["start_line"])
        return F.when(F.size(run) > 0, s["start_line"] - F.element_at(run, 1)["more"] - 1).otherwise(s["start_line"])

    return joined.select("doc_id", F.transform(
        "spans", lambda s: F.struct(first(s).cast("int").alias("start_line"), s["end_line"].cast("int").alias("end_line"))
    ).alias("scopes"))


def _pieces(body: Column, first: Column, last: Column, max_chars: int) -> Column:
    """One chunk, or consecutive pieces of a single line that is too long."""
    count = F.greatest(F.ceil(F.length(body) / F.lit(max_chars)), F.lit(1)).cast("int")
    whole = F.array(F.struct(first.cast("int").alias("start_line"), last.cast("int").alias("end_line"), body.alias("content")))
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(
        first.cast("int").alias("start_line"), last.cast("int").alias("end_line"),
        F.substr(body, k * max_chars + 1, F.lit(max_chars)).alias("content"),
    ))
    return F.when((first == last) & (count > 1), cut).otherwise(whole)


def chunk_code_structured(
    docs: DataFrame, lines: int = config.CODE_CHUNK_LINES, max_chars: int = config.CODE_CHUNK_CHARS
) -> DataFrame:
    """Chunks without overlap along scopes and blank lines; joined by line breaks they give the document.

    A class or function that fits into a chunk is never cut. Documents in languages without
    rules for scopes are cut at blank lines. Pieces of one line that is longer than a chunk follow
    each other without a line break.
    """
    none = F.array().cast("array<struct<start_line:int,end_line:int>>")
    joined = drop_blank(docs).join(_scopes_per_document(docs).hint("merge"), "doc_id", "left")
    split = joined.withColumn("_lines", F.split("text", "\n")).withColumn("_scopes", F.coalesce("scopes", none))
    sizes, blank = F.transform("_lines", F.length), F.transform("_lines", tx.is_blank)
    starts = _cuts(lines, max_chars)(sizes, blank, F.col("_scopes.start_line"), F.col("_scopes.end_line"))
    cut = split.withColumn("_starts", starts)

    def chunk(first: Column, k: Column) -> Column:
        after = F.coalesce(F.get("_starts", k + 1), F.size("_lines"))
        body = F.array_join(F.slice("_lines", first + 1, after - first), "\n")
        return tx.let(body, lambda b: _pieces(b, first, after - 1, max_chars))

    pieces = F.flatten(F.transform("_starts", chunk))
    rows = cut.select("doc_id", "metadata", F.posexplode(pieces).alias("chunk_no", "piece"))
    repo, path = F.col("metadata.repo_name"), F.col("metadata.file_path")
    return rows.select(
        paths.chunk_id(repo, path, F.col("chunk_no")).alias("chunk_id"),
        "doc_id", repo.alias("repo_name"), "chunk_no", "piece.start_line", "piece.end_line", "piece.content", "metadata",
    )
