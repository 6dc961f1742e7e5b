"""Keyword search: postings, corpus statistics and BM25 top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType

from lodestone import config
from lodestone.functions import text as tx
from lodestone.operators import vector
from lodestone.operators.filters import guard_query
from lodestone.operators.ranking import top_k
from lodestone.plans import scratch
from lodestone.plans.sizing import fits_broadcast, lookup_join

# Chunks of a cell of posting lists at most, and postings after which a cell takes no further chunk.
_CELL_CHUNKS = 8192
_CELL_POSTINGS = 1_000_000


def _terms(chunks: DataFrame) -> DataFrame:
    placed = chunks.select("chunk_id", "content").repartition("chunk_id")
    return placed.select("chunk_id", tx.tokens(F.col("content")).alias("terms"))


def _counts(terms: pa.Array) -> pa.Array:
    """Of each list of terms the distinct ones, in order, and how often they occur."""
    coded = terms.flatten().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    keys = np.sort(rows * len(order) + place[coded.indices.to_numpy(zero_copy_only=False)])
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    row, at = np.divmod(keys[heads], max(len(order), 1))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(terms)))))
    found = [coded.dictionary.take(pa.array(order[at])), pa.array(np.diff(heads, append=len(keys)), pa.int64())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(found, ["term", "tf"]))


def _counted(whole: DataFrame) -> DataFrame:
    """Texts of a chunk, usually a single one, counted inside the row: `lengths` and `firsts`, the number of terms and the
    first term of each text, `dl`, and `counts` (term, tf)."""
    others = [c for c in whole.columns if c != "_texts"]
    counts = F.arrow_udf("array<struct<term:string,tf:bigint>>")(_counts)
    lists = whole.select(*others, F.transform("_texts", tx.tokens).alias("_lists"))
    found = lists.select(
        *others, F.transform("_lists", lambda terms: F.size(terms)).alias("lengths"),
        F.transform("_lists", lambda terms: F.get(terms, F.lit(0))).alias("firsts"), counts(F.flatten("_lists")).alias("counts"),
    )
    return found.withColumn("dl", F.get(F.filter("lengths", lambda n: n > 0), F.lit(0)).cast("bigint"))


def _rows_of(counted: DataFrame, *keep: str) -> DataFrame:
    """The postings of counted chunks."""
    # The outer form keeps Spark from tokenizing once more to drop empty texts ahead of it.
    rows = counted.select("chunk_id", "dl", "firsts", *keep, F.explode_outer("counts").alias("p"))
    leads = F.array_contains("firsts", F.col("p.term"))
    return rows.select("chunk_id", "p.term", "p.tf", "dl", leads.alias("leads"), *keep).where(F.col("term").isNotNull())


def _whole(chunks: DataFrame, *keep: str) -> DataFrame:
    """(chunk_id, _texts, _rows): one row per chunk id with its texts, and the `keep` columns of each of its rows."""
    own = Window.partitionBy("chunk_id").orderBy(F.length("content"), "content")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = chunks.select("chunk_id", "content", *keep).repartition("chunk_id")
    rows = [F.collect_list(F.struct(*keep)).over(every).alias("_rows")] if keep else []
    return placed.select(
        "chunk_id", F.row_number().over(own).alias("_at"), F.collect_list("content").over(every).alias("_texts"), *rows
    ).where(F.col("_at") == 1).drop("_at")


def postings(chunks: DataFrame, *keep: str) -> DataFrame:
    """(chunk_id, term, tf, dl, leads, *keep): how often a term occurs in a chunk of `dl` terms.

    `leads` marks the term a chunk starts with, so one row per chunk. The text moves once, by
    chunk, and its terms are counted inside the row, so a task never holds more than the texts of
    its partition. The rows of a chunk follow each other in one task, which a search relies on.
    Rows with one `chunk_id` are one chunk, whose postings come once for the `keep` columns of each.
    """
    found = _rows_of(_counted(_whole(chunks, *keep)), *(["_rows"] if keep else []))
    if not keep:
        return found
    return found.withColumn("_row", F.explode("_rows")).select("chunk_id", "term", "tf", "dl", "leads", *[f"_row.{c}" for c in keep])


def kept_chunks(chunks: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, corpus size, rows): what `kept_postings` gives, and (chunk_id, *keep) of each row of the chunks.

    A search shows few of the chunks it reads; kept beside their counts, they are not cut and moved again for that.
    """
    kept = scratch.materialize(_counted(_whole(chunks, *keep)), "postings")
    rows = kept.select("chunk_id", F.explode("_rows").alias("_row")).select("chunk_id", "_row.*") if keep else kept.select("chunk_id")
    return _rows_of(kept), _size_of(kept.select(F.explode("lengths").alias("dl"))), rows


def kept_postings(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, corpus size) as `postings` and `corpus_size_of` give them, of texts that are tokenized once.

    A search reads the postings for the document frequencies and again for the scores. The counts of
    a chunk are one row of a table in the shared folder, so its postings stay together in one task.
    """
    return kept_chunks(chunks)[:2]


def corpus_size(postings: DataFrame) -> DataFrame:
    """One row: `n` chunks that have terms, and their average length. `postings` may be lists."""
    if _are_lists(postings):
        n = F.sum(F.size("leads"))
        return postings.where(F.col("term").isNotNull()).agg(
            F.coalesce(n, F.lit(0)).alias("n"), (F.sum(F.aggregate("tf", F.lit(0).cast("bigint"), lambda s, tf: s + tf)) / n).alias("avgdl")
        )
    n = F.count_if(F.col("leads"))
    return postings.agg(n.alias("n"), (F.sum("tf") / n).alias("avgdl"))


def corpus_size_of(chunks: DataFrame) -> DataFrame:
    """The same row straight from the texts, placed as for `postings` so that both share the shuffle."""
    return _size_of(_terms(chunks).select(F.size("terms").alias("dl")))


def _size_of(lengths: DataFrame) -> DataFrame:
    n = F.count_if(F.col("dl") > 0)
    return lengths.agg(n.alias("n"), (F.sum("dl") / n).alias("avgdl"))


def term_bucket(term: Column, buckets: int = config.POSTINGS_BUCKETS) -> Column:
    """Where a stored postings table keeps a term."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def document_frequency(postings: DataFrame) -> DataFrame:
    found = F.sum(F.size("at")) if _are_lists(postings) else F.count(F.lit(1))
    return postings.groupBy("term").agg(found.alias("df"))


def _are_lists(postings: DataFrame) -> bool:
    return "cell" in postings.columns


def posting_lists(postings: DataFrame, *place: str, chunks: int | None = None, salt: int = 0, apart: bool = True) -> DataFrame:
    """(term, cell, n, max_tf, min_dl, times, at, tf, leads, chunk_ids, dl, *place): postings gathered by term and cell, each chunk
    named once.

    A cell is up to `chunks` chunks of one place that follow each other in a task. Its row without a term
    has the `chunk_ids` and `dl` of its chunks, their number that have terms in `n` and of their terms in
    `max_tf`; the row of a term has the places `at` of its chunks in that row, ascending, how often it
    occurs in each, and the places of those that it `leads`, with their number, the largest `tf` and the
    least `dl`, and how many `times` a chunk is in it at most. The rows of a chunk must follow each other in one task, as `postings()` gives them; else a
    chunk is in several cells. Cells are numbered from `salt` on. Unless `apart`, the row of one of the terms
    has the chunks of the cell as well, and there is none without a term.
    """
    most = chunks or _CELL_CHUNKS
    kind = postings.schema["chunk_id"].dataType
    places = [f"{c} {postings.schema[c].dataType.simpleString()}" for c in place]
    schema = ", ".join([
        "term string, cell bigint, n bigint, max_tf bigint, min_dl bigint, times bigint, at array<smallint>, "
        "tf array<int>, leads array<smallint>",
        f"chunk_ids array<{kind.simpleString()}>, dl array<bigint>", *places,
    ])

    def listed(cell: int, held: list[tuple[pa.RecordBatch, np.ndarray]]) -> pa.RecordBatch:
        rows = pa.Table.from_batches([b for b, _ in held]).combine_chunks().to_batches()[0]
        at = np.concatenate([a for _, a in held]).astype(np.int16)
        coded = rows.column(1).dictionary_encode()
        term = coded.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        heads = np.flatnonzero(np.diff(term[order], prepend=-1))
        ends = pa.array(np.append(heads, len(term)), pa.int32())
        leads = rows.column(4).to_numpy(zero_copy_only=False).astype(bool)[order]
        led = np.append(0, np.cumsum(np.add.reduceat(leads, heads, dtype=np.int64)))
        again = np.flatnonzero(np.diff(term[order], prepend=-1) | np.diff(at[order], prepend=-1))
        copies = np.diff(np.append(again, len(term)))
        tf, dl = (rows.column(c).to_numpy(zero_copy_only=False)[order] for c in (2, 3))
        lists = [
            coded.dictionary.take(pa.array(term[order][heads])), pa.array(np.full(len(heads), cell)), pa.array(np.diff(np.append(heads, len(term)))),
            pa.array(np.maximum.reduceat(tf, heads)), pa.array(np.minimum.reduceat(dl, heads)),
            pa.array(np.maximum.reduceat(copies, np.searchsorted(again, heads))),
            pa.ListArray.from_arrays(ends, pa.array(at[order])),
            pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(led, pa.int32()), pa.array(at[order][leads])),
        ]
        firsts = pa.array(np.flatnonzero(np.diff(at, prepend=-1)))
        whole = pa.array([0, len(firsts)], pa.int32())
        names, sizes = (pa.ListArray.from_arrays(whole, rows.column(c).take(firsts)) for c in (0, 3))
        none = lambda a: pa.nulls(1, a.type)
        total = [pa.array([int(led[-1])]), pa.array([int(tf.sum())])]
        own = [none(lists[0]), pa.array([cell]), *total, *[none(a) for a in lists[4:]], names, sizes]
        every = [*lists, pa.nulls(len(heads), names.type), pa.nulls(len(heads), sizes.type)]
        if not apart:
            own, every[9:] = [a[:0] for a in every], [pa.concat_arrays([a, b[1:]]) for a, b in zip((names, sizes), every[9:], strict=True)]
        same = [rows.column(5 + i).take(pa.array(np.zeros(len(heads) + apart, np.int64))) for i in range(len(place))]
        return pa.RecordBatch.from_arrays(
            [*[pa.concat_arrays(pair) for pair in zip(own, every, strict=True)], *same],
            names=["term", "cell", "n", "max_tf", "min_dl", "times", "at", "tf", "leads", "chunk_ids", "dl", *place],
        )

    def fresh_at(rows: pa.RecordBatch, column: int, last: tuple | None) -> np.ndarray:
        codes = rows.column(column).dictionary_encode("encode").indices.to_numpy()
        fresh = np.diff(codes, prepend=codes[0]) != 0
        fresh[0] = last is None or rows.column(column)[0].as_py() != last[column]
        return fresh

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, count, size, last = salt + (TaskContext.get().partitionId() << 32), [], 0, 0, None
        for batch in batches:
            while batch.num_rows:
                moved = np.zeros(batch.num_rows, bool)
                for c in range(5, 5 + len(place)):
                    moved |= fresh_at(batch, c, last)
                fresh = moved | fresh_at(batch, 0, last)
                starts, turns = np.flatnonzero(fresh), np.flatnonzero(moved)
                # a cell ends where it is full, and where another place begins
                room = most - count if size < _CELL_POSTINGS else 0
                ends = [int(starts[room])] if len(starts) > room else []
                ends += [int(t) for t in turns if t or held][:1]
                cut = min(ends, default=batch.num_rows)
                if cut:
                    held.append((batch.slice(0, cut), count - 1 + np.cumsum(fresh[:cut])))
                    count, size = count + int(fresh[:cut].sum()), size + cut
                    last = tuple(column[cut - 1].as_py() for column in batch.columns)
                    batch = batch.slice(cut)
                if ends:
                    yield listed(cell, held)
                    cell, held, count, size, last = cell + 1, [], 0, 0, None
        if held:
            yield listed(cell, held)

    known = postings.where(F.col("term").isNotNull())
    return known.select("chunk_id", "term", "tf", "dl", "leads", *place).mapInArrow(step, schema)


def postings_in_place(chunks: DataFrame, *keep: str) -> DataFrame:
    """The rows of `postings(chunks, *keep)` without a shuffle of the texts, the rows of a chunk and of a place together.

    Only ids are compared over all chunks; if one is there twice, its texts have to be brought together first.
    """
    rows = chunks.select("chunk_id", "content", *keep)
    if rows.groupBy(F.xxhash64("chunk_id")).count().where("count > 1").isEmpty():
        return _rows_of(_counted(rows.withColumn("_texts", F.array("content")).drop("content")), *keep)
    found = postings(chunks, *keep).repartition(*keep, F.pmod(F.xxhash64("chunk_id"), F.lit(config.LOOKUP_SALTS)))
    return found.sortWithinPartitions(*keep, "chunk_id")


def _names_of(lists: DataFrame) -> DataFrame:
    return lists.where(F.col("chunk_ids").isNotNull())


def _named(lists: DataFrame) -> DataFrame:
    """(cell, at, chunk_id, dl) of the chunks of posting lists."""
    rows = _names_of(lists).select("cell", F.posexplode(F.arrays_zip("chunk_ids", "dl")).alias("at", "c"))
    return rows.select("cell", F.col("at").cast("smallint").alias("at"), F.col("c.chunk_ids").alias("chunk_id"), "c.dl")


def unlisted(lists: DataFrame, names: DataFrame) -> DataFrame:
    """Posting lists, all or some, as the rows of `postings()`; `names` are lists that have the chunks of all cells."""
    rows = lists.where(F.col("term").isNotNull()).select("term", "cell", "leads", F.explode(F.arrays_zip("at", "tf")).alias("e"))
    found = rows.select("term", "cell", "e.at", F.col("e.tf").cast("bigint").alias("tf"), F.array_contains("leads", F.col("e.at")).alias("leads"))
    return found.join(_named(names), ["cell", "at"]).select("chunk_id", "term", "tf", "dl", "leads")


def _scalar(size: DataFrame) -> Column:
    """The one row of `corpus_size` as a value each task gets, computed once."""
    return size.select(F.struct("n", "avgdl")).scalar()


def corpus_stats(postings: DataFrame) -> DataFrame:
    """(term, df, n, avgdl) for every term of the corpus."""
    size = corpus_size(postings)
    whole = _scalar(size)
    return document_frequency(postings).select(
        "term", "df", whole["n"].alias("n"), whole["avgdl"].alias("avgdl")
    )


def posting_blocks(postings: DataFrame, *place: str, chunks: int = config.BLOCK_CHUNKS) -> DataFrame:
    """Postings gathered by term and slot: (term, slot, n, max_tf, min_dl, entries, *place).

    A place has as many slots as it takes for about `chunks` chunks in each, so the list of a hot
    term never grows with the place. The largest `tf` and the least `dl` of a block bound what it
    can add to a score, whatever the statistics of the corpus become. A row without a term per
    place holds its number of chunks in `n` and of their terms in `max_tf`.
    """
    counts = postings.where("leads").groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunks)).alias("slots"))
    slot = F.pmod(F.xxhash64("chunk_id"), F.col("slots")).cast("int")
    blocks = postings.join(counts, list(place)).groupBy(*place, "term", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"),
        F.collect_list(F.struct("chunk_id", "tf", "dl")).alias("entries"),
    )
    none = F.lit(None)
    sizes = postings.groupBy(*place).agg(
        F.count_if("leads").alias("n"), F.sum("tf").alias("max_tf")
    ).select(
        *place, none.cast("string").alias("term"), F.lit(-1).alias("slot"), "n", "max_tf", none.cast("bigint").alias("min_dl"),
        none.cast("array<struct<chunk_id:string,tf:bigint,dl:bigint>>").alias("entries"),
    )
    return blocks.unionByName(sizes)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each term once per query; blank queries have none."""
    asked = guard_query(queries).where(F.col("status") == "ok")
    return asked.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("term"))


def bm25_weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    """Robertson and Zaragoza 2009, with the idf that stays above zero."""
    idf = F.log1p((n - df + 0.5) / (df + 0.5))
    norm = F.lit(config.BM25_K1) * (1 - config.BM25_B + config.BM25_B * dl / avgdl)
    return idf * tf * (config.BM25_K1 + 1) / (tf + norm)


def bm25_topk(
    queries: DataFrame, postings: DataFrame, k: int = config.TOP_K_BM25, size: DataFrame | None = None,
    grouped: bool = False,
) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the chunks that share a term with the query.

    `postings` may come from `postings()`, or be the lists of a stored table; with a `term_bucket` column, and
    the number of `buckets` in the stored `size`, only the buckets of the asked terms are read.
    `size` is the row of `corpus_size` when it is known; else all postings are read for it. `grouped`
    tells that the postings of a chunk follow each other in one task, as `postings()` and
    `kept_postings()` give them; others are first brought together. Queries that fit a broadcast are scored there, and only the
    best `k` of each leave a task.
    """
    asked = query_terms(queries)
    keys = ["term"]
    if "term_bucket" in postings.columns and size is not None and "buckets" in size.columns:
        asked = asked.withColumn("term_bucket", term_bucket(F.col("term"), size.first()["buckets"]))
        keys.append("term_bucket")
    small = fits_broadcast(asked)
    # Terms are never empty; Spark prunes partitions only by a side that has such a filter.
    wanted = asked.where(F.col("term") != "").select(*keys).distinct()
    found = postings.join(F.broadcast(wanted) if small else wanted, keys, "left_semi")
    size = corpus_size(postings) if size is None else size
    frequency = document_frequency(found)
    whole = _scalar(size)
    if small:
        numbers, lists, known, kind = _numbered(asked)
        listed = found.join(F.broadcast(frequency.join(F.broadcast(numbers), "term")), "term")
        if _are_lists(postings):
            return top_k(_scored_lists(listed, _names_of(postings), whole, lists, known, kind, k), k)
        if not grouped:
            listed = listed.select("chunk_id", "number", "df", "tf", "dl").repartition("chunk_id")
        weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), whole["n"], whole["avgdl"])
        rows = listed.select("chunk_id", "number", weight.alias("weight"))
        # Spark drops a sort that a join follows
        rows = rows if grouped else rows.sortWithinPartitions("chunk_id")
        return top_k(rows.mapInArrow(*_scored_chunks(lists, known, kind, postings.schema["chunk_id"].dataType, k)), k)
    terms = asked.join(frequency, "term").select("query_id", "term", "df")
    rows = unlisted(found, postings) if _are_lists(postings) else found
    hits = lookup_join(rows, terms, "term", spread="chunk_id", broadcast=False)
    weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), whole["n"], whole["avgdl"])
    scored = hits.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("score"))
    return top_k(scored, k)


def _queries_of(terms: DataFrame) -> DataFrame:
    """(term, df, queries): the queries that ask for a term as one array."""
    return terms.groupBy("term").agg(F.first("df").alias("df"), F.collect_list("query_id").alias("queries"))


def _asked_ids(asked: DataFrame) -> tuple[np.ndarray, pa.DataType, str]:
    """The ids of queries that fit a broadcast, in order, and their type."""
    found = asked.select("query_id").distinct().orderBy("query_id").toArrow().column(0)
    return found.to_numpy(), found.type, asked.schema["query_id"].dataType.simpleString()


def _numbered(asked: DataFrame) -> tuple[DataFrame, pa.ListArray, pa.Array, str]:
    """Of (query_id, term) that fit a broadcast: (term, number); per number the places of its queries among their ids; the
    ids in order and their type. A posting then names a number, not each of the queries that ask for its term."""
    pairs = asked.select("term", "query_id").orderBy("term").toArrow().combine_chunks()
    coded, ids = (pairs.column(c).combine_chunks() for c in ("term", "query_id"))
    coded, known = coded.dictionary_encode(), ids.unique().sort()
    number, terms = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    offsets = np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(terms)))))
    places = pc.index_in(ids, known).take(pa.array(np.argsort(number, kind="stable")))
    numbers = asked.sparkSession.createDataFrame(pa.table({"term": terms, "number": pa.array(np.arange(len(terms)), pa.int32())}))
    return numbers, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), places), known, asked.schema["query_id"].dataType.simpleString()


def _offer(best: vector._Running, chunk: np.ndarray, names: np.ndarray, queries: pa.ListArray, weight: np.ndarray) -> None:
    """Sum the weights of postings, given the number of their chunk and the places of their queries, per query and chunk."""
    counts = np.diff(np.asarray(queries.offsets))
    known = len(best.query_ids)
    cell = queries.flatten().to_numpy(zero_copy_only=False) * np.int64(len(names)) + np.repeat(chunk, counts)
    cells = known * len(names)
    score = np.bincount(cell, np.repeat(weight, counts), cells)
    none = score == 0 if (weight > 0).all() else np.bincount(cell, minlength=cells) == 0
    score = np.rint(score * vector._SCALE)
    score[none] = -1
    best.offer(names, score.reshape(known, -1), np.arange(known), least=0)


def _scored_chunks(lists: pa.ListArray, ids: pa.Array, kind: str, id_kind: DataType, k: int) -> tuple:
    """A step over (chunk_id, number, weight), the rows of a chunk together, and its schema: the best k per query and task."""
    known, query_type = ids.to_numpy(zero_copy_only=False), ids.type
    most = max(1, vector._CELLS // max(len(known), 1))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rest = vector._Running(known, None, k), None

        def score(rows: pa.RecordBatch, starts: np.ndarray) -> None:
            for low in range(0, len(starts), most):
                first = starts[low]
                last = starts[low + most] if low + most < len(starts) else rows.num_rows
                own = rows.slice(first, last - first)
                heads = starts[low:low + most] - first
                chunk = np.repeat(np.arange(len(heads)), np.diff([*heads, own.num_rows]))
                _offer(best, chunk, vector._ids(own.column(0).take(pa.array(heads))), lists.take(own.column(1)), own.column(2).to_numpy())

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            ids = rows.column(0).dictionary_encode().indices.to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1))
            # the last chunk may go on in the next batch
            score(rows.slice(0, starts[-1]), starts[:-1])
            rest = rows.slice(starts[-1])
        if rest is not None:
            score(rest, np.array([0]))
        result = best.result("chunk_id", pa.string())
        if result is not None:
            yield result.set_column(0, "query_id", result.column(0).cast(query_type))

    return step, f"query_id {kind}, chunk_id {id_kind.simpleString()}, score double"


def _scored_lists(
    found: DataFrame, named: DataFrame, whole: Column, lists: pa.ListArray, ids: pa.Array, kind: str, k: int
) -> DataFrame:
    """(query_id, chunk_id, score): the best k per query and task. `found` has the asked lists with the `number` and `df` of
    their term, `named` the chunks of the cells; the lists of a cell are brought together and scored in one step."""
    id_kind, query_type = named.schema["chunk_ids"].dataType.elementType, ids.type
    none = lambda name: F.lit(None).cast(named.schema[name].dataType).alias(name)
    names = named.select(
        "cell", F.lit(-1).alias("number"), F.lit(None).cast("bigint").alias("df"), none("at"), none("tf"), "chunk_ids", "dl"
    )
    cells = found.select("cell", "number", "df", "at", "tf", none("chunk_ids"), none("dl")).unionByName(names)
    rows = cells.repartition("cell").sortWithinPartitions("cell", "number").select("*", whole["n"].alias("n"), whole["avgdl"].alias("avgdl"))
    known = ids.to_numpy(zero_copy_only=False)
    most = max(1, vector._CELLS // max(len(known), 1))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = vector._Running(known, None, k)

        def score(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if table.num_rows < 2:
                return
            named, table = table.slice(0, 1), table.slice(1)
            names, sizes = vector._ids(named.column(5).flatten()), named.column(6).flatten().to_numpy()
            at, tf = (table.column(c).flatten().to_numpy() for c in (3, 4))
            row = np.repeat(np.arange(table.num_rows), pc.list_value_length(table.column(3)).to_numpy(zero_copy_only=False))
            order = np.argsort(at, kind="stable")
            at, tf, row = at[order].astype(np.int64), tf[order].astype(np.float64), row[order]
            number, df, n, avgdl = (table.column(c).to_numpy()[row] for c in (1, 2, 7, 8))
            idf = np.log1p((n - df + 0.5) / (df + 0.5))
            norm = config.BM25_K1 * (1 - config.BM25_B + config.BM25_B * sizes[at] / avgdl)
            weight = idf * tf * (config.BM25_K1 + 1) / (tf + norm)
            for low in range(0, len(names), most):
                part = slice(*np.searchsorted(at, (low, low + most)))
                if part.stop > part.start:
                    _offer(best, at[part] - low, names[low:low + most], lists.take(pa.array(number[part])), weight[part])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if high > low:
                    if held and held[0].column(0)[0].as_py() != cells[low]:
                        score(held)
                        held = []
                    held.append(batch.slice(low, high - low))
        if held:
            score(held)
        result = best.result("chunk_id", pa.string())
        if result is not None:
            yield result.set_column(0, "query_id", result.column(0).cast(query_type))

    return rows.mapInArrow(step, f"query_id {kind}, chunk_id {id_kind.simpleString()}, score double")


def _block_bounds(queries: DataFrame, blocks: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """(query_id, *place, ub): the most a chunk of each place can score for a query; (query_id, term, df); the
    corpus size. Entries are not read."""
    times = F.col("times") if _are_lists(blocks) else F.lit(1)
    heads = blocks.select("term", *place, "n", "max_tf", "min_dl", times.alias("times"))
    size = heads.where(F.col("term").isNull()).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("max_tf") / F.sum("n")).alias("avgdl")
    )
    whole = _scalar(size)
    asked = query_terms(queries)
    small = fits_broadcast(asked)
    wanted = asked.select("term").distinct()
    own = heads.join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
    terms = asked.join(own.groupBy("term").agg(F.sum("n").alias("df")), "term").select("query_id", "term", "df")
    hits = lookup_join(own, terms, "term", spread=place[-1], broadcast=small)
    bound = F.col("times") * bm25_weight(F.col("max_tf"), F.col("min_dl"), F.col("df"), whole["n"], whole["avgdl"])
    return hits.groupBy("query_id", *place).agg(F.sum(bound).alias("ub"), F.count(F.lit(1)).alias("blocks")), terms, whole


def _score_places(places: DataFrame, terms: DataFrame, blocks: DataFrame, whole: Column, place: list[str]) -> DataFrame:
    """Scores of all chunks of the (query_id, *place). Spark skips the partitions of other places."""
    # Terms are never empty; Spark prunes partitions only by a side that has such a filter.
    pairs = places.join(terms, "query_id").where(F.col("term") != "").select("query_id", "term", "df", *place)
    found = blocks.where(F.col("term").isNotNull()).join(F.broadcast(pairs) if fits_broadcast(pairs) else pairs, ["term", *place])
    if _are_lists(blocks):
        rows = found.select("query_id", "df", "cell", F.explode(F.arrays_zip("at", "tf")).alias("e")).select("query_id", "df", "cell", "e.*")
        entries = rows.join(_named(blocks), ["cell", "at"])
    else:
        entries = found.select("query_id", "df", F.explode("entries").alias("e")).select("query_id", "df", "e.*")
    weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), whole["n"], whole["avgdl"])
    return entries.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("score"))


def _best_of_places(
    places: DataFrame, terms: DataFrame, blocks: DataFrame, whole: Column, place: list[str], k: int
) -> DataFrame:
    """The best k of each query among the chunks of the places: a place is scored in one step, for all queries.

    Every block of an asked term in such a place is read, so each score is whole. A place holds a
    bounded number of chunks, so only their best leave a task, not each pair of a query and a chunk.
    """
    known, query_type, kind = _asked_ids(terms)
    # Slots of terms are never negative; Spark prunes partitions only by a side that has such a filter.
    slot = "cell" if _are_lists(blocks) else "slot"
    wanted = places.where(F.col(slot) >= 0).select(*place).distinct()
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    found = blocks.where(F.col("term").isNotNull()).join(wanted, place, "left_semi")
    if _are_lists(blocks):
        numbers, lists, ids, kind = _numbered(terms)
        frequency = terms.select("term", "df").distinct().join(F.broadcast(numbers), "term")
        named = _names_of(blocks).join(wanted, place, "left_semi")
        return top_k(_scored_lists(found.join(F.broadcast(frequency), "term"), named, whole, lists, ids, kind, k), k)
    listed = found.join(F.broadcast(_queries_of(terms)), "term")
    rows = listed.select(
        F.xxhash64(*place).alias("cell"), "queries", "df", "entries", whole["n"].alias("size"), whole["avgdl"].alias("avgdl")
    ).repartition("cell").sortWithinPartitions("cell")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = vector._Running(known, None, k), []

        def score() -> None:
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            entries, queries = table.column(3), table.column(1)
            places = np.searchsorted(known, queries.flatten().to_numpy(zero_copy_only=False))
            queries = pa.ListArray.from_arrays(pa.array(np.asarray(queries.offsets) - queries.offsets[0].as_py(), pa.int32()), pa.array(places))
            sizes = np.diff(np.asarray(entries.offsets))
            flat = entries.flatten()
            tf, dl = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("tf", "dl"))
            row = np.repeat(np.arange(table.num_rows), sizes)
            df, n = (table.column(c).to_numpy().astype(np.float64)[row] for c in (2, 4))
            idf = np.log1p((n - df + 0.5) / (df + 0.5))
            norm = config.BM25_K1 * (1 - config.BM25_B + config.BM25_B * dl / table.column(5).to_numpy()[row])
            coded = flat.field("chunk_id").dictionary_encode()
            _offer(
                best, coded.indices.to_numpy(), vector._ids(coded.dictionary), queries.take(pa.array(row)),
                idf * tf * (config.BM25_K1 + 1) / (tf + norm),
            )

        for batch in batches:
            cells = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if high > low:
                    if held and held[0].column(0)[0].as_py() != cells[low]:
                        score()
                        held = []
                    held.append(batch.slice(low, high - low))
        score()
        result = best.result("chunk_id", pa.string())
        if result is not None:
            yield result.set_column(0, "query_id", result.column(0).cast(query_type))

    return top_k(rows.mapInArrow(step, f"query_id {kind}, chunk_id string, score double"), k)


def bm25_topk_blocks(
    queries: DataFrame, blocks: DataFrame, k: int = config.TOP_K_BM25, first: int = config.BLOCK_FIRST_PLACES
) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, score, rank) as `bm25_topk` gives it, and (query_id, blocks, read) of the blocks.

    Only the heads of the blocks are read to bound each place. The `first` places with the highest
    bounds of a query are scored; the worst of its k hits there is a threshold, and of the other
    places only those whose bound reaches it are read.
    """
    place = [c for c in blocks.columns if c not in ("term", "n", "max_tf", "min_dl", "times", "entries", "at", "tf", "leads", "chunk_ids", "dl")]
    bounds, terms, whole = _block_bounds(queries, blocks, place)
    bounds, terms = scratch.materialize(bounds, "bounds"), scratch.materialize(terms, "terms")
    order = Window.partitionBy("query_id").orderBy(F.desc("ub"), *place)
    best = bounds.withColumn("at", F.row_number().over(order)).where(F.col("at") <= first).select("query_id", *place)
    small = fits_broadcast(terms)

    def score(places: DataFrame) -> DataFrame:
        if small:
            return _best_of_places(places, terms, blocks, whole, place, k)
        return top_k(_score_places(places, terms, blocks, whole, place), k)

    begun = score(best)
    worst = begun.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("worst"))
    reach = F.col("worst").isNull() | (F.col("ub") >= F.col("worst") - 2 * 10.0**-config.SCORE_DECIMALS)
    judged = scratch.materialize(bounds.join(worst, "query_id", "left").withColumn("reach", reach), "places")
    open_places = judged.where("reach").select("query_id", *place)
    report = judged.groupBy("query_id").agg(
        F.sum("blocks").alias("blocks"), F.sum(F.when(F.col("reach"), F.col("blocks")).otherwise(0)).alias("read")
    )
    return score(open_places), report
