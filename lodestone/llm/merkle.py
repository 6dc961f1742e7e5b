"""Merkle manifest of a dataset: leaves, subroots, root, and a proof for every row.

A row is a leaf, the hash of its fields. Leaves of a source ascend by doc_id; of every run of
16 nodes the hash of their digests is the parent, until one node is left, the subroot of the
source. The subroots, ordered by source, form a tree of the same kind, whose top is the root.

Each level is one window over runs: `lag` and `lead` columns of the offsets 1 to 15, masked by
the slot of a node and the length of its run, hold its siblings, and the first child of a run
hashes the parent. Windows never hold more than one run, so a source with a third of all rows
is spread over all tasks. Positions come from a range partitioning by (source, doc_id, leaf,
row number) and prefix sums over the counts of its partitions. Proofs go down again level by
level: a node takes the siblings of its parent's path and puts its own before them.

Null fields hash as `-`. A null source is a source of its own and comes first, null ids come
before others. Rows with equal ids follow their leaves, so repeated rows have places of their
own and equal results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.tables import checkpoint, partitions, remainder
from lodestone.plans.sizing import lookup_join

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes below one parent.
FANOUT = 16
TAMPER_DIVISOR = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IN_PARTITION = (1 << 33) - 1


def digest(values: Sequence[Column]) -> Column:
    """Hash of typed fields: `-` for null, else the count of UTF-8 bytes, a colon, the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def leaf(fields: Sequence[str] = FIELDS, **changed: Column) -> Column:
    """The leaf of a row; `changed` gives other values to some fields."""
    return digest([changed.get(name, _quoted(name)) for name in fields])


def tampered_leaf() -> Column:
    """The leaf of the row a tamperer leaves behind: null where nothing is touched."""
    touched = remainder("doc_id", TAMPER_DIVISOR) == 0
    return F.when(touched, leaf(text=F.translate("text", UPPER, UPPER.lower())))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """`rows` with `place`, their position in the order, from 0.

    Ranges of the order are sorted each for itself. What goes to one task is one count per
    partition.
    """
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = checkpoint(spread.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit(_IN_PARTITION))
    return joined.withColumn("place", place).drop("_at", "_part", "_start")


def families(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, pos, n, digest, ...) with run, slot, and the digests `left` and `right` of them in their run."""
    run = Window.partitionBy("tree", "run").orderBy("pos")
    nodes = nodes.withColumn("run", F.expr(f"pos div {FANOUT}")).withColumn("slot", F.col("pos") % FANOUT)
    length = F.least(F.lit(FANOUT), F.col("n") - F.col("run") * FANOUT)
    offsets = range(1, FANOUT)
    left = [F.when(F.col("slot") >= k, F.lag("digest", k).over(run)).otherwise("") for k in reversed(offsets)]
    right = [F.when(F.col("slot") + k < length, F.lead("digest", k).over(run)).otherwise("") for k in offsets]
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def climb(nodes: DataFrame) -> list[DataFrame]:
    """All levels of the trees of `nodes` (tree, pos, n, digest), the given one first.

    n is the number of nodes of the tree on the level; trees that have come to one node stop.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = [nodes]
    while most > 1:
        parents = families(levels[-1].select("tree", "pos", "n", "digest").filter("n > 1")).filter("slot = 0").select(
            "tree", F.col("run").alias("pos"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
            F.sha2(F.concat("digest", "right"), 256).alias("digest"),
        )
        levels.append(checkpoint(parents))
        most = -(-most // FANOUT)
    return levels


def tops(levels: Sequence[DataFrame]) -> DataFrame:
    """(tree, digest) of the last node of every tree."""
    parts = [level.filter("n = 1").select("tree", "digest") for level in levels]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def descend(levels: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """The first level with `path`: the siblings (left, right) of the node, its parent and so on.

    `above` (tree, path, ...) says how the top of a tree goes on; its other columns come along.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")]
    below: DataFrame | None = None
    for level in reversed(levels):
        done = level.filter("n = 1").join(above, "tree")
        if below is not None:
            parents = below.select("tree", F.col("pos").alias("run"), F.col("path").alias("_rest"), *carried)
            own = F.array(F.struct("left", "right"))
            inner = families(level.filter("n > 1")).join(parents, ["tree", "run"]).withColumn("path", F.concat(own, "_rest"))
            done = done.unionByName(inner.select(*done.columns))
        below = done
    return below


def manifest(docs: DataFrame, claim: Column | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """doc_id, leaf, subroot, root, path and claimed leaf of every row of `docs`.

    `claim` is the leaf that a holder of the row would show; null or absent: the leaf itself.
    path: siblings (left, right) from the leaf to the root, each side concatenated.
    """
    claim = F.lit(None).cast("string") if claim is None else claim
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    leaves = checkpoint(docs.select(
        source.alias("source"), "doc_id", leaf(fields).alias("digest"), claim.alias("claim"),
        F.monotonically_increasing_id().alias("row"),
    ))
    placed = numbered(leaves, ["source", "doc_id", "digest", "row"])
    sources = placed.groupBy("source").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n"))
    sources = checkpoint(numbered(sources, ["source"]).withColumnRenamed("place", "tree"))
    nodes = checkpoint(lookup_join(placed, sources, "source", "row").select(
        "tree", (F.col("place") - F.col("low")).alias("pos"), "n", "digest", "doc_id", "claim",
    ))
    levels = climb(nodes)
    subroots = tops(levels).join(sources.select("tree"), "tree")
    several = sources.count()
    forest = climb(checkpoint(subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(several).cast("long").alias("n"), "digest",
    )))
    top = tops(forest).first()
    root = F.lit(top["digest"] if top else None).cast("string")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    end = docs.sparkSession.range(1).select(F.col("id").alias("tree"), nothing.alias("path"))
    above = descend(forest, end).select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"), "path")
    return descend(levels, above).select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path", "claim")


def proof(path: str = "path") -> Column:
    """Hash of all siblings from the leaf to the root."""
    sides = F.transform(path, lambda step: F.concat(step["left"], step["right"]))
    return F.sha2(F.array_join(sides, ""), 256)


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of `docs` held against a copy in which every fifth id is tampered with."""
    rows = manifest(docs, tampered_leaf()).withColumn("folded_root", folded(F.coalesce("claim", "leaf")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
