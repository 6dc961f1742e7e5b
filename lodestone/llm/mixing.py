"""Mixing sources to target weights as a min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern, the
words of each pattern flow to the quotas of its sources, and every further copy of a pattern
costs more (convex), so nothing is repeated before all else is used. The flow is solved on
the driver: its size is that of the set of patterns, not of the data, and is checked. Then
documents are chosen in a seeded order until each pattern's flow is met.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lodestone.llm.tables import WORD, checkpoint

#: A document is taken so often at most.
MAX_COPIES = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Patterns that the flow is solved for; a mix is defined over that many at most.
MAX_PATTERNS = 100_000
#: Rows of a bucket of the seeded order: the unit in which the last documents are chosen.
BUCKET_ROWS = 2048
SEED = 17


def words(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float = MAX_COPIES) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size; the excess is shared
    again by weight among the others until none is above."""
    out, active, left = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0], float(total)
    while active:
        weight = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        active = [i for i in active if i not in set(over)]
    return out


def route(patterns: list[tuple[frozenset[int], int]], quotas: list[int], copies: int = MAX_COPIES) -> list[dict[int, int]]:
    """Words from each pattern (its sources, its size) to each source, at least total cost.

    The k-th copy of a word costs k squared. Successive shortest paths with potentials.
    """
    n, s = len(patterns), len(quotas)
    source, sink = n + s, n + s + 1
    arcs: list[list[int]] = []  # to, free, cost
    out: list[list[int]] = [[] for _ in range(n + s + 2)]

    def arc(a: int, b: int, free: int, cost: int) -> None:
        out[a].append(len(arcs))
        arcs.append([b, free, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    first = {}
    for p, (members, size) in enumerate(patterns):
        for k in range(1, copies + 1):
            arc(source, p, size, k * k)
        for m in sorted(members):
            first[p, m] = len(arcs)
            arc(p, n + m, size * copies, 0)
    for m, quota in enumerate(quotas):
        arc(n + m, sink, quota, 0)
    potential = [0] * len(out)
    while True:
        cost: dict[int, int] = {source: 0}
        came: dict[int, int] = {}
        queue = [(0, source)]
        while queue:
            d, v = heapq.heappop(queue)
            if d > cost[v]:
                continue
            for e in out[v]:
                to, free, c = arcs[e]
                if free > 0 and (new := d + c + potential[v] - potential[to]) < cost.get(to, new + 1):
                    cost[to], came[to] = new, e
                    heapq.heappush(queue, (new, to))
        if sink not in cost:
            break
        furthest = max(cost.values())
        for v in range(len(out)):
            potential[v] += cost.get(v, furthest)
        path, v = [], sink
        while v != source:
            path.append(came[v])
            v = arcs[came[v] ^ 1][0]
        amount = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= amount
            arcs[e ^ 1][1] += amount
    flows: list[dict[int, int]] = [{} for _ in patterns]
    for (p, m), e in first.items():
        if arcs[e ^ 1][1]:
            flows[p][m] = arcs[e ^ 1][1]
    return flows


def mix(rows: DataFrame, copies: int = MAX_COPIES, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """How often each document is taken, and for which of its sources.

    rows: key, sources (array of names, null entries allowed), size (words). Returns them
    with `copies` (the number taken) and `for_sources` (one entry per copy), and `target`
    (of the first source of the document). Null or empty arrays belong to the source null.
    Rows with equal keys are chosen each for itself.
    """
    rows = checkpoint(rows.withColumn(
        "pattern", F.sort_array(F.array_distinct(F.coalesce("sources", F.array(F.lit(None).cast("string")))))
    ).withColumn("pattern", F.when(F.size("pattern") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("pattern"))))
    plan = _plan(rows, copies, weights)
    keyed = rows.withColumn("mark", F.to_json(F.struct("pattern"), {"ignoreNullFields": "false"}))
    placed = keyed.join(F.broadcast(plan), "mark").withColumn("draw", F.xxhash64(F.lit(SEED), "key", "size"))
    placed = placed.withColumn("bucket", F.pmod(F.shiftright("draw", 8), F.col("buckets")))
    inside = Window.partitionBy("mark", "bucket").orderBy("draw", "key", "size")
    placed = placed.withColumn("before", F.sum("size").over(inside) - F.col("size"))
    sums = placed.groupBy("mark", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = sums.withColumn(
        "bucket_start", F.sum("bucket_size").over(Window.partitionBy("mark").orderBy("bucket")) - F.col("bucket_size")
    )
    placed = placed.join(sums, ["mark", "bucket"]).withColumn("at", F.col("bucket_start") + F.col("before"))
    cut = (F.col("cut") >= F.col("bucket_start")) & (F.col("cut") < F.col("bucket_start") + F.col("bucket_size"))
    outside = placed.filter(~cut).withColumn("extra", (F.col("at") < F.col("cut")).cast("int"))
    schema = T.StructType([*placed.schema.fields, T.StructField("extra", T.IntegerType())])
    border = placed.filter(cut).groupBy("mark", "bucket").applyInPandas(_nearest, schema)
    taken = outside.unionByName(border).withColumn("copies", (F.col("full") + F.col("extra")).cast("int"))
    middle = lambda k: (k * F.col("pattern_size") + F.col("at") + F.col("size") / 2)
    owner = lambda k: F.coalesce(
        F.get(F.filter("parts", lambda part: middle(k) < part["until"]), 0)["source"],
        F.try_element_at("parts", F.lit(-1))["source"],
    )
    given = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), owner)).otherwise(
        F.array().cast("array<string>")
    )
    return taken.withColumn("for_sources", given).select("key", "sources", "size", "copies", "for_sources", "target", "source_size")


def _plan(rows: DataFrame, copies: int, weights: tuple[float, ...]) -> DataFrame:
    """One row per pattern: what flows from it and where to. At most MAX_PATTERNS rows."""
    found = (
        rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        .withColumn("mark", F.to_json(F.struct("pattern"), {"ignoreNullFields": "false"}))
        .limit(MAX_PATTERNS + 1).collect()
    )
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; name fewer sources")
    found.sort(key=lambda r: r["mark"])
    names = sorted({name for r in found for name in r["pattern"]}, key=lambda name: (name is None, name or ""))
    place = {name: i for i, name in enumerate(names)}
    members = [frozenset(place[name] for name in r["pattern"]) for r in found]
    sizes = [sum(r["size"] for r, m in zip(found, members, strict=True) if i in m) for i in range(len(names))]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], sum(r["size"] for r in found), copies)
    flows = route([(m, r["size"]) for r, m in zip(found, members, strict=True)], [round(t) for t in wanted], copies)
    plan = []
    for r, flow in zip(found, flows, strict=True):
        total, until, parts = sum(flow.values()), 0, []
        for i, amount in sorted(flow.items()):
            until += amount
            parts.append((names[i], float(until)))
        full = total // r["size"] if r["size"] else 0
        own = place[r["pattern"][0]]
        plan.append((
            r["mark"], r["size"], max(1, r["n"] // BUCKET_ROWS), int(full), int(total - full * r["size"]), parts,
            float(wanted[own]), int(sizes[own]),
        ))
    return rows.sparkSession.createDataFrame(
        plan,
        "mark string, pattern_size long, buckets long, full int, cut long, "
        "parts array<struct<source: string, until: double>>, target double, source_size long",
    )


def _nearest(rows: pd.DataFrame) -> pd.DataFrame:
    """In the bucket where a pattern's last round ends: the documents of the seeded order that
    fit, then the largest others that still fit, so that their sum comes close to what is left."""
    rows = rows.sort_values(["draw", "key", "size"], kind="stable")
    left, chosen = int(rows["cut"].iloc[0] - rows["bucket_start"].iloc[0]), [0] * len(rows)
    sizes = rows["size"].tolist()
    first = 0
    while first < len(sizes) and sizes[first] <= left:
        chosen[first] = int(sizes[first] > 0)  # an empty document adds nothing to a round
        left -= sizes[first]
        first += 1
    for i in sorted(range(first, len(sizes)), key=lambda i: -sizes[i]):
        if 0 < sizes[i] <= left:
            chosen[i] = 1
            left -= sizes[i]
    smallest = min((i for i in range(len(sizes)) if not chosen[i] and sizes[i] < 2 * left), key=lambda i: sizes[i], default=None)
    if smallest is not None:
        chosen[smallest] = 1
    return rows.assign(extra=pd.Series(chosen, rows.index, dtype="int32"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Every document of a mix with one source each: doc_id, size, source_size, target, taken."""
    rows = docs.select(F.col("doc_id").alias("key"), F.array("source").alias("sources"), words().alias("size"))
    return mix(rows).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as it is taken. Equal rows stand for each other."""
    key = F.xxhash64(*[F.col(c) for c in docs.columns], F.col("text"))
    keyed = docs.withColumn("__key", key)
    rows = keyed.select(F.col("__key").alias("key"), F.array("source").alias("sources"), words().alias("size"))
    taken = mix(rows).groupBy("key").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    taken = checkpoint(taken.filter("__copies > 0").withColumnRenamed("key", "__key"))
    if not taken.filter("__rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["__key"])
    return keyed.join(taken, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
