"""URL filters: fixed rules first, then logistic regression on character n-grams.

Everything is DataFrame functions. Host and path are cut out of the url, digits become 0,
and their n-grams of three and four characters are hashed to PLACES by arithmetic on code
points. The model is trained on a small labelled table of urls by gradient descent. With so
few rows the descent runs on one number per row (the weights stay in the span of the rows),
inside one expression; the resulting PLACES weights then judge every url in its own row.

A null url, or one without `://`, has an empty host and path and is judged by the intercept
alone. Rows may repeat; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PLACES = 4096
GRAMS = (3, 4)
STEPS, RATE, DECAY = 120, 0.05, 0.01
#: Rows of a labelled table at most; their similarities are all held in one row.
MAX_LABELLED = 500

#: Rules: verdict, host, path. A rule fits its host and all subdomains.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Names of a small labelled table of invented urls.
BLOCKED_NAMES = (
    "casino-win", "casino-royal", "free-bets", "best-bets", "cheap-pills", "cheap-meds",
    "ads-track", "ad-tracker", "spam-farm", "spam-links", "adult-x", "xxx-adult",
)
ALLOWED_NAMES = (
    "library", "garden", "weather", "museum", "history", "recipes", "thinking", "station", "northern", "reading",
    "theatre", "nation", "thunder", "harbour", "mountain", "others", "therapy", "hearing", "wherever", "string",
    "shelter", "handed", "earth", "street", "answer", "sister", "winter", "notion", "country", "better",
    "bread-and-tea", "town-hall", "the-times", "open-house", "on-air", "math-notes",
)


def _table() -> list[tuple[int, str]]:
    """Every name under other prefixes, domains and paths, dealt out in turn."""
    prefixes, domains, paths = ("", "www.", "m.", "blog."), ("com", "org", "net"), ("en", "de", "fr", "es")
    rows = []
    for label, names, times in ((1, BLOCKED_NAMES, 4), (0, ALLOWED_NAMES, 4)):
        for i, name in enumerate(names):
            for k in range(times):
                rows.append((label, f"https://{prefixes[k]}{name}.example.{domains[(i + k) % 3]}/{paths[(i + 3 * k) % 4]}/{1200 + i}"))
    return rows


#: label 1 block, 0 allow.
LABELLED = _table()


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def places(host: Column, path: Column) -> Column:
    """Distinct places of the n-grams of host and path, with their ends marked."""
    plain = F.regexp_replace(F.concat(F.lit("^"), host, path, F.lit("$")), "[0-9]", "0")

    def grams(s: Column) -> Column:
        # one cut into characters: a substring per place would start from the front each time
        codes = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))
        return F.get(F.transform(F.array(codes), of_codes), F.lit(0))

    def of_codes(c: Column) -> Column:
        def gram(i: Column, size: int) -> Column:
            value = F.lit(size).cast("long")
            for k in range(size):
                value = F.pmod(value * 131 + F.get(c, i + k), F.lit(1_000_003))
            return F.pmod(value, F.lit(PLACES)).cast("int")

        def of_size(n: int) -> Column:
            found = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: gram(i, n))
            return F.when(F.size(c) >= n, found).otherwise(F.array().cast("array<int>"))

        return F.array_distinct(F.concat(*[of_size(n) for n in GRAMS]))

    return F.get(F.transform(F.array(plain), grams), F.lit(0))


def train(labelled: DataFrame) -> list[float]:
    """PLACES weights and the intercept, from rows (label 0/1, url)."""
    rows = labelled.select("label", places(*host_and_path(F.col("url"))).alias("at")).filter("label is not null")
    if rows.count() > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls")
    one = rows.agg(F.array_sort(F.collect_list(F.struct(F.col("label").cast("double").alias("y"), "at"))).alias("rows"))
    norm = lambda at: F.sqrt(F.greatest(F.size(at), F.lit(1)).cast("double"))
    shared = lambda a, b: F.size(F.array_intersect(a, b)) / norm(a) / norm(b) + F.lit(1.0)
    one = one.withColumn(
        "alike", F.transform("rows", lambda a: F.transform("rows", lambda b: shared(a["at"], b["at"])))
    )
    # the table is one row: its similarities are kept, not recomputed in every step
    one = one.withColumn("start", F.transform("rows", lambda r: F.lit(0.0))).repartition(1)
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    def step(a: Column, _: Column) -> Column:
        def update(like: Column, i: Column) -> Column:
            margin = add(F.zip_with(like, a, lambda k, x: k * x))
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
            return F.get(a, i) * F.lit(1 - RATE * DECAY) + F.lit(RATE) * (F.get(F.col("rows"), i)["y"] - p)

        return F.transform(F.col("alike"), update)

    fitted = one.withColumn("a", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.col("start"), step))
    each = fitted.select(F.explode(F.arrays_zip("rows", "a")).alias("r")).select("r.rows.at", "r.a")
    each = each.withColumn("part", F.col("a") / norm(F.col("at")))
    weights = [0.0] * (PLACES + 1)
    for row in each.select(F.explode("at").alias("place"), "part").groupBy("place").agg(F.sum("part").alias("w")).collect():
        weights[row["place"]] = row["w"]  # PLACES rows at most
    weights[PLACES] = each.agg(F.sum("a")).first()[0] or 0.0
    return weights


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED, "label int, url string")


def judge(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every row."""
    weights = F.lit(train(labelled))
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    at = places(F.col("host"), F.col("path"))
    margin = F.get(
        F.transform(
            F.array(at),
            lambda p: F.aggregate(F.transform(p, lambda i: F.get(weights, i)), F.lit(0.0), lambda a, b: a + b)
            / F.sqrt(F.greatest(F.size(p), F.lit(1)).cast("double")),
        ),
        F.lit(0),
    ) + F.get(weights, F.lit(PLACES))
    model = F.when(margin > 0, F.lit("block")).otherwise(F.lit("allow"))
    ruled = cut.withColumn("r", rule_of(F.col("host"), F.col("path")))
    return ruled.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), model).alias("verdict")
    )
