"""op11 against counts of every n-gram in plain Python."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import phrases
from lodestone.llm.oracles import ORACLES


def expected(docs, size=phrases.MAX_WORDS, least=phrases.MIN_COUNT, top=phrases.TOP):
    counts, totals = Counter(), Counter()
    for row in docs.collect():
        lang = "und" if row["lang"] is None else row["lang"]
        text = re.sub("[A-Z]", lambda m: m[0].lower(), row["text"] or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, size + 1):
                counts.update((lang, *words[i:i + n]) for i in range(len(words) - n + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    dropped = set()
    for (lang, *words), a in candidates.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                if 100 * a >= 50 * counts[(lang, *words[i:i + n])]:
                    dropped.add((lang, *words[i:i + n]))
    rows = []
    for (lang, *words), a in candidates.items():
        cuts = [(counts[(lang, *words[:k])], counts[(lang, *words[k:])]) for k in range(1, len(words))]
        score, _, left, right = min((1_000_000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        if (lang, *words) not in dropped:
            rows.append((lang, -score, -a, " ".join(words).encode(), left, right))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def found(docs, *args):
    return sorted(tuple(r) for r in phrases.collocations(docs, *args).collect())


def test_whole_table(spark, documents, sf_dir):
    rows = found(documents)
    assert rows == expected(documents) and len(rows) > 100
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(duck.execute(ORACLES["op11_phrases"]).fetchall()) == rows


@pytest.mark.parametrize("size, least, top", [(2, 3, 5), (4, 4, 2000), (3, 1, 2000)])
def test_other_sizes(spark, documents, size, least, top):
    docs = documents.limit(40)
    assert found(docs, size, least, top) == expected(docs, size, least, top)


def test_odd_rows_ties_and_repeats(spark, odd):
    many = odd.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(11)))).drop("n").withColumn("w0", F.lit("x"))
    more = spark.createDataFrame(
        [(100 + i, "New York. New York!\nNEW,YORK;new\tyork a\x0bb É é", None if i % 2 else "en") for i in range(12)],
        "doc_id long, text string, lang string",
    )
    rows = many.select("doc_id", "text", "lang").union(more)
    assert found(rows) == expected(rows)
    assert {r[0] for r in found(rows)} >= {"en", "de"}


def test_very_long_texts(spark):
    texts = ["ab cd ef gh ij " * 30_000, "x" * 600_000, "line one two\n" * 30_000, " " * 500_000, "!?;" * 200_000, "a " * 100_000]
    docs = spark.createDataFrame([(i, t, "en" if i else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert found(docs) == expected(docs)


def test_empty(spark, empty):
    rows = phrases.collocations(empty)
    assert rows.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and rows.collect() == []


def test_full_and_small_maps_of_frequent_runs_change_nothing(spark, documents):
    docs = documents.limit(60)
    every = [np.full((1 << phrases.MAP_BITS) >> 3, 255, np.uint8)] * 2

    def rolled(rows):
        counts = rows.groupBy("lang", "w0", "w1", "w2").agg(F.sum("n").alias("n"))
        return {tuple(r) for r in counts.filter("w2 <> '' and n >= 10").collect()}

    whole = rolled(phrases.windows(docs, 3, every))
    assert whole and rolled(phrases.windows(docs, 3, phrases.frequent_runs(docs, 3, 10, 19), 19)) == whole
    assert rolled(phrases.windows(docs, 3, phrases.frequent_runs(docs, 3))) == whole


def test_counts_are_added_up_over_slices_and_tasks(spark, documents, monkeypatch):
    docs = documents.limit(40)
    whole = phrases.frequent_runs(docs, 3, 5)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 3000)
    monkeypatch.setattr(phrases, "HELD_HASHES", 500)
    for some, every in zip(phrases.frequent_runs(docs.repartition(3), 3, 5), whole, strict=True):
        assert np.unpackbits(every).sum() > 10 and (some == every).all()
    large = spark.createDataFrame([("en", "x y " * 300)] * 2, "lang string, text string")
    assert np.unpackbits(phrases.frequent_runs(large, 2, 600)[0]).sum() == 1


def test_score_is_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", 1, "x", 4_000_000_000_001), ("en", 1, "y", 4_000_000_000_003), ("en", 2, "x y", 3_999_999_999_999)],
        "lang string, words int, phrase string, a long",
    )
    row = phrases.scored(counts).first()
    assert row["score"] == 1_000_000 * 3_999_999_999_999 ** 2 // (4_000_000_000_001 * 4_000_000_000_003)


def test_wide_keys_are_folded():
    draw = np.random.default_rng(1)
    columns = [draw.integers(0, 3, 500) for _ in range(4)]
    first, n = phrases._distinct(columns, [1 << 40] * 4)
    rows = Counter(zip(*[c.tolist() for c in columns], strict=True))
    assert {tuple(int(c[i]) for c in columns): int(k) for i, k in zip(first, n, strict=True)} == rows
