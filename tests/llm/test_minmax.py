"""op13 against all pairs in plain Python."""

import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import minmax, words as W
from lodestone.llm.oracles import ORACLES


def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())


def expected(docs, percent=80):
    rows = [(r["doc_id"], shingles(r["text"])) for r in docs.select("doc_id", "text").collect()]
    holders, label = defaultdict(list), list(range(len(rows)))
    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, (_, own) in enumerate(rows):
        common = defaultdict(int)
        for s in own:
            for j in holders[s]:
                common[j] += 1
            holders[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(rows[j][1]) - n):
                label[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(
        ((doc, len(s), least.get(top(i)), doc == least.get(top(i))) for i, (doc, s) in enumerate(rows)), key=repr
    )


def found(docs, **kw):
    return sorted((tuple(r) for r in minmax.near_duplicates(docs, **kw).collect()), key=repr)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_whole_table(spark, documents, sf_dir):
    rows = found(documents)
    assert rows == expected(documents) and sum(not r[3] for r in rows) > 5
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(duck.execute(ORACLES["op13_min_max_duplicates"]).fetchall(), key=repr) == rows


def test_odd_rows(spark, odd):
    more = odd.select("*", *[F.lit(1).alias(c) for c in ("digest", "node", "bands", "a.b")])
    assert found(more) == expected(odd)
    assert [r for r in found(more) if r[0] in (2, 3, 4)] == [(i, 0, i, True) for i in (2, 3, 4)]


def test_empty(spark, empty):
    rows = minmax.near_duplicates(empty)
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"] and rows.collect() == []


def edit(base, places):
    words = list(base)
    for p in places:
        words[p] = f"new{p}"
    return " ".join(words)


def test_chains_copies_and_look_alikes_in_small_tiles(spark, monkeypatch):
    """Links of a chain whose ends are unlike; copies by the hundred; a passage that many unlike texts share."""
    base = [f"b{i}" for i in range(160)]
    chain = [edit(base, range(5, 5 + 9 * k, 9)) for k in range(6)]
    copies = [" ".join(base[:100]).upper()] * 150 + [" ".join(base[:100]) + " \n"] * 150
    passage = [f"p{i}" for i in range(70)]
    alike = [" ".join(passage + [f"q{k}_{i}" for i in range(12)]) for k in range(90)]
    docs = table(spark, chain + copies + alike + ["short text", "Short  text", "a b c d", "a b c", ""])
    want = expected(docs)
    for rounds in (minmax.ROUNDS, (minmax.BANDS,)):
        monkeypatch.setattr(minmax, "ROUNDS", rounds)
        assert found(docs, tile=16) == want
    assert len({r[2] for r in want}) < len(want) - 290


def test_threshold_is_met_exactly(spark):
    """8 of 10 shingles in common link, 79 of 99 do not."""
    eight = " ".join(f"x{i}" for i in range(12)), " ".join(f"x{i}" for i in [*range(11), 99]), " ".join(f"x{i}" for i in range(11))
    below = " ".join(f"y{i}" for i in range(92)), " ".join([*[f"y{i}" for i in range(82)], *[f"z{i}" for i in range(10)]])
    docs = table(spark, [*eight, *below])
    assert found(docs) == expected(docs)


def test_confirmed_against_all_pairs():
    draw = np.random.default_rng(3)
    for trial in range(60):
        n, two = 12, trial % 2
        pool = draw.integers(0, 1 << 62, 14)
        sets = [np.unique(draw.choice(pool, draw.integers(6, 14), replace=False)) for _ in range(n)]
        label = draw.integers(0, 9, n)
        t = draw.integers(0, 2, n) if two else np.zeros(n, int)
        cell = {
            "node": np.arange(n), "t": t, "x": np.zeros(n, int), "y": np.full(n, two), "label": label,
            "shingles": np.array([*sets, None], object)[:-1],
        }
        a, b = minmax.confirmed(cell, 80)
        def groups(pairs, label=label):
            group = list(label)
            for i, j in pairs:
                group = [group[i] if g == group[j] else g for g in group]
            return {frozenset(k for k in range(n) if group[k] == g) for g in group}
        every = [
            (i, j) for i in range(n) for j in range(i) if (not two or t[i] != t[j])
            and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
        ]
        assert groups(zip(a, b, strict=True)) == groups(every)
        assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} <= {tuple(sorted(p)) for p in every}


@pytest.mark.parametrize("common", [0.5, 0.8, 0.95])
def test_both_extremes_agree_as_often_as_the_sets_are_alike(common):
    draw = np.random.default_rng(5)
    shares = []
    for _ in range(40):
        pool = W.mix(draw.integers(0, 1 << 63, 1000).astype(np.uint64))
        each = int((1 - common) * 500)
        a, b = pool[:1000 - each], np.concatenate([pool[each:]])
        low, high = minmax.extremes(np.concatenate([a, b]), np.array([0, len(a)]))
        shares.append(((low[0] == low[1]).mean(), (high[0] == high[1]).mean()))
    true = (1000 - 2 * int((1 - common) * 500)) / 1000
    assert np.abs(np.mean(shares, axis=0) - true).max() < 0.03


def test_band_keys_take_minima_and_maxima():
    values = W.mix(np.arange(50, dtype=np.uint64))
    low, high = minmax.extremes(values, np.array([0]))
    keys = minmax.band_keys(low, high)
    assert keys.shape == (1, minmax.BANDS) and len(np.unique(keys)) == minmax.BANDS
    other = low.copy()
    other[0, 0] += np.uint64(1)
    assert (minmax.band_keys(other, high) != keys).sum() == 1
    assert pa.array(W.signed(keys[0])).type == pa.int64()
