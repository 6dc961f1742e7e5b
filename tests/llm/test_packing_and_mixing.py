"""op8 and op4: exact round trips, limits, optimal routes."""

import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lodestone.llm import mixing, packing

PATH = packing.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check_pieces(rows, texts, tokenizer):
    """Every id of every row in exactly one piece; sequences without gaps, within the limits."""
    ids = [np.array([*e.ids, 0], "<u4") for e in tokenizer.encode_batch([t or "" for _, t in texts], add_special_tokens=False)]
    want = sorted((repr(d), len(x)) for (d, _), x in zip(texts, ids, strict=True))
    whole = [r for r in rows if r.start == 0]
    assert sorted((repr(r.doc_id), r.doc_tokens) for r in whole) == want
    by_doc = {}
    for (d, _), x in zip(texts, ids, strict=True):
        by_doc.setdefault(d, []).append(x)
    for d, options in by_doc.items():
        own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        if len(options) == 1:
            assert [s for s, _, _ in own] == [0, *itertools.accumulate(n for _, n, _ in own)][:-1]
            assert sum(n for _, n, _ in own) == len(options[0])
            assert all(zlib.crc32(options[0][s:s + n].tobytes()) == c for s, n, c in own)
        else:
            assert sum(n for _, n, _ in own) == sum(map(len, options))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *itertools.accumulate(n for _, n in pieces)][:-1]
        total = sum(n for _, n in pieces)
        assert total <= 1024 and len(pieces) <= packing.MAX_SEGMENTS
        padding += 0 if total & (total - 1) == 0 else 1024 - total
    return padding / max(1, sum(r.length for r in rows))


def test_op8_round_trip(documents, tokenizer):
    rows = packing.pack_documents(documents, PATH).collect()
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    assert check_pieces(rows, texts, tokenizer) < 0.01


def test_op8_odd_rows(odd, empty, tokenizer):
    rows = packing.pack_documents(odd, PATH).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in odd.collect()], tokenizer)
    assert packing.pack_documents(empty, PATH).count() == 0


def test_fast_ids_are_those_of_the_tokenizer(tokenizer):
    encode = packing.encoder(PATH)
    for text in ("", " ", "a  b\n\n c", "x" * 5000, "<|endoftext|> y", "é中文😀 it's", "\u00a0\u2003z", "1234567 !!??", "\t\r\n \x0b"):
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    for text in (" " * 1_200_000, "a" + "\n" * 1_200_000 + "b", " a" * 700_000):
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=60))
def test_examples_keep_all_limits(spark, sizes):
    rows = [(i, n, m) for i, (n, m) in enumerate(sizes)]
    table = spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long")
    found = packing.pack_examples(table, (50, 4, 30)).collect()
    assert sorted(r.example_id for r in found) == list(range(len(rows)))
    groups = {}
    for r in found:
        groups.setdefault(r.sequence_id, []).append(r)
    for group in groups.values():
        if group[0].over:
            assert len(group) == 1 and (sizes[group[0].example_id][0] > 50 or sizes[group[0].example_id][1] > 30)
        else:
            assert sum(sizes[r.example_id][0] for r in group) <= 50 and len(group) <= 4
            assert sum(sizes[r.example_id][1] for r in group) <= 30
        assert sorted(r.slot for r in group) == list(range(len(group)))


def test_dot_product_prefers_what_uses_the_free_dimension():
    pool = packing.Pool((100, 10, 100))
    pool.add(["tokens", "loss"], [(80, 1, 5), (20, 1, 20)])
    assert pool.best(np.array([100.0, 10.0, 10.0])) == 0
    assert pool.best(np.array([25.0, 10.0, 100.0])) == 1


def test_targets_share_the_excess_again():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 300) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 1000, 1000], [5, 2, 1], 2010)
    assert got[0] == 30 and got[1] == pytest.approx(1320) and got[2] == pytest.approx(660)
    assert mixing.targets([0, 5], [5, 2], 5) == [0.0, 5.0] and mixing.targets([], [], 0) == []


def test_route_is_a_cheapest_full_flow():
    patterns = [(frozenset({0}), 4), (frozenset({1}), 3), (frozenset({0, 1}), 3)]
    for quotas in ([7, 5], [12, 2], [2, 9], [5, 5]):
        flows = mixing.route(patterns, quotas, 3)
        got = [sum(f.get(m, 0) for f in flows) for m in (0, 1)]
        assert got == quotas
        cost = lambda total, size: sum((k + 1) ** 2 * max(0, min(size, total - k * size)) for k in range(3))
        best = min(
            cost(quotas[0] - x, 4) + cost(quotas[1] - y, 3) + cost(x + y, 3)
            for x in range(10) for y in range(10)
            if x + y <= 9 and 0 <= quotas[0] - x <= 12 and 0 <= quotas[1] - y <= 9
        )
        assert sum(cost(sum(f.values()), size) for f, (_, size) in zip(flows, patterns, strict=True)) == best


def plain_targets(sizes, weights, total):
    """The definition, one source at a time."""
    fixed = {}
    while True:
        left = total - sum(fixed.values())
        free = [i for i in range(len(sizes)) if i not in fixed]
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        above = [i for i in free if share[i] > 3 * sizes[i] + 1e-9]
        if not above:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        for i in above:
            fixed[i] = 3.0 * sizes[i]


def test_op4_contract(larger):
    docs, _ = larger
    rows = mixing.mix_documents(docs).toPandas()
    again = mixing.mix_documents(docs.repartition(7)).toPandas()
    assert rows.set_index("doc_id").taken.sort_index().equals(again.set_index("doc_id").taken.sort_index())
    table = docs.toPandas()[["doc_id", "source", "text"]].merge(rows, on="doc_id")
    import re

    assert (table["size"] == [len(re.findall("[^\x20\x09-\x0D]+", t)) for t in table.text]).all()
    by = table.groupby("source").agg(size=("size", "sum"), stated=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert (by["size"] == by.stated).all()
    want = plain_targets(by["size"].tolist(), [(5, 2, 1)[i % 3] for i in range(len(by))], by["size"].sum())
    assert by.target.to_numpy() == pytest.approx(np.array(want))
    assert ((by.taken - by.target).abs() <= 0.02 * by.target + 1).all()
    copies = table.taken / table["size"].clip(lower=1)
    assert copies.max() <= 3 and (copies == copies.round()).all()


def test_op4_odd_rows(odd, empty):
    rows = mixing.mix_documents(odd).toPandas()
    assert len(rows) == odd.count() and (rows.taken <= 3 * rows["size"]).all() and rows.target.notna().all()
    assert mixing.mix_documents(empty).count() == 0


def test_overlapping_sources_share_their_documents(spark):
    members = [["a"], ["b"], ["a", "b"], ["b", "c"], [None], None, []]
    rows = [(i, members[i % 7], 1 + (i * 37) % 50) for i in range(2100)]
    out = mixing.mix(spark.createDataFrame(rows, "key long, sources array<string>, size long")).collect()
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert len(r.for_sources) == r.copies <= 3
        assert set(r.for_sources) <= set(r.sources or [None])
        for s in r.for_sources:
            taken[s] = taken.get(s, 0) + r.size
    sizes = {s: sum(n for _, m, n in rows if s in (m or [None])) for s in ("a", "b", "c", None)}
    want = plain_targets([sizes[s] for s in ("a", "b", "c", None)], [5, 2, 1, 5], sum(n for _, _, n in rows))
    for s, t in zip(("a", "b", "c", None), want, strict=True):
        assert abs(taken.get(s, 0) - t) <= 0.01 * t + 50, (s, taken, want)


def test_mixed_rows_repeat_documents(odd, empty):
    mixed = mixing.mixed_rows(odd)
    assert mixed.columns == odd.columns
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts and max(v for k, v in counts.items() if k not in (1, None)) <= 3
    assert counts.get(1, 0) <= 6 and counts.get(None, 0) <= 6
    assert mixing.mixed_rows(empty).count() == 0
