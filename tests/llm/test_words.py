"""Word arrays against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from lodestone.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\nZ ß中#", max_size=40)), max_size=8)
WORD = re.compile("[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_shingles_are_those_of_each_row(texts):
    found = W.cut(pa.array(texts, pa.string()))
    plain = [WORD.findall(t or "") for t in texts]
    assert [found.text(i) for i in range(len(found.starts))] == [w for ws in plain for w in ws]
    assert found.counts().tolist() == [len(ws) for ws in plain]
    values, doc = W.shingles(found, 3)
    sizes = [max(len(ws) - 2, 1 if ws else 0) for ws in plain]
    assert np.bincount(doc.astype(int), minlength=len(texts)).tolist() == sizes
    sets = [tuple(ws[i:i + 3]) for ws in plain for i in range(max(len(ws) - 2, 1 if ws else 0))]
    by_value = {}
    for value, shingle in zip(values.tolist(), sets, strict=True):
        assert by_value.setdefault(value, shingle) == shingle
    assert len(set(by_value.values())) == len(by_value)


def test_hashes_do_not_depend_on_slices():
    texts = pa.array([("word%d " % (i % 97)) * (1 + i % 50) for i in range(300)])
    batch = pa.record_batch([texts], names=["text"])
    whole = W.cut(texts).hashes()
    parts = [W.cut(p.column(0)).hashes() for p in W.slices(batch, "text", 500)]
    assert np.array_equal(np.concatenate(parts), whole)


def test_a_word_longer_than_a_slice():
    long = "x" * (2 * W.SLICE_BYTES)
    found = W.cut(pa.array([long + " y", "y " + long]))
    a, y, z, b = found.hashes()
    assert a == b and y == z and a != y


def test_table_finds_exactly_its_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64))
    table = W.Table(keys)
    assert np.array_equal(table.find(keys[::-1]), np.arange(len(keys))[::-1])
    assert (table.find(keys + np.uint64(1)) == -1).all()
    assert (W.Table(np.empty(0, np.uint64)).find(keys) == -1).all()
