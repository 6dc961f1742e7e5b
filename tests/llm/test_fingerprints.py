"""op1 and op9 against brute force."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from lodestone.llm import components, minhash, simhash

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall(text)
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op1_against_brute_force(spark, documents):
    rows = minhash.fingerprints(documents).toPandas().sort_values("doc_id")
    docs = documents.toPandas().sort_values("doc_id")
    texts = docs.text.tolist()
    following = texts[1:] + texts[:1]
    changed = [a[:len(a) - len(a) // 4] + b[:len(a) // 4] for a, b in zip(texts, following, strict=True)]
    assert rows.doc_id.tolist() == docs.doc_id.tolist() and rows.n_chars.tolist() == [len(t) for t in texts]
    assert rows.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    near = [jaccard(shingles(a, 5), shingles(b, 5)) for a, b in zip(texts, changed, strict=True)]
    after = [jaccard(shingles(a, 5), shingles(b, 5)) for a, b in zip(texts, following, strict=True)]
    assert np.abs(rows.near_edited - near).mean() < 0.04 and np.abs(rows.near_edited - near).max() < 0.2
    assert np.abs(rows.near_next - after).max() < 0.2
    by_text = {}
    for text, value in zip(texts, rows.fingerprint, strict=True):
        assert by_text.setdefault(text, value) == value


def test_op1_next_document_across_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RANGE_ROWS", 7)
    docs = spark.createDataFrame([(i * 3, f"text number {i} " * (1 + i % 5)) for i in range(400)], "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r for r in minhash.fingerprints(docs).collect()}
    texts = [f"text number {i} " * (1 + i % 5) for i in range(400)]
    for i, text in enumerate(texts):
        changed = minhash.edited(text, texts[(i + 1) % 400])
        assert rows[i * 3].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()


def test_op1_odd_rows(odd, empty):
    rows = minhash.fingerprints(odd).collect()
    assert len(rows) == odd.count() and minhash.fingerprints(empty).count() == 0
    assert {len(r.fingerprint) for r in rows} == {4 * minhash.SLOTS}
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].n_chars == 0 and by_id[3].near_edited == 1.0
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    # the last document is followed by the first in order: a null id, and of those the empty text
    assert by_id[10].edited_sha256 == hashlib.sha256(minhash.edited("中文 字 <|endoftext|> é", "").encode()).hexdigest()


def test_near_classes_verify_what_bands_bring_together(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:150] + [f"x{i}_{k}" for k in range(6)])) for i in range(40)]
    rows += [(100 + i, " ".join(f"y{i}_{k}" for k in range(80))) for i in range(20)]
    rows += [(200, rows[0][1]), (201, None), (202, "")]
    found = {r.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t or "", 5) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] != label[b] and jaccard(sets[a], sets[b]) >= 0.8:
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if v == high else v for k, v in label.items()}
                    changed = True
    assert found == label


def reachable(fps, ids, radius=4):
    values = np.array(fps, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return new.tolist()
        label = new


def test_fingerprint_is_the_majority_of_bits():
    import xxhash

    for text in ("One two THREE four five\tsix one two three four", "a b", "É x", "", None, " \n "):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = WORD.findall(words)
        parts = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def test_op9_against_brute_force(documents):
    rows = simhash.near_duplicates(documents).toPandas().sort_values("doc_id")
    fps = [simhash.fingerprint(t) for t in documents.toPandas().sort_values("doc_id").text]
    assert rows.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    assert rows.component_id.tolist() == reachable(fps, rows.doc_id.tolist())


def test_links_across_tiles_and_refined_masks(spark):
    draw = np.random.default_rng(5)
    centres = draw.integers(0, 1 << 64, 6, np.uint64)
    fps = set()
    for centre in centres.tolist():
        for _ in range(120):
            value = centre
            for bit in draw.choice(64, draw.integers(0, 6), replace=False).tolist():
                value ^= 1 << bit
            fps.add(value)
    fps = sorted(fps)
    ids = list(range(len(fps)))
    table = spark.createDataFrame([(i, np.uint64(x).view(np.int64).item()) for i, x in zip(ids, fps, strict=True)], "doc_id long, fp long")
    want = reachable(fps, ids)
    for tile, refined in ((16, False), (4096, False), (50, True)):
        links = simhash.links(table.select("fp"), tile=tile, refined=refined)
        labels = {r.node: r.label for r in components.components(links).collect()}
        groups = {}
        for i, x in zip(ids, fps, strict=True):
            signed = np.uint64(x).view(np.int64).item()
            groups.setdefault(labels.get(signed, signed), []).append(i)
        assert sorted(sorted(g) for g in groups.values()) == sorted(
            [i for i in ids if want[i] == low] for low in set(want)
        )


def test_masks_keep_every_pair_within_the_radius():
    draw = np.random.default_rng(2)
    for refined in (False, True):
        masks = simhash.masks(4, refined)
        for _ in range(2000):
            changed = sum(1 << int(b) for b in draw.choice(64, 4, replace=False))
            assert any(not changed & (m & (1 << 64) - 1) for m in masks)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    links = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.label for r in components.components(links).collect()}
    label = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in range(40):
        for a, b in pairs:
            if a != b:
                low = min(label[a], label[b])
                for n in [n for n, v in label.items() if v in (label[a], label[b])]:
                    label[n] = low
    assert found == label


def test_keep_one_keeps_one_row_of_each_group(odd, empty, documents):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(empty).count() == 0
    ids = sorted(r.doc_id for r in kept.collect())
    # 2, 3, 4 and one of the null ids have no word: one group; the other null id has the text of 8
    assert ids == [1, 2, 5, 6, 8, 9, 10]
    twice = documents.union(documents)
    assert simhash.keep_one(twice).count() == simhash.keep_one(documents).count()


def test_near_classes_of_a_bucket_of_many_unlike_texts_and_of_chains(spark, monkeypatch):
    """One bucket of more texts than 200 that are not alike, and a chain of links over a member that follows another."""
    def all_in_one(texts):
        return texts.selectExpr("id", "array(1L) bands")

    monkeypatch.setattr(minhash, "_bands", all_in_one)
    words = [f"c{i}" for i in range(100)]
    # A to B differ in the last words, L to A in the first: both at 0.8 or more, L to B below
    chains = [[], [], []]
    for n in range(12):
        base = [f"{n}_{w}" for w in words]
        chains[0].append(" ".join([f"l{n}_{k}" for k in range(7)] + base[7:]))
        chains[1].append(" ".join(base))
        chains[2].append(" ".join(base[:-7] + [f"b{n}_{k}" for k in range(7)]))
    rows = [(3 * n + k, chains[k][n]) for n in range(12) for k in range(3)]
    rows += [(1000 + i, " ".join(words[:40] + [f"z{i}_{k}" for k in range(30)])) for i in range(230)]
    sets = {i: shingles(t, 5) for i, t in rows}
    assert jaccard(sets[0], sets[1]) >= 0.8 and jaccard(sets[1], sets[2]) >= 0.8 and jaccard(sets[0], sets[2]) < 0.8
    want = {i: i - i % 3 if i < 1000 else i for i in sets}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (50, 1024):
        assert {r.doc_id: r.class_id for r in minhash.near_classes(docs, tile=tile).collect()} == want


def test_keep_one_drops_a_near_copy_whose_id_is_kept_for_another_text(spark):
    first = " ".join(f"a{i}" for i in range(300))
    other = " ".join(f"b{i}" for i in range(300))
    third = " ".join(f"c{i}" for i in range(300))
    rows = [(3, first), (5, other), (5, first), (None, third), (None, first), (7, other)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("3", "a"), ("5", "b"), ("None", "c")]
