"""Learnt operators: held-out accuracy, contracts, odd rows."""

import inspect
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import brown, langid, quality, toxicity

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def held(doc, divisor, value):
    return doc is not None and zlib.crc32(str(doc).encode()) % divisor == value


def test_op3_held_out(larger):
    docs, labels = larger
    rows = toxicity.judge(docs, labels).toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [held(d, 5, 0) for d in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()
    both = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    bad, good = both[both.toxic == 1].score.to_numpy(), both[both.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None, :]).mean() > 0.85 and (good >= 0.5).mean() < 0.05


def test_ftrl_finds_the_telling_places_and_drops_the_rest():
    draw = np.random.default_rng(0)
    labels = (draw.random(1500) < 0.3).astype(float)
    examples = [
        np.unique(np.append(draw.integers(100, 50_000, 60), [7] if y and draw.random() < 0.9 else [8] if draw.random() < 0.3 else []).astype(int))
        for y in labels
    ]
    places, weights = toxicity.train(examples, labels)
    weight = dict(zip(places.tolist(), weights.tolist(), strict=True))
    assert weight[7] > 1 and weight[7] == max(weight.values())
    assert len(places) < 0.05 * len(np.unique(np.concatenate(examples))) and toxicity.INTERCEPT in weight


def test_skip_grams_reach_over_one_word():
    a, _ = toxicity.features(pa.array(["you xxx fool"]))
    b, _ = toxicity.features(pa.array(["you yyy fool"]))
    assert len(set(a) & set(b)) == 3 and len(a) == 3 + 2 + 1


def test_op7_held_out(larger):
    docs, labels = larger
    rows = quality.judge(docs, labels).toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [held(d, 4, 2) for d in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.7)).all()
    both = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95
    assert both[both.quality == 1].predicted.mean() > 0.97


def test_positive_unlabelled_risk_recovers_the_prior():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(0, 1, (6000, 5)), draw.normal(3, 1, (1500, 5))
    model = quality.train(good[:2000].astype(np.float32), np.concatenate([good[2000:], bad]).astype(np.float32))
    assert abs(model.prior - 4000 / 5500) < 0.06
    assert model.score(draw.normal(0, 1, (1000, 5))).mean() > 0.9 and model.score(draw.normal(3, 1, (1000, 5))).mean() < 0.1


def test_quality_features_count_repeats():
    clean = " ".join(f"word{i}" for i in range(40))
    x = quality.describe(pa.array([clean, "same " * 40, "line a\nline a\nline a\n", None, ""]))
    assert x[0, -5] == 0 and x[0, -4] == 0 and x[0, -3] == 0
    assert x[1, -5] > 0.9 and x[1, -4] > 0.9 and x[2, -3] == pytest.approx(2 / 3)
    assert (x[3:] == 0).all()


def test_op6_held_out(larger):
    docs, _ = larger
    rows = langid.identify(docs).toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [held(d, 4, 2) for d in rows.doc_id]).all()
    both = rows[rows.held_out].merge(docs.toPandas()[["doc_id", "lang"]], on="doc_id")
    assert (both.lang_pred == both.lang).mean() > 0.99


def test_unseen_words_back_off_to_grams(spark):
    rows = [(4 * i, t, lang) for i in range(40) for t, lang in (("nation station notion", "en"), ("zeitung achtung haltung", "de"))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = ["motion", "meinung", "station meinung achtung", "123 !!", "", None, "中文", "ZEITUNG", "é1"]
    names, score = langid._decide(model, model.tables(), pa.array(tests))
    assert names[:3] == ["en", "de", "de"] and names[3:6] == ["und"] * 3 and names[7] == "de"
    assert names[6] in ("de", "en") and names[8] != "und" and score[3] == 0


def test_op5_base_and_probabilities(documents):
    rows = brown.evaluate(documents).toPandas().set_index("doc_id")
    texts = {r.doc_id: r.text for r in documents.collect()}
    tokens = {d: WORD.findall(t.translate(LOWER)) + [None] for d, t in texts.items()}
    counts = Counter(w for d, ws in tokens.items() if not held(d, 7, 2) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        row = rows.loc[d]
        assert row.held_out == held(d, 7, 2) and row.n_tokens == len(ws) and row.train_tokens == total
        assert row.n_known == sum(counts[w] > 0 for w in ws)
        want = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)
        assert row.base_score == pytest.approx(want, rel=1e-9)
    out = rows[rows.held_out]
    assert out.score.sum() > out.base_score.sum()


@pytest.mark.parametrize("head", [3, 40])
def test_class_model_against_brute_force(spark, monkeypatch, head):
    """Every symbol's probability after every symbol, and texts scored with a cut-off head."""
    monkeypatch.setattr(brown, "HEAD_WORDS", head)
    monkeypatch.setattr(brown, "CLASS_WORDS", 2)
    monkeypatch.setattr(brown, "CLASSES", 2)
    texts = ["a b a c", "a b d e", "b a b", "c c f", "a"]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(100, "z a q b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in brown.evaluate(docs).collect()}
    training = docs.filter(brown.remainder("doc_id", 7) != 2)
    counts = brown.count_words(training)
    m = brown.fit(training, counts)
    n = Counter(w for r in training.collect() for w in r.text.split())
    key = {w: brown.W.cut(pa.array([w])).hashes()[0] for w in "abcdefzq"}
    place = {int(k): i for i, k in enumerate(m.words)}

    def symbol(w):
        i = place.get(int(key[w]))
        c = m.classes[i] if i is not None else brown.CLASSES
        if c < brown.CLASSES:
            return c, m.counts[i] / m.class_counts[c]
        return c, (n[w] + 1) / (m.rest_tokens + m.rest_types + 1)

    classes = 10 ** m.transitions
    assert classes.sum(axis=1) == pytest.approx(1.0)
    for d, t in rows:
        steps = [symbol(w) for w in t.split()] + [(brown.CLASSES + 1, 1.0)]
        before, value = brown.CLASSES + 1, 0.0
        for c, e in steps:
            value += m.transitions[before, c] + math.log10(e)
            before = c
        assert out[d].score == pytest.approx(value, rel=1e-9), (d, t)


def test_exchange_never_lowers_the_likelihood_and_finds_blocks():
    draw = np.random.default_rng(3)
    n = np.zeros((22, 22))
    for i in range(20):
        for j in range(20):
            n[i, j] = draw.poisson(30 if (i % 2) != (j % 2) else 1)
    n[20, 20] = 5
    of = brown.exchange(n, 2, 10, 20)
    assert len(set(of[:20:2])) == 1 and len(set(of[1:20:2])) == 1 and of[0] != of[1]

    def likelihood(classes):
        pairs = np.zeros((4, 4))
        np.add.at(pairs, (classes[:, None], classes[None, :]), n)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(pairs) - f(pairs.sum(axis=0)) - f(pairs.sum(axis=1))

    start = np.concatenate([np.arange(20) % 2, [2, 3]])
    shuffled = np.concatenate([draw.permutation(start[:20]), [2, 3]])
    assert likelihood(of) >= max(likelihood(start), likelihood(shuffled)) - 1e-6


@pytest.mark.parametrize("op", ["toxicity", "quality", "language", "model"])
def test_odd_rows(op, odd, empty, odd_labels, no_labels):
    run = {
        "toxicity": lambda d, lab: toxicity.judge(d, lab), "quality": lambda d, lab: quality.judge(d, lab),
        "language": lambda d, lab: langid.identify(d), "model": lambda d, lab: brown.evaluate(d),
    }[op]
    for labels in (odd_labels, no_labels):
        rows = run(odd, labels).toPandas()
        assert len(rows) == odd.count() and rows.score.notna().all()
        same = rows[rows.doc_id == 1].score
        assert len(same) == 2 and same.nunique() == 1
    assert run(empty, no_labels).count() == 0


@pytest.mark.parametrize("head", [40, 100_000])
def test_every_frequent_word_has_a_class(spark, monkeypatch, head):
    """More words than are exchanged one by one, in the head and outside: two kinds in turn tell their classes."""
    monkeypatch.setattr(brown, "HEAD_WORDS", head)
    monkeypatch.setattr(brown, "CLASS_WORDS", 20)
    monkeypatch.setattr(brown, "CLASSES", 2)
    draw = np.random.default_rng(4)
    chance = np.concatenate([np.full(20, 0.03), np.full(180, 0.4 / 180)])

    def text():
        kinds = draw.choice(200, (2, 30), p=chance / chance.sum())
        return " ".join(f"x{a} y{b}" for a, b in kinds.T.tolist())

    docs = spark.createDataFrame([(i, text()) for i in range(300)] + [(1000, "once never")], "doc_id long, text string")
    counts = brown.count_words(docs)
    known = brown.cluster(docs, counts)
    of = dict(zip(known.words.tolist(), known.classes.tolist(), strict=True))
    if known.tail is not None:
        of |= {brown.W.unsigned([r.word])[0].item(): r["class"] for r in known.tail.collect()}
    assert (known.tail is not None) == (head == 40)
    n = Counter(w for r in docs.collect() for w in r.text.split())
    kinds = {"x": [], "y": []}
    for w, times in n.items():
        c = of.get(brown.W.cut(pa.array([w])).hashes()[0].item(), brown.CLASSES)
        assert (c < brown.CLASSES) == (times >= brown.MIN_COUNT)
        if c < brown.CLASSES:
            kinds[w[0]].append(c)
    shares = [np.mean(kinds[k]) for k in "xy"]
    assert len(n) > 300 and sorted(np.round(shares, 1).tolist()) == [0.0, 1.0]
    assert known.rest_types == sum(t < brown.MIN_COUNT for t in n.values())
    # scores follow from the classes, those outside the head included
    m = brown.fit(docs, counts)
    rows = brown._learn(brown.tag(docs.selectExpr("doc_id", "false held_out", "true training", "text"), counts, known), known)
    assert np.allclose(rows.transitions, m.transitions) and m.class_counts[brown.CLASSES] == known.rest_tokens
    tagged = brown.tag(docs.selectExpr("doc_id", "false held_out", "true training", "text"), counts, known)
    found = {r.doc_id: r.score for r in brown.score(tagged, rows).collect()}
    for r in docs.limit(5).collect():
        before, value = brown.CLASSES + 1, 0.0
        for w in r.text.split():
            c = of.get(brown.W.cut(pa.array([w])).hashes()[0].item(), brown.CLASSES)
            value += rows.transitions[before, c] + math.log10((n[w] + (c == brown.CLASSES)) / 10 ** rows.norms()[c])
            before = c
        assert found[r.doc_id] == pytest.approx(value + rows.transitions[before, brown.CLASSES + 1], rel=1e-9)


def test_rare_languages_are_learnt_from_large_tables(spark):
    rows = [(i, "nation station notion", "en") for i in range(3000)] + [(5000 + i, "слово язык", "ru") for i in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bound=50)
    assert model.languages == ["en", "ru"]
    names, score = langid._decide(model, model.tables(), pa.array(["язык слово", "station"]))
    assert names == ["ru", "en"] and (score > 0.5).all()


def test_quality_trains_all_of_its_steps():
    assert inspect.signature(quality.train).parameters["steps"].default == quality.STEPS >= 500


def test_a_rare_language_does_not_win_by_having_seen_little(spark):
    draw = np.random.default_rng(8)
    vocabulary = np.array([f"{a}{b}{c}ing" for a in "bcdfghjklmnpqrstvw" for b in ("a", "ee", "io", "u") for c in map("".join, zip("bcdfgklmnprstvxz" * 18, "aeiou" * 60, strict=False))])
    rows = [(4 * i, " ".join(draw.choice(vocabulary, 5)), "en") for i in range(4000)]
    rows += [(4 * (5000 + i), t, "ru") for i, t in enumerate(("слово язык ting", "мир дом", "слово дом big"))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    trained = [w for r in rows[:4000] for w in r[1].split()]
    texts = [" ".join(draw.choice(trained, 20)) for _ in range(300)] + ["слово язык мир"]
    names, score = langid._decide(model, model.tables(), pa.array(texts))
    assert names == ["en"] * 300 + ["ru"] and (score > 0.99).all()


def test_op6_scores_against_plain_counts(documents):
    """All rows, words and n-grams are kept on this table, so every score can be counted by hand."""
    learnt = documents.filter("doc_id % 3 > 0")
    model = langid.fit(learnt)

    def runs(text):
        upper = {chr(c): chr(c + 32) for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}
        kept = "".join(upper.get(c, c) if ord(c) >= 128 or c.isalpha() else " " for c in text)
        return kept.split(" ")

    counts = {n: {} for n in range(6)}
    for r in learnt.collect():
        for w in filter(None, runs(r.text)):
            for n in range(6):
                for g in ([w[i:i + n] for i in range(len(w) - n + 1)] if n else [w]):
                    counts[n].setdefault(r.lang, Counter())[g] += 1
    langs = sorted(counts[0])
    mass = {n: {k: c.total() + len(c) for k, c in counts[n].items()} for n in counts}
    known = {n: set().union(*counts[n].values()) for n in counts}
    assert len(model.words[0]) == len(known[0]) and len(model.grams[5][0]) == len(known[5])

    def log(n, g, lang):
        c = counts[n][lang][g]
        return math.log(c / mass[n][lang] if c else 0.5 / max(mass[n].values()))

    texts = [r.text for r in documents.filter("doc_id % 3 = 0 and n_chars < 3000").limit(30).collect()]
    found, _ = langid.scores(model, model.tables(), pa.array(texts))
    for row, text in zip(found, texts, strict=True):
        want = np.zeros(len(langs))
        for w in filter(None, runs(text)):
            for n in (0, 5, 4, 3, 2, 1):
                grams = [g for g in ([w[i:i + n] for i in range(len(w) - n + 1)] if n else [w]) if g in known[n]]
                if grams:
                    want += [sum(log(n, g, k) for g in grams) / len(grams) for k in langs]
                    break
        assert row == pytest.approx(want, rel=1e-5)


def test_op5_rounds_never_lower_the_likelihood(larger):
    docs, _ = larger
    docs = docs.limit(300)
    counts = brown.count_words(docs)
    reached = []
    for rounds in (0, 1, 2, 4):
        known = brown.cluster(docs, counts, rounds)
        reached.append(known.likelihood)
        assert known.likelihood == pytest.approx(brown.likelihood(brown._class_pairs(docs, known.words, known.classes)))
        shares = np.bincount(known.classes, known.counts, brown.CLASSES + 1)[:brown.CLASSES]
        assert shares.max() < 0.4 * shares.sum()
    assert reached == sorted(reached) and reached[1] > reached[0]


def test_op5_round_picks_the_class_that_exchange_would_pick():
    """Of one word that moves alone: the class with the highest likelihood of all."""
    draw = np.random.default_rng(4)
    symbols, width = 30, brown.CLASSES + 2
    bigrams = draw.poisson(2.0, (symbols, symbols)).astype(float)
    of = np.append(draw.integers(0, 6, symbols - 1), brown.CLASSES + 1)

    def pairs(classes):
        out = np.zeros((width, width))
        np.add.at(out, (classes[:, None], classes[None, :]), bigrams)
        return out

    right, left = np.zeros((symbols, width)), np.zeros((symbols, width))
    for w in range(symbols):
        others = np.arange(symbols) != w
        np.add.at(right[w], of[others], bigrams[w, others])
        np.add.at(left[w], of[others], bigrams[others, w])
    found = brown.best_classes(pairs(of), of[:-1], right[:-1], left[:-1], np.diagonal(bigrams)[:-1])
    for w in range(symbols - 1):
        reach = [brown.likelihood(pairs(np.where(np.arange(symbols) == w, c, of))) for c in range(brown.CLASSES)]
        assert reach[found[w]] == pytest.approx(max(reach))


def test_op5_packed_counts_come_back():
    draw = np.random.default_rng(6)
    word = np.sort(draw.integers(0, 40, 300)).astype(np.uint64)
    code, n = draw.integers(0, 2500, 300), draw.integers(1, 1 << 34, 300)
    rows = pa.Table.from_batches([brown._packed(0, word, code, n)])
    row, codes, counts = brown._unpacked(rows)
    back = Counter()
    for w, c, k in zip(rows.column("word").to_numpy()[row].tolist(), codes.tolist(), counts.tolist(), strict=True):
        back[w, c] += k
    want = Counter()
    for w, c, k in zip(word.tolist(), code.tolist(), n.tolist(), strict=True):
        want[w, c] += k
    assert back == want and rows.num_rows == len(set(word.tolist()))
    assert [len(x) for x in brown._unpacked(rows.slice(0, 0))] == [0, 0, 0]
