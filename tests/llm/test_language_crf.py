import itertools
import random

import numpy as np
import pytest

from glyphmill.llm import language_crf as c

WORDS = {"en": "the of and with from that this house river green walk over under bright morning".split(), "de": "der die und nicht über grün haus fluß gehen unter hell morgen straße schön".split(), "fr": "le la les des une maison rivière vert marcher sous clair matin était à où".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    m = c.Model(sorted(WORDS))
    m.fit([(k, text(rng, lang, 20).split()) for k, lang in enumerate(sorted(WORDS)) for _ in range(60)], sequences=400, epochs=4)
    return m


def test_posteriors_equal_brute_force():
    rng = np.random.default_rng(2)
    m = c.Model(["a", "b", "c"])
    m.move, m.start = rng.standard_normal((3, 3)).astype(np.float32), rng.standard_normal(3).astype(np.float32)
    lengths = np.array([4, 1, 6, 6, 2])
    e = rng.standard_normal((lengths.sum(), 3)).astype(np.float32)
    p, counts = m.posteriors(e, lengths, pairs=True)
    at, want, moves = 0, [], np.zeros((3, 3))
    for n in lengths:
        marginal, total = np.zeros((n, 3)), 0.0
        seen = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(m.start[path[0]] + sum(e[at + k, s] for k, s in enumerate(path)) + sum(m.move[a, b] for a, b in zip(path, path[1:])))
            total += w
            for k, s in enumerate(path):
                marginal[k, s] += w
            for a, b in zip(path, path[1:]):
                seen[a, b] += w
        want.append(marginal / total)
        moves += seen / total
        at += n
    assert np.allclose(p, np.concatenate(want), atol=1e-4) and np.allclose(counts, moves, atol=1e-3)


def test_words_and_code_switching(model):
    rng = random.Random(4)
    mixed = text(rng, "de", 12) + " " + text(rng, "en", 12)
    labels = [lang for _, lang in c.tag(model, mixed)]
    assert labels[:11].count("de") >= 9 and labels[13:].count("en") >= 9
    assert c.words_of("Ab, c3d! 12") == ["ab", "c", "d"] and c.words_of("² ½ 12") == [] and c.words_of(None) == []


def test_blocks_do_not_change_results(model, monkeypatch):
    rng = random.Random(5)
    texts = [text(rng, rng.choice(list(WORDS)), rng.randrange(1, 60)) for _ in range(80)] + [None, "", "12"]
    whole = c.Tagger(model).predict(texts)
    monkeypatch.setattr(c, "BLOCK_WORDS", 50)
    monkeypatch.setattr(c, "CACHE", 20)
    small = c.Tagger(model).predict(texts)
    assert [a for a, _ in whole] == [a for a, _ in small] and np.allclose([b for _, b in whole], [b for _, b in small], atol=1e-5)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(7)
    langs = list(WORDS)
    rows = [(i, text(rng, langs[i % 3], rng.randrange(3, 60)), langs[i % 3], 0.0) for i in range(400)]
    rows += [(1000, None, "en", 0.0), (1001, "", None, 0.0), (1002, "12 !!", "en", 0.0), (None, "the green house", "en", 0.0), (5, rows[5][1], rows[5][2], 0.0), (1003, "the " * 60_000, None, 0.0)]
    got = c.language(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()
    assert len(got) == len(rows)
    want = {i: lang for i, t, lang, _ in rows if t and i is not None and i < 1000}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 40 and np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.95
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1000, 1001, 1002} and all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert c.language(empty).count() == 0
    assert c.language(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")).first()["lang_pred"] == "und"
