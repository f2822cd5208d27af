import random
import zlib

import numpy as np

from glyphmill.llm import quality_mil as q


def good(rng):
    return " ".join(rng.choice("the cat sat on a mat and then it went away over there".split()) for _ in range(rng.randrange(20, 200))) + "."


def bad(rng):
    return " ".join(rng.choice(["BUY!!", "NOW###", "$$$", "win%%%"]) for _ in range(rng.randrange(20, 200)))


def test_passages_cover_the_whole_text():
    texts = [b"", b" \n", b"one", b"w " * 200, "é ".encode() * 70]
    x, bag = q.passages(texts)
    assert np.bincount(bag).tolist() == [1, 1, 1, 4, 2] and x.shape[1] == q.WIDTH and np.isfinite(x).all()
    alone = np.concatenate([q.passages([t])[0] for t in texts])
    assert np.allclose(x, alone, atol=1e-6)


def test_gradients():
    rng = np.random.default_rng(3)
    m = q.Model(2)
    x = rng.standard_normal((7, q.WIDTH)).astype(np.float64)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    first, bag, label, weight = np.array([0, 3, 4]), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1, 0, 1]), np.ones(3)
    loss = lambda: float(-np.mean(label * np.log(m.forward(x, first, bag)["y"]) + (1 - label) * np.log(1 - m.forward(x, first, bag)["y"])))
    grads = m._gradient(x, first, bag, label, weight)
    for k in ("V", "U", "w", "c", "b"):
        at = tuple(0 for _ in m.p[k].shape)
        before = m.p[k][at]
        m.p[k][at] = before + 1e-5
        up = loss()
        m.p[k][at] = before - 1e-5
        down = loss()
        m.p[k][at] = before
        assert abs((up - down) / 2e-5 - np.asarray(grads[k])[at]) < 1e-4, k


def test_held_out_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, good(rng) if i % 4 else bad(rng), 0.0) for i in range(240)]
    rows += [(1000, None, 0.0), (1001, "", 0.0), (None, good(rng), 0.0), (7, rows[7][1], 0.0), (1002, "the cat sat. " * 30_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)] + [(None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    got = q.quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.95
    assert {r.predicted for r in got if r.doc_id == 1002} == {1}
    assert q.quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in q.quality(docs, labels.where("quality = 1")).collect()} == {0.5}


def test_sample_is_bounded_where_ids_repeat(spark):
    from glyphmill.llm.sampling import sample_ids

    rows = spark.range(5000).selectExpr("9L AS doc_id", "1 AS label").union(spark.range(300).selectExpr("id AS doc_id", "0 AS label"))
    for most in (1, 50, 4000, 10_000):
        picked, counts = sample_ids(rows, "label", most)
        n = dict(picked.groupBy("label").count().collect())
        assert counts == {1: 5000, 0: 300} and all(n.get(k, 0) <= min(2 * most, counts[k]) for k in counts), most
    assert n == {1: 5000, 0: 300}
    once = sorted(map(tuple, sample_ids(rows.repartition(7), "label", 50)[0].collect()))
    assert once == sorted(map(tuple, sample_ids(rows.repartition(3), "label", 50)[0].collect()))


def test_training_is_bounded_in_rows_and_passages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q.Model, "fit", lambda self, x, bag, y, share: seen.append(np.bincount(bag)))
    long = "the cat sat " * (64 * q.PASSAGES)
    texts = spark.createDataFrame([(1, "short one"), (2, long)] + [(3, f"again {i}") for i in range(40)], "doc_id long, text string")
    q.train(texts, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int"), sample=5)
    assert len(seen[0]) <= 20 and seen[0].max() <= q.PASSAGES
