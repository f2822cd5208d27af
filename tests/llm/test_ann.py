import numpy as np
import pytest

from glyphmill.llm import ann


def brute(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    dim = max(set(len(v) for _, v in ok), key=lambda d: sum(len(v) == d for _, v in ok))
    ok = [(i, v) for i, v in ok if len(v) == dim]
    out = {}
    for q, x in ok:
        if q % every == 0:
            out[q] = sorted([(-(x * v).sum(), i) for i, v in ok if i != q])[:k]
    return out


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = sum(len({i for _, i, _ in by.get(q, [])} & {i for _, i in w}) for q, w in want.items())
    return by, hits / sum(map(len, want.values()))


@pytest.mark.parametrize("norms", ["unit", "varied"])
def test_recall_and_scores(spark, monkeypatch, norms):
    monkeypatch.setattr(ann, "SHARD", 300)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((10, 24))
    x = centres[rng.integers(0, 10, 2000)] + 0.8 * rng.standard_normal((2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "varied":
        x *= rng.uniform(0.3, 2, (2000, 1))
    x[100:700] = x[20]  # a third of all rows are one vector
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, 20).collect()
    want = brute(rows, 20, 20)
    by, r = recall(got, want)
    assert r >= 0.93 and set(by) == set(want)
    v = dict(rows)
    for q, found in by.items():
        assert [f[0] for f in sorted(found)] == list(range(1, 21))
        assert sorted(found) == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(f[1] != q for f in found)
        assert all(abs(f[2] - float(np.dot(np.array(v[q]), np.array(v[f[1]])))) < 1e-12 for f in found)
    assert [f[1] for f in sorted(by[120])] == [20, *range(100, 119)]


def test_repeated_query_rows_take_no_slots(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 100)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[60] = x[40]  # another query with the vector of the most repeated one
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(20, rows[20][1])] * 2 + [(40, rows[40][1])] * 24 + [(80, rows[81][1])]
    by = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20).collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all(sorted(f[0] for f in found) == list(range(1, 21)) and all(f[1] != q for f in found) for q, found in by.items() if q != 80)
    want = {q: sorted([(-float(np.dot(x[q], v)), i) for i, v in rows if i != q])[:20] for q in range(0, 600, 20) if q != 80}
    hits = sum(len({f[1] for f in by[q]} & {i for _, i in w}) for q, w in want.items())
    assert set(by) == {*want, 80} and hits >= 0.93 * sum(len({i for _, i in w}) for w in want.values())
    assert [f[1] for f in sorted(by[60])] == [40] * 20
    # Two vectors under one vec_id: two lists, none with a row of its own.
    assert sorted(f[0] for f in by[80]) == sorted([*range(1, 21)] * 2) and all(f[1] != 80 for f in by[80])


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (10, [2.0, 1.0]), (11, [2.0, 1.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df).collect()]
    assert sorted(got) == [(0, 1, 10, 2.0), (0, 2, 11, 2.0), (0, 3, 20, 0.5), (0, 4, 11, -1.0), (20, 1, 10, 1.5), (20, 2, 11, 1.5), (20, 3, 0, 0.5), (20, 4, 11, -0.5)]
    other = spark.createDataFrame([(40, [2.0], 0), (41, [-1.0], 0), (60, [1.0, 1.0, 1.0], 0)], df.schema)
    more = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df.union(other)).collect()]
    assert sorted(more) == sorted([*got, (40, 1, 8, 2.0), (40, 2, 41, -2.0)])  # 8 and 41 are the vectors of one component
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 0")).count() == 0


def test_chi_square():
    assert abs(ann.chi_square(0.95, 8) - 15.507) < 1e-2 and abs(ann.chi_square(0.5, 2) - 1.3863) < 1e-3
