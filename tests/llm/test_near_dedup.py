import random
import re

import pytest

from glyphmill.llm import near_dedup
from glyphmill.llm.near_dedup import components, near_duplicates


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and rows[a][0] is not None and rows[b][0] is not None:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    if x != y:
                        up[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted([(i, len(sets[k]), least.get(find(k)) if i is not None else None, i is None or i == least[find(k)]) for k, (i, _) in enumerate(rows)], key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_shingles string")
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == brute(rows)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_edge_cases(spark):
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (7, "a b c d E"), (None, "a b"), (9, "é É"), (10, "É é"), (11, "a\xa0b c"), (12, "x " * 50_000), (13, "X " * 40_000)])
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql_says_the_same(spark):
    import duckdb

    from glyphmill.llm.queries import OP1_SQL

    rng = random.Random(21)
    rows = []
    for _ in range(20):
        base = words(rng, rng.randrange(3, 60))
        rows += [(len(rows) + k, " ".join(base[:-1] + [f"e{k}"] if k else base)) for k in range(3)]
    rows += [(1000, None), (1001, ""), (1002, "A b"), (1003, "a  B")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(OP1_SQL).fetchall())


def test_copies_and_near_copies(spark):
    rng = random.Random(4)
    rows = []
    for g in range(25):
        base = words(rng, rng.randrange(20, 150))
        for _ in range(rng.choice([1, 2, 3, 30 if g == 0 else 3])):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "new" + str(rng.random())
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    check(spark, rows)


def test_shared_passage_without_links_opens_all_levels(spark):
    """Many texts that share most of a passage but are no near copies, with a few that are."""
    rng = random.Random(8)
    passage = words(rng, 100)
    rows = [(k, " ".join(passage + words(rng, 52))) for k in range(26)]
    rows += [(100 + k, rows[k][1] + " end") for k in range(0, 26, 3)]
    check(spark, rows)


def test_links_that_only_meet_in_a_shared_passage(spark):
    """A passage of four fifths of each text, and pairs at 0.75 to 0.8 that mostly share no band key but the passage's."""
    rng = random.Random(12)
    passage = words(rng, 120)
    rows = []
    for g in range(150):
        own = [f"g{g}n{k}" for k in range(32)]
        rows.append((2 * g, " ".join(passage + own)))
        share = rng.randrange(12, 15)
        rows.append((2 * g + 1, " ".join(passage + own[:share] + [f"h{g}n{k}" for k in range(32 - share)])))
    rng.shuffle(rows)
    check(spark, rows)


def test_families_joined_by_one_link(spark):
    """Pairs of families of near copies with a passage in common, each joined by one pair of members that is similar enough and in no key's centre."""
    rng = random.Random(13)
    rows = []
    for g in range(8):
        base = words(rng, 150)
        other = base[:130] + [f"g{g}o{k}" for k in range(40)]
        for family, w in enumerate((base, other)):
            rows.append((1000 * g + 100 * family, " ".join(w)))
            for k in range(1, 24):
                v = list(w)
                v[3 + 4 * k] = f"g{g}f{family}m{k}"
                rows.append((1000 * g + 100 * family + k, " ".join(v)))
        rows.append((1000 * g + 300, " ".join(base + other[130:138])))
        rows.append((1000 * g + 301, " ".join(base[:138] + other[130:156])))
    check(spark, rows)


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (9, 8), (8, 7), (20, 7), (50, 51)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[4] == 1 and got[20] == 7 and got[51] == 50 and got[140] == 100


@pytest.mark.parametrize("share", [0.5, 0.75, 1.0])
def test_estimate_is_corrected(share):
    import numpy as np

    rng = np.random.default_rng(3)
    n = 4000
    both = int(2 * n * share / (1 + share))
    s = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
    a, b = s[:n], s[n - both :]
    _, bits = near_dedup.signatures(np.concatenate((a, b)), np.array([0, n]))
    x = np.bitwise_xor(bits[0], bits[1])
    differ = sum(bin(int((v | (v >> np.uint64(1))) & np.uint64(near_dedup._LOW))).count("1") for v in x)
    assert abs(((1 - differ / 128) - 0.25) / 0.75 - share) < 0.16
