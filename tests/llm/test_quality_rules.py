import re

import duckdb
import pytest

from glyphmill.llm import quality_rules as q

TEXTS = [
    None, "", " \t\n", "one two", "a b c d e f g h i j", "The cat sat on the mat.\nThe cat sat on the mat.\nAnother line here.",
    " ".join(["spam"] * 40), "Prose with words, and a few stops. It goes on for a while and says a thing or two about cats.",
    "LOUD!! WORDS!! ARE!! HERE!! AND!! THEY!! SHOUT!! AT!! ALL!! READERS!! NOW!!", "sym### bol$$$ text%%% here*** with&&& lots||| of<<< marks>>> in### every### word$$$",
    "x y z v w q x y z v w r x y z v w", "é É ß " * 12, "nbsp\xa0glued words here and so on to ten words in all", "long " * 30_000,
]


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_and_sql(spark):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 5), (None, "a b", 5)]
    got = q.weak_supervision(spark.createDataFrame(rows, "doc_id long, text string, n_words int"))
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = sorted(map(tuple, got.collect()), key=str)
    for r in found:
        if r[0] is not None:
            want = brute(TEXTS[r[0]])
            assert r[1:6] == want, TEXTS[r[0]]
            assert r[6] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r[6] and r[7])
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    assert sorted(con.execute(q.sql()).fetchall(), key=str) == found


def test_empty(spark):
    assert q.weak_supervision(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fit_learns_accuracies():
    """Rules that agree with the majority of evidence gain, one that votes against it loses."""
    k = len(q.NAMES)
    clean = [None] * k
    clean[q.NAMES.index("marks")] = clean[q.NAMES.index("plain")] = 1
    bad = [None] * k
    for n in ("symbols", "capitals", "exclaims"):
        bad[q.NAMES.index(n)] = 0
    bad[q.NAMES.index("marks")] = 0
    odd = list(clean)
    odd[q.NAMES.index("dup_lines")] = 0
    share, right = q.fit([(tuple(clean), 900), (tuple(bad), 100), (tuple(odd), 60)])
    assert q.posterior(share, right, tuple(clean)) > 0.99 > 0.01 > q.posterior(share, right, tuple(bad))
    assert q.posterior(share, right, tuple(odd)) > 0.5 > right[q.NAMES.index("dup_lines")]
    assert share == pytest.approx(0.905, abs=0.02)
