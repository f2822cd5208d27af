import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glyphmill.llm.packing import Bins, best_fit, encode

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_tokenizers(spark):
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    pieces = ["the", " And", "'s", "'LL", "é", "日本", "😀", "\n\n", "\t", "  ", "123", "<|endoftext|>", "<|end", "###", " ", "​", "x" * 60, "é"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        assert encode(text, PATH).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_is_whole_and_tight(spark, rule):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["the", "and", "ouea", "x1"]) for _ in range(rng.choice([0, 3, 50, 300, 900, 2500])))) for i in range(300)]
    texts += [(1000, None), (1000, None), (1001, ""), (None, "a b")]
    df = spark.createDataFrame([(a, b, "x") for a, b in texts], "doc_id long, text string, piece string").repartition(3)
    rows = best_fit(df, PATH, length=512, max_docs=512, rule=rule).collect()
    left = {}
    for i, t in texts:
        ids = np.append(encode(t or "", PATH), 0).astype("<u4")
        first = len(ids) % 512 or 512
        cuts = [0, *range(first, len(ids) + 1, 512)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            key = (i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
            left[key] = left.get(key, 0) + 1
    for r in rows:
        left[tuple(r)[:5]] -= 1
    assert not any(left.values())
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.08 * total / 512 + 1
    assert best_fit(df.limit(0), PATH).count() == 0


def test_every_capacity_holds():
    bins = Bins(100, 3, 5000, (1, 1, 1), "norm")
    for i, n in enumerate([60, 40, 30, 30, 30, 5, 5, 5, 5]):
        bins.place(i, n)
    sizes = [60, 40, 30, 30, 30, 5, 5, 5, 5]
    for group in bins.items:
        assert len(group) <= 3 and sum(sizes[i] for i in group) <= 100 and sum(sizes[i] ** 2 for i in group) <= 5000


def test_open_bins_are_bounded_and_nothing_is_lost():
    bins = Bins(100, 100, 10_000, (1, 0, 0), "norm")
    sizes = [60 + i % 30 for i in range(50)]
    for i, n in enumerate(sizes):
        bins.place(i, n)
    out = bins.take_beyond(20)
    assert len(bins.items) == 20 and sorted(i for g in out + bins.items for i in g) == list(range(50))
    assert min(sizes[g[0]] for g in out) >= max(sizes[g[0]] for g in bins.items)
    for i in range(50, 70):
        bins.place(i, 10)
    assert all(left[0] == 100 - sum(([*sizes, *[10] * 20])[i] for i in g) for left, g in zip(bins.left, bins.items))


def brute(sizes, capacity, docs, cost):
    """The least number of bins, by trying every placement."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best and i < len(sizes):
            return
        if i == len(sizes):
            best = min(best, len(bins))
            return
        n = sizes[i]
        for k, (a, b, c) in enumerate(bins):
            if a + n <= capacity and b < docs and c + n * n <= cost:
                go(i + 1, [*bins[:k], (a + n, b + 1, c + n * n), *bins[k + 1 :]])
        go(i + 1, [*bins, (n, 1, n * n)])

    go(0, [])
    return best


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_close_to_the_least_number_of_bins(rule):
    from functools import partial

    from glyphmill.llm.packing import pack

    rng = random.Random(4)
    found = least = 0
    for _ in range(60):
        docs, cost = rng.choice([(2, 10**6), (3, 3000), (9, 2500), (9, 10**6)])
        sizes = [rng.randrange(1, 50) for _ in range(8)]
        groups = pack(np.array(sizes), partial(Bins, 60, docs, cost, (1, 0.05, 0.05), rule))
        assert sorted(i for g in groups for i in g) == list(range(8))
        for g in groups:
            assert len(g) <= docs and sum(sizes[i] for i in g) <= 60 and sum(sizes[i] ** 2 for i in g) <= cost
        best = brute(sizes, 60, docs, cost)
        assert len(groups) <= best + 1
        found, least = found + len(groups), least + best
    assert found <= 1.1 * least
