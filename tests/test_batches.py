"""Counting in the workers: results over many runs and parts, and plans that neither spill in the JVM nor shuffle single counts."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import batches
from glyphmill.functions import text as T
from glyphmill.operators import bpe, corpus, ngram

TEXTS = ["The (cat)  sat on the mat", "", None, "a\x1cb \U0001d518x ﬁn the cat", "the cat sat on the mat"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def brute(lists, order):
    out = Counter()
    for s in lists:
        p = ["<s>"] * (order - 1) + s + ["</s>"]
        for n in range(1, order + 1):
            out.update((n, " ".join(p[i - n + 1 : i]), p[i]) for i in range(n - 1, len(p)))
    return out


def test_words_are_split_as_the_columns_split_them(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    expected = [r.w for r in df.select(T.split_words(T.normalize(F.col("text"))).alias("w")).collect()]
    assert [batches.words_of(t) for t in TEXTS] == expected


def test_grams_of_texts_are_summed_without_an_aggregate_of_the_jvm(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS * 5], "tokens string").repartition(3)
    lists = [batches.words_of(t) for t in TEXTS * 5]
    found = ngram.counts(df)
    assert "Aggregate" not in plan(found)
    assert {(r.n, r.ctx, r.tok): r.cnt for r in found.collect()} == brute(lists, 3)
    assert {(r.n, r.ctx, r.tok) for r in ngram.counts(df, least=2).collect()} == {k for k in brute(lists, 3) if k[0] >= 2}
    assert ngram.counts(df.limit(0)).count() == 0


def test_parts_are_summed_apart_and_early_where_grams_repeat(monkeypatch):
    monkeypatch.setattr(batches, "TOKENS", 5)
    lists = [["a", "b", "c", "a"], ["x y", ""], [], ["a", "b"]] * 6
    rows = pa.RecordBatch.from_arrays([pa.array([*lists, None], pa.list_(pa.string()))], names=["tokens"])
    blobs = list(batches.gram_blobs([rows], 2, 1, 7))
    assert len(blobs) > 6
    dealt = pa.Table.from_batches(blobs).sort_by("part").to_batches()
    got = pa.Table.from_batches(batches.gram_sums(dealt)).to_pylist()
    assert len(got) == len({(r["n"], r["ctx"], r["tok"]) for r in got})
    assert {(r["n"], r["ctx"], r["tok"]): r["cnt"] for r in got} == brute(lists, 2)


@pytest.mark.parametrize("kind", ["string", "array<string>"])
def test_totals_need_no_grams(spark, kind):
    data = TEXTS if kind == "string" else [["a", "b"], [], None, ["a"]]
    df = spark.createDataFrame([(t,) for t in data], f"tokens {kind}")
    one = lambda x: {r.n: r.total for r in x.collect()}
    assert one(ngram.total_grams(df)) == one(ngram.totals(ngram.counts(df)))


def test_features_of_equal_keys_are_summed_and_leave_as_one_row_a_text(spark, monkeypatch):
    data = [(1, "ab cd ab"), (None, "ab"), (1, "cd"), (2, "  "), (3, None), (None, "x\U0001d518y"), (2, "Éx")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    found = corpus.hashed_features(df, "doc_id", features=64, chars=True)
    expected = Counter()
    for key, text in data:
        words = [w for w in __import__("re").split(r"[\W_]+", (text or "").lower()) if w]
        for items in (words, list((text or "").lower()) if (text or "").strip() else []):
            for gram in [*items, *(a + b for a, b in zip(items, items[1:]))]:
                h = 2166136261
                for b in gram.encode("utf-16-le")[::2]:
                    h = (h ^ b) * 16777619 % (1 << 32)
                expected[key, h % 64] += 1
    rows = found.collect()
    assert {(r.doc_id, r.bucket): r.cnt for r in rows} == expected and len(rows) == len(expected)
    assert "Aggregate" not in plan(found)


def test_runs_hold_no_more_than_their_bound_of_characters(monkeypatch):
    monkeypatch.setattr(batches, "CHARACTERS", 10)
    rows = pa.RecordBatch.from_arrays([pa.array(["aa bb"] * 9)], names=["text"])
    assert [len(sizes) for _, _, sizes in batches.token_runs([rows])] == [2, 2, 2, 2, 1]


def test_piece_use_and_pairs_are_counted_without_joins_or_words_in_the_shuffle(spark, monkeypatch):
    lines = spark.createDataFrame([(1, "The cat (sat) the cat sat"), (2, ""), (3, None), (4, "zzz the ab\x1fab")], "doc_id long, text string")
    tok = bpe.train(lines, 256)
    counts = corpus.word_counts(lines)
    table = bpe.piece_table(counts, tok)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    used, pairs = bpe.use(lines, tok), bpe.piece_pairs(lines, tok)
    assert not any("Join" in plan(x) or "ArrowEvalPython" in plan(x) for x in (used, pairs))
    assert rows(bpe.piece_use(lines, tok)) == rows(bpe.piece_counts(bpe.encode(lines, tok)))
    assert rows(pairs) == rows(bpe.pairs_after(counts, table))
    by = counts.join(table, "word").groupBy(F.size("pieces").alias("n_pieces")).agg(F.sum("cnt").alias("cnt"))
    assert rows(bpe.summary_of_use(used, 9)) == rows(bpe.summary(bpe.piece_counts(bpe.encode(lines, tok)), by, 9))


@pytest.mark.parametrize("bos, eos", [(False, False), (True, False), (False, True), (True, True)])
def test_encoding_leaves_in_runs_with_marks(spark, bos, eos):
    lines = spark.createDataFrame([(1, "the cat"), (2, ""), (3, None), (4, "the the cats")], "doc_id long, text string").coalesce(1)
    tok = bpe.train(lines, 256)
    found = bpe.encode(lines, tok, bos=bos, eos=eos)
    assert "ArrowEvalPython" not in plan(found)
    ids = lambda text: [bpe.BOS] * bos + [tok.vocabulary.id(p) for w in text.split() for p in tok.pieces(w)] + [bpe.EOS] * eos
    assert {r.doc_id: r.ids for r in found.collect()} == {1: ids("the cat"), 2: ids(""), 3: ids(""), 4: ids("the the cats")}


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("unseen", ["zero", "backoff"])
def test_scoring_by_context_equals_the_chained_joins(spark, order, unseen):
    train = spark.createDataFrame([(s.split(),) for s in ("a b c a b", "b", "", "a </s> b c", "</s>", "c a b a")] + [(None,)], "tokens array<string>").repartition(3)
    held = spark.createDataFrame([(s.split(),) for s in ("a b c", "x a b", "</s> b a </s>", "")], "tokens array<string>")
    model = ngram.Model.fit(train, order)
    plain = ngram.Model(model.grams, order)
    for seq in (train, held):
        found = {(r.ctx, r.tok): (r.times, r.p) for r in model.scored(seq, unseen).collect()}
        expected = {(r.ctx, r.tok): (r.times, r.p) for r in plain.scored(seq, unseen).collect()}
        assert found.keys() == expected.keys()
        assert all(found[k][0] == expected[k][0] and found[k][1] == pytest.approx(expected[k][1], abs=1e-12) for k in found)
    assert plan(model.scored(train)).count("Join") < plan(plain.scored(train)).count("Join")
    contexts = spark.createDataFrame([(s.split(),) for s in (" ".join(["<s>"] * (order - 1)), " ".join(["b", "c", "a"][: order - 1]))], "context array<string>")
    one = lambda m: {(*r.context, r.tok): r.p for r in m.next_tokens(contexts).collect()}
    assert one(model) == pytest.approx(one(plain))
