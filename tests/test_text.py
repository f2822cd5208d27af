import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.functions import vectors as V
from glyphmill.operators import corpus, ngram


def fnv(s):
    h = 2166136261
    for b in s.encode("utf-16-le")[::2]:
        h = (h ^ b) * 16777619 % 2**32
    return h


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


@pytest.mark.parametrize("text,want", [("(Foo)  BAR\t\n", "foo bar"), (None, ""), ("\t", ""), ("a [b]{c}<d>", "a bcd"), ("É x", "é x")])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize(F.col("x")), text) == want


def test_normalize_compose_and_strip(spark):
    assert one(spark, T.normalize(F.col("x"), compose=True), "ﬁｎ（x）") == "finx"
    assert one(spark, T.normalize(F.col("x"), strip_diacritics=True), "Éñ ü") == "en u"


def test_normalize_equals_nfkc_on_every_character(spark):
    import re
    import unicodedata

    marks = [chr(c) for c in range(1, 0xFFFF) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    rows = [(k, "".join("a" + c + "e" + c for c in marks[k : k + 1])) for k in range(0, len(marks), 3)]
    got = dict(map(tuple, spark.createDataFrame(rows, "k long, x string").select("k", T.normalize(F.col("x"))).collect()))
    kept = re.compile("[" + T.COMPOSED + "]*")
    for k, text in rows:
        if kept.fullmatch(text):
            assert unicodedata.normalize("NFKC", text) == text
        assert "".join(got[k].split()) == "".join(re.sub(r"[()\[\]{}<>]", "", unicodedata.normalize("NFKC", text).lower()).split()), hex(ord(text[1]))


def test_fnv_has_no_separator_and_uses_low_bytes(spark):
    for s in ("", "abc", "é", "日本", "a😀b"):
        assert one(spark, T.fnv(F.col("x")), s) == fnv(s)
    df = spark.createDataFrame([(1, "ab c"), (2, "a bc"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.bucket): r.cnt for r in corpus.hashed_features(df, "doc_id", features=64).collect()}
    assert got[1, fnv("abc") % 64] >= 1 and got[2, fnv("abc") % 64] >= 1 and not {3, 4} & {k[0] for k in got}
    with pytest.raises(ValueError):
        corpus.hashed_features(df, "doc_id", features=0)
    vector = {r.doc_id: r.vector for r in corpus.dense(corpus.hashed_features(df, "doc_id", features=8), "doc_id", 8).collect()}
    assert sum(vector[1]) == 3


def test_code_points_and_grams(spark):
    assert one(spark, T.code_points(F.col("x")), "a😀b") == ["a", "😀", "b"]
    assert one(spark, T.grams(F.split("x", " "), 1, 2, ""), "a b c") == ["a", "b", "c", "ab", "bc"]
    assert one(spark, T.split_list(F.col("x")), " a | |b|") == ["a", "b"]
    assert one(spark, T.csv_safe(F.col("x")), 'a"b\n') == 'a""b\\n'


def test_pair_counts_overlap(spark):
    lines = spark.createDataFrame([("aaa abab",), ("",), (None,)], "text string")
    got = {(r.lhs, r.rhs): r.cnt for r in corpus.pair_counts(corpus.word_counts(lines)).collect()}
    assert got == {("a", "a"): 2, ("a", "b"): 2, ("b", "a"): 1}
    assert tuple(corpus.best_pair(corpus.pair_counts(corpus.word_counts(lines))).first())[:2] == ("a", "a")


def test_prefix_sample_stops_at_the_first_overflow(spark):
    lines = spark.createDataFrame([(0, "aaaa"), (1, ""), (2, "bb"), (20_000, "cccccccc"), (20_001, "d")], "line_no long, text string")
    assert [r.text for r in corpus.prefix_sample(lines, 10).orderBy("line_no").collect()] == ["aaaa", "bb"]


class Brute:
    def __init__(self, seqs, order, d=0.75):
        self.order, self.d, self.n, pairs = order, d, {}, set()
        for s in seqs:
            p = ["<s>"] * (order - 1) + s + ["</s>"]
            for i in range(len(p)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        g = tuple(p[i - n + 1 : i + 1])
                        self.n[g] = self.n.get(g, 0) + 1
                        if n >= 2:
                            pairs.add(g)
        self.pre, self.fol = {}, {}
        for g in pairs:
            self.pre[g[-1]] = self.pre.get(g[-1], 0) + 1
            self.fol[g[:-1]] = self.fol.get(g[:-1], 0) + 1

    def p(self, ctx, tok):
        if not ctx:
            return self.pre[tok] / sum(self.pre.values()) if tok in self.pre else 1e-10 if self.pre else 1e-8
        c = self.n.get(ctx, 0)
        if not c:
            return 0.0
        return max(self.n.get((*ctx, tok), 0) - self.d, 0) / c + self.d * self.fol.get(ctx, 0) / c * self.p(ctx[1:], tok)


def test_probabilities_equal_brute_force(spark):
    rng = random.Random(2)
    seqs = [[rng.choice("abcd") for _ in range(rng.randrange(8))] for _ in range(30)]
    held = [list("abx"), ["zz"], list("dcba"), []]
    frame = lambda s: spark.createDataFrame([(x,) for x in s], "tokens array<string>")
    for order in (1, 2, 3):
        brute, model = Brute(seqs, order), ngram.Model.fit(frame(seqs), order)
        for rows in (seqs, held):
            got = {(tuple(r.context), r.tok): r.p for r in model.probabilities(model.events(frame(rows))).collect()}
            assert got
            for (ctx, tok), p in got.items():
                assert p == pytest.approx(brute.p(ctx, tok), abs=1e-12)
    assert model.perplexity(frame([])).first()["perplexity"] == float("inf")
    backed = model.probabilities(spark.createDataFrame([(["q", "q"], "a")], "context array<string>, tok string"), "backoff").first()["p"]
    assert backed == pytest.approx(Brute(seqs, 3).p((), "a"))
    with pytest.raises(ValueError):
        ngram.counts(frame(seqs), 6)


def test_model_save_and_generate(spark, tmp_path):
    seqs = spark.createDataFrame([(["a", "b", "c"],)] * 5, "tokens array<string>")
    model = ngram.Model.fit(seqs)
    model.save(str(tmp_path / "m"))
    again = ngram.Model.load(spark, str(tmp_path / "m"))
    assert (again.order, again.discount, again.grams.count()) == (3, 0.75, model.grams.count())
    assert again.generate(spark, [], most=2, seed=1)[0] in {"a", "b", "c"}


def test_vectors(spark):
    assert one(spark, V.softmax(F.col("x")), [1000.0, 1000.0], "array<double>") == [0.5, 0.5]
    assert one(spark, V.argmax(F.col("x")), [1.0, 3.0, 3.0], "array<double>") == 1
    assert one(spark, V.sound(F.col("x"), 2), [1.0, float("nan")], "array<double>") is False
    assert one(spark, V.draw(F.col("x"), F.lit(0.55)), [0.5, 0.25, 0.25], "array<double>") == 1
    with pytest.raises(Exception, match="finite"):
        one(spark, V.guard(F.col("x"), 3), [1.0], "array<double>")


def test_hash_of_bytes(spark):
    assert one(spark, T.fnv_bytes(F.encode("x", "UTF-8")), "a") == 0xE40C292C
    assert one(spark, T.fnv_bytes(F.encode("x", "UTF-8")), "") == 2166136261
