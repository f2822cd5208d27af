import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import bpe, environments, experience, lexicon, policy, tagging, wsd


def log(spark, acts, episode=1):
    return spark.createDataFrame([(i, i * 10, episode, i, [1.0, float(i)], a, 1.0, False) for i, a in enumerate(acts)], "id long, ticks long, episode int, step int, obs array<double>, act int, reward double, terminal boolean")


def test_streak_penalty_starts_at_the_fifth_equal_act(spark):
    df = experience.streaks(log(spark, [0, 0, 0, 0, 0, 1, 1, 0])).orderBy("step")
    assert [r.streak for r in df.collect()] == [0, 1, 2, 3, 4, 0, 1, 0]
    shaped = [r[0] for r in df.select(experience.repeat_penalty(F.col("reward"), F.col("streak"))).collect()]
    assert shaped == pytest.approx([1, 1, 1, 1, 0.8, 1, 1, 1])


def test_global_streaks_cross_blocks(spark):
    df = spark.createDataFrame([(i * 3000, 5 if i > 2 else 1) for i in range(10)], "id long, act int")
    assert [r.streak for r in experience.global_streaks(df).orderBy("id").collect()] == [0, 1, 2, 0, 1, 2, 3, 4, 5, 6]


def test_recall_is_newest_first(spark):
    rows = experience.recall(log(spark, [0] * 6), 4, "step").orderBy("step").collect()
    assert [r.recent for r in rows][:2] == [[], [0]] and rows[5].recent == [4, 3, 2, 1]


def test_numbering_batches_and_priority(spark):
    df = log(spark, [0] * 5).withColumn("terminal", F.col("step").isin(1, 3))
    rows = experience.number_episodes(df, "step").orderBy("step").collect()
    assert [(r.episode_no, r.step_no) for r in rows] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert [r.batch for r in experience.batches(df, 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    assert [r.id for r in experience.prioritized(df, 2).collect()] == [4, 3]
    stats = experience.episode_stats(df).first()
    assert (stats.steps, stats.succeeded) == (5, True)


def slow_train(counts, size, least=2):
    words = [(list(w), n) for w, n in counts.items()]
    chars = {}
    for w, n in words:
        for c in w:
            chars[c] = chars.get(c, 0) + n
    pieces, merges = sorted(c for c in chars if chars[c] >= least), []
    while len(pieces) + len(merges) + 4 < size:
        total = {}
        for w, n in words:
            for p in zip(w, w[1:]):
                total[p] = total.get(p, 0) + n
        if not total:
            break
        n, pair = min((-n, p) for p, n in total.items())
        if -n < least:
            break
        merges.append(pair)
        pieces.append("".join(pair))
        words = [(bpe._merge(w, pair), n) for w, n in words]
    return merges, pieces


def test_training_equals_recounting():
    rng = random.Random(1)
    counts = {"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 30) for _ in range(200)}
    tok = bpe.train_on_counts(counts, 400)
    merges, pieces = slow_train(counts, 400)
    assert tok.merges == merges and tok.vocabulary.tokens == bpe.SPECIALS + pieces
    for w in counts:
        assert "".join(tok.pieces(w)) == w
    assert bpe.Tokenizer.from_json(tok.to_json()).merges == tok.merges
    with pytest.raises(ValueError):
        bpe.train_on_counts(counts, 100)


def test_encode_decode_report(spark, tmp_path):
    lines = spark.createDataFrame([(1, "The cat (sat) the cat sat"), (2, ""), (3, None), (4, "zzz the")], "doc_id long, text string")
    tok = bpe.train(lines, 300)
    ids = {r.doc_id: r.ids for r in bpe.encode(lines, tok, bos=True, eos=True).collect()}
    assert ids[2] == ids[3] == [bpe.BOS, bpe.EOS] and ids[1][0] == bpe.BOS
    decoded = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(lines, tok), tok).collect()}
    assert decoded[1].replace(" ", "") == "thecatsatthecatsat"
    bpe.report(lines, tok, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/summary", header=True).first()["pieces_per_word"]
    empty = bpe.summary(bpe.piece_counts(bpe.encode(lines.limit(0), tok)), spark.createDataFrame([], "n_pieces int, cnt long"), 4).first()
    assert (empty.total_pieces, empty.pieces_per_word) == (0, 0.0)


def test_senses_ties_caps_and_gold(spark):
    words = spark.createDataFrame([(1, "bank")], "wordid int, word string")
    synsets = spark.createDataFrame([(i, "n", f"g{i}") for i in range(100, 180)], "synsetid int, posid string, definition string")
    senses = spark.createDataFrame([(1, i, None if i == 150 else i - 99) for i in range(100, 180)], "wordid int, synsetid int, sensenum int")
    found = lexicon.senses(words, senses, synsets)
    assert found.count() == 64 and found.where("place = 1").first()["synset_id"] == "150"
    inventory = lexicon.candidates(found)
    ex = spark.createDataFrame([(1, ["a"], 0, "bank", "n", "150"), (2, ["a"], 0, "bank", "n", "999"), (3, ["a"], 0, "x", "n", "150"), (4, ["a"], 0, "bank", "n", "140")], "ex_id long, tokens array<string>, target_index int, lemma string, pos string, gold string")
    assert [(r.ex_id, r.gold_index) for r in lexicon.with_gold(ex, inventory).collect()] == [(1, 0)]
    none = lexicon.lookup(ex.select("lemma", "pos").distinct(), inventory).where("lemma = 'x'").first()
    assert none.cands == []
    twice = spark.createDataFrame([("bank", "n", [(1, "7", "a"), (2, "7", "b")])], "lemma string, pos string, cands array<struct<place:int,synset_id:string,gloss:string>>")
    assert lexicon.with_gold(ex.withColumn("gold", F.lit("7")).limit(1), twice).first()["gold_index"] == 1


def test_text_loaders(spark):
    lines = spark.createDataFrame([("# no",), ("",), ("the bank shut\t1\tbank\tn\t7",), ("a b\t5\tb\tn\t7",), ("a b\tx\tb\tn\t7",), ("short\t1",)], "value string")
    assert [(r.tokens, r.target_index) for r in lexicon.read_examples(lines).collect()] == [(["the", "bank", "shut"], 1)]
    senses = spark.createDataFrame([(2, "bank\tn\t8\tshore\tx | |y"), (1, "bank\tn\t7\tmoney"), (3, "#")], "line_no long, value string")
    cands = lexicon.read_senses(senses).first().cands
    assert [c.synset_id for c in cands] == ["7", "8"] and cands[1].examples == ["x", "y"]
    pos = spark.createDataFrame([("f", i, v) for i, v in enumerate(["The\tD", "cat\tN", "", "", "no tab", "\tX", "runs\tV"])], "file string, line_no long, value string")
    got = tagging.read_sentences(pos, "file", "line_no").orderBy("sent", "i").collect()
    assert [(r.sent, r.i, r.token, r.tag) for r in got] == [(0, 0, "The", "D"), (0, 1, "cat", "N"), (1, 0, "runs", "V")]


def test_examples_locate_and_cap(spark):
    rows = spark.createDataFrame([(i, f"See the Bank, number {i}.", 5, "n", "bank") for i in range(5)] + [(9, "none here", 5, "n", "bank"), (10, "x", 5, "n", None)], "sampleid long, sample string, synsetid int, posid string, word string")
    assert sorted((r.ex_id, r.target_index) for r in lexicon.examples(rows, 3).collect()) == [(0, 2), (1, 2), (2, 2)]


def test_policy(spark):
    p = policy.Policy(np.array([[0.1, 0.2], [0.0, -0.1]]), np.array([0.0, 0.1]))
    df = log(spark, [0, 1, 1, 0])
    one = policy.apply_gradient(p, policy.batch_gradient(df, p), 0.05)
    want = policy.Policy(p.weights.copy(), p.bias.copy())
    for r in df.collect():
        g = p.probabilities(np.array(r.obs))
        g[r.act] -= 1
        want.weights -= 0.05 * r.reward * np.outer(g, r.obs)
        want.bias -= 0.05 * r.reward * g
    assert np.allclose(one.weights, want.weights) and np.allclose(one.bias, want.bias)
    seq = policy.Policy(p.weights.copy(), p.bias.copy())
    for r in df.orderBy("step").collect():
        seq.step(np.array(r.obs), r.act, r.reward)
    assert np.allclose(policy.replay(df, p).first().weights, seq.weights.ravel())
    assert np.allclose(policy.Policy.from_json(p.to_json()).weights, p.weights)
    with pytest.raises(ValueError):
        policy.Policy.from_json(p.to_json(), state=3)


def test_grid_and_rollout(spark):
    t = {(r.state, r.act): r for r in environments.grid_transitions(spark).collect()}
    assert len(t) == 125 and t[0, 0].next_state == 0 and t[0, 1].next_state == 1 and t[23, 1].at_goal and t[23, 1].reward == pytest.approx(0.99) and t[7, 4].next_state == 7
    rows = environments.rollout(spark, policy.Policy.fresh(25, 4), 6, most=40, learn=0.2).collect()
    for r in rows:
        assert t[r.obs.index(1.0), r.act].next_state == r.next_obs.index(1.0)
    with pytest.raises(ValueError):
        environments.grid_transitions(spark, goal=(9, 9))
    assert environments.bandit(spark, 10, arms=3, drift=0.1).count() == 30


def test_tagger_learns(spark):
    rows = [(s, i, w, t) for s in range(30) for i, (w, t) in enumerate([("the", "D"), (f"cat{s % 3}", "N"), ("runs", "V")])]
    tokens = spark.createDataFrame(rows, "sent_id long, i int, token string, tag string")
    tags = tagging.tag_ids(tokens, ["sent_id", "i"])
    assert {r.tag: r.tag_id for r in tags.collect()} == {"D": 0, "N": 1, "V": 2}
    table = tagging.gather(tagging.features(tokens, ["sent_id", "i"], 64), ["sent_id", "i"]).join(tokens.join(tags, "tag").select("sent_id", "i", F.col("tag_id").alias("y")), ["sent_id", "i"])
    model, history = tagging.train(table, 5 * 64 + 1, 3, ["sent_id", "i"])
    assert history[-1]["accuracy"] > 0.95 and history[-1]["loss"] < history[0]["loss"]
    scored = tagging.accuracy(tagging.predict(table, model), "y", "pred", "p_gold").first()
    assert scored.accuracy == pytest.approx(history[-1]["accuracy"])
    assert tuple(tagging.accuracy(tagging.predict(table, model).limit(0), "y", "pred", "p_gold").first()) == (0, 0.0, 0.0)


def test_bi_encoder(spark):
    ex = spark.createDataFrame([(i, ["money" if i % 2 else "river", "bank"], 1, [(1, "a", "cash and money"), (2, "b", "side of a river")], 0 if i % 2 else 1) for i in range(40)], "ex_id long, tokens array<string>, target_index int, cands array<struct<place:int,synset_id:string,gloss:string>>, gold_index int")
    model = wsd.BiEncoder(256, 16)
    history = wsd.train(ex, model, rate=0.5, epochs=6)
    assert history[-1]["loss"] < history[0]["loss"]
    assert np.mean([r.pred == r.gold_index for r in wsd.predict(ex, model).collect()]) > 0.9
    assert np.allclose(wsd.BiEncoder.from_json(model.to_json()).wc, model.wc)
    assert spark.range(1).select(wsd.context(F.array(*map(F.lit, "abcdefgh")), F.lit(6), 3).alias("c")).first().c == list("defgh")


def test_global_recall_crosses_episodes_and_blocks(spark):
    df = spark.range(20_005).select(F.col("id") * 7, (F.col("id") % 3).alias("episode"), F.col("id").alias("v")).toDF("id", "episode", "v")
    rows = {r.v: r.recent for r in experience.global_recall(df, 4, "v").where("v < 3 or v between 9998 and 10003 or v > 19999").collect()}
    assert rows == {v: list(range(v - 1, max(-1, v - 5), -1)) for v in rows} and len(rows) == 14
    assert experience.global_recall(df.limit(0), 4, "v").count() == 0


def test_an_environment_as_a_function():
    class Counter:
        def reset(self):
            self.n = 0
            return self.n

        def step(self, act):
            self.n += act
            return 1.0, self.n, self.n > 2

    act = environments.as_function(Counter())
    assert act() == 0 and act(2) == (1.0, 2, False) and act(2) == (1.0, 4, True) and act() == 0


def test_pairs_after_merges(spark):
    counts = spark.createDataFrame([("this", 2), ("thin", 3), ("a", 9)], "word string, cnt long")
    tok = bpe.Tokenizer(bpe.Vocabulary.of(["t", "h", "i", "s", "n", "th", "in"]), [("t", "h"), ("i", "n")])
    got = {(r.lhs, r.rhs): r.cnt for r in bpe.pairs_after(counts, bpe.piece_table(counts, tok)).collect()}
    assert got == {("th", "i"): 2, ("i", "s"): 2, ("th", "in"): 3}


def test_ranks_of_sparse_and_clustered_keys(spark):
    from glyphmill.operators import ordered

    keys = sorted({*range(500), *(random.Random(3).randrange(-(1 << 60), 1 << 60) for _ in range(500)), *(10**15 + i for i in range(300))})
    df = spark.createDataFrame([(k,) for k in random.Random(4).sample(keys, len(keys))], "id long")
    got = {r.id: r.rank for r in ordered.ranked(df, "id", width=100, most=50).collect()}
    assert got == {k: i for i, k in enumerate(keys)}
    assert ordered.ranked(df.limit(0), "id").count() == 0


def test_training_resumes_where_it_stopped():
    rng = random.Random(5)
    counts = {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))): rng.randint(1, 9) for _ in range(400)}
    kept = []
    whole = bpe.train_on_counts(counts, 400, checkpoint=lambda tok, n: kept.append(tok.to_json()), every=20)
    assert len(kept) > 2
    for text in kept:
        again = bpe.train_on_counts(counts, 400, resume=bpe.Tokenizer.from_json(text))
        assert again.merges == whole.merges and again.vocabulary.tokens == whole.vocabulary.tokens
