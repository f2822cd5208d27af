"""The engine's queries by name over the general tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import bpe, corpus, environments, experience, lexicon, ngram, policy, tagging
from ..schemas import EPOCH_TICKS
from ..schemas import experience as as_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return table(spark, d, "documents")


def _log(spark, d):
    return as_log(table(spark, d, "events"))


# ---- SQL parts --------------------------------------------------------------------------------------------------

NORM = r"trim(regexp_replace(translate(lower(coalesce(text, '')), '()[]{}<>', ''), '\s+', ' ', 'g'))"
WORDS = f"list_filter(string_split({NORM}, ' '), lambda x: x <> '')"
ALNUM = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')"
COUNTS = f"w AS (SELECT unnest({WORDS}) AS word FROM documents), c AS (SELECT word, count(*)::BIGINT AS cnt FROM w GROUP BY word)"
GRAMS = f"""s AS (SELECT list_concat(['<s>', '<s>'], {WORDS}, ['</s>']) AS p FROM documents),
e AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM s),
g AS (SELECT n, array_to_string(p[i - n + 1:i - 1], ' ') AS ctx, p[i] AS tok, count(*)::BIGINT AS cnt FROM e, (SELECT unnest([1, 2, 3])::INTEGER AS n) WHERE i >= n GROUP BY ALL)"""


def fnv_sql(token: str) -> str:
    return f"list_reduce(list_concat([2166136261::BIGINT], list_transform(list_filter(string_split({token}, ''), lambda x: x <> ''), lambda x: (unicode(x) % 256)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


LOG = f"""log AS (SELECT event_id AS id, epoch_us(ts) * 10 + {EPOCH_TICKS} AS ticks, user_id::INTEGER AS episode,
(row_number() OVER q - 1)::INTEGER AS step, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::INTEGER AS act, value AS reward,
lead(value) OVER q AS next_value, lead(false, 1, true) OVER q AS terminal FROM events WINDOW q AS (PARTITION BY user_id ORDER BY ts, event_id))"""


# ---- text -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {NORM} AS norm FROM documents")
def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query(f"WITH {COUNTS} SELECT word, cnt FROM c")
def word_counts(spark, d):
    return corpus.word_counts(_docs(spark, d))


@query(f"WITH {COUNTS}, h AS (SELECT unnest(string_split(word, '')) AS ch, cnt FROM c) SELECT ch, sum(cnt)::BIGINT AS cnt FROM h WHERE ch <> '' GROUP BY ch")
def char_counts(spark, d):
    return corpus.char_counts(corpus.word_counts(_docs(spark, d)))


PAIRS = f"{COUNTS}, h AS (SELECT list_filter(string_split(word, ''), lambda x: x <> '') AS s, cnt FROM c), k AS (SELECT s, cnt, unnest(range(1, len(s))) AS i FROM h), p AS (SELECT s[i] AS lhs, s[i + 1] AS rhs, sum(cnt)::BIGINT AS cnt FROM k GROUP BY ALL)"


@query(f"WITH {PAIRS} SELECT lhs, rhs, cnt FROM p WHERE cnt >= 2")
def pair_counts(spark, d):
    return corpus.pair_counts(corpus.word_counts(_docs(spark, d)), 2)


@query(f"WITH {PAIRS} SELECT lhs, rhs, cnt FROM p ORDER BY cnt DESC, lhs, rhs LIMIT 1")
def best_pair(spark, d):
    return corpus.best_pair(corpus.pair_counts(corpus.word_counts(_docs(spark, d))))


@query("SELECT doc_id, text FROM (SELECT doc_id, text, sum(length(text) + 1) OVER (ORDER BY doc_id) AS chars FROM documents WHERE length(text) > 0) WHERE chars <= 1000000")
def prefix_sample(spark, d):
    return corpus.prefix_sample(_docs(spark, d), 1_000_000, "doc_id").select("doc_id", "text")


@query("SELECT text FROM documents WHERE text IS NOT NULL UNION ALL SELECT text FROM benchmark WHERE text IS NOT NULL")
def corpus_union(spark, d):
    return corpus.union_texts((_docs(spark, d), F.col("text")), (table(spark, d, "benchmark"), F.col("text")))


@query(f"SELECT doc_id, {NORM} AS line FROM documents WHERE length({NORM}) > 0")
def clean_lines(spark, d):
    return corpus.clean_lines(_docs(spark, d)).select("doc_id", F.col("text").alias("line"))


@query(f"SELECT doc_id, len(t)::INTEGER AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {ALNUM.format('text')} AS t FROM documents)")
def alnum_tokens(spark, d):
    return _docs(spark, d).select("doc_id", T.alnum_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


HASHED = f"""t AS (SELECT doc_id, {ALNUM.format("coalesce(text, '')")} AS t FROM documents),
i AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t),
g AS (SELECT doc_id, t[i] AS gram FROM i UNION ALL SELECT doc_id, t[i] || t[i + 1] FROM i WHERE i < len(t)),
c AS (SELECT gram, {fnv_sql('gram')} AS h FROM (SELECT DISTINCT gram FROM g))"""


@query(f"WITH {HASHED} SELECT doc_id, (h % 8192)::INTEGER AS bucket, count(*)::BIGINT AS cnt FROM g JOIN c USING (gram) GROUP BY ALL")
def hashed_features(spark, d):
    return corpus.hashed_features(_docs(spark, d), "doc_id")


@query(f"WITH w AS (SELECT DISTINCT unnest({ALNUM.format('text')}) AS word FROM documents) SELECT word, {fnv_sql('word')}::BIGINT AS hash FROM w")
def fnv_hashes(spark, d):
    return _docs(spark, d).select(F.explode(T.alnum_tokens(F.col("text"))).alias("word")).distinct().withColumn("hash", T.fnv(F.col("word")))


@query("SELECT doc_id, (doc_id * 2654435761) % 1000 < 900 AS train FROM documents")
def train_split(spark, d):
    return corpus.hash_order(_docs(spark, d), "doc_id").select("doc_id", "train")


# ---- language model ---------------------------------------------------------------------------------------------


def _sequences(spark, d):
    """The texts; the workers split them into words."""
    return _docs(spark, d).select("doc_id", F.col("text").alias("tokens"))


@query(f"WITH {GRAMS} SELECT n, ctx, tok, cnt FROM g")
def ngram_counts(spark, d):
    return ngram.counts(_sequences(spark, d))


@query(f"WITH {GRAMS} SELECT n, sum(cnt)::BIGINT AS total FROM g GROUP BY n")
def ngram_totals(spark, d):
    return ngram.total_grams(_sequences(spark, d))


@query(f"WITH {GRAMS} SELECT tok, count(*)::BIGINT AS contexts FROM g WHERE n >= 2 GROUP BY tok")
def continuation_preceding(spark, d):
    return ngram.preceding(ngram.counts(_sequences(spark, d), least=2))


@query(f"WITH {GRAMS} SELECT n, ctx, count(*)::BIGINT AS followers FROM g WHERE n >= 2 GROUP BY n, ctx")
def continuation_following(spark, d):
    return ngram.following(ngram.counts(_sequences(spark, d), least=2))


EVENTS_SQL = "SELECT array_to_string(p[i - 2:i - 1], ' ') AS c3, p[i - 1] AS c2, p[i] AS tok, count(*) AS times FROM he GROUP BY ALL"


def _kn_sql(train: str, held: str, last: str, events: str = EVENTS_SQL) -> str:
    seq = lambda where: f"SELECT list_concat(['<s>', '<s>'], {WORDS}, ['</s>']) AS p FROM documents WHERE {where}"
    return f"""WITH s AS ({seq(train)}), e AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM s),
g AS (SELECT n, array_to_string(p[i - n + 1:i - 1], ' ') AS ctx, p[i] AS tok, count(*)::BIGINT AS cnt FROM e, (SELECT unnest([1, 2, 3])::INTEGER AS n) WHERE i >= n GROUP BY ALL),
pre AS (SELECT tok, count(*) AS contexts FROM g WHERE n >= 2 GROUP BY tok), whole AS (SELECT sum(contexts) AS whole FROM pre),
fol AS (SELECT n, ctx, count(*) AS followers FROM g WHERE n >= 2 GROUP BY n, ctx),
own AS (SELECT n, CASE WHEN ctx = '' THEN tok ELSE ctx || ' ' || tok END AS ctx, cnt AS cc FROM g),
hs AS ({seq(held)}), he AS (SELECT p, unnest(range(3, len(p) + 1)) AS i FROM hs),
ev AS ({events}),
p1 AS (SELECT ev.*, coalesce(contexts / whole, 1e-10) AS p FROM ev LEFT JOIN pre USING (tok), whole),
p2 AS (SELECT p1.* EXCLUDE (p), CASE WHEN own.cc IS NULL THEN 0 ELSE greatest(coalesce(g.cnt, 0) - 0.75::DOUBLE, 0) / own.cc + 0.75::DOUBLE * coalesce(followers, 0) / own.cc * p1.p END AS p
  FROM p1 LEFT JOIN g ON g.n = 2 AND g.ctx = p1.c2 AND g.tok = p1.tok LEFT JOIN fol ON fol.n = 2 AND fol.ctx = p1.c2 LEFT JOIN own ON own.n = 1 AND own.ctx = p1.c2),
p3 AS (SELECT p2.* EXCLUDE (p), CASE WHEN own.cc IS NULL THEN 0 ELSE greatest(coalesce(g.cnt, 0) - 0.75::DOUBLE, 0) / own.cc + 0.75::DOUBLE * coalesce(followers, 0) / own.cc * p2.p END AS p
  FROM p2 LEFT JOIN g ON g.n = 3 AND g.ctx = p2.c3 AND g.tok = p2.tok LEFT JOIN fol ON fol.n = 3 AND fol.ctx = p2.c3 LEFT JOIN own ON own.n = 2 AND own.ctx = p2.c3)
{last}"""


PPL = "SELECT sum(times)::BIGINT AS n_tokens, round(pow(2, sum(-log2(greatest(p, 1e-12)) * times) / sum(times)), 4) AS perplexity FROM p3"


@query(_kn_sql("true", "true", PPL))
def kn_perplexity(spark, d):
    seq = _sequences(spark, d)
    return ngram.Model.fit(seq).perplexity(seq).withColumn("perplexity", F.round("perplexity", 4))


@query(_kn_sql("true", "true", "SELECT c3 AS context, tok, times::BIGINT AS times, round(p, 8) AS p FROM p3"))
def kn_probs(spark, d):
    seq = _sequences(spark, d)
    return ngram.Model.fit(seq).scored(seq).select(F.col("ctx").alias("context"), "tok", "times", F.round("p", 8).alias("p"))


@query(_kn_sql("doc_id % 10 <> 0", "doc_id % 10 = 0", "SELECT sum(times)::BIGINT AS n_tokens, round(sum(-log2(greatest(p, 1e-12)) * times) / sum(times), 6) AS bits FROM p3"))
def kn_heldout(spark, d):
    """Bits a token of every tenth document under a model of the others."""
    docs = _docs(spark, d)
    split = lambda c: docs.where(c).select("doc_id", F.col("text").alias("tokens"))
    return ngram.Model.fit(split("doc_id % 10 <> 0")).perplexity(split("doc_id % 10 = 0")).select("n_tokens", F.round(F.log2("perplexity"), 6).alias("bits"))


@query(_kn_sql("true", "true", "SELECT c3 AS context, tok, round(p, 8) AS p FROM p3", "SELECT c3, c2, tok, 1 AS times FROM pre, (VALUES ('<s> <s>', '<s>'), ('<s> the', 'the')) v(c3, c2) WHERE tok <> '<s>'"))
def next_token_probs(spark, d):
    """What may follow a text's start, and a first word."""
    contexts = spark.createDataFrame([(["<s>", "<s>"],), (["<s>", "the"],)], "context array<string>")
    found = ngram.Model.fit(_sequences(spark, d)).next_tokens(contexts, specials=False)
    return found.select(F.array_join("context", " ").alias("context"), "tok", F.round("p", 8).alias("p"))


@query()
def lm_generate(spark, d):
    """A text drawn from the trigram model of the benchmark passages."""
    seq = table(spark, d, "benchmark").select(T.split_words(T.normalize(F.col("text"))).alias("tokens"))
    model = ngram.Model.fit(seq)
    words = model.generate(spark, [], most=8, seed=7)
    model.release()
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, word string")


# ---- lexicon ----------------------------------------------------------------------------------------------------

LEMMAS = [(0, "1-urgent"), (1, "specified"), (2, "3-medium"), (3, "5-low"), (4, "2-high")]
_LEMMA_SQL = "words AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in LEMMAS) + ") AS v(wordid, word))"
SAMPLES_SQL = f"{_LEMMA_SQL}, smp AS (SELECT o_orderkey AS sampleid, o_orderpriority AS sample, o_custkey AS synsetid, c_mktsegment AS posid, word FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN words ON wordid = o_orderkey % 7 WHERE o_orderpriority IS NOT NULL ORDER BY o_orderkey LIMIT 200000)"
EXAMPLES_SQL = f"""{SAMPLES_SQL}, tok AS (SELECT *, list_filter(regexp_split_to_array(sample, '\\s+'), lambda x: x <> '') AS tokens FROM smp WHERE word IS NOT NULL AND trim(word) <> '' AND trim(sample) <> ''),
loc AS (SELECT *, (coalesce(list_position(list_transform(tokens, lambda t: lower(regexp_replace(t, '[''.,;:!?)(]+$', ''))), word), 0) - 1)::INTEGER AS target_index FROM tok),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, posid ORDER BY sampleid) AS place FROM loc WHERE target_index >= 0) WHERE place <= 200)"""
SENSES_SQL = """sen AS (SELECT * FROM (SELECT word AS lemma, c_mktsegment AS pos, c_custkey::VARCHAR AS synset_id, c_name AS gloss, c_nationkey AS sense_num,
row_number() OVER (PARTITION BY word, c_mktsegment ORDER BY c_nationkey, c_custkey::VARCHAR) AS place FROM customer JOIN words ON wordid = c_nationkey % 5) WHERE place <= 64)"""


def _lexicon(spark, d):
    words = spark.createDataFrame(LEMMAS, "wordid long, word string")
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    synsets = customer.select(F.col("c_custkey").alias("synsetid"), F.col("c_mktsegment").alias("posid"), F.col("c_name").alias("definition"))
    senses = customer.select((F.col("c_nationkey") % 5).cast("long").alias("wordid"), F.col("c_custkey").alias("synsetid"), F.col("c_nationkey").alias("sensenum"))
    samples = orders.select(F.col("o_orderkey").alias("sampleid"), F.col("o_custkey").alias("synsetid"), (F.col("o_orderkey") % 7).alias("wordid"), F.col("o_orderpriority").alias("sample"))
    return words, senses, synsets, samples


@query("SELECT c_name AS text FROM customer WHERE c_name IS NOT NULL UNION ALL SELECT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL")
def lexicon_export(spark, d):
    _, _, synsets, samples = _lexicon(spark, d)
    return lexicon.text_export(synsets, samples)


@query(f"WITH {SAMPLES_SQL} SELECT sampleid, sample, synsetid, posid, word FROM smp")
def sample_rows(spark, d):
    words, _, synsets, samples = _lexicon(spark, d)
    return lexicon.sample_rows(samples, synsets, words)


@query(f"WITH {EXAMPLES_SQL} SELECT sampleid AS ex_id, array_to_string(tokens, ' ') AS tokens, target_index, word AS lemma, posid AS pos, synsetid::VARCHAR AS gold FROM ex")
def wsd_examples_capped(spark, d):
    return _examples(spark, d).withColumn("tokens", F.array_join("tokens", " "))


def _examples(spark, d):
    words, _, synsets, samples = _lexicon(spark, d)
    return lexicon.examples(lexicon.sample_rows(samples, synsets, words), 200)


def _inventory(spark, d):
    words, senses, synsets, _ = _lexicon(spark, d)
    return lexicon.senses(words, senses, synsets)


@query(f"WITH {_LEMMA_SQL}, {SENSES_SQL} SELECT lemma, pos, synset_id, gloss, sense_num, place::INTEGER AS place FROM sen")
def sense_topk(spark, d):
    return _inventory(spark, d)


@query(f"WITH {EXAMPLES_SQL} SELECT DISTINCT word AS lemma, posid AS pos FROM ex")
def distinct_keys(spark, d):
    return lexicon.distinct_keys(_examples(spark, d))


@query(f"WITH {EXAMPLES_SQL}, {SENSES_SQL} SELECT DISTINCT word AS lemma, posid AS pos, (SELECT count(*) FROM sen WHERE sen.lemma = ex.word AND sen.pos = ex.posid)::INTEGER AS n_cands FROM ex")
def candidate_join(spark, d):
    found = lexicon.lookup(lexicon.distinct_keys(_examples(spark, d)), lexicon.candidates(_inventory(spark, d)))
    return found.select("lemma", "pos", F.size("cands").alias("n_cands"))


@query(f"WITH {EXAMPLES_SQL}, {SENSES_SQL} SELECT sampleid AS ex_id, (max(sen.place) - 1)::INTEGER AS gold_index FROM ex JOIN sen ON sen.lemma = ex.word AND sen.pos = ex.posid AND sen.synset_id = ex.synsetid::VARCHAR AND sen.place <= 16 GROUP BY sampleid")
def gold_filter(spark, d):
    return lexicon.with_gold(_examples(spark, d), lexicon.candidates(_inventory(spark, d))).select("ex_id", "gold_index")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, (coalesce(list_position(list_transform(w, lambda t: lower(regexp_replace(t, '[''.,;:!?)(]+$', ''))), 'the'), 0) - 1)::INTEGER AS target_index FROM t""")
def target_index(spark, d):
    return _docs(spark, d).select("doc_id", lexicon.target_index(T.split_words(F.col("text")), F.lit("the")).alias("target_index"))


@query()
def wsd_predict(spark, d):
    """Senses of examples by an untrained, seeded bi-encoder."""
    from ..operators import wsd

    return wsd.predict(lexicon.with_gold(_examples(spark, d), lexicon.candidates(_inventory(spark, d))), wsd.BiEncoder(512, 16))


# ---- experience -------------------------------------------------------------------------------------------------


@query(f"WITH {LOG}, m AS (SELECT min(ticks) AS a, max(ticks) AS b FROM log) SELECT id, ticks, episode, step, reward FROM log, m WHERE ticks BETWEEN a + (b - a) // 4 AND a + (b - a) // 2")
def time_range_scan(spark, d):
    log = _log(spark, d)
    ends = log.agg(F.min("ticks").alias("a"), F.max("ticks").alias("b")).first()
    if ends.a is None:
        return log.select("id", "ticks", "episode", "step", "reward")
    return experience.time_range(log, ends.a + (ends.b - ends.a) // 4, ends.a + (ends.b - ends.a) // 2).select("id", "ticks", "episode", "step", "reward")


@query(f"WITH {LOG} SELECT id, ticks, reward FROM log WHERE id >= 100 AND id < 600")
def index_range(spark, d):
    return experience.index_range(_log(spark, d), 100, 500).select("id", "ticks", "reward")


@query(f"WITH {LOG} SELECT episode, step, array_to_string(list_transform(list_reverse(list(reward) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)), lambda x: round(x, 6)::VARCHAR), ',') AS recent FROM log")
def recall_last4(spark, d):
    out = experience.recall(_log(spark, d), 4, "reward")
    return out.select("episode", "step", F.when(F.size("recent") > 0, F.array_join(F.transform("recent", lambda x: F.round(x, 6).cast("string")), ",")).alias("recent"))


STREAK_SQL = f"{LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY step) - row_number() OVER (PARTITION BY episode, act ORDER BY step) AS run FROM log), k AS (SELECT *, (row_number() OVER (PARTITION BY episode, act, run ORDER BY step) - 1)::INTEGER AS streak FROM r)"


@query(f"WITH {STREAK_SQL} SELECT episode, step, act, streak, round(reward - CASE WHEN streak >= 4 THEN 0.2 ELSE 0 END, 6) AS shaped FROM k")
def repeat_penalty(spark, d):
    return experience.streaks(_log(spark, d)).select("episode", "step", "act", "streak", F.round(experience.repeat_penalty(F.col("reward"), F.col("streak")), 6).alias("shaped"))


@query(f"WITH {LOG}, a AS (SELECT *, row_number() OVER (ORDER BY id) - row_number() OVER (PARTITION BY act ORDER BY id) AS run FROM log) SELECT id, act, (row_number() OVER (PARTITION BY act, run ORDER BY id) - 1)::INTEGER AS streak FROM a")
def global_streaks(spark, d):
    return experience.global_streaks(_log(spark, d)).select("id", "act", "streak")


@query(f"WITH {LOG} SELECT id, round(reward + CASE WHEN terminal THEN 1 ELSE 0 END, 6) AS shaped FROM log")
def goal_reward(spark, d):
    return _log(spark, d).select("id", F.round(experience.goal_reward(F.col("reward"), F.col("terminal")), 6).alias("shaped"))


@query(f"WITH {LOG} SELECT id, round(reward + CASE WHEN act = 2 THEN 0.5 ELSE 0 END, 6) AS shaped FROM log")
def target_action_reward(spark, d):
    return _log(spark, d).select("id", F.round(experience.target_reward(F.col("reward"), F.col("act"), 2), 6).alias("shaped"))


@query(f"WITH {STREAK_SQL} SELECT id, round(3 * reward + CASE WHEN terminal THEN 1 ELSE 0 END + CASE WHEN act = 2 THEN 0.5 ELSE 0 END - CASE WHEN streak >= 4 THEN 0.2 ELSE 0 END, 5) AS shaped FROM k")
def composite_reward(spark, d):
    log = experience.streaks(_log(spark, d))
    r = F.col("reward")
    shaped = experience.composite(experience.goal_reward(r, F.col("terminal")), experience.target_reward(r, F.col("act"), 2), experience.repeat_penalty(r, F.col("streak")))
    return log.select("id", F.round(shaped, 5).alias("shaped"))


@query(f"WITH {LOG}, p AS (SELECT id, reward, 0.6 * abs(reward) + 0.4 * ((row_number() OVER (ORDER BY id) - 1) / count(*) OVER ()) AS priority FROM log) SELECT id, round(priority, 6) AS priority FROM p ORDER BY p.priority DESC, id LIMIT 100")
def prioritized_topk(spark, d):
    return experience.prioritized(_log(spark, d), 100).select("id", F.round("priority", 6).alias("priority"))


@query(f"WITH {LOG} SELECT episode, count(*)::BIGINT AS steps, round(sum(reward), 4) AS total_reward, bool_or(terminal) AS succeeded, min(ticks) AS start_ticks, max(ticks) AS end_ticks FROM log GROUP BY episode")
def episode_stats(spark, d):
    return experience.episode_stats(_log(spark, d)).withColumn("total_reward", F.round("total_reward", 4))


@query(f"WITH {LOG} SELECT episode, step, count(*) OVER q::BIGINT AS n, round(sum(reward) OVER q, 4) AS reward_sum, round(avg(reward) OVER q, 9) AS reward_mean, round((ticks - lag(ticks) OVER (PARTITION BY episode ORDER BY step)) / 10000.0::DOUBLE, 3) AS step_ms FROM log WINDOW q AS (PARTITION BY episode ORDER BY step ROWS UNBOUNDED PRECEDING)")
def telemetry(spark, d):
    return experience.telemetry(_log(spark, d)).select("episode", "step", "n", F.round("reward_sum", 4).alias("reward_sum"), F.round("reward_mean", 9).alias("reward_mean"), F.round("step_ms", 3).alias("step_ms"))


@query(f"WITH {LOG} SELECT episode, step, reward, next_value FROM log")
def next_obs_pairs(spark, d):
    return experience.next_values(_log(spark, d), "reward").select("episode", "step", "reward", F.col("next_reward").alias("next_value"))


@query(f"WITH {LOG}, k AS (SELECT id, episode, reward, step, act = 2 AS terminal FROM log), n AS (SELECT *, coalesce(sum(terminal::INTEGER) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS episode_no FROM k) SELECT id, episode_no, (row_number() OVER (PARTITION BY episode, episode_no ORDER BY step) - 1)::INTEGER AS step_no FROM n")
def episode_numbering(spark, d):
    log = _log(spark, d).withColumn("terminal", F.col("act") == 2)
    return experience.number_episodes(log, "step").select("id", "episode_no", "step_no")


@query(f"WITH {LOG} SELECT id, ((row_number() OVER (ORDER BY id) - 1) // 256)::BIGINT AS batch FROM log")
def batches(spark, d):
    return experience.batches(_log(spark, d)).select("id", "batch")


@query(f"WITH {LOG} SELECT id, greatest(0, least(2, act))::INTEGER AS act, ['stay', 'go', 'stop'][greatest(0, least(2, act)) + 1] AS say FROM log")
def clamp_template(spark, d):
    texts = ["stay", "go", "stop"]
    return _log(spark, d).select("id", V.clamp(F.col("act"), 0, 2).alias("act"), V.template(F.col("act"), texts).alias("say"))


@query("SELECT event_id AS id, (coalesce(list_position(['view', 'click'], event_type), 1) - 1)::INTEGER AS act FROM events")
def template_lookup(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), V.template_index(F.col("event_type"), ["view", "click"]).alias("act"))


# ---- vectors, models --------------------------------------------------------------------------------------------


@query("SELECT vec_id, embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS sound FROM embeddings")
def vector_guard(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.sound(F.col("embedding"), 64).alias("sound"))


CUES = "cue AS (SELECT label AS cue, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
DOT = "list_sum(list_transform(list_zip(embedding, c), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _cues(spark, d):
    """One mean vector a label."""
    each = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").alias("cue")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


@query(f"WITH {CUES} SELECT vec_id, cue, round({DOT}, 6) AS score FROM embeddings, cue")
def dot_scores(spark, d):
    """Every vector against each of the few cue vectors."""
    both = table(spark, d, "embeddings").crossJoin(F.broadcast(_cues(spark, d)))  # one cue a label
    return both.select("vec_id", "cue", F.round(V.dot(F.col("embedding"), F.col("c")), 6).alias("score"))


@query(f"WITH {CUES}, s AS (SELECT vec_id, cue, round({DOT}, 6) AS score FROM embeddings, cue) SELECT cue, vec_id, score, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 10")
def knn_topk(spark, d):
    return lexicon.top_per_key(dot_scores(spark, d).withColumn("far", -F.col("score")), ["cue"], ["far", "vec_id"], 10).select("cue", "vec_id", "score", "place")


WEIGHTS = [[0.1 * a, 0.01 * (a - 2)] for a in range(5)]
BIAS = [0.0, 0.1, 0.2, 0.1, 0.0]
LOGITS_SQL = "[" + ", ".join(f"{w[0]!r}::DOUBLE + {w[1]!r}::DOUBLE * reward + {b!r}::DOUBLE" for w, b in zip(WEIGHTS, BIAS)) + "]"
PROBS_SQL = f"{LOG}, z AS (SELECT *, {LOGITS_SQL} AS z FROM log), x AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS ex FROM z), p AS (SELECT *, list_transform(ex, lambda v: v / list_sum(ex)) AS probs FROM x)"


def _policy():
    import numpy as np

    return policy.Policy(np.array(WEIGHTS), np.array(BIAS))


@query(f"WITH {PROBS_SQL} SELECT id, unnest(range(0, 5))::INTEGER AS action, round(unnest(z), 6) AS logit, round(unnest(probs), 6) AS p FROM p")
def softmax_probs(spark, d):
    log = _log(spark, d).withColumn("logit", V.logits(F.col("obs"), WEIGHTS, BIAS))
    rows = policy.probabilities(log, _policy()).select("id", F.posexplode(F.arrays_zip("logit", "probs")).alias("action", "z"))
    return rows.select("id", "action", F.round("z.logit", 6).alias("logit"), F.round("z.probs", 6).alias("p"))


@query(f"WITH {PROBS_SQL} SELECT id, (list_position(probs, list_max(probs)) - 1)::INTEGER AS best FROM p")
def argmax_class(spark, d):
    return policy.probabilities(_log(spark, d), _policy()).select("id", V.argmax(F.col("probs")).alias("best"))


@query(f"WITH {PROBS_SQL}, u AS (SELECT id, probs, ((id * 7919) % 1000) / 1000.0::DOUBLE AS u FROM p) SELECT id, least(len(list_filter([probs[1], probs[1] + probs[2], probs[1] + probs[2] + probs[3], probs[1] + probs[2] + probs[3] + probs[4], probs[1] + probs[2] + probs[3] + probs[4] + probs[5]], lambda c: c < u)), 4)::INTEGER AS decision FROM u")
def policy_decide(spark, d):
    u = (F.col("id") * 7919) % 1000 / F.lit(1000.0)
    return policy.decide(_log(spark, d), _policy(), u).select("id", "decision")


@query(f"WITH {PROBS_SQL}, a AS (SELECT unnest(range(0, 5))::INTEGER AS action), g AS (SELECT action, reward * (probs[action + 1] - (act = action)::INTEGER) AS g, reward FROM p, a WHERE act IS NOT NULL) SELECT action, i, round(sum(g * CASE WHEN i < 1 THEN 1 ELSE reward END) / 1000, 6) AS grad FROM g, (SELECT unnest([-1, 0, 1])::INTEGER AS i) GROUP BY action, i")
def policy_batch_gradient(spark, d):
    return policy.batch_gradient(_log(spark, d), _policy()).withColumn("grad", F.round(F.col("grad") / 1000, 6))


@query()
def policy_replay(spark, d):
    """Ordered replay of every episode from the same start."""
    return policy.replay(_log(spark, d).where("act is not null").withColumn("reward", F.col("reward") / 100), _policy()).select("episode", "steps", "weights")


@query("SELECT count(*)::BIGINT AS n, round(avg((quality = (p >= 0.5)::INTEGER)::INTEGER), 6) AS accuracy, round(avg(-ln(greatest(1e-8, CASE WHEN quality = 1 THEN p ELSE 1 - p END))), 6) AS loss FROM (SELECT quality, 1 / (1 + exp(-(n_chars / 1000.0::DOUBLE - 1))) AS p FROM labels JOIN documents USING (doc_id))")
def accuracy_loss(spark, d):
    """A length-only baseline against the quality labels."""
    p = 1 / (1 + F.exp(-(F.col("n_chars") / F.lit(1000.0) - 1)))
    rows = table(spark, d, "labels").join(_docs(spark, d), "doc_id").withColumn("p", p).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    rows = rows.withColumn("pg", F.when(F.col("quality") == 1, F.col("p")).otherwise(1 - F.col("p")))
    return tagging.accuracy(rows, "quality", "pred", "pg").select("n", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"))


@query("SELECT s.state::INTEGER AS state, a.act::INTEGER AS act, (ny * 5 + nx)::INTEGER AS next_state, round(CASE WHEN ny * 5 + nx = 24 THEN 1.0 ELSE 0.0 END - 0.01, 6)::DOUBLE AS reward, ny * 5 + nx = 24 AS at_goal FROM (SELECT unnest(range(0, 25)) AS state) s, (SELECT unnest(range(0, 5)) AS act) a, LATERAL (SELECT CASE a.act WHEN 1 THEN least(4, s.state % 5 + 1) WHEN 3 THEN greatest(0, s.state % 5 - 1) ELSE s.state % 5 END AS nx, CASE a.act WHEN 0 THEN greatest(0, s.state // 5 - 1) WHEN 2 THEN least(4, s.state // 5 + 1) ELSE s.state // 5 END AS ny) m")
def grid_transitions(spark, d):
    return environments.grid_transitions(spark).withColumn("reward", F.round("reward", 6))


@query()
def grid_rollout(spark, d):
    return environments.rollout(spark, policy.Policy.fresh(25, 4), 20, learn=0.1).select("episode", "step", "act", "reward", "shaped_reward", "terminal", "at_goal")


@query()
def bandit_rollout(spark, d):
    return environments.bandit(spark, 200, drift=0.05)


# ---- tagging ----------------------------------------------------------------------------------------------------

FIRST_WORD = r"regexp_extract(text, '^\s*(\S*)', 1)"


def _tokens(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("sent_id"), F.col("turn").alias("i"), F.regexp_extract("text", r"^\s*(\S*)", 1).alias("token"), F.col("role").alias("tag"))


@query(f"WITH t AS (SELECT conv_id AS sent_id, turn AS i, {FIRST_WORD} AS token FROM conversations) SELECT sent_id, i, " + " || ' ' || ".join(f"{f}(token, {k}, '<PAD>') OVER q" if k else "token" for f, k in (("lag", 2), ("lag", 1), ("", 0), ("lead", 1), ("lead", 2))) + " AS slots FROM t WINDOW q AS (PARTITION BY sent_id ORDER BY i)")
def pos_windows(spark, d):
    return tagging.windows(_tokens(spark, d)).select("sent_id", "i", F.array_join("slots", " ").alias("slots"))


@query(f"""WITH t AS (SELECT conv_id AS sent_id, turn AS i, {FIRST_WORD} AS token FROM conversations),
s AS (SELECT sent_id, i, [{", ".join(f"{f}(token, {k}, '<PAD>') OVER q" if k else "token" for f, k in (("lag", 2), ("lag", 1), ("", 0), ("lead", 1), ("lead", 2)))}] AS slots FROM t WINDOW q AS (PARTITION BY sent_id ORDER BY i)),
u AS (SELECT sent_id, i, unnest(range(0, 5)) AS slot, unnest(slots) AS word FROM s), a AS (SELECT *, {ALNUM.format("word")} AS w FROM u),
k AS (SELECT *, unnest(range(1, len(w) + 1)) AS j FROM a), g AS (SELECT sent_id, i, slot, w[j] AS gram FROM k UNION ALL SELECT sent_id, i, slot, w[j] || w[j + 1] FROM k WHERE j < len(w)),
h AS (SELECT sent_id, i, (slot * 512 + {fnv_sql("gram")} % 512)::INTEGER AS f FROM g UNION ALL SELECT sent_id, i, 2560 FROM t)
SELECT sent_id, i, f, count(*)::BIGINT AS cnt FROM h GROUP BY ALL""")
def pos_features(spark, d):
    return tagging.features(_tokens(spark, d), ["sent_id", "i"])


@query("SELECT tag, (row_number() OVER (ORDER BY a, b, tag) - 1)::INTEGER AS tag_id FROM (SELECT role AS tag, min(conv_id) AS a, arg_min(turn, (conv_id, turn)) AS b FROM conversations GROUP BY role)")
def tag_dictionary(spark, d):
    return tagging.tag_ids(_tokens(spark, d), ["sent_id", "i"])


# ---- byte pairs -------------------------------------------------------------------------------------------------


def _tokenizer(spark, d):
    return bpe.train(table(spark, d, "benchmark").unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"))), 512)


@query()
def bpe_encode(spark, d):
    return bpe.decode(bpe.encode(table(spark, d, "benchmark"), _tokenizer(spark, d), "item_id", bos=True, eos=True), _tokenizer(spark, d))


@query()
def tokenizer_summary(spark, d):
    docs, tok = _docs(spark, d), _tokenizer(spark, d)
    return bpe.summary_of_use(bpe.use(docs, tok), len(tok.vocabulary.tokens))


@query(f"WITH {COUNTS}, h AS (SELECT unnest(string_split(word, '')) AS piece, cnt FROM c), f AS (SELECT piece AS id, sum(cnt)::BIGINT AS freq FROM h WHERE piece <> '' GROUP BY piece) SELECT id, freq FROM f ORDER BY freq DESC, id LIMIT 20")
def top_pieces(spark, d):
    return bpe.top_pieces(corpus.char_counts(corpus.word_counts(_docs(spark, d))).select(F.col("ch").alias("id"), F.col("cnt").alias("freq")), 20)


@query(f"WITH {COUNTS}, h AS (SELECT unnest(string_split(word, '')) AS piece, cnt FROM c), f AS (SELECT piece AS id, sum(cnt)::BIGINT AS freq FROM h WHERE piece <> '' GROUP BY piece) SELECT id, freq FROM f ORDER BY freq, id LIMIT 20")
def rare_pieces(spark, d):
    return bpe.rare_pieces(corpus.char_counts(corpus.word_counts(_docs(spark, d))).select(F.col("ch").alias("id"), F.col("cnt").alias("freq")), 20)


# ---- log format -------------------------------------------------------------------------------------------------


@query(f"WITH {LOG} SELECT id, ticks, episode, act, round(reward::FLOAT::DOUBLE, 3) AS reward, terminal FROM log")
def xlog_roundtrip(spark, d):
    """The log as record payloads and back."""
    import pandas as pd

    from ..sources import xlog
    from .. import schemas

    rows = xlog.to_envelopes(_log(spark, d))

    def through(batches):
        for pdf in batches:
            out = [xlog.decode(xlog.encode(r)) for r in pdf.to_dict("records")]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schemas.ENVELOPE.split(", ")])

    back = xlog.from_envelopes(rows.mapInPandas(through, schemas.ENVELOPE))
    return back.select("id", "ticks", "episode", "act", F.round(F.col("reward").cast("double"), 3).alias("reward"), "terminal")


# ---- a stated byte-pair vocabulary ------------------------------------------------------------------------------

#: Merges in order; every part of a pair is a character or made by an earlier merge.
MERGES = [tuple(m.split()) for m in "t h,th e,i n,e r,a n,o n,r e,in g,an d,s t,e n,o r,a t,e s,i t,a l,o u,l l,the r,e d,i s,o f,er s,c h".split(",")]
STATED = bpe.Tokenizer(bpe.Vocabulary.of([*"abcdefghijklmnopqrstuvwxyz0123456789", *(a + b for a, b in MERGES)]), MERGES)


def _merged(word: str) -> str:
    """SQL of a word's pieces as <piece><piece>: words hold no brackets, and each merge goes over the word once."""
    out = rf"regexp_replace({word}, '(?s)(.)', '<\1>', 'g')"
    for a, b in MERGES:
        out = f"replace({out}, '<{a}><{b}>', '<{a}{b}>')"
    return out


_VOCAB_SQL = "[" + ", ".join(f"'{t}'" for t in STATED.vocabulary.tokens) + "]"
PIECES_SQL = f"{COUNTS}, m AS (SELECT word, cnt, {_merged('word')} AS x FROM c WHERE word <> ''), k AS (SELECT word, cnt, string_split(substr(x, 2, length(x) - 2), '><') AS p FROM m)"
USE_SQL = f"{PIECES_SQL}, u AS (SELECT unnest(p) AS piece, cnt FROM k), f AS (SELECT (coalesce(list_position({_VOCAB_SQL}, piece), 2) - 1)::INTEGER AS id, sum(cnt)::BIGINT AS freq FROM u GROUP BY ALL)"


def _piece_use(spark, d):
    return bpe.piece_use(_docs(spark, d), STATED)


@query(f"WITH {PIECES_SQL} SELECT word, array_to_string(p, ' ') AS pieces FROM k")
def bpe_pieces(spark, d):
    return bpe.with_pieces(corpus.word_counts(_docs(spark, d)), STATED).select("word", F.array_join("pieces", " ").alias("pieces"))


@query(f"""WITH w AS (SELECT doc_id, list_transform({WORDS}, lambda w: {_merged('w')}) AS ms FROM documents), x AS (SELECT doc_id, array_to_string(ms, '') AS x FROM w),
p AS (SELECT doc_id, CASE WHEN x = '' THEN [] ELSE string_split(substr(x, 2, length(x) - 2), '><') END AS p FROM x),
i AS (SELECT doc_id, list_transform(p, lambda t: coalesce(list_position({_VOCAB_SQL}, t), 2) - 1) AS ids FROM p)
SELECT doc_id, array_to_string(list_concat([2], ids, [3]), ' ') AS ids, array_to_string(list_transform(list_filter(ids, lambda n: n > 3), lambda n: {_VOCAB_SQL}[n + 1]), ' ') AS decoded FROM i""")
def bpe_ids(spark, d):
    """Ids of all documents between start and end marks, and back."""
    encoded = bpe.decode(bpe.encode(_docs(spark, d), STATED, bos=True, eos=True), STATED)
    return encoded.select("doc_id", F.array_join("ids", " ").alias("ids"), "decoded")


@query(f"WITH {USE_SQL} SELECT id, freq FROM f")
def piece_use(spark, d):
    return _piece_use(spark, d)


@query(f"WITH {USE_SQL} SELECT id, {_VOCAB_SQL}[id + 1] AS token, freq FROM f ORDER BY freq DESC, id LIMIT 20")
def common_pieces(spark, d):
    return bpe.top_pieces(_piece_use(spark, d), 20).join(F.broadcast(STATED.tables(spark)[0]), "id").select("id", "token", "freq")  # the stated vocabulary


@query(f"WITH {USE_SQL} SELECT id, {_VOCAB_SQL}[id + 1] AS token, freq FROM f ORDER BY freq, id LIMIT 20")
def scarce_pieces(spark, d):
    return bpe.rare_pieces(_piece_use(spark, d), 20).join(F.broadcast(STATED.tables(spark)[0]), "id").select("id", "token", "freq")  # the stated vocabulary


@query(f"""WITH {USE_SQL}, a AS (SELECT sum(freq)::BIGINT AS total, count(*)::BIGINT AS uniq FROM f),
b AS (SELECT sum(cnt) AS w, sum(cnt) FILTER (len(p) <= 1) AS w1, sum(cnt) FILTER (len(p) = 2) AS w2, sum(cnt) FILTER (len(p) >= 3) AS w3 FROM k)
SELECT {len(STATED.vocabulary.tokens)}::INTEGER AS vocab_size, total AS total_pieces, uniq AS unique_pieces, round(total / w, 6) AS pieces_per_word, round(coalesce(w1, 0) * 100 / w, 6) AS pct_1, round(coalesce(w2, 0) * 100 / w, 6) AS pct_2, round(coalesce(w3, 0) * 100 / w, 6) AS pct_3_plus FROM a, b""")
def fragmentation(spark, d):
    out = bpe.summary_of_use(bpe.use(_docs(spark, d), STATED), len(STATED.vocabulary.tokens))
    return out.select("vocab_size", "total_pieces", "unique_pieces", *(F.round(c, 6).alias(c) for c in ("pieces_per_word", "pct_1", "pct_2", "pct_3_plus")))


@query(f"WITH {PIECES_SQL}, e AS (SELECT p, cnt, unnest(range(1, len(p))) AS i FROM k) SELECT p[i] AS lhs, p[i + 1] AS rhs, sum(cnt)::BIGINT AS cnt FROM e GROUP BY ALL")
def merged_pairs(spark, d):
    return bpe.piece_pairs(_docs(spark, d), STATED)


# ---- log files, loaders, small functions ------------------------------------------------------------------------


def _stored_log(spark, d) -> str:
    """The events as log files in a new folder of the shared checkpoint folder (a local one where that is unset, as in tests)."""
    from ..sources import xlog

    xlog.register(spark)
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    folder = f"{shared.rstrip('/')}/log-{uuid.uuid4().hex}"
    xlog.to_envelopes(_log(spark, d)).write.format("xlog").mode("append").option("rotateBytes", 1 << 28).save(folder)
    return folder


@query(f"WITH {LOG} SELECT ticks, episode, step, act, round(reward::FLOAT::DOUBLE, 3) AS reward, terminal FROM log")
def xlog_scan(spark, d):
    """The log written to chunk files and read back."""
    from ..sources import xlog

    back = xlog.from_envelopes(spark.read.format("xlog").load(_stored_log(spark, d)))
    return back.select("ticks", "episode", "step", "act", F.round(F.col("reward").cast("double"), 3).alias("reward"), "terminal")


@query(f"WITH {LOG}, m AS (SELECT min(ticks) AS a, max(ticks) AS b FROM log) SELECT ticks, episode, step FROM log, m WHERE ticks BETWEEN a + (b - a) // 4 AND a + (b - a) // 2")
def xlog_time_range(spark, d):
    """Records of a time range, fetched by the offsets in the index."""
    folder = _stored_log(spark, d)
    ends = spark.read.format("fidx").load(folder).agg(F.min("ticks").alias("a"), F.max("ticks").alias("b")).first()
    a, b = (ends.a, ends.b) if ends.a is not None else (0, 0)
    found = spark.read.format("xlog").option("start", a + (b - a) // 4).option("end", a + (b - a) // 2).load(folder)
    return found.select("ticks", "episode", "step")


@query(f"WITH {LOG} SELECT ticks, greatest(0, least(65535, episode))::INTEGER AS episode, terminal::SMALLINT AS flags, round(reward::FLOAT::DOUBLE, 3) AS reward FROM log")
def fidx_scan(spark, d):
    return spark.read.format("fidx").load(_stored_log(spark, d)).select("ticks", "episode", "flags", F.round(F.col("reward").cast("double"), 3).alias("reward"))


@query(f"WITH {LOG} SELECT id, ticks FROM log WHERE id % 3 = 1")
def kind_filter(spark, d):
    kind = lambda on: F.when(on, 1).otherwise(2)
    log = _log(spark, d).withColumn("obs_kind", kind(F.col("id") % 3 != 0)).withColumn("act_kind", kind(F.col("id") % 3 != 2))
    return experience.time_range(log, 0, (1 << 63) - 1, (1, 1)).select("id", "ticks")


@query(f"WITH {LOG} SELECT id, array_to_string(list_transform(list_reverse(list(reward) OVER (ORDER BY id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)), lambda x: round(x, 6)::VARCHAR), ',') AS recent FROM log")
def global_recall4(spark, d):
    out = experience.global_recall(_log(spark, d), 4, "reward")
    return out.select("id", F.when(F.size("recent") > 0, F.array_join(F.transform("recent", lambda x: F.round(x, 6).cast("string")), ",")).alias("recent"))


@query(f"WITH {LOG} SELECT id, round(reward, 6) AS reward, round(reward, 6) AS scaled FROM log")
def raw_reward(spark, d):
    log = _log(spark, d).select("id", experience.raw_reward(F.col("reward")).alias("reward"), V.scale(F.col("obs")).alias("obs"))
    return log.select("id", F.round("reward", 6).alias("reward"), F.round(F.get("obs", F.lit(1)), 6).alias("scaled"))


@query("SELECT event_id AS id, round(sqrt(-2 * ln(((event_id * 7919) % 1000 + 1) / 1001.0::DOUBLE)) * sin(2 * pi() * (((event_id * 104729) % 997) / 997.0::DOUBLE)), 6) AS z FROM events")
def gaussian_draws(spark, d):
    i = F.col("event_id")
    u1, u2 = ((i * 7919) % 1000 + 1) / F.lit(1001.0), ((i * 104729) % 997) / F.lit(997.0)
    return table(spark, d, "events").select(i.alias("id"), F.round(V.gaussian(u1, u2), 6).alias("z"))


@query(f"WITH {HASHED} SELECT doc_id, array_to_string(list_transform(range(0, 16), lambda b: list_count(list_filter(hs, lambda x: x = b))), ' ') AS vector FROM (SELECT doc_id, list((h % 16)::INTEGER) AS hs FROM g JOIN c USING (gram) GROUP BY doc_id)")
def dense_vectors(spark, d):
    out = corpus.dense(corpus.hashed_features(_docs(spark, d), "doc_id", features=16), "doc_id", 16)
    return out.select("doc_id", F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), " ").alias("vector"))


@query(f"""WITH t AS (SELECT doc_id, {ALNUM.format("coalesce(text, '')")} AS t FROM documents UNION ALL SELECT doc_id, list_filter(string_split(lower(text), ''), lambda x: x <> '') FROM documents WHERE trim(text) <> ''),
i AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t), g AS (SELECT doc_id, t[i] AS gram FROM i UNION ALL SELECT doc_id, t[i] || t[i + 1] FROM i WHERE i < len(t)),
c AS (SELECT gram, {fnv_sql('gram')} AS h FROM (SELECT DISTINCT gram FROM g)) SELECT doc_id, (h % 1024)::INTEGER AS bucket, count(*)::BIGINT AS cnt FROM g JOIN c USING (gram) GROUP BY ALL""")
def char_features(spark, d):
    return corpus.hashed_features(_docs(spark, d), "doc_id", features=1024, chars=True)


@query("SELECT p_partkey, (list_reduce(list_concat([2166136261::BIGINT], list_transform(range(1, strlen(p_name) + 1), lambda i: ('0x' || substr(hex(encode(p_name)), (i * 2 - 1)::BIGINT, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296))::BIGINT AS hash FROM part")
def fnv_bytes(spark, d):
    return table(spark, d, "part").select("p_partkey", T.fnv_bytes(F.encode("p_name", "UTF-8")).alias("hash"))


@query(r"""SELECT doc_id, replace(replace(replace(text, '"', '""'), chr(13), '\r'), chr(10), '\n') AS safe, array_to_string(list_filter(list_transform(string_split(text, '|'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS parts FROM documents""")
def escaped_and_split(spark, d):
    return _docs(spark, d).select("doc_id", T.csv_safe(F.col("text")).alias("safe"), F.array_join(T.split_list(F.col("text")), "|").alias("parts"))


@query("""SELECT (o_orderkey % 2)::INTEGER AS target_index, o_orderstatus AS lemma, 'n' AS pos, o_custkey::VARCHAR AS gold, 'key' || o_orderkey || ' ' || o_orderstatus AS tokens
FROM orders WHERE o_orderkey % 5 > 1 AND o_orderkey % 4 < 2""")
def wsd_lines(spark, d):
    """Word-sense examples from tab-separated lines, some of them comments, blank or with a target beyond their tokens."""
    k = F.col("o_orderkey")
    target = F.when(k % 4 < 2, k % 2).otherwise(9).cast("string")
    line = F.concat_ws("\t", F.concat(F.lit("key"), k.cast("string"), F.lit("  "), F.col("o_orderstatus")), target, "o_orderstatus", F.lit(" n "), F.col("o_custkey").cast("string"))
    lines = table(spark, d, "orders").select(F.when(k % 5 == 0, F.concat(F.lit("#"), line)).when(k % 5 == 1, " ").otherwise(line).alias("value"))
    return lexicon.read_examples(lines).withColumn("tokens", F.array_join("tokens", " "))


@query("""SELECT c_mktsegment AS lemma, c_nationkey::VARCHAR AS pos, count(*)::BIGINT AS n, string_agg(c_custkey::VARCHAR, ' ' ORDER BY c_custkey) AS synsets FROM customer WHERE c_custkey % 7 <> 0 GROUP BY ALL""")
def sense_lines(spark, d):
    """A sense inventory from tab-separated lines, some of them comments."""
    row = F.concat_ws("\t", "c_mktsegment", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"), "c_name", F.lit("a | b"))
    lines = table(spark, d, "customer").select(F.col("c_custkey").alias("line_no"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("#"), row)).otherwise(row).alias("value"))
    return lexicon.read_senses(lines).select("lemma", "pos", F.size("cands").cast("long").alias("n"), F.array_join(F.transform("cands", lambda c: c["synset_id"]), " ").alias("synsets"))


@query(r"""WITH l AS (SELECT conv_id, turn, turn % 3 = 2 AS blank, role, 'w' || turn AS token FROM conversations),
s AS (SELECT *, sum(blank::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM l)
SELECT conv_id, (dense_rank() OVER (PARTITION BY conv_id ORDER BY s) - 1)::INTEGER AS sent, (row_number() OVER (PARTITION BY conv_id, s ORDER BY turn) - 1)::INTEGER AS i, token, role AS tag FROM s WHERE NOT blank""")
def pos_lines(spark, d):
    """Tagged sentences from lines, blank ones between them."""
    line = F.when(F.col("turn") % 3 == 2, "").otherwise(F.concat(F.lit("w"), F.col("turn").cast("string"), F.lit("\t"), F.col("role")))
    return tagging.read_sentences(table(spark, d, "conversations").select("conv_id", "turn", line.alias("value")), "conv_id", "turn")
