"""Quality rules as weak supervision, in DataFrame functions alone.

Each rule looks at one statistic of a text and votes to keep it (1), to drop it (0), or abstains. A two-class model with one
probability of each rule's voting keep or drop per class (conditionally independent, abstention says nothing) is fitted by
expectation-maximisation to the votes of all documents, without labels; the posterior probability of good quality then
replaces all-must-pass filtering.

One pass over the texts computes the statistics and votes; they are written as a small table. The fit needs only how often
each combination of votes occurs: at most 3^rules rows whatever the corpus, summed with partial aggregates. The posterior is
an expression over the vote columns, so nothing is joined and nothing is shuffled but those counts.

Defined results: a null, empty or blank text has all counts 0, base_failed true and kept false. Rows that repeat a doc_id
answer each for themselves. No rows in: the model stays at its priors; no rows out. Further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, save

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
WINDOW = 5
ROUNDS = 30

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"

#: (name, numerator, denominator, drop at or beyond, keep at or within, starting accuracy): a rule votes drop if numerator >= drop / 1000 * denominator, keep if numerator <= keep / 1000 * denominator, else it abstains; None: it never votes so.
RULES = [
    ("symbols", "n_symbols", "n_words", 100, None, 0.95),
    ("repeats", "n_repeat_words", "n_words", 200, None, 0.95),
    ("dup_lines", "n_dup_lines", "n_lines", 300, None, 0.9),
    ("capitals", "n_upper", "word_chars", 300, None, 0.95),
    ("exclaims", "n_exclaims", "n_words", 150, None, 0.95),
    ("marks", "n_marks", "word_chars", 100, 60, 0.85),
    ("variety", "n_words_again", "n_words", 900, None, 0.9),
    ("plain", "(n_symbols + n_exclaims)", "n_words", None, 20, 0.75),
]
#: Bounds of the mean word length, in hundredths of characters: beyond them that rule votes drop.
LENGTH = (200, 1800)
NAMES = [r[0] for r in RULES] + ["word_length"]
ACCURACY = [r[5] for r in RULES] + [0.9]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Starting belief in the share of good documents, and how many documents that belief and each starting accuracy weigh.
PRIOR, WEIGHT = 0.8, 10.0


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more.

    Windows are compared by a 64-bit hash. Without equal hashes the answer is 0 after one set; otherwise the sorted
    (hash, place) pairs give the places of repeated windows, and each place covers the words up to the next, WINDOW at most.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(WINDOW))))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(pairs, lambda p: F.array_sort(F.transform(F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"])), lambda x: x["i"])))
        gaps = let(places, lambda a: F.aggregate(F.transform(a, lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get(a, i + 1) - x), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x))
        return gaps

    some = let(let(hashes, windows), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) < WINDOW + 1, 0).otherwise(some)


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns named, and the counts of each text."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", *more, t.alias("_text"))
    split = lambda c, p: F.filter(F.split(c, p), lambda x: x != "")
    found = base.select(
        "doc_id",
        *more,
        let(split(F.col("_text"), r"[\x20\x09-\x0D]+"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"), (F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_words_again"))).alias("w"),
        let(F.filter(F.split("_text", "\n"), lambda x: F.translate(x, BLANKS, "") != ""), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        (F.length("_text") - _without(F.col("_text"), BLANKS)).cast("long").alias("word_chars"),
        _without(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        _without(F.col("_text"), UPPER).cast("long").alias("n_upper"),
        _without(F.col("_text"), "!").cast("long").alias("n_exclaims"),
        _without(F.col("_text"), MARKS).cast("long").alias("n_marks"),
    )
    return found.select("doc_id", *more, "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_exclaims", "n_marks")


def votes(counts: DataFrame) -> DataFrame:
    """Adds a column v_<rule> with 1 (keep), 0 (drop) or null (abstains); texts without words get no votes."""
    out = counts
    for name, a, b, drop, keep, _ in RULES:
        vote = F.when(F.col("n_words") == 0, None)
        if drop is not None:
            vote = vote.when(F.expr(a) * 1000 >= F.col(b) * drop, 0)
        if keep is not None:
            vote = vote.when(F.expr(a) * 1000 <= F.col(b) * keep, 1)
        out = out.withColumn(f"v_{name}", vote)
    mean, (low, high) = F.col("word_chars") * 100, LENGTH
    return out.withColumn("v_word_length", F.when((F.col("n_words") > 0) & ((mean < F.col("n_words") * low) | (mean > F.col("n_words") * high)), 0))


def fit(patterns: list[tuple[tuple[int | None, ...], int]]) -> tuple[float, list[float]]:
    """(share of good documents, accuracy of each rule) by expectation-maximisation over how often each combination of votes occurs."""
    share, right = PRIOR, list(ACCURACY)
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        good, agree, cast = 0.0, [0.0] * len(NAMES), [0] * len(NAMES)
        for pattern, n in patterns:
            p = posterior(share, right, pattern)
            good += n * p
            for i, v in enumerate(pattern):
                if v is not None:
                    agree[i] += n * (p if v else 1 - p)
                    cast[i] += n
        share = min(max((good + WEIGHT * PRIOR) / (total + WEIGHT), 0.01), 0.99)
        right = [min(max((x + WEIGHT * start) / (n + WEIGHT), 0.01), 0.99) for x, n, start in zip(agree, cast, ACCURACY)]
    return share, right


def posterior(share: float, right: list[float], pattern: tuple[int | None, ...]) -> float:
    odds = math.log(share / (1 - share))
    for a, v in zip(right, pattern):
        if v is not None:
            odds += math.log(a / (1 - a)) * (1 if v else -1)
    return 1 / (1 + math.exp(-odds))


def weak_supervision(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the posterior (6 decimals) for every row of docs (doc_id, text)."""
    return judged(save(votes(statistics(docs)), "votes")).select("doc_id", *COUNTS, "base_failed", "kept", "quality")


def judged(scored: DataFrame) -> DataFrame:
    """Adds base_failed, kept and quality to rows with votes, by a model of all of them."""
    names = [f"v_{n}" for n in NAMES]
    rows = scored.where("n_words > 0").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3^rules rows
    share, right = fit(sorted(((tuple(r[:-1]), r[-1]) for r in rows), key=str))
    odds = F.lit(math.log(share / (1 - share)))
    for name, a in zip(names, right):
        weight = math.log(a / (1 - a))
        odds = odds + F.when(F.col(name) == 1, weight).when(F.col(name) == 0, -weight).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    p = 1 / (1 + F.exp(-odds))
    return scored.select("*", failed.alias("base_failed"), (~failed & (p >= 0.5)).alias("kept"), F.round(F.when(F.col("n_words") > 0, p).otherwise(0.0), 6).alias("quality"))


def select_quality(docs: DataFrame) -> DataFrame:
    """Rows of docs, unchanged, that the rules keep: one pass over the texts, written with their votes."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    return judged(save(votes(statistics(row, "_row")), "votes")).where("kept").select("_row.*")


def sql() -> str:
    """The same in DuckDB's SQL, the fit as one recursive step a round."""
    v = [f"v_{n}" for n in NAMES]
    odds = " + ".join(["ln(s / (1 - s))"] + [f"CASE {c} WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END * ln(a[{i + 1}] / (1 - a[{i + 1}]))" for i, c in enumerate(v)])
    p = f"1 / (1 + exp(-({odds})))"
    clip = lambda x: f"least(greatest({x}, 0.01::DOUBLE), 0.99::DOUBLE)"
    rates = ", ".join(clip(f"(sum(n * CASE {c} WHEN 1 THEN p WHEN 0 THEN 1 - p ELSE 0 END) + {WEIGHT * start}::DOUBLE) / (sum(CASE WHEN {c} IS NOT NULL THEN n ELSE 0 END) + {WEIGHT})") for c, start in zip(v, ACCURACY))
    rules = ", ".join(f"CASE WHEN n_words = 0 THEN NULL" + (f" WHEN {x} * 1000 >= {y} * {drop} THEN 0" if drop is not None else "") + (f" WHEN {x} * 1000 <= {y} * {keep} THEN 1" if keep is not None else "") + f" END AS v_{n}" for n, x, y, drop, keep, _ in RULES)
    low, high = LENGTH
    without = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: translate(x, {blanks}, '') <> '') AS ls FROM d
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)
), again AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest(range(0, {WINDOW})) AS j) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(covered.n, 0) AS n_repeat_words, len(ws) - len(list_distinct(ws)) AS n_words_again,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, length(translate(t, {blanks}, '')) AS word_chars,
    {without(SYMBOLS)} AS n_symbols, {without(UPPER)} AS n_upper, {without("!")} AS n_exclaims, {without(MARKS.replace("'", "''"))} AS n_marks
  FROM w LEFT JOIN covered USING (doc_id)
), r AS (
  SELECT *, {rules},
    CASE WHEN n_words > 0 AND (word_chars * 100 < n_words * {low} OR word_chars * 100 > n_words * {high}) THEN 0 END AS v_word_length
  FROM c
), y AS (
  SELECT {", ".join(v)}, count(*) AS n FROM r WHERE n_words > 0 GROUP BY ALL
), m(round, s, a) AS (
  SELECT 0, {PRIOR}::DOUBLE, [{", ".join(f"{x}::DOUBLE" for x in ACCURACY)}]
  UNION ALL
  SELECT round + 1, {clip(f"(sum(n * p) + {WEIGHT * PRIOR}::DOUBLE) / (sum(n) + {WEIGHT})")}, [{rates}]
  FROM (SELECT m.round, y.*, {p} AS p FROM m, y WHERE m.round < {ROUNDS}) GROUP BY round
), z AS (
  SELECT r.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {p} AS p
  FROM r, (SELECT s, a FROM m ORDER BY round DESC LIMIT 1)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(CASE WHEN n_words > 0 THEN p ELSE 0 END, 6) AS quality
FROM z
"""
