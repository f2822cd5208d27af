"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Fixed patterns find e-mail addresses, IP addresses, payment cards and telephone numbers. These are the seeds. Every other
word is a candidate. Seeds and candidates stand in lexical patterns: the two words before,
the word before with the word after, and the word before alone. Patterns and instances form a graph (distinct instances, so
copied documents count once) that is scored in rounds: a pattern's confidence in a kind is the summed score of its
instances of that kind over all its distinct instances; an unlabelled candidate gets one minus the product of the doubts of
its accepted patterns, and joins the seeds of the next round if that reaches CONFIDENT. Patterns need SUPPORT distinct
instances of the kind. Rounds end when one finds nothing new. Candidates found so become spans of their own; the fixed ones stay.

Words with a digit or an @ are read once with their contexts; they are few. A pattern's share of labelled instances among
them is an upper bound of its confidence, so most patterns end there, exactly. Only words after a word of the patterns left are
looked at, in one pass over the texts each round, and none if no pattern is left. Matches leave a text as rows (row, kind, place, gap); starts are
running sums within one text. A frequent pattern is aggregated before anything is joined, and only accepted patterns, few
of which are frequent, meet the instances again, by a join that Spark can split.

Defined results: a null text is empty, without spans. Rows that repeat a doc_id answer each for themselves. A null doc_id
stays null. No rows in, no rows out. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few, free, save

KINDS = ["email", "ip", "card", "phone"]
SUPPORT, CONFIDENT = 3, 0.8
_B = r"\x20\x09-\x0D"

#: The stated patterns. Possessive loops and a look-behind (or the end of the last match) replace retries that cannot succeed, which keeps long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: A candidate: any word, or several that make up one number.
WORD = rf"(?<![^{_B}])(?:\+[0-9][\x20().0-9-]+[0-9]|[0-9]++(?:[\x20-][0-9]++)++|[^{_B}])[^{_B}]*+"
#: The words that can be seeds: those with a digit or an @.
TOKEN = rf"(?<![^{_B}])(?:\+[0-9][\x20().0-9-]+[0-9]|[0-9]++(?:[\x20-][0-9]++)++|[^{_B}0-9@]*+[0-9@])[^{_B}]*+"
_OPEN, _CLOSE = "\"'([{<`*", "\"')]}>`*.,;:!?#$%&|"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.try_to_number(c, F.lit("9")).cast("int") * (1 + i % 2))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)) - F.when(x > 9, 9).otherwise(0))
    return total % 10 == 0


def valid(kind: Column, hit: Column) -> Column:
    """Whether a match passes its kind's further test."""
    d = _digits(hit)
    return (
        F.when(kind == "ip", hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}"))
        .when(kind == "card", F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
        .when(kind == "phone", F.length(d).between(9, 15))
        .otherwise(True)
    )


def _matches(text: Column) -> Column:
    """Per kind: matches and the lengths of what stands before each; null where the text has nothing to match."""

    def one(kind: str, pattern: str, needs: str) -> Column:
        parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.when(text.rlike(needs), F.struct(F.lit(kind).alias("kind"), hits.alias("hits"), F.transform(parts, lambda p: F.length(p)).alias("gaps")))

    return F.when(text.rlike("[0-9@]"), F.array(*(one(k, PATTERNS[k], NEEDS[k]) for k in KINDS)))


def spans_of(rows: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, more) spans (row, kind, start, end) of rows (row, found), found made by _matches, and of texts (row, text)."""
    each = rows.where("found is not null").select("row", F.explode("found").alias("f")).where("f is not null and size(f.hits) > 0")
    flat = each.select("row", "f.kind", "f.gaps", F.posexplode("f.hits").alias("i", "hit"))
    flat = flat.select("row", "kind", "i", "hit", F.get("gaps", F.col("i")).alias("gap"))
    size = F.length("hit")
    before = F.sum(F.col("gap") + size).over(W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    placed = flat.withColumn("end", before.cast("long")).withColumn("start", F.col("end") - size)
    base = placed.where(valid(F.col("kind"), F.col("hit"))).select("row", "kind", "start", "end")
    return base, _bootstrap(texts)


def _ways(last2: Column, last: Column, first: Column) -> Column:
    """The patterns of a slot: two words before it, one on either side, one before it. Null without a word before."""
    none = F.lit("")
    return F.when(last != none, F.array(F.when(last2 != none, F.concat(F.lit("2 "), last2)), F.when(first != none, F.concat(F.lit("1+1 "), last, F.lit(" _ "), first)), F.concat(F.lit("1 "), last)))


def _core(hit: Column) -> tuple[Column, Column]:
    """A word without quotes, brackets and punctuation around it, and the length of what was taken off its head."""
    headless = F.ltrim(hit, F.lit(_OPEN))
    return F.rtrim(headless, F.lit(_CLOSE)), F.length(hit) - F.length(headless)


def _tokens(texts: DataFrame) -> DataFrame:
    """Every word with a digit or an @ of texts (row, text): core, instance, last (the word before) and ways."""
    t = F.regexp_replace("text", f"[{_B}]+", " ")
    arrays = texts.where(F.col("text").rlike("[0-9@]")).select(t.alias("t")).select(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)).alias("hits"), F.split("t", TOKEN, -1).alias("gaps"))
    arrays = arrays.select("hits", F.transform("gaps", lambda g: F.substring_index(g, " ", -3)).alias("tails"), F.transform("gaps", lambda g: F.substring_index(F.ltrim(g), " ", 1)).alias("firsts"))
    none = F.array(F.lit(""))
    # Two words back lie in the gap before, or in the token, gap and token before that.
    zipped = F.arrays_zip(F.col("hits").alias("hit"), F.concat(none, none, "hits").alias("h2"), F.concat(none, "tails").alias("t1"), F.concat(none, "hits").alias("h1"), F.col("tails").alias("t0"), F.slice("firsts", 2, F.size("firsts")).alias("f1"), F.concat(F.slice("hits", 2, F.size("hits")), none).alias("n1"))
    each = arrays.select(F.explode(zipped).alias("w")).select("w.*").where("hit is not null")
    left = F.lower(F.substring_index(F.concat("h2", "t1", "h1", "t0"), " ", -3))
    core, _ = _core(F.col("hit"))
    each = each.select(core.alias("core"), F.trim(left).alias("last2"), F.substring_index(F.trim(left), " ", -1).alias("last"), F.lower(F.when(F.col("f1") != "", F.col("f1")).otherwise(F.substring_index("n1", " ", 1))).alias("first"))
    two = F.when(F.instr("last2", " ") > 0, F.col("last2"))
    return each.where("core <> ''").select("core", F.lower("core").alias("instance"), "last", _ways(two, F.col("last"), F.col("first")).alias("ways"))


def _words(texts: DataFrame) -> DataFrame:
    """Every word of texts (row, text) with its place among them, the words around it, and last, the word before."""
    none = F.lit("")
    zipped = F.arrays_zip(F.col("t").alias("hit"), F.concat(F.array(none), "t").alias("before"), F.concat(F.array(none, none), "t").alias("before2"), F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))).alias("after"))
    split = texts.select("row", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("t"))
    # A word that is several numbers has spaces inside; contexts are words of the text.
    return split.select("row", F.posexplode(zipped).alias("i", "w")).select("row", "i", "w.*").where("hit is not null").withColumn("last", F.lower(F.substring_index("before", " ", -1)))


def _in_context(words: DataFrame) -> DataFrame:
    """Adds core, head, instance and ways to words made by _words."""
    first = F.lower(F.substring_index(F.coalesce("after", F.lit("")), " ", 1))
    both = F.regexp_replace(F.trim(F.concat_ws(" ", "before2", "before")), " +", " ")
    two = F.when(F.instr("both", " ") > 0, F.lower(F.substring_index("both", " ", -2)))
    core, head = _core(F.col("hit"))
    named = words.select("row", "i", "hit", core.alias("core"), head.alias("head"), "last", both.alias("both"), first.alias("first"))
    return named.select("row", "i", "hit", "core", "head", F.lower("core").alias("instance"), "last", _ways(two, F.col("last"), F.col("first")).alias("ways")).where("core <> ''")


def _seed() -> Column:
    """The kind of a core that is a whole match of a fixed pattern."""
    seed = F.lit(None).cast("string")
    for k in KINDS[::-1]:
        seed = F.when(F.col("core").rlike("^(?:" + PATTERNS[k] + ")$") & valid(F.lit(k), F.col("core")), k).otherwise(seed)
    return F.when(F.col("core").rlike("[0-9@]"), seed)


def _bootstrap(texts: DataFrame) -> DataFrame:
    """Spans (row, kind, start, end) of words of texts (row, text) that high-confidence patterns find."""
    words = _words(texts)
    seen = _tokens(texts).withColumn("seed", _seed())
    marks = save(seen.select("instance", "seed", "last", F.explode_outer("ways").alias("way")).groupBy("instance", "last", "way").agg(F.max("seed").alias("seed")), "marks")
    known = save(marks.where("seed is not null").groupBy("instance").agg(F.max("seed").alias("kind"), F.lit(1.0).alias("score")), "known")
    marks = marks.where("way is not null").select("instance", "last", "way")
    found = None
    while True:
        # The instances met so far are a part of those in a pattern's slot, so a pattern whose share among them is too low can be left out before the texts are read.
        labelled = marks.join(known, "instance", "left")
        by_way = labelled.groupBy("way", "last").agg(F.count(F.lit(1)).alias("n"))
        support = labelled.where("kind is not null").groupBy("way", "kind").agg(F.sum("score").alias("right"), F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= SUPPORT)
        strong = save(support.join(by_way, "way").where(F.col("right") >= CONFIDENT * F.col("n")).select("way", "last").distinct(), "strong")
        n = strong.count()
        if not n:
            break
        in_slots = _in_context(words.join(few(strong.select("last").distinct(), n), "last", "left_semi"))
        slots = in_slots.select("instance", F.explode_outer("ways").alias("way")).join(few(strong.select("way"), n), "way", "left_semi").distinct()
        graph = save(slots.join(known, "instance", "left"), "graph")
        total = graph.groupBy("way").agg(F.count(F.lit(1)).alias("n"))
        of_kind = graph.where("kind is not null").groupBy("way", "kind").agg(F.sum("score").alias("right"), F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= SUPPORT)
        good = save(of_kind.join(total, "way").withColumn("trust", F.col("right") / F.col("n")).where(F.col("trust") >= CONFIDENT).select("way", F.col("kind").alias("guess"), "trust"), "good")
        met = graph.where("kind is null").join(good, "way").groupBy("instance", "guess").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("trust")))))).alias("belief"))
        best = met.where(F.col("belief") >= CONFIDENT).groupBy("instance").agg(F.max_by("guess", F.struct("belief", "guess")).alias("kind"), F.max("belief").alias("score"))
        new = save(best, "new")
        if new.isEmpty():
            break
        found = new.select("instance", "kind") if found is None else found.unionByName(new.select("instance", "kind"))
        known = known.unionByName(new)
        more = _in_context(words).join(few(new.select("instance"), new.count()), "instance", "left_semi").where("ways is not null").select("instance", "last", F.explode("ways").alias("way"))
        marks = save(marks.unionByName(more).where("way is not null").distinct(), "marks")
    if found is None:
        return marks.sparkSession.createDataFrame([], "row long, kind string, start long, end long")
    hits = save(_in_context(words).join(few(found, found.count()), "instance").withColumn("seed", _seed()).where("seed is null").select("row", "i", "head", F.length("core").alias("size"), "kind"), "hits")
    some = hits.select("row").distinct()
    lengths = F.arrays_zip(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda x: F.length(x)).alias("size"), F.transform(F.split("text", WORD, -1), lambda x: F.length(x)).alias("gap"))
    each = texts.join(few(some, some.count()), "row", "left_semi").select("row", F.posexplode(lengths).alias("i", "l")).where("l.size is not null")
    begin = F.sum(F.col("l.gap") + F.col("l.size")).over(W.partitionBy("row").orderBy("i").rowsBetween(W.unboundedPreceding, 0)) - F.col("l.size")
    start = F.col("begin") + F.col("head")
    return each.select("row", "i", begin.cast("long").alias("begin")).join(hits, ["row", "i"]).select("row", "kind", start.alias("start"), (start + F.col("size")).alias("end"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _by_row(base: DataFrame, more: DataFrame) -> DataFrame:
    """row, base and all: sorted arrays of (start, order, end); spans found by context that touch a fixed one are left out."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("order"), "end")
    both = base.withColumn("fixed", F.lit(True)).unionByName(more.distinct().withColumn("fixed", F.lit(False)))
    grouped = both.groupBy("row").agg(F.collect_list(F.when(F.col("fixed"), span)).alias("base"), F.collect_list(F.when(~F.col("fixed"), span)).alias("more"))  # one text's spans
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return grouped.select("row", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", free)).alias("all"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans for every row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = save(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")), "texts")
    rows = save(texts.select("row", "doc_id", _matches(F.col("text")).alias("found")), "matches")
    grouped = _by_row(*spans_of(rows.select("row", "found"), texts.select("row", "text")))
    out = rows.select("row", "doc_id").join(grouped, "row", "left")
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint>>")
    base, every = F.coalesce("base", none), F.coalesce("all", none)
    of = lambda n: F.size(F.filter(base, lambda s: s["order"] == n)).cast("long")
    counts = [of(n).alias(f"n_{k}") for n, k in enumerate(KINDS, 1)]
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets, overlapping ones by the first's; all columns stay, n_chars follows the text.

    Null texts stay null, empty tables empty; rows that repeat a doc_id answer each for themselves; columns of any further name are carried through.
    """
    row, cut = free("_row", docs.columns), free("_cuts", docs.columns)
    kept = save(docs.withColumn(row, F.monotonically_increasing_id()), "texts")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    matches = save(kept.where(F.col("text").rlike("[0-9@]")).select(F.col(row).alias("row"), _matches(text).alias("found")), "matches")
    spans = save(_by_row(*spans_of(matches, kept.select(F.col(row).alias("row"), text.alias("text")))).select("row", F.explode("all").alias("s")).select("row", "s.*"), "spans")
    by = W.partitionBy("row").orderBy("start", "order", "end")
    reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("order", F.struct("start", "order", "end")).alias("order"))
    cuts = save(merged.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("start", "end", "order"))).alias(cut)), "cuts")
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    slice_ = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    zero = F.lit(0).cast("long")
    pieces = F.transform(cut, lambda c, i: F.concat(slice_(F.coalesce(F.get(cut, i - 1)["end"], zero), c["start"]), F.element_at(marks, c["order"])))
    rest = F.substring(F.col("text"), (F.element_at(cut, -1)["end"] + 1).cast("int"), F.length("text"))
    clean = F.when(F.col(cut).isNotNull(), F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text"))
    out = kept.join(few(cuts, cuts.count()), row, "left").withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
