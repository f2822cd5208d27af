"""N-gram language model as tables: counts, continuation statistics, interpolated probabilities, perplexity, sampling.

Middle orders use raw counts; only the unigram level uses continuation counts, pooled over all orders from two. An unseen
context at the top gives probability 0 (unseen="zero") or backs off (unseen="backoff"). Contexts are keyed by their joined
tokens; the joins are equi-joins on those keys, so Spark deals them out and splits skewed ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.batches import gram_blobs, gram_sums, gram_totals, level_blobs, level_sums

NO_TOKENS, NEW_TOKEN, FLOOR = 1e-8, 1e-10, 1e-12
#: Bytes of input for one part of its n-grams, and the most parts.
PART_BYTES, MOST_PARTS = 4 << 20, 8192
#: Contexts that next_tokens collects.
FEW = 1000


def counts(sequences: DataFrame, order: int = 3, tokens: str = "tokens", least: int = 1, only: list[str] | None = None) -> DataFrame:
    """(n, ctx, tok, cnt) of every n-gram, n = least..order, of padded token sequences: token lists, or texts that are split in
    the worker. The workers count within runs; what is shuffled are compressed parts, dealt by a hash of the whole gram, each
    small enough to be summed in a worker. only: just what concerns these contexts."""
    if not 1 <= order <= 5:
        raise ValueError("order must be 1 to 5")
    dealt = partial(gram_blobs, order=order, least=least, parts=_parts(sequences), only=only)
    each = sequences.select(tokens).mapInArrow(dealt, "part int, size int, blob binary")
    return each.repartition("part").sortWithinPartitions("part").mapInArrow(gram_sums, "n int, ctx string, tok string, cnt long")


def _parts(df: DataFrame) -> int:
    """Parts for the grams of df by the bytes of what it reads; many where that is not known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    return max(1, min(-(-size // PART_BYTES), MOST_PARTS)) if size < 1 << 50 else 1024


def totals(grams: DataFrame) -> DataFrame:
    return grams.groupBy("n").agg(F.sum("cnt").alias("total"))


def total_grams(sequences: DataFrame, order: int = 3, tokens: str = "tokens") -> DataFrame:
    """What totals(counts(...)) gives, from the sequences' lengths alone."""
    if not 1 <= order <= 5:
        raise ValueError("order must be 1 to 5")
    each = sequences.select(tokens).mapInArrow(partial(gram_totals, order=order), "n int, cnt long")
    return totals(each)


def preceding(grams: DataFrame) -> DataFrame:
    """(tok, contexts): distinct contexts of each token, pooled over n >= 2."""
    return grams.where("n >= 2").groupBy("tok").agg(F.count(F.lit(1)).alias("contexts"))


def following(grams: DataFrame) -> DataFrame:
    """(n, ctx, followers, cnt): distinct followers and occurrences of each context of n - 1 tokens."""
    return grams.where("n >= 2").groupBy("n", "ctx").agg(F.count(F.lit(1)).alias("followers"))


@dataclass
class Model:
    """A fitted model: its n-gram table, order and discount; the sequences and their column where it was fitted here."""

    grams: DataFrame
    order: int
    discount: float = 0.75
    source: tuple[DataFrame, str] | None = None

    @classmethod
    def fit(cls, sequences: DataFrame, order: int = 3, discount: float = 0.75, tokens: str = "tokens") -> Model:
        """Counts when it is asked: what scores whole sequences goes over these sequences again, so no table is kept."""
        return cls(counts(sequences, order, tokens), order, discount, (sequences, tokens))

    def release(self) -> None:
        self.grams.unpersist()

    def save(self, path: str) -> None:
        """Writes the n-gram table, partitioned by n, with the settings in its columns."""
        self.grams.withColumns({"order": F.lit(self.order), "discount": F.lit(self.discount)}).write.mode("overwrite").partitionBy("n").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Model:
        table = spark.read.parquet(path)
        first = table.select("order", "discount").first()
        return cls(table.select("n", "ctx", "tok", "cnt"), first["order"], first["discount"])

    def probabilities(self, events: DataFrame, unseen: str = "zero", grams: DataFrame | None = None, pre: DataFrame | None = None) -> DataFrame:
        """Adds `p` to events (context array of order - 1 tokens, tok): chained joins from the unigram level up. grams: the part of
        the model's that concerns the contexts of events; pre: what preceding(all of them) gives."""
        grams, pre = self.grams if grams is None else grams, preceding(self.grams) if pre is None else pre
        whole = pre.agg(F.sum("contexts").alias("whole"))
        out = events.join(pre, "tok", "left").crossJoin(F.broadcast(whole))  # one row
        out = out.withColumn("p", F.when(F.coalesce("whole", F.lit(0)) == 0, NO_TOKENS).otherwise(F.coalesce(F.col("contexts") / F.col("whole"), F.lit(NEW_TOKEN)))).drop("contexts", "whole")
        for n in range(2, self.order + 1):
            ctx = F.array_join(F.slice("context", -(n - 1), n - 1), " ")
            seen = grams.where(F.col("n") == n).select("ctx", "tok", F.col("cnt").alias("c"))
            follow = following(grams.where(F.col("n") == n)).select("ctx", "followers")
            # a context's own count as an n-gram, as its last token with the rest before it
            joined = F.when(F.col("ctx") == "", F.col("tok")).otherwise(F.concat_ws(" ", "ctx", "tok"))
            own = grams.where(F.col("n") == n - 1).select(joined.alias("ctx"), F.col("cnt").alias("cc"))
            out = out.withColumn("ctx", ctx).join(seen, ["ctx", "tok"], "left").join(follow, "ctx", "left").join(own, "ctx", "left")
            known = F.greatest(F.coalesce("c", F.lit(0)) - self.discount, F.lit(0.0)) / F.col("cc") + self.discount * F.coalesce("followers", F.lit(0)) / F.col("cc") * F.col("p")
            out = out.withColumn("p", F.when(F.col("cc").isNotNull(), known).otherwise(F.lit(0.0) if unseen == "zero" else F.col("p"))).drop("ctx", "c", "followers", "cc")
        return out

    def events(self, sequences: DataFrame, tokens: str = "tokens") -> DataFrame:
        """(context, tok, times) of all predicted places of sequences, equal ones counted together."""
        k = self.order - 1
        if isinstance(sequences.schema[tokens].dataType, StringType):
            sequences = sequences.select(T.split_words(T.normalize(F.col(tokens))).alias(tokens))
        each = T.let(T.padded(F.col(tokens), self.order), lambda s: F.transform(F.sequence(F.lit(self.order), F.size(s)), lambda i: F.struct(F.slice(s, i - k, F.lit(k)).alias("context"), F.element_at(s, i).alias("tok"))))
        return sequences.select(F.explode(each).alias("e")).groupBy("e.context", "e.tok").agg(F.count(F.lit(1)).alias("times"))

    def scored(self, sequences: DataFrame, unseen: str = "zero", tokens: str = "tokens") -> DataFrame:
        """(ctx, tok, times, p) of all predicted places of sequences, the context's tokens joined. A fitted model and the places are
        dealt by context, so that counts, followers and the context's own count need no joins; each level joins the one below once."""
        if self.source is None or self.order == 1:
            found = self.probabilities(self.events(sequences, tokens), unseen)
            return found.select(F.array_join("context", " ").alias("ctx"), "tok", "times", "p")
        source, column = self.source
        parts, kind = _parts(source), "part int, size int, blob binary"
        same = column == tokens and source.sameSemantics(sequences)  # then the model's own n-grams are the places
        blobs = source.select(column).mapInArrow(partial(level_blobs, order=self.order, parts=parts, events=False), kind)
        if not same:
            blobs = blobs.unionByName(sequences.select(tokens).mapInArrow(partial(level_blobs, order=self.order, parts=parts, events=True), kind))
        dealt = blobs.repartition("part").sortWithinPartitions("part")
        level = lambda n: dealt.mapInArrow(partial(level_sums, level=n, events=not same), "ctx string, tok string, times long, c long, followers long, cc long")
        pre = level(0).groupBy("tok").agg(F.sum("times").alias("contexts"))
        whole = pre.agg(F.sum("contexts").alias("whole"))
        base = F.when(F.coalesce("whole", F.lit(0)) == 0, NO_TOKENS).otherwise(F.coalesce(F.col("contexts") / F.col("whole"), F.lit(NEW_TOKEN)))
        below = pre.select(F.lit("").alias("_ctx"), F.col("tok").alias("_tok"), "contexts")
        for n in range(2, self.order + 1):
            rows = level(n)
            if n == 2:
                out = rows.join(below, F.col("tok") == F.col("_tok"), "left").crossJoin(F.broadcast(whole)).withColumn("p", base).drop("_ctx", "_tok", "contexts", "whole")  # one row
            else:
                out = rows.join(below, (F.expr("substr(ctx, instr(ctx, ' ') + 1)") == F.col("_ctx")) & (F.col("tok") == F.col("_tok")), "left").drop("_ctx", "_tok")
            known = F.greatest(F.col("c") - self.discount, F.lit(0.0)) / F.col("cc") + self.discount * F.col("followers") / F.col("cc") * F.col("p")
            out = out.withColumn("p", F.when(F.col("cc") > 0, known).otherwise(F.lit(0.0) if unseen == "zero" else F.col("p")))
            below = out.select(F.col("ctx").alias("_ctx"), F.col("tok").alias("_tok"), "p")
        return out.select("ctx", "tok", "times", "p")

    def perplexity(self, sequences: DataFrame, unseen: str = "zero", tokens: str = "tokens") -> DataFrame:
        """One row: n_tokens and perplexity (infinite without tokens)."""
        scored = self.scored(sequences, unseen, tokens)
        bits = F.sum(-F.log2(F.greatest("p", F.lit(FLOOR))) * F.col("times"))
        n = F.coalesce(F.sum("times"), F.lit(0))
        return scored.agg(n.alias("n_tokens"), F.when(n == 0, float("inf")).otherwise(F.pow(F.lit(2.0), bits / n)).alias("perplexity"))

    def next_tokens(self, contexts: DataFrame, specials: bool = True) -> DataFrame:
        """(context, tok, p) over the continuation vocabulary for each context; specials=False leaves the start mark out. For up to
        FEW contexts only what concerns them is counted."""
        grams, pre, contexts = self.grams, preceding(self.grams), contexts.distinct()
        if self.source is not None and len(few := contexts.limit(FEW + 1).collect()) <= FEW:
            source, column = self.source
            tails = {" ".join(r.context[-k:]) for r in few for k in range(1, self.order) if r.context}
            grams = counts(source, self.order, column, only=sorted(tails))
            pre = preceding(counts(source, self.order, column, least=2)).persist()  # a row a token, read as vocabulary, base and sum
        vocabulary = pre.select("tok")
        if not specials:
            vocabulary = vocabulary.where("tok <> '<s>'")
        return self.probabilities(contexts.crossJoin(vocabulary), "zero", grams, pre)  # the stated contexts, each against the vocabulary: that is the result's size

    def generate(self, spark, prompt: list[str], most: int = 20, seed: int = 42, specials: bool = False) -> list[str]:
        """Continues a prompt by drawing from next_tokens until the end mark; the draw is the first token whose running share reaches u."""
        import random

        self.grams.persist()  # until release()
        rng, out = random.Random(seed), list(prompt)
        k = self.order - 1
        for _ in range(most):
            context = (["<s>"] * k + out)[len(out) :] if k else []
            rows = Model(self.grams, self.order, self.discount).next_tokens(spark.createDataFrame([(context,)], "context array<string>"), specials).select("tok", "p").where("p > 0").orderBy("tok").collect()
            if not rows:
                break
            u, run = rng.random() * sum(r.p for r in rows), 0.0
            tok = rows[-1].tok
            for r in rows:
                run += r.p
                if run >= u:
                    tok = r.tok
                    break
            if tok == "</s>":
                break
            out.append(tok)
        return out
