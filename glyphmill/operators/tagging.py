"""Token tagging: sentences from lines, windowed hashed features, softmax classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from ..functions import text as T

PAD_TOKEN = "<PAD>"


def read_sentences(lines: DataFrame, block: str, order: str) -> DataFrame:
    """(block, sent, i, token, tag) from numbered lines `TOKEN<tab>TAG`: a blank line ends a sentence, lines without a tab behind a first character are skipped. block: a column of which sentences never cross values, such as the file."""
    w = W.partitionBy(block).orderBy(order)
    blank = T.is_blank(F.col("value")).cast("int")
    marked = lines.withColumn("_s", F.sum(blank).over(w.rowsBetween(W.unboundedPreceding, 0))).where((blank == 0) & (F.instr("value", "\t") > 1))
    cut = F.instr("value", "\t")
    rows = marked.select(block, F.col("_s"), order, F.expr("substring(value, 1, instr(value, '\t') - 1)").alias("token"), F.substring(F.col("value"), cut + 1, F.length("value")).alias("tag"))
    return rows.withColumn("sent", F.dense_rank().over(W.partitionBy(block).orderBy("_s")) - 1).withColumn("i", F.row_number().over(W.partitionBy(block, "_s").orderBy(order)) - 1).select(block, "sent", "i", "token", "tag")


def tag_ids(tokens: DataFrame, order: list[str], tag: str = "tag") -> DataFrame:
    """(tag, tag_id): ids from 0 in order of first appearance."""
    first = tokens.groupBy(tag).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(tag, (F.row_number().over(W.orderBy("first", tag)) - 1).cast("int").alias("tag_id"))  # one row a tag


def windows(tokens: DataFrame, sentence: str = "sent_id", order: str = "i", reach: int = 2) -> DataFrame:
    """Adds `slots`: the tokens reach before to reach behind, <PAD> outside the sentence."""
    w = W.partitionBy(sentence).orderBy(order)
    at = lambda k: F.lag("token", -k, PAD_TOKEN).over(w) if k < 0 else F.col("token") if k == 0 else F.lead("token", k, PAD_TOKEN).over(w)
    return tokens.withColumn("slots", F.array(*(at(k) for k in range(-reach, reach + 1))))


def features(tokens: DataFrame, keys: list[str], per_slot: int = 512, reach: int = 2) -> DataFrame:
    """(keys, f, cnt): hashed word uni- and bigrams of every slot in the slot's own range, and a bias at the end."""
    per_slot = max(32, per_slot)
    slots = windows(tokens, keys[0], keys[1], reach).select(*keys, F.posexplode("slots").alias("slot", "word"))
    each = slots.select(*keys, "slot", F.explode(T.grams(T.alnum_tokens(F.col("word")), 1, 2, "")).alias("g"))
    hashed = each.select(*keys, (F.col("slot") * per_slot + T.bucket(F.col("g"), per_slot)).alias("f"))
    bias = tokens.select(*keys, F.lit((2 * reach + 1) * per_slot).alias("f"))
    return hashed.unionByName(bias).groupBy(*keys, "f").agg(F.count(F.lit(1)).alias("cnt"))


class Softmax:
    """A linear softmax classifier over sparse (feature, count) rows."""

    def __init__(self, dim: int, classes: int, seed: int = 123) -> None:
        self.weights = (np.random.default_rng(seed).random((classes, dim)) * 2 - 1) * 0.01 / np.sqrt(dim)
        self.bias = np.zeros(classes)

    def probabilities(self, f: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = self.weights[:, f] @ x + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    def step(self, f: np.ndarray, x: np.ndarray, y: int, rate: float = 0.05) -> float:
        p = self.probabilities(f, x)
        loss = -np.log(max(1e-8, p[y]))
        p[y] -= 1
        self.bias -= rate * p
        self.weights[:, f] -= rate * np.outer(p, x)
        return float(loss)


def gather(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f, x): each row's features as two arrays."""
    return features.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("f", "cnt"))).alias("v")).select(*keys, F.transform("v", lambda v: v["f"]).alias("f"), F.transform("v", lambda v: v["cnt"].cast("double")).alias("x"))


def train(rows: DataFrame, dim: int, classes: int, order: list[str], epochs: int = 3, rate: float = 0.05, seed: int = 123) -> tuple[Softmax, list[dict]]:
    """Stochastic gradient descent in row order on a training table that fits the driver; returns the model and loss and accuracy by epoch."""
    model, history = Softmax(dim, classes, seed), []
    data = [(np.array(r.f), np.array(r.x), r.y) for r in rows.select("f", "x", "y", *order).orderBy(*order).toLocalIterator()]
    for _ in range(epochs):
        losses = [model.step(f, x, y, rate) for f, x, y in data]
        right = [int(model.probabilities(f, x).argmax() == y) for f, x, y in data]
        history.append({"loss": float(np.mean(losses)) if data else 0.0, "accuracy": float(np.mean(right)) if data else 0.0})
    return model, history


def predict(rows: DataFrame, model: Softmax) -> DataFrame:
    """Adds `pred` and `p_gold` (chance of y, null without y)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    has = "y" in rows.columns

    def run(batches):
        for pdf in batches:
            p = [shared.value.probabilities(np.asarray(f, int), np.asarray(x)) for f, x in zip(pdf["f"], pdf["x"])]
            gold = [float(q[int(y)]) if has and not pd.isna(y) else None for q, y in zip(p, pdf["y"] if has else [None] * len(p))]
            yield pdf.assign(pred=[int(q.argmax()) for q in p], p_gold=gold)

    return rows.mapInPandas(run, StructType(list(rows.schema)).add("pred", IntegerType()).add("p_gold", DoubleType()))


def accuracy(rows: DataFrame, gold: str, pred: str, p: str) -> DataFrame:
    """One row: n, accuracy and mean loss, 0 without rows."""
    loss = -F.log(F.greatest(F.lit(1e-8), F.col(p)))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg((F.col(gold) == F.col(pred)).cast("double")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss"))
