"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages (of WORDS words each; the whole text is covered). Every passage is encoded from counts of
character classes and of pairs of neighbouring classes, repeated words and word lengths by a small learned network; a gated
attention (tanh times sigmoid) weighs the passages, and the weighted representation is scored. Weights and encoder are
learned together from document labels alone.

Training uses about SAMPLE labelled documents of each class (at most twice that, also where ids repeat), up to PASSAGES passages
of each, on the driver; the true class shares, counted over all labels, set the offset of the score. Scoring is one pass over the texts without a shuffle.

Defined results: a null, empty or blank text is one passage without words and is scored like any other text. A very long
text is a bag of as many passages as it has. Equal texts get equal scores. Rows that repeat a doc_id answer each for themselves. A null doc_id counts as not held out and gets a score. Without labels of both classes every score is 0.5.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_mod, word_hashes
from .sampling import first_rows, sample_ids

WORDS = 64
SAMPLE = 2000
#: Passages of one text that training looks at; a longer one (16,384 words) is sampled evenly from begin to end.
PASSAGES = 256
HIDDEN, GATE = 32, 16
EPOCHS = 60

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".", ",;:", "!", "?", "'\"()[]{}", "|", "#*$%&", "<>=/\\^_`~+@", "-"]
CLASSES = len(_GROUPS) + 1
_CLASS = np.full(256, CLASSES - 1, np.uint8)
for _i, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _i
WIDTH = CLASSES * CLASSES + CLASSES + 4


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts (rows in order), and each passage's text number."""
    h, doc = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    bags = np.maximum(1, -(-n // WORDS))
    first = np.concatenate(([0], np.cumsum(bags)))
    within = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    of_word = first[doc] + within // WORDS
    total = int(first[-1])
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    cls = _CLASS[buf].astype(np.int64)
    blank = (cls == 3) | (cls == 4)
    starts = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)) == -1)
    # each byte belongs to the passage of the last word that began before it, or to its text's first passage
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    mark = np.full(len(buf), -1, np.int64)
    mark[begins] = first[:-1]
    mark[starts] = of_word
    at = np.maximum.accumulate(mark)
    inside = np.ones(len(buf) - 1, bool)
    inside[begins[1:] - 1] = False  # no pair reaches into the next text
    pairs = np.bincount((at[:-1] * (CLASSES * CLASSES) + cls[:-1] * CLASSES + cls[1:])[inside], minlength=total * CLASSES * CLASSES).reshape(total, -1).astype(np.float32)
    single = np.bincount(at * CLASSES + cls, minlength=total * CLASSES).reshape(total, -1).astype(np.float32)
    length = single.sum(axis=1, keepdims=True)
    count = np.bincount(of_word, minlength=total).astype(np.float32)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((h, of_word))
    dup = (h[order][1:] == h[order][:-1]) & (of_word[order][1:] == of_word[order][:-1])
    again = np.bincount(of_word[order][1:][dup], minlength=total) / np.maximum(count, 1)
    repeat = np.bincount(of_word[same], minlength=total) / np.maximum(count, 1)
    letters = (length[:, 0] - single[:, 3] - single[:, 4]) / np.maximum(count, 1) / 10
    extra = np.stack((repeat, again, np.minimum(letters, 10), np.log1p(count) / 5), axis=1)
    x = np.concatenate((np.sqrt(pairs / np.maximum(length, 1)), np.sqrt(single / np.maximum(length, 1)), extra), axis=1)
    return x.astype(np.float32), np.repeat(np.arange(len(texts)), bags)


class Model:
    """Encoder W, b; gates V, U; attention w; classifier c, d; feature mean and scale; prior correction."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE, 1), "c": draw(HIDDEN, 1), "d": np.zeros(1, np.float32)}
        self.mean, self.scale, self.shift = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), 0.0
        self.trained = False

    def forward(self, x: np.ndarray, first: np.ndarray, bag: np.ndarray) -> dict:
        p = self.p
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = ((t * g) @ p["w"])[:, 0]
        e = np.exp(a - np.maximum.reduceat(a, first)[bag])
        att = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(att[:, None] * h, first)
        return {"h": h, "t": t, "g": g, "att": att, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])[:, 0]))}

    def fit(self, x: np.ndarray, bag: np.ndarray, label: np.ndarray, shares: tuple[float, float], epochs: int = EPOCHS, seed: int = 1) -> None:
        """Adam on the cross-entropy, classes weighted alike; shares (bad, good) then move the offset to the true odds."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.05
        x = (x - self.mean) / self.scale
        weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
        first_of = np.searchsorted(bag, np.arange(len(label) + 1))
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        rng, step = np.random.default_rng(seed), 0
        for epoch in range(epochs):
            order = rng.permutation(len(label))
            for at in range(0, len(order), 128):
                docs = np.sort(order[at : at + 128])
                rows = np.concatenate([np.arange(first_of[d], first_of[d + 1]) for d in docs])
                sizes = first_of[docs + 1] - first_of[docs]
                grads = self._gradient(x[rows], np.cumsum(sizes) - sizes, np.repeat(np.arange(len(docs)), sizes), label[docs], weight[docs])
                step += 1
                rate = 0.005 * (1 - epoch / epochs) + 0.0002
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    m, v = state[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bad, good = shares
        self.shift = float(np.log(max(good, 1e-6) / max(bad, 1e-6)))
        self.trained = True

    def _gradient(self, x, first, bag, label, weight) -> dict:
        f, p = self.forward(x, first, bag), self.p
        dy = ((f["y"] - label) * weight / len(label))[:, None].astype(np.float32)
        dz = dy @ p["c"].T
        per = dz[bag]
        da = (per * (f["h"] - f["z"][bag])).sum(axis=1) * f["att"]
        dh = f["att"][:, None] * per
        dtg = da[:, None] @ p["w"].T
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (f["h"] > 0)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ da[:, None], "c": f["z"].T @ dy, "d": dy.sum(axis=0)}

    def score(self, x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        if not self.trained:
            return np.full(n, 0.5)
        y = self.forward((x - self.mean) / self.scale, np.searchsorted(bag, np.arange(n)), bag)["z"] @ self.p["c"] + self.p["d"]
        return 1 / (1 + np.exp(-(y[:, 0].astype(float) + self.shift)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(1).to_pylist()
        texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
        for at, part in chunks(texts):
            x, bag = passages(part)
            edges = np.searchsorted(bag, np.arange(len(part) + 1))
            for d in range(len(part)):
                own = x[edges[d] : edges[d + 1]]
                if len(own) > PASSAGES:
                    own = own[np.linspace(0, len(own) - 1, PASSAGES).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([label[at + d]], pa.int32()), pa.array([own.astype(np.float16).tobytes()], pa.binary())], names=["label", "x"])


def train(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from texts (doc_id, text) and labels (doc_id, label 0/1); class shares are counted over all labels.

    At most 2 * sample texts of each label, also where ids repeat, and of a text at most PASSAGES passages, evenly spaced over
    all of it, come to the driver. Only learning is bounded so; scoring reads every passage.
    """
    chosen, counts = sample_ids(labels.where("label in (0, 1)"), "label", sample)
    model = Model()
    if len(counts) == 2:
        rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "label")  # at most 2 * sample ids of each of two classes
        bags = first_rows(rows.mapInArrow(_features, "label int, x binary"), "label", 2 * sample)
        found = sorted(bags.collect(), key=lambda r: (r.label, r.x))
        if len({r.label for r in found}) == 2:
            xs = [np.frombuffer(r.x, np.float16).reshape(-1, WIDTH).astype(np.float32) for r in found]
            total = counts[0] + counts[1]
            model.fit(np.concatenate(xs), np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.array([r.label for r in found]), (counts[0] / total, counts[1] / total))
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        out = np.zeros(len(texts))
        for at, part in chunks(texts):
            x, bag = passages(part)
            out[at : at + len(part)] = model.score(x, bag, len(part))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = source.mapInArrow(partial(_score, model=model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labels of all folds but one, applied to every row."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(crc_mod("doc_id", folds) != held_out).dropDuplicates(["doc_id"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(texts, known)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
