"""Language identification by a linear-chain conditional random field over words.

Every word (a run of letters) of a text gets a language label: emission scores come from its affixes and character n-grams
(up to four bytes, with marks for the word's begin and end) and from a lexicon of words that are frequent in the training
sample; learned transitions between neighbouring words and forward-backward give each word's posterior. A text's language is
the one with the largest mean posterior, which is also its score; code-switched texts keep their labels word by word (`tag`).

Training reads about SAMPLE documents of each language (at most twice that, also where ids repeat), SPANS runs of SPAN words spread evenly over each whole text,
and joins runs of several languages into code-switched sequences, from which transitions are learned. Applying it is one
pass over the texts without a shuffle; a worker keeps the emissions of at most CACHE words.

Defined results: a text that is null or has no letter is `und` with score 0. A very long text is read whole. Languages with
equal posteriors: the first by name. Rows that repeat a doc_id answer each for themselves. A null doc_id counts as not held out. Without any labelled text everything is `und`. Further columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, mix, sliced
from .sampling import sample_ids

SAMPLE, SPANS, SPAN = 400, 6, 20
SEQUENCES, EPOCHS = 3000, 6
BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
CACHE = 200_000
#: Words that one forward-backward pass works on at once (more if a single text has more).
BLOCK_WORDS = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if the text has no letter."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w) else []


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words, one after the other, and where each word's begin. Lexicon: sorted hashes of known words."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    buf = np.frombuffer(b"".join(raw) + b"\x03" * 4, np.uint8).astype(np.uint64)
    size = np.array([len(r) for r in raw])
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(raw)), size)
    left = (begin + size)[word] - np.arange(len(word))  # bytes from here to the word's end
    ids, of = [], []
    h = np.zeros(len(word), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h * np.uint64(257) + buf[n - 1 : n - 1 + len(word)] + np.uint64(1)
        ok = left >= n
        ids.append((mix(h[ok] + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64) + n * BUCKETS)
        of.append(word[ok])
    whole = _word_hash(h, buf, begin, size, word)
    at = np.minimum(np.searchsorted(lexicon, whole), max(len(lexicon) - 1, 0))
    hit = np.flatnonzero(lexicon[at] == whole) if len(lexicon) else np.zeros(0, np.int64)
    ids.append((whole[hit] & np.uint64(BUCKETS - 1)).astype(np.int64))
    of.append(hit)
    ids, of = np.concatenate(ids), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return ids[order], np.searchsorted(of[order], np.arange(len(words)))


def _word_hash(h, buf, begin, size, word) -> np.ndarray:
    place = (np.arange(len(word)) - begin[word]).astype(np.uint64)
    return mix(np.add.reduceat(mix(buf[: len(word)] * np.uint64(0x100000001B3) + place), begin))


def word_hashes_of(words: list[str]) -> np.ndarray:
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    size = np.array([len(r) for r in raw])
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(raw)), size)
    return _word_hash(None, np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), begin, size, word)


class Model:
    def __init__(self, languages: list[str]) -> None:
        n = len(languages)
        self.languages = languages
        self.weight = np.zeros(((max(GRAMS) + 1) * BUCKETS, n), np.float32)
        self.move = np.zeros((n, n), np.float32)
        self.start = np.zeros(n, np.float32)
        self.lexicon = np.zeros(0, np.uint64)

    def emissions(self, words: list[str]) -> np.ndarray:
        ids, first = features(words, self.lexicon)
        return np.add.reduceat(self.weight[ids], first).astype(np.float32)

    def posteriors(self, e: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """Posteriors of all words by forward-backward, sequence after sequence; with pairs also the expected transitions.

        Sequences run side by side, the longest first, so that one step serves all that are still running.
        """
        n = e.shape[1]
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        longest = int(lengths.max())
        running = np.searchsorted(-lengths[order], -np.arange(longest), "left")  # sequences longer than t
        offset = np.concatenate(([0], np.cumsum(running)))
        seq = np.repeat(np.arange(len(lengths)), lengths)
        t = np.arange(len(e)) - (np.cumsum(lengths) - lengths)[seq]
        to = offset[t] + rank[seq]
        x = np.empty_like(e)
        x[to] = np.exp(e - e.max(axis=1, keepdims=True))
        move = np.exp(self.move - self.move.max())
        ahead = np.empty_like(x)
        a = np.exp(self.start - self.start.max()) * x[: running[0]]
        ahead[: running[0]] = a = a / a.sum(axis=1, keepdims=True)
        for s in range(1, longest):
            lo, hi = offset[s], offset[s + 1]
            a = (a[: hi - lo] @ move) * x[lo:hi]
            a /= a.sum(axis=1, keepdims=True)
            ahead[lo:hi] = a
        counts = np.zeros((n, n))
        b = np.ones((running[-1], n), np.float32)
        for s in range(longest - 1, 0, -1):
            lo, hi = offset[s], offset[s + 1]
            xb = x[lo:hi] * b
            if pairs:
                before = ahead[offset[s - 1] : offset[s - 1] + hi - lo]
                joint = before[:, :, None] * move * xb[:, None, :]
                counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            ahead[lo:hi] *= b
            b = xb @ move.T
            b /= b.sum(axis=1, keepdims=True)
            if running[s - 1] > hi - lo:
                b = np.concatenate((b, np.ones((running[s - 1] - (hi - lo), n), np.float32)))
        ahead[: running[0]] *= b
        ahead /= ahead.sum(axis=1, keepdims=True)
        out = ahead[to]
        return (out, counts) if pairs else out

    def fit(self, spans: list[tuple[int, list[str]]], sequences: int = SEQUENCES, epochs: int = EPOCHS, seed: int = 3) -> None:
        """Adagrad on the likelihood of sequences of one to four spans (language, words) each."""
        rng = np.random.default_rng(seed)
        often = Counter(w for _, ws in spans for w in ws)
        vocabulary = sorted(often)
        number = {w: i for i, w in enumerate(vocabulary)}
        known = [w for w in vocabulary if often[w] >= 5]
        self.lexicon = np.sort(word_hashes_of(known)) if known else self.lexicon
        ids, first = features(vocabulary, self.lexicon)
        last = np.append(first[1:], len(ids))
        by = [[i for i, (k, _) in enumerate(spans) if k == lang] for lang in range(len(self.languages))]
        drawn = []
        for _ in range(sequences):
            picks = [int(rng.choice(by[rng.integers(len(by))])) for _ in range(rng.integers(1, 5))]
            parts = [spans[i] if rng.random() < 0.7 else (spans[i][0], spans[i][1][: rng.integers(1, 6)]) for i in picks]
            drawn.append((np.array([number[w] for _, ws in parts for w in ws]), np.array([k for k, ws in parts for _ in ws])))
        square = [np.full_like(p, 1e-2) for p in (self.weight, self.move, self.start)]
        n = len(self.languages)
        for _ in range(epochs):
            order = rng.permutation(len(drawn))
            for at in range(0, len(order), 100):
                batch = [drawn[i] for i in order[at : at + 100]]
                lengths = np.array([len(w) for w, _ in batch])
                word, gold = np.concatenate([w for w, _ in batch]), np.concatenate([g for _, g in batch])
                uniq, inverse = np.unique(word, return_inverse=True)
                sizes = last[uniq] - first[uniq]
                feats = np.concatenate([ids[first[u] : last[u]] for u in uniq])
                starts = np.cumsum(sizes) - sizes
                e = np.add.reduceat(self.weight[feats], starts)[inverse].astype(np.float32)
                p, counts = self.posteriors(e, lengths, pairs=True)
                p[np.arange(len(gold)), gold] -= 1
                per = np.zeros((len(uniq), n))
                np.add.at(per, inverse, p)
                touched, back = np.unique(feats, return_inverse=True)
                g = np.zeros((len(touched), n))
                np.add.at(g, back, np.repeat(per, sizes, axis=0))
                g = g / len(batch) + 1e-5 * self.weight[touched]
                square[0][touched] += (g * g).astype(np.float32)
                self.weight[touched] -= (0.1 * g / np.sqrt(square[0][touched])).astype(np.float32)
                begins = np.cumsum(lengths) - lengths
                inside = np.ones(len(gold), bool)
                inside[begins] = False
                np.add.at(counts, (gold[np.flatnonzero(inside) - 1], gold[inside]), -1)
                for value, sq, grad in ((self.move, square[1], counts / len(batch)), (self.start, square[2], p[begins].sum(axis=0) / len(batch))):
                    sq += grad * grad
                    value -= 0.1 * grad / np.sqrt(sq)


class Tagger(dict):
    """Word -> row of emissions; rows of new words are filled in by `rows`."""

    def __init__(self, model: Model) -> None:
        self.model, self.fresh = model, []
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def rows(self, numbers: np.ndarray) -> np.ndarray:
        if self.fresh:
            self.table = np.concatenate((self.table, *(self.model.emissions(self.fresh[k : k + 20_000]) for k in range(0, len(self.fresh), 20_000))))
            self.fresh = []
        return self.table[numbers]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.model.languages:
            return found
        has: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            if words:
                has.append(i)
                held.append(self.numbers(words))
                size += len(words)
            if has and (size >= BLOCK_WORDS or i + 1 == len(texts)):
                lengths = np.array([len(h) for h in held])
                p = self.model.posteriors(self.rows(np.concatenate(held)), lengths)
                mean = np.add.reduceat(p, np.cumsum(lengths) - lengths, dtype=np.float64) / lengths[:, None]
                for k, best, m in zip(has, mean.argmax(axis=1), mean):
                    found[k] = (self.model.languages[best], float(min(max(m[best], 0.0), 1.0)))
                has, held, size = [], [], 0
                if len(self) > CACHE:
                    self.clear()
                    self.table = self.table[:0].copy()
        return found


def tag(model: Model, text: str) -> list[tuple[str, str]]:
    """(word, language) of every word of a text."""
    words = words_of(text)
    if not words:
        return []
    p = model.posteriors(model.emissions(words), np.array([len(words)]))
    return [(w, model.languages[k]) for w, k in zip(words, p.argmax(axis=1))]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SPANS runs of SPAN words of each text, evenly spread."""
    for batch in batches:
        langs, runs = [], []
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            w = words_of(text)
            k = min(SPANS, -(-len(w) // SPAN))
            for i in range(k):
                at = i * max(len(w) - SPAN, 0) // max(k - 1, 1)
                langs.append(lang)
                runs.append(" ".join(w[at : at + SPAN]))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(runs, pa.string())], names=["lang", "words"])


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (doc_id, text, lang); rows without lang are left out."""
    known = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    picked, counts = sample_ids(known, "lang", sample)
    found = sorted(picked.select("lang", "text").mapInArrow(_spans, "lang string, words string").collect(), key=tuple)  # at most 2 x sample x SPANS x SPAN words a language
    languages = sorted({r.lang for r in found})
    model = Model(languages)
    if languages:
        number = {x: i for i, x in enumerate(languages)}
        model.fit([(number[r.lang], r.words.split(" ")) for r in found])
    return model


_TAGGERS: dict[str, Tagger] = {}


def _predict(batches: Iterator[pa.RecordBatch], shared, key: str) -> Iterator[pa.RecordBatch]:
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(shared.value)
    tagger = _TAGGERS[key]
    for batch in sliced(batches, 2048):
        found = tagger.predict(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text); the model is a few MB whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(partial(_predict, shared=shared, key=uuid.uuid4().hex), "doc_id long, lang_pred string, score double")


def language(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from text and lang of all folds but one, applied to every row."""
    model = train(docs.where(crc_mod("doc_id", folds) != held_out))
    return predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _select(batches: Iterator[pa.RecordBatch], shared, key: str, text: int, least: float) -> Iterator[pa.RecordBatch]:
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(shared.value)
    for batch in sliced(batches, 2048):
        found = _TAGGERS[key].predict(batch.column(text).to_pylist())
        yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))


def select_language(docs: DataFrame, least: float) -> DataFrame:
    """Rows of docs, unchanged, whose text has a language with a mean posterior of at least `least`; learned from all labelled rows."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    return docs.mapInArrow(partial(_select, shared=shared, key=uuid.uuid4().hex, text=docs.columns.index("text"), least=least), docs.schema)
