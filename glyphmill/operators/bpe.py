"""Byte-pair vocabularies: learning merges, encoding, decoding, reports.

Word counts are aggregated on the cluster; the merges themselves are strictly one after the other, so they run where the
distinct words are, on the driver, with an index from pairs to words and a heap instead of recounting. Encoding looks at
each distinct word once.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import text as T
from ..functions.batches import token_runs
from .corpus import word_counts

SPECIALS = ["<pad>", "<unk>", "<bos>", "<eos>"]
PAD, UNK, BOS, EOS = range(4)
VERSION = "bpe-v1"
#: Words whose ids a worker keeps.
KEPT = 100_000


@dataclass
class Vocabulary:
    """Ordered tokens; the four specials come first, a repeated token keeps its first id."""

    tokens: list[str]
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for i, t in enumerate(self.tokens):
            self.ids.setdefault(t, i)

    @classmethod
    def of(cls, pieces: list[str]) -> Vocabulary:
        return cls(SPECIALS + list(pieces))

    def id(self, token: str) -> int:
        return self.ids.get(token, UNK)

    def token(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < len(self.tokens) else SPECIALS[UNK]


@dataclass
class Tokenizer:
    vocabulary: Vocabulary
    merges: list[tuple[str, str]]
    _ranks: dict[tuple[str, str], int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._ranks = {pair: i for i, pair in enumerate(self.merges)}

    def pieces(self, word: str) -> list[str]:
        """Merges the lowest-ranked neighbouring pair, everywhere in the word, until none is left."""
        symbols = list(word)
        while len(symbols) > 1:
            rank, pair = min(((self._ranks.get(p, len(self.merges)), p) for p in zip(symbols, symbols[1:])))
            if rank == len(self.merges):
                break
            symbols = _merge(symbols, pair)
        return symbols

    # models as JSON, for exchange with other tools
    def to_json(self) -> str:
        names = dict(zip(("PadId", "UnkId", "BosId", "EosId"), (PAD, UNK, BOS, EOS)))
        return json.dumps({"Version": VERSION, "Vocab": {"IdToToken": self.vocabulary.tokens, **names}, "Merges": ["\t".join(m) for m in self.merges]}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Tokenizer:
        model = json.loads(text)
        return cls(Vocabulary(model["Vocab"]["IdToToken"]), [tuple(m.split("\t", 1)) for m in model["Merges"]])

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(vocab, merges) as tables."""
        return spark.createDataFrame(list(enumerate(self.vocabulary.tokens)), "id int, token string"), spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(self.merges)], "rank int, lhs string, rhs string")


def _merge(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
            out.append(symbols[i] + symbols[i + 1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def train_on_counts(counts: dict[str, int], size: int = 8192, least: int = 2, checkpoint=None, every: int = 2000, resume: Tokenizer | None = None) -> Tokenizer:
    """Learns merges from word counts. Ties go to the smaller pair. Every merge counts twice against `size`, as a piece and
    as a merge, which is the established stopping rule. checkpoint(tokenizer, merges) is called every so many merges; resume,
    such a tokenizer of the same counts, goes on after its merges and ends as an unbroken run does."""
    if size < 256:
        raise ValueError("size must be at least 256")
    split = [resume.pieces(w) if resume else list(w) for w in counts]
    weight = list(counts.values())
    chars: dict[str, int] = defaultdict(int)
    total: dict[tuple[str, str], int] = defaultdict(int)
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, (word, symbols) in enumerate(zip(counts, split)):
        for c in word:
            chars[c] += weight[k]
        for p in zip(symbols, symbols[1:]):
            total[p] += weight[k]
            where[p].add(k)
    pieces = sorted(c for c, n in chars.items() if n >= least)
    merges: list[tuple[str, str]] = list(resume.merges) if resume else []
    pieces += [a + b for a, b in merges]
    heap = [(-n, p) for p, n in total.items()]
    heapq.heapify(heap)
    while len(pieces) + len(merges) + len(SPECIALS) < size and heap:
        n, pair = heapq.heappop(heap)
        if total[pair] != -n:
            continue  # counted anew since
        if -n < least:
            break
        merges.append(pair)
        pieces.append(pair[0] + pair[1])
        changed = set()
        for k in list(where[pair]):
            old, new = split[k], _merge(split[k], pair)
            for p in zip(old, old[1:]):
                total[p] -= weight[k]
                changed.add(p)
            for p in zip(new, new[1:]):
                total[p] += weight[k]
                where[p].add(k)
                changed.add(p)
            for p in set(zip(old, old[1:])) - set(zip(new, new[1:])):
                where[p].discard(k)
            split[k] = new
        for p in changed:
            if total[p] > 0:
                heapq.heappush(heap, (-total[p], p))
        if checkpoint and len(merges) % every == 0:
            checkpoint(Tokenizer(Vocabulary.of(pieces), list(merges)), len(merges))
    return Tokenizer(Vocabulary.of(pieces), merges)


def train(lines: DataFrame, size: int = 8192, least: int = 2, text: str = "text", most_words: int = 2_000_000, **more) -> Tokenizer:
    """Learns a tokenizer from lines; at most `most_words` distinct words (the commonest) come to the driver."""
    top = word_counts(lines, text).orderBy(F.desc("cnt"), "word").limit(most_words)
    return train_on_counts({r.word: r.cnt for r in top.toLocalIterator()}, size, least, **more)


def with_pieces(words: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Adds `pieces` to rows that have a word."""
    shared = words.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("array<string>")
    def pieces(col: pd.Series) -> pd.Series:
        return col.map(shared.value.pieces)

    return words.withColumn("pieces", pieces("word"))


def piece_table(words: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(word, pieces) of distinct words."""
    return with_pieces(words.select("word").distinct(), tokenizer)


class _Known:
    """The pieces of words, looked up once; up to KEPT words are kept."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.known = tokenizer, {}

    def of(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all words one after the other, and how many each has."""
        known, pieces, found = self.known, self.tokenizer.pieces, []
        for word in words.to_pylist():
            if (got := known.get(word)) is None:
                got = pieces(word)
                if len(known) < KEPT:
                    known[word] = got
            found.append(got)
        return pa.array(chain.from_iterable(found), pa.string()), np.fromiter(map(len, found), np.int64, len(found))

    def ids(self, pieces: pa.Array) -> np.ndarray:
        names = pieces.dictionary_encode()
        table = np.fromiter(map(self.tokenizer.vocabulary.id, names.dictionary.to_pylist()), np.int32, len(names.dictionary))
        return table[names.indices.to_numpy()]


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer, bos: bool, eos: bool) -> Iterator[pa.RecordBatch]:
    known = _Known(tokenizer.value)
    for rows, tokens, sizes in token_runs(batches, 1):
        words = tokens.dictionary_encode()
        pieces, lengths = known.of(words.dictionary)
        ids, at = known.ids(pieces), words.indices.to_numpy()
        starts, each = (np.cumsum(lengths) - lengths)[at], lengths[at]
        ends = np.cumsum(each)
        flat = ids[np.repeat(starts - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]  # ids before each row's end
        if bos or eos:
            flat = _marked(flat, upto, bos, eos)
            upto = upto + np.arange(len(upto)) * (bos + eos)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat, pa.int32()))], names=["key", "ids"])


def _marked(flat: np.ndarray, upto: np.ndarray, bos: bool, eos: bool) -> np.ndarray:
    """Each row's ids with a start mark, an end mark or both."""
    more, k = bos + eos, np.arange(len(upto) - 1)
    out = np.empty(len(flat) + more * len(k), flat.dtype)
    if bos:
        out[upto[:-1] + more * k] = BOS
    if eos:
        out[upto[1:] + more * k + more - 1] = EOS
    out[np.arange(len(flat)) + more * np.repeat(k, np.diff(upto)) + bos] = flat
    return out


def encode(lines: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text", bos: bool = False, eos: bool = False) -> DataFrame:
    """(key, ids) of every line, where it is read, a run of lines at a time; a worker keeps the pieces of up to KEPT words."""
    shared = lines.sparkSession.sparkContext.broadcast(tokenizer)
    schema = StructType([StructField("key", lines.schema[key].dataType), StructField("ids", ArrayType(IntegerType()))])
    rows = lines.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_encoded, tokenizer=shared, bos=bos, eos=eos), schema).withColumnRenamed("key", key)


def _used(batches: Iterator[pa.RecordBatch], tokenizer, pairs: bool) -> Iterator[pa.RecordBatch]:
    """Of each run of texts: with pairs (lhs, rhs, cnt), else (piece, id, cnt), id being a piece's or, without piece, a number of pieces."""
    known = _Known(tokenizer.value)
    for _, tokens, _ in token_runs(batches):
        words = tokens.dictionary_encode()
        cnt = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        pieces, lengths = known.of(words.dictionary)
        weight = np.repeat(cnt, lengths)
        if pairs:
            names = pieces.dictionary_encode()
            each, word = names.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
            near = np.flatnonzero(word[1:] == word[:-1])
            code, at = np.unique(each[near] * len(names.dictionary) + each[near + 1], return_inverse=True)
            lhs, rhs = (names.dictionary.take(pa.array(x)) for x in (code // max(len(names.dictionary), 1), code % max(len(names.dictionary), 1)))
            yield pa.RecordBatch.from_arrays([lhs, rhs, pa.array(_sums(at, weight[near]))], names=["lhs", "rhs", "cnt"])
            continue
        for piece, keys, n in ((True, known.ids(pieces), weight), (False, lengths, cnt)):
            some, at = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([piece] * len(some), pa.bool_()), pa.array(some.astype(np.int32)), pa.array(_sums(at, n))], names=["piece", "id", "cnt"])


def _sums(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.bincount(at, n).astype(np.int64)  # of one run, so exact in doubles


def use(lines: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """(piece, id, cnt): how often each piece is used, and, where piece is false, how many words have so many pieces. Counted in
    the workers, so that neither words nor ids are shuffled."""
    shared = lines.sparkSession.sparkContext.broadcast(tokenizer)
    each = lines.select(text).mapInArrow(partial(_used, tokenizer=shared, pairs=False), "piece boolean, id int, cnt long")
    return each.groupBy("piece", "id").agg(F.sum("cnt").alias("cnt"))


def piece_use(lines: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """(id, freq), as piece_counts of all encoded lines."""
    return use(lines, tokenizer, text).where("piece").select("id", F.col("cnt").alias("freq"))


def piece_pairs(lines: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """(lhs, rhs, cnt), as pairs_after of all words of the lines, counted in the workers."""
    shared = lines.sparkSession.sparkContext.broadcast(tokenizer)
    each = lines.select(text).mapInArrow(partial(_used, tokenizer=shared, pairs=True), "lhs string, rhs string, cnt long")
    return each.groupBy("lhs", "rhs").agg(F.sum("cnt").alias("cnt"))


def decode(encoded: DataFrame, tokenizer: Tokenizer, ids: str = "ids", strip: bool = True) -> DataFrame:
    """Adds `decoded`: pieces joined by spaces, specials left out unless strip is off."""
    tokens = F.array(*map(F.lit, tokenizer.vocabulary.tokens)) if len(tokenizer.vocabulary.tokens) < 200 else None
    if tokens is None:
        shared = encoded.sparkSession.sparkContext.broadcast(tokenizer.vocabulary)

        @F.pandas_udf("string")
        def text_of(col: pd.Series) -> pd.Series:
            return col.map(lambda x: " ".join(t for t in (shared.value.token(i) for i in x) if not (strip and t in SPECIALS)))

        return encoded.withColumn("decoded", text_of(ids))
    named = F.transform(ids, lambda i: F.coalesce(F.get(tokens, i), F.lit(SPECIALS[UNK])))
    kept = F.filter(named, lambda t: ~t.isin(SPECIALS)) if strip else named
    return encoded.withColumn("decoded", F.array_join(kept, " "))


def piece_counts(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    return encoded.select(F.explode(ids).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("freq"))


def pairs_after(counts: DataFrame, table: DataFrame) -> DataFrame:
    """(lhs, rhs, cnt) of neighbouring pieces, from word counts (word, cnt) and the words' pieces (word, pieces)."""
    pairs = F.transform(F.sequence(F.lit(2), F.size("pieces")), lambda i: F.struct(F.get("pieces", i - 2).alias("lhs"), F.get("pieces", i - 1).alias("rhs")))
    each = counts.join(table, "word").where("size(pieces) > 1").select("cnt", F.explode(pairs).alias("p"))
    return each.groupBy("p.lhs", "p.rhs").agg(F.sum("cnt").alias("cnt"))


def summary(pieces: DataFrame, words: DataFrame, vocab_size: int) -> DataFrame:
    """One row on piece use and fragmentation. pieces: (id, freq). words: (n_pieces, cnt), words by how many pieces they take; words of no piece count with those of one."""
    one = lambda piece, key, n: (F.lit(piece).alias("piece"), F.col(key).cast("int").alias("id"), F.col(n).alias("cnt"))
    return summary_of_use(pieces.select(*one(True, "id", "freq")).unionByName(words.select(*one(False, "n_pieces", "cnt"))), vocab_size)


def summary_of_use(used: DataFrame, vocab_size: int) -> DataFrame:
    """The same from the one table that use() gives."""
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("cnt"))), F.lit(0))
    word, n = ~F.col("piece"), F.col("id")
    one = used.agg(total(F.col("piece")).alias("total_pieces"), F.count_if("piece").alias("unique_pieces"), total(word).alias("words"), total(word & (n <= 1)).alias("w1"), total(word & (n == 2)).alias("w2"), total(word & (n >= 3)).alias("w3"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("words")), F.lit(0.0))
    return one.select(F.lit(vocab_size).alias("vocab_size"), "total_pieces", "unique_pieces", F.coalesce(F.try_divide(F.col("total_pieces").cast("double"), F.col("words")), F.lit(0.0)).alias("pieces_per_word"), share("w1").alias("pct_1"), share("w2").alias("pct_2"), share("w3").alias("pct_3_plus"))


def top_pieces(pieces: DataFrame, n: int = 200) -> DataFrame:
    return pieces.orderBy(F.desc("freq"), "id").limit(n)


def rare_pieces(pieces: DataFrame, n: int = 200) -> DataFrame:
    return pieces.orderBy("freq", "id").limit(n)


def report(lines: DataFrame, tokenizer: Tokenizer, path: str, key: str = "doc_id", text: str = "text", top: int = 200, samples: int = 100) -> None:
    """Writes summary, top, rare and word segments as CSV folders under path."""
    used = use(lines, tokenizer, text).cache()  # a row a piece
    pieces = used.where("piece").select("id", F.col("cnt").alias("freq"))
    table = with_pieces(word_counts(lines, text), tokenizer)
    names = tokenizer.tables(lines.sparkSession)[0].withColumn("piece", T.csv_safe(F.col("token"))).select("id", "piece")
    picked = table.where(F.pmod(F.xxhash64("word"), F.lit(20)) == 0).orderBy("word").limit(samples)
    out = {
        "summary": summary_of_use(used, len(tokenizer.vocabulary.tokens)),
        "top_pieces": top_pieces(pieces, top).join(F.broadcast(names), "id", "left").select("id", "piece", "freq"),
        "rare_pieces": rare_pieces(pieces).join(F.broadcast(names), "id", "left").select("id", "piece", "freq"),
        "word_segments": picked.select("word", F.array_join("pieces", " + ").alias("pieces")),
    }
    for name, df in out.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True, quoteAll=True, escape='"')
    used.unpersist()
