"""Vector best-fit packing of tokenized documents into fixed-length training sequences.

A document becomes its token ids and a closing separator; only documents longer than a sequence are cut, into full pieces
after a first piece that may be shorter. Pieces go to bins with three capacities: tokens, documents, and attention cost
(the sum of squared lengths, what block-diagonal attention over the bin costs). A bin takes a piece only if all three
residuals allow it; among such bins the piece goes to the one with the largest weighted dot product of demand and residual,
or with the smallest weighted norm of what would be left (the default).

Pieces are packed where their text was tokenized, in blocks of BLOCK, longest first, into that task's open bins. Bins that
end up too empty are opened again and their pieces packed once more in fewer, larger groups; the small piece table between
the two passes is written, so a lost executor never tokenizes twice what was finished. No document leaves its place, no
task holds more than a block and OPEN open bins.

Defined results: a null text is empty and gives one piece, the separator alone. A very long text
is cut into as many pieces as it needs. Equal lengths go in their order in the block; among equal bins the older one takes the
piece. Rows that repeat a doc_id are packed as documents of their own. A null doc_id stays null. No rows in, no rows out. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

BLOCK = 8192
#: Bins that a task keeps open between blocks; the fullest beyond that go on to the second pass.
OPEN = 4096
#: A bin with at least this share of its tokens is done after the first pass.
DONE = 0.995
#: Pieces that a group of the second pass holds on average.
REPACK = 20_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("done", pa.bool_())])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, done boolean"


@cache
def byte_tokenizer(json_path: str):
    """The byte-level vocabulary of a tokenizers file, run by tiktoken, which gives the same ids some eight times as fast."""
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    spec = json.loads(Path(json_path).read_text())
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as themselves
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(to_byte.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str, json_path: str) -> np.ndarray:
    return byte_tokenizer(json_path).encode_to_numpy(text, allowed_special="all", disallowed_special=())


class Bins:
    """Open bins with residual tokens, documents and attention cost."""

    def __init__(self, length: int, docs: int, cost: int, weights: tuple[float, float, float], rule: str) -> None:
        self.full = np.array([length, docs, cost], float)
        self.weights, self.rule = np.array(weights) / self.full**2, rule
        self.left = np.zeros((0, 3))
        self.room = self.left  # left is the used part of room, which doubles when it is full
        self.items: list[list[int]] = []

    def place(self, item: int, length: int) -> None:
        need = np.array([length, 1, float(length) * length])
        left = self.left
        fits = np.flatnonzero((left >= need).all(axis=1))
        if len(fits):
            rest = left[fits] - need
            score = (rest * rest) @ self.weights if self.rule == "norm" else -(left[fits] @ (need * self.weights))
            at = fits[np.argmin(score)]
        else:
            at = len(left)
            if at == len(self.room) or self.room.base is not None or left.base is not self.room:
                self.room = np.empty((2 * at + 16, 3))
                self.room[:at] = left
            self.left = self.room[: at + 1]
            self.left[at] = self.full
            self.items.append([])
        self.left[at] -= need
        self.items[at].append(item)

    def take_full(self, least: int) -> list[list[int]]:
        """Removes and returns the bins that no piece of at least `least` tokens would fit."""
        return self._take((self.left[:, 0] < least) | (self.left[:, 1] < 1))

    def take_beyond(self, most: int) -> list[list[int]]:
        """Removes and returns the fullest bins, so that at most `most` stay open."""
        shut = np.zeros(len(self.left), bool)
        shut[np.argsort(self.left[:, 0], kind="stable")[: max(0, len(shut) - most)]] = True
        return self._take(shut)

    def _take(self, shut: np.ndarray) -> list[list[int]]:
        out = [x for x, s in zip(self.items, shut) if s]
        self.items = [x for x, s in zip(self.items, shut) if not s]
        self.left = self.left[~shut]
        return out


def pack(lengths: np.ndarray, make: partial) -> list[list[int]]:
    """Bins (lists of item numbers) of one group, longest first, in blocks."""
    out, bins = [], make()
    for at in range(0, len(lengths), BLOCK):
        part = lengths[at : at + BLOCK]
        for i in np.argsort(-part, kind="stable"):
            if part[i] >= bins.full[0]:
                out.append([at + int(i)])
            else:
                bins.place(at + int(i), int(part[i]))
        out += bins.take_full(1)
    return out + bins.items


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, length: int, end: int, make: partial) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    rows: list[tuple] = []
    bins = make()

    def finished(groups: list[list[int]], share: float) -> list[tuple]:
        nonlocal number
        out = []
        for group in groups:
            done, at = sum(rows[i][3] for i in group) >= share * length, 0
            for i in group:
                out.append((*rows[i], (task << 33) | number, at, done))
                at += rows[i][3]
                rows[i] = None
            number += 1
        return out

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _PIECES)] if found else [pa.array([], f.type) for f in _PIECES], schema=_PIECES)

    def flush(fresh: int) -> list[tuple]:
        """Packs the rows from fresh on, emits full bins, and renumbers what stays open."""
        nonlocal rows
        lens = np.array([r[3] for r in rows[fresh:]], np.int64)
        groups = []
        for i in np.argsort(-lens, kind="stable"):
            if lens[i] == length:
                groups.append([fresh + int(i)])
            else:
                bins.place(fresh + int(i), int(lens[i]))
        out = finished(groups + bins.take_full(1 + int(length * (1 - DONE))) + bins.take_beyond(OPEN), DONE)
        keep = [i for i, r in enumerate(rows) if r is not None]
        new = {i: k for k, i in enumerate(keep)}
        rows = [rows[i] for i in keep]
        bins.items = [[new[i] for i in g] for g in bins.items]
        return out

    fresh = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(encode(text or "", path), np.uint32(end)).astype("<u4")
            first = len(ids) % length or length
            cuts = [0, *range(first, len(ids) + 1, length)]
            rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            if len(rows) - fresh >= BLOCK:
                yield batch_of(flush(fresh))
                fresh = len(rows)
    yield batch_of(flush(fresh))
    yield batch_of(finished(bins.items, DONE))


def _repack(batches: Iterator[pa.RecordBatch], make: partial) -> Iterator[pa.RecordBatch]:
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    task = TaskContext.get().partitionId()
    table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")])
    lens = table.column("length").to_numpy()
    where, offset = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
    for k, group in enumerate(pack(lens, make)):
        where[group] = -1 - ((task << 33) | k)  # below zero: apart from the numbers of the first pass
        offset[group] = np.cumsum(np.concatenate(([0], lens[group[:-1]])))
    table = table.set_column(5, "bin", pa.array(where)).set_column(6, "offset", pa.array(offset))
    yield from table.to_batches()


def best_fit(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 0, max_docs: int = 1024, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs (doc_id, text)."""
    make = partial(Bins, length, max_docs, length * length if max_cost is None else max_cost, weights, rule)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = save(source.mapInArrow(partial(_tokenize, path=tokenizer, length=length, end=end, make=make), PIECES), "pieces")
    loose = pieces.where("not done")
    groups = max(1, loose.count() // REPACK)
    again = loose.repartition(groups, F.xxhash64("doc_id", "piece", "ids_crc32", "bin", "offset")).mapInArrow(partial(_repack, make=make), PIECES)
    return pieces.where("done").unionByName(again).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
