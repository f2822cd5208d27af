"""Byte-pair encoding and decoding of whole texts by tree concatenation.

A long text is halved until its leaves hold at most LEAF characters. The leaves are encoded in parallel, wherever the
cluster has room; then neighbours are joined pairwise, level by level. A join re-encodes a window around the cut, from a
token boundary on the left to one on the right, and widens it until the window's own encoding agrees exactly with the left
part before the cut and with the right part behind it: on each side some token with the same id and the same characters,
at the end of a pre-token for both. From such a token on the tokenizer has no memory of what came before it, so the joined
ids are those of the whole text; if the window grows to the whole text it simply is the encoding.

Texts of more than FAR characters have their leaves dealt over the cluster; those between are leaves and joins within the task
that read them. There, and in the leaves of texts of at most LEAF characters, each distinct word is encoded once per worker and
kept in a cache of CACHE words, which gives the tokenizer's own ids several times as fast; texts with special tokens or with
characters outside the scripts for which the shortcut is proven by test go through the tokenizer itself. The texts are read
once: finished rows and leaves are written side by side in the shared folder.

Defined results: a null text is empty: no tokens, the digest of the empty string. Rows that repeat a doc_id are grouped by
row, not by doc_id, so each keeps its own result. A null doc_id stays null. No rows in, no rows out. Further columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, partial
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Characters of a leaf, and of a text whose leaves stay in one task.
LEAF, FAR = 4096, 32768
#: Characters of the first window on either side of a cut.
WINDOW = 32
#: Words (with their punctuation) that a worker keeps, none longer than LONGEST characters; and rows it takes out of a batch at once.
CACHE, LONGEST, ROWS = 50_000, 64, 256


class Tree:
    """A tokenizers file with tree concatenation; tokens are (id, start, end) on the text's characters."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t["content"] for t in json.loads(Path(path).read_text())["added_tokens"]]
        self.name = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]

    def leaf(self, text: str, at: int = 0) -> list[tuple[int, int, int]]:
        e = self.tok.encode(text, add_special_tokens=False)
        return [(i, a + at, b + at) for i, (a, b) in zip(e.ids, e.offsets)]

    def settled(self, text: str, t: tuple[int, int, int], u: tuple[int, int, int]) -> bool:
        """Whether what follows two agreed neighbours t, u cannot depend on what stands before t.

        At a word end the pre-tokenizer starts anew. Inside a run of letters (not those of a contraction) or of punctuation
        both sides see the same run, and byte-pair tokens in a run are right exactly if each neighbouring pair is.
        """
        run = text[t[1] : u[2]]
        return self.name[t[0]].endswith("</w>") or (run.isalpha() and text[max(0, t[1] - 3) : t[1]].isalpha() and t[1] >= 3) or _MARKS.fullmatch(run) is not None

    def join(self, text: str, left: list, right: list, lo: int, cut: int, hi: int) -> list:
        """The encoding of text[lo:hi] from those of text[lo:cut] and text[cut:hi]."""
        reach = WINDOW
        while True:
            a, b = max(lo, cut - reach), min(hi, cut + reach)
            window = self.leaf(text[a:b], a)
            i = self._agree_left(text, left, window, a, cut, lo)
            j = self._agree_right(text, right, window, b, cut, hi)
            if i is not None and j is not None and i[1] <= j[1]:
                return left[: i[0]] + window[i[1] : j[1]] + right[j[0] :]
            if a == lo and b == hi:
                return window
            reach *= 2

    def _agree_left(self, text: str, left: list, window: list, a: int, cut: int, lo: int):
        """Where to leave the left part and enter the window: behind the last settled token both have, clear of the cut."""
        if a == lo:
            return 0, 0
        at = {t: k for k, t in enumerate(window)}
        for k in range(len(left) - 2, -1, -1):
            t = left[k]
            if t[1] < a:
                return None
            if left[k + 1][2] < cut and t in at and at[t] + 1 < len(window) and left[k + 1] == window[at[t] + 1] and self.settled(text, t, left[k + 1]):
                return k + 1, at[t] + 1
        return None

    def _agree_right(self, text: str, right: list, window: list, b: int, cut: int, hi: int):
        """Where to leave the window and enter the right part: behind the first settled token both have, clear of the window's edge."""
        if b == hi:
            return len(right), len(window)
        at = {t: k for k, t in enumerate(window)}
        for k, t in enumerate(right[:-1]):
            if t[2] >= b:
                return None
            if t[1] > cut and t in at and at[t] + 1 < len(window) and right[k + 1] == window[at[t] + 1] and right[k + 1][2] < b and self.settled(text, t, right[k + 1]):
                return k + 1, at[t] + 1
        return None

    def concatenate(self, text: str, leaves: list[list], cuts: list[int]) -> list:
        """Joins neighbouring leaves, then neighbouring results, up to the root; cuts are the leaves' ends."""
        spans = list(zip([0, *cuts[:-1]], cuts, leaves))
        while len(spans) > 1:
            up = [(x[0], y[1], self.join(text, x[2], y[2], x[0], x[1], y[1])) for x, y in zip(spans[::2], spans[1::2])]
            spans = up + ([spans[-1]] if len(spans) % 2 else [])
        return spans[0][2] if spans else []

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        cuts = leaf_ends(text, leaf)
        if not cuts or any(s in text for s in self.special):
            return [t[0] for t in self.leaf(text)]
        return [t[0] for t in self.concatenate(text, [self.leaf(text[a:b], a) for a, b in zip([0, *cuts[:-1]], cuts)], cuts)]

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)


def leaf_ends(text: str, leaf: int = LEAF) -> list[int]:
    """Ends of the leaves: halves of halves down to `leaf` characters; a cut moves right to where white space or an ASCII letter follows, so that no combining mark loses its base."""
    n = len(text)
    parts = 1
    while n > leaf * parts:
        parts *= 2
    out: list[int] = []
    for k in range(1, parts):
        c = n * k // parts
        while c < n and not (text[c].isspace() or (text[c].isascii() and text[c - 1].isascii())):
            c += 1
        if c < n and (not out or c > out[-1]):
            out.append(c)
    return [*out, n] if n else []


# ---- the shortcut for short texts ---------------------------------------------------------------------------------

#: Scripts for which the shortcut equals the tokenizer on every character (tests try all of them): ASCII, Latin and Cyrillic letters, general punctuation.
_KNOWN = regex.compile(r"[\t-\r\x20-\x7E -įĲ-ňŊ-ɏА-я‐-‧‰-›€]*")
_LETTER, _NUMBER = r"[^\W\d_²³¹¼½¾]", r"[\d²³¹¼½¾]"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|{_NUMBER}|(?:[^\w\s]|_)+")
_MARKS = regex.compile(r"[^\s\p{L}\p{N}]+")
#: Stands for a word's end among bytes; never part of UTF-8.
_END = b"\xff"


def word_ranks(vocab: dict[str, int], special: list[str]) -> dict[bytes, int]:
    """The vocabulary as bytes, with _END for </w>.

    Merging by the rank of the merged bytes equals merging by the list of pairs if each token's own bytes merge to that
    token, which a test shows for all of them; a last byte and _END come first, as the lowest ranks.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as themselves
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    out = {}
    for token, i in vocab.items():
        if token not in special:
            core = token.removesuffix("</w>") or token
            out[bytes(to_byte[c] for c in core) + (_END if core != token else b"")] = i
    return out


class Words(dict):
    """Word between white space, in lower case -> (tokens, ids, decoded), made at the first use."""

    def __init__(self, tree: Tree, path: str) -> None:
        import tiktoken

        ranks = word_ranks(json.loads(Path(path).read_text())["model"]["vocab"], tree.special)
        bpe = tiktoken.Encoding("word_bpe", pat_str=r"[\s\S]", mergeable_ranks=ranks, special_tokens={})
        self.piece = bpe._core_bpe.encode_single_piece
        self.name = tree.name

    def __missing__(self, word: str) -> tuple[int, str, str]:
        if word.isalpha():
            parts = [word]
        elif word[:-1].isalpha() and not word[-1].isalnum():  # letters and one mark
            parts = [word[:-1], word[-1]]
        else:
            parts = _WORD.findall(word)
        ids = [i for part in parts for i in self.piece(part.encode() + _END)]
        found = (len(ids), " ".join(map(str, ids)), " ".join([self.name[i] for i in ids]))
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found


class Encoder:
    def __init__(self, path: str) -> None:
        self.tree = Tree(path)
        self.words = Words(self.tree, path)

    def digests(self, text: str, leaf: int = LEAF) -> tuple[int, str, str]:
        """(tokens, digest of the ids, digest of the decoded text) of a text."""
        if not _KNOWN.fullmatch(text) or any(s in text for s in self.tree.special):
            return digests(self.tree, self.tree.encode(text, leaf))
        plain = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        parts = self.concatenate(plain, leaf)
        if not parts:
            return 0, _sha(""), _sha("")
        n, ids, decoded = zip(*parts)
        return sum(n), _sha(" ".join(ids)), _sha(" ".join(decoded))

    def concatenate(self, text: str, leaf: int = LEAF) -> list[tuple[int, str, str]]:
        """The encoded words of a text by tree concatenation: leaves, then neighbours joined level by level."""
        look = self.words.__getitem__
        cuts = leaf_ends(text, leaf)
        spans = [(a, b, [*map(look, text[a:b].split())]) for a, b in zip([0, *cuts[:-1]], cuts)]
        while len(spans) > 1:
            up = [(x[0], y[1], self.join(text, x[2], y[2], x[0], x[1], y[1])) for x, y in zip(spans[::2], spans[1::2])]
            spans = up + ([spans[-1]] if len(spans) % 2 else [])
        return spans[0][2] if spans else []

    def join(self, text: str, left: list, right: list, lo: int, cut: int, hi: int) -> list:
        """The words of text[lo:hi] from those of text[lo:cut] and text[cut:hi], by a growing window around the cut.

        On each side some whole word clear of the cut must be the same in the window and in the part, or the window must
        reach that side's end; white space ends a word for the tokenizer too.
        """
        look, reach = self.words.__getitem__, WINDOW
        while True:
            a, b = max(lo, cut - reach), min(hi, cut + reach)
            window = [*map(look, text[a:b].split())]
            head, tail = text[a:cut].split(), text[cut:b].split()
            # words of each half that the cut cannot touch
            head = head if text[cut - 1].isspace() else head[:-1]
            tail = tail if text[cut].isspace() else tail[1:]
            n, m = len(left) - (not text[cut - 1].isspace()), len(right) - (not text[cut].isspace())
            i, j = (0, 0) if a == lo else (n, len(head)), (len(right), len(window)) if b == hi else (len(right) - m, len(window) - len(tail))
            agrees_left = a == lo or (len(head) > 1 and n > 0 and window[len(head) - 1] == left[n - 1])
            agrees_right = b == hi or (len(tail) > 1 and m > 0 and window[len(window) - len(tail)] == right[len(right) - m])
            if agrees_left and agrees_right:
                return left[: i[0]] + window[i[1] : j[1]] + right[j[0] :]
            reach *= 2


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digests(tree: Tree, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), _sha(" ".join(map(str, ids))), _sha(tree.decode(ids))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


_FIRST = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("start", pa.int64()), ("text", pa.string())])


def _first(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Finished rows of the texts that stay in this task, and the leaves of the others."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            out: list[tuple] = []
            for row, doc, text in zip(*(c.slice(at, ROWS).to_pylist() for c in batch.columns)):
                if len(text) <= FAR:
                    out.append((row, doc, *encoder(path).digests(text), None, None))
                else:
                    ends = leaf_ends(text)
                    out += [(row, doc, None, None, None, a, text[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FIRST)], schema=_FIRST)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tree = encoder(path).tree
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            out = [tree.leaf(t) for t in batch.column("text").to_pylist()]
            lists = [pa.array([[t[k] for t in x] for x in out], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "ids", "begins", "ends"])


def _tree(group: pa.Table, path: str) -> pa.Table:
    tree = encoder(path).tree
    rows = group.sort_by("start").to_pylist()
    text = "".join(r["text"] for r in rows)
    leaves = [[(i, a + r["start"], b + r["start"]) for i, a, b in zip(r["ids"], r["begins"], r["ends"])] for r in rows]
    if any(s in text for s in tree.special):  # special tokens are found in the raw text, before anything is split
        ids = [t[0] for t in tree.leaf(text)]
    else:
        ids = [t[0] for t in tree.concatenate(text, leaves, [r["start"] + len(r["text"]) for r in rows])]
    n, a, b = digests(tree, ids)
    return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [a], "decoded_sha256": [b]})


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text)."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = save(source.mapInArrow(partial(_first, path=tokenizer), "row long, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, start long, text string"), "encoded")
    leaves = first.where("text is not null").select("row", "doc_id", "start", "text").repartition("row", "start")
    encoded = leaves.mapInArrow(partial(_encode, path=tokenizer), "row long, doc_id long, start long, text string, ids array<int>, begins array<int>, ends array<int>")
    long = encoded.groupBy("row").applyInArrow(lambda group: _tree(group, tokenizer), _OUT)  # one text's leaves
    return first.where("text is null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(long)
