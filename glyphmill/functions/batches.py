"""Counting inside Arrow batches: n-grams by dense ids and hashed n-gram buckets, in numpy passes over whole batches.

Each batch yields its distinct grams with their counts, which is the partial aggregate; only those are shuffled.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import BRACKETS, FNV_OFFSET, FNV_PRIME

#: Tokens, or characters of texts, that one pass works on (more if a single row has more); rows that leave at once.
TOKENS, CHARACTERS, OUT = 500_000, 3_000_000, 50_000
#: Unicode's white space, and what only Python takes for it.
SPACE, SEPARATORS = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", "\x1c\x1d\x1e\x1f"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _cut(sizes: np.ndarray, most: int = TOKENS) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows whose sizes sum to at most `most`, or of a single larger row."""
    first, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _sizes(column: pa.Array) -> np.ndarray:
    """Elements of lists, characters of texts; nulls have none."""
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    return pc.fill_null(pc.utf8_length(column) if text else pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def words_of(text: str | None) -> list[str]:
    """The words of a text as functions.text splits what it normalises: NFKC, lower case, brackets dropped, cut at white space."""
    if not text:
        return []
    text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    for c in BRACKETS:
        if c in text:
            text = text.replace(c, "")
    if any(c in text for c in SEPARATORS):  # white space to Python, not to Unicode
        return [w for w in re.split(SPACE, text) if w]
    return text.split()


def token_runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """(rows, tokens, tokens of each row) by runs of rows; the column holds token lists, or texts, which are split here. Nulls have no token."""
    for batch in batches:
        lists = pa.types.is_list(batch.column(column).type)
        for first, end in _cut(_sizes(batch.column(column)), TOKENS if lists else CHARACTERS):
            part = batch.slice(first, end - first)
            if lists:
                yield part, part.column(column).flatten().cast(pa.string()), _sizes(part.column(column))
            else:
                words = [words_of(t) for t in part.column(column).to_pylist()]
                yield part, pa.array(chain.from_iterable(words), pa.string()), np.fromiter(map(len, words), np.int64, len(words))


def word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, cnt) of the distinct words of each run of texts."""
    for _, tokens, _ in token_runs(batches):
        found = tokens.dictionary_encode()
        n = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(n)], names=["word", "cnt"])


#: Added to n: rows of contexts that end a sequence, and of places that are scored.
ENDS, EVENTS = 100, 200


def gram_blobs(batches: Iterator[pa.RecordBatch], order: int, least: int, parts: int, bos: str = "<s>", eos: str = "</s>", only: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """(part, size, blob): the n-grams, n = least..order, of padded token lists or texts with their counts in each run, dealt
    by a hash of the whole gram into `parts` and compressed. Null lists have none; a null text is an empty one. With `only`,
    those whose context, or which as a context, is among these."""
    for tokens, sizes in _sequences(batches):
        grams = list(_gram_counts(tokens, sizes, order, bos, eos))[least - 1 :]
        n = np.repeat(np.arange(least, order + 1), [len(g[2]) for g in grams])
        ctx, tok = (pa.concat_arrays([g[k] for g in grams]) for k in (0, 1))
        cnt, mark = (np.concatenate([g[k] for g in grams]) for k in (2, 3))
        if only is not None:
            wanted = pa.array(only, pa.string())
            whole = pc.if_else(pc.equal(ctx, ""), tok, pc.binary_join_element_wise(ctx, tok, " "))
            keep = pc.or_(pc.is_in(ctx, wanted), pc.is_in(whole, wanted))
            ctx, tok, keep = ctx.filter(keep), tok.filter(keep), keep.to_numpy(zero_copy_only=False)
            n, cnt, mark = n[keep], cnt[keep], mark[keep]
        yield _packed(n, ctx, tok, cnt, (mark >> np.uint64(17)) % np.uint64(parts))


def level_blobs(batches: Iterator[pa.RecordBatch], order: int, parts: int, events: bool, bos: str = "<s>", eos: str = "</s>") -> Iterator[pa.RecordBatch]:
    """As gram_blobs from n = 2, but dealt by a hash of the context, so that all about a context meets: n-grams and the contexts
    that end sequences (n + ENDS), or with `events` the places to be scored (n + EVENTS)."""
    for tokens, sizes in _sequences(batches):
        found = []
        for n, (ctx, tok, cnt, mark, under, ends) in enumerate(_gram_counts(tokens, sizes, order, bos, eos, order if events else 0), 1):
            if n > 1:
                found.append((np.full(len(cnt), n + EVENTS * events), ctx, tok, cnt, under))
            if not events and n < order:  # contexts of n tokens that nothing follows
                last, times = np.unique(ends, return_counts=True)
                whole = (tok if n == 1 else pc.binary_join_element_wise(ctx, tok, " ")).take(pa.array(last))
                found.append((np.full(len(last), n + 1 + ENDS), whole, pa.array([""] * len(last), pa.string()), times, mark[last]))
        n, cnt, under = (np.concatenate([g[k] for g in found]) for k in (0, 3, 4))
        ctx, tok = (pa.concat_arrays([g[k] for g in found]) for k in (1, 2))
        yield _packed(n, ctx, tok, cnt, ((under * MIX) >> np.uint64(17)) % np.uint64(parts))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for rows, tokens, sizes in token_runs(batches):
        if pa.types.is_list(rows.column(0).type):
            sizes = sizes[rows.column(0).is_valid().to_numpy(zero_copy_only=False)]
        if len(sizes):
            yield tokens, sizes


def gram_totals(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(n, cnt): how many n-grams the padded lists or texts of each run have, n = 1..order."""
    for _, sizes in _sequences(batches):
        n = np.arange(1, order + 1)
        yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(int(sizes.sum()) + len(sizes) * (order + 1 - n))], names=["n", "cnt"])


def _gram_counts(tokens: pa.Array, sizes: np.ndarray, order: int, bos: str, eos: str, start: int = 0) -> Iterator[tuple]:
    """By n: contexts, tokens, counts and hashes of the distinct n-grams that end at place `start` (from 1) or later, hashes of
    their contexts, and which gram ends each sequence."""
    encoded = pa.concat_arrays([tokens, pa.array([bos, eos])]).dictionary_encode()
    names, ids = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
    marks = np.fromiter((zlib.crc32(w.encode()) for w in names.to_pylist()), np.uint64, len(names)) + np.uint64(1)
    row_at = np.concatenate(([0], np.cumsum(sizes + order)[:-1]))
    place = np.arange(int((sizes + order).sum())) - np.repeat(row_at, sizes + order)  # within the padded row
    padded = np.full(len(place), ids[-2])
    inner = (place >= order - 1) & (place < np.repeat(sizes, sizes + order) + order - 1)
    padded[inner] = ids[:-2]
    padded[row_at + sizes + order - 1] = ids[-1]
    below, texts, under = np.zeros(len(padded), np.int64), pa.array([""]), np.zeros(1, np.uint64)  # the context of each place as a number, the contexts as texts and hashes
    for n in range(1, order + 1):
        at = np.flatnonzero(place >= n - 1)
        context = below[at - 1] if n > 1 else below[at]
        _, some, dense, cnt = np.unique(context * len(names) + padded[at], return_index=True, return_inverse=True, return_counts=True)
        ctx, tok = texts.take(pa.array(context[some])), names.take(pa.array(padded[at][some]))
        mark = (under[context[some]] + marks[padded[at][some]]) * MIX
        mark ^= mark >> np.uint64(29)
        dealt = slice(None)
        if start > n:
            late = place[at] >= start - 1
            dealt, cnt = np.unique(dense[late], return_counts=True)
            some = some[dealt]
        rows = (ctx, tok) if start <= n else (ctx.take(pa.array(dealt)), tok.take(pa.array(dealt)))
        yield *rows, cnt.astype(np.int64), mark[dealt], under[context[some]], dense[np.searchsorted(at, row_at + sizes + order - 1)]
        below = np.full(len(padded), -1)
        below[at] = dense
        texts, under = tok if n == 1 else pc.binary_join_element_wise(ctx, tok, " "), mark


def _bytes(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and the last ends, and the bytes they lie in."""
    offsets = np.frombuffer(items.buffers()[1], np.int32)[items.offset : items.offset + len(items) + 1]
    return offsets, np.frombuffer(items.buffers()[2] or b"", np.uint8)


def _packed(n: np.ndarray, ctx: pa.Array, tok: pa.Array, cnt: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    part, n, cnt = part[order], n[order].astype(np.uint8), cnt[order].astype(np.uint32)
    texts = [_bytes(a.take(pa.array(order))) for a in (ctx, tok)]
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    blobs, sizes = [], []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
        raw = b"".join([n[a:b].tobytes(), cnt[a:b].tobytes(), *(np.diff(o[a : b + 1]).tobytes() for o, _ in texts), *(x[o[a] : o[b]].tobytes() for o, x in texts)])
        sizes.append(b - a)
        blobs.append(zlib.compress(raw, 1))
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "size", "blob"])


def _unpacked(size: int, blob: bytes) -> pa.RecordBatch:
    raw = zlib.decompress(blob)
    n, cnt = np.frombuffer(raw, np.uint8, size), np.frombuffer(raw, np.uint32, size, size)
    at, texts = 13 * size, []
    for k in range(2):
        offsets = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.int32, size, (5 + 4 * k) * size)))).astype(np.int32)
        texts.append(pa.StringArray.from_buffers(size, pa.py_buffer(offsets), pa.py_buffer(raw[at : at + int(offsets[-1])])))
        at += int(offsets[-1])
    return pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), *texts, pa.array(cnt.astype(np.int64))], names=["n", "ctx", "tok", "cnt"])


def _summed_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """(n, ctx, tok, cnt) of one part after the other, from rows (part, size, blob) in the order of their parts."""
    last, held, rows = None, [], 0

    def summed() -> pa.Table:
        table = pa.Table.from_batches(held)
        return table.group_by(["n", "ctx", "tok"], use_threads=False).aggregate([("cnt", "sum")]).rename_columns(["n", "ctx", "tok", "cnt"]) if len(held) > 1 else table

    for batch in batches:
        for part, size, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if held and part != last:
                yield summed()
                held, rows = [], 0
            last = part
            held.append(_unpacked(size, blob))
            rows += size
            if rows > 4 * TOKENS and len(held) > 1 and held[0].num_rows < rows / 2:  # copies of common grams go early
                held = summed().combine_chunks().to_batches()
                rows = sum(x.num_rows for x in held)
    if held:
        yield summed()


def gram_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, ctx, tok, cnt), a part at a time."""
    for table in _summed_parts(batches):
        yield from table.to_batches(OUT)


def level_sums(batches: Iterator[pa.RecordBatch], level: int, events: bool) -> Iterator[pa.RecordBatch]:
    """From rows dealt by context, level n: (ctx, tok, times, c, followers, cc) of its n-grams, or of its places to be scored
    with `events`: times there, occurrences in the model, distinct followers and occurrences of the context (0: unseen).
    Level 0: (tok, times) as the number of contexts a token has in each part."""
    for table in _summed_parts(batches):
        table = table.combine_chunks()
        n = table["n"].to_numpy()
        if level == 0:
            names = table.filter(pa.array(n < ENDS))["tok"].combine_chunks().dictionary_encode()
            times = np.bincount(names.indices.to_numpy(), minlength=len(names.dictionary))
            none = np.zeros(len(times), np.int64)
            rows = [pa.array([""] * len(times), pa.string()), names.dictionary, times, none, none, none]
        else:
            table = table.filter(pa.array(n % 100 == level))
            n, cnt = table["n"].to_numpy(), table["cnt"].to_numpy()
            if not len(n):
                continue
            ctx, tok = (table[k].combine_chunks().dictionary_encode() for k in ("ctx", "tok"))
            who, code = ctx.indices.to_numpy().astype(np.int64), None
            code = who * len(tok.dictionary) + tok.indices.to_numpy()
            model, wanted = n < ENDS, n >= EVENTS if events else n < ENDS
            followers = np.bincount(who[model], minlength=len(ctx.dictionary))
            occurs = np.bincount(who[n < EVENTS], cnt[n < EVENTS], len(ctx.dictionary)).astype(np.int64)
            if events:
                order = np.argsort(code[model])
                known, counts = np.append(code[model][order], -1), np.append(cnt[model][order], 0)
                at = np.searchsorted(known[:-1], code[wanted])
                c = np.where(known[at] == code[wanted], counts[at], 0)
            else:
                c = cnt[wanted]
            take = pa.array(wanted)
            rows = [table["ctx"].combine_chunks().filter(take), table["tok"].combine_chunks().filter(take), cnt[wanted], c, followers[who[wanted]], occurs[who[wanted]]]
        yield from pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in rows], names=["ctx", "tok", "times", "c", "followers", "cc"]).to_batches(OUT)


def _low_bytes(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The low byte of every UTF-16 unit of all items, and each item's number of units."""
    whole = "".join(items.to_pylist()).encode("utf-16-le", "surrogatepass")
    sizes = pc.utf8_length(items).to_numpy(zero_copy_only=False).astype(np.int64)
    if sizes.sum() * 2 != len(whole):  # characters of two units
        sizes = np.array([len(x.encode("utf-16-le", "surrogatepass")) // 2 for x in items.to_pylist()], np.int64)
    return np.frombuffer(whole, np.uint8)[::2].astype(np.uint32), sizes


def _continue(h: np.ndarray, units: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """FNV-1a states h continued by units[start : start + size], longest items last so that each pass takes a tail."""
    order = np.argsort(size, kind="stable")
    h, start, size = h[order], start[order], size[order]
    for k in range(int(size[-1]) if len(size) else 0):
        live = np.searchsorted(size, k, "right")
        h[live:] = (h[live:] ^ units[start[live:] + k]) * np.uint32(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters of all texts: low bytes of their UTF-16 units, units of each character, characters of each text."""
    sizes = _sizes(texts)
    codes = np.frombuffer("".join(pc.fill_null(texts, "").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = codes > 0xFFFF
    if not wide.any():
        return codes & 0xFF, np.ones(len(codes), np.int64), sizes
    lengths = 1 + wide.astype(np.int64)
    units = np.repeat(codes, lengths)
    high = (np.cumsum(lengths) - lengths)[wide]
    rest = codes[wide] - 0x10000
    units[high], units[high + 1] = 0xD800 + (rest >> 10), 0xDC00 + (rest & 0x3FF)
    return units & 0xFF, lengths, sizes


def bucket_blobs(batches: Iterator[pa.RecordBatch], features: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """(key, size, blob) of rows (key, words[, text]): hashed runs of low..high neighbouring words, and characters, glued
    without a mark, as compressed buckets and counts; the rows of a run with an equal key are one."""
    for batch in batches:
        for first, end in _cut(sum(_sizes(c) for c in batch.columns[1:])):
            part = batch.slice(first, end - first)
            keys = part.column(0).dictionary_encode("encode")
            owner, found = keys.indices.to_numpy().astype(np.int64), []
            for column in part.columns[1:]:
                if pa.types.is_list(column.type):
                    sizes = _sizes(column)
                    units, lengths = _low_bytes(column.flatten())
                else:
                    units, lengths, sizes = _units(column)
                start = np.concatenate(([0], np.cumsum(lengths)))[: len(lengths)]
                row = np.repeat(np.arange(len(sizes)), sizes)
                state, at = np.full(len(row), FNV_OFFSET, np.uint32), np.arange(len(row))
                for n in range(1, high + 1):
                    fits = at + n - 1 < len(row)
                    at, state = at[fits], state[fits]
                    same = row[at + n - 1] == row[at]
                    at, state = at[same], state[same]
                    state = _continue(state, units, start[at + n - 1], lengths[at + n - 1])
                    if n >= low:
                        found.append(owner[row[at]] * features + state.astype(np.int64) % features)
            code = np.concatenate(found)
            if len(keys.dictionary) * features <= 4 * len(code):
                n = np.bincount(code, minlength=len(keys.dictionary) * features)
                code = np.flatnonzero(n)
                n = n[code]
            else:
                code, n = np.unique(code, return_counts=True)
            who = code // features
            starts = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.zeros(0, np.int64)
            blobs, sizes = [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(who)]):
                gaps = np.diff(code[a:b] % features, prepend=0).astype(np.uint32)
                blobs.append(zlib.compress(gaps.tobytes() + n[a:b].astype(np.uint32).tobytes(), 1))
                sizes.append(b - a)
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(who[starts])), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=["key", "size", "blob"])


def bucket_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bucket, n) from rows (key, size, blob) in which equal keys follow each other."""
    key, held, out, rows = None, [], [], 0

    def closed() -> tuple:
        bucket, n = (np.concatenate(x) for x in zip(*held))
        if len(held) > 1:
            bucket, at = np.unique(bucket, return_inverse=True)
            n = np.bincount(at, n.astype(np.float64)).astype(np.int64)
        return bucket, n

    def sent(kind: pa.DataType) -> pa.RecordBatch:
        keys = pa.array([k for k, _, _ in out], kind).take(pa.array(np.repeat(np.arange(len(out)), [len(b) for _, b, _ in out])))
        return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([b for _, b, _ in out]).astype(np.int32)), pa.array(np.concatenate([n for _, _, n in out]))], names=["key", "bucket", "n"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for k, size, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if held and k != key:
                out.append((key, *closed()))
                rows += len(out[-1][1])
                held = []
                if rows > OUT:
                    yield sent(kind)
                    out, rows = [], 0
            elif len(held) > 64:
                held = [closed()]
            raw = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
            key = k
            held.append((np.cumsum(raw[:size]), raw[size:]))
    if held:
        out.append((key, *closed()))
    if out:
        yield sent(kind)
