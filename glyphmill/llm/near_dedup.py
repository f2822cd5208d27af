"""Near-duplicate groups by b-bit MinHash.

One pass over the texts makes, for each document, its distinct word shingles, 128 minima under 128 hash functions, 32 band
keys of four minima each, and a packed signature of the low two bits of every minimum (four longs). Documents with equal
sets collapse into a class before anything is compared. Classes that share a band key are candidates; the packed
signatures estimate their similarity by bit counts, corrected for chance agreement of two-bit values; what is left is
confirmed on the full shingle sets of both texts. Components of confirmed links come from hooking and pointer jumping.

Skew. A band key is never gathered into one task: its size and its central member come from partial aggregates, and its
members meet the central one through a join that Spark can split. Keys of at most SMALL members give their few pairs
outright (at most SMALL/2 a member). Larger keys give a star around their central member, the one whose band keys have the
most members: in a family of near copies that is the text the others were made from. The members of all large keys that
still hold several components (texts that share a passage, families joined by few links) then meet exactly: by a prefix
filter on their rarest shingles, joined by equality, which yields every pair of different components that can be similar
enough. Texts that only share a passage have other rare shingles and seldom meet there. No member is dropped. Before that,
as long as a step links more members than it leaves, the components that meet in a large key are compared once more, one
member for each and another one in another key; this only saves work for the exact step.

At similarity 0.75 two classes miss every one of the 32 bands with probability (1 - 0.75^4)^32 = 6e-6.

Defined results: a null or blank text has an empty set, n_shingles 0, and stands alone. Texts of fewer words than a shingle
have one shingle, the whole sequence. Rows that repeat a doc_id answer each for their own text. A null doc_id stays out of
all groups: component_id null, kept true. No rows in, no rows out. Further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, constants, few, mix, save, sliced, word_hashes

ROWS, BANDS, BITS = 4, 32, 2
HASHES = ROWS * BANDS
#: Members of a band key up to which its pairs are written out.
SMALL = 8
#: A candidate goes on to the full sets if its estimate is within five standard errors (0.046 each) of the threshold.
MARGIN = 0.25
#: Bits of the slots in which shingles are counted to order them by rarity.
TALLY = 20

_A = constants(HASHES, 101) | np.uint64(1)
_B = constants(HASHES, 202)
_PLACE = constants(64, 303) | np.uint64(1)
_SHORT = constants(64, 404)
_BAND = constants(BANDS, 505)
_LOW = 0x5555555555555555


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of lower-cased (A-Z) texts, sorted by text, and each one's text number."""
    h, doc = word_hashes([t.lower() for t in texts])
    n = len(h)
    count = np.bincount(doc, minlength=len(texts))
    full = np.zeros(0, np.int64)
    s = np.zeros(0, np.uint64)
    if n >= words:
        full = np.flatnonzero(doc[: n - words + 1] == doc[words - 1 :])
        s = np.zeros(len(full), np.uint64)
        for j in range(words):
            s += h[full + j] * _PLACE[j]
        s = mix(s)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        first = np.searchsorted(doc, short)
        rest = [np.sum(np.append(h[f : f + count[d]] * _PLACE[: count[d]], _SHORT[count[d]]), dtype=np.uint64) for d, f in zip(short, first)]
        s = np.concatenate((s, mix(np.array(rest, np.uint64))))
    of = np.concatenate((doc[full], short)).astype(np.int64)
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    if len(s):
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (of[1:] != of[:-1])))
        s, of = s[new], of[new]
    return s, of


def signatures(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and packed low bits (texts x 4) of non-empty sets that begin at first."""
    minima = np.empty((HASHES, len(first)), np.uint64)
    v = np.empty_like(s)
    for k in range(HASHES):
        np.multiply(s, _A[k], out=v)
        v += _B[k]
        v >>= np.uint64(32)
        minima[k] = np.minimum.reduceat(v, first)
    bands = np.repeat(_BAND[:, None], len(first), axis=1)
    for j in range(ROWS):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + minima[j::ROWS])
    low = minima & np.uint64((1 << BITS) - 1)
    at = (np.arange(HASHES) % (64 // BITS) * BITS).astype(np.uint64)
    packed = np.bitwise_or.reduce((low << at[:, None]).reshape(-1, 64 // BITS, len(first)), axis=1)
    return bands.T, packed.T


_SIGN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        ids = batch.column(0)
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        for at, part in chunks(texts):
            s, of = shingles(part, words)
            n = np.bincount(of, minlength=len(part))
            has = np.flatnonzero(n)
            keys = np.zeros((2, len(part)), np.uint64)
            bands, bits = np.zeros((0, BANDS), np.uint64), np.zeros((0, HASHES * BITS // 64), np.uint64)
            if len(has):
                first = np.searchsorted(of, has)
                keys[0, has] = np.add.reduceat(s, first)
                keys[1, has] = np.add.reduceat(mix(s + np.uint64(7)), first)
                bands, bits = signatures(s, first)
            lists = []
            for m in (bands, bits):
                offsets = np.concatenate(([0], np.cumsum(n > 0) * m.shape[1])).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).view(np.int64).ravel())))
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(n.astype(np.int64)), *(pa.array(k.view(np.int64)) for k in keys), *lists], schema=_SIGN)


def similar_bits(a: str, b: str) -> Column:
    """Jaccard estimate from two packed signatures: the share of equal two-bit values, corrected for chance (1/4)."""
    differ = sum((F.bit_count((x := F.col(a)[i].bitwiseXOR(F.col(b)[i])).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW))) for i in range(HASHES * BITS // 64)), F.lit(0))
    chance = 1 / (1 << BITS)
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def _confirm(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        a, b, ta, tb = batch.columns
        texts = [(t or "").encode() for pair in zip(ta.to_pylist(), tb.to_pylist()) for t in pair]
        good = np.zeros(len(a), bool)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < 1 << 20):
                size += len(texts[end]) + len(texts[end + 1])
                end += 2
            s, of = shingles(texts[at:end], words)
            n = np.bincount(of, minlength=end - at).reshape(-1, 2).sum(axis=1)
            order = np.lexsort((s, of // 2))
            t, p = s[order], of[order] // 2
            both = np.bincount(p[1:][(t[1:] == t[:-1]) & (p[1:] == p[:-1])], minlength=len(n))
            good[at // 2 : end // 2] = (100 * both >= percent * (n - both)) & (n > 0)
            at = end
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' full shingle sets are similar enough; docs: doc_id, text."""
    ids = save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = save(docs.join(few(ids, ids.count()), "doc_id", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(partial(_confirm, words=words, percent=percent), "a long, b long")


def _tally(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << TALLY, np.int64)
    for batch in sliced(batches):
        for _, part in chunks([(t or "").encode() for t in batch.column(0).to_pylist()]):
            total += np.bincount((shingles(part, words)[0] >> np.uint64(64 - TALLY)).astype(np.int64), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])


def _rare(batches: Iterator[pa.RecordBatch], words: int, percent: int, tally: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each text (doc_id, root, text) the rarest shingles, of which a similar text of at most its size must have one: (key, doc_id, root, n, at, first).

    A similar text of at least its size must have one of those marked first.
    """
    for batch in sliced(batches):
        ids, roots = (c.to_numpy() for c in batch.columns[:2])
        for start, part in chunks([(t or "").encode() for t in batch.column(2).to_pylist()]):
            s, of = shingles(part, words)
            order = np.lexsort((s, tally[(s >> np.uint64(64 - TALLY)).astype(np.int64)], of))
            s = s[order]
            n = np.bincount(of, minlength=len(part))[of]
            at = np.arange(len(of)) - np.searchsorted(of, of)
            keep = at <= n - -(-percent * n // 100)
            first = at <= n - -(-2 * percent * n // (100 + percent))
            columns = [s.view(np.int64), ids[start + of], roots[start + of], n, at, first]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["key", "doc_id", "root", "n", "at", "first"])


def by_rare_shingles(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a < b) of members (doc_id, root) of different roots, among them every one that is similar enough.

    Prefix filter: under any one order of all shingles, two similar texts share one of the first of each. The order is by
    the members that have a shingle, counted in 2^TALLY slots (a fixed size, for the driver too); shingles in a slot go by hash.
    """
    texts = save(docs.join(few(members, members.count()), "doc_id").select("doc_id", "root", "text"), "members")
    slots = texts.select("text").mapInArrow(partial(_tally, words=words), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    tally = np.zeros(1 << TALLY, np.uint32)
    tally[slots["slot"].to_numpy()] = np.minimum(slots["n"].to_numpy(), 0xFFFFFFFF)
    rows = save(texts.mapInArrow(partial(_rare, words=words, percent=percent, tally=tally), "key long, doc_id long, root long, n long, at long, first boolean"), "rare")
    several = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("first").alias("first")).where("least < most and first").select("key")
    rows = save(rows.join(several, "key", "left_semi"), "met")
    x, y = (rows.select("key", *(F.col(c).alias(f"{c}_{end}") for c in ("doc_id", "root", "n", "at", "first"))) for end in "xy")
    both = x.where("first_x").join(y, "key").where("root_x <> root_y and (n_x < n_y or (n_x = n_y and doc_id_x < doc_id_y))")
    # The first shingle that two texts share leaves at most the rest of each as overlap.
    able = both.where((100 * F.col("n_x") >= percent * F.col("n_y")) & ((100 + percent) * F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= percent * (F.col("n_x") + F.col("n_y"))))
    return able.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of edges (a, b): root is the smallest id that can be reached.

    Every root hooks to its smallest smaller neighbour, chains of hooks are halved until flat, and edges are drawn again
    between roots, until none is left; each step is a written table.
    """
    links = save(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct(), "links")
    ids = links.select(F.explode(F.array("hi", "lo")).alias("id")).distinct()
    labels = ids.withColumn("root", F.col("id"))
    while not links.isEmpty():
        hook = save(links.groupBy("hi").agg(F.min("lo").alias("to")).select(F.col("hi").alias("v"), "to"), "hook")
        while True:
            up = hook.select(F.col("v").alias("to"), F.col("to").alias("up"))
            far = hook.join(up, "to", "left").select("v", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved"))
            hook = save(far, "hook")
            if hook.where("moved").isEmpty():
                break
            hook = hook.drop("moved")
        hook = hook.select("v", "to")

        def lift(df: DataFrame, col: str) -> DataFrame:
            return df.join(hook.select(F.col("v").alias(col), "to"), col, "left").withColumn(col, F.coalesce("to", col)).drop("to")

        labels = save(lift(labels, "root"), "labels")
        moved = lift(lift(links, "hi"), "lo")
        links = save(moved.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi > lo").distinct(), "links")
    return labels


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = save(source.mapInArrow(partial(_sign, words=words), "doc_id long, n long, key1 long, key2 long, bands array<long>, bits array<long>"), "signed")
    known = signed.where("n > 0 and doc_id is not null")
    key = ["key1", "key2", "n"]
    classes = save(known.groupBy(key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    firsts = known.join(classes.select("rep", *key), [known.doc_id == F.col("rep"), *(known[k] == classes[k] for k in key)], "left_semi").select("doc_id", "bands", "bits").dropDuplicates(["doc_id"])
    reps = save(firsts, "reps")

    def estimated(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(reps.select(F.col("doc_id").alias(end), F.col("bits").alias(f"bits_{end}")), end)
        return pairs.withColumn("like", similar_bits("bits_a", "bits_b")).where(F.col("like") >= percent / 100 - MARGIN).select("a", "b", "like")

    labels = reps.sparkSession.createDataFrame([], "id long, root long")

    def rooted(df: DataFrame, col: str, root: str = "root") -> DataFrame:
        return df.join(labels.select(F.col("id").alias(col), F.col("root").alias(root)), col, "left").withColumn(root, F.coalesce(root, col))

    def link(candidates: DataFrame) -> int:
        """Confirms candidates (a < b), the likeliest partner of each b first: most others then lie in one component. How many links it found."""
        nonlocal labels
        n = 0
        pairs = save(estimated(candidates.distinct()), "pairs")
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("like", "a")).alias("a")).select("a", "b")
        for wanted in (best, pairs.select("a", "b").join(best, ["a", "b"], "left_anti")):
            wanted = save(rooted(rooted(wanted, "a", "ra"), "b", "rb").where("ra != rb"), "wanted")
            if wanted.isEmpty():
                continue
            found = save(confirm(wanted.select("a", "b"), source, words, percent).join(wanted, ["a", "b"]).select("ra", "rb"), "found")
            if new := found.count():
                n += new
                # Only roots are linked anew: the components found before move as a whole.
                moved = save(components(found.toDF("a", "b")).select("id", "root"), "moved")
                lifted = labels.join(moved.toDF("root", "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
                labels = save(lifted.unionByName(moved.join(labels, "id", "left_anti").select("id", "root")), "labels")
        return n

    def sized(rows: DataFrame) -> DataFrame:
        """Rows of keys with more than one row, with the key's size; written, so that what follows is not bound to tasks by key."""
        return save(rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "key"), "sized")

    def candidates(members: DataFrame) -> DataFrame:
        """Pairs of members (key, doc_id, met, size) of keys: all of a small key's, a star around the member with the largest met of others."""
        small = members.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("doc_id")).alias("m"))
        within = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        outright = small.select(F.explode(within).alias("p")).select("p.*")
        large = members.where(F.col("size") > SMALL)
        central = large.groupBy("key").agg(F.max_by("doc_id", F.struct("met", -F.col("doc_id"))).alias("centre"))
        stars = large.join(central, "key").where("doc_id != centre").select(F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b"))
        return outright.unionByName(stars)

    def unsettled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows (key, doc_id) of keys whose members lie in several components, with their root, and their members (doc_id, root).

        Components only grow, so no other key can link any more."""
        root = save(rooted(rows.select("doc_id").distinct(), "doc_id"), "roots")
        placed = save(rows.join(root, "doc_id"), "placed")
        several = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
        meet = save(placed.join(several, "key", "left_semi"), "unsettled")
        return meet, save(meet.select("doc_id", "root").distinct(), "left")

    shared = sized(reps.select("doc_id", F.explode("bands").alias("key")))
    met = shared.join(shared.where(F.col("size") > SMALL).groupBy("doc_id").agg(F.sum("size").alias("met")), "doc_id", "left")
    n = link(candidates(met))
    meet, left = unsettled(shared.where(F.col("size") > SMALL).select("key", "doc_id"))
    turn = 0
    # A turn pays while the step before linked more than it left: families too wide for one star. It changes no result, only what is left to the exact step.
    while n > left.select("root").distinct().count() > 0:
        n = link(candidates(sized(meet.groupBy("key", "root").agg(F.min_by("doc_id", F.xxhash64("doc_id", "key", F.lit(turn))).alias("doc_id"), F.count(F.lit(1)).alias("met")))))
        (meet, left), turn = unsettled(meet.select("key", "doc_id")), turn + 1
    if not left.isEmpty():
        link(by_rare_shingles(left, source, words, percent))
    by_class = classes.join(labels.select(F.col("id").alias("rep"), "root"), "rep", "left").select(*key, F.coalesce("root", "rep").alias("root"))
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    grouped = known.select("doc_id", *key).join(by_class, key).select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
