"""Approximate nearest neighbours by low-dimensional stable projections indexed with kd-trees.

Vectors are projected on DIMS Gaussian (2-stable) directions: for two vectors at distance d, the squared projected distance is
d squared times a chi-square variable of DIMS degrees. A query takes neighbours in the projection in growing order and
verifies each on the original vectors; it stops when the chi-square test says that, with probability CERTAIN, no vector
beyond the present projected radius is nearer than the k-th best one found. Each true neighbour is therefore found with at
least that probability. Largest inner products become nearest neighbours by one further coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, which is 0 for queries.

The index has two levels: a kd-tree over the projections of a bounded sample (SAMPLE vectors) deals all vectors to cells;
a cell with many vectors, which equal vectors cannot be split into fewer, is salted into shards of about SHARD; each shard
builds its own kd-tree of leaves. Queries first search their home cell; the radius that its k-th best allows then decides
which other cells they visit. Equal query vectors are searched once, for one neighbour more than asked, and each query
drops itself; a query whose vec_id has several rows is searched for itself, without those rows. Nothing but the sample, the cells' sizes and M reaches the driver.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part. Vectors of several lengths, between which
there is no inner product, are searched length by length. Very long vectors are like others. Ties go to the smaller vec_id. Rows that repeat a vec_id are candidates of their own; a query's own rows are those with its vec_id. Equal rows ask
once; each different vector of a vec_id asks for itself and has its own ranks. Fewer than k candidates: all of them. No rows in, no rows out. Further columns are not read.
"""

from __future__ import annotations

from functools import partial
from math import exp, gamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

DIMS, CERTAIN = 8, 0.97
SAMPLE, SHARD, LEAF = 20_000, 8192, 64


def chi_square(p: float, n: int) -> float:
    """The p-quantile of the chi-square distribution with n degrees, by bisection on the series of its distribution function."""

    def below(x: float) -> float:
        a, x = n / 2, x / 2
        term = total = 1 / a
        k = 0
        while term > total * 1e-15:
            k += 1
            term *= x / (a + k)
            total += term
        return total * exp(-x + a * log(x)) / gamma(a)

    lo, hi = 1e-9, 10.0 * n + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree over points: leaves of at most `leaf` points (halving the widest side), their boxes, and each point's leaf."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.leaves: list[np.ndarray] = []
        self.splits: list[tuple] = []  # (axis, value, left, right); a leaf is ~number
        self.root = self._grow(points, np.arange(len(points)), leaf)
        self.low = np.array([points[i].min(axis=0) for i in self.leaves])
        self.high = np.array([points[i].max(axis=0) for i in self.leaves])

    def _grow(self, points: np.ndarray, at: np.ndarray, leaf: int) -> int:
        side = np.ptp(points[at], axis=0) if len(at) else np.zeros(1)
        axis = int(side.argmax())
        if len(at) <= leaf or side[axis] == 0:
            self.leaves.append(at)
            return ~(len(self.leaves) - 1)
        x = points[at, axis]
        cut = np.partition(x, len(x) // 2)[len(x) // 2]
        left = x < cut
        if not left.any():
            left = x <= cut
        me = len(self.splits)
        self.splits.append(())
        self.splits[me] = (axis, cut if (x[~left] >= cut).all() and (x[left] < cut).all() else np.nextafter(cut, np.inf), self._grow(points, at[left], leaf), self._grow(points, at[~left], leaf))
        return me

    def find(self, points: np.ndarray) -> np.ndarray:
        """The leaf whose region each point lies in."""
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = ~node
            elif len(at):
                axis, cut, left, right = self.splits[node]
                go = points[at, axis] < cut
                todo += [(left, at[go]), (right, at[~go])]
        return out

    def regions(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """The unbounded boxes that the splits give each leaf."""
        low, high = np.full((len(self.leaves), dims), -np.inf), np.full((len(self.leaves), dims), np.inf)
        todo = [(self.root, np.full(dims, -np.inf), np.full(dims, np.inf))]
        while todo:
            node, lo, hi = todo.pop()
            if node < 0:
                low[~node], high[~node] = lo, hi
            else:
                axis, cut, left, right = self.splits[node]
                a, b = hi.copy(), lo.copy()
                a[axis] = b[axis] = cut
                todo += [(left, lo, a), (right, b, hi)]
        return low, high


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) from boxes (columns)."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        x = points[:, k : k + 1]
        gap = np.maximum(np.maximum(low[:, k] - x, x - high[:, k]), 0)
        out += gap * gap
    return out


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed in the same order whatever else is computed."""
    return (queries * vectors).sum(axis=1)


def search(queries: np.ndarray, start: np.ndarray, ids: np.ndarray, vectors: np.ndarray, project: np.ndarray, top: float, k: int, own_id: np.ndarray, alone: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the (ids, scores) of its k best in one shard, where it is alone without rows of its own_id; start: squared distances of k-th best found elsewhere."""
    dim = vectors.shape[1]
    norm = (vectors * vectors).sum(axis=1)
    points = vectors @ project[:dim] + np.sqrt(np.maximum(top - norm, 0))[:, None] * project[dim]
    at = queries @ project[:dim]
    own = (queries * queries).sum(axis=1) + top
    tree, factor = Tree(points, LEAF), chi_square(CERTAIN, DIMS)
    far = box_distance(at, tree.low, tree.high)
    order = np.argsort(far, axis=1, kind="stable")
    best = np.full((len(queries), k), -np.inf)
    bound = start.copy()  # squared distance of the k-th best so far
    tested = np.zeros_like(far, bool)
    step, done = 4, np.zeros(len(queries), bool)
    begun = 0
    kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
    while not done.all() and begun < len(tree.leaves):
        now = np.zeros_like(tested)
        rows = np.flatnonzero(~done)
        cols = order[rows, begun : begun + step]
        near = np.take_along_axis(far[rows], cols, axis=1) <= bound[rows, None] * factor
        now[np.repeat(rows, cols.shape[1])[near.ravel()], cols.ravel()[near.ravel()]] = True
        for leaf in np.flatnonzero(now.any(axis=0)):
            q, members = np.flatnonzero(now[:, leaf]), tree.leaves[leaf]
            s = queries[q] @ vectors[members].T
            if alone[q].any():
                s[alone[q][:, None] & (own_id[q][:, None] == ids[members])] = -np.inf
            both = np.concatenate((best[q], s), axis=1)
            best[q] = -np.partition(-both, k - 1, axis=1)[:, :k]
            least = best[q].min(axis=1)
            for i, row, low in zip(q, s, least):
                hit = np.flatnonzero((row >= low - 1e-9) & (row > -np.inf))
                if len(hit):
                    kept[i].append((members[hit], row[hit]))
        kth = best.min(axis=1)
        bound = np.minimum(bound, np.where(np.isfinite(kth), np.maximum(own - 2 * kth, 0) + 1e-12, np.inf))
        begun += cols.shape[1]
        if begun < len(tree.leaves):
            done |= far[np.arange(len(far)), order[:, begun]] > bound * factor
        step *= 2
    out = []
    for i, parts in enumerate(kept):
        m = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        rough = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
        m = m[rough >= best[i].min() - 1e-9] if len(rough) else m
        s = exact(np.broadcast_to(queries[i], (len(m), dim)), vectors[m])
        pick = np.lexsort((ids[m], -s))[:k]
        out.append((ids[m][pick], s[pick]))
    return out


def _shard(left: pd.DataFrame, right: pd.DataFrame, project: np.ndarray, top: float, k: int) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({"query": pd.Series([], dtype="int64"), "ids": pd.Series([], dtype=object), "scores": pd.Series([], dtype=object)})
    right = right.sort_values("vec_id", kind="stable")
    found = search(np.stack(left["v"].to_numpy()).astype(float), left["bound"].to_numpy(float), right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()).astype(float), project, top, k, left["own"].to_numpy(), left["alone"].to_numpy(bool))
    return pd.DataFrame({"query": left["query"].to_numpy(), "ids": [f[0] for f in found], "scores": [f[1] for f in found]})


def _cells(batches, tree: Tree, project: np.ndarray, top: float):
    for pdf in batches:
        if len(pdf):
            v = np.stack(pdf["v"].to_numpy()).astype(float)
            norm = (v * v).sum(axis=1)
            points = v @ project[:-1] + np.sqrt(np.maximum(top - norm, 0))[:, None] * project[-1]
            yield pdf.assign(cell=tree.find(points).astype("int32"))


def _visits(batches, low: np.ndarray, high: np.ndarray, project: np.ndarray, factor: float, tree: Tree):
    """The cells of each query: its home where no bound is known yet, else all others within the radius."""
    for pdf in batches:
        if len(pdf):
            v = np.stack(pdf["v"].to_numpy()).astype(float)
            points = v @ project[:-1]
            home = tree.find(points)
            if "bound" not in pdf:
                yield pdf.assign(bound=np.inf, cell=home.astype("int32"))
                continue
            near = box_distance(points, low, high) <= pdf["bound"].to_numpy(float)[:, None] * factor
            near[np.arange(len(home)), home] = False
            rows, cells = np.nonzero(near)
            if len(rows):
                yield pdf.iloc[rows].assign(cell=cells.astype("int32"))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)")
    lengths = sound.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).collect()  # one row a vector length
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, (dim, rows, top) in enumerate(sorted(lengths)):
        found = _of_length(sound, dim, rows, top, every, k, seed)
        out = found if i == 0 else out.unionByName(found)
    return out


def _of_length(sound: DataFrame, dim: int, rows: int, top: float, every: int, k: int, seed: int) -> DataFrame:
    """The search among the vectors (vec_id, v) with dim components: rows of them, none with a squared norm above top."""
    rng = np.random.default_rng(seed)
    project = rng.standard_normal((dim + 1, DIMS))
    clean = save(sound.where(F.size("v") == dim), "vectors")
    share = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / rows)) + 1
    drawn = np.array([r.v for r in clean.where(share).select("v").limit(2 * SAMPLE).collect()])
    if not len(drawn):
        drawn = np.array([r.v for r in clean.select("v").limit(SAMPLE).collect()])
    points = drawn @ project[:-1] + np.sqrt(np.maximum(top - (drawn * drawn).sum(axis=1), 0))[:, None] * project[-1]
    tree = Tree(points, max(2, len(drawn) * SHARD // max(rows, SHARD)))
    low, high = tree.regions(DIMS)
    placed = save(clean.mapInPandas(partial(_cells, tree=tree, project=project, top=top), "vec_id long, v array<double>, cell int"), "cells")
    shards = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"))  # one row a cell, about rows / SHARD
    index = placed.join(shards, "cell").withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), "shards").cast("int")).select("cell", "shard", "vec_id", "v")
    rows_of = clean.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))
    several = rows_of.groupBy("vec_id").agg((F.sum("n") > 1).alias("alone"))
    asked = save(rows_of.join(several, "vec_id").select("vec_id", "v", "alone", F.when(F.col("alone"), F.col("vec_id")).otherwise(0).alias("own")), "asked")
    one = save(asked.select("v", "own", "alone").distinct().select(F.monotonically_increasing_id().alias("query"), "v", "own", "alone"), "queries")
    visit = "query long, v array<double>, own long, alone boolean, bound double, cell int"

    def look(queries: DataFrame) -> DataFrame:
        """The k + 1 nearest (a query finds itself) in each shard of the cells that the queries visit."""
        dealt = queries.join(shards, "cell").select("query", "v", "own", "alone", "bound", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        both = dealt.groupBy("cell", "shard").cogroup(index.groupBy("cell", "shard"))
        found = both.applyInPandas(lambda a, b: _shard(a, b, project, top, k + 1), "query long, ids array<long>, scores array<double>")
        return found.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("query", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))

    steps = partial(_visits, low=low, high=high, project=project, factor=chi_square(CERTAIN, DIMS), tree=tree)
    home = save(look(one.mapInPandas(steps, visit)), "home")
    worst = home.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("score")).alias("least"), F.array_sort(F.collect_list("score")).alias("s"))
    kth = worst.select("query", F.when(F.col("n") >= k + 1, F.get("s", F.col("n") - (k + 1))).alias("kth"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    bound = F.when(F.col("kth").isNotNull(), F.greatest(F.lit(0.0), norm + top - 2 * F.col("kth")) + 1e-12).otherwise(F.lit(float("inf")))
    onward = one.join(kth, "query", "left").select("query", "v", "own", "alone", bound.alias("bound"))
    away = save(look(onward.mapInPandas(steps, visit)), "away")
    return _ranked(home.unionByName(away), asked, one, k)


def _ranked(found: DataFrame, asked: DataFrame, one: DataFrame, k: int) -> DataFrame:
    order = lambda c: F.array_sort(F.transform(c, lambda f: F.struct((-f["score"]).alias("far"), f["vec_id"].alias("vec_id"))))
    lists = found.groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("f")).select("query", F.slice(order(F.col("f")), 1, k + 1).alias("f"))  # k + 1 a shard visited
    ids = asked.join(one, ["v", "own", "alone"]).select(F.col("vec_id").alias("query_id"), "query")
    mine = ids.join(lists, "query").select("query_id", F.slice(F.filter("f", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("f"))
    return mine.select("query_id", F.posexplode("f").alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
