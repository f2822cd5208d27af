"""Experience logs: range scans, recent context, streaks, numbering, episode statistics, prioritised rows, reward shaping.

Windows run per episode; global variants take block-wise ranks (operators.ordered) instead of one sorted task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import clamp
from .ordered import ranked


def time_range(log: DataFrame, start: int, end: int, kinds: tuple[int, int] | None = None) -> DataFrame:
    """Rows with start <= ticks <= end; kinds keeps one pair of (observation, action) kinds."""
    out = log.where(F.col("ticks").between(start, end))
    return out if kinds is None else out.where((F.col("obs_kind") == kinds[0]) & (F.col("act_kind") == kinds[1]))


def index_range(index: DataFrame, first: int, count: int, key: str = "id") -> DataFrame:
    return index.where((F.col(key) >= first) & (F.col(key) < first + count))


def by_episode(order: str = "step") -> W:
    return W.partitionBy("episode").orderBy(order)


def recall(log: DataFrame, k: int = 4, value: str = "obs", order: str = "step") -> DataFrame:
    """Adds `recent`: up to k earlier values of the episode, newest first."""
    return log.withColumn("recent", F.reverse(F.collect_list(value).over(by_episode(order).rowsBetween(-k, -1))))


def global_recall(log: DataFrame, k: int = 4, value: str = "obs", key: str = "id") -> DataFrame:
    """Adds `recent`: up to k earlier values of the whole log in the order of a unique number key, newest first.

    Every block of places also holds the last k rows before it, so no window spans the table."""
    width = max(10_000, k)
    own, late = F.floor(F.col("_at") / width), F.col("_at") % width >= width - k
    each = ranked(log, key, "_at").withColumn("_own", own).withColumn("_block", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    before = F.collect_list(value).over(W.partitionBy("_block").orderBy("_at").rowsBetween(-k, -1))
    return each.withColumn("recent", F.reverse(before)).where("_block = _own").drop("_at", "_own", "_block")


def next_values(log: DataFrame, value: str = "obs", order: str = "step") -> DataFrame:
    return log.withColumn(f"next_{value}", F.lead(value).over(by_episode(order)))


def streaks(log: DataFrame, order: str = "step") -> DataFrame:
    """Adds `streak`: how many equal acts precede this one without a break, within the episode."""
    changed = F.coalesce((F.col("act") != F.lag("act").over(by_episode(order))).cast("int"), F.lit(1))
    marked = log.withColumn("_run", changed)
    marked = marked.withColumn("_run", F.sum("_run").over(by_episode(order).rowsBetween(W.unboundedPreceding, 0)))
    return marked.withColumn("streak", (F.row_number().over(W.partitionBy("episode", "_run").orderBy(order)) - 1).cast("int")).drop("_run")


def global_streaks(log: DataFrame, key: str = "id") -> DataFrame:
    """Adds `streak` over the whole log in the order of a unique number key, never reset by episodes."""
    at = ranked(log, key, "_at")
    before = at.select((F.col("_at") + 1).alias("_at"), F.col("act").alias("_last"))
    starts = at.join(before, "_at", "left").withColumn("_start", F.when(F.col("_last").eqNullSafe(F.col("act")), F.lit(None)).otherwise(F.col("_at")))
    blocks = starts.withColumn("_block", F.floor(F.col("_at") / 10_000))
    last = blocks.groupBy("_block").agg(F.max("_start").alias("_m"))
    carried = last.select("_block", F.max("_m").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    within = F.max("_start").over(W.partitionBy("_block").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    return blocks.join(carried, "_block").withColumn("streak", (F.col("_at") - F.coalesce(within, F.col("_before"))).cast("int")).drop("_at", "_last", "_start", "_block", "_before")


def raw_reward(reward: Column) -> Column:
    """The reward as logged."""
    return reward


def goal_reward(reward: Column, reached: Column, bonus: float = 1.0) -> Column:
    return reward + F.when(reached, bonus).otherwise(0.0)


def target_reward(reward: Column, act: Column, target: int, bonus: float = 0.5) -> Column:
    return reward + F.when(act == target, bonus).otherwise(0.0)


def repeat_penalty(reward: Column, streak: Column, window: int = 4, penalty: float = 0.2) -> Column:
    return reward - F.when(streak >= max(1, window), penalty).otherwise(0.0)


def composite(*rewards: Column) -> Column:
    """The sum of shaped rewards; each of them already holds the base reward."""
    out = F.lit(0.0)
    for r in rewards:
        out = out + r
    return out


def number_episodes(log: DataFrame, order: str = "id") -> DataFrame:
    """Adds `episode_no` and `step_no` per stream: an episode ends with a terminal row."""
    w = W.partitionBy("episode").orderBy(order)
    out = log.withColumn("episode_no", F.coalesce(F.sum(F.col("terminal").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    return out.withColumn("step_no", (F.row_number().over(W.partitionBy("episode", "episode_no").orderBy(order)) - 1).cast("int"))


def episode_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("episode").agg(F.count(F.lit(1)).alias("steps"), F.sum("reward").alias("total_reward"), F.bool_or("terminal").alias("succeeded"), F.min("ticks").alias("start_ticks"), F.max("ticks").alias("end_ticks"))


def telemetry(log: DataFrame, order: str = "step") -> DataFrame:
    """Adds running n, sum, mean and the time since the step before, in milliseconds."""
    w = by_episode(order).rowsBetween(W.unboundedPreceding, 0)
    return log.withColumns({"n": F.count(F.lit(1)).over(w), "reward_sum": F.sum("reward").over(w), "reward_mean": F.avg("reward").over(w), "step_ms": (F.col("ticks") - F.lag("ticks").over(by_episode(order))) / 10_000.0})


def batches(log: DataFrame, size: int = 256, key: str = "id") -> DataFrame:
    """Adds `batch`, `size` rows each in the order of a unique number key."""
    return ranked(log, key, "batch").withColumn("batch", F.floor(F.col("batch") / size))


def prioritized(log: DataFrame, k: int, alpha: float = 0.6, key: str = "id") -> DataFrame:
    """The k rows with the highest alpha |reward| + (1 - alpha) recency; recency runs from 0 (oldest) towards 1."""
    placed = ranked(log, key, "_at")
    n = log.agg(F.count(F.lit(1)).alias("_n"))
    scored = placed.crossJoin(F.broadcast(n))  # one row
    return scored.withColumn("priority", alpha * F.abs("reward") + (1 - alpha) * F.col("_at") / F.col("_n")).drop("_at", "_n").orderBy(F.desc("priority"), key).limit(k)


def clamp_action(log: DataFrame, actions: int) -> DataFrame:
    return log.withColumn("act", clamp(F.col("act"), 0, actions - 1))
