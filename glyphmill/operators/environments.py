"""Simulated sources: a grid world as a transition table, bandits, and episode rollouts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .policy import Policy


def grid_transitions(spark: SparkSession, width: int = 5, height: int = 5, goal: tuple[int, int] = (4, 4), cost: float = 0.01, bonus: float = 1.0) -> DataFrame:
    """(state, act, next_state, reward, at_goal) of every cell and act: 0 up, 1 right, 2 down, 3 left, 4 stays (any other act)."""
    if width <= 0 or height <= 0 or not (0 <= goal[0] < width and 0 <= goal[1] < height):
        raise ValueError("the grid must hold its goal")
    base = spark.range(width * height * 5).select((F.col("id") / 5).cast("int").alias("state"), (F.col("id") % 5).cast("int").alias("act"))
    x, y, a = F.col("state") % width, F.floor(F.col("state") / width), F.col("act")
    nx = F.when(a == 1, F.least(F.lit(width - 1), x + 1)).when(a == 3, F.greatest(F.lit(0), x - 1)).otherwise(x)
    ny = F.when(a == 0, F.greatest(F.lit(0), y - 1)).when(a == 2, F.least(F.lit(height - 1), y + 1)).otherwise(y)
    out = base.withColumn("next_state", (ny * width + nx).cast("int")).withColumn("at_goal", F.col("next_state") == goal[1] * width + goal[0])
    return out.select("state", "act", "next_state", (F.when(F.col("at_goal"), bonus).otherwise(0.0) - cost).alias("reward"), "at_goal")


def bandit(spark: SparkSession, steps: int, arms: int = 5, seed: int = 123, sigma: float = 1.0, drift: float = 0.0, runs: int = 1) -> DataFrame:
    """(episode, step, arm, mean, reward): every arm's reward at every step; means start Gaussian and, with drift, walk at random."""
    base = spark.range(runs * steps * arms).select((F.col("id") / (steps * arms)).cast("int").alias("episode"), (F.col("id") / arms % steps).cast("int").alias("step"), (F.col("id") % arms).cast("int").alias("arm"))
    start = F.first(F.randn(seed)).over(W.partitionBy("episode", "arm").orderBy("step"))
    walk = F.sum(F.randn(seed + 1) * drift).over(W.partitionBy("episode", "arm").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    return base.withColumn("mean", start + (walk if drift else F.lit(0.0))).withColumn("reward", F.col("mean") + sigma * F.randn(seed + 2))


def as_function(env):
    """An environment object with reset() and step(act) as one callable: without an act it resets, with one it steps."""
    return lambda act=None: env.reset() if act is None else env.step(act)


def rollout(spark: SparkSession, policy: Policy, episodes: int, most: int = 100, width: int = 5, height: int = 5, goal: tuple[int, int] = (4, 4), cost: float = 0.01, bonus: float = 1.0, learn: float = 0.0, seed: int = 123, shape=None) -> DataFrame:
    """Grid-world episodes as an experience log, each with its own seed. learn > 0 updates a copy of the policy by the shaped
    reward while the log keeps the raw one; shape(reward, act, streak) shapes it."""
    start = policy.to_json()

    def run(batches):
        for pdf in batches:
            rows = []
            for e in pdf["id"]:
                rng, p = np.random.default_rng((seed, int(e))), Policy.from_json(start)
                x, y = goal
                while (x, y) == goal:
                    x, y = int(rng.integers(width)), int(rng.integers(height))
                last, streak = -1, 0
                for step in range(most):
                    obs = np.zeros(width * height)
                    obs[y * width + x] = 1
                    act = min(int(np.searchsorted(np.cumsum(p.probabilities(obs)), rng.random())), len(p.bias) - 1)
                    x, y = min(width - 1, max(0, x + {1: 1, 3: -1}.get(act, 0))), min(height - 1, max(0, y + {2: 1, 0: -1}.get(act, 0)))
                    there = (x, y) == goal
                    reward = -cost + (bonus if there else 0.0)
                    streak = streak + 1 if act == last else 0
                    last = act
                    shaped = shape(reward, act, streak) if shape else reward
                    if learn:
                        p.step(obs, act, shaped, learn)
                    after = np.zeros(width * height)
                    after[y * width + x] = 1
                    end = there or step == most - 1
                    rows.append((int(e), step, obs.tolist(), act, reward, shaped, after.tolist(), end, there))
                    if end:
                        break
            yield pd.DataFrame(rows, columns=["episode", "step", "obs", "act", "reward", "shaped_reward", "next_obs", "terminal", "at_goal"])

    return spark.range(episodes).mapInPandas(run, "episode int, step int, obs array<float>, act int, reward double, shaped_reward double, next_obs array<float>, terminal boolean, at_goal boolean")
