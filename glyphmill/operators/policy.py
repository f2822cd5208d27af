"""Linear softmax policies: probabilities, decisions, gradients, ordered replay, snapshots."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


@dataclass
class Policy:
    weights: np.ndarray  # actions x state
    bias: np.ndarray

    @classmethod
    def fresh(cls, state: int, actions: int, seed: int = 123) -> Policy:
        return cls(np.random.default_rng(seed).normal(0, 0.1 / np.sqrt(state), (actions, state)), np.zeros(actions))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights.T + self.bias
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def step(self, x: np.ndarray, act: int, reward: float, rate: float = 0.05) -> None:
        """One policy-gradient step without a baseline."""
        g = self.probabilities(x)
        g[act] -= 1
        self.weights -= rate * reward * np.outer(g, x)
        self.bias -= rate * reward * g

    def to_json(self) -> str:
        return json.dumps({"StateDim": self.weights.shape[1], "ActionDim": self.weights.shape[0], "W": self.weights.ravel().tolist(), "B": self.bias.tolist()})

    @classmethod
    def from_json(cls, text: str, state: int | None = None, actions: int | None = None) -> Policy:
        m = json.loads(text)
        if (state or m["StateDim"]) != m["StateDim"] or (actions or m["ActionDim"]) != m["ActionDim"]:
            raise ValueError("the snapshot has other dimensions")
        return cls(np.array(m["W"], float).reshape(m["ActionDim"], m["StateDim"]), np.array(m["B"], float))


def write_atomically(path: str, text: str) -> None:
    """Writes a small model file so that readers see the old or the new one."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temporary, path)


def probabilities(log: DataFrame, policy: Policy, obs: str = "obs") -> DataFrame:
    return log.withColumn("probs", V.softmax(V.logits(F.col(obs), policy.weights.tolist(), policy.bias.tolist())))


def decide(log: DataFrame, policy: Policy, u, obs: str = "obs") -> DataFrame:
    """Adds `decision`, drawn from the probabilities with the uniform column u."""
    return probabilities(log, policy, obs).withColumn("decision", V.draw(F.col("probs"), u).cast("int"))


def batch_gradient(log: DataFrame, policy: Policy, obs: str = "obs") -> DataFrame:
    """(action, i, grad): the summed gradient reward (p - 1[act]) x of one batch; i = -1 is the bias. Map-side sums, no order."""
    rows = probabilities(log, policy, obs).where(F.col("act").isNotNull() & F.col(obs).isNotNull())
    each = rows.select("reward", F.posexplode("probs").alias("action", "p"), "act", F.concat(F.array(F.lit(1.0)), F.transform(obs, lambda x: x.cast("double"))).alias("x"))
    g = each.select("action", (F.col("reward") * (F.col("p") - (F.col("act") == F.col("action")).cast("double"))).alias("g"), F.posexplode("x").alias("i", "x"))
    return g.groupBy("action", (F.col("i") - 1).alias("i")).agg(F.sum(F.col("g") * F.col("x")).alias("grad"))


def apply_gradient(policy: Policy, gradient: DataFrame, rate: float) -> Policy:
    """The policy after one batch step; the gradient has one row a weight."""
    w, b = policy.weights.copy(), policy.bias.copy()
    for r in gradient.collect():
        if r.i < 0:
            b[r.action] -= rate * r.grad
        else:
            w[r.action, r.i] -= rate * r.grad
    return Policy(w, b)


def replay(log: DataFrame, policy: Policy, rate: float = 0.05, by: str = "episode", order: str = "step", obs: str = "obs") -> DataFrame:
    """(by, weights, bias, steps): an ordered replay of each group on its own copy of the policy."""
    start = policy.to_json()

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Policy.from_json(start)
        for x, act, r in pdf.sort_values(order)[[obs, "act", "reward"]].itertuples(index=False):
            p.step(np.asarray(x, float), int(act), float(r), rate)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "weights": [p.weights.ravel().tolist()], "bias": [p.bias.tolist()], "steps": [len(pdf)]})

    kind = log.schema[by].dataType.simpleString()
    return log.select(by, order, obs, "act", "reward").groupBy(by).applyInPandas(learn, f"{by} {kind}, weights array<double>, bias array<double>, steps long")


def train_from_log(log: DataFrame, policy: Policy, start: int, end: int, rate: float = 0.05) -> DataFrame:
    """Replays the rows of a ticks range; batch borders do not change an ordered replay."""
    from .experience import time_range

    return replay(time_range(log, start, end), policy, rate)
