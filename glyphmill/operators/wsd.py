"""Word-sense scoring by two linear projections: a context's and a gloss's hashed features meet in a dot product."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def context(tokens, target, reach: int = 5):
    """The tokens up to `reach` places around the target, clipped to the sentence."""
    left = F.greatest(F.lit(0), target - reach)
    return F.slice(tokens, (left + 1).cast("int"), (F.least(F.size(tokens) - 1, target + reach) - left + 1).cast("int"))


def _hash(text: str, features: int) -> dict[int, float]:
    """Hashed word uni- and bigrams, as functions.text does it on columns."""
    tokens = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    out: dict[int, float] = {}
    for n in (1, 2):
        for i in range(len(tokens) - n + 1):
            h = T.FNV_OFFSET
            for b in "".join(tokens[i : i + n]).encode("utf-16-le")[::2]:
                h = (h ^ b) * T.FNV_PRIME % T.U32
            out[h % features] = out.get(h % features, 0.0) + 1
    return out


class BiEncoder:
    """Context and gloss projections. compat keeps only the last token of the context window, as older models did."""

    def __init__(self, features: int = 4096, dim: int = 128, seed: int = 123, compat: bool = False) -> None:
        rng = np.random.default_rng(seed)
        self.features, self.dim, self.compat = features, dim, compat
        self.wc, self.wg = ((rng.random((features, dim)) * 2 - 1) * 0.02 for _ in range(2))

    def _context(self, tokens: list[str]) -> dict[int, float]:
        out: dict[int, float] = {}
        for t in tokens[-1:] if self.compat else tokens:
            for f, x in _hash(t, self.features).items():
                out[f] = out.get(f, 0.0) + x
        return out

    @staticmethod
    def _project(w: np.ndarray, x: dict[int, float]) -> np.ndarray:
        return np.array(list(x.values())) @ w[list(x)] if x else np.zeros(w.shape[1])

    def scores(self, tokens: list[str], glosses: list[str]) -> np.ndarray:
        yc = self._project(self.wc, self._context(tokens))
        return np.array([self._project(self.wg, _hash(g, self.features)) @ yc for g in glosses])

    def predict(self, tokens: list[str], glosses: list[str]) -> int:
        return int(self.scores(tokens, glosses).argmax())

    def step(self, tokens: list[str], glosses: list[str], gold: int, rate: float = 0.05) -> float:
        """One step of gradient descent; both sides move by the activations before the step."""
        xc, xg = self._context(tokens), [_hash(g, self.features) for g in glosses]
        yc, yg = self._project(self.wc, xc), np.array([self._project(self.wg, x) for x in xg])
        s = yg @ yc
        p = np.exp(s - s.max())
        p /= p.sum()
        loss = -np.log(max(1e-8, p[gold]))
        p[gold] -= 1
        dyc = p @ yg
        for f, x in xc.items():
            self.wc[f] -= rate * x * dyc
        for g, x in zip(p, xg):
            for f, v in x.items():
                self.wg[f] -= rate * v * g * yc
        return float(loss)

    def to_json(self) -> str:
        return json.dumps({"CtxFeatures": self.features, "GlsFeatures": self.features, "Dim": self.dim, "Wc": self.wc.ravel().tolist(), "Wg": self.wg.ravel().tolist(), "Seed": 123})

    @classmethod
    def from_json(cls, text: str) -> BiEncoder:
        m = json.loads(text)
        out = cls(m["CtxFeatures"], m["Dim"])
        out.wc, out.wg = (np.array(m[k], float).reshape(m["CtxFeatures"], m["Dim"]) for k in ("Wc", "Wg"))
        return out


def train(examples: DataFrame, model: BiEncoder, rate: float = 0.05, epochs: int = 1, checkpoint=None, every: int = 10_000) -> list[dict]:
    """Ordered training on examples (ex_id, tokens, target_index, cands, gold_index), read in ex_id order; accuracy is taken after each update."""
    rows = examples.select("ex_id", context(F.col("tokens"), F.col("target_index")).alias("ctx"), F.transform("cands", lambda c: c["gloss"]).alias("glosses"), "gold_index").orderBy("ex_id")
    history, seen = [], 0
    for _ in range(epochs):
        losses, right = [], []
        for r in rows.toLocalIterator():
            losses.append(model.step(r.ctx, r.glosses, r.gold_index, rate))
            right.append(model.predict(r.ctx, r.glosses) == r.gold_index)
            seen += 1
            if checkpoint and seen % every == 0:
                checkpoint(model, seen)
        history.append({"loss": float(np.mean(losses)) if losses else 0.0, "accuracy": float(np.mean(right)) if right else 0.0})
    return history


def predict(examples: DataFrame, model: BiEncoder) -> DataFrame:
    """(ex_id, gold_index, pred) of examples with candidates."""
    shared = examples.sparkSession.sparkContext.broadcast(model)
    rows = examples.select("ex_id", "gold_index", context(F.col("tokens"), F.col("target_index")).alias("ctx"), F.transform("cands", lambda c: c["gloss"]).alias("glosses"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"ex_id": pdf["ex_id"], "gold_index": pdf["gold_index"], "pred": [shared.value.predict(list(c), [g or "" for g in gs]) for c, gs in zip(pdf["ctx"], pdf["glosses"])]})

    return rows.mapInPandas(run, "ex_id long, gold_index int, pred int")
