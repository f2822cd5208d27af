"""Transcript parsing: a hidden Markov model over the lines of conversations recovers who speaks.

A line shows a speaker marker (or none), how it ends, its length, and whether it opens a row. Hidden states are the roles;
between rows the roles move by learned turn transitions, inside a row they stay unless a marker says otherwise. Viterbi
gives the likeliest roles, and each run of lines of one role is rendered as a canonical turn without its marker.

A conversation may be of any length. Rows are dealt by ranges of (conversation, turn), so a long conversation spreads over
several parts; each part gives the max-plus transfer matrix of a conversation that crosses its border (at most two a part).
Chaining those fixes the role at every border, and all parts are then decoded on their own, to the same path as a whole.

Parameters are counted over all rows that have a known role, across the borders of parts too; add-one smoothing keeps them finite, and without such rows the
markers and a plain alternation decide. Defined results: a null text is one empty line. A null turn sorts first; equal turns
sort by text. A null conversation is a conversation of its own. No rows in, no rows out. Further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

ROLES = ["system", "user", "assistant"]
#: Speaker markers at a line's start, by role.
MARKERS = {
    "system": r"(?:<\|?system\|?>|\[system\]|#+\s*system\s*:?|\*{0,2}system(?: prompt)?\*{0,2}\s*[:>])",
    "user": r"(?:<\|?(?:user|human)\|?>|\[(?:user|inst|human)\]|#+\s*(?:instruction|user|human|question)\s*:?|\*{0,2}(?:user|human|question|q|me|customer)\*{0,2}\s*[:>])",
    "assistant": r"(?:<\|?(?:assistant|bot)\|?>|\[(?:assistant|/inst)\]|#+\s*(?:response|assistant|answer)\s*:?|\*{0,2}(?:assistant|answer|a|ai|bot|agent|model)\*{0,2}\s*[:>])",
}
_MARKER = [re.compile(r"\s*" + MARKERS[r], re.IGNORECASE) for r in ROLES]
#: Sizes of the emission features: marker, ending, length, row opening.
SIZES = (4, 4, 6, 4)
N = len(ROLES)
STAY = 0.98


def observe(line: str, opens: bool, first: bool, words_in_row: int) -> tuple[int, int, int, int]:
    """The features of a line: marker (0 none), ending, length class, and what opening a row of that length tells (0: it opens none)."""
    marker = next((i + 1 for i, m in enumerate(_MARKER) if m.match(line)), 0)
    s = line.rstrip()
    ending = 0 if not s else 1 if s[-1] == "?" else 2 if s[-1] in ".!" else 3
    n = len(s.split())
    length = sum(n >= k for k in (1, 6, 16, 41, 101))
    return marker, ending, length, (1 + sum(words_in_row >= k for k in (30, 100))) if opens else 0


class Model:
    def __init__(self, counts: dict[tuple[str, int, int], int] | None = None) -> None:
        counts = counts or {}
        known = any(k[0] == "turn" for k in counts)
        turn = np.array([[counts.get(("turn", a, b), 0) + (1.0 if known else 1.0 + 20 * (a != b and b > 0)) for b in range(N)] for a in range(N)])
        start = np.array([counts.get(("start", 0, b), 0) + 1.0 for b in range(N)])
        self.start = np.log(start / start.sum())
        self.turn = np.log(turn / turn.sum(axis=1, keepdims=True))
        self.line = np.log(np.full((N, N), (1 - STAY) / (N - 1)) + np.eye(N) * (STAY - (1 - STAY) / (N - 1)))
        self.emit = []
        for f, size in enumerate(SIZES):
            e = np.array([[counts.get((f"f{f}", r, v), 0) + 1.0 for v in range(size)] for r in range(N)])
            if f == 0:  # a marker is trusted whether or not the counted rows have any
                e = np.array([[50.0] + [50.0 if v == r else 0.01 for v in range(N)] for r in range(N)])
            self.emit.append(np.log(e / e.sum(axis=1, keepdims=True)))

    def scores(self, obs: list[tuple]) -> np.ndarray:
        o = np.array(obs)
        return sum(e.T[o[:, f]] for f, e in enumerate(self.emit))

    def viterbi(self, obs: list[tuple], opens: list[bool], enter: np.ndarray, leave: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(path, scores of the last line's roles) given the roles' scores before the first line; leave fixes the last role."""
        e, v, back = self.scores(obs), None, np.zeros((len(obs), N), np.int8)
        for t in range(len(obs)):
            if t == 0:
                v = enter + e[0]
            else:
                s = v[:, None] + (self.turn if opens[t] else self.line)
                back[t] = s.argmax(axis=0)
                v = s.max(axis=0) + e[t]
        path = np.zeros(len(obs), np.int8)
        path[-1] = v.argmax() if leave is None else leave
        for t in range(len(obs) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path, v

    def entering(self, role: int | None, opens: bool) -> np.ndarray:
        return self.start if role is None else (self.turn if opens else self.line)[role]


def _runs(table: pa.Table):
    """(conversation, rows) of a part in order."""
    rows = table.sort_by("idx").to_pylist()
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end]["conv_id"] == rows[at]["conv_id"]:
            end += 1
        yield rows[at]["conv_id"], rows[at:end]
        at = end


def _lines(rows: list[dict], first: bool) -> tuple[list[str], list[tuple], list[bool], list[int]]:
    """Lines, their features, whether each opens a row, and its row's number; first: the conversation begins here."""
    lines, obs, opens, of = [], [], [], []
    for k, r in enumerate(rows):
        text = r["text"] or ""
        n = len(text.split())
        for i, line in enumerate(text.split("\n")):
            lines.append(line)
            obs.append(observe(line, i == 0, first and k == 0, n))
            opens.append(i == 0)
            of.append(k)
    return lines, obs, opens, of


def _count(table: pa.Table) -> pa.Table:
    """Counts of a part; its first and last row come along (kinds `first` and `last`), since a conversation may cross parts."""
    found: dict[tuple, int] = {}
    edges: list[tuple] = []
    pid = table["pid"][0].as_py()

    def add(*key) -> None:
        found[key] = found.get(key, 0) + 1

    for place, (conv, rows) in enumerate(_runs(table)):
        last = None
        for k, r in enumerate(rows):
            role = ROLES.index(r["role"]) if r["learn"] and r["role"] in ROLES else None
            if k == 0 and place == 0:
                edges.append(("first", role, None, 1, pid, str(conv)))
            if role is not None:
                for o in _lines([r], False)[1]:
                    for f, v in enumerate(o):
                        add(f"f{f}", role, v)
                if last is not None:
                    add("turn", last, role)
                elif k == 0 and place:
                    add("start", 0, role)
            last = role
    edges.append(("last", last, None, 1, pid, str(conv)))
    every = [(*k, n, None, None) for k, n in found.items()] + edges
    types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string())
    return pa.table({name: pa.array([e[i] for e in every], t) for i, (name, t) in enumerate(zip(("kind", "a", "b", "n", "pid", "conv"), types))})


def stitch(edges: list[tuple]) -> dict[tuple, int]:
    """Turns and starts at the borders of parts, from their (pid, kind, conversation, role or None)."""
    found: dict[tuple, int] = {}
    before: tuple[str, int | None] | None = None
    for _, kind, conv, role in sorted(edges, key=lambda e: (e[0], e[1])):  # first, then last
        if kind == "first" and role is not None:
            inside = before is not None and before[0] == conv
            key = ("turn", before[1], role) if inside else ("start", 0, role)
            if key[1] is not None:
                found[key] = found.get(key, 0) + 1
        before = (conv, role)
    return found


def _transfer(table: pa.Table, model: Model) -> pa.Table:
    """Max-plus matrices of the first and the last conversation of a part: row 0 from a start, row 1 + r from role r before it."""
    runs = list(_runs(table))
    ends = runs[:1] + (runs[-1:] if len(runs) > 1 else [])
    flat = []
    for _, rows in ends:
        _, obs, opens, _ = _lines(rows, False)
        flat.append(np.stack([model.viterbi(obs, opens, model.entering(r, True))[1] for r in (None, *range(N))]).ravel().tolist())
    return pa.table({"pid": pa.array([table["pid"][0].as_py()] * len(ends), pa.int32()), "place": pa.array([0, 1][: len(ends)], pa.int32()), "conv": pa.array([str(c) for c, _ in ends], pa.string()), "m": pa.array(flat, pa.list_(pa.float64()))})


def _decode(table: pa.Table, model: Model, borders: dict[tuple[int, int], tuple[int | None, int | None]]) -> pa.Table:
    out: dict[str, list] = {"conv_id": [], "turn": [], "role_pred": [], "n_turns": [], "rendered": []}
    pid = table["pid"][0].as_py()
    runs = list(_runs(table))
    for place, (conv, rows) in enumerate(runs):
        key = (pid, 0 if place == 0 else 1 if place == len(runs) - 1 else 2)
        before, leave = borders.get(key, (None, None))
        lines, obs, opens, of = _lines(rows, before is None)
        path, _ = model.viterbi(obs, opens, model.entering(before, True), leave)
        at = 0
        for k, r in enumerate(rows):
            end = at
            turns: list[tuple[int, list[str]]] = []
            while end < len(of) and of[end] == k:
                role = int(path[end])
                body = _MARKER[obs[end][0] - 1].sub("", lines[end], count=1).lstrip() if obs[end][0] else lines[end]
                if turns and turns[-1][0] == role and not (obs[end][0] and any(turns[-1][1])):
                    turns[-1][1].append(body)
                else:
                    turns.append((role, [body]))
                end += 1
            out["conv_id"].append(conv)
            out["turn"].append(r["turn"])
            out["role_pred"].append(ROLES[turns[0][0]])
            out["n_turns"].append(len(turns))
            out["rendered"].append("".join(f"<|{ROLES[a]}|>\n{chr(10).join(b).strip()}\n<|end|>\n" for a, b in turns))
            at = end
    return pa.table({"conv_id": pa.array(out["conv_id"], pa.int64()), "turn": pa.array(out["turn"], pa.int64()), "role_pred": pa.array(out["role_pred"], pa.string()), "n_turns": pa.array(out["n_turns"], pa.int32()), "rendered": pa.array(out["rendered"], pa.string())})


def chain(matrices: list[tuple[int, int, str, list[float]]], model: Model) -> dict[tuple[int, int], tuple[int | None, int | None]]:
    """(role before, role at the end) of every piece (part, place) of a conversation that crosses parts."""
    pieces = sorted(matrices)
    borders = {}
    at = 0
    while at < len(pieces):
        end = at + 1
        while end < len(pieces) and pieces[end][2] == pieces[at][2] and pieces[end][0] != pieces[end - 1][0] and pieces[end][1] == 0:
            end += 1
        if end - at > 1:
            m = [np.array(p[3]).reshape(N + 1, N) for p in pieces[at:end]]
            v, back = m[0][0], []
            for x in m[1:]:
                s = v[:, None] + x[1:]
                back.append(s.argmax(axis=0))
                v = s.max(axis=0)
            leave = [int(v.argmax())]
            for b in back[::-1]:
                leave.append(int(b[leave[-1]]))
            leave = leave[::-1]
            for k, p in enumerate(pieces[at:end]):
                borders[p[0], p[1]] = (leave[k - 1] if k else None, leave[k])
        at = end
    return borders


def parse(rows: DataFrame, learn_from=None) -> DataFrame:
    """conv_id, turn, role_pred, n_turns, rendered for every row of rows (conv_id, turn, text and, if known, role).

    learn_from: a condition on rows whose roles may be counted; all by default.
    """
    has = "role" in rows.columns
    learn = F.coalesce(learn_from if learn_from is not None else F.lit(True), F.lit(False))
    role = F.when(learn, F.col("role").cast("string")) if has else F.lit(None).cast("string")  # other roles aren't even an order among ties
    chosen = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"), role.alias("role"), learn.alias("learn"))
    order = ["conv_id", "turn", F.xxhash64("text", "role")]
    dealt = chosen.repartitionByRange(*order).sortWithinPartitions("conv_id", "turn", "text", "role")
    parts = save(dealt.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("idx")), "lines")
    grouped = lambda f, schema: parts.groupBy("pid").applyInArrow(lambda t: f(t), schema)
    counted = grouped(_count, "kind string, a int, b int, n long, pid int, conv string")
    counts = counted.groupBy("kind", "a", "b", "pid", "conv").agg(F.sum("n").alias("n")).collect()  # a row a parameter, two a part
    total = Counter({(r.kind, r.a, r.b): r.n for r in counts if r.pid is None})
    total.update(stitch([(r.pid, r.kind, r.conv, r.a) for r in counts if r.pid is not None]))
    model = Model(dict(total))
    pieces = grouped(lambda t: _transfer(t, model), "pid int, place int, conv string, m array<double>").collect()  # two rows a part
    borders = chain([(r.pid, r.place, r.conv, r.m) for r in pieces], model)
    return grouped(lambda t: _decode(t, model, borders), "conv_id long, turn long, role_pred string, n_turns int, rendered string")
