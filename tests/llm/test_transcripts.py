import itertools
import random

import numpy as np

from glyphmill.llm import transcripts as t


def weigh(model, obs, opens, path):
    e = model.scores(obs)
    s = model.start[path[0]] + e[0][path[0]]
    for k in range(1, len(obs)):
        s += (model.turn if opens[k] else model.line)[path[k - 1], path[k]] + e[k][path[k]]
    return s


def brute(model, obs, opens):
    return max(weigh(model, obs, opens, path) for path in itertools.product(range(t.N), repeat=len(obs)))


def test_viterbi_equals_brute_force():
    rng = random.Random(3)
    model = t.Model({("turn", 1, 2): 50, ("turn", 2, 1): 40, ("start", 0, 1): 30, ("f3", 1, 1): 9, ("f3", 2, 3): 9})
    for _ in range(40):
        obs = [tuple(rng.randrange(s) for s in t.SIZES) for _ in range(6)]
        opens = [rng.random() < 0.5 for _ in obs]
        path, v = model.viterbi(obs, opens, model.start)
        best = brute(model, obs, opens)
        assert abs(v.max() - best) < 1e-9 and abs(weigh(model, obs, opens, path) - best) < 1e-9


def conversations(rng, n):
    rows = []
    for c in range(n):
        for k in range(rng.randrange(1, 9) if c else 700):  # conversation 0 holds a large share of all rows
            role = ["user", "assistant"][k % 2]
            body = " ".join(["word"] * (rng.randrange(3, 20) if role == "user" else rng.randrange(60, 200))) + ("?" if role == "user" else ".\nMore.")
            rows.append((c, k, role, body))
    return rows


def test_roles_and_borders(spark):
    rows = conversations(random.Random(5), 60)
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {(r.conv_id, r.turn): r for r in t.parse(df).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[c, k].role_pred == role for c, k, role, _ in rows]) > 0.95
    one = {(r.conv_id, r.turn): r.role_pred for r in t.parse(df.coalesce(1)).collect()}
    assert one == {k: r.role_pred for k, r in got.items()}
    wide = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = {(r.conv_id, r.turn): r.role_pred for r in t.parse(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wide[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", wide[1])
    assert many == one


def test_markers_and_rendering(spark):
    text = "System: be kind\nUser: hello there\nhow are you?\nAssistant: fine"
    rows = [(1, 0, text), (2, 0, None), (2, None, ""), (None, 1, "### Instruction:\nDo it"), (3, 0, "x " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r for r in t.parse(df).collect()}
    assert got[1, 0].rendered == "<|system|>\nbe kind\n<|end|>\n<|user|>\nhello there\nhow are you?\n<|end|>\n<|assistant|>\nfine\n<|end|>\n"
    assert got[1, 0].n_turns == 3 and got[None, 1].role_pred == "user" and len(got) == 5
    assert t.parse(df.limit(0)).count() == 0


def test_counts_do_not_depend_on_the_dealing():
    rng = random.Random(8)
    rows = [{"conv_id": c, "idx": 0, "turn": k, "text": f"line {k}", "role": rng.choice([*t.ROLES, None]), "learn": True} for c in range(12) for k in range(rng.randrange(1, 6))]
    for i, r in enumerate(rows):
        r["idx"] = i

    def counted(cuts):
        found, edges = {}, []
        for pid, (a, b) in enumerate(itertools.pairwise([0, *cuts, len(rows)])):
            for r in t._count(t.pa.Table.from_pylist([{**r, "pid": pid} for r in rows[a:b]])).to_pylist():
                if r["pid"] is None:
                    found[r["kind"], r["a"], r["b"]] = found.get((r["kind"], r["a"], r["b"]), 0) + r["n"]
                else:
                    edges.append((r["pid"], r["kind"], r["conv"], r["a"]))
        for k, n in t.stitch(edges).items():
            found[k] = found.get(k, 0) + n
        return found

    turns, starts = {}, {}
    for before, r in zip([None, *rows], rows):
        inside = before is not None and before["conv_id"] == r["conv_id"]
        if r["role"] and not inside:
            starts[r["role"]] = starts.get(r["role"], 0) + 1
        if r["role"] and inside and before["role"]:
            turns[before["role"], r["role"]] = turns.get((before["role"], r["role"]), 0) + 1
    whole = counted([])
    assert {k: n for k, n in whole.items() if k[0] == "turn"} == {("turn", t.ROLES.index(a), t.ROLES.index(b)): n for (a, b), n in turns.items()}
    assert {k: n for k, n in whole.items() if k[0] == "start"} == {("start", 0, t.ROLES.index(a)): n for a, n in starts.items()}
    for _ in range(20):
        assert counted(sorted(rng.sample(range(1, len(rows)), rng.randrange(1, 9)))) == whole
    assert counted(range(1, len(rows))) == whole
