"""Facility location vs brute force, greedy merge vs a set-based walk, change
LMI golden, vocabulary rule."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.operators import edits as ED
from sievekit.operators import models as MD
from sievekit.operators import select as SL
from sievekit.operators import shortcuts as SC


def _vectors(n, d=8, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d))


def test_greedy_matches_brute_force_single_block(spark):
    x = _vectors(40)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")
    got = SL.greedy_order(df, head=7).orderBy("order").select("id", "gain").collect()
    xn = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = xn @ xn.T
    chosen, cover = [], np.zeros(len(x))
    for _ in range(len(x)):
        g = [(-1e18 if j in chosen else round(np.maximum(sim[:, j] - cover, 0).sum(), 9)) for j in range(len(x))]
        j = int(np.argmax(g))
        chosen.append(j)
        cover = np.maximum(cover, sim[:, j])
    assert [r.id for r in got] == chosen


def test_facility_value_monotone_and_beats_random(spark):
    x = _vectors(300, seed=5)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")
    sel = SL.submodular_prune(df, [40, 60, 80], block_rows=100, head=30).select("prune_rate", "id")
    vals = {r.prune_rate: r.value for r in SL.objective(df, sel, set_cols=["prune_rate"], block_rows=100).collect()}
    assert vals[80] <= vals[60] <= vals[40]
    n20 = math.ceil(0.2 * 300)
    rnd = df.select("id").orderBy(F.md5(F.col("id").cast("string"))).limit(n20).withColumn("prune_rate", F.lit(80))
    rv = SL.objective(df, rnd, set_cols=["prune_rate"], block_rows=100).collect()[0].value
    assert vals[80] >= rv


def test_two_rounds_reach_the_exact_greedy_value(spark):
    """2,000 clustered vectors in blocks of 250: at every budget f(S) is at least 0.95 of the exact greedy's."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 2000)] + 0.6 * rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>").cache()
    got = [r.id for r in SL.greedy_order(df, block_rows=250, head=64).orderBy("order").select("id").collect()]
    assert sorted(got) == list(range(2000))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    best, _ = SL.greedy(sim)
    value = lambda ids: np.maximum(sim[:, ids].max(axis=1), 0).sum()
    for budget in (5, 20, 64, 100, 400, 1000, 1900):
        assert value(got[:budget]) >= 0.95 * value(best[:budget])


def test_block_pairs_are_exact(spark):
    x = _vectors(157, seed=9)
    x[20] = x[21]
    x[30] = 0
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)] + [(900, [1.0] * 8, 7)],
                               "id long, embedding array<double>, label int").repartition(3)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n > 0, n, 1)
    sim = np.round(u @ u.T, 9) + 0.0
    for rows in (2048, 40):
        near = {r.id: (r.neighbour, r.similarity) for r in SL.nearest_neighbour(df, ["label"], block_rows=rows).collect()}
        assert near.pop(900) == (None, None) and len(near) == 157
        for i, (j, s) in near.items():
            others = [k for k in range(157) if k != i and k % 2 == i % 2]
            assert s == pytest.approx(max(sim[i, k] for k in others), abs=1e-8)
            assert j == min(k for k in others if sim[i, k] > max(sim[i, m] for m in others) - 1e-9)
        some = [3, 20, 77]
        sel = df.where(F.col("id").isin(some))
        plain = df.where("id < 900")
        got = SL.objective(plain, sel, block_rows=rows).first()
        cover = np.maximum(sim[:, some].max(axis=1), 0)
        assert got.value == pytest.approx(cover.sum(), abs=1e-6) and got.n_selected == 3
        gains = {r.id: r.gain for r in SL.marginal_gains(plain, sel, block_rows=rows).collect()}
        want = np.maximum(u @ u.T - cover[:, None], 0).sum(axis=0)
        assert max(abs(gains[i] - want[i]) for i in range(157)) < 1e-6


def test_merge_greedy_matches_set_walk(spark):
    """Random marks against a walk over plain sets, by masks and by stored blocks."""
    rng = np.random.default_rng(4)
    n, names = 120, [f"w{k}" for k in range(40)]
    marks = {(("(A *)", "(B *)")[k % 2], w): np.flatnonzero(rng.random(n) < rng.uniform(0.02, 0.4)).tolist() for k, w in enumerate(names)}
    y = (rng.random(n) < 0.4).astype(int).tolist()
    inc = spark.createDataFrame([(i, y[i], *f) for f, ids in marks.items() for i in ids], "uid long, y int, tpl string, yield string")
    ex = spark.createDataFrame([(i, y[i]) for i in range(n)], "uid long, y int")
    totals = [y.count(0), y.count(1)]
    topk = SC.topk_features(SC.feature_mi(inc, ex), 40).cache()
    count = lambda ids: [sum(y[i] == k for i in ids) for k in (0, 1)]
    want = {}
    for r in topk.orderBy("topk_no").collect():
        groups = want.setdefault(r["tpl"][1], [([], set(), 0.0)])
        ids = set(marks[r["tpl"], r["yield"]])
        scores = []
        for _, has, mi in groups:
            new = _mi(count(has | ids), totals)
            scores.append((new > mi) * new - (new < mi) * new)
        if all(s < 0 for s in scores):
            groups.append(([r["yield"]], ids, _mi(count(ids), totals)))
        else:
            j = int(np.argmax(scores))
            members, has, _ = groups[j]
            groups[j] = ([*members, r["yield"]], has | ids, _mi(count(has | ids), totals))
    flat = sorted((k, g, m, len(has)) for k, gs in want.items() for g, (m, has, _) in enumerate(gs))
    assert any(g for _, g, _, _ in flat)
    for size in (1 << 28, 1):
        got = sorted((r.group_key, r.g, r.members, r["count"]) for r in SC.merge_greedy(inc, ex, topk, mask_bytes=size).collect())
        assert got == flat


def test_change_lmi_golden(spark):
    rows = [("a", False)] * 3 + [("a", True)] + [("b", False)] * 2 + [("b", True)] * 4
    df = spark.createDataFrame(rows, "tpl string, changed boolean")
    got = {r.tpl: (r.lmi_unchanged, r.lmi_changed) for r in ED.change_lmi(df).collect()}
    assert got["a"] == pytest.approx((0.08219487784336595, -0.05792358687259492), abs=1e-12)
    assert got["b"] == pytest.approx((-0.06164615838252448, 0.07969412546936064), abs=1e-12)


def _mi(counts, totals):
    cells = [(c + 1, t - c + 1) for c, t in zip(counts, totals)]
    tot = sum(a + b for a, b in cells)
    pz1 = sum(a for a, _ in cells) / tot
    s = 0.0
    for a, b in cells:
        py = (a + b) / tot
        s += a / tot * math.log((a / tot) / (py * pz1)) + b / tot * math.log((b / tot) / (py * (1 - pz1)))
    return s


def test_merge_greedy_hand_worked(spark):
    """Ten positive (0-9) and ten negative (10-19) examples.  ``p`` and ``q`` mark
    positives only, so their union tells more than either; ``m`` marks negatives
    only, and its union with a positive group tells almost nothing, so it must
    open a group of its own; ``z`` hangs under another root."""
    marks = {("(A *)", "p"): range(0, 4), ("(A *)", "q"): range(4, 7), ("(A *)", "m"): range(10, 14), ("(B *)", "z"): range(0, 2)}
    inc = [(i, int(i < 10), *f) for f, ids in marks.items() for i in ids]
    inc_df = spark.createDataFrame(inc, "uid long, y int, tpl string, yield string")
    ex = spark.createDataFrame([(i, int(i < 10)) for i in range(20)], "uid long, y int")
    topk = SC.topk_features(SC.feature_mi(inc_df, ex), 10)
    got = [(r.group_key, frozenset(r.members)) for r in SC.merge_greedy(inc_df, ex, topk).collect()]
    assert sorted(got, key=repr) == sorted([("A", frozenset("pq")), ("A", frozenset("m")), ("B", frozenset("z"))], key=repr)
    # every feature is in exactly one group
    assert sorted(m for _, g in got for m in g) == ["m", "p", "q", "z"]


def test_vocabulary_rule(spark):
    df = spark.createDataFrame([("b a a c",), ("a b d",), ("a b c",), ("c e",)], "text string")
    v = {r.word: r.id for r in MD.build_vocabulary(df, ["text"], min_frequency=2).collect()}
    assert v["[PAD]"] == 0 and v["[UNK]"] == 3
    assert [w for w, _ in sorted(v.items(), key=lambda kv: kv[1])][4:] == ["a", "b", "c"]
    enc = MD.encode_ids(df.withColumn("id", F.monotonically_increasing_id()), "text",
                        MD.build_vocabulary(df, ["text"], min_frequency=2), "id").orderBy("id").collect()
    assert enc[3].input_ids == [1, 6, 3, 2]
