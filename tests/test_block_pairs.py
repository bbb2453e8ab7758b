"""Values of several sets from shared block pairs, against all pairs in one place."""

import numpy as np
import pytest

from sievekit.operators import select as SL


def _pool(n=90, seed=4):
    rng = np.random.default_rng(seed)
    return [(i, ("a", "b", None)[i % 3], rng.normal(size=8).tolist()) for i in range(n)]


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("block_rows", [16, 1000])
def test_objective_of_many_sets(spark, by, block_rows):
    rows = _pool()
    df = spark.createDataFrame(rows, "id long, g string, embedding array<double>")
    sets = {(s, k): [i for i in range(90) if (i * 7 + k) % m == 0] for s, m in (("x", 2), ("y", 5), (None, 11)) for k in (0, 1)}
    sets["only_a", 0] = [0, 3, 6]       # no member in other groups
    chosen = [(s, k, i) for (s, k), ids in sets.items() for i in ids]
    got = SL.objective(df, spark.createDataFrame(chosen, "s string, k int, id long"), by, set_cols=["s", "k"], block_rows=block_rows)
    assert got.columns == ["s", "k", *by, "value", "n_selected"]
    got = {(r["s"], r["k"], r["g"] if by else 0): (r["value"], r["n_selected"]) for r in got.collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    want = {}
    for (s, k), ids in sets.items():
        for g in ({"a", "b", None} if by else {0}):
            pool = [i for i, h, _ in rows if not by or h == g]
            mine = [i for i in ids if i in pool]
            if mine:
                want[s, k, g] = (sum(max(0.0, max(float(unit[i] @ unit[j]) for j in mine)) for i in pool), len(mine))
    assert got.keys() == want.keys()
    for key, (value, n) in want.items():
        assert got[key][0] == pytest.approx(value, abs=1e-6) and got[key][1] == n


def test_objective_without_sets(spark):
    df = spark.createDataFrame(_pool(), "id long, g string, embedding array<double>")
    none = spark.createDataFrame([], "s int, id long")
    assert SL.objective(df, none, set_cols=["s"]).collect() == []
    assert SL.objective(df, none.select("id")).collect() == []


def test_rows_travel_once_per_large_block(spark):
    """40,000 rows: 3 blocks a side; with blocks of 2,048 every row travelled 20 times."""
    df = spark.range(40_000).selectExpr("id", "array(1.0D) as embedding")
    a, b, _ = SL._block_pairs(df, df, [], "id", SL.PAIR_ROWS)
    assert a.count() == b.count() == 120_000
