"""Models trained together against each trained for itself on its own rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.operators import manymodels as MM
from sievekit.operators import models as MD

FEATURES = 64


def _alone(x, y, w, passes):
    """Accelerated gradient descent on one model's rows only."""
    coef = ahead = np.zeros(x.shape[1])
    momentum = 1.0
    for _ in range(passes):
        p = 1 / (1 + np.exp(-x @ ahead))
        grad = x.T @ (w * (p - y)) / w.sum() + MM.REGULAR * ahead
        new = ahead - MM.STEP * grad
        faster = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead, coef, momentum = new + (momentum - 1) / faster * (new - coef), new, faster
    return coef


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(300):
        y = int(rng.random() < .4)
        t = " ".join(rng.choice(words[:25] if y else words[10:]) for _ in range(rng.randint(0, 20)))
        rows.append((k, t if k % 50 else None, y, "ab"[k % 2], [rng.choice((0, 20, 60, 100)), 100]))
    return spark.createDataFrame(rows, "id long, text string, y int, lang string, keep array<int>").repartition(6).checkpoint()


def test_each_model_is_the_one_trained_alone(spark, table):
    rows = MM.model_rows(table, "text", "y", F.col("keep"), MM.bootstrap_weights("id", 2), ["id", "lang"], FEATURES).checkpoint()
    cells = [MM.Cell((w, q, r), w, q, r) for w in (0, 1) for q in (20, 60) for r in (1, 2)] + [MM.Cell(("none", 0, 0), 0, 101, 1)]
    coef = MM.train(rows, cells, FEATURES, 12)
    got = sorted(rows.collect(), key=lambda r: r.id)
    x = np.zeros((len(got), FEATURES + 1))
    for i, r in enumerate(got):
        for f in r.w or []:
            x[i, f] += 1
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(size > 0, size, 1)
    x[:, -1] = 1
    y = np.array([r.y for r in got])
    for j, c in enumerate(cells[:-1]):
        mine = np.array([r.keep[c.way] >= c.rate for r in got])
        w = np.array([r.u[c.run - 1] for r in got])
        assert np.allclose(coef[:, j], _alone(x[mine], y[mine], w[mine], 12), atol=1e-9)
    assert not coef[:, -1].any()        # no rows: stays 0
    n = {tuple(r)[:4]: r.n for r in MM.confusion(rows, coef, cells, "lang").collect()}
    label = (x @ coef > 0).astype(int)
    for j in range(len(cells)):
        for s in "ab":
            of = np.array([r.lang == s for r in got])
            for v in (0, 1):
                for p in (0, 1):
                    assert n.get((j, s, v, p), 0) == int((of & (y == v) & (label[:, j] == p)).sum())


def test_grid_report_is_accuracy_and_macro_f1(spark):
    cells = [MM.Cell(("informed", "pvi", "easy", 5, 1), 0, 5, 1), MM.Cell(("random", "", "", 5, 1), 0, 5, 1)]
    counts = spark.createDataFrame([(0, "a", 0, 0, 3), (0, "a", 0, 1, 1), (0, "a", 1, 1, 4), (1, "a", 0, 0, 7)],
                                   "cell int, test_set string, y int, predicted int, n long")
    got = {r.strategy: r for r in MM.grid_report(counts, cells, ["strategy", "inf_score", "prune_type", "prune_rate", "run"]).collect()}
    assert got["informed"].n == 8 and got["informed"].accuracy == pytest.approx(7 / 8)
    assert got["informed"].macro_f1 == pytest.approx((6 / 7 + 8 / 9) / 2)
    assert got["random"].macro_f1 == 1.0      # the class without rows does not count


def test_ensemble_learns_and_does_not_depend_on_partitions(spark, table):
    a = {(r.id, r.run): r.probs for r in MD.fit_run_ensemble(table, runs=3, features=FEATURES).collect()}
    b = {(r.id, r.run): r.probs for r in MD.fit_run_ensemble(table.repartition(2), runs=3, features=FEATURES).collect()}
    assert len(a) == 900 and all(abs(a[k][1] - b[k][1]) < 1e-9 for k in a)
    y = {r.id: r.y for r in table.collect()}
    assert np.mean([(p[1] > .5) == y[i] for (i, _), p in a.items()]) > .8


def test_dense_rows_are_scaled_counts():
    """Empty and null texts, repeats and slices of a batch."""
    import pyarrow as pa
    words = pa.array([[], None, [1], [3, 3, 3, 7], [0] * 50], pa.list_(pa.int32()))

    def whole(lists, features):
        x = np.array([np.bincount(r or [], minlength=features + 1) for r in lists.to_pylist()], dtype=float)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(size > 0, size, 1.0)
        x[:, -1] = 1.0
        return x
    assert (MM._dense(words, 8) == whole(words, 8)).all()
    assert (MM._dense(words.slice(2, 2), 8) == whole(words.slice(2, 2), 8)).all()
    assert (MM._matrix(pa.array([[1, None], [2, 3]]).slice(1), -1) == [[2, 3]]).all()
