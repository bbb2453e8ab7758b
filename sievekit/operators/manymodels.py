"""Many logistic models trained together over one table.

A grid of retrained models (scores x types x rates x runs) differs only in which
rows each model sees and how they weigh.  Here every pass over the shared
hashed features adds up the gradients of *all* models: the number of jobs is the
number of passes, whatever the number of models, and no split is ever written
out.  A row carries ``keep``, one number per way of pruning (the largest rate
that keeps it, see ``prune.kept_rates``), and ``u``, one weight per run; a model
is a ``Cell``: it sees the rows with ``keep[way] >= rate`` at weight ``u[run]``.

Accelerated gradient descent on the mean weighted log loss with an L2 term;
rows are scaled to length 1, so one step size serves all models.  What a pass
sends is one partial gradient per task, ``features x models`` numbers, added up
by feature block; the models live in the driver, a size set by parameters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.text import tokens_basic

FEATURES = 1 << 12
#: Rows made dense at once, and features of a block of partial gradients.
CHUNK, FEATURE_BLOCK = 256, 256
STEP, REGULAR, PASSES = 8.0, 1e-4, 15


@dataclass(frozen=True)
class Cell:
    """One model: its place in the grid (``name``), and which rows it sees."""
    name: tuple
    way: int
    rate: int
    run: int


def bootstrap_weights(id_col: str, runs: int, seed: int = 7) -> Column:
    """``-ln U`` per run, U from a hash of (seed, run, id): equal however rows are partitioned."""
    def one(r: int) -> Column:
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(r), id_col), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return -F.log(u)
    return F.array(*[one(r) for r in range(1, runs + 1)])


def model_rows(df: DataFrame, text_col: str, label_col: str, keep: Column, u: Column, carry: Sequence[str] = (),
               features: int = FEATURES) -> DataFrame:
    """``*carry, y, w, keep, u``: ``w`` are the hashed words of a text, repeats included."""
    hashed = F.transform(tokens_basic(text_col), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))
    return df.select(*carry, F.col(label_col).cast("double").alias("y"), hashed.alias("w"), keep.cast("array<int>").alias("keep"),
                     u.cast("array<double>").alias("u"))


def _dense(words: pa.Array, features: int) -> np.ndarray:
    """Word counts of each row, scaled to length 1, with a last column of ones."""
    words = words.fill_null([]) if words.null_count else words
    off = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]
    row = np.repeat(np.arange(len(words)), np.diff(off))
    x = np.zeros((len(words), features + 1))
    cells, at = x.reshape(-1), row * (features + 1) + flat
    np.add.at(cells, at, 1.0)
    count = cells[at]       # each word's count, once per occurrence: their sum is the sum of squares
    size = np.sqrt(np.bincount(row, weights=count, minlength=len(words)))
    cells[at] = count / size[row]
    x[:, -1] = 1.0
    return x


def _matrix(col: pa.Array, missing: float) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    flat = col.flatten()
    if col.null_count or len(flat) % max(len(col), 1):
        return np.array([[missing if v is None else v for v in row] for row in col.to_pylist()], dtype=float)
    return flat.fill_null(missing).to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, CHUNK):
            yield b.slice(i, CHUNK)


def _weights(b: pa.RecordBatch, cells: Sequence[Cell]) -> np.ndarray:
    """Weight of each row in each model."""
    keep, u = _matrix(b.column("keep"), -1), _matrix(b.column("u"), 0)
    way, run = [c.way for c in cells], [c.run - 1 for c in cells]
    return (keep[:, way] >= np.array([c.rate for c in cells])) * u[:, run]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def train(rows: DataFrame, cells: Sequence[Cell], features: int = FEATURES, passes: int = PASSES, step: float = STEP,
          regular: float = REGULAR) -> np.ndarray:
    """(features + 1) x models coefficients, the last row the intercepts.  ``rows`` as ``model_rows`` gives them, stored;
    a model without rows stays 0."""
    spark = rows.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    table = rows.select("y", "w", "keep", "u").coalesce(max(tasks, 1))
    w = np.zeros((features + 1, len(cells)))
    ahead, momentum = w, 1.0
    schema = "block int, part binary, mass binary"
    for _ in range(passes):
        handle = spark.sparkContext.broadcast(ahead)

        def gradient(batches):
            coef = handle.value
            total, mass = np.zeros_like(coef), np.zeros(len(cells))
            for b in _chunks(batches):
                x, weight = _dense(b.column("w"), features), _weights(b, cells)
                y = b.column("y").to_numpy()
                total += x.T @ (weight * (_logistic(x @ coef) - y[:, None]))
                mass += weight.sum(axis=0)
            for i in range(0, features + 1, FEATURE_BLOCK):
                yield pa.RecordBatch.from_pydict({"block": pa.array([i // FEATURE_BLOCK], pa.int32()),
                                                  "part": [total[i:i + FEATURE_BLOCK].tobytes()], "mass": [mass.tobytes()]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            out = {c: sum(np.frombuffer(x) for x in pdf[c]).tobytes() for c in ("part", "mass")}
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], **{c: [v] for c, v in out.items()}})
        got = table.mapInArrow(gradient, schema).groupBy("block").applyInPandas(add, schema).orderBy("block").collect()
        handle.destroy()
        if not got:
            break
        mass = np.frombuffer(got[0]["mass"])
        grad = np.concatenate([np.frombuffer(r["part"]).reshape(-1, len(cells)) for r in got]) / np.where(mass > 0, mass, 1.0)
        grad = grad + regular * ahead * (mass > 0)
        new = ahead - step * grad
        faster = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead = new + (momentum - 1) / faster * (new - w)
        w, momentum = new, faster
    return w


def predict(rows: DataFrame, coef: np.ndarray, cells: Sequence[Cell], carry: Sequence[str]) -> DataFrame:
    """``*carry, p``: the probability of label 1 of every model, in the order of ``cells``."""
    features = coef.shape[0] - 1
    handle = rows.sparkSession.sparkContext.broadcast(coef)
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in _chunks(batches):
            p = _logistic(_dense(b.column("w"), features) @ handle.value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(p.tolist(), pa.list_(pa.float64()))],
                                             names=[*carry, "p"])
    return rows.select(*carry, "w").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", p array<double>")


def confusion(rows: DataFrame, coef: np.ndarray, cells: Sequence[Cell], set_col: str) -> DataFrame:
    """``cell, test_set, y, predicted, n`` over every row as test row of its set.  Rows times models never leave a task:
    it hands on its counts."""
    features = coef.shape[0] - 1
    handle = rows.sparkSession.sparkContext.broadcast(coef)
    schema = pa.schema([("cell", pa.int32()), ("test_set", pa.string()), ("y", pa.int32()), ("predicted", pa.int32()), ("n", pa.int64())])

    def run(batches):
        seen: dict[tuple, np.ndarray] = {}
        for b in _chunks(batches):
            label = (_dense(b.column("w"), features) @ handle.value > 0).astype(np.int64)
            y, sets = b.column("y").to_numpy().astype(int), np.array(b.column("test_set").to_pylist(), dtype=object)
            for s in set(sets.tolist()):
                for v in (0, 1):
                    of = label[(sets == s) & (y == v)]
                    seen.setdefault((s, v), np.zeros((2, len(cells)), dtype=np.int64))
                    seen[s, v] += np.stack([(of == 0).sum(axis=0), (of == 1).sum(axis=0)])
        for (s, v), n in seen.items():
            for p in (0, 1):
                at = np.flatnonzero(n[p])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([s] * len(at), pa.string()),
                                                  pa.array([v] * len(at), pa.int32()), pa.array([p] * len(at), pa.int32()),
                                                  pa.array(n[p][at], pa.int64())], schema=schema)
    got = rows.select("y", "w", F.col(set_col).cast("string").alias("test_set")).mapInArrow(
        run, "cell int, test_set string, y int, predicted int, n bigint")
    return got.groupBy("cell", "test_set", "y", "predicted").agg(F.sum("n").alias("n"))


def grid_report(counts: DataFrame, cells: Sequence[Cell], names: Sequence[str]) -> DataFrame:
    """Accuracy and macro-F1 per model and test set from ``confusion``: ``*names, test_set, n, accuracy, macro_f1``.  A class
    without rows and predictions has F1 0, as with ``zero_division=0``, and counts only if either occurs."""
    spark = counts.sparkSession
    kinds = ["string" if isinstance(v, str) else "int" for v in cells[0].name]
    table = spark.createDataFrame([(i, *c.name) for i, c in enumerate(cells)], "cell int, " + ", ".join(
        f"{n} {k}" for n, k in zip(names, kinds)))
    cell = lambda y, p: F.sum(F.when((F.col("y") == y) & (F.col("predicted") == p), F.col("n")).otherwise(0))
    m = counts.groupBy("cell", "test_set").agg(cell(0, 0).alias("a"), cell(0, 1).alias("b"), cell(1, 0).alias("c"), cell(1, 1).alias("d"))
    miss = F.col("b") + F.col("c")
    f1 = lambda hit: F.when(2 * F.col(hit) + miss > 0, 2 * F.col(hit) / (2 * F.col(hit) + miss))
    both = F.array_compact(F.array(f1("a"), f1("d")))
    mean = F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / F.size(both)
    n = F.col("a") + F.col("d") + miss
    return (m.select("cell", "test_set", n.alias("n"), ((F.col("a") + F.col("d")) / n).alias("accuracy"), mean.alias("macro_f1"))
            .join(F.broadcast(table), "cell").select(*names, "test_set", "n", "accuracy", "macro_f1"))
