"""Metrics over long prediction tables: F1, accuracy, curves, histograms,
rank tests, report averaging, checkpoint selection.

Everything is a grouped aggregation keyed by the grid columns (strategy,
score, type, rate, run, dataset …), so one job evaluates a whole grid; the
reference loops over files and models instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.functions._util import col, r6
from sievekit.operators.rank import distributed_rank


# ------------------------------------------------------------------ F1 family
def class_confusion(df: DataFrame, keys: Sequence[str], label_col: str = "y",
                    pred_col: str = "predicted") -> DataFrame:
    """Per (keys, class): tp, fp, fn, support over classes present in gold or
    prediction.  Built from the confusion counts (partial aggregation, so a
    grid of any size costs one shuffle of tiny rows)."""
    conf = df.groupBy(*keys, label_col, pred_col).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.col(label_col) == F.col(pred_col)
    as_gold = conf.select(*keys, F.col(label_col).alias("cls"),
                          F.when(hit, F.col("_n")).otherwise(0).alias("tp"),
                          F.lit(0).cast("long").alias("fp"),
                          F.when(hit, 0).otherwise(F.col("_n")).alias("fn"),
                          F.col("_n").alias("support"))
    as_pred = conf.select(*keys, F.col(pred_col).alias("cls"), F.lit(0).cast("long").alias("tp"),
                          F.when(hit, 0).otherwise(F.col("_n")).alias("fp"),
                          F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("support"))
    return (as_gold.unionByName(as_pred).groupBy(*keys, "cls")
            .agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "support")]))


def _f1(tp, fp, fn) -> Column:
    den = 2 * F.col(tp) + F.col(fp) + F.col(fn)
    return F.coalesce(F.try_divide((2 * F.col(tp)).cast("double"), den.cast("double")), F.lit(0.0))


def macro_f1(df: DataFrame, keys: Sequence[str] = (), label_col: str = "y",
             pred_col: str = "predicted", name: str = "macro_f1") -> DataFrame:
    """Unweighted mean of per-class F1 over classes seen in gold or prediction
    (F1 with an empty denominator is 0), per group of ``keys``."""
    cc = class_confusion(df, keys, label_col, pred_col)
    return cc.groupBy(*keys).agg(F.avg(_f1("tp", "fp", "fn")).alias(name))


def f1_variants(df: DataFrame, keys: Sequence[str] = (), label_col: str = "y",
                pred_col: str = "predicted", positive=1) -> DataFrame:
    """macro, micro, weighted and binary (positive class) F1 per group."""
    cc = class_confusion(df, keys, label_col, pred_col).withColumn("_f1", _f1("tp", "fp", "fn"))
    micro_den = 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")
    return cc.groupBy(*keys).agg(
        F.avg("_f1").alias("macro_f1"),
        F.coalesce(F.try_divide((2 * F.sum("tp")).cast("double"), micro_den.cast("double")),
                   F.lit(0.0)).alias("micro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("_f1") * F.col("support")),
                                F.sum("support").cast("double")), F.lit(0.0)).alias("weighted_f1"),
        F.coalesce(F.max(F.when(F.col("cls") == F.lit(positive), F.col("_f1"))), F.lit(0.0))
        .alias("binary_f1"))


def accuracy(df: DataFrame, keys: Sequence[str] = (), label_col: str = "y",
             pred_col: str = "predicted", name: str = "accuracy") -> DataFrame:
    """Share of rows with prediction == label per group."""
    return df.groupBy(*keys).agg(
        F.avg((F.col(label_col) == F.col(pred_col)).cast("double")).alias(name))


def mean_loss(df: DataFrame, keys: Sequence[str] = (), loss_col: str = "loss") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(loss_col).alias("mean_loss"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))


def label_counts(df: DataFrame, label_col: str, n_labels: int, keys: Sequence[str] = ()) -> DataFrame:
    """``bincount(y, n)``: count per label 0..n-1 with zero fill, per group."""
    spark = df.sparkSession
    labels = spark.range(n_labels).select(F.col("id").cast("int").alias(label_col))
    counts = df.groupBy(*keys, label_col).agg(F.count(F.lit(1)).alias("count"))
    if keys:
        frame = df.select(*keys).distinct().crossJoin(F.broadcast(labels))
    else:
        frame = labels
    return (frame.join(counts, [*keys, label_col], "left")
            .select(*keys, label_col, F.coalesce("count", F.lit(0)).cast("long").alias("count")))


# ------------------------------------------------------------------ curves
def score_curve(f1: DataFrame, keys: Sequence[str], rate_col: str = "prune_rate",
                value_col: str = "macro_f1", baseline: DataFrame | None = None) -> DataFrame:
    """Per (keys, rate): mean and **population** std of ``value_col`` over runs.
    ``baseline`` (rate-0 rows ``(run, value)``) is replicated to every key
    combination in front of the curve."""
    rows = f1.select(*keys, rate_col, value_col)
    if baseline is not None:
        combos = f1.select(*keys).distinct()
        base = (baseline.select(F.lit(0).cast(f1.schema[rate_col].dataType).alias(rate_col), value_col)
                .crossJoin(combos))
        rows = rows.unionByName(base.select(*keys, rate_col, value_col))
    return rows.groupBy(*keys, rate_col).agg(F.avg(value_col).alias("mean"),
                                             F.stddev_pop(value_col).alias("std"),
                                             F.count(F.lit(1)).alias("n_runs"))


def curve_band(curve: DataFrame) -> DataFrame:
    """mean ± std band for plotting."""
    return (curve.withColumn("lower", F.col("mean") - F.col("std"))
            .withColumn("upper", F.col("mean") + F.col("std")))


def average_reports(metrics: DataFrame, report_col: str, metric_col: str = "metric",
                    value_col: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population std and the value list (ordered by report) of each
    numeric metric over reports."""
    return metrics.groupBy(*keys, metric_col).agg(
        F.avg(value_col).alias("mean"), F.stddev_pop(value_col).alias("std"),
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(report_col), F.col(value_col)))),
                    lambda s: s[value_col]).alias("values"))


def mean_std_cell(mean, std) -> Column:
    """``round(100·mean, 1)\\textpm round(100·std, 1)`` (half to even, as numpy)."""
    return F.concat(F.bround(F.lit(100.0) * col(mean), 1).cast("string"), F.lit("\\textpm"),
                    F.bround(F.lit(100.0) * col(std), 1).cast("string"))


def best_checkpoint(metrics: DataFrame, ckp_col: str = "ckp", value_col: str = "loss",
                    lower_is_better: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Per checkpoint: whether it is a new best (strictly better than every
    earlier one; the first wins ties) and the patience count (checkpoints since
    the last improvement).  Window over the metric rows of one run — one row
    per checkpoint."""
    w_prev = Window.partitionBy(*keys).orderBy(ckp_col).rowsBetween(Window.unboundedPreceding, -1)
    prev_best = F.min(value_col).over(w_prev) if lower_is_better else F.max(value_col).over(w_prev)
    better = (F.col(value_col) < prev_best) if lower_is_better else (F.col(value_col) > prev_best)
    flagged = metrics.withColumn("is_best", prev_best.isNull() | better)
    w_run = Window.partitionBy(*keys).orderBy(ckp_col).rowsBetween(Window.unboundedPreceding, 0)
    flagged = flagged.withColumn("_grp", F.sum(F.col("is_best").cast("int")).over(w_run))
    w_grp = Window.partitionBy(*keys, "_grp").orderBy(ckp_col)
    return (flagged.withColumn("patience", (F.row_number().over(w_grp) - 1).cast("int"))
            .withColumn("best_ckp", F.last(F.when(F.col("is_best"), F.col(ckp_col)), True).over(w_run))
            .drop("_grp"))


# ------------------------------------------------------------------ histograms
def arange_edges(lo: float, hi: float, step: float) -> list[float]:
    """Bin edges exactly as ``numpy.arange(lo, hi, step)`` produces them."""
    return [float(x) for x in np.arange(lo, hi, step)]


def _bin_of(x: Column, edges: Column) -> Column:
    """``searchsorted(edges, x, 'right') - 1`` with the last bin closed; NULL
    outside [first, last] (numpy.histogram semantics)."""
    n_bins = F.size(edges) - 1
    idx = F.size(F.filter(edges, lambda e: e <= x)) - 1
    idx = F.when(x == F.element_at(edges, -1), n_bins - 1).otherwise(idx)
    inside = (x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, -1))
    return F.when(inside, idx)


def histogram_bins(df: DataFrame, value_col: str, edges: Sequence[float],
                   keys: Sequence[str] = (), weight_by: Sequence[str] | None = None) -> DataFrame:
    """Fixed-edge histogram per group of ``keys``: one row per bin (empty bins
    included) with ``count`` and ``weight`` = count / rows of the
    ``weight_by`` group (the reference weights by 1/len(class) or
    1/len(subset)).  Values outside the edges are dropped from the counts but
    still count in the weight total, as with numpy weights."""
    spark = df.sparkSession
    edges = [float(e) for e in edges]
    e = F.array(*[F.lit(v) for v in edges])
    binned = df.withColumn("bin", _bin_of(F.col(value_col).cast("double"), e))
    counts = binned.filter(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("count"))
    bins = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)],
                                 "bin int, lo double, hi double")
    frame = (df.select(*keys).distinct().crossJoin(F.broadcast(bins)) if keys else bins)
    out = frame.join(counts, [*keys, "bin"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0)).cast("long"))
    wb = list(weight_by) if weight_by is not None else list(keys)
    totals = df.groupBy(*wb).agg(F.count(F.lit(1)).alias("_tot")) if wb else \
        df.agg(F.count(F.lit(1)).alias("_tot"))
    out = out.join(F.broadcast(totals), wb) if wb else out.crossJoin(F.broadcast(totals))
    return out.withColumn("weight", F.col("count") / F.col("_tot").cast("double")).drop("_tot")


def histogram_auto(df: DataFrame, value_col: str, bins: int = 10) -> DataFrame:
    """``numpy.histogram(x, bins)``: equal bins between min and max (edges as
    ``linspace``), last bin closed.  Two passes: one 1-row aggregate, then the
    binning (the 1-row table is broadcast)."""
    spark = df.sparkSession
    mm = df.agg(F.min(value_col).cast("double").alias("_lo"), F.max(value_col).cast("double").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)),
                        lambda i: F.when(i == bins, F.col("_hi")).otherwise(i * step + F.col("_lo")))
    x = F.col(value_col).cast("double")
    binned = (df.select(value_col).crossJoin(F.broadcast(mm)).withColumn("_e", edges)
              .withColumn("bin", F.least(_bin_of(x, F.col("_e")), F.lit(bins - 1))))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    with_edges = frame.crossJoin(F.broadcast(mm)).select(
        "bin", (F.col("bin") * step + F.col("_lo")).alias("lo"),
        F.when(F.col("bin") == bins - 1, F.col("_hi")).otherwise((F.col("bin") + 1) * step + F.col("_lo"))
        .alias("hi"))
    return (with_edges.join(counts, "bin", "left")
            .withColumn("count", F.coalesce("count", F.lit(0)).cast("long")))


def class_means(df: DataFrame, score_col: str, label_col: str = "y",
                correct_col: str = "correctness") -> DataFrame:
    """Mean score per class, of its correct part and of its incorrect part."""
    return df.groupBy(label_col).agg(
        F.avg(score_col).alias("mean_all"),
        F.avg(F.when(F.col(correct_col) == "correct", F.col(score_col))).alias("mean_correct"),
        F.avg(F.when(F.col(correct_col) == "incorrect", F.col(score_col))).alias("mean_incorrect"))


# ------------------------------------------------------------------ rank test
def mann_whitney_u(df: DataFrame, value_col: str, group_col: str, x_value, id_col: str = "id",
                   alternative: str = "greater") -> DataFrame:
    """Mann–Whitney U of sample x (rows with ``group_col == x_value``) against
    the rest, with average ranks for ties.

    Ranks come from ``distributed_rank`` over (value, id) — no single-task
    sort — then per distinct value the average rank ``min_rank + (t-1)/2``.
    Returns one row: n1, n2, U (of x), tie term Σ(t³−t), z and the asymptotic
    one-sided p-value with continuity correction (scipy's asymptotic method).
    """
    base = df.select(F.col(value_col).cast("double").alias("_v"),
                     (F.col(group_col) == F.lit(x_value)).cast("int").alias("_x"), id_col)
    ranked = distributed_rank(base, ["_v", id_col], rank_col="_r")
    per_v = ranked.groupBy("_v").agg(F.min("_r").alias("_r0"), F.count(F.lit(1)).alias("_t"),
                                     F.sum("_x").alias("_nx"))
    per_v = per_v.withColumn("_avg", F.col("_r0") + (F.col("_t") - 1) / 2.0)
    agg = per_v.agg(F.sum(F.col("_avg") * F.col("_nx")).alias("R1"),
                    F.sum("_nx").cast("long").alias("n1"),
                    (F.sum("_t") - F.sum("_nx")).cast("long").alias("n2"),
                    F.sum(F.pow(F.col("_t").cast("double"), 3) - F.col("_t")).alias("tie_term"))
    n1 = F.col("n1").cast("double")
    n2 = F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("R1") - n1 * (n1 + 1) / 2.0
    mu = n1 * n2 / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    sign = 1.0 if alternative == "greater" else -1.0
    z = (F.lit(sign) * (u - mu) - 0.5) / sigma
    out = agg.select("n1", "n2", u.alias("U"), "tie_term", z.alias("z"))
    return out.withColumn("p_value", _normal_sf(F.col("z")))


@F.pandas_udf(T.DoubleType())
def _normal_sf(z: pd.Series) -> pd.Series:  # one row per test: scalar arithmetic
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)) if v == v else float("nan"))


__all__ = ["class_confusion", "macro_f1", "f1_variants", "accuracy", "mean_loss", "value_counts",
           "label_counts", "score_curve", "curve_band", "average_reports", "mean_std_cell",
           "best_checkpoint", "arange_edges", "histogram_bins", "histogram_auto", "class_means",
           "mann_whitney_u", "r6"]


def method_dataset_table(preds: DataFrame, method_col: str, dataset_col: str, run_col: str = "run",
                         label_col: str = "y", predicted_col: str = "predicted") -> DataFrame:
    """``method, dataset, runs, accuracy``: the cells of a method × dataset table, mean over all rows of all runs.  Methods
    and datasets are whatever the table holds; ``wide_table`` lays the cells out."""
    hit = (F.col(predicted_col) == F.col(label_col)).cast("double")
    return preds.groupBy(F.col(method_col).alias("method"), F.col(dataset_col).alias("dataset")).agg(
        F.countDistinct(run_col).alias("runs"), F.avg(hit).alias("accuracy"))


def wide_table(cells: DataFrame, row: str = "method", col: str = "dataset", value: str = "accuracy") -> DataFrame:
    """One row per ``row``, one column per value of ``col`` (sorted)."""
    names = sorted(r[0] for r in cells.select(col).where(F.col(col).isNotNull()).distinct().collect())     # columns of a report
    return cells.groupBy(row).pivot(col, names).agg(F.first(value))
