"""Influence scores: V-entropy, PVI, EL2N, averaging over runs, misses.

Input is a **long** prediction table ``(id, run, probs)`` — one row per example
and training run — instead of the reference's wide per-run columns.  Runs are a
column, so all runs are scored in one pass, and joins are by key, never by row
position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.functions import scores as S
from sievekit.functions._util import r6


def v_entropy(preds: DataFrame, examples: DataFrame, id_col: str = "id",
              label_col: str = "y") -> DataFrame:
    """Per (id, run): ``H_yx = -log2 p(y|x)``, argmax label and correctness.

    ``examples`` is joined on ``id`` (shuffle join; AQE turns it into a
    broadcast only when a side is measured small)."""
    j = preds.join(examples.select(id_col, label_col), id_col)
    return j.select(id_col, "run", label_col,
                    S.entropy_bits("probs", label_col).alias("H_yx"),
                    S.argmax("probs").alias("predicted_label"),
                    (S.argmax("probs") == F.col(label_col)).alias("correct_yx"),
                    "probs")


def null_model_prior(examples: DataFrame, label_col: str = "y") -> DataFrame:
    """Class prior ``(y, n_y, N, H_yb)``: the output of a model trained on the
    constant input ``" "`` is the class prior, so its entropy is ``-log2(n_y/N)``.
    One row per class."""
    per = examples.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_y"))
    from pyspark.sql import Window
    per = per.withColumn("N", F.sum("n_y").over(Window.partitionBy()))
    return per.withColumn("H_yb", S.prior_bits("n_y", "N"))


def score_runs(preds: DataFrame, examples: DataFrame, null: DataFrame | None = None,
               id_col: str = "id", label_col: str = "y") -> DataFrame:
    """PVI and EL2N for every (id, run) in one pass.

    ``null`` is either a class-prior table ``(y, H_yb)`` (default: the prior of
    ``examples``) joined by label — at most #classes rows, so broadcast — or a
    null-model prediction table ``(id, run, probs)`` joined by ``(id, run)``.
    """
    ent = v_entropy(preds, examples, id_col, label_col)
    if null is None:
        null = null_model_prior(examples, label_col)
    if "H_yb" in null.columns:
        j = ent.join(F.broadcast(null.select(label_col, "H_yb")), label_col)
    else:
        nb = null.select(id_col, "run", F.col("probs").alias("_null_probs"))
        j = ent.join(nb, [id_col, "run"]).withColumn(
            "H_yb", S.entropy_bits("_null_probs", label_col)).drop("_null_probs")
    return j.select(id_col, "run", label_col, "H_yb", "H_yx", "correct_yx", "predicted_label",
                    S.pvi("H_yb", "H_yx").alias("pvi"),
                    S.el2n("probs", label_col).alias("el2n"))


def _ordered_mean(runs, c: str):
    """Mean of field ``c`` over the sorted runs, nulls left out, added in the order of the runs."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    step = lambda a, r: F.when(r[c].isNull(), a).otherwise(F.struct((a["s"] + r[c]).alias("s"), (a["n"] + 1).alias("n")))
    return F.aggregate(runs, start, step, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


def average_scores(scored: DataFrame, score_cols: Sequence[str] = ("pvi", "el2n"),
                   id_col: str = "id", label_col: str = "y",
                   keys: Sequence[str] = (), rounding: int | None = None) -> DataFrame:
    """Mean of each score over runs (NaN treated as missing, like
    ``mean(skipna=True)``) plus ``misclassification_number`` = runs whose
    prediction differs from the gold label — one ``groupBy(id)``.

    Output columns are ``average_<score>``, unrounded unless ``rounding`` asks for
    it.  Runs are added in order of their number (a group holds one row per run),
    so a mean does not depend on how rows were shuffled.  ``keys`` adds grouping
    columns (e.g. a checkpoint number)."""
    names = [f"average_{c}" for c in score_cols]
    value = {c: F.when(~F.isnan(c), F.col(c).cast("double")) for c in score_cols}
    miss = F.sum(F.when(F.col("predicted_label") != F.col(label_col), 1).otherwise(0)).cast("long").alias("misclassification_number")
    by = [id_col, label_col, *keys]
    if "run" in scored.columns:     # one array of all scores a row, sorted once
        runs = F.array_sort(F.collect_list(F.struct("run", *(value[c].alias(c) for c in score_cols))))
        out = scored.groupBy(*by).agg(runs.alias("_runs"), miss)
        out = out.select(*by, *(_ordered_mean("_runs", c).alias(n) for c, n in zip(score_cols, names)), "misclassification_number")
    else:
        out = scored.groupBy(*by).agg(*(F.avg(value[c]).alias(n) for c, n in zip(score_cols, names)), miss)
    return out if rounding is None else out.withColumns({n: F.round(n, rounding) for n in names})


def final_score_table(examples: DataFrame, averaged: DataFrame, id_col: str = "id",
                      label_col: str = "y", text_col: str = "text") -> DataFrame:
    """Join averages back to text: ``id, text, y, average_*, misclassification_number``."""
    return examples.select(id_col, text_col).join(averaged, id_col)


def pivot_runs(scored: DataFrame, value_col: str = "predicted_label", id_col: str = "id",
               n_runs: int | None = None) -> DataFrame:
    """Export view with one column per run (``<value>_<r>``).  Without ``n_runs``, every run the table holds has its
    column; with it, runs beyond are an error instead of a loss."""
    runs = sorted(r[0] for r in scored.select("run").distinct().collect())     # columns of an export
    if n_runs is not None:
        if runs and runs[-1] > n_runs:
            raise ValueError(f"run {runs[-1]} is beyond n_runs={n_runs}")
        runs = list(range(1, n_runs + 1))
    wide = scored.groupBy(id_col).pivot("run", runs).agg(F.first(value_col))
    return wide.select(id_col, *[F.col(str(r)).alias(f"{value_col}_{r}") for r in runs])


def correctness_band(df: DataFrame, misses_col: str = "misclassification_number",
                     threshold: int = 4, name: str = "correctness") -> DataFrame:
    """``incorrect`` when misses >= threshold else ``correct``."""
    return df.withColumn(name, F.when(F.col(misses_col) >= threshold, "incorrect").otherwise("correct"))


def hardness_band(df: DataFrame, misses_col: str = "misclassification_number",
                  easy_max: int = 3, name: str = "hardness") -> DataFrame:
    """``easy`` when misses <= easy_max else ``hard``."""
    return df.withColumn(name, F.when(F.col(misses_col) <= easy_max, "easy").otherwise("hard"))


__all__ = ["v_entropy", "null_model_prior", "score_runs", "average_scores", "final_score_table",
           "pivot_runs", "correctness_band", "hardness_band", "r6"]
