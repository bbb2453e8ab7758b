"""Counterfactual-edit analysis: edited examples paired with their originals,
change rates per template and per edit, change LMI, contrast summaries and
edit error rates.

Input: an **edit table** ``(uid, original_uid, group, tpl, w, w_, predicted)``
(one row per edited example; ``w``/``w_`` are word arrays, or arrays of word
arrays for pairs) and an **original table** ``(uid, predicted, acc)``.  The
reference pairs edits and originals by list position; here always by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = "\\textarrow "


def fmt_edit(w, w_, pair: bool = False) -> Column:
    """``w\\textarrow w_`` with words joined by blanks; of a ``pair`` (arrays of two word
    arrays) the sides are joined by ``/``."""
    def side(c):
        c = F.col(c) if isinstance(c, str) else c
        return F.array_join(F.transform(c, lambda s: F.array_join(s, " ")), "/") if pair else F.array_join(c, " ")
    return F.concat(side(w), F.lit(ARROW), side(w_))


def load_edit_predictions(edits: DataFrame, originals: DataFrame) -> DataFrame:
    """Pair every edit with its original prediction (inner join on the
    original uid) and flag ``changed``."""
    o = originals.select(F.col("uid").alias("original_uid"), F.col("predicted").alias("original_predicted"),
                         F.col("acc").alias("original_acc"))
    return (edits.join(o, "original_uid")
            .withColumn("changed", F.col("predicted") != F.col("original_predicted")))


def change_lmi(paired: DataFrame, key: str = "tpl") -> DataFrame:
    """Local mutual information of template × {unchanged, changed} with +1
    smoothing over every cell: ``p(x,y) ln(p(x,y) / (p(x) p(y)))``.  One row
    per template: ``lmi_unchanged``, ``lmi_changed``."""
    c = paired.groupBy(key).agg(
        (F.sum(F.when(~F.col("changed"), 1).otherwise(0)) + 1).cast("double").alias("_c0"),
        (F.sum(F.when(F.col("changed"), 1).otherwise(0)) + 1).cast("double").alias("_c1"))
    sums = c.agg(F.sum("_c0").alias("_n0"), F.sum("_c1").alias("_n1"))  # one row
    tot = F.col("_n0") + F.col("_n1")
    p0, p1 = F.col("_c0") / tot, F.col("_c1") / tot
    px = p0 + p1
    py0, py1 = F.col("_n0") / tot, F.col("_n1") / tot
    return c.crossJoin(F.broadcast(sums)).select(key, (p0 * F.log(p0 / (px * py0))).alias("lmi_unchanged"),
                    (p1 * F.log(p1 / (px * py1))).alias("lmi_changed"))


def group_edits_by_edit(paired: DataFrame) -> DataFrame:
    """Per (template, edit): number of edits and number that changed the
    prediction."""
    pair = isinstance(paired.schema["w"].dataType.elementType, T.ArrayType)
    return (paired.withColumn("edit", fmt_edit("w", "w_", pair)).groupBy("tpl", "edit")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.sum(F.col("changed").cast("int")).cast("long").alias("changed")))


def top_edits(paired: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` (template, edit) pairs with the most changed predictions
    (ties: template, edit)."""
    return group_edits_by_edit(paired).orderBy(F.col("changed").desc(), "tpl", "edit").limit(k)


def group_edits_by_template(paired: DataFrame, k: int = 3, n: int | None = None) -> DataFrame:
    """Per template: its ``k`` edits with most changes, edit count, % changed
    (2 decimals) and change LMI; ordered by LMI of the changed cell."""
    by_edit = group_edits_by_edit(paired)
    w = Window.partitionBy("tpl").orderBy(F.col("changed").desc(), F.col("edit"))
    top = (by_edit.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
           .groupBy("tpl").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "edit"))),
                                                        lambda s: s["edit"]), ", ").alias("top_edits")))
    stats = paired.groupBy("tpl").agg(F.count(F.lit(1)).alias("count"),
                                      F.round(100 * F.avg(F.col("changed").cast("double")), 2).alias("pct_changed"))
    out = stats.join(top, "tpl").join(change_lmi(paired), "tpl")
    out = out.orderBy(F.col("lmi_changed").desc(), "tpl")
    return out.limit(n) if n is not None else out


def contrast_summary(paired: DataFrame) -> DataFrame:
    """Edits, % whose prediction differs from the original (2 decimals), newly
    wrong (original correct, edit wrong) and previously correct counts."""
    return paired.agg(
        F.count(F.lit(1)).alias("n_edits"),
        F.round(100 * F.avg(F.col("changed").cast("double")), 2).alias("pct_changed"),
        F.sum(((F.col("original_acc") == 1) & (F.col("acc") == 0)).cast("int")).cast("long").alias("newly_wrong"),
        F.sum((F.col("original_acc") == 1).cast("int")).cast("long").alias("previously_correct"))


def attach_edits(edits: DataFrame, originals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits grouped under their original by (original uid, group) and the
    count of edits whose original is missing (anti join)."""
    o = originals.select(F.col("uid").alias("original_uid"), F.col("predicted").alias("original_predicted"))
    grouped = (edits.join(o, "original_uid").groupBy("original_uid", "group")
               .agg(F.first("original_predicted").alias("original_predicted"),
                    F.sort_array(F.collect_list(F.struct("uid", "predicted"))).alias("edits")))
    missing = edits.join(o, "original_uid", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return grouped, missing


def edit_error_rate(edits: DataFrame, originals: DataFrame, tgt: int) -> DataFrame:
    """Over (original, group) items whose original prediction is not ``tgt``:
    n, share with any edit predicted ``tgt``, mean share of such edits."""
    o = originals.select(F.col("uid").alias("original_uid"), F.col("predicted").alias("original_predicted"))
    j = edits.join(o, "original_uid").filter(F.col("original_predicted") != tgt)
    hit = (F.col("predicted") == tgt).cast("double")
    per = j.groupBy("original_uid", "group").agg(F.max(hit).alias("_any"), F.avg(hit).alias("_mean"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg("_any").alias("any_rate"),
                   F.avg("_mean").alias("mean_rate"))
