"""Registered queries for §2.H metrics and §2.J ranks / tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions._util import r6
from sievekit.operators import influence as I
from sievekit.operators import metrics as M
from sievekit.plans import fixtures as X
from sievekit.plans.registry import register
from sievekit.plans.scoring import averaged, averaged_exactly

RS = X.REPORT_SQL


def _f1_sql(src: str, keys: list[str], extra: str = "") -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    return f"""conf AS (SELECT {kc}y, predicted, COUNT(*) AS n FROM {src} GROUP BY {kc}y, predicted),
cls AS (
  SELECT {kc}y AS cls, CASE WHEN y = predicted THEN n ELSE 0 END AS tp, 0 AS fp,
         CASE WHEN y = predicted THEN 0 ELSE n END AS fn, n AS support FROM conf
  UNION ALL
  SELECT {kc}predicted, 0, CASE WHEN y = predicted THEN 0 ELSE n END, 0, 0 FROM conf),
percls AS (
  SELECT {kc}cls, SUM(tp) AS tp, SUM(fp) AS fp, SUM(fn) AS fn, SUM(support) AS support,
         COALESCE(CAST(2 * SUM(tp) AS DOUBLE) / CAST(NULLIF(2 * SUM(tp) + SUM(fp) + SUM(fn), 0) AS DOUBLE), 0) AS f1
  FROM cls GROUP BY {kc}cls){extra}"""


def _bp(spark, sf):
    return X.base_predictions(X.examples(spark, sf))


def _gp(spark, sf):
    return X.grid_predictions(X.examples(spark, sf))


GRID_KEYS = ["inf_score", "prune_type", "prune_rate", "run"]


@register("macro_f1", RS + ", " + _f1_sql("bpreds", ["run"]) + """
SELECT run, round(avg(f1), 6) AS macro_f1 FROM percls GROUP BY run""")
def q_macro_f1(spark, sf):
    return M.macro_f1(_bp(spark, sf), ["run"]).select("run", r6("macro_f1").alias("macro_f1"))


@register("macro_f1_lineitem", """
WITH src AS (SELECT l_linestatus, l_returnflag AS y,
   CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS predicted FROM lineitem),
""" + _f1_sql("src", ["l_linestatus"]) + """
SELECT l_linestatus, round(avg(f1), 6) AS macro_f1 FROM percls GROUP BY l_linestatus""")
def q_macro_f1_lineitem(spark, sf):
    """Macro-F1 over a table of lineitem size (gold = return flag, prediction =
    quantity band): the aggregation is partial + final, so it scales with rows."""
    from sievekit.sources.tables import table
    li = table(spark, sf, "lineitem")
    src = li.select("l_linestatus", F.col("l_returnflag").alias("y"),
                    F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N")
                    .otherwise("R").alias("predicted"))
    return M.macro_f1(src, ["l_linestatus"]).select("l_linestatus", r6("macro_f1").alias("macro_f1"))


@register("f1_variants", RS + ", " + _f1_sql("bpreds", ["run"]) + """
SELECT run, round(avg(f1), 6) AS macro_f1,
       round(COALESCE(CAST(2 * SUM(tp) AS DOUBLE) / CAST(NULLIF(2 * SUM(tp) + SUM(fp) + SUM(fn), 0) AS DOUBLE), 0), 6) AS micro_f1,
       round(COALESCE(SUM(f1 * support) / CAST(NULLIF(SUM(support), 0) AS DOUBLE), 0), 6) AS weighted_f1,
       round(COALESCE(MAX(CASE WHEN cls = 1 THEN f1 END), 0), 6) AS binary_f1
FROM percls GROUP BY run""")
def q_f1_variants(spark, sf):
    v = M.f1_variants(_bp(spark, sf), ["run"])
    return v.select("run", *[r6(c).alias(c) for c in ("macro_f1", "micro_f1", "weighted_f1", "binary_f1")])


@register("evaluate_grid", RS + ", " + _f1_sql("gpreds", GRID_KEYS) + """
SELECT inf_score, prune_type, prune_rate, run, round(avg(f1), 6) AS macro_f1
FROM percls GROUP BY inf_score, prune_type, prune_rate, run""")
def q_evaluate_grid(spark, sf):
    return M.macro_f1(_gp(spark, sf), GRID_KEYS).withColumn("macro_f1", r6("macro_f1"))


@register("evaluate_unpruned", RS + ", " + _f1_sql("bpreds", ["run"]) + """
SELECT 0 AS prune_rate, run, round(avg(f1), 6) AS macro_f1 FROM percls GROUP BY run""")
def q_evaluate_unpruned(spark, sf):
    return (M.macro_f1(_bp(spark, sf), ["run"]).select(F.lit(0).alias("prune_rate"), "run",
                                                      r6("macro_f1").alias("macro_f1")))


_CURVE_SQL = RS + ", " + _f1_sql("gpreds", GRID_KEYS) + """,
grid_f1 AS (SELECT inf_score, prune_type, prune_rate, run, avg(f1) AS macro_f1 FROM percls
            GROUP BY inf_score, prune_type, prune_rate, run),
conf0 AS (SELECT run, y, predicted, COUNT(*) AS n FROM bpreds GROUP BY run, y, predicted),
cls0 AS (
  SELECT run, y AS cls, CASE WHEN y = predicted THEN n ELSE 0 END AS tp, 0 AS fp,
         CASE WHEN y = predicted THEN 0 ELSE n END AS fn FROM conf0
  UNION ALL SELECT run, predicted, 0, CASE WHEN y = predicted THEN 0 ELSE n END, 0 FROM conf0),
base_f1 AS (
  SELECT run, avg(f1) AS macro_f1 FROM (
    SELECT run, cls, COALESCE(CAST(2 * SUM(tp) AS DOUBLE) / CAST(NULLIF(2 * SUM(tp) + SUM(fp) + SUM(fn), 0) AS DOUBLE), 0) AS f1
    FROM cls0 GROUP BY run, cls) GROUP BY run),
curve_rows AS (
  SELECT inf_score, prune_type, prune_rate, macro_f1 FROM grid_f1
  UNION ALL
  SELECT c.inf_score, c.prune_type, 0, b.macro_f1 FROM base_f1 b
  CROSS JOIN (SELECT DISTINCT inf_score, prune_type FROM grid_f1) c),
curve AS (
  SELECT inf_score, prune_type, prune_rate, avg(macro_f1) AS mean, stddev_pop(macro_f1) AS std,
         COUNT(*) AS n_runs FROM curve_rows GROUP BY inf_score, prune_type, prune_rate)"""


def _curve(spark, sf):
    gf = M.macro_f1(_gp(spark, sf), GRID_KEYS)
    bf = M.macro_f1(_bp(spark, sf), ["run"])
    return M.score_curve(gf, ["inf_score", "prune_type"], baseline=bf)


@register("score_curve", _CURVE_SQL + """
SELECT inf_score, prune_type, CAST(prune_rate AS INTEGER) AS prune_rate, round(mean, 6) AS mean,
       round(std, 6) AS std, n_runs FROM curve""")
def q_score_curve(spark, sf):
    c = _curve(spark, sf)
    return c.select("inf_score", "prune_type", F.col("prune_rate").cast("int"), r6("mean").alias("mean"),
                    r6("std").alias("std"), "n_runs")


@register("curve_band", _CURVE_SQL + """
SELECT inf_score, prune_type, CAST(prune_rate AS INTEGER) AS prune_rate,
       round(mean - std, 6) AS lower, round(mean + std, 6) AS upper FROM curve""")
def q_curve_band(spark, sf):
    c = M.curve_band(_curve(spark, sf))
    return c.select("inf_score", "prune_type", F.col("prune_rate").cast("int"),
                    r6("lower").alias("lower"), r6("upper").alias("upper"))


@register("mean_std_cell", _CURVE_SQL + """
SELECT inf_score, prune_type, CAST(prune_rate AS INTEGER) AS prune_rate,
       CAST(round_even(100 * mean, 1) AS VARCHAR) || '\\textpm' || CAST(round_even(100 * std, 1) AS VARCHAR) AS cell
FROM curve""")
def q_mean_std_cell(spark, sf):
    c = _curve(spark, sf)
    return c.select("inf_score", "prune_type", F.col("prune_rate").cast("int"),
                    M.mean_std_cell("mean", "std").alias("cell"))


@register("assemble_curves", RS + ", " + _f1_sql("gpreds", ["lang", *GRID_KEYS]) + """,
grid_f1 AS (SELECT lang, inf_score, prune_type, prune_rate, run, avg(f1) AS macro_f1 FROM percls
            GROUP BY lang, inf_score, prune_type, prune_rate, run),
conf0 AS (SELECT lang, run, y, predicted, COUNT(*) AS n FROM bpreds GROUP BY lang, run, y, predicted),
cls0 AS (
  SELECT lang, run, y AS cls, CASE WHEN y = predicted THEN n ELSE 0 END AS tp, 0 AS fp,
         CASE WHEN y = predicted THEN 0 ELSE n END AS fn FROM conf0
  UNION ALL SELECT lang, run, predicted, 0, CASE WHEN y = predicted THEN 0 ELSE n END, 0 FROM conf0),
base_f1 AS (
  SELECT lang, run, avg(f1) AS macro_f1 FROM (
    SELECT lang, run, cls, COALESCE(CAST(2 * SUM(tp) AS DOUBLE) / CAST(NULLIF(2 * SUM(tp) + SUM(fp) + SUM(fn), 0) AS DOUBLE), 0) AS f1
    FROM cls0 GROUP BY lang, run, cls) GROUP BY lang, run),
rows_ AS (
  SELECT lang AS dataset, inf_score AS strategy, prune_rate, macro_f1 FROM grid_f1 WHERE prune_type = 'easy'
  UNION ALL SELECT lang, 'no_prune', 0, macro_f1 FROM base_f1)
SELECT dataset, strategy, CAST(prune_rate AS INTEGER) AS prune_rate, round(avg(macro_f1), 6) AS mean,
       round(stddev_pop(macro_f1), 6) AS std FROM rows_ GROUP BY dataset, strategy, prune_rate""")
def q_assemble_curves(spark, sf):
    """Per dataset (language here): the no-prune aggregate next to each
    strategy's curve, in one table."""
    gf = M.macro_f1(_gp(spark, sf).filter(F.col("prune_type") == "easy"),
                    ["lang", "inf_score", "prune_rate", "run"])
    bf = M.macro_f1(_bp(spark, sf), ["lang", "run"])
    rows = (gf.select(F.col("lang").alias("dataset"), F.col("inf_score").alias("strategy"),
                      "prune_rate", "macro_f1")
            .unionByName(bf.select(F.col("lang").alias("dataset"), F.lit("no_prune").alias("strategy"),
                                   F.lit(0).alias("prune_rate"), "macro_f1")))
    return rows.groupBy("dataset", "strategy", F.col("prune_rate").cast("int").alias("prune_rate")).agg(
        r6(F.avg("macro_f1")).alias("mean"), r6(F.stddev_pop("macro_f1")).alias("std"))


@register("accuracy", RS + """
SELECT run, round(avg(CAST(predicted = y AS DOUBLE)), 6) AS accuracy FROM bpreds GROUP BY run""")
def q_accuracy(spark, sf):
    return M.accuracy(_bp(spark, sf), ["run"]).withColumn("accuracy", r6("accuracy"))


_PHASE_SQL = "CASE WHEN substr(md5('phase|' || CAST(id AS VARCHAR)), 1, 1) < '4' THEN 'test' ELSE 'train' END"


def _phase():
    return F.when(F.substring(F.md5(F.concat(F.lit("phase|"), F.col("id").cast("string"))), 1, 1) < "4",
                  "test").otherwise("train")


@register("accuracy_trace", RS + f"""
SELECT run AS epoch,
       round(avg(CASE WHEN {_PHASE_SQL} = 'train' THEN CAST(predicted = y AS DOUBLE) END), 6) AS train,
       round(avg(CASE WHEN {_PHASE_SQL} = 'test' THEN CAST(predicted = y AS DOUBLE) END), 6) AS test
FROM bpreds GROUP BY run""")
def q_accuracy_trace(spark, sf):
    """Accuracy per epoch and phase, phases as columns (``pivot``)."""
    bp = _bp(spark, sf).withColumn("phase", _phase()).withColumnRenamed("run", "epoch")
    acc = M.accuracy(bp, ["epoch", "phase"])
    wide = acc.groupBy("epoch").pivot("phase", ["train", "test"]).agg(F.first("accuracy"))
    return wide.select("epoch", r6("train").alias("train"), r6("test").alias("test"))


@register("mean_loss", RS + "SELECT run, round(avg(loss), 6) AS mean_loss FROM bpreds GROUP BY run")
def q_mean_loss(spark, sf):
    return M.mean_loss(_bp(spark, sf), ["run"]).withColumn("mean_loss", r6("mean_loss"))


_REPORTS_SQL = RS + ", " + _f1_sql("bpreds", ["run"]) + """,
reports AS (
  SELECT run, 'accuracy' AS metric, avg(CAST(predicted = y AS DOUBLE)) AS value FROM bpreds GROUP BY run
  UNION ALL SELECT run, 'loss', avg(loss) FROM bpreds GROUP BY run
  UNION ALL SELECT run, 'macro_f1', avg(f1) FROM percls GROUP BY run)"""


def _reports(spark, sf):
    bp = _bp(spark, sf)
    acc = M.accuracy(bp, ["run"]).select("run", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    loss = M.mean_loss(bp, ["run"]).select("run", F.lit("loss").alias("metric"), F.col("mean_loss").alias("value"))
    f1 = M.macro_f1(bp, ["run"]).select("run", F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("value"))
    return acc.unionByName(loss).unionByName(f1)


@register("average_reports", _REPORTS_SQL + """
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
       list(round(value, 6) ORDER BY run) AS "values"
FROM reports GROUP BY metric""")
def q_average_reports(spark, sf):
    a = M.average_reports(_reports(spark, sf), "run")
    return a.select("metric", r6("mean").alias("mean"), r6("std").alias("std"),
                    F.transform("values", lambda v: F.round(v, 6)).alias("values"))


@register("seed_average_split_report", RS + """
SELECT model, split, round(avg(acc), 6) AS mean_accuracy, round(stddev_pop(acc), 6) AS std_accuracy
FROM (SELECT inf_score || '_' || prune_type AS model, lang AS split, run AS seed,
             avg(CAST(predicted = y AS DOUBLE)) AS acc
      FROM gpreds WHERE prune_rate = 20 GROUP BY inf_score, prune_type, lang, run)
GROUP BY model, split""")
def q_seed_average_split_report(spark, sf):
    gp = (_gp(spark, sf).filter(F.col("prune_rate") == 20)
          .withColumn("model", F.concat_ws("_", "inf_score", "prune_type"))
          .withColumnRenamed("lang", "split").withColumnRenamed("run", "seed"))
    per_seed = M.accuracy(gp, ["model", "split", "seed"], name="acc")
    return per_seed.groupBy("model", "split").agg(r6(F.avg("acc")).alias("mean_accuracy"),
                                                  r6(F.stddev_pop("acc")).alias("std_accuracy"))


@register("loss_report", RS + """
, per AS (SELECT lang AS dataset, avg(loss) AS loss FROM bpreds WHERE run = 1 GROUP BY lang)
SELECT dataset, round(loss, 6) AS loss, round(avg(loss) OVER (), 6) AS mean_over_datasets,
       round(stddev_pop(loss) OVER (), 6) AS std_over_datasets FROM per""")
def q_loss_report(spark, sf):
    from pyspark.sql import Window
    per = M.mean_loss(_bp(spark, sf).filter(F.col("run") == 1), ["lang"])
    w = Window.partitionBy()  # one row per dataset
    return per.select(F.col("lang").alias("dataset"), r6("mean_loss").alias("loss"),
                      r6(F.avg("mean_loss").over(w)).alias("mean_over_datasets"),
                      r6(F.stddev_pop("mean_loss").over(w)).alias("std_over_datasets"))


@register("best_checkpoint", RS + """
, m AS (SELECT lang, run AS ckp, avg(loss) AS loss FROM bpreds GROUP BY lang, run),
f AS (SELECT lang, ckp, loss,
             (min(loss) OVER (PARTITION BY lang ORDER BY ckp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS prev
      FROM m),
g AS (SELECT *, prev IS NULL OR loss < prev AS is_best FROM f),
h AS (SELECT *, SUM(CAST(is_best AS INTEGER)) OVER (PARTITION BY lang ORDER BY ckp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM g)
SELECT lang, ckp, round(loss, 6) AS loss, is_best,
       CAST(ROW_NUMBER() OVER (PARTITION BY lang, grp ORDER BY ckp) - 1 AS INTEGER) AS patience,
       last(CASE WHEN is_best THEN ckp END IGNORE NULLS) OVER (PARTITION BY lang ORDER BY ckp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_ckp
FROM h""")
def q_best_checkpoint(spark, sf):
    m = M.mean_loss(_bp(spark, sf), ["lang", "run"]).select("lang", F.col("run").alias("ckp"),
                                                            F.col("mean_loss").alias("loss"))
    b = M.best_checkpoint(m, "ckp", "loss", keys=["lang"])
    return b.select("lang", "ckp", r6("loss").alias("loss"), "is_best", "patience", "best_ckp")


@register("value_counts", "SELECT quality, toxic, COUNT(*) AS count FROM labels GROUP BY quality, toxic")
def q_value_counts(spark, sf):
    from sievekit.sources.tables import table
    return M.value_counts(table(spark, sf, "labels"), ["quality", "toxic"])


@register("label_counts", X.with_ctes(X.EXAMPLES_SQL) + """
SELECT l.lang, CAST(b.y AS INTEGER) AS y, COUNT(e.id) AS count
FROM (SELECT DISTINCT lang FROM examples) l CROSS JOIN (VALUES (0), (1), (2)) AS b(y)
LEFT JOIN examples e ON e.lang = l.lang AND e.y = b.y GROUP BY l.lang, b.y""")
def q_label_counts(spark, sf):
    return M.label_counts(X.examples(spark, sf), "y", 3, keys=["lang"])


_BANDED = X.BASE_SQL + """, banded AS (
  SELECT *, CASE WHEN misclassification_number >= 4 THEN 'incorrect' ELSE 'correct' END AS correctness
  FROM raw_scores)"""


def _banded(spark, sf):
    return I.correctness_band(averaged_exactly(spark, sf))


@register("class_means", _BANDED + """
SELECT y, round(avg(average_pvi), 6) AS mean_all,
       round(avg(CASE WHEN correctness = 'correct' THEN average_pvi END), 6) AS mean_correct,
       round(avg(CASE WHEN correctness = 'incorrect' THEN average_pvi END), 6) AS mean_incorrect
FROM banded GROUP BY y""")
def q_class_means(spark, sf):
    c = M.class_means(_banded(spark, sf), "average_pvi")
    return c.select("y", *[r6(x).alias(x) for x in ("mean_all", "mean_correct", "mean_incorrect")])


def _edges_sql(edges):
    vals = ", ".join(f"({i}, {repr(float(a))}::DOUBLE, {repr(float(b))}::DOUBLE)"
                     for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])))
    return f"bins AS (SELECT * FROM (VALUES {vals}) AS v(bin, lo, hi))"


_PVI_EDGES = M.arange_edges(-2, 3, 0.3)


@register("histogram_bins", _BANDED + ", " + _edges_sql(_PVI_EDGES) + f""",
hit AS (
  SELECT b.correctness, CAST(bb.bin AS INTEGER) AS bin FROM banded b JOIN bins bb
    ON b.average_pvi >= bb.lo AND (b.average_pvi < bb.hi OR (bb.bin = {len(_PVI_EDGES) - 2} AND b.average_pvi <= bb.hi))),
tot AS (SELECT correctness, COUNT(*) AS t FROM banded GROUP BY correctness)
SELECT c.correctness, CAST(bb.bin AS INTEGER) AS bin, bb.lo, bb.hi, COUNT(h.bin) AS count,
       round(COUNT(h.bin) / CAST(MAX(t.t) AS DOUBLE), 6) AS weight
FROM (SELECT DISTINCT correctness FROM banded) c CROSS JOIN bins bb
LEFT JOIN hit h ON h.correctness = c.correctness AND h.bin = bb.bin
JOIN tot t ON t.correctness = c.correctness
GROUP BY c.correctness, bb.bin, bb.lo, bb.hi""")
def q_histogram_bins(spark, sf):
    h = M.histogram_bins(_banded(spark, sf), "average_pvi", _PVI_EDGES, keys=["correctness"])
    return h.select("correctness", "bin", "lo", "hi", "count", r6("weight").alias("weight"))


@register("histogram_auto", X.BASE_SQL + """,
mm AS (SELECT min(average_el2n) AS lo, max(average_el2n) AS hi FROM avg_scores),
e AS (SELECT b.bin, b.bin * ((mm.hi - mm.lo) / 10.0) + mm.lo AS lo,
             CASE WHEN b.bin = 9 THEN mm.hi ELSE (b.bin + 1) * ((mm.hi - mm.lo) / 10.0) + mm.lo END AS hi
      FROM range(10) AS b(bin) CROSS JOIN mm)
SELECT CAST(e.bin AS INTEGER) AS bin, e.lo, e.hi, COUNT(a.id) AS count FROM e LEFT JOIN avg_scores a
  ON a.average_el2n >= e.lo AND (a.average_el2n < e.hi OR (e.bin = 9 AND a.average_el2n <= e.hi))
GROUP BY e.bin, e.lo, e.hi""")
def q_histogram_auto(spark, sf):
    return M.histogram_auto(averaged(spark, sf), "average_el2n", 10).select("bin", "lo", "hi", "count")


_MWU_SQL = _BANDED + """,
r AS (SELECT average_pvi AS v, correctness = 'correct' AS is_x,
             RANK() OVER (ORDER BY average_pvi) AS r0, COUNT(*) OVER (PARTITION BY average_pvi) AS t
      FROM banded),
a AS (SELECT SUM(CASE WHEN is_x THEN r0 + (t - 1) / 2.0 ELSE 0 END) AS R1,
             SUM(CASE WHEN is_x THEN 1 ELSE 0 END) AS n1, SUM(CASE WHEN is_x THEN 0 ELSE 1 END) AS n2
      FROM r),
tie AS (SELECT SUM(CAST(t AS DOUBLE) * t * t - t) AS tie_term FROM (SELECT COUNT(*) AS t FROM banded GROUP BY average_pvi))"""


@register("mann_whitney_u", _MWU_SQL + """
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(R1 - n1 * (n1 + 1) / 2.0, 6) AS U,
       round(tie_term, 6) AS tie_term FROM a CROSS JOIN tie""")
def q_mann_whitney_u(spark, sf):
    """One-sided rank test: PVI of correctly vs incorrectly classified rows."""
    t = M.mann_whitney_u(_banded(spark, sf), "average_pvi", "correctness", "correct")
    return t.select("n1", "n2", r6("U").alias("U"), r6("tie_term").alias("tie_term"))


@register("mann_whitney_p_value")
def q_mann_whitney_p(spark, sf):
    """Asymptotic p-value (normal, tie and continuity corrected) for PVI
    (alternative greater) and EL2N (alternative less) — the EL2N test uses
    EL2N on both sides (defect D8 fixed)."""
    b = _banded(spark, sf)
    p = M.mann_whitney_u(b, "average_pvi", "correctness", "correct", alternative="greater")
    e = M.mann_whitney_u(b, "average_el2n", "correctness", "correct", alternative="less")
    return (p.withColumn("score", F.lit("pvi")).unionByName(e.withColumn("score", F.lit("el2n"))))


@register("mann_whitney_u_events", """
WITH b AS (SELECT event_id AS id, value, event_type FROM events WHERE event_type IN ('click', 'view')),
r AS (SELECT value, event_type = 'click' AS is_x, RANK() OVER (ORDER BY value) AS r0,
             COUNT(*) OVER (PARTITION BY value) AS t FROM b),
a AS (SELECT SUM(CASE WHEN is_x THEN r0 + (t - 1) / 2.0 ELSE 0 END) AS R1,
             SUM(CASE WHEN is_x THEN 1 ELSE 0 END) AS n1, SUM(CASE WHEN is_x THEN 0 ELSE 1 END) AS n2 FROM r),
tie AS (SELECT SUM(CAST(t AS DOUBLE) * t * t - t) AS tie_term FROM (SELECT COUNT(*) AS t FROM b GROUP BY value))
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(R1 - n1 * (n1 + 1) / 2.0, 6) AS U,
       round(tie_term, 6) AS tie_term FROM a CROSS JOIN tie""")
def q_mann_whitney_events(spark, sf):
    """Rank test on a larger table with many ties: event value of clicks vs views."""
    from sievekit.sources.tables import table
    ev = table(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    t = M.mann_whitney_u(ev.withColumnRenamed("event_id", "id"), "value", "event_type", "click")
    return t.select("n1", "n2", r6("U").alias("U"), r6("tie_term").alias("tie_term"))


@register("method_dataset_table", RS + """
SELECT 'K' || CAST(prune_rate AS VARCHAR) || 'L' || inf_score || '_' || prune_type AS method, lang AS dataset,
       COUNT(DISTINCT run) AS runs, round(avg(CAST(predicted = y AS DOUBLE)), 6) AS accuracy
FROM gpreds GROUP BY 1, 2""")
def q_method_dataset_table(spark, sf):
    """Method × dataset accuracies over all runs and every dataset there is, one row a cell of the table."""
    gp = _gp(spark, sf).withColumn(
        "method", F.concat(F.lit("K"), F.col("prune_rate").cast("string"), F.lit("L"),
                           F.col("inf_score"), F.lit("_"), F.col("prune_type")))
    return M.method_dataset_table(gp, "method", "lang").withColumn("accuracy", r6("accuracy"))


@register("method_settings", RS + """
SELECT method, CAST(regexp_extract(method, 'K([0-9]+)', 1) AS INTEGER) AS k,
       regexp_extract(method, 'L([a-z0-9_]+)', 1) AS l
FROM (SELECT DISTINCT 'K' || CAST(prune_rate AS VARCHAR) || 'L' || inf_score || '_' || prune_type AS method FROM gpreds)""")
def q_method_settings(spark, sf):
    """Parse ``K<rate>L<setting>`` method names into columns."""
    gp = _gp(spark, sf).select(F.concat(F.lit("K"), F.col("prune_rate").cast("string"), F.lit("L"),
                                        F.col("inf_score"), F.lit("_"), F.col("prune_type")).alias("method")).distinct()
    return gp.select("method", F.regexp_extract("method", "K([0-9]+)", 1).cast("int").alias("k"),
                     F.regexp_extract("method", "L([a-z0-9_]+)", 1).alias("l"))
