"""Registered queries for §2.D influence scoring and §2.E pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions._util import r6
from sievekit.operators import influence as I
from sievekit.operators import prune as P
from sievekit.operators import rank as R
from sievekit.plans import fixtures as X
from sievekit.plans.registry import register

B = X.BASE_SQL


def scored(spark, sf):
    ex = X.examples(spark, sf)
    return I.score_runs(X.predictions(ex), ex)


def averaged_exactly(spark, sf):
    """Unrounded means: what rows are ordered by."""
    return I.average_scores(scored(spark, sf))


def shown(df):
    """Means rounded, once all rows are in order."""
    return df.withColumns({c: r6(c) for c in df.columns if c.startswith("average_")})


def averaged(spark, sf):
    return shown(averaged_exactly(spark, sf))


# ---------------------------------------------------------------- §2.D
@register("v_entropy", B + """
SELECT p.id, p.run, e.y,
       round(-log2(CASE WHEN e.y = 1 THEN p.p1 ELSE 1 - p.p1 END), 6) AS H_yx,
       CAST(CASE WHEN 1 - p.p1 >= p.p1 THEN 0 ELSE 1 END AS INTEGER) AS predicted_label,
       (CASE WHEN 1 - p.p1 >= p.p1 THEN 0 ELSE 1 END) = e.y AS correct_yx
FROM preds p JOIN examples e ON p.id = e.id""")
def q_v_entropy(spark, sf):
    ex = X.examples(spark, sf)
    v = I.v_entropy(X.predictions(ex), ex)
    return v.select("id", "run", "y", r6("H_yx").alias("H_yx"), "predicted_label", "correct_yx")


@register("null_model_prior", B + """
SELECT y, COUNT(*) AS n_y, SUM(COUNT(*)) OVER () AS "N",
       round(-log2(COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)), 6) AS H_yb
FROM examples GROUP BY y""")
def q_null_model_prior(spark, sf):
    n = I.null_model_prior(X.examples(spark, sf))
    return n.select("y", "n_y", "N", r6("H_yb").alias("H_yb"))


@register("pvi", B + "SELECT id, run, round(pvi, 6) AS pvi FROM scored")
def q_pvi(spark, sf):
    return scored(spark, sf).select("id", "run", r6("pvi").alias("pvi"))


@register("el2n", B + "SELECT id, run, round(el2n, 6) AS el2n FROM scored")
def q_el2n(spark, sf):
    return scored(spark, sf).select("id", "run", r6("el2n").alias("el2n"))


@register("score_all_runs", B + """
SELECT id, run, y, round(pvi, 6) AS pvi, round(el2n, 6) AS el2n, predicted AS predicted_label
FROM scored""")
def q_score_all_runs(spark, sf):
    return scored(spark, sf).select("id", "run", "y", r6("pvi").alias("pvi"),
                                    r6("el2n").alias("el2n"), "predicted_label")


@register("average_scores", B + "SELECT * FROM avg_scores")
def q_average_scores(spark, sf):
    return averaged(spark, sf)


@register("misclassification_number", B + "SELECT id, misclassification_number FROM avg_scores")
def q_misses(spark, sf):
    return averaged(spark, sf).select("id", "misclassification_number")


@register("average_vog_input", B + """
SELECT s.id, round(avg(s.pvi), 6) AS average_pvi, round(avg(s.el2n), 6) AS average_el2n,
       round(avg(-log2(CASE WHEN s.y = 1 THEN p.p1 ELSE 1 - p.p1 END)), 6) AS average_H_yx
FROM scored s JOIN preds p ON s.id = p.id AND s.run = p.run GROUP BY s.id""")
def q_average_any(spark, sf):
    a = I.average_scores(scored(spark, sf), score_cols=("pvi", "el2n", "H_yx"), rounding=6)
    return a.select("id", "average_pvi", "average_el2n", "average_H_yx")


@register("final_score_table", B + """
SELECT e.id, e.text, a.y, a.average_pvi, a.average_el2n, a.misclassification_number
FROM examples e JOIN avg_scores a ON e.id = a.id""")
def q_final_score_table(spark, sf):
    return I.final_score_table(X.examples(spark, sf), averaged(spark, sf))


@register("pivot_runs", B + """
SELECT id,
  max(CASE WHEN run = 1 THEN predicted END) AS predicted_label_1,
  max(CASE WHEN run = 2 THEN predicted END) AS predicted_label_2,
  max(CASE WHEN run = 3 THEN predicted END) AS predicted_label_3,
  max(CASE WHEN run = 4 THEN predicted END) AS predicted_label_4,
  max(CASE WHEN run = 5 THEN predicted END) AS predicted_label_5
FROM scored GROUP BY id""")
def q_pivot_runs(spark, sf):
    return I.pivot_runs(scored(spark, sf))


@register("correctness_band", B + """
SELECT id, misclassification_number,
       CASE WHEN misclassification_number >= 4 THEN 'incorrect' ELSE 'correct' END AS correctness
FROM avg_scores""")
def q_correctness_band(spark, sf):
    return I.correctness_band(averaged(spark, sf)).select("id", "misclassification_number", "correctness")


@register("hardness_band", B + """
SELECT id, misclassification_number,
       CASE WHEN misclassification_number <= 3 THEN 'easy' ELSE 'hard' END AS hardness
FROM avg_scores""")
def q_hardness_band(spark, sf):
    return I.hardness_band(averaged(spark, sf)).select("id", "misclassification_number", "hardness")


# ---------------------------------------------------------------- §2.E
_RANK_PVI = """ranked AS (
  SELECT a.id, a.y, round(a.average_pvi, 6) AS average_pvi, round(a.average_el2n, 6) AS average_el2n, misclassification_number,
         CAST(ROW_NUMBER() OVER (PARTITION BY a.y ORDER BY a.average_pvi, a.id) AS INTEGER) AS rnk,
         COUNT(*) OVER (PARTITION BY a.y) AS n_class
  FROM raw_scores a)"""


_KEPT = """kept AS (
  SELECT s.inf_score, s.id, s.y,
         max(CASE WHEN s.rnk <= CEIL((1 - CAST(r.prune_rate AS DOUBLE) / 100) * s.n) THEN r.prune_rate END) AS kept_easy,
         max(CASE WHEN s.rnk > s.n - CEIL((1 - CAST(r.prune_rate AS DOUBLE) / 100) * s.n) THEN r.prune_rate END) AS kept_hard
  FROM sranked s CROSS JOIN rates r GROUP BY ALL)"""


@register("rank_by_score", B + ", " + _RANK_PVI + """
SELECT id, y, average_pvi, rnk AS "rank", n_class FROM ranked""")
def q_rank_by_score(spark, sf):
    r = P.rank_by_score(averaged_exactly(spark, sf), "average_pvi")
    return r.select("id", "y", r6("average_pvi").alias("average_pvi"), "rank", "n_class")


@register("undersample_easy", B + ", " + _RANK_PVI + """
SELECT id, y, average_pvi, average_el2n, misclassification_number FROM ranked
WHERE y <> 0 OR rnk <= CEIL((1 - CAST(20 AS DOUBLE) / 100) * n_class)""")
def q_undersample_easy(spark, sf):
    return shown(P.undersample(averaged_exactly(spark, sf), "average_pvi", 20, "easy"))


@register("undersample_hard", B + ", " + _RANK_PVI + """
SELECT id, y, average_pvi, average_el2n, misclassification_number FROM ranked
WHERE y <> 0 OR rnk > n_class - CEIL((1 - CAST(20 AS DOUBLE) / 100) * n_class)""")
def q_undersample_hard(spark, sf):
    return shown(P.undersample(averaged_exactly(spark, sf), "average_pvi", 20, "hard"))


@register("undersample_hard_drop_last", B + ", " + _RANK_PVI + """
SELECT id, y, average_pvi, average_el2n, misclassification_number FROM ranked
WHERE y <> 0 OR (rnk > n_class - CEIL((1 - CAST(20 AS DOUBLE) / 100) * n_class) AND rnk < n_class)""")
def q_undersample_hard_drop_last(spark, sf):
    return shown(P.undersample(averaged_exactly(spark, sf), "average_pvi", 20, "hard", drop_last=True))


_STACKED = """stacked AS (
  SELECT 'pvi' AS inf_score, id, y, average_pvi AS k FROM raw_scores
  UNION ALL SELECT 'el2n', id, y, -average_el2n FROM raw_scores),
sranked AS (
  SELECT inf_score, id, y, ROW_NUMBER() OVER (PARTITION BY inf_score, y ORDER BY k, id) AS rnk,
         COUNT(*) OVER (PARTITION BY inf_score, y) AS n FROM stacked),
rates AS (SELECT * FROM (VALUES (5), (10), (15), (20), (25), (30), (35), (40), (50), (60)) AS v(prune_rate)),
types AS (SELECT * FROM (VALUES ('easy'), ('hard')) AS v(t))"""


@register("undersample_grid", B + ", " + _STACKED + """
SELECT s.inf_score, t.t AS prune_type, CAST(r.prune_rate AS INTEGER) AS prune_rate, s.id, s.y
FROM sranked s CROSS JOIN types t CROSS JOIN rates r
WHERE s.y <> 0
   OR (t.t = 'easy' AND s.rnk <= CEIL((1 - CAST(r.prune_rate AS DOUBLE) / 100) * s.n))
   OR (t.t = 'hard' AND s.rnk > s.n - CEIL((1 - CAST(r.prune_rate AS DOUBLE) / 100) * s.n))""")
def q_undersample_grid(spark, sf):
    return P.undersample_grid(averaged_exactly(spark, sf))


@register("kept_rates", B + ", " + _STACKED + ", " + _KEPT + "SELECT * FROM kept")
def q_kept_rates(spark, sf):
    """Every undersampling split of the grid in one row per (score, example)."""
    return P.kept_rates(averaged_exactly(spark, sf))


_PROP_WHERE = """
  (CASE WHEN (CASE WHEN s.y = 1 THEN a.t ELSE b.t END) = 'easy'
        THEN s.rnk <= CEIL((1 - CAST(r.prune_rate AS DOUBLE) / 2 / 100) * s.n)
        ELSE s.rnk > s.n - CEIL((1 - CAST(r.prune_rate AS DOUBLE) / 2 / 100) * s.n) END)"""


@register("proportional_grid", B + ", " + _STACKED + """
SELECT s.inf_score, a.t AS type_pos, b.t AS type_neg, CAST(r.prune_rate AS INTEGER) AS prune_rate, s.id, s.y
FROM sranked s CROSS JOIN types a CROSS JOIN types b CROSS JOIN rates r
WHERE""" + _PROP_WHERE)
def q_proportional_grid(spark, sf):
    return P.proportional_grid(averaged_exactly(spark, sf))


@register("proportional_prune", B + ", " + _STACKED + """
SELECT s.id, s.y
FROM sranked s CROSS JOIN (SELECT 'easy' AS t) a CROSS JOIN (SELECT 'hard' AS t) b
     CROSS JOIN (SELECT 20 AS prune_rate) r
WHERE s.inf_score = 'pvi' AND""" + _PROP_WHERE)
def q_proportional_prune(spark, sf):
    g = P.proportional_grid(averaged_exactly(spark, sf), scores=("average_pvi",), types=("easy", "hard"),
                            rates=(20,))
    return g.filter((F.col("type_pos") == "easy") & (F.col("type_neg") == "hard")).select("id", "y")


_SEEDS = """seeds AS (SELECT * FROM (VALUES (1, 12), (2, 42), (3, 72), (4, 123), (5, 250)) AS v(run, seed)),
rates AS (SELECT * FROM (VALUES (5), (10), (15), (20), (25), (30), (35), (40), (50), (60)) AS v(prune_rate)),
hranked AS (
  SELECT s.run, s.seed, e.id, e.y,
         ROW_NUMBER() OVER (PARTITION BY s.run ORDER BY md5(CAST(s.seed AS VARCHAR) || '|' || CAST(e.id AS VARCHAR)), e.id) AS rnk,
         COUNT(*) OVER (PARTITION BY s.run) AS n
  FROM examples e CROSS JOIN seeds s)"""


@register("random_prune", X.with_ctes(X.EXAMPLES_SQL, _SEEDS) + """
SELECT CAST(h.run AS INTEGER) AS run, CAST(h.seed AS INTEGER) AS seed, CAST(r.prune_rate AS INTEGER) AS prune_rate, h.id, h.y
FROM hranked h CROSS JOIN rates r
WHERE h.rnk <= round_even((1 - CAST(r.prune_rate AS DOUBLE) / 100) * h.n, 0)""")
def q_random_prune(spark, sf):
    return P.random_prune_grid(X.examples(spark, sf).select("id", "y"))


@register("random_kept_rates", X.with_ctes(X.EXAMPLES_SQL, _SEEDS) + """
SELECT CAST(h.run AS INTEGER) AS run, CAST(h.seed AS INTEGER) AS seed, h.id, h.y,
       max(CASE WHEN h.rnk <= round_even((1 - CAST(r.prune_rate AS DOUBLE) / 100) * h.n, 0) THEN r.prune_rate END) AS kept
FROM hranked h CROSS JOIN rates r GROUP BY ALL""")
def q_random_kept_rates(spark, sf):
    return P.random_kept_rates(X.examples(spark, sf).select("id", "y"))


@register("sample_fraction_exact", X.with_ctes(X.EXAMPLES_SQL) + """
SELECT id, y FROM (
  SELECT id, y, ROW_NUMBER() OVER (ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS rnk,
         COUNT(*) OVER () AS n FROM examples)
WHERE rnk <= round_even(CAST(0.8 AS DOUBLE) * n, 0)""")
def q_sample_fraction_exact(spark, sf):
    return R.sample_fraction_exact(X.examples(spark, sf).select("id", "y"), 0.8, 42)


@register("sample_fraction_train", X.with_ctes(X.EXAMPLES_SQL) + """
SELECT id, y FROM (
  SELECT id, y, ROW_NUMBER() OVER (ORDER BY md5('7|' || CAST(id AS VARCHAR)), id) AS rnk,
         COUNT(*) OVER () AS n FROM examples)
WHERE rnk <= round_even(CAST(0.05 AS DOUBLE) * n, 0)""")
def q_sample_fraction_train(spark, sf):
    return R.sample_fraction_exact(X.examples(spark, sf).select("id", "y"), 0.05, 7)


@register("prune_ratio", B + ", " + _STACKED + """,
grid AS (
  SELECT s.inf_score, t.t AS prune_type, r.prune_rate, s.id, s.y
  FROM sranked s CROSS JOIN types t CROSS JOIN rates r
  WHERE s.y <> 0
     OR (t.t = 'easy' AND s.rnk <= CEIL((1 - CAST(r.prune_rate AS DOUBLE) / 100) * s.n))
     OR (t.t = 'hard' AND s.rnk > s.n - CEIL((1 - CAST(r.prune_rate AS DOUBLE) / 100) * s.n))
  UNION ALL
  SELECT s.inf_score, t.t, 0, s.id, s.y FROM sranked s CROSS JOIN types t)
SELECT inf_score, prune_type, CAST(prune_rate AS INTEGER) AS prune_rate,
       CAST(SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
       CAST(SUM(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
       round(SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) / CAST(SUM(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS DOUBLE), 6) AS ratio
FROM grid GROUP BY inf_score, prune_type, prune_rate""")
def q_prune_ratio(spark, sf):
    a = averaged_exactly(spark, sf)
    grid = P.undersample_grid(a)
    base = (P._stacked_scores(a, ("average_pvi", "average_el2n"), "y", "id")
            .crossJoin(F.broadcast(spark.createDataFrame([("easy",), ("hard",)], ["prune_type"])))
            .select("inf_score", "prune_type", F.lit(0).alias("prune_rate"), "id", "y"))
    return P.prune_ratio(grid.unionByName(base), ["inf_score", "prune_type", "prune_rate"])


@register("topk_examples", B + """
SELECT * FROM (
  SELECT a.id, a.y, round(a.average_pvi, 6) AS average_pvi, round(a.average_el2n, 6) AS average_el2n, misclassification_number,
         CAST(ROW_NUMBER() OVER (PARTITION BY a.y ORDER BY a.average_pvi, a.id) AS INTEGER) AS pos, 'hard' AS "end"
  FROM raw_scores a) WHERE pos <= 10
UNION ALL
SELECT * FROM (
  SELECT a.id, a.y, round(a.average_pvi, 6) AS average_pvi, round(a.average_el2n, 6) AS average_el2n, misclassification_number,
         CAST(ROW_NUMBER() OVER (PARTITION BY a.y ORDER BY a.average_pvi DESC, a.id DESC) AS INTEGER) AS pos, 'easy' AS "end"
  FROM raw_scores a) WHERE pos <= 10""")
def q_topk_examples(spark, sf):
    return shown(P.topk_examples(averaged_exactly(spark, sf), "average_pvi", 10))


@register("easy_hard_pools_majority", B + ", " + _RANK_PVI + """
SELECT id, y, average_pvi,
       y = 0 AND rnk <= CEIL(CAST(0.6 AS DOUBLE) * n_class) AS in_hard_pool,
       y = 0 AND rnk > n_class - CEIL(CAST(0.6 AS DOUBLE) * n_class) AND rnk < n_class AS in_easy_pool
FROM ranked""")
def q_pools_majority(spark, sf):
    p = shown(P.easy_hard_pools(averaged_exactly(spark, sf), "average_pvi", 60, labels=(0,)))
    return p.select("id", "y", "average_pvi", "in_hard_pool", "in_easy_pool")


@register("easy_hard_pools_each_class", B + ", " + _RANK_PVI + """
SELECT id, y, average_pvi,
       rnk <= CEIL(CAST(0.3 AS DOUBLE) * n_class) AS in_hard_pool,
       rnk > n_class - CEIL(CAST(0.3 AS DOUBLE) * n_class) AND rnk < n_class AS in_easy_pool
FROM ranked""")
def q_pools_each(spark, sf):
    p = shown(P.easy_hard_pools(averaged_exactly(spark, sf), "average_pvi", 30, labels=None))
    return p.select("id", "y", "average_pvi", "in_hard_pool", "in_easy_pool")


@register("prune_class_balance", B + ", " + _RANK_PVI + """
SELECT y, COUNT(*) AS kept, round(avg(average_pvi), 6) AS mean_average_pvi,
       CAST(SUM(misclassification_number) AS BIGINT) AS sum_misses
FROM ranked WHERE y <> 0 OR rnk <= CEIL((1 - CAST(20 AS DOUBLE) / 100) * n_class)
GROUP BY y""")
def q_prune_class_balance(spark, sf):
    """Slice 1: score → average → undersample_easy(q=20) → per-class balance."""
    kept = shown(P.undersample(averaged_exactly(spark, sf), "average_pvi", 20, "easy"))
    return kept.groupBy("y").agg(F.count(F.lit(1)).alias("kept"),
                                 r6(F.avg("average_pvi")).alias("mean_average_pvi"),
                                 F.sum("misclassification_number").cast("long").alias("sum_misses"))
