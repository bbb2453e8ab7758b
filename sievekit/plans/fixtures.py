"""Closed-form derivations of the reference's inputs from the given tables.

The reference scores examples with fine-tuned models whose predictions are not
shipped.  For testing, every registered query derives its inputs from the
parquet tables with closed-form rules (stated in FIXTURES.md §3), so Spark and
the SQL oracle see identical rows and the work grows with the tables:

* examples     ``documents ⋈ labels`` on ``doc_id``; ``id = doc_id``, ``y = toxic``
* predictions  5 runs, ``p1 = (1 + (id*7919 + r*104729 + n_chars*31) % 97) / 99``
* null model   class prior ``n_y / N`` (what a model that sees only ``" "`` learns)

Each builder has a SQL twin (``*_SQL``) used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.sources.tables import spread, table

N_RUNS = 5


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, dealt to every core by ``id`` where the table is but a few splits.  Column pruning keeps
    that to the columns a plan uses."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars", F.col("toxic").alias("y"), "quality")


def runs(spark: SparkSession, n_runs: int = N_RUNS) -> DataFrame:
    """Run numbers 1..n as a tiny literal table (broadcast when joined)."""
    return spark.range(1, n_runs + 1).select(F.col("id").cast("int").alias("run"))


def predictions(ex: DataFrame, n_runs: int = N_RUNS) -> DataFrame:
    """Long prediction table ``(id, run, probs, predicted)`` for every example."""
    spark = ex.sparkSession
    p1 = ((F.lit(1) + (F.col("id") * 7919 + F.col("run") * 104729 + F.col("n_chars") * 31) % 97)
          / F.lit(99).cast("double"))
    return (ex.select("id", "n_chars").crossJoin(F.broadcast(runs(spark, n_runs)))
            .withColumn("p1", p1)
            .select("id", "run", F.array(F.lit(1.0) - F.col("p1"), F.col("p1")).alias("probs"),
                    (F.col("p1") >= 0.5).cast("int").alias("predicted")))


EXAMPLES_SQL = """examples AS (
  SELECT d.doc_id AS id, d.text, d.lang, d.source, d.n_chars, l.toxic AS y, l.quality
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

RUNS_SQL = """runs AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) AS v(run))"""

PREDICTIONS_SQL = """preds AS (
  SELECT e.id, r.run,
         (1 + (e.id * 7919 + r.run * 104729 + e.n_chars * 31) % 97) / CAST(99 AS DOUBLE) AS p1
  FROM examples e CROSS JOIN runs r)"""

# ``raw_scores`` adds the runs up in their order and orders rows by the exact mean;
# ``avg_scores`` is what is shown.
# Scores per (id, run) with the class prior as the null model.  p_y and
# the one-hot error are written per class, which for two classes is the same
# arithmetic the array expressions do.
SCORES_SQL = """prior AS (
  SELECT y, COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS py FROM examples GROUP BY y),
scored AS (
  SELECT p.id, p.run, e.y,
         -log2(pr.py) - (-log2(CASE WHEN e.y = 1 THEN p.p1 ELSE 1 - p.p1 END)) AS pvi,
         sqrt(0.0 + ((1 - p.p1) - CASE WHEN e.y = 0 THEN 1.0 ELSE 0.0 END) * ((1 - p.p1) - CASE WHEN e.y = 0 THEN 1.0 ELSE 0.0 END)
                  + (p.p1 - CASE WHEN e.y = 1 THEN 1.0 ELSE 0.0 END) * (p.p1 - CASE WHEN e.y = 1 THEN 1.0 ELSE 0.0 END)) AS el2n,
         CAST(p.p1 >= 0.5 AS INTEGER) AS predicted
  FROM preds p JOIN examples e ON p.id = e.id JOIN prior pr ON pr.y = e.y),
raw_scores AS (
  SELECT id, y, {pvi} / 5 AS average_pvi, {el2n} / 5 AS average_el2n,
         CAST(SUM(CASE WHEN predicted <> y THEN 1 ELSE 0 END) AS BIGINT) AS misclassification_number
  FROM scored GROUP BY id, y),
avg_scores AS (
  SELECT id, y, round(average_pvi, 6) AS average_pvi, round(average_el2n, 6) AS average_el2n, misclassification_number
  FROM raw_scores)""".format(**{c: "(" + " + ".join(["0.0::DOUBLE", *(
    f"max(CASE WHEN run = {r} THEN {c} END)" for r in range(1, N_RUNS + 1))]) + ")" for c in ("pvi", "el2n")})


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE_SQL = with_ctes(EXAMPLES_SQL, RUNS_SQL, PREDICTIONS_SQL, SCORES_SQL)


# Predictions of the models retrained on each pruned split, per grid cell
# (score, type, rate, run): the same closed form with the cell mixed in.
SCORE_OFFSET = {"pvi": 0, "el2n": 17}
TYPE_OFFSET = {"easy": 0, "hard": 29}
RATES = (5, 10, 15, 20, 25, 30, 35, 40, 50, 60)


def grid_predictions(ex: DataFrame, n_runs: int = N_RUNS) -> DataFrame:
    """``(inf_score, prune_type, prune_rate, run, id, y, lang, predicted)``."""
    spark = ex.sparkSession
    cells = spark.createDataFrame(
        [(s, so, t, to, r) for s, so in SCORE_OFFSET.items() for t, to in TYPE_OFFSET.items()
         for r in RATES], "inf_score string, so int, prune_type string, tpo int, prune_rate int")
    p1 = ((F.lit(1) + (F.col("id") * 7919 + F.col("run") * 104729 + F.col("prune_rate") * 131
                       + F.col("so") + F.col("tpo") + F.col("n_chars") * 31) % 97)
          / F.lit(99).cast("double"))
    return (ex.select("id", "y", "lang", "n_chars")
            .crossJoin(F.broadcast(cells)).crossJoin(F.broadcast(runs(spark, n_runs)))
            .select("inf_score", "prune_type", "prune_rate", "run", "id", "y", "lang",
                    (p1 >= 0.5).cast("int").alias("predicted")))


GRID_PREDS_SQL = """gcells AS (
  SELECT * FROM (VALUES ('pvi', 0), ('el2n', 17)) AS s(inf_score, so)
  CROSS JOIN (VALUES ('easy', 0), ('hard', 29)) AS t(prune_type, tpo)
  CROSS JOIN (VALUES (5), (10), (15), (20), (25), (30), (35), (40), (50), (60)) AS r(prune_rate)),
gpreds AS (
  SELECT g.inf_score, g.prune_type, g.prune_rate, r.run, e.id, e.y, e.lang,
         CAST((1 + (e.id * 7919 + r.run * 104729 + g.prune_rate * 131 + g.so + g.tpo + e.n_chars * 31) % 97)
              / CAST(99 AS DOUBLE) >= 0.5 AS INTEGER) AS predicted
  FROM examples e CROSS JOIN gcells g CROSS JOIN runs r)"""

# Base predictions with label, language and loss (natural log) per (id, run).
BASE_PREDS_SQL = """bpreds AS (
  SELECT p.id, p.run, e.y, e.lang, CAST(p.p1 >= 0.5 AS INTEGER) AS predicted,
         -ln(CASE WHEN e.y = 1 THEN p.p1 ELSE 1 - p.p1 END) AS loss
  FROM preds p JOIN examples e ON p.id = e.id)"""


def base_predictions(ex: DataFrame) -> DataFrame:
    """``(id, run, y, lang, predicted, loss)`` with loss = -ln p(y|x)."""
    from sievekit.functions.scores import prob_of
    pr = predictions(ex)
    return (pr.join(ex.select("id", "y", "lang"), "id")
            .select("id", "run", "y", "lang", "predicted", (-F.log(prob_of("probs", "y"))).alias("loss")))


REPORT_SQL = with_ctes(EXAMPLES_SQL, RUNS_SQL, PREDICTIONS_SQL, BASE_PREDS_SQL, GRID_PREDS_SQL)
