"""Registered queries for §2.H counterfactual-edit tables.

Edit fixture (closed form over documents ⋈ labels): every occurrence of a word
covered by a small user table of swap rules becomes one edited example
``(uid = id-pos, original_uid = id, group = tpl, w, w_)``; its prediction is
``(1 + (id*7919 + pos*31 + length(w_)*17) % 97) / 99 >= 0.5``.  Originals are
the run-1 predictions of the examples with ``quality = 1`` (so some edits
have no original, as the reference's loader counts).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions import text as TX
from sievekit.functions._util import r6
from sievekit.operators import edits as ED
from sievekit.plans import fixtures as X
from sievekit.plans.registry import register
from sievekit.plans.textual import tok_sql

# A user table of edit rules (template, word, replacement).
EDIT_RULES = [("DET", "the", "a"), ("DET", "a", "the"), ("CONJ", "and", "or"), ("CONJ", "or", "and"),
              ("VERB", "is", "was"), ("VERB", "was", "is"), ("DET", "le", "la"), ("DET", "la", "le"),
              ("DET", "der", "die"), ("DET", "die", "der"), ("PREP", "of", "in"), ("PREP", "in", "of"),
              ("PREP", "de", "en"), ("PREP", "en", "de")]

_RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{w}', '{r}')" for t, w, r in EDIT_RULES) + ") AS v(tpl, w, w_))"

EDITS_SQL = X.with_ctes(X.EXAMPLES_SQL, X.RUNS_SQL, X.PREDICTIONS_SQL, _RULES_SQL, f"""toks AS (
  SELECT id, {tok_sql('text')} AS t FROM examples),
pos AS (SELECT id, unnest(t) AS tok, unnest(range(0, len(t))) AS p FROM toks),
edits AS (
  SELECT CAST(pos.id AS VARCHAR) || '-' || CAST(pos.p AS VARCHAR) AS uid, pos.id AS original_uid, r.tpl AS "group",
         r.tpl, [r.w] AS w, [r.w_] AS w_,
         CAST((1 + (pos.id * 7919 + pos.p * 31 + length(r.w_) * 17) % 97) / CAST(99 AS DOUBLE) >= 0.5 AS INTEGER)
           AS predicted,
         e.y
  FROM pos JOIN rules r ON pos.tok = r.w JOIN examples e ON e.id = pos.id),
edits_acc AS (SELECT *, CAST(predicted = y AS INTEGER) AS acc FROM edits),
originals AS (
  SELECT p.id AS uid, CAST(p.p1 >= 0.5 AS INTEGER) AS predicted, CAST(CAST(p.p1 >= 0.5 AS INTEGER) = e.y AS INTEGER) AS acc
  FROM preds p JOIN examples e ON p.id = e.id WHERE p.run = 1 AND e.quality = 1),
paired AS (
  SELECT a.*, o.predicted AS original_predicted, o.acc AS original_acc, a.predicted <> o.predicted AS changed
  FROM edits_acc a JOIN originals o ON a.original_uid = o.uid)""")


def _fixture(spark, sf):
    ex = X.examples(spark, sf)
    rules = spark.createDataFrame(EDIT_RULES, "tpl string, w string, w_ string")
    pos = ex.select("id", "y", F.posexplode(TX.tokens_basic("text")).alias("p", "tok"))
    p1 = (F.lit(1) + (F.col("id") * 7919 + F.col("p") * 31 + F.length("w_") * 17) % 97) / F.lit(99).cast("double")
    edits = (pos.join(F.broadcast(rules), pos.tok == rules.w)  # rule table: a few rows
             .select(F.concat_ws("-", F.col("id").cast("string"), F.col("p").cast("string")).alias("uid"),
                     F.col("id").alias("original_uid"), F.col("tpl").alias("group"), "tpl",
                     F.array("w").alias("w"), F.array("w_").alias("w_"),
                     (p1 >= 0.5).cast("int").alias("predicted"), "y")
             .withColumn("acc", (F.col("predicted") == F.col("y")).cast("int")))
    pr = X.predictions(ex).filter(F.col("run") == 1).join(ex.filter(F.col("quality") == 1).select("id", "y"), "id")
    originals = pr.select(F.col("id").alias("uid"), "predicted",
                          (F.col("predicted") == F.col("y")).cast("int").alias("acc"))
    return edits, originals


def _paired(spark, sf):
    e, o = _fixture(spark, sf)
    return ED.load_edit_predictions(e, o)


@register("load_edit_predictions", EDITS_SQL + """
SELECT uid, original_uid, tpl, predicted, original_predicted, changed FROM paired""")
def q_load_edit_predictions(spark, sf):
    return _paired(spark, sf).select("uid", "original_uid", "tpl", "predicted", "original_predicted", "changed")


@register("fmt_edit", EDITS_SQL + """
SELECT uid, array_to_string(w, ' ') || '\\textarrow ' || array_to_string(w_, ' ') AS edit FROM edits""")
def q_fmt_edit(spark, sf):
    e, _ = _fixture(spark, sf)
    return e.select("uid", ED.fmt_edit("w", "w_").alias("edit"))


_LMI_SQL = """, cells AS (
  SELECT tpl, SUM(CASE WHEN NOT changed THEN 1 ELSE 0 END) + 1.0 AS c0, SUM(CASE WHEN changed THEN 1 ELSE 0 END) + 1.0 AS c1
  FROM paired GROUP BY tpl),
lmi AS (
  SELECT tpl, (c0 / t) * ln((c0 / t) / (((c0 / t) + (c1 / t)) * (s0 / t))) AS lmi_unchanged,
              (c1 / t) * ln((c1 / t) / (((c0 / t) + (c1 / t)) * (s1 / t))) AS lmi_changed
  FROM (SELECT *, CAST(SUM(c0 + c1) OVER () AS DOUBLE) AS t, CAST(SUM(c0) OVER () AS DOUBLE) AS s0,
               CAST(SUM(c1) OVER () AS DOUBLE) AS s1 FROM cells))"""


@register("change_lmi", EDITS_SQL + _LMI_SQL + """
SELECT tpl, round(lmi_unchanged, 6) AS lmi_unchanged, round(lmi_changed, 6) AS lmi_changed FROM lmi""")
def q_change_lmi(spark, sf):
    c = ED.change_lmi(_paired(spark, sf))
    return c.select("tpl", r6("lmi_unchanged").alias("lmi_unchanged"), r6("lmi_changed").alias("lmi_changed"))


_BY_EDIT = """, by_edit AS (
  SELECT tpl, array_to_string(w, ' ') || '\\textarrow ' || array_to_string(w_, ' ') AS edit, COUNT(*) AS count,
         CAST(SUM(CAST(changed AS INTEGER)) AS BIGINT) AS changed
  FROM paired GROUP BY 1, 2)"""


@register("group_edits_by_edit", EDITS_SQL + _BY_EDIT + "SELECT tpl, edit, count, changed FROM by_edit")
def q_group_edits_by_edit(spark, sf):
    return ED.group_edits_by_edit(_paired(spark, sf))


@register("top_edits", EDITS_SQL + _BY_EDIT + """
SELECT tpl, edit, count, changed FROM by_edit ORDER BY changed DESC, tpl, edit LIMIT 3""")
def q_top_edits(spark, sf):
    return ED.top_edits(_paired(spark, sf), 3)


@register("group_edits_by_template", EDITS_SQL + _LMI_SQL + _BY_EDIT + """,
top AS (SELECT tpl, array_to_string(list(edit ORDER BY r), ', ') AS top_edits FROM (
  SELECT tpl, edit, ROW_NUMBER() OVER (PARTITION BY tpl ORDER BY changed DESC, edit) AS r FROM by_edit) WHERE r <= 3
  GROUP BY tpl),
stats AS (SELECT tpl, COUNT(*) AS count, round(100 * avg(CAST(changed AS DOUBLE)), 2) AS pct_changed FROM paired GROUP BY tpl)
SELECT s.tpl, s.count, s.pct_changed, t.top_edits, round(l.lmi_unchanged, 6) AS lmi_unchanged,
       round(l.lmi_changed, 6) AS lmi_changed
FROM stats s JOIN top t ON s.tpl = t.tpl JOIN lmi l ON s.tpl = l.tpl""")
def q_group_edits_by_template(spark, sf):
    g = ED.group_edits_by_template(_paired(spark, sf), k=3)
    return g.select("tpl", "count", "pct_changed", "top_edits", r6("lmi_unchanged").alias("lmi_unchanged"),
                    r6("lmi_changed").alias("lmi_changed"))


@register("contrast_summary", EDITS_SQL + """
SELECT COUNT(*) AS n_edits, round(100 * avg(CAST(changed AS DOUBLE)), 2) AS pct_changed,
       CAST(SUM(CASE WHEN original_acc = 1 AND acc = 0 THEN 1 ELSE 0 END) AS BIGINT) AS newly_wrong,
       CAST(SUM(CASE WHEN original_acc = 1 THEN 1 ELSE 0 END) AS BIGINT) AS previously_correct FROM paired""")
def q_contrast_summary(spark, sf):
    return ED.contrast_summary(_paired(spark, sf))


@register("attach_edits", EDITS_SQL + """
SELECT original_uid, "group", COUNT(*) AS n_edits,
       (SELECT COUNT(*) FROM edits WHERE original_uid NOT IN (SELECT uid FROM originals)) AS missing
FROM edits WHERE original_uid IN (SELECT uid FROM originals) GROUP BY original_uid, "group\"""")
def q_attach_edits(spark, sf):
    e, o = _fixture(spark, sf)
    grouped, missing = ED.attach_edits(e, o)
    return (grouped.select("original_uid", "group", F.size("edits").cast("long").alias("n_edits"))
            .crossJoin(F.broadcast(missing)))


@register("edit_error_rate", EDITS_SQL + """
SELECT COUNT(*) AS n, round(avg(a), 6) AS any_rate, round(avg(m), 6) AS mean_rate FROM (
  SELECT e.original_uid, e."group", max(CAST(e.predicted = 1 AS DOUBLE)) AS a, avg(CAST(e.predicted = 1 AS DOUBLE)) AS m
  FROM edits e JOIN originals o ON e.original_uid = o.uid WHERE o.predicted <> 1 GROUP BY e.original_uid, e."group")""")
def q_edit_error_rate(spark, sf):
    e, o = _fixture(spark, sf)
    r = ED.edit_error_rate(e, o, 1)
    return r.select("n", r6("any_rate").alias("any_rate"), r6("mean_rate").alias("mean_rate"))
