"""Registered queries for §2.C filters and splits, §2.G joins / set ops /
reshapes and §2.J sorts, slices and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions import text as TX
from sievekit.functions._util import r6
from sievekit.operators import influence as I
from sievekit.operators import joins as J
from sievekit.operators import metrics as M
from sievekit.operators import rank as R
from sievekit.operators import trees as TR
from sievekit.plans import fixtures as X
from sievekit.plans import mining as MN
from sievekit.plans.registry import register
from sievekit.plans.scoring import averaged, averaged_exactly, scored
from sievekit.plans.textual import PAIRS_SQL, tok_sql
from sievekit.sources.tables import table

B = X.BASE_SQL
EX = X.with_ctes(X.EXAMPLES_SQL)


# ----------------------------------------------------------------- §2.C
@register("filter_class", B + "SELECT id, y, average_pvi FROM avg_scores WHERE y = 1")
def q_filter_class(spark, sf):
    return averaged(spark, sf).filter(F.col("y") == 1).select("id", "y", "average_pvi")


@register("filter_misclassified", B + """
SELECT id, y, misclassification_number FROM avg_scores WHERE misclassification_number >= 2""")
def q_filter_misclassified(spark, sf):
    a = averaged(spark, sf)
    return a.filter(F.col("misclassification_number") >= 2).select("id", "y", "misclassification_number")


@register("extreme_instances", B + """
SELECT id, y, CASE WHEN misclassification_number = 0 THEN 'easy' ELSE 'hard' END AS kind
FROM avg_scores WHERE misclassification_number IN (0, 5)""")
def q_extreme_instances(spark, sf):
    a = averaged(spark, sf).filter(F.col("misclassification_number").isin(0, 5))
    return a.select("id", "y", F.when(F.col("misclassification_number") == 0, "easy")
                    .otherwise("hard").alias("kind"))


_PHASE = "CASE WHEN substr(md5('phase|' || CAST(id AS VARCHAR)), 1, 1) < '4' THEN 'test' ELSE 'train' END"


def _phase(c="id"):
    return F.when(F.substring(F.md5(F.concat(F.lit("phase|"), F.col(c).cast("string"))), 1, 1) < "4",
                  "test").otherwise("train")


@register("split_by_column", EX + f"""
SELECT id, CASE WHEN split = 'train' THEN 'train' ELSE 'test' END AS part
FROM (SELECT id, {_PHASE} AS split FROM examples)""")
def q_split_by_column(spark, sf):
    ex = X.examples(spark, sf).withColumn("split", _phase())
    return ex.select("id", F.when(F.col("split") == "train", "train").otherwise("test").alias("part"))


@register("stratified_split", EX + """,
cls AS (SELECT y, COUNT(*) AS ny FROM examples GROUP BY y),
q AS (SELECT y, ny, CAST(0.2 AS DOUBLE) * ny AS ex, floor(CAST(0.2 AS DOUBLE) * ny) AS base FROM cls),
q2 AS (SELECT *, ceil(CAST(0.2 AS DOUBLE) * SUM(ny) OVER ()) - SUM(base) OVER () AS short,
              ROW_NUMBER() OVER (ORDER BY ex - base DESC, y) AS pos FROM q),
quota AS (SELECT y, base + CASE WHEN pos <= short THEN 1 ELSE 0 END AS quota FROM q2),
r AS (SELECT id, y, ROW_NUMBER() OVER (PARTITION BY y ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS rnk
      FROM examples)
SELECT r.id, r.y, CASE WHEN r.rnk <= quota.quota THEN 'test' ELSE 'train' END AS split
FROM r JOIN quota ON r.y = quota.y""")
def q_stratified_split(spark, sf):
    return R.stratified_split(X.examples(spark, sf).select("id", "y"), "y", 0.2, 42)


@register("sample_n", EX + """
SELECT id, y FROM (SELECT id, y, ROW_NUMBER() OVER (ORDER BY md5('13|' || CAST(id AS VARCHAR)), id) AS rnk
                   FROM examples) WHERE rnk <= 50""")
def q_sample_n(spark, sf):
    return R.sample_n(X.examples(spark, sf).select("id", "y"), 50, 13)


@register("random_halves", EX + """
SELECT id, CAST(CASE WHEN rnk <= floor(n / 2) THEN 0 ELSE 1 END AS INTEGER) AS half
FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY md5('13|' || CAST(id AS VARCHAR)), id) AS rnk,
             COUNT(*) OVER () AS n FROM examples)""")
def q_random_halves(spark, sf):
    return R.random_halves(X.examples(spark, sf).select("id"), 13).select("id", "half")


@register("label_contains", EX + "SELECT id, y FROM examples WHERE regexp_matches(text, 'the') AND y = 1")
def q_label_contains(spark, sf):
    ex = X.examples(spark, sf)
    return ex.filter(F.col("text").rlike("the") & (F.col("y") == 1)).select("id", "y")


_TREE_STR = """trees AS (SELECT id, '(S ' || array_to_string(list_transform(t, lambda w: '(L ' || w || ')'), ' ') || ')' AS tree
  FROM toks)"""


@register("tree_contains_root", X.with_ctes(X.EXAMPLES_SQL, MN._TOKS_SQL, _TREE_STR,
                                            X.RUNS_SQL, X.PREDICTIONS_SQL, X.SCORES_SQL) + """
SELECT t.id, a.misclassification_number FROM trees t JOIN avg_scores a ON t.id = a.id
WHERE regexp_matches(t.tree, '\\(L -LRB-\\)') AND a.misclassification_number >= 3""")
def q_tree_contains_root(spark, sf):
    """Trees holding a given sub-pattern (here a bracket leaf) among examples
    missed by at least 3 runs."""
    t = MN._trees(spark, sf).select(F.col("uid").alias("id"), "tree")
    a = averaged(spark, sf)
    j = t.join(a, "id").filter(F.col("tree").rlike(r"\(L -LRB-\)") & (F.col("misclassification_number") >= 3))
    return j.select("id", "misclassification_number")


# ----------------------------------------------------------------- §2.J
@register("sort_by", B + "SELECT id, y, average_pvi, average_el2n FROM avg_scores ORDER BY y DESC, average_pvi")
def q_sort_by(spark, sf):
    return averaged(spark, sf).select("id", "y", "average_pvi", "average_el2n").orderBy(
        F.col("y").desc(), "average_pvi", "id")


@register("slice_head_tail", B + """, c0 AS (
  SELECT id, ROW_NUMBER() OVER (ORDER BY average_pvi, id) - 1 AS i, COUNT(*) OVER () AS n
  FROM raw_scores WHERE y = 0)
SELECT id, 'head' AS part FROM c0 WHERE i < 10
UNION ALL SELECT id, 'tail' AS part FROM c0 WHERE i >= n - 10 AND i < n - 1""")
def q_slice_head_tail(spark, sf):
    """``iloc[:10]`` and ``iloc[-10:-1]`` of class 0 in PVI order."""
    c0 = averaged_exactly(spark, sf).filter(F.col("y") == 0)
    head = J.slice_by_rank(c0, ["average_pvi", "id"], None, 10).select("id", F.lit("head").alias("part"))
    tail = J.slice_by_rank(c0, ["average_pvi", "id"], -10, -1).select("id", F.lit("tail").alias("part"))
    return head.unionByName(tail)


@register("rank_in_class", B + """
SELECT id, y, CAST(ROW_NUMBER() OVER (PARTITION BY y ORDER BY average_el2n DESC, id) AS INTEGER) AS rank
FROM raw_scores""")
def q_rank_in_class(spark, sf):
    r = R.distributed_rank(averaged_exactly(spark, sf), [F.col("average_el2n").desc(), "id"], ["y"])
    return r.select("id", "y", "rank")


@register("argsort_desc", MN.FEAT_SQL + """
SELECT tpl, yield, CAST(ROW_NUMBER() OVER (ORDER BY round(mi, 10) DESC, tpl, yield) AS INTEGER) AS feature_no
FROM fmi""")
def q_argsort_desc(spark, sf):
    from sievekit.operators import shortcuts as SC
    return SC.feature_vocabulary(MN._fmi(spark, sf)).select("tpl", "yield", "feature_no")


# ----------------------------------------------------------------- §2.G
@register("join_inner_same_key", B + """
SELECT e.id, e.text, a.average_pvi FROM examples e JOIN avg_scores a ON e.id = a.id""")
def q_join_inner_same_key(spark, sf):
    return X.examples(spark, sf).select("id", "text").join(averaged(spark, sf), "id").select(
        "id", "text", "average_pvi")


_CF = """cf AS (SELECT CAST(doc_id AS DOUBLE) AS original_id, CAST(doc_id + 1 AS DOUBLE) AS counterfactual_id FROM labels)"""


@register("join_inner_two_keys", X.with_ctes(X.EXAMPLES_SQL, _CF) + """
SELECT c.original_id, e.id, e.y FROM cf c JOIN examples e ON CAST(c.counterfactual_id AS BIGINT) = e.id""")
def q_join_inner_two_keys(spark, sf):
    """Pairs table whose key arrives as a double (``13519.0``) joined on the
    other side's integer id after a cast."""
    cf = table(spark, sf, "labels").select(F.col("doc_id").cast("double").alias("original_id"),
                                           (F.col("doc_id") + 1).cast("double").alias("counterfactual_id"))
    ex = X.examples(spark, sf).select("id", "y")
    return cf.join(ex, cf.counterfactual_id.cast("long") == ex.id).select("original_id", "id", "y")


@register("join_trees_to_scores", X.with_ctes(X.EXAMPLES_SQL, MN._TOKS_SQL, _TREE_STR, X.RUNS_SQL,
                                              X.PREDICTIONS_SQL, X.SCORES_SQL) + """
SELECT t.id, t.tree, a.average_pvi, a.misclassification_number FROM trees t JOIN avg_scores a ON t.id = a.id""")
def q_join_trees_to_scores(spark, sf):
    t = MN._trees(spark, sf).select(F.col("uid").alias("id"), "tree")
    return t.join(averaged(spark, sf), "id").select("id", "tree", "average_pvi", "misclassification_number")


@register("semi_join_ids", B + """
SELECT id, text FROM examples WHERE id IN (SELECT id FROM avg_scores WHERE misclassification_number >= 3)""")
def q_semi_join_ids(spark, sf):
    ids = averaged(spark, sf).filter(F.col("misclassification_number") >= 3).select("id")
    return X.examples(spark, sf).select("id", "text").join(ids, "id", "left_semi")


@register("counterfactual_split", B + """
SELECT id, id IN (SELECT doc_id + 1 FROM labels) AS is_counterfactual FROM avg_scores""")
def q_counterfactual_split(spark, sf):
    """Rows whose id is / is not in the counterfactual id list (semi / anti join)."""
    ids = table(spark, sf, "labels").select((F.col("doc_id") + 1).alias("id")).distinct()
    a = averaged(spark, sf).select("id")
    yes = a.join(ids, "id", "left_semi").withColumn("is_counterfactual", F.lit(True))
    no = a.join(ids, "id", "left_anti").withColumn("is_counterfactual", F.lit(False))
    return yes.unionByName(no)


@register("positional_concat", B + """
SELECT a.id, round(a.pvi, 6) AS pvi_1, round(b.pvi, 6) AS pvi_2
FROM (SELECT * FROM scored WHERE run = 1) a JOIN (SELECT * FROM scored WHERE run = 2) b ON a.id = b.id""")
def q_positional_concat(spark, sf):
    """The reference glues run tables side by side by row position; here by key."""
    s = scored(spark, sf)
    a = s.filter(F.col("run") == 1).select("id", r6("pvi").alias("pvi_1"))
    b = s.filter(F.col("run") == 2).select("id", r6("pvi").alias("pvi_2"))
    return a.join(b, "id")


@register("union_splits", B + """
SELECT id, y, average_pvi, NULL::DOUBLE AS average_el2n FROM avg_scores WHERE y = 1
UNION ALL SELECT id, y, NULL::DOUBLE, average_el2n FROM avg_scores WHERE y = 0""")
def q_union_splits(spark, sf):
    a = averaged(spark, sf)
    p = a.filter(F.col("y") == 1).select("id", "y", "average_pvi")
    n = a.filter(F.col("y") == 0).select("id", "y", "average_el2n")
    return p.unionByName(n, allowMissingColumns=True)


@register("union_distinct_ids", B + """
SELECT id FROM avg_scores WHERE misclassification_number >= 4
UNION SELECT id FROM avg_scores WHERE average_pvi < 0""")
def q_union_distinct_ids(spark, sf):
    a = averaged(spark, sf)
    return (a.filter(F.col("misclassification_number") >= 4).select("id")
            .union(a.filter(F.col("average_pvi") < 0).select("id")).distinct())


@register("drop_rows_by_index", B + """
SELECT id FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY average_pvi DESC, id) AS pos FROM raw_scores) WHERE pos <> 5""")
def q_drop_rows_by_index(spark, sf):
    return J.drop_rows_by_rank(averaged_exactly(spark, sf).select("id", "average_pvi"),
                               [F.col("average_pvi").desc(), "id"], [5]).select("id")


@register("group_sentences_to_document", """
SELECT conv_id, list(text ORDER BY turn) AS texts, list(role ORDER BY turn)[1] AS role, COUNT(*) AS n_sentences
FROM conversations GROUP BY conv_id""")
def q_group_sentences(spark, sf):
    c = table(spark, sf, "conversations")
    d = J.group_sentences_to_document(c, "conv_id", "turn", ["text"], "role")
    return d.select("conv_id", "texts", "role", F.col("n_sentences").cast("long"))


@register("group_predictions_to_document", X.with_ctes(PAIRS_SQL) + """
SELECT p.conv_id, COUNT(*) AS n_predictions, list(p.uid ORDER BY p.turn) AS uids
FROM pairs p WHERE p.conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) GROUP BY p.conv_id""")
def q_group_predictions(spark, sf):
    """Per-pair predictions grouped under their parent conversation (inner join
    to the parents; pairs without a parent drop out)."""
    from sievekit.operators import text as OT
    pairs = OT.conversation_pairs(table(spark, sf, "conversations"))
    parents = table(spark, sf, "conversations").filter(F.col("turn") == 0).select("conv_id").distinct()
    g = pairs.join(parents, "conv_id").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "uid"))), lambda s: s["uid"]).alias("uids"))
    return g


@register("explode_grid", """
SELECT l.lang, r.prune_rate, s.run FROM (SELECT DISTINCT lang FROM documents) l
CROSS JOIN (VALUES (5), (10), (15), (20), (25), (30), (35), (40), (50), (60)) AS r(prune_rate)
CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS s(run)""")
def q_explode_grid(spark, sf):
    """``itertools.product`` of datasets × rates × runs as a cross join of
    small tables (rates and runs are literal, datasets come from the data)."""
    langs = table(spark, sf, "documents").select("lang").distinct()
    rates = spark.createDataFrame([(r,) for r in (5, 10, 15, 20, 25, 30, 35, 40, 50, 60)], "prune_rate int")
    runs = X.runs(spark)
    return langs.crossJoin(F.broadcast(rates)).crossJoin(F.broadcast(runs))


@register("melt_support_counter", MN._SC_SQL + """
SELECT group_key, group_j, metric, round(value, 6) AS value FROM (
  SELECT group_key, group_j, 'support_acc' AS metric, support_acc AS value FROM sc
  UNION ALL SELECT group_key, group_j, 'counter_acc', counter_acc FROM sc)""")
def q_melt_support_counter(spark, sf):
    _, s = MN._sc(spark, sf)
    m = J.melt(s, ["group_key", "group_j"], ["support_acc", "counter_acc"], "metric", "value")
    return m.select("group_key", "group_j", "metric", r6("value").alias("value"))


@register("select_rows_label", MN.GROUPS_ROOT_SQL + """
SELECT group_key, group_j, 'Subtrees' AS family, 'shortcut ' || CAST(rk AS VARCHAR) AS shortcut FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY round(mi, 10) DESC, group_key, group_j) AS rk FROM groups) WHERE rk <= 2""")
def q_select_rows_label(spark, sf):
    """Pick groups by rank, tag them with feature family and shortcut name."""
    from pyspark.sql import Window
    g = MN._merged(spark, sf)
    w = Window.orderBy(F.round("mi", 10).desc(), "group_key", "group_j")  # groups: ≤ K·|Y| rows
    r = g.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= 2)
    return r.select("group_key", "group_j", F.lit("Subtrees").alias("family"),
                    F.concat(F.lit("shortcut "), F.col("rk").cast("string")).alias("shortcut"))


_PAT_SQL = MN.GROUPS_ROOT_SQL + """,
pats AS (SELECT DISTINCT trim(p) AS pattern, majority FROM (SELECT unnest(string_split(examples, ',')) AS p, majority FROM groups)
         WHERE trim(p) <> '' AND NOT contains(trim(p), '[UNK]')),
rx AS (SELECT pattern, majority, regexp_replace(pattern, '([!-/:-@\\[-`{-~])', '\\\\\\1', 'g') AS esc FROM pats)"""


def _patterns(spark, sf):
    return J.explode_examples(MN._merged(spark, sf)).select("pattern", "majority")


@register("pattern_join", _PAT_SQL + """
SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM rx WHERE regexp_matches(d.text, '(?i)' || rx.esc))""")
def q_pattern_join(spark, sf):
    """Documents matching any example word of the mined groups."""
    return J.pattern_join(table(spark, sf, "documents").select("doc_id", "text"), _patterns(spark, sf),
                          literal=True).select("doc_id")


@register("cross_class_shortcuts", _PAT_SQL + """
SELECT e.id FROM examples e WHERE e.y = 0
  AND EXISTS (SELECT 1 FROM rx WHERE rx.majority = 1 AND regexp_matches(e.text, '(?i)' || rx.esc))""")
def q_cross_class_shortcuts(spark, sf):
    """Class-0 examples matching patterns mined from class-1 groups."""
    p = _patterns(spark, sf).filter(F.col("majority") == 1)
    ex = X.examples(spark, sf).filter(F.col("y") == 0).select("id", "text")
    return J.pattern_join(ex, p, literal=True).select("id")


@register("type_split_shape", _PAT_SQL.replace("WITH ", "WITH ", 1) + """,
runs AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) AS v(run)),
""" + X.PREDICTIONS_SQL + ", " + X.SCORES_SQL + """
SELECT CASE WHEN a.misclassification_number >= 4 THEN 'incorrect' ELSE 'correct' END AS correctness, COUNT(*) AS count
FROM examples e JOIN avg_scores a ON e.id = a.id
WHERE EXISTS (SELECT 1 FROM rx WHERE regexp_matches(e.text, '(?i)' || rx.esc)) GROUP BY 1""")
def q_type_split_shape(spark, sf):
    """Correct / incorrect counts among rows that hold a mined shortcut."""
    ex = X.examples(spark, sf).select("id", "text")
    hit = J.pattern_join(ex, _patterns(spark, sf), literal=True).select("id")
    b = I.correctness_band(averaged(spark, sf)).join(hit, "id", "left_semi")
    return M.value_counts(b, ["correctness"])


__all__ = ["TX", "TR", "tok_sql"]
