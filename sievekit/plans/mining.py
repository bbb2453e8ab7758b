"""Registered queries for §2.I parse-tree features, MI and shortcut groups.

Trees: one flat tree per labelled document over **all** its words,
``(S (L w1) … (L wk))`` (FIXTURES §3), so the node set has a closed form and a
SQL oracle: k leaves ``(L *)`` + one root.  Labels: ``y = toxic``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions import text as TX
from sievekit.functions._util import r6
from sievekit.operators import shortcuts as SC
from sievekit.operators import trees as TR
from sievekit.plans import fixtures as X
from sievekit.plans.registry import register
from sievekit.plans.textual import tok_sql

K_TOP = 50
LABEL_NAMES = ["non-toxic", "toxic"]

_TOKS_SQL = f"""toks AS (
  SELECT id, y, list_transform({tok_sql('text')}, lambda w: CASE w WHEN '(' THEN '-LRB-' WHEN ')' THEN '-RRB-'
         WHEN '/' THEN '-SLASH-' ELSE w END) AS t FROM examples)"""

_NODES_SQL = r"""nodes AS (
  SELECT id, y, CAST(pos AS INTEGER) AS node_no, 'L' AS root, '(L *)' AS tpl, replace(w, '_', '') AS yield,
         1 AS depth, 1 AS n_leaves, 0 AS n_children
  FROM (SELECT id, y, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS pos FROM toks)
  UNION ALL
  SELECT id, y, CAST(len(t) + 1 AS INTEGER), 'S', '(S ' || array_to_string(list_transform(t, lambda w: '(L *)'), ' ') || ')',
         regexp_replace(array_to_string(list_transform(t, lambda w: replace(w, '_', '')), ' '), '\s+', ' ', 'g'),
         2, CAST(len(t) AS INTEGER), CAST(len(t) AS INTEGER)
  FROM toks WHERE len(t) > 0)"""

TREES_SQL = X.with_ctes(X.EXAMPLES_SQL, _TOKS_SQL, _NODES_SQL)


def mi_sql(src: str, name: str = "fmi") -> str:
    """SQL twin of ``feature_mi`` for two labels (0, 1) over incidence ``src``."""
    return f"""tot AS (SELECT max(CASE WHEN y = 0 THEN n END) AS t0, max(CASE WHEN y = 1 THEN n END) AS t1
  FROM (SELECT y, COUNT(*) AS n FROM examples GROUP BY y)),
cnt AS (SELECT tpl, yield, CAST(SUM(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0,
               CAST(SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1 FROM {src} GROUP BY tpl, yield),
cells AS (SELECT *, CAST(n0 + 1 AS DOUBLE) AS a1, CAST(t0 - n0 + 1 AS DOUBLE) AS a0,
                 CAST(n1 + 1 AS DOUBLE) AS b1, CAST(t1 - n1 + 1 AS DOUBLE) AS b0 FROM cnt CROSS JOIN tot),
tt AS (SELECT *, (((0.0::DOUBLE + a1) + a0) + b1) + b0 AS tt_ FROM cells),
pz AS (SELECT *, ((0.0::DOUBLE + a1) + b1) / tt_ AS pz1 FROM tt),
{name} AS (SELECT tpl, yield, n0, n1, n0 + n1 AS count,
  (((0.0::DOUBLE + (a1 / tt_) * ln((a1 / tt_) / (((a1 + a0) / tt_) * pz1)))
     + (a0 / tt_) * ln((a0 / tt_) / (((a1 + a0) / tt_) * (1.0::DOUBLE - pz1))))
     + (b1 / tt_) * ln((b1 / tt_) / (((b1 + b0) / tt_) * pz1)))
     + (b0 / tt_) * ln((b0 / tt_) / (((b1 + b0) / tt_) * (1.0::DOUBLE - pz1))) AS mi,
  CAST(CASE WHEN n0 >= n1 THEN 0 ELSE 1 END AS INTEGER) AS majority,
  greatest(n0 + 1, n1 + 1) / CAST(n0 + n1 + 2 AS DOUBLE) AS pct_majority
  FROM pz)"""


FEAT_SQL = TREES_SQL + ", feat AS (SELECT DISTINCT id, y, tpl, yield FROM nodes), " + mi_sql("feat")
TOPK_SQL = FEAT_SQL + f""", topk AS (
  SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY round(mi, 10) DESC, tpl, yield) AS INTEGER) AS topk_no
  FROM (SELECT * FROM fmi ORDER BY round(mi, 10) DESC, tpl, yield LIMIT {K_TOP}))"""


def _examples(spark, sf):
    return X.examples(spark, sf)


def _trees(spark, sf):
    ex = _examples(spark, sf)
    return ex.select(F.col("id").alias("uid"), "y", TR.flat_tree(TX.tokens_basic("text")).alias("tree"))


def _nodes(spark, sf, *columns):
    return TR.tree_nodes(_trees(spark, sf), "tree", columns=columns)


def _incidence(spark, sf):
    """The incidence table is used several times per query (MI, top-K, group
    incidence): materialise it once with a reliable checkpoint."""
    return TR.tree_features(_trees(spark, sf), "tree").select("uid", "y", "tpl", "yield").checkpoint(eager=True)


def _fmi(spark, sf, inc=None):
    inc = inc if inc is not None else _incidence(spark, sf)
    return SC.feature_mi(inc, _examples(spark, sf))


def _topk(spark, sf, k=K_TOP, inc=None):
    return SC.topk_features(_fmi(spark, sf, inc), k)


_NODE_COLS = ["node_no", "root", "tpl", "yield", "depth", "n_leaves"]


@register("tree_nodes", TREES_SQL + "SELECT id AS uid, node_no, root, tpl, yield, depth, n_leaves FROM nodes")
def q_tree_nodes(spark, sf):
    return _nodes(spark, sf, *_NODE_COLS).select("uid", *_NODE_COLS)


@register("explode_tree", TREES_SQL + "SELECT id AS uid, node_no, root, tpl, yield, depth, n_leaves FROM nodes")
def q_explode_tree(spark, sf):
    """The table function on the session, called from SQL with ``LATERAL``."""
    TR.register_functions(spark)
    return spark.sql("SELECT t.uid, n.node_no, n.root, n.tpl, n.yield, n.depth, n.n_leaves "
                     "FROM {trees} t, LATERAL explode_tree(t.tree, false) n", trees=_trees(spark, sf))


@register("tree_templates", TREES_SQL + "SELECT id AS uid, node_no, tpl FROM nodes")
def q_tree_templates(spark, sf):
    return _nodes(spark, sf, "node_no", "tpl").select("uid", "node_no", "tpl")


@register("tree_spans", TREES_SQL + "SELECT id AS uid, node_no, yield FROM nodes")
def q_tree_spans(spark, sf):
    return _nodes(spark, sf, "node_no", "yield").select("uid", "node_no", "yield")


@register("template_depth", TREES_SQL + "SELECT id AS uid, node_no, depth FROM nodes")
def q_template_depth(spark, sf):
    return _nodes(spark, sf, "node_no", "depth").select("uid", "node_no", "depth")


@register("root_label", TREES_SQL + """
SELECT DISTINCT tpl, regexp_extract(tpl, '^\\(([^ ]*) ', 1) AS root FROM nodes""")
def q_root_label(spark, sf):
    return _nodes(spark, sf, "tpl").select("tpl").distinct().select("tpl", TR.root_label("tpl").alias("root"))


@register("root_production", TREES_SQL + """
SELECT id AS uid, node_no, root AS lhs,
  CASE WHEN root = 'L' THEN '(' || CASE WHEN yield_raw = '''' THEN '"''"' WHEN yield_raw = '\\' THEN '''\\\\'''
                                        ELSE '''' || yield_raw || '''' END || ',)'
       ELSE '(' || array_to_string(list_transform(range(n_children), lambda i: 'L'), ', ')
            || CASE WHEN n_children = 1 THEN ',' ELSE '' END || ')' END AS rhs
FROM (SELECT n.*, t.t[n.node_no] AS yield_raw FROM nodes n JOIN toks t ON n.id = t.id)""")
def q_root_production(spark, sf):
    return _nodes(spark, sf, "node_no", "lhs", "rhs").select("uid", "node_no", "lhs", "rhs")


@register("node_production")
def q_node_production(spark, sf):
    """Printable node (``A -> 'w'`` / ``A -> B C``) and child count."""
    return _nodes(spark, sf, "node_no", "node", "n_children").select("uid", "node_no", "node", "n_children")


@register("tree_parse_skipped")
def q_tree_parse_skipped(spark, sf):
    """Bracket strings straight from raw text, ``(S <text>)``: texts holding
    unbalanced brackets do not parse; they are skipped and counted."""
    d = _examples(spark, sf).select(F.concat(F.lit("(S "), F.col("text"), F.lit(")")).alias("tree"))
    return TR.count_unparsed(d, "tree")


@register("subtree_features", FEAT_SQL + "SELECT id AS uid, tpl, yield FROM feat")
def q_subtree_features(spark, sf):
    return _incidence(spark, sf).select("uid", "tpl", "yield")


@register("pcfg_subtree_features", FEAT_SQL + "SELECT id AS uid, y, tpl, yield FROM feat")
def q_pcfg_subtree_features(spark, sf):
    return _incidence(spark, sf).select("uid", "y", "tpl", "yield")


@register("subtree_features_max_depth", TREES_SQL + "SELECT DISTINCT id AS uid, tpl, yield FROM nodes WHERE depth <= 1")
def q_subtree_features_max_depth(spark, sf):
    return TR.tree_features(_trees(spark, sf), "tree", max_depth=1).select("uid", "tpl", "yield")


@register("production_features")
def q_production_features(spark, sf):
    """Grammar productions as binary features ``(lhs, rhs)`` per example."""
    return _nodes(spark, sf, "lhs", "rhs").select("uid", "lhs", "rhs").distinct()


@register("production_tree_features", TREES_SQL + """
SELECT id AS uid, 'S -> L L' AS node, yield FROM nodes WHERE n_children >= 2""")
def q_production_tree_features(spark, sf):
    """Binary productions with the flattened subtree (its yield); nodes with at
    most one child are skipped."""
    return _nodes(spark, sf, "node", "yield", "n_children").filter(F.col("n_children") >= 2).select("uid", "node", "yield")


@register("tree_feature_rows", TREES_SQL + """
SELECT id AS uid, y, CASE WHEN y = 1 THEN 'toxic' ELSE 'non-toxic' END AS label, yield AS span, tpl, root FROM nodes""")
def q_tree_feature_rows(spark, sf):
    n = _nodes(spark, sf, "yield", "tpl", "root")
    lab = F.element_at(F.array(*[F.lit(x) for x in LABEL_NAMES]), F.col("y") + 1)
    return n.select("uid", "y", lab.alias("label"), F.col("yield").alias("span"), "tpl", "root")


@register("label_feature_counts", FEAT_SQL + "SELECT tpl, yield, n0, n1 FROM fmi")
def q_label_feature_counts(spark, sf):
    f = _fmi(spark, sf)
    return f.select("tpl", "yield", F.element_at("counts", 1).alias("n0"), F.element_at("counts", 2).alias("n1"))


@register("mutual_information", FEAT_SQL + "SELECT tpl, yield, round(mi, 6) AS mi FROM fmi")
def q_mutual_information(spark, sf):
    return _fmi(spark, sf).select("tpl", "yield", r6("mi").alias("mi"))


@register("feature_vocabulary", FEAT_SQL + """
SELECT tpl, yield, CAST(ROW_NUMBER() OVER (ORDER BY round(mi, 10) DESC, tpl, yield) AS INTEGER) AS feature_no,
       round(mi, 6) AS mi FROM fmi""")
def q_feature_vocabulary(spark, sf):
    v = SC.feature_vocabulary(_fmi(spark, sf))
    return v.select("tpl", "yield", "feature_no", r6("mi").alias("mi"))


@register("feature_table", FEAT_SQL + """
SELECT regexp_extract(tpl, '^\\(([^ ]*) ', 1) AS "Root", tpl AS "Subtree", yield AS "Yield", round(mi, 6) AS "MI",
       count AS "Count", n0 AS "non-toxic", n1 AS "toxic",
       CASE WHEN majority = 0 THEN 'non-toxic' ELSE 'toxic' END AS "Majority label",
       round(pct_majority, 6) AS "% majority" FROM fmi""")
def q_feature_table(spark, sf):
    t = SC.feature_table(_fmi(spark, sf), [0, 1], LABEL_NAMES)
    return t.withColumn("MI", r6("MI")).withColumn("% majority", r6("% majority"))


@register("topk_features", TOPK_SQL + """
SELECT topk_no, tpl, yield, round(mi, 6) AS mi, count, majority FROM topk""")
def q_topk_features(spark, sf):
    return _topk(spark, sf).select("topk_no", "tpl", "yield", r6("mi").alias("mi"), "count", "majority")


@register("feature_filter", FEAT_SQL + """
SELECT tpl, yield, CAST(length(tpl) - length(replace(tpl, '*', '')) AS INTEGER) AS n_leaves FROM fmi
WHERE length(tpl) - length(replace(tpl, '*', '')) >= 2 AND starts_with(tpl, '(S ')""")
def q_feature_filter(spark, sf):
    """Templates with at least two leaves whose root is ``S``."""
    f = _fmi(spark, sf)
    n = TR.template_leaf_count("tpl").cast("int")
    return f.filter((n >= 2) & F.col("tpl").startswith("(S ")).select("tpl", "yield", n.alias("n_leaves"))


def _groups_sql(key_expr: str, head: str = TOPK_SQL) -> str:
    return head + f""",
members AS (SELECT tpl, yield, topk_no, {key_expr} AS group_key, majority AS group_j FROM topk),
ginc AS (SELECT DISTINCT f.id, f.y, m.group_key, m.group_j FROM feat f JOIN members m ON f.tpl = m.tpl AND f.yield = m.yield),
gcnt AS (SELECT k.group_key, j.group_j,
           CAST(COALESCE(SUM(CASE WHEN g.y = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n0,
           CAST(COALESCE(SUM(CASE WHEN g.y = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n1
         FROM (SELECT DISTINCT group_key FROM members) k CROSS JOIN (VALUES (0), (1)) AS j(group_j)
         LEFT JOIN ginc g ON g.group_key = k.group_key AND g.group_j = j.group_j
         GROUP BY k.group_key, j.group_j),
gtot AS (SELECT max(CASE WHEN y = 0 THEN n END) AS t0, max(CASE WHEN y = 1 THEN n END) AS t1
  FROM (SELECT y, COUNT(*) AS n FROM examples GROUP BY y)),
gc AS (SELECT *, CAST(n0 + 1 AS DOUBLE) AS a1, CAST(t0 - n0 + 1 AS DOUBLE) AS a0,
              CAST(n1 + 1 AS DOUBLE) AS b1, CAST(t1 - n1 + 1 AS DOUBLE) AS b0 FROM gcnt CROSS JOIN gtot),
gt AS (SELECT *, (((0.0::DOUBLE + a1) + a0) + b1) + b0 AS tt_ FROM gc),
gp AS (SELECT *, ((0.0::DOUBLE + a1) + b1) / tt_ AS pz1 FROM gt),
groups AS (SELECT gp.group_key, gp.group_j, n0, n1, n0 + n1 AS count,
  (((0.0::DOUBLE + (a1 / tt_) * ln((a1 / tt_) / (((a1 + a0) / tt_) * pz1)))
     + (a0 / tt_) * ln((a0 / tt_) / (((a1 + a0) / tt_) * (1.0::DOUBLE - pz1))))
     + (b1 / tt_) * ln((b1 / tt_) / (((b1 + b0) / tt_) * pz1)))
     + (b0 / tt_) * ln((b0 / tt_) / (((b1 + b0) / tt_) * (1.0::DOUBLE - pz1))) AS mi,
  CAST(CASE WHEN n0 >= n1 THEN 0 ELSE 1 END AS INTEGER) AS majority,
  greatest(n0 + 1, n1 + 1) / CAST(n0 + n1 + 2 AS DOUBLE) AS pct_majority,
  COALESCE((SELECT array_to_string(list(m.yield ORDER BY m.topk_no)[1:8], ', ') FROM members m
            WHERE m.group_key = gp.group_key AND m.group_j = gp.group_j), '') AS examples
  FROM gp)"""


_GROUP_COLS_SQL = """SELECT group_key, group_j, examples, round(mi, 6) AS mi, count, n0, n1, majority,
       round(pct_majority, 6) AS pct_majority, greatest(n0, n1) AS support_count, count - greatest(n0, n1) AS counter_count
FROM groups"""


def _group_cols(g):
    return g.select("group_key", "group_j", "examples", r6("mi").alias("mi"), "count",
                    F.element_at("counts", 1).alias("n0"), F.element_at("counts", 2).alias("n1"), "majority",
                    r6("pct_majority").alias("pct_majority"), "support_count", "counter_count")


def _merged(spark, sf, by_template=False):
    inc = _incidence(spark, sf)
    topk = _topk(spark, sf, inc=inc).checkpoint(eager=True)     # K rows, used in several places
    return SC.merge_by_majority(inc, _examples(spark, sf), topk, by_template=by_template)


GROUPS_ROOT_SQL = _groups_sql("regexp_extract(tpl, '^\\(([^ ]*) ', 1)")


@register("merge_by_majority", GROUPS_ROOT_SQL + _GROUP_COLS_SQL)
def q_merge_by_majority(spark, sf):
    return _group_cols(_merged(spark, sf))


@register("merge_by_template", _groups_sql("tpl") + _GROUP_COLS_SQL)
def q_merge_by_template(spark, sf):
    return _group_cols(_merged(spark, sf, by_template=True))


@register("group_table", GROUPS_ROOT_SQL + """
SELECT group_key AS "Root", examples AS "Examples", round(mi, 6) AS "MI", count AS "Count",
       n0 AS "non-toxic", n1 AS "toxic", majority AS "Majority label idx",
       CASE WHEN majority = 0 THEN 'non-toxic' ELSE 'toxic' END AS "Majority label",
       round(pct_majority, 6) AS "% majority", greatest(n0, n1) AS "Support count",
       count - greatest(n0, n1) AS "Counter count" FROM groups""")
def q_group_table(spark, sf):
    g = _merged(spark, sf)
    lab = F.array(*[F.lit(x) for x in LABEL_NAMES])
    return g.select(F.col("group_key").alias("Root"), F.col("examples").alias("Examples"),
                    r6("mi").alias("MI"), F.col("count").alias("Count"),
                    F.element_at("counts", 1).alias("non-toxic"), F.element_at("counts", 2).alias("toxic"),
                    F.col("majority").alias("Majority label idx"),
                    F.element_at(lab, F.col("majority") + 1).alias("Majority label"),
                    r6("pct_majority").alias("% majority"), F.col("support_count").alias("Support count"),
                    F.col("counter_count").alias("Counter count"))


@register("fmt_words", GROUPS_ROOT_SQL + "SELECT group_key, group_j, examples FROM groups")
def q_fmt_words(spark, sf):
    g = _merged(spark, sf)
    return g.select("group_key", "group_j", SC.fmt_words(F.slice("members", 1, 8)).alias("examples"))


@register("fmt_words_pairs")
def q_fmt_words_pairs(spark, sf):
    """The word pairs of the top synchronous features, written as ``left/right``, per number of words."""
    _, pats = _pair_patterns(spark, sf)
    by = pats.groupBy((F.size("u") + F.size("v")).alias("n_words")).agg(F.array_sort(F.collect_list(F.struct("group", "u", "v"))).alias("p"))
    return by.select("n_words", SC.fmt_pairs("p").alias("examples"))


@register("majority_view", GROUPS_ROOT_SQL + """
SELECT group_key, group_j, round(mi, 6) AS mi, majority FROM groups WHERE majority = 1
ORDER BY majority DESC, round(mi, 10) DESC, group_key, group_j LIMIT 10""")
def q_majority_view(spark, sf):
    v = SC.majority_view(_merged(spark, sf), majority=1, n=10)
    return v.select("group_key", "group_j", r6("mi").alias("mi"), "majority")


_PHASE = "CASE WHEN substr(md5('phase|' || CAST(id AS VARCHAR)), 1, 1) < '4' THEN 'test' ELSE 'train' END"


def _phase(c="uid"):
    return F.when(F.substring(F.md5(F.concat(F.lit("phase|"), F.col(c).cast("string"))), 1, 1) < "4",
                  "test").otherwise("train")


_SPLIT_SQL = X.with_ctes(X.EXAMPLES_SQL.replace("examples AS", "all_examples AS"),
                         f"examples AS (SELECT * FROM all_examples WHERE {_PHASE} = 'train')",
                         _TOKS_SQL.replace("FROM examples", "FROM all_examples"), _NODES_SQL) + """,
allfeat AS (SELECT DISTINCT id, y, tpl, yield FROM nodes),
feat AS (SELECT * FROM allfeat WHERE id IN (SELECT id FROM examples)), """ + mi_sql("feat")


def _split_parts(spark, sf):
    inc = _incidence(spark, sf).withColumn("phase", _phase())
    ex = _examples(spark, sf).withColumn("phase", _phase("id"))
    train_ex = ex.filter(F.col("phase") == "train")
    train_inc = inc.filter(F.col("phase") == "train").drop("phase")
    eval_inc = inc.filter(F.col("phase") == "test").drop("phase")
    return train_ex, train_inc, eval_inc


@register("add_features_train", _SPLIT_SQL + "SELECT tpl, yield, n0, n1, round(mi, 6) AS mi FROM fmi")
def q_add_features_train(spark, sf):
    """Fit features and MI on the train split only."""
    train_ex, train_inc, _ = _split_parts(spark, sf)
    f = SC.feature_mi(train_inc, train_ex)
    return f.select("tpl", "yield", F.element_at("counts", 1).alias("n0"),
                    F.element_at("counts", 2).alias("n1"), r6("mi").alias("mi"))


@register("add_features", _SPLIT_SQL + f"""
SELECT a.id AS uid, a.tpl, a.yield FROM allfeat a
WHERE a.id IN (SELECT id FROM all_examples WHERE {_PHASE} = 'test')
  AND EXISTS (SELECT 1 FROM fmi f WHERE f.tpl = a.tpl AND f.yield = a.yield)""")
def q_add_features(spark, sf):
    """Apply train features to the evaluation split: unseen features dropped."""
    train_ex, train_inc, eval_inc = _split_parts(spark, sf)
    f = SC.feature_mi(train_inc, train_ex)
    return SC.apply_train_features(f, eval_inc).select("uid", "tpl", "yield")


_ACC_SQL = """acc AS (SELECT p.id, CAST(p.p1 >= 0.5 AS INTEGER) AS y_hat,
  CAST(CAST(p.p1 >= 0.5 AS INTEGER) = e.y AS INTEGER) AS acc FROM preds p JOIN examples e ON p.id = e.id WHERE p.run = 1)"""


def _acc(spark, sf):
    ex = _examples(spark, sf)
    p = X.predictions(ex).filter(F.col("run") == 1).join(ex.select("id", "y"), "id")
    return p.select(F.col("id").alias("uid"), F.col("predicted").alias("y_hat"),
                    (F.col("predicted") == F.col("y")).cast("int").alias("acc"))


@register("attach_classifier_accuracy", X.with_ctes(X.EXAMPLES_SQL, X.RUNS_SQL, X.PREDICTIONS_SQL, _ACC_SQL) +
          "SELECT id AS uid, y_hat, acc FROM acc")
def q_attach_classifier_accuracy(spark, sf):
    return _acc(spark, sf)


_SC_SQL = GROUPS_ROOT_SQL + """, runs AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) AS v(run)), """ + \
    X.PREDICTIONS_SQL + ", " + _ACC_SQL + """,
sc AS (SELECT g.group_key, g.group_j,
         avg(CASE WHEN g.y = gr.majority THEN CAST(a.acc AS DOUBLE) END) AS support_acc,
         avg(CASE WHEN g.y <> gr.majority THEN CAST(a.acc AS DOUBLE) END) AS counter_acc,
         CAST(SUM(CASE WHEN g.y = gr.majority THEN 1 ELSE 0 END) AS BIGINT) AS n_support,
         CAST(SUM(CASE WHEN g.y <> gr.majority THEN 1 ELSE 0 END) AS BIGINT) AS n_counter
       FROM ginc g JOIN groups gr ON g.group_key = gr.group_key AND g.group_j = gr.group_j
       JOIN acc a ON a.id = g.id GROUP BY g.group_key, g.group_j)"""


def _sc(spark, sf, with_ginc=False):
    inc = _incidence(spark, sf)
    ex = _examples(spark, sf)
    topk = _topk(spark, sf, inc=inc).checkpoint(eager=True)     # K rows, used in several places
    groups = SC.merge_by_majority(inc, ex, topk).checkpoint(eager=True)
    ginc = SC.group_incidence(inc, SC.group_members(topk, [0, 1]))
    sc = SC.support_counter_accuracy(ginc, groups, _acc(spark, sf))
    return (groups, sc, ginc) if with_ginc else (groups, sc)


@register("support_counter_accuracy", _SC_SQL + """
SELECT group_key, group_j, round(support_acc, 6) AS support_acc, round(counter_acc, 6) AS counter_acc,
       n_support, n_counter FROM sc""")
def q_support_counter_accuracy(spark, sf):
    _, s = _sc(spark, sf)
    return s.select("group_key", "group_j", r6("support_acc").alias("support_acc"),
                    r6("counter_acc").alias("counter_acc"), "n_support", "n_counter")


@register("apply_groups", _SPLIT_SQL + f""",
topk AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY round(mi, 10) DESC, tpl, yield) AS INTEGER) AS topk_no
         FROM (SELECT * FROM fmi ORDER BY round(mi, 10) DESC, tpl, yield LIMIT {K_TOP})),
members AS (SELECT tpl, yield, regexp_extract(tpl, '^\\(([^ ]*) ', 1) AS group_key, majority AS group_j FROM topk)
SELECT DISTINCT a.id AS uid, m.group_key, m.group_j FROM allfeat a JOIN members m ON a.tpl = m.tpl AND a.yield = m.yield
WHERE a.id IN (SELECT id FROM all_examples WHERE {_PHASE} = 'test')""")
def q_apply_groups(spark, sf):
    """Groups mined on train, applied to the evaluation split."""
    train_ex, train_inc, eval_inc = _split_parts(spark, sf)
    topk = SC.topk_features(SC.feature_mi(train_inc, train_ex), K_TOP)
    g = SC.group_incidence(eval_inc, SC.group_members(topk, [0, 1]))
    return g.select("uid", "group_key", "group_j")


@register("group_support_counter_flags", _SC_SQL + """
SELECT g.id AS uid, g.group_key, g.group_j, g.y = gr.majority AS support, g.y <> gr.majority AS counter
FROM ginc g JOIN groups gr ON g.group_key = gr.group_key AND g.group_j = gr.group_j""")
def q_group_flags(spark, sf):
    groups, _, ginc = _sc(spark, sf, with_ginc=True)
    j = ginc.join(groups.select("group_key", "group_j", "majority"), ["group_key", "group_j"])
    return j.select("uid", "group_key", "group_j", (F.col("y") == F.col("majority")).alias("support"),
                    (F.col("y") != F.col("majority")).alias("counter"))


_MODELS_SQL = _groups_sql("regexp_extract(tpl, '^\\(([^ ]*) ', 1)", _SPLIT_SQL + f""",
topk AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY round(mi, 10) DESC, tpl, yield) AS INTEGER) AS topk_no
         FROM (SELECT * FROM fmi ORDER BY round(mi, 10) DESC, tpl, yield LIMIT {K_TOP}))""") + """,
runs AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) AS v(run)),
""" + X.PREDICTIONS_SQL.replace("FROM examples", "FROM all_examples") + f""",
members2 AS (SELECT DISTINCT a.id, a.y, m.group_key, m.group_j FROM allfeat a JOIN members m ON a.tpl = m.tpl AND a.yield = m.yield),
ga AS (SELECT g.group_key, g.group_j, g.mi, g.n0, g.n1, g.majority, {_PHASE.replace('id AS', 'm.id AS')} AS split, 'run' || p.run AS model,
    COUNT(*) AS n, avg(CAST(m.y = g.majority AS DOUBLE)) AS majority_acc,
    avg(CASE WHEN m.y = g.majority THEN CAST((p.p1 >= 0.5) = (m.y = 1) AS DOUBLE) END) AS support_acc,
    avg(CASE WHEN m.y <> g.majority THEN CAST((p.p1 >= 0.5) = (m.y = 1) AS DOUBLE) END) AS counter_acc,
    avg(CASE WHEN m.y = CASE WHEN g.n0 <= g.n1 THEN 0 ELSE 1 END THEN CAST((p.p1 >= 0.5) = (m.y = 1) AS DOUBLE) END) AS hard_counter_acc
  FROM members2 m JOIN groups g ON m.group_key = g.group_key AND m.group_j = g.group_j JOIN preds p ON p.id = m.id GROUP BY ALL)"""


@register("group_accuracy_tables", _MODELS_SQL + """
SELECT group_key, group_j, round(mi, 6) AS mi, n0, n1, majority, split, model, n, round(majority_acc, 6) AS majority_acc,
       round(support_acc, 6) AS support_acc, round(counter_acc, 6) AS counter_acc,
       round(hard_counter_acc, 6) AS hard_counter_acc, round(support_acc - counter_acc, 6) AS drop_ FROM ga""")
def q_group_accuracy_tables(spark, sf):
    """Groups mined on the training split, looked at in both splits and through five models: accuracy of the majority
    guess, of the model on support, on counter-examples and on those of the group's own least frequent class."""
    inc = _incidence(spark, sf)
    ex = _examples(spark, sf)
    train = ex.where(_phase("id") == "train")
    train_inc = inc.where(_phase() == "train")
    topk = SC.topk_features(SC.feature_mi(train_inc, train), K_TOP).checkpoint(eager=True)
    groups = SC.merge_by_majority(train_inc, train, topk)
    ginc = SC.group_incidence(inc, SC.group_members(topk, [0, 1]))
    right = X.predictions(ex).join(ex.select("id", "y"), "id").select(
        F.col("id").alias("uid"), F.concat(F.lit("run"), F.col("run").cast("string")).alias("model"),
        (F.col("predicted") == F.col("y")).cast("int").alias("acc"))
    acc = SC.group_accuracy(ginc, groups, right, ex.select(F.col("id").alias("uid"), _phase("id").alias("split")))
    j = acc.join(groups.select("group_key", "group_j", "mi", "counts", "majority"), ["group_key", "group_j"])
    shown = ("majority_acc", "support_acc", "counter_acc", "hard_counter_acc")
    return j.select("group_key", "group_j", r6("mi").alias("mi"), F.element_at("counts", 1).alias("n0"),
                    F.element_at("counts", 2).alias("n1"), "majority", "split", "model", "n", *(r6(c).alias(c) for c in shown),
                    r6(F.col("support_acc") - F.col("counter_acc")).alias("drop_"))


@register("split_accuracy_support_counter", _SC_SQL + f"""
SELECT CASE WHEN {_PHASE.replace('id', 'g.id')} = 'test' THEN 'test' ELSE 'train' END AS split,
       g.y = gr.majority AS is_support, COUNT(*) AS n, round(avg(CAST(a.acc AS DOUBLE)), 6) AS accuracy
FROM ginc g JOIN groups gr ON g.group_key = gr.group_key AND g.group_j = gr.group_j JOIN acc a ON a.id = g.id
GROUP BY 1, 2""")
def q_split_accuracy(spark, sf):
    groups, _, ginc = _sc(spark, sf, with_ginc=True)
    j = (ginc.join(groups.select("group_key", "group_j", "majority"), ["group_key", "group_j"])
         .join(_acc(spark, sf), "uid"))
    return (j.withColumn("split", _phase()).withColumn("is_support", F.col("y") == F.col("majority"))
            .groupBy("split", "is_support").agg(F.count(F.lit(1)).alias("n"),
                                                r6(F.avg(F.col("acc").cast("double"))).alias("accuracy")))


@register("yield_equals", TREES_SQL + "SELECT DISTINCT id AS uid, tpl FROM nodes WHERE yield = 'the'")
def q_yield_equals(spark, sf):
    return _nodes(spark, sf, "yield", "tpl").filter(F.col("yield") == "the").select("uid", "tpl").distinct()


@register("merge_greedy")
def q_merge_greedy(spark, sf):
    """Greedy MI merge of the top-1000 features, per root label."""
    inc = _incidence(spark, sf)
    topk = SC.topk_features(SC.feature_mi(inc, _examples(spark, sf)), 1000).checkpoint(eager=True)
    g = SC.merge_greedy(inc, _examples(spark, sf), topk)
    return g.select("group_key", "g", r6("mi").alias("mi"), "count", "counts", "examples")


def _pair_trees(spark, sf):
    """Synchronous trees over conversation pairs: premise words ``w/`` and
    hypothesis words ``/v`` under one root."""
    from sievekit.operators import text as OT
    from sievekit.sources.tables import table
    pairs = OT.conversation_pairs(table(spark, sf, "conversations"))
    t = pairs.select("uid", (F.col("turn") % 2).cast("int").alias("y"),
                     TX.tokens_basic("premise").alias("a_tokens"), TX.tokens_basic("hypothesis").alias("b_tokens"))
    trees = t.select("uid", "y", "a_tokens", "b_tokens", TR.pair_tree("a_tokens", "b_tokens").alias("tree"))
    return t, trees.select("uid", "y", "tree")


@register("subtree_features_scfg")
def q_subtree_features_scfg(spark, sf):
    """Synchronous-grammar features ``(tpl, yield)`` per pair (set semantics)."""
    return TR.tree_features(_pair_trees(spark, sf)[1], "tree", scfg=True).select("uid", "tpl", "yield")


@register("subtree_to_ngram_pair")
def q_subtree_to_ngram_pair(spark, sf):
    """Synchronous yields split at the last ``/`` into (left n-gram, right n-gram)."""
    n = TR.tree_nodes(_pair_trees(spark, sf)[1], "tree", scfg=True, columns=("node_no", "yield"))
    u, v = SC.subtree_to_ngram_pair("yield")
    return n.select("uid", "node_no", "yield", u.alias("u"), v.alias("v"))


def _pair_patterns(spark, sf, k=20):
    """Groups of n-gram twins from the top synchronous features: every top
    feature of depth ≤ 2 is one group holding its (u, v) pair."""
    t, trees = _pair_trees(spark, sf)
    inc = TR.tree_features(trees, "tree", scfg=True).checkpoint(eager=True)
    ex = t.select(F.col("uid").alias("id"), "y")
    top = SC.topk_features(SC.feature_mi(inc, ex), k)
    u, v = SC.subtree_to_ngram_pair("yield")
    pats = top.select(F.col("topk_no").alias("group"), u.alias("u"), v.alias("v"))
    pats = pats.withColumn("u", F.when(F.col("u") == F.array(F.lit("")), F.array(F.lit("ϵ"))).otherwise(F.col("u")))
    return t, pats


@register("pair_ngram_features")
def q_pair_ngram_features(spark, sf):
    """Pairs holding group i's premise n-gram u and hypothesis n-gram v."""
    t, pats = _pair_patterns(spark, sf)
    return SC.pair_ngram_features(t, pats)


@register("hypothesis_ngram_features")
def q_hypothesis_ngram_features(spark, sf):
    """Pairs whose hypothesis holds group i's n-gram v."""
    t, pats = _pair_patterns(spark, sf)
    return SC.hypothesis_ngram_features(t, pats)


def _family_sql(feat: str, head: str) -> str:
    """Groups of one family with their members and the accuracies of the first run: a query that stands alone."""
    key = "regexp_extract(tpl, '^\\(([^ ]*) ', 1)"
    top = head + ", " + mi_sql(feat) + f""", topk AS (
  SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY round(mi, 10) DESC, tpl, yield) AS INTEGER) AS topk_no
  FROM (SELECT * FROM fmi ORDER BY round(mi, 10) DESC, tpl, yield LIMIT {K_TOP}))"""
    return _groups_sql(key, top) + """, runs AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) AS v(run)), """ + \
        X.PREDICTIONS_SQL + ", " + _ACC_SQL + """,
sc AS (SELECT g.group_key, g.group_j, avg(CASE WHEN g.y = gr.majority THEN CAST(a.acc AS DOUBLE) END) AS support_acc,
         avg(CASE WHEN g.y <> gr.majority THEN CAST(a.acc AS DOUBLE) END) AS counter_acc
       FROM ginc g JOIN groups gr ON g.group_key = gr.group_key AND g.group_j = gr.group_j JOIN acc a ON a.id = g.id GROUP BY 1, 2)
SELECT gr.*, sc.support_acc, sc.counter_acc, COALESCE((SELECT list(m.yield) FROM members m
  WHERE m.group_key = gr.group_key AND m.group_j = gr.group_j), []) AS yields
FROM groups gr LEFT JOIN sc ON sc.group_key = gr.group_key AND sc.group_j = gr.group_j"""


_GRAMS_SQL = """grams AS (SELECT DISTINCT id, y, tpl, yield FROM (
  SELECT id, y, '(1-gram *)' AS tpl, unnest(list_transform(range(1, len(t) + 1), lambda i: array_to_string(t[i:i], ' '))) AS yield FROM toks
  UNION ALL SELECT id, y, '(2-gram *)', unnest(list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' '))) FROM toks
  UNION ALL SELECT id, y, '(3-gram *)', unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) FROM toks))"""
_RAW_TOKS_SQL = f"toks AS (SELECT id, y, {tok_sql('text')} AS t FROM examples)"


@register("equivalent_group_tables", "WITH a AS (" + _family_sql("feat", TREES_SQL + ", feat AS (SELECT DISTINCT id, y, tpl, yield FROM nodes)")
          + "),\nb AS (" + _family_sql("feat", X.with_ctes(X.EXAMPLES_SQL, _RAW_TOKS_SQL, _GRAMS_SQL) + ", feat AS (SELECT * FROM grams)") + """),
pairs AS (SELECT a.group_key, a.group_j, b.group_key AS other_key, b.group_j AS other_j, len(list_intersect(a.yields, b.yields)) AS shared
          FROM a CROSS JOIN b),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_key, group_j ORDER BY shared DESC, other_key, other_j) AS r
                        FROM pairs WHERE shared > 0) WHERE r = 1),
f AS (SELECT group_key, group_j, 'Subtrees' AS family, CAST(NULL AS BIGINT) AS shared, group_key AS own_key, group_j AS own_j,
             n0, n1, count, majority, support_acc, counter_acc FROM a
      UNION ALL SELECT p.group_key, p.group_j, 'N-grams', p.shared, b.group_key, b.group_j, b.n0, b.n1, b.count, b.majority,
             b.support_acc, b.counter_acc FROM best p JOIN b ON b.group_key = p.other_key AND b.group_j = p.other_j)
SELECT group_key, group_j, family, own_key, own_j, shared, count, round((greatest(n0, n1) + 1) / CAST(count + 2 AS DOUBLE), 6) AS p_y_given_z,
       round(support_acc, 6) AS support, round(counter_acc, 6) AS counter, round(support_acc - counter_acc, 6) AS drop_ FROM f""")
def q_equivalent_group_tables(spark, sf):
    """Groups of subtrees and of word n-grams, each family mined for itself, lined up by the members they share: Count,
    p(y|z) with +1, support and counter accuracy and their drop, side by side."""
    ex = _examples(spark, sf)
    toks = ex.select(F.col("id").alias("uid"), "y", TX.tokens_basic("text").alias("t"))

    def of_size(n):
        return F.transform(SC.gram_texts("t", n), lambda g: F.struct(F.lit(f"({n}-gram *)").alias("tpl"), g.alias("yield")))
    sized = F.concat(*[of_size(n) for n in (1, 2, 3)])      # sizes differ in ``tpl``
    grams = toks.select("uid", "y", F.explode(sized).alias("g")).select("uid", "y", "g.tpl", "g.yield")
    acc, found = _acc(spark, sf), []
    for inc in (_incidence(spark, sf), grams.checkpoint(eager=True)):
        topk = SC.topk_features(SC.feature_mi(inc, ex), K_TOP).checkpoint(eager=True)
        groups = SC.merge_by_majority(inc, ex, topk).checkpoint(eager=True)
        ginc = SC.group_incidence(inc, SC.group_members(topk, [0, 1]))
        found.append((groups, groups.join(SC.support_counter_accuracy(ginc, groups, acc), ["group_key", "group_j"], "left")))
    (one, left), (two, right) = found
    best = SC.aligned_groups(one, two).where("shared is not null")
    cols = ["counts", "count", "support_acc", "counter_acc"]
    own = left.select("group_key", "group_j", F.lit("Subtrees").alias("family"), F.col("group_key").alias("own_key"),
                      F.col("group_j").alias("own_j"), F.lit(None).cast("long").alias("shared"), *cols)
    other = best.join(right.select(F.col("group_key").alias("other_key"), F.col("group_j").alias("other_j"), *cols),
                      ["other_key", "other_j"]).select("group_key", "group_j", F.lit("N-grams").alias("family"),
                                                       F.col("other_key").alias("own_key"), F.col("other_j").alias("own_j"), "shared", *cols)
    p = (F.array_max("counts") + 1) / (F.col("count") + 2).cast("double")
    return own.unionByName(other).select(
        "group_key", "group_j", "family", "own_key", "own_j", "shared", "count", r6(p).alias("p_y_given_z"),
        r6("support_acc").alias("support"), r6("counter_acc").alias("counter"),
        r6(F.col("support_acc") - F.col("counter_acc")).alias("drop_"))
