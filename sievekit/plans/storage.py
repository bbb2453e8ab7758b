"""Registered queries for §2.A sources and sinks: each writes a table derived
from the given data to the session's checkpoint folder in the reference's
format and reads it back with the library reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators import prune as P
from sievekit.plans import fixtures as X
from sievekit.plans import mining as MN
from sievekit.plans.registry import register
from sievekit.plans.reporting import GRID_KEYS, _f1_sql, _gp
from sievekit.plans.scoring import averaged, averaged_exactly
from sievekit.sources import files as FS

EX = X.with_ctes(X.EXAMPLES_SQL)
_W = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "header": True}


def _write_csv(df, path, sep=",", header=True):
    (df.write.mode("overwrite").options(**{**_W, "header": header}).option("sep", sep).csv(path))


@register("read_labelled_csv", EX + "SELECT id, text, y FROM examples")
def q_read_labelled_csv(spark, sf):
    """Texts with quotes, commas and newlines survive a CSV round trip."""
    path = FS.scratch_path(spark, "labelled_csv")
    _write_csv(X.examples(spark, sf).select("id", "text", "y"), path)
    return FS.read_labelled_csv(spark, path, "id long, text string, y int")


@register("read_labelled_tsv", EX + "SELECT id, text, y FROM examples")
def q_read_labelled_tsv(spark, sf):
    """Header-less TSV: the schema names the columns."""
    path = FS.scratch_path(spark, "labelled_tsv")
    _write_csv(X.examples(spark, sf).select("id", "text", "y"), path, sep="\t", header=False)
    return FS.read_labelled_tsv(spark, path, "id long, text string, y int", header=False)


_PAIRS = """pairs AS (
  SELECT CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS uid, a.text AS sentence1, b.text AS sentence2,
         CAST(a.turn % 2 AS INTEGER) AS label
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""


def _pairs(spark, sf):
    from sievekit.operators import text as OT
    from sievekit.sources.tables import table
    p = OT.conversation_pairs(table(spark, sf, "conversations"))
    return p.select("uid", F.col("premise").alias("sentence1"), F.col("hypothesis").alias("sentence2"),
                    (F.col("turn") % 2).cast("int").alias("label"))


@register("load_examples_csv", X.with_ctes(_PAIRS) + """
SELECT uid, sentence1 AS a_text, sentence2 AS b_text, uid AS a_uid, label FROM pairs""")
def q_load_examples_csv(spark, sf):
    """Pair CSV → examples with nested ``a``/``b`` (flattened for the check)."""
    path = FS.scratch_path(spark, "pairs_csv")
    _write_csv(_pairs(spark, sf), path)
    df = FS.read_labelled_csv(spark, path, "uid string, sentence1 string, sentence2 string, label int")
    e = FS.load_examples(df)
    return e.select("uid", F.col("a.text").alias("a_text"), F.col("b.text").alias("b_text"),
                    F.col("a.uid").alias("a_uid"), "label")


@register("load_examples_by_position", EX + """
SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS VARCHAR) AS uid, text, y AS label FROM examples""")
def q_load_examples_by_position(spark, sf):
    """Files without ids, written in id order (a file holds a range of ids): the uid is the row's place in them, whatever
    splits they are read in."""
    path = FS.scratch_path(spark, "positions_csv")
    ex = X.examples(spark, sf).select("id", "text", F.col("y").alias("label")).orderBy("id")
    _write_csv(ex.select("text", "label"), path)
    return FS.load_examples(FS.read_labelled_csv(spark, path, "text string, label int", uid_col="uid")).select("uid", "text", "label")


@register("load_examples_tsv", EX + "SELECT CAST(id AS VARCHAR) AS uid, text, y AS label FROM examples")
def q_load_examples_tsv(spark, sf):
    path = FS.scratch_path(spark, "examples_tsv")
    ex = X.examples(spark, sf).select(F.col("id").cast("string").alias("uid"), F.col("text").alias("sentence"),
                                      F.col("y").alias("label"))
    _write_csv(ex, path, sep="\t")
    df = FS.read_labelled_tsv(spark, path, "uid string, sentence string, label int")
    return FS.load_examples(df, text_col="sentence")


@register("load_examples_json", EX + """
SELECT CAST(id AS VARCHAR) AS uid,
       CASE WHEN starts_with(text, '<br') THEN replace(replace(text, '<br />', ''), '<br / >', '') ELSE text END AS text,
       y AS label FROM examples WHERE trim(text) <> ''""")
def q_load_examples_json(spark, sf):
    path = FS.scratch_path(spark, "examples_json")
    X.examples(spark, sf).select(F.col("id").cast("string").alias("uid"), "text", F.col("y").alias("label")) \
        .write.mode("overwrite").json(path)
    e = FS.load_examples_json(spark, path, "uid string, text string, label int", multi_line=False)
    return e.select("uid", "text", "label")


_TREES_SQL = X.with_ctes(X.EXAMPLES_SQL, MN._TOKS_SQL) + """,
trees AS (SELECT id, '(S ' || array_to_string(list_transform(t, lambda w: '(L ' || w || ')'), ' ') || ')' AS tree FROM toks)"""
_PHASE = "CASE WHEN substr(md5('phase|' || CAST(e.id AS VARCHAR)), 1, 1) < '4' THEN 'test' ELSE 'train' END"


def _phase():
    return F.when(F.substring(F.md5(F.concat(F.lit("phase|"), F.col("uid").cast("string"))), 1, 1) < "4",
                  "test").otherwise("train")


@register("load_tree_table", _TREES_SQL + f"""
SELECT CAST(e.id AS VARCHAR) AS uid, e.y AS label, t.tree, {_PHASE} AS split, e.y
FROM examples e JOIN trees t ON e.id = t.id""")
def q_load_tree_table(spark, sf):
    """Train / test CSV files holding a ``tree`` column → one table with
    ``split`` (a missing split would be empty)."""
    trees = MN._trees(spark, sf).withColumn("phase", _phase())
    paths = {}
    for split in ("train", "test"):
        p = FS.scratch_path(spark, f"trees_{split}")
        _write_csv(trees.filter(F.col("phase") == split).select(
            F.col("uid").cast("string").alias("uid"), F.col("y").alias("label"), "tree"), p)
        paths[split] = p
    t = FS.load_tree_table(spark, paths, "uid string, label int, tree string")
    return t.select("uid", "label", "tree", "split", "y")


_PRED_SCHEMA = "e struct<uid:string, text:string, label:int>, predicted int, tree string"


def _write_predictions(spark, sf):
    ex = X.examples(spark, sf)
    pr = X.predictions(ex).filter(F.col("run") == 1).select("id", "predicted")
    trees = MN._trees(spark, sf).select(F.col("uid").alias("id"), "tree")
    rows = (ex.join(pr, "id").join(trees, "id")
            .select(F.struct(F.col("id").cast("string").alias("uid"), "text", F.col("y").alias("label")).alias("e"),
                    "predicted", "tree", F.col("id")).withColumn("phase", _phase_id()))
    base = FS.scratch_path(spark, "predictions")
    for split, name in (("train", "toxic_train"), ("test", "toxic")):
        rows.filter(F.col("phase") == split).drop("id", "phase").write.mode("overwrite").json(
            f"{base}/predictions.{name}.end.json")
    return base


def _phase_id():
    return F.when(F.substring(F.md5(F.concat(F.lit("phase|"), F.col("id").cast("string"))), 1, 1) < "4",
                  "test").otherwise("train")


@register("load_trees_from_predictions", _TREES_SQL + X.RUNS_SQL.join([", ", ""]) + ", " + X.PREDICTIONS_SQL + f"""
SELECT CAST(e.id AS VARCHAR) AS uid, e.text AS sentence, e.y AS label, t.tree,
       CAST(p.p1 >= 0.5 AS INTEGER) AS predicted, {_PHASE} AS split
FROM examples e JOIN trees t ON e.id = t.id JOIN preds p ON p.id = e.id WHERE p.run = 1""")
def q_load_trees_from_predictions(spark, sf):
    """Prediction JSON of the train and test splits → flat rows with trees."""
    base = _write_predictions(spark, sf)
    out = FS.load_trees_from_predictions(spark, base, "toxic", _PRED_SCHEMA, multi_line=False)
    return out.select("uid", "sentence", "label", "tree", "predicted", "split")


@register("flatten_predictions", EX + X.RUNS_SQL.join([", ", ""]) + ", " + X.PREDICTIONS_SQL + """
SELECT CAST(e.id AS VARCHAR) AS uid, e.text AS sentence, e.y AS label, CAST(p.p1 >= 0.5 AS INTEGER) AS predicted
FROM examples e JOIN preds p ON p.id = e.id WHERE p.run = 1""")
def q_flatten_predictions(spark, sf):
    ex = X.examples(spark, sf)
    pr = X.predictions(ex).filter(F.col("run") == 1).select("id", "predicted")
    nested = ex.join(pr, "id").select(
        F.struct(F.col("id").cast("string").alias("uid"), "text", F.col("y").alias("label")).alias("e"), "predicted")
    return FS.flatten_predictions(nested).select("uid", "sentence", "label", "predicted")


@register("read_score_json", X.REPORT_SQL + ", " + _f1_sql("gpreds", GRID_KEYS) + """
SELECT inf_score, prune_type, CAST(prune_rate AS INTEGER) AS prune_rate, CAST(run AS INTEGER) AS run,
       round(avg(f1), 6) AS macro_f1 FROM percls GROUP BY inf_score, prune_type, prune_rate, run""")
def q_read_score_json(spark, sf):
    """F1 dictionaries ``{score: {macro: {rate: [f1 per run]}}}`` written per
    (score, type) and read back as long rows."""
    from sievekit.operators import metrics as M
    f1 = M.macro_f1(_gp(spark, sf), GRID_KEYS)
    per_rate = f1.groupBy("inf_score", "prune_type", "prune_rate").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("run", "macro_f1"))), lambda s: s["macro_f1"]).alias("f1s"))
    docs = per_rate.groupBy("inf_score", "prune_type").agg(
        F.struct(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("prune_rate").cast("string"), "f1s")))
                          .alias("macro")).alias("score")).alias("doc"))
    path = FS.scratch_path(spark, "scores_json")
    docs.select("inf_score", "prune_type", "doc.score").write.mode("overwrite").json(path)
    r = FS.read_score_json(spark, path, keys=["inf_score", "prune_type"])
    return r.withColumn("macro_f1", F.round("macro_f1", 6))


_UG_SQL = X.BASE_SQL + """, stacked AS (
  SELECT 'pvi' AS inf_score, id, y, average_pvi AS k FROM raw_scores),
sranked AS (SELECT inf_score, id, y, ROW_NUMBER() OVER (PARTITION BY inf_score, y ORDER BY k, id) AS rnk,
                   COUNT(*) OVER (PARTITION BY inf_score, y) AS n FROM stacked)"""


@register("write_split", _UG_SQL + """
SELECT id, y FROM sranked WHERE y <> 0 OR rnk <= CEIL((1 - CAST(20 AS DOUBLE) / 100) * n)""")
def q_write_split(spark, sf):
    """The undersample grid written once, partitioned by (strategy, score,
    type, rate); reading one setting prunes partitions (``PartitionFilters``)."""
    g = P.undersample_grid(averaged_exactly(spark, sf)).withColumn("strategy", F.lit("informed"))
    path = FS.scratch_path(spark, "splits")
    FS.write_split(g, path)
    r = spark.read.parquet(path)
    return r.filter((F.col("strategy") == "informed") & (F.col("inf_score") == "pvi")
                    & (F.col("prune_type") == "easy") & (F.col("prune_rate") == 20)).select("id", "y")


@register("write_split_csv", EX + "SELECT id, text, y FROM examples WHERE y = 1")
def q_write_split_csv(spark, sf):
    path = FS.scratch_path(spark, "split_csv")
    FS.write_split_csv(X.examples(spark, sf).filter(F.col("y") == 1).select("id", "text", "y"), path)
    return FS.read_labelled_csv(spark, path, "id long, text string, y int")


@register("write_scores_json", X.BASE_SQL + "SELECT id, average_pvi, average_el2n, misclassification_number FROM avg_scores")
def q_write_scores_json(spark, sf):
    path = FS.scratch_path(spark, "scores")
    FS.write_scores_json(averaged(spark, sf).select("id", "average_pvi", "average_el2n",
                                                    "misclassification_number"), path)
    return spark.read.schema("id long, average_pvi double, average_el2n double, misclassification_number long") \
        .json(path)


@register("write_tree_features", MN.GROUPS_ROOT_SQL + """
SELECT group_key, group_j, examples, round(mi, 6) AS mi, count FROM groups""")
def q_write_tree_features(spark, sf):
    path = FS.scratch_path(spark, "group_table")
    g = MN._merged(spark, sf).select("group_key", "group_j", "examples", F.round("mi", 6).alias("mi"), "count")
    FS.write_tree_features(g, path, fmt="csv")
    return FS.read_labelled_csv(spark, path, "group_key string, group_j int, examples string, mi double, count long")
