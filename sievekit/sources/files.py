"""Readers and writers for the reference's file formats.

Schemas are always given (never inferred).  Texts hold quotes, commas and
newlines, so CSV goes through ``quoted``, which splits files all the same.  Row-position
ids (the reference's ``uid = row number`` when a file has no uid column) follow
the order of file paths, then places in a file, however Spark deals out the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.operators.rank import distributed_rank
from sievekit.sources.quoted import read_quoted

SPLIT_PARTITIONS = ("strategy", "inf_score", "prune_type", "prune_rate")


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType | str, uid_col: str | None = None) -> DataFrame:
    """Comma CSV with header; quoted fields may span lines, and a file is read by as many tasks as it has splits."""
    return read_quoted(spark, path, schema, uid_col=uid_col)


def read_labelled_tsv(spark: SparkSession, path: str, schema: T.StructType | str,
                      header: bool = True, uid_col: str | None = None) -> DataFrame:
    """Tab-separated file, with or without a header (``schema`` names the
    columns of header-less files)."""
    return read_quoted(spark, path, schema, "\t", header, uid_col)


def with_row_uid(df: DataFrame, uid_col: str = "uid") -> DataFrame:
    """Add ``uid`` = row position (string, from 0) when the file has none.

    Rows of a file scan, and of a table as the CSV readers return it, count by path, place of the split and row; others
    in the order of their partitions.  The rank is exact and made by Spark's range sort."""
    if uid_col in df.columns:
        return df.withColumn(uid_col, F.col(uid_col).cast("string"))
    if hasattr(df, "_with_places"):
        return df._with_places(uid_col)
    keys = {"_sk_row": F.monotonically_increasing_id()}
    try:
        at = {"_sk_file": F.col("_metadata.file_path"), "_sk_block": F.col("_metadata.file_block_start")}
        placed = df.select("*", *(c.alias(k) for k, c in {**at, **keys}.items()))
        order = [*at, *keys]
    except AnalysisException:  # not a file scan
        placed, order = df.select("*", keys["_sk_row"].alias("_sk_row")), [*keys]
    ranked = distributed_rank(placed, order, rank_col="_sk_rank")
    return ranked.select(*df.columns, (F.col("_sk_rank") - 1).cast("string").alias(uid_col))


def load_examples(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows → examples: ``uid`` (given or row position); pair files
    (``sentence1``/``sentence2``) become nested ``a``/``b`` structs sharing the
    uid, single-text files keep ``text``; optional ``label``, ``sexist``,
    ``label_name`` pass through; ``review_id`` goes to ``details.original_uid``."""
    df = with_row_uid(df)
    cols = [F.col("uid")]
    if "sentence1" in df.columns:
        cols += [F.struct(F.col("sentence1").alias("text"), F.col("uid")).alias("a"),
                 F.struct(F.col("sentence2").alias("text"), F.col("uid")).alias("b")]
    else:
        cols.append(F.col(text_col).alias("text"))
    for c in ("label", "sexist", "label_name"):
        if c in df.columns:
            cols.append(F.col(c))
    if "review_id" in df.columns:
        cols.append(F.struct(F.col("review_id").cast("string").alias("original_uid")).alias("details"))
    return df.select(*cols)


def load_examples_json(spark: SparkSession, path: str, schema: T.StructType | str,
                       multi_line: bool = True, remove_br: bool = True) -> DataFrame:
    """JSON examples (a top-level array with ``multi_line``, else JSON lines).
    Texts that start with ``<br`` lose ``<br />`` / ``<br / >``; missing uids
    become the row position (also inside ``a``/``b``); blank single texts are
    dropped."""
    df = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    pos_col = "_pos"
    if "uid" in df.columns and df.where(F.col("uid").isNull()).isEmpty():
        out = df.withColumn("uid", F.col("uid").cast("string"))
    else:
        uid = F.coalesce(F.col("uid").cast("string"), F.col(pos_col)) if "uid" in df.columns else F.col(pos_col)
        out = with_row_uid(df, pos_col).withColumn("uid", uid)
    if "text" in df.columns:
        t = F.col("text")
        cleaned = F.when(t.startswith("<br"), F.replace(F.replace(t, F.lit("<br />"), F.lit("")),
                                                        F.lit("<br / >"), F.lit(""))).otherwise(t)
        out = out.withColumn("text", cleaned if remove_br else t)
        out = out.filter(F.trim(F.col("text")) != "")
    for side in ("a", "b"):
        if side in df.columns:
            s = F.col(side)
            out = out.withColumn(side, F.struct(s["text"].alias("text"),
                                                F.coalesce(s["uid"].cast("string"), F.col("uid")).alias("uid")))
    return out.drop(pos_col)


def load_tree_table(spark: SparkSession, paths: dict[str, str], schema: T.StructType | str,
                    sep: str = ",") -> DataFrame:
    """Split files holding a ``tree`` column → one table with a ``split``
    column; ``uid`` as string, ``y`` = label.  A missing split is empty."""
    out = None
    for split, path in paths.items():
        try:
            df = read_quoted(spark, path, schema, sep)
        except AnalysisException:
            continue
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], schema).withColumn("split", F.lit(None).cast("string"))
    if "uid" in out.columns:
        out = out.withColumn("uid", F.col("uid").cast("string"))
    if "label" in out.columns:
        out = out.withColumn("y", F.col("label"))
    return out


def flatten_predictions(preds: DataFrame) -> DataFrame:
    """Nested prediction rows ``{e: {uid, text | a, b, label | sexist,
    details}, tree, …}`` → flat columns ``uid, sentence | sentence1,
    sentence2, label, review_id, tree``; the label comes from ``sexist`` when
    present."""
    e = preds.schema["e"].dataType
    names = {f.name for f in e.fields}
    cols = [F.col("e.uid").cast("string").alias("uid")]
    if "a" in names:
        cols += [F.col("e.a.text").alias("sentence1"), F.col("e.b.text").alias("sentence2")]
    else:
        cols.append(F.col("e.text").alias("sentence"))
    lab = F.col("e.sexist").cast("int") if "sexist" in names else F.col("e.label")
    cols.append(lab.alias("label"))
    if "details" in names:
        cols.append(F.col("e.details.original_uid").cast("string").alias("review_id"))
    for c in ("tree", "predicted", "loss"):
        if c in preds.columns:
            cols.append(F.col(c))
    return preds.select(*cols)


def load_trees_from_predictions(spark: SparkSession, output_dir: str, dataset: str,
                                schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """``predictions.{dataset}_train.end.json`` (train) and
    ``predictions.{dataset}.end.json`` (test), flattened, with ``split``; a file holds one
    JSON array (``multi_line``) or a row per line."""
    out = None
    for split, name in (("train", f"{dataset}_train"), ("test", dataset)):
        try:
            df = spark.read.schema(schema).option("multiLine", multi_line).json(
                f"{output_dir.rstrip('/')}/predictions.{name}.end.json")
            df.schema  # noqa: B018
        except AnalysisException:
            continue
        f = flatten_predictions(df).withColumn("split", F.lit(split))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


SCORE_JSON_SCHEMA = "score struct<macro: map<string, array<double>>>"


def read_score_json(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """F1 files ``{score: {macro: {"<rate>": [f1 per run]}}}`` → long rows
    ``(…keys, prune_rate, run, macro_f1)`` (run = list position + 1)."""
    schema = ", ".join([f"{k} string" for k in keys] + [SCORE_JSON_SCHEMA])
    df = spark.read.schema(schema).json(path)
    m = df.select(*keys, F.explode("score.macro").alias("rate", "f1s"))
    return m.select(*keys, F.col("rate").cast("int").alias("prune_rate"),
                    F.posexplode("f1s").alias("pos", "macro_f1")).select(
        *keys, "prune_rate", (F.col("pos") + 1).cast("int").alias("run"), "macro_f1")


def read_embeddings(spark: SparkSession, path: str, id_col: str = "vec_id") -> DataFrame:
    """``(id, embedding array<float>)`` parquet."""
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), "embedding")


def write_split(df: DataFrame, path: str, partition_cols: Sequence[str] = SPLIT_PARTITIONS,
                mode: str = "overwrite") -> None:
    """Pruned splits as one parquet table partitioned by the grid columns:
    later reads of one setting prune partitions instead of listing files."""
    df.write.mode(mode).partitionBy(*partition_cols).parquet(path)


def write_split_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, one directory per split (``{name}_train``, ``{name}_test``)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_scores_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long score rows as JSON lines."""
    df.write.mode(mode).json(path)


def write_tree_features(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Feature / group tables as parquet (or CSV with a header)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint directory (shared storage
    on a cluster) for written intermediate tables."""
    import uuid
    from sievekit.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
