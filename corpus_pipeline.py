"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; the runner writes a stage's result as Parquet and reads it back as the
next one's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import decontaminate, language, neardup, packing, secrets
from sievekit.llm._common import stash
from sievekit.sources.tables import table

#: SQL can not say what the stages with learned models keep.
ORACLE_SQL = None

#: A document is rejected only if its language is undetermined, or its best language
#: contains less than about this share of the trigrams it would know in a new text of its own.
LEAST_SCORE = 0.2


def _carried(docs: DataFrame) -> DataFrame:
    """``text`` and, as one struct, all other columns, so that none clashes with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("carried"), F.col("text").cast("string").alias("text"))


def _restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col("text") if c == "text" else F.col(f"carried.`{c}`") for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: drops documents without letters and those no learned language explains.
    Texts are scored where they stand; the other columns, whatever their names, travel along.  Null and empty
    texts go, repeated rows fare alike, an empty table stays empty."""
    known = docs.where(F.col("lang").isNotNull())
    model = language.learn(known.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    scored = language.predict(_carried(docs), model, ["carried", "text"])
    least = F.create_map(*(F.lit(x) for name in model.names for x in (name, LEAST_SCORE * model.coverage[name]))) \
        if model.names else F.lit(None).cast("map<string,double>")
    kept = scored.where((F.col("lang_pred") != language.UND) & (F.col("score") >= least[F.col("lang_pred")]))
    return _restored(kept, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component the document of the smallest id stays, of
    rows that share it the one of least text (null ids come last).  Rows without words
    stand alone; rows of equal id and text are one.  Other columns travel as one struct."""
    found = stash(neardup.row_components(docs).select("doc_id", "row", "root").distinct(), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    least = found.where("root is not null").groupBy("root").agg(F.min(rank).alias("least"))
    first = stash(found.join(least, "root").where(rank.eqNullSafe(F.col("least"))).select("root", "row"), "first")
    tied = first.groupBy("root").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    rows_ = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("carried"), neardup.row_key(docs).alias("row"))
    # texts are compared only where rows of one component share its least id
    texts = first.join(tied.where("n > 1").select("root"), "root").join(
        rows_.select("row", F.col("carried.text").cast("string").alias("least_text")), "row")
    by_text = texts.groupBy("root").agg(F.min(F.struct("least_text", "row")).alias("m")).select("m.row")
    keep = (found.where("root is null").select("row").unionByName(tied.where("n = 1").select("row")).unionByName(by_text))
    return rows_.join(keep, "row", "left_semi").dropDuplicates(["row"]).select("carried.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark window go; rows are told
    apart by id and text, so repeated rows fare alike.  Null and empty texts stay; other columns are not read."""
    seen = decontaminate.row_hits(docs, table(spark, sf_dir, "benchmark"))
    bad = seen.where("contaminated").select("doc_id", "h").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["h"]), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span becomes ``[secret]``; no document goes.  A null text stays null, ``n_chars`` follows
    the text, other columns travel as one struct; an empty table stays empty."""
    texts = _carried(docs)
    found = secrets.find_secrets(texts, secrets.fit(texts), ["carried", "text"])
    clean = _restored(found.withColumn("text", secrets.redact(F.col("text"), F.col("found"))), docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: where each piece of each document stands.  Null and empty texts are one id long,
    repeated rows are packed as often as they occur; other columns are not read."""
    return packing.pack_documents(docs, added=packing.added_tokens())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
