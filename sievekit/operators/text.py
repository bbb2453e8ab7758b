"""DataFrame-level text operators: label codes, null inputs, lexicon joins,
emoji aliases, token views of examples and pairs."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.functions import text as TX
from sievekit.operators.lookup import lookup
from sievekit.operators.rank import _broadcast_if_few, distributed_rank

NULL_INPUT = " "  # the reference's empty input: one blank, not ""


def _coded(df: DataFrame, codes: DataFrame, label_col: str, out_col: str) -> DataFrame:
    """Rows with their label's code (one row per label, broadcast if counted small); rows without a label go."""
    return df.join(_broadcast_if_few(codes.select(label_col, (F.col("_rank") - 1).cast("int").alias(out_col))), label_col)


def encode_labels_sorted(df: DataFrame, label_col: str, out_col: str = "numeric_labels") -> DataFrame:
    """Label → code in sorted label order (``LabelBinarizer`` for two classes)."""
    labels = df.select(label_col).where(F.col(label_col).isNotNull()).distinct()
    return _coded(df, distributed_rank(labels, [label_col], rank_col="_rank"), label_col, out_col)


def encode_labels_by_appearance(df: DataFrame, label_col: str, order_col: str,
                                out_col: str = "numeric_labels") -> DataFrame:
    """Label → code by order of first appearance (``order_col`` fixes the order)."""
    first = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.min(order_col).alias("_first"))
    return _coded(df, distributed_rank(first, ["_first", label_col], rank_col="_rank"), label_col, out_col)


def null_input(df: DataFrame, text_col: str = "text", name: str | None = None) -> DataFrame:
    """Replace (or add as ``name``) the text with the null input ``" "``."""
    return df.withColumn(name or text_col, F.lit(NULL_INPUT))


def filter_unlabelled(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.filter(F.col(label_col) != -1)


def sentiment_polarity(df: DataFrame, text_col: str, lexicon: DataFrame, id_col: str = "id",
                       word_col: str = "word", polarity_col: str = "polarity") -> DataFrame:
    """Mean lexicon polarity of a row's tokens (0 when no token is in the
    lexicon) and its band.  Tokens are looked up where their row stands; the lexicon may be of any size, its words
    must differ."""
    found = lookup(df, TX.tokens_basic(text_col), lexicon.select(word_col, F.col(polarity_col).cast("double").alias(polarity_col)),
                   word_col, polarity_col, "_known")
    known = F.filter("_known", lambda p: p.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, p: a + p) / F.nullif(F.size(known), F.lit(0))
    out = found.withColumn("polarity", F.coalesce(mean, F.lit(0.0))).drop("_known")
    return out.withColumn("sentiment", TX.sentiment_label("polarity"))


def demojize(df: DataFrame, text_col: str, aliases: DataFrame, out_col: str | None = None,
             max_entries: int = 100_000) -> DataFrame:
    """Replace each emoji by ``:alias:`` from a user table ``(emoji, alias)``.

    The alias table is checked to be at most ``max_entries`` rows before it is
    shipped to the executors; the replacement runs as an Arrow-batched pandas
    UDF with one compiled alternation (longest emoji first)."""
    n = aliases.count()
    if n > max_entries:
        raise ValueError(f"alias table has {n} rows > max_entries={max_entries}")
    pairs = {r["emoji"]: r["alias"] for r in aliases.select("emoji", "alias").collect()}
    keys = sorted(pairs, key=len, reverse=True)
    pattern = re.compile("|".join(re.escape(k) for k in keys)) if keys else None

    @F.pandas_udf(T.StringType())
    def _sub(s: pd.Series) -> pd.Series:
        if pattern is None:
            return s
        return s.map(lambda x: x if x is None else pattern.sub(lambda m: f":{pairs[m.group(0)]}:", x))

    return df.withColumn(out_col or text_col, _sub(F.col(text_col)))


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Consecutive turns of one conversation (turn t user, t+1 assistant) as a
    sentence pair ``(uid, premise, hypothesis)`` — an equi-join on
    ``(conv_id, turn + 1)``."""
    a = conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("premise"))
    b = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return (a.join(b, ["conv_id", "turn"])
            .select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uid"),
                    "conv_id", "turn", "premise", "hypothesis"))


def add_tokens(df: DataFrame, cols: Sequence[str], suffix: str = "_tokens") -> DataFrame:
    """Token arrays for each text column (NULL text → empty list)."""
    for c in cols:
        df = df.withColumn(c + suffix, TX.tokens_basic(c))
    return df


def length_filter(df: DataFrame, length_col: str, min_length: int | None, max_length: int | None) -> DataFrame:
    cond = F.lit(True)
    if min_length is not None:
        cond = cond & (F.col(length_col) >= min_length)
    if max_length is not None:
        cond = cond & (F.col(length_col) <= max_length)
    return df.filter(cond)
