"""Exact ranks, exact samples and splits without a per-group single task.

``Window.partitionBy(label).orderBy(score)`` puts a whole class into one task;
with two classes over 100 TB that is two tasks.  ``distributed_rank`` gives the
same ``row_number`` with work spread over all range partitions:

1. ``repartitionByRange(group, order…)`` + ``sortWithinPartitions`` — one
   shuffle; a hot class is split over many partitions by its score range.
2. ``monotonically_increasing_id`` then encodes (partition, position).  The
   result is written with a reliable ``checkpoint()`` so these ids never change
   when an executor is lost and a stage is recomputed.
3. Row counts per partition (≤ #partitions rows, a proven bound) → running sum
   → broadcast offsets → global position.
4. Rank inside a group = global position − first position of the group
   (one small aggregate over groups).

The order key must be total (end it with a unique id), which is also the tie
rule of every operator that uses it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions._util import col
from sievekit.session import ensure_checkpoint_dir

_POS_MASK = (1 << 33) - 1


def _null_safe_on(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = None
    for n in names:
        c = left[n].eqNullSafe(right[n])
        cond = c if cond is None else cond & c
    return cond


#: Groups whose starts or sizes are broadcast once counted; more of them meet in a shuffle join.
MAX_BROADCAST_GROUPS = 100_000


def _broadcast_if_few(groups: DataFrame) -> DataFrame:
    """A one-row-per-group table, broadcast if it is counted small: the ranked rows then
    stay where they are instead of meeting in one task per group."""
    few = groups.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
    return F.broadcast(groups) if few else groups


def distributed_rank(df: DataFrame, order: Sequence, by: Sequence[str] = (),
                     rank_col: str = "rank", partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY by ORDER BY order)`` as a bigint column.

    ``order`` holds names or sort Columns (``F.col(x).desc()``); it must make
    the order total.  Null group keys form their own group.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [*(col(b) for b in by), *(col(o) for o in order)]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged = (ranged.sortWithinPartitions(*keys)
              .withColumn("_sk_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    ranged = (ranged.withColumn("_sk_pid", F.shiftright("_sk_mid", 33))
              .withColumn("_sk_pos", F.col("_sk_mid").bitwiseAND(F.lit(_POS_MASK))))
    offsets = (ranged.groupBy("_sk_pid").agg(F.count(F.lit(1)).alias("_sk_n"))
               .select("_sk_pid", (F.sum("_sk_n").over(Window.orderBy("_sk_pid"))
                                   - F.col("_sk_n")).alias("_sk_off")))
    # offsets: one row per partition — bounded by the partition count.
    out = (ranged.join(F.broadcast(offsets), "_sk_pid")
           .withColumn("_sk_g", F.col("_sk_off") + F.col("_sk_pos")))
    if by:
        starts = out.groupBy(*by).agg(F.min("_sk_g").alias("_sk_start"))
        s = _broadcast_if_few(starts).alias("_sk_s")
        o = out.alias("_sk_o")
        joined = o.join(s, _null_safe_on(o, s, list(by)), "inner")
        out = joined.select("_sk_o.*", F.col("_sk_s._sk_start"))
        rank = F.col("_sk_g") - F.col("_sk_start") + 1
    else:
        rank = F.col("_sk_g") + 1
    return (out.withColumn(rank_col, rank.cast("long"))
            .drop("_sk_mid", "_sk_pid", "_sk_pos", "_sk_off", "_sk_g", "_sk_start"))


def hash_key(seed, id_col) -> Column:
    """Reproducible pseudo-random order key ``md5(seed || '|' || id)``.

    md5 gives the same bytes in Spark and in any SQL engine, so a sample drawn
    with it has an exact oracle (``rand()`` and ``shuffle`` do not).
    """
    return F.md5(F.concat(col(seed).cast("string"), F.lit("|"), col(id_col).cast("string")))


def with_group_sizes(df: DataFrame, by: Sequence[str], name: str = "n_group") -> DataFrame:
    """Attach the row count of each group (partial aggregate, broadcast back if few)."""
    if not by:
        n = df.agg(F.count(F.lit(1)).alias(name))
        return df.crossJoin(F.broadcast(n))  # one row
    o = df.alias("_sk_o")
    s = _broadcast_if_few(df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))).alias("_sk_s")
    # null-safe: rows whose group is NULL are a group like any other
    return o.join(s, _null_safe_on(o, s, list(by)), "inner").select("_sk_o.*", F.col(f"_sk_s.{name}"))


def sample_fraction_exact(df: DataFrame, frac: float, seed: int, id_col: str = "id",
                          by: Sequence[str] = ()) -> DataFrame:
    """Exactly ``bround(frac * N)`` rows without replacement (per group when
    ``by`` is given), chosen by the md5 order of ``seed|id``.

    ``DataFrame.sample`` is Bernoulli and gives a random count; this keeps the
    count of the reference's ``df.sample(frac=…, random_state=…)``.
    """
    keyed = df.withColumn("_sk_h", hash_key(F.lit(str(seed)), id_col))
    ranked = distributed_rank(keyed, ["_sk_h", id_col], by, rank_col="_sk_r")
    sized = with_group_sizes(ranked, by, "_sk_n")
    return (sized.filter(F.col("_sk_r") <= F.bround(F.lit(float(frac)) * F.col("_sk_n"), 0))
            .drop("_sk_h", "_sk_r", "_sk_n"))


def sample_n(df: DataFrame, n: int, seed: int = 13, id_col: str = "id") -> DataFrame:
    """At most ``n`` rows, chosen by the md5 order of ``seed|id``."""
    keyed = df.withColumn("_sk_h", hash_key(F.lit(str(seed)), id_col))
    ranked = distributed_rank(keyed, ["_sk_h", id_col], rank_col="_sk_r")
    return ranked.filter(F.col("_sk_r") <= n).drop("_sk_h", "_sk_r")


def random_halves(df: DataFrame, seed: int = 13, id_col: str = "id") -> DataFrame:
    """Tag rows with ``half`` 0/1: the first ``floor(N/2)`` rows of the md5
    order form half 0."""
    keyed = df.withColumn("_sk_h", hash_key(F.lit(str(seed)), id_col))
    ranked = with_group_sizes(distributed_rank(keyed, ["_sk_h", id_col], rank_col="_sk_r"), (), "_sk_n")
    half = F.when(F.col("_sk_r") <= F.floor(F.col("_sk_n") / 2), 0).otherwise(1)
    return ranked.withColumn("half", half.cast("int")).drop("_sk_h", "_sk_r", "_sk_n")


def stratified_split(df: DataFrame, label_col: str, test_size: float = 0.2, seed: int = 42,
                     id_col: str = "id") -> DataFrame:
    """Tag rows ``split`` = train/test keeping class proportions.

    Test size is ``ceil(test_size * N)``; class quotas are ``floor(test_size *
    n_y)`` plus one for the classes with the largest remainders (ties: lower
    label) until the total is reached.  Inside a class the md5 order of
    ``seed|id`` picks the rows.
    """
    keyed = df.withColumn("_sk_h", hash_key(F.lit(str(seed)), id_col))
    ranked = distributed_rank(keyed, ["_sk_h", id_col], [label_col], rank_col="_sk_r")
    classes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_sk_ny"))
    total_test = F.ceil(F.lit(float(test_size)) * F.sum("_sk_ny").over(Window.partitionBy()))
    quota = (classes
             .withColumn("_sk_exact", F.lit(float(test_size)) * F.col("_sk_ny"))
             .withColumn("_sk_base", F.floor("_sk_exact"))
             .withColumn("_sk_rem", F.col("_sk_exact") - F.col("_sk_base"))
             .withColumn("_sk_short", total_test - F.sum("_sk_base").over(Window.partitionBy()))
             .withColumn("_sk_pos", F.row_number().over(
                 Window.orderBy(F.col("_sk_rem").desc(), F.col(label_col))))
             .withColumn("_sk_quota", F.col("_sk_base")
                         + F.when(F.col("_sk_pos") <= F.col("_sk_short"), 1).otherwise(0))
             .select(label_col, "_sk_quota"))
    # one row per class: bounded by the label cardinality
    r, q = ranked.alias("_sk_o"), F.broadcast(quota).alias("_sk_s")
    out = r.join(q, _null_safe_on(r, q, [label_col]), "inner").select("_sk_o.*", "_sk_s._sk_quota")
    split = F.when(F.col("_sk_r") <= F.col("_sk_quota"), "test").otherwise("train")
    return out.withColumn("split", split).drop("_sk_h", "_sk_r", "_sk_quota")
