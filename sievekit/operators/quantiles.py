"""Exact order statistics without a sort.

A prune rate needs the row at one rank of each class, not the rank of every
row.  ``rank_thresholds`` finds the rows at any number of ranks in two passes:

1. one aggregation gives each group's size and, per wanted rank, a bracket of
   keys around it (``percentile_approx``, whose rank error is at most one part in
   ``ACCURACY``);
2. one aggregation counts exactly what lies below each bracket, and the rows
   inside the brackets, a few parts in ``ACCURACY`` of all, are numbered.

Groups of at most ``SMALL`` rows are numbered whole instead.  Brackets hold few rows unless a key repeats without end: brackets of more than
``MAX_INSIDE`` rows are numbered by ``distributed_rank``, which spreads them
over range partitions.  Nothing else is sorted or shuffled, and a row then
learns its place from a table of (groups x ranks) thresholds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.operators.rank import MAX_BROADCAST_GROUPS, _null_safe_on, distributed_rank

#: One over the rank error of a bracket's ends.
ACCURACY = 10_000
#: Groups of at most this many rows are numbered by a window; brackets serve larger ones.
SMALL = 20_000
#: Rows of one bracket that are numbered by a window in one task.
MAX_INSIDE = 200_000


def _sized(groups: DataFrame, n: int) -> DataFrame:
    """A one-row-per-group table, broadcast if its counted size ``n`` is small."""
    return F.broadcast(groups) if n <= MAX_BROADCAST_GROUPS else groups


def rank_thresholds(df: DataFrame, by: Sequence[str], key: str, ties: Sequence[str], shares: Sequence[float],
                    rank_of: Callable[[Column, int], Column], max_inside: int = MAX_INSIDE, small: int = SMALL) -> DataFrame:
    """``(*by, n, at)``: per group its size and, for each wanted rank, the row there as a struct
    ``(key, *ties)`` (null for rank 0 and below).

    Rows are ordered by ``key`` (a double without NaN; null keys go first), then by ``ties``, which must make the
    order total.  ``rank_of(n, i)`` is the i-th wanted rank in a group of n, from 1, which lies near
    ``shares[i] * n``.  ``df`` is read twice: hand in a stored table."""
    k = len(shares)
    # twice the error of a percentile, and some ranks of the smallest group that has brackets
    slack = 2.0 / ACCURACY + 4.0 / small
    lo, hi = [max(0.0, s - slack) for s in shares], [min(1.0, s + slack) for s in shares]
    got = F.percentile_approx(_number(key), F.array(*[F.lit(p) for p in [*lo, *hi]]), F.lit(ACCURACY))
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), got.alias("_q"))
    groups = groups.select(
        *by, "n", F.array(*[rank_of(F.col("n"), i).cast("long") for i in range(k)]).alias("_rank"),
        # the ends of the whole range stay open
        *(F.when(F.lit(lo[i] > 0.0), F.get("_q", F.lit(i))).alias(f"_lo{i}") for i in range(k)),
        *(F.when(F.lit(hi[i] < 1.0), F.get("_q", F.lit(k + i))).alias(f"_hi{i}") for i in range(k))).checkpoint(eager=True)
    least, most, n_groups = groups.agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first()
    parts = []
    if least is None or least <= small:
        parts.append(_in_small(df, _sized(groups.where(F.col("n") <= small), n_groups), by, key, ties))
    if most is not None and most > small:
        parts.append(_in_brackets(df, _sized(groups.where(F.col("n") > small), n_groups), by, key, ties, k, max_inside, n_groups))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_row"))).alias("_m"))
    g, f = groups.alias("g"), found.alias("f")
    at = F.array(*[F.try_element_at(F.col("f._m"), F.lit(i)) for i in range(k)])
    out = (g.join(f, _null_safe_on(g, f, list(by)) if by else F.lit(True), "left")
           .select(*(F.col(f"g.{c}").alias(c) for c in by), F.col("g.n").alias("n"), F.col("g._rank").alias("_rank"), at.alias("at"))
           .checkpoint(eager=True))
    lost = F.exists(F.arrays_zip("_rank", "at"), lambda x: x["at"].isNull() & (x["_rank"] >= 1))
    if not out.where(lost).isEmpty():
        raise RuntimeError("a wanted rank lies outside its bracket: shares and ranks do not belong together")
    return _sized(out.drop("_rank"), n_groups)


def _number(key: str) -> Column:
    """The key as brackets see it: nulls below all values."""
    return F.coalesce(F.col(key), F.lit(float("-inf")))


def _in_small(df: DataFrame, groups: DataFrame, by: Sequence[str], key: str, ties: Sequence[str]) -> DataFrame:
    """``(*by, _i, _row)``: the wanted rows of small groups, each numbered once."""
    a, b = df.select(*by, key, *ties).alias("a"), groups.alias("b")
    rows = a.join(b, _null_safe_on(a, b, list(by)) if by else F.lit(True)).select(
        *(F.col(f"a.{c}").alias(c) for c in by), F.struct(*(F.col(f"a.{c}").alias(c) for c in (key, *ties))).alias("_row"), "b._rank")
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("_row")))
    wanted = F.filter(F.transform("_rank", lambda r, i: F.when(r == F.col("_at"), i)), lambda i: i.isNotNull())
    return rows.select(*by, F.explode(wanted).alias("_i"), "_row")


def _in_brackets(df: DataFrame, groups: DataFrame, by: Sequence[str], key: str, ties: Sequence[str], k: int,
                 max_inside: int, n_groups: int) -> DataFrame:
    """The same for groups with a bracket per rank."""
    order = F.struct(key, *ties)
    a, b = df.select(*by, key, *ties).alias("a"), groups.alias("b")
    marked = a.join(b, _null_safe_on(a, b, list(by)) if by else F.lit(True)).select(
        "a.*", "b._rank", *(F.col(f"b._{e}{i}") for e in ("lo", "hi") for i in range(k)))
    v = _number(key)
    under = [F.coalesce(v < F.col(f"_lo{i}"), F.lit(False)) for i in range(k)]
    over = [F.coalesce(v > F.col(f"_hi{i}"), F.lit(False)) for i in range(k)]
    inside = [~under[i] & ~over[i] for i in range(k)]
    below = marked.groupBy(*by).agg(F.array(*[F.count_if(u) for u in under]).alias("_below"),
                                    F.array(*[F.count_if(x) for x in inside]).alias("_inside")).checkpoint(eager=True)
    few = (below.agg(F.max(F.array_max("_inside"))).first()[0] or 0) <= max_inside
    hit = F.filter(F.array(*[F.when(inside[i], F.lit(i)) for i in range(k)]), lambda x: x.isNotNull())
    rows = marked.select(*by, "_rank", order.alias("_row"), F.explode(hit).alias("_i"))
    if few:
        rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_i").orderBy("_row")))
    else:
        rows = distributed_rank(rows, ["_row"], [*by, "_i"], rank_col="_at")
    r, w = rows.alias("r"), _sized(below, n_groups).alias("w")
    rows = r.join(w, _null_safe_on(r, w, list(by)) if by else F.lit(True)).where(
        F.col("r._at") + F.get("w._below", F.col("r._i")) == F.get("r._rank", F.col("r._i")))
    return rows.select(*(F.col(f"r.{c}").alias(c) for c in by), F.col("r._i").alias("_i"), F.col("r._row").alias("_row"))


def with_thresholds(df: DataFrame, thresholds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with their group's ``n`` and ``at``."""
    d, t = df.alias("d"), thresholds.alias("t")
    return d.join(t, _null_safe_on(d, t, list(by)) if by else F.lit(True)).select("d.*", "t.n", "t.at")


def up_to(order: Column, at: Column, i: int | Column) -> Column:
    """True for rows at or below the i-th threshold."""
    t = F.get(at, F.lit(i) if isinstance(i, int) else i)
    return t.isNotNull() & (order <= t)
