"""Score-driven pruning: informed undersampling, proportional, random, grids.

Every class is ordered **hardest first** — PVI ascending, EL2N descending — with
``id`` as the tie-break (pandas' sort is unstable on ties; this is the fixed
rule).  ``keep(q) = ceil((1 - q/100) * n_class)`` computed in doubles, as the
reference does.

* ``easy`` pruning removes the easiest rows: keep ranks ``1..keep``.
* ``hard`` pruning removes the hardest rows: keep the last ``keep`` ranks.
  ``drop_last=True`` reproduces the reference's ``iloc[-k:-1]``, which also
  drops the very last (easiest) row (defect D1); default False.

Kept sets are nested across rates, so a grid of rates is one number a row: the
largest rate that keeps it (``kept_rates``).  It comes from the rows at the exact
ranks where each rate cuts a class, found without a sort (``quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.operators.quantiles import rank_thresholds, up_to, with_thresholds
from sievekit.operators.rank import distributed_rank, hash_key, with_group_sizes

PRUNE_RATES = (5, 10, 15, 20, 25, 30, 35, 40, 50, 60)
RANDOM_SEEDS = (12, 42, 72, 123, 250)  # run 1..5, fixed values of the reference
HARDEST_FIRST = {"pvi": "asc", "el2n": "desc", "vog": "desc"}


def keep_count(rate, n) -> Column:
    """``ceil((1 - q/100) * n)`` in doubles (``q`` in percent)."""
    q = rate if isinstance(rate, Column) else F.lit(rate)
    nn = F.col(n) if isinstance(n, str) else n
    return F.ceil((F.lit(1.0) - q.cast("double") / F.lit(100.0)) * nn).cast("long")


def _hardness_key(score_col: str, direction: str) -> Column:
    c = F.col(score_col).cast("double")
    return c if direction == "asc" else -c


def rank_by_score(df: DataFrame, score_col: str, direction: str | None = None,
                  label_col: str = "y", id_col: str = "id", rank_col: str = "rank") -> DataFrame:
    """Rank inside each class, hardest first (``direction`` defaults from the
    score name: ``average_pvi`` ascending, ``average_el2n`` descending).
    Adds ``rank`` and ``n_class``."""
    direction = direction or HARDEST_FIRST.get(score_col.replace("average_", ""), "asc")
    keyed = df.withColumn("_pk", _hardness_key(score_col, direction))
    ranked = distributed_rank(keyed, ["_pk", id_col], [label_col], rank_col=rank_col)
    return with_group_sizes(ranked, [label_col], "n_class").drop("_pk")


def _stacked_scores(df: DataFrame, scores: Sequence[str], label_col: str, id_col: str) -> DataFrame:
    """One row per (example, score) with a common hardness key, so one ranking
    serves every score."""
    parts = []
    for s in scores:
        name = s.replace("average_", "")
        direction = HARDEST_FIRST.get(name, "asc")
        parts.append(df.select(F.lit(name).alias("inf_score"), id_col, label_col,
                               _hardness_key(s, direction).alias("_pk")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _kept_rank(prune_type: str, q: float, n: Column) -> Column:
    """The rank that parts kept from dropped rows: the last kept one (``easy``), or the last dropped one."""
    k = keep_count(F.lit(float(q)), n)
    return k if prune_type == "easy" else n - k


def _share(prune_type: str, q: float) -> float:
    return 1.0 - q / 100.0 if prune_type == "easy" else q / 100.0


def _kept(prune_type: str, order: Column, at: Column, i: int, last: Column | None) -> Column:
    """Whether a row stays, given the threshold at place ``i``; ``last`` is the easiest row of the class, which goes
    too when the reference's slice is reproduced."""
    inside = up_to(order, at, i)
    if prune_type == "easy":
        return inside
    return ~inside if last is None else ~inside & (order < last)


def undersample(df: DataFrame, score_col: str = "average_pvi", rate: float = 20,
                prune_type: str = "easy", prune_label: int = 0, label_col: str = "y",
                id_col: str = "id", drop_last: bool = False) -> DataFrame:
    """Informed undersampling: prune ``prune_label`` (the majority class) by
    score, keep every other class whole.  Returns the kept rows of ``df``, each class cut at the row of one
    exact rank (``rank_thresholds``)."""
    keyed = _keyed(df, score_col).checkpoint(eager=True)
    wanted = [(prune_type, rate), ("easy", 0)]
    t = rank_thresholds(keyed, [label_col], "_pk", [id_col], [_share(*w) for w in wanted],
                        lambda n, i: _kept_rank(*wanted[i], n))
    rows = with_thresholds(keyed, t, [label_col])
    order, last = F.struct("_pk", id_col), F.get("at", F.lit(1)) if drop_last else None
    keep = _kept(prune_type, order, F.col("at"), 0, last)
    return rows.filter((F.col(label_col) != F.lit(prune_label)) | keep).select(*df.columns)


def _keyed(df: DataFrame, score_col: str) -> DataFrame:
    name = score_col.replace("average_", "")
    return df.withColumn("_pk", _hardness_key(score_col, HARDEST_FIRST.get(name, "asc")))


def _largest(kept: Sequence[Column], rates: Sequence[float]) -> Column:
    """The largest of ``rates`` (rising) at which a row is kept: kept sets are nested, so this says all; null if
    the row goes at every rate."""
    return F.array_max(F.array(*[F.when(k, F.lit(int(r))) for k, r in zip(kept, rates)]))


def kept_rates(df: DataFrame, scores: Sequence[str] = ("average_pvi", "average_el2n"),
               types: Sequence[str] = ("easy", "hard"), rates: Sequence[float] = PRUNE_RATES,
               label_col: str = "y", id_col: str = "id", drop_last: bool = False, halve: bool = False) -> DataFrame:
    """One row per (score, example): ``inf_score, id, y`` and, per type, ``kept_<type>``: the largest rate at which
    pruning its class by this score keeps the row (null: none).  A split of any rate is a filter on it, so a grid of
    rates is stored once instead of once a rate."""
    rates = sorted(rates)
    wanted = [(t, q / 2.0 if halve else q) for t in types for q in rates] + [("easy", 0)]
    stacked = _stacked_scores(df, scores, label_col, id_col).checkpoint(eager=True)
    by = ["inf_score", label_col]
    t = rank_thresholds(stacked, by, "_pk", [id_col], [_share(*w) for w in wanted], lambda n, i: _kept_rank(*wanted[i], n))
    rows = with_thresholds(stacked, t, by)
    order, last = F.struct("_pk", id_col), F.get("at", F.lit(len(wanted) - 1)) if drop_last else None
    n = len(rates)
    return rows.select("inf_score", id_col, label_col, *(
        _largest([_kept(kind, order, F.col("at"), j * n + i, last) for i in range(n)], rates).alias(f"kept_{kind}")
        for j, kind in enumerate(types)))


def undersample_grid(df: DataFrame, scores: Sequence[str] = ("average_pvi", "average_el2n"),
                     types: Sequence[str] = ("easy", "hard"), rates: Sequence[float] = PRUNE_RATES,
                     prune_label: int = 0, label_col: str = "y", id_col: str = "id",
                     drop_last: bool = False) -> DataFrame:
    """All (score × type × rate) undersampled splits as one long table
    ``(inf_score, prune_type, prune_rate, id, y)``, spread out of ``kept_rates``."""
    kept = kept_rates(df, scores, types, rates, label_col, id_col, drop_last)
    rows = kept.select("inf_score", id_col, label_col, F.explode(F.array(*[
        F.struct(F.lit(t).alias("prune_type"), F.col(f"kept_{t}").alias("most")) for t in types])).alias("k"))
    stays = (F.col(label_col) != F.lit(prune_label))
    at = F.filter(F.array(*[F.lit(int(r)) for r in rates]), lambda r: stays | (r <= F.col("k.most")))
    return rows.select("inf_score", "k.prune_type", F.explode(at).alias("prune_rate"), id_col, label_col)


def proportional_grid(df: DataFrame, scores: Sequence[str] = ("average_pvi", "average_el2n"),
                      types: Sequence[str] = ("easy", "hard"), rates: Sequence[float] = PRUNE_RATES,
                      positive_label: int = 1, label_col: str = "y", id_col: str = "id",
                      halve: bool = True, drop_last: bool = False) -> DataFrame:
    """Proportional pruning: each class is pruned at ``q/2`` percent
    (``halve=True``, the reference's meaning) with its own type; grid over
    (score, type of positive class, type of the other class, rate).  Output
    ``(inf_score, type_pos, type_neg, prune_rate, id, y)``.  Each score uses its
    own order (the reference fed the PVI order to both, defect D3)."""
    kept = kept_rates(df, scores, types, rates, label_col, id_col, drop_last, halve)
    positive = F.col(label_col) == F.lit(positive_label)
    pairs = [F.struct(F.lit(p).alias("type_pos"), F.lit(m).alias("type_neg"),
                      F.when(positive, F.col(f"kept_{p}")).otherwise(F.col(f"kept_{m}")).alias("most"))
             for p in types for m in types]
    rows = kept.select("inf_score", id_col, label_col, F.explode(F.array(*pairs)).alias("k"))
    at = F.filter(F.array(*[F.lit(int(r)) for r in rates]), lambda r: r <= F.col("k.most"))
    return rows.select("inf_score", "k.type_pos", "k.type_neg", F.explode(at).alias("prune_rate"), id_col, label_col)


def random_kept_rates(df: DataFrame, rates: Sequence[float] = PRUNE_RATES, seeds: Sequence[int] = RANDOM_SEEDS,
                      id_col: str = "id", label_col: str = "y") -> DataFrame:
    """``run, seed, id, y, kept``: per seed (run = position) the largest rate at which an exact
    ``bround((1-q/100)·N)``-row sample in md5 order of ``seed|id`` keeps the row (null: none)."""
    rates = sorted(rates)
    runs = F.array(*[F.struct(F.lit(i + 1).alias("run"), F.lit(int(s)).alias("seed")) for i, s in enumerate(seeds)])
    keyed = df.select(id_col, label_col, F.explode(runs).alias("r")).select(id_col, label_col, "r.run", "r.seed")
    keyed = keyed.withColumn("_h", hash_key(F.col("seed"), id_col))
    # the first 52 bits of the digest as a double order like the digest, ties but for the rest of it
    keyed = keyed.withColumn("_pk", F.conv(F.substring("_h", 1, 13), 16, 10).cast("double")).checkpoint(eager=True)

    def rank(n: Column, i: int) -> Column:
        return F.bround((F.lit(1.0) - F.lit(float(rates[i])) / F.lit(100.0)) * n, 0)
    t = rank_thresholds(keyed, ["run"], "_pk", ["_h", id_col], [1.0 - q / 100.0 for q in rates], rank)
    rows = with_thresholds(keyed, t, ["run"])
    order = F.struct("_pk", "_h", id_col)
    kept = _largest([up_to(order, F.col("at"), i) for i in range(len(rates))], rates)
    return rows.select("run", "seed", id_col, label_col, kept.alias("kept"))


def random_prune_grid(df: DataFrame, rates: Sequence[float] = PRUNE_RATES,
                      seeds: Sequence[int] = RANDOM_SEEDS, id_col: str = "id",
                      label_col: str = "y") -> DataFrame:
    """Random pruning: for each seed (run = position 1..5) an exact
    ``bround((1-q/100)·N)``-row sample without replacement, spread out of ``random_kept_rates``.  Output
    ``(run, seed, prune_rate, id, y)``."""
    rows = random_kept_rates(df, rates, seeds, id_col, label_col)
    at = F.filter(F.array(*[F.lit(int(r)) for r in rates]), lambda r: r <= F.col("kept"))
    return rows.select("run", "seed", F.explode(at).alias("prune_rate"), id_col, label_col)


def prune_ratio(splits: DataFrame, keys: Sequence[str], label_col: str = "y",
                positive_label: int = 1) -> DataFrame:
    """Class-1 / class-0 count ratio per split (``keys`` name the split)."""
    pos = F.sum(F.when(F.col(label_col) == positive_label, 1).otherwise(0))
    neg = F.sum(F.when(F.col(label_col) != positive_label, 1).otherwise(0))
    return (splits.groupBy(*keys)
            .agg(pos.cast("long").alias("n_pos"), neg.cast("long").alias("n_neg"))
            .withColumn("ratio", F.round(F.try_divide(F.col("n_pos").cast("double"),
                                                      F.col("n_neg").cast("double")), 6)))


def topk_examples(df: DataFrame, score_col: str, k: int = 10, label_col: str = "y",
                  id_col: str = "id") -> DataFrame:
    """The ``k`` hardest and ``k`` easiest rows per class.  Bounded per-class
    top-k: Spark plans ``WindowGroupLimit`` (partial top-k before the shuffle),
    so a class is never gathered whole."""
    from pyspark.sql import Window
    name = score_col.replace("average_", "")
    key = _hardness_key(score_col, HARDEST_FIRST.get(name, "asc"))
    hard_w = Window.partitionBy(label_col).orderBy(key.asc(), F.col(id_col).asc())
    easy_w = Window.partitionBy(label_col).orderBy(key.desc(), F.col(id_col).desc())
    hard = (df.withColumn("pos", F.row_number().over(hard_w)).filter(F.col("pos") <= k)
            .withColumn("end", F.lit("hard")))
    easy = (df.withColumn("pos", F.row_number().over(easy_w)).filter(F.col("pos") <= k)
            .withColumn("end", F.lit("easy")))
    return hard.unionByName(easy)


def easy_hard_pools(df: DataFrame, score_col: str = "average_pvi", share: float = 60,
                    labels: Sequence[int] | None = (0,), label_col: str = "y",
                    id_col: str = "id", drop_last: bool = True) -> DataFrame:
    """Flag rows of the given classes: ``in_hard_pool`` = first
    ``ceil(share% · n)`` ranks, ``in_easy_pool`` = last ``ceil(share% · n)``
    ranks, minus the very last when ``drop_last`` (the reference's slice).  The
    pools overlap when share > 50.  ``labels=None`` means every class (30 % in
    the proportional analysis)."""
    ranked = rank_by_score(df, score_col, label_col=label_col, id_col=id_col, rank_col="_r")
    k = F.ceil(F.lit(share / 100.0) * F.col("n_class"))
    n = F.col("n_class")
    r = F.col("_r")
    in_hard = r <= k
    in_easy = (r > n - k) & ((r < n) if drop_last else F.lit(True))
    if labels is not None:
        member = F.col(label_col).isin(list(labels))
        in_hard = member & in_hard
        in_easy = member & in_easy
    return (ranked.withColumn("in_hard_pool", in_hard).withColumn("in_easy_pool", in_easy)
            .drop("_r", "n_class"))
