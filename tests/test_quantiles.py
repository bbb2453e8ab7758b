"""Exact ranks from brackets, against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from sievekit.operators import prune as P
from sievekit.operators import quantiles as Q


def _frame(spark, seed=3):
    """Groups: None, an even spread, one value only, nulls and ties, a single row."""
    rng = random.Random(seed)
    rows = [("a", k, rng.gauss(0, 1)) for k in range(1500)] + [("ties", k, float(rng.randrange(3))) for k in range(900)] \
        + [("same", k, 1.5) for k in range(300)] + [(None, k, None if k % 4 == 0 else rng.random()) for k in range(400)] + [("one", 7, 0.0)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, id long, v double").repartition(5)


@pytest.mark.parametrize("small,inside", [(20_000, 200_000), (50, 200_000), (50, 10)])
def test_thresholds_are_the_rows_at_their_ranks(spark, small, inside):
    rows, df = _frame(spark)
    shares = [0.0, 0.05, 0.37, 0.5, 0.95, 1.0]
    t = Q.rank_thresholds(df, ["g"], "v", ["id"], shares, lambda n, i: F.ceil(F.lit(shares[i]) * n), inside, small).collect()
    assert {r.g for r in t} == {"a", "ties", "same", None, "one"}
    for r in t:
        own = sorted(((v is not None, v or 0.0, k) for g, k, v in rows if g == r.g))
        assert r.n == len(own)
        for i, s in enumerate(shares):
            rank = -int(-s * len(own) // 1)
            got = r["at"][i]
            assert (got is None) == (rank == 0)
            if rank:
                assert (got.v is not None, got.v or 0.0, got.id) == own[rank - 1]


def test_kept_rates_say_what_each_split_holds(spark):
    rows, df = _frame(spark, 5)
    df = df.where("g is not null").withColumn("average_pvi", F.col("v")).withColumn("y", (F.col("g") == "a").cast("int"))
    df = df.withColumn("id", F.monotonically_increasing_id()).checkpoint()
    kept = P.kept_rates(df, ["average_pvi"], rates=(5, 50, 60)).collect()
    order = sorted((r.y, r.average_pvi, r.id) for r in df.collect())
    for y in (0, 1):
        own = [(v, i) for c, v, i in order if c == y]
        place = {i: k + 1 for k, (_, i) in enumerate(own)}
        for r in (r for r in kept if r.y == y):
            n = len(own)
            easy = [q for q in (5, 50, 60) if place[r.id] <= -int(-(1 - q / 100) * n // 1)]
            hard = [q for q in (5, 50, 60) if place[r.id] > n + int(-(1 - q / 100) * n // 1)]
            assert (r.kept_easy, r.kept_hard) == (max(easy, default=None), max(hard, default=None))
    assert P.kept_rates(df.limit(0), ["average_pvi"]).count() == 0
