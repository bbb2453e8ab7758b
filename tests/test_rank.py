"""Distributed rank = window row_number, independent of partition counts;
pruning and sampling properties."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievekit.operators import prune as P
from sievekit.operators import rank as R
from sievekit.plans import fixtures as X
from sievekit.plans.scoring import averaged
from tests.conftest import MEDIUM


@pytest.mark.parametrize("parts", [1, 4, 200])
def test_distributed_rank_matches_window(spark, parts):
    df = spark.range(0, 3000).select(F.col("id"), (F.col("id") % 3).alias("g"),
                                     ((F.col("id") * 7919) % 101).alias("v"))
    got = R.distributed_rank(df, ["v", "id"], ["g"], partitions=parts)
    exp = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert got.select("id", "rank").exceptAll(exp.select("id", "rank")).count() == 0
    assert got.count() == 3000


def test_distributed_rank_hot_group(spark):
    # one group holds 90 % of the rows: ranks still exact
    df = spark.range(0, 5000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("g"),
                                     (F.col("id") % 7).alias("v"))
    got = R.distributed_rank(df, [F.col("v").desc(), "id"], ["g"], partitions=16)
    exp = df.withColumn("rank", F.row_number().over(
        Window.partitionBy("g").orderBy(F.col("v").desc(), "id")))
    assert got.select("id", "rank").exceptAll(exp.select("id", "rank")).count() == 0


def test_sample_sizes_exact(spark):
    df = spark.range(0, 1001).select("id")
    assert R.sample_fraction_exact(df, 0.8, 42).count() == round(0.8 * 1001)
    assert R.sample_n(df, 10).count() == 10
    halves = R.random_halves(df).groupBy("half").count().orderBy("half").collect()
    assert [r["count"] for r in halves] == [500, 501]


def test_stratified_split(spark):
    df = spark.range(0, 1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    s = R.stratified_split(df, "y", 0.2)
    test = s.filter(F.col("split") == "test")
    assert test.count() == 200
    assert test.filter(F.col("y") == 1).count() == 50


def test_undersample_grid_nested_and_sized(spark):
    a = averaged(spark, MEDIUM)
    g = P.undersample_grid(a).filter((F.col("inf_score") == "pvi") & (F.col("prune_type") == "easy"))
    n0 = a.filter(F.col("y") == 0).count()
    n1 = a.filter(F.col("y") == 1).count()
    sizes = {r.prune_rate: r["count"] for r in g.groupBy("prune_rate").count().collect()}
    import math
    for q, c in sizes.items():
        assert c == n1 + math.ceil((1 - q / 100) * n0)
    k60 = g.filter(F.col("prune_rate") == 60).select("id")
    k50 = g.filter(F.col("prune_rate") == 50).select("id")
    assert k60.exceptAll(k50).count() == 0


def test_pruned_and_dropped_partition_input(spark):
    a = averaged(spark, MEDIUM)
    kept = P.undersample(a, "average_pvi", 30, "hard").select("id")
    dropped = a.select("id").exceptAll(kept)
    assert kept.count() + dropped.count() == a.count()
    assert kept.intersect(dropped).count() == 0


def test_slice1_golden(spark):
    import __spark_entry__ as E
    rows = {r.y: r for r in E.queries()["prune_class_balance"](spark, MEDIUM).collect()}
    assert (rows[0].kept, rows[0].mean_average_pvi, rows[0].sum_misses) == (279, -1.330537, 783)
    assert (rows[1].kept, rows[1].mean_average_pvi, rows[1].sum_misses) == (51, 1.306845, 140)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["y", "kept", "mean_average_pvi", "sum_misses"]


def test_predictions_fixture_scales(spark):
    ex = X.examples(spark, MEDIUM)
    assert X.predictions(ex).count() == 5 * ex.count()


def test_null_class_is_a_group_like_any_other(spark):
    from sievekit.operators import influence, rank
    df = spark.createDataFrame([("a", None), ("b", None), ("c", 1), ("d", 1)], "id string, y int")
    got = rank.with_group_sizes(rank.distributed_rank(df, ["id"], ["y"], rank_col="r"), ["y"], "n")
    assert sorted((r.id, r.y, r.r, r.n) for r in got.collect()) == [("a", None, 1, 2), ("b", None, 2, 2), ("c", 1, 1, 2), ("d", 1, 2, 2)]
    assert dict(got.dtypes)["r"] == "bigint"
    runs = spark.createDataFrame([("a", 1, k, 0, 0.1 * k + 1e-9) for k in range(1, 6)], "id string, y int, run int, predicted_label int, pvi double")
    mean = influence.average_scores(runs, ("pvi",)).first()
    assert mean.average_pvi == sum(0.1 * k + 1e-9 for k in range(1, 6)) / 5 and mean.misclassification_number == 5
