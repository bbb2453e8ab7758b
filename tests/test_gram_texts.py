"""N-gram texts of a document, and feature MI with its sums written out."""

import time

import pytest
from pyspark.sql import functions as F

from sievekit.functions import scores as S
from sievekit.operators import shortcuts as SC


def test_gram_texts_are_distinct(spark):
    t = "a b a b c".split()
    df = spark.createDataFrame([(1, t), (2, ["x"]), (3, []), (4, None)], "id int, t array<string>")
    got = {r.id: r for r in df.select("id", *[SC.gram_texts("t", n).alias(f"g{n}") for n in (1, 2, 3)]).collect()}
    assert got[1].g1 == ["a", "b", "c"] and got[1].g2 == ["a b", "b a", "b c"] and got[1].g3 == ["a b a", "b a b", "a b c"]
    assert got[2].g1 == ["x"] and got[2].g2 == [] == got[2].g3
    assert got[3].g1 == [] == got[4].g1


def test_long_text_of_distinct_words(spark):
    """60,000 words: told apart two by two, the 180,000 grams would be 16 billion comparisons."""
    n = 60_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("t"))
    start = time.monotonic()
    sizes = df.select(*[F.size(SC.gram_texts("t", k)) for k in (1, 2, 3)]).first()
    assert tuple(sizes) == (n, n - 1, n - 2)
    assert time.monotonic() - start < 60


@pytest.mark.parametrize("k", [1, 2, 3, 9])
def test_written_out_mi_is_the_folded_one(spark, k):
    rows = [tuple((i * (j + 3)) % 7 for j in range(k)) for i in range(20)]
    totals = [9 + j for j in range(k)]
    df = spark.createDataFrame(rows, ", ".join(f"_n{j} long" for j in range(k)))
    folded = S.natural_mi(F.array(*[F.col(f"_n{j}") for j in range(k)]), F.array(*[F.lit(t).cast("long") for t in totals]))
    got = SC.with_mi(df.withColumn("folded", folded), list(range(k)), totals).select("mi", "folded").collect()
    assert all(r.mi == r.folded for r in got)
