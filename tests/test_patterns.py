"""Literal patterns, group accuracies and exported tables, worked out by hand or by plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sievekit.operators import influence as I
from sievekit.operators import joins as J
from sievekit.operators import metrics as M
from sievekit.operators import shortcuts as SC


@pytest.mark.parametrize("chars", [8_000_000, 60])
def test_literals_match_as_substrings(spark, chars):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abAB.*é(") for _ in range(n))
    texts = [(k, some(rng.randint(0, 12)) if k % 11 else None) for k in range(200)]
    pats = [some(rng.randint(2, 4)) for _ in range(60)] + ["a[UNK]", "", "É.", None]
    df = spark.createDataFrame(texts, "id long, text string").repartition(4)
    p = spark.createDataFrame([(x,) for x in pats], "pattern string")
    got = {r.id: r.matched for r in J.literal_matches(df, p, chars=chars).collect()}
    live = [x.lower() for x in pats if x and "[UNK]" not in x]
    assert got == {k: t is not None and any(x in t.lower() for x in live) for k, t in texts}
    kept = {r.id for r in J.pattern_join(df, p, literal=True).collect()}
    assert kept == {k for k, hit in got.items() if hit} and 0 < len(kept) < 200
    assert J.pattern_join(df, p.limit(0), literal=True).count() == 0


def test_many_literals_in_one_pass(spark):
    df = spark.range(400).select("id", F.concat(F.lit("word"), (F.col("id") * 977).cast("string"), F.lit(" end")).alias("text"))
    p = spark.range(100_000).select(F.concat(F.lit("WORD"), F.col("id").cast("string"), F.lit(" ")).alias("pattern"))
    assert J.pattern_join(df, p, literal=True).count() == sum(k * 977 < 100_000 for k in range(400))


def test_group_accuracy_uses_the_groups_own_classes(spark):
    groups = spark.createDataFrame([("A", 0, [5, 2, 9], 2), ("B", 1, [1, 1, 1], 0)], "group_key string, group_j int, counts array<long>, majority int")
    ginc = spark.createDataFrame([(1, 2, "A", 0), (2, 1, "A", 0), (3, 0, "A", 0), (4, 2, "A", 0), (1, 2, "B", 1)],
                                 "uid long, y int, group_key string, group_j int")
    preds = spark.createDataFrame([(u, m, int((u + len(m)) % 2 == 0)) for u in range(1, 5) for m in ("m", "mm")], "uid long, model string, acc int")
    splits = spark.createDataFrame([(1, "train"), (2, "dev"), (3, "dev"), (4, "dev")], "uid long, split string")
    got = {(r.group_key, r.split, r.model): r for r in SC.group_accuracy(ginc, groups, preds, splits).collect()}
    a = got["A", "dev", "mm"]     # 2 and 4 right, 3 wrong; 1 is the group's least frequent class
    assert (a.n, a.support_acc, a.counter_acc, a.hard_counter_acc) == (3, 1.0, 0.5, 1.0) and a.majority_acc == pytest.approx(1 / 3)
    assert got["A", "dev", "m"].hard_counter_acc == 0.0
    b = got["B", "train", "m"]      # all classes tie: majority and least are both the first
    assert (b.support_acc, b.counter_acc, b.hard_counter_acc) == (None, 1.0, None)


def test_runs_and_methods_are_all_there(spark):
    df = spark.createDataFrame([(k, r, (k + r) % 2) for k in range(3) for r in range(1, 8)], "id long, run int, predicted_label int")
    wide = I.pivot_runs(df)
    assert wide.columns == ["id", *(f"predicted_label_{r}" for r in range(1, 8))]
    assert {tuple(r) for r in wide.collect()} == {(k, *((k + r) % 2 for r in range(1, 8))) for k in range(3)}
    with pytest.raises(ValueError):
        I.pivot_runs(df, n_runs=5)
    preds = spark.createDataFrame([("m1", "de", 1, 0, 0), ("m1", "de", 2, 0, 1), ("m1", "it", 1, 1, 1), ("m2", "it", 1, 1, 0)],
                                  "method string, lang string, run int, y int, predicted int")
    cells = M.method_dataset_table(preds, "method", "lang")
    assert {(r.method, r.dataset, r.runs, r.accuracy) for r in cells.collect()} == {("m1", "de", 2, .5), ("m1", "it", 1, 1.), ("m2", "it", 1, 0.)}
    assert {tuple(r) for r in M.wide_table(cells).collect()} == {("m1", .5, 1.), ("m2", None, 0.)}


def test_words_and_pairs_are_printed(spark):
    df = spark.createDataFrame([(["a", "b"], [["x", "y"], ["z"]], [(["p", "q"], ["r"]), (["ϵ"], ["s", "t"])])],
                               "w array<string>, g array<array<string>>, p array<struct<u: array<string>, v: array<string>>>")
    assert tuple(df.select(SC.fmt_words("w"), SC.fmt_ngrams("g"), SC.fmt_pairs("p")).first()) == ("a, b", "x y, z", "p q/r, ϵ/s t")
