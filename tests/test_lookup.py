"""Dictionary look-up, label codes and the SQL table function."""

import pytest
from pyspark.sql import functions as F

from sievekit.operators import text as OT
from sievekit.operators import trees as TR
from sievekit.operators.lookup import lookup


@pytest.mark.parametrize("part", [1000, 7, 1])
def test_lookup_equals_a_dict(spark, part):
    rows = [(k, [f"w{(k * j) % 60}" for j in range(k % 9)] if k % 7 else None) for k in range(80)]
    df = spark.createDataFrame([*rows, (900, ["w1", None, "é"])], "id long, t array<string>").repartition(4)
    for kind, value in (("int", lambda k: k * 3), ("double", lambda k: k / 4), ("long", lambda k: k << 40)):
        words = {f"w{k}": value(k) for k in range(20)} | {"é": value(1)}
        d = spark.createDataFrame(list(words.items()), f"word string, v {kind}")
        got = {r.id: r.found for r in lookup(df, F.col("t"), d, "word", "v", "found", part).collect()}
        for k, t in [*rows, (900, ["w1", None, "é"])]:
            assert got[k] == (None if t is None else [words.get(w) for w in t])
    none = spark.createDataFrame([], "word string, v int")
    assert {tuple(r.found or ()) for r in lookup(df, F.col("t"), none, "word", "v", "found").collect()} <= {(None,) * n for n in range(9)}
    with pytest.raises(ValueError):
        lookup(df, F.col("t"), spark.createDataFrame([("a", 1), ("a", 2)], "word string, v int"), "word", "v", "found")


def test_label_codes(spark):
    df = spark.createDataFrame([(5, "b"), (1, "c"), (3, "a"), (9, "b"), (4, None)], "id long, l string")
    assert {(r.id, r.numeric_labels) for r in OT.encode_labels_sorted(df, "l").collect()} == {(5, 1), (1, 2), (3, 0), (9, 1)}
    assert {(r.id, r.numeric_labels) for r in OT.encode_labels_by_appearance(df, "l", "id").collect()} == {(5, 2), (1, 0), (3, 1), (9, 2)}


def test_table_function_in_sql(spark):
    TR.register_functions(spark)
    df = spark.createDataFrame([(1, "(S (A (L x) (L y)) (L z))"), (2, "broken ("), (3, "(S (L q))")], "uid long, tree string")
    got = spark.sql("SELECT t.uid, n.node_no, n.tpl, n.yield FROM {t} t, LATERAL explode_tree(t.tree, false) n", t=df)
    want = TR.tree_nodes(df).select("uid", "node_no", "tpl", "yield")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 7
