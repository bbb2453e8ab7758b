"""Rules that must not change with the size or layout of the data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.functions import text as TX
from sievekit.operators import edits as ED
from sievekit.operators import select as SL
from sievekit.operators import trees as TR
from sievekit.operators.rank import distributed_rank, with_group_sizes
from sievekit.sources import files as FS


@pytest.mark.parametrize("n", [512, 513])
def test_blocks_are_bounded_whatever_the_size(spark, n):
    df = spark.range(n).withColumn("y", F.col("id") % 2)
    got = SL.assign_blocks(df, [], block_rows=128).groupBy("block", "blocks").count().collect()
    assert {r.blocks for r in got} == {-(-n // 128)} and max(r["count"] for r in got) < 2 * 128
    per = SL.assign_blocks(df, ["y"], block_rows=100).groupBy("y").agg(F.max("blocks").alias("b")).collect()
    assert {r.b for r in per} == {3}


def test_objective_and_gains_are_one_function(spark):
    x = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (3, [-0.6, -0.8])]
    df = spark.createDataFrame(x, "id long, embedding array<double>")
    value = lambda ids: SL.objective(df, df.where(F.col("id").isin(ids))).first().value
    gains = {r.id: r.gain for r in SL.marginal_gains(df, df.where("id = 0")).collect()}
    for c in (1, 2, 3):
        assert gains[c] == pytest.approx(value([0, c]) - value([0]))


def test_rank_and_sizes_do_not_shuffle_by_label(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("y"), (F.col("id") * 7 % 101).alias("s"))
    out = with_group_sizes(distributed_rank(df, [F.col("s").desc(), "id"], ["y"]), ["y"])
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    for y in (None, 0, 1):
        mine = sorted((-r.s, r.id, r["rank"]) for r in rows if r.y == y)
        assert [r[2] for r in mine] == list(range(1, len(mine) + 1))
        assert {r.n_group for r in rows if r.y == y} == {len(mine)}


def test_tree_frames_are_small_and_whole(spark):
    trees = [(i, "(S " + " ".join(f"(L w{i}_{k})" for k in range(300)) + ")") for i in range(50)]
    df = spark.createDataFrame(trees, "uid long, tree string").coalesce(1)
    assert TR.tree_nodes(df).count() == sum(len(TR.nodes(TR.parse(t), False)) for _, t in trees)


def test_row_uid_follows_files(spark, tmp_path):
    for part, n in enumerate((3, 400, 20)):
        (tmp_path / f"part-{part}.csv").write_text("text\n" + "".join(f"p{part}r{k}\n" for k in range(n)))
    df = FS.read_labelled_csv(spark, str(tmp_path), "text string")
    got = {r.text: int(r.uid) for r in FS.with_row_uid(df).collect()}
    want = [f"p{part}r{k}" for part, n in enumerate((3, 400, 20)) for k in range(n)]
    assert got == {t: k for k, t in enumerate(want)}
    local = FS.with_row_uid(spark.range(10).withColumnRenamed("id", "v")).collect()
    assert [r.uid for r in sorted(local, key=lambda r: r.v)] == [str(k) for k in range(10)]


def test_tokens_in_any_script(spark):
    text = "a\x00b x\u200dy \u65e5\u672c\u8a9eok \u0419\u0451 \u03ac \u00c9cole\tz \uac00"
    got = spark.createDataFrame([(text,)], "t string").select(TX.tokens_basic("t").alias("w")).first().w
    assert got == ["ab", "xy", "\u65e5", "\u672c", "\u8a9e", "ok", "\u0438\u0435", "\u03b1", "ecole", "z", "\uac00"]


def test_edits_of_pairs(spark):
    rows = [("t", [["a", "b"], ["c"]], [["a"], ["d"]], True), ("t", [["a", "b"], ["c"]], [["a"], ["d"]], False)]
    df = spark.createDataFrame(rows, "tpl string, w array<array<string>>, w_ array<array<string>>, changed boolean")
    r = ED.group_edits_by_edit(df).collect()
    assert [(x.edit, x["count"], x.changed) for x in r] == [("a b/c\\textarrow a/d", 2, 1)]
