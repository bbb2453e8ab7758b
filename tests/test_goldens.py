"""Hand-computed goldens (FIXTURES §4) for scores, metrics, MI, text, histograms."""

import math

import pytest
from pyspark.sql import functions as F

from sievekit.functions import scores as S
from sievekit.functions import text as TX
from sievekit.operators import metrics as M
from sievekit.operators import prune as P


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_pvi_el2n(spark):
    df = spark.createDataFrame([([0.2, 0.8], 1, 0.5)], "probs array<double>, y int, prior double")
    r = one(df.select(S.pvi(-F.log2("prior"), S.entropy_bits("probs", "y")).alias("pvi"),
                      S.el2n("probs", "y").alias("el2n")))
    assert r.pvi == pytest.approx(0.6780719051126377, abs=1e-15)
    assert r.el2n == pytest.approx(0.28284271247461906, abs=1e-15)


@pytest.mark.parametrize("gold,pred,expected", [
    ([0, 0, 1, 1, 1], [0, 1, 1, 1, 0], 0.5833333333333333),
    ([0, 0, 1], [0, 0, 0], 0.4),
])
def test_macro_f1(spark, gold, pred, expected):
    df = spark.createDataFrame(list(zip(gold, pred)), "y int, predicted int")
    assert one(M.macro_f1(df)).macro_f1 == pytest.approx(expected, abs=1e-12)


def test_macro_f1_invariant_under_class_swap(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0), (0, 0)], "y int, predicted int")
    sw = df.select((1 - F.col("y")).alias("y"), (1 - F.col("predicted")).alias("predicted"))
    assert one(M.macro_f1(df)).macro_f1 == pytest.approx(one(M.macro_f1(sw)).macro_f1)


def test_mann_whitney_u(spark):
    rows = [(i, float(v), "x") for i, v in enumerate([1, 2, 2, 5])] + [(10 + i, float(v), "y") for i, v in enumerate([0, 2, 3])]
    df = spark.createDataFrame(rows, "id long, v double, g string")
    r = one(M.mann_whitney_u(df, "v", "g", "x"))
    assert r.U == pytest.approx(7.0)
    assert r.n1 == 4 and r.n2 == 3
    assert 0.0 < r.p_value < 1.0


def test_average_reports(spark):
    df = spark.createDataFrame([(1, "loss", 178.99742885203088), (2, "loss", 179.7520106924525)],
                               "run int, metric string, value double")
    r = one(M.average_reports(df, "run"))
    assert r["mean"] == pytest.approx(179.3747197722417, abs=1e-9)
    assert r["std"] == pytest.approx(0.377290920210811, abs=1e-9)
    assert r["values"] == [178.99742885203088, 179.7520106924525]


PRUNE_TABLE = {
    20: [19, 18, 17, 16, 15, 14, 13, 12, 10, 8],
    10: [10, 9, 9, 8, 8, 7, 7, 6, 5, 4],
    7: [7, 7, 6, 6, 6, 5, 5, 5, 4, 3],
    1: [1] * 10,
}


def test_keep_count_table(spark):
    rows = [(n, q) for n in PRUNE_TABLE for q in P.PRUNE_RATES]
    df = spark.createDataFrame(rows, "n long, q int").withColumn("k", P.keep_count(F.col("q"), "n"))
    got = {(r.n, r.q): r.k for r in df.collect()}
    for n, ks in PRUNE_TABLE.items():
        assert [got[(n, q)] for q in P.PRUNE_RATES] == ks


@pytest.mark.parametrize("counts,expected", [
    ([3, 1], 0.08878194993480429), ([0, 5], 0.17871515126363852), ([2, 3], 0.0)])
def test_mutual_information(spark, counts, expected):
    df = spark.createDataFrame([(counts, [4, 6])], "a array<long>, t array<long>")
    assert one(df.select(S.natural_mi("a", "t").alias("mi"))).mi == pytest.approx(expected, abs=1e-14)


def test_text_goldens(spark):
    df = spark.createDataFrame([("  [USER] hi [URL]there [USER][URL]", "sexism2022_english-3523", "LABEL_1",
                                 "she is a Foo, bar foos!")], "t string, k string, l string, s string")
    r = one(df.select(TX.clean_mentions("t").alias("c"), TX.extract_numeric_id("k").alias("i"),
                      TX.parse_label("l").alias("p"),
                      F.regexp_replace("s", TX.lexicon_pattern(["foo", "foos"]), "").alias("raw"),
                      TX.keep_lexicon_words("s", ["foo", "foos"]).alias("kept")))
    assert r.c == "hi there"  # all three passes
    assert r.i == "3523"
    assert r.p == 1
    assert r.raw == "   Foo,  foos!"
    assert r.kept == "Foo  foos"


def test_clean_mentions_first_pass(spark):
    df = spark.createDataFrame([("  [USER] hi [URL]there [USER][URL]",)], "t string")
    step1 = TX._ws_trim(F.regexp_replace("t", r"\[USER\]*\s*", ""))
    assert one(df.select(step1.alias("c"))).c == "hi [URL]there [URL]"


def test_overlap_band(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "b", "c"])], "h array<string>, p array<string>")
    assert one(df.select(TX.overlap_band("h", "p").alias("b"))).b == "HIGH OVERLAP."


def test_tokens_basic(spark):
    df = spark.createDataFrame([("Héllo, Wörld! a$b (x) don't",)], "t string")
    toks = one(df.select(TX.tokens_basic("t").alias("x"))).x
    assert toks == ["hello", ",", "world", "!", "a", "$", "b", "(", "x", ")", "don", "'", "t"]


def test_histogram_edges_and_counts(spark):
    edges = M.arange_edges(-2, 3, 0.3)
    assert len(edges) == 17 and edges[-1] == 2.8000000000000007
    vals = [-2, -1.71, 0, 0.1, 2.4, 2.5, 2.8, 2.81]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    h = M.histogram_bins(df, "v", edges).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 2, 1]


def test_softmax_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "l array<double>")
    r = one(df.select(S.softmax("l").alias("p"), S.argmax("l").alias("a")))
    assert sum(r.p) == pytest.approx(1.0)
    assert r.a == 1  # first maximum wins
    assert math.isclose(r.p[1], r.p[2])
