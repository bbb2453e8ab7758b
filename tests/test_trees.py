"""Tree explosion goldens through ``tree_nodes``."""

from sievekit.operators import trees as TR

PCFG = "(25 (28 (57 women) (77 should)) (74 .))"
SCFG = "(7 (3 (11 the/the) (12 red/blue)) (5 (13 quickly/) (14 runs/sleeps)))"


def test_pcfg_nodes(spark):
    df = spark.createDataFrame([("u", PCFG)], "uid string, tree string")
    rows = TR.tree_nodes(df).orderBy("node_no").collect()
    assert [(r.tpl, r["yield"]) for r in rows] == [
        ("(57 *)", "women"), ("(77 *)", "should"), ("(28 (57 *) (77 *))", "women should"),
        ("(74 *)", "."), ("(25 (28 (57 *) (77 *)) (74 *))", "women should .")]
    assert [r.depth for r in rows] == [1, 1, 2, 1, 3]
    assert [r.root for r in rows] == ["57", "77", "28", "74", "25"]
    assert rows[2].rhs == "(57, 77)" and rows[0].rhs == "('women',)"
    assert rows[0].node == "57 -> 'women'" and rows[2].node == "28 -> 57 77"


def test_scfg_yields(spark):
    df = spark.createDataFrame([("u", SCFG)], "uid string, tree string")
    rows = TR.tree_nodes(df, scfg=True).orderBy("node_no").collect()
    assert [r["yield"] for r in rows] == [
        "the/the", "red/blue", "the red/the blue", "quickly/ϵ", "runs/sleeps", "quickly runs/ sleeps",
        "the red quickly runs/the blue sleeps"]


def test_bad_tree_skipped(spark):
    df = spark.createDataFrame([("a", PCFG), ("b", "(S (a b)"), ("c", "(S a))")], "uid string, tree string")
    assert TR.tree_nodes(df).select("uid").distinct().count() == 1
    r = TR.count_unparsed(df).collect()[0]
    assert r.skipped == 2 and r.total == 3


def test_deep_tree_no_recursion_limit():
    depth = 5000
    s = "".join("(A " for _ in range(depth)) + "w" + ")" * depth
    rows = TR.nodes(TR.parse(s))
    assert len(rows) == depth and rows[-1][4] == depth


def test_one_pass_rows_are_the_trees_rows():
    """Nested, empty, bare and malformed trees: ``node_columns`` against ``nodes`` of the parsed tree."""
    odd = [PCFG, SCFG, "(S)", "()", "(S ())", "(S (A) w (B x y_z))", "((A b) c)", "( S ( L  w ) )", "w", "", "(S (L w)) (S (L v))",
           "(S (L w)", "(S w))", "(S _ (L _) (L a__b))", "(A (B (C d) (C d)))", "(S (L it's) (L \"))", "(L a/) ", "(L /b)"]
    for s in odd:
        for scfg in (False, True):
            t = TR.parse(s)
            want = None if t is None else TR.nodes(t, scfg)
            assert TR.node_columns(s, scfg, TR.NODE_COLS) == want, s
            for depth in (None, 1, 2):
                pairs = None if t is None else list(dict.fromkeys((r[2], r[3]) for r in want if depth is None or r[4] <= depth))
                assert TR.node_columns(s, scfg, ("tpl", "yield"), depth, True) == pairs, s
    assert TR.node_columns(None) is None


def test_only_asked_columns_are_sent(spark):
    df = spark.createDataFrame([("u", PCFG)], "uid string, tree string")
    got = TR.tree_nodes(df, columns=("node_no", "tpl"))
    assert got.columns == ["uid", "node_no", "tpl"]
    assert [tuple(r) for r in got.collect()] == [("u", r["node_no"], r["tpl"]) for r in TR.tree_nodes(df).collect()]
