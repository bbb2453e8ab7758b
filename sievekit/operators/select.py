"""Embeddings and facility-location (submodular) selection.

``f(S) = Σ_i max(0, max_{j∈S} sim(i, j))`` with cosine similarity over a whole
pool (a class, or everything).  The reference builds the pool's n×n matrix in
memory; here no task ever holds more than ``block_rows`` × ``block_rows``.

*Values.*  ``best_match`` is a block-pair join: the rows of a pool are dealt to
blocks, every block of rows meets every block of the other side in a task of
its own, and the partial maxima of a row combine by ``max``.  Nearest
neighbours, f(S) and marginal gains are exact at any number of blocks.

*Selection* has two rounds.  In the first, every block picks by exact greedy
for itself; the picks, each with the vector sum of the rows it stands for, meet in
groups of bounded size and are picked from again, until one group gives the
``head`` of the order, whose gains are then measured against the whole pool.
In the second, every block continues the greedy from what the head covers
already, and the blocks' sequences merge by gain.  A pool of one block has the
exact greedy order (ties: lowest id).  One order answers every budget, so kept
sets are nested across rates; the reference re-runs a stochastic optimiser per
budget instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.operators.rank import _broadcast_if_few, _null_safe_on, distributed_rank, with_group_sizes

#: Rows of a block, about: a task holds a matrix of twice this many rows and columns at most.
BLOCK_ROWS = 2048
#: Rows of a block where all pairs meet; a task holds ``PAIR_CELLS`` cosines of two blocks at once.  Rows travel once per
#: block of the other side, so larger blocks shuffle less.
PAIR_ROWS, PAIR_CELLS = 16384, 4 << 20
#: Picks of the first round that all blocks start the second from.
HEAD = 256
#: Cosines that differ by less are ties.
DIGITS = 9


def l2_normalize(vec) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def cosine(a, b) -> Column:
    """Cosine similarity of two arrays (dot of the normalised vectors)."""
    return F.aggregate(F.zip_with(l2_normalize(a), l2_normalize(b), lambda x, y: x * y),
                       F.lit(0.0), lambda s, x: s + x)


def unit_rows(col: pd.Series) -> np.ndarray:
    """Normalised vectors of a column, one a row; a zero vector stays zero."""
    x = np.stack(col.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1.0)


def assign_blocks(df: DataFrame, by: Sequence[str], id_col: str = "id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Deal every group to hash blocks of about ``block_rows`` rows (``block``, and ``blocks``: how many there
    are).  The number follows from the group's counted size."""
    df = df.select(*(F.col(c).alias(c) for c in df.columns))    # columns of its own: both sides may be one table
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else df.agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("_n") / F.lit(block_rows)), F.lit(1)).cast("int")).drop("_n")
    d, s = df.alias("d"), (_broadcast_if_few(sizes) if by else F.broadcast(sizes)).alias("s")
    out = d.join(s, _null_safe_on(d, s, list(by))) if by else d.crossJoin(s)
    return (out.select("d.*", "s.blocks")
            .withColumn("block", F.pmod(F.xxhash64(F.col(id_col)), F.col("blocks")).cast("int")))


# ------------------------------------------------------------------ block pairs
def _block_pairs(left: DataFrame, right: DataFrame, by: Sequence[str], id_col: str, block_rows: int):
    """Both sides dealt to blocks, rows once for each block of the other side of their group, and the keys of a pair."""
    a = assign_blocks(left, by, id_col, block_rows).withColumnRenamed("block", "_a")
    b = assign_blocks(right, by, id_col, block_rows).withColumnRenamed("block", "_b")
    counts = lambda d, name: d.select(*by, F.col("blocks").alias(name)).distinct()

    def spread(d: DataFrame, to: DataFrame, name: str, col: str) -> DataFrame:
        x, y = d.drop("blocks").alias("x"), F.broadcast(to).alias("y")      # one row a group
        j = x.join(y, _null_safe_on(x, y, list(by))) if by else x.crossJoin(y)
        return j.select("x.*", F.explode(F.sequence(F.lit(0), F.col(f"y.{name}") - 1)).alias(col))
    return spread(a, counts(b, "_n"), "_n", "_b"), spread(b, counts(a, "_n"), "_n", "_a"), [*by, "_a", "_b"]


def _stripes(rows: int, columns: int) -> range:
    """Starts of the row stripes of a matrix that hold about ``PAIR_CELLS`` numbers, and their step."""
    return range(0, rows, max(1, PAIR_CELLS // max(columns, 1)))


def best_match(left: DataFrame, right: DataFrame, by: Sequence[str] = (), id_col: str = "id", vec_col: str = "embedding",
               block_rows: int = PAIR_ROWS, other: bool = False) -> DataFrame:
    """Per row of ``left``: ``match``, the row of ``right`` with the largest cosine (``similarity``), of equal ones the
    lowest id, over all of ``right`` in its group.  ``other`` leaves out the row's own id.  Left rows without a
    candidate have none.

    Each pair of blocks meets in one task and hands on one row per left row; ``left`` travels once per block of
    ``right``.  Both sides need distinct ids."""
    a2, b2, keys = _block_pairs(left.select(*by, id_col, vec_col), right.select(*by, id_col, vec_col), by, id_col, block_rows)

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c.name: pd.Series([], dtype="object") for c in schema.fields})
        if not len(x) or not len(y):
            return empty
        y = y.sort_values(id_col, kind="mergesort")
        ids, mine = y[id_col].to_numpy(), x[id_col].to_numpy()
        u, v = unit_rows(x[vec_col]), unit_rows(y[vec_col])
        j, best = np.empty(len(mine), dtype=np.int64), np.empty(len(mine))
        some = _stripes(len(mine), len(ids))
        for i in some:
            part = slice(i, i + some.step)
            sim = np.round(u[part] @ v.T, DIGITS) + 0.0
            if other:
                sim[mine[part, None] == ids[None, :]] = -np.inf
            j[part] = sim.argmax(axis=1)          # first maximum: lowest id
            best[part] = sim[np.arange(len(sim)), j[part]]
        ok = np.isfinite(best)
        out = pd.DataFrame({id_col: mine[ok], "match": ids[j][ok], "similarity": best[ok]})
        for k in by:
            out[k] = x[k].iloc[0]
        return out[[f.name for f in schema.fields]]
    schema = T.StructType([*(left.schema[k] for k in by), left.schema[id_col],
                           T.StructField("match", right.schema[id_col].dataType), T.StructField("similarity", T.DoubleType())])
    met = a2.groupBy(*keys).cogroup(b2.groupBy(*keys)).applyInPandas(meet, schema)
    # the largest cosine, then the lowest id
    return (met.groupBy(*by, id_col).agg(F.max("similarity").alias("similarity"), F.min_by(
        "match", F.struct(-F.col("similarity"), F.col("match"))).alias("match")).select(*by, id_col, "match", "similarity"))


def nearest_neighbour(df: DataFrame, by: Sequence[str] = (), id_col: str = "id", vec_col: str = "embedding",
                      block_rows: int = PAIR_ROWS) -> DataFrame:
    """Per row: the most similar other row of its group (``neighbour``, null in a group of one) and that cosine
    similarity: a linear-size summary of the similarity matrix."""
    found = best_match(df, df, by, id_col, vec_col, block_rows, other=True)
    d, m = df.select(*by, id_col).alias("d"), found.alias("m")
    return (d.join(m, _null_safe_on(d, m, [*by, id_col]), "left")
            .select("d.*", F.col("m.match").alias("neighbour"), "m.similarity"))


def objective(df: DataFrame, selected: DataFrame, by: Sequence[str] = (), id_col: str = "id", vec_col: str = "embedding",
              set_cols: Sequence[str] = (), block_rows: int = PAIR_ROWS) -> DataFrame:
    """Facility-location value of selected sets over the whole pool: ``value`` and ``n_selected`` per group and set
    (``set_cols`` name several sets, e.g. a rate; ``selected`` has them and the ids).  An empty set has no row."""
    vec = df.select(*by, id_col, vec_col)
    names = selected.select(*set_cols).distinct().collect() if set_cols else [()]       # few sets
    if not names:
        names = [tuple([None] * len(set_cols))]     # no set: no candidate either
    number = df.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(names)], T.StructType(
        [T.StructField("_set", T.IntegerType()), *(T.StructField(c, selected.schema[c].dataType) for c in set_cols)]))
    l, r = selected.select(*set_cols, id_col).alias("l"), F.broadcast(number).alias("r")
    of = (l.join(r, _null_safe_on(l, r, list(set_cols))) if set_cols else l.crossJoin(r)).select(F.col(f"l.{id_col}"), "r._set")
    # a candidate comes once, with the numbers of its sets: the cosines of a pair of blocks serve all of them
    sets = of.groupBy(id_col).agg(F.collect_list("_set").alias("_sets")).join(vec, id_col).select(*by, id_col, vec_col, "_sets")
    a2, b2, keys = _block_pairs(vec, sets, by, id_col, block_rows)
    schema = T.StructType([*(df.schema[k] for k in by), df.schema[id_col], T.StructField("best", T.ArrayType(T.DoubleType()))])

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({f.name: pd.Series([], dtype="object") for f in schema.fields})
        kinds: dict[tuple, int] = {}        # candidates of the same sets stand together
        kind = np.array([kinds.setdefault(tuple(sorted({int(k) for k in c})), len(kinds)) for c in y["_sets"]])
        order = np.argsort(kind, kind="stable")
        starts = np.searchsorted(kind[order], np.arange(len(kinds)))
        u, v = unit_rows(x[vec_col]), unit_rows(y[vec_col])[order]
        most = np.empty((len(u), len(kinds)))
        some = _stripes(len(u), len(v))
        for i in some:
            most[i:i + some.step] = np.maximum.reduceat(u[i:i + some.step] @ v.T, starts, axis=1)
        most = np.round(most, DIGITS) + 0.0     # the largest rounded cosine is the rounded largest
        best = np.full((len(u), len(names)), -np.inf)
        for which, k in kinds.items():
            for m in which:
                best[:, m] = np.maximum(best[:, m], most[:, k])
        out = pd.DataFrame({id_col: x[id_col].to_numpy(),
                            "best": [[w if ok else None for w, ok in zip(ws, oks)] for ws, oks in zip(best.tolist(), np.isfinite(best).tolist())]})
        for k in by:
            out[k] = x[k].iloc[0]
        return out[[f.name for f in schema.fields]]
    met = a2.groupBy(*keys).cogroup(b2.groupBy(*keys)).applyInPandas(meet, schema)
    own = [f"_b{m}" for m in range(len(names))]
    best = met.groupBy(*by, id_col).agg(*[F.max(F.get("best", F.lit(m))).alias(c) for m, c in enumerate(own)])
    total = best.groupBy(*by).agg(*[F.sum(F.greatest(c, F.when(F.col(c).isNotNull(), F.lit(0.0)))).alias(c) for c in own])
    value = total.select(*by, F.posexplode(F.array(*own)).alias("_set", "value")).where("value is not null")
    n = sets.select(*by, F.explode("_sets").alias("_set")).groupBy(*by, "_set").agg(F.count(F.lit(1)).alias("n_selected"))
    v, c, m = value.alias("v"), n.alias("c"), F.broadcast(number).alias("m")
    return v.join(c, _null_safe_on(v, c, [*by, "_set"])).join(m, F.col("v._set") == F.col("m._set")).select(
        *[F.col(f"m.{k}") for k in set_cols], *[F.col(f"v.{k}") for k in by], "v.value", "c.n_selected")


def marginal_gains(df: DataFrame, selected: DataFrame, by: Sequence[str] = (), id_col: str = "id",
                   vec_col: str = "embedding", block_rows: int = PAIR_ROWS) -> DataFrame:
    """Marginal gain of every candidate given the selected set, over the whole pool:
    ``Σ_i max(0, sim(i, c) − cover_i)``, and whether it is ``selected``.  Covers come from ``best_match``, sums from a
    second block-pair join."""
    vec = df.select(*by, id_col, vec_col)
    best = best_match(vec, vec.join(selected.select(id_col).distinct(), id_col), by, id_col, vec_col, block_rows)
    v, m = vec.alias("v"), best.alias("m")
    pool = v.join(m, _null_safe_on(v, m, [*by, id_col]), "left").select(
        "v.*", F.greatest(F.coalesce("m.similarity", F.lit(0.0)), F.lit(0.0)).alias("cover"))
    a = assign_blocks(vec, by, id_col, block_rows)
    b = assign_blocks(pool, by, id_col, block_rows)
    parts = lambda col: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(col)
    keys = [*by, "_a", "_b"]
    a2 = a.select(*by, id_col, vec_col, F.col("block").alias("_a"), parts("_b"))
    b2 = b.select(*by, id_col, vec_col, "cover", F.col("block").alias("_b"), parts("_a"))
    schema = T.StructType([*(df.schema[k] for k in by), df.schema[id_col], T.StructField("gain", T.DoubleType())])

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({f.name: pd.Series([], dtype="object") for f in schema.fields})
        gain = np.zeros(len(x))
        if len(y):
            u, v, cover = unit_rows(y[vec_col]), unit_rows(x[vec_col]), y["cover"].to_numpy()
            some = _stripes(len(u), len(v))
            for i in some:
                gain += np.maximum(u[i:i + some.step] @ v.T - cover[i:i + some.step, None], 0.0).sum(axis=0)
        out = pd.DataFrame({id_col: x[id_col].to_numpy(), "gain": gain})
        for k in by:
            out[k] = x[k].iloc[0]
        return out[[f.name for f in schema.fields]]
    met = a2.groupBy(*keys).cogroup(b2.groupBy(*keys)).applyInPandas(meet, schema)
    total = met.groupBy(*by, id_col).agg(F.sum("gain").alias("gain"))
    return total.join(selected.select(id_col).distinct().withColumn("_in", F.lit(True)), id_col, "left").select(
        *by, id_col, "gain", F.coalesce("_in", F.lit(False)).alias("selected"))


# ------------------------------------------------------------------ greedy order
def greedy(sim: np.ndarray, cover: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lazy greedy facility location: order and gains of up to ``most`` columns of ``sim`` (rows = ground set,
    columns = candidates), ground rows covered up to ``cover`` before.  A gain computed
    for an earlier step bounds it now, so only the leading candidates are measured again; ties go to the first."""
    import heapq
    n, k = sim.shape
    cover = np.zeros(n) if cover is None else cover.copy()
    gain = np.maximum(sim - cover[:, None], 0.0).sum(axis=0)
    heap = [(-round(float(g), DIGITS), j, 0) for j, g in enumerate(gain)]
    heapq.heapify(heap)
    order, gains = [], []
    step = 0
    while heap and (most is None or step < most):
        g, j, when = heapq.heappop(heap)
        if when < step:
            heapq.heappush(heap, (-round(float(np.maximum(sim[:, j] - cover, 0.0).sum()), DIGITS), j, step))
            continue
        order.append(j)
        gains.append(-g)
        cover = np.maximum(cover, sim[:, j])
        step += 1
    return np.array(order, dtype=np.int64), np.array(gains)


def _picked(by, id_col, vec_col, most):
    """Greedy picks of one block.  A ground row is the sum of the unit vectors it stands for (``mass``): its product with
    a candidate is the sum of their cosines.  A pick takes over the mass of the rows nearest to it."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, kind="mergesort").reset_index(drop=True)
        x, mass = unit_rows(pdf[vec_col]), np.stack(pdf["mass"].to_numpy())
        sim = mass @ x.T
        order, _ = greedy(sim, most=most)
        near = sim[:, order].argmax(axis=1)
        total = np.zeros((len(order), mass.shape[1]))
        np.add.at(total, near, mass)
        out = pdf.iloc[order][[*by, id_col, vec_col]].copy()
        out["mass"] = list(total)
        out["step"] = np.arange(1, len(order) + 1, dtype=np.int32)
        return out
    return run


def head_order(df: DataFrame, by: Sequence[str] = (), id_col: str = "id", vec_col: str = "embedding",
               block_rows: int = BLOCK_ROWS, head: int = HEAD) -> DataFrame:
    """``*by, id, embedding, step``: the first ``head`` picks of every group.  Blocks pick for themselves, their picks,
    each with the vector sum of the rows it stands for, meet in groups of at most about ``block_rows`` and are picked
    from again, down to one group; so the last choice is judged by all rows."""
    fields = [*(df.schema[k] for k in by), df.schema[id_col], df.schema[vec_col]]
    schema = T.StructType([*fields, T.StructField("mass", T.ArrayType(T.DoubleType())), T.StructField("step", T.IntegerType())])
    level = df.select(*by, id_col, vec_col).withColumn("mass", l2_normalize(vec_col))
    while True:
        dealt = assign_blocks(level, by, id_col, block_rows).checkpoint(eager=True)
        blocks = dealt.agg(F.max("blocks")).first()[0] or 0
        picked = dealt.groupBy(*by, "block").applyInPandas(_picked(by, id_col, vec_col, head), schema)
        if blocks <= 1:
            return picked.select(*by, id_col, vec_col, "step")
        level = picked.drop("step")


def greedy_order(df: DataFrame, by: Sequence[str] = (), id_col: str = "id", vec_col: str = "embedding",
                 block_rows: int = BLOCK_ROWS, head: int = HEAD) -> DataFrame:
    """Per row: its place in the greedy ``order`` of its group and the marginal ``gain``: against the whole pool for the
    ``head``, against its block and the head for the others.  A task holds ``block_rows`` × (``block_rows`` + ``head``)
    numbers, at any size of the pool."""
    pool = df.select(*by, id_col, vec_col)
    top = head_order(pool, by, id_col, vec_col, block_rows, head).checkpoint(eager=True)
    blocked = assign_blocks(pool, by, id_col, block_rows)
    keys = [*by, "block"]
    # the head of a group, at most ``head`` vectors, goes to each of its blocks
    sizes = blocked.select(*by, "blocks").distinct()
    t, s = top.alias("t"), _broadcast_if_few(sizes).alias("s")
    sent = (t.join(s, _null_safe_on(t, s, list(by))) if by else t.crossJoin(F.broadcast(sizes).alias("s"))).select(
        "t.*", F.explode(F.sequence(F.lit(0), F.col("s.blocks") - 1)).alias("block"))
    schema = T.StructType([*(df.schema[k] for k in by), df.schema[id_col], T.StructField("block", T.IntegerType()),
                           T.StructField("step", T.IntegerType()), T.StructField("gain", T.DoubleType()),
                           T.StructField("head", T.BooleanType())])

    def run(x: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({f.name: pd.Series([], dtype="object") for f in schema.fields})
        x = x.sort_values(id_col, kind="mergesort").reset_index(drop=True)
        h = h.sort_values("step").reset_index(drop=True)
        v, first = unit_rows(x[vec_col]), unit_rows(h[vec_col])
        reach = np.maximum(np.maximum.accumulate(v @ first.T, axis=1), 0.0)
        # what each pick of the head adds in this block: the sums over blocks are exact gains
        added = np.diff(reach, axis=1, prepend=0.0).sum(axis=0)
        rest = np.flatnonzero(~np.isin(x[id_col].to_numpy(), h[id_col].to_numpy()))
        order, gains = greedy((v @ v[rest].T), cover=reach[:, -1])
        out = pd.DataFrame({id_col: np.concatenate([h[id_col].to_numpy(), x[id_col].to_numpy()[rest[order]]]),
                            "block": np.int32(x["block"].iloc[0]),
                            "step": np.concatenate([h["step"].to_numpy(), np.arange(1, len(rest) + 1)]).astype(np.int32),
                            "gain": np.concatenate([added, gains]), "head": [True] * len(h) + [False] * len(rest)})
        for k in by:
            out[k] = x[k].iloc[0]
        return out[[f.name for f in schema.fields]]
    picks = blocked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(run, schema).checkpoint(eager=True)
    lead = picks.where("head").groupBy(*by, id_col, "step").agg(F.sum("gain").alias("gain")) \
        .select(*by, id_col, F.lit(-1).alias("block"), "step", "gain")
    tail = picks.where("not head").select(*by, id_col, "block", "step", "gain")
    both = lead.unionByName(tail).withColumn("_late", F.col("block") >= 0)
    ordered = distributed_rank(both, ["_late", F.when(F.col("_late"), -F.round("gain", DIGITS)).otherwise(F.col("step")),
                                      "block", "step"], list(by), rank_col="order")
    return ordered.select(*by, id_col, "block", "step", "gain", "order")


def budget(rate, n) -> Column:
    """``ceil((1 - q/100) * n)``."""
    q = rate if isinstance(rate, Column) else F.lit(rate)
    nn = F.col(n) if isinstance(n, str) else n
    return F.ceil((F.lit(1.0) - q.cast("double") / F.lit(100.0)) * nn)


def submodular_prune(df: DataFrame, rates: Sequence[int], by: Sequence[str] = (), id_col: str = "id",
                     vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, head: int = HEAD) -> DataFrame:
    """Keep the first ``ceil((1-q/100)·n)`` rows of the greedy order for every
    rate (per group of ``by`` when given: class-wise budgets keep the class
    ratio).  Output ``(prune_rate, id, gain, order, …by)``."""
    ordered = with_group_sizes(greedy_order(df, by, id_col, vec_col, block_rows, head), list(by), "_n")
    grid = F.array(*[F.lit(int(r)) for r in rates])
    kept = F.filter(grid, lambda r: F.col("order") <= budget(r, "_n"))
    return ordered.select(F.explode(kept).alias("prune_rate"), *by, id_col, "gain", "order")


def project_2d(df: DataFrame, vec_col: str = "embedding", k: int = 2) -> DataFrame:
    """2-D map of the embeddings with ``pyspark.ml.feature.PCA`` (a linear
    stand-in for the reference's UMAP)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = df.withColumn("_v", array_to_vector(F.col(vec_col)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    out = model.transform(v).withColumn("_a", vector_to_array("_p"))
    return out.select(*[c for c in df.columns if c != vec_col],
                      *[F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)])
