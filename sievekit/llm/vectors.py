"""Exact top-k inner products with a bit-sliced index.

Vectors become integers.  The index cuts rows into blocks; a block stores, for
every attribute, bitmaps of its most significant bits (one bit per row).  A
query's scores for a whole block are computed with bitmap arithmetic: slices are
added under carry-save adders, weighted by the query's bits, into slices of the
score.  Rows are then chosen from the most significant score slice downward.
Bits left out of the slices bound the error; rows the bound can not separate are
resolved by exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm._common import rows, stash
from sievekit.llm._words import U64

SCALE = 256
#: Rows of a block, queries worked on together, and slices kept per attribute.
BLOCK_ROWS = 8192
QUERY_ROWS = 128
SLICES = 8
#: Queries that meet a block of rows in one task.
QUERY_BLOCK = 8192
#: Integers of at least this size have no 64-bit slices; they stand in blocks of their own.
WIDE = 1 << 61


class Block:
    """The bit slices of up to ``BLOCK_ROWS`` integer vectors (rows by ascending id)."""

    def __init__(self, x: np.ndarray, slices: int = SLICES):
        self.x = x
        self.most = int(np.abs(x).max()) if x.size else 0
        self.low = x.min(axis=0) if len(x) else np.zeros(x.shape[1], dtype=np.int64)
        spread = int((x - self.low).max()) if x.size else 0
        self.drop = max(0, spread.bit_length() - slices)
        kept = (x - self.low) >> self.drop
        self.n_slices = max(1, spread.bit_length() - self.drop)
        words = max(1, -(-len(x) // 64))
        bits = np.zeros((x.shape[1], self.n_slices, words * 64), dtype=np.uint8)
        for t in range(self.n_slices):
            bits[:, t, :len(x)] = ((kept >> t) & 1).T
        self.bits = np.packbits(bits, axis=-1, bitorder="little").view(U64)
        self.live = np.packbits(np.arange(words * 64) < len(x), bitorder="little").view(U64)

    def scores(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(score slices, error): for each query, sum over attributes of |q| times the
        kept bits (complemented where q < 0), and the most the dropped bits can add."""
        size, negative = np.abs(q), q < 0
        flip = np.where(negative, ~U64(0), U64(0))
        planes = int(size.max()).bit_length() if size.size else 0
        columns: dict[int, list[np.ndarray]] = {}

        def add(weight: int, row: np.ndarray) -> None:
            while True:
                pending = columns.setdefault(weight, [])
                if len(pending) < 2:
                    pending.append(row)
                    return
                a, b = pending.pop(), pending.pop()
                half = a ^ b
                pending.append(half ^ row)
                row = (a & b) | (half & row)
                weight += 1

        for p in range(planes):
            for j in range(q.shape[1]):
                on = ((size[:, j] >> p) & 1).astype(bool)
                if not on.any():
                    continue
                mask = np.where(on, ~U64(0), U64(0))[:, None]
                for t in range(self.n_slices):
                    add(p + t, (self.bits[j, t][None, :] ^ flip[:, j, None]) & mask)
        out, carry, weight = [], None, 0
        while columns and weight <= max(columns) or carry is not None:
            got = columns.get(weight, []) + ([carry] if carry is not None else [])
            while len(got) < 3:
                got.append(None)
            a, b, c = sorted(got, key=lambda v: v is None)
            if a is None:
                out.append(np.zeros((len(q), len(self.live)), dtype=U64))
                carry = None
            elif b is None:
                out.append(a)
                carry = None
            elif c is None:
                out.append(a ^ b)
                carry = a & b
            else:
                half = a ^ b
                out.append(half ^ c)
                carry = (a & b) | (half & c)
            weight += 1
        error = size.astype(object).sum(axis=1) * ((1 << self.drop) - 1)
        return out, error

    def products(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; in unbounded integers where 64 bits may not hold a sum."""
        if len(q) * int(np.abs(q).max()) * self.most < 1 << 63:
            return self.x[at] @ q
        return _held(self.x[at].astype(object) @ q.astype(object))

    def top(self, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, exact scores) of at least the k best rows of each query."""
        slices, error = self.scores(q)
        n = len(q)
        sure = np.zeros((n, len(self.live)), dtype=U64)
        maybe = np.repeat(self.live[None, :], n, axis=0)
        floor = np.zeros(n, dtype=object)
        open_ = np.ones(n, dtype=bool)
        for w in range(len(slices) - 1, -1, -1):
            both = sure | (maybe & slices[w])
            many = np.bitwise_count(both).sum(axis=1) >= k
            floor += np.where(many, 1 << w, 0)
            keep = many[:, None]
            sure = np.where(keep, sure, both)
            maybe = np.where(keep, maybe & slices[w], maybe & ~slices[w])
        # kept-bit scores from the k-th best down to what the dropped bits may lift
        for i in range(n):
            pick = sure[i] | maybe[i]
            if error[i]:
                pick = pick | self._reach(slices, i, int(floor[i]) * (1 << self.drop) - int(error[i]))
            at = np.flatnonzero(np.unpackbits(pick.view(np.uint8), bitorder="little"))
            yield i, at, self.products(at, q[i])

    def _reach(self, slices: list[np.ndarray], i: int, least: int) -> np.ndarray:
        """Rows whose kept bits give at least ``least``: compared slice by slice."""
        least = max(0, -(-least // (1 << self.drop)))
        above, same = np.zeros_like(self.live), self.live.copy()
        for w in range(max(len(slices), least.bit_length()) - 1, -1, -1):
            s = slices[w][i] if w < len(slices) else np.zeros_like(self.live)
            if (least >> w) & 1:
                same = same & s
            else:
                above |= same & s
                same = same & ~s
        return above | same


class WideBlock:
    """Rows or queries with integers too wide for slices: every score in unbounded integers."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(object)

    def top(self, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, one in enumerate(q.astype(object)):
            score = self.x @ one
            at = np.array(sorted(range(len(score)), key=lambda r: -score[r])[:k], dtype=np.int64)
            if len(at):     # ties of the last one too: ids decide between them
                at = np.array([r for r in range(len(score)) if score[r] >= score[at[-1]]], dtype=np.int64)
            yield i, at, score[at]


def _held(score: np.ndarray) -> np.ndarray:
    return score if score.dtype == np.int64 else np.array([int(s) for s in score], dtype=object)


def _as_long(score: np.ndarray) -> np.ndarray:
    """Scores as they leave a task.  One above 64 bits is among the best of all, so it is an error here; one below
    them loses to any other and is null, an error only where a query has nothing better."""
    if score.dtype == np.int64:
        return score
    if any(s >= 1 << 63 for s in score):
        raise OverflowError("a score among the best does not fit a 64-bit integer")
    return np.array([None if s < -(1 << 63) else int(s) for s in score], dtype=object)


_FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int, slices: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block of rows against the query blocks sent to it."""
        ids = left.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            x = _matrix(left.column("v"))[order]
            q_all = _matrix(right.column("v"))
            wide = x.dtype == object or q_all.dtype == object
            block = WideBlock(x) if wide else Block(x, slices)
            q_ids, q_rows = right.column("vec_id").to_numpy(), right.column("row").to_numpy()
            # its own rows may stand among the best: ask for as many more
            own = int(np.unique(ids, return_counts=True)[1].max())
            for a in range(0, len(q_all), QUERY_ROWS):
                for i, at, score in block.top(q_all[a:a + QUERY_ROWS], min(k + own, len(ids))):
                    keep = ids[at] != q_ids[a + i]
                    at, score = at[keep], score[keep]
                    best = np.array(sorted(range(len(at)), key=lambda r: (-int(score[r]), ids[at[r]]))[:k], dtype=np.int64) \
                        if score.dtype == object else np.lexsort((ids[at], -score))[:k]
                    found.append((np.full(len(best), q_rows[a + i]), np.full(len(best), q_ids[a + i]), ids[at[best]],
                                  _as_long(score[best])))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_FOUND)
    return run


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Integers of a column of whole doubles, in 64 bits where all fit."""
    flat = col.combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    if x.size and float(np.abs(x).max()) >= WIDE:
        return np.array([[int(c) for c in row] for row in x], dtype=object)
    return x.astype(np.int64)


def integers(embeddings: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, dim, v, wide``: floor(256 x) of every component, as a whole double (exact at any size), and
    whether one is too wide for slices.  Null ids, null or empty vectors and those with a null or non-finite
    component are left out."""
    x = F.col("e")
    e = embeddings.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # doubles of 2^53 and more are whole; floor() gives a long, so they go around it
    whole = F.transform(x, lambda c: F.when(F.abs(c * SCALE) < 1 << 53, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    return (e.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False)))
            .select("vec_id", F.size(x).alias("dim"), whole.alias("v"))
            .withColumn("wide", F.exists("v", lambda c: F.abs(c) >= float(WIDE))))


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, slices: int = SLICES,
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose id is divisible by
    ``every``, its k best rows by integer inner product.

    Candidates are all rows of the same dimension but those with the query's own id.
    Ties go to the smaller vec_id.  A repeated query row gets one answer per id; a
    repeated candidate row counts as often as it occurs.  Empty tables, and queries
    without a candidate, give no rows.  Components of any finite size take part: sums that 64 bits may
    not hold are made in unbounded integers, and a best score that is no 64-bit integer is an error.
    A task is a block of at most about ``block_rows`` rows and one of about ``query_rows`` queries; it hands on
    k rows per query, never all pairs.
    """
    v = stash(integers(embeddings), "vectors")
    n, n_queries = v.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, turns = max(1, -(-n // block_rows)), max(1, -(-n_queries // query_rows))
    # dealt by place in the stored table: no value, however often repeated, fills a block
    cand = v.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    queries = (v.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim", "v").agg(F.count("*").alias("_n")).drop("_n")
               .withColumn("row", F.xxhash64("vec_id", "v")).withColumn("turn", F.pmod(F.xxhash64("row"), F.lit(turns))))
    spread = lambda name, count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)
    sent = queries.select("*", spread("block", blocks))
    sent = sent.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("wide"))
    keys = ["block", "turn", "dim", "wide"]
    found = cand.select("*", spread("turn", turns)).groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(
        _search(k, slices), "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    from pyspark.sql import Window
    by = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    held = F.coalesce("score", F.raise_error(F.lit("a score among the best does not fit a 64-bit integer")).cast("long"))
    return (found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", held.alias("score")))
