"""Near duplicates: exact Jaccard join of documents over word shingles.

The join is the product of the sparse document-by-shingle incidence with its own
transpose, computed in blocks of shingles: every block adds up the overlaps of
the documents that meet in it, and pairs whose sums stay below bounds that follow
from the set sizes are discarded.  Shingles are ordered by how full their
frequency bucket is, so a document enters the product with its rarest shingles
only: two sets that link must share ``NEED`` of those.  Surviving pairs are
measured on their whole sets.

Equal sets are one node, and shingles held by exactly the same nodes are one list
with a weight, so a group's product is added up once and not once per shingle.
Within a component not all pairs are needed: first each node is measured against
hubs of its lists, then only pairs from different components are, so groups of
thousands of near copies cost about a measurement per member, and still no link
between components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm._common import rows, stash
from sievekit.llm._words import BLANK, U64, Words, mix64, sliced
from sievekit.llm.components import components

SHINGLE = 5
#: The similarity threshold, as a fraction of whole numbers: 75 / 100.
UP, DOWN = 75, 100
#: Rarest shingles two linked documents must share (all of a small set's bound).
NEED = 3
#: Frequency buckets of the global shingle order.
BUCKETS = 1 << 18
#: Turns in which nodes are measured against hubs, before all remaining pairs are.
TURNS = 1
#: Slots of a node's list weights, and nodes of a list that meet in one block.
SLOTS, BLOCK = 128, 4096

#: Odd multipliers, one per place in a shingle.
_PLACE = mix64(np.arange(1, 65, dtype=U64)) | U64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its
    whole sequence as one shingle, one without words none."""
    w = Words(texts, BLANK)
    h, first, out = w.hashes(), w.first, []
    n = max(0, len(h) - size + 1)
    g = np.full(n, U64(size))
    for k in range(size):
        g += h[k:n + k] * _PLACE[k]
    g = mix64(g)
    for a, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - a >= size:
            out.append(np.unique(g[a:e - size + 1]))
        elif e > a:
            out.append(mix64(np.array([e - a], dtype=U64) + (h[a:e] * _PLACE[:e - a]).sum(dtype=U64)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def _name(s: np.ndarray) -> int | None:
    """A set's name: a 64-bit digest of its shingles; None for the empty set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def required(n: int) -> int:
    """Least overlap of a set of n with any set it links to: ceil(t n)."""
    return -(-UP * n // DOWN)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(BUCKETS, dtype=np.int64)
    for b in sliced(batches):
        sets = shingle_sets(b.column("text"))
        if sets:
            n += np.bincount((np.concatenate(sets) & U64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(n)
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
    for i in range(0, len(at), 65_536):
        yield rows(schema, bucket=at[i:i + 65_536], n=n[at[i:i + 65_536]])


def bucket_frequencies(docs: DataFrame) -> np.ndarray:
    """How many (document, shingle) pairs fall in each of ``BUCKETS`` hash buckets, over
    all texts: a shingle that many documents share makes its bucket stand out."""
    got = (docs.select("text").mapInArrow(_bucket_counts, "bucket int, n bigint")
           .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


_SKETCH = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("n", pa.int64()), ("node", pa.int64())])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        sets = shingle_sets(b.column("text"))
        yield rows(_SKETCH, doc_id=b.column("doc_id"), row=b.column("row"), n=[len(s) for s in sets],
                   node=[_name(s) for s in sets])


#: Set names a task remembers so as to hand equal sets on once.
SEEN = 200_000


def incidence(docs: DataFrame, frequency: np.ndarray) -> DataFrame:
    """``h, node, n``: each set with its rarest shingles, a row per (shingle, set); equal
    sets are dropped within a task first, then where their rows meet."""
    handle = docs.sparkSession.sparkContext.broadcast(frequency)
    schema = pa.schema([("h", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches):
        freq, seen = handle.value, set()
        for b in sliced(batches):
            h, node, n = [], [], []
            for s in shingle_sets(b.column("text")):
                name = _name(s)
                if name is None or name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                least = required(len(s))
                keep = len(s) - least + min(NEED, least)
                order = np.argsort(freq[(s & U64(BUCKETS - 1)).astype(np.int64)], kind="stable")[:keep]
                h.append(s[order].view(np.int64))
                node.append(np.full(keep, name, dtype=np.int64))
                n.append(np.full(keep, len(s), dtype=np.int64))
            if h:
                yield rows(schema, h=np.concatenate(h), node=np.concatenate(node), n=np.concatenate(n))
    return (docs.select("text").mapInArrow(run, "h bigint, node bigint, n bigint")
            .repartition("h").dropDuplicates(["h", "node"]))


def _near_sizes(a, b):
    return F.least(a, b) * DOWN >= F.greatest(a, b) * UP


def _enough(n_a, n_b, shared):
    """The size-derived bound on overlaps among rarest shingles."""
    need = lambda n: F.least(F.lit(NEED), F.ceil(n * UP / DOWN))
    return shared >= F.least(need(n_a), need(n_b))


def weighted_lists(met: DataFrame) -> DataFrame:
    """``h, node, n, w``: the lists of ``met`` with two or more nodes; the ``w`` shingles
    that the same nodes share are one list, named by a digest of those nodes (two lists
    of one digest would only add candidates, and candidates are measured)."""
    by_shingle = Window.partitionBy("h")
    same = F.xxhash64(F.count("*").over(by_shingle), F.bit_xor(F.xxhash64("node")).over(by_shingle))
    return (met.select(same.alias("h"), "node", "n", F.count("*").over(by_shingle).alias("c")).where("c > 1")
            .groupBy("h", "node", "n").agg(F.count("*").alias("w")))


def overlap_bound(n_a, n_b):
    """Least number of rarest shingles two linked sets share (of sizes, or arrays of them).

    Linked sets overlap by at least t / (1 + t) of the sum of their sizes.  Of the set whose
    rarest shingles end first in the global order, every overlap among them is also among the
    other's, so all that a shared count can lack is what that set holds beyond them."""
    overlap = -(-UP * (n_a + n_b) // (DOWN + UP))
    most = required(np.maximum(n_a, n_b))
    return np.maximum(1, overlap - most + np.minimum(NEED, most))


def _bounded(n_a, n_b):
    """``overlap_bound`` as a column."""
    overlap = F.ceil((n_a + n_b) * UP / (DOWN + UP))
    most = F.ceil(F.greatest(n_a, n_b) * UP / DOWN)
    return F.greatest(F.lit(1), overlap - most + F.least(F.lit(NEED), most))


def _apart(live: DataFrame, root: DataFrame | None) -> DataFrame:
    """The lists that still hold more than one component, with each node's ``root`` and
    the number of nodes ``g`` of the list."""
    rooted = live.withColumn("root", F.col("node")) if root is None else \
        live.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = (rooted.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("g"))
             .where("r0 != r1").select("h", "g"))
    return stash(rooted.join(apart, "h").select("h", "node", "n", "w", "root", "g"), "apart")


def hub_pairs(apart: DataFrame, turn: int) -> DataFrame:
    """At most two candidates per node: for each of two rows of size classes, the hub it
    shares most lists with.

    A class is as wide as the threshold lets linked sizes differ, and the second row is
    shifted by half a class, so near sizes meet in one of them.  A list's hub in a class is,
    in the first turn, the node of which most is shared with any other: of many near copies
    the one with the fewest changes of its own.  Later turns take another node by hash.
    Members of the hub's component are passed over."""
    size = F.log(F.col("n").cast("double")) / math.log(DOWN / UP)
    t = F.sum("w").over(Window.partitionBy("node"))
    each = apart.withColumn("share", t / F.col("n") if turn == 0 else F.lit(0.0)) \
        .select("*", F.posexplode(F.array(F.floor(size), F.floor(size + 0.5))).alias("o", "size"))
    rank = F.struct("share", F.xxhash64("node", F.lit(turn)).alias("r"), F.col("node").alias("hub"),
                    F.col("n").alias("hub_n"), F.col("root").alias("hub_root"))
    hub = each.groupBy("h", "o", "size").agg(F.max(rank).alias("x")) \
        .select("h", "o", "size", "x.hub", "x.hub_n", "x.hub_root")
    met = (each.join(hub, ["h", "o", "size"])
           .where((F.col("root") != F.col("hub_root")) & _near_sizes(F.col("n"), F.col("hub_n")))
           .groupBy("node", "n", "o", "hub", "hub_n").agg(F.sum("w").alias("shared"))
           .where(_enough(F.col("n"), F.col("hub_n"), F.col("shared"))))
    return (met.groupBy("node", "n", "o").agg(F.max(F.struct("shared", "hub", "hub_n")).alias("m"))
            .select(F.greatest("node", "m.hub").alias("a"), F.least("node", "m.hub").alias("b")).distinct())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each block (equal h, x, y; sorted), as arrays; ``slots`` is a row per node."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        got = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c != "slots"}
        lists = b.column("slots")
        flat, slots = lists.flatten(), np.zeros((b.num_rows, SLOTS), dtype=np.int64)
        at = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        slots[at, flat.field("slot").to_numpy(zero_copy_only=False)] = flat.field("w").to_numpy(zero_copy_only=False)
        got["slots"] = slots
        if rest is not None:
            got = {c: np.concatenate([rest[c], v]) for c, v in got.items()}
        new = np.zeros(len(got["h"]), dtype=bool)
        for c in ("h", "x", "y"):
            new[1:] |= got[c][1:] != got[c][:-1]
        edges = [0, *np.flatnonzero(new).tolist()]
        for i, j in zip(edges, edges[1:]):
            yield {c: v[i:j] for c, v in got.items()}
        rest = {c: v[edges[-1]:] for c, v in got.items()}
    if rest is not None:
        yield rest


#: Rows of a block that meet the rest of it at once, and pairs whose slots are compared at once.
TILE, PAIRS = 128, 16_384


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each block from different components and of near sizes whose slot weights
    can add up to the bound: the lesser weight of each slot, summed, is at least what both share."""
    schema = pa.schema([("a", pa.int64()), ("n_a", pa.int64()), ("b", pa.int64()), ("n_b", pa.int64()),
                        ("w", pa.int64())])
    for g in _runs(batches):
        n, node, root, part, slots, w = (g[c] for c in ("n", "node", "root", "part", "slots", "w"))
        t, low, across = slots.sum(axis=1), np.searchsorted(n * DOWN, n * UP), g["x"][0] != g["y"][0]
        for i in range(0, len(n), TILE):
            one = np.arange(i, min(i + TILE, len(n)))[:, None]
            two = np.arange(low[i], one[-1, 0])[None]
            ok = (two < one) & (two >= low[one]) & (root[one] != root[two])
            if across:
                ok &= part[one] != part[two]
            ok &= np.minimum(t[one], t[two]) >= overlap_bound(n[one], n[two])
            p, q = np.nonzero(ok)
            p, q = p + i, q + low[i]
            for k in range(0, len(p), PAIRS):
                a, b = p[k:k + PAIRS], q[k:k + PAIRS]
                fit = np.minimum(slots[a], slots[b]).sum(axis=1) >= overlap_bound(n[a], n[b])
                a, b = a[fit], b[fit]
                if len(a):
                    first = node[a] > node[b]
                    a, b = np.where(first, a, b), np.where(first, b, a)
                    yield rows(schema, a=node[a], n_a=n[a], b=node[b], n_b=n[b], w=np.minimum(w[a], w[b]))


def remaining_pairs(apart: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every pair from different components whose shared rarest shingles, summed over
    all blocks, reach the bound.

    Every row carries its node's list weights summed by ``SLOTS`` hashed slots, so most pairs
    are discarded where they would be formed.  A list of more than ``block`` nodes is cut into
    parts, and each two of them meet in a block of their own."""
    slot = F.pmod(F.xxhash64("h"), F.lit(SLOTS)).cast("int").alias("slot")
    slots = (apart.groupBy("node", slot).agg(F.sum("w").alias("w"))
             .groupBy("node").agg(F.collect_list(F.struct("slot", "w")).alias("slots")))
    parts = F.ceil(F.col("g") / F.lit(block)).cast("long")
    lists = (apart.join(slots, "node").withColumn("part", F.pmod(F.xxhash64("node"), parts))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
             .select("h", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"),
                     "part", "n", "node", "root", "w", "slots")
             .repartition("h", "x", "y").sortWithinPartitions("h", "x", "y", "n", "node"))
    met = lists.mapInArrow(_meet, "a bigint, n_a bigint, b bigint, n_b bigint, w bigint")
    return (met.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("w").alias("shared"))
            .where(F.col("shared") >= _bounded(F.col("n_a"), F.col("n_b"))).select("a", "b"))


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for x, y in zip(b.column("set_a"), b.column("set_b")):
            s, t = (np.frombuffer(v.as_buffer(), dtype=np.int64) for v in (x, y))
            both = np.concatenate([s, t])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            good.append(DOWN * same >= UP * (len(s) + len(t) - same))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], schema=_LINK)


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    one = sets.select(F.col("node").alias("a"), F.col("s").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("s").alias("set_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b") \
        .mapInArrow(_measure, "a bigint, b bigint")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.int64()), ("s", pa.binary())])
    for b in sliced(batches):
        yield rows(schema, node=b.column("node"), s=[s.tobytes() for s in shingle_sets(b.column("text"))])


def near_duplicates(docs: DataFrame, turns: int = TURNS, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Sets are of the distinct 5-word shingles of a whole text (A-Z lower-cased); two
    link at a Jaccard similarity of 0.75 or more.  component_id is the smallest
    doc_id reachable by links.  Null, empty and blank texts have no set and stand
    alone under their own id; rows with equal sets always link, also under one
    repeated id; null ids never name a component that has another.  An empty table
    gives no rows; other columns are ignored.
    """
    return row_components(docs, turns, block).select("doc_id", "n_shingles", "component_id")


def row_key(docs: DataFrame) -> Column:
    """What ``row_components`` names a row by: a 128-bit digest of its id and text."""
    id_ = F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(id_, F.coalesce(F.concat(F.lit(":"), docs["text"].cast("string")), F.lit("")))))


def row_components(docs: DataFrame, turns: int = TURNS, block: int = BLOCK) -> DataFrame:
    """``near_duplicates`` with the ``row`` (``row_key``) and the ``root`` of its component
    (null: a row without a set, alone); ids, null or repeated, name neither."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("row", row_key(own))
    sketch = stash(own.select("doc_id", "row", "text").mapInArrow(_sketch, "doc_id bigint, row binary, n bigint, node bigint"), "sketch")
    nodes = stash(sketch.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min("row").alias("row")), "nodes")
    # a list is the nodes that hold some of their rarest shingles in common; lists of one are dropped
    live = stash(weighted_lists(incidence(own, bucket_frequencies(own))), "lists")

    # whole sets of the nodes that stand in enough lists to pass the bound at all
    able = (live.groupBy("node", "n").agg(F.sum("w").alias("c"))
            .where(F.col("c") >= F.least(F.lit(NEED), F.ceil(F.col("n") * UP / DOWN))).select("node"))
    bearer = nodes.select("node", "row").join(able, "node", "left_semi")
    texts = own.select("row", "text").dropDuplicates(["row"]).join(bearer, "row").select("node", "text")
    sets = stash(texts.mapInArrow(_sets, "node bigint, s binary"), "sets")

    found, root = None, None
    for turn in [*range(turns), None]:
        # before the first turn every list holds as many components as nodes
        apart = live.withColumn("root", F.col("node")) if turn == 0 else _apart(live, root)
        new = stash(links(remaining_pairs(apart, block) if turn is None else hub_pairs(apart, turn), sets), "links")
        if root is not None and new.isEmpty():
            continue
        root = components(new if found is None else found.unionByName(new))
        found = root.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b")
    least = (nodes.select("node", "least").join(root, "node")
             .groupBy("root").agg(F.min("least").alias("component_id")))
    of_node = root.join(least, "root").select("node", "root", "component_id")
    # equal sets: the node's least id; narrow rows, and a join that Spark splits when copies crowd one node
    named = nodes.select("node", "least").join(of_node, "node", "left") \
        .select("node", F.coalesce("root", "node").alias("root"),
                F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return (sketch.select("doc_id", "row", "n", "node").join(named, "node", "left")
            .select("doc_id", "row", "root", F.col("n").alias("n_shingles"),
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
