"""Merkle manifest of a table, proved with octopus multiproofs.

Rows are the leaves of one tree per source, in order of ``doc_id``; the roots of
these trees, in order of source, are the leaves of a top tree.  An inner node is
the digest of up to ``ARITY`` consecutive nodes.

* *Manifest.*  Rows are range-sorted, so a hot source spreads over many tasks;
  places come from the partition counts.  Each level of all trees is one
  aggregation, a sixteenth of the level below.
* *Octopus.*  A leaf partition holds up to ``BLOCK`` consecutive leaves, of one
  or many sources.  It works out the least set of nodes that it can not derive
  from its own leaves (``missing``), in the trees of its sources and in the top
  tree.  These coordinates are fetched by one join.  From its leaves and the
  fetched nodes the partition derives every inner node on its paths once, and
  cuts each leaf's proof out of the joined digests of its runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm._common import rows, stash

ARITY, BLOCK = 16, 4096
#: The tree over the roots of the sources.
TOP = -1
#: Nodes wanted by more partitions than this are copied, so that not all requests for one meet in a task.
COPIES_AT, COPIES = 4096, 64
UPPER, FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    """One value of a leaf: ``-`` for null, else its length in bytes, ``:`` and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def depth(n: int) -> int:
    """Levels above the leaves of a tree of ``n``."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def missing(places: np.ndarray, n: int) -> list[np.ndarray]:
    """Per level below the root, the least set of nodes needed besides the leaves at ``places``
    (ascending) to derive the root of a tree of ``n`` leaves."""
    out = []
    while n > 1:
        runs = np.unique(places // ARITY)
        need = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append(np.setdiff1d(need[need < n], places, assume_unique=True))
        places, n = runs, -(-n // ARITY)
    return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Paths:
    """The nodes above some leaves of one tree, derived once from them and the fetched ones."""

    def __init__(self, places: np.ndarray, digests: list[str], n: int, fetched: dict[tuple[int, int], str]):
        self.n, self.joined = n, []
        known, level = dict(zip(places.tolist(), digests)), 0
        while n > 1:
            runs = np.unique(places // ARITY)
            joined = {}
            for run in runs.tolist():
                members = range(run * ARITY, min(run * ARITY + ARITY, n))
                joined[run] = "".join(known[i] if i in known else fetched[level, i] for i in members)
            self.joined.append(joined)
            known = {run: _sha(text) for run, text in joined.items()}
            places, n, level = runs, -(-n // ARITY), level + 1
        self.root = known[0]

    def proof(self, place: int) -> list[str]:
        """Joined siblings of a leaf, level by level."""
        out = []
        for joined in self.joined:
            run, at = divmod(place, ARITY)
            out.append(joined[run][:64 * at] + joined[run][64 * at + 64:])
            place = run
        return out


def fold(node: str, place: int, proof: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for siblings in proof:
        place, at = divmod(place, ARITY)
        node = _sha(siblings[:64 * at] + node + siblings[64 * at:])
    return node


def placed_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, tampered, source, sid, place, n, at``: each row with its tree (``sid``, sources in
    order), its place among the ``n`` leaves of it and its place ``at`` among all."""
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    named = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.when(altered & text.isNotNull(), digest(*named, field(F.translate(text, UPPER, FOLDED))))
    raw = docs.select("doc_id", source.alias("source"), digest(*named, field(text)).alias("leaf"), lower.alias("tampered"))
    keys = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf"]
    sorted_ = stash(raw.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .withColumn("_id", F.monotonically_increasing_id()), "leaves")
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    leaves = sorted_.withColumn("part", part).withColumn("_in", at).drop("_id")
    held = stash(leaves.groupBy("part", "source").agg(F.count("*").alias("m"), F.min("_in").alias("low")), "held")
    # one row a partition: how many rows lie before it
    before = held.groupBy("part").agg(F.sum("m").alias("m")).select(
        "part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))
    held = held.join(F.broadcast(before), "part").withColumn("first", F.col("before") + F.col("low"))
    trees = held.groupBy("source").agg(F.sum("m").alias("n"), F.min(F.struct("first", "part")).alias("s"))
    trees = trees.select("source", "n", F.col("s.first").alias("start"), F.col("s.part").alias("part"))
    # sources in order: those that begin in earlier partitions, then by start
    earlier = trees.groupBy("part").agg(F.count("*").alias("m")).select(
        "part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("earlier"))
    trees = trees.join(F.broadcast(earlier), "part").withColumn(
        "sid", F.col("earlier") + F.row_number().over(Window.partitionBy("part").orderBy("start")) - 1)
    h, t = held.alias("h"), trees.drop("part").alias("t")
    held = stash(h.join(t, F.col("h.source").eqNullSafe(F.col("t.source")))
                 .select("h.part", "h.source", "h.before", "t.sid", "t.n", "t.start"), "trees")
    a, b = leaves.alias("a"), held.alias("b")
    here = F.col("b.before") + F.col("a._in")
    # equal on (part, source): no more rows of a key than a partition holds
    return stash(a.join(b, (F.col("a.part") == F.col("b.part")) & F.col("a.source").eqNullSafe(F.col("b.source")))
                 .select("a.doc_id", "a.leaf", "a.tampered", "a.source", "b.sid", (here - F.col("b.start")).alias("place"),
                         "b.n", here.alias("at")), "placed")


def _grown(level: DataFrame, most: int) -> list[DataFrame]:
    """All levels of trees given as ``sid, n, level, place, node``, the leaves first; ``n`` counts the nodes
    of the tree on the level, ``most`` those of the largest tree."""
    out = [level]
    while most > 1:
        up = (out[-1].where("n > 1").groupBy("sid", "n", "level", F.floor(F.col("place") / ARITY).cast("bigint").alias("up"))
              .agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("run")))
        up = up.select("sid", F.ceil(F.col("n") / ARITY).cast("bigint").alias("n"), (F.col("level") + 1).alias("level"),
                       F.col("up").alias("place"), F.sha2(F.concat_ws("", F.col("run.node")).cast("binary"), 256).alias("node"))
        out.append(stash(up, "level"))
        most = -(-most // ARITY)
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """``sid, n, level, place, node``: every node of every tree; ``sid`` -1 is the top tree.  ``n`` counts the
    nodes of the tree on that level; a tree ends at the level where it is 1."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    own = _grown(leaves.select("sid", "n", F.lit(0).alias("level"), "place", F.col("leaf").alias("node")), most)
    roots = stash(_union([d.where("n = 1") for d in own]), "roots")
    n = roots.count()
    top = _grown(roots.select(F.lit(TOP).cast("bigint").alias("sid"), F.lit(n).cast("bigint").alias("n"),
                              F.lit(0).alias("level"), F.col("sid").alias("place"), "node"), n)
    return _union([*own, *top])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_WANT = pa.schema([("block", pa.int64()), ("sid", pa.int64()), ("level", pa.int32()), ("place", pa.int64())])


def _wanted(n_top: int):
    """A partition's leaves to the coordinates it can not derive."""
    def run(t: pa.Table) -> pa.Table:
        sid, place, n = (t.column(c).to_numpy() for c in ("sid", "place", "n"))
        trees = [(s, np.sort(place[sid == s]), int(n[sid == s][0])) for s in np.unique(sid)]
        trees.append((TOP, np.unique(sid), n_top))
        got = [(s, level, need) for s, mine, size in trees for level, need in enumerate(missing(mine, size))]
        k = [len(need) for _, _, need in got]
        where = np.concatenate([need for _, _, need in got]) if got else np.zeros(0, dtype=np.int64)
        return pa.Table.from_batches([rows(
            _WANT, block=np.full(len(where), t.column("block")[0].as_py()), place=where,
            sid=np.repeat([s for s, _, _ in got], k).astype(np.int64), level=np.repeat([x for _, x, _ in got], k).astype(np.int32))])
    return run


PROVED = ("doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean, source string, place bigint")
_PROVED = pa.schema([(x.split()[0], {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]])
                     for x in PROVED.split(", ")])


def _proved(n_top: int):
    """A partition's leaves and its fetched nodes to proofs."""
    def run(t: pa.Table, fetched: pa.Table) -> pa.Table:
        t = t.sort_by([("sid", "ascending"), ("place", "ascending")])
        nodes: dict[int, dict[tuple[int, int], str]] = {}
        for s, level, place, node in zip(*(fetched.column(c).to_pylist() for c in ("sid", "level", "place", "node"))):
            nodes.setdefault(s, {})[level, place] = node
        sid, place = t.column("sid").to_numpy(), t.column("place").to_numpy()
        leaf, tampered = t.column("leaf").to_pylist(), t.column("tampered").to_pylist()
        sizes, cuts = t.column("n").to_numpy(), np.flatnonzero(np.diff(sid, prepend=-2))
        trees = {}
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sid)]):
            trees[int(sid[i])] = Paths(place[i:j], leaf[i:j], int(sizes[i]), nodes.get(int(sid[i]), {}))
        top = Paths(np.array(list(trees)), [p.root for p in trees.values()], n_top, nodes.get(TOP, {}))
        out = {c: [] for c in ("subroot", "proof_sha256", "folded_root")}
        upper = {s: top.proof(s) for s in trees}
        for s, p, h in zip(sid.tolist(), place.tolist(), tampered):
            tree = trees[s]
            own = tree.proof(p)
            out["subroot"].append(tree.root)
            out["proof_sha256"].append(_sha("".join(own) + "".join(upper[s])))
            # an unaltered leaf folds along the nodes already derived; an altered one has a path of its own
            out["folded_root"].append(top.root if h is None else fold(fold(h, p, own), s, upper[s]))
        return pa.Table.from_batches([rows(
            _PROVED, doc_id=t.column("doc_id").combine_chunks(), leaf=leaf, root=[top.root] * len(leaf), place=place,
            source=t.column("source").to_pylist(), verified=[f == top.root for f in out["folded_root"]], **out)])
    return run


def prove(leaves: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Proofs of ``leaves`` (all of a manifest's, or any part of them) against its ``nodes``."""
    n_top = nodes.where(F.col("sid") == TOP).agg(F.max("n")).first()[0] or 0
    mine = leaves.withColumn("block", F.floor(F.col("at") / block).cast("bigint"))
    want = stash(mine.select("block", "sid", "place", "n").groupBy("block").applyInArrow(
        _wanted(n_top), "block bigint, sid bigint, level int, place bigint"), "wanted")
    # a node high in a large tree is wanted by each partition below it
    spread = F.col("asked") > COPIES_AT
    asked = want.groupBy("sid", "level", "place").agg(F.count("*").alias("asked"))
    found = nodes.select("sid", "level", "place", "node").join(asked, ["sid", "level", "place"])
    found = stash(found, "found")
    hot = found.where(spread).select("sid", "level").distinct().withColumn("hot", F.lit(True))
    wide = found.join(hot, ["sid", "level"], "left")
    wide = wide.withColumn("copy", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))))
    want = want.join(hot, ["sid", "level"], "left").withColumn(
        "copy", F.when(F.col("hot"), F.pmod("block", F.lit(COPIES)).cast("int")).otherwise(0))
    fetched = want.join(wide.select("sid", "level", "place", "copy", "node"), ["sid", "level", "place", "copy"])
    return (mine.groupBy("block").cogroup(fetched.select("block", "sid", "level", "place", "node").groupBy("block"))
            .applyInArrow(_proved(n_top), PROVED))


def verify_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id long, source, lang, n_chars, text): leaf, subroot, root, proof_sha256,
    folded_root and verified, where every row whose id's crc32 is divisible by 5 is checked with the
    upper-case ASCII letters of its text lowered; source and place (in its tree) follow.

    Nulls in any column are ``-`` in the leaf.  A null source is a tree of its own, the first.  Rows of one id
    go by leaf; rows equal throughout are leaves of their own side by side.  A null id or text is never
    altered; a text without such letters verifies.  Other columns are not read.  An empty table gives no rows.
    """
    leaves = placed_leaves(docs)
    return prove(leaves, manifest(leaves), block)
