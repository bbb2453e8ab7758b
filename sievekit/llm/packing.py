"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Documents become token ids; longer ones than a sequence are cut.  Pieces are
dealt at random into blocks of bounded size, and every block is packed, longest
piece first, by the sum-of-squares rule: a piece goes into the open bin for which
the sum of the squared counts of open bins per residual gap becomes smallest,
ties to the tightest fit, and opens a bin only where none fits.  Bins that blocks
leave at most half full are items of a second, far smaller packing by the same
rule, so few sequences are lost to the blocking.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm._common import rows, stash
from sievekit.llm._words import sliced

SEQUENCE = 1024
END_ID = 2
#: Pieces a block holds on average; a bound on one task's work.
BLOCK = 50_000
#: Distinct text chunks a worker remembers before it starts anew (some 100 MB).
MEMORY = 1_000_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row string"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("row", pa.string())])

#: A blank that precedes a non-blank always starts a token of its own, so texts may
#: be cut there; blanks are those of both Python and the tokenizer's pattern.
CUT = re.compile(r"(?= \S)")


class ChunkEncoder:
    """Token ids of texts, from a public byte-level BPE.

    A text is cut at blanks that always part tokens, and the ids of each distinct
    chunk are remembered, so a corpus is merged about once per distinct word.
    Chunks that recur are ids of ``tokenizers``' vocabulary read as ranks by
    ``tiktoken`` (the same merges, several times faster on short strings).  ``added``
    tokens (content to id) are found first, as ``tokenizers`` does by default.
    """

    def __init__(self, ranks_path: str, added: dict[str, int] | None = None):
        import base64

        import public_tokenizers
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                         special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}
        self._added = {t: np.array([i], dtype="<u4").tobytes() for t, i in (added or {}).items()}
        longest = sorted(self._added, key=len, reverse=True)
        self._parts = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if longest else None

    def _cut(self, text: str) -> list[str]:
        if self._parts is None:
            return CUT.split(text)
        parts = self._parts(text)
        return CUT.split(text) if len(parts) == 1 else [c for p in parts for c in ([p] if p in self._added else CUT.split(p))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        cut = [self._cut(t) for t in texts]
        known = self._known
        if len(known) > MEMORY:
            known.clear()
        known.update(self._added)
        for new in set().union(*cut).difference(known) if cut else ():
            known[new] = np.array(self._encode(new), dtype="<u4").tobytes()
        return [b"".join(map(known.__getitem__, c)) for c in cut]


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens() -> dict[str, int]:
    """The added tokens of ``byte_bpe_50k.json`` that are plain strings, with their ids."""
    import json

    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        got = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in got):
        raise ValueError("added tokens that take in what stands around them are not supported")
    return {t["content"]: t["id"] for t in got}


def _cut_ids(ids: bytes, limit: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, bytes) of the pieces of one document; only the first is short."""
    n = len(ids) // 4
    at = 0
    first = n % limit or limit
    while at < n:
        size = first if at == 0 else limit
        yield at, size, ids[4 * at:4 * (at + size)]
        at += size


def pieces(docs: DataFrame, limit: int = SEQUENCE, ranks: str | None = None, keep_ids: bool = False,
           added: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, row`` (and ``ids`` binary): every
    document's ids and the end id, cut into pieces of at most ``limit`` where they
    are more.  ``row`` tells repeated ids apart.  Null text: the end id alone.
    ``added``: strings that are one token each (``added_tokens()``); without, they are plain text."""
    def cut(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = ChunkEncoder(ranks or default_ranks(), added)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in sliced(batches):
            out: list[tuple] = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc, row, ids in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), encode(texts)):
                for k, (at, size, part) in enumerate(_cut_ids(ids + end, limit)):
                    out.append((doc, k, at, size, zlib.crc32(part), row, part)[:7 if keep_ids else 6])
            names = [*_PIECES.names, "ids"]
            schema = _PIECES.append(pa.field("ids", pa.binary())) if keep_ids else _PIECES
            yield rows(schema, **dict(zip(names, map(list, zip(*out)))))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      F.concat(F.hex(F.xxhash64("doc_id", "text")), F.hex(F.xxhash64(F.lit(1), "text", "doc_id"))).alias("row"))
    return src.mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def sum_of_squares(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, in the order given.

    ``count[g]`` open bins have gap g.  Moving a bin from gap g to g - s changes
    the sum of squares by 2 (count[g - s] - count[g]) + 2, and filling it (a full
    bin is no longer open) by 1 - 2 count[g]; the smallest change wins, the
    tightest gap among equals.
    """
    count = np.zeros(limit + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(limit + 1)]
    where, offset, n_bins = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        have = count[s:limit]
        gap = limit
        if have.any():
            change = 2 * (count[:limit - s] - have) + 2
            change[0] = 1 - 2 * have[0]
            change[have == 0] = never
            gap = s + int(change.argmin())
        if gap == limit:
            b = n_bins
            n_bins += 1
        else:
            b = open_[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = b, limit - gap
        if gap - s:
            open_[gap - s].append(b)
            count[gap - s] += 1
    return where, offset


PLACED = "block long, item string, length long, bin long, offset long, used long"
_PLACED = pa.schema([("block", pa.int64()), ("item", pa.string()), ("length", pa.int64()), ("bin", pa.int64()),
                     ("offset", pa.int64()), ("used", pa.int64())])


def _pack_block(limit: int):
    def pack(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc
        table = table.take(pc.sort_indices(table, sort_keys=[("length", "descending"), ("item", "ascending")]))
        size = table.column("length").to_numpy()
        where, offset = sum_of_squares(size, limit)
        used = np.bincount(where, weights=size).astype(np.int64)[where]
        return pa.Table.from_arrays([table.column("block").combine_chunks(), table.column("item").combine_chunks(),
                                     table.column("length").combine_chunks(), pa.array(where), pa.array(offset),
                                     pa.array(used)], schema=_PLACED)
    return pack


def _blocked(items: DataFrame, n: int, per_block: int, limit: int) -> DataFrame:
    """Pack ``item, length`` in ceil(n / per_block) blocks, dealt by a hash of the name."""
    blocks = max(1, -(-n // per_block))
    dealt = items.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInArrow(_pack_block(limit), PLACED)


def pack(items: DataFrame, limit: int = SEQUENCE, per_block: int = BLOCK) -> DataFrame:
    """``item, sequence_id, offset`` for items with a ``length`` of 1 to ``limit``.

    Item names must differ.  Full-length items fill a sequence each and need no
    search.  An empty table gives no rows.
    """
    n = items.where(F.col("length") < limit).count()
    first = stash(_blocked(items.where(F.col("length") < limit), n, per_block, limit), "packed")
    bin_ = F.concat_ws(".", "block", "bin")
    bins = first.where("offset = 0").select(bin_.alias("item"), F.col("used").alias("length"))
    loose = bins.where(F.col("length") <= limit // 2)  # of two bins that can be joined, one is
    n_loose = loose.count()
    again = stash(_blocked(loose, n_loose, per_block, limit), "repacked")
    # a sequence's number: its block and bin, even in the first round, odd in the second; below 0 if it holds one item.
    # A block has no more bins than items, and these are about ``per_block``; 2^22 is far from that
    number = lambda odd: (F.col("block") * (1 << 22) + F.col("bin")) * 2 + odd
    to = again.select(F.col("item").alias("b"), number(1).alias("seq"), F.col("offset").alias("shift"))
    placed = (first.select("item", bin_.alias("b"), number(0).alias("own"), "offset").join(to, "b", "left")
              .select("item", F.coalesce("seq", "own").alias("sequence_id"),
                      (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")))
    whole = stash(items.where(F.col("length") == limit).select(
        "item", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")), "whole")
    return placed.unionByName(whole)


def pack_documents(docs: DataFrame, limit: int = SEQUENCE, per_block: int = BLOCK, ranks: str | None = None,
                   added: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Null and empty texts are a piece of one id.  A repeated row is packed as often
    as it occurs.  Other columns are ignored; an empty table gives no rows.
    """
    p = pieces(docs, limit, ranks, added=added)
    # a row that occurs more than once gives equal pieces: number them within their (rare) group
    w = stash(p, "pieces")
    copies = w.groupBy("row", "piece").agg(F.count("*").alias("n")).where("n > 1")
    once = w.join(copies, ["row", "piece"], "left_anti").withColumn("copy", F.lit(0).cast("long"))
    more = (w.join(copies, ["row", "piece"], "left_semi").groupBy("doc_id", "row", "piece", "start", "length", "ids_crc32")
            .agg(F.count("*").alias("n"))
            .select("doc_id", "piece", "start", "length", "ids_crc32", "row",
                    F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")))
    item = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "row", "piece", "copy")
    named = once.unionByName(more).withColumn("item", item)
    placed = pack(named.select("item", "length"), limit, per_block)
    return (named.join(placed, "item")
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))


def sequences(pieces_with_ids: DataFrame, placed: DataFrame) -> DataFrame:
    """``sequence_id, n_ids, ids`` (binary, little-endian 32-bit): the packed sequences
    themselves, from pieces with ``item, ids`` and their places; at most ``limit``
    pieces meet in a row."""
    p = pieces_with_ids.join(placed, "item")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = p.groupBy("sequence_id").agg(parts.alias("p"))
    whole = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return joined.select("sequence_id", whole.alias("ids")).withColumn("n_ids", F.octet_length("ids") / 4)
