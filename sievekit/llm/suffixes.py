"""Exact removal of repeated strings with a distributed difference-cover scheme.

A string of ``length`` bytes is repeated when it starts at two places of the
corpus.  The steps are those of difference-cover suffix sorting:

1. *Cover.*  Sample positions are taken such that any two equal strings hold a
   sample at the same offset, which is what a difference cover is for.  The cover
   is chosen by content (the least name among the ``gram`` names of a string, the
   leftmost of equal ones), so a string holds few samples; a cover by position
   modulo three holds two thirds of all positions.
2. *Names of triples.*  Eight bytes have a name; the name of a longer string is
   the name of the triple of names of three strings that cover it, and so on
   upward (8, 24, 72, then the full length).  Names are fingerprints, equal in
   every task, so no level needs a sort of its own; whole strings have 128 bits.
3. *Sort.*  Each sample carries the triple (name of the first string it stands
   for, its own name, name of the last one).  Equal triples meet in a shuffle;
   they settle all strings of a sample at once.  A sample whose name no other
   has settles its strings too: none repeats.
4. *Recursion.*  Samples whose name is shared but whose triple is not are cut
   into runs of ``STEP`` strings, which are named and meet in the same way.
5. *Merge.*  The strings of runs still open are the remaining suffixes, each
   with the name of its prefix of ``length`` bytes; they meet, and prefixes that
   are equal to a neighbour's are repeated.

Every string is decided by exactly one of these.  Texts are read whole; those of
any length are worked on in overlapping parts of ``PART`` bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm._common import CLEANUP, discard, rows, stash
from sievekit.llm._words import U64, utf8
from sievekit.session import ensure_checkpoint_dir

LENGTH = 200
#: String starts worked on at once, and strings of a run in the second round.
PART, STEP = 1 << 19, 8

#: Odd multipliers of the two lanes of a name.
_MUL = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD),
        (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _mix(x: np.ndarray, lane: int) -> np.ndarray:
    x ^= x >> U64(32)
    x *= U64(_MUL[lane][3])
    x ^= x >> U64(29)
    return x


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray, lane: int) -> np.ndarray:
    """The name of a triple of names."""
    out = a * U64(_MUL[lane][0])
    out += b * U64(_MUL[lane][1])
    out ^= out >> U64(31)
    out += c * U64(_MUL[lane][2])
    return _mix(out, lane)


def levels(length: int) -> list[int]:
    """Lengths of the strings that get names: 8, 24, 72 …, then ``length``."""
    if length < 16:
        raise ValueError("strings of less than 16 bytes are not supported")
    out = [8]
    while out[-1] * 3 < length:
        out.append(out[-1] * 3)
    return out + [length]


def gram_size(length: int) -> int:
    """The longest named length that leaves a sample room: at most half a string."""
    return max(n for n in levels(length)[:-1] if 2 * n <= length)


def _parts_of(n: int, size: int) -> tuple[int, int, int]:
    """Offsets of three strings of ``size`` bytes that cover one of ``n``."""
    return 0, (n - size) // 2, n - size


class Strings:
    """Names of the strings of joined bytes; ``stops`` are the ends of the texts in them."""

    def __init__(self, raw: np.ndarray, stops: np.ndarray, length: int):
        self.length, self.levels, self.gram = length, levels(length), gram_size(length)
        raw = np.ascontiguousarray(raw)
        self.eight = np.ndarray((max(len(raw) - 7, 0),), dtype="<u8", buffer=raw, strides=(1,)) if len(raw) > 7 \
            else np.zeros(0, dtype=U64)
        self.n = max(len(raw) - length + 1, 0)
        ends = np.repeat(stops, np.diff(stops, prepend=0))
        self.valid = np.arange(self.n) + length <= ends[:self.n]

    def name(self, at: np.ndarray, lane: int, size: int | None = None) -> np.ndarray:
        """Names of the ``size`` bytes that start at ``at``."""
        size = size or self.length
        if size == 8:
            return _mix(self.eight[at] * U64(_MUL[lane][0]) + U64(_MUL[lane][1]), lane)
        below = max(n for n in self.levels if n < size)
        return _triple(*(self.name(at + o, lane, below) for o in _parts_of(size, below)), lane)

    def gram_names(self) -> np.ndarray:
        """Lane 0 names of the gram at every place."""
        size, h = 8, _mix(self.eight * U64(_MUL[0][0]) + U64(_MUL[0][1]), 0)
        while size < self.gram:
            n = len(h) - 2 * size
            h = _triple(h[:n], h[size:size + n], h[2 * size:], 0)
            size *= 3
        return h

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, at, name): strings ``first..last`` belong to the sample at ``at``."""
        if not self.n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none.astype(U64)
        grams = self.gram_names()
        # 40 bits of the name, then the place: the least is the leftmost of the least names
        low = (grams >> U64(24) << U64(24)) | np.arange(len(grams), dtype=U64)
        width, have = self.length - self.gram + 1, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[:len(low) - step], low[step:])
            have += step
        at = (low[:self.n] & U64((1 << 24) - 1)).astype(np.int64)
        live = np.flatnonzero(self.valid)
        if not len(live):
            return live, live, live, live.astype(U64)
        cut = np.flatnonzero((np.diff(at[live]) != 0) | (np.diff(live) != 1))
        first, last = live[np.concatenate([[0], cut + 1])], live[np.concatenate([cut, [len(live) - 1]])]
        return first, last, at[first], grams[at[first]]

    def runs(self, first: np.ndarray, last: np.ndarray, lane: int) -> np.ndarray:
        """Names of whole runs: the triple of their first string, their length and their last string."""
        return _triple(self.name(first, lane), (last - first).astype(U64) + U64(1), self.name(last, lane), lane)


def _cut_runs(first: np.ndarray, last: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Cut runs where the distance to the sample is a multiple of ``step``, so equal strings are cut alike:
    (number of the run, first, last, least place that all strings such a run may have reach)."""
    lo, hi = (at - last) // step, (at - first) // step
    n = hi - lo + 1
    of = np.repeat(np.arange(len(first)), n)
    k = np.repeat(lo, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return (of, np.maximum(first[of], at[of] - (k + 1) * step + 1), np.minimum(last[of], at[of] - k * step),
            at[of] - k * step)


def _pieces(batches: Iterator[pa.RecordBatch], length: int, extra: tuple[str, ...] = (), size: int = PART):
    """Joined texts of about ``size`` bytes: (Strings, row numbers, their starts in the join and in their
    text, the batch).  Parts of one text overlap, each string starts in one of them."""
    for b in batches:
        off, raw = utf8(b.column("text"))
        todo: list[tuple[int, int, int]] = []
        held = 0
        for r in range(b.num_rows):
            a, e = int(off[r]), int(off[r + 1])
            while a < e:
                stop = min(e, a + size + length - 1)
                todo.append((r, a, stop))
                held += stop - a
                if held >= size:
                    yield _joined(raw, off, todo, length, b)
                    todo, held = [], 0
                if stop == e:
                    break
                a += size
        if todo:
            yield _joined(raw, off, todo, length, b)


def _joined(raw, off, todo, length, batch):
    r, a, e = (np.array(x, dtype=np.int64) for x in zip(*todo))
    stops = np.cumsum(e - a)
    data = np.concatenate([raw[i:j] for _, i, j in todo])
    return Strings(data, stops, length), r, stops - (e - a), a - off[r], batch


def _place(starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The part each joined place lies in."""
    return np.searchsorted(starts, first, side="right") - 1


FOUND = "key binary, name bigint, f0 bigint, f1 bigint, n int, first bigint, last bigint"
_FOUND = pa.schema([("key", pa.binary()), ("name", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()),
                    ("n", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])


def _named(batch, row, name, f0, f1, first=None) -> pa.RecordBatch:
    """Rows of runs still to be settled, ``n`` being 2 where a text has more than one copy.  Without
    ``first``, runs of one text with the same triple become one row (``n`` 2)."""
    copies = np.minimum(batch.column("copies").to_numpy(zero_copy_only=False), 2).astype(np.int64)
    if first is None:
        order = np.lexsort((f1, f0, row))
        row, name, f0, f1 = row[order], name[order], f0[order], f1[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (f0[1:] != f0[:-1]) | (f1[1:] != f1[:-1])
        start = np.flatnonzero(new)
        n = np.minimum(np.diff(np.append(start, len(row))) * copies[row[start]], 2)
        row, name, f0, f1 = row[start], name[start], f0[start], f1[start]
        at = pa.nulls(len(row), pa.int64())
    else:
        n, at = copies[row], pa.array(first)
    return rows(_FOUND, key=batch.column("key").take(pa.array(row)), name=name.view(np.int64), f0=f0.view(np.int64),
                f1=f1.view(np.int64), n=n.astype(np.int32), first=at, last=pa.nulls(len(row), pa.int64()))


def _settled(batch, row, first, last) -> pa.RecordBatch:
    """Rows of repeated runs, in places of their text; runs that touch become one."""
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (first[1:] != last[:-1] + 1)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(row)) - 1
    none = pa.nulls(len(a), pa.int64())
    return rows(_FOUND, key=batch.column("key").take(pa.array(row[a])), name=none, f0=none, f1=none,
                n=pa.nulls(len(a), pa.int32()), first=first[a], last=last[z])


def _sampled(length: int):
    """Round 1: the triples of all samples."""
    def run(batches):
        for s, r, starts, _, b in _pieces(batches, length):
            first, last, _, name = s.samples()
            if len(first):
                yield _named(b, r[_place(starts, first)], name, s.runs(first, last, 0), s.runs(first, last, 1))
    return run


def _in_lists(row: np.ndarray, value: np.ndarray, lists: pa.Array) -> np.ndarray:
    """True where ``value[i]`` is in the list of row ``row[i]`` (rows ascend)."""
    out = np.zeros(len(row), dtype=bool)
    for r in np.unique(row):
        listed = lists[int(r)].values
        if listed is not None and len(listed):
            mine = slice(*np.searchsorted(row, [r, r + 1]))
            out[mine] = np.isin(value[mine], listed.to_numpy())
    return out


def _recursed(length: int, step: int, rounds: int):
    """Rounds 2 and 3.  ``whole1``/``open1`` list the settled and open samples of a text by their lane 0
    name, ``whole2``/``open2`` its runs of ``step`` strings.  Round 2 gives the settled samples and the runs
    of open ones, round 3 the settled runs and the strings of open ones."""
    def run(batches):
        for s, r, starts, skip, b in _pieces(batches, length):
            first, last, at, _ = s.samples()
            if not len(first):
                continue
            part = _place(starts, first)
            f0 = s.runs(first, last, 0).view(np.int64)
            open_ = _in_lists(r[part], f0, b.column("open1"))
            of, lo, hi, core = _cut_runs(first[open_], last[open_], at[open_], step)
            at, inner = at[open_][of], part[open_][of]
            if rounds == 2:
                whole = _in_lists(r[part], f0, b.column("whole1"))
            else:
                f0 = s.runs(lo, hi, 0).view(np.int64)
                whole, open_ = _in_lists(r[inner], f0, b.column("whole2")), _in_lists(r[inner], f0, b.column("open2"))
                first, last, part = lo, hi, inner
                lo = _cut_runs(first[open_], last[open_], at[open_], 1)[1]
                lo = np.sort(lo)
                inner = _place(starts, lo)
            if whole.any():
                order = np.flatnonzero(whole)[np.argsort(first[whole])]
                move = skip[part[order]] - starts[part[order]]
                yield _settled(b, r[part[order]], first[order] + move, last[order] + move)
            if not len(lo):
                continue
            if rounds == 2:
                # the name: bytes that lie in every string such a run may have, and how they lie to the sample
                shared = _triple(s.name(core, 0, s.gram), s.name(core - step + 1 + length - s.gram, 0, s.gram),
                                 (at - core).astype(U64), 0)
                yield _named(b, r[inner], shared, s.runs(lo, hi, 0), s.runs(lo, hi, 1))
            else:
                name = s.name(lo, 0)
                yield _named(b, r[inner], name, name, s.name(lo, 1), lo + skip[inner] - starts[inner])
    return run


def _settle(met: DataFrame, tag: str) -> DataFrame:
    """Let equal names meet.  Per text (``key``): names of its runs whose triple others have too
    (``whole``), and of those to be looked at more closely (``open``): their name is shared, their triple is
    not, or they stand for an equal triple that such runs must be compared with."""
    names = met.groupBy("name").agg(F.sum("n").alias("t")).where("t > 1").select("name")
    met, every = stash(met.join(names, "name", "left_semi").select("key", "name", "f0", "f1", "n"), tag), met
    if hasattr(every, "_stashed_at"):
        discard(every)
    classes = met.groupBy("name", "f0", "f1").agg(F.sum("n").alias("total"), F.min("key").alias("stands"))
    mixed = (classes.groupBy("name").agg(F.count("*").alias("classes"), F.count_if(F.col("total") == 1).alias("alone"))
             .where("classes > 1 and alone > 0").select("name", F.lit(True).alias("mixed")))
    state = classes.join(mixed, "name", "left")
    seen = (met.select("key", "name", "f0", "f1").join(state, ["name", "f0", "f1"])
            .select("key", "f0", (F.col("total") > 1).alias("whole"),
                    (F.col("mixed") & ((F.col("total") == 1) | (F.col("key") == F.col("stands")))).alias("open")))
    return (seen.where("whole or open").groupBy("key")
            .agg(F.collect_set(F.when(F.col("whole"), F.col("f0"))).alias("whole"),
                 F.collect_set(F.when(F.col("open"), F.col("f0"))).alias("open")))


def _texts(docs: DataFrame, length: int) -> DataFrame:
    """Distinct texts of at least ``length`` bytes as a table bucketed by ``key``, so that what is
    found about them joins without moving them again: (key, text, copies)."""
    spark = docs.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = (docs.where(F.octet_length("text") >= length).groupBy("key")
             .agg(F.first("text").alias("text"), F.count("*").alias("copies")))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        found.write.bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.table(name)


def repeated_runs(texts: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """``key, first, last``: runs of places where a repeated string starts, for ``texts`` as ``_texts`` gives
    them; texts with copies offer their strings and are left out of the result (every string of theirs repeats)."""
    step = max(1, min(step, (length - gram_size(length)) // 2))  # so that strings of a run share a gram
    first = stash(texts.select("key", "text", "copies").mapInArrow(_sampled(length), FOUND), "triples")
    one = stash(_settle(first, "shared").select("key", F.col("whole").alias("whole1"), F.col("open").alias("open1")), "round1")
    two = stash(texts.join(one, "key").select("key", "text", "copies", "whole1", "open1")
                .mapInArrow(_recursed(length, step, 2), FOUND), "round2")
    lists = stash(_settle(two.where("f0 is not null"), "shared")
                  .select("key", F.col("whole").alias("whole2"), F.col("open").alias("open2")).join(one.drop("whole1"), "key"), "lists")
    three = stash(texts.join(lists, "key").select("key", "text", "copies", "open1", "whole2", "open2")
                  .mapInArrow(_recursed(length, step, 3), FOUND), "round3")
    strings = three.where("f0 is not null")
    equal = strings.groupBy("f0", "f1").agg(F.sum("n").alias("t")).where("t > 1").select("f0", "f1")
    last = strings.join(equal, ["f0", "f1"], "left_semi").select("key", "first", F.col("first").alias("last"))
    runs = [d.where("f0 is null").select("key", "first", "last") for d in (two, three)]
    return runs[0].unionByName(runs[1]).unionByName(last)


REMOVED = "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
_REMOVED = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                      ("kept", pa.binary())])


def _remove(length: int, keep: bool):
    def run(batches):
        for b in batches:
            off, raw = utf8(b.column("text"))
            out = []
            for r, runs in enumerate(b.column("runs")):
                first = np.sort(runs.values.field("first").to_numpy())
                # the strings of a run end `length` after its last place; ends ascend with the places
                end = np.sort(runs.values.field("last").to_numpy()) + length
                new = np.ones(len(first), dtype=bool)
                new[1:] = first[1:] > end[:-1]
                a, z = first[new], end[np.append(np.flatnonzero(new)[1:], len(first)) - 1]
                text, at, kept = raw[off[r]:off[r + 1]].tobytes(), 0, []
                for i, j in zip(a.tolist(), z.tolist()):
                    kept.append(text[at:i])
                    at = j
                kept = b"".join([*kept, text[at:]])
                out.append((int((z - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept if keep else None))
            n, spans, digest, kept = (list(x) for x in zip(*out)) if out else ([], [], [], [])
            yield rows(_REMOVED, key=b.column("key"), n_removed=n, n_spans=spans, kept_sha256=digest, kept=kept)
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): n_bytes, n_removed, n_spans, kept_sha256, and with
    ``keep_bytes`` the remaining bytes as ``kept``.

    A byte goes when a string of ``length`` bytes that covers it also starts at another place of any text, its
    own included; strings are judged on the input.  Texts are their UTF-8 bytes, null and empty ones have none
    and lose none; strings never cross rows.  Equal texts of ``length`` bytes or more, also rows repeated
    whole, are removed in full, each of them.  Null ids are rows like any other, an id may occur twice; other
    columns are not read, whatever their names.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("key", F.unhex(F.md5("text")))
    texts = _texts(base, length)
    runs = (repeated_runs(texts, length)
            .groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs")))
    cut = (texts.where("copies = 1").join(stash(runs, "runs"), "key").select("key", "text", "runs")
           .mapInArrow(_remove(length, keep_bytes), REMOVED))
    gone = texts.where("copies > 1").select(
        "key", F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
    found = stash(cut.unionByName(gone), "removed")
    n = F.octet_length(base["text"]).cast("long")
    whole: Column = F.coalesce(found["kept_sha256"], F.sha2(base["text"].cast("binary"), 256))
    kept = [F.coalesce(found["kept"], base["text"].cast("binary")).alias("kept")] if keep_bytes else []
    return base.join(found, "key", "left").select(
        "doc_id", n.alias("n_bytes"),
        F.when(found["n_removed"] < 0, n).otherwise(F.coalesce(found["n_removed"], F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce(found["n_spans"], F.lit(0)).cast("long").alias("n_spans"), whole.alias("kept_sha256"), *kept)
