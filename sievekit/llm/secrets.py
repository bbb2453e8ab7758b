"""Secret scans with a linear-chain conditional random field.

Tokens are tagged outside, begin or inside of a secret from their shape, the
words around them and features of the whole file, and decoded by Viterbi.  Fixed
patterns give the base spans; those of a bounded sample of texts are also the
labels the field is trained on, so it learns what secrets look like and finds
more where no pattern applies.  A text is decoded only if one of its tokens could
win against the all-outside path, which the weights decide exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sievekit.llm._common import rows, stash
from sievekit.llm._words import U64, Words, sliced

#: The base patterns, as the contract lists them, in the order of its kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")

O, B, I = 0, 1, 2
#: Tokens to either side of the middle of a training window.
HALF = 12
#: Training windows with and without a base span, at most.
SAMPLE = 3000
WORD_BUCKETS = 1024

#: True where a byte parts tokens: all but letters, digits, + / _ - and non-ASCII.
PARTS = np.ones(256, dtype=bool)
PARTS[48:58] = PARTS[97:123] = PARTS[128:] = False
PARTS[[43, 45, 47, 95]] = False


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself), by start, then kind."""
    out = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _may_have_base(w: Words) -> np.ndarray:
    """Numbers of the texts a base pattern might match: a keyword, AKIA, or 32 hex digits in a row."""
    at: list[int] = []
    for data, needles in ((w.low.tobytes(), KEYWORDS), (w.raw.tobytes(), (b"AKIA",))):
        for n in needles:
            i = data.find(n)
            while i >= 0:
                at.append(i)
                i = data.find(n, i + 1)     # a match across two texts hides none in the second
    digit = _HEXDIGIT[w.raw]
    begin, finish = digit.copy(), digit.copy()
    begin[1:] &= ~digit[:-1]
    finish[:-1] &= ~digit[1:]
    full = w.off[1:] > w.off[:-1]           # runs end where their text ends
    begin[w.off[:-1][full]] = digit[w.off[:-1][full]]
    finish[w.off[1:][full] - 1] = digit[w.off[1:][full] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    at += starts[ends - starts >= 32].tolist()
    return np.unique(np.searchsorted(w.off, np.array(at, dtype=np.int64), side="right") - 1) if at else np.zeros(0, dtype=np.int64)


# --- features: each token has one id in each of these families ---------------
FAMILIES = (("length", 8), ("mix", 32), ("digits", 4), ("changes", 5), ("hexlike", 5), ("before", 8), ("after", 8),
            ("previous", WORD_BUCKETS), ("second", WORD_BUCKETS), ("next", WORD_BUCKETS), ("file_digits", 4),
            ("file_code", 4))
_OFFSET = np.concatenate([[0], np.cumsum([n for _, n in FAMILIES])])
N_FEATURES = int(_OFFSET[-1])

_CLASS = np.full(256, 4, dtype=np.uint8)          # lower, upper, digit, symbol, non-ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[43, 45, 47, 95]] = 0, 1, 2, 3
_HEXDIGIT = np.zeros(256, dtype=bool)
_HEXDIGIT[48:58] = _HEXDIGIT[97:103] = True
_EDGE = np.full(256, 7, dtype=np.uint8)           # what stands beside a token
for _k, _c in enumerate(("=", ":", "\"'`", " ", "\t\n\r", ".,;!?", "()[]{}<>")):
    _EDGE[list(_c.encode())] = _k


def features(w: Words) -> np.ndarray:
    """(tokens, families): feature ids of every token of a slice of texts."""
    n = len(w.starts)
    out = np.empty((n, len(FAMILIES)), dtype=np.int32)
    if not n:
        return out
    raw, lens = w.raw, w.ends - w.starts
    cls = _CLASS[raw]
    ahead = np.concatenate([[0], np.cumsum(cls == 2)])
    digits = ahead[w.ends] - ahead[w.starts]
    mix = np.zeros(n, dtype=np.int64)
    for k in range(5):
        c = np.concatenate([[0], np.cumsum(cls == k)])
        mix |= (c[w.ends] > c[w.starts]).astype(np.int64) << k
    turn = np.concatenate([[0], np.cumsum(np.concatenate([[False], cls[1:] != cls[:-1]]))])
    changes = turn[w.ends] - turn[np.minimum(w.starts + 1, w.ends)]
    hexes = np.concatenate([[0], np.cumsum(_HEXDIGIT[raw])])
    hexlike = np.where(hexes[w.ends] - hexes[w.starts] == lens, 1 + np.digitize(lens, [8, 16, 32]), 0)
    doc = np.repeat(np.arange(len(w.off) - 1), w.counts)
    first = w.starts == w.off[doc]
    last = w.ends == w.off[doc + 1]
    before = np.where(first, 7, _EDGE[raw[np.maximum(w.starts - 1, 0)]])
    after = np.where(last, 7, _EDGE[raw[np.minimum(w.ends, len(raw) - 1)]])
    bucket = 1 + (w.hashes() % U64(WORD_BUCKETS - 1)).astype(np.int64)
    near = {}
    for name, step in (("previous", -1), ("second", -2), ("next", 1)):
        v = np.zeros(n, dtype=np.int64)
        if step < 0:
            v[-step:] = np.where(doc[-step:] == doc[:step], bucket[:step], 0)
        else:
            v[:-step] = np.where(doc[:-step] == doc[step:], bucket[step:], 0)
        near[name] = v
    size = np.maximum(np.diff(w.off), 1)
    of_byte = np.repeat(np.arange(len(size)), np.diff(w.off))
    file_digits = np.digitize(np.bincount(of_byte[cls == 2], minlength=len(size)) / size, [0.005, 0.02, 0.1])
    code = np.isin(raw, np.frombuffer(b"={}[]();<>", dtype=np.uint8))
    file_code = np.digitize(np.bincount(of_byte[code], minlength=len(size)) / size, [0.002, 0.01, 0.05])
    cols = (np.digitize(lens, [3, 5, 8, 12, 16, 24, 40]), mix, np.digitize(digits / lens, [1e-9, 0.2, 0.5]),
            np.digitize(changes, [1, 2, 4, 8]), hexlike, before, after, near["previous"], near["second"], near["next"],
            file_digits[doc], file_code[doc])
    for k, c in enumerate(cols):
        out[:, k] = c + _OFFSET[k]
    return out


@dataclass
class Field:
    """Weights of a linear-chain CRF: (features, tags) and (tag before, tag)."""
    w: np.ndarray
    t: np.ndarray

    def emissions(self, f: np.ndarray) -> np.ndarray:
        e = np.zeros((len(f), 3))
        for k in range(f.shape[1]):
            e += self.w[f[:, k]]
        return e

    def can_win(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """True for tokens that might leave the outside tag on some best path: below 0 the
        bound shows that a path with the token outside is at least as good.  ``first``:
        numbers of the tokens that begin a text; no transition leads into these."""
        into = np.full(len(e), max(self.t[O, B], self.t[B, B], self.t[I, B], self.t[B, I], self.t[I, I]) - self.t[O, O])
        into[first] = 0.0
        leave = max(self.t[B, O], self.t[I, O]) - self.t[O, O]
        return np.maximum(e[:, B], e[:, I]) - e[:, O] + into + max(0.0, leave) > 0

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags of one token sequence; ties to the lower tag."""
        n = len(e)
        back = np.zeros((n, 3), dtype=np.int8)
        s = e[0] + np.array([0.0, 0.0, -1e9])
        for i in range(1, n):
            step = s[:, None] + self.t
            back[i] = step.argmax(axis=0)
            s = step.max(axis=0) + e[i]
        tags = np.empty(n, dtype=np.int8)
        tags[-1] = s.argmax()
        for i in range(n - 1, 0, -1):
            tags[i - 1] = back[i, tags[i]]
        return tags


def train(f: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.5, l2: float = 1e-3) -> Field:
    """Maximum conditional likelihood by full-batch AdaGrad.

    ``f``: (sequences, length, families) feature ids; ``y``: tags.  Deterministic.
    An inside tag can not follow an outside one."""
    n, length, _ = f.shape
    w, t = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    t[O, I] = -1e9
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    flat = f.reshape(-1, f.shape[2])
    gold = np.eye(3)[y]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    start = np.array([0.0, 0.0, -1e9])

    def logsum(x, axis):
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        e = sum(w[flat[:, k]] for k in range(flat.shape[1])).reshape(n, length, 3)
        a, b = np.empty((n, length, 3)), np.zeros((n, length, 3))
        a[:, 0] = e[:, 0] + start
        for i in range(1, length):
            a[:, i] = logsum(a[:, i - 1, :, None] + t[None], 1) + e[:, i]
        for i in range(length - 2, -1, -1):
            b[:, i] = logsum(t[None] + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
        z = logsum(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None])
        diff = (gold - p).reshape(-1, 3) / n
        grad = np.zeros_like(w)
        for k in range(flat.shape[1]):
            for tag in range(3):
                grad[:, tag] += np.bincount(flat[:, k], weights=diff[:, tag], minlength=N_FEATURES)
        grad -= l2 * w
        expect = np.zeros((3, 3))
        for i in range(1, length):
            expect += np.exp(a[:, i - 1, :, None] + t[None] + (e[:, i] + b[:, i])[:, None, :] - z[:, None, None]).sum(axis=0)
        tg = (pairs - expect) / n - l2 * np.where(t > -1e8, t, 0)
        tg[O, I] = 0
        gw += grad ** 2
        gt += tg ** 2
        w += rate * grad / np.sqrt(gw)
        t += rate * tg / np.sqrt(gt)
    return Field(w, t)


_WINDOW = pa.schema([("hit", pa.bool_()), ("order", pa.int64()), ("f", pa.list_(pa.int32())), ("y", pa.list_(pa.int8()))])


def _tags(w: Words, d: int, text: str, spans) -> np.ndarray:
    """Tags of the tokens of text d from its base spans: a token that overlaps a secret is in it."""
    a, e = int(w.first[d]), int(w.first[d + 1])
    y = np.zeros(e - a, dtype=np.int8)
    starts, ends = w.starts[a:e] - w.off[d], w.ends[a:e] - w.off[d]
    for _, _, end, start in spans:
        s, t = len(text[:start].encode()), len(text[:end].encode())
        i, j = int(np.searchsorted(ends, s, side="right")), int(np.searchsorted(starts, t, side="left"))
        if j > i:
            y[i] = y[i] or B
            y[i + 1:j] = I
    return y


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = 2 * HALF + 1
    for b in sliced(batches):
        w = Words(b.column("text"), PARTS)
        f, h, out = features(w), w.hashes(), []
        may = set(_may_have_base(w).tolist())
        for d, (text, order) in enumerate(zip(b.column("text").to_pylist(), b.column("order").to_pylist())):
            a, e = int(w.first[d]), int(w.first[d + 1])
            if e - a < span:
                continue
            y = _tags(w, d, text, base_spans(text)) if d in may else np.zeros(e - a, dtype=np.int8)
            at = np.flatnonzero(y == B)
            middle = int(at[0]) if len(at) else int(h[a] % U64(e - a))
            lo = min(max(middle - HALF, 0), e - a - span)
            out.append((bool(len(at)), order, f[a + lo:a + lo + span].ravel(), y[lo:lo + span]))
        if out:
            yield rows(_WINDOW, **dict(zip(_WINDOW.names, map(list, zip(*out)))))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Train on one window of each of at most ``sample`` distinct texts with a base span and as
    many without (those of smallest hash); None if no text has one.  A bound on the hash, taken
    from the counts, keeps about a tenth more than that before the smallest are chosen."""
    src = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("order"))
    win = stash(src.mapInArrow(_windows, "hit boolean, order bigint, f array<int>, y array<tinyint>")
                .where(F.col("hit") | (F.pmod("order", F.lit(8)) == 0)), "windows")
    place = F.pmod(F.xxhash64("order"), F.lit(1 << 30))
    count = {r["hit"]: r["n"] for r in win.groupBy("hit").agg(F.countDistinct("order").alias("n")).collect()}
    got = []
    for k in (True, False):
        part = min(1.0, (1.1 * sample + 64) / max(count.get(k, 0), 1))
        few = win.where((F.col("hit") == k) & (place < int(part * (1 << 30)))).dropDuplicates(["order"])
        got.append(few.orderBy(place, "order").limit(sample).select("f", "y").collect())
    if not got[0]:
        return None
    span = 2 * HALF + 1
    both = [*got[0], *got[1]]
    return train(np.array([r["f"] for r in both]).reshape(len(both), span, len(FAMILIES)), np.array([r["y"] for r in both]))


def field_spans(w: Words, model: Field) -> dict[int, list[tuple[int, int]]]:
    """Text number -> byte ranges (in the text) of the tagged secrets."""
    e = model.emissions(features(w))
    hot = np.flatnonzero(model.can_win(e, w.first[:-1][w.counts > 0]))
    out: dict[int, list[tuple[int, int]]] = {}
    for d in np.unique(np.searchsorted(w.first, hot, side="right") - 1).tolist():
        a, z = int(w.first[d]), int(w.first[d + 1])
        tags = model.viterbi(e[a:z])
        at = 0
        while at < len(tags):
            if tags[at] == B:
                end = at + 1
                while end < len(tags) and tags[end] == I:
                    end += 1
                out.setdefault(d, []).append((int(w.starts[a + at] - w.off[d]), int(w.ends[a + end - 1] - w.off[d])))
                at = end
            else:
                at += 1
    return out


def spans_of(batch_text: pa.Array, model: Field | None) -> list[list[tuple[str, int, int]]]:
    """All spans (kind, start, end in code points) of each text; the field's spans that
    touch a base span are part of it and not listed again."""
    w = Words(batch_text, PARTS)
    texts: dict[int, str] = {}
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(batch_text))]

    def text(d: int) -> str:
        if d not in texts:
            texts[d] = w.raw[w.off[d]:w.off[d + 1]].tobytes().decode("utf-8")
        return texts[d]
    for d in _may_have_base(w).tolist():
        out[d] = [s[:3] for s in base_spans(text(d))]
    if model is not None:
        for d, found in field_spans(w, model).items():
            data = text(d).encode()
            more = [("crf", len(data[:s].decode("utf-8", "ignore")), len(data[:t].decode("utf-8", "ignore"))) for s, t in found]
            more = [m for m in more if all(m[2] <= s[1] or m[1] >= s[2] for s in out[d])]
            out[d] = sorted(out[d] + more, key=lambda s: (s[1], KINDS.index(s[0])))
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, model: Field | None, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``found``: kind, start and end of every span of every whole
    text, in order.  Null and empty texts have none."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans_of(b.column("text"), handle.value)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found, _SPAN)], names=[*keep, "found"])
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([*(docs.schema[c] for c in keep), StructField("found", ArrayType(span))])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def redact(text, spans, mark: str = "[secret]"):
    """``text`` with every run of overlapping spans replaced by ``mark`` (a Column)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def cut(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.substr(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.when(fresh, F.concat(acc["text"], piece, F.lit(mark))).otherwise(acc["text"]).alias("text"),
                        F.greatest(acc["at"], s["end"]).alias("at"))
    done = F.aggregate(ordered, start, cut)
    return F.when(F.size(spans) > 0, F.concat(done["text"], F.substr(text, done["at"].cast("int") + 1))).otherwise(text)


def scan_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, found`` for every row.

    Null text is empty; without spans the digest is that of the empty string and
    ``spans`` is "".  Repeated rows give equal rows, an empty table none; other
    columns are ignored."""
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    found = find_secrets(own, fit(own, sample), ["doc_id"])
    show = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, show), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("found", show), ",").alias("spans"), "found")
