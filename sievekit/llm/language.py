"""Language identification with language-bitmask n-gram filters.

Every language owns the character trigrams that are frequent in its training text and,
however rare, all that no other language uses far more.  All sets live in one bit-sliced Bloom filter, sized from the counted trigrams: a slot holds a bit
per language, and the AND of a trigram's slots is the bitmask of all languages
that contain it.  A text's trigrams vote; each language's popcount is
corrected for the rate of false positives its slots have, and the largest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sievekit.llm._common import fold_of, rows, stash
from sievekit.llm._words import U64, mix64, sliced

#: A trigram is frequent from this share of a language's trigrams on; a rarer one is owned
#: unless another language uses it more than FOREIGN times as much.
SHARE = 5e-5
FOREIGN = 2.0
#: Slots of the filter for each 64 languages, at least; slots for each trigram of the
#: language that has most; probes for each trigram.
SLOTS = 1 << 20
PER_GRAM = 16
PROBES = 4
#: Trigrams the driver takes in at a time, about.
MET = 4_000_000

UND = "und"


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """A code per code point: letters fold to their lower case, all else is 0; a
    combining mark has a code too, as scripts spell with them.  Second: what is a letter."""
    import sys
    import unicodedata
    table, letter = np.zeros(sys.maxunicode + 1, dtype=np.uint32), np.zeros(sys.maxunicode + 1, dtype=bool)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        letter[c] = kind == "L"
        if kind in "LM":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table, letter


_table: list[tuple[np.ndarray, np.ndarray]] = []


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, text number of each key, letters per text): trigrams of letters, a run
    of other characters standing as one blank; three 21-bit code points a key."""
    if not _table:
        _table.append(_letters())
    strings = ["" if t is None else t for t in texts.to_pylist()]
    # a blank at either end of every text, so that no trigram spans two
    joined = " " + " ".join(strings) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = _table[0][0][points]
    lens = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    owner = np.repeat(np.arange(len(strings)), lens + 1)
    owner = np.concatenate([owner[:1], owner])[:len(points)]
    letter = code > 0
    letters = np.bincount(owner[_table[0][1][points]], minlength=len(strings))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    code, owner = code[keep].astype(U64), owner[keep]
    if len(code) < 3:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), letters
    key = (code[:-2] << U64(42)) | (code[1:-1] << U64(21)) | code[2:]
    # the middle must be a letter: blanks part words, they do not join them
    good = (code[1:-1] > 0)
    return key[good], owner[1:-1][good], letters


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        langs = b.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        key, owner, _ = trigrams(b.column("text"))
        of = code[owner]
        for k, name in enumerate(names):
            gram, n = np.unique(key[of == k], return_counts=True)
            yield rows(_COUNTS, lang=[name] * len(gram), gram=gram.view(np.int64), n=n)


def language_grams(labelled: DataFrame, share: float = SHARE) -> DataFrame:
    """``lang, gram, n, total, own``: the trigrams of each language, from all ``text, lang``
    rows, and whether the language owns them.  Foreign words put the trigrams of one
    language into texts of another, there less often by far; what is rare in all goes to
    those that use it most, so a script of many letters loses none at any size."""
    counts = stash(labelled.select("text", "lang").mapInArrow(_count, "lang string, gram bigint, n bigint")
                   .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    part = F.col("n") / F.col("total")
    most = F.max(part).over(Window.partitionBy("gram"))     # a row per language
    return stash(counts.join(F.broadcast(totals), "lang")
                 .withColumn("own", (part >= share) | (part * FOREIGN >= most)), "owned")


@dataclass
class LanguageFilter:
    """``slots[s, w]``: for slot s the bits of languages 64 w to 64 w + 63; ``coverage``:
    the share of a language's trigrams expected to be known in a new text of it."""
    names: list[str]
    slots: np.ndarray
    coverage: dict[str, float] = field(default_factory=dict)

    @classmethod
    def empty(cls, names: list[str], n_slots: int) -> LanguageFilter:
        return cls(names, np.zeros((n_slots, max(1, -(-len(names) // 64))), dtype=U64))

    @classmethod
    def build(cls, grams: list[tuple[str, int]], n_slots: int = SLOTS) -> LanguageFilter:
        out = cls.empty(sorted({g[0] for g in grams}), n_slots)
        for k, name in enumerate(out.names):
            out.add(k, np.array([g[1] for g in grams if g[0] == name], dtype=np.int64).view(U64))
        return out

    def add(self, k: int, keys: np.ndarray) -> None:
        """Language number k owns the keys."""
        for place in _probes(keys, len(self.slots)):
            self.slots[place, k // 64] |= U64(1 << (k % 64))

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """The bitmask of the languages that contain each key."""
        out = None
        for place in _probes(keys, len(self.slots)):
            got = self.slots[place]
            out = got if out is None else out & got
        return out

    def false_rate(self) -> np.ndarray:
        """Per language, the chance that a key it lacks passes all probes."""
        got = self.__dict__.get("_rate")
        if got is None:
            fill = [np.count_nonzero(self.slots[:, k // 64] & U64(1 << (k % 64))) / len(self.slots) for k in range(len(self.names))]
            got = self.__dict__["_rate"] = np.array(fill) ** PROBES
        return got

    def votes(self, keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Corrected popcounts, (texts, languages)."""
        mask, total = self.masks(keys), np.bincount(owner, minlength=n)
        rate, out = self.false_rate(), np.empty((n, len(self.names)))
        for k in range(len(self.names)):
            bit = (mask[:, k // 64] >> U64(k % 64)) & U64(1)
            hit = np.bincount(owner, weights=bit, minlength=n)
            out[:, k] = np.clip((hit - total * rate[k]) / (1 - rate[k]), 0, None)
        return out


def _probes(keys: np.ndarray, n_slots: int) -> list[np.ndarray]:
    a = mix64(keys)
    b = mix64(a ^ U64(0x9E3779B97F4A7C15)) | U64(1)
    return [((a + U64(i) * b) % U64(n_slots)).astype(np.int64) for i in range(PROBES)]


def learn(labelled: DataFrame) -> LanguageFilter:
    """A filter from all rows with a text and a language; it grows with the trigrams of the
    language that has most.  ``coverage`` is the share of owned trigrams without those
    seen once (Good and Turing's estimate of what new text adds)."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    grams = language_grams(known)
    sizes = sorted(grams.groupBy("lang").agg(       # one row a language
        F.count_if("own").alias("grams"), (F.sum(F.when(F.col("own") & (F.col("n") > 1), F.col("n")).otherwise(0)) / F.max("total"))
        .alias("coverage")).collect())
    most = max((r["grams"] for r in sizes), default=0)
    out = LanguageFilter.empty([r["lang"] for r in sizes], max(SLOTS, 1 << (PER_GRAM * most - 1).bit_length()) if most else SLOTS)
    out.coverage = {r["lang"]: r["coverage"] for r in sizes}
    part = (np.cumsum([r["grams"] for r in sizes]) // MET).tolist()
    for p in sorted(set(part)):             # about MET keys at a time meet in the driver
        some = [k for k in range(len(sizes)) if part[k] == p]
        got = grams.where(F.col("own") & F.col("lang").isin([out.names[k] for k in some])).select("lang", "gram").toArrow()
        keys = got.column("gram").to_numpy().view(U64)
        for k in some:
            out.add(k, keys[pc.equal(got.column("lang"), out.names[k]).to_numpy()])
    out.false_rate()
    return out


_PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: LanguageFilter, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score``.

    The score is the winner's corrected popcount over its own and the runner-up's
    distance from all trigrams: the share of trigrams it contains, times its lead.
    Ties go to the name that sorts first.  ``und`` with score 0: null text, no
    letter, or no language was learned."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = handle.value
        for b in sliced(batches):
            key, owner, letters = trigrams(b.column("text"))
            n = b.num_rows
            total = np.bincount(owner, minlength=n)
            names, score = np.full(n, UND, dtype=object), np.zeros(n)
            if m.names:
                votes = m.votes(key, owner, n)
                best = votes.argmax(axis=1)
                top = votes[np.arange(n), best]
                votes[np.arange(n), best] = -1
                second = np.clip(votes.max(axis=1), 0, None)
                ok = letters > 0
                names[ok] = np.array(m.names, dtype=object)[best[ok]]
                share = top / np.maximum(total, 1)
                lead = (top - second) / np.maximum(top, 1e-9)
                score = np.where(ok, np.clip(share * (0.5 + 0.5 * lead), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(names.tolist(), pa.string()), pa.array(score)],
                names=[*keep, "lang_pred", "score"])
    schema = StructType([*(docs.schema[c] for c in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    cols = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*cols).mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``.

    Learns from the text and the non-null lang of rows whose crc32(doc_id) modulo
    ``folds`` is not ``held`` (a null id is never held out).  Empty tables give
    no rows; repeated rows are scored alike; other columns are ignored."""
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"),
                      F.col("lang").cast("string").alias("lang"), (fold_of(F.col("doc_id"), folds) == held).alias("held_out"))
    model = learn(own.where(~F.col("held_out")))
    return predict(own, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
