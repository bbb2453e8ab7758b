"""Document quality by regularised quadratic discriminant analysis.

Statistics of a whole text are transformed towards normality; each class keeps a
mean and a covariance shrunk towards the pooled one and towards a multiple of
the identity.  A score is the posterior from the difference of two Mahalanobis
log-densities, computed with Cholesky factors kept in the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm._common import fold_of, rows, stash
from sievekit.llm._words import BLANK, Words, sliced

FEATURES = ("log_words", "log_word_bytes", "word_bytes_spread", "symbols", "punctuation", "upper", "digits",
            "non_ascii", "pipes", "short_words", "distinct_words", "top_word", "repeated_bigrams", "line_words",
            "distinct_lines", "ends_in_mark")
#: Weight of the pooled covariance in a class's, and of the identity in that.
POOL, RIDGE = 0.1, 0.05


def _lut(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars.encode())] = True
    return t


_SYMBOL, _PUNCT, _PIPE = _lut("#$%&*<>{}[]\\^~@=+_`"), _lut(".,;:!?'\"()-"), _lut("|")
_UPPER, _DIGIT, _MARK = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _lut("0123456789"), _lut(".,;:!?#$%&*|")
_HIGH = np.zeros(256, dtype=bool)
_HIGH[128:] = True


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, features): transformed statistics of every whole text; zeros if it has no word."""
    w = Words(texts, BLANK)
    n, out = len(texts), np.zeros((len(texts), len(FEATURES)))
    if not n:
        return out
    of_word = np.repeat(np.arange(n), w.counts)
    size = np.diff(w.off)
    of_byte = np.repeat(np.arange(n), size)
    total = np.maximum(size, 1)
    share = lambda lut: np.bincount(of_byte[lut[w.raw]], minlength=n) / total
    words = np.maximum(w.counts, 1)
    lens = (w.ends - w.starts).astype(float)
    mean = np.bincount(of_word, lens, n) / words
    spread = np.sqrt(np.maximum(np.bincount(of_word, lens ** 2, n) / words - mean ** 2, 0))
    h = w.hashes()
    root = np.sqrt
    line = np.bincount(of_byte[w.raw == 10], minlength=n) + 1
    distinct, top, again, lines = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n)
    text_bytes = w.raw.tobytes()
    for d in range(n):
        a, e = w.first[d], w.first[d + 1]
        if e > a:
            _, c = np.unique(h[a:e], return_counts=True)
            distinct[d], top[d] = len(c) / root(e - a), c.max() / (e - a)
            if e - a > 1:
                pair = h[a:e - 1] * np.uint64(31) + h[a + 1:e]
                again[d] = 1 - len(np.unique(pair)) / len(pair)
        parts = text_bytes[w.off[d]:w.off[d + 1]].split(b"\n")
        lines[d] = len(set(parts)) / len(parts)
    cols = (np.log1p(w.counts), np.log1p(mean), np.log1p(spread), root(share(_SYMBOL)), root(share(_PUNCT)),
            root(share(_UPPER)), root(share(_DIGIT)), root(share(_HIGH)), root(share(_PIPE)),
            root(np.bincount(of_word, lens <= 2, n) / words), np.log1p(distinct), root(top), root(again),
            np.log1p(w.counts / line), lines, root(np.bincount(of_word, _MARK[w.raw[w.ends - 1]], n) / words))
    out[:] = np.column_stack(cols)
    out[w.counts == 0] = 0
    return out


@dataclass
class Discriminant:
    """Per class: log prior, mean, Cholesky factor and its log-determinant."""
    centre: np.ndarray
    spread: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray, float]]

    @classmethod
    def from_moments(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
        """``moments[c]``: count, sum and sum of outer products of class c (0 and 1)."""
        d = len(FEATURES)
        n = sum(m[0] for m in moments.values())
        centre = sum((m[1] for m in moments.values()), np.zeros(d)) / max(n, 1)
        square = sum((np.diag(m[2]) for m in moments.values()), np.zeros(d)) / max(n, 1)
        spread = np.sqrt(np.maximum(square - centre ** 2, 1e-8))
        own = {}
        for c in (0, 1):
            k, s, o = moments.get(c, (0.0, np.zeros(d), np.zeros((d, d))))
            mu = (s / k - centre) / spread if k else np.zeros(d)
            second = (o - np.outer(s, centre) - np.outer(centre, s) + k * np.outer(centre, centre)) / np.outer(spread, spread)
            own[c] = (k, mu, second / k - np.outer(mu, mu) if k else np.eye(d))
        pooled = sum(k * cov for k, _, cov in own.values()) / max(n, 1) if n else np.eye(d)
        classes = []
        for c in (0, 1):
            k, mu, cov = own[c]
            cov = (1 - POOL) * cov + POOL * pooled
            cov = (1 - RIDGE) * cov + RIDGE * max(np.trace(cov) / d, 1e-6) * np.eye(d)
            low = np.linalg.cholesky(cov)
            classes.append((float(np.log((k + 1) / (n + 2))), mu, low, float(2 * np.log(np.diag(low)).sum())))
        return cls(centre, spread, classes)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for rows of statistics."""
        z = (x - self.centre) / self.spread
        dens = []
        for prior, mu, low, logdet in self.classes:
            y = np.linalg.solve(low, (z - mu).T)
            dens.append(prior - 0.5 * ((y ** 2).sum(axis=0) + logdet))
        return 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -500, 500)))


_PART = pa.schema([("label", pa.int32()), ("cell", pa.int32()), ("v", pa.float64())])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    for b in batches:
        x, y = _matrix(b.column("x")), b.column("label").to_numpy()
        for c in (0, 1):
            s = x[y == c]
            if len(s):
                v = np.concatenate([[len(s)], s.sum(axis=0), (s.T @ s).ravel()])
                yield rows(_PART, label=np.full(len(v), c), cell=np.arange(1 + d + d * d), v=v)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), len(FEATURES))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``x``, the statistics of each whole text."""
    def run(batches):
        for b in sliced(batches):
            x = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(list(x), pa.list_(pa.float64()))],
                                             names=[*keep, "x"])
    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(
        run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", x array<double>")


def fit(measured: DataFrame) -> Discriminant:
    """From every ``x, label`` row: counts, sums and products are added up by Spark, only
    the two classes' totals reach the driver."""
    d = len(FEATURES)
    got = (measured.select("x", "label").mapInArrow(_moments, "label int, cell int, v double")
           .groupBy("label", "cell").agg(F.sum("v").alias("v")).collect())
    flat = {c: np.zeros(1 + d + d * d) for c in {r["label"] for r in got}}
    for r in got:
        flat[r["label"]][r["cell"]] = r["v"]
    return Discriminant.from_moments({c: (v[0], v[1:1 + d], v[1 + d:].reshape(d, d)) for c, v in flat.items()})


def predict(measured: DataFrame, model: Discriminant, keep: list[str], wordless: float = 0.0) -> DataFrame:
    """``keep`` columns with ``score``; texts without a word get ``wordless``."""
    handle = measured.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = handle.value
        for b in batches:
            x = _matrix(b.column("x"))
            s = np.where(x.any(axis=1), m.score(x), wordless)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], names=[*keep, "score"])
    kinds = dict(measured.dtypes)
    return measured.select(*keep, "x").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double")


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels train only where crc32(doc_id) modulo ``folds`` is not ``held`` (a null id
    counts as remainder 0); an id that ``labels`` repeats trains once for each distinct
    label.  Null, empty and blank texts score 0.  Repeated rows score alike; an empty
    table gives no rows; without labels every text with a word scores near 0.5; other
    columns are ignored.  Texts are read once and never shuffled: only their
    statistics meet the labels."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                      (fold_of(F.col("doc_id"), folds) == held).alias("held_out"))
    measured = stash(measure(own, ["doc_id", "held_out"]), "quality")
    y = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")) \
        .where(F.col("label").isin(0, 1)).distinct()
    train = measured.where(~F.col("held_out"))
    model = fit(train.join(y, train["doc_id"] == y["_id"]))
    return predict(measured, model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
