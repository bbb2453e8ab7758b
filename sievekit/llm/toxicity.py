"""Toxic passages by maximum-scoring segments of token log-odds.

Word weights are log-odds between toxic and other training texts under an
informative Dirichlet prior whose counts come from the whole corpus (a token
counts once per text, and copies of a text count once between them); a word with no
evidence of its own leans on its longest known stem (its first letters).  A linear scan
finds every maximal segment of positive total.  Segment scores follow an
extreme-value law in clean text; its parameters, fitted on clean training texts,
turn the scores into expectations, whose aggregate is calibrated to the
probability of the label.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm._common import fold_of, rows, stash
from sievekit.llm._words import U64, mix64, sliced
from sievekit.llm.neardup import shingle_sets

WORD = re.compile(r"[^\W\d_]+")
#: Letters of stems, longest first.
STEMS = (5, 4)
#: Mass of the corpus prior, as a share of the labelled tokens, and the least evidence
#: (z-score) of a weight.
PRIOR = 0.05
LEAST_Z = 3.0
#: The evidence asked for grows with the tokens tried, as sqrt(2 log(tokens / TRIED)).
TRIED = 100
#: Standard deviations by which a weight is drawn towards 0, so that chance finds weigh little.
CAUTION = 2.0
#: What any other token adds to a segment: toxic passages are dense.
DRIFT = -0.25


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def stems(word: str) -> list[str]:
    """The stem tokens of a word, longest first; ``~`` and the length keep stems and words apart."""
    return [f"~{k}{word[:k]}" for k in STEMS if len(word) > k]


_COUNT = pa.schema([("token", pa.string()), ("label", pa.int32()), ("n", pa.float64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter
    for b in sliced(batches, limit=8 << 20):
        by: dict[int, Counter] = {}
        for text, label, one in zip(*(b.column(c).to_pylist() for c in ("text", "label", "one"))):
            words = set(tokens(text or ""))
            if one == 1.0:
                c = by.setdefault(label, Counter())
                c.update(words)
                for k in STEMS:
                    c.update({f"~{k}{w[:k]}" for w in words if len(w) > k})
            else:
                c = by.setdefault(label, Counter())
                for w in words.union(*({f"~{k}{w[:k]}" for w in words if len(w) > k} for k in STEMS)):
                    c[w] += one
        for label, c in by.items():
            yield rows(_COUNT, token=list(c), label=[label] * len(c), n=list(c.values()))


#: Seeds of the signatures that find copies among training texts.
SEEDS = (1, 2, 3)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("seed", pa.int32()), ("m", pa.int64())])
    for b in sliced(batches):
        out = []
        for h, s in zip(b.column("h").to_pylist(), shingle_sets(b.column("text"))):
            if len(s):
                out += [(h, k, int(mix64(s ^ U64(k * 0x9E3779B97F4A7C15 % 2**64)).min().view(np.int64))) for k in SEEDS]
        yield rows(schema, **dict(zip(schema.names, map(list, zip(*out)))) if out else {n: [] for n in schema.names})


def unique_share(labelled: DataFrame) -> DataFrame:
    """``labelled`` (text, label) with ``one``: 1 over the number of texts that share the
    least shingle under one of the seeds, so that a text and its copies count about once."""
    t = labelled.withColumn("h", F.xxhash64("text"))
    signs = stash(t.select("h", "text").mapInArrow(_sign, "h bigint, seed int, m bigint"), "signs")
    crowd = signs.groupBy("seed", "m").agg(F.count("*").alias("n")).where("n > 1")
    worst = signs.join(crowd, ["seed", "m"]).groupBy("h").agg(F.max("n").alias("n"))
    return t.join(worst, "h", "left").select("text", "label", (1 / F.coalesce("n", F.lit(1))).alias("one"))


def weights(labelled: DataFrame, corpus: DataFrame) -> DataFrame:
    """``token, delta, z`` of tokens with at least ``LEAST_Z`` of evidence; delta is drawn
    towards 0 by ``CAUTION`` standard deviations.

    delta = log-odds(toxic) - log-odds(other) with Dirichlet pseudo-counts
    alpha_w = PRIOR * labelled tokens * corpus share of w, z = delta over its standard deviation."""
    marked = (corpus.select(F.col("text"), F.lit(-1).alias("label"), F.lit(1.0).alias("one"))
              .unionByName(unique_share(labelled.select("text", F.col("label").cast("int").alias("label")))))
    counts = marked.mapInArrow(_count, "token string, label int, n double")
    of = lambda k: F.round(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)), 6)
    table = stash(counts.groupBy("token").agg(of(1).alias("y1"), of(0).alias("y0"), of(-1).alias("c"))
                  .withColumn("stem", F.when(F.col("token").startswith("~"), F.substring("token", 2, 1)).otherwise("")), "tokens")
    totals = table.groupBy("stem").agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0"), F.sum("c").alias("nc"),
                                       F.count_if(F.col("y1") + F.col("y0") > 0).alias("tried"))
    t = table.where("y1 + y0 > 0").join(F.broadcast(totals), "stem")  # a row for words and one per stem length
    mass = PRIOR * (F.col("n1") + F.col("n0"))
    a = mass * (F.col("c") + 1) / (F.col("nc") + 1)
    odds = lambda y, n: F.log((F.col(y) + a) / (F.col(n) + mass - F.col(y) - a))
    delta = odds("y1", "n1") - odds("y0", "n0")
    sd = F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    sure = delta - F.signum(delta) * CAUTION * sd
    least = F.sqrt(F.greatest(F.lit(LEAST_Z ** 2), 2 * F.log(F.greatest(F.col("tried"), F.lit(1)) / TRIED)))
    return (t.select("token", sure.alias("delta"), (delta / sd).alias("z"), least.alias("least"))
            .where(F.abs("z") >= F.col("least")).drop("least"))


@dataclass
class ToxicModel:
    weight: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0                      # lambda of the extreme-value law
    rate: float = 1e-9                      # K: segments above 0 per token of clean text
    steps: tuple[float, ...] = ()           # upper evidence of each calibration step
    chance: tuple[float, ...] = (0.0,)      # probability of label 1 in each step

    def value(self, word: str) -> float:
        for token in (word, *stems(word)):
            if token in self.weight:
                return self.weight[token]
        return DRIFT

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Every maximal scoring segment (first, end, score) of the words, linear in
        their number; runs without a positive word are skipped in one step."""
        weight = self.weight
        if not weight:
            return []
        heads = self._heads
        hot = [i for i, w in enumerate(words) if w in weight or w[:STEMS[-1]] in heads and self.value(w) != DRIFT]
        found: list[list[float]] = []       # first, end, cumulative before, cumulative after
        total, last = 0.0, 0
        for i in hot:
            total += DRIFT * (i - last)
            last = i + 1
            v = self.value(words[i])
            before, total = total, total + v
            if v <= 0:
                continue
            seg = [i, i + 1, before, total]
            while True:
                k = len(found) - 1
                while k >= 0 and found[k][2] >= seg[2]:
                    k -= 1
                if k < 0 or found[k][3] >= seg[3]:
                    found.append(seg)
                    break
                seg = [found[k][0], seg[1], found[k][2], seg[3]]
                del found[k:]
        return [(int(a), int(e), r - l) for a, e, l, r in found]

    @property
    def _heads(self) -> set[str]:
        got = self.__dict__.get("_h")
        if got is None:
            got = self.__dict__["_h"] = {t[2:2 + STEMS[-1]] for t in self.weight if t.startswith("~")}
        return got

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """-log of the expected number of clean segments as good as these, summed over
        the significant ones (expectation below 1); 0 without any."""
        base = math.log(max(self.rate * max(n, 1), 1e-300))
        return sum(max(0.0, self.scale * s - base) for *_, s in segments)

    def score(self, evidence: float) -> float:
        """Probability of label 1 at this evidence, rising within a step so that order is kept."""
        k = int(np.searchsorted(self.steps, evidence, side="left"))
        low, high = self.chance[k], self.chance[min(k + 1, len(self.chance) - 1)]
        rise = 1 - math.exp(-evidence / 50)
        return min(1.0, max(0.0, low + (high - low) * 0.5 * rise if high > low else low + (1 - low) * 1e-3 * rise))


_SCAN = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("segments", pa.list_(pa.float64()))])
def _fit_law(seen: DataFrame, model: ToxicModel) -> None:
    """lambda and K by maximum likelihood from clean texts' segment scores: scores
    over 0 fall off as exp(-lambda s), K is their number per token."""
    total = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s)
    got = seen.where("label = 0").agg(F.sum(F.size("segments")), F.sum(F.round(total, 6)), F.sum("n")).first()
    count, score, n = (x or 0 for x in got)
    # one pseudo-segment of score 1 keeps the law proper where clean text has none
    model.scale = (count + 1) / (score + 1.0)
    model.rate = (count + 1) / (n + 1)


def _calibrate(seen: DataFrame, model: ToxicModel, steps: int = 24) -> None:
    """Isotonic steps of P(label 1 | evidence): pool texts by evidence, then merge
    neighbours until the shares rise.  Two numbers a labelled text reach the driver."""
    base = F.log(F.greatest(F.lit(model.rate) * F.greatest(F.col("n"), F.lit(1)), F.lit(1e-300)))
    gain = F.aggregate("segments", F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), F.lit(model.scale) * s - base))
    got = seen.select(gain.alias("ev"), F.col("label").cast("double").alias("y")).toArrow()
    ev, y = got.column("ev").to_numpy(), got.column("y").to_numpy()
    if not len(y):
        model.chance = (0.0,)
        return
    some = np.sort(ev[ev > 0])
    cuts = [0.0, *np.unique(np.quantile(some, np.linspace(0, 1, steps + 1))[1:-1])] if len(some) else [0.0]
    at = np.searchsorted(cuts, ev, side="left")
    pools = [[c, float((at == k).sum()), float(y[at == k].sum())] for k, c in enumerate([*cuts, math.inf]) if (at == k).any()]
    out: list[list[float]] = []
    for p in pools:
        out.append(p)
        while len(out) > 1 and out[-2][2] / out[-2][1] >= out[-1][2] / out[-1][1]:
            c, n, s = out.pop()
            out[-1] = [c, out[-1][1] + n, out[-1][2] + s]
    model.steps = tuple(p[0] for p in out[:-1])
    model.chance = tuple((p[2] + 0.01) / (p[1] + 0.02) for p in out)


def fit(labelled: DataFrame, corpus: DataFrame) -> ToxicModel:
    """Weights from the labelled rows and all of the corpus; law and calibration from the
    labelled rows.

    ``labelled``: text, label (bounded by ``MAX_LABELS``); ``corpus``: text.  Without positive labels the
    model scores every text 0."""
    # no more tokens than the labelled texts hold, of which there are at most MAX_LABELS
    got = weights(labelled, corpus).select("token", "delta").collect()
    model = ToxicModel({r["token"]: float(r["delta"]) for r in got})
    plain = ToxicModel(dict(model.weight))

    def scan(batches):
        for b in sliced(batches):
            out = []
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                w = tokens(text or "")
                seg = [s for *_, s in plain.segments(w)]
                out.append((label, len(w), seg))
            yield rows(_SCAN, **dict(zip(_SCAN.names, map(list, zip(*out)))))
    seen = stash(labelled.select("text", F.col("label").cast("int").alias("label")).mapInArrow(
        scan, "label int, n bigint, segments array<double>"), "segments")
    _fit_law(seen, model)
    _calibrate(seen, model)
    return model


def passages(docs: DataFrame, model: ToxicModel, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``score, n_words, evidence`` and ``passages``: first word,
    end word, score and text of every significant passage.  Null and empty texts
    have none and get the lowest score."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    part = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches):
        m = handle.value
        for b in sliced(batches):
            score, count, ev, spans = [], [], [], []
            for text in b.column("text").to_pylist():
                w = tokens(text or "")
                seg = m.segments(w)
                e = m.evidence(seg, len(w))
                score.append(m.score(e))
                count.append(len(w))
                ev.append(e)
                spans.append([{"first": a, "end": z, "score": s, "text": " ".join(w[a:z])} for a, z, s in seg
                              if m.evidence([(a, z, s)], len(w)) > 0])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(score, pa.float64()), pa.array(count, pa.int64()),
                 pa.array(ev, pa.float64()), pa.array(spans, part)],
                names=[*keep, "score", "n_words", "evidence", "passages"])
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (
        ", score double, n_words bigint, evidence double,"
        " passages array<struct<first:bigint,end:bigint,score:double,text:string>>")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


#: Labelled documents the model is fitted on, at most (those whose ids hash lowest).
MAX_LABELS = 200_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """``text, label`` of documents with a 0 or 1 label outside the held-out fold; an id
    that ``labels`` repeats trains once for each distinct label, null ids and labels
    not at all.  The label table is cut to ``MAX_LABELS`` rows, so its broadcast has
    a fixed bound and no text is shuffled."""
    y = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")) \
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held)).distinct()
    n = y.count()
    if n > MAX_LABELS:      # by hash down to about the bound first, so that no task hands on more than its share
        y = y.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * 1.05 * MAX_LABELS / n) + 1)
    y = y.orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)), "_id", "label").limit(MAX_LABELS)
    return docs.join(F.broadcast(y), docs["doc_id"] == y["_id"]).select(docs["text"], "label")


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, cut: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_passages`` for every row of ``docs``.

    Labels train only where crc32(doc_id) modulo ``folds`` is not ``held`` (at most
    ``MAX_LABELS``); null ids are never held out and carry no label.  Repeated rows score alike; an empty
    table gives no rows; other columns are ignored."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                      (fold_of(F.col("doc_id"), folds) == held).alias("held_out"))
    train = stash(training_rows(own, labels, "toxic", folds, held), "toxic-train")
    model = fit(train, own)
    out = passages(own, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"),
                      F.size("passages").alias("n_passages"))
