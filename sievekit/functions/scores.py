"""Column expressions for probabilities and influence scores.

All functions return ``Column`` objects built from ``pyspark.sql.functions``,
so they stay inside whole-stage codegen.  Probability vectors are
``array<double>`` indexed by class (class k sits at 1-based position k+1).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievekit.functions._util import col


def prob_of(probs, label) -> Column:
    """p(label) from a probability vector; NULL when the label is out of range."""
    return F.try_element_at(col(probs), col(label).cast("int") + 1)


def entropy_bits(probs, label) -> Column:
    """V-entropy term ``-log2 p(y|x)`` of the gold class."""
    return -F.log2(prob_of(probs, label))


def pvi(null_bits, full_bits) -> Column:
    """Pointwise V-information ``H_yb - H_yx`` (null-input entropy minus full)."""
    return col(null_bits) - col(full_bits)


def el2n(probs, label) -> Column:
    """Error L2-norm ``|| p - onehot(y) ||_2`` over all classes."""
    p = col(probs)
    y = col(label).cast("int")
    sq = F.transform(p, lambda x, i: (x - F.when(i == y, F.lit(1.0)).otherwise(F.lit(0.0)))
                     * (x - F.when(i == y, F.lit(1.0)).otherwise(F.lit(0.0))))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def argmax(values) -> Column:
    """0-based index of the first maximum (ties: lowest index wins)."""
    v = col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def logsumexp(values) -> Column:
    """Max-shifted ``log(sum(exp(x)))`` of an array."""
    v = col(values)
    m = F.array_max(v)
    return m + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def softmax(logits) -> Column:
    """Max-shifted softmax of an array of logits."""
    v = col(logits)
    m = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def log_softmax(logits) -> Column:
    v = col(logits)
    lse = logsumexp(v)
    return F.transform(v, lambda x: x - lse)


def collapse_log_probs(log_probs) -> Column:
    """3-class log-probabilities -> 2: ``[lp0, logsumexp(lp[1:])]``."""
    lp = col(log_probs)
    rest = F.slice(lp, 2, F.size(lp) - 1)
    return F.array(F.element_at(lp, 1), logsumexp(rest))


def ensemble_log_probs(biased_log_probs, logits) -> Column:
    """Product of experts: ``biased + log_softmax(logits)`` renormalised."""
    s = F.zip_with(col(biased_log_probs), log_softmax(logits), lambda a, b: a + b)
    return log_softmax(s)


def prior_bits(n_class, n_total) -> Column:
    """Entropy of the class-prior model, ``-log2(n_y / N)``: the optimum of a
    model that only ever sees the constant null input."""
    return -F.log2(col(n_class) / col(n_total).cast("double"))


def natural_mi(counts_with, class_totals) -> Column:
    """Mutual information (natural log) between a binary feature and the label.

    ``counts_with``: array of n(y, z=1) per class; ``class_totals``: array of
    N_y per class; every one of the 2*|Y| cells gets +1 (additive smoothing).
    """
    a = col(counts_with)
    t = col(class_totals)
    cells = F.zip_with(a, t, lambda n1, ny: F.struct((n1 + 1).cast("double").alias("c1"),
                                                     (ny - n1 + 1).cast("double").alias("c0")))
    tot = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c["c1"] + c["c0"])
    pz1 = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c["c1"]) / tot
    pz0 = F.lit(1.0) - pz1

    def term(acc, c):
        py = (c["c1"] + c["c0"]) / tot
        p1 = c["c1"] / tot
        p0 = c["c0"] / tot
        return acc + p1 * F.log(p1 / (py * pz1)) + p0 * F.log(p0 / (py * pz0))

    return F.aggregate(cells, F.lit(0.0), term)


LOG2 = math.log(2.0)
