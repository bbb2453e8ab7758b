"""Shortcut mining: binary features per example, label counts, mutual
information, top-K, merged feature groups, support/counter accuracy.

Data model: a long **incidence** table ``(uid, y, <feature cols>)`` with one
row per (example, feature) — set semantics, so ``count`` = examples.  No
matrix, no positional feature ids: features are identified by their columns.

Scale notes
* counts use partial + final hash aggregation (frequent leaves like ``the``
  hit every example; partial aggregation makes that cheap);
* the label list is a tiny aggregate (#classes rows, checked) turned into
  literal arrays, like ``pivot`` does when values are not given;
* top-K is ``orderBy(...).limit(K)`` = ``TakeOrderedAndProject``;
* the global feature order uses ``distributed_rank`` (no single-task window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions.scores import natural_mi
from sievekit.operators.rank import distributed_rank
from sievekit.operators.trees import root_label

MAX_LABELS = 1000
WRITTEN_OUT = 8  # labels up to which sums over them are written out instead of folded over arrays
MI_ORDER_DIGITS = 10  # order by MI rounded to this many places, then by the feature


def feature_incidence(nodes: DataFrame, id_col: str = "uid", label_col: str = "y",
                      feature_cols: Sequence[str] = ("tpl", "yield"),
                      max_depth: int | None = None) -> DataFrame:
    """Distinct (example, feature) rows; ``max_depth`` keeps templates of depth
    ≤ d (the notebooks use 7)."""
    df = nodes if max_depth is None else nodes.filter(F.col("depth") <= max_depth)
    return df.select(id_col, label_col, *feature_cols).distinct()


def class_totals(examples: DataFrame, label_col: str = "y") -> DataFrame:
    return examples.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_y"))


def label_list(totals: DataFrame, label_col: str = "y") -> list[tuple]:
    """``[(label, n_y), …]`` sorted by label — #classes rows, checked."""
    rows = totals.orderBy(label_col).limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return [(r[0], int(r[1])) for r in rows]


def _argmax_first(arr: Column) -> Column:
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def count_columns(labels: Sequence, label_col: str = "y") -> list[Column]:
    return [F.sum(F.when(F.col(label_col) == F.lit(lab), 1).otherwise(0)).cast("long").alias(f"_n{i}")
            for i, lab in enumerate(labels)]


def _mi_columns(counted: DataFrame, totals: Sequence[int]) -> DataFrame:
    """``mi`` from the columns ``_n0.._nk``: ``natural_mi`` with its sums written out, in the same order, so that they are
    compiled; many labels go through its arrays."""
    n = [F.col(f"_n{i}") for i in range(len(totals))]
    if not 0 < len(n) <= WRITTEN_OUT:
        tot = F.array(*[F.lit(int(t)).cast("long") for t in totals])
        return counted.withColumn("mi", natural_mi(F.array(*n), tot))
    cells = [((c + 1).cast("double"), (F.lit(int(t)).cast("long") - c + 1).cast("double")) for c, t in zip(n, totals)]
    whole, one, mi = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for c1, c0 in cells:
        whole, one = whole + c1 + c0, one + c1
    tot, pz1, pz0 = F.col("_tot"), F.col("_pz1"), F.lit(1.0) - F.col("_pz1")
    for c1, c0 in cells:
        py, p1, p0 = (c1 + c0) / tot, c1 / tot, c0 / tot
        mi = mi + p1 * F.log(p1 / (py * pz1)) + p0 * F.log(p0 / (py * pz0))
    return counted.withColumn("_tot", whole).withColumn("_pz1", one / tot).withColumn("mi", mi).drop("_tot", "_pz1")


def with_mi(counted: DataFrame, labels: Sequence, totals: Sequence[int]) -> DataFrame:
    """From per-label count columns ``_n0.._nk`` add ``counts`` (array),
    ``count``, ``mi`` (natural log, +1 smoothing), ``majority`` (index of the
    first maximum), ``majority_label`` and ``pct_majority`` = max (n+1)/Σ(n+1)."""
    k = len(labels)
    arr = F.array(*[F.col(f"_n{i}") for i in range(k)])
    lab = F.array(*[F.lit(x) for x in labels])
    out = (_mi_columns(counted, totals).withColumn("counts", arr)
           .withColumn("count", F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x))
           .withColumn("majority", _argmax_first(arr)))
    plus = F.transform(F.col("counts"), lambda x: (x + 1).cast("double"))
    out = (out.withColumn("majority_label", F.element_at(lab, F.col("majority") + 1))
           .withColumn("pct_majority", F.array_max(plus) / F.aggregate(plus, F.lit(0.0), lambda a, x: a + x)))
    return out.drop(*[f"_n{i}" for i in range(k)])


def feature_mi(incidence: DataFrame, examples: DataFrame, label_col: str = "y",
               feature_cols: Sequence[str] = ("tpl", "yield"), min_count: int = 1) -> DataFrame:
    """Per feature: label counts (Bernoulli NB ``feature_count_``), MI with the
    label and majority statistics.  Class totals come from ``examples`` (every
    example, also those without features).  ``min_count`` > 1 drops rare
    features after counting; the MI of the others is unchanged (it uses only a
    feature's own counts and the class totals)."""
    labs = label_list(class_totals(examples, label_col), label_col)
    labels = [x for x, _ in labs]
    totals = [n for _, n in labs]
    counted = incidence.groupBy(*feature_cols).agg(*count_columns(labels, label_col))
    out = with_mi(counted, labels, totals)
    if min_count > 1:
        out = out.filter(F.col("count") >= min_count)
    return out


def mi_order(desc_mi: str = "mi", feature_cols: Sequence[str] = ("tpl", "yield")) -> list[Column]:
    """The feature order of every table: MI descending, then the feature."""
    return [F.round(F.col(desc_mi), MI_ORDER_DIGITS).desc(), *[F.col(c).asc() for c in feature_cols]]


def feature_vocabulary(fmi: DataFrame, feature_cols: Sequence[str] = ("tpl", "yield")) -> DataFrame:
    """Features numbered 1..n in MI order (``argsort(-mi)``), distributed."""
    keyed = fmi.withColumn("_mi_key", -F.round(F.col("mi"), MI_ORDER_DIGITS))
    return distributed_rank(keyed, ["_mi_key", *feature_cols], rank_col="feature_no").drop("_mi_key")


def topk_features(fmi: DataFrame, k: int, where: Column | None = None,
                  feature_cols: Sequence[str] = ("tpl", "yield")) -> DataFrame:
    """First ``k`` features by MI after an optional filter, with their position
    ``topk_no`` (1..k).  ``limit`` after ``orderBy`` plans a bounded top-K."""
    df = fmi if where is None else fmi.filter(where)
    top = df.orderBy(*mi_order("mi", feature_cols)).limit(k)
    w = Window.orderBy(*mi_order("mi", feature_cols))  # ≤ k rows
    return top.withColumn("topk_no", F.row_number().over(w))


def feature_table(fmi: DataFrame, labels: Sequence, label_names: Sequence[str] | None = None) -> DataFrame:
    """Root, Subtree, Yield, MI, Count, one count column per label, majority
    label and % majority (the reference's feature table)."""
    names = list(label_names) if label_names is not None else [str(x) for x in labels]
    cols = [root_label("tpl").alias("Root"), F.col("tpl").alias("Subtree"), F.col("yield").alias("Yield"),
            F.col("mi").alias("MI"), F.col("count").alias("Count")]
    cols += [F.element_at("counts", i + 1).alias(n) for i, n in enumerate(names)]
    lab = F.array(*[F.lit(n) for n in names])
    cols += [F.element_at(lab, F.col("majority") + 1).alias("Majority label"),
             F.col("pct_majority").alias("% majority")]
    return fmi.select(*cols)


# ------------------------------------------------------------------- groups
def group_members(topk: DataFrame, labels: Sequence, by_template: bool = False) -> DataFrame:
    """Assign each top-K feature to group ``(key, j)``: key = root label (or the
    whole template), j = the feature's majority class."""
    key = F.col("tpl") if by_template else root_label("tpl")
    return topk.select("tpl", "yield", "topk_no", "mi", key.alias("group_key"),
                       F.col("majority").alias("group_j"))


def group_incidence(incidence: DataFrame, members: DataFrame, id_col: str = "uid",
                    label_col: str = "y") -> DataFrame:
    """Example has a group when it has any member feature: incidence ⋈ members
    (≤ K rows; AQE broadcasts it when its measured size allows) → distinct."""
    j = incidence.join(members.select("tpl", "yield", "group_key", "group_j"), ["tpl", "yield"])
    return j.select(id_col, label_col, "group_key", "group_j").distinct()


def merge_by_majority(incidence: DataFrame, examples: DataFrame, topk: DataFrame,
                      by_template: bool = False, label_col: str = "y", id_col: str = "uid",
                      k_examples: int = 8) -> DataFrame:
    """Merged feature groups (the reference's argmax merge).

    Every key seen in the top-K gets one group per class j (empty groups
    included, as in the reference); a group's counts and MI are recomputed on
    the OR of its members.  Output one row per group with ``members`` (yields
    in top-K order), ``examples`` (first ``k_examples`` joined by ``, ``),
    ``counts``, ``count``, ``mi``, ``majority``, ``pct_majority``,
    ``support_count`` and ``counter_count``."""
    spark = incidence.sparkSession
    labs = label_list(class_totals(examples, label_col), label_col)
    labels = [x for x, _ in labs]
    totals = [n for _, n in labs]
    members = group_members(topk, labels, by_template)
    ginc = group_incidence(incidence, members, id_col, label_col)
    counted = ginc.groupBy("group_key", "group_j").agg(*count_columns(labels, label_col))
    js = spark.createDataFrame([(i,) for i in range(len(labels))], "group_j int")
    frame = members.select("group_key").distinct().crossJoin(F.broadcast(js))
    full = frame.join(counted, ["group_key", "group_j"], "left")
    full = full.fillna(0, subset=[f"_n{i}" for i in range(len(labels))])
    scored = with_mi(full, labels, totals)
    lists = members.groupBy("group_key", "group_j").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("topk_no", "yield"))), lambda s: s["yield"])
        .alias("members"))
    out = scored.join(lists, ["group_key", "group_j"], "left").withColumn(
        "members", F.coalesce("members", F.array().cast("array<string>")))
    return (out.withColumn("examples", F.array_join(F.slice("members", 1, k_examples), ", "))
            .withColumn("support_count", F.array_max("counts"))
            .withColumn("counter_count", F.col("count") - F.array_max("counts")))


def support_counter_accuracy(ginc: DataFrame, groups: DataFrame, preds: DataFrame,
                             id_col: str = "uid", label_col: str = "y", acc_col: str = "acc") -> DataFrame:
    """Per group: accuracy of a classifier on member examples whose label is
    the group majority (support) and on the others (counter); NULL when empty.
    ``preds`` is ``(uid, acc)``."""
    g = groups.select("group_key", "group_j", F.col("majority").alias("_maj"))
    j = (ginc.join(g, ["group_key", "group_j"]).join(preds.select(id_col, acc_col), id_col)
         .withColumn("_support", F.col(label_col) == F.col("_maj")))
    a = F.col(acc_col).cast("double")
    return j.groupBy("group_key", "group_j").agg(
        F.avg(F.when(F.col("_support"), a)).alias("support_acc"),
        F.avg(F.when(~F.col("_support"), a)).alias("counter_acc"),
        F.sum(F.col("_support").cast("int")).cast("long").alias("n_support"),
        F.sum((~F.col("_support")).cast("int")).cast("long").alias("n_counter"))


def group_accuracy(ginc: DataFrame, groups: DataFrame, preds: DataFrame, splits: DataFrame,
                   id_col: str = "uid", label_col: str = "y") -> DataFrame:
    """Accuracy of several models on several splits, inside each group: ``group_key, group_j, split, model, n,
    majority_acc, support_acc, counter_acc, hard_counter_acc``.

    ``groups`` comes from the training split: its counts fix a group's majority class and its *own* least frequent class
    (the first on ties).  Support are members of a split with the majority label, counter those with another, hard
    counter those with the group's least frequent one; an accuracy over no member is null.  ``preds`` is
    ``(uid, model, acc)``, ``splits`` ``(uid, split)``, ``ginc`` the members of all splits."""
    least = F.array_position("counts", F.array_min("counts")) - 1
    g = groups.select("group_key", "group_j", F.col("majority").alias("_most"), least.alias("_least"))
    j = ginc.join(g, ["group_key", "group_j"]).join(splits, id_col).join(preds, id_col)
    y, a = F.col(label_col), F.col("acc").cast("double")
    of = lambda cond: F.avg(F.when(cond, a))
    return j.groupBy("group_key", "group_j", "split", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg((y == F.col("_most")).cast("double")).alias("majority_acc"),
        of(y == F.col("_most")).alias("support_acc"), of(y != F.col("_most")).alias("counter_acc"),
        of(y == F.col("_least")).alias("hard_counter_acc"))


def aligned_groups(left: DataFrame, right: DataFrame) -> DataFrame:
    """Groups of two independently mined families lined up: per group of ``left`` (``group_key, group_j, members``) the
    group of ``right`` with which it shares most members (``other_key, other_j, shared``; ties go to the first by key and
    class), null where it shares none.  Members are compared whole; both sides hold at most K of them."""
    one = left.select("group_key", "group_j", F.explode("members").alias("m"))
    two = right.select(F.col("group_key").alias("other_key"), F.col("group_j").alias("other_j"), F.explode("members").alias("m"))
    shared = one.join(two, "m").groupBy("group_key", "group_j", "other_key", "other_j").agg(F.countDistinct("m").alias("shared"))
    best = shared.groupBy("group_key", "group_j").agg(
        F.min(F.struct((-F.col("shared")).alias("less"), "other_key", "other_j")).alias("b"))
    return left.select("group_key", "group_j").join(best, ["group_key", "group_j"], "left").select(
        "group_key", "group_j", "b.other_key", "b.other_j", (-F.col("b.less")).alias("shared"))


def apply_train_features(train_fmi: DataFrame, eval_incidence: DataFrame,
                         feature_cols: Sequence[str] = ("tpl", "yield")) -> DataFrame:
    """Fit on train, apply to an evaluation split: features unseen in train are
    ignored (``left_semi`` on the train feature table)."""
    return eval_incidence.join(train_fmi.select(*feature_cols), list(feature_cols), "left_semi")


def fmt_words(words) -> Column:
    """Comma-joined member words."""
    return F.array_join(F.col(words) if isinstance(words, str) else words, ", ")


def fmt_ngrams(grams) -> Column:
    """``fmt_words`` of word lists."""
    return fmt_words(F.transform(grams, lambda g: F.array_join(g, " ")))


def fmt_pairs(pairs) -> Column:
    """``fmt_words`` of (left, right) word lists, fields ``u`` and ``v``."""
    return fmt_words(F.transform(pairs, lambda p: F.concat(F.array_join(p["u"], " "), F.lit("/"), F.array_join(p["v"], " "))))


def majority_view(groups: DataFrame, majority: int | None = None, n: int | None = None) -> DataFrame:
    """Groups of one majority class (or all), sorted by (majority desc, MI
    desc), first ``n``."""
    df = groups if majority is None else groups.filter(F.col("majority") == majority)
    df = df.orderBy(F.col("majority").desc(), F.round("mi", MI_ORDER_DIGITS).desc(),
                    F.col("group_key"), F.col("group_j"))
    return df.limit(n) if n is not None else df


# ------------------------------------------------------------- n-gram twins
def subtree_to_ngram_pair(yield_col) -> tuple[Column, Column]:
    """Split a synchronous yield at the **last** ``/``: (left words, right
    words); no slash → ("", yield)."""
    y = F.col(yield_col) if isinstance(yield_col, str) else yield_col
    has = F.instr(y, "/") > 0
    left = F.when(has, F.regexp_extract(y, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    right = F.when(has, F.regexp_extract(y, r"/([^/]*)$", 1)).otherwise(y)
    split = lambda c: F.split(F.trim(c), " ")
    return split(left), split(right)


def ngrams(tokens, max_n: int) -> Column:
    """All contiguous n-grams, n = 1..max_n, as arrays (texts shorter than n
    give no n-grams of that size)."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens

    def of_size(n):
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))),
                          lambda i: i + (n - 1) <= F.size(t))
        return F.transform(starts, lambda i: F.slice(t, i, n))
    return F.flatten(F.array(*[of_size(n) for n in range(1, max_n + 1)]))


def gram_texts(tokens, n: int) -> Column:
    """The distinct contiguous n-grams of a token column as texts, words joined by a blank.  Texts are told apart by hash;
    ``array_distinct`` of arrays or structs would compare all of them two by two."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)])))


def pair_ngram_features(pairs: DataFrame, patterns: DataFrame, id_col: str = "uid",
                        a_col: str = "a_tokens", b_col: str = "b_tokens",
                        max_n: int = 3, max_m: int = 3) -> DataFrame:
    """Example has group i when some pattern (u, v) of the group matches: u an
    n-gram of side a and v an n-gram of side b; a side equal to ``ϵ`` is
    ignored.  ``patterns`` is ``(group, u array, v array)``.  Explode n-grams
    per side and equi-join with the patterns (no per-row loop) → distinct
    ``(uid, group)``."""
    a = pairs.select(id_col, F.explode(F.array_distinct(ngrams(a_col, max_n))).alias("u"))
    b = pairs.select(id_col, F.explode(F.array_distinct(ngrams(b_col, max_m))).alias("v"))
    p = patterns.select("group", "u", "v")
    only_v = p.filter(F.col("u")[0] == "ϵ")
    only_u = p.filter((F.col("u")[0] != "ϵ") & (F.col("v")[0] == "ϵ"))
    both = p.filter((F.col("u")[0] != "ϵ") & (F.col("v")[0] != "ϵ"))
    hit_v = b.join(only_v.select("group", "v"), "v").select(id_col, "group")
    hit_u = a.join(only_u.select("group", "u"), "u").select(id_col, "group")
    hit_uv = (a.join(both, "u").select(id_col, "group", "v")
              .join(b, [id_col, "v"]).select(id_col, "group"))
    return hit_v.unionByName(hit_u).unionByName(hit_uv).distinct()


def hypothesis_ngram_features(pairs: DataFrame, patterns: DataFrame, id_col: str = "uid",
                              b_col: str = "b_tokens", max_m: int = 3) -> DataFrame:
    """Only the hypothesis side: example has group i when some v of the group
    is an n-gram of side b."""
    b = pairs.select(id_col, F.explode(F.array_distinct(ngrams(b_col, max_m))).alias("v"))
    return b.join(patterns.select("group", "v"), "v").select(id_col, "group").distinct()


# ------------------------------------------------------------- greedy merge
#: Bytes of the bit masks of one key that a task may hold; a key with more is worked on in parts.
MASK_BYTES = 256 << 20


def feature_masks(incidence: DataFrame, members: DataFrame, label_col: str = "y", id_col: str = "uid") -> DataFrame:
    """Contingency table of feature masks: ``group_key, mask, label, n``.

    ``members`` is ``(tpl, yield, group_key, step)``, at most K rows; ``mask`` is the sorted array of the steps (places in
    its key) of the features an example has.  One pass over the incidence: examples with the same mask and label are one
    row, and those without any feature of a key are not in it."""
    hit = incidence.join(members.select("tpl", "yield", "group_key", "step"), ["tpl", "yield"])
    per = hit.groupBy(id_col, label_col, "group_key").agg(F.array_sort(F.collect_set("step")).alias("mask"))
    return per.groupBy("group_key", "mask", F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _mi(counts, totals):
    """``functions.scores.natural_mi`` for one row of label counts."""
    import math
    cells = [(c + 1.0, t - c + 1.0) for c, t in zip(counts, totals)]
    whole = 0.0
    for a, b in cells:
        whole = whole + a + b
    one = 0.0
    for a, _ in cells:
        one += a
    one /= whole
    out = 0.0
    for a, b in cells:
        p = (a + b) / whole
        out += (a / whole) * math.log((a / whole) / (p * one))
        out += (b / whole) * math.log((b / whole) / (p * (1.0 - one)))
    return out


def greedy_groups(rows_of: list, weight, n_features: int, totals: Sequence[int]) -> list[tuple[int, list[int], list[int], float]]:
    """The greedy walk over one key: ``(group, steps, label counts, MI)``.

    ``rows_of[s]`` holds the table rows of feature s, ``weight`` the examples of each row per label.  What a feature adds
    to a group is the weight of its rows that the group does not have yet, so a step costs its own rows per group."""
    import numpy as np
    groups = [([], [0] * len(totals), 0.0, np.zeros(len(weight), dtype=bool))]
    for s in range(n_features):
        mine = rows_of[s]
        best, place, most = None, 0, None
        for j, (_, counts, mi, has) in enumerate(groups):
            more = weight[mine[~has[mine]]].sum(axis=0)
            union = [int(c + m) for c, m in zip(counts, more)]
            new = _mi(union, totals)
            score = new if new > mi else -new if new < mi else 0.0
            if most is None or score > most:
                best, place, most = (union, new), j, score
        if most < 0:
            own = [int(c) for c in weight[mine].sum(axis=0)]
            has = np.zeros(len(weight), dtype=bool)
            has[mine] = True
            groups.append(([s], own, _mi(own, totals), has))
        else:
            steps, _, _, has = groups[place]
            has[mine] = True
            groups[place] = ([*steps, s], *best, has)
    return [(j, steps, counts, mi) for j, (steps, counts, mi, _) in enumerate(groups)]


def merge_greedy(incidence: DataFrame, examples: DataFrame, topk: DataFrame, by_template: bool = False,
                 label_col: str = "y", id_col: str = "uid", mask_bytes: int = MASK_BYTES) -> DataFrame:
    """Greedy merge of top-K features into groups per key (root label, or the
    whole template).

    Features of a key are visited in MI order.  Each key starts with one empty
    group of MI 0.  A feature joins the group whose MI after the OR is best
    (score = sign(new − old) · new, first group on ties) unless every score
    is negative, in which case it opens a new group.

    The walk needs only how many examples of each label have each set of features, so the incidence is read once into
    the table of ``feature_masks``; the walk of a key is arithmetic on its rows, in one task, and the number of jobs
    does not depend on K.  A key whose table would take more than ``mask_bytes`` (counted first) keeps its rows in
    blocks: every step is then one aggregation over stored blocks (``_walk_in_blocks``)."""
    spark = incidence.sparkSession
    labs = label_list(class_totals(examples, label_col), label_col)
    labels, totals = [x for x, _ in labs], [n for _, n in labs]
    key = F.col("tpl") if by_template else root_label("tpl")
    members = (topk.select("tpl", "yield", "topk_no", key.alias("group_key"))
               .withColumn("step", F.row_number().over(Window.partitionBy("group_key").orderBy("topk_no")) - 1)
               .checkpoint(eager=True))
    index = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
    table = (feature_masks(incidence, members, label_col, id_col)
             .withColumn("label", index[F.col("label")]).checkpoint(eager=True))
    sizes = table.groupBy("group_key").agg((F.sum(F.size("mask") * 8 + 8 * len(labels)) + F.count(F.lit(1)) * 16).alias("bytes"))
    keys = members.groupBy("group_key").agg(F.count(F.lit(1)).alias("features")).join(sizes, "group_key", "left").collect()  # ≤ K
    wide = [r["group_key"] for r in keys if (r["bytes"] or 0) > mask_bytes]
    schema = "group_key string, g int, steps array<int>, counts array<bigint>, mi double"

    def walk(pdf):
        import numpy as np
        import pandas as pd
        pdf = pdf.sort_values(["label"]).reset_index(drop=True)
        n = int(pdf["features"].iloc[0])
        masks: dict = {}
        at = np.array([masks.setdefault(tuple(m), len(masks)) if m is not None else -1 for m in pdf["mask"]])
        weight = np.zeros((len(masks), len(totals)), dtype=np.int64)
        real = at >= 0
        np.add.at(weight, (at[real], pdf["label"].to_numpy()[real].astype(int)), pdf["n"].to_numpy()[real].astype(np.int64))
        rows_of: list = [[] for _ in range(n)]
        for mask, row in masks.items():
            for s in mask:
                rows_of[s].append(row)
        found = greedy_groups([np.array(r, dtype=np.int64) for r in rows_of], weight, n, totals)
        return pd.DataFrame([(pdf["group_key"].iloc[0], *f) for f in found], columns=["group_key", "g", "steps", "counts", "mi"])
    counted = members.groupBy("group_key").agg(F.count(F.lit(1)).cast("int").alias("features"))
    narrow = counted if not wide else counted.where(~F.col("group_key").isin(wide))
    groups = (narrow.join(table, "group_key", "left").select("group_key", "features", "mask", "label", "n")
              .groupBy("group_key").applyInPandas(walk, schema))
    for k in wide:
        groups = groups.unionByName(_walk_in_blocks(spark, table.where(F.col("group_key") == F.lit(k)), k, totals, schema))
    lab = F.array(*[F.lit(x) for x in labels])
    plus = F.transform("counts", lambda x: (x + 1).cast("double"))
    out = (groups.withColumn("count", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
           .withColumn("majority", _argmax_first(F.col("counts")))
           .withColumn("majority_label", F.element_at(lab, F.col("majority") + 1))
           .withColumn("pct_majority", F.array_max(plus) / F.aggregate(plus, F.lit(0.0), lambda a, x: a + x)))
    named = (out.select("group_key", "g", F.explode("steps").alias("step")).join(members, ["group_key", "step"])
             .groupBy("group_key", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "yield"))),
                                                        lambda x: x["yield"]).alias("members")))
    out = out.drop("steps").join(named, ["group_key", "g"], "left")
    none = F.array().cast("array<string>")
    return out.withColumn("members", F.coalesce("members", none)).withColumn("examples", F.array_join("members", ", "))


def _walk_in_blocks(spark, table: DataFrame, key: str, totals: Sequence[int], schema: str) -> DataFrame:
    """The walk for a key whose table no task should hold: each step adds up, over the stored rows, the weight that the
    step's feature adds to every group there is.  Rows know their groups from their mask and the assignment so far."""
    assigned: list[int] = []
    groups: list[list] = [[[], [0] * len(totals), 0.0]]
    n = table.select(F.max(F.array_max("mask"))).first()[0] + 1
    for s in range(n):
        owner = F.array(*[F.lit(g) for g in assigned]) if assigned else F.array().cast("array<int>")
        has = F.transform(F.filter("mask", lambda f: f < s), lambda f: F.get(owner, f))
        of = table.where(F.array_contains("mask", s)).withColumn("has", has)
        own = F.sum("n").alias("own")
        more = [F.sum(F.when(~F.array_contains("has", g), F.col("n")).otherwise(0)).alias(f"m{g}") for g in range(len(groups))]
        got = {r["label"]: r for r in of.groupBy("label").agg(own, *more).collect()}    # one row a label
        pick, most = None, None
        for g, (_, counts, mi) in enumerate(groups):
            union = [c + (got[i][f"m{g}"] if i in got else 0) for i, c in enumerate(counts)]
            new = _mi(union, totals)
            score = new if new > mi else -new if new < mi else 0.0
            if most is None or score > most:
                pick, most = (g, union, new), score
        if most < 0:
            fresh = [got[i]["own"] if i in got else 0 for i in range(len(totals))]
            groups.append([[s], fresh, _mi(fresh, totals)])
            assigned.append(len(groups) - 1)
        else:
            g, union, new = pick
            groups[g] = [[*groups[g][0], s], union, new]
            assigned.append(g)
    return spark.createDataFrame([(key, g, *row) for g, row in enumerate(groups)], schema)
