"""Model jobs at the level a Spark user writes them: vocabulary building, id
encoding, run ensembles and grids of models fitted together, batched inference with
``predict_batch_udf``, and text embeddings.

Neural fine-tuning and the GPU grammar are not rebuilt (README); their roles in
the pipeline — produce per-run predictions, produce vectors — are filled by
linear models over hashed words and by user models behind ``predict_batch_udf``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.functions.text import tokens_basic
from sievekit.operators import manymodels as MM
from sievekit.operators.lookup import PART_ROWS, lookup

# Fixed values of the reference's word tokenizer: special tokens and their ids.
SPECIALS = ["[PAD]", "[CLS]", "[SEP]", "[UNK]"]
PAD, CLS, SEP, UNK = 0, 1, 2, 3


def build_vocabulary(df: DataFrame, text_cols: Sequence[str], min_frequency: int = 3,
                     vocab_size: int = 20000) -> DataFrame:
    """Word-level vocabulary ``(word, id, count)``: specials get ids 0–3, then
    words with count ≥ ``min_frequency`` ordered by (count desc, word asc), at
    most ``vocab_size`` entries in total.  Pair data passes both text columns.
    Counting is a partial+final aggregate; the order is a bounded top-K."""
    spark = df.sparkSession
    toks = None
    for c in text_cols:
        t = df.select(F.explode(tokens_basic(c)).alias("word"))
        toks = t if toks is None else toks.unionByName(t)
    counts = toks.groupBy("word").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_frequency)
    top = counts.orderBy(F.col("count").desc(), F.col("word")).limit(vocab_size - len(SPECIALS))
    w = Window.orderBy(F.col("count").desc(), F.col("word"))  # ≤ vocab_size rows
    words = top.withColumn("id", (F.row_number().over(w) + len(SPECIALS) - 1).cast("int"))
    specials = spark.createDataFrame([(s, i, None) for i, s in enumerate(SPECIALS)],
                                     "word string, id int, count long")
    return specials.unionByName(words.select("word", "id", "count"))


def encode_ids(df: DataFrame, text_col: str, vocab: DataFrame, id_col: str, out_col: str = "input_ids",
               part_rows: int = PART_ROWS) -> DataFrame:
    """Tokens → ids (unknown → ``[UNK]``) wrapped in ``[CLS]`` … ``[SEP]``.

    Tokens are looked up where their row stands (``lookup``), so neither they nor the rows are shuffled, whatever the
    size of the vocabulary."""
    found = lookup(df, tokens_basic(text_col), vocab, "word", "id", out_col, part_rows)
    ids = F.transform(F.coalesce(out_col, F.array().cast("array<int>")), lambda x: F.coalesce(x, F.lit(UNK)))
    return found.withColumn(out_col, F.concat(F.array(F.lit(CLS)), ids, F.array(F.lit(SEP))))


def fit_run_ensemble(train: DataFrame, text_col: str = "text", label_col: str = "y", id_col: str = "id",
                     runs: int = 5, score: DataFrame | None = None, features: int = MM.FEATURES,
                     passes: int = MM.PASSES, seed: int = 7) -> DataFrame:
    """One classifier per run on a Bayesian-bootstrap reweighting of ``train`` (weights ``-ln U``, U uniform by a hash
    of seed, run and id), all fitted in the same passes (``manymodels``); predict ``score`` (default the training
    rows).  Output the long table ``(id, run, probs, predicted)`` that the influence operators consume."""
    score = score if score is not None else train
    every, u = F.array(F.lit(100)), MM.bootstrap_weights(id_col, runs, seed)
    cells = [MM.Cell((r,), 0, 0, r) for r in range(1, runs + 1)]
    rows = MM.model_rows(train, text_col, label_col, every, u, features=features).checkpoint(eager=True)
    coef = MM.train(rows, cells, features, passes)
    test = MM.model_rows(score, text_col, label_col, every, u, [id_col], features)
    p = MM.predict(test, coef, cells, [id_col])
    return p.select(id_col, F.posexplode("p").alias("_r", "_p")).select(
        id_col, (F.col("_r") + 1).alias("run"), F.array(F.lit(1.0) - F.col("_p"), F.col("_p")).alias("probs"),
        (F.col("_p") > 0.5).cast("int").alias("predicted"))


def retrain_grid(examples: DataFrame, kept: DataFrame, random_kept: DataFrame, rates: Sequence[int], runs: int = 5,
                 prune_label: int = 0, text_col: str = "text", label_col: str = "y", id_col: str = "id",
                 set_col: str = "lang", features: int = MM.FEATURES, passes: int = MM.PASSES) -> DataFrame:
    """Retrain on every split and score every test set: ``strategy, inf_score, prune_type, prune_rate, run, test_set,
    n, accuracy, macro_f1``.

    ``kept`` is ``prune.kept_rates`` (informed undersampling of ``prune_label``), ``random_kept`` is
    ``prune.random_kept_rates``; test sets are the values of ``set_col``.  Models of all strategies, scores, types,
    rates and runs are trained in the same passes, an unpruned one per run among them (rate 0)."""
    ways = [(s, t) for s in ("pvi", "el2n") for t in ("easy", "hard")]
    pick = lambda s, t: F.max(F.when(F.col("inf_score") == s, F.coalesce(F.col(f"kept_{t}"), F.lit(-1))))
    informed = kept.groupBy(id_col).agg(F.array(*[pick(s, t) for s, t in ways]).alias("_informed"))
    at = [F.max(F.when(F.col("run") == r, F.coalesce("kept", F.lit(-1)))) for r in range(1, runs + 1)]
    chance = random_kept.groupBy(id_col).agg(F.array(*at).alias("_random"))
    whole = F.when(F.col(label_col) == prune_label, F.col("_informed")).otherwise(F.array(*[F.lit(100)] * len(ways)))
    rows = MM.model_rows(examples.join(informed, id_col).join(chance, id_col), text_col, label_col,
                         F.concat(whole, F.col("_random"), F.array(F.lit(100))), MM.bootstrap_weights(id_col, runs),
                         [set_col], features).checkpoint(eager=True)
    cells = [MM.Cell(("informed", s, t, q, r), w, q, r) for w, (s, t) in enumerate(ways) for q in rates for r in range(1, runs + 1)]
    cells += [MM.Cell(("random", "", "", q, r), len(ways) + r - 1, q, r) for q in rates for r in range(1, runs + 1)]
    cells += [MM.Cell(("unpruned", "", "", 0, r), len(ways) + runs, 0, r) for r in range(1, runs + 1)]
    coef = MM.train(rows, cells, features, passes)
    return MM.grid_report(MM.confusion(rows, coef, cells, set_col), cells,
                          ["strategy", "inf_score", "prune_type", "prune_rate", "run"])


def linear_predict_fn(weights: Sequence[float], bias: float):
    """``make_predict_fn`` for ``predict_batch_udf``: a logistic model on a
    feature matrix; returns p(y=1) per row."""
    w = np.asarray(weights, dtype=np.float64)

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            z = x.astype(np.float64) @ w + bias
            return 1.0 / (1.0 + np.exp(-z))
        return predict
    return make


def predict_batches(df: DataFrame, feature_cols: Sequence[str], make_predict_fn,
                    batch_size: int = 100, out_col: str = "p1") -> DataFrame:
    """Batched inference with ``pyspark.ml.functions.predict_batch_udf`` (the
    model is built once per Python worker and fed Arrow batches of
    ``batch_size`` rows).  Adds ``probs`` and ``predicted`` (first maximum)."""
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size,
                            input_tensor_shapes=[[len(feature_cols)]])
    x = F.array(*[F.col(c).cast("double") for c in feature_cols])
    out = df.withColumn(out_col, udf(x))
    return (out.withColumn("probs", F.array(F.lit(1.0) - F.col(out_col), F.col(out_col)))
            .withColumn("predicted", (F.col(out_col) > 0.5).cast("int")))


def hashed_bow_embedder(dim: int = 64, seed: int = 0):
    """Default text model for ``embed_texts``: hashed bag of words, L2-normed."""
    def make():
        import zlib

        def embed(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, t in enumerate(texts):
                for w in str(t).lower().split():
                    h = zlib.crc32(w.encode("utf-8")) ^ seed
                    out[i, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            n = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(n > 0, n, 1.0)
        return embed
    return make


def embed_texts(df: DataFrame, text_col: str, id_col: str = "id", make_embed_fn=None, dim: int = 64,
                batch_size: int = 64) -> DataFrame:
    """One vector per id (first occurrence of an id wins) from a user model
    run by ``predict_batch_udf``; default model: ``hashed_bow_embedder``."""
    from pyspark.ml.functions import predict_batch_udf
    make = make_embed_fn or hashed_bow_embedder(dim)
    udf = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.dropDuplicates([id_col]).select(id_col, udf(F.col(text_col)).alias("embedding"))


def token_attribution_stats(df: DataFrame, tokens_col: str, scores_col: str, label_col: str,
                            boundary: str | None = None) -> DataFrame:
    """Per (label, token): mean and count of per-token attribution scores,
    from aligned ``tokens`` / ``scores`` arrays (``arrays_zip`` + explode).  With ``boundary``, the token that parts the
    sentences of a pair, the figures are per (label, side, token): side ``a`` before its first place, ``b`` after it; a
    row without it is all ``a``, and the boundary itself counts for neither."""
    z = F.arrays_zip(F.col(tokens_col).alias("t"), F.col(scores_col).alias("s"))
    rows = df.select(label_col, F.posexplode(z).alias("_i", "_z"), *(
        [F.array_position(tokens_col, F.lit(boundary)).alias("_cut")] if boundary is not None else []))
    keys = [F.col(label_col)]
    if boundary is not None:
        cut = F.col("_cut") - 1
        rows = rows.where((cut < 0) | (F.col("_i") != cut))
        keys.append(F.when((cut < 0) | (F.col("_i") < cut), "a").otherwise("b").alias("side"))
    return rows.groupBy(*keys, F.col("_z.t").alias("token")).agg(
        F.avg("_z.s").alias("mean_score"), F.count(F.lit(1)).alias("count"))
