"""Registered queries for §2.F embeddings / selection and §2.K model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions import text as TX
from sievekit.functions._util import r6
from sievekit.operators import models as MD
from sievekit.operators import select as SL
from sievekit.operators import shortcuts as SC
from sievekit.plans import fixtures as X
from sievekit.plans.registry import register
from sievekit.plans.scoring import averaged, averaged_exactly
from sievekit.plans.textual import PAIRS_SQL, tok_sql
from sievekit.sources.tables import spread, table

RATES = (5, 10, 15, 20, 25, 30, 35, 40, 50, 60)


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


# ----------------------------------------------------------------- §2.F
@register("read_embeddings", "SELECT vec_id AS id, embedding FROM embeddings")
def q_read_embeddings(spark, sf):
    return _emb(spark, sf).select("id", "embedding")


@register("align_embeddings", X.with_ctes(X.EXAMPLES_SQL) + """
SELECT e.id, e.y, m.embedding FROM examples e JOIN embeddings m ON e.id = m.vec_id""")
def q_align_embeddings(spark, sf):
    """Vectors in the order of the example ids: an inner join on id."""
    return X.examples(spark, sf).select("id", "y").join(_emb(spark, sf).select("id", "embedding"), "id")


@register("join_scores_embeddings", X.BASE_SQL + """
SELECT a.id, a.average_pvi, a.misclassification_number, m.label FROM avg_scores a JOIN embeddings m ON a.id = m.vec_id""")
def q_join_scores_embeddings(spark, sf):
    e = _emb(spark, sf).select("id", "label")
    return averaged(spark, sf).join(e, "id").select("id", "average_pvi", "misclassification_number", "label")


_VECTORS_SQL = """e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sims AS (SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj, list_cosine_similarity(a.v, b.v) AS s FROM e a CROSS JOIN e b)"""
#: Selected sets that SQL can state: a share of ids that falls with the rate.
_STATED = "(id * 7919) % 100 >= "


@register("cosine_matrix", X.with_ctes(_VECTORS_SQL) + """
SELECT li AS label, i AS id, j AS neighbour, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j) AS r FROM sims WHERE li = lj AND i <> j) WHERE r = 1
UNION ALL SELECT label, min(id), NULL, NULL FROM e GROUP BY label HAVING count(*) = 1""")
def q_cosine_matrix(spark, sf):
    """The similarity matrix is only formed in block pairs inside tasks; its linear-size summary is each row's nearest
    neighbour in its class, exact at any number of blocks."""
    nn = SL.nearest_neighbour(_emb(spark, sf), ["label"])
    return nn.select("label", "id", "neighbour", r6("similarity").alias("similarity"))


@register("facility_location_select")
def q_facility_location_select(spark, sf):
    """Greedy order of every pool (one per label) with marginal gains; block -1 is the head, picked over the whole pool."""
    g = SL.greedy_order(_emb(spark, sf), ["label"])
    return g.select("label", "block", "id", "step", r6("gain").alias("gain"), "order")


@register("submodular_prune_global")
def q_submodular_prune_global(spark, sf):
    """All rates from one greedy run over the whole set."""
    return SL.submodular_prune(_emb(spark, sf), RATES).select("prune_rate", "id", r6("gain").alias("gain"),
                                                               "order")


@register("submodular_prune_per_class")
def q_submodular_prune_per_class(spark, sf):
    """Per-class pools and budgets (class ratio kept); rate q used as is (D13)."""
    p = SL.submodular_prune(_emb(spark, sf), RATES, by=["label"])
    return p.select("prune_rate", "label", "id", r6("gain").alias("gain"), "order")


@register("facility_location_value", X.with_ctes(_VECTORS_SQL, "rates AS (SELECT * FROM (VALUES "
          + ", ".join(f"({r})" for r in RATES) + ") AS t(prune_rate))") + """
SELECT CAST(prune_rate AS INTEGER) AS prune_rate, round(sum(best), 6) AS value, max(n) AS n_selected FROM (
  SELECT prune_rate, i, greatest(max(round(s, 9)), 0) AS best, count(*) AS n FROM sims, rates
  WHERE (j * 7919) % 100 >= prune_rate GROUP BY prune_rate, i) GROUP BY prune_rate""")
def q_facility_location_value(spark, sf):
    """f(S) over the whole table, per rate, of sets that SQL can state too."""
    e = _emb(spark, sf)
    rates = F.array(*[F.lit(r) for r in RATES])
    sel = e.select("id", F.explode(F.filter(rates, lambda r: (F.col("id") * 7919) % 100 >= r)).alias("prune_rate"))
    v = SL.objective(e, sel, set_cols=["prune_rate"])
    return v.select("prune_rate", r6("value").alias("value"), "n_selected")


@register("submodular_values")
def q_submodular_values(spark, sf):
    """f(S) over the whole table of the greedy sets of every rate: rises with the budget."""
    e = _emb(spark, sf)
    v = SL.objective(e, SL.submodular_prune(e, RATES).select("prune_rate", "id"), set_cols=["prune_rate"])
    return v.select("prune_rate", r6("value").alias("value"), "n_selected")


@register("facility_location_gain", X.with_ctes(_VECTORS_SQL) + """,
cover AS (SELECT i, greatest(max(round(s, 9)), 0) AS c FROM sims WHERE (j * 7919) % 100 >= 50 GROUP BY i)
SELECT s.j AS id, round(sum(greatest(s.s - coalesce(c.c, 0), 0)), 6) AS gain, (s.j * 7919) % 100 >= 50 AS selected
FROM sims s LEFT JOIN cover c ON c.i = s.i GROUP BY s.j""")
def q_facility_location_gain(spark, sf):
    """Marginal gain of every candidate over the whole table, given a set that SQL can state too."""
    e = _emb(spark, sf)
    g = SL.marginal_gains(e, e.where(F.expr(_STATED + "50")).select("id"))
    return g.select("id", r6("gain").alias("gain"), "selected")


@register("attach_gains")
def q_attach_gains(spark, sf):
    """Gains put on the selected rows by id (the reference wrote them by row
    position, D4)."""
    e = _emb(spark, sf)
    sel = SL.submodular_prune(e, (20,), by=["label"]).select("id", "gain")
    return e.select("id", "label").join(sel, "id").select("id", "label", r6("gain").alias("gain"))


@register("project_2d")
def q_project_2d(spark, sf):
    p = SL.project_2d(_emb(spark, sf))
    return p.select("id", "label", r6("pc1").alias("pc1"), r6("pc2").alias("pc2"))


@register("embed_texts")
def q_embed_texts(spark, sf):
    """Document vectors from a batched user model (hashed bag of words)."""
    return MD.embed_texts(table(spark, sf, "documents"), "text", "doc_id")


# ----------------------------------------------------------------- §2.K
_VOCAB_SQL = f"""cnt AS (SELECT w AS word, COUNT(*) AS count FROM (SELECT unnest({tok_sql('text')}) AS w FROM documents)
  GROUP BY w HAVING COUNT(*) >= 3),
vocab AS (
  SELECT * FROM (VALUES ('[PAD]', 0, NULL::BIGINT), ('[CLS]', 1, NULL), ('[SEP]', 2, NULL), ('[UNK]', 3, NULL)) AS s(word, id, count)
  UNION ALL
  SELECT word, CAST(ROW_NUMBER() OVER (ORDER BY count DESC, word) + 3 AS INTEGER) AS id, count
  FROM (SELECT * FROM cnt ORDER BY count DESC, word LIMIT 19996))"""


def _vocab(spark, sf):
    return MD.build_vocabulary(spread(table(spark, sf, "documents").select("text")), ["text"])


@register("build_vocabulary", X.with_ctes(_VOCAB_SQL) + "SELECT word, id, count FROM vocab")
def q_build_vocabulary(spark, sf):
    return _vocab(spark, sf)


@register("build_vocabulary_pairs", X.with_ctes(PAIRS_SQL, f"""cnt AS (SELECT w AS word, COUNT(*) AS count FROM (
    SELECT unnest({tok_sql('premise')}) AS w FROM pairs UNION ALL SELECT unnest({tok_sql('hypothesis')}) FROM pairs)
  GROUP BY w HAVING COUNT(*) >= 3)""") + """
SELECT word, CAST(ROW_NUMBER() OVER (ORDER BY count DESC, word) + 3 AS INTEGER) AS id, count
FROM (SELECT * FROM cnt ORDER BY count DESC, word LIMIT 19996)
UNION ALL SELECT * FROM (VALUES ('[PAD]', 0, NULL::BIGINT), ('[CLS]', 1, NULL), ('[SEP]', 2, NULL), ('[UNK]', 3, NULL)) AS s(word, id, count)""")
def q_build_vocabulary_pairs(spark, sf):
    """Pair data: both sides feed one vocabulary."""
    from sievekit.operators import text as OT
    pairs = OT.conversation_pairs(table(spark, sf, "conversations"))
    return MD.build_vocabulary(pairs, ["premise", "hypothesis"])


@register("encode_ids", X.with_ctes(_VOCAB_SQL) + f"""
SELECT d.doc_id, [1] || list_transform({tok_sql('d.text')}, lambda t: COALESCE(m.v[t], 3)) || [2] AS input_ids
FROM documents d CROSS JOIN (SELECT map(list(word), list(id)) AS v FROM vocab) m""")
def q_encode_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return MD.encode_ids(d, "text", _vocab(spark, sf), "doc_id").select("doc_id", "input_ids")


@register("fit_null_model", X.with_ctes(X.EXAMPLES_SQL) + """
SELECT y, COUNT(*) AS n_y, round(COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 6) AS p_y FROM examples GROUP BY y""")
def q_fit_null_model(spark, sf):
    """The null model sees only ``" "``: its optimum is the class prior."""
    from sievekit.operators import influence as I
    n = I.null_model_prior(X.examples(spark, sf))
    return n.select("y", "n_y", r6(F.col("n_y") / F.col("N")).alias("p_y"))


@register("fit_run_ensemble")
def q_fit_run_ensemble(spark, sf):
    """Five bootstrap runs of a text classifier, fitted in the same passes → long predictions,
    ready for ``score_runs``."""
    ex = X.examples(spark, sf).select("id", "text", "y")
    p = MD.fit_run_ensemble(ex, runs=5)
    return p.select("id", "run", F.transform("probs", lambda x: F.round(x, 6)).alias("probs"), "predicted")


@register("predict_batches", X.with_ctes(X.EXAMPLES_SQL) + """
SELECT id, round(1.0 / (1.0 + exp(-((n_chars / 1000.0) * 0.8 + (len(string_split(text, ' ')) / 100.0) * -0.5 - 0.2))), 6) AS p1
FROM examples""")
def q_predict_batches(spark, sf):
    """Batched inference of a logistic model through ``predict_batch_udf``."""
    ex = X.examples(spark, sf).withColumn("f1", F.col("n_chars") / 1000.0).withColumn(
        "f2", F.size(F.split("text", " ")) / 100.0)
    p = MD.predict_batches(ex, ["f1", "f2"], MD.linear_predict_fn([0.8, -0.5], -0.2), batch_size=100)
    return p.select("id", r6("p1").alias("p1"))


@register("retrain_grid")
def q_retrain_grid(spark, sf):
    """Retrain on every informed and random split (2 scores x 2 types x 10 rates x 5 runs, and 10 rates x 5 seeds) and
    score every language as a test set; 255 models, the same passes over the table."""
    from sievekit.operators import prune as P
    ex = X.examples(spark, sf).select("id", "text", "y", "lang")
    g = MD.retrain_grid(ex, P.kept_rates(averaged_exactly(spark, sf)), P.random_kept_rates(ex.select("id", "y")), RATES)
    return g.withColumns({c: r6(c) for c in ("accuracy", "macro_f1")})


_ATTR_SQL = f"""attr AS (SELECT id, y, {tok_sql('text')} AS t FROM examples),
ex2 AS (SELECT y, unnest(t) AS token, unnest(list_transform(t, lambda w, i: (length(w) % 5 - 2) * ((i - 1) % 3))) AS s
        FROM attr)"""


@register("token_attribution_stats", X.with_ctes(X.EXAMPLES_SQL, _ATTR_SQL) + """
SELECT y, token, round(avg(s) / CAST(10 AS DOUBLE), 6) AS mean_score, COUNT(*) AS count FROM ex2 GROUP BY y, token""")
def q_token_attribution_stats(spark, sf):
    """Per-token score statistics per label from aligned (tokens, scores)
    arrays; scores here are a closed-form stand-in for gradient saliency,
    carried in integer units of 0.1 so sums are exact in any order."""
    ex = X.examples(spark, sf).withColumn("tokens", TX.tokens_basic("text"))
    ex = ex.withColumn("scores", F.transform("tokens", lambda w, i: ((F.length(w) % 5) - 2) * (i % 3)))
    t = MD.token_attribution_stats(ex, "tokens", "scores", "y")
    return t.select("y", "token", r6(F.col("mean_score") / F.lit(10.0)).alias("mean_score"), "count")


_PAIR_ATTR_SQL = f"""attr AS (SELECT uid, turn % 2 AS y, list_concat({tok_sql('premise')}, ['[SEP]'], {tok_sql('hypothesis')}) AS t,
  len({tok_sql('premise')}) AS n FROM pairs),
ex2 AS (SELECT y, n, unnest(t) AS token, unnest(range(0, len(t))) AS i FROM attr)"""


@register("token_attribution_pairs", X.with_ctes(PAIRS_SQL, _PAIR_ATTR_SQL) + """
SELECT y, CASE WHEN i < n THEN 'a' ELSE 'b' END AS side, token, round(avg((length(token) % 5 - 2) * (i % 3)) / CAST(10 AS DOUBLE), 6) AS mean_score,
       COUNT(*) AS count FROM ex2 WHERE i <> n GROUP BY ALL""")
def q_token_attribution_pairs(spark, sf):
    """The same figures for pairs, premise and hypothesis apart, split at the boundary token."""
    from sievekit.operators import text as OT
    p = OT.conversation_pairs(table(spark, sf, "conversations")).withColumn("y", F.col("turn") % 2)
    p = p.withColumn("tokens", F.concat(TX.tokens_basic("premise"), F.array(F.lit("[SEP]")), TX.tokens_basic("hypothesis")))
    p = p.withColumn("scores", F.transform("tokens", lambda w, i: ((F.length(w) % 5) - 2) * (i % 3)))
    t = MD.token_attribution_stats(p, "tokens", "scores", "y", "[SEP]")
    return t.select("y", "side", "token", r6(F.col("mean_score") / F.lit(10.0)).alias("mean_score"), "count")


_NG_SQL = f"""toks AS (SELECT id, y, {tok_sql('text')} AS t FROM examples),
grams AS (SELECT DISTINCT id, y, g AS ngram FROM (
  SELECT id, y, unnest(list_transform(range(1, len(t) + 1), lambda i: array_to_string(t[i:i], ' '))) AS g FROM toks
  UNION ALL SELECT id, y, unnest(list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' '))) FROM toks
  UNION ALL SELECT id, y, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) FROM toks))"""


def _ngram_incidence(spark, sf):
    ex = X.examples(spark, sf).select("id", "y", TX.tokens_basic("text").alias("t"))
    grams = F.concat(*[SC.gram_texts("t", n) for n in (1, 2, 3)])      # tokens hold no blank, so sizes do not meet
    return ex.select(F.col("id").alias("uid"), "y", F.explode(grams).alias("ngram"))


@register("ngrams", X.with_ctes(X.EXAMPLES_SQL, _NG_SQL) + "SELECT id AS uid, ngram FROM grams")
def q_ngrams(spark, sf):
    """Distinct contiguous 1-3-grams of every document."""
    return _ngram_incidence(spark, sf).select("uid", "ngram")


@register("ngram_mutual_information", X.with_ctes(X.EXAMPLES_SQL, _NG_SQL) + """,
feat AS (SELECT id, y, ngram AS tpl, '' AS yield FROM grams), """ + __import__(
    "sievekit.plans.mining", fromlist=["mi_sql"]).mi_sql("feat") + """
SELECT tpl AS ngram, n0, n1, round(mi, 6) AS mi FROM fmi""")
def q_ngram_mutual_information(spark, sf):
    """MI of every 1-3-gram with the label (the n-gram family of features)."""
    inc = _ngram_incidence(spark, sf).withColumnRenamed("ngram", "tpl").withColumn("yield", F.lit(""))
    f = SC.feature_mi(inc, X.examples(spark, sf))
    return f.select(F.col("tpl").alias("ngram"), F.element_at("counts", 1).alias("n0"),
                    F.element_at("counts", 2).alias("n1"), r6("mi").alias("mi"))


@register("submodular_prune")
def q_submodular_prune(spark, sf):
    """§2.E entry point of diversity pruning: per-class facility-location
    selection at every prune rate (see ``submodular_prune_per_class``)."""
    p = SL.submodular_prune(_emb(spark, sf), RATES, by=["label"])
    return p.select("prune_rate", "label", "id")
