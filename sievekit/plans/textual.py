"""Registered queries for §2.B text operators (documents, conversation pairs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions import scores as S
from sievekit.functions import text as TX
from sievekit.functions._util import r6
from sievekit.operators import text as OT
from sievekit.plans import fixtures as X
from sievekit.plans.registry import register
from sievekit.sources.tables import table

# DuckDB spellings of the Spark expressions used below.
TOK_SQL = ("regexp_extract_all(lower(strip_accents(COALESCE({x}, ''))), "
           "'[\\p{{P}}$+<=>^`|~]|[^\\s\\p{{Z}}\\p{{Cc}}\\p{{P}}$+<=>^`|~]+')")


def tok_sql(x: str) -> str:
    return TOK_SQL.format(x=x)


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


PAIRS_SQL = """pairs AS (
  SELECT CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS uid, a.conv_id, a.turn,
         a.text AS premise, b.text AS hypothesis
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _pairs(spark, sf):
    return OT.conversation_pairs(table(spark, sf, "conversations"))


_MARKED = "'  [USER] ' || text || ' [URL]there [USER][URL]'"


def _clean_sql(x: str) -> str:
    x = strip_sql(f"regexp_replace({x}, '\\[USER\\]*\\s*', '', 'g')")
    x = strip_sql(f"regexp_replace({x}, '\\[URL\\]*\\s*', '', 'g')")
    return strip_sql(f"regexp_replace({x}, '\\[USER\\]*\\s*\\[URL\\]*', '', 'g')")


@register("clean_mentions", f"SELECT doc_id, {_clean_sql(_MARKED)} AS clean FROM documents")
def q_clean_mentions(spark, sf):
    d = _docs(spark, sf).withColumn(
        "marked", F.concat(F.lit("  [USER] "), F.col("text"), F.lit(" [URL]there [USER][URL]")))
    return d.select("doc_id", TX.clean_mentions("marked").alias("clean"))


@register("extract_numeric_id", """
SELECT doc_id, regexp_extract_all(source || '_english-' || CAST(doc_id AS VARCHAR), '\\d+')[-1] AS numeric_id
FROM documents""")
def q_extract_numeric_id(spark, sf):
    d = _docs(spark, sf)
    key = F.concat(F.col("source"), F.lit("_english-"), F.col("doc_id").cast("string"))
    return d.select("doc_id", TX.extract_numeric_id(key).alias("numeric_id"))


@register("parse_label", """
SELECT doc_id, CAST(substr('LABEL_' || CAST(toxic AS VARCHAR), instr('LABEL_' || CAST(toxic AS VARCHAR), '_') + 1) AS INTEGER) AS label
FROM labels""")
def q_parse_label(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.select("doc_id", TX.parse_label(F.concat(F.lit("LABEL_"), F.col("toxic").cast("string"))).alias("label"))


@register("encode_labels_sorted", """
SELECT d.doc_id, d.lang, CAST(c.code AS INTEGER) AS numeric_labels FROM documents d
JOIN (SELECT lang, DENSE_RANK() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM documents)) c
  ON d.lang = c.lang""")
def q_encode_labels_sorted(spark, sf):
    return OT.encode_labels_sorted(_docs(spark, sf).select("doc_id", "lang"), "lang")


@register("encode_labels_by_appearance", """
SELECT d.doc_id, d.source, CAST(c.code AS INTEGER) AS numeric_labels FROM documents d
JOIN (SELECT source, ROW_NUMBER() OVER (ORDER BY f) - 1 AS code
      FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY source)) c ON d.source = c.source""")
def q_encode_labels_by_appearance(spark, sf):
    return OT.encode_labels_by_appearance(_docs(spark, sf).select("doc_id", "source"), "source", "doc_id")


@register("null_input", X.with_ctes(X.EXAMPLES_SQL) + "SELECT id, ' ' AS empty_strings, y FROM examples")
def q_null_input(spark, sf):
    ex = X.examples(spark, sf).select("id", "y")
    return OT.null_input(ex, name="empty_strings").select("id", "empty_strings", "y")


@register("pair_to_text", X.with_ctes(PAIRS_SQL) +
          "SELECT uid, 'PREMISE: ' || premise || ' HYPOTHESIS: ' || hypothesis AS sentence1 FROM pairs")
def q_pair_to_text(spark, sf):
    return _pairs(spark, sf).select("uid", TX.pair_to_text("premise", "hypothesis").alias("sentence1"))


@register("hypothesis_only", X.with_ctes(PAIRS_SQL) +
          "SELECT uid, 'HYPOTHESIS: ' || hypothesis AS sentence1 FROM pairs")
def q_hypothesis_only(spark, sf):
    return _pairs(spark, sf).select("uid", TX.hypothesis_only("hypothesis").alias("sentence1"))


@register("premise_only", X.with_ctes(PAIRS_SQL) + "SELECT uid, 'PREMISE: ' || premise AS sentence1 FROM pairs")
def q_premise_only(spark, sf):
    return _pairs(spark, sf).select("uid", TX.premise_only("premise").alias("sentence1"))


@register("identity_transform", "SELECT doc_id, text AS sentence1 FROM documents")
def q_identity(spark, sf):
    return _docs(spark, sf).select("doc_id", F.col("text").alias("sentence1"))


_PAIR_TOKS = X.with_ctes(PAIRS_SQL, f"""pt AS (SELECT uid, {tok_sql('premise')} AS p, {tok_sql('hypothesis')} AS h
  FROM pairs)""")


def _pair_toks(spark, sf):
    return _pairs(spark, sf).select("uid", TX.tokens_basic("premise").alias("p"),
                                    TX.tokens_basic("hypothesis").alias("h"))


@register("overlap_band", _PAIR_TOKS + """
SELECT uid, CASE WHEN o >= 0.75 THEN 'HIGH' WHEN o >= 0.5 THEN 'MEDIUM' WHEN o >= 0.25 THEN 'LOW' ELSE 'NO' END
            || ' OVERLAP.' AS sentence1, round(o, 6) AS overlap
FROM (SELECT uid, CAST(len(list_filter(h, lambda t: list_contains(p, t))) AS DOUBLE) / NULLIF(len(h), 0) AS o FROM pt)""")
def q_overlap_band(spark, sf):
    t = _pair_toks(spark, sf)
    return t.select("uid", TX.overlap_band("h", "p").alias("sentence1"),
                    r6(TX.overlap_share("h", "p")).alias("overlap"))


@register("raw_overlap_mask", _PAIR_TOKS + """
SELECT uid, 'PREMISE: ' || array_to_string(list_transform(p, lambda t: CASE WHEN list_contains(h, t) THEN t ELSE '[MASK]' END), ' ')
         || ' HYPOTHESIS: ' || array_to_string(list_transform(h, lambda t: CASE WHEN list_contains(p, t) THEN t ELSE '[MASK]' END), ' ')
         AS sentence1
FROM pt""")
def q_raw_overlap_mask(spark, sf):
    t = _pair_toks(spark, sf)
    return t.select("uid", TX.pair_to_text(TX.raw_overlap_mask("p", "h"), TX.raw_overlap_mask("h", "p"))
                    .alias("sentence1"))


@register("shuffle_tokens", _PAIR_TOKS + """
SELECT uid, array_to_string(list_transform(list_sort(list_transform(h, lambda x, i:
          {'h': md5('13|' || uid || '|' || CAST(i - 1 AS VARCHAR) || '|' || x), 't': x})), lambda s: s.t), ' ') AS shuffled
FROM pt""")
def q_shuffle_tokens(spark, sf):
    t = _pair_toks(spark, sf)
    return t.select("uid", F.array_join(TX.shuffle_tokens("h", 13, "uid"), " ").alias("shuffled"))


@register("length_mask", _PAIR_TOKS + """
SELECT uid, 'PREMISE: ' || array_to_string(list_transform(p, lambda t: '#'), ' ')
         || ' HYPOTHESIS: ' || array_to_string(list_transform(h, lambda t: '#'), ' ') AS sentence1 FROM pt""")
def q_length_mask(spark, sf):
    t = _pair_toks(spark, sf)
    return t.select("uid", TX.pair_to_text(TX.length_mask("p"), TX.length_mask("h")).alias("sentence1"))


LEXICON = ["the", "and", "of", "le", "la", "de", "der", "und", "el", "que"]


@register("keep_lexicon_words")
def q_keep_lexicon_words(spark, sf):
    """Java look-ahead regex; DuckDB (RE2) has no look-ahead, so this key is
    checked by goldens in the tests, not by SQL."""
    return _docs(spark, sf).select("doc_id", TX.keep_lexicon_words("text", LEXICON).alias("sentence1"))


_LEX_SQL = f"""lex AS (
  SELECT DISTINCT w AS word, ((ascii(w) % 7) - 3) / 10.0 AS polarity
  FROM (SELECT unnest({tok_sql('text')}) AS w FROM benchmark)),
dt AS (SELECT doc_id, unnest({tok_sql('text')}) AS w FROM documents),
pol AS (SELECT dt.doc_id, avg(lex.polarity) AS polarity FROM dt JOIN lex ON dt.w = lex.word GROUP BY dt.doc_id)"""


def _lexicon(spark, sf):
    """A polarity lexicon derived from the benchmark texts (a user table)."""
    b = table(spark, sf, "benchmark")
    return (b.select(F.explode(TX.tokens_basic("text")).alias("word")).distinct()
            .withColumn("polarity", ((F.ascii("word") % 7) - 3) / 10.0))


@register("sentiment_band", X.with_ctes(_LEX_SQL) + """
SELECT d.doc_id, round(COALESCE(p.polarity, 0.0), 6) AS polarity,
  CASE WHEN COALESCE(p.polarity, 0.0) BETWEEN -0.10 AND 0.10 THEN 'neutral'
       WHEN COALESCE(p.polarity, 0.0) > 0.10 THEN 'positive' ELSE 'negative' END AS sentiment
FROM documents d LEFT JOIN pol p ON d.doc_id = p.doc_id""")
def q_sentiment_band(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text")
    s = OT.sentiment_polarity(d, "text", _lexicon(spark, sf), id_col="doc_id")
    return s.select("doc_id", r6("polarity").alias("polarity"), "sentiment")


@register("sentiment_plus_lexicon")
def q_sentiment_plus_lexicon(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text")
    s = OT.sentiment_polarity(d, "text", _lexicon(spark, sf), id_col="doc_id")
    out = F.concat_ws(" ", "sentiment", TX.keep_lexicon_words("text", LEXICON))
    return s.select("doc_id", F.when(out == "", " ").otherwise(out).alias("sentence1"))


_LABELLED = """lab AS (SELECT d.doc_id, d.text, CASE WHEN l.quality = 0 THEN -1 ELSE l.toxic END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _labelled(spark, sf):
    d = _docs(spark, sf)
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id").select("doc_id", "text", F.when(F.col("quality") == 0, -1)
                                        .otherwise(F.col("toxic")).alias("label"))


@register("filter_unlabelled", X.with_ctes(_LABELLED) + "SELECT doc_id, label FROM lab WHERE label <> -1")
def q_filter_unlabelled(spark, sf):
    return OT.filter_unlabelled(_labelled(spark, sf)).select("doc_id", "label")


@register("rename_columns", X.with_ctes(_LABELLED) + "SELECT doc_id, text AS sentence1, label FROM lab")
def q_rename_columns(spark, sf):
    return _labelled(spark, sf).withColumnsRenamed({"text": "sentence1"})


@register("project_text_label", X.with_ctes(_LABELLED) + "SELECT text, label FROM lab")
def q_project_text_label(spark, sf):
    return _labelled(spark, sf).select("text", "label")


@register("display_names", """
SELECT DISTINCT lang || '_' || source AS dataset,
       upper(substr(replace(lang || '_' || source, '_', ' '), 1, 1)) || substr(replace(lang || '_' || source, '_', ' '), 2) AS display
FROM documents""")
def q_display_names(spark, sf):
    d = _docs(spark, sf).select(F.concat_ws("_", "lang", "source").alias("dataset")).distinct()
    return d.select("dataset", TX.display_name("dataset").alias("display"))


@register("clean_token", f"""
SELECT doc_id, list_transform({tok_sql('text')}, lambda t: replace('Ġ' || t, 'Ġ', '_')) AS tokens FROM documents""")
def q_clean_token(spark, sf):
    d = _docs(spark, sf)
    marked = F.transform(TX.tokens_basic("text"), lambda t: F.concat(F.lit("Ġ"), t))
    return d.select("doc_id", F.transform(marked, lambda t: TX.clean_token(t)).alias("tokens"))


@register("tokens_basic", f"SELECT doc_id, {tok_sql('text')} AS tokens FROM documents")
def q_tokens_basic(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.tokens_basic("text").alias("tokens"))


@register("add_tokens", _PAIR_TOKS + "SELECT uid, p AS tokens_a, h AS tokens_b FROM pt")
def q_add_tokens(spark, sf):
    """Pair tokens as ``struct(a, b)``; the registered view flattens the struct."""
    t = _pair_toks(spark, sf)
    s = t.select("uid", F.struct(F.col("p").alias("a"), F.col("h").alias("b")).alias("tokens"))
    return s.select("uid", F.col("tokens.a").alias("tokens_a"), F.col("tokens.b").alias("tokens_b"))


@register("tokens_per_row_length", _PAIR_TOKS + """
SELECT uid, CAST(len(p) + len(h) AS INTEGER) AS length, CAST(len(p) * len(h) AS INTEGER) AS product_length FROM pt""")
def q_tokens_per_row_length(spark, sf):
    t = _pair_toks(spark, sf)
    return t.select("uid", (F.size("p") + F.size("h")).alias("length"),
                    (F.size("p") * F.size("h")).alias("product_length"))


@register("length_filter", _PAIR_TOKS + """
SELECT uid, CAST(len(p) + len(h) AS INTEGER) AS length FROM pt WHERE len(p) + len(h) BETWEEN 10 AND 400""")
def q_length_filter(spark, sf):
    t = _pair_toks(spark, sf).select("uid", (F.size("p") + F.size("h")).alias("length"))
    return OT.length_filter(t, "length", 10, 400)


_IDS_SQL = f"""ids AS (SELECT doc_id, [1] || list_transform({tok_sql('text')}, lambda t: CAST(length(t) AS INTEGER) + 3) || [2] AS input_ids
  FROM documents)"""


def _ids(spark, sf):
    t = TX.tokens_basic("text")
    return _docs(spark, sf).select(
        "doc_id", F.concat(F.array(F.lit(1)), F.transform(t, lambda x: F.length(x) + 3), F.array(F.lit(2)))
        .alias("input_ids"))


@register("drop_special_tokens", X.with_ctes(_IDS_SQL) +
          "SELECT doc_id, input_ids[2:len(input_ids) - 1] AS input_ids FROM ids")
def q_drop_special_tokens(spark, sf):
    return _ids(spark, sf).select("doc_id", TX.drop_special_tokens("input_ids").alias("input_ids"))


@register("pair_to_single", _PAIR_TOKS + """
SELECT uid, h AS tokens, uid AS details_original_uid, p AS details_other, h || p AS cat_tokens FROM pt""")
def q_pair_to_single(spark, sf):
    t = _pair_toks(spark, sf)
    s = t.select("uid", F.col("h").alias("tokens"),
                 F.struct(F.col("uid").alias("original_uid"), F.col("p").alias("other")).alias("details"),
                 F.concat("h", "p").alias("cat_tokens"))
    return s.select("uid", "tokens", F.col("details.original_uid").alias("details_original_uid"),
                    F.col("details.other").alias("details_other"), "cat_tokens")


@register("concat_pair_positions", _PAIR_TOKS + """
SELECT uid, p || h AS tokens, CAST(range(0, len(p) + len(h)) AS INTEGER[]) AS position_ids,
       CAST(len(p) AS INTEGER) AS b_offset FROM pt""")
def q_concat_pair_positions(spark, sf):
    t = _pair_toks(spark, sf)
    return t.select("uid", F.concat("p", "h").alias("tokens"),
                    TX.concat_positions(F.size("p"), F.size("h")).alias("position_ids"),
                    F.size("p").alias("b_offset"))


# ----------------------------------------------------------- probability ops
_LP_SQL = X.with_ctes(X.EXAMPLES_SQL, X.RUNS_SQL, X.PREDICTIONS_SQL) + """, lp AS (
  SELECT id, run, [ln(1 - p1), ln(p1 * 0.6), ln(p1 * 0.4)] AS log_probs,
         [(1 - p1) * 4 - 2, p1 * 4 - 2] AS logits FROM preds)"""


def _lp(spark, sf):
    ex = X.examples(spark, sf)
    pr = X.predictions(ex).withColumn("p1", F.element_at("probs", 2))
    return pr.select("id", "run",
                     F.array(F.log(1 - F.col("p1")), F.log(F.col("p1") * 0.6), F.log(F.col("p1") * 0.4))
                     .alias("log_probs"),
                     F.array((1 - F.col("p1")) * 4 - 2, F.col("p1") * 4 - 2).alias("logits"))


def _lse_sql(v: str) -> str:
    return f"(list_max({v}) + ln(list_reduce(list_transform({v}, lambda x: exp(x - list_max({v}))), lambda a, b: a + b, 0.0::DOUBLE)))"


@register("collapse_labels", _LP_SQL + f"""
SELECT id, run, [round(log_probs[1], 6), round({_lse_sql('log_probs[2:3]')}, 6)] AS log_probs2,
       CAST(CASE WHEN log_probs[1] >= {_lse_sql('log_probs[2:3]')} THEN 0 ELSE 1 END AS INTEGER) AS predicted
FROM lp""")
def q_collapse_labels(spark, sf):
    t = _lp(spark, sf).withColumn("lp2", S.collapse_log_probs("log_probs"))
    return t.select("id", "run", F.transform("lp2", lambda x: F.round(x, 6)).alias("log_probs2"),
                    S.argmax("lp2").alias("predicted"))


@register("softmax", _LP_SQL + """
SELECT id, run, list_transform(list_transform(logits, lambda x: exp(x - list_max(logits))),
       lambda e: round(e / (exp(logits[1] - list_max(logits)) + exp(logits[2] - list_max(logits))), 6)) AS probs
FROM lp""")
def q_softmax(spark, sf):
    return _lp(spark, sf).select("id", "run", F.transform(S.softmax("logits"), lambda x: F.round(x, 6)).alias("probs"))


@register("argmax_label", _LP_SQL + """
SELECT id, run, CAST(list_position(log_probs, list_max(log_probs)) - 1 AS INTEGER) AS predicted FROM lp""")
def q_argmax_label(spark, sf):
    return _lp(spark, sf).select("id", "run", S.argmax("log_probs").alias("predicted"))


@register("ensemble_log_probs", _LP_SQL + f""", s AS (
  SELECT id, run, list_transform(list_zip(log_probs[1:2], list_transform(logits, lambda x: x - {_lse_sql('logits')})),
                                 lambda z: z[1] + z[2]) AS v FROM lp)
SELECT id, run, list_transform(v, lambda x: round(x - {_lse_sql('v')}, 6)) AS log_probs FROM s""")
def q_ensemble_log_probs(spark, sf):
    t = _lp(spark, sf)
    e = S.ensemble_log_probs(F.slice("log_probs", 1, 2), "logits")
    return t.select("id", "run", F.transform(e, lambda x: F.round(x, 6)).alias("log_probs"))


@register("weighted_loss", X.REPORT_SQL + """
SELECT id, run, round(loss * (1 + y), 6) AS weighted_loss FROM bpreds""")
def q_weighted_loss(spark, sf):
    bp = X.base_predictions(X.examples(spark, sf))
    return bp.select("id", "run", r6(F.col("loss") * (1 + F.col("y"))).alias("weighted_loss"))


@register("type_from_label", X.with_ctes(X.EXAMPLES_SQL) +
          "SELECT id, CASE WHEN y = 1 THEN 'toxic' ELSE 'non-toxic' END AS type FROM examples")
def q_type_from_label(spark, sf):
    return X.examples(spark, sf).select("id", TX.type_from_label("y", "toxic", "non-toxic").alias("type"))


# A user table of emoji aliases (fixed values for the check).
EMOJI_ALIASES = [("\U0001F642", "slightly_smiling_face"), ("\U0001F621", "pouting_face"),
                 ("\U0001F44D", "thumbs_up"), ("❤️", "red_heart")]
_EMOJI_MARKED = "text || ' \U0001F642 ok \U0001F44D\U0001F621 ❤️'"


def _demojize_sql() -> str:
    x = _EMOJI_MARKED
    for e, a in sorted(EMOJI_ALIASES, key=lambda p: -len(p[0])):
        x = f"replace({x}, '{e}', ':{a}:')"
    return f"SELECT doc_id, {x} AS text FROM documents"


@register("demojize", _demojize_sql())
def q_demojize(spark, sf):
    """Emoji → ``:alias:`` from a user alias table (checked size, broadcast to
    an Arrow-batched replacement)."""
    d = _docs(spark, sf).select("doc_id", F.concat(F.col("text"), F.lit(" \U0001F642 ok \U0001F44D\U0001F621 ❤️"))
                                .alias("text"))
    aliases = spark.createDataFrame(EMOJI_ALIASES, "emoji string, alias string")
    return OT.demojize(d, "text", aliases).select("doc_id", "text")


@register("stream_clean", f"""
SELECT doc_id, {{clean}} AS clean, CAST(len({tok_sql("{clean}")}) AS INTEGER) AS n_tokens FROM documents""".replace(
    "{clean}", "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\\\[USER\\\\]*\\\\s*', '', 'g'), '^\\\\s+', ''), '\\\\s+$', ''), '\\\\[URL\\\\]*\\\\s*', '', 'g'), '^\\\\s+', ''), '\\\\s+$', ''), '\\\\[USER\\\\]*\\\\s*\\\\[URL\\\\]*', '', 'g'), '^\\\\s+', ''), '\\\\s+$', '')"))
def q_stream_clean(spark, sf):
    """Documents streamed through the cleaning operators (Structured
    Streaming, ``availableNow``), read back from the parquet sink."""
    from sievekit.sources.files import scratch_path
    from sievekit.streaming.clean import run_clean_stream
    src, sink, ck = (scratch_path(spark, n) for n in ("stream_src", "stream_sink", "stream_ckpt"))
    docs = _docs(spark, sf).select("doc_id", "text")
    docs.write.mode("overwrite").parquet(src)
    run_clean_stream(spark, src, sink, ck, docs.schema)
    return spark.read.parquet(sink).select("doc_id", "clean", "n_tokens")
