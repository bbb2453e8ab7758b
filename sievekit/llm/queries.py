"""The registered queries of this package and the DuckDB SQL that states some of them.

``QUERIES[name](spark, sf_dir)`` applies an operator to its whole table; ``ORACLE``
holds SQL where SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import (decontaminate, language, licences, merkle, neardup, packing, quality, ranked, secrets, suffixes,
                          toxicity, vectors, warc)
from sievekit.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100""")
def op1_warc(spark, sf_dir):
    bundles = warc.write_bundles(table(spark, sf_dir, "pages"))
    return warc.read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_jaccard", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
       ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
      FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM o WHERE 100 * c >= 75 * (nx + ny - c)),
r(x, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT x, min(root) AS component_id FROM r GROUP BY x) m ON m.x = s.doc_id""")
def op3_jaccard(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@register("op4_packing")
def op4_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), added=packing.added_tokens())


@register("op5_quality")
def op5_quality(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_decontaminate", r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k,
             array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
      FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM g),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d, k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, g.item_id FROM dw JOIN g ON g.g = dw.g AND g.k = dw.k),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op6_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op7_licences")
def op7_licences(spark, sf_dir):
    return licences.scan_licences(table(spark, sf_dir, "documents")).drop("blocks")


@register("op8_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def op8_topk(spark, sf_dir):
    return vectors.top_k(table(spark, sf_dir, "embeddings"))


@register("op9_secrets")
def op9_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("found")


@register("op10_language")
def op10_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@register("op11_suffix_dedup", """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS s
      FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
x AS (SELECT w.r, w.i, i - lag(i) OVER (PARTITION BY w.r ORDER BY i) AS gap
      FROM w SEMI JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) t USING (s)),
g AS (SELECT r, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM x),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS z, lag(max(i) + 200, 1, 0) OVER (PARTITION BY r ORDER BY min(i)) AS after
      FROM g GROUP BY r, run),
k AS (SELECT r, sum(z - a) AS gone, count(*) AS n, max(z) AS z,
             string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS kept FROM s JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(from_hex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (r)""")
def op11_suffix_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


@register("op12_ranked_search", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
           FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest(list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM b) GROUP BY ALL),
p AS (SELECT r, doc_id, len(w) AS size, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d)
      SEMI JOIN q USING (term) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
      FROM p, c GROUP BY term, n),
s AS (SELECT q.item_id, q.text, p.r, p.doc_id, CAST(sum(times * weight * ((1000000000 * tf)
             // (1000 * tf + 8 * (100 - 75 + ((75 * size * n) // l))))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN t USING (term), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s WHERE score > 0) WHERE rank <= 10""")
def op12_ranked_search(spark, sf_dir):
    return ranked.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _merkle_sql(levels: int = 6) -> str:
    """The manifest with up to ``levels`` levels in each tree and in the top tree, one step a level: ``t`` holds the
    nodes, ``g`` the joined runs, ``d`` each row's place, folded node and proof so far."""
    def cell(c):
        v = f"CAST({c} AS VARCHAR)"
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({v})) || ':' || {v} END"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(cell(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = ("xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: "
           "CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)), CAST(4294967295 AS BIGINT))")
    out = [f"x AS (SELECT row_number() OVER () AS r, doc_id, source, sha256({head} || {cell('text')}) AS leaf, "
           f"sha256({head} || CASE WHEN {crc} % 5 = 0 THEN {cell(low)} ELSE {cell('text')} END) AS fold FROM documents)",
           "y AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid, row_number() OVER (PARTITION BY source "
           "ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM x)",
           "t0 AS (SELECT sid, p, n, leaf AS node FROM y)",
           "d0 AS (SELECT r, doc_id, leaf, sid, p, n, fold, '' AS proof FROM y)"]
    for k in range(2 * levels):
        if k == levels:  # the roots are the leaves of the top tree
            out += [f"t{k}a AS (SELECT sid AS s, node FROM t{k})",
                    f"t{k}b AS (SELECT 0 AS sid, s AS p, (SELECT count(*) FROM t{k}) AS n, node FROM t{k}a)",
                    f"d{k}a AS (SELECT r, doc_id, leaf, 0 AS sid, d{k}.sid AS p, (SELECT count(*) FROM t{k}) AS n, fold, proof, "
                    f"node AS subroot FROM d{k} JOIN t{k} USING (sid))"]
        t, d = (f"t{k}b", f"d{k}a") if k == levels else (f"t{k}", f"d{k}")
        keep = ", subroot" if k >= levels else ""
        out += [f"g{k} AS (SELECT sid, p // 16 AS up, n, string_agg(node, '' ORDER BY p) AS run FROM {t} GROUP BY ALL)",
                f"t{k + 1} AS (SELECT sid, up AS p, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS node FROM g{k})",
                f"d{k + 1} AS (SELECT r, doc_id, leaf, sid, up AS p, (d.n + 15) // 16 AS n, CASE WHEN d.n = 1 THEN fold ELSE "
                f"sha256(substr(run, 1, 64 * (p % 16)) || fold || substr(run, 64 * (p % 16) + 65)) END AS fold, proof || "
                f"substr(run, 1, 64 * (p % 16)) || substr(run, 64 * (p % 16) + 65) AS proof{keep} "
                f"FROM (SELECT *, p // 16 AS up FROM {d}) d JOIN g{k} USING (sid, up))"]
    k = 2 * levels
    return "WITH " + ",\n".join(out) + (f"\nSELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, "
                                        f"fold AS folded_root, fold = node AS verified FROM d{k}, t{k}")


@register("op13_merkle", _merkle_sql())
def op13_merkle(spark, sf_dir):
    return merkle.verify_documents(table(spark, sf_dir, "documents")).drop("source", "place")


@register("pipeline")
def pipeline(spark, sf_dir):
    """All stages of ``corpus_pipeline.py``, one after the other."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
