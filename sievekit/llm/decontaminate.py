"""Benchmark decontamination with a distributed positional inverted index.

DataFrame functions only.  The corpus frequency of every benchmark term is
counted first; each benchmark window then picks its rarest term as anchor.
Postings ``(term, document, position)`` are stored for anchor terms alone, each
with the words around it, because no other posting can start a match.  A
window's occurrences come from its anchor's postings, shifted by the anchor's
place in the window and intersected with the other terms from the second rarest
upward; what is left are exact phrase matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm._common import stash

#: Terms are broadcast only up to this many rows (some 10 MB); above it the same
#: joins run shuffled.
BROADCAST_TERMS = 200_000

UPPER, FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words, as the contract of the operator fixes them.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` serves texts that are all ASCII)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, FOLDED))


def words(text: Column) -> Column:
    """Words of a text in order; null or wordless gives an empty array."""
    return F.array_remove(F.split(fold_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _sized(df: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """Mark a stored table for broadcast if, and only if, its counted size allows it."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``(item_id, gram)``: the distinct ``size``-word windows of each item; a
    shorter item with words is one window, one without words has none."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return (w.where(F.size("w") > 0)
            .select("item_id", "w", F.explode(starts).alias("at"))
            .select("item_id", F.slice("w", F.col("at"), size).alias("gram")).distinct())


def anchors(docs: DataFrame, grams: DataFrame, size: int = 10) -> DataFrame:
    """``(gram, length, term, place)``: each distinct window with its rarest term,
    by corpus frequency (then by term and place).  Windows with a term the
    corpus lacks can not occur and are left out."""
    g = stash(grams.select("gram").distinct(), "grams")
    places = g.select("gram", F.posexplode("gram").alias("place", "term"))
    terms = _sized(stash(places.select("term").distinct(), "terms"))
    seen = (docs.select(F.explode(words(F.col("text"))).alias("term"))
            .join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq")))
    # one row per benchmark term: a left join keeps windows whose term is unseen, min() = 0 drops them
    rated = places.join(seen, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    return (rated.groupBy("gram").agg(F.min(F.struct("freq", "term", "place")).alias("rare"))
            .where(F.col("rare.freq") > 0)
            .select("gram", F.size("gram").alias("length"), F.col("rare.term").alias("term"),
                    F.col("rare.place").alias("place")))


def postings(docs: DataFrame, terms: DataFrame, size: int = 10) -> DataFrame:
    """The stored index: ``(term, key, pos, left, around)`` for every occurrence of
    an anchor term; ``around`` holds the words up to ``size - 1`` to either side
    and ``left`` how many of them precede the term."""
    w = docs.select("key", words(F.col("text")).alias("w"))
    reach = size - 1
    return (w.select("key", "w", F.posexplode("w").alias("pos", "term"))
            .join(terms, "term", "left_semi" if len(terms.columns) == 1 else "inner")
            .withColumn("left", F.least(F.col("pos"), F.lit(reach)))
            .select("term", "key", "pos", "left",
                    F.slice("w", F.col("pos") - F.col("left") + 1, F.col("left") + size).alias("around")))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Exact occurrences: ``(key, start, length, gram)``; ``docs`` has ``key, text``."""
    grams = windows(benchmark, size)
    rare = stash(anchors(docs, grams, size), "anchors")
    terms = _sized(stash(rare.select("term").distinct(), "anchor-terms"))
    index = stash(postings(docs, terms, size), "postings")
    offset = F.col("left") - F.col("place")
    return (index.join(_sized(rare), "term")
            .where((offset >= 0) & (F.slice("around", F.greatest(offset, F.lit(0)) + 1, F.col("length")) == F.col("gram")))
            .select("key", (F.col("pos") - F.col("place")).alias("start"), "length", "gram"))


def rare_terms(docs: DataFrame, grams: DataFrame, need: int) -> DataFrame:
    """``gram, term``: of each window with d distinct terms the d - need + 1 that the corpus holds least (by frequency,
    then term), without those it lacks.  A stretch that holds ``need`` of the terms holds one of these."""
    g = stash(grams.select("gram").distinct(), "grams")
    places = g.select("gram", F.size(F.array_distinct("gram")).alias("d"), F.explode(F.array_distinct("gram")).alias("term"))
    terms = _sized(stash(places.select("term").distinct(), "terms"))
    seen = (docs.select(F.explode(words(F.col("text"))).alias("term"))
            .join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq")))
    rated = places.join(seen, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    of = rated.groupBy("gram", "d").agg(F.array_sort(F.collect_list(F.struct("freq", "term"))).alias("r"))
    first = F.slice("r", 1, F.greatest(F.col("d") - F.least(F.lit(need), F.col("d")) + 1, F.lit(1)))
    return of.select("gram", F.explode(first).alias("t")).where("t.freq > 0").select("gram", F.col("t.term").alias("term"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, need: int = 8) -> DataFrame:
    """Looser matches: ``(key, gram, shared)`` where some stretch of ``size`` words of a document (``key, text``) holds at
    least ``need`` of a window's distinct terms (all of a window with fewer), in any order; ``shared`` is the most that
    one stretch holds.  Candidates come from the postings of ``rare_terms``, so a window of which up to
    ``d - need`` terms were replaced, its rarest among them, is found."""
    grams = windows(benchmark, size)
    rare = stash(rare_terms(docs, grams, need), "rare")
    terms = _sized(stash(rare.select("term").distinct(), "rare-terms"))
    index = stash(postings(docs, terms, size), "postings")
    # stretches that hold the posting: they begin at each of the words before it and at itself
    begins = F.sequence(F.lit(1), F.col("left") + 1)
    shared = F.array_max(F.transform(begins, lambda b: F.size(F.array_intersect(F.slice("around", b, size), F.col("gram")))))
    return (index.join(_sized(rare), "term").withColumn("shared", shared)
            .where(F.col("shared") >= F.least(F.lit(need), F.size(F.array_distinct("gram"))))
            .groupBy("key", "gram").agg(F.max("shared").alias("shared")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per row of ``docs``: n_words, n_hit, n_items, items_sha256, contaminated.

    Rows are told apart by (doc_id, text), so repeated rows get equal results and
    an id shared by two texts does not mix them.  Null or empty text: no words,
    no hits.  A null item_id takes no part in ``items_sha256``; an empty
    benchmark leaves every document clean.  Other columns are ignored.
    """
    return row_hits(docs, benchmark, size).drop("h")


def row_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``decontaminate`` with ``h``, the digest of the text: with the id it names the row judged."""
    docs = docs.select("doc_id", "text")
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    keyed = docs.select(key.alias("key"), "text")
    bench = benchmark.select(F.col("item_id"), F.col("text"))
    grams = stash(windows(bench, size), "windows")
    hits = stash(phrase_matches(keyed, bench, size), "hits")
    places = hits.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("p"))
    hit = places.distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    # one row per (document, item): items of one document, not of the corpus, meet in the array
    items = (hits.select("key", "gram").distinct().join(grams, "gram").select("key", "item_id").distinct()
             .where(F.col("item_id").isNotNull()).groupBy("key")
             .agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids")))
    found = hit.join(items, "key", "left").select(
        F.col("key.doc_id").alias("_id"), F.col("key.h").alias("_h"), "n_hit",
        F.coalesce(F.col("ids"), F.array().cast("array<string>")).alias("ids"))
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(
        F.regexp_count(fold_ascii(F.col("text")), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = base.join(found, base["doc_id"].eqNullSafe(found["_id"]) & (base["h"] == found["_h"]), "left")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    return out.select(
        base["doc_id"], base["h"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
