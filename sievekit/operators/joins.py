"""Joins, set operations and reshapes that carry the reference's row-position
and dictionary logic as keyed relational operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.operators.rank import distributed_rank

#: Characters of the patterns of one automaton; more patterns are searched in several passes.
AUTOMATON_CHARS = 8_000_000


def _clean(patterns: DataFrame, pattern_col: str) -> DataFrame:
    """Distinct patterns but those that hold ``[UNK]`` (as in the reference) or nothing."""
    p = F.col(pattern_col)
    return patterns.select(p.alias("p")).where(~p.contains("[UNK]") & (p != "")).distinct()


def literal_matches(texts: DataFrame, patterns: DataFrame, text_col: str = "text", pattern_col: str = "pattern",
                    out_col: str = "matched", chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``texts`` with ``out_col``: whether the text holds any of the patterns, letters in either case.

    An Aho–Corasick automaton over the lower-cased patterns reads each text once, up to its first hit, whatever the
    number of patterns.  An automaton holds patterns of about ``chars`` characters; more of them are dealt by hash to
    several, each with a pass over the rows (a row that has matched is not read again).  A null text does not match."""
    clean = _clean(patterns, pattern_col).select(F.lower("p").alias("p")).distinct().checkpoint(eager=True)
    total = clean.agg(F.sum(F.length("p"))).first()[0] or 0
    out = texts.withColumn("_low", F.lower(F.col(text_col))).withColumn(out_col, F.lit(False))
    turns = -(-total // chars)
    for k in range(turns):
        part = clean if turns == 1 else clean.where(F.pmod(F.xxhash64("p"), F.lit(turns)) == k)
        out = _searched(out, [r["p"] for r in part.collect()], out_col)     # about ``chars`` characters
    return out.drop("_low")


def _searched(df: DataFrame, words: list[str], out_col: str) -> DataFrame:
    handle = df.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import ahocorasick
        import pyarrow as pa
        find = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in handle.value:
            find.add_word(w)
        find.make_automaton()
        for b in batches:
            hit = [h or (t is not None and next(find.iter(t), None) is not None)
                   for t, h in zip(b.column("_low").to_pylist(), b.column(out_col).to_pylist())] if handle.value else b.column(out_col)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.bool_()) if c == out_col else b.column(c) for c in b.schema.names],
                                             names=b.schema.names)
    return df.mapInArrow(run, df.schema)


def pattern_regex(patterns: DataFrame, pattern_col: str = "pattern", chars: int = AUTOMATON_CHARS) -> str | None:
    """Fold a table of regular expressions into one case-insensitive alternation, compiled once a task.  The table
    must hold at most ``chars`` characters, as a query's own text would; mined words are literals and have no bound."""
    clean = _clean(patterns, pattern_col)
    if (clean.agg(F.sum(F.length("p"))).first()[0] or 0) > chars:
        raise ValueError(f"regular expressions of more than {chars} characters; search literals instead")
    found = sorted(r["p"] for r in clean.collect())
    return "(?iu)" + "|".join(f"(?:{p})" for p in found) if found else None


def pattern_join(texts: DataFrame, patterns: DataFrame, text_col: str = "text",
                 pattern_col: str = "pattern", literal: bool = False) -> DataFrame:
    """Rows of ``texts`` whose text matches any pattern (case-insensitive): a filter, no join, no shuffle.  ``literal``
    takes patterns as they stand and searches any number of them at once (``literal_matches``)."""
    if literal:
        return literal_matches(texts, patterns, text_col, pattern_col, "_matched").where("_matched").drop("_matched")
    rx = pattern_regex(patterns, pattern_col)
    if rx is None:
        return texts.limit(0)
    return texts.filter(F.col(text_col).rlike(rx))


def explode_examples(groups: DataFrame, examples_col: str = "examples") -> DataFrame:
    """Split a group's comma-joined examples into trimmed patterns."""
    return (groups.select("*", F.explode(F.split(F.col(examples_col), ",")).alias("_p"))
            .withColumn("pattern", F.trim("_p")).drop("_p").filter(F.col("pattern") != ""))


def group_sentences_to_document(df: DataFrame, doc_col: str, pos_col: str,
                                value_cols: Sequence[str], label_col: str) -> DataFrame:
    """Sentence rows → one row per document: arrays of the value columns in
    sentence order and the label of the first sentence.  A document is one
    group (bounded by its own size)."""
    s = F.sort_array(F.collect_list(F.struct(F.col(pos_col), *[F.col(c) for c in value_cols],
                                             F.col(label_col).alias("_lab"))))
    agg = df.groupBy(doc_col).agg(s.alias("_s"))
    def field(name):
        return lambda x: x[name]
    cols = [F.transform("_s", field(c)).alias(c + "s") for c in value_cols]
    return agg.select(doc_col, *cols, F.col("_s")[0]["_lab"].alias(label_col),
                      F.size("_s").alias("n_sentences"))


def drop_rows_by_rank(df: DataFrame, order: Sequence, ranks: Sequence[int]) -> DataFrame:
    """Drop rows by their position in an explicit order (``iloc``-style drop)."""
    r = distributed_rank(df, list(order), rank_col="_pos")
    return r.filter(~F.col("_pos").isin(list(ranks))).drop("_pos")


def slice_by_rank(df: DataFrame, order: Sequence, start: int | None, stop: int | None,
                  by: Sequence[str] = ()) -> DataFrame:
    """``iloc[start:stop]`` per group on an explicit order, negative indices
    counting from the end (e.g. ``slice(-k, -1)``)."""
    from sievekit.operators.rank import with_group_sizes
    r = with_group_sizes(distributed_rank(df, list(order), by, rank_col="_pos"), by, "_n")
    i = F.col("_pos") - 1  # 0-based position
    n = F.col("_n")

    def bound(v):
        return F.lit(v) if v is None or v >= 0 else n + F.lit(v)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (i >= bound(start))
    if stop is not None:
        cond = cond & (i < bound(stop))
    return r.filter(cond).drop("_pos", "_n")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "metric",
         value: str = "value") -> DataFrame:
    """Wide → long (``DataFrame.unpivot``)."""
    return df.unpivot(list(ids), list(values), var, value)
