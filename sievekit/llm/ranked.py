"""Ranked lexical search, term at a time with a limited set of accumulators.

Documents are cut into blocks; one pass over the texts stores for each block
the document lengths and the postings of the terms that any query holds.
Corpus statistics (documents, words, document frequencies) come from the stored
blocks, so scores are global although blocks are scored on their own.

In a block each query takes its terms rarest first.  A document gets an
accumulator when a posting first meets it.  Before each term the best that the
remaining terms could give together, from the largest contribution of each in
the block, is held against the k-th largest partial score: once it is smaller, a
document without an accumulator can not be among the k best any more, and no
more accumulators are made.  The survivors are updated with all remaining terms,
so their scores are exact.  The k best of each block meet per query.

A hot term is split by documents, never gathered; queries travel in blocks of a
bounded number of terms, with a pass over the texts for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm._common import rows, stash
from sievekit.llm._words import NOT_ALNUM, Words, hash_words, sliced
from sievekit.llm.decontaminate import words

#: Documents of a block, and postings after which a block ends in any case.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 4 << 20
#: (query, term) rows that travel to the tasks at once; more go in several turns.
TERM_ROWS = 200_000

INDEX = ("ids array<bigint>, n_docs bigint, n_words bigint, size binary, terms binary, starts binary, "
         "place binary, tf binary")
_INDEX = pa.schema([("ids", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_words", pa.int64()), ("size", pa.binary()),
                    ("terms", pa.binary()), ("starts", pa.binary()), ("place", pa.binary()), ("tf", pa.binary())])


def query_terms(items: DataFrame) -> DataFrame:
    """``item_id, h, term, times``: the terms of each distinct (item_id, text)."""
    w = items.select("item_id", "text", F.xxhash64("text").alias("h")).distinct()
    return (w.select("item_id", "h", F.explode(words(F.col("text"))).alias("term"))
            .groupBy("item_id", "h", "term").agg(F.count("*").alias("times")))


class _Block:
    """Postings of the documents of a block, gathered slice by slice."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.postings = 0

    def add(self, ids: pa.Array, w: Words, known: np.ndarray, lengths: np.ndarray) -> None:
        h = w.hashes()
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        hit = np.flatnonzero((known[at] == h) & (lengths[at] == w.ends - w.starts)) if len(known) else at[:0]
        doc = np.searchsorted(w.first, hit, side="right") - 1
        pair, tf = np.unique(doc * len(known) + at[hit], return_counts=True)
        self.ids.append(ids)
        self.sizes.append(w.counts.astype(np.int64))
        if len(pair):
            self.found.append((pair % len(known), pair // len(known) + self.docs, tf))
        self.docs += len(ids)
        self.postings += len(pair)

    def row(self) -> pa.RecordBatch:
        size = np.concatenate(self.sizes)
        term, doc, tf = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.zeros(0, dtype=np.int64),) * 3
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        terms, starts = np.unique(term, return_index=True)
        cells = {"size": size, "terms": terms.astype(np.int32), "starts": np.append(starts, len(term)).astype(np.int64),
                 "place": doc.astype(np.int32), "tf": tf.astype(np.int32)}
        return rows(_INDEX, ids=pa.array([pa.concat_arrays(self.ids).to_pylist()], _INDEX.field("ids").type),
                    n_docs=[int((size > 0).sum())], n_words=[int(size.sum())], **{c: [v.tobytes()] for c, v in cells.items()})


def _postings(terms: list[str], block_docs: int):
    """Stored postings of ``terms`` (a term is known by the 64-bit hash of its bytes and its length)."""
    known = hash_words(terms)
    order = np.argsort(known)
    number, lengths = order, np.array([len(t.encode()) for t in terms], dtype=np.int64)[order]
    known = known[order]

    def run(batches: Iterator[pa.RecordBatch]):
        block = _Block()
        for b in sliced(batches):
            for i in range(0, b.num_rows, block_docs):
                part = b.slice(i, block_docs)
                block.add(part.column("doc_id"), Words(part.column("text"), NOT_ALNUM), known, lengths)
                if block.docs >= block_docs or block.postings >= BLOCK_POSTINGS:
                    yield block.row()
                    block = _Block()
        if block.docs:
            yield block.row()
    return run, number


def _cells(row: dict) -> tuple[np.ndarray, ...]:
    kinds = {"size": np.int64, "terms": np.int32, "starts": np.int64, "place": np.int32, "tf": np.int32}
    return tuple(np.frombuffer(row[c], dtype=k) for c, k in kinds.items())


_HELD = pa.schema([("term", pa.int32()), ("df", pa.int64())])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, block by block."""
    for b in batches:
        for terms, starts in zip(b.column("terms").to_pylist(), b.column("starts").to_pylist()):
            yield rows(_HELD, term=np.frombuffer(terms, dtype=np.int32), df=np.diff(np.frombuffer(starts, dtype=np.int64)))


def _contribution(tf: np.ndarray, m: np.ndarray, weight: int) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _length_norm(size: np.ndarray, n: int, total: int) -> np.ndarray:
    if not len(size) or 75 * int(size.max()) * n < 1 << 63:
        return 25 + (75 * size * n) // max(total, 1)
    return np.array([25 + 75 * int(s) * n // total for s in size], dtype=np.int64)


def best_of_block(query: list[tuple[int, int]], at: dict[int, tuple[np.ndarray, np.ndarray]], most: dict[int, int],
                  n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, accumulators made) among which are the ``k`` best of the block; ``query`` holds (term, times) rarest
    first, ``at`` each term's documents and contributions, ``most`` its largest one."""
    score = np.zeros(n_docs, dtype=np.int64)
    made = np.zeros(n_docs, dtype=bool)
    left = np.cumsum([times * most[t] for t, times in reversed(query)])[::-1]
    growing, count = True, 0
    for (term, times), bound in zip(query, left):
        where, value = at[term]
        if growing and count >= k:
            partial = score[made]
            growing = int(bound) >= int(np.partition(partial, len(partial) - k)[len(partial) - k])
        if growing:
            made[where] = True
            count = int(made.sum())
        else:
            alive = made[where]
            where, value = where[alive], value[alive]
        score[where] += times * value
    kept = np.flatnonzero(made & (score > 0))
    if len(kept) > k:
        s = score[kept]
        kept = kept[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return kept, score[kept], count


BEST = "item int, doc_id bigint, score bigint"
_BEST = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search(queries: list[list[tuple[int, int]]], weight: dict[int, int], n: int, total: int, k: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                size, terms, starts, place, tf = _cells(row)
                norm = _length_norm(size, n, total)
                at, most = {}, {}
                for i, t in enumerate(terms.tolist()):
                    where = place[starts[i]:starts[i + 1]]
                    value = _contribution(tf[starts[i]:starts[i + 1]].astype(np.int64), norm[where], weight[t])
                    at[t], most[t] = (where, value), int(value.max())
                item, doc, score = [], [], []
                for q, query in enumerate(queries):
                    here = [(t, times) for t, times in query if t in at]
                    if here:
                        best, s, _ = best_of_block(here, at, most, len(size), k)
                        ids = [row["ids"][d] for d in best.tolist()]
                        order = sorted(range(len(ids)), key=lambda i: (-int(s[i]), ids[i] is None, ids[i] or 0))[:k]
                        item += [q] * len(order)
                        doc += [ids[i] for i in order]
                        score += [int(s[i]) for i in order]
                if item:
                    yield rows(_BEST, item=item, doc_id=doc, score=score)
    return run


def _turn(docs: DataFrame, wanted: DataFrame, k: int, block_docs: int) -> DataFrame:
    """Best documents of one bounded set of queries."""
    spark = docs.sparkSession
    got = wanted.select("item_id", "h", "term", "times").collect()  # at most TERM_ROWS and one query's
    terms = sorted({r.term for r in got})
    run, number = _postings(terms, block_docs)
    of = {terms[j]: i for i, j in enumerate(number.tolist())}
    index = stash(docs.select("doc_id", "text").mapInArrow(run, INDEX), "postings")
    n, total = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    df = {r.term: r.df for r in index.select("terms", "starts").mapInArrow(_held, "term int, df bigint")
          .groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most one row a term
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    names = sorted({(r.item_id, r.h) for r in got}, key=repr)
    queries: list[list[tuple[int, int]]] = [[] for _ in names]
    at = {name: i for i, name in enumerate(names)}
    for r in got:
        if of[r.term] in df:
            queries[at[r.item_id, r.h]].append((of[r.term], r.times))
    for q in queries:
        q.sort(key=lambda x: (df[x[0]], x[0]))
    best = index.mapInArrow(_search(queries, weight, n, total, k), BEST)
    kind = wanted.schema["item_id"].dataType.simpleString()
    named = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(names)], f"item int, item_id {kind}")
    first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
            .join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, term_rows: int = TERM_ROWS,
                  block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best rows of ``docs`` (doc_id long, text) for each item
    (item_id, text), scores above 0 only, equal ones by ascending doc_id (null ids last).

    Null, empty and wordless texts have no terms: such documents are never found and count in no average, such
    items have no rows.  A repeated document row is a document of its own; an item repeated whole is one item,
    one id with two texts is two, each with its own ranks.  Other columns are not read.  Empty tables give no
    rows.  Items go to the tasks in turns of about ``term_rows`` (item, term) pairs, each with a pass over the texts.
    """
    wanted = stash(query_terms(items), "terms")
    turns = max(1, -(-wanted.count() // term_rows))
    out = None
    for t in range(turns):
        mine = wanted.where(F.pmod(F.xxhash64("item_id", "h"), F.lit(turns)) == t)
        found = _turn(docs, mine, k, block_docs)
        out = found if out is None else out.unionByName(found)
    return out
