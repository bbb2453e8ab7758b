"""Licence scans by exact set-similarity containment.

Templates are short licence notices.  Terms are ordered by their frequency in the
whole corpus; a template's prefix is its rarest terms, one of which every text
block that contains enough of it must hold.  Blocks are runs of words around such
a hit; the length filter drops blocks with too few words and the positional
filter those whose later terms can no longer reach the threshold.  Blocks that
pass are measured exactly.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm._common import rows, stash
from sievekit.llm._words import NOT_ALNUM, U64, Words, hash_words, mix64, sliced

#: The base phrases and their labels, as the contract lists them.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices as licence stewards publish them, shortened to their opening words.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files",
    "apache-2": "licensed under the apache license version 2 0 you may not use this file except in compliance with the "
                "license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
           "the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
           "public license as published by the free software foundation",
    "gpl-3": "licensed under the gnu general public license version 3",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Share of a template's distinct terms a block must hold.
THRESHOLD = 0.8
#: A block is this many times as long as the template has words.
STRETCH = 1.25


def _count(wanted: np.ndarray):
    """Per task: how often each wanted word hash (sorted) occurs."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted), dtype=np.int64)
        for b in sliced(batches):
            h = Words(b.column("text"), NOT_ALNUM).hashes()
            at = np.searchsorted(wanted, h)
            at[at == len(wanted)] = 0
            n += np.bincount(at[wanted[at] == h], minlength=len(wanted))
        yield rows(schema, term=wanted.view(np.int64), n=n)
    return run


class Scanner:
    """Templates ready for the scan: term hashes rarest first, prefixes and needs."""

    def __init__(self, templates: dict[str, str], frequency: dict[int, int], threshold: float = THRESHOLD):
        self.phrases = [(hash_words(p.split()), label) for p, label in PHRASES.items()]
        self.templates = []
        for label, text in templates.items():
            words = text.split()
            terms = hash_words(sorted(set(words)))
            order = sorted(terms.tolist(), key=lambda t: (frequency.get(t, 0), t))
            need = max(1, -(-int(round(threshold * 1000)) * len(order) // 1000))
            self.templates.append((label, np.array(order, dtype=U64), need, max(need, int(STRETCH * len(words)))))
        # every template term with its place in the templates; the hit test is one search
        prefix = {t for _, o, need, _ in self.templates for t in o[:len(o) - need + 1].tolist()}
        self.prefix = np.array(sorted(prefix), dtype=U64)

    def base(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, str]]:
        """(text, start word, label) of every phrase place."""
        out = []
        for p, label in self.phrases:
            at = np.flatnonzero(h[:len(h) - len(p) + 1] == p[0]) if len(h) >= len(p) else np.zeros(0, dtype=np.int64)
            for k in range(1, len(p)):
                at = at[h[at + k] == p[k]]
            d = np.searchsorted(first, at, side="right") - 1
            fit = at + len(p) <= first[d + 1]
            out += [(int(t), int(a - first[t]), label) for t, a in zip(d[fit], at[fit])]
        return out

    def contained(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, str, float, int, int]]:
        """(text, label, containment, first word, end word): for each template the blocks of
        words that hold enough of it, by place; no two overlap, and no block that overlaps
        one of them holds more.  A block is cut to the words that count."""
        at = np.searchsorted(self.prefix, h)
        at[at == len(self.prefix)] = 0
        hits = np.flatnonzero(self.prefix[at] == h) if len(self.prefix) else np.zeros(0, dtype=np.int64)
        out = []
        of = np.searchsorted(first, hits, side="right") - 1
        for d in np.unique(of).tolist():
            own = hits[of == d]
            for label, order, need, width in self.templates:
                mine = own[np.isin(h[own], order[:len(order) - need + 1])]
                for n, a, e in self._blocks(h, int(first[d]), int(first[d + 1]), mine.tolist(), order, need, width):
                    out.append((d, label, n / len(order), a - int(first[d]), e - int(first[d])))
        return out

    def _blocks(self, h, low, high, hits, order, need, width) -> list[tuple[int, int, int]]:
        """(terms, from, to) of the blocks in h[low:high], left to right: the first hit that
        passes gives way to any overlapping block that holds more."""
        out: list[tuple[int, int, int]] = []
        todo = [(low, high)]                    # ranges still to search, the last one first
        while todo:
            low, high = todo.pop()
            top = None
            for i in hits[bisect_left(hits, low):bisect_left(hits, high)]:
                if top is not None and i >= top[2] + width:
                    break                       # no block of this hit reaches the one found
                a, e = max(low, i - width + 1), min(high, i + width)
                if e - a < need or np.isin(order, h[a:e]).sum() < need:     # length and positional filter
                    continue
                got = self._best_block(h, a, e, i, order, width)
                if got[0] >= need and (top is None or got[0] > top[0] and got[1] < top[2] and got[2] > top[1]):
                    top = got
            if top is not None:
                out.append(top)
                todo += [(top[2], high), (low, top[1])]
        return sorted(out, key=lambda x: x[1])

    @staticmethod
    def _best_block(h, a, e, i, order, width):
        """Most distinct terms in any ``width`` words of h[a:e] that include word i: (n, from,
        to), without the words at either end that add no term."""
        place = {t: k for k, t in enumerate(order.tolist())}
        ids = [place.get(t, -1) for t in h[a:e].tolist()]
        top = (0, a, e)
        for s in range(max(a, i - width + 1), min(i, e - 1) + 1):
            n = len({k for k in ids[s - a:s - a + width] if k >= 0})
            if n > top[0]:
                top = (n, s, min(s + width, e))
        n, s, t = top
        seen: set[int] = set()
        for t in range(s, top[2]):
            seen |= {ids[t - a]} - {-1}
            if len(seen) == n:
                break
        t += 1
        while s < t and (ids[s - a] < 0 or ids[s - a] in ids[s - a + 1:t - a]):
            s += 1
        return n, s, t


def corpus_frequency(docs: DataFrame, templates: dict[str, str]) -> dict[int, int]:
    """Corpus count of each template term (hash), over all texts."""
    wanted = np.unique(hash_words(sorted({w for t in templates.values() for w in t.split()})))
    got = (docs.select("text").mapInArrow(_count(wanted), "term bigint, n bigint")
           .groupBy("term").agg(F.sum("n").alias("n")).collect())
    return {int(np.int64(r["term"]).view(U64)): r["n"] for r in got}


_OUT = pa.list_(pa.struct([("label", pa.string()), ("containment", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    blocks`` for every row of ``docs``; ``blocks`` are the text blocks that hold a
    template (label, containment, words from and to).

    The score is 1 with a base phrase, else the best containment found, else 0.  Null,
    empty and wordless texts: no words, no labels ("").  Repeated rows give equal
    rows, an empty table none; other columns are ignored."""
    templates = TEMPLATES if templates is None else templates
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    scanner = Scanner(templates, corpus_frequency(own, templates), threshold)
    kind = dict(own.dtypes)["doc_id"]

    def run(batches):
        for b in sliced(batches):
            w = Words(b.column("text"), NOT_ALNUM)
            h, n = w.hashes(), b.num_rows
            base: list[list] = [[] for _ in range(n)]
            more: list[list] = [[] for _ in range(n)]
            for d, at, label in scanner.base(h, w.first):
                base[d].append((at, label))
            for d, label, c, a, e in scanner.contained(h, w.first):
                more[d].append({"label": label, "containment": c, "first": a, "end": e})
            names = [sorted({x[1] for x in p}) for p in base]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array([len(p) for p in base], pa.int64()),
                 pa.array([min((x[0] for x in p), default=None) for p in base], pa.int64()),
                 pa.array([max((x[0] for x in p), default=None) for p in base], pa.int64()),
                 pa.array([",".join(x) for x in names], pa.string()),
                 pa.array([",".join(sorted({*x, *(m["label"] for m in q)})) for x, q in zip(names, more)], pa.string()),
                 pa.array([1.0 if p else max((m["containment"] for m in q), default=0.0) for p, q in zip(base, more)],
                          pa.float64()),
                 pa.array(more, _OUT)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])
    return own.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                               "base_labels string, labels string, score double, "
                               "blocks array<struct<label:string,containment:double,first:bigint,end:bigint>>")
