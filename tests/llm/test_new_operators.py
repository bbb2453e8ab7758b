"""Repeated strings, ranked search and the Merkle manifest against brute force, odd rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm import decontaminate, language, merkle, ranked, suffixes, vectors
from tests.llm.test_operators import DOCS, ODD, WORDS, docs


# ------------------------------------------------------------------ op11
def _without_repeats(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                gone[i:i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("seed,length,part", [(1, 200, 1 << 19), (2, 40, 1 << 19), (5, 200, 700)])
def test_repeats_match_brute_force(spark, monkeypatch, seed, length, part):
    monkeypatch.setattr(suffixes, "PART", part)
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé中") for _ in range(rng.randint(1, 7))) for _ in range(9 if seed % 2 else 30)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(9)]
    texts = [t for _, t in ODD] + ["ab" * 700, "a" * 500, "a" * 201, "a" * 199]     # runs that repeat within themselves
    for _ in range(70):
        t = " ".join(rng.choice(passages) if rng.random() < .4 else "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(1, 300)))
                     for _ in range(rng.randint(1, 4)))
        texts += [t] * (1 + (rng.random() < .1))
    df = docs(spark, list(enumerate(texts))).repartition(4)
    got = sorted(tuple(r)[:5] + (bytes(r.kept),) for r in suffixes.remove_repeats(df, length, keep_bytes=True).collect())
    assert got == [(k, *w) for k, w in enumerate(_without_repeats(texts, length))]


def test_repeats_odd_rows(spark):
    """Null and repeated ids are rows like any other; whole copies go, in every row."""
    t = " ".join(f"w{k}" for k in range(80))
    got = suffixes.remove_repeats(docs(spark, [(None, t), (None, t), (3, t[:199]), (3, None), (4, "")])).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in got) == \
        [(0, len(t), len(t), 1)] * 2 + [(3, 0, 0, 0), (3, 199, 0, 0), (4, 0, 0, 0)]
    assert suffixes.remove_repeats(docs(spark, [(1, "x")]).limit(0)).count() == 0


def test_strings_share_their_sample():
    """Equal strings hold a sample at the same offset, whatever stands around them."""
    rng = np.random.default_rng(2)
    common = rng.integers(97, 103, 260, dtype=np.uint8)
    place = []
    for before in (0, 3, 57, 400):
        raw = np.concatenate([rng.integers(97, 103, before, dtype=np.uint8), common, rng.integers(97, 103, 300, dtype=np.uint8)])
        first, last, at, name = suffixes.Strings(raw, np.array([len(raw)]), 200).samples()
        assert (first <= at).all() and (at <= last + 200 - suffixes.gram_size(200)).all()
        of = {i: int(a) - before for f, z, a in zip(first, last, at) for i in range(int(f) - before, int(z) - before + 1)}
        place.append([of[i] for i in range(61)])
    assert place[0] == place[1] == place[2] == place[3]


# ------------------------------------------------------------------ op12
def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _ranked(rows, items, k):
    w = [_terms(t) for _, t in rows]
    n, total = sum(map(bool, w)), sum(map(len, w))
    tf = [Counter(x) for x in w]
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for (doc, _), c, x in zip(rows, tf, w):
            m = 100 - 75 + (75 * len(x) * n) // total if x else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in _terms(text) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_ranked_search_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(WORDS) if rng.random() < .6 else rng.choice(WORDS).upper() + str(int(rng.paretovariate(.7)) % 400)
    rows = [(k, rng.choice((" ", ".\n")).join(word() for _ in range(rng.randint(1, 60)))) for k in range(300)]
    rows += [*ODD, rows[3], (900, rows[3][1]), (-5, rows[3][1])]     # repeated rows and ties
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 30)))) for k in range(25)]
    items += [(30, None), (31, ""), (32, " .,"), (33, "notthere"), (0, items[0][1]), (1, rows[5][1] + " " + rows[5][1]), (None, "alpha beta")]
    df = docs(spark, rows)
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    want = _ranked(rows, items, 10)
    for terms, block in ((200_000, 8192), (60, 32)):
        got = ranked.ranked_search(df, it, 10, terms, block).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert ranked.ranked_search(df.limit(0), it).count() == 0 and ranked.ranked_search(df, it.limit(0)).count() == 0


def test_accumulators_stop_and_survivors_stay_exact():
    """With a rare strong term first, later terms make no accumulator, and the best are those of a full sum."""
    rng = np.random.default_rng(1)
    n = 2000
    at = {0: (np.arange(0, 40), rng.integers(900, 1000, 40))}
    for t in range(1, 6):
        where = np.sort(rng.choice(n, 1200, replace=False))
        at[t] = (where, rng.integers(1, 100, 1200))
    most = {t: int(v.max()) for t, (_, v) in at.items()}
    query = [(t, 1) for t in range(6)]
    full = np.zeros(n, dtype=np.int64)
    for where, value in at.values():
        full[where] += value
    best, score, made = ranked.best_of_block(query, at, most, n, 10)
    assert made == 40 and (score == full[best]).all()
    assert sorted(score)[-10:] == sorted(full)[-10:]


# ------------------------------------------------------------------ op13
def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(nodes):
    """(root, joined siblings per level of each leaf) of a list of digests."""
    place, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for leaf, p in enumerate(place):
            run = runs[p // 16]
            proofs[leaf].append((run[:p % 16], run[p % 16 + 1:]))
            place[leaf] = p // 16
        nodes = [_sha("".join(r)) for r in runs]
    return nodes[0], proofs


def _manifest(rows):
    def cell(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return _sha("".join(cell(x) for x in (r[0], r[3], r[2], r[4], text)))
    order = sorted(rows, key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, leaf(r, r[1])))
    groups = {}
    for r in order:
        groups.setdefault(r[3], []).append(r)
    trees = {s: _tree([leaf(r, r[1]) for r in g]) for s, g in groups.items()}
    root, top = _tree([t[0] for t in trees.values()])
    out = []
    for k, (s, g) in enumerate(groups.items()):
        for i, r in enumerate(g):
            proof = trees[s][1][i] + top[k]
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node = leaf(r, text)
            for a, b in proof:
                node = _sha("".join(a) + node + "".join(b))
            out.append((r[0], leaf(r, r[1]), trees[s][0], root, _sha("".join("".join(a + b) for a, b in proof)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4096, 50, 7])
def test_manifest_matches_plain_trees(spark, block):
    rng = random.Random(6)
    rows = [(k, rng.choice(("Upper É", "lower", "", None, "中 Ab")) , rng.choice(("en", None)),
             rng.choice(("s0",) * 6 + ("s1", "é", "Z", None, f"tiny{k}")), rng.choice((1, None)), 0.5, 1, "k") for k in range(700)]
    rows += [rows[5], rows[5], (None, "Ab", "en", "s0", 1, 0.5, 1, "k"), (9, "Other", "en", "s0", 1, 0.5, 1, "k"), (5, "x " * 30000, "en", "s1", 1, .5, 1, "k")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = merkle.verify_documents(df, block)
    want = _manifest(rows)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=repr) == want
    assert any(not w[6] for w in want) and any(w[6] and zlib.crc32(str(w[0]).encode()) % 5 == 0 for w in want)


def test_manifest_of_little(spark):
    assert merkle.verify_documents(docs(spark, [(1, "x")]).limit(0)).count() == 0
    r = merkle.verify_documents(docs(spark, [(4, "x")])).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == _sha("") and r.verified


def test_octopus_fetches_no_more_than_it_needs():
    """What some leaves can not derive, level by level, for any part of a tree."""
    rng = random.Random(3)
    for n in (1, 2, 16, 17, 300, 5000):
        leaves = [_sha(str(i)) for i in range(n)]
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([_sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
        some = np.array(sorted(rng.sample(range(n), min(n, 40))))
        need = merkle.missing(some, n)
        fetched = {(k, int(i)): levels[k][int(i)] for k, places in enumerate(need) for i in places}
        paths = merkle.Paths(some, [leaves[i] for i in some], n, fetched)
        assert paths.root == levels[-1][0]
        for i in some:
            assert merkle.fold(leaves[i], int(i), paths.proof(int(i))) == paths.root
        for lost in list(fetched)[:5]:
            with pytest.raises(KeyError):
                merkle.Paths(some, [leaves[i] for i in some], n, {k: v for k, v in fetched.items() if k != lost})


# ------------------------------------------------------------------ cases earlier rounds got wrong
def test_topk_takes_components_of_any_size(spark):
    rows = [(50, [300000.0, 1.0, 0.0]), (51, [1.0, 2.0, 0.0]), (52, [-300000.0, 0.5, 0.0]), (100, [2.0, 2.0, 0.0]),
            (3, [0.25, 1.0, 1e16]), (7, [-0.5, 0.0, -1e300]), (4, [None, 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    live = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i not in (4, 5, 6)]
    want = []
    for q, v in live:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in live if i != q)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:3])]
    for turns in (8192, 1):
        got = vectors.top_k(df, k=3, query_rows=turns).collect()
        assert sorted(tuple(r) for r in got) == sorted(want) and {r.query_id for r in got} == {50, 100}
    big = df.union(spark.createDataFrame([(150, [0.0, 0.0, 1e17])], df.schema))
    with pytest.raises(Exception, match="64-bit"):      # its score with 3
        vectors.top_k(big, k=3).collect()
    # with 7 it is far below; only where nothing else is left that is an error
    low = big.where("vec_id in (7, 150)")
    with pytest.raises(Exception, match="64-bit"):
        vectors.top_k(low, k=1).collect()
    assert {(r.query_id, r.vec_id) for r in vectors.top_k(big.where("vec_id in (7, 51, 150)"), k=1).collect()} == {(150, 51)}


def test_topk_sums_beyond_64_bits_of_products(spark):
    """Dimensions whose bound passes 2^63 though every score fits."""
    rng = np.random.default_rng(5)
    x = rng.choice([-1.7e6, 1.7e6, 1.6e6, -1.6e6], size=(60, 64))
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    v = [[math.floor(256 * c) for c in r] for r in x]
    want = []
    for q in (0, 50):
        scored = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in range(60) if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    assert sorted(tuple(r) for r in vectors.top_k(df).collect()) == sorted(want)


def test_marks_and_emoji_are_no_letters(spark):
    plain = [(k, "the quick brown fox jumps over the lazy dog " * 3) for k in range(40)]
    odd = [(200, "❤️ ☎️ 1️⃣"), (201, "́"), (202, "123 !"), (203, None), (204, "क्षि"), (205, "é")]
    got = {r.doc_id: r for r in language.identify(docs(spark, plain + odd)).collect()}
    for k in (200, 201, 202, 203):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[204].lang_pred == "en" and got[205].lang_pred == "en"


def test_pipeline_keeps_clashing_columns(spark):
    import corpus_pipeline as P
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(40))
    names = ["_row", "row", "_score", "score", "lang_pred", "found", "_found", "root", "carried", "odd name", "least_text"]
    rows = [(k, text(), "en", "s", 1, *(f"{n}{k}" for n in names)) for k in range(30)]
    cols = ["doc_id", "text", "lang", "source", "n_chars", *names]
    df = spark.createDataFrame(rows, cols)
    for _, stage in P.STAGES[:2] + P.STAGES[3:4]:
        out = stage(spark, df, "")
        assert out.columns == cols
        got = {r.doc_id: tuple(r) for r in out.collect()}
        assert got.keys() == set(range(30))
        assert all(got[k][5:] == rows[k][5:] for k in got)
    assert P.STAGES[0][1](spark, df.limit(0), "").count() == 0 and P.STAGES[3][1](spark, df.limit(0), "").count() == 0
    assert out.select(F.count("odd name")).first()[0] == 30


def test_proximity_finds_windows_with_replaced_terms(spark):
    """Against all stretches, the rarest words of a window replaced among others."""
    rng = random.Random(9)
    common = WORDS[:6]
    items = [(k, " ".join([f"rare{k}a", f"rare{k}b", *rng.sample(common, 4), *rng.sample(WORDS, 4)])) for k in range(8)] + [(20, "rare0a x"), (21, None)]
    rows = []
    for k in range(160):
        body = [rng.choice(common + WORDS) for _ in range(rng.randint(0, 30))]
        if k % 2:
            w = items[k % 8][1].split()
            for _ in range(k % 5):
                w[rng.choice((0, 1, 2, 5))] = f"other{k}"
            rng.shuffle(w) if k % 3 == 0 else None
            at = rng.randint(0, len(body))
            body[at:at] = w
        rows.append((k, " ".join(body)))
    df = spark.createDataFrame(rows + [(900, None)], "key long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.key, tuple(r.gram)): r.shared for r in decontaminate.proximity_matches(df, b).collect()}
    want = {}
    for _, t in items:
        w = _terms(t)
        for g in {tuple(w[i:i + 10]) for i in range(max(len(w) - 9, 1))} if w else ():
            for k, text in rows:
                x = _terms(text)
                most = max((len(set(x[i:i + 10]) & set(g)) for i in range(len(x))), default=0)
                if most >= min(8, len(set(g))):
                    want[k, g] = most
    assert got == want and any(not any(w.startswith("rare") for w in set(g) & set(rows[k][1].split())) for k, g in want)
    assert decontaminate.proximity_matches(df, b.limit(0)).count() == 0 and decontaminate.proximity_matches(df.limit(0), b).count() == 0
