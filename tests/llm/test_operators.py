"""Small inputs against brute force, odd rows (nulls, empty, repeats, clashing columns) and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from sievekit.llm import (decontaminate, language, licences, neardup, packing, quality, secrets, toxicity, vectors,
                          warc)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, key string"


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[k], "s", len(t or ""), 0.5, 1, "k") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (4, "one two"), (None, "one two"), (5, "x " * 30000), (6, "ÉCOLE ß 中 ‍")]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def test_warc_round_trip(spark):
    big, small = "<p>" + "é" * 200, "short"
    rows = [(3, "u", big), (1, "u\r\nX: y", big), (2, None, small), (4, "u", small), (5, "u", None), (None, "u", big), (6, "u", big + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    bundles = warc.write_bundles(pages.selectExpr("*", "1 as payload", "2 as digest"))
    got = {(r.page_id, r.payload_digest): r for r in warc.read_bundles(bundles).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert len(got) == len(rows)
    for page, _, html in rows:
        r = got[page, sha(html)]
        assert r.payload_bytes == len((html or "").encode())
        assert (r.record_type, r.refers_to) == (("revisit", 1) if html == big and page != 1 else ("response", None))
    index = warc.record_index(bundles).where("page_id = 6").collect()[0]
    b = bundles.where(bundles.bundle_id == index.bundle_id).collect()[0]
    head, block = warc.read_record(bytes(b.data), index.frame, index.offset, index.length)
    assert head["WARC-Type"] == "response" and block.decode() == big + "!"
    assert warc.read_bundles(warc.write_bundles(pages.limit(0))).count() == 0


def test_jaccard_matches_brute_force(spark):
    rng, texts = random.Random(1), []
    base = [[rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)] for n in (60, 61, 8, 5, 120)]
    for k in range(90):
        w = list(base[k % 5])
        for _ in range(rng.choice((0, 0, 1, 2, 4, 9))):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append((100 + k, (" \t" if k % 3 else " ").join(w).upper() if k % 2 else " ".join(w)))
    texts += ODD

    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    s = [sets(t) for _, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in itertools.combinations(range(len(texts)), 2):
        if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
            parent[find(i)] = find(j)
    want = []
    for i, (d, _) in enumerate(texts):
        group = [texts[j][0] for j in range(len(texts)) if find(j) == find(i) and texts[j][0] is not None]
        want.append((d, len(s[i]), min(group, default=None)))
    for turns, block in ((0, 7), (1, 4096), (2, 3)):
        got = [tuple(r) for r in neardup.near_duplicates(docs(spark, texts), turns, block).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert neardup.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_overlap_bound_loses_no_link():
    rng, linked = random.Random(5), 0
    for _ in range(20_000):
        all_of = sorted(rng.sample(range(200), rng.randint(1, 60)))
        x, y = ([e for e in all_of if rng.random() < 0.93] for _ in range(2))
        both = len(set(x) & set(y))
        if not both or 100 * both < 75 * (len(x) + len(y) - both):
            continue
        rare = [set(z[:len(z) - neardup.required(len(z)) + min(neardup.NEED, neardup.required(len(z)))]) for z in (x, y)]
        assert len(rare[0] & rare[1]) >= neardup.overlap_bound(len(x), len(y))
        linked += 1
    assert linked > 10_000


def test_packing(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    odd = ["a  b\t c\n\n d ", " lead", " x   y", "\x1c z", "don't  we'll", "<|endoftext|>", "中文 字", "é" * 50, "\r\n  \r\n x"]
    texts = ODD + [(50 + k, t) for k, t in enumerate(odd)] + [(100 + k, "word " * (7 * k)) for k in range(60)]
    got = packing.pack_documents(docs(spark, texts), limit=64, per_block=20).collect()
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [2]
    want = {d: ids(t) for d, t in texts if d not in (4, None)}
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id in want:
            part = want[r.doc_id][r.start:r.start + r.length]
            assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32 and len(part) == r.length
    for d, x in want.items():
        p = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == d)
        assert [q[1] for q in p] == list(np.cumsum([0, *(q[2] for q in p[:-1])])) and sum(q[2] for q in p) == len(x)
        assert all(q[2] == 64 for q in p[1:])
    for places in seqs.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 64
    assert sum(r.doc_id == 4 for r in got) == 2
    total = sum(r.length for r in got)
    assert len(seqs) <= 1.1 * total / 64 + 3
    assert packing.pack_documents(docs(spark, texts).limit(0)).count() == 0


def test_added_tokens_are_found_as_by_default():
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>  x", "a<|endoftext|>", " <|endoftext| > \n<|endoftext|>\n y", "", "don't  we'll"]
    encode = packing.ChunkEncoder(packing.default_ranks(), packing.added_tokens())
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_packs_added_tokens(spark, tmp_path):
    from sievekit.llm.queries import QUERIES
    docs(spark, [(1, "a <|endoftext|> b")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_packing"](spark, str(tmp_path)).collect()
    assert [(r.length, r.ids_crc32) for r in got] == [(5, zlib.crc32(np.array([64, 220, 50256, 275, 2], dtype="<u4").tobytes()))]


def test_sum_of_squares_prefers_the_crowded_gap():
    where, offset = packing.sum_of_squares(np.array([7, 7, 7, 6, 3]), 10)
    assert where.tolist() == [0, 1, 2, 3, 2] and offset.tolist() == [0, 0, 0, 0, 7]


@pytest.mark.parametrize("size", [3, 10])
def test_decontamination_matches_brute_force(spark, size):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice(WORDS[:6]) for _ in range(n))) for k, n in enumerate((2, 12, 14, 3, 1))] + [(9, None), (8, "!!"), (7, "É É-x")]
    texts = ODD + [(100 + k, ", ".join(rng.choice(WORDS[:7]) for _ in range(60)) + (" " + items[k % 5][1].upper() if k % 3 else "")) for k in range(25)]
    texts += [(300, "É, é É x")]
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for d, t in texts:
        w, hit, ids = word(t), set(), set()
        for i, it in items:
            x = word(it)
            k = min(size, len(x))
            for a in range(len(x) - k + 1 if x else 0):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == x[a:a + k]:
                        hit.update(range(p, p + k))
                        ids.add(str(i))
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as gram", "2 as key")
    got = [tuple(r) for r in decontaminate.decontaminate(docs(spark, texts), bench, size).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs(spark, ODD), bench.limit(0)).collect())


def test_licences(spark):
    texts = ODD + [(10, "Released Under the MIT license. Apache License, Version 2.0 cc-by-nc"), (11, "the MIT License"),
                   (12, "x " * 50 + licences.TEMPLATES["bsd"].upper() + " y" * 50), (13, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in licences.scan_licences(docs(spark, texts)).collect()}
    r = got[10]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (13, 3, 1, 10, "apache-2,cc-by-nc,mit", 1.0)
    assert got[11].labels == "" and got[1].n_words == 0 and got[1].first_word is None
    assert got[12].labels == "bsd" and got[12].n_base == 0 and got[12].score == 1.0
    assert "gpl-3" in got[13].labels


def test_every_licence_block_is_listed(spark):
    mit, bsd = licences.TEMPLATES["mit"], licences.TEMPLATES["bsd"]
    part = " ".join(mit.split()[:17])           # enough of it, less than the whole
    texts = [(1, " ".join([part, mit, mit, "x " * 40, bsd, mit, "y " * 9, bsd])), (2, mit), (3, "x " * 99)]
    got = {r.doc_id: r for r in licences.scan_licences(docs(spark, texts)).collect()}
    n, m = len(mit.split()), len(bsd.split())
    starts = {"mit": [0, 17, 17 + n, 57 + 2 * n + m], "bsd": [57 + 2 * n, 66 + 3 * n + m]}
    for label, want in starts.items():
        found = [b for b in got[1].blocks if b["label"] == label]
        assert len(found) == len(want)
        assert all(abs(b["first"] - w) <= 4 for b, w in zip(found, want))
        assert all(x["end"] <= y["first"] for x, y in zip(found, found[1:]))
    assert [b["label"] for b in got[2].blocks] == ["mit"] and got[1].score == 1.0 and got[3].blocks == []


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)).round(2)
    x[150:170] = x[0]
    big = rng.normal(size=(40, 3)) * 9000
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(1000 + i, [float(v) for v in big[i]]) for i in range(40)]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, []), (None, [1.0] * 6), (7, [float(v) for v in x[7]])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "3 as block", "4 as v")
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        best = sorted(((-int(v @ c), i) for i, c in good if i != q and len(c) == len(v)))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for slices, block_rows in ((8, 64), (2, 100), (8, 8192)):
        got = [tuple(r) for r in vectors.top_k(e, slices=slices, block_rows=block_rows).collect()]
        assert sorted(got) == sorted(want)
    assert vectors.top_k(e.limit(0)).count() == 0


def test_secrets_base_and_field(spark):
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(80)]
    filler = " ".join(WORDS * 2)
    texts = ODD + [(100 + k, f'{filler} é token = "{h}" {filler}') for k, h in enumerate(hexes)] + [(300 + k, filler * 2) for k in range(60)]
    texts += [(400, "PASSWORD:abc password='abcdefgh' AKIA1234 AKIAABCDEFGHIJKL " + "a" * 31 + "g" + "f" * 32)]
    got = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, texts)).collect()}
    for d, t in texts:
        spans = sorted([(m.start(), k, m.end()) for k, p, ok in (
            (0, secrets.ASSIGN, lambda m: len(m[2]) >= 8), (1, secrets.ACCESS, lambda m: len(m[0]) >= 16),
            (2, secrets.HEX, lambda m: len(m[0]) >= 32)) for m in p.finditer(t or "") if ok(m)])
        listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        if d not in (4, None):
            assert got[d].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
            assert got[d].n_assign + got[d].n_access + got[d].n_hex == len(spans)
            assert set(filter(None, listed.split(","))) <= set(got[d].spans.split(","))
    assert all(got[300 + k].spans == "" for k in range(60))
    model = secrets.fit(docs(spark, texts))
    import pyarrow as pa
    bare = f"{filler} é token - \"{hashlib.sha1(b'new').hexdigest()[:31]}\" {filler}"   # no base pattern matches
    assert [s[0] for s in secrets.spans_of(pa.array([bare]), model)[0]] == ["crf"]
    d = docs(spark, [(1, f"a {hexes[0]} b password=abcdefgh1"), (2, None), (3, "plain")])
    from pyspark.sql import functions as F
    red = secrets.find_secrets(d, None, ["doc_id", "text"]).select("doc_id", secrets.redact(F.col("text"), F.col("found")))
    assert {r[0]: r[1] for r in red.collect()} == {1: "a [secret] b [secret]", 2: None, 3: "plain"}


def test_base_spans_do_not_depend_on_the_neighbours():
    import pyarrow as pa
    h = hashlib.md5(b"k").hexdigest()
    texts = ["all is done", h + " x", h, h, None, "", h[:31], h[0], "AKI", "AKIAABCDEFGHIJKLM", "pass", "word=abcdefgh", "token=abcdefgh1"]
    for order in (texts, texts[::-1], texts[2:] + texts[:2]):
        assert [[s[:3] for s in secrets.base_spans(t or "")] for t in order] == secrets.spans_of(pa.array(order, pa.string()), None)


def test_first_token_of_a_text_can_win():
    import pyarrow as pa
    t = np.array([[4.0, -9.0, -1e9], [0.0, -9.0, -9.0], [0.0, -9.0, -9.0]])
    w = secrets.Words(pa.array(["", "plain", "key plain"]), secrets.PARTS)
    f = secrets.Field(np.zeros((secrets.N_FEATURES, 3)), t)
    own = np.setdiff1d(secrets.features(w)[1], secrets.features(w)[[0, 2]])
    f.w[own, secrets.B] = 8.0 / len(own)
    assert f.viterbi(f.emissions(secrets.features(w))[1:]).tolist() == [secrets.B, secrets.O]
    assert secrets.field_spans(w, f) == {2: [(0, 3)]}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    t = rng.normal(size=(3, 3))
    t[secrets.O, secrets.I] = -1e9
    f = secrets.Field(np.zeros((1, 3)), t)
    e = rng.normal(size=(6, 3)) * 2

    def total(p):
        return sum(e[i, k] for i, k in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])) - (1e9 if p[0] == secrets.I else 0)
    assert tuple(f.viterbi(e)) == max(itertools.product(range(3), repeat=6), key=total)


def test_segments_are_the_maximal_ones():
    m = toxicity.ToxicModel({"bad": 3.0, "ill": 1.0, "good": -5.0})
    words = "x bad x ill x x x x x x x x x x x x bad good bad".split()
    got = m.segments(words)
    s = [m.value(w) if words.index(w) == i or w == "x" else toxicity.DRIFT for i, w in enumerate(words)]
    best = max((sum(s[a:b]), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1))
    assert max(got, key=lambda g: g[2])[2] == pytest.approx(best[0])


def test_every_occurrence_of_a_word_scores():
    m = toxicity.ToxicModel({"bad": 3.0, "ill": 2.0, "vile": 2.5}, scale=1.0, rate=1.0)
    apart = " ".join(w + " x" * 40 for w in ("bad", "ill", "vile")).split()
    dense = "bad ill vile".split()
    words = apart + dense + ["x"] * 40 + dense
    got = m.segments(words)
    assert [(a, e) for a, e, s in got if s == 7.5] == [(len(apart), len(apart) + 3), (len(words) - 3, len(words))]
    assert sum(m.evidence([g], len(words)) > 0 for g in got) == 2
    assert sorted(s for *_, s in m.segments(words[::-1])) == sorted(s for *_, s in got)


def test_models_on_odd_rows_and_held_out(spark):
    rng = random.Random(4)
    good = [(k, " ".join(rng.choice(WORDS) for _ in range(80)) + ".") for k in range(100, 400)]
    bad = [(k, " ".join(rng.choice(WORDS) + "$$$" for _ in range(80)) + " vile") for k in range(400, 700)]
    d = docs(spark, ODD + good + bad)
    y = spark.createDataFrame([(k, int(k < 400), int(k >= 400)) for k, _ in good + bad] + [(None, 1, 1), (4, None, None)],
                              "doc_id long, quality int, toxic int")
    for fn, flip in ((quality.score_quality, False), (toxicity.score_toxicity, True)):
        got = fn(d, y).collect()
        assert len(got) == len(ODD) + 600 and all(0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 100]
        assert held and np.mean([r.predicted == int((r.doc_id < 400) != flip) for r in held]) > 0.95
        assert fn(d.limit(0), y).count() == 0
        assert len(fn(d, y.limit(0)).collect()) == len(ODD) + 600


def test_language(spark):
    rng = random.Random(6)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(30))
    rows = [(k, make(("the", "ing", "and")) if k % 2 else make(("être", "eau", "que"))) for k in range(10, 210)]
    d = docs(spark, ODD + rows, [None] * len(ODD) + ["en" if k % 2 else "fr" for k, _ in rows])
    got = {r.doc_id: r for r in language.identify(d).collect() if r.doc_id is not None}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und"
    assert all(got[k].lang_pred == ("en" if k % 2 else "fr") for k, _ in rows)
    assert language.identify(d.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs(spark, ODD, [None] * len(ODD))).collect()} == {"und"}


def test_many_letter_scripts_keep_their_trigrams(spark):
    rng = random.Random(7)
    han, kana = [chr(0x4E00 + k) for k in range(3000)], [chr(0xAC00 + k) for k in range(3000)]
    zipf = [1 / (k + 1) for k in range(3000)]
    make = lambda letters, n: "".join(rng.choices(letters, zipf, k=n))
    for per in (10, 150):
        rows = [(k, make(kana if k % 2 else han, 400)) for k in range(10, 10 + per)]
        langs = ["ko" if k % 2 else "zh" for k, _ in rows]
        d = docs(spark, rows, langs)
        model = language.learn(d)
        got = {r.doc_id: r for r in language.predict(d, model, ["doc_id"]).collect()}
        assert all(got[k].lang_pred == lang and got[k].score > 0.95 for (k, _), lang in zip(rows, langs))
        new = docs(spark, [(k, make(kana if k % 2 else han, 400)) for k in range(20)])
        for r in language.predict(new, model, ["doc_id"]).collect():
            assert r.lang_pred == ("ko" if r.doc_id % 2 else "zh") and r.score >= 0.2 * model.coverage[r.lang_pred]


def test_bloom_masks_contain_every_language_of_a_gram():
    f = language.LanguageFilter.build([(f"l{k:03}", g) for k in range(70) for g in range(k, k + 50)], 1 << 14)
    m = f.masks(np.arange(120, dtype=np.uint64))
    for k in range(70):
        bits = (m[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
        assert bits[k:k + 50].all()
