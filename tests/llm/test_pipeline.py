"""The pipeline on a small folder: what each stage drops, changes and keeps."""

import hashlib
import random

from tests.llm.test_operators import WORDS


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    plain = [(k, text(60), "en", "s", 1, "extra") for k in range(40)]
    item = text(14)
    secret = hashlib.sha1(b"x").hexdigest()
    odd = [(100, plain[0][1], "en", "s", 1, None), (101, text(30) + " " + item, "en", "s", 1, None), (102, None, None, None, None, None),
           (103, text(40) + f" token={secret}", "en", "s", 1, None), (104, "123 456", "en", "s", 1, None)]
    spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string, n_chars long, found string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(40))
    assert set(seen["language_id"]) == clean | {100, 101, 103}
    assert set(seen["near_duplicates"]) == clean | {101, 103}
    assert set(seen["decontamination"]) == clean | {103}
    assert set(seen["secrets"]) == clean | {103}
    got = seen["secrets"][103]
    assert secret not in got.text and "[secret]" in got.text and got.n_chars == len(got.text)
    assert seen["secrets"][1].found == "extra"
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == clean | {103}
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_decisions_hold_for_the_row_judged(spark, tmp_path):
    import corpus_pipeline as P
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    a, b, c, d, e, item = (text(60) for _ in range(6))
    rows = [(None, a), (None, a), (None, a + " end"), (1, b), (None, b + " end"), (7, c + " z"), (7, c + " y"), (7, d), (None, e),
            (None, e + " " + item), (7, text(30) + " " + item), (8, None), (8, None), (None, " "), (2, d + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.text) for r in P.drop_contaminated(spark, docs, str(tmp_path)).collect()}
    assert got == {r for r in rows if item not in (r[1] or "")}
    kept = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    want = [(None, a), (1, b), (7, c + " y"), (2, d + " end"), (None, e), rows[9], rows[10], (8, None), (None, " ")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
