"""Quoted CSV in byte ranges: the csv module's rows, however small the ranges."""

import csv
import random

import pytest

from sievekit.sources import files as FS
from sievekit.sources import quoted as QT


@pytest.fixture(scope="module")
def written(tmp_path_factory):
    rng = random.Random(3)
    folder, rows = tmp_path_factory.mktemp("csv"), []
    for name in ("a.csv", "b.csv"):
        with open(folder / name, "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n" if name == "a.csv" else "\r\n")
            w.writerow(["text", "n"])
            for k in range(150):
                t = "".join(rng.choice(['"', ",", "\n", "x", " ", "é", "line\n\n", "word "]) for _ in range(rng.randint(1, 60))).strip() or "x"
                if k == 70:
                    t = "long\n" * 400      # longer than several ranges
                rows.append((t, k))
                w.writerow([t, k])
    return str(folder), rows


@pytest.mark.parametrize("size", [1 << 20, 700, 97])
def test_ranges_do_not_matter(spark, written, size):
    path, rows = written
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, str(size))
        starts = {(r.file, r.start) for r in QT.records(spark, path).select("file", "start").collect()}
        assert len(starts) > (2 if size < 1 << 20 else 1)
        got = FS.read_labelled_csv(spark, path, "text string, n int", uid_col="uid").collect()
        assert [(r.text, r.n) for r in sorted(got, key=lambda r: int(r.uid))] == rows
        assert sorted(int(r.uid) for r in got) == list(range(len(rows)))
        plain = FS.read_labelled_csv(spark, path, "text string, n int").collect()
        assert sorted((r.text, r.n) for r in plain) == sorted(rows)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_little_files(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('a\t"b\tc"\n\n"q ""r"""\t\n')
    got = FS.read_labelled_tsv(spark, str(tmp_path / "x.tsv"), "p string, q string", header=False).collect()
    assert [tuple(r) for r in got] == [("a", "b\tc"), ('q "r"', None)]
    (tmp_path / "empty.csv").write_text("")
    assert FS.read_labelled_csv(spark, str(tmp_path / "empty.csv"), "p string").count() == 0
    (tmp_path / "head.csv").write_text("p\n")
    assert FS.read_labelled_csv(spark, str(tmp_path / "head.csv"), "p string", uid_col="uid").count() == 0
