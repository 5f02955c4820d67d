"""Records of files that are cut into many splits, against the csv module."""

import csv
import io
import random

import pytest

from veilspark.sources import delimited


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def made(seed, n, end):
    rng = random.Random(seed)
    cells = ["", "a", 'say "x"', "two\nlines", '"', "\n\n", "a,b", "é\U0001f600", "x" * 50, "\r\nq", "end\n"]
    out = io.StringIO()
    rows = [[rng.choice(cells) for _ in range(rng.randint(2, 5))] for _ in range(n)]
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue(), rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_many_splits_equal_the_csv_module(spark, small_splits, tmp_path, end):
    (tmp_path / "t").mkdir()
    want = []
    for seed in (1, 2):
        text, rows = made(seed, 150, end)
        (tmp_path / "t" / f"{seed}.csv").write_text(text, newline="")
        assert list(csv.reader(io.StringIO(text, newline=""))) == rows
        want += rows
    got = delimited.read_records(spark, str(tmp_path / "t"))
    found = [list(r["fields"]) for r in got.orderBy("file", "block", "seq").collect()]
    assert found == want
    assert got.select("file", "block").distinct().count() > 20


def test_an_open_quote_is_reported_and_not_gathered(spark, small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "MAX_RECORD_CHARS", 400)
    (tmp_path / "t.csv").write_text('a,b\n\n1,"two\nlines"\n2,"open\n' + "x,y\n" * 400)
    rows = delimited.read_records(spark, str(tmp_path / "t.csv")).orderBy("block", "seq").collect()
    assert [r["fields"] for r in rows] == [["a", "b"], ["1", "two\nlines"], None] and [r["too_long"] for r in rows] == [False, False, True]
