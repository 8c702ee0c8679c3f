"""Quoted records cut by parity in blocks of a few bytes, against Spark's multi-line reader and Python's."""

import csv
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.sources import quoted, readers

PARTS = ["a", "b c", '"', '""', ",", "\n", "\r\n", "\n\n", "é", "\n\"x\"\n", "1,2", "-"]


@pytest.fixture
def tiny_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def table(seed, n=60):
    rng = np.random.default_rng(seed)
    return [[str(i), "".join(rng.choice(PARTS, rng.integers(1, 9))) + "e", "plain", "x" * int(rng.integers(0, 300) if i % 17 == 0 else 1)] for i in range(n)]


def write(path, rows, encoding="utf-8", end="\n", header=("id", "note", "p q", "long")):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows([header, *rows])
    path.write_bytes(out.getvalue().encode(encoding))


def rows_of(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()), key=lambda r: int(r[0]))


@pytest.mark.parametrize("seed, encoding, end", [(1, "utf-8", "\n"), (2, "iso-8859-1", "\n"), (3, "utf-8", "\r\n")])
def test_one_file_many_tasks(spark, tmp_path, tiny_blocks, seed, encoding, end):
    p, rows = tmp_path / "t.csv", table(seed)
    write(p, rows, encoding, end)
    got = quoted.read_quoted(spark, str(p), ",", encoding)
    assert quoted.lines(spark, str(p)).select("block").distinct().count() > 10
    assert got.columns == ["id", "note", "p q", "long"] and dict(got.dtypes)["id"] == "int"
    assert rows_of(got) == [tuple(r) for r in rows]
    if end == "\n":
        plain = spark.read.options(header=True, sep=",", encoding=encoding, quote='"', escape='"', multiLine=True).csv(str(p))
        assert rows_of(got) == rows_of(plain)


def test_lines_shuffled_by_block_keep_their_order(spark, tmp_path, tiny_blocks, monkeypatch):
    monkeypatch.setattr(quoted, "SENT", 0)
    p, rows = tmp_path / "t.csv", table(4)
    write(p, rows)
    assert rows_of(quoted.read_quoted(spark, str(p), ",", "utf-8")) == [tuple(r) for r in rows]


def test_many_files_each_with_a_header(spark, tmp_path, tiny_blocks):
    rows = table(5)
    for i in range(4):
        write(tmp_path / f"part-{i}.csv", rows[i::4])
    got = readers.read_csv_smart(spark, str(tmp_path))
    assert rows_of(got) == [tuple(r) for r in rows]


@pytest.mark.parametrize("text", ['id,note\n1,5" pipe\n2,"a\nb"\n3,6" pipe\n', 'id,note\n1,"open\n2,x\n'])
def test_stray_quotes_are_left_to_the_multi_line_reader(spark, tmp_path, tiny_blocks, text):
    (tmp_path / "s.csv").write_text(text)
    assert quoted.read_quoted(spark, str(tmp_path / "s.csv"), ",", "utf-8") is None
    plain = spark.read.options(header=True, inferSchema=True, quote='"', escape='"', multiLine=True).csv(str(tmp_path / "s.csv"))
    assert readers.read_csv_smart(spark, str(tmp_path / "s.csv")).collect() == plain.collect()


def test_header_alone_and_a_row_like_the_header(spark, tmp_path):
    (tmp_path / "h.csv").write_text('"a","b\nc"\n')
    d = readers.read_csv_smart(spark, str(tmp_path / "h.csv"))
    assert d.columns == ["a", "b\nc"] and d.count() == 0
    (tmp_path / "r.csv").write_text('a,"b"\na,"b"\n1,"x\ny"\n')
    assert [tuple(r) for r in readers.read_csv_smart(spark, str(tmp_path / "r.csv")).collect()] == [("a", "b"), ("1", "x\ny")]
