"""Readers and writers on small files made by the tests."""

import json

import pytest

from tallygrid.operators.relational import downcast, run_sql
from tallygrid.sources import readers, writers


def test_separator_and_encoding(spark, tmp_path):
    for sep, enc, name in ((";", "latin-1", "Zoë"), ("\t", "utf-8", "Élan"), ("|", "utf-8", "x"), (",", "utf-8", "ü")):
        p = tmp_path / f"f{ord(sep)}.csv"
        p.write_text(f"id{sep}name\n1{sep}{name}\n2{sep}\n", encoding=enc)
        rows = readers.read_csv_smart(spark, str(p)).collect()
        assert [tuple(r) for r in rows] == [(1, name), (2, None)]


def test_a_character_cut_at_the_sample_end_is_still_utf8(spark, tmp_path):
    p = tmp_path / "long.csv"
    p.write_text("a,b\n" + "x" * (readers.SNIFF_CHARACTERS * 4 - 5) + "éé,1\n", encoding="utf-8")
    assert readers.sniff(spark, str(p))[1] == "utf-8"


def test_nan_is_missing(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("x,y\nNaN,1\n2.5,2\n")
    assert [r["x"] for r in readers.read_csv_smart(spark, str(p)).orderBy("y").collect()] == [None, 2.5]


def test_json_array_and_nested_object(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "u": {"n": "x", "tags": [1, 2]}}, {"id": 2, "u": {"n": "y", "tags": []}}]))
    (tmp_path / "b.json").write_text(json.dumps({"meta": {"k": {"z": 3}}, "v": 1.5}))
    a = readers.read_json_flat(spark, str(tmp_path / "a.json"))
    assert sorted(a.columns) == ["id", "u.n", "u.tags"] and a.count() == 2
    b = readers.read_json_flat(spark, str(tmp_path / "b.json")).first()
    assert b["meta.k.z"] == 3 and b["v"] == 1.5


def test_one_bad_file_does_not_stop_the_others(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("a\n1\n")
    (tmp_path / "bad.json").write_text("{")
    tables, errors = readers.load_all(spark, [str(tmp_path / "ok.csv"), str(tmp_path / "bad.json"), str(tmp_path / "none.parquet")])
    assert list(tables) == ["ok"] and errors.count() == 2


def test_table_names():
    assert readers.table_name("/x/my sales-2024.csv") == "my_sales_2024"
    assert readers.table_name("2024.parquet") == "_2024"


def test_versions_and_rollback(spark, tmp_path):
    p = str(tmp_path / "t")
    d = spark.range(5)
    assert writers.persist_table(d, p) == 1
    # The table being replaced is also the one being read.
    assert writers.persist_table(writers.load_table(spark, p).where("id > 2"), p) == 2
    assert writers.load_table(spark, p).count() == 2 and writers.rollback(spark, p).count() == 5
    with pytest.raises(FileNotFoundError):
        writers.load_table(spark, str(tmp_path / "none"))


def test_downcast(spark):
    d = spark.range(100).selectExpr("id", "id * 1000 as big", "id / 4D as q", "cast(123456789.123 as double) as w")
    got = dict(downcast(d).dtypes)
    assert got == {"id": "tinyint", "big": "int", "q": "float", "w": "double"}


def test_sql_limit(spark):
    assert run_sql(spark, "select * from r", {"r": spark.range(500)}).count() == 500
    assert run_sql(spark, "select * from r", {"r": spark.range(500)}, limit=100).count() == 100
