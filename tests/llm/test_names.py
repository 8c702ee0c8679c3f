"""Columns named like the operators' own come through."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tallygrid.llm import linededup, mixing, simhash, substrings, toxicity

OWN = ["_kept", "_removed", "_lines", "_words", "_score", "_predicted", "_tie0", "_tie", "_doc", "_starts", "_windows", "_cut", "cut", "row", "id", "of", "_row", "_size",
       "_copies", "size", "target", "copies", "_md5", "_digest", "_first", "digest", "unit", "same", "stays", "first", "root", "fp", "label", "line", "d1", "d2", "rank", "key", "n"]
ROWS = [(1, "first line here\nsecond line there\nend"), (2, "first line here\nsecond line there\nother"), (3, None), (4, "alone"), (4, "alone")]


def with_own(frame):
    return frame(ROWS).withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in OWN})


def kept_whole(out, columns):
    assert out.columns == columns
    for r in out.collect():
        assert all(r[c] == f"{c} of {r['doc_id']}" for c in OWN if c in columns)


@pytest.mark.parametrize("step", ["reject", "lines", "near", "mix"])
def test_rows_come_back_as_they_were(spark, frame, step):
    d = with_own(frame)
    model = toxicity.Model([("zzzzz", False)], [0.0] * len(toxicity.FEATURES), -5.0)
    out = {"reject": lambda: toxicity.reject(d, model), "lines": lambda: cp.drop_repeated_lines(spark, d, ""),
           "near": lambda: simhash.near_duplicates(d), "mix": lambda: mixing.mix(d)}[step]()
    kept_whole(out, d.columns)
    if step == "lines":
        assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] < 3) == [(1, ROWS[0][1]), (2, "other")]


@pytest.mark.parametrize("names", [("_lines", "_removed", "_kept"), ("_words", "_removed", "_kept")])
def test_result_names_are_replaced(spark, frame, names):
    d = with_own(frame)
    out = linededup.dedup(d) if names[0] == "_lines" else substrings.remove_repeats(d, 3)
    kept_whole(out.drop(*names), [c for c in d.columns if c not in names])
    assert out.columns == [*[c for c in d.columns if c not in names], *names]
    r = next(r for r in out.collect() if r["doc_id"] == 2)
    assert r["_removed"] > 0 and r["_kept"].endswith("other")
    ref = substrings.remove_reference(d, frame([(9, "second line there")]), 3)
    assert ref.columns == [*[c for c in d.columns if c not in ("_words", "_removed", "_kept")], "_words", "_removed", "_kept"]
    assert next(r for r in ref.collect() if r["doc_id"] == 1)["_kept"] == "first line here end"
