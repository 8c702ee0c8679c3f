import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallygrid.llm import packing, token_files, tokens
from tallygrid.llm.common import fresh_path
from tallygrid.llm.queries import QUERIES, table
from tallygrid.llm.tokens import encoder, vocabulary_path

PATH = vocabulary_path()
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text, end):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def crc(x):
    return zlib.crc32(x.tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\x1c\x85  ́ÉéΣςİß'sAbc19<|>")), max_size=40))
def test_words_give_the_ids_of_the_text(text):
    assert encoder(PATH).encode(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700), st.integers(-5, 1 << 30))
def test_elias_fano_round_trip(values, shift):
    v = np.array(sorted(values), np.int64) + shift
    e, end = token_files.EliasFano.unpack(b"??" + token_files.EliasFano.of(v).pack(), 2)
    assert e.values().tolist() == v.tolist() and end == 2 + len(e.pack())
    assert [e[i] for i in range(0, len(v), 7)] == v[::7].tolist()
    with pytest.raises(IndexError):
        e[len(v)]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert len(token_files.EliasFano.of(ends).pack()) < 50_000 * 13.5 / 8


def test_query_equals_brute_force(spark, sf):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op2_token_files"](spark, sf).collect()}
    at, want = 0, {}
    for r in sorted(table(spark, sf, "documents").select("doc_id", "text").collect()):
        x = ids_of(r["text"], 2)
        want[r["doc_id"]] = (at, len(x), crc(x))
        at += len(x)
    assert got == want


def test_files_of_odd_rows(spark, frame, odd, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 50)
    path = fresh_path(spark, "t")
    token_files.write(frame(odd).withColumns({c: F.lit(1) for c in ("ids", "chunk", "n_ids")}), path, PATH, 2)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 5, 5, 7, 9]
    assert sorted(r["ids_crc32"] for r in rows) == sorted(crc(ids_of(t, 2)) for _, t in odd)
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows[:-1]]]).tolist()


def test_empty_table(spark, frame):
    path = fresh_path(spark, "t")
    token_files.write(frame([]), path, PATH, 2)
    assert token_files.read(spark, path).count() == 0
    assert packing.pack(frame([]), PATH, 0).count() == 0


def check_packing(rows, texts, most=2048):
    """Every piece once, sequences gapless and not above the bound."""
    want = []
    for t in texts:
        x = ids_of(t, 0)
        want += [(k, a, len(x[a:a + most]), crc(x[a:a + most])) for k, a in enumerate(range(0, len(x), most))]
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == np.cumsum([0, *[n for _, n in x[:-1]]]).tolist() and sum(n for _, n in x) <= most
    return by


def test_packing_query(spark, sf):
    rows = QUERIES["op10_packing"](spark, sf).collect()
    by = check_packing(rows, [r["text"] for r in table(spark, sf, "documents").collect()])
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len(by) <= least + 2


def test_packing_odd_rows(frame, odd):
    check_packing(packing.pack(frame(odd), PATH, 0, 100).collect(), [t for _, t in odd], 100)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15), st.integers(1, 6), st.integers(1600, 4000), st.sampled_from(["norm", "dot"]))
def test_plan_holds_every_constraint(counts, docs, cost, rule):
    bins, seen = {}, {}
    for length, a, z, first, k, offset in packing.plan(counts, 40, docs, cost, (1.0, 0.3, 0.5), rule):
        for i in range(a, z):
            seen.setdefault(length, set()).add(i)
            bins.setdefault(first + (i - a) // k, []).append((offset + (i - a) % k * length, length))
    assert {n: len(s) for n, s in seen.items()} == counts and all(s == set(range(len(s))) for s in seen.values())
    for x in bins.values():
        x.sort()
        assert sum(n for _, n in x) <= 40 and len(x) <= docs and sum(n * n for _, n in x) <= cost
        assert [o for o, _ in x] == np.cumsum([0, *[n for _, n in x[:-1]]]).tolist()


def test_plan_equals_best_fit_one_by_one():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = sorted(rng.integers(1, 60, 300).tolist(), reverse=True)
        left = []
        for n in lengths:
            fits = [i for i, x in enumerate(left) if x >= n]
            if fits:
                left[min(fits, key=lambda i: left[i])] -= n
            else:
                left.append(60 - n)
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.plan(counts, 60, 60, 3600, (1.0, 0.0, 0.0), "norm")
        assert max(first + (z - a - 1) // k for _, a, z, first, k, _ in plan) + 1 == len(left)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=1500), st.data())
def test_selects_equal_decoding(steps, data):
    values = np.cumsum(steps) + 7
    ef = token_files.EliasFano.unpack(token_files.EliasFano.of(values).pack(), 0)[0]
    asked = np.array(sorted(data.draw(st.lists(st.integers(0, len(values) - 1), max_size=40))), np.int64)
    assert ef.at(asked).tolist() == values[asked].tolist() == [ef[int(i)] for i in asked]
    assert ef.at(np.arange(len(values))).tolist() == ef.values().tolist() == values.tolist()


def test_reading_selects_and_does_not_decode(spark, frame, tmp_path, monkeypatch):
    token_files.write(frame([(i, "some words " * (i % 9)) for i in range(40)]), f"{tmp_path}/t", vocabulary_path(), 2)
    raw = [r["payload"] for r in spark.read.parquet(f"{tmp_path}/t").collect()]
    s = token_files.Segment(bytes(raw[0]))
    monkeypatch.setattr(token_files.EliasFano, "values", None)
    assert len(s.document(0)) == s.bounds.at(np.array([1]))[0]


def test_all_three_capacities_choose(spark, sf):
    """With every dimension weighted the number of sequences does not grow; where capacities bind they hold."""
    lengths = [r["length"] for r in packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), vocabulary_path(), 0).select("length").collect()]
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins = lambda p: max(f + -(-(z - a) // k) for _, a, z, f, k, _ in p)
    every = packing.plan(counts, 2048, 2048, 2048 ** 2, (1, 1, 1), "norm")
    assert bins(every) <= bins(packing.plan(counts, 2048, 2048, 2048 ** 2, (1, 0, 0), "norm"))
    # Two bins with 60 tokens left, one of them nearly out of documents: the weights tell them apart.
    small = {90: 1, 30: 3, 10: 3}
    picks = {w: packing.plan(small, 100, 5, 10_000, w, rule) for rule, w in (("norm", (1, 0, 0)), ("norm", (0, 1, 0)))}
    assert picks[1, 0, 0] != picks[0, 1, 0]
    for max_docs, max_cost in ((3, 10_000), (5, 2000)):
        used = {}
        for length, a, z, first, each, _ in packing.plan({40: 6, 20: 9, 5: 30}, 100, max_docs, max_cost, (1, 1, 1), "dot"):
            for k in range(z - a):
                used.setdefault(first + k // each, []).append(length)
        assert all(len(x) <= max_docs and sum(n * n for n in x) <= max_cost and sum(x) <= 100 for x in used.values()) and sum(map(len, used.values())) == 45


def test_columns_of_texts(monkeypatch):
    """Nulls, slices, small groups, caches that overflow and texts with special tokens give the library's ids."""
    monkeypatch.setattr(tokens, "GROUP_BYTES", 40)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 9)
    texts = ["skipped", None, "", " \n", "Über ÑANDÚ!! naïve×x a\xb7b Ωmega it's 'tis", "x<|endoftext|> y", "<|", "Über it's ... a1 B.", *["one two three four, (five)"] * 9, "last"]
    enc = tokens.WordEncoder(PATH)
    for column in (pa.array(texts).slice(1), pa.array(texts, pa.large_string()).slice(1)):
        groups = list(enc.encode_column(column))
        assert len(groups) > 3 and sum(len(c) for c, _ in groups) == len(texts) - 1
        for (counts, ids), end in ((g, 7) for g in groups):
            assert counts.sum() == len(ids)
            bounds, ended = tokens.with_end(counts, ids, end)
            assert (ended[bounds[1:] - 1] == end).all() and (np.diff(bounds) == counts + 1).all()
        got = [x.tolist() for counts, ids in groups for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
        assert list(enc.encode_column(column.slice(0, 0))) == []


def test_words_are_looked_at_once_a_group(monkeypatch):
    """Python sees no word of a text: only words new to the caches reach the library, each once."""
    enc, seen = tokens.WordEncoder(PATH), []
    for cache in (enc.letters, enc.others):
        monkeypatch.setattr(cache, "encode", lambda words, f=cache.encode: (seen.extend(words.to_pylist()), f(words))[1])
    texts = ["Alpha alpha, ALPHA! 4x beta"] * 500
    assert all(x.tolist() == PLAIN.encode(texts[0], add_special_tokens=False).ids for x in enc.encode_many(texts) + enc.encode_many(texts))
    assert sorted(seen) == ["!", ",", "4x", "alpha", "beta"]


def test_pieces_are_cut_and_numbered_by_columns(spark, frame):
    """Pieces of several batches and groups: cut as the ids are, and numbered from 0 within the task and length; rows repeat and ids may be missing."""
    wide = " " * (tokens.GROUP_BYTES // 2 + 9)
    texts = [None, "", "one two three, four!!", wide + "x y", *["a b c d e f g " * k for k in range(12)], "it's <|endoftext|> x"] * 3
    rows = [(None if i % 5 == 0 else i % 7, t) for i, t in enumerate(texts)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        p = packing.pieces(frame(rows, 2), PATH, 3, 20)
        got = p.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = []
    for d, t in rows:
        x = ids_of((t or "").strip(), 3)
        want += [(d, k, a, len(x[a:a + 20]), crc(x[a:a + 20])) for k, a in enumerate(range(0, len(x), 20))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault((r["part"], r["length"]), []).append(r["ord"])
    assert {k for k, _ in by} == {0, 1} and all(x == list(range(len(x))) for x in by.values())
    plan = p._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_caches_are_bounded_in_words_and_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_BYTES", 3000)
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    enc = tokens.WordEncoder(PATH)
    for texts in ([f"{i}{'-x' * 400}" for i in range(100)], ["ж" * (300 + i) for i in range(100)], ["ab" * (200 + i) for i in range(100)]):
        assert [x.tolist() for x in enc.encode_many(texts)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
        for cache in (enc.letters, enc.others):
            assert cache.words.nbytes + cache.ids.nbytes < 40_000 and len(cache.counts) == len(cache.words) and cache.counts.sum() == len(cache.ids)
