"""Repeated runs of lines, by prefix doubling over line ids.

Lines are split at ``\\n``; lines without words are not part of the sequence and
always stay. Every line that occurs again is a suffix start of the line-id
sequence of its document. Prefix doubling ranks these suffixes, in Spark: the
rank at depth 1 counts the suffixes whose line id is smaller; the rank at depth
2d is the rank at depth d plus the number of suffixes of the same class whose
follower, d lines on, ranks lower. A suffix whose class has no second member is
settled and leaves; doubling goes on until all have left, past the longest
repeated run. Equal ranks at a depth are the intervals of the suffix array whose
longest common prefix has at least as many lines. Of each interval the first
occurrence in document order stays. Windows of ``min_lines`` of all others are
later copies, and so are those of every greater depth; a later copy that follows
another one lies in the same run, and what is deleted are maximal runs.

With ``long_words`` later copies of single lines of more words are deleted too,
whatever stands beside them; the first line in document order stays. A text that
is nothing but that line, as the first one's is, copies a whole document and is
left to document deduplication, which drops the row.

No class is gathered in a task: counts, first members and ranks are aggregates
with partial sums, or windows over (class, slice).

Defined cases: null text is empty and stays null; null ``doc_id`` sorts first;
rows of one ``doc_id`` are ordered by a hash of the text; rows equal in id and
text are one document and keep the same lines; an empty table gives no rows;
other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import stored, whole_row, with_result

SLICES = 256
DOC = ["doc_id", "tie"]


def split(text: str) -> tuple[list[str], list[int]]:
    """All lines, and the places of those that have words."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.encode().split()]


def tie(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_ids(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, tie, line, d1, d2, words, alone): a 128-bit id of each line with words, how many, and if it is the whole text; ``line`` counts the lines."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [[xxhash.xxh3_128_digest(lines[i].encode()) for i in at] for lines, at in map(split, b["text"])]
            more = [(len(lines[i].encode().split()), len(lines) == 1) for lines, at in map(split, b["text"]) for i in at]
            words, alone = np.array(more, np.int32).reshape(-1, 2).T
            n = [len(x) for x in ids]
            d = np.frombuffer(b"".join(x for y in ids for x in y), ">i8").astype(np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").repeat(n).array, "tie": np.repeat(b["tie"].to_numpy(), n),
                                "line": np.concatenate([np.arange(k, dtype=np.int32) for k in n]) if n else [], "d1": d[:, 0], "d2": d[:, 1], "words": words, "alone": alone > 0})
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie(F.col("text")).alias("tie"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return d.mapInPandas(run, "doc_id long, tie long, line int, d1 long, d2 long, words int, alone boolean").distinct()


def ranked(classes: DataFrame, within: list[str], order: list[str], slice_: Column) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over the classes of the same ``within`` that come earlier in ``order``.

    ``slice_`` rises with the order; a window sees one slice, or one row per slice.
    """
    c = classes.withColumn("slice", slice_)
    sums = c.groupBy(*within, "slice").agg(F.sum("n").alias("n"))
    offset = sums.select(*[F.col(x).alias(f"_{x}") for x in (*within, "slice")], (F.sum("n").over(W.partitionBy(*within).orderBy("slice")) - F.col("n")).alias("offset"))
    inner = F.sum("n").over(W.partitionBy(*within, "slice").orderBy(*order)) - F.col("n")
    on = [c[x] == offset[f"_{x}"] for x in (*within, "slice")]
    j = c.withColumn("inner", inner).join(offset, on)
    return j.select(*classes.columns, (F.col("offset") + F.col("inner")).alias("before"))


def doublings(lines: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """For depth 1, 2, 4 and so on, as long as there are any: rows (doc_id, tie, line, rank) of the suffixes whose first ``depth`` lines occur again."""
    seen = lines.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Ids are hashes, so slices of their range are even.
    first = stored(ranked(seen, [], ["d1", "d2"], F.shiftright("d1", 56)).select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.col("before").alias("rank")), "ranks")
    active = stored(lines.join(first, (lines["d1"] == first["_1"]) & (lines["d2"] == first["_2"])).select(*DOC, "line", "rank"), "suffixes")
    at = 1
    while not active.isEmpty():
        yield at, active
        follower = active.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), (F.col("line") - at).alias("_line"), F.col("rank").alias("next"))
        pairs = stored(active.join(follower, active["doc_id"].eqNullSafe(F.col("_doc")) & (active["tie"] == F.col("_tie")) & (active["line"] == F.col("_line")))
                       .select(*DOC, "line", "rank", "next"), "pairs")
        classes = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        width = (active.agg(F.max("rank").alias("m")).first()["m"] or 0) // SLICES + 1
        named = stored(ranked(classes, ["rank"], ["next"], F.floor(F.col("next") / width)).select(
            F.col("rank").alias("_rank"), F.col("next").alias("_next"), (F.col("rank") + F.col("before")).alias("name")), "ranks")
        active = stored(pairs.join(named, (pairs["rank"] == named["_rank"]) & (pairs["next"] == named["_next"])).select(*DOC, "line", F.col("name").alias("rank")), "suffixes")
        at *= 2


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """The suffixes of ``doublings`` at one depth (a power of two)."""
    for at, active in doublings(lines):
        if at == depth:
            return active
    return lines.limit(0).select(*DOC, "line", F.lit(0).cast("long").alias("rank"))


def long_copies(lines: DataFrame, long_words: int) -> DataFrame:
    """Rows (doc_id, tie, line) of the later copies of lines of more than ``long_words`` words, but for copies of whole documents."""
    d = lines.where(F.col("words") > long_words)
    place = F.struct(*DOC, "line", "alone")
    first = stored(d.groupBy(F.col("d1").alias("_1"), F.col("d2").alias("_2")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    j = d.join(first, (d["d1"] == first["_1"]) & (d["d2"] == first["_2"]))
    return j.where(~place.eqNullSafe(F.col("first")) & ~(F.col("alone") & F.col("first.alone"))).select(*DOC, "line")


def repeats(docs: DataFrame, min_lines: int) -> DataFrame:
    """Rows (doc_id, tie, line, from_doc, from_tie, from_line): each later copy of a window of ``min_lines`` lines, and the first one."""
    return copies(stored(line_ids(docs), "lines"), min_lines)


def copies(lines: DataFrame, min_lines: int) -> DataFrame:
    """``repeats`` of given lines."""
    return later(suffix_ranks(lines, min_lines))


def later(suffixes: DataFrame) -> DataFrame:
    """Rows (doc_id, tie, line, from_doc, from_tie, from_line): each suffix that is not the first of its rank, and that first one."""
    place = F.struct(*DOC, "line")
    # Written out, so that both sides of the join come straight from a shuffle and a frequent line can be split.
    first = stored(suffixes.groupBy("rank").agg(F.min(place).alias("first")).withColumnRenamed("rank", "_rank"), "firsts")
    j = suffixes.join(first, suffixes["rank"] == first["_rank"])
    return j.where(~place.eqNullSafe(F.col("first"))).select(*DOC, "line", F.col("first.doc_id").alias("from_doc"), F.col("first.tie").alias("from_tie"), F.col("first.line").alias("from_line"))


def deepest(lines: DataFrame, min_lines: int) -> DataFrame:
    """``copies`` at every depth from ``min_lines`` on, each place once: with ``n``, the largest depth at which it is a later copy, and the first one of that depth."""
    source = ["from_doc", "from_tie", "from_line"]
    found = [later(active).withColumn("n", F.lit(at)) for at, active in doublings(lines) if at >= min_lines]
    if len(found) < 2:
        return found[0] if found else later(suffix_ranks(lines, min_lines)).withColumn("n", F.lit(min_lines))
    best = F.max(F.struct("n", *source)).alias("best")
    return reduce(DataFrame.unionByName, found).groupBy(*DOC, "line").agg(best).select(*DOC, "line", *[F.col(f"best.{c}").alias(c) for c in source], "best.n")


def runs(found: DataFrame, min_lines: int) -> DataFrame:
    """Maximal repeated runs (doc_id, tie, line, lines, from_doc, from_tie, from_line) of windows that follow each other with following sources.

    A window has ``min_lines`` lines, or ``n`` where ``found`` has that column.
    """
    same = ["doc_id", "tie", "from_doc", "from_tie", "shift"]
    d = found.withColumn("shift", F.col("line") - F.col("from_line"))
    d = d.withColumn("island", F.col("line") - F.row_number().over(W.partitionBy(*same).orderBy("line")))
    end = F.col("line") + (F.col("n") if "n" in found.columns else F.lit(min_lines))
    g = d.groupBy(*same, "island").agg(F.min("line").alias("line"), F.min("from_line").alias("from_line"), F.max(end).alias("end"))
    return g.select(*DOC, "line", (F.col("end") - F.col("line")).cast("long").alias("lines"), "from_doc", "from_tie", "from_line")


def dedup(docs: DataFrame, min_lines: int = 2, long_words: int | None = None) -> DataFrame:
    """``docs`` with columns _lines, _removed (lines with words, and of them deleted) and _kept (text without the deleted lines).

    ``long_words``: later copies of single lines of more than so many words go as well, but for whole documents (``long_copies``); None leaves them.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines is a power of two")
    lines = stored(line_ids(docs), "lines")
    gone = runs(deepest(lines, min_lines), min_lines).select(*DOC, "line", F.col("lines").cast("int").alias("n"))
    if long_words is not None and min_lines > 1:
        gone = gone.unionByName(long_copies(lines, long_words).select(*DOC, "line", F.lit(1).alias("n")))
    starts = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie")).agg(F.collect_list(F.struct("line", "n")).alias("_starts"))

    @F.pandas_udf("struct<lines: int, removed: int, kept: string>")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, starts):
            lines, at = split(text or "")
            gone = set() if found is None else {at[i] for s in found for i in range(s["line"], s["line"] + s["n"])}
            rows.append((len(at), len(gone), text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
        return pd.DataFrame(rows, columns=["lines", "removed", "kept"])

    # The row travels as one value, so that its names meet no others.
    d = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), tie(F.col("text")).alias("of"))
    j = d.join(starts, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("of") == F.col("_tie")), "left").select("row", cut("row.text", "_starts").alias("cut"))
    return with_result(j, docs.columns, "cut", ("lines", "removed", "kept"))
