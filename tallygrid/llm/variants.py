"""Spelling variant grouping over a corpus's own vocabulary.

Words one edit apart are found with a bit-sliced position index: for each
(position, letter) a bitset over the words of a cell that have the letter there.
A query word's letters drive recurrences over whole bitsets: ``same`` holds the
words equal so far, ``one`` those with one replaced letter, and ``longer`` those
that ran ahead by one letter, which read the index one position on. All queries
of a cell step together, and only three positions of the index are alive.

Cells keep the bitsets short. Class ``c`` holds the words of ``c`` and ``c + 1``
letters. A cell (c, a, s) is for pairs with the same first ``a`` and last ``s``
letters, whose first difference lies between; beginning from halves, a group of
over ``CROWDED`` words is halved again (either the front half of the middle is
the same, or the back half is). A pair's first difference lies in exactly one
cell, so each pair is met once, no group outgrows a task, and a word is in at
most a few cells more where it is crowded. Small groups share a cell.

Defined cases: null text has no words; a null id is an empty string in the hash;
repeated rows count again; ties go to the lesser word in code-point order; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_text

HELD = 300_000  # counts held by a task at a time
CROWDED = 2048  # words of one group, above which it is halved
CELL = 1024  # words that share a cell, about
U = np.uint64


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5, typo_every: int = 199) -> DataFrame:
    """Rows (word, n): runs of letters, A-Z lowered; one run in ``typo_every`` of (document, run) loses a letter."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for i, text in zip(b["id"], b["text"]):
                start = zlib.crc32(f"{i}:".encode())
                for w, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % typo_every == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1:]
                        if len(w) < min_chars:
                            continue
                    held[w] += n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype=np.int64)})
                    held.clear()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype=np.int64)})

    d = with_text(docs, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    return d.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    width = -(-flags.shape[-1] // 64) * 8
    return np.pad(packed, [(0, 0)] * (flags.ndim - 1) + [(0, width - packed.shape[-1])]).view(U)


def flags(sets: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(sets.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def near_matrix(words: list[str], c: int, same_first: int = 0, same_last: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of ``c`` letters, and which of all words (of ``c`` or ``c + 1``) each is one edit from.

    Only pairs count whose first difference is at ``same_first`` or later and, if
    ``same_last``, before ``c - same_last``.
    """
    letters = np.zeros((len(words), c + 1), np.uint32)
    for i, w in enumerate(words):
        letters[i, :len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
    short = np.array([len(w) == c for w in words])
    asks = np.flatnonzero(short)

    def index(p: int) -> np.ndarray:
        """The words that have each query's letter at position ``p``, given the letters by position."""
        alphabet, row = np.unique(letters[:, p], return_inverse=True)
        return alphabet, bits(np.arange(len(alphabet))[:, None] == row[None, :])

    def having(slices, asked: np.ndarray) -> np.ndarray:
        alphabet, sets = slices
        at = np.minimum(np.searchsorted(alphabet, asked), len(alphabet) - 1)
        return np.where((alphabet[at] == asked)[:, None], sets[at], U(0))

    of_c, of_more = bits(short[None, :]), bits(~short[None, :])
    same = np.broadcast_to(bits(np.ones((1, len(words)), bool)), (len(asks), of_c.shape[1])).copy()
    one, longer = np.zeros_like(same), np.zeros_like(same)
    front, differ = same.copy() if same_first == 0 else None, None
    here = index(0)
    for i in range(c):
        ahead = index(i + 1)
        x = letters[asks, i]
        now = having(here, x)
        longer = (longer | same) & having(ahead, x)  # the extra letter is skipped here, or was before
        one = (one & now) | (same & ~now)
        same &= now
        if i + 1 == same_first:
            front = same.copy()
        if same_last and i + 1 == c - same_last:
            differ = ~same
        here = ahead
    found = ((one & of_c) | ((longer | same) & of_more)) & front
    return asks, flags(found if differ is None else found & differ, len(words))


def halves(d: DataFrame) -> DataFrame:
    """Both cells (a, s) into which a cell's middle is cut."""
    middle = F.col("c") - F.col("a") - F.col("s")
    h = F.floor(middle / 2).cast("int")
    both = F.array(F.struct((F.col("a") + h).alias("a"), F.col("s").alias("s")), F.struct(F.col("a"), (F.col("s") + middle - h).alias("s")))
    return d.select("word", "n", "c", F.inline(F.when(middle >= 2, both).otherwise(F.array(F.struct("a", "s")))))


def group_of() -> Column:
    """Number of a row's group; groups that share one by chance only share a cell."""
    return F.xxhash64("c", "a", "s", F.expr("substring(word, 1, a)"), F.expr("right(word, s)"))


def cells(vocabulary: DataFrame, crowded: int = CROWDED, size: int = CELL) -> DataFrame:
    """Rows (word, n, c, a, s, cell): the words dealt to cells, each pair that is one edit apart to exactly one where its first difference counts."""
    c = F.length("word")
    least = vocabulary.agg(F.min(c)).first()[0] or 1
    # As the longer of a pair a word is of the class below, if that has words.
    classes = F.when(c > least, F.array(c, c - 1)).otherwise(F.array(c))
    rows = vocabulary.select("word", "n", F.explode(classes).alias("c")).withColumn("a", F.lit(0)).withColumn("s", F.lit(0))
    open_, settled = halves(rows), None
    while True:
        open_ = stored(open_.withColumn("group", group_of()), "groups")
        many = open_.where("c - a - s >= 2").groupBy("group").count().where(F.col("count") > crowded).select("group")
        fine = open_.join(many, "group", "left_anti")
        settled = fine if settled is None else settled.unionByName(fine)
        if many.isEmpty():
            break
        open_ = halves(open_.join(many, "group", "left_semi"))
    sizes = settled.groupBy("c", "a", "s").agg(F.ceil(F.count(F.lit(1)) / size).alias("cells"))
    return settled.join(sizes, ["c", "a", "s"]).select("word", "n", "c", "a", "s", F.pmod("group", "cells").alias("cell"))


def neighbours(vocabulary: DataFrame, crowded: int = CROWDED, size: int = CELL) -> DataFrame:
    """Rows (word, n_near, best_n, best): number of words one edit away, and the most frequent of them."""
    def close(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        c, a, s, _ = key
        d = d.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)  # str order is code-point order
        words, n = d["word"].to_numpy(object), d["n"].to_numpy()
        asks, near = near_matrix(list(words), int(c), int(a), int(s))
        longer = np.flatnonzero(~np.isin(np.arange(len(words)), asks))
        count, own = near.sum(1), asks
        best = near.argmax(1)  # the first is the most frequent
        if near.size and len(longer):
            m = near[:, longer]
            count, own, best = np.concatenate([count, m.sum(0)]), np.concatenate([own, longer]), np.concatenate([best, asks[m.argmax(0)]])
        hit = count > 0
        own, best = own[hit], best[hit]
        return pd.DataFrame({"word": pd.Series(words[own], dtype=object), "n_near": count[hit].astype(np.int64), "best_n": n[best], "best": pd.Series(words[best], dtype=object)})

    found = cells(vocabulary, crowded, size).groupBy("c", "a", "s", "cell").applyInPandas(close, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("f")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("f.m")).alias("best_n"), "f.best")


def groups(docs: DataFrame, min_chars: int = 6, min_count: int = 5, typo_every: int = 199, times: int = 5) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n): a word's form is its most frequent near word, if ``times`` as frequent; the root is where forms end."""
    vocabulary = stored(word_counts(docs, min_chars, min_count, typo_every), "vocabulary")
    best = neighbours(vocabulary)
    good = F.col("best_n") >= F.col("n") * times
    d = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    d = stored(d, "forms")
    # Counts rise along forms, so chains end; each step doubles what a word has followed.
    to = d.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        to = stored(to.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if to.where("moved").isEmpty():
            break
        to = to.drop("moved")
    return d.join(to.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
