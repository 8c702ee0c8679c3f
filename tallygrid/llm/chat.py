"""Chat formatting: reply trees as training conversations.

Messages form trees: each names the message it replies to. A path runs from a
root to a leaf; its score adds up (or averages) the scores of its messages. The
best ``branches`` paths of each tree are written out, each as one conversation.

Ancestors are found by self-joins whose reach doubles: after ``k`` of them each
message knows the ancestor ``2**k`` replies up and the score in between, so a
thread of a million replies needs twenty joins. They carry ids only. The chosen
leaves are then widened to whole paths over the same tables, and texts join
last. No tree is gathered; a conversation is written in parts of ``TURNS`` turns.

Template: ``<s>`` opens a conversation; ``[SYS]..[/SYS]`` is a system turn,
``[INST] .. [/INST]`` a user turn, `` .. </s>`` an assistant turn, and
``[ROLE]name[/ROLE]..[/TURN]`` a turn of any other role. A control string inside
a text gets a backslash after its bracket (one more, if it has some already), so
that none is left and the texts come back exactly. Assistant texts are the loss
mask: spans of code points in the formatted text.

Defined cases: null role or text is empty; null tree or node is an id of its
own; a null or unknown parent makes a root; in a ring of replies the least node
is the root; rows repeating a node id are one message (least role and text);
null scores count 0; ties between paths go to the lesser leaf id, compared as
text; null turns of a flat conversation come last, rows of one turn by role and
text, and repeated rows are turns of their own; empty tables give no rows; other
columns are ignored.

Reading back digests each conversation in order. A digest is sequential, so one
conversation is read by one task, a part at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tallygrid.functions.ordering import CHUNK, cut_points, with_chunk

from .common import stored

TURNS = 64  # of a conversation in one written row
SALTS = 64
WORDS = ["s>", "/s>", "INST]", "/INST]", "SYS]", "/SYS]", "ROLE]", "/ROLE]", "/TURN]"]
_REST = "|".join(re.escape(w) for w in WORDS)
INSIDE = rf"([\[<])(\\*(?:{_REST}))"  # a control string or an escaped one
ESCAPED = re.compile(rf"([\[<])\\(\\*(?:{_REST}))")
CONTROL = re.compile(rf"([\[<](?:{_REST}))")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, INSIDE, r"$1\\$2")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def key_of(c: Column) -> Column:
    """Ids of any type, null included, as strings that are never null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def messages(df: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", score: str = "score", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (key, tree, node, parent, score, role, text), one per message of reply trees."""
    value = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0))
    up = F.when(F.col(parent).isNotNull(), key_of(F.col(parent)))
    d = df.select(key_of(F.col(tree)).alias("key"), F.col(tree).alias("tree"), key_of(F.col(node)).alias("node"),
                  F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), up.alias("parent"), value.alias("score")).alias("m"))
    return d.groupBy("key", "node").agg(F.first("tree").alias("tree"), F.min("m").alias("m")).select("key", "tree", "node", "m.*")


def chained(df: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same rows from flat conversations: each row replies to the one before it, in order of ``turn``.

    Rows are numbered within (conversation, range of turns) and the ranges'
    sizes are added, so a long conversation is spread over its ranges.
    """
    d = df.select(key_of(F.col(tree)).alias("key"), F.col(tree).alias("tree"), F.col(turn).cast("double").alias("turn"),
                  F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    d = with_chunk(d, F.coalesce("turn", F.lit(float("inf"))), cut_points(d, F.col("turn")))
    sizes = d.groupBy("key", CHUNK).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("key").orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("key", CHUNK, F.coalesce(before, F.lit(0)).alias("start"))
    inner = W.partitionBy("key", CHUNK).orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    d = d.withColumn("nth", F.row_number().over(inner)).join(sizes, ["key", CHUNK])
    at = F.col("nth") + F.col("start")
    return d.select("key", "tree", key_of(at).alias("node"), "role", "text", F.when(at > 1, key_of(at - 1)).alias("parent"), F.lit(0.0).alias("score"))


def jumps(edges: DataFrame) -> list[DataFrame]:
    """Tables (key, node, up, total, depth, least) whose ``up`` is 1, 2, 4, .. replies higher; null above the root.

    The last one has no ``up`` left: its ``total`` and ``depth`` are those of the whole path.
    """
    longest = edges.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    levels = [edges]
    while not levels[-1].where("up IS NOT NULL").isEmpty():
        cur = levels[-1]
        higher = cur.select("key", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"), F.col("least").alias("least2"))
        more = cur.where("up IS NOT NULL").join(higher, ["key", "up"])
        more = more.select("key", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"),
                           (F.col("depth") + F.col("depth2")).alias("depth"), F.least("least", "least2").alias("least"))
        levels.append(stored(cur.where("up IS NULL").unionByName(more), "jumps"))
        if 1 << (len(levels) - 1) > longest and not levels[-1].where("up IS NOT NULL").isEmpty():
            # Only rings are left. All their members are named as ``up``; the least of each ring becomes its root.
            ring = levels[-1].where("up IS NOT NULL").select("key", F.col("up").alias("node")).distinct()
            heads = levels[-1].join(ring, ["key", "node"], "left_semi").where("node = least").select("key", "node", F.lit(True).alias("head"))
            cut = edges.join(heads, ["key", "node"], "left").withColumn("up", F.when(F.col("head").isNull(), F.col("up"))).drop("head")
            return jumps(stored(cut, "edges"))
    return levels


def paths(m: DataFrame, branches: int = 1, mean: bool = False) -> DataFrame:
    """Rows (key, tree, path, position, role, text): the best ``branches`` root-to-leaf paths of each tree, ranked from 1."""
    m = stored(m, "messages")
    known = m.select("key", F.col("node").alias("parent"), F.lit(True).alias("known"))
    edges = m.select("key", "node", "parent", "score").join(known, ["key", "parent"], "left")
    edges = stored(edges.select("key", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"),
                                F.lit(1).cast("long").alias("depth"), F.col("node").alias("least")), "edges")
    levels = jumps(edges)
    value = F.col("total") / F.col("depth") if mean else F.col("total")
    inner = levels[0].where("up IS NOT NULL").select("key", F.col("up").alias("node")).distinct()
    leaves = levels[-1].join(inner, ["key", "node"], "left_anti").select("key", "node", "depth", value.alias("value"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    best = [F.desc("value"), F.asc("node")]
    leaves = leaves.withColumn("r", F.row_number().over(W.partitionBy("key", "salt").orderBy(*best))).where(F.col("r") <= branches)
    leaves = leaves.withColumn("path", F.row_number().over(W.partitionBy("key").orderBy(*best))).where(F.col("path") <= branches)
    p = stored(leaves.select("key", "path", "node", (F.col("depth") - 1).alias("position")), "paths")
    for k, level in enumerate(levels[:-1]):
        up = level.where("up IS NOT NULL").select("key", "node", "up")
        p = stored(p.unionByName(p.join(up, ["key", "node"]).select("key", "path", F.col("up").alias("node"), (F.col("position") - (1 << k)).alias("position"))), "paths")
    return p.join(m.select("key", "node", "tree", "role", "text"), ["key", "node"]).select("key", "tree", "path", "position", "role", "text")


def formatted(turns: DataFrame) -> DataFrame:
    """Rows (key, tree, path, part, formatted, loss): conversations in parts, with the spans (start, end) of assistant texts in each part."""
    text = escape(F.col("text"))
    marks = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
    head, tail = F.concat(F.lit("[ROLE]"), escape(F.col("role")), F.lit("[/ROLE]")), F.lit("[/TURN]")
    for role, (before, after) in marks.items():
        head, tail = (F.when(F.col("role") == role, F.lit(x)).otherwise(y) for x, y in ((before, head), (after, tail)))
    first = F.when(F.col("position") == 0, F.lit("<s>")).otherwise(F.lit(""))
    d = turns.select("key", "tree", "path", F.floor(F.col("position") / TURNS).cast("long").alias("part"), "position", "role", F.concat(first, head).alias("head"), text.alias("body"), tail.alias("tail"))
    turn = F.struct("position", F.concat("head", "body", "tail").alias("piece"), F.length("head").alias("at"), F.length("body").alias("n"), (F.col("role") == "assistant").alias("loss"))
    g = d.groupBy("key", "path", "part").agg(F.first("tree").alias("tree"), F.sort_array(F.collect_list(turn)).alias("turns"))  # at most TURNS
    nothing = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start: int, end: int>>)").alias("spans"))
    spans = F.aggregate("turns", nothing, lambda a, t: F.struct(
        (a["at"] + F.length(t["piece"])).alias("at"),
        F.when(t["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + t["at"]).alias("start"), (a["at"] + t["at"] + t["n"]).alias("end"))))).otherwise(a["spans"]).alias("spans")))
    return g.select("key", "tree", "path", "part", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans["spans"].alias("loss"))


def write(df: DataFrame, path: str, branches: int = 1, mean: bool = False) -> None:
    """Conversations of ``messages(..)`` or ``chained(..)`` rows, as Parquet."""
    formatted(paths(df, branches, mean)).write.parquet(path)


def parse(part: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a written part."""
    p, out, i = CONTROL.split(part), [], 0
    while i < len(p):
        word = p[i]
        if word in ("", "<s>"):
            i += 1
        elif word == "[SYS]":
            out.append(("system", unescape(p[i + 1])))
            i += 3
        elif word == "[INST]":
            out.append(("user", unescape(p[i + 1][1:-1])))
            i += 3
        elif word == "[ROLE]":
            out.append((unescape(p[i + 1]), unescape(p[i + 3])))
            i += 5
        elif i + 1 < len(p) and p[i + 1] == "</s>":
            out.append(("assistant", unescape(word[1:-1])))
            i += 2
        else:
            raise ValueError(f"not a turn: {word[:40]!r}")
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per written conversation, all from the files: tree, path, n_turns, digests of the turns and of the texts under the loss mask, lengths."""
    d = spark.read.parquet(path)
    kind = d.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None

        def done():
            n, turns, chars, loss, length = state
            return *key, n, turns.hexdigest(), chars, loss.hexdigest(), length

        for b in batches:
            out = []
            for k, nth, text, starts, ends in zip(b["key"], b["path"], b["formatted"], b["start"], b["end"]):
                if (k, nth) != key:
                    if state:
                        out.append(done())
                    key, state = (k, nth), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for at, z in zip(starts, ends):
                    said = unescape(text[at:z])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield pd.DataFrame(out, columns=names)
        if state:
            yield pd.DataFrame([done()], columns=names)

    names = ["key", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = "key string, path int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    whole = d.repartition("key", "path").sortWithinPartitions("key", "path", "part")
    tree = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30).cast(kind)).alias("tree")
    return whole.select("key", "path", "formatted", "loss.start", "loss.end").mapInPandas(run, schema).select(tree, *names[1:])
