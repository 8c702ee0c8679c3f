"""The registered queries of the text operators and the SQL some of them are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, linededup, mixing, packing, rollups, simhash, substrings, termscan, token_files, topk, toxicity, variants
from .common import fresh_path, stored
from .tokens import vocabulary_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary_path(), end_id=2)
    return token_files.read(spark, path)


_SEEDS = ", ".join(map(str, range(mixing.SEEDS)))
_DRAW = "((h1 + h2 * {seed}) % 268435456) / 268435456.0"


@query("op7_mixing", f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS m FROM documents),
h AS (SELECT doc_id, source, size, CAST('0x' || substr(m, 1, 7) AS BIGINT) AS h1, CAST('0x' || substr(m, 9, 7) AS BIGINT) AS h2 FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM h GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level FROM w
  WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT source, source_size, weight, cap, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS level FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM m),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
k AS (SELECT h.source, seed, any_value(target) AS target, sum(size * (floor(rate) + CASE WHEN {_DRAW.format(seed="seed")} < rate - floor(rate) THEN 1 ELSE 0 END)) AS taken
  FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source, (SELECT unnest([{_SEEDS}]) AS seed) GROUP BY h.source, seed),
c AS (SELECT source, arg_min(seed, (abs(taken - target), seed)) AS seed FROM k GROUP BY source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN {_DRAW.format(seed="c.seed")} < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source JOIN c ON h.source IS NOT DISTINCT FROM c.source""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.copies(table(spark, sf_dir, "documents"), [3, 1, 2], 1.5, 2.0)
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=0, max_tokens=2048)


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op4_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")), 0.7)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


_COUNT = "CAST(len(regexp_extract_all(coalesce(text, ''), '{}')) AS BIGINT)"


@query("op6_rollups", f"""
WITH d AS (SELECT doc_id, source, lang, {_COUNT.format('[^\\x20\\x09-\\x0D]+')} AS n1, {_COUNT.format('[A-Za-z]+|[0-9]')} AS n2,
    row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS nth FROM documents)
SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-1' ELSE 'letters-2' END AS tokenizer, count(*) AS docs,
  CAST(sum(CASE WHEN lang = 'en' THEN n1 ELSE n2 END) AS BIGINT) AS tokens
FROM d WHERE nth = 1 GROUP BY 1, 2, 3""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; the first batch is sent twice; documents outside English get counts of a new tokenizer; later exact copies go."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = stored(docs.select("doc_id", "source", "lang", rollups.words(text).alias("n1"),
                                 F.when(F.col("lang") == "en", F.lit(0)).otherwise(rollups.letters_or_digits(text)).alias("n2"),
                                 F.md5(text).alias("digest")), "counted")
    r = rollups.Rollup(spark, fresh_path(spark, "rollup"))

    def feed(d, op, tokenizer, tokens):
        return d.select("doc_id", F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(tokens).alias("tokens"))

    first = feed(counted, "put", "words-1", "n1")
    r.commit(1, first)
    r.commit(1, first)
    r.commit(2, feed(counted.where("NOT lang <=> 'en'"), "put", "letters-2", "n2"))
    firsts = stored(counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    copies = counted.join(firsts.hint("merge"), "digest").where("doc_id <> first")
    r.commit(3, feed(copies, "delete", None, "n1"))
    return r.totals()


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.classes(table(spark, sf_dir, "documents"), words=3, distance=3)
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_line_dedup", """
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM a),
n AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
p AS (SELECT n.doc_id, n.k, row_number() OVER (PARTITION BY n.x, m.x ORDER BY n.doc_id, n.k) AS nth FROM n JOIN n m ON n.doc_id = m.doc_id AND m.k = n.k + 1),
g AS (SELECT DISTINCT doc_id, k + d AS k FROM p, (SELECT unnest([0, 1]) AS d) WHERE nth > 1),
r AS (SELECT l.doc_id, l.i, l.x, n.k IS NOT NULL AS counted, g.k IS NOT NULL AS gone
  FROM l LEFT JOIN n ON l.doc_id = n.doc_id AND l.i = n.i LEFT JOIN g ON n.doc_id = g.doc_id AND n.k = g.k)
SELECT doc_id, CAST(count(*) FILTER (counted) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=2)
    return d.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=20)
    return d.select("doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


_INSIDE = r"([\[<])(\\*(?:" + "|".join(w.replace("]", r"\]") for w in chat.WORDS) + "))"
_ESCAPE = f"regexp_replace({{}}, '{_INSIDE}', '\\1\\\\\\2', 'g')"


@query("op11_chat_format", f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length({_ESCAPE.format('text')})
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 20 + length({_ESCAPE.format('role')}) END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as reply chains, and one whose texts look like the template."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = fresh_path(spark, "chat")
    chat.write(chat.chained(rows), path)
    return chat.read(spark, path).withColumnRenamed("tree", "conv_id").drop("path")


@query("op12_spelling_variants", """
WITH RECURSIVE step(b, k, c) AS (SELECT b::UBIGINT, 0, b::UBIGINT FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM step WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
r AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT run, n, hex(encode(id || ':' || run)) AS hx FROM r WHERE length(run) >= 6),
y AS (SELECT run, n, list_transform(range(length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS UBIGINT)) AS bytes FROM x),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda a, b: xor(a // 256, t[CAST(xor(a, b) % 256 AS BIGINT) + 1])), 4294967295::UBIGINT) AS h FROM y, crc),
e AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
s AS (SELECT word, n, unnest(range(length(word))) AS p FROM v),
w AS MATERIALIZED (SELECT word, n, p, substr(word, 1, CAST(p AS INTEGER)) AS f, substr(word, CAST(p AS INTEGER) + 2) AS b FROM s),
g AS (SELECT DISTINCT w.word AS long, v.word AS short FROM w JOIN v ON v.word = w.f || w.b),
near AS (SELECT a.word, b.word AS o FROM w a JOIN w b ON a.p = b.p AND a.f = b.f AND a.b = b.b AND a.word <> b.word
  UNION ALL SELECT long, short FROM g UNION ALL SELECT short, long FROM g),
k AS (SELECT near.word, count(*) AS n_near, max(v.n) AS m FROM near JOIN v ON v.word = near.o GROUP BY near.word),
o AS (SELECT k.word, any_value(k.n_near) AS n_near, any_value(k.m) AS m, min(near.o) AS best FROM k JOIN near ON near.word = k.word JOIN v ON v.word = near.o AND v.n = k.m GROUP BY k.word),
j AS MATERIALIZED (SELECT v.word, v.n, coalesce(o.n_near, 0) AS n_near, CASE WHEN o.m >= 5 * v.n THEN o.best END AS form, CASE WHEN o.m >= 5 * v.n THEN o.m END AS form_n
  FROM v LEFT JOIN o ON o.word = v.word),
follow(word, root) AS (SELECT word, word FROM j UNION ALL SELECT follow.word, j.form FROM follow JOIN j ON j.word = follow.root WHERE j.form IS NOT NULL),
last AS (SELECT follow.word, arg_max(root, j.n) AS root FROM follow JOIN j ON j.word = follow.root GROUP BY follow.word)
SELECT j.word, j.form, last.root, j.n, j.n_near, j.form_n FROM j JOIN last ON last.word = j.word""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.groups(table(spark, sf_dir, "documents"), min_chars=6, min_count=5, typo_every=199, times=5)


_TERMS = f"unnest(regexp_extract_all(coalesce(text, ''), '{termscan.TERM}'))"
_LOWER = f"translate(term, '{termscan.UPPER}', '{termscan.LOWER}')"


@query("op13_term_scan", f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
a AS (SELECT row, doc_id, {_TERMS} AS term FROM d),
t AS (SELECT row, doc_id, {_LOWER} AS term, count(*) AS tf FROM a GROUP BY ALL),
l AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY row),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
i AS (SELECT item_id, {_TERMS} AS term FROM benchmark),
q AS (SELECT item_id, {_LOWER} AS term, count(*) AS times FROM i GROUP BY ALL),
w AS (SELECT q.item_id, q.term, times * CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM q JOIN f ON f.term = q.term, c),
s AS (SELECT w.item_id, t.row, any_value(t.doc_id) AS doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * l.n * c.docs) // c.terms)))) AS BIGINT) AS score
  FROM w JOIN t ON t.term = w.term JOIN l ON l.row = t.row, c GROUP BY w.item_id, t.row),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termscan.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)
