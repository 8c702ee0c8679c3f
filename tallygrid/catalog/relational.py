"""Sources, sinks and relational queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import strftime
from ..operators import relational as R
from ..sources import readers, writers
from .base import derived, duck, query, scratch, table, union

@query("S01_csv_scan", "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, round(c_acctbal,4) AS c_acctbal, c_mktsegment FROM customer")
def s01(spark, sf):
    p = scratch(spark)
    table(spark, sf, "customer").write.option("header", True).option("sep", ";").csv(p)
    d = readers.read_csv_smart(spark, p)
    return d.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"),
                    F.round("c_acctbal", 4).alias("c_acctbal"), "c_mktsegment")


@query("S01_csv_quoted", """SELECT c_custkey::BIGINT AS c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'line one' || chr(10) || 'line "two" of ' || c_name WHEN 1 THEN 'say ""hi"", ' || c_name ELSE c_name END AS note FROM customer""")
def s01_quoted(spark, sf):
    p = scratch(spark)
    note = F.expr("""CASE c_custkey % 3 WHEN 0 THEN concat('line one', chr(10), 'line "two" of ', c_name) WHEN 1 THEN concat('say ""hi"", ', c_name) ELSE c_name END""")
    # Written as text by the rules of the format, not by the library's own sink.
    row = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'))
    # Every part file has its own header, before its first row.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows = table(spark, sf, "customer").select(row.alias("row"), first.alias("first"))
    value = F.explode(F.when(F.col("first"), F.array(F.lit("c_custkey,note"), "row")).otherwise(F.array("row")))
    rows.select(value.alias("value")).write.text(p)
    return readers.read_csv_smart(spark, p).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "note")


@query("S01_csv_late_encoding", "SELECT c_custkey::BIGINT AS c_custkey, CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN 'café' ELSE c_name END AS name FROM customer")
def s01_late(spark, sf):
    p, c = scratch(spark), table(spark, sf, "customer")
    last = c.agg(F.max("c_custkey").alias("last"))
    rows = c.crossJoin(F.broadcast(last)).select("c_custkey", F.when(F.col("c_custkey") == F.col("last"), "café").otherwise(F.col("c_name")).alias("name"))
    rows.sortWithinPartitions("c_custkey").write.option("header", True).option("encoding", "iso-8859-1").csv(p)
    return readers.read_csv_smart(spark, p).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "name")


@query("S02_parquet_scan", "SELECT l_returnflag, l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_discount > 0.05")
def s02(spark, sf):
    return readers.read_parquet(spark, f"{sf}/lineitem.parquet").where("l_quantity >= 49 and l_discount > 0.05").select(
        "l_returnflag", "l_orderkey", "l_quantity")


@query("S03_json_scan", "SELECT s_suppkey AS \"id.key\", s_name AS \"id.name\", s_acctbal AS acctbal FROM supplier")
def s03(spark, sf):
    p = scratch(spark)
    table(spark, sf, "supplier").select(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")).alias("id"),
                                        F.col("s_acctbal").alias("acctbal")).write.json(p)
    return readers.read_json_flat(spark, p, lines=True)


@query("S04_load_all", "SELECT * FROM (VALUES ('absent', CAST(NULL AS BIGINT)), ('nation', (SELECT count(*) FROM nation)), ('part', (SELECT count(*) FROM part))) v(\"table\", \"rows\")")
def s04(spark, sf):
    tables, errors = readers.load_all(spark, [f"{sf}/nation.parquet", f"{sf}/part.parquet", f"{sf}/absent.parquet"])
    bad = errors.select(F.regexp_extract("path", r"(\w+)\.parquet$", 1).alias("table"), F.lit(None).cast("bigint").alias("rows"))
    good = [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, d in tables.items()]
    return bad.unionByName(good[0]).unionByName(good[1])


@query("S05_register", "SELECT n_regionkey::BIGINT AS region, count(*) AS n FROM nation GROUP BY 1")
def s05(spark, sf):
    name, = readers.register({"my nation-2024.csv": table(spark, sf, "nation")})
    return spark.sql(f"SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS n FROM {name} GROUP BY 1")


@query("S06_downcast", """SELECT CASE WHEN max(l_orderkey) < 32768 THEN 'smallint' ELSE 'int' END AS l_orderkey, 'tinyint' AS l_linenumber,
  'float' AS l_quantity, CASE WHEN max(abs(CAST(l_extendedprice AS FLOAT)::DOUBLE - l_extendedprice)) <= 0 THEN 'float' ELSE 'double' END AS l_extendedprice,
  round(sum(l_quantity), 4) AS total FROM lineitem""")
def s06(spark, sf):
    d = R.downcast(table(spark, sf, "lineitem"))
    t = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    return d.agg(F.round(F.sum(F.col("l_quantity").cast("double")), 4).alias("total")).select(
        *[F.lit(t[c]).alias(c) for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")], "total")


@query("S07_export_csv", "SELECT p_partkey::BIGINT AS p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, round(p_retailprice, 4) AS p_retailprice FROM part")
def s07(spark, sf):
    p = writers.export_csv(table(spark, sf, "part"), scratch(spark))
    return spark.read.option("header", True).schema("p_partkey bigint, p_name string, p_brand string, p_type string, p_size bigint, p_retailprice double").csv(
        p).withColumn("p_retailprice", F.round("p_retailprice", 4))


@query("S07_export_round_trip", "SELECT doc_id, text, source FROM documents")
def s07_round_trip(spark, sf):
    p = writers.export_csv(table(spark, sf, "documents").select("doc_id", "text", "source"), scratch(spark))
    return readers.read_csv_smart(spark, p, schema="doc_id bigint, text string, source string")


@query("S08_persist_versions", "SELECT s_suppkey, s_acctbal, 2::BIGINT AS version FROM supplier")
def s08(spark, sf):
    p = scratch(spark)
    writers.persist_table(table(spark, sf, "supplier").withColumn("s_acctbal", F.lit(0.0)), p)
    v = writers.persist_table(table(spark, sf, "supplier"), p)
    return writers.load_table(spark, p).select("s_suppkey", "s_acctbal", F.lit(v).cast("bigint").alias("version"))


def _schema_sql(t, cols, order):
    return union([f"""SELECT '{c}' AS "column", '{ty}' AS dtype, count(DISTINCT {c}) AS nunique,
 round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 1) AS null_pct, count(*) AS "rows",
 (SELECT string_agg(CAST({c} AS VARCHAR), '|' ORDER BY {order}) FROM (SELECT * FROM {t} ORDER BY {order} LIMIT 2)) AS samples FROM {t}"""
                  for c, ty in cols.items()])


@query("S10_describe_schema", _schema_sql("part", {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
                                                   "p_retailprice": "double"}, "p_partkey"))
def s10(spark, sf):
    return R.describe_schema(table(spark, sf, "part"), ["p_partkey"])


@query("R01_sql", "SELECT p_type AS category, count(*) AS cnt FROM part GROUP BY p_type ORDER BY cnt DESC, category")
def r01(spark, sf):
    return R.run_sql(spark, "SELECT p_type AS category, count(*) AS cnt FROM part_v GROUP BY p_type ORDER BY cnt DESC, category",
                     {"part_v": table(spark, sf, "part")})


@query("R02_projection", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def r02(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                                               F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("R03_filter", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 5000")
def r03(spark, sf):
    return R.filter_rows(table(spark, sf, "orders"), "o_orderstatus == 'P' and o_totalprice < 5000").select(
        "o_orderkey", "o_orderstatus", "o_totalprice")


# Whole tables; every seventh key has no partner.
SHIFTED = "CASE WHEN {0} % 7 = 0 THEN -{0} ELSE {0} END::BIGINT"


def shifted(key):
    k = F.col(key).cast("bigint")
    return F.when(k % 7 == 0, -k).otherwise(k)


for how, sql_how in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    def _join(spark, sf, how=how):
        a = table(spark, sf, "orders").select(shifted("o_custkey").alias("custkey"), "o_orderkey", F.lit("o").alias("tag"))
        b = table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("custkey"), "c_name", F.lit("c").alias("tag"))
        return R.join_tables(a, b, ["custkey"], how)
    query(f"R04_join_{how}", f"""SELECT custkey, o_orderkey, a.tag AS tag_x, c_name, b.tag AS tag_y
FROM (SELECT {SHIFTED.format("o_custkey")} AS custkey, o_orderkey, 'o' AS tag FROM orders) a
{sql_how} (SELECT c_custkey::BIGINT AS custkey, c_name, 'c' AS tag FROM customer) b USING (custkey)""")(_join)


@query("R05_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT " + SHIFTED.format("o_custkey") + " FROM orders)")
def r05a(spark, sf):
    o = table(spark, sf, "orders").select(shifted("o_custkey").alias("c_custkey"))
    return R.join_tables(table(spark, sf, "customer"), o, ["c_custkey"], "left_semi").select("c_custkey", "c_name")


@query("R05_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT " + SHIFTED.format("o_custkey") + " FROM orders)")
def r05b(spark, sf):
    o = table(spark, sf, "orders").select(shifted("o_custkey").alias("c_custkey"))
    return R.join_tables(table(spark, sf, "customer"), o, ["c_custkey"], "left_anti").select("c_custkey", "c_name")


BANDS = "SELECT n_nationkey::BIGINT AS band, n_nationkey * 20000.0 AS lo, n_nationkey * 20000.0 + 25000.0 AS hi FROM nation"


@query("R06_range_join", f"SELECT o_orderkey, band FROM orders JOIN ({BANDS}) b ON o_totalprice >= lo AND o_totalprice < hi")
def r06(spark, sf):
    b = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("band"), (F.col("n_nationkey") * 20000.0).alias("lo"),
                                          (F.col("n_nationkey") * 20000.0 + 25000.0).alias("hi"))
    return R.range_join(table(spark, sf, "orders"), b, "o_totalprice", "lo", "hi").select("o_orderkey", "band")


@query("R06_range_join_mixed_lengths", """WITH b AS (SELECT s_suppkey, TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey * 37 % 2000 AS INTEGER)) AS lo FROM supplier),
 c AS (SELECT s_suppkey, lo, lo + to_days(CAST(power(2, s_suppkey % 13) AS INTEGER)) AS hi FROM b)
SELECT s_suppkey, count(*) AS n, min(o_orderkey) AS least FROM orders JOIN c ON o_orderdate >= lo AND o_orderdate < hi GROUP BY s_suppkey""")
def r06_mixed(spark, sf):
    """Orders within a span of 1 to 4096 days of each supplier."""
    days = lambda n, at: F.timestamp_add("DAY", n.cast("int"), at)
    b = table(spark, sf, "supplier").select("s_suppkey", days(F.col("s_suppkey") * 37 % 2000, F.lit("1995-01-01").cast("timestamp_ntz")).alias("lo"))
    b = b.withColumn("hi", days(F.pow(F.lit(2), F.col("s_suppkey") % 13), F.col("lo")))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    d = R.range_join(o, b, "o_orderdate", "lo", "hi", totals={"n": (F.count(F.lit(1)), F.sum), "least": (F.min("o_orderkey"), F.min)})
    return d.groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.min("least").alias("least"))


@query("R07_asof_join", """SELECT a.event_id, b.event_id AS last_purchase, b.value AS purchase_value FROM (SELECT * FROM events WHERE event_type = 'error') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def r07(spark, sf):
    e = table(spark, sf, "events")
    a = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    b = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"), F.col("value").alias("purchase_value"))
    return R.asof_join(a, b, "ts", ["user_id"]).select("event_id", "last_purchase", "purchase_value")


@query("R07_asof_join_forward", """SELECT a.event_id, b.event_id AS next_purchase FROM (SELECT * FROM events WHERE event_type = 'error') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts <= b.ts""")
def r07b(spark, sf):
    e = table(spark, sf, "events")
    a = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    b = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("next_purchase"))
    return R.asof_join(a, b, "ts", ["user_id"], "forward").select("event_id", "next_purchase")


AGG = """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
 min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(DISTINCT l_suppkey) AS suppliers FROM {} GROUP BY l_returnflag, l_linestatus"""


@query("R08_group_by", AGG.format("lineitem"))
def r08(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.min("l_discount").alias("min_disc"), F.max("l_tax").alias("max_tax"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("R08_revenue_per_customer", """SELECT count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice) / count(DISTINCT o_custkey), 4) AS avg_revenue FROM orders""")
def r08b(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("r"))
    return per.agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("r") / F.count(F.lit(1)), 4).alias("avg_revenue"))


@query("R09_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def r09a(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query("R09_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def r09b(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query("R09_grouping_sets", """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def r09c(spark, sf):
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {o} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
                     o=table(spark, sf, "orders"))


@query("R10_distinct", "SELECT DISTINCT c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer")
def r10(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_mktsegment").distinct()


@query("R10_approx_distinct")
def r10b(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("R11_window_ranking", """SELECT s_suppkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn,
 round(percent_rank() OVER w, 6) AS pct, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS next_key
 FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)""")
def r11(spark, sf):
    d = R.ranking(table(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal", ["s_suppkey"], descending=True, lead="s_suppkey")
    return d.select("s_suppkey", F.col("rank").cast("bigint").alias("rnk"), F.col("dense_rank").cast("bigint").alias("dense"),
                    F.col("row_number").cast("bigint").alias("rn"), F.round("percent_rank", 6).alias("pct"), F.col("next_s_suppkey").alias("next_key"))


@query("R11_ranking_lineitem", """SELECT l_orderkey, l_linenumber, rank() OVER w AS rnk, dense_rank() OVER w AS dense, round(percent_rank() OVER w, 6) AS pct,
 row_number() OVER u AS rn, lead(l_orderkey) OVER u AS next_key
 FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice), u AS (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber)""")
def r11_lineitem(spark, sf):
    d = R.ranking(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"], lead="l_orderkey")
    return d.select("l_orderkey", "l_linenumber", F.col("rank").cast("bigint").alias("rnk"), F.col("dense_rank").cast("bigint").alias("dense"),
                    F.round("percent_rank", 6).alias("pct"), F.col("row_number").cast("bigint").alias("rn"), F.col("next_l_orderkey").alias("next_key"))


@query("R11_running_total", """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders""")
def r11b(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return R.running_total(d, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "running").select(
        "o_orderkey", F.round("running", 2).alias("running"))


@query("R11_running_total_missing", f"""WITH d AS {duck("readings")} SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running FROM d""")
def r11c(spark, sf):
    return R.running_total(derived(spark, sf, "readings"), ["user_id"], ["ts", "event_id"], "value", "running").select("event_id", F.round("running", 4).alias("running"))


@query("R12_qualify", "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def r12(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return R.qualify(table(spark, sf, "orders"), {"rn": F.row_number().over(w)}, F.col("rn") == 1).select("o_orderkey", "o_custkey")


@query("R13_pivot", """SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 4) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 4) AS O
 FROM lineitem GROUP BY l_returnflag""")
def r13(spark, sf):
    return R.pivot_table(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], F.round(F.sum("l_quantity"), 4))


@query("R13_unpivot", union([f"SELECT p_partkey, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM part" for c in ("p_size", "p_retailprice")]))
def r13b(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot(
        ["p_partkey"], ["p_size", "p_retailprice"], "variable", "value")


@query("R14_top_k", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def r14(spark, sf):
    return R.top_k(table(spark, sf, "lineitem"), [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 25).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_extendedprice")


@query("R14_top_k_per_group", """SELECT p_brand, p_partkey, p_retailprice FROM part
 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3""")
def r14b(spark, sf):
    return R.top_k(table(spark, sf, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], 3, ["p_brand"]).select("p_brand", "p_partkey", "p_retailprice")


@query("R14_best_category", "SELECT p_type, round(avg(p_retailprice), 4) AS avg_price FROM part GROUP BY p_type ORDER BY avg_price DESC, p_type LIMIT 1")
def r14c(spark, sf):
    g = table(spark, sf, "part").groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 4).alias("avg_price"))
    return R.top_k(g, [F.desc("avg_price"), F.asc("p_type")], 1)


_A = "SELECT c_nationkey::BIGINT AS k FROM customer"
_B = "SELECT " + SHIFTED.format("s_nationkey") + " AS k FROM supplier"
for _name, _op, _fn in (("union", "UNION", lambda a, b: a.union(b).distinct()), ("union_all", "UNION ALL", lambda a, b: a.unionByName(b)),
                        ("intersect", "INTERSECT", lambda a, b: a.intersect(b)), ("except", "EXCEPT", lambda a, b: a.subtract(b)),
                        ("intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b)), ("except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b))):
    def _setop(spark, sf, fn=_fn):
        a = table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("k"))
        b = table(spark, sf, "supplier").select(shifted("s_nationkey").alias("k"))
        return fn(a, b)
    query(f"R15_{_name}", f"{_A} {_op} {_B}")(_setop)


@query("R16_scalar_functions", """SELECT event_id, upper(event_type) AS up, length(event_type)::BIGINT AS len, substr(event_type, 1, 3) AS head, replace(event_type, 'e', '3') AS rep,
 round(sqrt(value), 6) AS root, floor(value)::BIGINT AS fl, sign(value - 20)::DOUBLE AS sg, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(date_trunc('month', ts), '%Y/%m/%d') AS month_start, CAST(dayofyear(ts) AS BIGINT) AS doy FROM events""")
def r16(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.upper("event_type").alias("up"), F.length("event_type").cast("bigint").alias("len"), F.substring("event_type", 1, 3).alias("head"),
        F.replace(F.col("event_type"), F.lit("e"), F.lit("3")).alias("rep"), F.round(F.sqrt("value"), 6).alias("root"), F.floor("value").alias("fl"),
        F.signum(F.col("value") - 20).alias("sg"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), strftime(F.col("ts"), "%Y-%m-%d %H:%M").alias("minute"),
        strftime(F.date_trunc("month", "ts"), "%Y/%m/%d").alias("month_start"), F.dayofyear("ts").cast("bigint").alias("doy"))


@query("R16_array_functions", """SELECT vec_id, len(embedding)::BIGINT AS dims, round(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding]), 4) AS norm2,
 round(list_max(embedding)::DOUBLE, 4) AS top, len([x FOR x IN embedding IF x > 0])::BIGINT AS positives FROM embeddings""")
def r16b(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.size(e).cast("bigint").alias("dims"),
        F.round(F.aggregate(e, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm2"),
        F.round(F.array_max(e).cast("double"), 4).alias("top"), F.size(F.filter(e, lambda x: x > 0)).cast("bigint").alias("positives"))


@query("R17_subqueries", """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey)
SELECT c_custkey, round(t, 2) AS total FROM customer JOIN big ON c_custkey = o_custkey
WHERE t > (SELECT avg(t) FROM big) AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)""")
def r17(spark, sf):
    return spark.sql("""WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey)
SELECT c_custkey, round(t, 2) AS total FROM {customer} JOIN big ON c_custkey = o_custkey
WHERE t > (SELECT avg(t) FROM big) AND EXISTS (SELECT 1 FROM {nation} n WHERE n.n_nationkey = c_nationkey AND n.n_regionkey = 1)""",
                     **{t: table(spark, sf, t) for t in ("orders", "customer", "nation")})


@query("R18_sample_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 20000 ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 10")
def r18(spark, sf):
    return R.sample_rows(table(spark, sf, "orders"), 10, ["o_orderkey"], "o_totalprice < 20000").select("o_orderkey", "o_totalprice")


@query("R19_preview", union([f"""SELECT '{t}' AS "table", row_number() OVER (ORDER BY {k}) AS "row" FROM (SELECT * FROM {t} ORDER BY {k} LIMIT 5)"""
                             for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"))]))
def r19(spark, sf):
    return R.preview({t: table(spark, sf, t) for t in ("region", "nation")}, {"region": ["r_regionkey"], "nation": ["n_nationkey"]}).drop("record")
