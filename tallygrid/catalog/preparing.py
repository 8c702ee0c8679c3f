"""Cleaning, feature and merge queries."""

from pyspark.sql import functions as F

from ..functions.kinds import FAKE_NULLS
from ..operators import clean as C, features as X, fuzzy, merge as M
from .base import derived, duck, query, table, union
from .profiling import PARSED, fuzzy_sql, inlist, strip

FAKE = inlist(FAKE_NULLS)
M0 = f"WITH m AS {duck('messy')}\n"


def messy(spark, sf):
    return derived(spark, sf, "messy")


def r(c, n=6):
    return F.round(c, n).alias(c)


@query("C01_nullify", M0 + f"SELECT customer_id, CASE WHEN {strip('segment')} NOT IN {FAKE} THEN segment END AS segment, CASE WHEN {strip('code_text')} NOT IN {FAKE} THEN code_text END AS code_text FROM m")
def c01(spark, sf):
    return C.nullify(messy(spark, sf), ["segment", "code_text"]).select("customer_id", "segment", "code_text")


@query("C02_impute", M0 + """SELECT customer_id, round(coalesce(balance, (SELECT avg(balance) FROM m)), 6) AS balance,
 coalesce(segment, (SELECT segment FROM m WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)) AS segment, coalesce(joined_date, 'never') AS joined_date FROM m""")
def c02(spark, sf):
    return C.impute(messy(spark, sf), {"balance": "mean", "segment": "mode", "joined_date": ("constant", "never")}).select(
        "customer_id", r("balance"), "segment", "joined_date")


@query("C02_impute_median", M0 + "SELECT customer_id, round(coalesce(balance, (SELECT median(balance) FROM m)), 6) AS balance FROM m")
def c02b(spark, sf):
    return C.impute(messy(spark, sf), {"balance": "median"}).select("customer_id", r("balance"))


@query("C03_impute_group", M0 + ", g AS (SELECT code_text, median(balance) AS b FROM m GROUP BY 1) SELECT customer_id, round(coalesce(balance, b), 6) AS balance FROM m LEFT JOIN g USING (code_text)")
def c03(spark, sf):
    return C.impute_group(messy(spark, sf), "balance", "code_text").select("customer_id", r("balance"))


@query("C04_ffill", f"SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {duck('readings')}")
def c04(spark, sf):
    d = derived(spark, sf, "readings").select("event_id", "user_id", "ts", "value")
    return C.ffill(d, ["value"], ["ts", "event_id"], ["user_id"]).select("event_id", "value")


@query("C04_bfill", f"SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {duck('readings')}")
def c04b(spark, sf):
    d = derived(spark, sf, "readings").select("event_id", "ts", "value")
    return C.ffill(d, ["value"], ["ts", "event_id"], backward=True).select("event_id", "value")


@query("C06_null_flags", M0 + "SELECT customer_id, (balance IS NULL)::INT AS balance_was_null, (segment IS NULL)::INT AS segment_was_null FROM m")
def c06(spark, sf):
    return C.add_null_flags(messy(spark, sf), ["balance", "segment"]).select("customer_id", "balance_was_null", "segment_was_null")


@query("C07_dedup", f"SELECT DISTINCT * FROM {duck('doubled')}")
def c07(spark, sf):
    return C.dedup(derived(spark, sf, "doubled"))


@query("C07_dedup_by_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def c07b(spark, sf):
    return C.dedup(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], keep="last").select("o_custkey", "o_orderkey", "o_totalprice")


@query("C08_apply_mapping", M0 + """SELECT customer_id, CASE trim(segment) WHEN 'building' THEN 'BUILDING' WHEN 'household' THEN 'HOUSEHOLD' ELSE segment END AS segment FROM m""")
def c08(spark, sf):
    d = messy(spark, sf)
    m = spark.createDataFrame([("building", "BUILDING"), ("household", "HOUSEHOLD")], "value string, canonical string")
    return C.apply_mapping(d, "segment", m).select("customer_id", "segment")


@query("C08_canonical_mapping", f"""WITH RECURSIVE p AS ({fuzzy_sql('p_name', 'part', 80).replace('WITH v AS', 'WITH v AS', 1)}),
 e AS (SELECT value_a AS x, value_b AS y FROM p UNION SELECT value_b, value_a FROM p), reach(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
 n AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1) SELECT x AS value, arg_min(y, (-n, y)) AS canonical FROM reach JOIN n ON v = y GROUP BY x""")
def c08b(spark, sf):
    return fuzzy.canonical_mapping(fuzzy.fuzzy_pairs(table(spark, sf, "part"), "p_name", 80, limit=None))


@query("C09_cast_columns", M0 + "SELECT customer_id, TRY_CAST(code_text AS BIGINT) AS code_text, CASE visits WHEN 0 THEN false ELSE true END AS visits FROM m")
def c09(spark, sf):
    return C.cast_columns(messy(spark, sf), {"code_text": "bigint", "visits": "boolean"}).select("customer_id", "code_text", "visits")


@query("C10_parse_dates", M0 + f"SELECT customer_id, strftime({PARSED}, '%Y-%m-%d') AS joined FROM m")
def c10(spark, sf):
    return C.parse_dates(messy(spark, sf), "joined_date").select("customer_id", F.date_format("joined_date", "yyyy-MM-dd").alias("joined"))


@query("C11_to_utc", "SELECT event_id, strftime(timezone('UTC', timezone('America/New_York', ts)), '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def c11(spark, sf):
    return C.to_utc(table(spark, sf, "events"), "ts", "America/New_York").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("C12_clip_iqr", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, round(greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), value)), 6) AS value FROM events, q""")
def c12(spark, sf):
    return C.clip(table(spark, sf, "events"), "value").select("event_id", r("value"))


@query("C12_clip_quantile", """WITH q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events) SELECT event_id, round(greatest(a, least(b, value)), 6) AS value FROM events, q""")
def c12b(spark, sf):
    return C.clip(table(spark, sf, "events"), "value", "quantile").select("event_id", r("value"))


@query("C13_log1p", "SELECT event_id, round(ln(1 + value), 6) AS value FROM events")
def c13(spark, sf):
    return C.log1p(table(spark, sf, "events"), "value").select("event_id", r("value"))


@query("C14_yeo_johnson", "SELECT c_custkey, round(CASE WHEN x >= 0 THEN (pow(x + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - x, 1.5) - 1) / 1.5 END, 4) AS x FROM (SELECT c_custkey, c_acctbal - 4000 AS x FROM customer)")
def c14(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") - 4000).alias("x"))
    return C.yeo_johnson(d, "x", 0.5).select("c_custkey", r("x", 4))


@query("C14_yeo_johnson_fitted")
def c14b(spark, sf):
    return C.yeo_johnson(table(spark, sf, "events"), "value").select("event_id", "value")


@query("C12_clip_all_missing", "SELECT event_id, NULL::DOUBLE AS value FROM events")
def c12_missing(spark, sf):
    return C.clip(table(spark, sf, "events").withColumn("value", F.lit(None).cast("double")), "value").select("event_id", "value")


@query("C15_flag_all_missing", "SELECT event_id, 0 AS value_outlier FROM events")
def c15_missing(spark, sf):
    return C.flag(table(spark, sf, "events").withColumn("value", F.lit(None).cast("double")), "value", "outlier").select("event_id", "value_outlier")


@query("C15_flag_negative", M0 + "SELECT customer_id, (age < 0)::INT AS age_negative FROM m")
def c15(spark, sf):
    return C.flag(messy(spark, sf), "age", "negative").select("customer_id", "age_negative")


@query("C15_flag_range", M0 + "SELECT customer_id, (age < 0 OR age > 120)::INT AS age_range FROM m")
def c15b(spark, sf):
    return C.flag(messy(spark, sf), "age", "range", 0, 120).select("customer_id", "age_range")


@query("C15_flag_outlier", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))::INT AS value_outlier FROM events, q""")
def c15c(spark, sf):
    return C.flag(table(spark, sf, "events"), "value", "outlier").select("event_id", "value_outlier")


@query("C16_nullify_sentinels", M0 + "SELECT customer_id, CASE WHEN age NOT IN (-1, 99) THEN age END AS age FROM m")
def c16(spark, sf):
    return C.nullify_sentinels(messy(spark, sf), "age", [-1, 99]).select("customer_id", "age")


@query("C17_standardize_text", M0 + f"SELECT customer_id, lower(regexp_replace({strip('note')}, '\\s+', ' ', 'g')) AS note, lower(regexp_replace({strip('segment')}, '\\s+', ' ', 'g')) AS segment FROM m")
def c17(spark, sf):
    return C.standardize_text(messy(spark, sf), ["note", "segment"]).select("customer_id", "note", "segment")


@query("C18_group_rare", M0 + """, k AS (SELECT segment AS s FROM m WHERE segment IS NOT NULL GROUP BY 1 HAVING count(*) * 1.0 / (SELECT count(*) FROM m) >= 0.05)
SELECT customer_id, CASE WHEN segment IS NULL OR segment IN (SELECT s FROM k) THEN segment ELSE 'Other' END AS segment FROM m""")
def c18(spark, sf):
    return C.group_rare(messy(spark, sf), "segment", 0.05).select("customer_id", "segment")


_CTRL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f​‌‍⁠‎‏﻿‪-‮]"


def clean_sql(c):
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '[\\r\\n]+', ' ', 'g'), '{_CTRL}', '', 'g'), '[ \\t]+', ' ', 'g'), ' ')"


@query("C19_clean_text", M0 + f"SELECT customer_id, {clean_sql('note')} AS note FROM m")
def c19(spark, sf):
    return C.clean_text(messy(spark, sf), "note").select("customer_id", "note")


@query("C19_clean_html", f"SELECT page_id, md5({clean_sql('html')}) AS digest, length({clean_sql('html')})::BIGINT AS n FROM pages")
def c19b(spark, sf):
    return C.clean_text(table(spark, sf, "pages"), "html").select("page_id", F.md5("html").alias("digest"), F.length("html").cast("bigint").alias("n"))


@query("C20_fix_encoding", "SELECT doc_id, md5(text) AS digest FROM documents")
def c20(spark, sf):
    # Every text is broken (UTF-8 bytes read as latin-1) and must come back whole.
    d = table(spark, sf, "documents").select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"))
    return C.fix_encoding(d, "text").select("doc_id", F.md5("text").alias("digest"))


@query("C21_snake_case", "SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS brand, p_type AS brand_2, p_size::BIGINT AS c_2_size FROM part")
def c21(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("bigint")).toDF("PartKey", "part-name", "Brand", "brand", "2 Size")
    return C.snake_case(d)


@query("C22_split_columns", M0 + "SELECT customer_id, trim(string_split(colours, ',')[1]) AS colours_1, trim(string_split(colours, ',')[2]) AS colours_2, trim(string_split(colours, ',')[3]) AS colours_3 FROM m")
def c22(spark, sf):
    return C.split_packed(messy(spark, sf), "colours", ",", "columns", 3).select("customer_id", "colours_1", "colours_2", "colours_3")


@query("C22_split_rows", M0 + "SELECT customer_id, trim(unnest(string_split(colours, ','))) AS colours_item FROM m")
def c22b(spark, sf):
    return C.split_packed(messy(spark, sf), "colours", ",", "rows").select("customer_id", "colours_item")


@query("C22_split_indicators", M0 + "SELECT customer_id, (colours LIKE '%red%')::INT AS colours_red, (colours LIKE '%green%')::INT AS colours_green FROM m")
def c22c(spark, sf):
    return C.split_packed(messy(spark, sf), "colours", ",", "indicators", values=["red", "green"]).select("customer_id", "colours_red", "colours_green")


@query("C23_melt", union([f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, '{c}' AS variable, {c} AS value FROM lineitem" for c in ("l_discount", "l_tax")]))
def c23(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    return C.melt(d, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("C24_expand_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events")
def c24(spark, sf):
    return C.expand_json(table(spark, sf, "events"), "props", "k bigint").select("event_id", "props_k")


@query("C24_expand_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS props_k, json_extract_string(props, '$.z') AS props_z FROM events")
def c24b(spark, sf):
    return C.expand_json(table(spark, sf, "events"), "props", fields=["k", "z"]).select("event_id", "props_k", "props_z")


@query("C25_convert_units", M0 + """SELECT customer_id, round(CAST(regexp_extract(weight_text, '^(\\d+)', 1) AS DOUBLE) * CASE regexp_extract(weight_text, '([a-z]+)$', 1) WHEN 'kg' THEN 1.0 WHEN 'lbs' THEN 0.4536 ELSE 0.02835 END, 6) AS kg FROM m""")
def c25(spark, sf):
    return C.convert_units(messy(spark, sf), "weight_text", "weight", "kg").select("customer_id", r("kg"))


@query("C26_parse_amount", M0 + """SELECT customer_id, round(CASE WHEN amount_text LIKE '$%' THEN CAST(replace(replace(amount_text, '$', ''), ',', '') AS DOUBLE) WHEN amount_text LIKE '%k' THEN CAST(replace(amount_text, 'k', '') AS DOUBLE) * 1000
 WHEN amount_text LIKE '%!%' ESCAPE '!' THEN CAST(replace(amount_text, '%', '') AS DOUBLE) * 0.01 END, 6) AS amount FROM m""")
def c26(spark, sf):
    return C.parse_amount(messy(spark, sf), "amount_text", "amount").select("customer_id", r("amount"))


@query("C27_mask_pii", M0 + """SELECT customer_id, sha256(email) AS email, regexp_replace('10.1.' || (customer_id % 256) || '.7', '\\.\\d+$', '.0/24') AS ip,
 '4111********' || lpad(CAST(customer_id % 10000 AS VARCHAR), 4, '0') AS card, '+1 555-****-***' AS phone FROM (SELECT customer_id, email FROM m)""")
def c27(spark, sf):
    d = messy(spark, sf).select(
        "customer_id", "email", F.concat(F.lit("10.1."), F.col("customer_id") % 256, F.lit(".7")).alias("ip"),
        F.concat(F.lit("4111 2222 3333 "), F.lpad((F.col("customer_id") % 10000).cast("string"), 4, "0")).alias("card"), F.lit("+1 555-1234-777").alias("phone"))
    return C.mask_pii(d, {"email": "hash", "ip": "ip", "card": "card", "phone": "digits"})


@query("C28_drop_columns", M0 + "SELECT * EXCLUDE (source_name, note, age, visits) FROM m")
def c28(spark, sf):
    return C.drop_columns(messy(spark, sf), ["note", "age", "visits"], constant=True)


for _k, _shift, _scale in (("standard", "avg({c})", "stddev_pop({c})"), ("min_max", "min({c})", "max({c}) - min({c})"),
                           ("robust", "median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"), ("log1p_standard", "avg(ln(1 + {c}))", "stddev_pop(ln(1 + {c}))")):
    _x = "ln(1 + {c})" if _k.startswith("log") else "{c}"
    _cols = ["l_quantity", "l_extendedprice"]
    _sql = "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, " + ", ".join(
        f"round(({_x} - (SELECT {_shift} FROM lineitem)) / (SELECT {_scale} FROM lineitem), 6) AS {{c}}".format(c=c) for c in _cols) + " FROM lineitem"

    def _scaled(spark, sf, k=_k, cols=tuple(_cols)):
        d = table(spark, sf, "lineitem")
        return C.apply_scaler(d, C.fit_scaler(d, list(cols), k), list(cols), k).select(
            "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), *[r(c) for c in cols])
    query(f"C29_scale_{_k}", _sql)(_scaled)


@query("C30_rollback", "SELECT s_suppkey, s_acctbal FROM supplier")
def c30(spark, sf):
    from ..sources import writers
    from .base import scratch
    p = scratch(spark)
    d = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    writers.persist_table(d, p)
    writers.persist_table(C.nullify_sentinels(d.withColumn("s_acctbal", F.lit(-1.0)), "s_acctbal"), p)
    return writers.rollback(spark, p)


@query("C31_resample", """WITH a AS (SELECT event_type, date_trunc('hour', ts) AS p, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2),
 c AS (SELECT event_type, unnest(generate_series(min(p), max(p), INTERVAL 1 HOUR)) AS p FROM a GROUP BY 1)
SELECT event_type, strftime(p, '%Y-%m-%d %H') AS period, n, round(v, 4) AS v FROM c LEFT JOIN a USING (event_type, p)""")
def c31(spark, sf):
    d = C.resample(table(spark, sf, "events"), "ts", "hour", ["event_type"], {"n": F.count(F.lit(1)), "v": F.sum("value")})
    return d.select("event_type", F.date_format("period", "yyyy-MM-dd HH").alias("period"), "n", r("v", 4))


@query("F01_date_features", """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, isodow(o_orderdate) - 1 AS d, dayofyear(o_orderdate) AS doy, hour(o_orderdate) AS h,
 (isodow(o_orderdate) >= 6)::INT::BIGINT AS we, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS e, datediff('day', (SELECT min(o_orderdate)::DATE FROM orders), o_orderdate::DATE) AS s FROM orders""")
def f01(spark, sf):
    d = X.date_features(table(spark, sf, "orders"), "o_orderdate")
    return d.select("o_orderkey", *[F.col(f"o_orderdate_{c}").cast("bigint").alias(a) for c, a in (
        ("year", "y"), ("quarter", "q"), ("month", "m"), ("day_of_week", "d"), ("day_of_year", "doy"), ("hour", "h"), ("is_weekend", "we"), ("days_since_epoch", "e"), ("days_since_min", "s"))])


@query("F02_cyclical", "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos FROM events")
def f02(spark, sf):
    return X.cyclical(table(spark, sf, "events").withColumn("hour", F.hour("ts")), "hour", 24).select("event_id", r("hour_sin"), r("hour_cos"))


@query("F03_lags", "SELECT event_id, " + ", ".join(f"lag(value, {n}) OVER w AS value_lag_{n}" for n in (1, 7, 30)) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def f03(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return X.lags(d, "value", ["user_id"], ["ts", "event_id"]).select("event_id", "value_lag_1", "value_lag_7", "value_lag_30")


_ROLL = "CASE WHEN count(value) OVER w >= 3 THEN round({f}(value) OVER w, 6) END AS value_rolling_{n}_7"


@query("F04_rolling", "SELECT event_id, " + ", ".join(_ROLL.format(f=f, n=n) for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("max", "max"))) +
       f" FROM {duck('readings')} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def f04(spark, sf):
    d = derived(spark, sf, "readings").select("event_id", "user_id", "ts", "value")
    out = X.rolling(d, "value", ["user_id"], ["ts", "event_id"], 7, ["mean", "std", "max"], min_periods=3)
    return out.select("event_id", *[r(f"value_rolling_{k}_7") for k in ("mean", "std", "max")])


@query("F05_rolling_time", """SELECT event_id, round(sum(value) OVER w, 4) AS value_sum_14d, count(value) OVER w AS value_count_14d FROM (SELECT *, epoch_us(ts) AS us FROM events)
 WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 1209599999999 PRECEDING AND CURRENT ROW)""")
def f05(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return X.rolling_time(d, "value", ["user_id"], "ts", 14, ["sum", "count"]).select("event_id", r("value_sum_14d", 4), "value_count_14d")


@query("F06_ratio", f"SELECT o_orderkey, round(revenue / nullif(cost, 0), 6) AS revenue_to_cost, round((revenue - cost) / nullif(revenue, 0), 6) AS margin FROM {duck('deals')}")
def f06(spark, sf):
    d = X.margin(X.ratio(derived(spark, sf, "deals"), "revenue", "cost"), "revenue", "cost")
    return d.select("o_orderkey", r("revenue_to_cost"), r("margin"))


@query("F07_interact", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_quantity * l_discount, 6) AS l_quantity_product_l_discount, round(l_quantity + l_tax, 6) AS l_quantity_sum_l_tax FROM lineitem")
def f07(spark, sf):
    d = X.interact(X.interact(table(spark, sf, "lineitem"), "l_quantity", "l_discount"), "l_quantity", "l_tax", "sum")
    return d.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), r("l_quantity_product_l_discount"), r("l_quantity_sum_l_tax"))


@query("F08_bin_edges", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_quantity < 0 THEN NULL WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 30 THEN 1 WHEN l_quantity <= 45 THEN 2 END AS b FROM lineitem")
def f08(spark, sf):
    return X.bin_edges(table(spark, sf, "lineitem"), "l_quantity", [0, 10, 30, 45], "b").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "b")


@query("F08_bin_width", "WITH q AS (SELECT min(value) AS a, max(value) AS z FROM events) SELECT event_id, CASE " + " ".join(
    f"WHEN value <= {'z' if i == 4 else f'a + (z - a) * {i + 1} / 5.0'} THEN {i}" for i in range(5)) + " END AS b FROM events, q")
def f08b(spark, sf):
    return X.bin_width(table(spark, sf, "events"), "value", 5, "b").select("event_id", "b")


@query("F08_bin_quantile", "WITH q AS (SELECT " + ", ".join(f"quantile_cont(value, {i / 4}) AS e{i}" for i in range(5)) + " FROM events) SELECT event_id, CASE " + " ".join(
    f"WHEN value <= e{i + 1} THEN {i}" for i in range(4)) + " END AS b FROM events, q")
def f08c(spark, sf):
    return X.bin_quantile(table(spark, sf, "events"), "value", 4, "b").select("event_id", "b")


@query("F08_bin_quantile_all_missing", "SELECT event_id, NULL::INTEGER AS b FROM events")
def f08_missing(spark, sf):
    return X.bin_quantile(table(spark, sf, "events").withColumn("value", F.lit(None).cast("double")), "value", 4, "b").select("event_id", "b")


@query("F09_text_features", "SELECT doc_id, length(text) AS text_chars, len([x FOR x IN string_split_regex(text, '\\s+') IF x <> ''])::BIGINT AS text_words, (lower(text) LIKE '%license%')::INT AS text_has_license FROM documents")
def f09(spark, sf):
    return X.text_features(table(spark, sf, "documents"), "text", ["license"]).select(
        "doc_id", F.col("text_chars").cast("bigint").alias("text_chars"), F.col("text_words").cast("bigint").alias("text_words"), "text_has_license")


_LEX = [("the", 1.0), ("and", 0.5), ("la", -1.0), ("der", -0.5), ("license", 2.0)]


@query("F10_sentiment", "WITH l(word, score) AS (VALUES " + ", ".join(f"('{w}', {s})" for w, s in _LEX) + """), w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}'']+')) AS word FROM documents),
 s AS (SELECT doc_id, sum(score)::DOUBLE AS t, count(*) AS n FROM w JOIN l USING (word) GROUP BY 1)
SELECT doc_id, round(coalesce(t, 0), 4) AS text_sentiment, coalesce(n, 0) AS text_sentiment_hits FROM documents LEFT JOIN s USING (doc_id)""")
def f10(spark, sf):
    lex = spark.createDataFrame(_LEX, "word string, score double")
    return X.sentiment(table(spark, sf, "documents"), "text", lex, ["doc_id"]).select("doc_id", r("text_sentiment", 4), "text_sentiment_hits")


@query("F11_frequency_encode", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS p_brand_count, round(count(*) OVER (PARTITION BY p_brand) * 1.0 / count(*) OVER (), 6) AS p_brand_share FROM part")
def f11(spark, sf):
    return X.frequency_encode(table(spark, sf, "part"), "p_brand").select("p_partkey", "p_brand_count", r("p_brand_share"))


@query("F12_poly", "SELECT p_partkey, pow(p_size, 2)::DOUBLE AS p_size_pow_2, pow(p_size, 3)::DOUBLE AS p_size_pow_3 FROM part")
def f12(spark, sf):
    return X.poly(table(spark, sf, "part"), "p_size", 3).select("p_partkey", "p_size_pow_2", "p_size_pow_3")


@query("F13_recency", """SELECT o_custkey, datediff('day', max(o_orderdate)::DATE, DATE '2002-01-01') AS recency_days, count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary, round(avg(o_totalprice), 4) AS avg_amount
 FROM orders GROUP BY 1""")
def f13(spark, sf):
    return X.recency(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "2002-01-01", "o_totalprice").select(
        "o_custkey", F.col("recency_days").cast("bigint").alias("recency_days"), "frequency", r("monetary", 2), r("avg_amount", 4))


@query("F13_days_until", "SELECT o_orderkey, datediff('day', DATE '1998-01-01', o_orderdate::DATE) AS days FROM orders")
def f13b(spark, sf):
    return X.days_until(table(spark, sf, "orders"), "o_orderdate", "1998-01-01").select("o_orderkey", F.col("o_orderdate_days_until").cast("bigint").alias("days"))


@query("F14_entity_agg", """SELECT o_orderkey, round(avg(o_totalprice) OVER w, 4) AS m, max(o_totalprice) OVER w AS x, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def f14(spark, sf):
    d = X.entity_agg(table(spark, sf, "orders"), "o_custkey", "o_totalprice")
    return d.select("o_orderkey", F.round("o_custkey_o_totalprice_mean", 4).alias("m"), F.col("o_custkey_o_totalprice_max").alias("x"), F.col("o_custkey_o_totalprice_count").alias("n"))


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("F15_one_hot", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS c_mktsegment_{s}" for s in _SEG) + " FROM customer")
def f15(spark, sf):
    return X.one_hot(table(spark, sf, "customer"), "c_mktsegment").select("c_custkey", *[f"c_mktsegment_{s}" for s in _SEG])


@query("F15_label_encode", M0 + "SELECT customer_id, CASE WHEN segment IS NULL THEN -1 ELSE (SELECT count(DISTINCT s) FROM (SELECT segment AS s FROM m) x WHERE s < m.segment) END AS segment_code FROM m")
def f15b(spark, sf):
    return X.label_encode(messy(spark, sf), "segment").select("customer_id", "segment_code")


_FOLD = "(('0x' || substr(md5('42|' || {k}), 1, 8))::BIGINT % {n})"


@query("F16_target_encode", f"""WITH t AS (SELECT o_orderkey, o_orderpriority AS c, o_totalprice AS y, {_FOLD.format(k='o_orderkey', n=5)} AS f FROM orders)
SELECT o_orderkey, round((sum(y) OVER (PARTITION BY c) - sum(y) OVER (PARTITION BY c, f)) / (count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY c, f)), 4) AS enc FROM t""")
def f16(spark, sf):
    d = table(spark, sf, "orders").withColumn("fold", X.fold_of([F.col("o_orderkey")], 5))
    return X.target_encode(d, "o_orderpriority", "o_totalprice", "fold").select("o_orderkey", F.round("o_orderpriority_target", 4).alias("enc"))


@query("F17_drop_constant", "SELECT s_suppkey, s_acctbal FROM supplier")
def f17(spark, sf):
    d = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", F.lit(3).alias("flat"), F.lit(None).cast("double").alias("void"))
    return X.drop_constant(d)


@query("M01_containment", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN -c_custkey ELSE c_custkey END AS k FROM customer)
SELECT (SELECT count(*) FROM a) AS keys_a, (SELECT count(*) FROM b) AS keys_b, count(*) AS shared, round(count(*) * 1.0 / (SELECT count(*) FROM a), 6) AS a_in_b, round(count(*) * 1.0 / (SELECT count(*) FROM b), 6) AS b_in_a FROM a JOIN b USING (k)""")
def m01(spark, sf):
    return M.containment(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 7 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("k")), "k")


def _suggest_sql():
    found = [("orders", "o_custkey", "customer", "c_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]
    out = []
    for a, ca, b, cb in found:
        both = f"(SELECT count(*) FROM (SELECT DISTINCT {ca} AS k FROM {a} INTERSECT SELECT DISTINCT {cb} FROM {b}))"
        na, nb = f"(SELECT count(DISTINCT {ca}) FROM {a})", f"(SELECT count(DISTINCT {cb}) FROM {b})"
        out.append(f"""SELECT '{a}' AS table_a, '{ca}' AS col_a, '{b}' AS table_b, '{cb}' AS col_b, 1.0::DOUBLE AS name_score, round({both} * 1.0 / {na}, 6) AS a_in_b, round({both} * 1.0 / {nb}, 6) AS b_in_a,
 round({na} * 1.0 / (SELECT count(*) FROM {a}), 6) AS uniqueness_a, round({nb} * 1.0 / (SELECT count(*) FROM {b}), 6) AS uniqueness_b""")
    return union(out)


@query("M01_suggest_joins", _suggest_sql())
def m01b(spark, sf):
    return M.suggest_joins({t: table(spark, sf, t) for t in ("orders", "customer", "nation", "lineitem")}, min_name=0.95, mode="substring")


@query("M02_merge_all", """SELECT custkey, nationkey, o_orderkey, c_name, n_name, c.src AS src, n.src AS src_n FROM (SELECT CASE WHEN o_custkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS custkey, o_orderkey FROM orders) o
 FULL JOIN (SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_name, 'c' AS src FROM customer) c USING (custkey) FULL JOIN (SELECT n_nationkey AS nationkey, n_name, 'n' AS src FROM (SELECT CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey + 100 ELSE n_nationkey END AS n_nationkey, n_name FROM nation)) n USING (nationkey)""")
def m02(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 7 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("custkey"), "o_orderkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"), "c_name", F.lit("c").alias("src"))
    n = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 5 == 0, F.col("n_nationkey") + 100).otherwise(F.col("n_nationkey")).alias("nationkey"), "n_name", F.lit("n").alias("src"))
    return M.merge_all({"o": o, "c": c, "n": n}, [("o", []), ("c", ["custkey"]), ("n", ["nationkey"])])


@query("M03_merge_audit", "SELECT count(*) AS \"rows\", 8::BIGINT AS cols, count(*) > 0 AS ok FROM orders JOIN customer ON o_custkey = c_custkey")
def m03(spark, sf):
    from ..operators.relational import join_tables
    a = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k").drop("o_orderdate", "o_orderpriority")
    return M.merge_audit(join_tables(a, table(spark, sf, "customer").withColumnRenamed("c_custkey", "k"), ["k"], "inner"), allow_empty=True)


@query("M04_join_audit", """WITH a AS (SELECT CASE WHEN c_nationkey < 20 THEN c_nationkey ELSE c_nationkey + 100 END AS k, count(*) AS na FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS nb FROM supplier GROUP BY 1)
SELECT sum(na)::BIGINT AS rows_left, sum(nb)::BIGINT AS rows_right, sum(na) FILTER (nb IS NULL)::BIGINT AS unmatched_left, sum(nb) FILTER (na IS NULL)::BIGINT AS unmatched_right, max(na) AS max_multiplicity_left,
 max(nb) AS max_multiplicity_right, sum(na * nb)::BIGINT AS inner_rows FROM a FULL JOIN b USING (k)""")
def m04(spark, sf):
    return M.join_audit(table(spark, sf, "customer").withColumn("k", F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).otherwise(F.col("c_nationkey") + 100)).drop("c_nationkey"),
                        table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "k"), ["k"])
