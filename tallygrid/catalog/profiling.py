"""Profiling and quality queries."""

from pyspark.sql import functions as F

from ..functions.kinds import (BOILERPLATE, ENCODING_PATTERNS, FAKE_NULLS, PII_PATTERNS, QUALITY_PATTERNS, SENTINELS,
                               TEXT_PATTERNS)
from ..operators import fuzzy, labels, profile as P, quality as Q, temporal as TM
from ..plans import summaries as S
from .base import derived, duck, query, table, union, with_p

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
NUM = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def lit(s):
    return "'" + s.replace("'", "''") + "'"


def pat(s):
    """A pattern for RE2; control characters by code."""
    return lit(s)


def num(c):
    """Number in a text."""
    return f"CASE WHEN regexp_matches({c}, {lit(NUM)}) THEN TRY_CAST({c} AS DOUBLE) END"


def strip(c):
    return f"trim({c}, {WS})"


def inlist(xs):
    return "(" + ", ".join(lit(x) for x in xs) + ")"


FAKE = inlist(FAKE_NULLS)
MESSY = {"customer_id": "bigint", "balance": "double", "segment": "string", "code_text": "string", "source_name": "string", "age": "bigint",
         "email": "string", "joined_date": "string", "weight_text": "string", "amount_text": "string", "colours": "string", "note": "string", "visits": "int"}
M_TEXT = [c for c, t in MESSY.items() if t == "string"]
LINE = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
        "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
L_NUM = [c for c, t in LINE.items() if t in ("bigint", "int", "double")]
FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def fence(c, t, k, where=""):
    """Rows beyond k interquartile ranges."""
    q = f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"
    return f"(SELECT count(*) FROM {t} x, {q} q WHERE x.{c} < q1 - {k} * (q3 - q1) OR x.{c} > q3 + {k} * (q3 - q1))"


def zout(c, t):
    return f"(SELECT count(*) FROM {t} x, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {t}) q WHERE s > 0 AND abs(x.{c} - m) > 3 * s)"


def skew(c):
    return f"coalesce(CASE WHEN isnan(skewness({c})) THEN 0 ELSE skewness({c}) END, 0)"


def kurt(c):
    return f"coalesce(CASE WHEN isnan(kurtosis({c})) THEN 0 ELSE kurtosis({c}) END, 0)"


def dups(t, cols="*"):
    return f"((SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {t})))"


def _profile_sql():
    out = []
    for c, ty in MESSY.items():
        text = ty == "string"
        frac = f"count({num(c)}) * 1.0 / nullif(count({c}), 0)"
        named = text and any(w in c for w in ("date", "time", "dt", "timestamp", "created", "updated", "at", "on"))
        out.append(f"""SELECT '{c}' AS "column", '{ty}' AS dtype, count(*) AS "rows", {dups("m")} AS duplicate_rows,
 round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, count(DISTINCT {c}) AS nunique,
 {f"count(*) FILTER ({strip(c)} IN {FAKE})" if text else "0::BIGINT"} AS fake_nulls,
 {f"coalesce({frac} > 0.1 AND {frac} < 0.9, false)" if text else "false"} AS mixed, {str(bool(named)).lower()} AS datetime_name,
 {f"count(DISTINCT {c}) * 1.0 / count(*) > 0.95" if text else "false"} AS id_like, {"false" if text else f"coalesce(stddev_samp({c}) = 0, false)"} AS constant FROM m""")
    return f"WITH m AS {duck('messy')}\n" + union(out)


@query("P01_profile", _profile_sql())
def p01(spark, sf):
    return P.profile(derived(spark, sf, "messy"), mode="substring")


def _inspect_numeric(c, t):
    return f"""SELECT '{c}' AS "column", count(*) AS total_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS nunique, round(avg({c}), 4) AS mean,
 round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
 round(skewness({c}), 3) AS skewness, round(kurtosis({c}), 3) AS kurtosis, {fence(c, t, 1.5)} AS outliers_iqr_count, count(*) FILTER ({c} < 0) AS negative_count,
 count(*) FILTER ({c} = 0) AS zero_count, 0::BIGINT AS non_numeric_rows FROM {t}"""


@query("P02_inspect_numeric", _inspect_numeric("value", "events"))
def p02(spark, sf):
    return P.inspect_numeric(table(spark, sf, "events"), "value")


def _sh(c, p):
    return f"coalesce(avg(CASE WHEN regexp_matches({strip(c)}, {lit(p)}) THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END)"


def _inspect_text(c):
    over = lambda p, t: f"{_sh(c, p)} > {t}, false)"
    first = lambda ch: f"coalesce(avg(CASE WHEN starts_with({strip(c)}, '{ch}') THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END) > 0.3, false)"
    dates = " OR ".join(over(p, 0.4) for k, p in TEXT_PATTERNS.items() if k.startswith("date_"))
    d, n = f"count(DISTINCT {c})", "count(*)"
    return f"""SELECT '{c}' AS "column", count(*) AS total_rows, count(*) - count({c}) AS null_count, {d} AS nunique, count(*) FILTER ({strip(c)} IN {FAKE}) AS fake_nulls,
 {over(TEXT_PATTERNS["email"], 0.5)} AS email, {over(TEXT_PATTERNS["phone"], 0.5)} AS phone, {over(TEXT_PATTERNS["url"], 0.3)} AS url,
 {first('{')} OR {first('[')} AS json_like, {over(TEXT_PATTERNS["currency"], 0.5)} AS currency, {over(TEXT_PATTERNS["numeric_string"], 0.7)} AS numeric_string,
 {dates} AS date_string, count(*) FILTER ({c} <> {strip(c)}) AS whitespace_issues, {d} > count(DISTINCT lower({strip(c)})) AS case_inconsistency,
 CASE WHEN {d} * 1.0 / {n} > 0.95 THEN 'id_or_high_cardinality_text' WHEN {d} <= 50 OR {d} * 1.0 / {n} < 0.2 THEN 'categorical' ELSE 'free_text' END AS logical_type FROM m"""


for _c in ("email", "segment", "joined_date", "amount_text"):
    query(f"P03_inspect_text_{_c}", f"WITH m AS {duck('messy')}\n" + _inspect_text(_c))(
        lambda spark, sf, c=_c: P.inspect_text(derived(spark, sf, "messy"), c))


@query("P03_inspect_text_props", _inspect_text("props").replace("FROM m", "FROM events"))
def p03(spark, sf):
    return P.inspect_text(table(spark, sf, "events"), "props")


def _kind_sql():
    out = []
    for c, ty in MESSY.items():
        numbers = f"count({num(c)})" if ty == "string" else f"count({c})"
        d = f"count(DISTINCT {c})"
        out.append(f"""SELECT '{c}' AS "column", {d} AS nunique, CASE WHEN {numbers} > 0.6 * count({c}) THEN 'numeric' WHEN {d} * 1.0 / count(*) > 0.95 THEN 'id'
 WHEN {d} <= 50 OR {d} * 1.0 / count(*) < 0.2 THEN 'categorical' ELSE 'free_text' END AS kind FROM m""")
    return f"WITH m AS {duck('messy')}\n" + union(out)


@query("P04_infer_kind", _kind_sql())
def p04(spark, sf):
    return P.infer_kind(derived(spark, sf, "messy"))


@query("P05_top_values", f"""WITH m AS {duck('messy')} SELECT trim(segment) AS value, count(*) AS n, round(count(*) * 1.0 / (SELECT count(segment) FROM m), 6) AS share
 FROM m WHERE segment IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20""")
def p05(spark, sf):
    return P.top_values(derived(spark, sf, "messy"), "segment")


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


DEALS_NUM = ["o_orderkey", "revenue", "cost", "profit", "age", "score_price"]


@query("P06_correlated_pairs", f"WITH d AS {duck('deals')} SELECT * FROM (" + union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(abs(corr({a}, {b})), 4) AS correlation FROM d" for a, b in _pairs(DEALS_NUM)]) + ") WHERE correlation >= 0.95")
def p06(spark, sf):
    return P.correlated_pairs(derived(spark, sf, "deals"))


@query("P07_duplicate_columns", f"WITH d AS {duck('deals')} SELECT * FROM (" + union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(avg(CASE WHEN {a} IS NOT DISTINCT FROM {b} THEN 1.0 ELSE 0.0 END) * 100, 2) AS pct_identical FROM d"
    for a, b in _pairs(["o_orderstatus", "status_copy", "o_orderpriority"])]) + ") WHERE pct_identical >= 95")
def p07(spark, sf):
    return P.duplicate_columns(derived(spark, sf, "deals"))


def _anomaly_sql():
    pos = ["age", "price", "cost", "amount", "salary", "count", "quantity", "weight", "height", "distance", "duration", "size"]
    out = []
    for c, ty in MESSY.items():
        text = ty == "string"
        sh = f"count({num(c)}) * 1.0 / nullif(count({c}), 0)" if text else "NULL"
        parts = f"CASE WHEN {c} IS NOT NULL THEN len(string_split({c}, ',')) END" if text else "NULL"
        neg = f"count(*) FILTER ({c} < 0)" if not text and any(w in c for w in pos) else "0::BIGINT"
        out.append(f"""SELECT '{c}' AS "column", count({c}) = 0 AS entirely_null, count(DISTINCT {c}) = 1 AS constant,
 {f"coalesce({sh} > 0 AND {sh} < 1, false)" if text else "false"} AS mixed_types,
 {f"coalesce(avg(CASE WHEN contains({c}, ',') THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END) > 0.3 AND stddev_samp({parts}) > 1, false)" if text else "false"} AS delimited_variable,
 {neg} AS negative_rows FROM m""")
    return f"WITH m AS {duck('messy')}\n" + union(out)


@query("P08_schema_anomalies", _anomaly_sql())
def p08(spark, sf):
    return P.schema_anomalies(derived(spark, sf, "messy"), mode="substring")


@query("P09_pk_violations", "SELECT * FROM (" + union([
    f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS duplicate_members FROM (SELECT {c}, count(*) AS n FROM {duck('doubled')} GROUP BY 1 HAVING count(*) > 1)"""
    for c in ("c_custkey", "c_nationkey")]) + ") WHERE duplicate_members > 0")
def p09(spark, sf):
    return P.pk_violations(derived(spark, sf, "doubled"), mode="substring")


def _dist_sql(t, cols):
    out = []
    for c in cols:
        iq, zo, n = fence(c, t, 1.5), zout(c, t), f"count({c})"
        rec = ("concat_ws(';', " + f"CASE WHEN abs({skew(c)}) > 1.5 AND count(*) FILTER ({c} < 0) = 0 THEN 'log1p_transform' END, "
               f"CASE WHEN abs({skew(c)}) > 1.5 AND count(*) FILTER ({c} < 0) > 0 THEN 'yeo_johnson_transform' END, CASE WHEN {iq} > {n} * 0.01 THEN 'clip_or_cap_outliers' END, "
               f"CASE WHEN {zo} > {n} * 0.005 THEN 'review_z_outliers' END, CASE WHEN count(*) FILTER ({c} = 0) * 1.0 / {n} > 0.4 THEN 'zero_inflated' END)")
        out.append(f"""SELECT '{c}' AS "column", round({skew(c)}, 3) AS skewness, round({kurt(c)}, 3) AS kurtosis, {iq} AS iqr_outliers, {zo} AS z_outliers,
 count(*) FILTER ({c} < 0) AS neg_count, count(*) FILTER ({c} = 0) AS zero_count, {rec} AS recommendations FROM {t}""")
    return union(out)


@query("P10_distributions", _dist_sql("lineitem", FOUR))
def p10(spark, sf):
    return P.distributions(table(spark, sf, "lineitem"), FOUR)


@query("P10_distributions_skewed", f"WITH s AS {duck('sparse_items')}\n" + _dist_sql("s", ["big_discount", "is_bulk", "high_tax"]))
def p10b(spark, sf):
    return P.distributions(derived(spark, sf, "sparse_items"), ["big_discount", "is_bulk", "high_tax"])


def _missing_sql():
    group = "(" + " UNION ALL ".join(f"SELECT '{c}' AS c, {i} AS p, count(DISTINCT {c}) AS d FROM m" for i, c in enumerate(M_TEXT)) + ")"
    g = f"(SELECT arg_min(c, p) FROM {group} WHERE d <= 20)"
    out = []
    for c, ty in MESSY.items():
        nn = f"count(*) - count({c})"
        if ty == "string":
            top = f"(SELECT max(n) FROM (SELECT count(*) AS n FROM m WHERE {c} IS NOT NULL GROUP BY {c}))"
            rec = f"CASE WHEN {top} * 100.0 / count({c}) > 70 THEN 'fill_mode' ELSE 'fill_constant' END"
        else:
            rec = f"CASE WHEN count({c}) > 5 AND abs({skew(c)}) > 1 THEN 'fill_median' ELSE 'fill_mean_or_median' END || ';groupby_fill_median:' || {g}"
        out.append(f"""SELECT '{c}' AS "column", {nn} AS null_count, round(({nn}) * 100.0 / count(*), 2) AS null_pct,
 CASE WHEN ({nn}) * 100.0 / count(*) > 60 THEN 'consider_dropping_column' ELSE {rec} END AS recommendations FROM m""")
    return f"WITH m AS {duck('messy')} SELECT * FROM (" + union(out) + ") WHERE null_count > 0"


@query("P11_missing_report", _missing_sql())
def p11(spark, sf):
    return P.missing_report(derived(spark, sf, "messy"))


@query("P12_duplicate_report", f"WITH d AS {duck('doubled')}\n" + union(
    [f"""SELECT 'rows' AS kind, '*' AS "column", {dups('d')} AS duplicates"""] +
    [f"""SELECT 'key' AS kind, '{c}' AS "column", count({c}) - count(DISTINCT {c}) AS duplicates FROM d""" for c in ("c_custkey", "c_nationkey")]))
def p12(spark, sf):
    return P.duplicate_report(derived(spark, sf, "doubled"), mode="substring")


@query("P12_duplicate_timestamps", union(
    [f"""SELECT 'rows' AS kind, '*' AS "column", {dups('orders')} AS duplicates""",
     """SELECT 'key' AS kind, 'o_custkey' AS "column", count(o_custkey) - count(DISTINCT o_custkey) AS duplicates FROM orders""",
     """SELECT 'timestamp' AS kind, 'o_orderdate' AS "column", count(o_orderdate) - count(DISTINCT o_orderdate) AS duplicates FROM orders"""]))
def p12b(spark, sf):
    return P.duplicate_report(table(spark, sf, "orders"), mode="substring")


@query("P13_category_report", f"""WITH m AS {duck('messy')}, v AS (SELECT segment AS v, count(*) AS n FROM m WHERE segment IS NOT NULL GROUP BY 1),
 g AS (SELECT lower({strip('v')}) AS l, count(*) AS k FROM v GROUP BY 1)
SELECT 'segment' AS "column", count(*) AS nunique, round(count(*) * 1.0 / (SELECT count(*) FROM m), 4) AS cardinality_ratio, (SELECT count(*) FROM g WHERE k > 1) AS variant_groups,
 count(*) FILTER (n * 1.0 / (SELECT count(*) FROM m) < 0.01) AS rare_categories, CASE WHEN count(*) * 1.0 / (SELECT count(*) FROM m) > 0.5 THEN 'high_cardinality'
 WHEN count(*) <= 10 THEN 'low_cardinality' ELSE 'moderate_cardinality' END AS encoding FROM v""")
def p13(spark, sf):
    return P.category_report(derived(spark, sf, "messy"), "segment")


@query("P13_category_variants", f"""WITH m AS {duck('messy')}, v AS (SELECT segment AS spelling, lower({strip('segment')}) AS canonical, count(*) AS n FROM m WHERE segment IS NOT NULL GROUP BY 1, 2)
SELECT canonical, spelling, n FROM v QUALIFY count(*) OVER (PARTITION BY canonical) > 1""")
def p13b(spark, sf):
    return P.category_variants(derived(spark, sf, "messy"), "segment")


PARSED = "coalesce(try_strptime(joined_date, '%Y-%m-%d'), try_strptime(joined_date, '%d/%m/%Y'), try_strptime(joined_date, '%m-%d-%Y'))"


@query("P14_datetime_report", f"""WITH m AS (SELECT *, {PARSED} AS p FROM {duck('messy')}) SELECT * FROM (SELECT 'joined_date' AS "column", false AS already_parsed,
 round(count(p) * 100.0 / count(*), 2) AS parse_pct, strftime(min(p), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(p), '%Y-%m-%d %H:%M:%S') AS last,
 count(*) FILTER (p > TIMESTAMP '2023-06-01') AS future_dates, count(*) FILTER (p < TIMESTAMP '1900-01-01') AS pre_1900_dates FROM m)""")
def p14(spark, sf):
    return P.datetime_report(derived(spark, sf, "messy"), as_of="2023-06-01")


@query("P14_datetime_report_typed", """SELECT 'o_orderdate' AS "column", true AS already_parsed, round(count(o_orderdate) * 100.0 / count(*), 2) AS parse_pct,
 strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last,
 count(*) FILTER (o_orderdate > TIMESTAMP '2000-01-01') AS future_dates, 0::BIGINT AS pre_1900_dates FROM orders""")
def p14b(spark, sf):
    return P.datetime_report(table(spark, sf, "orders"), as_of="2000-01-01")


def _text_quality(c, t):
    sh = lambda p: f"avg(CASE WHEN regexp_matches({c}, {lit(p)}) THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END)"
    q = QUALITY_PATTERNS
    return f"""SELECT '{c}' AS "column", count({c}) AS row_count, round(avg(length({c})), 1) AS avg_length, max(length({c})) AS max_length, min(length({c})) AS min_length,
 {sh(q['html'])} > 0.1 AS html_tags, {sh(q['escapes'])} > 0.1 AS unicode_escapes, {sh(q['control'])} > 0 AS control_characters,
 count(*) FILTER (lower({strip(c)}) IN {inlist(BOILERPLATE)}) AS boilerplate_rows, avg(CASE WHEN starts_with({c}, '{{') OR starts_with({c}, '[') THEN 1.0 ELSE 0.0 END) > 0.2 AS embedded_json,
 stddev_samp(length({c})) > 2 * avg(length({c})) AS high_length_variance, {sh(q['multiline'])} > 0.1 AS multiline FROM {t}"""


for _n, _t, _c in (("documents", "documents", "text"), ("pages", "pages", "html"), ("props", "events", "props")):
    query(f"P15_text_quality_{_n}", _text_quality(_c, _t))(lambda spark, sf, t=_t, c=_c: Q.text_quality(table(spark, sf, t), c))


@query("P16_date_order", f"WITH d AS {duck('deals')} SELECT 'start_date' AS col_start, 'end_date' AS col_end, count(*) AS violations FROM d WHERE end_date < start_date UNION ALL SELECT 'birth_date', 'end_date', count(*) FROM d WHERE end_date < birth_date")
def p16(spark, sf):
    return Q.date_order_violations(derived(spark, sf, "deals"))


@query("P17_financial_identity", f"WITH d AS {duck('deals')} SELECT 'revenue' AS revenue, 'cost' AS cost, 'profit' AS profit, count(*) AS violations FROM d WHERE abs(revenue - cost - profit) > 0.01")
def p17(spark, sf):
    return Q.financial_violations(derived(spark, sf, "deals"))


@query("P18_age_birth_date", f"WITH d AS {duck('deals')} SELECT 'age' AS age_col, 'birth_date' AS dob_col, count(*) AS mismatch_rows FROM d WHERE abs(age - datediff('day', birth_date, DATE '2024-06-15') / 365.25) > 2")
def p18(spark, sf):
    return Q.age_dob_mismatch(derived(spark, sf, "deals"), "age", "birth_date", "2024-06-15")


def _enc(t, cols):
    return union([f"SELECT '{c}' AS \"column\", " + ", ".join(f"count(*) FILTER (regexp_matches({c}, {lit(p)})) AS {k}_rows" for k, p in ENCODING_PATTERNS.items()) + f" FROM {t}"
                  for c in cols])


@query("P19_encoding_issues", _enc("documents", ["text", "lang", "source"]))
def p19(spark, sf):
    return Q.encoding_issues(table(spark, sf, "documents"))


@query("P19_encoding_issues_pages", _enc("pages", ["url", "html"]))
def p19b(spark, sf):
    return Q.encoding_issues(table(spark, sf, "pages"))


def _outlier_sql(c, t):
    iqr = f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"
    q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max, {q1} AS q1, {q3} AS q3,
 round({iqr}, 4) AS iqr, round({q1} - 1.5 * {iqr}, 4) AS lower_fence, round({q3} + 1.5 * {iqr}, 4) AS upper_fence, round({q1} - 3 * {iqr}, 4) AS extreme_lower, round({q3} + 3 * {iqr}, 4) AS extreme_upper,
 {fence(c, t, 1.5)} AS mild_outlier_count, {fence(c, t, 3.0)} AS extreme_outlier_count, {zout(c, t)} AS z_score_outlier_count,
 CASE WHEN abs(skewness({c})) > 2 AND min({c}) >= 0 THEN 'log1p_transform' WHEN {fence(c, t, 3.0)} < count({c}) * 0.005 THEN 'clip_at_extreme_IQR_bounds'
 WHEN {fence(c, t, 1.5)} < count({c}) * 0.02 THEN 'clip_at_1pct_99pct_quantiles' ELSE 'investigate_before_clipping' END AS recommendations FROM {t}"""


@query("P20_outlier_report", _outlier_sql("value", "events"))
def p20(spark, sf):
    return P.outlier_report(table(spark, sf, "events"), "value")


@query("P20_extreme_samples", """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT 'high' AS side, value FROM events, q WHERE value > q3 + 3 * (q3 - q1) ORDER BY value DESC LIMIT 5""")
def p20b(spark, sf):
    return P.extreme_samples(table(spark, sf, "events"), "value")


@query("P21_suggest_features")
def p21(spark, sf):
    return S.suggest_features(derived(spark, sf, "deals"))


_LEAK_W = ["target", "label", "outcome", "result", "prediction", "score", "flag", "churn", "converted", "purchased", "clicked", "approved", "defaulted", "fraud", "is_"]


def _leak_sql():
    cols = ["o_orderkey", "start_date", "end_date", "revenue", "cost", "profit", "age", "birth_date", "score_price", "o_orderstatus", "status_copy", "o_orderpriority"]
    named = [(c, "name_suggests_target") for c in cols if c != "revenue" and any(w in c for w in _LEAK_W)]
    named += [(c, "id_column") for c in cols if any(w in c for w in ("_id", "id_", "uuid", "key"))]
    parts = [f"SELECT '{c}' AS \"column\", '{r}' AS reason, NULL::DOUBLE AS abs_corr" for c, r in named]
    parts += [f"SELECT '{c}', 'correlates_with_target', round(abs(corr({c}, revenue)), 4) FROM d HAVING abs(corr({c}, revenue)) > 0.98" for c in DEALS_NUM if c not in ("revenue",)]
    return f"WITH d AS {duck('deals')}\n" + union(parts)


@query("P22_leakage_scan", _leak_sql())
def p22(spark, sf):
    return Q.leakage_scan(derived(spark, sf, "deals"), "revenue", mode="substring")


VERIFY_AFTER = "SELECT customer_id, coalesce(balance, 0) AS balance, 'same' AS segment, CAST(NULL AS DOUBLE) AS age, visits FROM m WHERE customer_id >= 10"


def _verify_sql():
    kept, before = ["customer_id", "balance", "segment", "age", "visits"], list(MESSY)
    ty = {"customer_id": "bigint", "balance": "double", "segment": "string", "age": "double", "visits": "int"}
    delta = "(SELECT count(*) FROM a) - (SELECT count(*) FROM m)"
    out = []
    for c in before:
        if c in kept:
            out.append(f"""SELECT '{c}' AS "column", 'kept' AS status, {delta} AS row_delta, (SELECT count(*) - count({c}) FROM a) - (SELECT count(*) - count({c}) FROM m) AS null_delta,
 '{MESSY[c]}' AS dtype_before, '{ty[c]}' AS dtype_after, (SELECT count(DISTINCT {c}) FROM a) <= 1 AND (SELECT count(DISTINCT {c}) FROM m) > 1 AS new_constant, (SELECT count({c}) = 0 FROM a) AS entirely_null""")
        else:
            out.append(f"SELECT '{c}', 'removed', {delta}, NULL, '{MESSY[c]}', NULL, false, false")
    return f"WITH m AS {duck('messy')}, a AS ({VERIFY_AFTER})\n" + union(out)


@query("P23_verify", _verify_sql())
def p23(spark, sf):
    b = derived(spark, sf, "messy")
    return Q.verify(b, spark.sql(VERIFY_AFTER.replace("FROM m", "FROM {m}"), m=b))


def _cmp(c, state, src):
    return f"""SELECT '{state}' AS state, 'double' AS dtype, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS nunique, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
 round(stddev_samp({c}), 4) AS std, NULL::VARCHAR AS mode FROM {src}"""


@query("P24_compare_column", f"WITH m AS {duck('messy')}, a AS (SELECT coalesce(balance, 0) AS balance FROM m)\n" + union([_cmp("balance", "before", "m"), _cmp("balance", "after", "a")]))
def p24(spark, sf):
    b = derived(spark, sf, "messy")
    return Q.compare_column(b, b.select(F.coalesce("balance", F.lit(0)).alias("balance")), "balance")


@query("P24_compare_column_text", f"""WITH m AS {duck('messy')}, a AS (SELECT coalesce(upper(trim(segment)), 'NONE') AS segment FROM m),
 v AS (SELECT 'before' AS state, segment AS s FROM m UNION ALL SELECT 'after', segment FROM a), t AS (SELECT state, s, count(*) AS n FROM v WHERE s IS NOT NULL GROUP BY 1, 2)
SELECT state, 'string' AS dtype, count(*) - count(s) AS null_count, count(DISTINCT s) AS nunique, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std,
 (SELECT s FROM t WHERE t.state = v.state ORDER BY n DESC, s LIMIT 1) AS mode FROM v GROUP BY state""")
def p24b(spark, sf):
    b = derived(spark, sf, "messy")
    return Q.compare_column(b, b.select(F.coalesce(F.upper(F.trim("segment")), F.lit("NONE")).alias("segment")), "segment")


def fuzzy_sql(col, t, threshold):
    return f"""WITH v AS (SELECT trim({col}) AS v, lower(trim({col})) AS l, length(trim({col})) AS k, count(*) AS n FROM {t} WHERE {col} IS NOT NULL GROUP BY 1, 2, 3)
SELECT a.v AS value_a, b.v AS value_b, round((1 - levenshtein(a.l, b.l) * 1.0 / greatest(a.k, b.k)) * 100, 1) AS similarity_pct, a.n AS count_a, b.n AS count_b
 FROM v a JOIN v b ON a.v < b.v AND least(a.k, b.k) >= {threshold / 100} * greatest(a.k, b.k) WHERE 1 - levenshtein(a.l, b.l) * 1.0 / greatest(a.k, b.k) >= {threshold / 100} - 1e-12"""


@query("P25_fuzzy_pairs", fuzzy_sql("p_name", "part", 80))
def p25(spark, sf):
    return fuzzy.fuzzy_pairs(table(spark, sf, "part"), "p_name", 80, limit=None)


@query("P25_fuzzy_pairs_keys", fuzzy_sql("c_name", "customer", 90))
def p25b(spark, sf):
    return fuzzy.fuzzy_pairs(table(spark, sf, "customer"), "c_name", 90, limit=None)


@query("P25_fuzzy_pairs_ratio")
def p25c(spark, sf):
    return fuzzy.fuzzy_pairs(table(spark, sf, "part"), "p_name", 90, method="ratio")


def _range_sql():
    cols = {"customer_id": "customer_id", "balance": "balance", "age": "age", "visits": "visits", **{c: num(c) for c in M_TEXT}}
    words = {"age": ["age", "tenure", "years", "experience"], "money": ["price", "cost", "amount", "salary", "revenue", "income", "fee", "payment"], "count": ["count", "quantity", "num_", "n_", "cnt"]}
    has = lambda c, k: any(w in c for w in words[k])
    out = []
    row = lambda c, x, rule, cond: f"SELECT '{c}' AS \"column\", '{rule}' AS rule, count(*) FILTER ({cond}) AS rows_hit, round(count(*) FILTER ({cond}) * 100.0 / nullif(count({x}), 0), 2) AS pct, count({x}) AS n FROM m"
    keep = []
    for c, x in cols.items():
        if has(c, "age"):
            out.append(row(c, x, "age_range_0_120", f"({x}) < 0 OR ({x}) > 120"))
        if has(c, "money"):
            out.append(row(c, x, "non_negative_financial", f"({x}) < 0"))
        if has(c, "count"):
            out.append(row(c, x, "count_non_negative", f"({x}) < 0"))
        keep += [row(c, x, f"sentinel_value_{s}_too_frequent", f"({x}) = {s}") for s in SENTINELS]
    return (f"WITH m AS {duck('messy')} SELECT \"column\", rule, rows_hit, pct FROM (" + union(out) + ") WHERE rows_hit > 0 AND n > 0 UNION ALL SELECT \"column\", rule, rows_hit, pct FROM ("
            + union(keep) + ") WHERE rows_hit * 1.0 / nullif(n, 0) > 0.05")


@query("P26_validate_ranges", _range_sql())
def p26(spark, sf):
    return Q.validate_ranges(derived(spark, sf, "messy"), mode="substring")


@query("P27_vif", union([f"SELECT '{c}' AS \"column\", round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 4) AS vif, 1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)) > 5 AS high FROM lineitem"
                         for c in ("l_quantity", "l_extendedprice")]))
def p27(spark, sf):
    return Q.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("vif", F.round("vif", 4))


def _det3(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _vif_sql(t, cols):
    """Regression of each of four columns on the other three through the origin, by determinants."""
    c = lambda a, b: f"c{min(a, b)}{max(a, b)}"
    g = lambda a, b: f"g{min(a, b)}{max(a, b)}"
    half = [(a, b) for a in range(4) for b in range(a, 4)]
    m = f"WITH m AS (SELECT {', '.join(f'avg({x}) AS m{a}' for a, x in enumerate(cols))}, {', '.join(f'covar_pop({cols[a]}, {cols[b]}) AS {c(a, b)}' for a, b in half)} FROM {t}), "
    m += f"s AS (SELECT *, {', '.join(f'{c(a, b)} + m{a} * m{b} AS {g(a, b)}' for a, b in half)} FROM m) "
    out = []
    for a in range(4):
        o = [b for b in range(4) if b != a]
        beta = [f"{_det3([[g(p, a) if q == r else g(p, q) for q in o] for p in o])} / {_det3([[g(p, q) for q in o] for p in o])} AS b{r}" for r in o]
        rest = f"{c(a, a)} - 2 * ({' + '.join(f'b{p} * {c(a, p)}' for p in o)}) + {' + '.join(f'b{p} * b{q} * {c(p, q)}' for p in o for q in o)}"
        out.append(f"SELECT '{cols[a]}' AS \"column\", round({c(a, a)} / ({rest}), 4) AS vif, {c(a, a)} / ({rest}) > 5 AS high FROM (SELECT *, {', '.join(beta)} FROM s)")
    return m + union(out)


@query("P27_vif_many", _vif_sql("lineitem", FOUR))
def p27b(spark, sf):
    return Q.vif(table(spark, sf, "lineitem"), FOUR, intercept=False).withColumn("vif", F.round("vif", 4))



def _scale_sql(t, cols):
    rng = lambda c: f"(SELECT max({c}) - min({c}) FROM {t})"
    hi = "greatest(" + ", ".join(rng(c) for c in cols) + ")"
    lo = "least(" + ", ".join(f"nullif({rng(c)}, 0)" for c in cols) + ")"
    out = []
    for c in cols:
        far = f"(SELECT avg(CASE WHEN abs(x.{c} - m) > 3 * s THEN 1.0 ELSE 0.0 END) FROM {t} x, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {t}) q)"
        out.append(f"""SELECT '{c}' AS "column", round(min({c}), 4)::DOUBLE AS min, round(max({c}), 4)::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(max({c}) - min({c}), 4)::DOUBLE AS "range",
 round(skewness({c}), 3) AS skewness, CASE WHEN abs(avg({c})) < 0.1 AND stddev_samp({c}) > 0.9 AND stddev_samp({c}) < 1.1 THEN 'already_standardized' WHEN min({c}) >= 0 AND max({c}) <= 1 THEN 'already_min_max'
 WHEN abs(skewness({c})) > 1.5 AND min({c}) >= 0 THEN 'log1p_then_standardize' WHEN {far} > 0.01 THEN 'robust_scaler' ELSE 'standard_scaler' END AS recommendation, round({hi} / {lo}, 1)::DOUBLE AS magnitude_ratio FROM {t}""")
    return union(out)


@query("P28_scaling_report", _scale_sql("lineitem", FOUR))
def p28(spark, sf):
    return Q.scaling_report(table(spark, sf, "lineitem"), FOUR)


@query("P29_packed_columns", f"WITH m AS {duck('messy')} SELECT 'colours' AS \"column\", ',' AS delimiter, round(avg(len(string_split(colours, ','))), 1) AS avg_values FROM m")
def p29(spark, sf):
    return Q.packed_columns(derived(spark, sf, "messy"))


@query("P29_naming_issues", """SELECT * FROM (VALUES ('Order Date', 'contains_space'), ('Order Date', 'special_characters'), ('Order Date', 'mixed_case'), ('q_1', 'wide_format:q'),
 ('q_2', 'wide_format:q'), ('q_3', 'wide_format:q'), ('7', 'numeric_name')) v("column", issue)""")
def p29b(spark, sf):
    return Q.naming_issues(table(spark, sf, "part").toDF("Order Date", "q_1", "q_2", "q_3", "7", "price"))


@query("P30_unit_issues", f"""WITH m AS {duck('messy')} SELECT 'weight_text' AS "column", 'weight' AS domain, regexp_extract(lower(weight_text), '\\b(kg|lbs?|oz)\\b', 1) AS unit, count(*) AS rows_hit FROM m GROUP BY 3""")
def p30(spark, sf):
    return Q.unit_issues(derived(spark, sf, "messy"))


@query("P30_unit_suspicions", """SELECT 'body_weight' AS "column", 'weight' AS domain, 'mixed_kg_and_lb' AS suspicion UNION ALL SELECT 'temp', 'temperature', 'fahrenheit'""")
def p30b(spark, sf):
    d = table(spark, sf, "customer").select((F.lit(60) + F.col("c_nationkey") * 5).alias("body_weight"), (F.lit(55) + F.col("c_nationkey")).alias("temp"))
    return Q.unit_suspicions(d)


SPARSE = {"l_orderkey": 1, "l_linenumber": 1, "big_discount": 1, "is_bulk": 1, "high_tax": 1, "l_extendedprice": 1, "l_returnflag": 0}


def _sparse_sql():
    cells = f"(SELECT count(*) * {len(SPARSE)} FROM s)"
    zero = lambda c: f"count(*) FILTER ({c} = 0)" if SPARSE[c] else "0"
    empty = "(SELECT " + " + ".join(f"count(*) - count({c}) + {zero(c)}" for c in SPARSE) + " FROM s)"
    return f"WITH s AS {duck('sparse_items')}\n" + union([f"""SELECT '{c}' AS "column", round({zero(c)} * 100.0 / count(*), 1) AS zero_pct, round((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct,
 round(({zero(c)} + count(*) - count({c})) * 100.0 / count(*), 1) AS sparse_pct, ({zero(c)} + count(*) - count({c})) * 100.0 / count(*) > 70 AS sparse,
 {f"count(*) FILTER ({c} NOT IN (0, 1)) = 0" if SPARSE[c] else "false"} AS is_binary_01, round({empty} * 100.0 / {cells}, 1) AS overall_sparsity_pct FROM s""" for c in SPARSE])


@query("P31_sparsity", _sparse_sql())
def p31(spark, sf):
    return Q.sparsity(derived(spark, sf, "sparse_items"))


@query("P32_class_imbalance", """WITH c AS (SELECT CAST(quality AS VARCHAR) AS class, count(*) AS n FROM labels GROUP BY 1), r AS (SELECT round(max(n) * 1.0 / min(n), 1) AS r FROM c)
SELECT class, n, round(n * 100.0 / sum(n) OVER (), 2) AS pct, r AS imbalance_ratio, CASE WHEN r < 3 THEN 'balanced_enough' WHEN r < 10 THEN 'moderate_imbalance' ELSE 'severe_imbalance' END AS band FROM c, r""")
def p32(spark, sf):
    return labels.class_imbalance(table(spark, sf, "labels"), "quality")


def _pii_sql(t, cols, named, cut=0.3):
    out = []
    for c in cols:
        s = f"CAST({c} AS VARCHAR)"
        rate = lambda p: f"avg(CASE WHEN regexp_matches({s}, {lit(p)}) THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END)"
        mask = f"CASE WHEN length(min({s})) > 4 THEN substr(min({s}), 1, 2) || '***' || right(min({s}), 2) ELSE '***' END"
        for k, p in PII_PATTERNS.items():
            out.append(f"SELECT '{c}' AS \"column\", '{k}' AS pii_type, 'value_pattern' AS basis, round({rate(p)} * 100, 1) AS match_rate_pct, {mask} AS masked_sample FROM {t} HAVING {rate(p)} > {cut}")
        if c in named:
            none = " AND ".join(f"{rate(p)} <= 0.3" for p in PII_PATTERNS.values())
            out.append(f"SELECT '{c}', '{named[c]}', 'column_name', NULL, NULL FROM {t} HAVING {none}")
    return union(out)


@query("P33_scan_pii", f"WITH m AS {duck('messy')}\n" + _pii_sql("m", ["email", "segment", "source_name", "joined_date", "amount_text", "note", "balance"], {"source_name": "full_name", "balance": "financial"}))
def p33(spark, sf):
    return Q.scan_pii(derived(spark, sf, "messy"), cols=["email", "segment", "source_name", "joined_date", "amount_text", "note", "balance"], mode="substring")


@query("P33_scan_pii_documents", _pii_sql("documents", ["text", "lang", "source"], {}, 0.001))
def p33b(spark, sf):
    return Q.scan_pii(table(spark, sf, "documents"), 0.001, cols=["text", "lang", "source"])


def _score_sql():
    bad = " + ".join(f"avg(CASE WHEN {c} IS NULL{f' OR {strip(c)} IN {FAKE}' if ty == 'string' else ''} THEN 0.0 ELSE 1.0 END)" for c, ty in MESSY.items())
    return f"""WITH m AS {duck('messy')}, s AS (SELECT count(*) AS "rows", ({bad}) / {len(MESSY)} AS u, {dups('m')} * 1.0 / count(*) AS d FROM m)
SELECT "rows", round(u, 6) AS usable_share, round(d, 6) AS duplicate_share, round(greatest(0, u - d), 6) AS score FROM s"""


@query("P34_quality_score", _score_sql())
def p34(spark, sf):
    return Q.quality_score(derived(spark, sf, "messy"))


@query("P35_temporal_gaps", """WITH g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS g FROM events), m AS (SELECT quantile_cont(g / 1e6, 0.5) AS m FROM g)
SELECT (SELECT count(*) FROM events) AS total_rows, (SELECT count(ts) FROM events) AS valid_timestamps, 0::BIGINT AS unparseable,
 (SELECT floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6)::BIGINT FROM events) AS span_days, round((SELECT m FROM m), 6) AS median_gap_s, round(max(g / 1e6), 6) AS max_gap_s,
 count(*) FILTER (g / 1e6 > 5 * (SELECT m FROM m)) AS gaps_over_5_medians FROM g""")
def p35(spark, sf):
    return TM.temporal_gaps(table(spark, sf, "events"), "ts")


@query("P36_monthly_signal", """WITH c AS (SELECT month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1), v AS (SELECT stddev_samp(n) / avg(n) AS cv FROM c)
SELECT month, n, round(cv, 6) AS cv, cv > 0.3 AS uneven FROM c, v""")
def p36(spark, sf):
    return TM.monthly_signal(table(spark, sf, "orders"), "o_orderdate")


@query("P37_time_split_all_missing", "SELECT event_id, 'train' AS split FROM events")
def p37_missing(spark, sf):
    return TM.time_split(table(spark, sf, "events").withColumn("ts", F.lit(None).cast("timestamp_ntz")), "ts").select("event_id", "split")


@query("P37_split_point", """WITH c AS (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.8) AS c FROM events) SELECT CASE WHEN epoch_us(ts) > c THEN 'test' ELSE 'train' END AS split, count(*) AS n,
 strftime(make_timestamp(floor(any_value(c))::BIGINT), '%Y-%m-%d %H:%M:%S') AS train_end FROM events, c GROUP BY 1""")
def p37(spark, sf):
    e = table(spark, sf, "events")
    end = TM.split_point(e, "ts").select(F.date_format("train_end", "yyyy-MM-dd HH:mm:ss").alias("train_end"))
    return TM.time_split(e, "ts").groupBy("split").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(end))


# The tail probability needs the statistic as it is.
ROUNDED = "* EXCLUDE (p) REPLACE (round(statistic, 6) AS statistic)"


def ks_sql(v):
    """KS distance from a relation v(column, value, side)."""
    return f"""WITH v AS ({v}), h AS (SELECT "column", value, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM v GROUP BY 1, 2),
 c AS (SELECT "column", sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER t AS ta, sum(b) OVER t AS tb FROM h WINDOW w AS (PARTITION BY "column" ORDER BY value), t AS (PARTITION BY "column"))
SELECT "column", max(ta)::BIGINT AS n0, max(tb)::BIGINT AS n1, max(abs(ca * 1.0 / ta - cb * 1.0 / tb)) AS statistic FROM c GROUP BY 1"""


_DRIFT = """WITH q AS (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.25) AS a, quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.75) AS b FROM orders),
 s AS (SELECT *, CASE WHEN epoch_us(o_orderdate) <= a THEN 0 WHEN epoch_us(o_orderdate) > b THEN 1 END AS side FROM orders, q)
 SELECT 'o_totalprice' AS "column", o_totalprice AS value, side FROM s WHERE side IS NOT NULL UNION ALL SELECT 'o_orderkey', o_orderkey, side FROM s WHERE side IS NOT NULL"""


@query("P38_ks_drift", with_p(ks_sql(_DRIFT), "kolmogorov", ROUNDED, "drift"))
def p38(spark, sf):
    return TM.ks_drift(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice", "o_orderkey"]).select(
        "column", "n0", "n1", "statistic", F.round("p_value", 4).alias("p_value"), "drift")


TRIO = {"customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"], "nation": ["n_nationkey", "n_regionkey"]}


@query("P39_key_uniqueness", union([f"""SELECT '{t}' AS "table", '{c}' AS "column", count(DISTINCT {c}) AS unique_values, count(*) AS total_rows, count(DISTINCT {c}) = count(*) AS is_unique_key,
 count(*) - count(DISTINCT {c}) AS duplicate_count FROM {t}""" for t, cs in TRIO.items() for c in cs]))
def p39(spark, sf):
    return S.key_uniqueness({t: table(spark, sf, t) for t in TRIO}, mode="substring")


@query("P39_granularity", """WITH n AS (SELECT 'events' AS t, count(*) AS r, 'timestamp' AS g FROM events UNION ALL SELECT 'orders', count(*), CASE WHEN bool_or(hour(o_orderdate) <> 0 OR minute(o_orderdate) <> 0)
 THEN 'timestamp' WHEN bool_or(day(o_orderdate) <> 1) THEN 'daily' ELSE 'monthly_or_coarser' END FROM orders UNION ALL SELECT 'nation', count(*), NULL FROM nation)
SELECT a.t AS table_a, b.t AS table_b, round(greatest(a.r, b.r) * 1.0 / least(a.r, b.r), 1) AS row_ratio, greatest(a.r, b.r) * 1.0 / least(a.r, b.r) > 10 AS rows_differ,
 coalesce(a.g <> b.g, false) AS grains_differ FROM n a JOIN n b ON a.t < b.t""")
def p39b(spark, sf):
    return S.granularity({t: table(spark, sf, t) for t in ("events", "orders", "nation")})


@query("P40_label_quality", """WITH v AS (SELECT l_discount AS v, count(*) AS n FROM lineitem GROUP BY 1), q AS (SELECT quantile_cont(l_discount, 0.25) AS q1, quantile_cont(l_discount, 0.75) AS q3, count(*) AS t FROM lineitem)
SELECT 'l_discount' AS label, any_value(t) AS total_rows, 0::BIGINT AS null_labels, count(*) AS n_classes, count(*) = 1 AS constant_label, false AS high_cardinality_label,
 arg_min(n, v) * 1.0 / any_value(t) > 0.05 OR arg_max(n, v) * 1.0 / any_value(t) > 0.05 AS truncated_label, coalesce(sum(n) FILTER (v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)), 0)::BIGINT AS outlier_labels,
 false AS near_constant_label FROM v, q""")
def p40(spark, sf):
    return labels.label_quality(table(spark, sf, "lineitem"), "l_discount")


@query("P40_label_quality_text", f"""WITH m AS {duck('messy')}, v AS (SELECT segment AS v, count(*) AS n FROM m WHERE segment IS NOT NULL GROUP BY 1) SELECT 'segment' AS label, (SELECT count(*) FROM m) AS total_rows,
 (SELECT count(*) - count(segment) FROM m) AS null_labels, count(*) AS n_classes, count(*) = 1 AS constant_label, count(*) * 1.0 / (SELECT count(*) FROM m) > 0.8 AS high_cardinality_label, false AS truncated_label,
 0::BIGINT AS outlier_labels, max(n) * 1.0 / sum(n) > 0.95 AS near_constant_label FROM v""")
def p40b(spark, sf):
    return labels.label_quality(derived(spark, sf, "messy"), "segment")


@query("P41_class_separation", union([f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS classes,
 round((SELECT stddev_samp(m) FROM (SELECT avg({c}) AS m FROM lineitem GROUP BY l_returnflag)) / (SELECT stddev_samp({c}) FROM lineitem), 3) AS separation""" for c in FOUR]))
def p41(spark, sf):
    return labels.class_separation(table(spark, sf, "lineitem"), "l_returnflag", FOUR)


def _issues_sql():
    text_dates = [c for c in M_TEXT if any(w in c for w in ("date", "time", "created", "updated", "timestamp"))]
    out = []
    for c, ty in MESSY.items():
        out.append(f"SELECT '{c}' AS c, 'missing_values' AS issue, count(*) - count({c}) AS hit FROM m HAVING count(*) > count({c})")
        out.append(f"SELECT '{c}', 'constant', count({c}) FROM m HAVING count(DISTINCT {c}) = 1")
        if ty == "string":
            k = f"count({num(strip(c))})"
            out.append(f"SELECT '{c}', 'mixed_types', {k} FROM m HAVING {k} * 1.0 / nullif(count({c}), 0) > 0.1 AND {k} * 1.0 / nullif(count({c}), 0) < 0.9")
            out.append(f"SELECT '{c}', 'whitespace', count(*) FILTER ({strip(c)} <> {c}) FROM m HAVING count(*) FILTER ({strip(c)} <> {c}) > 0")
        if c in text_dates:
            out.append(f"SELECT '{c}', 'datetime_review', count({c}) FROM m")
    sev = "CASE issue " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in S.ISSUES.items()) + " END"
    act = "CASE issue " + " ".join(f"WHEN '{k}' THEN {lit(v[1])}" for k, v in S.ISSUES.items()) + " END"
    dup = f"SELECT 'doubled', '*', 'duplicate_rows', {dups('d')}"
    return (f"WITH m AS {duck('messy')}, d AS {duck('doubled')} SELECT t AS \"table\", c AS \"column\", issue, {sev} AS severity, hit AS rows_hit, {act} AS action FROM (SELECT 'messy' AS t, c, issue, hit FROM ("
            + union(out) + f") UNION ALL {dup})")


@query("P42_issue_summary", _issues_sql())
def p42(spark, sf):
    return S.issue_summary({"messy": derived(spark, sf, "messy"), "doubled": derived(spark, sf, "doubled")}, mode="substring")


def stats_sql(tables):
    out = []
    for t, cols in tables.items():
        for c, ty in cols.items():
            n = ty in ("bigint", "int", "double")
            f = lambda e: f"round({e}, 4)::DOUBLE" if n else "NULL::DOUBLE"
            out.append(f"""SELECT '{t}' AS "table", '{c}' AS "column", '{ty}' AS dtype, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 1) AS missing_pct, count(DISTINCT {c}) AS "unique",
 {f(f'avg({c})')} AS mean, {f(f'median({c})')} AS median, {f(f'stddev_samp({c})')} AS std, {f(f'min({c})')} AS min, {f(f'max({c})')} AS max FROM {t}""")
    return union(out)


PART = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}


@query("P43_statistics", stats_sql({"lineitem": LINE, "part": PART}))
def p43(spark, sf):
    return S.statistics({t: table(spark, sf, t) for t in ("lineitem", "part")})


@query("P43_statistics_with_missing", f"WITH messy AS {duck('messy')}\n" + stats_sql({"messy": MESSY}))
def p43b(spark, sf):
    return S.statistics({"messy": derived(spark, sf, "messy")})


def _summary_sql():
    out = []
    row = lambda t, c, kind, rank, label, value: f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{kind}' AS kind, {rank}::BIGINT AS rank, {label} AS label, {value}::DOUBLE AS value"
    for c in ("o_orderkey", "o_custkey", "o_totalprice"):
        for i, (k, e) in enumerate((("mean", f"round(avg({c}), 4)"), ("std", f"round(stddev_samp({c}), 4)"), ("min", f"round(min({c}), 4)"), ("max", f"round(max({c}), 4)"), ("nulls", f"count(*) - count({c})"))):
            out.append(row("orders", c, "numeric", i, f"'{k}'", e) + " FROM orders")
    for c in ("o_orderstatus", "o_orderpriority"):
        out.append(f"SELECT 'orders', '{c}', 'category', row_number() OVER (ORDER BY n DESC, v) - 1, v, n FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 3)")
    out.append("SELECT 'orders', 'o_orderdate', 'datetime', 0, 'span_days', floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400e6) FROM orders")
    return union(out)


@query("P44_data_summary", _summary_sql())
def p44(spark, sf):
    return S.data_summary({"orders": table(spark, sf, "orders")})


_KINDS = {"bigint": "numeric", "int": "numeric", "double": "numeric", "string": "categorical", "timestamp_ntz": "datetime"}


@query("P45_inspect_for_features", f"WITH messy AS {duck('messy')}\n" + union([f"""SELECT '{t}' AS "table", '{c}' AS "column", '{_KINDS[ty]}' AS kind, round((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct,
 """ + ", ".join((f"round({f}({c}), 4)::DOUBLE" if _KINDS[ty] == "numeric" else "NULL::DOUBLE") + f" AS {a}" for a, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + f" FROM {t}"
    for t, cols in (("messy", MESSY), ("lineitem", LINE)) for c, ty in cols.items()]))
def p45(spark, sf):
    return S.inspect_for_fe({"messy": derived(spark, sf, "messy"), "lineitem": table(spark, sf, "lineitem")})


@query("P46_inspect_for_ml", union([f"""SELECT 'lineitem' AS "table", '{c}' AS "column", '{_KINDS[ty]}' AS kind, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS nunique,
 {'false' if _KINDS[ty] == 'datetime' else f'count(DISTINCT {c}) <= 30'} AS target_candidate FROM lineitem""" for c, ty in LINE.items()]))
def p46(spark, sf):
    return S.inspect_for_ml({"lineitem": table(spark, sf, "lineitem")})


@query("P47_list_columns", union([f"SELECT {i + 1}::BIGINT AS position, '{c}' AS \"column\", '{ty}' AS dtype, (SELECT count(*) FROM lineitem) AS \"rows\", {len(LINE)}::BIGINT AS cols" for i, (c, ty) in enumerate(LINE.items())]))
def p47(spark, sf):
    return P.list_columns(table(spark, sf, "lineitem"))


@query("P48_validate_features", f"WITH d AS {duck('deals')}\n" + union(
    [f"""SELECT '{c}' AS "column", 'present' AS status, round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, count(DISTINCT {c}) AS nunique, {v} AS has_variance, {r} AS abs_corr FROM d"""
     for c, v, r in (("cost", "stddev_samp(cost) > 0", "round(abs(corr(cost, revenue)), 4)"), ("age", "stddev_samp(age) > 0", "round(abs(corr(age, revenue)), 4)"),
                     ("o_orderpriority", "count(DISTINCT o_orderpriority) > 1", "NULL::DOUBLE"))] + ["SELECT 'absent', 'missing', NULL, NULL, NULL, NULL"]))
def p48(spark, sf):
    return Q.validate_features(derived(spark, sf, "deals"), ["cost", "age", "o_orderpriority", "absent"], "revenue")
