"""Statistics, analytics, machine learning, chart data and user function queries."""

import pandas as pd
from pyspark.sql import functions as F

from ..functions.wide import column_stats
from ..operators import analytics as A, chartdata as V, ml as L, stats as T, userfn as U
from .base import derived, duck, query, scratch, table, union, with_p
from .preparing import _FOLD, r
from .profiling import ROUNDED, ks_sql

EV = "('error', 'click')"


def _correlation_p(sql: str) -> str:
    t = f"SELECT test, r AS statistic_r, n, r * sqrt((n - 2) / greatest(1 - r * r, 1e-300)) AS statistic, (n - 2)::DOUBLE AS dof FROM ({sql})"
    return f"SELECT test, round(statistic_r, 6) AS statistic, n, p_value, significant FROM ({with_p(t, 't')})"


def reading():
    return [F.round("p_value", 4).alias("p_value"), "significant"]


@query("T01_ttest", with_p("""SELECT 't_independent' AS test, round((m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS statistic, (n1 + n2 - 2)::DOUBLE AS dof FROM (
 SELECT count(value) FILTER (event_type = 'click') AS n1, avg(value) FILTER (event_type = 'click') AS m1, var_samp(value) FILTER (event_type = 'click') AS s1,
 count(value) FILTER (event_type = 'error') AS n2, avg(value) FILTER (event_type = 'error') AS m2, var_samp(value) FILTER (event_type = 'error') AS s2 FROM events)""", "t", "* EXCLUDE (p)"))
def t01(spark, sf):
    return T.ttest_ind(table(spark, sf, "events"), "value", "event_type", groups=("click", "error")).select("test", r("statistic"), "dof", *reading())


@query("T01_ttest_welch", with_p("""SELECT 't_welch' AS test, round((m1 - m2) / sqrt(s1 / n1 + s2 / n2), 6) AS statistic, round(pow(s1 / n1 + s2 / n2, 2) / (pow(s1 / n1, 2) / (n1 - 1) + pow(s2 / n2, 2) / (n2 - 1)), 4) AS dof FROM (
 SELECT count(value) FILTER (event_type = 'click') AS n1, avg(value) FILTER (event_type = 'click') AS m1, var_samp(value) FILTER (event_type = 'click') AS s1,
 count(value) FILTER (event_type = 'view') AS n2, avg(value) FILTER (event_type = 'view') AS m2, var_samp(value) FILTER (event_type = 'view') AS s2 FROM events)""", "t", "* EXCLUDE (p)"))
def t01b(spark, sf):
    return T.ttest_ind(table(spark, sf, "events"), "value", "event_type", False).select("test", r("statistic"), r("dof", 4), *reading())


@query("T02_ttest_paired", with_p("""SELECT 't_paired' AS test, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 4) AS statistic, (count(*) - 1)::DOUBLE AS dof FROM lineitem""", "t", "* EXCLUDE (p)"))
def t02(spark, sf):
    return T.ttest_rel(table(spark, sf, "lineitem"), "l_discount", "l_tax").select("test", r("statistic", 4), "dof", *reading())


@query("T03_anova", with_p("""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS s FROM events GROUP BY 1), t AS (SELECT avg(value) AS g FROM events)
SELECT 'anova' AS test, round(sum(n * pow(m - g, 2)) / (count(*) - 1) / (sum(n * s) / (sum(n) - count(*))), 6) AS statistic, (count(*) - 1)::DOUBLE AS df_between, (sum(n) - count(*))::DOUBLE AS df_within FROM g, t""", "f", "* EXCLUDE (p)"))
def t03(spark, sf):
    return T.anova(table(spark, sf, "events"), "value", "event_type").select("test", r("statistic"), "df_between", "df_within", *reading())


def _chi(t, a, b, yates):
    d = "greatest(abs(n - e) - 0.5, 0)" if yates else "(n - e)"
    return f"""WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY 1, 2), x AS (SELECT a, sum(n) AS ra FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS cb FROM c GROUP BY 1),
 z AS (SELECT coalesce(n, 0) AS n, ra * 1.0 * cb / (SELECT sum(n) FROM c) AS e FROM x CROSS JOIN y LEFT JOIN c USING (a, b))
SELECT 'chi2' AS test, round(sum({d} * {d} / e), 6) AS statistic, (((SELECT count(*) FROM x) - 1) * ((SELECT count(*) FROM y) - 1))::DOUBLE AS dof FROM z"""


@query("T04_chi2", with_p(_chi("orders", "o_orderstatus", "o_orderpriority", False), "chi2", "* EXCLUDE (p)"))
def t04(spark, sf):
    return T.chi2(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select("test", r("statistic"), "dof", *reading())


@query("T04_chi2_yates", with_p(_chi("labels", "quality", "toxic", True), "chi2", "* EXCLUDE (p)"))
def t04b(spark, sf):
    return T.chi2(table(spark, sf, "labels"), "quality", "toxic").select("test", r("statistic"), "dof", *reading())


@query("T05_pearson", _correlation_p("SELECT 'pearson' AS test, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem"))
def t05(spark, sf):
    return T.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("test", r("statistic"), "n", *reading())


FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_MATRIX = union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)") + " AS r FROM lineitem" + (" LIMIT 1" if a == b else "")
                 for a in FOUR for b in FOUR]).replace("FROM lineitem LIMIT 1", "")


@query("T05_corr_matrix", _MATRIX)
def t05b(spark, sf):
    return T.corr_matrix(table(spark, sf, "lineitem"), FOUR).select("col_a", "col_b", r("r"))


HINGED = [(c, i) for c in FOUR for i in range(8)]
_AT = {"l_quantity": 6.0, "l_extendedprice": 9000.0, "l_discount": 0.0125, "l_tax": 0.01}


@query("T05_corr_matrix_wide", "WITH h AS (SELECT " + ", ".join(f"greatest({c} - {_AT[c] * i}, 0) AS {c}_{i}" for c, i in HINGED) + " FROM lineitem) "
       + union([f"SELECT '{a}_{i}' AS col_a, '{b}_{j}' AS col_b, " + ("1.0::DOUBLE AS r" if (a, i) == (b, j) else f"round(corr({a}_{i}, {b}_{j}), 6) AS r FROM h")
                for a, i in HINGED for b, j in HINGED]))
def t05c(spark, sf):
    # Columns cut off at eight places each: 32 columns, enough for sums by blocks.
    d = table(spark, sf, "lineitem").select(*[F.greatest(F.col(c) - F.lit(_AT[c] * i), F.lit(0.0)).alias(f"{c}_{i}") for c, i in HINGED])
    return T.corr_matrix(d).withColumn("r", r("r"))


def ranks(t, c, keys):
    """Average ranks of c with the kept columns."""
    return f"(SELECT {keys}, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {c}) AS ties FROM {t})"


@query("T06_spearman", _correlation_p("""SELECT 'spearman' AS test, corr(x, y) AS r, count(*) AS n FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x,
 rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)"""))
def t06(spark, sf):
    return T.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("test", r("statistic"), "n", *reading())


@query("T07_normality", "SELECT 'jarque_bera' AS test, round(count(*) / 6.0 * (pow(s, 2) + pow(k, 2) / 4), 4) AS statistic, count(*) AS n, 0.0::DOUBLE AS p FROM orders, (SELECT avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) AS s, avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3 AS k FROM (SELECT o_totalprice AS x, avg(o_totalprice) OVER () AS m FROM orders)) GROUP BY s, k")
def t07(spark, sf):
    return T.normality(table(spark, sf, "orders"), "o_totalprice").select("test", r("statistic", 4), "n", F.round("p_value", 6).alias("p"))


@query("T08_mannwhitney", with_p(f"""WITH r AS {ranks("(SELECT * FROM events WHERE event_type IN ('click', 'error'))", 'value', 'event_type')}, s AS (SELECT count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'error') AS b,
 sum(rk) FILTER (event_type = 'click') AS ra, sum(ties * ties - 1.0) AS tie, count(*) * 1.0 AS n FROM r), u AS (SELECT *, ra - a * (a + 1) / 2.0 AS u FROM s)
SELECT 'mann_whitney' AS test, round(u, 2)::DOUBLE AS statistic, round((abs(u - a * b / 2.0) - 0.5) / sqrt(a * b / 12.0 * (n + 1 - tie / (n * (n - 1)))), 6) AS z FROM u""", "normal", "* EXCLUDE (p)"))
def t08(spark, sf):
    return T.mannwhitney(table(spark, sf, "events"), "value", "event_type", ("click", "error")).select("test", r("statistic", 2), r("z"), *reading())


@query("T09_kruskal", with_p(f"""WITH r AS {ranks('events', 'value', 'event_type')}, g AS (SELECT event_type, count(*) AS n, sum(rk) AS s FROM r GROUP BY 1), t AS (SELECT count(*) * 1.0 AS n, sum(ties * ties - 1.0) AS tie FROM r)
SELECT 'kruskal' AS test, round((12 / (t.n * (t.n + 1)) * sum(s * s / g.n) - 3 * (t.n + 1)) / (1 - tie / (t.n * t.n * t.n - t.n)), 6) AS statistic, (count(*) - 1)::DOUBLE AS dof FROM g, t GROUP BY t.n, tie""", "chi2", "* EXCLUDE (p)"))
def t09(spark, sf):
    return T.kruskal(table(spark, sf, "events"), "value", "event_type").select("test", r("statistic"), "dof", *reading())


@query("T10_ks_two_sample", with_p("SELECT 'ks_two_sample' AS test, statistic, n0, n1 FROM (" + ks_sql(
    f"SELECT 'value' AS \"column\", value, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS side FROM events WHERE event_type IN {EV}") + ")", "kolmogorov", ROUNDED))
def t10(spark, sf):
    return T.ks_2samp(table(spark, sf, "events"), "value", "event_type", ("click", "error")).select("test", r("statistic"), "n0", "n1", *reading())


@query("A01_kmeans")
def a01(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    return A.cluster_profile(A.kmeans(d, FOUR, 3), FOUR, "returned")


@query("A02_bisecting")
def a02(spark, sf):
    return A.cluster_profile(A.bisecting(table(spark, sf, "part"), ["p_size", "p_retailprice"], 4), ["p_size", "p_retailprice"])


def _score(c, up):
    s = " + ".join(f"({c} > {c}{i})::INT" for i in range(1, 5))
    return f"1 + {s}" if up else f"5 - ({s})"


@query("A04_rfm", """WITH c AS (SELECT o_custkey, datediff('day', max(o_orderdate)::DATE, DATE '2002-01-01') AS recency, count(*) AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1),
 q AS (SELECT """ + ", ".join(f"quantile_cont({c}, {i / 5}) AS {c}{i}" for c in ("recency", "frequency", "monetary") for i in range(1, 5)) + f""" FROM c),
 s AS (SELECT o_custkey, recency, frequency, round(monetary, 2) AS monetary, {_score('recency', False)} AS r_score, {_score('frequency', True)} AS f_score, {_score('c.monetary', True).replace('c.monetary1', 'monetary1').replace('c.monetary2', 'monetary2').replace('c.monetary3', 'monetary3').replace('c.monetary4', 'monetary4')} AS m_score FROM c, q)
SELECT *, CASE """ + " ".join(f"WHEN r_score >= {a} AND (f_score + m_score) // 2 >= {b} THEN '{n}'" for n, a, b in A.SEGMENTS) + " END AS segment FROM s")
def a04(spark, sf):
    d = A.rfm(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "2002-01-01")
    return d.select("o_custkey", F.col("recency").cast("bigint").alias("recency"), "frequency", r("monetary", 2), "r_score", "f_score", "m_score", "segment")


@query("A05_tiers", """WITH q AS (SELECT quantile_cont(c_acctbal, 0.9) AS g, quantile_cont(c_acctbal, 0.6) AS s FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal >= g THEN 'gold' WHEN c_acctbal >= s THEN 'silver' ELSE 'base' END AS tier FROM customer, q""")
def a05(spark, sf):
    return A.tiers(table(spark, sf, "customer"), "c_acctbal", {"gold": 0.9, "silver": 0.6}).select("c_custkey", "tier")


@query("A05_tiers_all_missing", "SELECT c_custkey, NULL::VARCHAR AS tier FROM customer")
def a05_missing(spark, sf):
    d = table(spark, sf, "customer").withColumn("c_acctbal", F.lit(None).cast("double"))
    return A.tiers(d, "c_acctbal", {"gold": 0.9, "silver": 0.6}).select("c_custkey", "tier")


@query("A06_cohort", """WITH p AS (SELECT DISTINCT o_custkey AS k, date_trunc('year', o_orderdate) AS p FROM orders), f AS (SELECT k, min(p) AS c FROM p GROUP BY 1), z AS (SELECT c, count(*) AS cohort_size FROM f GROUP BY 1)
SELECT strftime(c, '%Y-%m-%d') AS cohort, (year(p) - year(c))::INT AS period, count(*) AS customers, any_value(cohort_size) AS cohort_size, round(count(*) * 1.0 / any_value(cohort_size), 6) AS retention
 FROM p JOIN f USING (k) JOIN z USING (c) GROUP BY c, p""")
def a06(spark, sf):
    return A.cohort(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "year")


@query("A06_cohort_month", """WITH p AS (SELECT DISTINCT o_custkey AS k, date_trunc('month', o_orderdate) AS p FROM orders), f AS (SELECT k, min(p) AS c FROM p GROUP BY 1), z AS (SELECT c, count(*) AS cohort_size FROM f GROUP BY 1)
SELECT strftime(c, '%Y-%m-%d') AS cohort, ((year(p) - year(c)) * 12 + month(p) - month(c))::INT AS period, count(*) AS customers, any_value(cohort_size) AS cohort_size, round(count(*) * 1.0 / any_value(cohort_size), 6) AS retention
 FROM p JOIN f USING (k) JOIN z USING (c) GROUP BY c, p""")
def a06b(spark, sf):
    return A.cohort(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@query("A07_isolation_forest")
def a07(spark, sf):
    return A.isolation_forest(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"], trees=20, psi=128).select("c_custkey", "anomaly_score")


@query("A09_anomalies_z", """SELECT event_id, round(abs(value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS score, abs(value - avg(value) OVER w) / stddev_samp(value) OVER w > 3 AS is_anomaly
 FROM events WINDOW w AS (PARTITION BY event_type)""")
def a09(spark, sf):
    return A.anomalies(table(spark, sf, "events"), "value", "event_type").select("event_id", r("score"), "is_anomaly")


@query("A09_anomalies_iqr", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_id, round(greatest(a - value, value - b) / (b - a), 6) AS score, greatest(a - value, value - b) / (b - a) > 1.5 AS is_anomaly FROM events JOIN q USING (event_type)""")
def a09b(spark, sf):
    return A.anomalies(table(spark, sf, "events"), "value", "event_type", "iqr").select("event_id", r("score"), "is_anomaly")


@query("A09_anomalies_robust", """WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), d AS (SELECT event_type, median(abs(value - m)) AS s FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_id, round(0.6745 * abs(value - m) / s, 6) AS score, 0.6745 * abs(value - m) / s > 3.5 AS is_anomaly FROM events JOIN m USING (event_type) JOIN d USING (event_type)""")
def a09c(spark, sf):
    return A.anomalies(table(spark, sf, "events"), "value", "event_type", "robust").select("event_id", r("score"), "is_anomaly")


@query("A09_anomalies_null_group", """WITH e AS (SELECT event_id, value, CASE WHEN event_type <> 'click' THEN event_type END AS event_type FROM events)
SELECT event_id, round(abs(value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS score, coalesce(abs(value - avg(value) OVER w) / stddev_samp(value) OVER w > 0, false) AS is_anomaly
 FROM e WINDOW w AS (PARTITION BY event_type)""")
def a09_null(spark, sf):
    d = table(spark, sf, "events").withColumn("event_type", F.when(F.col("event_type") != "click", F.col("event_type")))
    return A.anomalies(d, "value", "event_type", limit=0).select("event_id", r("score"), "is_anomaly")


@query("A10_pair_rules", """WITH d AS (SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT b) AS n FROM d),
 f AS (SELECT i, count(*) AS c FROM d, n GROUP BY i, n HAVING count(*) * 1.0 / n >= 0.005)
SELECT x.i AS antecedent, y.i AS consequent, count(*) AS pair_count, round(count(*) * 1.0 / n, 6) AS support, round(count(*) * 1.0 / fx.c, 6) AS confidence, round(count(*) * 1.0 * n / (fx.c * fy.c), 6) AS lift
 FROM d x JOIN d y ON x.b = y.b AND x.i <> y.i JOIN f fx ON fx.i = x.i JOIN f fy ON fy.i = y.i, n GROUP BY x.i, y.i, n, fx.c, fy.c HAVING count(*) * 1.0 / n >= 0.005""")
def a10(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.pair_rules(d, "l_orderkey", "p_brand", 0.005)


@query("A10_association_rules", """WITH d AS (SELECT DISTINCT o_custkey AS b, o_orderpriority AS i FROM orders), n AS (SELECT count(DISTINCT b) AS n FROM d), f AS (SELECT i, count(*) AS c FROM d GROUP BY 1)
SELECT x.i AS antecedent, y.i AS consequent, round(count(*) * 1.0 / fx.c, 6) AS confidence, round(count(*) * 1.0 * n / (fx.c * fy.c), 6) AS lift FROM d x JOIN d y ON x.b = y.b AND x.i <> y.i JOIN f fx ON fx.i = x.i JOIN f fy ON fy.i = y.i, n
 GROUP BY x.i, y.i, n, fx.c, fy.c HAVING count(*) * 1.0 / n >= 0.1 AND count(*) * 1.0 / fx.c >= 0.5""")
def a10b(spark, sf):
    rules = A.assoc_rules(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", 0.1, 0.5)
    return rules.where(F.size("antecedent") == 1).select(F.col("antecedent")[0].alias("antecedent"), F.col("consequent")[0].alias("consequent"), r("confidence"), r("lift"))


@query("A11_pca")
def a11(spark, sf):
    return A.pca(table(spark, sf, "lineitem"), FOUR, 2)[1]


@query("A11_pca_projection")
def a11b(spark, sf):
    return A.pca(table(spark, sf, "part"), ["p_size", "p_retailprice"], 2)[0].select("p_partkey", "pc1", "pc2")


def _decomp(period, add):
    h = period // 2
    even = period % 2 == 0
    full = f"(ORDER BY p ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    ma = f"(sum(o) OVER {full} - (lag(o, {h}) OVER (ORDER BY p) + lead(o, {h}) OVER (ORDER BY p)) / 2) / {period}" if even else f"avg(o) OVER {full}"
    d, s, e = ("o - t", "x - avg(x) OVER ()", "o - t - s") if add else ("o / t", "x / avg(x) OVER ()", "o / (t * s)")
    return f"""WITH a AS (SELECT date_trunc('day', ts) AS p, sum(value) AS v FROM events GROUP BY 1), c AS (SELECT unnest(generate_series(min(p), max(p), INTERVAL 1 DAY)) AS p FROM a),
 b AS (SELECT p, coalesce(v, 0) AS o, row_number() OVER (ORDER BY p) - 1 AS pos FROM c LEFT JOIN a USING (p)), m AS (SELECT *, CASE WHEN count(o) OVER {full} = {2 * h + 1} THEN {ma} END AS t FROM b),
 f AS (SELECT pos % {period} AS phase, avg({d}) AS x FROM m GROUP BY 1), z AS (SELECT phase, {s} AS s FROM f)
SELECT strftime(p, '%Y-%m-%d') AS period, round(o, 3) AS observed, round(t, 3) AS trend, round(s, 3) AS seasonal, round({e}, 3) AS residual FROM m JOIN z ON pos % {period} = phase"""


for _n, _p, _m in (("additive", 7, "additive"), ("multiplicative", 4, "multiplicative")):
    def _dec(spark, sf, p=_p, m=_m):
        d = A.decompose(table(spark, sf, "events"), "ts", "value", p, model=m)
        return d.select(F.date_format("period", "yyyy-MM-dd").alias("period"), *[r(c, 3) for c in ("observed", "trend", "seasonal", "residual")])
    query(f"A12_decompose_{_n}", _decomp(_p, _m == "additive"))(_dec)


@query("A13_breakdown", """SELECT o_orderpriority AS "group", o_orderstatus AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY o_orderpriority), 4) AS pct FROM orders GROUP BY 1, 2""")
def a13(spark, sf):
    return A.breakdown(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("A14_findings")
def a14(spark, sf):
    from ..plans.summaries import findings
    return findings({t: table(spark, sf, t) for t in ("part", "orders")})


@query("L01_select_features", union([f"SELECT '{c}' AS feature, count({c}) AS present FROM lineitem" for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax")]))
def l01(spark, sf):
    d = table(spark, sf, "lineitem")
    got = L.select_features(d, "l_extendedprice", "l_shipdate", mode="substring")
    return column_stats(d, got, lambda c: {"present": F.count(c)}).withColumnRenamed("column", "feature")


@query("L02_prepare", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def l02(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice")).alias("price"),
                                          F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"))
    return L.prepare(d, ["price"], "o_orderstatus")


@query("L03_split_random", f"SELECT o_orderkey, CASE WHEN {_FOLD.format(k='o_orderkey', n=1000000)} < 200000 THEN 'test' ELSE 'train' END AS split FROM orders")
def l03(spark, sf):
    return L.split(table(spark, sf, "orders"), "random", ["o_orderkey"]).select("o_orderkey", "split")


_U = f"SELECT doc_id, quality, {_FOLD.format(k='doc_id', n=1000000)} AS u FROM labels"


@query("L03_split_stratified", f"WITH u AS ({_U}), q AS (SELECT quality, quantile_cont(u, 0.2) AS c FROM u GROUP BY 1) SELECT doc_id, CASE WHEN u < c THEN 'test' ELSE 'train' END AS split FROM u JOIN q USING (quality)")
def l03b(spark, sf):
    return L.split(table(spark, sf, "labels"), "stratified", ["doc_id"], "quality").select("doc_id", "split")


@query("L03_split_time", "WITH c AS (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.8) AS c FROM orders) SELECT o_orderkey, CASE WHEN epoch_us(o_orderdate) > c THEN 'test' ELSE 'train' END AS split FROM orders, c")
def l03c(spark, sf):
    return L.split(table(spark, sf, "orders"), "time", ts="o_orderdate").select("o_orderkey", "split")


@query("L04_folds_random", f"SELECT o_orderkey, ({_FOLD.format(k='o_orderkey', n=1000000)} % 5)::INT AS fold FROM orders")
def l04(spark, sf):
    return L.folds(table(spark, sf, "orders"), "random", 5, ["o_orderkey"]).select("o_orderkey", "fold")


@query("L04_folds_stratified", f"WITH u AS ({_U}), q AS (SELECT quality, " + ", ".join(f"quantile_cont(u, {i / 5}) AS c{i}" for i in range(1, 5)) + " FROM u GROUP BY 1) SELECT doc_id, ("
       + " + ".join(f"(u > c{i})::INT" for i in range(1, 5)) + ")::INT AS fold FROM u JOIN q USING (quality)")
def l04b(spark, sf):
    return L.folds(table(spark, sf, "labels"), "stratified", 5, ["doc_id"], "quality").select("doc_id", "fold")


@query("L04_folds_time", "WITH q AS (SELECT " + ", ".join(f"quantile_cont(epoch_us(o_orderdate)::DOUBLE, {i / 5}) AS c{i}" for i in range(1, 5)) + " FROM orders) SELECT o_orderkey, ("
       + " + ".join(f"(epoch_us(o_orderdate) > c{i})::INT" for i in range(1, 5)) + ")::INT AS fold FROM orders, q")
def l04c(spark, sf):
    return L.folds(table(spark, sf, "orders"), "time", 5, ts="o_orderdate").select("o_orderkey", "fold")


@query("L04_folds_time_all_missing", "SELECT o_orderkey, 0 AS fold FROM orders")
def l04_missing(spark, sf):
    d = table(spark, sf, "orders").withColumn("o_orderdate", F.lit(None).cast("timestamp_ntz"))
    return L.folds(d, "time", 5, ts="o_orderdate").select("o_orderkey", "fold")


SMALL = {"boosted_trees": {"maxIter": 5, "maxDepth": 3}, "random_forest": {"numTrees": 10, "maxDepth": 5}, "extra_trees": {"numTrees": 10, "maxDepth": 5}, "linear": {"maxIter": 50}}


def _regression(spark, sf, families=None, small=True):
    # The label depends on the features, so the families can be told apart.
    d = table(spark, sf, "orders").withColumn("month", F.month("o_orderdate")).withColumn(
        "load", F.col("o_totalprice") * 0.5 + F.col("month") * 1000.0)
    return d, L.auto_train(d, "load", "regression", ["o_orderkey"], ["o_totalprice", "month", "o_orderpriority"], families=families, **({"sizes": SMALL, "n_folds": 2} if small else {}))


def _classification(spark, sf, families=None):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("words", F.size(F.split("text", " ")))
    return d, L.auto_train(d, "quality", "classification", ["doc_id"], ["n_chars", "words", "lang"], families=families, sizes=SMALL, n_folds=2)


@query("L05_train_regression")
def l05(spark, sf):
    return _regression(spark, sf)[1].metrics


@query("L05_train_forecast_model")
def l05b(spark, sf):
    d = table(spark, sf, "orders").withColumn("month", F.month("o_orderdate")).withColumn("load", F.col("o_totalprice") * 0.5)
    t = L.auto_train(d, "load", "regression", ["o_orderkey"], ["o_totalprice", "month"], ts="o_orderdate", families=["linear", "random_forest"], sizes=SMALL, n_folds=3)
    return t.scores


@query("L06_train_classification")
def l06(spark, sf):
    return _classification(spark, sf)[1].metrics


@query("L07_forecast", """WITH a AS (SELECT event_type, date_trunc('day', ts)::DATE AS p, sum(value) AS v FROM events GROUP BY 1, 2), c AS (SELECT event_type, unnest(generate_series(min(p), max(p), INTERVAL 1 DAY))::DATE AS p FROM a GROUP BY 1),
 d AS (SELECT event_type, p, coalesce(v, 0) AS y, datediff('day', min(p) OVER (PARTITION BY event_type), p)::DOUBLE AS x FROM c LEFT JOIN a USING (event_type, p)),
 f AS (SELECT event_type, regr_slope(y, x) AS s, regr_intercept(y, x) AS b, max(p) AS last, max(x) AS n FROM d GROUP BY 1), e AS (SELECT event_type, isodow(p) AS wd, avg(y - b - s * x) AS eff FROM d JOIN f USING (event_type) GROUP BY 1, 2),
 h AS (SELECT *, unnest(generate_series(1, 30)) AS h FROM f)
SELECT h.event_type, strftime(last + h::INT, '%Y-%m-%d') AS date, round(b + s * (n + h) + coalesce(eff, 0), 4) AS predicted FROM h LEFT JOIN e ON e.event_type = h.event_type AND e.wd = isodow(last + h::INT)""")
def l07(spark, sf):
    d = L.forecast(table(spark, sf, "events"), "ts", "value", 30, ["event_type"])
    return d.select("event_type", F.date_format("date", "yyyy-MM-dd").alias("date"), r("predicted", 4))


@query("L07_forecast_lags", """WITH RECURSIVE a AS (SELECT event_type, date_trunc('day', ts)::DATE AS p, sum(value) AS v FROM events GROUP BY 1, 2), c AS (SELECT event_type, unnest(generate_series(min(p), max(p), INTERVAL 1 DAY))::DATE AS p FROM a GROUP BY 1),
 d AS (SELECT event_type, p, coalesce(v, 0) AS y FROM c LEFT JOIN a USING (event_type, p)), l AS (SELECT *, lag(y, 1) OVER w AS a, lag(y, 7) OVER w AS b, row_number() OVER (PARTITION BY event_type ORDER BY p DESC) AS back FROM d WINDOW w AS (PARTITION BY event_type ORDER BY p)),
 m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM l WHERE b IS NOT NULL),
 k AS (SELECT (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ka, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS kb, ma, mb, my FROM m), q AS (SELECT ka, kb, my - ka * ma - kb * mb AS k0 FROM k),
 t AS (SELECT event_type, max(p) AS last, list(y ORDER BY p)::DOUBLE[] AS s FROM l WHERE back <= 7 GROUP BY 1),
 f AS (SELECT event_type, last, 0 AS h, s, NULL::DOUBLE AS predicted FROM t UNION ALL SELECT event_type, last, h + 1, list_append(s[2:], k0 + ka * s[7] + kb * s[1]), k0 + ka * s[7] + kb * s[1] FROM f, q WHERE h < 30)
SELECT event_type, strftime(last + h::INT, '%Y-%m-%d') AS date, round(predicted, 4) AS predicted FROM f WHERE h > 0""")
def l07_lags(spark, sf):
    d = L.forecast_lags(table(spark, sf, "events"), "ts", "value", 30, ["event_type"], (1, 7))
    return d.select("event_type", F.date_format("date", "yyyy-MM-dd").alias("date"), r("predicted", 4))


@query("S09_forecast_file", "SELECT 30::BIGINT AS \"rows\", strftime(max(ts)::DATE + 1, '%Y-%m-%d') AS first, strftime(max(ts)::DATE + 30, '%Y-%m-%d') AS last FROM events")
def s09(spark, sf):
    from ..sources.writers import export_csv
    p = export_csv(L.forecast(table(spark, sf, "events"), "ts", "value", 30), scratch(spark))
    d = spark.read.option("header", True).csv(p)
    return d.agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("L08_model_selection")
def l08(spark, sf):
    return _regression(spark, sf, small=False)[1].scores


@query("L09_regression_metrics", f"""WITH s AS {duck('scored')}, m AS (SELECT avg(abs(actual - prediction)) AS mae, 1 - sum(pow(actual - prediction, 2)) / (var_pop(actual) * count(*)) AS r2, avg(abs((actual - prediction) / actual)) * 100 AS mape FROM s)
SELECT 'mae' AS metric, round(mae, 4) AS value FROM m UNION ALL SELECT 'r2', round(r2, 4) FROM m UNION ALL SELECT 'mape', round(mape, 4) FROM m""")
def l09(spark, sf):
    return L.regression_metrics(derived(spark, sf, "scored"), "actual").select("metric", r("value", 4))


@query("L10_classification_metrics", f"""WITH s AS {duck('scored')}, k AS (SELECT label AS k, count(*) AS t FROM s GROUP BY 1), g AS (SELECT guess AS k, count(*) AS g FROM s GROUP BY 1), h AS (SELECT label AS k, count(*) AS h FROM s WHERE label = guess GROUP BY 1),
 j AS (SELECT t, coalesce(g, 0) AS g, coalesce(h, 0) AS h FROM k LEFT JOIN g USING (k) LEFT JOIN h USING (k))
SELECT 'accuracy' AS metric, round(sum(h) * 1.0 / sum(t), 6) AS value FROM j UNION ALL SELECT 'f1_weighted', round(sum(t * 2.0 * h / (t + g)) / sum(t), 6) FROM j""")
def l10(spark, sf):
    return L.classification_metrics(derived(spark, sf, "scored"), "label", "guess").select("metric", r("value"))


@query("L10_confusion", f"SELECT label, guess AS prediction, count(*) AS n FROM {duck('scored')} GROUP BY 1, 2")
def l10b(spark, sf):
    return L.confusion(derived(spark, sf, "scored"), "label", "guess")


@query("L11_importance")
def l11(spark, sf):
    return L.importance(_regression(spark, sf, ["random_forest"])[1], spark)


@query("L12_model_report")
def l12(spark, sf):
    p = scratch(spark)
    L.save_model(_classification(spark, sf, ["random_forest"])[1], p)
    return L.model_report(spark, p)


@query("L13_predict")
def l13(spark, sf):
    p = scratch(spark)
    d, t = _classification(spark, sf, ["linear"])
    L.save_model(t, p)
    model, meta = L.load_model(spark, p)
    every = table(spark, sf, "documents").withColumn("words", F.size(F.split("text", " ")))
    return L.predict(every, model, meta["features"], "predicted", meta["labels"]).select("doc_id", "predicted")


@query("L14_class_weights", "SELECT quality AS class, count(*) AS n, round((SELECT count(*) FROM labels) * 1.0 / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY 1")
def l14(spark, sf):
    return L.class_weights(table(spark, sf, "labels"), "quality")


@query("L14_oversample", f"""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), f AS (SELECT quality, (SELECT max(n) FROM c) * 1.0 / n AS f FROM c),
 k AS (SELECT quality, floor(f) + ({_FOLD.format(k='doc_id', n=1000000)} / 1e6 < f - floor(f))::INT AS copies FROM labels JOIN f USING (quality)) SELECT quality, sum(copies)::BIGINT AS n FROM k GROUP BY 1""")
def l14b(spark, sf):
    return L.oversample(table(spark, sf, "labels"), "quality", ["doc_id"]).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("L15_train_per_group", """WITH d AS (SELECT event_type, date_trunc('day', ts) AS p, count(*) AS y FROM events GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p) - 1 AS x FROM d)
SELECT event_type, round(regr_slope(y, x), 6) AS slope FROM x GROUP BY 1""")
def l15(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("p")).agg(F.count(F.lit(1)).alias("y"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        s = pdf.sort_values("p")
        return pd.DataFrame({"event_type": [s["event_type"].iloc[0]], "slope": [float(np.polyfit(range(len(s)), s["y"], 1)[0])]})
    return L.train_per_group(daily, ["event_type"], fit, "event_type string, slope double").select("event_type", r("slope"))


@query("V01_line_data", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS period, round(sum(o_totalprice), 2) AS value, count(*) AS n FROM orders GROUP BY 1")
def v01(spark, sf):
    return V.line_data(table(spark, sf, "orders"), "o_orderdate", "o_totalprice").select(F.date_format("period", "yyyy-MM").alias("period"), r("value", 2), "n")


@query("V02_histogram_data", """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events), c AS (SELECT least(floor((value - lo) / w), 19)::BIGINT AS bin, count(*) AS n FROM events, b GROUP BY 1),
 g AS (SELECT unnest(range(20))::BIGINT AS bin) SELECT bin, round(lo + w * bin, 6) AS lo, round(lo + w * (bin + 1), 6) AS hi, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (bin), b""")
def v02(spark, sf):
    return V.histogram_data(table(spark, sf, "events"), "value").select("bin", r("lo"), r("hi"), "n")


@query("V03_heatmap_data", _MATRIX)
def v03(spark, sf):
    return V.heatmap_data(table(spark, sf, "lineitem"), FOUR).select("col_a", "col_b", r("r"))


@query("V04_bar_data", "SELECT p_type AS category, round(avg(p_retailprice), 4) AS value FROM part GROUP BY 1")
def v04(spark, sf):
    return V.bar_data(table(spark, sf, "part"), "p_type", "p_retailprice").select("category", r("value", 4))


@query("V05_box_data", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS m, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type AS category, min(value) AS min, round(any_value(q1), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(q3), 6) AS q3, max(value) AS max,
 count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM events JOIN q USING (event_type) GROUP BY 1""")
def v05(spark, sf):
    return V.box_data(table(spark, sf, "events"), "event_type", "value").select("category", "min", r("q1"), r("median"), r("q3"), "max", "outliers")


@query("V06_scatter_data", "SELECT o_orderkey, o_custkey AS x, o_totalprice AS y FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 200")
def v06(spark, sf):
    return V.scatter_data(table(spark, sf, "orders"), "o_custkey", "o_totalprice", 200, ["o_orderkey"])


@query("U01_apply_transform", """SELECT 'good' AS run, (SELECT count(*) FROM part) AS n, 1::BIGINT AS added UNION ALL SELECT 'bad', (SELECT count(*) FROM part), 0 UNION ALL SELECT 'lossy', (SELECT count(*) FROM part), 0""")
def u01(spark, sf):
    d = table(spark, sf, "part")
    runs = {"good": lambda x: x.withColumn("vat", F.col("p_retailprice") * 1.2), "bad": lambda x: x.withColumn("v", F.col("absent")), "lossy": lambda x: x.where("p_size > 10")}
    parts = []
    for name, fn in runs.items():
        out, audit = U.apply_transform(d, fn)
        n = out.agg(F.count(F.lit(1)).alias("n"))
        parts.append(audit.agg(F.count_if(F.col("status") == "added").alias("added")).crossJoin(n).select(F.lit(name).alias("run"), "n", "added"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("U02_scalar_function", "SELECT p_partkey, round(p_retailprice * 1.19 + p_size, 4) AS gross FROM part")
def u02(spark, sf):
    def gross(p: pd.Series, s: pd.Series) -> pd.Series:
        return p * 1.19 + s
    U.register_udf(spark, "gross_price", gross, "double")
    return spark.sql("SELECT p_partkey, round(gross_price(p_retailprice, p_size), 4) AS gross FROM {p}", p=table(spark, sf, "part"))


@query("U03_aggregate_function", "SELECT p_brand, round(max(p_retailprice) - min(p_retailprice), 4) AS spread FROM part GROUP BY 1")
def u03(spark, sf):
    d = U.aggregate(table(spark, sf, "part"), ["p_brand"], ["p_retailprice"], lambda v: (v["p_retailprice"].min(), v["p_retailprice"].max()),
                    lambda s: (s["lo"].min(), s["hi"].max()), lambda s: s["hi"] - s["lo"], "lo double, hi double", "double", "spread")
    return d.select("p_brand", r("spread", 4))


@query("U03_aggregate_in_sql", "SELECT p_brand, round(max(p_retailprice) - min(p_retailprice), 4) AS spread FROM part GROUP BY 1")
def u03_sql(spark, sf):
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())
    U.register_udaf(spark, "value_spread", spread, "double")
    return spark.sql("SELECT p_brand, round(value_spread(p_retailprice), 4) AS spread FROM {p} GROUP BY p_brand", p=table(spark, sf, "part"))


class WordRows:
    def eval(self, text: str):
        for i, w in enumerate(text.split(" ")):
            yield i, w


@query("U04_table_function", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, (generate_subscripts(string_split(p_name, ' '), 1) - 1)::INT AS pos FROM part")
def u04(spark, sf):
    U.register_udtf(spark, "word_rows", WordRows, "pos int, word string")
    return spark.sql("SELECT p_partkey, w.word, w.pos FROM {p}, LATERAL word_rows(p_name) w", p=table(spark, sf, "part"))



def _points(spark, sf):
    return table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("user_id").cast("double").alias("u"),
                                             F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("value"))


@query("C05_impute_knn")
def c05(spark, sf):
    from ..operators.neighbours import impute_knn
    return impute_knn(_points(spark, sf), "value", ["t", "u"], 5).select("event_id", r("value"))


@query("A03_dbscan")
def a03(spark, sf):
    from ..operators.neighbours import dbscan
    d = dbscan(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], 0.1, 8)
    return d.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("A08_local_outlier_factor")
def a08(spark, sf):
    from ..operators.neighbours import lof
    return lof(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], 10).select("c_custkey", r("lof", 4))
