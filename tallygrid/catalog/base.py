"""Registry of named queries over the given tables, each with the SQL another engine can check it with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]

# Defects are derived from the given tables by expressions both engines evaluate alike.
DERIVED = {
    "messy": """
SELECT c_custkey AS customer_id,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance,
  CASE WHEN c_custkey % 11 = 0 THEN 'N/A' WHEN c_custkey % 13 = 0 THEN '  ' || lower(c_mktsegment)
       WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE CAST(c_nationkey AS STRING) END AS code_text,
  'fixed' AS source_name,
  CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE c_custkey % 150 END AS age,
  'user' || CAST(c_custkey AS STRING) || '@example.com' AS email,
  CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN '2024-01-15' WHEN c_custkey % 4 = 1 THEN '16/02/2023'
       WHEN c_custkey % 4 = 2 THEN '03-17-2022' ELSE 'soon' END AS joined_date,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey + 1 AS STRING) || ' kg' WHEN c_custkey % 3 = 1
       THEN CAST(c_nationkey + 1 AS STRING) || ' lbs' ELSE CAST(c_nationkey + 1 AS STRING) || ' oz' END AS weight_text,
  CASE WHEN c_custkey % 4 = 0 THEN '$1,' || CAST(100 + c_nationkey AS STRING) || '.50' WHEN c_custkey % 4 = 1
       THEN CAST(c_nationkey AS STRING) || 'k' WHEN c_custkey % 4 = 2 THEN CAST(c_nationkey AS STRING) || '%' ELSE 'n.a.' END AS amount_text,
  CASE WHEN c_custkey % 2 = 0 THEN 'red, blue' ELSE 'blue, green' END AS colours,
  CASE WHEN c_custkey % 5 = 0 THEN '<b>' || c_name || '</b>' || chr(10) || 'new   line' WHEN c_custkey % 5 = 1 THEN c_name || chr(9) || chr(7)
       ELSE '  ' || c_name || ' ' END AS note,
  CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE c_nationkey END AS visits
FROM {customer}""",
    "doubled": """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM {customer}
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM {customer} WHERE c_nationkey < 5""",
    "deals": """
SELECT o_orderkey, o_orderdate AS start_date,
  CASE WHEN o_orderkey % 20 = 0 THEN o_orderdate - INTERVAL '3' DAY ELSE o_orderdate + INTERVAL '5' DAY END AS end_date,
  o_totalprice AS revenue, round(o_totalprice * 0.6, 2) AS cost,
  CASE WHEN o_orderkey % 50 = 0 THEN 1.0 ELSE o_totalprice - round(o_totalprice * 0.6, 2) END AS profit,
  CASE WHEN o_orderkey % 40 = 0 THEN 90 ELSE 24 END AS age, DATE '2000-06-15' AS birth_date,
  o_totalprice * 1.001 AS score_price, o_orderstatus, o_orderstatus AS status_copy, o_orderpriority
FROM {orders}""",
    "sparse_items": """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.08 THEN l_discount ELSE 0 END AS big_discount,
  CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS is_bulk, CASE WHEN l_tax > 0.07 THEN l_tax ELSE NULL END AS high_tax,
  l_extendedprice, l_returnflag
FROM {lineitem}""",
    "readings": """
SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value, event_type FROM {events}""",
    "scored": """
SELECT l_orderkey, l_linenumber, l_extendedprice AS actual, l_extendedprice * (0.95 + l_discount) AS prediction,
  l_returnflag AS label, CASE WHEN l_quantity > 40 THEN 'A' ELSE l_returnflag END AS guess FROM {lineitem}""",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A frame with defects derived from the given tables."""
    text = DERIVED[name]
    return spark.sql(text, **{t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in text})


def duck(name: str) -> str:
    """The derived frame as a subquery of the checking SQL."""
    return "(" + DERIVED[name].format(**{t: t for t in TABLES}) + ")"


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared folder, for queries that write and read back."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check, absent where SQL cannot express it."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _simpson(f: str, top: str, steps: int = 4000) -> str:
    """Integral of ``f`` (of x) from 0 to ``top`` in SQL."""
    w = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    x = f"(i * ({top}) / {steps}.0)"
    return f"(({top}) / {3 * steps}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda i: {w} * {f.replace('@', x)})))"


_T = "exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()) * pow(1 + @ * @ / dof, -(dof + 1) / 2)"
_TAILS = {
    "t": "1 - 2 * " + _simpson(_T, "least(abs(statistic), 40.0)"),
    "normal": "1 - 2 * " + _simpson("exp(-@ * @ / 2) / sqrt(2 * pi())", "least(abs(z), 12.0)"),
    # The square root of the statistic is the variable, so that the density is smooth at 0.
    "chi2": "1 - " + _simpson("(CASE WHEN @ = 0 AND dof > 1 THEN 0 ELSE 2 * pow(@, dof - 1) * exp(-@ * @ / 2 - dof / 2 * ln(2) - lgamma(dof / 2)) END)", "least(sqrt(statistic), 40.0)"),
    "f": "1 - exp(lgamma((df_between + df_within) / 2) - lgamma(df_between / 2) - lgamma(df_within / 2)) * " + _simpson(
        "(pow(@, df_between / 2 - 1) * pow(1 - @, df_within / 2 - 1))", "df_between * statistic / (df_between * statistic + df_within)"),
    "kolmogorov": "2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * statistic * statistic * n0 * n1 / (n0 + n1))))",
}


def with_p(sql: str, tail: str, keep: str = "*", flag: str = "significant") -> str:
    """The statistic's SQL with its tail probability, by quadrature or series, to 4 digits, and the reading at 0.05."""
    p = f"greatest(0, least(1, {_TAILS[tail]}))"
    return f"SELECT {keep}, round(p, 4) AS p_value, p < 0.05 AS {flag} FROM (SELECT *, {p} AS p FROM ({sql}))"
