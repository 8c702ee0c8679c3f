"""Planted defects with exact counts, the corrected behaviours, and properties of the cleaning transforms."""

import pytest
from pyspark.sql import functions as F

from tallygrid.functions.kinds import name_matches
from tallygrid.operators import clean, labels, profile, quality, userfn
from tallygrid.operators.temporal import ks_drift, time_split


@pytest.fixture(scope="module")
def sales(spark):
    """200 sales with the planted defects of the sample file."""
    rows = []
    for i in range(200):
        rows.append([f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}", f"P{i % 10}", f"Product {i % 10}", ["Electronics", "Furniture", "Stationery"][i % 3],
                     float(1 + i % 20), 10.0 + i % 10, 5.0 + i, f"C{i % 50:03d}", ["North", "South", "East", "West", "Central"][i % 5], i % 7])
    rows[30][0], rows[18][2], rows[5][4], rows[25][6], rows[12][8], rows[42][9] = "invalid-date", None, None, -50.0, "  North ", 150
    rows[51] = list(rows[50])
    return spark.createDataFrame(rows, "date string, product_id string, product_name string, category string, quantity double, unit_price double, "
                                       "total_revenue double, customer_id string, region string, discount_pct int").repartition(5)


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_profile_of_sales(sales):
    p = by_column(profile.profile(sales))
    assert {r["duplicate_rows"] for r in p.values()} == {1} and {r["rows"] for r in p.values()} == {200}
    assert p["product_name"]["null_pct"] == 0.5 and p["quantity"]["null_pct"] == 0.5
    assert p["region"]["nunique"] == 6 and p["date"]["datetime_name"] and not p["category"]["datetime_name"]


def test_sales_findings(sales):
    assert by_column(profile.datetime_report(sales))["date"]["parse_pct"] == 99.5
    v = [r.asDict() for r in profile.category_variants(sales, "region").collect()]
    assert {r["spelling"] for r in v} == {"North", "  North "}
    hits = {(r["column"], r["rule"]): r["rows_hit"] for r in quality.validate_ranges(sales).collect()}
    assert hits[("total_revenue", "non_negative_financial")] == 1 and hits[("discount_pct", "percentage_0_to_100")] == 1


def test_pipe_packed_cells_are_found(spark):
    d = spark.createDataFrame([("a|b",), ("c|d",), ("e|f",)], "tags string")
    assert [tuple(r) for r in quality.packed_columns(d).collect()] == [("tags", "|", 2.0)]


def test_units_mixed_temperature(spark):
    d = spark.createDataFrame([(f"{i}°C" if i % 2 else f"{i} F",) for i in range(30)], "t string")
    assert {r["unit"] for r in quality.unit_issues(d).collect()} == {"c", "f"}
    one = spark.createDataFrame([(f"{i} kg",) for i in range(30)], "t string")
    assert quality.unit_issues(one).count() == 0


def test_financial_identity_depends_on_the_data(spark):
    good = spark.range(1000).selectExpr("id * 2D as revenue", "id * 1D as cost", "id * 1D as profit")
    assert quality.financial_violations(good).first()["violations"] == 0
    assert quality.financial_violations(good.withColumn("profit", F.when(
        F.col("cost") == 7, 1e6).otherwise(F.col("profit")))).first()["violations"] == 1


def test_name_rules():
    assert not name_matches("percentage", ["age"]) and name_matches("percentage", ["age"], "substring")
    assert name_matches("customerAge", ["age"]) and not name_matches("width", ["id"]) and name_matches("order_id", ["id"])


def test_numbers_in_text(spark):
    d = spark.createDataFrame([("5d",), ("5f",), ("1e3",), (" 7 ",), ("-.5",), ("0x1A",), ("NaN",), ("",), (None,)], "x string")
    got = [r[0] for r in d.select(profile.text_to_number(F.col("x"))).collect()]
    assert got == [None, None, 1000.0, 7.0, -0.5, None, None, None, None]


def test_constant_columns_do_not_break_reports(spark):
    d = spark.range(50).selectExpr("cast(id as double) as x", "3.0D as c", "cast(null as double) as e")
    f = by_column(profile.distributions(d))
    assert f["c"]["skewness"] == 0.0 and f["c"]["kurtosis"] == 0.0 and "e" not in f
    assert profile.correlated_pairs(d).count() == 0
    assert by_column(quality.scaling_report(d)).keys() == {"x", "c"}


def test_nan_is_missing_in_reports(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    r = profile.column_statistics(d, "t").first()
    assert (r["missing"], r["mean"], r["max"], r["median"]) == (1, 2.0, 3.0, 2.0)


def test_scan_pii_masks(spark):
    d = spark.createDataFrame([("bob@example.com", "4111 1111 1111 1111", "Ann", "10.0.0.1")] * 3, "contact string, pay string, full_name string, host string")
    got = {(r["column"], r["pii_type"]): r["masked_sample"] for r in quality.scan_pii(d).collect()}
    assert got[("contact", "email")] == "bo***om" and got[("full_name", "full_name")] is None
    assert ("pay", "credit_card") in got and ("host", "ip_address") in got


def test_encoding_and_quality_score(spark):
    d = spark.createDataFrame([("cafÃ©",), ("a​b",), ("ok",), ("\x00",)], "t string")
    r = quality.encoding_issues(d).first()
    assert (r["mojibake_rows"], r["non_ascii_rows"], r["nul_rows"], r["zero_width_rows"]) == (1, 2, 1, 1)
    q = quality.quality_score(spark.createDataFrame([(1, None), (2, "N/A"), (3, "x"), (3, "x")], "a int, b string")).first()
    assert q["score"] == pytest.approx((1 + 0.5) / 2 - 0.25)


def test_drift_and_split_follow_time_not_row_order(spark):
    d = spark.range(4000).selectExpr("timestamp_seconds(id * 3600) as ts", "if(id < 2000, id % 10, id % 10 + 8) * 1D as moved", "(id * 7919) % 100 * 1D as same")
    d = d.orderBy(F.xxhash64("ts"))
    r = by_column(ks_drift(d, "ts"))
    assert r["moved"]["drift"] and not r["same"]["drift"]
    s = time_split(d, "ts").groupBy("split").agg(F.max("ts").alias("hi"), F.min("ts").alias("lo"), F.count("*").alias("n"))
    s = {x["split"]: x for x in s.collect()}
    assert s["train"]["hi"] < s["test"]["lo"] and s["train"]["n"] == 3200


def test_label_quality(spark):
    d = spark.createDataFrame([("yes",)] * 98 + [("no",), (None,)], "y string")
    r = labels.label_quality(d, "y").first()
    assert r["near_constant_label"] and r["null_labels"] == 1 and r["n_classes"] == 2


KEEPS_ROWS = {
    "nullify": lambda d: clean.nullify(d), "impute": lambda d: clean.impute(d, {"quantity": "median", "product_name": "mode"}),
    "group": lambda d: clean.impute_group(d, "quantity", "category"), "ffill": lambda d: clean.ffill(d, ["quantity"], ["unit_price", "product_id"], ["category"]),
    "flags": lambda d: clean.add_null_flags(d, ["quantity"]), "dates": lambda d: clean.parse_dates(d, "date"), "clip": lambda d: clean.clip(d, "total_revenue"),
    "log": lambda d: clean.log1p(d, "unit_price"), "yj": lambda d: clean.yeo_johnson(d, "total_revenue"), "flag": lambda d: clean.flag(d, "total_revenue", "outlier"),
    "text": lambda d: clean.standardize_text(d, ["region"]), "rare": lambda d: clean.group_rare(d, "region", 0.1), "html": lambda d: clean.clean_text(d, "region"),
    "encoding": lambda d: clean.fix_encoding(d, "region"), "snake": lambda d: clean.snake_case(d), "cast": lambda d: clean.cast_columns(d, {"date": "date"}),
    "mask": lambda d: clean.mask_pii(d, {"customer_id": "hash"}), "drop": lambda d: clean.drop_columns(d, ["region"]),
    "map": lambda d: clean.apply_mapping(d, "region", d.sparkSession.createDataFrame([("North", "N")], "value string, canonical string")),
    "scale": lambda d: clean.apply_scaler(d, clean.fit_scaler(d, ["unit_price"]), ["unit_price"]),
}


@pytest.mark.parametrize("name", KEEPS_ROWS)
def test_no_transform_drops_rows(sales, name):
    assert KEEPS_ROWS[name](sales).count() == 200


@pytest.mark.parametrize("fn", [lambda d: clean.nullify(d), lambda d: clean.dedup(d), lambda d: clean.standardize_text(d, ["region"]), lambda d: clean.snake_case(d),
                                lambda d: clean.fix_encoding(d, "region")])
def test_idempotent(sales, fn):
    once = fn(sales)
    assert sorted(map(str, once.collect())) == sorted(map(str, fn(once).collect()))


def test_dedup_removes_only_the_copy(sales):
    assert clean.dedup(sales).count() == 199


def test_snake_names():
    assert clean.snake_names(["Order ID", "orderId", "order_id", "2x", "€", "A"]) == ["order_id", "order_id_2", "order_id_3", "c_2x", "column", "a"]


def test_repair_of_text(spark):
    d = spark.createDataFrame([("â‚¬ 5 â€œxâ€\x9d",), ("cafÃ©",), ("café",), ("Â",), (r"é 😀 \ud83d",), (None,)], "t string")
    assert [r[0] for r in clean.fix_encoding(d, "t").collect()] == ["€ 5 “x”", "café", "café", "Â", r"é 😀 \ud83d", None]


def test_masks(spark):
    d = spark.createDataFrame([("+1 (555) 123-4567", "4111-2222-3333-4444", "192.168.1.77", "2000-01-01", "12 Main St, Springfield, IL")],
                              "p string, c string, i string, b string, a string")
    r = clean.mask_pii(d, {"p": "digits", "c": "card", "i": "ip", "b": "age_bucket", "a": "city"}, as_of="2024-06-01").first()
    assert tuple(r) == ("+1 (555) ***-****", "4111********4444", "192.168.1.0/24", "18-35", "Springfield, IL")


def test_units_and_amounts(spark):
    d = spark.createDataFrame([("100 lbs", "70F", "2 miles", "$1.5M"), ("5", "300 K", "500 m", "12%"), ("x", "20°C", "3ft", "n/a")], "w string, t string, d string, a string")
    d = clean.convert_units(clean.convert_units(clean.convert_units(d, "w", "weight", "kg"), "t", "temperature", "c"), "d", "distance", "km")
    rows = clean.parse_amount(d, "a", "amount").collect()
    assert [r["kg"] for r in rows] == [pytest.approx(45.36), 5.0, None]
    assert [round(r["c"], 3) for r in rows] == [21.111, 26.85, 20.0]
    assert [r["km"] for r in rows] == [pytest.approx(3.2186), 0.5, pytest.approx(0.0009144)]
    assert [r["amount"] for r in rows] == [1.5e6, pytest.approx(0.12), None]


def test_yeo_johnson_grid_finds_the_normal_shape(spark):
    d = spark.range(5000).select((F.exp(F.randn(5)) - 1).alias("x"))
    assert clean.yeo_johnson_lambda(d, "x") <= 0.0  # a log-normal needs a log-like transform


def test_user_transform_is_kept_out_when_it_loses_rows(sales):
    out, audit = userfn.apply_transform(sales, lambda d: d.where("quantity > 3"))
    assert out.count() == 200
    out, audit = userfn.apply_transform(sales, lambda d: d.withColumn("n", F.lit(1)))
    assert {r["column"]: r["status"] for r in audit.collect()}["n"] == "added"


def test_vif_known_value_and_origin_variant(spark):
    d = spark.range(200).selectExpr("cast(id as double) as a", "cast((id * 37) % 101 as double) as b", "id * 13 as id2").withColumn("c", F.col("a") + F.col("id2") % 7).drop("id2")
    v = by_column(quality.vif(d))
    assert v["a"]["vif"] > 100 and v["b"]["vif"] < 5
    assert by_column(quality.vif(d.withColumn("d", F.col("a") * 2), ["a", "d"]))["a"]["vif"] == float("inf")
