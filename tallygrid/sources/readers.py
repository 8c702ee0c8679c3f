"""File scans: delimited text, Parquet, JSON; many files at once; SQL registration."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import quoted
from .quoted import read_quoted

# --- Fixed values: separators and encodings in the order they are tried --------------------
SEPARATORS = [",", ";", "\t", "|"]
ENCODINGS = ["utf-8", "latin-1", "iso-8859-1", "cp1252"]
SNIFF_CHARACTERS = 4096
# -------------------------------------------------------------------------------------------


def nan_as_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN replaced by NULL."""
    fix = {f.name: F.nanvl(quoted(f.name), F.lit(None)).cast(f.dataType) for f in df.schema.fields
           if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[fix[c].alias(c) if c in fix else quoted(c) for c in df.columns]) if fix else df


def _look(spark: SparkSession, path: str) -> tuple[str, str, bool]:
    """(separator, encoding, whether any line has a quote)."""
    lines = spark.read.text(path)
    seen = lines.agg(F.min(F.is_valid_utf8("value").cast("int")).alias("ok"), F.max(F.contains("value", F.lit('"')).cast("int")).alias("quotes")).first()
    encoding = "iso-8859-1" if seen["ok"] == 0 else "utf-8"
    head = lines.select(F.substring(F.col("value").cast("binary"), 1, SNIFF_CHARACTERS * 4).alias("b")).limit(200).collect()
    text = b"\n".join(bytes(r["b"]) for r in head).decode(encoding, "ignore")[:SNIFF_CHARACTERS]
    best = SEPARATORS[0]
    for s in SEPARATORS[1:]:
        if text.count(s) > text.count(best):
            best = s
    return best, encoding, bool(seen["quotes"])


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(separator, encoding): the separator from the head of one file, the encoding from every line of the path.

    The text source passes bytes through untouched; one line that is not valid
    UTF-8 makes the whole path Latin-1, which any bytes are.
    """
    return _look(spark, path)[:2]


def read_csv_smart(spark: SparkSession, path: str, infer: bool = True, schema=None, multi_line: bool = True) -> DataFrame:
    """Delimited text with a header; separator and encoding are found from the data.

    Quotes inside a quoted value are doubled. ``multi_line`` lets a quoted value
    run over lines: files are then cut into records by the parity of their quotes,
    many tasks a file. Only where a quote stands inside an unquoted value is a file
    left to one task of Spark's multi-line reader. Without any quote lines are
    records. ``infer`` reads the data once more; pass a schema for large inputs.
    """
    sep, encoding, quotes = _look(spark, path)
    if multi_line and quotes:
        df = read_quoted(spark, path, sep, encoding, infer, schema)
        if df is not None:
            return nan_as_null(df)
    r = spark.read.options(header=True, sep=sep, encoding=encoding, quote='"', escape='"', multiLine=multi_line and quotes)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", infer)
    return nan_as_null(r.csv(path))


def read_parquet(spark: SparkSession, path: str, nan_null: bool = False) -> DataFrame:
    """Parquet scan. ``nan_null`` reads NaN as missing, at the price of filter pushdown on those columns."""
    df = spark.read.parquet(path)
    return nan_as_null(df) if nan_null else df


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested records as top-level columns with dotted names; arrays stay arrays."""
    def walk(schema, path):
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, here)
            else:
                c = quoted(here[0])
                for p in here[1:]:
                    c = c.getField(p)
                yield c.alias(sep.join(here))
    return df.select(*walk(df.schema, []))


def read_json_flat(spark: SparkSession, path: str, lines: bool = False, schema=None) -> DataFrame:
    """JSON records, nested objects flattened.

    One document per file (an array of records or one object), or one record
    per line with ``lines``, which is the splittable form for large inputs.
    """
    r = spark.read.option("multiLine", not lines).option("mode", "FAILFAST")
    if schema is not None:
        r = r.schema(schema)
    return nan_as_null(flatten(r.json(path)))


def table_name(file_name: str) -> str:
    """SQL name of a file: stem without extension, every other character an underscore."""
    stem = re.sub(r"\.(csv|parquet|json|pkl)$", "", os.path.basename(file_name.rstrip("/")), flags=re.I)
    return re.sub(r"\W|^(?=\d)", "_", stem)


def load_all(spark: SparkSession, paths: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Reader by extension for each path; a path that fails is reported and does not stop the others."""
    tables, errors = {}, []
    for p in paths:
        ext = os.path.splitext(p.rstrip("/"))[1].lower()
        try:
            if ext == ".parquet":
                df = read_parquet(spark, p)
            elif ext == ".json":
                df = read_json_flat(spark, p)
            else:
                df = read_csv_smart(spark, p)
            tables[table_name(p)] = df
        except Exception as e:  # any reader failure belongs in the report
            errors.append((p, str(e).splitlines()[0]))
    return tables, spark.createDataFrame(errors, "path string, error string")


def register(tables: dict[str, DataFrame]) -> list[str]:
    """Temp views under sanitised names; returns the names."""
    names = []
    for n, df in tables.items():
        names.append(table_name(n))
        df.createOrReplaceTempView(names[-1])
    return names
