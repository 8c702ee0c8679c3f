"""Column kinds, column-name rules and the fixed word lists and patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# --- Fixed values: strings read as missing -------------------------------------------------
FAKE_NULLS = ["?", "N/A", "n/a", "NA", "None", "null", "nan", "NaN", "", " ", "-999", "-9999", "9999", "#N/A", "#NA",
              "#NULL!", "(blank)", "missing", "unknown", "undefined", "nil", "NULL"]
# --- Fixed values: numbers that often stand for "missing" ----------------------------------
SENTINELS = [-1, -999, -9999, 9999, 999, 0]
# --- Fixed values: placeholder texts -------------------------------------------------------
BOILERPLATE = ["N/A", "TBD", "TBC", "n/a", "none", "null", "placeholder", "test", "lorem ipsum", "todo", "fill in",
               "example"]
# --- Fixed values: words in column names ---------------------------------------------------
NAME_DATETIME = ["date", "time", "dt", "timestamp", "created", "updated", "at", "on"]
NAME_DATETIME_WIDE = ["date", "time", "dt", "timestamp", "created", "updated", "birth", "expir", "start", "end"]
NAME_DATETIME_SUMMARY = ["date", "time", "created", "updated", "timestamp"]
NAME_POSITIVE = ["age", "price", "cost", "amount", "salary", "count", "quantity", "weight", "height", "distance",
                 "duration", "size"]
NAME_POSITIVE_OUTLIER = ["age", "price", "amount", "count", "weight", "height"]
NAME_KEY = ["id", "key", "uuid", "code"]
NAME_KEY_DUPLICATE = ["id", "key", "uuid", "email"]
NAME_NOT_FEATURE = ["id", "uuid", "key", "index"]
NAME_START = ["start", "begin", "from", "open", "created", "birth"]
NAME_END = ["end", "finish", "to", "close", "death", "expir"]
NAME_REVENUE = ["revenue", "sales", "income", "gross"]
NAME_COST = ["cost", "expense", "cogs"]
NAME_PROFIT = ["profit", "margin", "net"]
NAME_BIRTH = ["birth", "dob", "born"]
NAME_LEAK = ["target", "label", "outcome", "result", "prediction", "score", "flag", "churn", "converted", "purchased",
             "clicked", "approved", "defaulted", "fraud", "is_"]
NAME_LEAK_ID = ["_id", "id_", "uuid", "key"]
NAME_RANGE = {
    "age": ["age", "tenure", "years", "experience"],
    "money": ["price", "cost", "amount", "salary", "revenue", "income", "fee", "payment"],
    "share": ["pct", "percent", "rate", "ratio", "score"],
    "percent": ["pct", "percent"],
    "count": ["count", "quantity", "num_", "n_", "cnt"],
}
NAME_PII = {
    "full_name": ["name", "fullname", "full_name", "customer_name", "person"],
    "address": ["address", "street", "city", "state", "postcode", "zipcode", "location"],
    "dob": ["birth", "dob", "born", "birthday"],
    "national_id": ["ssn", "national_id", "passport", "license", "nid", "aadhaar", "pan"],
    "financial": ["account", "routing", "iban", "card_number", "cvv", "balance"],
}
# --- Fixed values: value patterns (searched unless anchored; the syntax is shared by Java and RE2) ---
TEXT_PATTERNS = {
    "email": r"^[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?[\d\s\-().]{7,20}$",
    "url": r"^https?://",
    "currency": r"^[$€£¥₹]?\s*[\d,.]+\s*[kKmMbB%]?$",
    "numeric_string": r"^-?\d+\.?\d*$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}",
    "date_slash": r"^\d{2}/\d{2}/\d{4}",
    "date_dmy": r"^\d{2}-[A-Za-z]{3}-\d{4}",
    "date_long": r"^[A-Za-z]+ \d{1,2},? \d{4}",
}
TEXT_SHARES = {"email": 0.5, "phone": 0.5, "url": 0.3, "json": 0.3, "currency": 0.5, "numeric_string": 0.7,
               "date": 0.4}
PII_PATTERNS = {
    "email": r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}",
    "phone": r"\+?[\d\s\-().]{10,15}",
    "ssn_us": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b(?:\d[ -]?){13,16}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "zip_code_us": r"\b\d{5}(?:[-\s]\d{4})?\b",
    "url": r"https?://\S+",
    "passport": r"\b[A-Z]{1,2}\d{6,9}\b",
}
QUALITY_PATTERNS = {
    "html": r"<[^>]+>",
    "escapes": r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}",
    "control": r"[\x00-\x08\x0b\x0c\x0e-\x1f]",
    "multiline": r"\n|\r",
}
ENCODING_PATTERNS = {
    "mojibake": "â€|Ã|â‚¬|Â",
    "non_ascii": r"[^\x00-\x7f]",
    "nul": r"\x00",
    "direction": "[‎‏﻿‪-‮]",
    "zero_width": "[​‌‍⁠]",
}
UNIT_PATTERNS = {
    "weight": r"\b(kg|lbs?|pounds?|kilograms?|grams?|oz)\b",
    "temperature": r"(?:\b|°)(celsius|fahrenheit|kelvin|[cf])\b",
    "distance": r"\b(km|miles?|meters?|feet|ft|inches?|cm)\b",
    "currency": r"([$€£¥₹])",
}
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
# -------------------------------------------------------------------------------------------


def _pick(df: DataFrame, types) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _pick(df, NUMERIC_TYPES)


def string_columns(df: DataFrame) -> list[str]:
    return _pick(df, T.StringType)


def time_columns(df: DataFrame) -> list[str]:
    return _pick(df, TIME_TYPES)


def type_name(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def name_tokens(name: str) -> list[str]:
    """``orderDate_key2`` -> ``['order', 'date', 'key2']``."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return [t for t in re.split(r"[^A-Za-z0-9]+", spaced.lower()) if t]


def name_matches(name: str, words: list[str], mode: str = "token") -> bool:
    """Does a column name carry one of the words?

    ``token`` compares whole name parts, so ``age`` is not found in
    ``percentage``; ``substring`` looks anywhere in the lower-cased name.
    """
    if mode == "substring":
        return any(w in name.lower() for w in words)
    parts = set(name_tokens(name))
    return any(w.strip("_") in parts for w in words)


def names_like(df: DataFrame, words: list[str], mode: str = "token") -> list[str]:
    return [c for c in df.columns if name_matches(c, words, mode)]


def quoted(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_double(df: DataFrame, col: str) -> Column:
    """Numeric column as double with NaN read as missing."""
    dt = df.schema[col].dataType
    c = quoted(col)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return c.cast("double")


def text_to_number(c: Column) -> Column:
    """Number in a text, or NULL; keeps out forms such as ``5d`` that Spark casts but others do not."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def as_number(df: DataFrame, col: str) -> Column:
    """Numeric reading of any column: numbers as they are, texts by ``text_to_number``, others NULL."""
    dt = df.schema[col].dataType
    if isinstance(dt, NUMERIC_TYPES):
        return as_double(df, col)
    if isinstance(dt, T.StringType):
        return text_to_number(quoted(col))
    return F.lit(None).cast("double")


def strip(c: Column) -> Column:
    """Trim all ASCII white space, not only blanks."""
    return F.trim(c, F.lit(" \t\n\r\x0b\x0c"))


def share(cond: Column) -> Column:
    """Share of rows where the condition holds; rows where it is NULL do not count."""
    return F.avg(cond.cast("double"))


def tally(cond: Column) -> Column:
    return F.count_if(cond)


def unicode_search(c: Column, pattern: str) -> Column:
    """Regex search with Unicode letter and digit classes."""
    return c.rlike("(?U)" + pattern)
