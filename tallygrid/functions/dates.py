"""Date parsing over several formats and strftime-style formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: date formats tried in this order, each with the shape a text must have ---
DATE_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "MM-dd-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    "dd-MMM-yyyy": r"^\d{2}-[A-Za-z]{3}-\d{4}$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
}
# --- Fixed values: strftime directives and the date patterns that print the same ------------
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
            "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%f": "SSSSSS", "%%": "%"}
# --------------------------------------------------------------------------------------------


def parse_any(c: Column, formats: list[str] | None = None) -> Column:
    """First format that fits, as timestamp without time zone; NULL when none does."""
    text = F.trim(c)
    tries = []
    for f in formats or DATE_FORMATS:
        got = F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")
        tries.append(F.when(text.rlike(DATE_FORMATS[f]), got) if f in DATE_FORMATS else got)
    return F.coalesce(*tries)


def strftime(c: Column, fmt: str) -> Column:
    """Format a date or time with strftime directives."""
    out, i = "", 0
    while i < len(fmt):
        two = fmt[i:i + 2]
        if two in STRFTIME:
            out, i = out + STRFTIME[two], i + 2
        elif two.startswith("%"):
            raise ValueError(f"unsupported directive {two}")
        else:
            ch = fmt[i]
            out, i = out + (f"'{ch}'" if ch.isalpha() else "''" if ch == "'" else ch), i + 1
    return F.date_format(c, out)
