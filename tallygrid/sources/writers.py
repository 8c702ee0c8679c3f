"""Sinks: CSV export, versioned Parquet persistence with rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def export_csv(df: DataFrame, path: str) -> str:
    """The whole dataset as a folder of CSV parts with headers; quotes are doubled, white space and line ends are kept."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a persisted table, oldest first."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    jvm = spark.sparkContext._jvm
    out = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(
                jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            out.append(int(name[1:]))
    return sorted(out)


def persist_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write the next version; the version being read is never overwritten."""
    have = versions(df.sparkSession, path)
    v = (have[-1] if have else 0) + 1
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/v{v}")
    return v


def load_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest complete version, or a given one."""
    have = versions(spark, path)
    if not have:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{version or have[-1]}")


def rollback(spark: SparkSession, path: str) -> DataFrame:
    """The version before the newest; the newest stays on disk."""
    have = versions(spark, path)
    if len(have) < 2:
        raise ValueError("no earlier version")
    return load_table(spark, path, have[-2])
