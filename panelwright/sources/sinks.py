"""Sinks: several tables at once or none, dead letters, and the split of private columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that must never be written to a shared table.
PRIVATE = ("card_text", "description")


def write_all(spark: SparkSession, tables: dict[str, DataFrame], root: str, private: tuple[str, ...] = PRIVATE) -> None:
    """Writes all tables below root, replacing those that are there; if any fails, none is replaced.

    Each is written beside its place first; then all are renamed, with the old ones kept until the last has moved.
    """
    for name, df in tables.items():
        if bad := [c for c in df.columns if c in private]:
            raise ValueError(f"{name} has private columns: {bad}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    new, old, to = ({n: path(f"{root}/{prefix}{n}{suffix}") for n in tables} for prefix, suffix in ((".", f".{mark}.new"), (".", f".{mark}.old"), ("", "")))
    try:
        for name, df in tables.items():
            df.write.parquet(str(new[name]))
        moved = []
        try:
            for name in tables:
                if fs.exists(to[name]):
                    fs.rename(to[name], old[name])
                moved.append(name)
                if not fs.rename(new[name], to[name]):
                    raise OSError(f"{name} could not be moved")
        except Exception:
            for name in moved:
                if fs.exists(old[name]):
                    fs.delete(to[name], True)
                    fs.rename(old[name], to[name])
            raise
    finally:
        for name in tables:
            for p in (new[name], old[name]):
                if fs.exists(p):
                    fs.delete(p, True)


def write_csv(df: DataFrame, path: str, private: tuple[str, ...] = PRIVATE) -> None:
    """One CSV with a header, for small tables that people read; private columns are refused."""
    if bad := [c for c in df.columns if c in private]:
        raise ValueError(f"private columns: {bad}")
    df.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def with_private(df: DataFrame, text: DataFrame, keys: list[str], private: tuple[str, ...] = PRIVATE) -> DataFrame:
    """df with its private columns again, from the table that split_private made; blank where it has none."""
    there = [c for c in private if c in text.columns]
    return df.drop(*there).join(text.select(*keys, *there), keys, "left").fillna("", there)


def dead_letters(rows: DataFrame, path: str) -> None:
    """Appends rejected rows as JSON lines."""
    rows.withColumn("rejected_at", F.current_timestamp()).write.mode("append").json(path)


def split_private(df: DataFrame, keys: list[str], private: tuple[str, ...] = PRIVATE) -> tuple[DataFrame, DataFrame]:
    """(df without its private columns, keys with the private columns)."""
    there = [c for c in private if c in df.columns]
    return df.drop(*there), df.select(*keys, *there)
