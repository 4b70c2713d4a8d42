"""Quarters and months as Column expressions. A quarter label is `2024Q3`; its index counts quarters since year 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.ids import quarter_index, quarter_label


def quarter_of(d: Column) -> Column:
    """The label of a date's quarter; null for null."""
    return F.when(d.isNotNull(), F.concat(F.lpad(F.year(d).cast("string"), 4, "0"), F.lit("Q"), F.quarter(d).cast("string")))


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def stamp_date(ts: Column) -> Column:
    """The date in a 14-digit capture stamp; null if there is none."""
    return F.try_to_timestamp(F.substring(ts, 1, 8), F.lit("yyyyMMdd")).cast("date")


def lagged_quarter(q: Column, k: Column | int) -> Column:
    return quarter_label(quarter_index(q) - k)


def next_quarter(q: Column) -> Column:
    return lagged_quarter(q, -1)


def quarters_between(a: Column, b: Column) -> Column:
    return quarter_index(b) - quarter_index(a)


def mid_quarter(q: Column) -> Column:
    """The 15th of the quarter's middle month."""
    i = quarter_index(q)
    return F.make_date(F.floor(i / 4).cast("int"), (F.pmod(i, F.lit(4)) * 3 + 2).cast("int"), F.lit(15))


def quarter_range(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per quarter from first to last."""
    return spark.range(1).select(F.explode(F.sequence(quarter_index(F.lit(first)), quarter_index(F.lit(last)))).alias("i")).select(quarter_label(F.col("i")).alias("quarter"))
