"""Clean forms of ids and quarters that carry export noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_id(c: Column, length: int) -> Column:
    """The run of exactly `length` digits inside a noisy id; null where there is none.

    The run may stand between quotes, blanks or signs, as the last part of a path, or before a decimal point.
    """
    found = F.regexp_extract(c, rf"(?<![0-9])([0-9]{{{length}}})(?![0-9])", 1)
    # most ids are clean: a number of that many digits needs no search
    clean = (F.length(c) == length) & (c.try_cast("bigint") >= 10 ** (length - 1))
    return F.when(F.coalesce(clean, F.lit(False)), c).when(found != "", found)


def clean_quarter(c: Column) -> Column:
    """`2024Q3` from `2024q3`, `2024 Q3`, `2024-Q3`, `Q3 2024`; null where year or quarter number is missing."""
    year = F.regexp_extract(c, r"(?<![0-9])([0-9]{4})(?![0-9])", 1)
    number = F.regexp_extract(c, r"(?i)q\s*([1-4])(?![0-9])", 1)
    clean = (F.length(c) == 6) & (F.substring(c, 5, 1) == "Q") & F.substring(c, 6, 1).isin("1", "2", "3", "4") & (F.substring(c, 1, 4).try_cast("int") >= 1000)
    return F.when(F.coalesce(clean, F.lit(False)), c).when((year != "") & (number != ""), F.concat(year, F.lit("Q"), number))


def quarter_index(c: Column) -> Column:
    """Quarters since year 0 of a clean label; null for null."""
    return F.substring(c, 1, 4).try_cast("int") * 4 + F.substring(c, 6, 1).try_cast("int") - 1


def quarter_label(i: Column) -> Column:
    """The label of a quarter index."""
    return F.concat(F.lpad(F.floor(i / 4).cast("string"), 4, "0"), F.lit("Q"), (F.pmod(i, F.lit(4)) + 1).cast("string"))
