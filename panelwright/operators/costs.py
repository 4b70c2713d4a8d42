"""Monthly and quarterly input costs, index bases and inflation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelwright.config import CONFIG
from panelwright.functions.periods import month_label, quarter_of


def monthly_mean(rows: DataFrame, date: Column, value: Column) -> DataFrame:
    """month, mean, days: the mean of a daily series per month and how many days it has; months without any value are left out."""
    x = value.try_cast("double")
    return rows.where(x.isNotNull() & date.isNotNull()).groupBy(month_label(date).alias("month")).agg(F.avg(x).alias("mean"), F.count(F.lit(1)).alias("days"))


def monthly_costs(prices: DataFrame, rates: DataFrame, roast_loss: float = CONFIG.roast_loss) -> DataFrame:
    """month, green (per kg) and roasted (per 100 g, after the loss of weight in roasting), for months with both a price and a rate."""
    if not 0 <= roast_loss < 1:
        raise ValueError("roast_loss must be in [0, 1)")
    p, r = prices.select("month", F.col("mean").alias("usd")), rates.select("month", F.col("mean").alias("rate"))
    green = F.col("usd") * F.col("rate")
    return p.join(r, "month").select("month", green.alias("green"), (green / (1 - roast_loss) / 10).alias("roasted"))


def to_quarters(monthly: DataFrame, *values: str) -> DataFrame:
    """Quarterly means of monthly values, with the number of months."""
    return monthly.groupBy(quarter_of(F.to_date(F.concat("month", F.lit("-01")))).alias("quarter")).agg(F.count(F.lit(1)).alias("months_in_quarter"), *[F.avg(v).alias(v) for v in values])


def add_lags(quarterly: DataFrame, value: str, most: int = 3) -> DataFrame:
    """value_lag1 .. of the rows before, by quarter. The table has one row per quarter, so a single window is no burden."""
    w = W.orderBy("quarter")
    return quarterly.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in range(1, most + 1)})


def rebase(quarterly: DataFrame, value: str, to: str, pre: tuple[str, ...] = CONFIG.pre) -> DataFrame:
    """Adds `to`: value as an index with the mean of the base quarters as 100."""
    base = quarterly.where(F.col("quarter").isin(*pre)).agg(F.avg(value).alias("base"))
    return quarterly.crossJoin(F.broadcast(base)).withColumn(to, F.col(value) / F.col("base") * 100).drop("base")  # one row


def splice(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """month, value, series: the old base's months, then the new base's after them, times the ratio of their means where they overlap.

    No overlap, no tail; with `strict` that is a ValueError.
    """
    o, n = old.select("month", F.col("value").alias("o")), new.select("month", F.col("value").alias("n"))
    both = o.join(n, "month")
    if strict and not both.limit(1).count():
        raise ValueError("the two series share no months")
    factor = both.agg(F.try_divide(F.avg("o"), F.avg("n")).alias("factor"))
    tail = n.crossJoin(F.broadcast(factor)).crossJoin(F.broadcast(o.agg(F.max("month").alias("last"))))  # one row each
    tail = tail.where(F.col("factor").isNotNull() & (F.col("month") > F.col("last"))).select("month", (F.col("n") * F.col("factor")).alias("value"), F.lit("new").alias("series"))
    return o.select("month", F.col("o").alias("value"), F.lit("old").alias("series")).unionByName(tail)


def splice_info(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row on how two series were linked: overlap_months, overlap_from, overlap_to, link_factor, ratio_min, ratio_max (4 digits) and linked_months."""
    both = old.select("month", F.col("value").alias("o")).join(new.select("month", F.col("value").alias("n")), "month")
    info = both.agg(F.count(F.lit(1)).alias("overlap_months"), F.min("month").alias("overlap_from"), F.max("month").alias("overlap_to"), F.round(F.try_divide(F.avg("o"), F.avg("n")), 4).alias("link_factor"), F.round(F.min(F.try_divide("o", "n")), 4).alias("ratio_min"), F.round(F.max(F.try_divide("o", "n")), 4).alias("ratio_max"))
    last = old.agg(F.max("month").alias("last"))
    linked = new.crossJoin(F.broadcast(last)).where("month > last").agg(F.count(F.lit(1)).alias("linked_months"))
    return info.crossJoin(F.broadcast(linked))  # one row each


def deflate(headline: DataFrame, cpi: DataFrame) -> DataFrame:
    """Adds inflation_part (the price rise that inflation explains), real_change and real_pass_through_pct (of the rise in cost) to pass-through rows."""
    c = cpi.select("quarter", F.col("cpi_index").alias("cpi"))
    part = F.col("base_price") * (F.col("cpi") / 100 - 1)
    real = F.col("retail_change_rs") - part
    return headline.join(c, "quarter", "left").withColumns({"inflation_part": part, "real_change": real, "real_pass_through_pct": F.try_divide(real * 100, F.col("cost_change_rs"))})
