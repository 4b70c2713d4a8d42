"""How far retail price indices follow costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelwright.config import CONFIG
from panelwright.functions.ids import quarter_index
from panelwright.operators.regression import ols, within


def _lagged(costs: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """i, lag, cost: the cost that a quarter sees at each lag, and at `avg` the mean of all lags where none is missing."""
    at = costs.select(quarter_index(F.col("quarter")).alias("i"), F.col("cost"))
    single = at.select(F.explode(F.array(*[F.struct((F.col("i") + k).alias("i"), F.lit(str(k)).alias("lag"), F.col("cost").alias("cost")) for k in lags])).alias("s")).select("s.*")
    mean = single.groupBy("i").agg(F.avg("cost").alias("cost"), F.count("cost").alias("n")).where(F.col("n") == len(lags)).select("i", F.lit("avg").alias("lag"), "cost")
    return single.unionByName(mean)


def pass_through(index: DataFrame, items: DataFrame, costs: DataFrame, *, pre: tuple[str, ...] = CONFIG.pre, start: str = CONFIG.shock_start, lags: tuple[int, ...] = CONFIG.lags, least: float = CONFIG.min_cost_change) -> DataFrame:
    """One row per roaster, quarter of its main segment from `start` on, and lag: changes of price and cost since the base quarters, and their ratios.

    costs: quarter and cost. The base price is the median item of the main segment's base quarters.
    `reliable` marks a change of cost of `least` or more, either way: ratios to smaller ones say little.
    """
    main = index.where("main_segment")
    base_q = main.where(F.col("quarter").isin(*pre)).select("roaster", "quarter")
    base = items.join(base_q, ["roaster", "quarter"], "left_semi").groupBy("roaster").agg(F.median("ppg").alias("base_price"))
    before = costs.where(F.col("quarter").isin(*pre)).agg(F.avg("cost").alias("base_cost"))
    rows = main.where(F.col("quarter") >= start).select("roaster", "quarter", (F.col("index") / 100 - 1).alias("rise"), quarter_index(F.col("quarter")).alias("i"))
    rows = rows.join(_lagged(costs, lags), "i").join(base, "roaster").crossJoin(F.broadcast(before))  # one row
    more, share = F.col("cost") - F.col("base_cost"), F.col("cost") / F.col("base_cost") - 1
    return rows.select(
        "roaster", "quarter", "lag", "base_price", (F.col("rise") * 100).alias("retail_change_pct"), (F.col("base_price") * F.col("rise")).alias("retail_change_rs"),
        more.alias("cost_change_rs"), (share * 100).alias("cost_change_pct"),
        F.try_divide(F.col("base_price") * F.col("rise") * 100, more).alias("rupee_pass_through_pct"), F.try_divide(F.col("rise") * 100, share).alias("percent_pass_through_pct"), (F.abs(more) >= least).alias("reliable"),
    )


def headline(rows: DataFrame) -> DataFrame:
    """Each roaster's latest quarter at the mean of the lags."""
    return rows.where("lag = 'avg'").groupBy("roaster").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "roaster"]), "quarter").alias("r")).select("roaster", "r.*")


def distributed_lag(index: DataFrame, costs: DataFrame, *, lags: tuple[int, ...] = CONFIG.lags) -> DataFrame:
    """Regression of log price changes between consecutive quarters of a segment on log cost changes over the same span at each lag, with a fixed effect per roaster: term, coef, se, ci_low, ci_high, and their sum."""
    w = W.partitionBy("roaster", "segment").orderBy("quarter")
    steps = index.select("roaster", F.ln("raw_level").alias("y1"), F.lag(F.ln("raw_level")).over(w).alias("y0"), quarter_index(F.col("quarter")).alias("i1"), F.lag(quarter_index(F.col("quarter"))).over(w).alias("i0")).where("y0 is not null")
    at = costs.where("cost > 0").select(quarter_index(F.col("quarter")).alias("ci"), F.ln("cost").alias("lc"))
    for k in lags:
        for end in ("0", "1"):
            side = at.select((F.col("ci") + k).alias(f"i{end}"), F.col("lc").alias(f"c{k}_{end}"))
            steps = steps.join(side, f"i{end}")
    names = [f"dcost_lag{k}" for k in lags]
    x = F.array(*[F.col(f"c{k}_1") - F.col(f"c{k}_0") for k in lags])
    less, sellers = within(steps.select((F.col("y1") - F.col("y0")).alias("y"), x.alias("x"), "roaster"), "roaster", len(names))
    return ols(less, names, total=names, absorbed=sellers)
