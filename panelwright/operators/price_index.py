"""Chained matched-model price indices. The chain is a forest: each period hangs on the latest earlier one it shares enough items with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelwright.config import CONFIG
from panelwright.functions.ids import quarter_index

_NODES = "array<struct<quarter:string,segment:int,raw_level:double,linked_from:string,link_items:bigint,relative:double>>"


def price_links(items: DataFrame, period: str = "quarter") -> DataFrame:
    """roaster, qa, qb, n_items, relative: matched items of every earlier and later period, and the geometric mean of their price relatives.

    An item's periods are gathered once and paired within its row, so the pairs need no join.
    """
    at = items.where("ppg > 0").groupBy("roaster", "product_key", "size_grams").agg(F.array_sort(F.collect_list(F.struct(F.col(period).alias("q"), F.ln("ppg").alias("l")))).alias("at"))
    pairs = F.flatten(F.transform("at", lambda a: F.transform(F.filter("at", lambda b: b["q"] > a["q"]), lambda b: F.struct(a["q"].alias("qa"), b["q"].alias("qb"), (b["l"] - a["l"]).alias("d")))))
    return at.select("roaster", F.explode(pairs).alias("p")).groupBy("roaster", "p.qa", "p.qb").agg(F.count(F.lit(1)).alias("n_items"), F.exp(F.avg("p.d")).alias("relative"))


def link_parents(links: DataFrame, least: int = CONFIG.min_link_items) -> DataFrame:
    """For each later period the latest earlier one with at least `least` matched items: roaster, quarter, linked_from, link_items, relative."""
    best = F.max_by(F.struct("qa", "n_items", "relative"), "qa").alias("b")
    return links.where(F.col("n_items") >= least).groupBy("roaster", F.col("qb").alias("quarter")).agg(best).select("roaster", "quarter", F.col("b.qa").alias("linked_from"), F.col("b.n_items").alias("link_items"), F.col("b.relative").alias("relative"))


def chain(items: DataFrame, period: str = "quarter", least: int = CONFIG.min_link_items) -> DataFrame:
    """roaster, quarter, segment, raw_level, linked_from, link_items, link_change_pct.

    Periods without a parent start a segment at 100; the others carry their parent's level on. The path
    products are one fold over a roaster's few periods.
    """
    periods = items.select("roaster", F.col(period).alias("quarter")).distinct()
    parents = link_parents(price_links(items, period), least).select(F.col("roaster").alias("r"), F.col("quarter").alias("q"), "linked_from", "link_items", "relative")
    steps = periods.join(parents, periods.roaster.eqNullSafe(F.col("r")) & (F.col("quarter") == F.col("q")), "left")
    row = F.struct("quarter", "linked_from", "link_items", "relative")
    per = steps.groupBy("roaster").agg(F.array_sort(F.collect_list(row)).alias("steps"))
    empty = F.array().cast(_NODES)

    def add(done, s):
        up = F.try_element_at(F.filter(done, lambda d: d["quarter"] == s["linked_from"]), F.lit(1))
        roots = F.size(F.filter(done, lambda d: d["linked_from"].isNull()))
        fresh = s["linked_from"].isNull()
        node = F.struct(
            s["quarter"].alias("quarter"),
            F.when(fresh, roots + 1).otherwise(up["segment"]).alias("segment"),
            F.when(fresh, F.lit(100.0)).otherwise(up["raw_level"] * s["relative"]).alias("raw_level"),
            s["linked_from"].alias("linked_from"), s["link_items"].alias("link_items"), s["relative"].alias("relative"),
        )
        return F.concat(done, F.array(node))

    folded = per.select("roaster", F.explode(F.aggregate("steps", empty, lambda d, s: add(d, s).cast(_NODES))).alias("n"))
    return folded.select("roaster", "n.quarter", "n.segment", "n.raw_level", "n.linked_from", "n.link_items", ((F.col("n.relative") - 1) * 100).alias("link_change_pct"))


def normalise(chained: DataFrame, pre: tuple[str, ...] = CONFIG.pre) -> DataFrame:
    """Adds pre_quarters, anchored, index (base: the mean of a segment's base periods, else its first level) and main_segment.

    The main segment is the anchored one that reaches furthest; of equals, the first.
    """
    is_pre = F.col("quarter").isin(*pre)
    seg = W.partitionBy("roaster", "segment")
    base = F.coalesce(F.avg(F.when(is_pre, F.col("raw_level"))).over(seg), F.first("raw_level").over(seg.orderBy("quarter").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    n = F.count(F.when(is_pre, 1)).over(seg)
    out = chained.withColumn("pre_quarters", n).withColumn("anchored", n > 0).withColumn("index", F.col("raw_level") / base * 100).withColumn("reach", F.max("quarter").over(seg))
    main = F.max(F.when(F.col("anchored"), F.struct("reach", (-F.col("segment")).alias("s")))).over(W.partitionBy("roaster"))
    return out.withColumn("main_segment", F.coalesce(F.col("segment") == -main["s"], F.lit(False))).drop("reach")


def step_timing(index: DataFrame, start: str = CONFIG.shock_start) -> DataFrame:
    """The largest link of each roaster's main segment from `start` on (of equals the earliest), and the span in which the step was made."""
    top = F.max_by(F.struct("quarter", "linked_from", "link_change_pct", "index"), F.struct("link_change_pct", -quarter_index(F.col("quarter")))).alias("t")
    steps = index.where(F.col("main_segment") & (F.col("quarter") >= start) & F.col("linked_from").isNotNull()).groupBy("roaster").agg(top).select("roaster", "t.*")
    before = index.select(F.col("roaster").alias("r"), F.col("quarter").alias("q"), F.col("index").alias("index_before"))
    got = steps.join(before, steps.roaster.eqNullSafe(F.col("r")) & (F.col("linked_from") == F.col("q")), "left")
    span = quarter_index(F.col("quarter")) - quarter_index(F.col("linked_from"))
    earliest = F.greatest(F.lit(0), quarter_index(F.col("linked_from")) - quarter_index(F.lit(start)) + 1)
    return got.select("roaster", "quarter", "linked_from", span.alias("span"), "link_change_pct", "index_before", F.col("index").alias("index_after"), earliest.alias("earliest"), (quarter_index(F.col("quarter")) - quarter_index(F.lit(start))).alias("latest"))


def period_index(chained: DataFrame) -> DataFrame:
    """Adds index, with the first period of each segment as 100, and main_segment, the one of the roaster's last period."""
    w = W.partitionBy("roaster", "segment").orderBy("quarter").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = F.max_by("segment", "quarter").over(W.partitionBy("roaster"))
    return chained.withColumn("index", F.col("raw_level") / F.first("raw_level").over(w) * 100).withColumn("main_segment", F.col("segment") == last)
