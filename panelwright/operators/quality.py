"""Data-quality operators: sales, identity breaks, live comparison, outliers, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelwright.config import CONFIG


def observed_quarters(rows: DataFrame) -> DataFrame:
    """roaster, quarter, qn (1, 2, ..) and last: a roaster's observed quarters in order. Quarters are gathered per roaster with partial sums."""
    per = rows.groupBy("roaster").agg(F.array_sort(F.collect_set("quarter")).alias("qs"))
    return per.select("roaster", F.posexplode("qs").alias("i", "quarter"), F.size("qs").alias("last")).select("roaster", "quarter", (F.col("i") + 1).alias("qn"), "last")


def mark_sales(rows: DataFrame) -> DataFrame:
    """Adds sale_status to archived rows of their own quarter: `candidate` for a drop by over a tenth that is back in the roaster's next observed quarter, `False`, or `not_checkable`.

    Neighbours are the roaster's observed quarters, not the variant's own.
    """
    use = rows.where((F.col("source_type") == "archive") & ~F.coalesce("served_outside_quarter", F.lit(False)))
    seen = observed_quarters(use)
    at = use.join(seen, ["roaster", "quarter"])
    w = W.partitionBy("roaster", "variant_id").orderBy("qn")
    prev = F.when(F.lag("qn").over(w) == F.col("qn") - 1, F.lag("price_inr").over(w))
    nxt = F.when(F.lead("qn").over(w) == F.col("qn") + 1, F.lead("price_inr").over(w))
    p = F.col("price_inr")
    open_ = (F.col("qn") == 1) | (F.col("qn") == F.col("last")) | prev.isNull() | p.isNull() | nxt.isNull()
    status = F.when(open_, "not_checkable").when((p < CONFIG.sale_drop * prev) & (nxt >= CONFIG.sale_revert * prev), "candidate").otherwise("False")
    return at.withColumn("sale_status", status).drop("qn", "last")


def id_carryover(rows: DataFrame, key: str = "variant_id") -> DataFrame:
    """roaster, quarter, carried: the share of the previous observed quarter's ids that are still there; null in the first quarter."""
    ids = rows.where(F.col(key).isNotNull()).select("roaster", "quarter", key).distinct()
    seen = observed_quarters(ids)
    w = W.partitionBy("roaster", key).orderBy("qn")
    at = ids.join(seen, ["roaster", "quarter"])
    at = at.withColumn("stays", F.coalesce(F.lead("qn").over(w) == F.col("qn") + 1, F.lit(False)).cast("int"))
    per = at.groupBy("roaster", "qn").agg(F.sum("stays").alias("kept"), F.count(F.lit(1)).alias("n")).select(F.col("roaster").alias("r"), (F.col("qn") + 1).alias("next"), "kept", "n")
    return seen.join(per, seen.roaster.eqNullSafe(F.col("r")) & (F.col("qn") == F.col("next")), "left").select("roaster", "quarter", F.round(F.col("kept") / F.col("n"), 3).alias("carried"))


def id_breaks(carryover: DataFrame, below: float = CONFIG.id_break_below) -> DataFrame:
    """Adds id_break, and ids_stable for roasters without any break."""
    b = carryover.withColumn("id_break", F.coalesce(F.col("carried") < below, F.lit(False)))
    return b.withColumn("ids_stable", ~F.bool_or("id_break").over(W.partitionBy("roaster")))


def compare_live(archived: DataFrame, live: DataFrame) -> DataFrame:
    """roaster, matched, median_pct_diff, share_higher, share_lower: live prices against the latest archived ones, by variant."""
    last = archived.join(archived.groupBy("roaster").agg(F.max("quarter").alias("quarter")), ["roaster", "quarter"]).where("price_inr > 0").select("roaster", "variant_id", F.col("price_inr").alias("was"))
    d = (F.col("price_inr") / F.col("was") - 1) * 100
    both = live.where("price_inr > 0").select("roaster", "variant_id", "price_inr").join(last, ["roaster", "variant_id"])
    return both.groupBy("roaster").agg(F.count(F.lit(1)).alias("matched"), F.round(F.median(d), 2).alias("median_pct_diff"), F.round(F.avg((d > 1).cast("int")), 3).alias("share_higher"), F.round(F.avg((d < -1).cast("int")), 3).alias("share_lower"))


def price_outliers(rows: DataFrame, by: list[str], price: str, ratio: float = CONFIG.bundle_ratio) -> DataFrame:
    """Adds outlier: a price above `ratio` times the median of its page; null prices are none."""
    middle = rows.groupBy(*by).agg(F.median(price).alias("__m"))
    return rows.join(middle, by, "left").withColumn("outlier", F.coalesce(F.col(price) > ratio * F.col("__m"), F.lit(False))).drop("__m")


def coverage(rows: DataFrame) -> DataFrame:
    """roaster, quarter: variant_count and the percentages that are sized, no coffee, open, and bundles."""
    pct = lambda c: F.round(F.avg(c.cast("int")) * 100, 1)
    guess = F.col("is_coffee_guess")
    return rows.groupBy("roaster", "quarter").agg(F.count(F.lit(1)).alias("variant_count"), pct(F.col("size_grams").isNotNull()).alias("pct_sized"), pct(guess.eqNullSafe(F.lit(False))).alias("pct_non_coffee"), pct(guess.isNull()).alias("pct_coffee_ambiguous"), pct(F.coalesce("is_bundle", F.lit(False))).alias("pct_bundle"))


def completeness(expected: Column, found: Column) -> tuple[Column, Column]:
    """(single_page | complete | partial, the sorted missing pages) from arrays of page numbers."""
    missing = F.array_sort(F.array_except(expected, found))
    return F.when(F.size(expected) == 0, "single_page").when(F.size(missing) > 0, "partial").otherwise("complete"), F.when(F.size(expected) == 0, F.array().cast("array<int>")).otherwise(missing)


def nearest(rows: DataFrame, by: list[str], target: Column, date: str, order: str, within_days: int | None = None) -> DataFrame:
    """The row of each group whose date is nearest to the target, of equals the first in `order`; `within_days` leaves out what is farther."""
    gap = F.abs(F.datediff(F.col(date), target))
    near = rows.withColumn("gap", gap)
    if within_days is not None:
        near = near.where(F.col("gap") <= within_days)
    kept = [c for c in near.columns if c not in by]
    return near.groupBy(*by).agg(F.min_by(F.struct(*kept), F.struct("gap", order)).alias("r")).select(*by, "r.*")
