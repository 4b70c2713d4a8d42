"""Changes from one period to the next: pack sizes, prices, range; upserts and table comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelwright.config import CONFIG


#: Where a size is read from a title that the shop wrote for that product (fixed values).
TITLE_SOURCES = ("variant_title", "product_title", "product_page_variant")


def usable_sizes(rows: DataFrame) -> DataFrame:
    """Rows whose sizes can be compared: sized, of their quarter, no bundles, not known to be something else."""
    false = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return rows.where(F.coalesce("is_coffee_guess", F.lit(True)) & false("is_bundle") & false("served_outside_quarter") & F.col("size_grams").isNotNull())


def _sure(*sources: Column) -> Column:
    """`high` if all sizes come from titles, else `low`."""
    all_ = None
    for c in sources:
        ok = F.coalesce(c.isin(*TITLE_SOURCES), F.lit(False))
        all_ = ok if all_ is None else all_ & ok
    return F.when(all_, "high").otherwise("low")


def variant_size_changes(rows: DataFrame) -> DataFrame:
    """Sizes of a variant that differ between its consecutive quarters, with its titles, where the sizes come from, and confidence. rows: one per variant and quarter."""
    w = W.partitionBy("roaster", "variant_id").orderBy("quarter")
    row = F.struct("quarter", "product_id", "variant_title", "size_grams", "size_source")
    at = rows.where("size_grams is not null").select("roaster", "variant_id", "product_title", row.alias("now"), F.lag(row).over(w).alias("was")).where("was.size_grams <> now.size_grams")
    return at.select(
        "roaster", F.col("was.product_id").alias("product_id"), "product_title", "variant_id", F.col("was.variant_title").alias("variant_title_before"), F.col("now.variant_title").alias("variant_title_after"),
        F.col("was.quarter").alias("from_quarter"), F.col("now.quarter").alias("to_quarter"), F.col("was.size_grams").alias("size_before"), F.col("now.size_grams").alias("size_after"),
        F.col("was.size_source").alias("size_source_before"), F.col("now.size_source").alias("size_source_after"), _sure(F.col("was.size_source"), F.col("now.size_source")).alias("confidence"),
    )


def menu(sizes: Column) -> Column:
    """Sizes as a text in ascending order, six digits each, whole numbers without decimals."""
    def text(x: Column) -> Column:
        unit = F.pow(F.lit(10.0), 5 - F.floor(F.log10(x)))
        six = F.round(x * unit) / unit
        return F.when(six == F.floor(six), F.floor(six).cast("string")).otherwise(six.cast("string"))

    return F.array_join(F.transform(F.array_sort(sizes), text), " ")


def product_size_changes(rows: DataFrame) -> DataFrame:
    """Menus of sizes of a product that differ between its consecutive quarters: a size added or gone is a change too. Confidence is `high` if all sizes on both sides come from titles."""
    doubtful = ~F.coalesce(F.col("size_source").isin(*TITLE_SOURCES), F.lit(False))
    menus = rows.where("size_grams is not null and product_id is not null").groupBy("roaster", "product_id", "quarter").agg(F.array_sort(F.collect_set("size_grams")).alias("sizes"), F.bool_or(doubtful).alias("doubtful"), F.min("product_title").alias("product_title"))
    w = W.partitionBy("roaster", "product_id").orderBy("quarter")
    at = menus.withColumns({"from_quarter": F.lag("quarter").over(w), "before": F.lag("sizes").over(w), "was": F.lag("doubtful").over(w)}).where("before is not null and before <> sizes")
    return at.select("roaster", "product_id", "product_title", "from_quarter", F.col("quarter").alias("to_quarter"), menu(F.col("before")).alias("sizes_before"), menu(F.col("sizes")).alias("sizes_after"), F.when(F.col("doubtful") | F.col("was"), "low").otherwise("high").alias("confidence"))


def mark_splits(changes: DataFrame, keys: DataFrame) -> DataFrame:
    """changes with crosses_product_split: the product's key differs between the two quarters (a missing key differs from one that is there). keys: roaster, product_id, quarter, source_type, product_key; archived keys count before live ones."""
    one = keys.groupBy("roaster", "product_id", "quarter").agg(F.min_by("product_key", "source_type").alias("key"))
    side = lambda name: one.select("roaster", "product_id", F.col("quarter").alias(f"{name}_quarter"), F.col("key").alias(f"{name}_key"))
    both = changes.join(side("from"), ["roaster", "product_id", "from_quarter"], "left").join(side("to"), ["roaster", "product_id", "to_quarter"], "left")
    return both.withColumn("crosses_product_split", ~F.col("from_key").eqNullSafe(F.col("to_key"))).drop("from_key", "to_key")


def period_changes(items: DataFrame, period: str, value: str = "ppg", move: float = CONFIG.price_move) -> DataFrame:
    """roaster, from_period, to_period, change, product_key, size_grams, before, after for each period of a roaster and its previous one.

    change: price_up or price_down by `move` or more (per product and size), added or dropped (per product, with medians).
    """
    per = items.groupBy("roaster").agg(F.array_sort(F.collect_set(period)).alias("ps"))
    steps = per.select("roaster", F.posexplode("ps").alias("i", "from_period"), "ps").where("i + 1 < size(ps)").select("roaster", "from_period", F.expr("ps[i + 1]").alias("to_period"))
    last = per.select("roaster", F.expr("element_at(ps, -1)").alias("end"), F.expr("element_at(ps, 1)").alias("start"))
    it = items.select("roaster", F.col(period).alias("p"), "product_key", "size_grams", F.col(value).alias("v"))
    before = it.join(steps, (steps.roaster == it.roaster) & (steps.from_period == it.p)).select(it.roaster, "from_period", "to_period", "product_key", "size_grams", F.col("v").alias("before"))
    after = it.join(steps, (steps.roaster == it.roaster) & (steps.to_period == it.p)).select(it.roaster, "from_period", "to_period", "product_key", "size_grams", F.col("v").alias("after"))
    keys = ["roaster", "from_period", "to_period", "product_key"]
    ratio = F.col("after") / F.col("before") - 1
    moved = before.join(after, [*keys, "size_grams"]).where(F.abs(ratio) >= move).select(*keys[:3], F.when(ratio > 0, "price_up").otherwise("price_down").alias("change"), "product_key", "size_grams", "before", "after")
    a, b = before.groupBy(*keys).agg(F.median("before").alias("before")), after.groupBy(*keys).agg(F.median("after").alias("after"))
    null = F.lit(None).cast("double")
    gone = a.join(b, keys, "left_anti").select(*keys[:3], F.lit("dropped").alias("change"), "product_key", null.alias("size_grams"), "before", null.alias("after"))
    new = b.join(a, keys, "left_anti").select(*keys[:3], F.lit("added").alias("change"), "product_key", null.alias("size_grams"), null.alias("before"), "after")
    return moved.unionByName(gone).unionByName(new)


def change_summary(changes: DataFrame) -> DataFrame:
    """roaster, to_period and how many changes there are of each kind."""
    kinds = ["price_up", "price_down", "added", "dropped"]
    return changes.groupBy("roaster", "to_period").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """keys, field, left_value, right_value of all cells that differ, and keys that are on one side only (field `row`)."""
    a, b = left.select(*keys, *[F.col(v).alias(f"{v}__l") for v in values], F.lit(True).alias("__l")), right.select(*keys, *[F.col(v).alias(f"{v}__r") for v in values], F.lit(True).alias("__r"))
    both = a.join(b, keys, "full")
    kinds = dict(left.dtypes)

    def differs(v: str) -> Column:
        x, y = F.col(f"{v}__l"), F.col(f"{v}__r")
        if kinds[v] in ("double", "float"):
            return ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False)))
        return ~x.eqNullSafe(y)

    one = F.col("__l").isNull() | F.col("__r").isNull()
    cells = F.array(F.when(one, F.struct(F.lit("row").alias("field"), F.col("__l").cast("string").alias("l"), F.col("__r").cast("string").alias("r"))), *[F.when(~one & differs(v), F.struct(F.lit(v).alias("field"), F.col(f"{v}__l").cast("string").alias("l"), F.col(f"{v}__r").cast("string").alias("r"))) for v in values])
    return both.select(*keys, F.explode(F.array_compact(cells)).alias("c")).select(*keys, "c.field", F.col("c.l").alias("left_value"), F.col("c.r").alias("right_value"))
