"""The price panel: one counting row per variant and snapshot, the analysis filter and price items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.ids import clean_quarter, digits_id

KEPT = ["tier", "source_type", "served_ts", "served_outside_quarter", "product_id", "product_title", "product_type", "variant_title", "size_source", "price_inr", "compare_at_price_inr", "size_grams", "multipack", "is_coffee_guess", "is_bundle", "in_switch_window"]


def counting_rows(variants: DataFrame, kept: list[str] = KEPT) -> DataFrame:
    """The row with the greatest served_ts of each roaster, variant and quarter, with clean ids and quarters.

    Of copies the one with the least price counts, nulls last, then the greatest titles. Prices are rounded to
    paise, which drops the noise of floats. Rows without a readable variant or quarter are left out. The
    shuffle is by variant, so that a large roaster is spread, and carries the columns in `kept` only.
    """
    v = variants.withColumns({"variant_id": digits_id(F.col("variant_id"), 14), "product_id": digits_id(F.col("product_id"), 13), "quarter": clean_quarter(F.col("quarter")), "price_inr": F.round("price_inr", 2)})
    v = v.where("variant_id is not null and quarter is not null")
    order = F.struct(F.coalesce("served_ts", F.lit("")), F.col("price_inr").isNotNull(), -F.col("price_inr"), F.coalesce("product_title", F.lit("")), F.coalesce("variant_title", F.lit("")))
    best = v.groupBy("roaster", "variant_id", "quarter").agg(F.max_by(F.struct(*kept), order).alias("r"))
    return best.select("roaster", "variant_id", "quarter", "r.*")


def with_keys(rows: DataFrame, keys: DataFrame, attributes: DataFrame) -> DataFrame:
    """rows with product_key, attributes_valid and title_changed of their product, quarter and source, and with is_coffee of their product; rows without a key or attributes keep nulls.

    keys: as identity.keyed_quarters gives them; attributes: roaster, product_id, is_coffee, one row per product.
    """
    k = keys.select("roaster", "product_id", "quarter", "source_type", "product_key", "attributes_valid", "title_changed")
    return rows.join(k, ["roaster", "product_id", "quarter", "source_type"], "left").join(attributes.select("roaster", "product_id", "is_coffee"), ["roaster", "product_id"], "left")


def analysis_rows(rows: DataFrame) -> DataFrame:
    """Rows fit for prices per gram, with ppg per 100 g: sized, priced, of their quarter, outside a change of address, no bundles, not known to be something else; where rows have is_coffee, it must be `yes`."""
    false = lambda c: F.coalesce(F.col(c), F.lit(False)) == F.lit(False)
    ok = F.coalesce("is_coffee_guess", F.lit(True)) & false("is_bundle") & false("served_outside_quarter") & false("in_switch_window")
    if "is_coffee" in rows.columns:
        ok &= F.col("is_coffee") == "yes"
    return rows.where(ok & (F.col("size_grams") > 0) & (F.col("price_inr") > 0)).withColumn("ppg", F.col("price_inr") / F.col("size_grams") * 100)


def price_items(rows: DataFrame, product: str = "product_id") -> DataFrame:
    """roaster, tier, quarter, product_key, size_grams: median ppg and the number of variants; with keys also product_id and attributes_valid, of the first variant."""
    first = [F.min_by(c, "variant_id").alias(c) for c in ("product_id", "attributes_valid") if product != "product_id" and c in rows.columns]
    return rows.groupBy("roaster", "tier", "quarter", F.col(product).alias("product_key"), "size_grams").agg(F.median("ppg").alias("ppg"), F.count(F.lit(1)).alias("n_variants"), *first)
