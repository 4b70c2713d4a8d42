"""What moved the average price: like-for-like prices, range, and where sellers stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.config import CONFIG
from panelwright.session import Scratch


def range_split(items: DataFrame, index: DataFrame, pre: tuple[str, ...] = CONFIG.pre) -> DataFrame:
    """roaster, end, total_pct, like_for_like_pct, range_mix_pp, products_continuing, products_added, products_dropped.

    total_pct compares the geometric mean price of the main segment's last quarter with the mean of its base
    quarters' log means; what the index does not explain is range and mix.
    """
    main = index.where("main_segment")
    last = main.groupBy("roaster").agg(F.max_by(F.struct("quarter", "index"), "quarter").alias("m")).select("roaster", F.col("m.quarter").alias("end"), (F.col("m.index") - 100).alias("like_for_like_pct"))
    before = items.join(main.where(F.col("quarter").isin(*pre)).select("roaster", "quarter"), ["roaster", "quarter"], "left_semi")
    after = items.join(last, (items.roaster == last.roaster) & (items.quarter == last.end), "left_semi")
    level = before.groupBy("roaster", "quarter").agg(F.avg(F.ln("ppg")).alias("l")).groupBy("roaster").agg(F.avg("l").alias("l0"))
    now = after.groupBy("roaster").agg(F.avg(F.ln("ppg")).alias("l1"))
    side = lambda df, name: df.select("roaster", "product_key").distinct().withColumn(name, F.lit(1))
    both = side(before, "b").join(side(after, "a"), ["roaster", "product_key"], "full").groupBy("roaster").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("products_continuing"), F.count_if(F.col("b").isNull()).alias("products_added"), F.count_if(F.col("a").isNull()).alias("products_dropped"))
    total = (F.exp(F.col("l1") - F.col("l0")) - 1) * 100
    return last.join(level, "roaster").join(now, "roaster").join(both, "roaster").select("roaster", "end", total.alias("total_pct"), "like_for_like_pct", (total - F.col("like_for_like_pct")).alias("range_mix_pp"), "products_continuing", "products_added", "products_dropped")


def size_cuts(changes: DataFrame, confirmed: DataFrame, variants: DataFrame, shock: str = CONFIG.shock_start) -> DataFrame:
    """roaster, product_id, product_title, variant_id, from_quarter, to_quarter, size_before, size_after, ppg_change_log: cuts of a variant's size from the shock on that a person has confirmed as the same product.

    changes: as changes.variant_size_changes and mark_splits give them, or the rows of a table of variants and
    products with level, sizes_before and sizes_after as texts; confirmed: product_id, the list kept by
    hand; variants: roaster, variant_id, quarter, ppg. Cuts without a price before and after are left out.
    """
    c = changes.where("level = 'variant'") if "level" in changes.columns else changes
    for one in ("before", "after"):
        if f"size_{one}" not in c.columns:
            c = c.withColumn(f"size_{one}", F.col(f"sizes_{one}").try_cast("double"))
    if "product_title" not in c.columns:
        c = c.withColumn("product_title", F.lit(None).cast("string"))
    c = c.where((F.col("confidence") == "high") & ~F.coalesce("crosses_product_split", F.lit(False)) & (F.col("to_quarter") >= shock) & (F.col("size_after") < F.col("size_before")))
    c = c.join(confirmed.select("product_id").distinct(), "product_id", "left_semi").select("roaster", "product_id", "product_title", "variant_id", "from_quarter", "to_quarter", "size_before", "size_after")
    one = variants.groupBy("roaster", "variant_id", "quarter").agg(F.min("ppg").alias("ppg"))
    at = lambda name: one.select("roaster", "variant_id", F.col("quarter").alias(f"{name}_quarter"), F.col("ppg").alias(name))
    both = c.join(at("from"), ["roaster", "variant_id", "from_quarter"]).join(at("to"), ["roaster", "variant_id", "to_quarter"])
    return both.withColumn("ppg_change_log", F.ln(F.col("to") / F.col("from"))).drop("from", "to").where("ppg_change_log is not null")


def cut_table(cuts: DataFrame, variants: DataFrame) -> DataFrame:
    """A row per roaster, product, quarters and sizes of the cuts: how many variants, median prices before, after and in the last quarter that each variant has, median change per gram in percent.

    variants: roaster, variant_id, quarter, price_inr; one row per variant and quarter.
    """
    price = lambda q, name: variants.select("roaster", "variant_id", F.col("quarter").alias(q), F.col("price_inr").alias(name))
    last = variants.groupBy("roaster", "variant_id").agg(F.max("quarter").alias("latest_quarter"), F.max_by("price_inr", "quarter").alias("price_latest"))
    all_ = cuts.join(price("from_quarter", "price_before"), ["roaster", "variant_id", "from_quarter"]).join(price("to_quarter", "price_after"), ["roaster", "variant_id", "to_quarter"]).join(last, ["roaster", "variant_id"])
    change = F.round((F.exp("ppg_change_log") - 1) * 100, 1)
    return all_.groupBy("roaster", "product_title", "from_quarter", "to_quarter", "size_before", "size_after").agg(
        F.countDistinct("variant_id").alias("n_variants"), F.median("price_before").alias("price_before"), F.median("price_after").alias("price_after"),
        F.median(change).alias("ppg_change_pct"), F.max("latest_quarter").alias("latest_quarter"), F.median("price_latest").alias("price_latest"),
    )


def full_split(items: DataFrame, index: DataFrame, coverage: DataFrame, cuts: DataFrame, pre: tuple[str, ...] = CONFIG.pre) -> DataFrame:
    """A row per roaster: range_split over base quarters with complete pages, with pack_size_pp, size_cut_products, size_cut_ppg_change_pct, median_ppg_added, median_ppg_dropped and a note where there is no split.

    coverage: roaster, quarter, source_type, completeness; cuts: as size_cuts gives them. pack_size_pp is the
    share of the last quarter's products that were cut times the mean change per cut product; range_mix_pp
    is what is left of the total without it.
    """
    # each of them is read many times below
    scratch = Scratch(items.sparkSession, "levers")
    items, index, cuts = (scratch.write(df)[0] for df in (items, index, cuts))
    complete = coverage.where((F.col("source_type") == "archive") & F.col("completeness").isin("complete", "single_page")).select("roaster", "quarter").distinct()
    main = index.where("main_segment")
    base = main.where(F.col("quarter").isin(*pre)).join(complete, ["roaster", "quarter"], "left_semi")
    last = main.groupBy("roaster").agg(F.max("quarter").alias("end"))
    ends = main.join(last, "roaster").where(F.col("quarter") == F.col("end")).select(*main.columns)
    split = range_split(items, base.unionByName(ends).dropDuplicates(["roaster", "quarter"]), tuple(pre)).drop("range_mix_pp")
    before = items.join(base.select("roaster", "quarter"), ["roaster", "quarter"], "left_semi")
    after = items.join(last.withColumnRenamed("end", "quarter"), ["roaster", "quarter"], "left_semi")
    only = lambda x, y, name: x.join(y.select("roaster", "product_key").distinct(), ["roaster", "product_key"], "left_anti").groupBy("roaster").agg(F.median("ppg").alias(name))
    per = cuts.join(last, "roaster").where(F.col("to_quarter") <= F.col("end")).groupBy("roaster", "product_id").agg(F.avg("ppg_change_log").alias("l")).groupBy("roaster").agg(F.count(F.lit(1)).alias("size_cut_products"), ((F.exp(F.avg("l")) - 1) * 100).alias("size_cut_ppg_change_pct"))
    out = items.select("roaster").distinct().join(last.withColumnRenamed("end", "indexed_until"), "roaster", "left").join(split, "roaster", "left").join(per, "roaster", "left")
    out = out.join(only(after, before, "median_ppg_added"), "roaster", "left").join(only(before, after, "median_ppg_dropped"), "roaster", "left")
    known = F.col("end").isNotNull()
    n = F.when(known, F.coalesce("size_cut_products", F.lit(0)))
    pack = F.when(known, F.coalesce(n / (F.col("products_continuing") + F.col("products_added")) * F.col("size_cut_ppg_change_pct"), F.lit(0.0)))
    note = F.when(F.col("indexed_until").isNull(), "no price index (too few matched products)").when(~known, "no complete pre-shock page in the index segment").otherwise("")
    mine = [F.when(known, F.col(c)).alias(c) for c in ("size_cut_ppg_change_pct", "median_ppg_added", "median_ppg_dropped")]
    return out.select("roaster", "end", "total_pct", "like_for_like_pct", pack.alias("pack_size_pp"), (F.col("total_pct") - F.col("like_for_like_pct") - pack).alias("range_mix_pp"), n.alias("size_cut_products"), "products_continuing", "products_added", "products_dropped", *mine, note.alias("note"))


def positioning(items: DataFrame, index: DataFrame) -> DataFrame:
    """roaster, n_items, median_ppg, quarter, index: all sellers, with the last row of their main segment if they have one."""
    own = items.groupBy("roaster").agg(F.count(F.lit(1)).alias("n_items"), F.median("ppg").alias("median_ppg"))
    last = index.where("main_segment").groupBy(F.col("roaster").alias("r")).agg(F.max_by(F.struct("quarter", "index"), "quarter").alias("m"))
    return own.join(last, F.col("roaster").eqNullSafe(F.col("r")), "left").select("roaster", "n_items", "median_ppg", F.col("m.quarter").alias("quarter"), F.col("m.index").alias("index"))
