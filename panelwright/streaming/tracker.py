"""The monthly tracker: append-only snapshots with a status per seller, in batch and as a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from panelwright.config import CONFIG
from panelwright.functions import text as X
from panelwright.operators.changes import table_diff, upsert


def snapshot_status(rows: DataFrame, period: str, drop: float = CONFIG.big_drop) -> DataFrame:
    """roaster, period, n_products, prev_products, big_drop: products per seller and period, against its previous one."""
    n = rows.groupBy("roaster", period).agg(F.countDistinct("product_id").alias("n_products"))
    prev = F.lag("n_products").over(W.partitionBy("roaster").orderBy(period))
    return n.withColumn("prev_products", prev).withColumn("big_drop", F.coalesce(F.col("n_products") < drop * prev, F.lit(False)))


def new_periods(landed: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Landed rows whose seller and period the kept table does not have yet: taking a snapshot twice adds nothing."""
    return landed.join(kept.select(*keys).distinct(), keys, "left_anti")


def enabled_roasters(final: DataFrame, settings: DataFrame) -> DataFrame:
    """final with enabled: false for those that the settings (roaster, tracker_enabled) switch off by hand."""
    off = settings.select(F.col("roaster").alias("__r"), (F.lower(F.trim("tracker_enabled")) == "true").alias("__e"))
    return final.join(off, F.col("roaster") == F.col("__r"), "left").withColumn("enabled", F.coalesce("__e", F.lit(True))).drop("__r", "__e")


def take_snapshot(month: str, monthly: DataFrame, roasters: DataFrame, robots: DataFrame, landed: DataFrame, errors: DataFrame, drop: float = CONFIG.big_drop) -> tuple[DataFrame, DataFrame]:
    """(monthly with the month's new rows, a status row per roaster).

    roasters: roaster, tier, enabled; robots: roaster, allowed, robots; landed: rows of `monthly` that were
    fetched; errors: roaster, error of fetches that failed. A roaster is `skipped_disabled`, `already_fetched`
    (its month is there and stays as it is), `skipped_robots` (also if nothing is known), `error` (failed or
    without rows) or `fetched`. big_drop: fewer than half the products of its previous month.
    """
    count = lambda df, name: df.groupBy("roaster").agg(F.countDistinct("product_id").alias(name))
    before = monthly.where(F.col("month") < month)
    last = before.groupBy("roaster").agg(F.max("month").alias("month"))
    have, new = count(monthly.where(F.col("month") == month), "have"), count(landed.where(F.col("month") == month), "new")
    prev = count(before.join(last, ["roaster", "month"]), "prev_products")
    s = roasters.select("roaster", "tier", "enabled").join(robots.select("roaster", "allowed", F.col("robots").alias("said")), "roaster", "left").join(errors.select("roaster", F.col("error").alias("failed")), "roaster", "left")
    for side in (have, new, prev):
        s = s.join(side, "roaster", "left")
    asked = F.col("enabled") & F.col("have").isNull()
    status = F.when(~F.col("enabled"), "skipped_disabled").when(F.col("have").isNotNull(), "already_fetched").when(~F.coalesce("allowed", F.lit(False)), "skipped_robots").when(F.col("failed").isNotNull() | F.col("new").isNull(), "error").otherwise("fetched")
    s = s.withColumn("status", status)
    n = F.coalesce(F.when(F.col("status") == "already_fetched", F.col("have")).when(F.col("status") == "fetched", F.col("new")), F.lit(0).cast("long"))
    error = F.when(F.col("status") == "error", F.coalesce(F.substring("failed", 1, 200), F.lit("products.json returned no products"))).otherwise("")
    s = s.withColumns({"n_products": n, "error": error, "robots": F.when(asked, F.coalesce("said", F.lit("error"))).otherwise("")})
    s = s.withColumn("big_drop", F.coalesce((F.col("n_products") > 0) & (F.col("n_products") < drop * F.col("prev_products")), F.lit(False)))
    shown = F.when(F.col("n_products") > 0, F.col("prev_products")).alias("prev_products")
    out = s.select(F.lit(month).alias("month"), "roaster", "tier", "status", "robots", "n_products", shown, "big_drop", "error")
    fresh = landed.where(F.col("month") == month).join(out.where("status = 'fetched'").select("roaster"), "roaster", "left_semi").select(*monthly.columns)
    return monthly.unionByName(fresh), out


def merge_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with this run's status rows: `already_fetched` adds nothing, any other status replaces what the roaster had in that month."""
    return upsert(old, new.where("status <> 'already_fetched'"), ["month", "roaster"])


def check_run(before: DataFrame, after: DataFrame, status: DataFrame, roasters: DataFrame, answers: DataFrame | None = None, most_failed: int = 4) -> None:
    """ValueError before anything is written: columns or earlier rows changed, a roaster without a status, too many failures, a product twice in the answers."""
    if before.columns != after.columns:
        raise ValueError("columns differ")
    if before.exceptAll(after).limit(1).count():
        raise ValueError("earlier months' rows would change")
    if missing := [r[0] for r in roasters.select("roaster").join(status.select("roaster"), "roaster", "left_anti").limit(10).collect()]:
        raise ValueError(f"no status for {sorted(missing)}")
    if (failed := status.where("status = 'error'").count()) >= most_failed:
        raise ValueError(f"{failed} roasters failed; limit is {most_failed - 1}")
    if answers is not None and answers.groupBy("roaster", "product_id").count().where("count > 1").limit(1).count():
        raise ValueError("duplicate products in the answers")


def known_coffee(phase: DataFrame, tracker: DataFrame) -> DataFrame:
    """roaster, product_id, answer: is_coffee of both tables, the tracker's first; blank while it is pending."""
    late = tracker.select("roaster", "product_id", F.when(F.col("status") == "pending", "").otherwise(F.col("is_coffee")).alias("answer"))
    return upsert(phase.select("roaster", "product_id", F.col("is_coffee").alias("answer")), late, ["roaster", "product_id"])


def coffee_rows(monthly: DataFrame, answers: DataFrame) -> DataFrame:
    """Sized and priced rows of coffee, no bundles, with attributes_pending and ppg; while an answer is pending the guess decides."""
    m = monthly.join(answers, ["roaster", "product_id"], "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    guess = F.coalesce("is_coffee_guess", F.lit(False))
    coffee = F.when(F.col("answer") != "", F.col("answer") == "yes").otherwise(guess) & F.coalesce("is_coffee_guess", F.lit(True)) & ~F.coalesce("is_bundle", F.lit(False))
    return m.withColumn("attributes_pending", F.col("answer") == "").where(coffee & F.col("size_grams").isNotNull() & F.col("price_inr").isNotNull()).withColumn("ppg", F.col("price_inr") / F.col("size_grams") * 100).drop("answer")


def add_product_keys(rows: DataFrame) -> DataFrame:
    """rows with product_key: the product's id, with #2, #3 .. after each month in which its title means another product. A month's title is the least one."""
    per = rows.groupBy("roaster", "product_id", "month").agg(F.min("product_title").alias("title"))
    w = W.partitionBy("roaster", "product_id").orderBy("month")
    at = per.withColumn("traits", X.title_traits(F.col("title"))).withColumn("was", F.lag("traits").over(w))
    other = (X.traits_overlap(F.col("was"), F.col("traits")) < 0.5) | X.traits_changed(F.col("was"), F.col("traits"))
    n = F.sum(F.coalesce(F.when(F.col("was").isNotNull(), other), F.lit(False)).cast("int")).over(w) + 1
    keys = at.withColumn("n", n).select("roaster", "product_id", "month", F.when(F.col("n") == 1, F.col("product_id")).otherwise(F.concat("product_id", F.lit("#"), F.col("n").cast("string"))).alias("product_key"))
    return rows.join(keys, ["roaster", "product_id", "month"])


def monthly_items(rows: DataFrame) -> DataFrame:
    """roaster, tier, month, product_key, size_grams: median ppg and the last title."""
    return rows.groupBy("roaster", "tier", "month", "product_key", "size_grams").agg(F.median("ppg").alias("ppg"), F.max("product_title").alias("product_title"))


def pack_size_changes(rows: DataFrame) -> DataFrame:
    """Sizes of a variant of one product that differ from those in its roaster's previous month."""
    per = rows.groupBy("roaster").agg(F.array_sort(F.collect_set("month")).alias("ms"))
    steps = per.select("roaster", F.posexplode("ms").alias("i", "month"), "ms").where("i > 0").select("roaster", "month", F.expr("ms[i - 1]").alias("prev"))
    one = rows.groupBy("roaster", "variant_id", "product_key", "month").agg(F.min_by(F.struct("size_grams", "price_inr", "ppg", "product_title"), F.struct("size_grams", "price_inr")).alias("r"))
    now = one.join(steps, ["roaster", "month"])
    was = one.select("roaster", "variant_id", "product_key", F.col("month").alias("prev"), F.col("r").alias("b"))
    both = now.join(was, ["roaster", "variant_id", "product_key", "prev"]).where("r.size_grams <> b.size_grams")
    pct = F.round((F.col("r.ppg") / F.col("b.ppg") - 1) * 100, 1)
    return both.select("roaster", F.col("prev").alias("from_month"), F.col("month").alias("to_month"), "variant_id", "product_key", F.col("r.product_title").alias("product_title"), F.col("b.size_grams").alias("grams_before"), F.col("r.size_grams").alias("grams_after"), F.col("b.price_inr").alias("price_before"), F.col("r.price_inr").alias("price_after"), F.round("b.ppg", 1).alias("ppg_before"), F.round("r.ppg", 1).alias("ppg_after"), pct.alias("ppg_change_pct"))


def tracker_summary(status: DataFrame, index: DataFrame, changes: DataFrame, packs: DataFrame, rows: DataFrame, month: str) -> DataFrame:
    """A row per status: products and those pending, how many changes of each kind, the index and its last change.

    changes: roaster, to_month, change; packs: as pack_size_changes gives them; index: roaster, month, link_change_pct, index.
    """
    kinds = ["price_up", "price_down", "pack_size_change", "added", "dropped"]
    all_ = changes.select("roaster", "to_month", "change").unionByName(packs.select("roaster", "to_month", F.lit("pack_size_change").alias("change"))).where(F.col("to_month") == month)
    n = all_.groupBy("roaster").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    now = rows.where(F.col("month") == month).groupBy("roaster").agg(F.countDistinct("product_key").alias("coffee_products"), F.count_distinct(F.when(F.col("attributes_pending"), F.col("product_id"))).alias("attributes_pending"))
    i = index.where(F.col("month") == month).select("roaster", F.col("link_change_pct").alias("same_product_change_pct"), F.round("index", 1).alias("index"))
    out = status.join(now, "roaster", "left").join(n, "roaster", "left").join(i, "roaster", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(F.lit(month).alias("month"), "roaster", "tier", "status", zero("coffee_products"), zero("attributes_pending"), *map(zero, kinds), "same_product_change_pct", "index", "big_drop")


def new_inputs(rows: DataFrame, known: DataFrame, month: str) -> DataFrame:
    """The month's products that are not known (roaster, product_id) yet, as inputs for attributes: no text of the shop."""
    some = rows.where(F.col("month") == month).join(known.select("roaster", "product_id").distinct(), ["roaster", "product_id"], "left_anti")
    guess = F.expr("mode() within group (order by is_coffee_guess)")
    per = some.groupBy("roaster", "product_id").agg(F.max("product_title").alias("product_title"), F.max("product_type").alias("product_type"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("variant_title") != "", F.col("variant_title")))), " | ").alias("v"), guess.alias("is_coffee_guess_p2"), F.coalesce(F.bool_or("is_bundle"), F.lit(False)).alias("is_bundle_p2"))
    return per.select("roaster", "product_id", F.lit(month).alias("first_month"), "product_title", F.lit("").alias("other_titles"), "product_type", X.cap(F.col("v"), 600).alias("variant_titles"), F.lit(False).alias("title_changed"), "is_coffee_guess_p2", "is_bundle_p2")


def to_do(inputs: DataFrame, answers: DataFrame) -> DataFrame:
    """Inputs without a final answer: never tried, or pending."""
    return inputs.join(answers.where("status <> 'pending'").select("roaster", "product_id"), ["roaster", "product_id"], "left_anti")


def update_answers(answers: DataFrame, fresh: DataFrame, month: str) -> DataFrame:
    """answers with the fresh ones, marked with the month, in place of those of the same products; what is done stays."""
    return upsert(answers, fresh.withColumn("attempted_month", F.lit(month)).select(*answers.columns), ["roaster", "product_id"])


def check_history(stored: dict[str, DataFrame], rebuilt: dict[str, DataFrame], keys: dict[str, list[str]], rtol: float = 1e-9, atol: float = 1e-12) -> None:
    """ValueError if a table built again is not the stored one: other columns or their order, other rows, other texts, or numbers off by more than the tolerance."""
    for name, old in stored.items():
        new = rebuilt[name]
        if old.columns != new.columns:
            raise ValueError(f"{name}: columns differ")
        diff = table_diff(old, new, keys[name], [c for c in old.columns if c not in keys[name]], rtol, atol).limit(3).collect()
        if diff:
            raise ValueError(f"{name}: {diff}")


#: Marks between which a text holds the line about the last run (fixed values).
MARKS = ("<!-- tracker:last-run -->", "<!-- /tracker:last-run -->")


def last_run_line(day: str, month: str, status: DataFrame, pending: int, new: int) -> str:
    """A line on how a run went, from its status counts."""
    n = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}  # a handful of statuses
    had = n.get("already_fetched", 0) + n.get("seeded_phase2", 0)
    return f"**Last run: {day}** (snapshot {month}). Roasters fetched: {n.get('fetched', 0)}; already had this month's data: {had}; skipped by robots.txt: {n.get('skipped_robots', 0)}; switched off: {n.get('skipped_disabled', 0)}; failed: {n.get('error', 0)}. New products this run: {new}; attributes pending: {pending}."


def with_last_run(text: str, line: str) -> str:
    """A text with the line between its marks; ValueError without them."""
    start, end = text.find(MARKS[0]), text.find(MARKS[1])
    if start < 0 or end < start:
        raise ValueError("no last-run marks")
    return f"{text[: start + len(MARKS[0])]}\n{line}\n{text[end:]}"


def check_append(before: DataFrame, after: DataFrame, keys: list[str], allowed: list[str] | None = None) -> None:
    """ValueError if rows of `before` are changed or missing in `after`, columns differ, or keys repeat."""
    if before.columns != after.columns:
        raise ValueError("columns differ")
    if before.exceptAll(after).limit(1).count():
        raise ValueError("earlier rows were changed")
    if after.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("keys repeat")


def windowed_counts(events: DataFrame, ts: Column, kind: str, width: str, late: str) -> DataFrame:
    """Counts and sums of a stream of events per window and kind; events later than `late` are dropped by the watermark."""
    e = events.withColumn("at", ts.cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def run_tracker(spark: SparkSession, landed: DataFrame, table: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends a stream's sellers and periods to the table at a path, partitioned by run and batch.

    A run is a checkpoint; a batch is written in its own place, so one that is replayed replaces itself, and
    rows of a seller and period that come in several batches are all kept. What earlier runs have of a seller
    and period stays: taking it again adds nothing.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def take(batch: DataFrame, batch_id: int) -> None:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        others = [str(f.getPath()) for f in fs.listStatus(path) if f.isDirectory() and f.getPath().getName() != f"run={run}" and f.getPath().getName().startswith("run=")] if fs.exists(path) else []
        fresh = new_periods(batch, spark.read.parquet(*others), keys) if others else batch
        fresh.write.mode("overwrite").parquet(f"{table}/run={run}/batch={batch_id}")

    return landed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
