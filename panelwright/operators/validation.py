"""Validation of extracted values, scoring against hand labels, quotas and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelwright.functions import text as X


def evidence_errors(value: Column, evidence: Column, source: Column, allowed: list[str] | None = None) -> Column:
    """The first fault of an extracted value, or null: not allowed, or without evidence that stands in the source word for word."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    known = ~X.is_unknown(value)
    out = F.when(F.lit(False), F.lit(""))
    if allowed is not None:
        out = out.when(~v.isin(*allowed), "value not allowed")
    e = X.normalise_quotes(evidence)
    return out.when(known & (e == ""), "no evidence").when(known & ~F.contains(X.normalise_quotes(source), e), "evidence not in source")


def split_batch(items: DataFrame, expected: DataFrame, ref: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dead letters with a reason): of a batch's answers, those that were asked for and came once; others, and refs without an answer, go to review."""
    n = F.count(F.lit(1)).over(W.partitionBy(ref))
    marked = items.join(expected.select(ref, F.lit(True).alias("__asked")).distinct(), ref, "left").withColumn("__n", n)
    reason = F.when(F.col("__asked").isNull(), "unexpected").when(F.col("__n") > 1, "duplicate")
    marked = marked.withColumn("reason", reason)
    missing = expected.select(ref).distinct().join(items.select(ref), ref, "left_anti").withColumn("reason", F.lit("missing"))
    return marked.where("reason is null").drop("reason", "__asked", "__n"), marked.where("reason is not null").select(ref, "reason").unionByName(missing)


def field_scores(gold: DataFrame, predicted: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """field, n, accuracy, gold_known, found, invented. fields: name -> `closed`, `free` or `place` (see text.same_answer).

    found: of answers the gold knows, the share that is right; invented: of those it doesn't, the share that is not `unknown`.
    """
    g, p = gold.select(*keys, *[F.col(f).alias(f"{f}__g") for f in fields]), predicted.select(*keys, *[F.col(f).alias(f"{f}__p") for f in fields])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), X.same_answer(F.col(f"{f}__p"), F.col(f"{f}__g"), free=k != "closed", contains=k == "place").alias("ok"), (~X.is_unknown(F.col(f"{f}__g"))).alias("known"), (~X.is_unknown(F.col(f"{f}__p"))).alias("said")) for f, k in fields.items()])
    long = g.join(p, keys).select(F.explode(cells).alias("c")).select("c.*")
    share = lambda c, where: F.round(F.avg(F.when(where, c.cast("int"))), 3)
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("int")), 3).alias("accuracy"), F.count_if("known").alias("gold_known"), share(F.col("ok"), F.col("known")).alias("found"), share(F.col("said"), ~F.col("known")).alias("invented"))


def allocate(sizes: DataFrame, total: int, floor: int) -> DataFrame:
    """group, n, quota: `floor` each (or all there are), the rest in proportion to what is above it, whole units by largest remainder. sizes: group, n - one row per group."""
    base = F.least(F.lit(floor), F.col("n"))
    s = sizes.select("group", "n", base.alias("base"), (F.col("n") - base).alias("spare"))
    sums = s.agg(F.sum("base").alias("given"), F.sum("spare").alias("above"))
    raw = s.crossJoin(F.broadcast(sums)).withColumn("raw", F.coalesce(F.try_divide((F.lit(total) - F.col("given")) * F.col("spare"), F.col("above")), F.lit(0.0)))  # one row
    raw = raw.withColumn("whole", F.floor("raw")).withColumn("part", F.col("raw") - F.col("whole"))
    left = raw.agg((F.lit(total) - F.first("given") - F.sum("whole")).alias("left"))
    ranked = raw.withColumn("r", F.row_number().over(W.orderBy(F.desc("part"), "group")))
    more = (F.col("r") <= F.col("left")) & (F.col("base") + F.col("whole") < F.col("n"))
    return ranked.crossJoin(F.broadcast(left)).select("group", "n", (F.col("base") + F.col("whole") + more.cast("int")).cast("long").alias("quota"))


def stratified_sample(rows: DataFrame, group: str, key: str, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of each group with the least hash of key and seed, as many as its quota."""
    at = rows.join(quotas.select(F.col("group").alias("__g"), "quota"), F.col(group).eqNullSafe(F.col("__g")))
    w = W.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return at.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.col("quota")).drop("__r", "__g", "quota")
