"""Queries of the training-corpus operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.ids import digits_id
from panelwright.llm.groups import link_groups
from panelwright.llm.leaks import leaked_items
from panelwright.llm.listings import same_products
from panelwright.llm.packing import fill_containers
from panelwright.llm.subjects import subject_areas


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "match_candidates").where(F.lower(F.trim("status")).isin("linked", "linked_human"))
    return link_groups(pairs.select(digits_id(F.col("before_id"), 13).alias("a"), digits_id(F.col("after_id"), 13).alias("b")), "a", "b")


P1_SQL = """
WITH RECURSIVE l AS (
  SELECT regexp_extract(before_id, '[0-9]{13}') AS a, regexp_extract(after_id, '[0-9]{13}') AS b
  FROM match_candidates WHERE lower(trim(status)) IN ('linked', 'linked_human')),
e AS (SELECT a, b FROM l WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM l WHERE a <> '' AND b <> '' AND a <> b),
r(v, g) AS (SELECT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON r.v = e.a)
SELECT v AS record_id, min(g) AS group_id FROM r GROUP BY v
"""

def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every listing of match_candidates with the product it is."""
    m = _t(spark, d, "match_candidates")
    sides = [m.select("roaster", digits_id(F.col(f"{side}_id"), 13).alias("id"), F.col(f"{side}_title").alias("title")) for side in ("before", "after")]
    return same_products(sides[0].unionByName(sides[1]), F.col("roaster"), F.col("id"), F.col("title")).select(F.col("seller").alias("roaster"), F.col("listing").alias("listing_id"), F.col("product").alias("product_group"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    g = p4_groups(spark, d)
    a, b = g.alias("a"), g.alias("b")
    same = (F.col("a.product_group") == F.col("b.product_group")) & F.col("a.roaster").eqNullSafe(F.col("b.roaster"))
    return a.join(b, same & (F.col("a.listing_id") < F.col("b.listing_id"))).select(F.col("a.listing_id").alias("listing_a"), F.col("b.listing_id").alias("listing_b")).distinct()


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each capacity, by tokens of a public tokenizer."""
    capacities = _t(spark, d, "pack_capacities").select(F.col("container_kind").alias("kind"), F.col("capacity_tokens").alias("capacity"))
    packed = fill_containers(_t(spark, d, "documents"), F.col("doc_id"), F.col("text"), capacities)
    return packed.select(F.col("kind").alias("container_kind"), "container", "slot", F.col("doc").alias("doc_id"), "piece", "first_token", "n_tokens")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry an evaluation item, how many of its words and where."""
    found = leaked_items(_t(spark, d, "documents"), F.col("doc_id"), F.col("text"), _t(spark, d, "eval_items").select("item_id", "passage", "question"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "words", "offset")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each document's areas and the share of its sentences about them."""
    areas = [r[0] for r in _t(spark, d, "subject_areas").select("subject_area").distinct().orderBy("subject_area").collect()]
    labels = _t(spark, d, "subject_labels").select(F.col("doc_id").alias("doc"), F.col("subject_area").alias("area"))
    found = subject_areas(_t(spark, d, "documents"), F.col("doc_id"), F.col("text"), labels, areas)
    return found.select(F.col("doc").alias("doc_id"), F.col("area").alias("subject_area"), F.round("share", 6).alias("share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_shares(spark, d).select("doc_id", "subject_area").distinct()


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_groups": p4_groups, "p8_packs": p8_packs, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_shares": p10_shares}
ORACLES = {"p1_found": P1_SQL}
