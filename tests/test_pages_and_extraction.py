from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelwright.operators import extraction as E
from panelwright.operators import pages as P
from panelwright.plans import identity_queries as Q


def test_card_snippets(spark):
    pages = spark.createDataFrame([(1, "Shop Attikan Notes of cocoa 250g Malabar Quick View spicy | 1 2 next footer"), (2, None)], "page long, text string")
    titles = spark.createDataFrame([(1, "a", "attikan"), (1, "b", "Malabar"), (1, "c", "Yemen"), (1, "d", ""), (2, "a", "attikan")], "page long, product_id string, product_title string")
    got = {r["product_id"]: r["snippet"] for r in P.card_snippets(pages, titles, "page", "text").collect()}
    assert got == {"a": "Notes of cocoa 250g", "b": "spicy"}
    many = spark.createDataFrame([("a", "xx", 2), ("a", "yy", 1), ("a", "z", 0)], "product_id string, snippet string, page long")
    assert P.longest_cards(many, ["product_id"], "page").first()["snippet"] == "yy"


@pytest.mark.parametrize("slug, handle, how", [("house", "house", "exact"), ("attikan", "attikan-estate-1", "prefix"), ("malabar-aa-coffee", "malabar-aa", "prefix"), ("atti", None, "unmapped"), ("twin", None, "unmapped"), ("other", None, "unmapped")])
def test_match_handle(spark, slug, handle, how):
    handles = spark.createDataFrame([("s", h) for h in ("house", "house-1", "attikan-estate-1", "malabar-aa", "twin-a", "twin-b")] + [("t", "other")], "shop string, handle string")
    got = P.match_handles(spark.createDataFrame([("s", slug)], "shop string, slug string"), handles, "shop", "slug").first()
    assert (got["handle"], got["handle_source"]) == (handle, how)


def test_match_handles_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "ab", "a1", ""]
    text = lambda: "-".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    products, handles = ([(rng.choice(["s", "t", None]), text()) for _ in range(n)] for n in (300, 60))
    extends = lambda x, y: x.startswith(y + "-")
    want = []
    for s, p in products:
        own = {h for t, h in handles if t == s}
        near = {h for h in own if extends(h, p) or extends(p, h)}
        want.append((s, p, p, "exact") if p in own else (s, p, near.pop(), "prefix") if len(near) == 1 else (s, p, None, "unmapped"))
    got = P.match_handles(spark.createDataFrame([*products, ("s", None)], "shop string, slug string"), spark.createDataFrame([*handles, ("s", None)], "shop string, handle string"), "shop", "slug")
    assert Counter(map(tuple, got.collect())) == Counter([*want, ("s", None, None, "unmapped")])
    assert {how for *_, how in want} == {"exact", "prefix", "unmapped"}


def test_match_handles_broadcasts_nothing(spark):
    """The planner guesses sizes by the file; tables of few bytes there gave broadcasts that the driver could not hold."""
    few = spark.range(1).select(F.lit("s").alias("shop"), F.concat(F.lit("house-"), F.col("id").cast("string")).alias("slug"))
    plan = P.match_handles(few, few.withColumnRenamed("slug", "handle"), "shop", "slug")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" in plan


PAGE = """<html><head><meta property="og:title" content="Attikan"><meta property="og:description" content="A bag of 250 g">
<script type="application/ld+json">{"@type":"Product","name":"Attikan","description":"dark"}</script></head>
<script>var x = {"variants":[{"id":1,"options":["Whole Bean","500g"]},{"id":2,"weight":300},{"id":3,"options":["Fine"]},{"id":4}]}; var y = {"variants": [{"id":1,"options":["1 kg"]}]; </script>"""


def test_product_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, PAGE.replace("250 g", "one size")), (3, "<p>none</p>"), (4, None), (5, '"variants":[{"id":')], "k long, html string")
    got = {(r["k"], r["variant_id"]): (r["size_grams"], r["size_source"]) for r in P.variant_sizes(pages, "k", "html").collect()}
    assert got == {
        (1, "1"): (500.0, "product_page_variant"), (1, "2"): (250.0, "product_page_text"), (1, "3"): (250.0, "product_page_text"),
        (2, "1"): (500.0, "product_page_variant"), (2, "2"): (300.0, "product_page_shipping_weight"), (2, "3"): (None, ""),
    }
    assert P.metadata_text(PAGE) == "Attikan A bag of 250 g Attikan dark"


def test_calendar(spark):
    c = spark.createDataFrame([("a", "20240115000000"), ("a", "20240201000000"), ("a", "20250101000000"), ("b", "20240401000000"), ("b", "x"), ("b", None)], "roaster string, ts string")
    got = {r["roaster"]: tuple(r)[1:] for r in P.capture_calendar(c, "ts", ["2024Q1", "2024Q2"]).collect()}
    assert got == {"a": (2, 0, 1, "2024-01-15"), "b": (0, 1, 1, "2024-04-01")}


def test_calendar_of_all_captures(spark, tmp_path):
    stamps = [("a", "20231130"), ("a", " 20240115000000"), ("a", "2024-08-01T10:00:00"), ("a", "2024-08-02 10:00:00"), ("b", "20240401000000"), ("b", "20240431000000"), ("b", "n/a"), ("b", None)]
    spark.createDataFrame(stamps, "roaster string, served_ts string").write.parquet(f"{tmp_path}/coverage_report.parquet")
    got = {(r["roaster"], r["quarter"]): (r["n"], r["quarters_covered"], r["earliest"]) for r in Q.QUERIES["capture_calendar_all"](spark, str(tmp_path)).collect()}
    a, b = (3, "2023-11-30"), (1, "2024-04-01")
    assert got == {
        ("a", "2023Q4"): (1, *a), ("a", "2024Q1"): (1, *a), ("a", "2024Q2"): (0, *a), ("a", "2024Q3"): (2, *a),
        ("b", "2023Q4"): (0, *b), ("b", "2024Q1"): (0, *b), ("b", "2024Q2"): (1, *b), ("b", "2024Q3"): (0, *b),
    }


def test_embedded_json_of_all_payloads(spark, tmp_path):
    rows = [("a", '{"b": 1, "a": [2]}'), ("b", 'var meta = {"x": "y"};\nmore()'), ("c", '<p>some</p> var meta = {"z": 3};'), ("d", '{"cut": ['), ("e", None)]
    spark.createDataFrame(rows, "payload_id string, payload string").write.parquet(f"{tmp_path}/page_payloads.parquet")
    got = {r["payload_id"]: r["json"] for r in Q.QUERIES["embedded_json_all"](spark, str(tmp_path)).collect()}
    assert got == {"a": '{"a": [2], "b": 1}', "b": '{"x": "y"}', "c": '{"z": 3}'}


def test_answers(spark):
    def provider(batch):
        if any(p == "boom" for _, p in batch):
            raise RuntimeError("gone")
        return {k: p.upper() for k, p in batch if p != "bad" and (p != "slow" or len(batch) == 1)}

    rows = spark.createDataFrame([("1", "a"), ("2", "slow"), ("3", "bad"), ("4", "b")], "ref string, prompt string").coalesce(1)
    got = {r["ref"]: (r["answer"], r["status"]) for r in E.answers(rows, "ref", "prompt", provider, batch=3).collect()}
    assert got == {"1": ("A", "ok"), "2": ("SLOW", "ok_after_retry"), "3": (None, "invalid_or_missing"), "4": ("B", "ok")}
    capped = {r["ref"]: r["status"] for r in E.answers(rows, "ref", "prompt", provider, batch=1, calls=1).collect()}
    assert capped == {"1": "ok", "2": "pending", "3": "pending", "4": "pending"}
    broken = spark.createDataFrame([("1", "a"), ("2", "boom"), ("3", "a")], "ref string, prompt string").coalesce(1)
    assert [r["status"] for r in E.answers(broken, "ref", "prompt", provider, batch=1).orderBy("ref").collect()] == ["ok", "pending", "pending"]


def test_cached_answers(spark):
    def provider(batch):
        return {k: f"new {p}" for k, p in batch}

    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b")], "ref string, prompt string")
    cache = rows.where("ref = '1'").select(E.cache_key("p", "m", F.col("prompt")).alias("key"), F.lit("old").alias("answer"))
    got, new = E.cached_answers(rows, cache, "ref", "prompt", provider, name="p", model="m")
    assert {r["ref"]: r["answer"] for r in got.collect()} == {"1": "old", "2": "new b", "3": "new b"}
    assert new.count() == 1


def test_backoff():
    waited, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise E.Retryable
        return "done"

    assert E.with_backoff(call, sleep=waited.append) == "done" and len(waited) == 2
    with pytest.raises(ValueError):
        E.with_backoff(lambda: int("x"))
