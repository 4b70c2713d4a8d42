from __future__ import annotations

import difflib

import pytest
from pyspark.sql import functions as F

from panelwright.functions import ids as I
from panelwright.functions import periods as D
from panelwright.functions import text as X
from panelwright.plans.quality_queries import QUERIES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("noisy, clean", [("40066895770413", "40066895770413"), ("'40066895770413", "40066895770413"), ("40066895770413.0", "40066895770413"), (" gid://shop/V/40066895770413 ", "40066895770413"), ("4006689577041", None), ("400668957704130", None), (None, None), ("", None)])
def test_digits_id(spark, noisy, clean):
    assert one(spark, I.digits_id(F.lit(noisy).cast("string"), 14)) == clean


@pytest.mark.parametrize("noisy, clean", [("2024Q3", "2024Q3"), ("2024q3", "2024Q3"), ("2024 Q3", "2024Q3"), ("2024-Q3", "2024Q3"), ("Q3 2024", "2024Q3"), ("2024", None), ("2024Q5", None), (None, None)])
def test_clean_quarter(spark, noisy, clean):
    assert one(spark, I.clean_quarter(F.lit(noisy).cast("string"))) == clean


def test_quarter_arithmetic(spark):
    q = F.lit("2025Q1")
    assert one(spark, D.lagged_quarter(q, 1)) == "2024Q4" and one(spark, D.lagged_quarter(q, 3)) == "2024Q2"
    assert one(spark, D.next_quarter(F.lit("2024Q4"))) == "2025Q1"
    assert str(one(spark, D.mid_quarter(F.lit("2024Q4")))) == "2024-11-15"
    assert one(spark, D.quarters_between(F.lit("2024Q2"), q)) == 3
    assert [r[0] for r in D.quarter_range(spark, "2023Q4", "2024Q2").orderBy("quarter").collect()] == ["2023Q4", "2024Q1", "2024Q2"]


@pytest.mark.parametrize("text, size", [("250g", (250.0, False)), ("2 x 200 g", (400.0, True)), ("1.5 kg", (1500.0, False)), ("Whole Bean / 500 Grams", (500.0, False)), ("SL9", None), ("", None), (None, None), ("12 gb", None)])
def test_parse_size(spark, text, size):
    got = one(spark, X.parse_size(F.lit(text).cast("string")))
    assert (got and (got["grams"], got["multipack"])) == size


def test_resolve_size_multiplies_packs(spark):
    got = one(spark, X.resolve_size(F.lit("200g"), F.lit("Nova Coffee (Pack of 2)")))
    assert (got["grams"], got["multipack"], got["source"]) == (400.0, True, "variant_title")
    none = one(spark, X.resolve_size(F.lit(None).cast("string"), F.lit("House")))
    assert none["grams"] is None and none["source"] == ""


@pytest.mark.parametrize("title, bundle", [("Sampler of four", True), ("Coffees (Pack of 3)", True), ("Nova Coffee (Pack of 2)", False), ("5-in-1", True), ("Trio", True), (None, False)])
def test_is_bundle(spark, title, bundle):
    assert one(spark, X.is_bundle(F.lit(title).cast("string"))) is bundle


@pytest.mark.parametrize("title, kind, grams, guess", [("V60 Dripper", "", True, False), ("Dark Chocolate Espresso", "", False, None), ("Dark Chocolate Espresso", "Coffee", False, True), ("House", "", True, True), ("House", None, False, None)])
def test_coffee_guess(spark, title, kind, grams, guess):
    assert one(spark, X.coffee_guess(F.lit(title), F.lit(kind).cast("string"), F.lit(grams), F.lit(False))) is guess


def test_coffee_guess_of_rows(spark, tmp_path):
    rows = [("Malabar", None, 250.0), ("Malabar", None, None), ("Sampler Bundle", None, None), ("Filter", "Tea", 100.0), ("Coffee Mug", "Coffee", 100.0), ("Malabar", "Coffee", None)]
    spark.createDataFrame(rows, "product_title string, product_type string, size_grams double").write.parquet(f"{tmp_path}/variants_long.parquet")
    got = {(r["p"], r["k"], r["has_grams"]): r["guess"] for r in QUERIES["coffee_guess_rows"](spark, str(tmp_path)).collect()}
    assert got == {("Malabar", None, True): True, ("Malabar", None, False): None, ("Sampler Bundle", None, False): True, ("Filter", "Tea", True): None, ("Coffee Mug", "Coffee", True): False, ("Malabar", "Coffee", False): True}


def test_titles(spark):
    assert one(spark, X.process_words(F.lit("Red Honey, washed"))) == ["red honey", "washed"]
    assert one(spark, X.process_words(F.lit("Anaerobic natural"))) == ["anaerobic", "natural"]
    assert one(spark, X.lot_ids(F.lit("Lot #08 and #A1"))) == ["08", "a1"]
    assert one(spark, X.word_overlap(F.lit("The Coffee"), F.lit("beans"))) == 1.0
    assert one(spark, X.different_product(F.lit("Graded Naturals"), F.lit("Graded Washed"))) is True
    assert one(spark, X.different_product(F.lit("March Mellow Cold Brew"), F.lit("Cold Brew - Regular (March Mellow)"))) is False
    assert one(spark, X.product_title(F.lit("House - 250g"), F.lit("250g"))) == "House"
    assert one(spark, X.tidy_card(F.lit("House Quick View notes | 1 2 next foot"), F.lit("House"))) == "notes"


def test_html_and_urls(spark):
    page = "<p>a  b</p><script>x</script><style>y</style>c &amp; d<!-- e -->"
    assert one(spark, X.visible_text(F.lit(page))) == "a b c & d"
    assert one(spark, X.page_number(F.lit("https://s.example/c/coffee/?page=3"), F.lit("/c/coffee"))) == 3
    for bad in ("https://s.example/c/coffee?page=1", "https://s.example/c/tea?page=3", "https://s.example/c/coffee?page=3&x=1"):
        assert one(spark, X.page_number(F.lit(bad), F.lit("/c/coffee"))) is None
    assert one(spark, X.linked_handles(F.lit('<a href="/products/b-1"><a href="/products/a">'))) == ["a", "b-1"]


@pytest.mark.parametrize("window, day, inside", [("2024-04-18 to 2024-05-23 (x)", "2024-05-01", True), ("2024-04-18 to 2024-05-23", "2024-05-24", False), ("2026-03-07 (x)", "2026-01-02", True), ("after 2024-Q2 (x)", "2024-07-01", True), ("after 2024-Q4", "2025-02-01", True), ("", "2024-07-01", False), (None, "2024-07-01", False)])
def test_switch_window(spark, window, day, inside):
    assert one(spark, X.in_switch_window(F.lit(window).cast("string"), F.lit(day).cast("date"))) is inside


def test_sequence_ratio(spark):
    df = spark.createDataFrame([("monsooned malabar", "malabar monsoon"), ("a", None)], "a string, b string")
    got = [r[0] for r in df.select(X.sequence_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [difflib.SequenceMatcher(None, "monsooned malabar", "malabar monsoon").ratio(), 0.0]
