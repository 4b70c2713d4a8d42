"""Scalar text functions of the panel as Column expressions; all are null-safe and stay in the JVM unless they say otherwise."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide results (fixed values).
NOT_COFFEE = [
    r"dripper", r"grinder", r"kettle", r"filter papers?", r"scale", r"mug", r"cups?",
    r"tumbler", r"bottle", r"server", r"frother", r"v60", r"chemex", r"moka pot",
    r"brewer", r"equipment", r"merch(andise)?", r"t-?shirt", r"tote", r"sticker", r"apron",
    r"drip bags?", r"coffee bags?", r"cold brew bags?", r"dip n sip", r"easy pour",
    r"pour ?over bags?", r"pourtable", r"concentrate", r"cans?", r"capsules?", r"pods?",
    r"instant", r"chicory", r"cascara", r"flour",
    r"cardamom", r"jaggery", r"pepper",
    r"subscriptions?", r"subscribe", r"kit", r"gift card", r"e-gift",
    r"workshop", r"course", r"class", r"event", r"ticket",
]
MAYBE_NOT = [r"tea", r"matcha", r"chocolate", r"cacao", r"oat", r"milk", r"syrup", r"french press", r"aeropress"]
SEVERAL = [r"samplers?", r"sample packs?", r"bundles?", r"combo", r"gift ?box", r"hamper", r"coffees", r"trio", r"\d+\s*-\s*in\s*-\s*1", r"pack(?!\s+of\s+\d)"]
COFFEE_TYPE = r"\bcoffee\b|\bbeans?\b|\broast"
GENERIC_WORDS = ["coffee", "coffees", "bean", "beans", "roast", "roasted", "profile", "blend", "the", "and", "of", "with", "regular", "a", "an", "by"]
PROCESSES = [
    (r"\b(red|yellow|black|white|golden)\s+honey\b", None),
    (r"\bsemi[- ]washed\b", "semi-washed"),
    (r"\bnaturals?\b", "natural"),
    (r"\bwashed\b", "washed"),
    (r"\bhoney\b", "honey"),
    (r"\banaerobic\b", "anaerobic"),
    (r"\baerobic\b", "aerobic"),
    (r"\bcarbonic\b", "carbonic"),
    (r"\bmacerat\w*", "maceration"),
    (r"\bmonsoon\w*", "monsooned"),
    (r"\bferment\w*", "fermentation"),
    (r"\byeast\b", "yeast"),
    (r"\bkoji\b", "koji"),
    (r"\bcultur\w*", "culture"),
    (r"\bpulped\b", "pulped"),
    (r"\bwet[- ]hulled\b", "wet-hulled"),
]
LOT_NUMBER = r"\blot\s*#?\s*([a-z]*\d[\w-]*)|#\s*([a-z]*\d[\w-]*)"
SIZE = r"(?<![\d.])(?:(\d+)\s*[x×]\s*)?(\d+(?:\.\d+)?)\s*(kilograms?|kilos?|kgs?|grams?|gms?|g)\b"
PLACE_FILLERS = ["estate", "estates", "farm", "farms", "plantation", "district", "the"]
CARD_NOISE = r"regular price|sale price|unit price|price|quick ?view|quick shop|buy now|add to cart|sold out|icon-x|close \(esc\)|hot new|new|sale|from|per|you will save|/|\+|\""


def _any(words: list[str]) -> str:
    return rf"(?i)\b({'|'.join(words)})\b"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space, no-break spaces too, as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_text(c), r"(?U)\s+", " "))


def norm_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", " "))


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def pack_count(c: Column) -> Column:
    """N of `pack of N`; null without one."""
    return F.regexp_extract(_text(c), r"(?i)\bpack\s+of\s+(\d+)\b", 1).try_cast("int")


def parse_size(c: Column) -> Column:
    """struct(grams, multipack) of the first weight in a text; null without one."""
    n, x, unit = (F.regexp_extract(_text(c), f"(?i){SIZE}", i) for i in (1, 2, 3))
    grams = x.try_cast("double") * F.when(F.lower(unit).startswith("k"), 1000.0).otherwise(1.0)
    many = n.try_cast("int")
    return F.when(x != "", F.struct((grams * F.coalesce(many, F.lit(1))).alias("grams"), many.isNotNull().alias("multipack")))


def resolve_size(variant_title: Column, product_title: Column, page_size: Column | None = None) -> Column:
    """struct(grams, multipack, source): from the variant's title, else the product's, else the page; a pack of N in the product's title multiplies a single bag."""
    v, p = parse_size(variant_title), parse_size(product_title)
    page = page_size if page_size is not None else F.lit(None).cast("struct<grams:double,multipack:boolean>")
    size = F.coalesce(v, p, page)
    source = F.when(v.isNotNull(), "variant_title").when(p.isNotNull(), "product_title").when(page.isNotNull(), "listing_text").otherwise("")
    n = pack_count(product_title)
    packed = (n >= 2) & ~size["multipack"]
    return F.struct(F.when(F.coalesce(packed, F.lit(False)), size["grams"] * n).otherwise(size["grams"]).alias("grams"), (size["multipack"] | F.coalesce(packed, F.lit(False))).alias("multipack"), source.alias("source"))


def single_size(c: Column) -> Column:
    """The only distinct weight in a text, in grams; null if there is none or more than one."""
    parts = [F.regexp_extract_all(_text(c), F.lit(f"(?i){SIZE}"), F.lit(i)) for i in (1, 2, 3)]
    all_ = F.transform(F.arrays_zip(parts[0].alias("n"), parts[1].alias("x"), parts[2].alias("u")), lambda m: F.coalesce(m["n"].try_cast("double"), F.lit(1.0)) * m["x"].try_cast("double") * F.when(F.lower(m["u"]).startswith("k"), 1000.0).otherwise(1.0))
    sizes = F.array_distinct(all_)
    return F.when(F.size(sizes) == 1, F.try_element_at(sizes, F.lit(1)))


def is_bundle(title: Column) -> Column:
    return _text(title).rlike(_any(SEVERAL))


def coffee_guess(title: Column, kind: Column, has_grams: Column, bundle: Column) -> Column:
    """True, False, or null where the words leave it open."""
    said = F.concat_ws(" ", _text(title), _text(kind))
    return F.when(said.rlike(_any(NOT_COFFEE)), False).when(_text(kind).rlike(f"(?i){COFFEE_TYPE}") | bundle, True).when(said.rlike(_any(MAYBE_NOT)), F.lit(None).cast("boolean")).when(has_grams, True)


def title_words(c: Column) -> Column:
    """The distinct words of a title that say which product it is."""
    return F.array_except(F.filter(F.split(norm_title(c), " "), lambda w: w != ""), F.array(*map(F.lit, GENERIC_WORDS)))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words of two titles as a share of all; 1 if neither has any."""
    x, y = title_words(a), title_words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(1.0))


def process_words(c: Column) -> Column:
    """The sorted processes a title names; what one pattern has taken is not seen by those after it."""
    rest, found = _text(c), []
    for pattern, name in PROCESSES:
        hits = F.regexp_extract_all(rest, F.lit(f"(?i){pattern}"), F.lit(1 if name is None else 0))
        found.append(F.transform(hits, lambda h: F.concat(F.lower(h), F.lit(" honey"))) if name is None else F.when(F.size(hits) > 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))
        if name in (None, "semi-washed", "anaerobic"):  # the only words that hold a later pattern
            rest = F.regexp_replace(rest, f"(?i){pattern}", " ")
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def lot_ids(c: Column) -> Column:
    """The sorted lot numbers of a title."""
    both = [F.regexp_extract_all(_text(c), F.lit(f"(?i){LOT_NUMBER}"), F.lit(i)) for i in (1, 2)]
    return F.array_sort(F.array_distinct(F.transform(F.arrays_zip(both[0].alias("a"), both[1].alias("b")), lambda m: F.lower(F.when(m["a"] != "", m["a"]).otherwise(m["b"])))))


def process_or_lot_changed(a: Column, b: Column) -> Column:
    """Both titles name a process, or both a lot, and not the same."""
    differs = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & (x != y)
    return differs(process_words(a), process_words(b)) | differs(lot_ids(a), lot_ids(b))


def different_product(a: Column, b: Column, below: float = 0.5) -> Column:
    return (word_overlap(a, b) < below) | process_or_lot_changed(a, b)


def title_traits(c: Column) -> Column:
    """What decides whether two titles are of one product: struct(words, processes, lots). To be computed once per title, before titles are compared."""
    return F.struct(title_words(c).alias("words"), process_words(c).alias("processes"), lot_ids(c).alias("lots"))


def traits_overlap(a: Column, b: Column) -> Column:
    """word_overlap of two titles by their traits."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a["words"], b["words"])), F.size(F.array_union(a["words"], b["words"]))), F.lit(1.0))


def traits_changed(a: Column, b: Column) -> Column:
    """process_or_lot_changed of two titles by their traits."""
    differs = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & (x != y)
    return differs(a["processes"], b["processes"]) | differs(a["lots"], b["lots"])


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(_text(c), "<[^>]+>", " "))


def visible_text(c: Column) -> Column:
    """What a reader of an HTML page sees: without scripts, styles, comments and tags, common entities resolved."""
    s = F.regexp_replace(_text(c), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", " ")
    for name, sign in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}.items():
        s = F.replace(s, F.lit(name), F.lit(sign))
    return squeeze(s)


def cap(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def tidy_card(snippet: Column, title: Column) -> Column:
    """A product card's text without its title, page numbers and shop labels."""
    s, t = _text(snippet), _text(title)
    s = F.when(F.lower(s).startswith(F.lower(t)), F.substr(s, F.length(t) + 1)).otherwise(s)
    s = F.split(s, r"(?i)\b1 2 (?:icon-chevron )?next\b").getItem(0)
    return F.btrim(F.regexp_replace(F.regexp_replace(s, f"(?i){CARD_NOISE}", " "), r"(?U)\s+", " "), F.lit(" -|,"))


def product_title(name: Column, variant_title: Column) -> Column:
    """A variant's full name without its ` - variant` ending."""
    n, suffix = F.trim(_text(name)), F.concat(F.lit(" - "), _text(variant_title))
    return F.when((_text(variant_title) != "") & n.endswith(suffix), F.trim(F.substr(n, F.lit(1), F.length(n) - F.length(suffix)))).otherwise(n)


def paise_to_rupees(c: Column) -> Column:
    return c.cast("string").try_cast("bigint") / 100.0


def page_number(url: Column, path: Column) -> Column:
    """The page of a listing URL of exactly that path and a single query `page`; null below 2 and for others."""
    same = F.rtrim(F.try_parse_url(url, F.lit("PATH")), F.lit("/")) == F.rtrim(path, F.lit("/"))
    n = F.regexp_extract(F.try_parse_url(url, F.lit("QUERY")), r"^page=(\d+)$", 1).try_cast("int")
    return F.when(same & (n >= 2), n)


def linked_handles(html: Column) -> Column:
    """The sorted product handles that a page links to."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_text(html), F.lit(r"/products/([a-z0-9][a-z0-9-]*)"), F.lit(1))))


def normalise_quotes(c: Column) -> Column:
    """Lower case, straight quotes and dashes, single blanks."""
    return squeeze(F.translate(F.lower(_text(c)), "‘’“”–—", "''\"\"--"))


def norm_place(c: Column) -> Column:
    return F.array_join(F.filter(F.split(norm_title(c), " "), lambda w: (w != "") & ~w.isin(*PLACE_FILLERS)), " ")


def same_answer(predicted: Column, gold: Column, *, free: bool, contains: bool = False) -> Column:
    """Equal answers: in any case; for free text without filler words; with `contains` also if one holds the other as whole words."""
    if not free:
        return F.lower(F.trim(_text(predicted))) == F.lower(F.trim(_text(gold)))
    p, g = norm_place(predicted), norm_place(gold)
    if not contains:
        return p == g
    known = ~is_unknown(predicted) & ~is_unknown(gold) & (p != "") & (g != "")
    inside = lambda x, y: F.concat(F.lit(" "), y, F.lit(" ")).contains(F.concat(F.lit(" "), x, F.lit(" ")))
    return (p == g) | known & (inside(p, g) | inside(g, p))


def is_unknown(c: Column) -> Column:
    return F.lower(F.trim(_text(c))).isin("unknown", "")


def in_switch_window(window: Column, served: Column) -> Column:
    """Whether a date lies in a change of address: between two dates, in the quarter of a single one, or in the quarter after the one named."""
    w = _text(window)
    quarter = lambda d: F.year(d) * 4 + F.quarter(d)
    after = F.regexp_extract(w, r"after (\d{4})-Q([1-4])", 1).try_cast("int") * 4 + F.regexp_extract(w, r"after (\d{4})-Q([1-4])", 2).try_cast("int") + 1
    dates = F.transform(F.regexp_extract_all(w, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)), lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).cast("date"))
    one, two = F.try_element_at(dates, F.lit(1)), F.try_element_at(dates, F.lit(2))
    inside = F.when(after.isNotNull(), quarter(served) == after).when(F.size(dates) >= 2, served.between(one, two)).when(F.size(dates) == 1, quarter(served) == quarter(one))
    return F.coalesce(inside, F.lit(False))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two strings, in Arrow batches; it has no SQL form."""
    return F.pandas_udf(_ratios, "double")(a, b)
