"""Listings of the same product under different wording: set-similarity join and star clustering."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelwright.functions.text import GENERIC_WORDS, PLACE_FILLERS
from panelwright.session import Scratch

#: What titles say of a product, in the order in which it is taken out of them: kind, value and the ways to say it (fixed values).
ATTRIBUTES = [
    ("roast", "medium-dark", r"roast: ?med(?:ium)?[- ]dark|med(?:ium)?[- ]dark(?:ly)? roast(?:ed)?"),
    ("roast", "medium", r"roast: ?(?:medium|mid)|(?:medium|mid) roast(?:ed)?"),
    ("roast", "light", r"roast: ?light|light(?:ly)? roast(?:ed)?"),
    ("roast", "dark", r"roast: ?dark|dark(?:ly)? roast(?:ed)?"),
    ("process", "anaerobic", r"anaerobic(?: ferment(?:ed|ation)?)?(?: process(?:ed)?)?"),
    ("process", "honey", r"honey(?: process(?:ed)?)?"),
    ("process", "monsooned", r"monsoon(?:ed)?(?: process(?:ed)?)?"),
    ("process", "washed", r"(?:fully )?washed(?: process(?:ed)?)?|wet process(?:ed)?"),
    ("process", "natural", r"natural(?: process(?:ed)?)?|dry process(?:ed)?|sun[- ]dried"),
    ("grade", "aaa", r"(?:plantation |gr\.? ?|grade )?aaa"),
    ("grade", "aa", r"(?:plantation |gr\.? ?|grade )?aa"),
    ("grade", "ab", r"(?:plantation |gr\.? ?|grade )?ab"),
    ("grade", "eb", r"extra bold|eb"),
    ("grade", "pb", r"pea ?berry|pb"),
    ("varietal", "cauvery", "cauvery"),
    ("varietal", "catuai", "catuai"),
    ("varietal", "sl9", r"sl[- ]?9"),
    ("varietal", "s795", r"s[- ]?795"),
    ("varietal", "chandragiri", "chandragiri"),
]
#: A lot number; a weight as number or word with its unit (fixed values).
LOT = r"(?:lot(?: no\.?)? ?#? ?|# ?)(\d+)"
SIZE = r"(?<!#)(?<!# )(?<!lot )(?<!\bno )(?<!\bno\. )(?:(\d+(?:\.\d+)?|\d/\d|half|quarter|one) ?(kilograms?|kilos?|kgs?|grams?|gms?|gr(?! ?\.)|g))"
#: A part of what a pattern matches, where the pattern itself is none: where no such part is in a title, the pattern need not be tried.
PARTS = {
    "medium-dark": ["dark"], "medium": ["mid", "medium"], "light": ["light"], "dark": ["dark"], "anaerobic": ["anaerobic"], "honey": ["honey"], "monsooned": ["monsoon"],
    "washed": ["washed", "wet process"], "natural": ["natural", "dry process", "sun"], "aaa": ["aaa"], "aa": ["aa"], "ab": ["ab"], "eb": ["eb", "extra bold"], "pb": ["berry", "pb"],
    "sl9": ["sl"], "s795": ["795"],
}
#: Letter pairs of a word that one slip of spelling destroys at most, and letters that it changes; shorter words have no slips.
SLIP, LETTERS, SHORT = 3, 2, 5
#: Words of a seller that meet in single letter pairs at most.
MANY = 1000
#: Two titles match if the words that both have weigh so much of the lighter one's, and so much of the heavier one's.
CONTAINED, HEAVY = 0.6, 0.15


def _words(pattern: str) -> str:
    return rf"(?<![\w])(?:{pattern})(?![\w])"


def title_profile(title: Column) -> tuple[Column, Column]:
    """(attributes, words): the sorted `kind:value` tokens that a title states, and its other distinct words in order of the alphabet.

    Case, order, punctuation and units don't matter; words that any listing may have (coffee, estate and the
    like) are left out; a null title has neither.
    """
    lower = F.lower(F.coalesce(title, F.lit("")))
    # titles are lower case from here on; most have no blanks but single spaces
    s = F.when(lower.rlike(r"(?U)[^\S ]|  "), F.regexp_replace(lower, r"(?U)\s+", " ")).otherwise(lower)
    profile = F.transform(F.array(s), _profile)[0]  # a lambda, so that each part is computed once
    return profile["attributes"], profile["words"]


def _profile(s: Column) -> Column:
    """struct(attributes, words) of a lower-case title."""
    has = lambda parts: reduce(or_, [s.contains(x) for x in parts])
    tokens = []
    for kind in dict.fromkeys(k for k, _, _ in ATTRIBUTES):
        value = F.when(F.lit(False), F.lit(""))
        for _, name, pattern in [a for a in ATTRIBUTES if a[0] == kind]:
            value = value.when(has(PARTS.get(name, [name])) & s.rlike(_words(pattern)), F.lit(f"{kind}:{name}"))
        tokens.append(value)
    lot = F.when(has(["#", "lot"]), F.regexp_extract(s, _words(LOT), 1)).otherwise("")
    tokens.append(F.transform(F.array(lot), lambda x: F.when(x != "", F.concat(F.lit("lot:"), F.regexp_replace(x, r"^0+(?=\d)", ""))))[0])
    tokens.append(F.transform(F.array(F.regexp_extract(s, rf"(?<![\w./]){SIZE}(?![\w])", 0)), _size)[0])
    spoken = "|".join([*(pattern for _, _, pattern in ATTRIBUTES), LOT, SIZE])
    bare = F.regexp_replace(s, rf"(?<![\w./]){SIZE}(?![\w])|" + _words(spoken), " ")
    words = F.array_sort(F.array_distinct(F.filter(F.split(bare, r"(?U)[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*GENERIC_WORDS, *PLACE_FILLERS))))
    return F.struct(F.array_sort(F.array_compact(F.array(*tokens))).alias("attributes"), words.alias("words"))


def _size(said: Column) -> Column:
    """The token of a weight as a title says it; null for none."""
    number, unit = F.regexp_extract(said, r"^[\d./]+|half|quarter|one", 0), F.regexp_extract(said, r"[a-z]+$", 0)
    amount = F.when(number == "", None).when(number == "half", 0.5).when(number == "quarter", 0.25).when(number == "one", 1.0).when(number.contains("/"), F.try_divide(F.substring(number, 1, 1).try_cast("double"), F.substring(number, 3, 1).try_cast("double"))).otherwise(number.try_cast("double"))
    grams = F.round(F.when(unit.startswith("k"), amount * 1000).otherwise(amount)).cast("long")
    return F.when(said != "", F.when(grams.isNotNull(), F.concat(F.lit("size:"), grams.cast("string"))))


def _letter_pairs(word: Column) -> Column:
    """The letter pairs of a word, numbered where they repeat."""
    chars = F.concat(F.lit("^"), word, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(chars) - 1), lambda i: F.substring(chars, i, F.lit(2)))
    again = lambda ps: F.transform(ps, lambda p, i: F.concat(p, F.size(F.filter(F.slice(ps, 1, i), lambda q: q == p)).cast("string")))
    return F.transform(F.array(pairs), lambda ps: F.when(F.size(F.array_distinct(ps)) == F.size(ps), F.transform(ps, lambda p: F.concat(p, F.lit("0")))).otherwise(again(ps)))[0]


def _without_letter(words: Column) -> Column:
    """All that is left of some words when one of their letters is taken out."""
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))


def _slips(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): different words of one seller (`seller`, id, word) that a slip of spelling turns into each other, both ways.

    Tokens of a word are its letter pairs, numbered where they repeat. In any one order of them, two words that
    share all but SLIP of the longer one's tokens share one of the SLIP + 1 first of each. Words of a seller with
    many meet in what is left of them without up to LETTERS letters instead: few others have the same.
    """
    sized = words.where(F.length("word") >= SHORT).select("seller", "id", "word", F.length("word").alias("n"), F.count(F.lit(1)).over(W.partitionBy("seller")).alias("many"))
    ordered = F.array_sort(F.transform(_letter_pairs(F.col("word")), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    less = [F.array("word")]
    for _ in range(LETTERS):
        less.append(_without_letter(less[-1]))
    keys = F.when(F.col("many") > MANY, F.array_distinct(F.concat(*less))).otherwise(F.transform(F.slice(ordered, 1, SLIP + 1), lambda x: x["g"]))
    met = sized.select("seller", "id", "word", "n", F.explode(keys).alias("k")).withColumn("k", F.xxhash64("seller", F.col("seller").isNull(), "k"))
    x, y = met.alias("x"), met.alias("y")
    near = (F.col("x.id") < F.col("y.id")) & (F.abs(F.col("x.n") - F.col("y.n")) <= LETTERS) & (F.levenshtein(F.col("x.word"), F.col("y.word"), LETTERS) >= 0)
    shared = F.size(F.array_intersect(_letter_pairs(F.col("x.word")), _letter_pairs(F.col("y.word"))))
    # tokens are only compared where the letters are near
    met = x.join(y, (F.col("x.k") == F.col("y.k")) & F.when(near, shared >= F.greatest("x.n", "y.n") + 1 - SLIP).otherwise(False))
    one = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both, _ = scratch.write(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return both


def _contained(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): sets (blk, id, ws: struct(weight, word), heaviest first) of one block of which the heavier one contains the lighter one, both ways.

    Words are ordered by rarity. Of the lighter set only the rarest words, up to where the rest could no longer
    weigh CONTAINED of it, must meet a word of the other; positions and weights then bound what they can share
    before the exact check. The lighter one is the one of less weight, of equals the one of smaller id.
    """
    weigh = lambda ws: F.aggregate(ws, F.lit(0.0), lambda t, w: t + w["weight"])
    sets = sets.withColumn("total", weigh(F.col("ws"))).where("total > 0")
    at = sets.select("blk", "id", "ws", "total", F.posexplode("ws").alias("i", "w"))
    at = at.select("blk", "id", "ws", "total", "w.word", (F.col("total") - weigh(F.slice("ws", F.lit(1), F.col("i")))).alias("rest"))
    own = at.alias("x").where(F.col("x.rest") >= CONTAINED * F.col("x.total") - 1e-9)
    other = at.alias("y")
    less = (F.col("x.total") < F.col("y.total")) | (F.col("x.total") == F.col("y.total")) & (F.col("x.id") < F.col("y.id"))
    # what both can share at most, from here on, if this is the first word that they share
    room = (F.least("x.rest", "y.rest") >= CONTAINED * F.col("x.total") - 1e-9) & (F.col("x.total") >= HEAVY * F.col("y.total"))
    met = own.join(other, (F.col("x.blk") == F.col("y.blk")) & (F.col("x.word") == F.col("y.word")) & less & (F.col("x.id") != F.col("y.id")) & room)
    met = met.withColumn("shared", weigh(F.array_intersect("x.ws", "y.ws"))).where((F.col("shared") >= CONTAINED * F.col("x.total") - 1e-9) & (F.col("shared") >= HEAVY * F.col("y.total")))
    one = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both, _ = scratch.write(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return both


def star_clusters(vertices: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, centre): vertices (id, weight) by star clustering over symmetric edges (a, b).

    In rounds: a vertex that outranks all its free neighbours (by degree, weight, then smaller id) becomes a
    centre, its free neighbours go to the highest centre beside them. Vertices without an edge are their own.
    """
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("deg"))
    # ids are turned so that the smallest id has the greatest rank
    free, seen = scratch.write(degree.join(vertices, degree.a == vertices.id).select("id", F.struct("deg", "weight", (-F.col("id")).alias("turned")).alias("rank")))
    done = None
    while seen["rows"]:
        theirs = free.select(F.col("id").alias("b"), F.col("rank").alias("theirs"))
        live = edges.join(theirs, "b").join(free.select(F.col("id").alias("a"), "rank"), "a")
        best = live.groupBy("a").agg(F.max("theirs").alias("best"), F.first("rank").alias("rank"))
        alone = free.join(best, free.id == best.a, "left").select(free.id, free["rank"], "best")
        centre, _ = scratch.write(alone.where("best is null or rank > best").select("id", "rank"))
        near = edges.join(centre.select(F.col("id").alias("b"), F.col("rank").alias("theirs")), "b").join(free.select(F.col("id").alias("a")), "a")
        near = near.join(centre.select(F.col("id").alias("a")), "a", "left_anti").groupBy("a").agg(F.max(F.struct("theirs", "b")).alias("m"))
        step, _ = scratch.write(centre.select("id", F.col("id").alias("centre")).unionByName(near.select(F.col("a").alias("id"), F.col("m.b").alias("centre"))))
        done = step if done is None else done.unionByName(step)
        left, seen = scratch.write(free.join(step.select("id"), "id", "left_anti"))
        free = left
    if done is None:
        return vertices.select("id", F.col("id").alias("centre"))
    done = done.select(F.col("id").alias("did"), "centre")
    return vertices.join(done, vertices.id == done.did, "left").select("id", F.coalesce("centre", "id").alias("centre"))


def same_products(listings: DataFrame, seller: Column, listing: Column, title: Column) -> DataFrame:
    """One row per seller and listing: seller, listing, product (a number), from titles that say the same.

    Attributes of known kinds that a title states (roast, process, grade, varietal, lot, size) are vetoes: titles
    match only if all of them agree. The other words are compared by weighted containment: a word weighs the
    squared logarithm of how rare it is among all sellers, so that names decide and words that many sellers use
    (praise, delivery, seasons), known or not, hardly count; two titles match if the words that both have weigh
    60 % or more of the lighter one and 15 % of the heavier one. Spellings of a word within a seller that a slip
    turns into each other are first made one (see _slips). Titles meet through their rarest words (see
    _contained); star clustering gives the products. Equal titles are one vertex, so copies cost nothing. A
    listing with several titles has the one it has most often. Rows without a listing id are left out; null
    sellers are one seller; listings with null or empty titles are their own products.
    """
    spark = listings.sparkSession
    scratch = Scratch(spark, "listings")
    attributes, words = title_profile(F.col("title"))
    base = listings.select(seller.alias("seller"), listing.cast("string").alias("listing"), title.alias("title")).where("listing is not null")
    titles = base.groupBy("seller", "listing", "title").agg(F.count(F.lit(1)).alias("n"))
    said = titles.select("seller", "listing", "n", attributes.alias("attributes"), words.alias("words"))
    blank = (F.size("attributes") == 0) & (F.size("words") == 0)
    said = said.select("seller", "listing", "n", F.xxhash64("seller", F.array_join("attributes", "|"), F.when(blank, F.col("listing"))).alias("blk"), "words")
    said, _ = scratch.write(said)

    # words of a seller, with all spellings of one under the most usual
    word = said.select("seller", "n", F.explode("words").alias("word")).groupBy("seller", "word").agg(F.sum("n").alias("weight")).withColumn("id", F.xxhash64("seller", "word"))
    word, _ = scratch.write(word)
    spelt = star_clusters(word.select("id", "weight"), _slips(word, scratch), scratch).withColumnRenamed("id", "sid")
    usual = word.select(F.col("id").alias("centre"), F.col("word").alias("usual"))
    spelt = word.join(spelt, F.col("id") == F.col("sid")).join(usual, "centre").select(F.col("seller").alias("ws"), F.col("word").alias("ww"), "usual")
    sellers = word.agg(F.countDistinct(F.coalesce(F.col("seller"), F.lit("")), F.col("seller").isNull()).alias("sellers"))
    spread = spelt.groupBy("usual").agg(F.count_distinct(F.struct("ws")).alias("df")).crossJoin(F.broadcast(sellers))  # one row
    spread = spread.select(F.col("usual").alias("su"), F.pow(F.ln((F.col("sellers") + 1) / F.col("df")), 2).alias("weight"))
    known, _ = scratch.write(spelt.join(spread, F.col("usual") == F.col("su")).select("ws", "ww", "usual", "weight"))

    item = F.when(F.col("usual").isNotNull(), F.struct((-F.col("weight")).alias("weight"), F.col("usual").alias("word")))
    # the titles of a listing, spelt the usual way, are counted by their sets of words
    sets = said.withColumn("title", F.xxhash64("words")).select("seller", "listing", "blk", "n", "title", F.explode_outer("words").alias("word"))
    sets = sets.join(known, F.col("seller").eqNullSafe(F.col("ws")) & (F.col("word") == F.col("ww")), "left").groupBy("seller", "listing", "blk", "title").agg(F.max("n").alias("n"), F.array_sort(F.collect_set(item)).alias("ws"))
    sets = sets.select("seller", "listing", "blk", "n", F.transform("ws", lambda w: F.struct((-w["weight"]).alias("weight"), w["word"].alias("word"))).alias("ws"))
    sets = sets.withColumn("id", F.xxhash64("blk", F.transform("ws", lambda w: w["word"])))
    own = sets.groupBy("seller", "listing", "id", "blk", "ws").agg(F.sum("n").alias("n")).groupBy("seller", "listing").agg(F.max_by(F.struct("id", "blk", "ws"), F.struct("n", "id")).alias("p"))
    own, _ = scratch.write(own.select("seller", "listing", "p.id", "p.blk", "p.ws"))
    vertices, _ = scratch.write(own.groupBy("id", "blk", "ws").agg(F.count(F.lit(1)).alias("weight")))
    clusters = star_clusters(vertices.select("id", "weight"), _contained(vertices, scratch), scratch)
    return own.join(clusters, "id").select("seller", "listing", F.col("centre").alias("product"))
