"""Product identity over time: title segments, candidate matches across a rebuild, conflicts and keys."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelwright.config import CONFIG
from panelwright.functions import text as X
from panelwright.session import Scratch

#: Products in a block before and after a break. Up to FEW titles are scored without bounds first, which is quicker.
BLOCK_BEFORE, BLOCK_AFTER, FEW = 256, 2048, 24


def title_segments(titles: DataFrame) -> DataFrame:
    """roaster, product_id, quarter, segment, product_key, segment_start: runs of a product id's titles (one per quarter) that mean the same product.

    A key is the id, with `@quarter` of the run's start from the second run on.
    """
    w = W.partitionBy("roaster", "product_id").orderBy("quarter")
    prev = F.lag("product_title").over(w)
    at = titles.withColumn("prev", prev).withColumn("new", F.coalesce(X.different_product(F.col("prev"), F.col("product_title")) & F.col("prev").isNotNull(), F.lit(False)))
    at = at.withColumn("segment", F.sum(F.col("new").cast("int")).over(w) + 1)
    start = F.min("quarter").over(W.partitionBy("roaster", "product_id", "segment"))
    key = F.when(F.col("segment") > 1, F.concat("product_id", F.lit("@"), start)).otherwise(F.col("product_id"))
    return at.select("roaster", "product_id", "quarter", F.col("segment").cast("int").alias("segment"), key.alias("product_key"), start.alias("segment_start"))


def title_history(rows: DataFrame) -> DataFrame:
    """roaster, product_id, titles, title_similarity, title_changed, process_or_lot_changed: a product's distinct titles in the order in which they came, and whether any step between them leads to another product."""
    seen = rows.where("product_id is not null and product_title is not null").groupBy("roaster", "product_id", "product_title").agg(F.min(F.struct("quarter", "source_type", "variant_id")).alias("since"))
    w = W.partitionBy("roaster", "product_id").orderBy("since", "product_title")
    at = seen.withColumn("traits", X.title_traits(F.col("product_title"))).withColumn("was", F.lag("traits").over(w))
    first = F.col("was").isNull()
    at = at.withColumns({"overlap": F.when(~first, X.traits_overlap(F.col("was"), F.col("traits"))), "changed": F.when(~first, X.traits_changed(F.col("was"), F.col("traits")))})
    per = at.groupBy("roaster", "product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("since", "product_title"))), lambda s: s["product_title"]).alias("titles"), F.round(F.min("overlap"), 3).alias("title_similarity"), F.coalesce(F.bool_or((F.col("overlap") < 0.5) | F.col("changed")), F.lit(False)).alias("title_changed"), F.coalesce(F.bool_or("changed"), F.lit(False)).alias("process_or_lot_changed"))
    return per.select("roaster", "product_id", "titles", "title_similarity", "title_changed", "process_or_lot_changed")


def keyed_quarters(rows: DataFrame, keys: DataFrame, history: DataFrame) -> DataFrame:
    """One row per product, quarter and source: product_title, product_key, segment, segment_start_quarter, segment_start_date, title_changed, attributes_valid.

    keys: roaster, product_id, product_key. The titles of a product whose title has changed (see title_history)
    are cut where they mean another product; the first segment keeps the key, others add `@` and the quarter in
    which they begin. Attributes are those of the last segment. Archived rows of a quarter come before live ones;
    the title of a quarter is its most frequent, of equals the least.
    """
    by = ["roaster", "product_id"]
    title = F.expr("mode() within group (order by product_title)").alias("product_title")
    per = rows.where("product_id is not null").groupBy(*by, "quarter", "source_type").agg(title, F.min(F.substring("served_ts", 1, 8)).alias("first_date"))
    w = W.partitionBy(*by).orderBy("quarter", "source_type")
    at = per.join(history.select(*by, "title_changed"), by, "left").withColumn("title_changed", F.coalesce("title_changed", F.lit(False)))
    at = at.withColumn("traits", F.when(F.col("title_changed"), X.title_traits(F.col("product_title")))).withColumns({"prev": F.lag("product_title").over(w), "was": F.lag("traits").over(w)})
    other = (X.traits_overlap(F.col("was"), F.col("traits")) < 0.5) | X.traits_changed(F.col("was"), F.col("traits"))
    at = at.withColumn("new", F.when(F.col("title_changed") & (F.col("prev") != F.col("product_title")), other).otherwise(F.lit(False))).withColumn("new", F.coalesce("new", F.lit(False)))
    at = at.withColumn("segment", (F.sum(F.col("new").cast("int")).over(w) + 1).cast("int"))
    seg = W.partitionBy(*by, "segment").orderBy("quarter", "source_type").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = at.withColumns({"segment_start_quarter": F.first("quarter").over(seg), "start_date": F.first("first_date").over(seg), "last": F.max("segment").over(W.partitionBy(*by))})
    at = at.join(keys.select(*by, F.col("product_key").alias("base")), by)
    key = F.when(F.col("segment") > 1, F.concat("base", F.lit("@"), "segment_start_quarter")).otherwise(F.col("base"))
    day = F.when(F.length("start_date") >= 8, F.concat_ws("-", F.substring("start_date", 1, 4), F.substring("start_date", 5, 2), F.substring("start_date", 7, 2))).otherwise("")
    return at.select(*by, "quarter", "source_type", "product_title", key.alias("product_key"), "segment", "segment_start_quarter", day.alias("segment_start_date"), "title_changed", (~F.col("title_changed") | (F.col("segment") == F.col("last"))).alias("attributes_valid"))


def break_sides(products: DataFrame, breaks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(before, after): products of the quarter before each break and of the break's quarter, without ids that are on both sides.

    products: roaster, quarter, product_id, product_title; breaks: roaster, quarter. Quarters are observed ones.
    """
    seen = products.select("roaster", "quarter").distinct()
    w = W.partitionBy("roaster").orderBy("quarter")
    prior = seen.withColumn("before_quarter", F.lag("quarter").over(w)).join(breaks.select("roaster", "quarter").distinct(), ["roaster", "quarter"]).where("before_quarter is not null").withColumnRenamed("quarter", "break_quarter")
    one = products.groupBy("roaster", "quarter", "product_id").agg(F.min("product_title").alias("product_title"))
    before = prior.join(one.withColumnRenamed("quarter", "before_quarter"), ["roaster", "before_quarter"])
    after = prior.join(one.withColumnRenamed("quarter", "break_quarter"), ["roaster", "break_quarter"])
    keys = ["roaster", "break_quarter", "product_id"]
    return before.join(after.select(*keys), keys, "left_anti"), after.join(before.select(*keys), keys, "left_anti")


def exact_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """roaster, break_quarter, before_id, after_id of equal normalised titles, one to one: the nth of a title before with the nth after, by id."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        norm = df.withColumn("norm", X.norm_title(F.col("product_title")))
        return norm.withColumn("nth", F.row_number().over(W.partitionBy("roaster", "break_quarter", "norm").orderBy("product_id"))).select("roaster", "break_quarter", "norm", "nth", F.col("product_id").alias(name))

    return numbered(before, "before_id").join(numbered(after, "after_id"), ["roaster", "break_quarter", "norm", "nth"]).select("roaster", "break_quarter", "before_id", "after_id")


def _possible(a: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The greatest ratio to `a` that each string can have: 2 * longest common subsequence / both lengths, as matching blocks form such a subsequence.

    codes: a row of bytes per place, the strings' lengths falling. One bit per letter of `a`, in words of 64.
    """
    words = -(-len(a) // 64)
    masks = np.zeros((words, 256), np.uint64)
    for i, c in enumerate(a.encode()):
        masks[i >> 6, c] |= np.uint64(1 << (i & 63))
    v = np.full((words, len(lengths)), ~np.uint64(0))
    longer = np.searchsorted(-lengths, -np.arange(len(codes)))
    for column, n in zip(codes, longer):
        carry = np.zeros(n, np.uint64)
        for w in range(words):
            old = v[w, :n]
            u = old & masks[w][column[:n]]
            plain = old + u
            both = plain + carry
            carry = ((plain < u) | (both < carry)).astype(np.uint64)
            v[w, :n] = both | (old - u)
    common = np.zeros(len(lengths))
    for w in range(words):
        common += np.bitwise_count(~v[w] & np.uint64((1 << min(64, len(a) - 64 * w)) - 1))
    total = lengths + len(a)
    return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)


def _best(least: float, top: int):
    """The `top` most similar titles after of each title before, within the blocks of a batch. A pair is left unscored only if it can't be among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = difflib.SequenceMatcher(None)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                after = sorted(((x["id"], x["norm"]) for x in r.after), key=lambda x: -len(x[1]))
                lengths = np.array([len(x[1]) for x in after])
                many = len(after) > FEW
                if many:
                    codes = np.zeros((lengths[0], len(after)), np.uint8)
                    for i, x in enumerate(after):
                        codes[: lengths[i], i] = np.frombuffer(x[1].encode(), np.uint8)
                for x in r.before:
                    bound = _possible(x["norm"], codes, lengths) if many else np.ones(len(after))
                    found: list[tuple[float, str]] = []
                    match.set_seq1(x["norm"])
                    for i in np.argsort(-bound, kind="stable"):
                        if bound[i] < (found[-1][0] if len(found) == top else least):
                            break
                        match.set_seq2(after[i][1])
                        ratio = match.ratio()
                        if ratio >= least:
                            found = sorted([*found, (ratio, after[i][0])], reverse=True)[:top]
                    out += [(r.roaster, r.break_quarter, x["id"], i, q, round(q, 3)) for q, i in found]
            yield pd.DataFrame(out, columns=["roaster", "break_quarter", "before_id", "after_id", "ratio", "similarity"])

    return run


def candidate_pairs(before: DataFrame, after: DataFrame, least: float = CONFIG.min_similarity, top: int = CONFIG.top_k) -> DataFrame:
    """roaster, break_quarter, before_id, after_id, similarity, method: exact pairs, and for each other product before the `top` most similar ones after, at `least` similar.

    Every pair of a break counts. Both sides are cut into blocks by id, each pair of blocks is a row of its own,
    and its best are found with an upper bound of the ratio. Ties go to the greater id.
    """
    keys = ["roaster", "break_quarter"]
    side = lambda df, first: df.select(*keys, "product_id", "product_title", F.lit(first).alias("first"))
    sides, _ = Scratch(before.sparkSession, "sides").write(side(before, True).unionByName(side(after, False)))
    before, after = (sides.where(F.col("first") == first).drop("first") for first in (True, False))
    exact = exact_pairs(before, after)

    def blocks(df: DataFrame, used: str, size: int, name: str) -> DataFrame:
        left = df.join(exact.select(*keys, F.col(used).alias("product_id")), [*keys, "product_id"], "left_anti")
        left = left.select(*keys, F.col("product_id").alias("id"), X.norm_title(F.col("product_title")).alias("norm"))
        n = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("n"))
        cut = left.join(n, keys).withColumn(f"{name}_block", F.expr("pmod(xxhash64(id), n)"))
        return cut.groupBy(*keys, f"{name}_block").agg(F.collect_list(F.struct("id", "norm")).alias(name))

    met = blocks(before, "before_id", BLOCK_BEFORE, "before").join(blocks(after, "after_id", BLOCK_AFTER, "after"), keys)
    spread = met.repartition(int(before.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "before_block", "after_block")
    scored = spread.select(*keys, "before", "after").mapInPandas(_best(least, top), "roaster string, break_quarter string, before_id string, after_id string, ratio double, similarity double")
    best = scored.withColumn("r", F.row_number().over(W.partitionBy(*keys, "before_id").orderBy(F.desc("ratio"), F.desc("after_id")))).where(F.col("r") <= top)
    near = best.select(*keys, "before_id", "after_id", "similarity", F.lit("similar").alias("method"))
    return exact.select(*keys, "before_id", "after_id", F.lit(1.0).alias("similarity"), F.lit("exact_title").alias("method")).unionByName(near)


def live_breaks(rows: DataFrame, below: float = CONFIG.id_break_below) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(breaks, before, after) between each seller's last archived quarter and its live catalogue, by product id.

    breaks: roaster, before_quarter, carryover (the share of the archived ids that are still live, 3 digits) and
    is_break; before and after: the products of one side only, with break_quarter (the live quarter and `-live`)
    and before_quarter, for breaks only.
    """
    arch = rows.where((F.col("source_type") == "archive") & ~F.coalesce("served_outside_quarter", F.lit(False)) & F.col("product_id").isNotNull())
    live = rows.where((F.col("source_type") == "live") & F.col("product_id").isNotNull())
    last = arch.groupBy("roaster").agg(F.max("quarter").alias("quarter"))
    old = arch.join(last, ["roaster", "quarter"]).groupBy("roaster", "product_id").agg(F.min("product_title").alias("product_title"), F.max("quarter").alias("before_quarter"))
    new = live.groupBy("roaster", "product_id").agg(F.min("product_title").alias("product_title"), F.min("quarter").alias("lq"))
    both = old.join(new.select("roaster", "product_id", F.lit(1).alias("there")), ["roaster", "product_id"], "left")
    share = both.groupBy("roaster", "before_quarter").agg((F.count("there") / F.count(F.lit(1))).alias("share")).join(new.groupBy("roaster").agg(F.min("lq").alias("lq")), "roaster")
    breaks = share.select("roaster", "before_quarter", F.round("share", 3).alias("carryover"), (F.col("share") < below).alias("is_break"), F.concat("lq", F.lit("-live")).alias("break_quarter"))
    cut = breaks.where("is_break").select("roaster", "before_quarter", "break_quarter")
    keys = ["roaster", "product_id"]
    before = old.join(new.select(*keys), keys, "left_anti").drop("before_quarter").join(cut, "roaster")
    after = new.join(old.select(*keys), keys, "left_anti").drop("lq").join(cut, "roaster")
    return breaks.drop("break_quarter"), before, after


def all_candidates(archived: tuple[DataFrame, DataFrame], live: tuple[DataFrame, DataFrame], top: int = CONFIG.top_k) -> DataFrame:
    """pair_ref, roaster, break_quarter, before_quarter, before_id, after_id, similarity, method: candidates of the archived breaks, then those of the live ones, numbered p1, p2 .. in that order.

    Within each: by roaster and break, exact titles first, then by product before, best first, so that the
    numbers of archived pairs stay when live breaks are added. Numbers come from counts per break.
    """
    parts = []
    for i, (before, after) in enumerate((archived, live)):
        quarters = before.select("roaster", "break_quarter", "before_quarter").distinct()
        parts.append(candidate_pairs(before, after, top=top).join(quarters, ["roaster", "break_quarter"]).withColumn("late", F.lit(i)))
    pairs, _ = Scratch(archived[0].sparkSession, "pairs").write(parts[0].unionByName(parts[1]))
    by = ["late", "roaster", "break_quarter"]
    counts = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    start = counts.withColumn("start", F.sum("n").over(W.orderBy(*by)) - F.col("n")).drop("n")  # a row per break
    order = W.partitionBy(*by).orderBy((F.col("method") != "exact_title").cast("int"), "before_id", F.desc("similarity"), F.desc("after_id"))
    numbered = pairs.join(start, by).withColumn("i", F.row_number().over(order) + F.col("start"))
    return numbered.select(F.concat(F.lit("p"), F.col("i").cast("string")).alias("pair_ref"), "roaster", "break_quarter", "before_quarter", "before_id", "after_id", "similarity", "method")


def resolve_pairs(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """pairs with same_product, confidence, reason and status.

    decisions: pair_ref, same_product, confidence, reason, one per pair at most. Exact titles are linked by rule.
    Without a decision a pair is `no_decision`, with a doubtful one in `review`, else linked or rejected; linked
    pairs that share a product with another linked one are `conflict`.
    """
    d = decisions.select("pair_ref", F.col("same_product").alias("sp"), F.col("confidence").alias("co"), F.col("reason").alias("re"))
    exact = F.col("method") == "exact_title"
    said = {"same_product": ("yes", "sp"), "confidence": ("high", "co"), "reason": ("identical title after normalising", "re")}
    p = pairs.drop(*said, "status").join(d, "pair_ref", "left").withColumns({c: F.when(exact, F.lit(v)).otherwise(F.coalesce(x, F.lit(""))) for c, (v, x) in said.items()}).drop("sp", "co", "re")
    status = F.when(F.col("same_product") == "", "no_decision").when(F.col("confidence") == "low", "review").when(F.col("same_product") == "yes", "linked").otherwise("rejected")
    return resolve_conflicts(p.withColumn("status", status))


def apply_human(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """pairs with human_decision (`yes`, `no` or blank): what a person decided (roaster, before_id, after_id, your_decision) overrides all else."""
    said = F.lower(F.trim("your_decision"))
    r = reviews.where(said.isin("yes", "no")).groupBy("roaster", "before_id", "after_id").agg(F.max(said).alias("__h"))
    p = pairs.drop("human_decision").join(r, ["roaster", "before_id", "after_id"], "left").withColumn("human_decision", F.coalesce("__h", F.lit(""))).drop("__h")
    return p.withColumn("status", F.when(F.col("human_decision") == "yes", "linked_human").when(F.col("human_decision") == "no", "rejected_human").otherwise(F.col("status")))


def needs_review(pairs: DataFrame) -> DataFrame:
    """Pairs that need a person, and those that one has decided, with your_decision to be filled in."""
    open_ = F.col("status").isin("review", "conflict", "no_decision") | (F.coalesce("human_decision", F.lit("")) != "")
    return pairs.where(open_).withColumn("your_decision", F.col("human_decision"))


def link_provenance(products: DataFrame, keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """products (roaster, product_id, ..) with product_key and, from the links to it, linked_from_product_id, link_method, link_confidence and link_reason, several joined by ` | ` in order of the pairs' ids."""
    linked = pairs.where(F.col("status").isin("linked", "linked_human"))
    rows = F.array_sort(F.collect_list(F.struct("before_id", "method", "confidence", "reason")))
    via = linked.groupBy("roaster", F.col("after_id").alias("product_id")).agg(rows.alias("l"), F.bool_or(F.col("status") == "linked_human").alias("human"))
    text = lambda f: F.array_join(F.transform("l", lambda r: r[f]), " | ")
    out = products.join(keys.select("roaster", "product_id", "product_key"), ["roaster", "product_id"]).join(via, ["roaster", "product_id"], "left")
    human = F.coalesce("human", F.lit(False))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return out.withColumns({
        "linked_from_product_id": blank(text("before_id")), "link_method": F.when(human, "human").otherwise(blank(F.array_join(F.array_sort(F.array_distinct(F.transform("l", lambda r: r["method"]))), " | "))),
        "link_confidence": F.when(human, "human").otherwise(blank(text("confidence"))), "link_reason": blank(text("reason")),
    }).drop("l", "human")


def resolve_conflicts(pairs: DataFrame, linked: str = "linked") -> DataFrame:
    """pairs with status `conflict` in place of `linked` where an id is linked to two others."""
    by = lambda c: F.count(F.when(F.col("status") == linked, 1)).over(W.partitionBy("roaster", c))
    twice = (F.col("status") == linked) & ((by("before_id") > 1) | (by("after_id") > 1))
    return pairs.withColumn("status", F.when(twice, "conflict").otherwise(F.col("status")))


def product_keys(products: DataFrame, links: DataFrame) -> DataFrame:
    """roaster, product_id, product_key: `slug:id` of the id of a linked group that was seen first (of equals the smaller).

    products: roaster, product_id, first_quarter; links: roaster, before_id, after_id. The least member moves
    along the links, and with each round to the least member of that one, until nothing changes.
    """
    scratch = Scratch(products.sparkSession, "keys")
    own = F.struct(F.coalesce("first_quarter", F.lit("")).alias("q"), F.col("product_id").alias("id"))
    state, seen = scratch.write(products.select("roaster", "product_id", own.alias("best")))
    e = links.select("roaster", F.col("before_id").alias("x"), F.col("after_id").alias("y")).where("x <> y")
    e, _ = scratch.write(e.unionByName(e.select("roaster", F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    while True:
        near = e.join(state.select("roaster", F.col("product_id").alias("x"), "best"), ["roaster", "x"]).select("roaster", F.col("y").alias("product_id"), "best")
        least = state.select("roaster", "product_id", "best").unionByName(near).groupBy("roaster", "product_id").agg(F.min("best").alias("best"))
        jump = least.select(F.col("roaster").alias("r"), F.col("product_id").alias("pid"), F.col("best").alias("further"))
        j = least.join(jump, (F.col("roaster") == F.col("r")) & (F.col("best.id") == F.col("pid")), "left").select("roaster", "product_id", F.least("best", F.coalesce("further", "best")).alias("best"))
        was = state.select("roaster", "product_id", F.col("best").alias("was"))
        nxt, seen = scratch.write(j.join(was, ["roaster", "product_id"]).select("roaster", "product_id", "best", (F.col("best") < F.col("was")).alias("moved")), {"moved": F.count_if("moved")})
        scratch.drop(state)
        state = nxt
        if not seen["moved"]:
            return state.select("roaster", "product_id", F.concat(X.slugify(F.col("roaster")), F.lit(":"), F.col("best.id")).alias("product_key"))
