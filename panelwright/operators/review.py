"""Extracted attributes: the text shown, rules applied afterwards, what a person must look at, and how good the answers are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import text as X

#: Allowed values of each attribute; those without a list are free text (fixed values).
ALLOWED: dict[str, list[str] | None] = {
    "is_coffee": ["yes", "no"],
    "origin_country": None,
    "region": None,
    "estate": None,
    "species": ["arabica", "robusta", "blend", "other", "unknown"],
    "origin_type": ["single_origin", "blend", "unknown"],
    "process": ["washed", "natural", "honey", "monsooned", "experimental", "mixed", "unknown"],
    "roast_level": ["light", "light_medium", "medium", "medium_dark", "dark", "omni", "unknown"],
    "decaf": ["yes", "no", "unknown"],
    "flavoured_infused": ["yes", "no", "unknown"],
}
#: What a text must say for a `no` to be one (fixed values).
REAL_NO = {
    "flavoured_infused": r"\b(unflavou?red|no (added |artificial )*flavou?r(s|ing)?|without (any )?(added |artificial )*flavou?r(s|ing)?|free (from|of) (added |artificial )*flavou?r(s|ing)?|no additives|additive[- ]free)\b",
    "decaf": r"\b(caffeinated|not decaf(feinated)?|regular caffeine|full[- ]caffeine)\b",
}
#: Places that lie in India (fixed values).
INDIAN_REGIONS = [
    "araku valley", "assam", "baba budan giri", "biligirirangan hills", "chikkamagaluru", "chikmagalur", "coorg", "gandha", "karnataka", "khasi hills", "kohima",
    "kolasib, mizoram", "malabar", "nilgiri", "nilgiris", "paderu", "sakleshpur", "thandigudi", "valparai", "zora, mizoram",
]
#: Parts of a product's text and how they are introduced (fixed values).
PARTS = [("Title", "product_title"), ("Earlier titles", "other_titles"), ("Product type", "product_type"), ("Variants", "variant_titles"), ("Listing card", "card_text"), ("Description", "description")]
#: Fields that are nearly always unknown say little of how good answers are (fixed values).
UNINFORMATIVE = ("decaf", "flavoured_infused")
_SHORT = [("earlier titles", "other_titles", 150), ("type", "product_type", 60), ("variants", "variant_titles", 200), ("card", "card_text", 200), ("description", "description", 400)]


def _said(c: str) -> Column:
    x = F.col(c).cast("string")
    return F.when((F.coalesce(x, F.lit("")) != "") & (x != "nan"), x)


def _true(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "true"


def product_text() -> Column:
    """The text of a product that attributes are taken from, a line per part that is there; earlier titles are left out where the title has changed to another product."""
    lines = [F.when(~_true("title_changed") if c == "other_titles" else F.lit(True), F.concat(F.lit(f"{label}: "), _said(c))) for label, c in PARTS]
    return F.concat_ws("\n", *lines)


def describe() -> Column:
    """A product in one line, its parts cut, for the comparison of two."""
    parts = [F.concat(F.lit(f"{label}: "), F.substring(_said(c), 1, n)) for label, c, n in _SHORT]
    return F.concat_ws("; ", F.concat(F.lit("title: "), F.coalesce("product_title", F.lit(""))), *parts)


def prompts(rows: DataFrame, head: str, block: Column, order: str, batch: int) -> DataFrame:
    """batch, refs, prompt: blocks of up to `batch` rows in the given order below a common head. rows: ref and what `block` needs."""
    from pyspark.sql.window import Window as W

    numbered = rows.select("ref", block.alias("b"), (F.floor((F.row_number().over(W.orderBy(order, "ref")) - 1) / batch)).alias("batch"))  # products to ask for, few by the calls allowed
    held = numbered.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("ref", "b"))).alias("x"))
    return held.select("batch", F.transform("x", lambda r: r["ref"]).alias("refs"), F.concat_ws("\n\n", F.lit(head), F.array_join(F.transform("x", lambda r: r["b"]), "\n\n")).alias("prompt"))


def origin_type(title: Column, text: Column, estate: Column, answer: Column) -> Column:
    """struct(value, rule): a blend by its title, a single origin by a named estate or by its text, else as answered."""
    blend = F.coalesce(title, F.lit("")).rlike(r"(?i)\bblend\b")
    single = ~X.is_unknown(estate) | F.coalesce(text, F.lit("")).rlike(r"(?i)\bsingle[- ](origin|estate)\b")
    said = F.coalesce(F.nullif(answer, F.lit("")), F.lit("unknown"))
    both = lambda v, r: F.struct((v if isinstance(v, Column) else F.lit(v)).alias("value"), F.lit(r).alias("rule"))
    return F.when(blend, both("blend", "title says blend")).when(single, both("single_origin", "named estate or 'single origin' in text")).otherwise(both(said, "model value"))


def postprocess(answers: DataFrame) -> DataFrame:
    """answers after the rules: failed ones all unknown; a `no` to decaf or flavoured only with text that says so; origin_type_analysis and its rule; rules_applied.

    answers: status, product_title, text and of each attribute f the columns f, f_confidence, f_evidence. What
    was answered stays in f_model and f_evidence_model and is what the rules read, so that applying them twice
    changes nothing.
    """
    failed, out, notes = ~F.coalesce(F.col("status").startswith("ok"), F.lit(False)), answers, []
    for f in ALLOWED:
        parts = {f: "unknown", f"{f}_confidence": "", f"{f}_evidence": ""}
        keep = {c: F.when(failed, F.lit(v)).otherwise(F.col(c)) for c, v in parts.items()}
        if f in REAL_NO:
            for c, model in ((f, f"{f}_model"), (f"{f}_evidence", f"{f}_evidence_model")):
                if model not in answers.columns:
                    out = out.withColumn(model, keep[c])
            empty = (F.col(f"{f}_model") == "no") & ~F.coalesce(F.col(f"{f}_evidence_model"), F.lit("")).rlike(f"(?i){REAL_NO[f]}")
            bare = ~failed & F.coalesce(empty, F.lit(False))
            keep = {f: F.when(failed | bare, F.lit("unknown")).otherwise(F.col(f"{f}_model")), f"{f}_evidence": F.when(failed | bare, F.lit("")).otherwise(F.col(f"{f}_evidence_model")), f"{f}_confidence": F.when(failed | bare, F.lit("")).otherwise(F.col(f"{f}_confidence"))}
            notes.append(F.when(bare, F.lit(f"{f} 'no' without real evidence -> unknown")))
        out = out.withColumns(keep)
    kind = origin_type(F.col("product_title"), F.col("text"), F.col("estate"), F.col("origin_type"))
    applied = F.concat_ws("; ", F.when(failed, F.lit("failed validation twice: all unknown")), *notes)
    return out.withColumns({"origin_type_analysis": kind["value"], "origin_type_analysis_rule": kind["rule"], "rules_applied": applied})


def raw_output(answers: DataFrame) -> DataFrame:
    """answers as they were before the rules, those that failed blank, so that they count as wrong."""
    failed = ~F.coalesce(F.col("status").startswith("ok"), F.lit(False))
    model = lambda f: F.col(f"{f}_model") if f"{f}_model" in answers.columns else F.col(f)
    return answers.withColumns({f: F.when(failed, F.lit("")).otherwise(model(f)) for f in ALLOWED})


def review_rows(answers: DataFrame) -> DataFrame:
    """roaster, product_id, product_title, reasons: products that a person must look at. A doubtful `unknown` asserts nothing and is none."""
    low = F.array_compact(F.array(*[F.when((F.col(f"{f}_confidence") == "low") & ~X.is_unknown(F.col(f)), F.lit(f)) for f in ALLOWED]))
    reasons = F.concat_ws(
        "; ", F.when(~F.coalesce(F.col("status").startswith("ok"), F.lit(False)), F.lit("extraction failed validation twice (see review_queue.jsonl)")),
        F.when(_true("title_changed"), F.lit("title changed within this product ID (possible page reuse)")), F.when(F.size(low) > 0, F.concat(F.lit("low confidence: "), F.array_join(low, ", "))),
    )
    return answers.select("roaster", "product_id", "product_title", reasons.alias("reasons")).where("reasons <> ''")


def fields_of_answers(fields: list[str] | None = None) -> dict[str, str]:
    """name -> how answers are compared, for validation.field_scores."""
    return {f: "place" if f == "region" else "closed" if ALLOWED[f] else "free" for f in (fields or ALLOWED)}


def agreement(a: DataFrame, b: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """field, n, agreement: of what is `ok` in both of two runs, the share with the same answer."""
    side = lambda df, end: df.where("status = 'ok'").select(*keys, *[F.col(f).alias(f"{f}__{end}") for f in fields])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), X.same_answer(F.col(f"{f}__a"), F.col(f"{f}__b"), free=k != "closed", contains=k == "place").alias("same")) for f, k in fields.items()])
    return side(a, "a").join(side(b, "b"), keys).select(F.explode(cells).alias("c")).groupBy("c.field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("c.same").cast("int")), 3).alias("agreement"))


def with_headline(scores: DataFrame, uninformative: tuple[str, ...] = UNINFORMATIVE) -> DataFrame:
    """scores (see validation.field_scores) and a row with the mean accuracy of the informative fields."""
    head = scores.where(~F.col("field").isin(*uninformative)).agg(F.round(F.avg("accuracy"), 4).alias("accuracy"), F.count(F.lit(1)).alias("k"))
    head = head.select(F.concat(F.lit("MEAN of "), F.col("k").cast("string"), F.lit(" informative fields (headline)")).alias("field"), "accuracy")
    return scores.unionByName(head, allowMissingColumns=True)


def label_problems(labelled: DataFrame, original: DataFrame, allowed: dict[str, list[str] | None] = ALLOWED, keys: tuple[str, ...] = ("product_id", "roaster")) -> DataFrame:
    """label_id, problem: rows missing or unknown, keys that were changed, blanks, and values that are not allowed; nothing if all is well."""
    if missing := [c for c in original.columns if c not in labelled.columns]:
        return labelled.sparkSession.createDataFrame([(None, f"missing columns: {missing}")], "label_id string, problem string")
    o = original.select(F.col("label_id").alias("__id"), *[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias("__there"))
    j = labelled.join(o, F.col("label_id") == F.col("__id"), "left")
    there = F.col("__there").isNotNull()
    found = [F.when(~there, F.lit("not in the original sample"))]
    found += [F.when(there & ~F.col(k).eqNullSafe(F.col(f"__{k}")), F.concat(F.lit(f"{k} is "), F.coalesce(k, F.lit("blank")), F.lit(", expected "), F.coalesce(f"__{k}", F.lit("blank")))) for k in keys]
    for f, values in allowed.items():
        v = F.trim(F.coalesce(F.col(f), F.lit("")))
        bad = F.when(v == "", F.lit(f"{f} is blank"))
        if values:
            bad = bad.when(~F.lower(v).isin(*values), F.concat(F.lit(f"{f} = "), v, F.lit(" is not allowed")))
        found.append(F.when(there, bad))
    rows = j.select("label_id", F.explode(F.array_compact(F.array(*found))).alias("problem"))
    n = labelled.agg(F.count(F.lit(1)).alias("a")).crossJoin(F.broadcast(original.agg(F.count(F.lit(1)).alias("b"))))  # one row each
    count = n.where("a <> b").select(F.lit(None).cast("string").alias("label_id"), F.concat(F.col("a").cast("string"), F.lit(" rows, expected "), F.col("b").cast("string")).alias("problem"))
    return rows.select(F.col("label_id").cast("string").alias("label_id"), "problem").unionByName(count)


def india_rule(labels: DataFrame, region: str = "region", country: str = "origin_country") -> DataFrame:
    """labels with country `India` where the region is an Indian place and the country unknown, and rule: `set`, `conflict` (another country stands there and stays) or null."""
    c = F.lower(F.trim(F.coalesce(F.col(country), F.lit(""))))
    rule = F.when(F.lower(F.trim(F.coalesce(F.col(region), F.lit("")))).isin(*INDIAN_REGIONS), F.when(c == "unknown", "set").when(c != "india", "conflict"))
    return labels.withColumn("rule", rule).withColumn(country, F.when(F.col("rule") == "set", "India").otherwise(F.col(country)))


def stale_answers(products: DataFrame, below: float = 0.5) -> DataFrame:
    """Products whose text held earlier titles of another product when they were asked for: the title changed by its process or lot only."""
    return products.where(_true("title_changed") & (F.col("title_similarity") >= below))


def replace_answers(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """old with the answers of fresh in place of its own, also in the f_model columns, and marked as reextracted; other columns stay."""
    mine = [c for c in fresh.columns if c not in keys and c in old.columns]
    new = {**{c: F.col(f"__f.{c}") for c in mine}, **{f"{f}_model": F.col(f"__f.{f}") for f in REAL_NO if f in mine}, **{f"{f}_evidence_model": F.col(f"__f.{f}_evidence") for f in REAL_NO if f"{f}_evidence" in mine}}
    base = old if "reextracted" in old.columns else old.withColumn("reextracted", F.lit(""))
    for c in new:
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("string"))
    j = base.join(fresh.select(*keys, F.struct(*[F.col(c) for c in fresh.columns if c not in keys]).alias("__f")), keys, "left")
    got = F.col("__f").isNotNull()
    return j.withColumns({c: F.when(got, v).otherwise(F.col(c)) for c, v in new.items()} | {"reextracted": F.when(got, "True").otherwise(F.col("reextracted"))}).drop("__f")


def contingency(rows: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """by and a count per kind, zeros included."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def reason_counts(reviews: DataFrame) -> DataFrame:
    """reason, n: how often each reason, without its details, is given."""
    one = reviews.select(F.explode(F.split("reasons", "; ")).alias("r")).select(F.split("r", ":").getItem(0).alias("reason"))
    return one.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
