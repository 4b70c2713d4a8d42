"""Queries of the operators on extracted attributes: answers made from titles stand in for a provider's."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.ids import digits_id
from panelwright.operators import review as V
from panelwright.operators import validation as VA
from panelwright.plans.panel_queries import _t

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_CLOSED = {
    "process": [("washed", "washed"), ("natural", "natural"), ("honey", "honey"), ("monsoon", "monsooned"), ("anaerobic", "experimental")],
    "roast_level": [("medium[- ]dark|med dark", "medium_dark"), ("light", "light"), ("dark", "dark"), ("medium|mid", "medium")],
}


def _case(field: str, t: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({t}), '{p}') THEN '{v}'" for p, v in _CLOSED[field]) + " ELSE 'unknown' END"


_NO = "CASE WHEN method = 'exact_title' THEN 'no' ELSE 'unknown' END"
_EVIDENCE = "CASE WHEN status LIKE '%linked%' THEN 'no added flavours, not decaf' ELSE before_title END"
ANSWERS = f"""ans AS (SELECT pair_ref, roaster, regexp_extract(before_id, '[0-9]{{13}}') AS product_id, CASE WHEN same_product IS NULL THEN 'invalid_or_missing' WHEN confidence = 'low' THEN 'ok_after_retry' ELSE 'ok' END AS status, coalesce(before_title, '') AS product_title, coalesce(reason, '') AS text, similarity < 0.6 AS title_changed,
  'yes' AS is_coffee, 'unknown' AS origin_country, 'unknown' AS region, CASE WHEN before_title LIKE '%Estate%' THEN 'x' ELSE 'unknown' END AS estate, 'arabica' AS species, 'blend' AS origin_type, {_case('process', "coalesce(before_title, '')")} AS process, {_case('roast_level', "coalesce(before_title, '')")} AS roast_level, {_NO} AS decaf, {_NO} AS flavoured_infused,
  {_EVIDENCE} AS evidence, coalesce(confidence, '') AS confidence FROM match_candidates)"""


def _answers(spark, d):
    m = _t(spark, d, "match_candidates")
    title = F.coalesce("before_title", F.lit(""))

    def closed(field):
        out = None
        for p, v in _CLOSED[field]:
            out = (F.when if out is None else out.when)(F.lower(title).rlike(p), v)
        return out.otherwise("unknown")

    no = F.when(F.col("method") == "exact_title", "no").otherwise("unknown")
    values = {"is_coffee": F.lit("yes"), "origin_country": F.lit("unknown"), "region": F.lit("unknown"), "estate": F.when(F.col("before_title").contains("Estate"), "x").otherwise("unknown"), "species": F.lit("arabica"), "origin_type": F.lit("blend"), "process": closed("process"), "roast_level": closed("roast_level"), "decaf": no, "flavoured_infused": no}
    evidence = F.when(F.col("status").contains("linked"), "no added flavours, not decaf").otherwise(F.col("before_title"))
    status = F.when(F.col("same_product").isNull(), "invalid_or_missing").when(F.col("confidence") == "low", "ok_after_retry").otherwise("ok")
    out = m.select("pair_ref", "roaster", digits_id(F.col("before_id"), 13).alias("product_id"), status.alias("status"), title.alias("product_title"), F.coalesce("reason", F.lit("")).alias("text"), (F.col("similarity") < 0.6).alias("title_changed"), *[c.alias(f) for f, c in values.items()], *[F.coalesce("confidence", F.lit("")).alias(f"{f}_confidence") for f in values], *[evidence.alias(f"{f}_evidence") for f in values])
    return out


_REAL = {f: p.replace("'", "''") for f, p in V.REAL_NO.items()}
POST = f"""{ANSWERS}, post AS (SELECT *, NOT starts_with(status, 'ok') AS failed, status LIKE 'ok%' AND decaf = 'no' AND NOT regexp_matches(coalesce(evidence, ''), '(?i){_REAL['decaf']}') AS bd, status LIKE 'ok%' AND flavoured_infused = 'no' AND NOT regexp_matches(coalesce(evidence, ''), '(?i){_REAL['flavoured_infused']}') AS bf FROM ans)"""


@query(f"""WITH {POST} SELECT pair_ref, CASE WHEN failed THEN 'unknown' ELSE process END AS process, CASE WHEN failed OR bd THEN 'unknown' ELSE decaf END AS decaf, CASE WHEN failed OR bf THEN 'unknown' ELSE flavoured_infused END AS flavoured_infused, CASE WHEN failed OR bd THEN '' ELSE evidence END AS decaf_evidence,
  CASE WHEN regexp_matches(product_title, '(?i)\\bblend\\b') THEN 'blend' WHEN (NOT failed AND estate <> 'unknown') OR regexp_matches(text, '(?i)\\bsingle[- ](origin|estate)\\b') THEN 'single_origin' WHEN failed THEN 'unknown' ELSE origin_type END AS origin_type_analysis,
  concat_ws('; ', CASE WHEN failed THEN 'failed validation twice: all unknown' END, CASE WHEN bd THEN 'decaf ''no'' without real evidence -> unknown' END, CASE WHEN bf THEN 'flavoured_infused ''no'' without real evidence -> unknown' END) AS rules_applied FROM post""")
def postprocess_rules(spark, d):
    once = V.postprocess(_answers(spark, d))
    return V.postprocess(once).select("pair_ref", "process", "decaf", "flavoured_infused", "decaf_evidence", "origin_type_analysis", "rules_applied")


@query(f"""WITH {POST}, l AS (SELECT *, list_filter([CASE WHEN confidence = 'low' THEN 'is_coffee' END, CASE WHEN confidence = 'low' AND estate <> 'unknown' THEN 'estate' END, CASE WHEN confidence = 'low' THEN 'species' END, CASE WHEN confidence = 'low' THEN 'origin_type' END, CASE WHEN confidence = 'low' AND process <> 'unknown' THEN 'process' END,
  CASE WHEN confidence = 'low' AND roast_level <> 'unknown' THEN 'roast_level' END, CASE WHEN confidence = 'low' AND decaf <> 'unknown' AND NOT bd THEN 'decaf' END, CASE WHEN confidence = 'low' AND flavoured_infused <> 'unknown' AND NOT bf THEN 'flavoured_infused' END], lambda x: x IS NOT NULL) AS low FROM post),
r AS (SELECT roaster, nullif(product_id, '') AS product_id, product_title, concat_ws('; ', CASE WHEN failed THEN 'extraction failed validation twice (see review_queue.jsonl)' END, CASE WHEN title_changed THEN 'title changed within this product ID (possible page reuse)' END, CASE WHEN NOT failed AND len(low) > 0 THEN 'low confidence: ' || array_to_string(low, ', ') END) AS reasons FROM l)
SELECT * FROM r WHERE reasons <> ''""")
def review_list(spark, d):
    return V.review_rows(V.postprocess(_answers(spark, d)))


def _two(spark, d):
    m = _t(spark, d, "match_candidates").select("pair_ref", "before_title", "after_title")
    make = lambda c: m.select("pair_ref", F.lit("ok").alias("status"), F.coalesce(c, F.lit("")).alias("estate"), F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), "(washed|natural|honey)", 1).alias("process"), F.when(F.col(c).isNull(), "unknown").otherwise(F.col(c)).alias("region"))
    return make("before_title"), make("after_title")


def _place(t: str) -> str:
    fill = "'estate', 'estates', 'farm', 'farms', 'plantation', 'district', 'the'"
    return f"array_to_string(list_filter(string_split(trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({fill})), ' ')"


_PAIRS = f"""s AS (SELECT coalesce(before_title, '') AS b, coalesce(after_title, '') AS a, coalesce(before_title, 'unknown') AS rb, coalesce(after_title, 'unknown') AS ra FROM match_candidates),
n AS (SELECT *, {_place('b')} AS nb, {_place('a')} AS na, {_place('rb')} AS nrb, {_place('ra')} AS nra, regexp_extract(lower(b), '(washed|natural|honey)', 1) AS pb, regexp_extract(lower(a), '(washed|natural|honey)', 1) AS pa, trim(lower(rb)) IN ('', 'unknown') AS ub, trim(lower(ra)) IN ('', 'unknown') AS ua FROM s),
x AS (SELECT 'estate' AS field, nb = na AS same, trim(lower(b)) NOT IN ('', 'unknown') AS known, trim(lower(a)) NOT IN ('', 'unknown') AS said FROM n UNION ALL SELECT 'process', pb = pa, pb <> '', pa <> '' FROM n
  UNION ALL SELECT 'region', nrb = nra OR (NOT ub AND NOT ua AND nrb <> '' AND nra <> '' AND (contains(' ' || nra || ' ', ' ' || nrb || ' ') OR contains(' ' || nrb || ' ', ' ' || nra || ' '))), NOT ub, NOT ua FROM n)"""
_KINDS = {"estate": "free", "process": "closed", "region": "place"}


@query(f"WITH {_PAIRS} SELECT field, count(*) AS n, round(avg(same::INT), 3) AS agreement FROM x GROUP BY 1")
def run_agreement(spark, d):
    return V.agreement(*_two(spark, d), ["pair_ref"], _KINDS)


@query(f"""WITH {_PAIRS}, f AS (SELECT field, count(*) AS n, round(avg(same::INT), 3) AS accuracy, count(*) FILTER (WHERE known) AS gold_known, round(avg(same::INT) FILTER (WHERE known), 3) AS found, round(avg(said::INT) FILTER (WHERE NOT known), 3) AS invented FROM x GROUP BY 1)
SELECT * FROM f UNION ALL SELECT 'MEAN of ' || count(*) || ' informative fields (headline)', NULL, round(avg(accuracy), 4), NULL, NULL, NULL FROM f""")
def accuracy_report(spark, d):
    """How well the titles after a rebuild say what those before it said, by field, with the mean of all fields."""
    gold, said = _two(spark, d)
    return V.with_headline(VA.field_scores(gold.drop("status"), said.drop("status"), ["pair_ref"], _KINDS))


@query("""WITH l AS (SELECT pair_ref AS label_id, roaster, before_id AS product_id, CASE WHEN status LIKE '%human%' THEN 'someone' ELSE roaster END AS r2, coalesce(same_product, '') AS a, coalesce(confidence, '') AS c FROM match_candidates),
p AS (SELECT label_id, CASE WHEN r2 <> roaster THEN 'roaster is ' || r2 || ', expected ' || roaster END AS x, CASE WHEN trim(a) = '' THEN 'same_product is blank' WHEN lower(trim(a)) NOT IN ('yes', 'no') THEN 'same_product = ' || trim(a) || ' is not allowed' END AS y, CASE WHEN trim(c) = '' THEN 'confidence is blank' WHEN lower(trim(c)) NOT IN ('high', 'medium') THEN 'confidence = ' || trim(c) || ' is not allowed' END AS z FROM l)
SELECT label_id, x AS problem FROM p WHERE x IS NOT NULL UNION ALL SELECT label_id, y FROM p WHERE y IS NOT NULL UNION ALL SELECT label_id, z FROM p WHERE z IS NOT NULL""")
def label_problems(spark, d):
    """Faults of recorded judgements, read as a label sheet in which some roasters were changed by hand."""
    m = _t(spark, d, "match_candidates").select(F.col("pair_ref").alias("label_id"), F.col("before_id").alias("product_id"), "roaster", "same_product", "confidence", "status")
    edited = m.withColumn("roaster", F.when(F.col("status").like("%human%"), "someone").otherwise(F.col("roaster"))).drop("status")
    return V.label_problems(edited, m.drop("status"), {"same_product": ["yes", "no"], "confidence": ["high", "medium"]})


@query("""SELECT roaster, count(*) FILTER (WHERE s = 'linked') AS linked, count(*) FILTER (WHERE s = 'rejected') AS rejected, count(*) FILTER (WHERE s = 'review') AS review FROM (SELECT roaster, lower(trim(status)) AS s FROM match_candidates) GROUP BY 1""")
def status_contingency(spark, d):
    return V.contingency(_t(spark, d, "match_candidates").withColumn("s", F.lower(F.trim("status"))), "roaster", "s", ["linked", "rejected", "review"])
