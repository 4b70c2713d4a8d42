"""Queries of the tracker's tables and of matching over catalogue rebuilds."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.ids import digits_id
from panelwright.operators import identity as I
from panelwright.plans.keyed_queries import LINES, _lines, _step_sql
from panelwright.plans.panel_queries import PANEL, _panel, _t
from panelwright.session import Scratch
from panelwright.streaming import tracker as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


MONTHLY = f"""{LINES},
coffee AS (SELECT l.* REPLACE (quantity AS size_grams), quarter AS month, coalesce(p.p_size > 40, true) AND p.p_size <= 45 AS attributes_pending, price_inr / quantity * 100 AS ppg FROM lines l JOIN part p ON p.p_partkey::VARCHAR = l.product_id
  WHERE CASE WHEN p.p_size <= 40 THEN true WHEN p.p_size > 45 THEN false ELSE coalesce(is_coffee_guess, false) END AND coalesce(is_coffee_guess, true) AND NOT is_bundle),
mt AS (SELECT roaster, product_id, month, min(product_title) AS title FROM coffee GROUP BY ALL),
ml AS (SELECT *, lag(title) OVER (PARTITION BY roaster, product_id ORDER BY month) AS prev FROM mt),
md AS {_step_sql("(SELECT *, coalesce(prev, '') AS pv FROM ml)", 'roaster, product_id, month, prev', 'pv', 'title')},
mk AS (SELECT roaster, product_id, month, 1 + sum((prev IS NOT NULL AND different)::INT) OVER (PARTITION BY roaster, product_id ORDER BY month) AS n FROM md),
mrows AS (SELECT c.*, CASE WHEN n = 1 THEN product_id ELSE product_id || '#' || n::VARCHAR END AS product_key FROM coffee c JOIN mk USING (roaster, product_id, month)),
steps AS (SELECT roaster, month, lag(month) OVER (PARTITION BY roaster ORDER BY month) AS prev FROM (SELECT DISTINCT roaster, month FROM mrows)),
one AS (SELECT roaster, variant_id, product_key, month, size_grams, price_inr, ppg, product_title FROM mrows QUALIFY row_number() OVER (PARTITION BY roaster, variant_id, product_key, month ORDER BY size_grams, price_inr) = 1),
packs AS (SELECT n.roaster, s.prev AS from_month, n.month AS to_month, n.variant_id, n.product_key, n.product_title, b.size_grams AS grams_before, n.size_grams AS grams_after, b.price_inr AS price_before, n.price_inr AS price_after, round(b.ppg, 1) AS ppg_before, round(n.ppg, 1) AS ppg_after, round((n.ppg / b.ppg - 1) * 100, 1) + 0.0 AS ppg_change_pct
  FROM one n JOIN steps s USING (roaster, month) JOIN one b ON b.roaster = n.roaster AND b.variant_id = n.variant_id AND b.product_key = n.product_key AND b.month = s.prev WHERE n.size_grams <> b.size_grams)"""


def _monthly(spark, d):
    """The order lines month by month, with answers for some products and pending ones for others."""
    part = _t(spark, d, "part").select(F.col("p_brand").alias("roaster"), F.col("p_partkey").cast("string").alias("product_id"), "p_size")
    answers = T.known_coffee(part.where("p_size <= 40").withColumn("is_coffee", F.lit("yes")), part.where("p_size > 40").withColumns({"status": F.when(F.col("p_size") > 45, "ok").otherwise("pending"), "is_coffee": F.lit("no")}))
    rows = _lines(spark, d).withColumns({"month": F.col("quarter"), "size_grams": F.col("quantity")})
    return T.add_product_keys(T.coffee_rows(rows, answers))


@query(f"WITH {MONTHLY} SELECT roaster, variant_id, month, product_key, attributes_pending, round(ppg, 4) AS ppg FROM mrows")
def tracker_rows(spark, d):
    return _monthly(spark, d).select("roaster", "variant_id", "month", "product_key", "attributes_pending", F.round("ppg", 4).alias("ppg"))


@query(f"WITH {MONTHLY} SELECT * EXCLUDE (ppg_before, ppg_after) FROM packs")
def tracker_pack_changes(spark, d):
    out = T.pack_size_changes(_monthly(spark, d)).drop("ppg_before", "ppg_after")  # ties of rounding differ between engines
    return out.withColumn("ppg_change_pct", F.col("ppg_change_pct") + 0.0)


@query("""WITH r AS (SELECT roaster, max(tier) AS tier, max(CASE WHEN tier = 'core' THEN 1 ELSE 0 END) = 1 AS core FROM roasters_final GROUP BY 1), v AS (SELECT roaster, regexp_extract(quarter, '[0-9]{4}') || 'Q' || regexp_extract(upper(quarter), 'Q *([1-4])', 1) AS month, regexp_extract(product_id, '[0-9]{13}') AS product_id FROM variants_long WHERE regexp_matches(product_id, '[0-9]{13}')),
o AS (SELECT * FROM v WHERE month < '2025Q3' OR (month = '2025Q3' AND roaster < 'H')), h AS (SELECT roaster, count(DISTINCT product_id) AS n FROM o WHERE month = '2025Q3' GROUP BY 1), w AS (SELECT roaster, count(DISTINCT product_id) AS n FROM v WHERE month = '2025Q3' GROUP BY 1),
p AS (SELECT roaster, count(DISTINCT product_id) AS n FROM (SELECT *, max(month) OVER (PARTITION BY roaster) AS lm FROM o WHERE month < '2025Q3') WHERE month = lm GROUP BY 1),
s AS (SELECT r.roaster, r.tier, h.n AS h, w.n AS w, p.n AS p, CASE WHEN r.roaster LIKE 'A%' THEN 'skipped_disabled' WHEN h.n IS NOT NULL THEN 'already_fetched' WHEN r.roaster LIKE 'S%' THEN 'skipped_robots' WHEN r.roaster LIKE 'T%' OR w.n IS NULL THEN 'error' ELSE 'fetched' END AS status FROM r LEFT JOIN h USING (roaster) LEFT JOIN w USING (roaster) LEFT JOIN p USING (roaster)),
k AS (SELECT *, coalesce(CASE status WHEN 'already_fetched' THEN h WHEN 'fetched' THEN w END, 0) AS n FROM s)
SELECT '2025Q3' AS month, roaster, tier, status, CASE WHEN status IN ('skipped_disabled', 'already_fetched') THEN '' WHEN status = 'skipped_robots' THEN 'blocked' ELSE 'found' END AS robots, n AS n_products, CASE WHEN n > 0 THEN p END AS prev_products, coalesce(n > 0 AND n < 0.5 * p, false) AS big_drop, CASE WHEN status <> 'error' THEN '' WHEN roaster LIKE 'T%' THEN 'timeout' ELSE 'products.json returned no products' END AS error FROM k""")
def take_snapshot(spark, d):
    """A month of the catalogue: some roasters are there already, some switched off, some not allowed, some fail."""
    from panelwright.functions.ids import clean_quarter

    v = _t(spark, d, "variants_long").select("roaster", clean_quarter(F.col("quarter")).alias("month"), digits_id(F.col("product_id"), 13).alias("product_id")).where("product_id is not null")
    final = _t(spark, d, "roasters_final").groupBy("roaster").agg(F.max("tier").alias("tier"))
    roasters = T.enabled_roasters(final, final.where("roaster like 'A%'").select("roaster", F.lit("False").alias("tracker_enabled")))
    robots = final.select("roaster", (~F.col("roaster").like("S%")).alias("allowed"), F.when(F.col("roaster").like("S%"), "blocked").otherwise("found").alias("robots"))
    old = v.where("month < '2025Q3' or (month = '2025Q3' and roaster < 'H')")
    return T.take_snapshot("2025Q3", old, roasters, robots, v.where("month = '2025Q3'"), final.where("roaster like 'T%'").select("roaster", F.lit("timeout").alias("error")))[1]


@query(f"""WITH {PANEL}, a AS (SELECT roaster, product_id, quarter FROM panel WHERE source_type = 'archive' AND NOT coalesce(served_outside_quarter, false) AND product_id IS NOT NULL QUALIFY quarter = max(quarter) OVER (PARTITION BY roaster)),
l AS (SELECT DISTINCT roaster, product_id FROM panel WHERE source_type = 'live' AND product_id IS NOT NULL), o AS (SELECT DISTINCT roaster, product_id, quarter FROM a),
s AS (SELECT o.roaster, o.quarter AS before_quarter, count(l.product_id) / count(*)::DOUBLE AS share FROM o LEFT JOIN l USING (roaster, product_id) GROUP BY ALL)
SELECT roaster, before_quarter, round(share, 3) AS carryover, share < 0.1 AS is_break FROM s WHERE roaster IN (SELECT roaster FROM l)""")
def live_breaks(spark, d):
    return I.live_breaks(_panel(spark, d))[0]


_CLEAN = "p AS (SELECT pair_ref, roaster, regexp_extract(before_id, '[0-9]{13}') AS before_id, regexp_extract(after_id, '[0-9]{13}') AS after_id, method, lower(trim(coalesce(same_product, ''))) AS sp, coalesce(confidence, '') AS co, coalesce(reason, '') AS re, lower(trim(coalesce(human_decision, ''))) AS hd FROM match_candidates WHERE regexp_matches(before_id, '[0-9]{13}') AND regexp_matches(after_id, '[0-9]{13}'))"
RESOLVED = f"""{_CLEAN}, q AS (SELECT *, CASE WHEN method = 'exact_title' THEN 'yes' ELSE sp END AS same_product, CASE WHEN method = 'exact_title' THEN 'high' ELSE co END AS confidence, CASE WHEN method = 'exact_title' THEN 'identical title after normalising' ELSE re END AS reason FROM p),
s AS (SELECT *, CASE WHEN same_product = '' THEN 'no_decision' WHEN confidence = 'low' THEN 'review' WHEN same_product = 'yes' THEN 'linked' ELSE 'rejected' END AS st FROM q),
c AS (SELECT *, CASE WHEN st = 'linked' AND (count(*) FILTER (WHERE st = 'linked') OVER (PARTITION BY roaster, before_id) > 1 OR count(*) FILTER (WHERE st = 'linked') OVER (PARTITION BY roaster, after_id) > 1) THEN 'conflict' ELSE st END AS st2 FROM s),
hu AS (SELECT roaster, before_id, after_id, max(hd) AS h FROM p WHERE hd IN ('yes', 'no') GROUP BY ALL),
res AS (SELECT c.*, coalesce(h, '') AS human, CASE h WHEN 'yes' THEN 'linked_human' WHEN 'no' THEN 'rejected_human' ELSE st2 END AS status FROM c LEFT JOIN hu ON hu.roaster IS NOT DISTINCT FROM c.roaster AND hu.before_id = c.before_id AND hu.after_id = c.after_id)"""


def _resolved(spark, d):
    m = _t(spark, d, "match_candidates").where("roaster is not null").withColumns({"before_id": digits_id(F.col("before_id"), 13), "after_id": digits_id(F.col("after_id"), 13)}).where("before_id is not null and after_id is not null")
    pairs = m.select("pair_ref", "roaster", "before_id", "after_id", "method")
    decisions = m.select("pair_ref", F.lower(F.trim("same_product")).alias("same_product"), "confidence", "reason")
    return I.apply_human(I.resolve_pairs(pairs, decisions), m.select("roaster", "before_id", "after_id", F.col("human_decision").alias("your_decision")))


@query(f"WITH {RESOLVED} SELECT pair_ref, same_product, confidence, status, human AS human_decision FROM res WHERE roaster IS NOT NULL")
def match_decisions(spark, d):
    return _resolved(spark, d).select("pair_ref", "same_product", "confidence", "status", "human_decision")


@query(f"WITH {RESOLVED} SELECT pair_ref, status, human AS your_decision FROM res WHERE roaster IS NOT NULL AND (status IN ('review', 'conflict', 'no_decision') OR human <> '')")
def match_review(spark, d):
    return I.needs_review(_resolved(spark, d)).select("pair_ref", "status", "your_decision")


@query(f"""WITH {RESOLVED}, l AS (SELECT roaster, after_id AS product_id, string_agg(before_id, ' | ' ORDER BY before_id, method, confidence, reason) AS f, string_agg(DISTINCT method, ' | ' ORDER BY method) AS m, string_agg(confidence, ' | ' ORDER BY before_id, method, confidence, reason) AS c, bool_or(status = 'linked_human') AS h FROM res WHERE status IN ('linked', 'linked_human') AND roaster IS NOT NULL GROUP BY ALL),
x AS (SELECT DISTINCT roaster, after_id AS product_id FROM res WHERE roaster IS NOT NULL)
SELECT roaster, product_id, coalesce(f, '') AS linked_from_product_id, CASE WHEN h THEN 'human' ELSE coalesce(m, '') END AS link_method, CASE WHEN h THEN 'human' ELSE coalesce(c, '') END AS link_confidence FROM x LEFT JOIN l USING (roaster, product_id)""")
def link_provenance(spark, d):
    pairs, _ = Scratch(spark, "resolved").write(_resolved(spark, d))
    products = pairs.select("roaster", F.col("after_id").alias("product_id")).distinct()
    return I.link_provenance(products, products.withColumn("product_key", F.col("product_id")), pairs).select("roaster", "product_id", "linked_from_product_id", "link_method", "link_confidence")
