"""Queries of the operators that turn captured pages into variant rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import text as X
from panelwright.functions.ids import digits_id
from panelwright.operators import collection as C
from panelwright.plans.panel_queries import PANEL, _panel, _t
from panelwright.plans.quality_queries import _B, _M, _N, _SIZE
from panelwright.sources.readers import embedded_json

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_GRAMS = "try_cast({0}.x AS DOUBLE) * CASE WHEN lower({0}.u) LIKE 'k%' THEN 1000.0 ELSE 1.0 END * coalesce(try_cast({0}.n AS DOUBLE), 1.0)"
CASCADE = f"""t AS (SELECT DISTINCT variant_title AS v, product_title AS p, product_type AS k FROM variants_long),
m AS (SELECT *, {_SIZE.format("coalesce(v, '')")} AS mv, {_SIZE.format("coalesce(p, '')")} AS mp, try_cast(regexp_extract(coalesce(p, ''), '(?i)\\bpack\\s+of\\s+([0-9]+)\\b', 1) AS INT) AS pack FROM t),
c AS (SELECT v, p, k, pack, CASE WHEN mv.x <> '' THEN {_GRAMS.format('mv')} WHEN mp.x <> '' THEN {_GRAMS.format('mp')} END AS g, CASE WHEN mv.x <> '' THEN mv.n <> '' WHEN mp.x <> '' THEN mp.n <> '' END AS mu, CASE WHEN mv.x <> '' THEN 'variant_title' WHEN mp.x <> '' THEN 'product_title' ELSE '' END AS source FROM m),
sized AS (SELECT v, p, k, source, CASE WHEN pack >= 2 AND NOT mu THEN g * pack ELSE g END AS grams, CASE WHEN g IS NOT NULL THEN mu OR coalesce(pack >= 2, false) END AS multipack FROM c)"""


def _titles(spark, d):
    return _t(spark, d, "variants_long").select(F.col("variant_title").alias("v"), F.col("product_title").alias("p"), F.col("product_type").alias("k")).distinct()


@query(f"WITH {CASCADE} SELECT DISTINCT v, p, grams, multipack, source FROM sized")
def size_cascade(spark, d):
    """Sizes from variant title, product title, with packs, and where each was found."""
    s = X.resolve_size(F.col("v"), F.col("p"))
    return _titles(spark, d).select("v", "p").distinct().select("v", "p", s["grams"].alias("grams"), s["multipack"].alias("multipack"), s["source"].alias("source"))


@query(f"""WITH {CASCADE}, b AS (SELECT *, coalesce(p, '') || ' ' || coalesce(k, '') AS s, regexp_matches(coalesce(p, ''), '(?i)\\b({_B})\\b') OR regexp_matches(regexp_replace(coalesce(p, ''), '(?i)\\bpack\\s+of\\s+[0-9]', ' ', 'g'), '(?i)\\bpack\\b') AS bundle FROM sized),
g AS (SELECT *, CASE WHEN regexp_matches(s, '(?i)\\b({_N})\\b') THEN false WHEN regexp_matches(coalesce(k, ''), '(?i)\\bcoffee\\b|\\bbeans?\\b|\\broast') OR bundle THEN true WHEN regexp_matches(s, '(?i)\\b({_M})\\b') THEN NULL WHEN grams IS NOT NULL THEN true END AS guess FROM b)
SELECT v AS variant_title, p AS product_title, k AS product_type, grams AS size_grams, multipack, source AS size_source, guess AS is_coffee_guess, bundle AND guess IS DISTINCT FROM false AS is_bundle FROM g""")
def finish_rows(spark, d):
    """The size, guess and bundle flag of each variant, product title and type."""
    return C.finish_rows(_titles(spark, d).select(F.col("v").alias("variant_title"), F.col("p").alias("product_title"), F.col("k").alias("product_type")))


@query("""WITH p AS (SELECT DISTINCT payload_id, trim(payload) AS t FROM page_payloads WHERE payload IS NOT NULL),
j AS (SELECT payload_id, CASE WHEN starts_with(t, '{') THEN t WHEN starts_with(t, 'var meta = ') THEN split_part(substr(t, 12), ';' || chr(10), 1) END AS s FROM p),
a AS (SELECT payload_id, unnest(json_extract(s, '$.products[*]')) AS p FROM j WHERE json_valid(s) AND json_type(s, '$.products') = 'ARRAY'),
v AS (SELECT payload_id, p, unnest(json_extract(p, '$.variants[*]')) AS v FROM a WHERE json_type(p, '$.variants') = 'ARRAY'),
r AS (SELECT payload_id, json_extract_string(p, '$.id') AS product_id, coalesce(json_extract_string(p, '$.type'), '') AS product_type, trim(coalesce(json_extract_string(v, '$.name'), '')) AS n, coalesce(json_extract_string(v, '$.public_title'), '') AS t, json_extract_string(v, '$.id') AS variant_id, try_cast(regexp_extract(json_extract_string(v, '$.price'), '^-?[0-9]+$') AS BIGINT) / 100.0 AS price_inr, coalesce(json_extract_string(v, '$.sku'), '') AS sku FROM v)
SELECT payload_id, product_id, product_type, CASE WHEN t <> '' AND ends_with(n, ' - ' || t) THEN trim(left(n, length(n) - length(t) - 3)) ELSE n END AS product_title, variant_id, t AS variant_title, price_inr, sku FROM r""")
def page_variant_rows(spark, d):
    """Variant rows of the payloads that are a listing's products."""
    pages = embedded_json(_t(spark, d, "page_payloads").distinct(), "payload_id", "payload")
    listed = F.get_json_object("json", "$.products").startswith("[")
    return C.variant_rows(pages.where(listed), "json", ["payload_id"])


@query(f"""WITH {PANEL}, u AS (SELECT * FROM panel WHERE source_type = 'archive' AND NOT coalesce(served_outside_quarter, false) AND (size_grams IS NULL OR coalesce(starts_with(size_source, 'product_page'), false)) AND coalesce(is_coffee_guess, true))
SELECT roaster, product_id, quarter, regexp_extract(arg_min(source_url, variant_id), '^https?://([^/?]+)', 1) AS host, arg_min(product_title, variant_id) AS product_title, arg_min(served_ts, variant_id) AS served_ts FROM u GROUP BY ALL""")
def size_targets(spark, d):
    return C.targets(_wide(spark, d))


def _wide(spark, d):
    from panelwright.operators.panel import KEPT, counting_rows

    return counting_rows(_t(spark, d, "variants_long"), [*KEPT, "source_url", "sale_suspected"])


@query(f"""WITH {PANEL}, u AS (SELECT 'sizes' AS kind, roaster, product_id, quarter FROM panel WHERE source_type = 'archive' AND size_grams IS NULL AND coalesce(is_coffee_guess, true) UNION ALL SELECT 'sales', roaster, product_id, quarter FROM panel WHERE source_type = 'archive' AND sale_suspected = 'candidate'),
h AS (SELECT DISTINCT roaster, regexp_extract(after_id, '[0-9]{{13}}') AS product_id, true AS mapped FROM match_candidates WHERE after_title <> '' AND regexp_matches(after_id, '[0-9]{{13}}'))
SELECT kind, count(*) AS rows, count(DISTINCT (u.roaster, u.product_id, quarter)) AS product_quarters, count(DISTINCT (u.roaster, u.product_id)) AS products, count(DISTINCT (u.roaster, u.product_id)) FILTER (WHERE mapped) AS products_mapped, count(DISTINCT (u.roaster, u.product_id, quarter)) FILTER (WHERE mapped) AS page_fetches
FROM u LEFT JOIN h ON h.roaster = u.roaster AND h.product_id = u.product_id GROUP BY 1""")
def work_estimate(spark, d):
    m = _t(spark, d, "match_candidates").select("roaster", digits_id(F.col("after_id"), 13).alias("product_id"), F.coalesce("after_title", F.lit("")).alias("handle"))
    return C.work_estimate(_wide(spark, d), m)


@query(f"""WITH {PANEL}, pg AS (SELECT roaster, product_id, quarter, variant_id, min(size_grams) AS g FROM (SELECT roaster, product_id, variant_id, size_grams, unnest(['2023Q2', '2024Q1', '2024Q4', '2025Q2']) AS quarter FROM panel WHERE source_type = 'live' AND size_grams IS NOT NULL AND product_id IS NOT NULL) GROUP BY ALL)
SELECT p.roaster, p.variant_id, p.quarter, CASE WHEN p.source_type = 'archive' THEN coalesce(p.size_grams, g) ELSE p.size_grams END AS size_grams, CASE WHEN p.source_type = 'archive' AND p.size_grams IS NULL AND g IS NOT NULL THEN 'product_page_variant' ELSE p.size_source END AS size_source
FROM panel p LEFT JOIN pg ON pg.roaster = p.roaster AND pg.product_id = p.product_id AND pg.quarter = p.quarter AND pg.variant_id = p.variant_id""")
def page_sizes_applied(spark, d):
    """The panel with the sizes that live pages show for the same variant."""
    p = _panel(spark, d)
    live = p.where("source_type = 'live' and size_grams is not null and product_id is not null").select("roaster", "product_id", "variant_id", "size_grams", F.explode(F.array(*map(F.lit, ("2023Q2", "2024Q1", "2024Q4", "2025Q2")))).alias("quarter"))
    pages = live.withColumns({"multipack": F.lit(False), "size_source": F.lit("product_page_variant"), "compare_at_price_inr": F.lit(None).cast("double")})
    return C.apply_page_sizes(p, pages).select("roaster", "variant_id", "quarter", "size_grams", "size_source")
