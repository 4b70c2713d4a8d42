"""Queries of the text, quality and change operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import periods as D
from panelwright.functions import text as X
from panelwright.functions.ids import clean_quarter, digits_id
from panelwright.operators import changes as K
from panelwright.operators import quality as Q
from panelwright.plans.panel_queries import ITEMS, PANEL, _items, _panel, _round, _t

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_UNIT = "(?:kilograms?|kilos?|kgs?|grams?|gms?|g)"
_TITLES = "t AS (SELECT DISTINCT variant_title AS v, product_title AS p, product_type AS k FROM variants_long)"
_SIZE = f"""regexp_extract({{0}}, '(?i)(?:^|[^0-9.])(?:([0-9]+)\\s*[x×]\\s*)?([0-9]+(?:\\.[0-9]+)?)\\s*({_UNIT})(?:$|[^a-z0-9_])', ['n', 'x', 'u'])"""


def _titles(spark, d):
    return _t(spark, d, "variants_long").select(F.col("variant_title").alias("v"), F.col("product_title").alias("p"), F.col("product_type").alias("k")).distinct()


@query(f"""WITH {_TITLES}, s AS (SELECT DISTINCT v, {_SIZE.format("coalesce(v, '')")} AS m FROM t)
SELECT v, try_cast(m.x AS DOUBLE) * CASE WHEN lower(m.u) LIKE 'k%' THEN 1000.0 ELSE 1.0 END * coalesce(try_cast(m.n AS DOUBLE), 1.0) AS grams, CASE WHEN m.x <> '' THEN m.n <> '' END AS multipack FROM s""")
def parse_sizes(spark, d):
    s = X.parse_size(F.col("v"))
    return _titles(spark, d).select("v").distinct().select("v", s["grams"].alias("grams"), s["multipack"].alias("multipack"))


@query(f"WITH {_TITLES}, x AS (SELECT DISTINCT p || ' (Pack of ' || (length(p) % 5)::VARCHAR || ')' AS p FROM t) SELECT p, try_cast(regexp_extract(p, '(?i)\\bpack\\s+of\\s+([0-9]+)\\b', 1) AS INT) AS n FROM x")
def pack_count(spark, d):
    p = _titles(spark, d).select(F.concat("p", F.lit(" (Pack of "), (F.length("p") % 5).cast("string"), F.lit(")")).alias("p")).distinct()
    return p.select("p", X.pack_count(F.col("p")).alias("n"))


_B = "|".join(X.SEVERAL[:-1])


@query(f"WITH {_TITLES} SELECT DISTINCT p, regexp_matches(coalesce(p, ''), '(?i)\\b({_B})\\b') OR regexp_matches(regexp_replace(coalesce(p, ''), '(?i)\\bpack\\s+of\\s+[0-9]', ' ', 'g'), '(?i)\\bpack\\b') AS bundle FROM t")
def is_bundle(spark, d):
    return _titles(spark, d).select("p", X.is_bundle(F.col("p")).alias("bundle")).distinct()


_N, _M = "|".join(X.NOT_COFFEE), "|".join(X.MAYBE_NOT)


@query(f"""WITH {_TITLES}, c AS (SELECT DISTINCT p, k, coalesce(p, '') || ' ' || coalesce(k, '') AS s FROM t)
SELECT p, k, CASE WHEN regexp_matches(s, '(?i)\\b({_N})\\b') THEN false WHEN regexp_matches(coalesce(k, ''), '(?i)\\bcoffee\\b|\\bbeans?\\b|\\broast') THEN true WHEN regexp_matches(s, '(?i)\\b({_M})\\b') THEN NULL ELSE NULL END AS guess FROM c""")
def coffee_guess(spark, d):
    return _titles(spark, d).select("p", "k").distinct().select("p", "k", X.coffee_guess(F.col("p"), F.col("k"), F.lit(False), F.lit(False)).alias("guess"))


@query(f"""WITH c AS (SELECT DISTINCT product_title AS p, product_type AS k, size_grams IS NOT NULL AS has_grams FROM variants_long),
b AS (SELECT *, coalesce(p, '') || ' ' || coalesce(k, '') AS s, regexp_matches(coalesce(p, ''), '(?i)\\b({_B})\\b') OR regexp_matches(regexp_replace(coalesce(p, ''), '(?i)\\bpack\\s+of\\s+[0-9]', ' ', 'g'), '(?i)\\bpack\\b') AS bundle FROM c)
SELECT p, k, has_grams, bundle, CASE WHEN regexp_matches(s, '(?i)\\b({_N})\\b') THEN false WHEN regexp_matches(coalesce(k, ''), '(?i)\\bcoffee\\b|\\bbeans?\\b|\\broast') OR bundle THEN true WHEN regexp_matches(s, '(?i)\\b({_M})\\b') THEN NULL WHEN has_grams THEN true END AS guess FROM b""")
def coffee_guess_rows(spark, d):
    """The guess of each title and type with the sizes and bundles of the real rows."""
    rows = _t(spark, d, "variants_long").select(F.col("product_title").alias("p"), F.col("product_type").alias("k"), F.col("size_grams").isNotNull().alias("has_grams")).distinct()
    return rows.withColumn("bundle", X.is_bundle(F.col("p"))).withColumn("guess", X.coffee_guess(F.col("p"), F.col("k"), F.col("has_grams"), F.col("bundle")))


@query("SELECT DISTINCT before_title, trim(regexp_replace(lower(coalesce(before_title, '')), '[^a-z0-9]+', ' ', 'g')) AS norm FROM match_candidates")
def norm_title(spark, d):
    return _t(spark, d, "match_candidates").select("before_title", X.norm_title(F.col("before_title")).alias("norm")).distinct()


_G = ", ".join(f"'{w}'" for w in X.GENERIC_WORDS)
_W = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({1})))"


@query(f"""WITH w AS (SELECT pair_ref, {_W.format('before_title', _G)} AS a, {_W.format('after_title', _G)} AS b FROM match_candidates)
SELECT pair_ref, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::DOUBLE, 1.0), 6) AS overlap FROM w""")
def title_words_jaccard(spark, d):
    return _t(spark, d, "match_candidates").select("pair_ref", F.round(X.word_overlap(F.col("before_title"), F.col("after_title")), 6).alias("overlap"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]+', ' ', 'g')) AS clean FROM documents")
def html_strip_tags(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.strip_tags(F.col("text")).alias("clean"))


_VISIBLE = r"""regexp_replace(regexp_replace(coalesce(text, ''), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"""
for _name, _sign in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&amp;": "&"}.items():
    _VISIBLE = f"replace({_VISIBLE}, '{_name}', '{_sign}')"


@query(rf"SELECT doc_id, trim(regexp_replace({_VISIBLE}, '[\s\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x0b]+', ' ', 'g')) AS visible FROM documents")
def html_visible_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.visible_text(F.col("text")).alias("visible"))


@query("SELECT DISTINCT source_url, page, CASE WHEN page >= 2 THEN page END AS number FROM variants_long WHERE source_url IS NOT NULL AND page IS NOT NULL")
def page_numbers(spark, d):
    v = _t(spark, d, "variants_long").where("source_url is not null and page is not null").select("source_url", "page").distinct()
    url = F.concat(F.regexp_replace("source_url", r"\?.*$", ""), F.lit("?page="), F.col("page").cast("string"))
    return v.select("source_url", "page", X.page_number(url, F.try_parse_url(F.col("source_url"), F.lit("PATH"))).alias("number"))


@query("""WITH w AS (SELECT roaster, regexp_extract(url_switch_window, 'after ([0-9]{4})-Q([1-4])', 1) AS ay, regexp_extract(url_switch_window, 'after ([0-9]{4})-Q([1-4])', 2) AS aq,
  regexp_extract_all(coalesce(url_switch_window, ''), '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS ds FROM roasters_final),
q AS (SELECT i, make_date((i // 4)::INT, ((i % 4) * 3 + 2)::INT, 15) AS mid FROM range(8092, 8108) t(i))
SELECT roaster, (i // 4)::VARCHAR || 'Q' || (i % 4 + 1)::VARCHAR AS quarter, coalesce(CASE WHEN ay <> '' THEN i = ay::INT * 4 + aq::INT WHEN len(ds) >= 2 THEN mid BETWEEN ds[1]::DATE AND ds[2]::DATE
  WHEN len(ds) = 1 THEN i = year(ds[1]::DATE) * 4 + quarter(ds[1]::DATE) - 1 END, false) AS inside FROM w, q""")
def switch_windows(spark, d):
    q = D.quarter_range(spark, "2023Q1", "2026Q4")
    r = _t(spark, d, "roasters_final").select("roaster", "url_switch_window").crossJoin(F.broadcast(q))  # sixteen quarters
    return r.select("roaster", "quarter", X.in_switch_window(F.col("url_switch_window"), D.mid_quarter(F.col("quarter"))).alias("inside"))


@query(f"""WITH {PANEL}, u AS (SELECT * FROM panel WHERE source_type = 'archive' AND NOT coalesce(served_outside_quarter, false)),
q AS (SELECT roaster, quarter, row_number() OVER (PARTITION BY roaster ORDER BY quarter) AS qn, count(*) OVER (PARTITION BY roaster) AS last FROM (SELECT DISTINCT roaster, quarter FROM u)),
a AS (SELECT u.roaster, u.variant_id, u.quarter, u.price_inr, qn, last FROM u JOIN q USING (roaster, quarter)),
b AS (SELECT a.*, p.price_inr AS pp, n.price_inr AS np FROM a LEFT JOIN a p ON p.roaster = a.roaster AND p.variant_id = a.variant_id AND p.qn = a.qn - 1 LEFT JOIN a n ON n.roaster = a.roaster AND n.variant_id = a.variant_id AND n.qn = a.qn + 1)
SELECT roaster, variant_id, quarter, CASE WHEN qn = 1 OR qn = last OR pp IS NULL OR price_inr IS NULL OR np IS NULL THEN 'not_checkable' WHEN price_inr < 0.9 * pp AND np >= 0.95 * pp THEN 'candidate' ELSE 'False' END AS sale_status FROM b""")
def sale_flags(spark, d):
    return Q.mark_sales(_panel(spark, d)).select("roaster", "variant_id", "quarter", "sale_status")


_CARRY = f"""{PANEL}, ids AS (SELECT DISTINCT roaster, quarter, variant_id FROM panel),
q AS (SELECT roaster, quarter, row_number() OVER (PARTITION BY roaster ORDER BY quarter) AS qn FROM (SELECT DISTINCT roaster, quarter FROM ids)),
i AS (SELECT ids.*, qn FROM ids JOIN q USING (roaster, quarter)),
k AS (SELECT a.roaster, a.qn + 1 AS qn, count(b.variant_id) / count(*)::DOUBLE AS carried FROM i a LEFT JOIN i b ON a.roaster = b.roaster AND a.variant_id = b.variant_id AND b.qn = a.qn + 1 GROUP BY ALL),
c AS (SELECT q.roaster, q.quarter, round(k.carried, 3) AS carried FROM q LEFT JOIN k ON q.roaster = k.roaster AND q.qn = k.qn)"""


@query(f"WITH {_CARRY} SELECT roaster, quarter, carried FROM c")
def id_carryover(spark, d):
    return Q.id_carryover(_panel(spark, d))


@query(f"WITH {_CARRY} SELECT roaster, quarter, coalesce(carried < 0.1, false) AS id_break, NOT bool_or(coalesce(carried < 0.1, false)) OVER (PARTITION BY roaster) AS ids_stable FROM c")
def id_break(spark, d):
    return Q.id_breaks(Q.id_carryover(_panel(spark, d))).drop("carried")


@query(f"""WITH {PANEL}, a AS (SELECT roaster, variant_id, price_inr FROM panel WHERE source_type = 'archive' QUALIFY quarter = max(quarter) OVER (PARTITION BY roaster)),
m AS (SELECT l.roaster, (l.price_inr / a.price_inr - 1) * 100 AS d FROM panel l JOIN a USING (roaster, variant_id) WHERE l.source_type = 'live' AND l.price_inr > 0 AND a.price_inr > 0)
SELECT roaster, count(*) AS matched, round(median(d), 2) + 0.0 AS median_pct_diff, round(avg((d > 1)::INT), 3) AS share_higher, round(avg((d < -1)::INT), 3) AS share_lower FROM m GROUP BY 1""")
def compare_live(spark, d):
    p = _panel(spark, d)
    return Q.compare_live(p.where("source_type = 'archive'"), p.where("source_type = 'live'")).withColumn("median_pct_diff", F.col("median_pct_diff") + 0.0)


@query(f"WITH {PANEL} SELECT roaster, variant_id, quarter, coalesce(price_inr > 1.75 * median(price_inr) OVER (PARTITION BY roaster, quarter), false) AS outlier FROM panel")
def price_outliers(spark, d):
    return Q.price_outliers(_panel(spark, d), ["roaster", "quarter"], "price_inr").select("roaster", "variant_id", "quarter", "outlier")


@query(f"""WITH {PANEL} SELECT roaster, quarter, count(*) AS variant_count, round(avg((size_grams IS NOT NULL)::INT) * 100, 1) AS pct_sized, round(avg((is_coffee_guess IS NOT DISTINCT FROM false)::INT) * 100, 1) AS pct_non_coffee,
  round(avg((is_coffee_guess IS NULL)::INT) * 100, 1) AS pct_coffee_ambiguous, round(avg(coalesce(is_bundle, false)::INT) * 100, 1) AS pct_bundle FROM panel GROUP BY ALL""")
def coverage_report(spark, d):
    return Q.coverage(_panel(spark, d))


_PAGES = "SELECT roaster, quarter, served_ts, pages_expected, pages_found, range(2, greatest(pages_expected, 1) + 1) AS e, range(2, greatest(pages_found, 1) + 1) AS f FROM coverage_report"


@query(f"WITH p AS ({_PAGES}) SELECT DISTINCT roaster, quarter, served_ts, CASE WHEN len(e) = 0 THEN 'single_page' WHEN len(list_filter(e, lambda x: NOT list_contains(f, x))) > 0 THEN 'partial' ELSE 'complete' END AS state FROM p")
def completeness(spark, d):
    pages = lambda c: F.when(F.col(c) >= 2, F.sequence(F.lit(2), F.greatest(F.col(c), F.lit(2)))).otherwise(F.array().cast("array<int>"))
    return _t(spark, d, "coverage_report").select("roaster", "quarter", "served_ts", Q.completeness(pages("pages_expected"), pages("pages_found"))[0].alias("state")).distinct()


_NEAR = """c AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, make_date(year(o_orderdate)::INT, (quarter(o_orderdate) * 3 - 1)::INT, 15) AS mid FROM orders)"""


@query(f"WITH {_NEAR} SELECT o_custkey, mid, day, o_orderkey, abs(day - mid)::INT AS gap FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey, mid ORDER BY abs(day - mid), o_orderkey) = 1")
def nearest_mid_quarter(spark, d):
    return Q.nearest(_by_quarter(spark, d), ["o_custkey", "mid"], F.col("mid"), "day", "o_orderkey")


@query(f"WITH {_NEAR} SELECT o_custkey, mid, day, o_orderkey, abs(day - mid)::INT AS gap FROM c WHERE abs(day - mid) <= 30 QUALIFY row_number() OVER (PARTITION BY o_custkey, mid ORDER BY abs(day - mid), o_orderkey) = 1")
def nearest_within_30d(spark, d):
    return Q.nearest(_by_quarter(spark, d), ["o_custkey", "mid"], F.col("mid"), "day", "o_orderkey", 30)


def _by_quarter(spark, d):
    day = F.col("o_orderdate").cast("date")
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("day"), F.make_date(F.year(day), F.quarter(day) * 3 - 1, F.lit(15)).alias("mid"))


_CH = f"""{ITEMS}, qs AS (SELECT roaster, quarter AS from_period, lead(quarter) OVER (PARTITION BY roaster ORDER BY quarter) AS to_period FROM (SELECT DISTINCT roaster, quarter FROM items)),
b AS (SELECT i.roaster, from_period, to_period, product_key, size_grams, ppg FROM items i JOIN qs ON qs.roaster = i.roaster AND qs.from_period = i.quarter AND to_period IS NOT NULL),
a AS (SELECT i.roaster, from_period, to_period, product_key, size_grams, ppg FROM items i JOIN qs ON qs.roaster = i.roaster AND qs.to_period = i.quarter),
ch AS (SELECT b.roaster, b.from_period, b.to_period, CASE WHEN a.ppg > b.ppg THEN 'price_up' ELSE 'price_down' END AS change, b.product_key, b.size_grams, b.ppg AS before, a.ppg AS after
  FROM b JOIN a ON a.roaster = b.roaster AND a.to_period = b.to_period AND a.product_key = b.product_key AND a.size_grams = b.size_grams WHERE abs(a.ppg / b.ppg - 1) >= 0.005
  UNION ALL SELECT roaster, from_period, to_period, 'dropped', product_key, NULL, median(ppg), NULL FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.roaster = b.roaster AND a.to_period = b.to_period AND a.product_key = b.product_key) GROUP BY ALL
  UNION ALL SELECT roaster, from_period, to_period, 'added', product_key, NULL, NULL, median(ppg) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.roaster = b.roaster AND a.to_period = b.to_period AND a.product_key = b.product_key) GROUP BY ALL)"""


def _keyed(spark, d):
    return _items(spark, d).where("product_key is not null")


@query(f"WITH {_CH} SELECT roaster, from_period, to_period, change, product_key, size_grams, round(before, 6) AS before, round(after, 6) AS after FROM ch WHERE product_key IS NOT NULL")
def period_changes(spark, d):
    return _round(K.period_changes(_keyed(spark, d), "quarter"), "before", "after")


@query(f"WITH {_CH} SELECT roaster, to_period, count(*) FILTER (WHERE change = 'price_up') AS price_up, count(*) FILTER (WHERE change = 'price_down') AS price_down, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'dropped') AS dropped FROM ch WHERE product_key IS NOT NULL GROUP BY ALL")
def change_summary(spark, d):
    return K.change_summary(K.period_changes(_keyed(spark, d), "quarter"))


@query(f"""WITH {ITEMS}, l AS (SELECT * FROM items WHERE quarter < '2025Q1'), r AS (SELECT roaster, tier, quarter, product_key, size_grams, CASE WHEN quarter = '2024Q4' THEN ppg * 1.1 ELSE ppg END AS ppg FROM items WHERE quarter > '2023Q1')
SELECT roaster, quarter, product_key, size_grams, CASE WHEN l.ppg IS NULL OR r.ppg IS NULL THEN 'row' ELSE 'ppg' END AS field FROM l FULL JOIN r USING (roaster, quarter, product_key, size_grams)
WHERE product_key IS NOT NULL AND (l.ppg IS NULL OR r.ppg IS NULL OR abs(l.ppg - r.ppg) > 1e-9 * r.ppg)""")
def table_diff(spark, d):
    i = _keyed(spark, d)
    changed = i.where("quarter > '2023Q1'").withColumn("ppg", F.when(F.col("quarter") == "2024Q4", F.col("ppg") * 1.1).otherwise(F.col("ppg")))
    return K.table_diff(i.where("quarter < '2025Q1'"), changed, ["roaster", "quarter", "product_key", "size_grams"], ["ppg"]).drop("left_value", "right_value")


@query("WITH o AS (SELECT * FROM roasters_final), n AS (SELECT roaster, 'new' AS tier FROM roasters_final WHERE tier = 'core') SELECT roaster, tier FROM o WHERE roaster NOT IN (SELECT roaster FROM n) UNION ALL SELECT roaster, tier FROM n")
def merge_status(spark, d):
    old = _t(spark, d, "roasters_final").select("roaster", "tier")
    return K.upsert(old, old.where("tier = 'core'").withColumn("tier", F.lit("new")), ["roaster"])
