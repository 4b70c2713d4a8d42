"""Queries of the identity, lever, validation, source and tracker operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import text as X
from panelwright.functions.ids import digits_id
from panelwright.operators import identity as I
from panelwright.operators import levers as L
from panelwright.operators import pages as PG
from panelwright.operators import panel as P
from panelwright.operators import price_index as PI
from panelwright.operators import validation as V
from panelwright.plans.panel_queries import CHAIN, INDEX, PANEL, _items, _panel, _round, _t
from panelwright.session import Scratch
from panelwright.sources import readers as S
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


def _titles(spark, d, panel=None):
    return (panel or _panel(spark, d)).where("product_id is not null and product_title is not null").groupBy("roaster", "product_id", "quarter").agg(F.min("product_title").alias("product_title"))


def _sides(spark, d, products=None):
    products = products or _titles(spark, d)
    m = _t(spark, d, "match_candidates")
    return I.break_sides(products, m.select("roaster", F.col("break_quarter").alias("quarter")))


_SIDES = f"""{PANEL}, ti AS (SELECT roaster, product_id, quarter, min(product_title) AS title FROM panel WHERE product_id IS NOT NULL AND product_title IS NOT NULL GROUP BY ALL),
qq AS (SELECT roaster, quarter, lag(quarter) OVER (PARTITION BY roaster ORDER BY quarter) AS bq FROM (SELECT DISTINCT roaster, quarter FROM ti)),
pr2 AS (SELECT q.roaster, q.quarter AS break_quarter, bq FROM qq q WHERE bq IS NOT NULL AND EXISTS (SELECT 1 FROM match_candidates m WHERE m.roaster = q.roaster AND m.break_quarter = q.quarter)),
bf AS (SELECT p.roaster, p.break_quarter, t.product_id, t.title FROM pr2 p JOIN ti t ON t.roaster = p.roaster AND t.quarter = p.bq),
af AS (SELECT p.roaster, p.break_quarter, t.product_id, t.title FROM pr2 p JOIN ti t ON t.roaster = p.roaster AND t.quarter = p.break_quarter),
b1 AS (SELECT * FROM bf WHERE (roaster, break_quarter, product_id) NOT IN (SELECT (roaster, break_quarter, product_id) FROM af)),
a1 AS (SELECT * FROM af WHERE (roaster, break_quarter, product_id) NOT IN (SELECT (roaster, break_quarter, product_id) FROM bf))"""


@query(f"WITH {_SIDES} SELECT roaster, break_quarter, product_id, 'before' AS side FROM b1 UNION ALL SELECT roaster, break_quarter, product_id, 'after' FROM a1")
def break_sides(spark, d):
    b, a = _sides(spark, d)
    keep = ["roaster", "break_quarter", "product_id"]
    return b.select(*keep, F.lit("before").alias("side")).unionByName(a.select(*keep, F.lit("after").alias("side")))


_EXACT = """SELECT b.roaster, b.break_quarter, b.product_id AS before_id, a.product_id AS after_id FROM
  (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS norm, row_number() OVER (PARTITION BY roaster, break_quarter, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) ORDER BY product_id) AS nth FROM b1) b JOIN
  (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS norm, row_number() OVER (PARTITION BY roaster, break_quarter, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) ORDER BY product_id) AS nth FROM a1) a
  USING (roaster, break_quarter, norm, nth)"""


_LISTED = """b1 AS (SELECT roaster, break_quarter, regexp_extract(before_id, '[0-9]{13}') AS product_id, min(before_title) AS title FROM match_candidates WHERE regexp_matches(before_id, '[0-9]{13}') AND before_title IS NOT NULL GROUP BY ALL),
a1 AS (SELECT roaster, break_quarter, regexp_extract(after_id, '[0-9]{13}') AS product_id, min(after_title) AS title FROM match_candidates WHERE regexp_matches(after_id, '[0-9]{13}') AND after_title IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_LISTED} {_EXACT}")
def match_exact(spark, d):
    """Equal titles of the listings before and after a break, one to one."""
    m = _t(spark, d, "match_candidates")
    side = lambda s: m.select("roaster", "break_quarter", digits_id(F.col(f"{s}_id"), 13).alias("product_id"), F.col(f"{s}_title").alias("t")).where("product_id is not null and t is not null").groupBy("roaster", "break_quarter", "product_id").agg(F.min("t").alias("product_title"))
    return I.exact_pairs(side("before"), side("after"))


@query()
def match_candidates(spark, d):
    panel = P.counting_rows(_t(spark, d, "variants_long"), ["product_id", "product_title"])
    products, _ = Scratch(spark, "titles").write(_titles(spark, d, panel))
    return I.candidate_pairs(*_sides(spark, d, products))


def _links(spark, d):
    m = _t(spark, d, "match_candidates").select("pair_ref", "roaster", digits_id(F.col("before_id"), 13).alias("before_id"), digits_id(F.col("after_id"), 13).alias("after_id"), F.lower(F.trim("status")).alias("status"))
    return m.where("before_id is not null and after_id is not null")


_M = "m AS (SELECT pair_ref, roaster, regexp_extract(before_id, '[0-9]{13}') AS b, regexp_extract(after_id, '[0-9]{13}') AS a, lower(trim(status)) AS status FROM match_candidates WHERE regexp_matches(before_id, '[0-9]{13}') AND regexp_matches(after_id, '[0-9]{13}'))"


@query(f"""WITH {_M} SELECT pair_ref, CASE WHEN status = 'linked' AND (count(*) FILTER (WHERE status = 'linked') OVER (PARTITION BY roaster, b) > 1 OR count(*) FILTER (WHERE status = 'linked') OVER (PARTITION BY roaster, a) > 1) THEN 'conflict' ELSE status END AS status FROM m""")
def match_resolve(spark, d):
    return I.resolve_conflicts(_links(spark, d)).select("pair_ref", "status")


@query(f"""WITH RECURSIVE {_M}, {PANEL},
n AS (SELECT roaster, product_id, min(quarter) AS fq FROM panel WHERE product_id IS NOT NULL GROUP BY ALL),
e AS (SELECT roaster, a AS x, b AS y FROM m WHERE status IN ('linked', 'linked_human') AND a <> b UNION SELECT roaster, b, a FROM m WHERE status IN ('linked', 'linked_human') AND a <> b),
ne AS (SELECT e.* FROM e WHERE EXISTS (SELECT 1 FROM n WHERE n.roaster = e.roaster AND n.product_id = e.x) AND EXISTS (SELECT 1 FROM n WHERE n.roaster = e.roaster AND n.product_id = e.y)),
r AS (SELECT roaster, product_id AS v, product_id AS g FROM n UNION SELECT r.roaster, ne.y, r.g FROM r JOIN ne ON ne.roaster = r.roaster AND ne.x = r.v),
k AS (SELECT r.roaster, r.v AS product_id, arg_min(r.g, n.fq || r.g) AS root FROM r JOIN n ON n.roaster = r.roaster AND n.product_id = r.g GROUP BY ALL)
SELECT roaster, product_id, trim(regexp_replace(lower(roaster), '[^a-z0-9]+', '-', 'g'), '-') || ':' || root AS product_key FROM k""")
def product_keys_cc(spark, d):
    products = _panel(spark, d).where("product_id is not null").groupBy("roaster", "product_id").agg(F.min("quarter").alias("first_quarter"))
    return I.product_keys(products, _links(spark, d).where("status in ('linked', 'linked_human')"))


@query(f"""WITH RECURSIVE {INDEX}, l AS (SELECT roaster, max(quarter) AS quarter, arg_max(index, quarter) AS index FROM idx WHERE main_segment GROUP BY 1)
SELECT i.roaster, count(*) AS n_items, round(median(ppg), 6) AS median_ppg, any_value(l.quarter) AS quarter, round(any_value(l.index), 6) AS index FROM items i LEFT JOIN l ON l.roaster = i.roaster GROUP BY 1""")
def positioning(spark, d):
    items = _items(spark, d)
    return _round(L.positioning(items, PI.normalise(PI.chain(items))), "median_ppg", "index")


@query("SELECT item_id, CASE WHEN length(trim(answer)) = 0 THEN 'no evidence' WHEN NOT contains(regexp_replace(lower(passage), '\\s+', ' ', 'g'), lower(answer)) THEN 'evidence not in source' END AS error FROM eval_items WHERE answer IS NOT NULL")
def evidence_check(spark, d):
    e = _t(spark, d, "eval_items").where("answer is not null")
    return e.select("item_id", V.evidence_errors(F.lit("x"), F.col("answer"), F.col("passage")).alias("error"))


@query("""WITH x AS (SELECT doc_id, coalesce(rater, '') AS rater, coalesce(lower(trim(subject_area)), '') AS a FROM subject_labels), l AS (SELECT doc_id, arg_min(a, rater || '|' || a) AS g, arg_max(a, rater || '|' || a) AS p FROM x GROUP BY 1)
SELECT 'area' AS field, count(*) AS n, round(avg((g = p)::INT), 3) AS accuracy, count(*) FILTER (WHERE g NOT IN ('', 'unknown')) AS gold_known, round(avg((g = p)::INT) FILTER (WHERE g NOT IN ('', 'unknown')), 3) AS found, round(avg((p NOT IN ('', 'unknown'))::INT) FILTER (WHERE g IN ('', 'unknown')), 3) AS invented FROM l""")
def label_scores(spark, d):
    """How often the last rater of a document says what the first one does."""
    area, rater = F.coalesce(F.lower(F.trim("subject_area")), F.lit("")), F.coalesce("rater", F.lit(""))
    lab = _t(spark, d, "subject_labels").select("doc_id", area.alias("area"), F.concat(rater, F.lit("|"), area).alias("by")).groupBy("doc_id")
    return V.field_scores(lab.agg(F.min_by("area", "by").alias("area")), lab.agg(F.max_by("area", "by").alias("area")), ["doc_id"], {"area": "closed"})


@query("""WITH s AS (SELECT source AS g, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), b AS (SELECT g, n, least(5, n) AS base, n - least(5, n) AS spare FROM s),
r AS (SELECT *, (100 - sum(base) OVER ()) * spare / (sum(spare) OVER ())::DOUBLE AS raw FROM b), w AS (SELECT *, floor(raw) AS whole, raw - floor(raw) AS part FROM r),
k AS (SELECT *, row_number() OVER (ORDER BY part DESC, g) AS rk, 100 - sum(base) OVER () - sum(whole) OVER () AS lft FROM w)
SELECT g AS "group", n, (base + whole + (rk <= lft AND base + whole < n)::INT)::BIGINT AS quota FROM k""")
def allocate_quota(spark, d):
    return V.allocate(_t(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("group")).agg(F.count(F.lit(1)).alias("n")), 100, 5)


@query()
def stratified_sample(spark, d):
    docs = _t(spark, d, "documents").where("source is not null").select("doc_id", "source")
    return V.stratified_sample(docs, "source", "doc_id", allocate_quota(spark, d))


@query(r"""WITH p AS (SELECT DISTINCT payload_id, trim(payload) AS t FROM page_payloads WHERE payload IS NOT NULL),
j AS (SELECT payload_id, CASE WHEN starts_with(t, '{') OR starts_with(t, '[') THEN t WHEN starts_with(t, 'var meta = ') THEN split_part(substr(t, 12), ';' || chr(10), 1) END AS s FROM p)
SELECT payload_id, 0 AS n, CASE WHEN json_type(s) = 'OBJECT' THEN array_to_string(list_sort(json_keys(s)), ',') END AS keys, json_array_length(s)::INT AS items FROM j WHERE json_valid(s)""")
def embedded_json(spark, d):
    """Every JSON value in the payloads, with its fields (of an object) or its length (of a list)."""
    got = S.embedded_json(_t(spark, d, "page_payloads").distinct(), "payload_id", "payload")
    keys = F.array_join(F.array_sort(F.json_object_keys("json")), ",")
    return got.select("payload_id", "n", F.when(F.col("json").startswith("{"), keys).alias("keys"), F.coalesce(F.json_array_length("json"), F.lit(0)).alias("items"))


@query()
def embedded_json_all(spark, d):
    """The JSON itself, of all payloads: those that are bare JSON, and those with anything before the marker."""
    return S.embedded_json(_t(spark, d, "page_payloads"), "payload_id", "payload")


@query("WITH n AS (SELECT user_id::VARCHAR AS roaster, ts::DATE AS day, count(DISTINCT event_type) AS n FROM events GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY roaster ORDER BY day) AS p FROM n) SELECT roaster, day, n AS n_products, p AS prev_products, coalesce(n < 0.5 * p, false) AS big_drop FROM l")
def snapshot_status(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("roaster"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("product_id"))
    return T.snapshot_status(e, "day")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    """A stream over the events, run to its end: counts per day and kind. Update mode keeps the windows that are still open."""
    source = _t(spark, d, "events")
    scratch = Scratch(spark, "stream")
    scratch.write(source)
    stream = spark.readStream.schema(source.schema).parquet(f"{scratch.root}/0")
    out = f"{scratch.root}/out"

    def keep(batch, batch_id):
        batch.write.mode("append").parquet(out)

    run = T.windowed_counts(stream, F.col("ts"), "event_type", "1 day", "40 days").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.parquet(out).groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "n").alias("l"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "l.n", F.round("l.total", 4).alias("total"))


@query("SELECT DISTINCT user_id::VARCHAR AS roaster, ts::DATE AS day FROM events")
def stream_snapshots(spark, d):
    """Snapshots taken from a stream into an append-only table; taking it twice adds nothing."""
    source = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("roaster"), F.col("ts").cast("date").alias("day")).distinct()
    scratch = Scratch(spark, "tracker")
    scratch.write(source)
    for state in ("a", "b"):
        stream = spark.readStream.schema(source.schema).parquet(f"{scratch.root}/0")
        T.run_tracker(spark, stream, f"{scratch.root}/table", ["roaster", "day"], f"{scratch.root}/{state}").awaitTermination()
    return spark.read.parquet(f"{scratch.root}/table").drop("run", "batch")


@query(f"""WITH {PANEL}, x AS (SELECT * FROM panel WHERE product_id IS NOT NULL),
p AS (SELECT roaster, product_id, quarter, max(product_title) AS title, max(product_type) AS kind FROM x GROUP BY ALL),
s AS (SELECT roaster, product_id, arg_max(title, quarter) FILTER (WHERE title IS NOT NULL) AS product_title, arg_max(kind, quarter) FILTER (WHERE kind IS NOT NULL) AS product_type, min(quarter) AS first_quarter, max(quarter) AS last_quarter, count(*) AS n_quarters, count(DISTINCT title) AS n_titles FROM p GROUP BY ALL),
v AS (SELECT roaster, product_id, string_agg(variant_title, ' | ' ORDER BY q, variant_title) AS variant_titles FROM (SELECT roaster, product_id, variant_title, min(quarter) AS q FROM x WHERE variant_title <> '' GROUP BY ALL) GROUP BY ALL),
g AS (SELECT roaster, product_id, count(*) FILTER (WHERE is_coffee_guess) AS y, count(*) FILTER (WHERE NOT is_coffee_guess) AS n, coalesce(bool_or(is_bundle), false) AS any_bundle FROM x GROUP BY ALL)
SELECT roaster, product_id, product_title, coalesce(variant_titles, '') AS variant_titles, product_type, CASE WHEN y + n > 0 THEN y > n END AS guess, any_bundle, first_quarter, last_quarter, n_quarters FROM s JOIN g USING (roaster, product_id) LEFT JOIN v USING (roaster, product_id)""")
def product_build(spark, d):
    return PG.products(_panel(spark, d).where("product_id is not null")).drop("other_titles")


@query("""WITH c AS (SELECT roaster, left(served_ts, 8) AS s FROM coverage_report WHERE regexp_matches(served_ts, '^[0-9]{8}')), q AS (SELECT roaster, year(t) || 'Q' || quarter(t) AS q, t FROM (SELECT roaster, try_strptime(s, '%Y%m%d') AS t FROM c) WHERE t IS NOT NULL)
SELECT roaster, count(*) FILTER (WHERE q = '2024Q1') AS "2024Q1", count(*) FILTER (WHERE q = '2024Q2') AS "2024Q2", (count(*) FILTER (WHERE q = '2024Q1') > 0)::INT + (count(*) FILTER (WHERE q = '2024Q2') > 0)::INT AS quarters_covered, strftime(min(t), '%Y-%m-%d') AS earliest FROM q GROUP BY 1""")
def capture_calendar(spark, d):
    c = _t(spark, d, "coverage_report").where("served_ts rlike '^[0-9]{8}'")
    return PG.capture_calendar(c, "served_ts", ["2024Q1", "2024Q2"])


@query(r"""WITH s AS (SELECT roaster, trim(served_ts) AS s FROM coverage_report),
d AS (SELECT roaster, rpad(CASE WHEN regexp_full_match(s, '[0-9]{14}|[0-9]{8}') THEN s WHEN regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?([.][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?')
  THEN regexp_replace(regexp_replace(s, '([.][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$', ''), '[^0-9]', '', 'g') END, 14, '0') AS x FROM s),
c AS (SELECT roaster, t, year(t) * 4 + quarter(t) - 1 AS i FROM (SELECT roaster, try_strptime(left(x, 8), '%Y%m%d') AS t FROM d WHERE substr(x, 9, 2) < '24' AND substr(x, 11, 2) < '60' AND substr(x, 13, 2) < '60') WHERE t IS NOT NULL),
r AS (SELECT roaster, count(DISTINCT i)::INT AS quarters_covered, strftime(min(t), '%Y-%m-%d') AS earliest FROM c GROUP BY 1), g AS (SELECT unnest(range((SELECT min(i) FROM c), (SELECT max(i) FROM c) + 1)) AS i),
n AS (SELECT roaster, i, count(*) AS n FROM c GROUP BY ALL)
SELECT r.roaster, (g.i // 4)::VARCHAR || 'Q' || (g.i % 4 + 1)::VARCHAR AS quarter, coalesce(n.n, 0) AS n, quarters_covered, earliest FROM r CROSS JOIN g LEFT JOIN n ON n.roaster = r.roaster AND n.i = g.i""")
def capture_calendar_all(spark, d):
    """The calendar of all readable captures and quarters, a row per roaster and quarter."""
    wide = PG.capture_calendar(_t(spark, d, "coverage_report"), "served_ts")
    return wide.unpivot(["roaster", "quarters_covered", "earliest"], None, "quarter", "n").select("roaster", "quarter", "n", "quarters_covered", "earliest")


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""WITH h AS (SELECT DISTINCT roaster, {_SLUG.format("split_part(after_title, '|', 1)")} AS handle FROM match_candidates), p AS (SELECT DISTINCT roaster, {_SLUG.format('before_title')} AS slug FROM match_candidates UNION SELECT roaster, {_SLUG.format('after_title')} FROM match_candidates),
n AS (SELECT p.roaster, p.slug, count(*) AS c, min(handle) AS handle FROM p JOIN h ON h.roaster = p.roaster AND h.handle <> '' AND (starts_with(h.handle, p.slug || '-') OR starts_with(p.slug, h.handle || '-')) GROUP BY ALL)
SELECT p.roaster, p.slug, coalesce(h.handle, n.handle) AS handle, CASE WHEN h.handle IS NOT NULL THEN 'exact' WHEN n.handle IS NOT NULL THEN 'prefix' ELSE 'unmapped' END AS handle_source
FROM p LEFT JOIN h ON h.roaster = p.roaster AND h.handle = p.slug LEFT JOIN n ON n.roaster = p.roaster AND n.slug = p.slug AND n.c = 1""")
def match_handles(spark, d):
    m = _t(spark, d, "match_candidates")
    h = m.select("roaster", X.slugify(F.split("after_title", r"\|").getItem(0)).alias("handle")).where("handle <> ''").distinct()
    p = m.select("roaster", X.slugify(F.col("before_title")).alias("slug")).union(m.select("roaster", X.slugify(F.col("after_title")))).distinct()
    return PG.match_handles(p, h, "roaster", "slug").select("roaster", "slug", "handle", "handle_source")


@query()
def card_snippets(spark, d):
    """Cards of a page made of each pair's two titles."""
    m = _t(spark, d, "match_candidates")
    pages = m.select("pair_ref", F.concat_ws(" notes of cocoa 250g ", "before_title", "after_title", F.lit("end")).alias("text"))
    titles = m.select("pair_ref", F.lit("b").alias("product_id"), F.col("before_title").alias("product_title")).union(m.select("pair_ref", F.lit("a"), "after_title"))
    return PG.card_snippets(pages, titles, "pair_ref", "text")


@query()
def page_variant_sizes(spark, d):
    """Sizes of the variants that captured pages detail."""
    return PG.variant_sizes(_t(spark, d, "page_payloads"), "payload_id", "payload").distinct()


@query(f"""WITH RECURSIVE {CHAIN}, s AS (SELECT roaster, segment, arg_min(raw_level, quarter) AS base FROM walk GROUP BY ALL), l AS (SELECT roaster, arg_max(segment, quarter) AS seg FROM walk GROUP BY 1)
SELECT w.roaster, w.quarter, w.segment::INT AS segment, round(raw_level / base * 100, 6) AS index, w.segment = l.seg AS main_segment FROM walk w JOIN s USING (roaster, segment) JOIN l USING (roaster)""")
def tracker_index(spark, d):
    return _round(PI.period_index(PI.chain(_items(spark, d))), "index").select("roaster", "quarter", "segment", "index", "main_segment")
