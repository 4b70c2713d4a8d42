"""Queries of the data-cleaning operators over the price-panel tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.ids import clean_quarter, digits_id, quarter_index, quarter_label
from panelwright.operators.nested import holder_rows
from panelwright.operators.regular_grid import read_timestamp, regular_grid
from panelwright.operators.snapshots import snapshot_changes
from panelwright.operators.spikes import flag_spikes
from panelwright.operators.units import common_grams
from panelwright.session import shared_dir


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Variants added, removed or changed; their ordinals are stored beside the session's shared tables, one dictionary per folder of input."""
    v = _t(spark, d, "variants_long")
    store = f"{shared_dir(spark).rstrip('/')}/ordinals-{hashlib.md5(d.encode()).hexdigest()[:12]}"
    changes = snapshot_changes(v, F.col("roaster"), digits_id(F.col("variant_id"), 14).cast("long"), clean_quarter(F.col("quarter")), F.col("served_ts"), F.col("price_inr"), store=store)
    return changes.select(F.lpad(F.col("key").cast("string"), 14, "0").alias("variant_id"), F.col("period").alias("quarter"), "change_kind")


_COUNTING = """
v AS (SELECT roaster, nullif(regexp_extract(variant_id, '[0-9]{14}'), '') AS variant_id,
        regexp_extract(quarter, '[0-9]{4}') || 'Q' || regexp_extract(upper(quarter), 'Q *([1-4])', 1) AS quarter,
        price_inr, compare_at_price_inr, coalesce(served_ts, '') AS ts FROM variants_long),
ranked AS (SELECT *, row_number() OVER (PARTITION BY roaster, variant_id, quarter ORDER BY ts DESC, price_inr ASC NULLS LAST) AS rn FROM v WHERE quarter IS NOT NULL),
cnt AS (SELECT roaster, variant_id, quarter, price_inr FROM ranked WHERE rn = 1 AND variant_id IS NOT NULL),
snaps AS (SELECT roaster, quarter, row_number() OVER (PARTITION BY roaster ORDER BY quarter) AS i FROM (SELECT DISTINCT roaster, quarter FROM v))
"""

P2_SQL = f"""
WITH {_COUNTING},
c AS (SELECT c.*, s.i FROM cnt c JOIN snaps s ON c.roaster IS NOT DISTINCT FROM s.roaster AND c.quarter = s.quarter),
step AS (SELECT a.roaster, a.i, a.quarter FROM snaps a WHERE a.i > 1)
SELECT coalesce(n.variant_id, o.variant_id) AS variant_id, s.quarter,
  CASE WHEN o.variant_id IS NULL THEN 'added' WHEN n.variant_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT roaster, variant_id, i, price_inr, 1 AS side FROM c) n
FULL JOIN (SELECT roaster, variant_id, i + 1 AS i, price_inr FROM c) o ON n.roaster IS NOT DISTINCT FROM o.roaster AND n.variant_id = o.variant_id AND n.i = o.i
JOIN step s ON s.roaster IS NOT DISTINCT FROM coalesce(n.roaster, o.roaster) AND s.i = coalesce(n.i, o.i)
WHERE o.variant_id IS NULL OR n.variant_id IS NULL OR abs(n.price_inr - o.price_inr) >= 0.005 OR (n.price_inr IS NULL) <> (o.price_inr IS NULL)
"""



def p3_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Implausible price readings with the rule that found them and their isolation score."""
    v = _t(spark, d, "variants_long")
    found = flag_spikes(v, F.col("roaster"), digits_id(F.col("variant_id"), 14), quarter_index(clean_quarter(F.col("quarter"))), F.col("served_ts"), F.col("price_inr"), F.col("compare_at_price_inr"))
    field = F.when(F.col("field") == "main", "price_inr").otherwise("compare_at_price_inr")
    return found.select(F.col("series").alias("variant_id"), quarter_label(F.col("t")).alias("quarter"), field.alias("field"), "rule", F.round("score", 6).alias("score"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_spikes(spark, d).select("variant_id", "quarter", "field")


def _captures(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """The captures of coverage_report with their time, and the quarter it falls in."""
    c = _t(spark, d, "coverage_report").withColumn("at", read_timestamp(F.col("served_ts")))
    quarter = F.concat(F.substring("at", 1, 4), F.lit("Q"), F.ceil(F.substring("at", 6, 2).cast("int") / 3).cast("string"))
    return c, quarter_index(quarter)


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    """Each roaster's unbroken quarterly series of its variant counts."""
    c, quarter = _captures(spark, d)
    grid = regular_grid(c, F.col("roaster"), quarter, F.col("at"), F.col("variant_count"))
    return grid.select(F.col("source").alias("roaster"), quarter_label(F.col("period")).alias("quarter"), "observed", "value", F.round("filled", 4).alias("filled"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The quarters that the whole operator, with its seasonal regression, lays out and fills because they have no capture."""
    return p5_grid(spark, d).where(~F.col("observed")).select("roaster", "quarter")


P5_SQL = """
WITH c AS (SELECT roaster, trim(served_ts) AS s FROM coverage_report),
t AS (SELECT roaster, CASE
    WHEN regexp_full_match(s, '[0-9]{14}') THEN try_strptime(s, '%Y%m%d%H%M%S')
    WHEN regexp_full_match(s, '[0-9]{8}') THEN try_strptime(s, '%Y%m%d')
    ELSE try_cast(replace(s, 'T', ' ') AS timestamp) END AS cap FROM c),
q AS (SELECT DISTINCT roaster, year(cap) * 4 + quarter(cap) - 1 AS i FROM t WHERE cap IS NOT NULL),
g AS (SELECT roaster, unnest(range(min(i), max(i) + 1)) AS i FROM q GROUP BY roaster)
SELECT g.roaster, CAST(g.i // 4 AS varchar) || 'Q' || CAST(g.i % 4 + 1 AS varchar) AS quarter
FROM g WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.roaster IS NOT DISTINCT FROM g.roaster AND q.i = g.i)
"""


P5_GRID_SQL = r"""
WITH RECURSIVE c AS (SELECT roaster, trim(served_ts) AS s, variant_count AS v FROM coverage_report),
t AS (SELECT roaster, v, CASE WHEN regexp_full_match(s, '[0-9]{14}') THEN try_strptime(s, '%Y%m%d%H%M%S') WHEN regexp_full_match(s, '[0-9]{8}') THEN try_strptime(s, '%Y%m%d') ELSE try_cast(replace(s, 'T', ' ') AS timestamp) END AS cap FROM c),
q AS (SELECT roaster, year(cap) * 4 + quarter(cap) - 1 AS i, strftime(cap, '%Y-%m-%d %H:%M:%S') AS o, v::DOUBLE AS v FROM t WHERE cap IS NOT NULL),
s AS (SELECT roaster, i, v AS x FROM q QUALIFY row_number() OVER (PARTITION BY roaster, i ORDER BY o DESC, v DESC NULLS LAST) = 1),
m AS (SELECT roaster, avg(i) AS mid FROM s WHERE x IS NOT NULL GROUP BY 1),
f AS (SELECT s.roaster, s.i, x, [1.0, (s.i - mid) / 4.0, cos(s.i * pi() / 2), sin(s.i * pi() / 2), cos(s.i * pi())]::DOUBLE[] AS b FROM s JOIN m ON m.roaster IS NOT DISTINCT FROM s.roaster WHERE x IS NOT NULL),
ne AS (SELECT roaster, r, c, sum(b[r] * CASE WHEN c <= 5 THEN b[c] ELSE x END) AS a, count(*) AS n FROM f, range(1, 6) rr(r), range(1, 7) cc(c) GROUP BY ALL),
mx AS (SELECT roaster, list(row ORDER BY r) AS a FROM (SELECT roaster, r, list(a + CASE WHEN r <> c THEN 0.0 WHEN r = 1 THEN 1e-9 * n ELSE 1e-3 * n END ORDER BY c) AS row FROM ne GROUP BY ALL) GROUP BY 1),
el AS (SELECT roaster, 1 AS k, a FROM mx UNION ALL SELECT roaster, k + 1, list_transform(a, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda z: z / row[k]) ELSE list_transform(row, lambda z, j: z - row[k] * a[k][j] / a[k][k]) END) FROM el WHERE k <= 5),
w AS (SELECT el.roaster, mid, list_transform(a, lambda row: row[6]) AS w FROM el JOIN m ON m.roaster IS NOT DISTINCT FROM el.roaster WHERE k = 6),
g AS (SELECT roaster, unnest(range(min(i), max(i) + 1)) AS i FROM s GROUP BY roaster),
h AS (SELECT g.roaster, g.i, s.i IS NOT NULL AS observed, x, w.w[1] + w.w[2] * (g.i - mid) / 4.0 + w.w[3] * cos(g.i * pi() / 2) + w.w[4] * sin(g.i * pi() / 2) + w.w[5] * cos(g.i * pi()) AS fitted FROM g LEFT JOIN s ON s.roaster IS NOT DISTINCT FROM g.roaster AND s.i = g.i LEFT JOIN w ON w.roaster IS NOT DISTINCT FROM g.roaster),
r AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY roaster ORDER BY i) AS pi_, min(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY roaster ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM h),
e AS (SELECT r.*, p.x - p.fitted AS pr, n.x - n.fitted AS nr FROM r LEFT JOIN h p ON p.roaster IS NOT DISTINCT FROM r.roaster AND p.i = r.pi_ LEFT JOIN h n ON n.roaster IS NOT DISTINCT FROM r.roaster AND n.i = r.ni)
SELECT roaster, CAST(i // 4 AS varchar) || 'Q' || CAST(i % 4 + 1 AS varchar) AS quarter, observed, x AS value, round(coalesce(x, fitted + CASE WHEN pr IS NULL THEN nr WHEN nr IS NULL OR ni = pi_ THEN pr ELSE pr + (i - pi_) / (ni - pi_)::DOUBLE * (nr - pr) END), 4) AS filled FROM e
"""


def p6_grams(spark: SparkSession, d: str) -> DataFrame:
    """Every size before the change, in grams, with where its unit comes from."""
    s = _t(spark, d, "size_changes")
    level = F.lower(F.trim(F.coalesce("level", F.lit(""))))
    s = s.select(digits_id(F.col("product_id"), 13).alias("product"), F.when(level == "product", F.lit("")).otherwise(F.coalesce(digits_id(F.col("variant_id"), 14), F.lit(""))).alias("variant"), clean_quarter(F.col("from_quarter")).alias("since"), "sizes_before", "variant_title_before", "size_source_before")
    return common_grams(s, "sizes_before", "variant_title_before", "size_source_before", ["product", "variant", "since"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_grams(spark, d).select(F.col("product").alias("product_id"), F.col("variant").alias("variant_id"), F.col("since").alias("from_quarter"), F.round("grams").try_cast("long").alias("grams")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, rows = holder_rows(_t(spark, d, "page_payloads"), F.col("payload_id"), F.col("payload"))
    return rows.where("holder_id is not null and row_id is not null").select(F.col("doc").alias("payload_id"), F.col("holder_id").alias("product_id"), F.col("row_id").alias("variant_id"), F.col("title").alias("variant_title")).distinct()


P7_SQL = r"""
WITH RECURSIVE p AS (SELECT DISTINCT payload_id, trim(payload) AS t FROM page_payloads WHERE payload IS NOT NULL),
j AS (SELECT payload_id, CASE WHEN starts_with(t, '{') OR starts_with(t, '[') THEN t WHEN starts_with(t, 'var meta = ') THEN split_part(substr(t, 12), ';' || chr(10), 1) END AS s FROM p),
n AS MATERIALIZED (SELECT payload_id, s, x.key, x.value, x.type, x.id, x.parent FROM (SELECT * FROM j WHERE json_valid(s)), json_tree(s) x),
o AS MATERIALIZED (SELECT *, json_exists(value, '$.variants') AS holds, NOT json_exists(value, '$.variants') AND NOT json_exists(value, '$.id') AND (json_exists(value, '$.edges') OR json_exists(value, '$.nodes') OR json_exists(value, '$.node')) AS wraps FROM n),
w AS (SELECT v.payload_id, v.s, v.parent AS holder, v.id, v.type, v.value, v.wraps FROM o v WHERE v.key = 'variants'
  UNION ALL SELECT c.payload_id, c.s, w.holder, c.id, c.type, c.value, c.wraps FROM w JOIN o c ON c.payload_id = w.payload_id AND c.s = w.s AND c.parent = w.id AND (w.type = 'ARRAY' OR (w.type = 'OBJECT' AND w.wraps AND c.key IN ('edges', 'nodes', 'node')))),
r AS (SELECT w.payload_id, h.value AS hv, w.value AS v FROM w JOIN o h ON h.payload_id = w.payload_id AND h.s = w.s AND h.id = w.holder WHERE w.type = 'OBJECT' AND NOT w.wraps),
d AS (SELECT payload_id, nullif(regexp_extract(regexp_replace(json_extract_string(hv, '$.id'), '\.0*$', ''), '([0-9]+)[^0-9]*$', 1), '') AS product_id, nullif(regexp_extract(regexp_replace(json_extract_string(v, '$.id'), '\.0*$', ''), '([0-9]+)[^0-9]*$', 1), '') AS variant_id, json_extract_string(v, '$.public_title') AS pt, json_extract_string(v, '$.title') AS ti,
  CASE WHEN json_type(v, '$.options') = 'ARRAY' THEN array_to_string(json_extract_string(v, '$.options[*]'), ' / ') ELSE json_extract_string(v, '$.options') END AS op FROM r)
SELECT DISTINCT payload_id, product_id, variant_id, CASE WHEN trim(pt) <> '' THEN pt WHEN trim(ti) <> '' THEN ti ELSE coalesce(op, '') END AS variant_title FROM d WHERE product_id IS NOT NULL AND variant_id IS NOT NULL
"""

QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_spikes": p3_spikes, "p5_found": p5_found, "p5_grid": p5_grid, "p6_found": p6_found, "p6_grams": p6_grams, "p7_found": p7_found}
ORACLES = {"p2_found": P2_SQL, "p5_found": P5_SQL, "p5_grid": P5_GRID_SQL, "p7_found": P7_SQL}
