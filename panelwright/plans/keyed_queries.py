"""Queries of keys over time, size changes, levers and hedonic fits, on the order lines read as a panel in which titles, sizes and prices change."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import text as X
from panelwright.functions.periods import quarter_of
from panelwright.operators import changes as K
from panelwright.operators import identity as I
from panelwright.operators import levers as L
from panelwright.operators import panel as P
from panelwright.operators import price_index as PI
from panelwright.operators import regression as R
from panelwright.plans.panel_queries import INDEX, ITEMS, PRE, _round, _t
from panelwright.session import Scratch

QUERIES: dict = {}
ORACLES: dict = {}
BASE = ("1995Q1", "1995Q2", "1995Q3", "1995Q4", "1996Q1")
SHOCK = "1996Q2"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LINES = """
lines AS (SELECT p_brand AS roaster, CASE WHEN length(p_brand) <= 7 THEN 'core' ELSE 'secondary' END AS tier, l_partkey::VARCHAR AS product_id, (l_partkey * 10 + l_linenumber)::VARCHAR AS variant_id, year(l_shipdate)::VARCHAR || 'Q' || quarter(l_shipdate)::VARCHAR AS quarter,
  CASE WHEN year(any_value(l_shipdate)) >= 2001 THEN 'live' ELSE 'archive' END AS source_type, strftime(min(l_shipdate), '%Y%m%d') || '000000' AS served_ts,
  any_value(p_name) || CASE WHEN year(any_value(l_shipdate)) < 1998 THEN ' washed' WHEN any_value(p_type) = 'SMALL' THEN ' natural' ELSE ' Washed roast' END || CASE WHEN year(any_value(l_shipdate)) < 1999 THEN '' ELSE ' lot #' || any_value(p_size)::VARCHAR END AS product_title,
  min(l_quantity)::DOUBLE AS quantity, any_value(p_size)::DOUBLE AS size_grams, min(l_extendedprice)::DOUBLE AS price_inr,
  CASE max(l_returnflag) WHEN 'R' THEN 'variant_title' WHEN 'N' THEN 'product_title' ELSE 'listing_text' END AS size_source, max(l_linestatus) AS variant_title,
  max(l_returnflag) = 'A' AND min(l_linestatus) = 'O' AS served_outside_quarter, any_value(p_name) LIKE '%ring' AS is_bundle, CASE WHEN any_value(p_type) = 'PROMO' THEN false END AS is_coffee_guess
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, l_partkey, l_linenumber, year(l_shipdate), quarter(l_shipdate))"""


def _lines(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size")
    j = _t(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus").join(part, F.col("l_partkey") == F.col("p_partkey"))
    keys = [F.col("p_brand").alias("roaster"), F.when(F.length("p_brand") <= 7, "core").otherwise("secondary").alias("tier"), F.col("l_partkey").cast("string").alias("product_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("string").alias("variant_id"), quarter_of(F.col("l_shipdate")).alias("quarter"), F.year("l_shipdate").alias("y"), "p_name", "p_type", "p_size"]
    g = j.groupBy(*keys).agg(F.date_format(F.min("l_shipdate"), "yyyyMMdd").alias("day"), F.min("l_quantity").cast("double").alias("quantity"), F.min("l_extendedprice").cast("double").alias("price_inr"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("variant_title"), F.min("l_linestatus").alias("open"))
    title = F.concat("p_name", F.when(F.col("y") < 1998, " washed").when(F.col("p_type") == "SMALL", " natural").otherwise(" Washed roast"), F.when(F.col("y") < 1999, "").otherwise(F.concat(F.lit(" lot #"), F.col("p_size").cast("string"))))
    return g.select(
        "roaster", "tier", "product_id", "variant_id", "quarter", F.when(F.col("y") >= 2001, "live").otherwise("archive").alias("source_type"), F.concat("day", F.lit("000000")).alias("served_ts"), title.alias("product_title"),
        "quantity", F.col("p_size").cast("double").alias("size_grams"), "price_inr", F.when(F.col("flag") == "R", "variant_title").when(F.col("flag") == "N", "product_title").otherwise("listing_text").alias("size_source"), "variant_title",
        ((F.col("flag") == "A") & (F.col("open") == "O")).alias("served_outside_quarter"), F.col("p_name").endswith("ring").alias("is_bundle"), F.when(F.col("p_type") == "PROMO", False).alias("is_coffee_guess"),
    )


def _words_sql(t: str) -> str:
    generic = ", ".join(f"'{w}'" for w in X.GENERIC_WORDS)
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({generic})))"


def _processes_sql(t: str) -> str:
    """The processes of a title: what one pattern has taken is blank for those after it."""
    rest, found = f"lower({t})", []
    for pattern, name in X.PROCESSES:
        p = pattern.replace("'", "''")
        found.append(f"list_transform(regexp_extract_all({rest}, '{p}', 1), lambda h: h || ' honey')" if name is None else f"CASE WHEN regexp_matches({rest}, '{p}') THEN ['{name}'] ELSE []::VARCHAR[] END")
        if name in (None, "semi-washed", "anaerobic"):
            rest = f"regexp_replace({rest}, '{p}', ' ', 'g')"
    return f"list_sort(list_distinct(flatten([{', '.join(found)}])))"


def _lots_sql(t: str) -> str:
    p = X.LOT_NUMBER
    return f"list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(lower({t}), '{p}', 1), regexp_extract_all(lower({t}), '{p}', 2)), lambda z: CASE WHEN z[1] <> '' THEN z[1] ELSE z[2] END)))"


def _step_sql(table: str, keys: str, a: str, b: str) -> str:
    """Of each row of a table with two titles: overlap, changed, different."""
    return f"""(SELECT {keys}, overlap, changed, overlap < 0.5 OR changed AS different FROM (SELECT {keys}, coalesce(len(list_intersect(wa, wb)) / nullif(len(list_distinct(list_concat(wa, wb))), 0)::DOUBLE, 1.0) AS overlap,
  (len(pa) > 0 AND len(pb) > 0 AND pa <> pb) OR (len(la) > 0 AND len(lb) > 0 AND la <> lb) AS changed
  FROM (SELECT {keys}, {_words_sql(a)} AS wa, {_words_sql(b)} AS wb, {_processes_sql(a)} AS pa, {_processes_sql(b)} AS pb, {_lots_sql(a)} AS la, {_lots_sql(b)} AS lb FROM {table})))"""


@query(f"""WITH m AS (SELECT pair_ref, coalesce(before_title, '') AS a, coalesce(after_title, '') AS b FROM match_candidates), s AS {_step_sql('m', 'pair_ref, a, b', 'a', 'b')}
SELECT pair_ref, array_to_string({_processes_sql('a')}, ',') AS processes, array_to_string({_lots_sql('a')}, ',') AS lots, changed, different FROM s""")
def different_title(spark, d):
    a, b = F.col("before_title"), F.col("after_title")
    return _t(spark, d, "match_candidates").select("pair_ref", F.array_join(X.process_words(a), ",").alias("processes"), F.array_join(X.lot_ids(a), ",").alias("lots"), X.process_or_lot_changed(a, b).alias("changed"), X.different_product(a, b).alias("different"))


HISTORY = f"""{LINES},
th AS (SELECT roaster, product_id, product_title, min(quarter || '|' || source_type || '|' || variant_id) AS since FROM lines GROUP BY ALL),
tn AS (SELECT roaster, product_id, product_title AS a, lead(product_title) OVER (PARTITION BY roaster, product_id ORDER BY since, product_title) AS b FROM th),
ts AS {_step_sql('(SELECT * FROM tn WHERE b IS NOT NULL)', 'roaster, product_id', 'a', 'b')},
hist AS (SELECT t.roaster, t.product_id, any_value(n) AS n_titles, round(min(overlap), 3) AS title_similarity, coalesce(bool_or(different), false) AS title_changed, coalesce(bool_or(changed), false) AS process_or_lot_changed
  FROM (SELECT roaster, product_id, count(*) AS n FROM th GROUP BY ALL) t LEFT JOIN ts USING (roaster, product_id) GROUP BY ALL)"""


@query(f"WITH {HISTORY} SELECT * FROM hist")
def title_history(spark, d):
    return I.title_history(_lines(spark, d)).withColumn("n_titles", F.size("titles").cast("long")).drop("titles")


KEYED = f"""{HISTORY},
pc AS (SELECT roaster, product_id, quarter, source_type, product_title, count(*) AS n, min(left(served_ts, 8)) AS d FROM lines GROUP BY ALL),
pq AS (SELECT roaster, product_id, quarter, source_type, product_title, min(d) OVER (PARTITION BY roaster, product_id, quarter, source_type) AS first_date FROM pc QUALIFY row_number() OVER (PARTITION BY roaster, product_id, quarter, source_type ORDER BY n DESC, product_title) = 1),
pl AS (SELECT pq.*, title_changed, lag(product_title) OVER (PARTITION BY roaster, product_id ORDER BY quarter, source_type) AS prev FROM pq JOIN hist USING (roaster, product_id)),
pd AS {_step_sql("(SELECT *, coalesce(prev, '') AS pv FROM pl)", 'roaster, product_id, quarter, source_type, product_title, first_date, title_changed, prev', 'pv', 'product_title')},
ps AS (SELECT *, (sum((title_changed AND prev IS NOT NULL AND prev <> product_title AND different)::INT) OVER (PARTITION BY roaster, product_id ORDER BY quarter, source_type) + 1)::INT AS segment FROM pd),
pb AS (SELECT *, first_value(quarter) OVER w AS sq, first_value(first_date) OVER w AS sd, max(segment) OVER (PARTITION BY roaster, product_id) AS lastseg FROM ps WINDOW w AS (PARTITION BY roaster, product_id, segment ORDER BY quarter, source_type)),
keyed AS (SELECT roaster, product_id, quarter, source_type, product_title, CASE WHEN segment > 1 THEN product_id || '@' || sq ELSE product_id END AS product_key, segment, sq AS segment_start_quarter, left(sd, 4) || '-' || substr(sd, 5, 2) || '-' || substr(sd, 7, 2) AS segment_start_date, title_changed, NOT title_changed OR segment = lastseg AS attributes_valid FROM pb)"""


def _keyed(spark, d):
    lines = _lines(spark, d)
    own = lines.select("roaster", "product_id", F.col("product_id").alias("product_key")).distinct()
    return lines, I.keyed_quarters(lines, own, I.title_history(lines))


@query(f"WITH {KEYED} SELECT * FROM keyed")
def key_segments(spark, d):
    return _keyed(spark, d)[1]


ATTRIBUTES = "attributes AS (SELECT p_brand AS roaster, p_partkey::VARCHAR AS product_id, CASE WHEN p_size > 45 THEN 'no' ELSE 'yes' END AS is_coffee, CASE WHEN p_name LIKE 'red%' THEN '' ELSE string_split(p_name, ' ')[1] END AS process, p_type AS roast_level FROM part)"


def _attributes(spark, d):
    return _t(spark, d, "part").select(F.col("p_brand").alias("roaster"), F.col("p_partkey").cast("string").alias("product_id"), F.when(F.col("p_size") > 45, "no").otherwise("yes").alias("is_coffee"), F.when(F.col("p_name").startswith("red"), "").otherwise(F.split("p_name", " ")[0]).alias("process"), F.col("p_type").alias("roast_level"))


KEYED_ITEMS = f"""{KEYED}, {ATTRIBUTES},
kv AS (SELECT l.*, k.product_key, k.attributes_valid, price_inr / size_grams * 100 AS ppg FROM lines l LEFT JOIN keyed k USING (roaster, product_id, quarter, source_type) LEFT JOIN attributes a USING (roaster, product_id)
  WHERE is_coffee = 'yes' AND coalesce(is_coffee_guess, true) AND NOT is_bundle AND NOT served_outside_quarter AND size_grams > 0 AND price_inr > 0),
kitems AS (SELECT roaster, tier, quarter, product_key, size_grams, median(ppg) AS ppg, count(*) AS n_variants, arg_min(product_id, variant_id) AS product_id, arg_min(attributes_valid, variant_id) AS attributes_valid FROM kv GROUP BY ALL)"""


def _keyed_items(spark, d):
    lines, keys = _keyed(spark, d)
    rows = P.with_keys(lines.withColumn("in_switch_window", F.lit(False)), keys, _attributes(spark, d))
    return P.price_items(P.analysis_rows(rows), "product_key")


@query(f"WITH {KEYED_ITEMS} SELECT * REPLACE (round(ppg, 6) AS ppg) FROM kitems")
def keyed_items(spark, d):
    return _round(_keyed_items(spark, d), "ppg")


def _sized(spark, d):
    return K.usable_sizes(_lines(spark, d).withColumn("size_grams", F.col("quantity")))


SIZED = f"""{KEYED},
us AS (SELECT * FROM lines WHERE coalesce(is_coffee_guess, true) AND NOT is_bundle AND NOT served_outside_quarter),
k1 AS (SELECT roaster, product_id, quarter, arg_min(product_key, source_type) AS key FROM keyed GROUP BY ALL),
vs AS (SELECT roaster, variant_id, product_title, lag(product_id) OVER w AS product_id, lag(variant_title) OVER w AS variant_title_before, variant_title AS variant_title_after, lag(quarter) OVER w AS from_quarter, quarter AS to_quarter,
  lag(quantity) OVER w AS size_before, quantity AS size_after, lag(size_source) OVER w AS size_source_before, size_source AS size_source_after FROM us WINDOW w AS (PARTITION BY roaster, variant_id ORDER BY quarter)),
vc AS (SELECT v.*, CASE WHEN size_source_before <> 'listing_text' AND size_source_after <> 'listing_text' THEN 'high' ELSE 'low' END AS confidence, a.key IS DISTINCT FROM b.key AS crosses_product_split
  FROM vs v LEFT JOIN k1 a ON a.roaster = v.roaster AND a.product_id = v.product_id AND a.quarter = from_quarter LEFT JOIN k1 b ON b.roaster = v.roaster AND b.product_id = v.product_id AND b.quarter = to_quarter WHERE size_before <> size_after)"""


def _variant_changes(spark, d):
    return K.mark_splits(K.variant_size_changes(_sized(spark, d)), _keyed(spark, d)[1])


@query(f"WITH {SIZED} SELECT * FROM vc")
def size_changes_variant(spark, d):
    return _variant_changes(spark, d)


@query(f"""WITH {SIZED}, m AS (SELECT roaster, product_id, quarter, list_sort(list_distinct(list(quantity))) AS s, bool_or(size_source = 'listing_text') AS doubtful, min(product_title) AS product_title FROM us GROUP BY ALL),
l AS (SELECT *, lag(quarter) OVER w AS from_quarter, lag(s) OVER w AS b, lag(doubtful) OVER w AS was FROM m WINDOW w AS (PARTITION BY roaster, product_id ORDER BY quarter))
SELECT roaster, product_id, product_title, from_quarter, quarter AS to_quarter, array_to_string(list_transform(b, lambda x: x::BIGINT::VARCHAR), ' ') AS sizes_before, array_to_string(list_transform(s, lambda x: x::BIGINT::VARCHAR), ' ') AS sizes_after, CASE WHEN doubtful OR was THEN 'low' ELSE 'high' END AS confidence FROM l WHERE b IS NOT NULL AND b <> s""")
def size_changes_product(spark, d):
    return K.product_size_changes(_sized(spark, d))


CUTS = f"""{SIZED}, confirmed AS (SELECT p_partkey::VARCHAR AS product_id FROM part WHERE p_retailprice >= 925),
vp AS (SELECT roaster, variant_id, quarter, price_inr, price_inr / quantity AS ppg FROM lines),
cuts AS (SELECT c.roaster, c.product_id, c.product_title, c.variant_id, from_quarter, to_quarter, size_before, size_after, ln(b.ppg / a.ppg) AS ppg_change_log FROM vc c JOIN vp a ON a.roaster = c.roaster AND a.variant_id = c.variant_id AND a.quarter = from_quarter
  JOIN vp b ON b.roaster = c.roaster AND b.variant_id = c.variant_id AND b.quarter = to_quarter WHERE confidence = 'high' AND NOT crosses_product_split AND to_quarter >= '{SHOCK}' AND size_after < size_before AND c.product_id IN (SELECT product_id FROM confirmed))"""


def _cuts(spark, d):
    confirmed = _t(spark, d, "part").where("p_retailprice >= 925").select(F.col("p_partkey").cast("string").alias("product_id"))
    lines = _lines(spark, d).withColumn("ppg", F.col("price_inr") / F.col("quantity"))
    return L.size_cuts(_variant_changes(spark, d), confirmed, lines, SHOCK), lines


@query(f"WITH {CUTS} SELECT * REPLACE (round(ppg_change_log, 6) + 0.0 AS ppg_change_log) FROM cuts")
def size_cuts(spark, d):
    return _round(_cuts(spark, d)[0], "ppg_change_log")


@query(f"""WITH {CUTS}, lp AS (SELECT roaster, variant_id, max(quarter) AS lq, arg_max(price_inr, quarter) AS pl FROM lines GROUP BY ALL)
SELECT c.roaster, product_title, from_quarter, to_quarter, size_before, size_after, count(DISTINCT c.variant_id) AS n_variants, round(median(a.price_inr), 2) AS price_before, round(median(b.price_inr), 2) AS price_after, round(median(round((exp(ppg_change_log) - 1) * 100, 1)), 2) + 0.0 AS ppg_change_pct, max(lq) AS latest_quarter, round(median(pl), 2) AS price_latest
FROM cuts c JOIN vp a ON a.roaster = c.roaster AND a.variant_id = c.variant_id AND a.quarter = from_quarter JOIN vp b ON b.roaster = c.roaster AND b.variant_id = c.variant_id AND b.quarter = to_quarter JOIN lp ON lp.roaster = c.roaster AND lp.variant_id = c.variant_id GROUP BY ALL""")
def cut_table(spark, d):
    return _round(L.cut_table(*_cuts(spark, d)), "price_before", "price_after", "ppg_change_pct", "price_latest", n=2)


LINE_ITEMS = f"{CUTS},\nitems AS (SELECT roaster, tier, quarter, product_id AS product_key, size_grams, median(price_inr / size_grams * 100) AS ppg, count(*) AS n_variants FROM lines GROUP BY ALL)"
LINE_PRE = f"({', '.join(repr(q) for q in BASE)})"
LINE_INDEX = INDEX.replace(ITEMS, LINE_ITEMS).replace(PRE, LINE_PRE)


@query(f"""WITH RECURSIVE {LINE_INDEX},
cov AS (SELECT roaster, quarter FROM (SELECT roaster, quarter, count(*) FILTER (WHERE source_type = 'archive') AS n, count(DISTINCT product_id) AS p FROM lines GROUP BY ALL) WHERE n > 0 AND p % 4 <> 0),
mn AS (SELECT roaster, quarter, index FROM idx WHERE main_segment), l AS (SELECT roaster, max(quarter) AS e, arg_max(index, quarter) - 100 AS lfl FROM mn GROUP BY 1),
b AS (SELECT i.* FROM items i JOIN mn USING (roaster, quarter) JOIN cov USING (roaster, quarter) WHERE i.quarter IN {LINE_PRE}),
a AS (SELECT i.* FROM items i JOIN l ON l.roaster = i.roaster AND l.e = i.quarter),
l0 AS (SELECT roaster, avg(x) AS l0 FROM (SELECT roaster, quarter, avg(ln(ppg)) AS x FROM b GROUP BY ALL) GROUP BY 1), l1 AS (SELECT roaster, avg(ln(ppg)) AS l1 FROM a GROUP BY 1),
p AS (SELECT coalesce(x.roaster, y.roaster) AS roaster, count(*) FILTER (WHERE x.product_key IS NOT NULL AND y.product_key IS NOT NULL) AS c, count(*) FILTER (WHERE x.product_key IS NULL) AS ad, count(*) FILTER (WHERE y.product_key IS NULL) AS dr
  FROM (SELECT DISTINCT roaster, product_key FROM b) x FULL JOIN (SELECT DISTINCT roaster, product_key FROM a) y USING (roaster, product_key) GROUP BY 1),
cp AS (SELECT roaster, count(*) AS n, (exp(avg(m)) - 1) * 100 AS pct FROM (SELECT cuts.roaster, product_id, avg(ppg_change_log) AS m FROM cuts JOIN l ON l.roaster = cuts.roaster AND to_quarter <= e GROUP BY ALL) GROUP BY 1),
ma AS (SELECT roaster, median(ppg) AS m FROM a WHERE (roaster, product_key) NOT IN (SELECT (roaster, product_key) FROM b) GROUP BY 1), md AS (SELECT roaster, median(ppg) AS m FROM b WHERE (roaster, product_key) NOT IN (SELECT (roaster, product_key) FROM a) GROUP BY 1),
v AS (SELECT r.roaster, l.e, CASE WHEN l0.l0 IS NOT NULL THEN l.e END AS ende, (exp(l1 - l0) - 1) * 100 AS total, lfl, coalesce(cp.n, 0) AS n, cp.pct, c, ad, dr, ma.m AS ma, md.m AS md FROM (SELECT DISTINCT roaster FROM items) r LEFT JOIN l USING (roaster) LEFT JOIN l0 USING (roaster) LEFT JOIN l1 USING (roaster) LEFT JOIN p USING (roaster) LEFT JOIN cp USING (roaster) LEFT JOIN ma USING (roaster) LEFT JOIN md USING (roaster))
SELECT roaster, ende AS "end", round(total, 4) + 0.0 AS total_pct, round(CASE WHEN ende IS NOT NULL THEN lfl END, 4) + 0.0 AS like_for_like_pct, round(CASE WHEN ende IS NOT NULL THEN coalesce(n / (c + ad)::DOUBLE * pct, 0.0) END, 4) + 0.0 AS pack_size_pp, round(CASE WHEN ende IS NOT NULL THEN total - lfl - coalesce(n / (c + ad)::DOUBLE * pct, 0.0) END, 4) + 0.0 AS range_mix_pp,
  CASE WHEN ende IS NOT NULL THEN n END AS size_cut_products, CASE WHEN ende IS NOT NULL THEN c END AS products_continuing, CASE WHEN ende IS NOT NULL THEN ad END AS products_added, CASE WHEN ende IS NOT NULL THEN dr END AS products_dropped, round(CASE WHEN ende IS NOT NULL THEN pct END, 4) + 0.0 AS size_cut_ppg_change_pct, round(CASE WHEN ende IS NOT NULL THEN ma END, 4) AS median_ppg_added, round(CASE WHEN ende IS NOT NULL THEN md END, 4) AS median_ppg_dropped,
  CASE WHEN e IS NULL THEN 'no price index (too few matched products)' WHEN ende IS NULL THEN 'no complete pre-shock page in the index segment' ELSE '' END AS note FROM v""")
def levers(spark, d):
    lines = _lines(spark, d)
    items, _ = Scratch(spark, "items").write(P.price_items(lines.withColumn("ppg", F.col("price_inr") / F.col("size_grams") * 100)))
    index = PI.normalise(PI.chain(items), BASE)
    n = lines.groupBy("roaster", "quarter").agg(F.count_if(F.col("source_type") == "archive").alias("n"), F.countDistinct("product_id").alias("p"))
    coverage = n.select("roaster", "quarter", F.when(F.col("n") > 0, "archive").otherwise("live").alias("source_type"), F.when(F.col("p") % 4 != 0, "complete").otherwise("partial").alias("completeness"))
    split = L.full_split(items, index, coverage, _cuts(spark, d)[0], BASE)
    return _round(split, "total_pct", "like_for_like_pct", "pack_size_pp", "range_mix_pp", "size_cut_ppg_change_pct", "median_ppg_added", "median_ppg_dropped", n=4)


LEVELS = {"process": "blue", "roast_level": "standard"}


def _sample(spark, d):
    pending = _t(spark, d, "part").where("p_size = 7").select(F.col("p_brand").alias("roaster"), F.col("p_partkey").cast("string").alias("product_id"))
    return R.hedonic_sample(_keyed_items(spark, d), _attributes(spark, d), list(LEVELS), pending, pre=BASE, shock=SHOCK)


SAMPLE = f"""{KEYED_ITEMS}, sample AS (SELECT i.*, CASE WHEN process = '' THEN 'unknown' ELSE lower(process) END AS process, lower(roast_level) AS roast_level, CASE WHEN quarter >= '{SHOCK}' THEN 'shock' ELSE 'pre' END AS period
  FROM kitems i JOIN attributes USING (roaster, product_id) WHERE attributes_valid AND product_id NOT IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size = 7))"""


@query(f"""WITH {SAMPLE}, c AS (SELECT period, 'process' AS attribute, process AS level, count(*) AS n_obs, count(DISTINCT product_key) AS n_products FROM sample GROUP BY ALL UNION ALL SELECT period, 'roast_level', roast_level, count(*), count(DISTINCT product_key) FROM sample GROUP BY ALL)
SELECT *, n_obs >= 20 AND n_products >= 5 OR level IN ('blue', 'standard') AS reported FROM c""")
def hedonic_levels(spark, d):
    return R.hedonic_counts(_sample(spark, d), LEVELS)


@query()
def hedonic_periods(spark, d):
    """The effects of attributes in each period; the regression is tested against numpy."""
    fit = R.hedonic_periods(_sample(spark, d), LEVELS)
    return _round(fit.where("term not like 'quarter%'").select("period", "term", "coef", "se", "effect_pct", "effect_low", "effect_high", "p", "n", "n_products"), "coef", "se", "effect_pct", "effect_low", "effect_high", "p")


@query()
def hedonic_shift(spark, d):
    """How the attributes' effects shift in the shock; the regression is tested against numpy."""
    return _round(R.fit_change(_sample(spark, d), LEVELS), "shock_shift", "ci_low", "ci_high", "p")
