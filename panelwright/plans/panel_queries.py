"""Queries of the panel, index, cost and pass-through operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import costs as C
from panelwright.operators import panel as P
from panelwright.operators import pass_through as PT
from panelwright.operators import price_index as X
from panelwright.operators import regression as R
from panelwright.session import Scratch


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _panel(spark, d):
    return P.counting_rows(_t(spark, d, "variants_long"))


def _items(spark, d):
    return P.price_items(P.analysis_rows(_panel(spark, d)))


def _round(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) + 0.0 for c in names})  # no negative zero


PANEL = """
pv AS (SELECT * REPLACE (nullif(regexp_extract(variant_id, '[0-9]{14}'), '') AS variant_id, nullif(regexp_extract(product_id, '[0-9]{13}'), '') AS product_id,
         regexp_extract(quarter, '[0-9]{4}') || 'Q' || regexp_extract(upper(quarter), 'Q *([1-4])', 1) AS quarter, round(price_inr, 2) AS price_inr) FROM variants_long),
pr AS (SELECT *, row_number() OVER (PARTITION BY roaster, variant_id, quarter ORDER BY coalesce(served_ts, '') DESC, price_inr ASC NULLS LAST, coalesce(product_title, '') DESC, coalesce(variant_title, '') DESC) AS rn
       FROM pv WHERE variant_id IS NOT NULL),
panel AS (SELECT * FROM pr WHERE rn = 1)"""
ROWS = f"""{PANEL},
fit AS (SELECT *, price_inr / size_grams * 100 AS ppg FROM panel
        WHERE coalesce(is_coffee_guess, true) AND NOT coalesce(is_bundle, false) AND NOT coalesce(served_outside_quarter, false) AND NOT coalesce(in_switch_window, false)
          AND size_grams > 0 AND price_inr > 0)"""
ITEMS = f"""{ROWS},
items AS (SELECT roaster, tier, quarter, product_id AS product_key, size_grams, median(ppg) AS ppg, count(*) AS n_variants FROM fit GROUP BY ALL)"""
LINKS = f"""{ITEMS},
links AS (SELECT a.roaster, a.quarter AS qa, b.quarter AS qb, count(*) AS n_items, exp(avg(ln(b.ppg) - ln(a.ppg))) AS relative
          FROM items a JOIN items b ON a.roaster = b.roaster AND a.product_key IS NOT DISTINCT FROM b.product_key AND a.size_grams = b.size_grams AND a.quarter < b.quarter GROUP BY ALL)"""
CHAIN = f"""{LINKS},
parents AS (SELECT roaster, qb AS quarter, max(qa) AS linked_from, arg_max(n_items, qa) AS link_items, arg_max(relative, qa) AS relative FROM links WHERE n_items >= 3 GROUP BY roaster, qb),
qs AS (SELECT DISTINCT roaster, quarter FROM items),
roots AS (SELECT q.roaster, q.quarter, row_number() OVER (PARTITION BY q.roaster ORDER BY q.quarter) AS segment FROM qs q ANTI JOIN parents p ON p.roaster = q.roaster AND p.quarter = q.quarter),
walk AS (SELECT roaster, quarter, segment, 100.0::DOUBLE AS raw_level, NULL::VARCHAR AS linked_from, NULL::BIGINT AS link_items, NULL::DOUBLE AS relative FROM roots
         UNION ALL SELECT p.roaster, p.quarter, w.segment, w.raw_level * p.relative, p.linked_from, p.link_items, p.relative FROM walk w JOIN parents p ON p.roaster = w.roaster AND p.linked_from = w.quarter)"""
PRE = "('2023Q1', '2023Q2', '2023Q3', '2023Q4', '2024Q1')"
INDEX = f"""{CHAIN},
seg AS (SELECT roaster, segment, count(*) FILTER (WHERE quarter IN {PRE}) AS pre_quarters, coalesce(avg(raw_level) FILTER (WHERE quarter IN {PRE}), arg_min(raw_level, quarter)) AS base, max(quarter) AS reach FROM walk GROUP BY ALL),
best AS (SELECT roaster, segment FROM seg WHERE pre_quarters > 0 QUALIFY row_number() OVER (PARTITION BY roaster ORDER BY reach DESC, segment) = 1),
idx AS (SELECT w.*, s.pre_quarters, s.pre_quarters > 0 AS anchored, w.raw_level / s.base * 100 AS index, b.segment IS NOT NULL AS main_segment
        FROM walk w JOIN seg s USING (roaster, segment) LEFT JOIN best b USING (roaster, segment))"""

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {ITEMS} SELECT roaster, tier, quarter, product_key, size_grams, round(ppg, 6) AS ppg, n_variants FROM items")
def items_median(spark, d):
    return _round(_items(spark, d), "ppg")


@query(f"WITH {LINKS} SELECT roaster, qa, qb, n_items, round(relative, 6) AS relative FROM links")
def price_links(spark, d):
    return _round(X.price_links(_items(spark, d)), "relative")


@query(f"WITH {LINKS} SELECT roaster, qb AS quarter, max(qa) AS linked_from, arg_max(n_items, qa) AS link_items, round(arg_max(relative, qa), 6) AS relative FROM links WHERE n_items >= 3 GROUP BY roaster, qb")
def linkback_parent(spark, d):
    return _round(X.link_parents(X.price_links(_items(spark, d))), "relative")


@query(f"WITH RECURSIVE {CHAIN} SELECT roaster, quarter, segment::INT AS segment, round(raw_level, 6) AS raw_level, linked_from, link_items, round((relative - 1) * 100, 6) AS link_change_pct FROM walk")
def chained_index(spark, d):
    return _round(X.chain(_items(spark, d)), "raw_level", "link_change_pct")


@query(f"WITH RECURSIVE {INDEX} SELECT roaster, quarter, segment::INT AS segment, pre_quarters, anchored, round(index, 6) AS index, main_segment FROM idx")
def index_normalised(spark, d):
    return _round(X.normalise(X.chain(_items(spark, d))), "index").select("roaster", "quarter", "segment", "pre_quarters", "anchored", "index", "main_segment")


@query(f"""WITH RECURSIVE {INDEX},
s AS (SELECT * FROM idx WHERE main_segment AND quarter >= '2024Q2' AND linked_from IS NOT NULL QUALIFY row_number() OVER (PARTITION BY roaster ORDER BY relative DESC, quarter) = 1),
n AS (SELECT s.*, b.index AS index_before, left(s.quarter, 4)::INT * 4 + right(s.quarter, 1)::INT - 1 AS qi, left(s.linked_from, 4)::INT * 4 + right(s.linked_from, 1)::INT - 1 AS li FROM s LEFT JOIN idx b ON b.roaster = s.roaster AND b.quarter = s.linked_from)
SELECT roaster, quarter, linked_from, qi - li AS span, round((relative - 1) * 100, 6) AS link_change_pct, round(index_before, 6) AS index_before, round(index, 6) AS index_after, greatest(0, li - 8097 + 1) AS earliest, qi - 8097 AS latest FROM n""")
def step_timing(spark, d):
    return _round(X.step_timing(X.normalise(X.chain(_items(spark, d)))), "link_change_pct", "index_before", "index_after")


def _month_shift(c: str):
    """The driver's orders lie 28 years before the panel's quarters."""
    return F.add_months(F.col(c).cast("date"), 28 * 12)


def _rates(spark, d):
    return C.monthly_mean(_t(spark, d, "orders"), _month_shift("o_orderdate"), F.col("o_totalprice") / 1000)


def _prices(spark, d):
    return C.monthly_mean(_t(spark, d, "lineitem"), _month_shift("l_shipdate"), F.col("l_extendedprice") / 10000)


def _costs(spark, d, loss=0.18):
    return C.to_quarters(C.monthly_costs(_prices(spark, d), _rates(spark, d), loss), "green", "roasted")


RATES = """
rates AS (SELECT strftime(o_orderdate + INTERVAL 336 MONTH, '%Y-%m') AS month, avg(o_totalprice / 1000) AS mean, count(*) AS days FROM orders GROUP BY 1),
prices AS (SELECT strftime(l_shipdate + INTERVAL 336 MONTH, '%Y-%m') AS month, avg(l_extendedprice / 10000) AS mean, count(*) AS days FROM lineitem GROUP BY 1)"""
COSTS = f"""{RATES},
mc AS (SELECT month, p.mean * r.mean AS green, p.mean * r.mean / (1 - 0.18) / 10 AS roasted FROM prices p JOIN rates r USING (month)),
costs AS (SELECT left(month, 4) || 'Q' || ((right(month, 2)::INT + 2) // 3)::VARCHAR AS quarter, count(*) AS months_in_quarter, avg(green) AS green, avg(roasted) AS roasted FROM mc GROUP BY 1)"""


@query(f"WITH {RATES} SELECT month, round(mean, 6) AS mean, days FROM rates")
def cost_monthly_fx(spark, d):
    return _round(_rates(spark, d), "mean")


@query(f"WITH {COSTS} SELECT month, round(green, 6) AS green, round(roasted, 6) AS roasted FROM mc")
def cost_monthly(spark, d):
    return _round(C.monthly_costs(_prices(spark, d), _rates(spark, d)), "green", "roasted")


@query(f"WITH {COSTS} SELECT quarter, months_in_quarter, round(green, 6) AS green, round(roasted, 6) AS roasted FROM costs")
def cost_quarterly(spark, d):
    return _round(_costs(spark, d), "green", "roasted")


@query(f"WITH {COSTS} SELECT quarter, round(roasted, 6) AS roasted, round(lag(roasted) OVER w, 6) AS roasted_lag1, round(lag(roasted, 2) OVER w, 6) AS roasted_lag2, round(lag(roasted, 3) OVER w, 6) AS roasted_lag3 FROM costs WINDOW w AS (ORDER BY quarter)")
def cost_lags(spark, d):
    names = ["roasted", *[f"roasted_lag{k}" for k in (1, 2, 3)]]
    return _round(C.add_lags(_costs(spark, d), "roasted").select("quarter", *names), *names)


@query(f"WITH {COSTS} SELECT quarter, round(roasted / (SELECT avg(roasted) FROM costs WHERE quarter IN {PRE}) * 100, 6) AS cost_index FROM costs")
def cost_index(spark, d):
    return _round(C.rebase(_costs(spark, d), "roasted", "cost_index").select("quarter", "cost_index"), "cost_index")


def _old_new(spark, d):
    m = _rates(spark, d).select("month", F.col("mean").alias("value"))
    return m.where("month < '2025-01'"), m.where("month >= '2024-01'").withColumn("value", F.col("value") / 2)


def _cpi(spark, d):
    monthly = C.splice(*_old_new(spark, d))
    return C.rebase(C.to_quarters(monthly, "value"), "value", "cpi_index").select("quarter", "cpi_index")


CPI = f"""
sp AS (SELECT month, mean AS value, 'old' AS series FROM rates WHERE month < '2025-01' UNION ALL
       SELECT month, mean / 2 * (SELECT avg(mean) / avg(mean / 2) FROM rates WHERE month >= '2024-01' AND month < '2025-01'), 'new' FROM rates WHERE month >= '2024-01' AND month > (SELECT max(month) FROM rates WHERE month < '2025-01')),
cq AS (SELECT left(month, 4) || 'Q' || ((right(month, 2)::INT + 2) // 3)::VARCHAR AS quarter, avg(value) AS v FROM sp GROUP BY 1),
cpi AS (SELECT quarter, v / (SELECT avg(v) FROM cq WHERE quarter IN {PRE}) * 100 AS cpi_index FROM cq)"""


@query(f"WITH {RATES}, {CPI} SELECT month, round(value, 6) AS value, series FROM sp")
def cpi_splice(spark, d):
    return _round(C.splice(*_old_new(spark, d)), "value")


@query(f"""WITH {RATES}, o AS (SELECT month, mean AS o FROM rates WHERE month < '2025-01'), n AS (SELECT month, mean / 2 AS n FROM rates WHERE month >= '2024-01')
SELECT count(*) AS overlap_months, min(month) AS overlap_from, max(month) AS overlap_to, round(avg(o) / avg(n), 4) AS link_factor, round(min(o / n), 4) AS ratio_min, round(max(o / n), 4) AS ratio_max, (SELECT count(*) FROM n WHERE month > (SELECT max(month) FROM o)) AS linked_months FROM o JOIN n USING (month)""")
def cpi_splice_info(spark, d):
    return C.splice_info(*_old_new(spark, d))


@query(f"WITH {RATES}, {CPI} SELECT quarter, round(cpi_index, 6) AS cpi_index FROM cpi")
def cpi_quarterly(spark, d):
    return _round(_cpi(spark, d), "cpi_index")


def _indexed(spark, d):
    """The items and their index, each computed and written once."""
    scratch = Scratch(spark, "items")
    items, _ = scratch.write(_items(spark, d))
    return items, scratch.write(X.normalise(X.chain(items)))[0]


def _pt(spark, d, loss=0.18, indexed=None):
    items, index = indexed or _indexed(spark, d)
    return PT.pass_through(index, items, _costs(spark, d, loss).select("quarter", F.col("roasted").alias("cost")))


PASS = f"""{INDEX}, {COSTS},
base AS (SELECT i.roaster, median(i.ppg) AS base_price FROM items i JOIN idx x ON x.roaster = i.roaster AND x.quarter = i.quarter AND x.main_segment AND x.quarter IN {PRE} GROUP BY 1),
cl AS (SELECT left(quarter, 4)::INT * 4 + right(quarter, 1)::INT - 1 + k AS i, k, roasted AS cost FROM costs, (VALUES (0), (1), (2), (3)) t(k)),
lagged AS (SELECT i, k::VARCHAR AS lag, cost FROM cl UNION ALL SELECT i, 'avg', avg(cost) FROM cl GROUP BY i HAVING count(*) = 4),
m AS (SELECT x.roaster, x.quarter, l.lag, b.base_price, x.index / 100 - 1 AS rise, l.cost, (SELECT avg(roasted) FROM costs WHERE quarter IN {PRE}) AS base_cost
      FROM idx x JOIN lagged l ON l.i = left(x.quarter, 4)::INT * 4 + right(x.quarter, 1)::INT - 1 JOIN base b ON b.roaster = x.roaster WHERE x.main_segment AND x.quarter >= '2024Q2'),
pt AS (SELECT roaster, quarter, lag, base_price, rise * 100 AS retail_change_pct, base_price * rise AS retail_change_rs, cost - base_cost AS cost_change_rs, (cost / base_cost - 1) * 100 AS cost_change_pct,
         base_price * rise * 100 / (cost - base_cost) AS rupee_pass_through_pct, rise * 100 / (cost / base_cost - 1) AS percent_pass_through_pct FROM m)"""
_PT = ["base_price", "retail_change_pct", "retail_change_rs", "cost_change_rs", "cost_change_pct", "rupee_pass_through_pct", "percent_pass_through_pct"]
_PTSQL = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in _PT) + ", abs(cost_change_rs) >= 10.0 AS reliable"


@query(f"WITH RECURSIVE {PASS} SELECT roaster, quarter, lag, {_PTSQL} FROM pt")
def pass_through(spark, d):
    return _round(_pt(spark, d), *_PT, n=4)


@query(f"WITH RECURSIVE {PASS} SELECT roaster, quarter, lag, {_PTSQL} FROM pt WHERE lag = 'avg' QUALIFY row_number() OVER (PARTITION BY roaster ORDER BY quarter DESC) = 1")
def pass_through_headline(spark, d):
    return _round(PT.headline(_pt(spark, d)), *_PT, n=4)


def _loss_sql(name: str, loss: float) -> str:
    return f"{name} AS (SELECT roaster, rupee_pass_through_pct * (1 - {loss}) / (1 - 0.18) AS {name} FROM h)"


@query(f"""WITH RECURSIVE {PASS}, h AS (SELECT * FROM pt WHERE lag = 'avg' QUALIFY row_number() OVER (PARTITION BY roaster ORDER BY quarter DESC) = 1),
{_loss_sql('loss_15', 0.15)}, {_loss_sql('loss_18', 0.18)}, {_loss_sql('loss_20', 0.2)}
SELECT roaster, round(loss_15, 4) AS loss_15, round(loss_18, 4) AS loss_18, round(loss_20, 4) AS loss_20 FROM loss_15 JOIN loss_18 USING (roaster) JOIN loss_20 USING (roaster)""")
def pass_through_losses(spark, d):
    """The headline at three roast losses side by side; costs in rupees are in inverse proportion to what roasting leaves."""
    indexed = _indexed(spark, d)
    parts = [PT.headline(_pt(spark, d, x, indexed)).select("roaster", F.lit(f"loss_{round(x * 100)}").alias("loss"), "rupee_pass_through_pct") for x in (0.15, 0.18, 0.20)]
    wide = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("roaster").pivot("loss", ["loss_15", "loss_18", "loss_20"]).agg(F.first("rupee_pass_through_pct"))
    return _round(wide, "loss_15", "loss_18", "loss_20", n=4)


@query(f"""WITH RECURSIVE {PASS}, {CPI},
h AS (SELECT * FROM pt WHERE lag = 'avg' QUALIFY row_number() OVER (PARTITION BY roaster ORDER BY quarter DESC) = 1)
SELECT roaster, h.quarter, round(base_price * (cpi_index / 100 - 1), 4) AS inflation_part, round(retail_change_rs - base_price * (cpi_index / 100 - 1), 4) AS real_change,
  round((retail_change_rs - base_price * (cpi_index / 100 - 1)) * 100 / cost_change_rs, 4) AS real_pass_through_pct FROM h LEFT JOIN cpi ON cpi.quarter = h.quarter""")
def deflate(spark, d):
    names = ["inflation_part", "real_change", "real_pass_through_pct"]
    return _round(C.deflate(PT.headline(_pt(spark, d)), _cpi(spark, d)).select("roaster", "quarter", *names), *names, n=4)


@query()
def distributed_lag(spark, d):
    items, _ = Scratch(spark, "items").write(_items(spark, d))
    fit = PT.distributed_lag(X.chain(items), _costs(spark, d).select("quarter", F.col("roasted").alias("cost")))
    return _round(fit.where("term like 'dcost%' or term = 'sum'").select("term", "coef", "se", "ci_low", "ci_high", "n"), "coef", "se", "ci_low", "ci_high")


@query(f"""WITH {ITEMS}, z AS (SELECT ln(ppg) AS y, ln(size_grams) AS x FROM items),
b AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, avg(x) AS mx, regr_sxx(y, x) AS sxx, count(*) AS n, regr_r2(y, x) AS r2 FROM z),
e AS (SELECT sum(((x - mx) * (y - b0 - b1 * x)) ** 2) AS s1, sum(((1 / n::DOUBLE - mx * (x - mx) / sxx) * (y - b0 - b1 * x)) ** 2) AS s0 FROM z, b)
SELECT round(b0, 6) AS const, round(b1, 6) AS ln_size, round(sqrt(n / (n - 2.0) * s0), 6) AS se_const, round(sqrt(n / (n - 2.0) * s1) / sxx, 6) AS se_ln_size, n::BIGINT AS n, round(r2, 6) AS r2 FROM b, e""")
def ols_hc1(spark, d):
    fit = R.ols(_items(spark, d).select(F.ln("ppg").alias("y"), F.array(F.lit(1.0), F.ln("size_grams")).alias("x")), ["const", "ln_size"])
    wide = fit.groupBy("n", "r2").pivot("term", ["const", "ln_size"]).agg(F.first("coef").alias("b"), F.first("se").alias("se"))
    return _round(wide.select(F.col("const_b").alias("const"), F.col("ln_size_b").alias("ln_size"), F.col("const_se").alias("se_const"), F.col("ln_size_se").alias("se_ln_size"), "n", "r2"), "const", "ln_size", "se_const", "se_ln_size", "r2")


@query(f"""WITH {ITEMS}, z AS (SELECT ln(ppg) AS y, ln(size_grams) AS x, roaster AS g FROM items),
b AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, avg(x) AS mx, regr_sxx(y, x) AS sxx, count(*) AS n FROM z),
s AS (SELECT g, sum((x - mx) * (y - b0 - b1 * x)) AS s FROM z, b GROUP BY g)
SELECT 'ln_size' AS term, round(any_value(b1), 6) AS coef, round(sqrt(sum(s * s) * count(*) / (count(*) - 1) * (any_value(n) - 1) / (any_value(n) - 2)) / any_value(sxx), 6) AS se FROM s, b""")
def ols_cluster(spark, d):
    fit = R.ols(_items(spark, d).select(F.ln("ppg").alias("y"), F.array(F.lit(1.0), F.ln("size_grams")).alias("x"), F.col("roaster").alias("cluster")), ["const", "ln_size"], cluster=True)
    return _round(fit.where("term = 'ln_size'").select("term", "coef", "se"), "coef", "se")


def _attributed(spark, d):
    rows = P.analysis_rows(_panel(spark, d)).withColumn("product_key", F.col("product_id"))
    return rows.withColumn("source", F.col("size_source"))


@query(f"""WITH {ROWS}, l AS (SELECT coalesce(size_source, 'unknown') AS level, count(*) AS n, count(DISTINCT product_id) AS p FROM fit GROUP BY 1)
SELECT CASE WHEN level <> 'variant_title' AND (n < 20 OR p < 5) THEN 'too_few' ELSE level END AS source, sum(n)::BIGINT AS n_obs FROM l GROUP BY 1""")
def hedonic_counts(spark, d):
    return R.fold_small(_attributed(spark, d), "source", "product_key", "variant_title").groupBy("source").agg(F.count(F.lit(1)).alias("n_obs"))


@query()
def hedonic_fit(spark, d):
    """Coefficients of size and of where the size was found, with roaster and quarter dummies."""
    fit = R.hedonic(_attributed(spark, d), {"source": "variant_title"})
    return _round(fit.where("term = 'ln_size' or term like 'source%'").select("term", "coef", "se", "effect_pct", "n"), "coef", "se", "effect_pct")
