"""Least squares with robust and clustered standard errors, from sums over the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.config import CONFIG
from panelwright.session import Scratch

_RESULT = "term string, coef double, se double, ci_low double, ci_high double, p double, n long, r2 double"


def _matrix(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(float), b.column("y").to_numpy(zero_copy_only=False).astype(float)


def _summed(df: DataFrame, size: int) -> np.ndarray:
    """Sums of (cell, v) rows by cell: the partial sums of all partitions meet in `size` rows."""
    out = np.zeros(size)
    for r in df.groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out


def _cells(values: np.ndarray) -> pa.RecordBatch:
    flat = values.reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "v"])


def within(rows: DataFrame, effect: str, k: int) -> tuple[DataFrame, int]:
    """(rows with y and x less their means in each group of `effect`, number of groups): the regression on these has the coefficients of one with a dummy per group."""
    scratch = Scratch(rows.sparkSession, "within")
    # the rows are read several times from here on: they are computed once
    rows, _ = scratch.write(rows.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))))
    means = rows.groupBy(F.col(effect).alias("__e")).agg(F.avg("y").alias("__y"), F.array(*[F.avg(F.col("x")[i]) for i in range(k)]).alias("__x"))
    means, seen = scratch.write(means)
    less = rows.join(means, F.col(effect).eqNullSafe(F.col("__e")))
    return less.withColumns({"y": F.col("y") - F.col("__y"), "x": F.zip_with("x", "__x", lambda a, b: a - b)}).drop("__e", "__y", "__x"), seen["rows"]


def ols(rows: DataFrame, terms: list[str], *, cluster: bool = False, total: list[str] | None = None, absorbed: int = 0, z: float = CONFIG.z95) -> DataFrame:
    """term, coef, se, ci_low, ci_high, p, n, r2 of the regression of y on the array x (one entry per term).

    Standard errors are HC1, or with `cluster` (a column of that name) CR1. `total` adds a row
    `sum` of some coefficients; `absorbed` is the number of dummies taken out by within(). One pass gives X'X and X'y, a second one the middle of the sandwich; only
    these k x k sums reach the driver, where a pseudo-inverse copes with redundant dummies. Rows with a
    null y or x entry are left out; no rows give no terms.
    """
    k = len(terms)
    spark = rows.sparkSession
    kept = ["y", "x", *["cluster"] * cluster]
    # two passes read the rows: they are computed once
    rows, _ = Scratch(spark, "ols").write(rows.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))).select(*kept))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_ = np.zeros(k * k + k + 3)
        for b in batches:
            x, y = _matrix(b, k)
            total_ += np.concatenate([(x.T @ x).reshape(-1), x.T @ y, [y.sum(), y @ y, len(y)]])
        yield _cells(total_)

    m = _summed(rows.select("x", "y").mapInArrow(moments, "cell long, v double"), k * k + k + 3)
    n = int(m[-1])
    if not n:
        return spark.createDataFrame([], _RESULT)
    bread = np.linalg.pinv(m[: k * k].reshape(k, k))
    beta = bread @ m[k * k : k * k + k]

    if cluster:
        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = _matrix(b, k)
                yield pa.RecordBatch.from_arrays([b.column("cluster"), pa.array(list(x * (y - x @ beta)[:, None]), pa.list_(pa.float64()))], names=["cluster", "s"])

        kind = rows.schema["cluster"].dataType.simpleString()
        each = rows.select("cluster", "x", "y").mapInArrow(scores, f"cluster {kind}, s array<double>")
        sums = each.select("cluster", F.posexplode("s").alias("j", "v")).groupBy("cluster", "j").agg(F.sum("v").alias("v")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("x"))

        def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total_ = np.zeros(k * k + 1)
            for b in batches:
                s = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                total_ += np.r_[(s.T @ s).reshape(-1), len(s)]
            yield _cells(total_)

        got = _summed(sums.select("x").mapInArrow(outer, "cell long, v double"), k * k + 1)
        g = got[-1]
        scale = g / max(g - 1, 1) * (n - 1) / max(n - k - absorbed, 1)
    else:
        def meat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total_ = np.zeros((k, k))
            for b in batches:
                x, y = _matrix(b, k)
                w = x * (y - x @ beta)[:, None]
                total_ += w.T @ w
            yield _cells(total_)

        got = _summed(rows.select("x", "y").mapInArrow(meat, "cell long, v double"), k * k)
        scale = n / max(n - k - absorbed, 1)
    cov = scale * bread @ got[: k * k].reshape(k, k) @ bread
    xy, yy, mean = m[k * k : k * k + k], m[-2], m[-3] / n
    rss, tss = yy - 2 * beta @ xy + beta @ m[: k * k].reshape(k, k) @ beta, yy - n * mean * mean
    r2 = float(1 - rss / tss) if tss > 0 else None
    out = []
    weights = [(t, np.eye(k)[i]) for i, t in enumerate(terms)] + ([("sum", np.array([float(t in total) for t in terms]))] if total else [])
    for term, w in weights:
        b, se = float(w @ beta), math.sqrt(max(float(w @ cov @ w), 0.0))
        out.append((term, b, se, b - z * se, b + z * se, math.erfc(abs(b / se) / math.sqrt(2)) if se > 0 else None, n, r2))
    return spark.createDataFrame(out, _RESULT)


def fold_small(rows: DataFrame, attribute: str, product: str, baseline: str, *, min_products: int = CONFIG.min_products, min_obs: int = CONFIG.min_obs) -> DataFrame:
    """rows with the levels of an attribute that too few products or rows have folded into `too_few`; the baseline stays, nulls are `unknown`."""
    level = F.coalesce(F.col(attribute), F.lit("unknown"))
    counts = rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n_obs"), F.countDistinct(product).alias("n_products"))
    small = counts.where((F.col("level") != baseline) & ((F.col("n_obs") < min_obs) | (F.col("n_products") < min_products))).select("level", F.lit(True).alias("small"))
    out = rows.withColumn("level", level).join(small, "level", "left")
    return out.withColumn(attribute, F.when(F.col("small"), F.lit("too_few")).otherwise(F.col("level"))).drop("level", "small")


def _levels(rows: DataFrame, column: str) -> list:
    return [r[0] for r in rows.select(column).distinct().orderBy(column).collect() if r[0] is not None]  # levels are model columns


def design(rows: DataFrame, attributes: dict[str, str], periods: str = "quarter", shifts: Column | None = None) -> tuple[list[str], list[Column]]:
    """Names and columns of a regression: log size, dummies of the attributes' levels (each against its baseline) and of the periods (against the first), with `shifts` also each attribute dummy times it. Columns that do not vary are left out."""
    terms, x = ["ln_size"], [F.ln("size_grams")]
    for a in (*attributes, periods):
        levels = _levels(rows, a)
        for v in levels:
            if v != (attributes[a] if a in attributes else levels[0]):
                x.append(F.col(a).eqNullSafe(F.lit(v)).cast("double"))
                terms.append(f"{a}[{v}]")
    if shifts is not None:
        for t, c in list(zip(terms, x)):
            if t.split("[")[0] in attributes:
                x.append(c * shifts.cast("double"))
                terms.append(f"{t}:shock")
    spread = rows.agg(*[(F.max(c) > F.min(c)).alias(f"c{i}") for i, c in enumerate(x)]).first()
    kept = [i for i in range(len(x)) if spread[f"c{i}"]]
    return [terms[i] for i in kept], [x[i] for i in kept]


def _fitted(rows: DataFrame, terms: list[str], x: list[Column], product: str, absorb: str) -> DataFrame:
    less, groups = within(rows.select(F.ln("ppg").alias("y"), F.array(*x).alias("x"), F.col(product).alias("cluster"), F.col(absorb).alias("effect")), "effect", len(terms))
    fit = ols(less, terms, cluster=True, absorbed=groups)
    return fit.withColumns({"effect_pct": (F.exp("coef") - 1) * 100, "effect_low": (F.exp("ci_low") - 1) * 100, "effect_high": (F.exp("ci_high") - 1) * 100})


def hedonic(rows: DataFrame, attributes: dict[str, str], product: str = "product_key", absorb: str = "roaster", periods: str = "quarter") -> DataFrame:
    """Log price per gram on log size, the attributes' levels, period dummies and a fixed effect of `absorb` (see design); errors clustered by product.

    Adds effect_pct, effect_low and effect_high, the effect of a term in percent. The fixed effect is taken out
    within its groups, so the number of columns depends on levels and periods only.
    """
    base = rows.where("ppg > 0 and size_grams > 0")
    for a, baseline in attributes.items():
        base = fold_small(base, a, product, baseline)
    return _fitted(base, *design(base, attributes, periods), product, absorb)


def hedonic_sample(items: DataFrame, attributes: DataFrame, names: list[str], pending: DataFrame | None = None, *, pre: tuple[str, ...] = CONFIG.pre, shock: str = CONFIG.shock_start) -> DataFrame:
    """Items whose attributes are those of their product in that quarter, with the attributes in lower case (blank: `unknown`) and period, `pre` or `shock`; products in `pending` (roaster, product_id) await new attributes and are left out."""
    d = items.where(F.coalesce("attributes_valid", F.lit(False)))
    d = d.join(attributes.select("roaster", "product_id", *names), ["roaster", "product_id"])
    if pending is not None:
        d = d.join(pending.select("roaster", "product_id").distinct(), ["roaster", "product_id"], "left_anti")
    for a in names:
        d = d.withColumn(a, F.lower(F.when(F.coalesce(F.col(a), F.lit("")) == "", "unknown").otherwise(F.col(a))))
    return d.withColumn("period", F.when((F.col("quarter") >= shock) & ~F.col("quarter").isin(*pre), "shock").otherwise("pre"))


def hedonic_counts(sample: DataFrame, attributes: dict[str, str], product: str = "product_key", *, min_products: int = CONFIG.min_products, min_obs: int = CONFIG.min_obs) -> DataFrame:
    """period, attribute, level, n_obs, n_products, reported: how often each level occurs; levels with too few products or rows are not reported, baselines always are."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a), F.lit("unknown")).alias("level"), F.lit(b).alias("baseline")) for a, b in attributes.items()]))
    n = sample.select("period", F.col(product).alias("__p"), cells.alias("c")).groupBy("period", "c.attribute", "c.level", "c.baseline").agg(F.count(F.lit(1)).alias("n_obs"), F.countDistinct("__p").alias("n_products"))
    enough = (F.col("n_products") >= min_products) & (F.col("n_obs") >= min_obs) | (F.col("level") == F.col("baseline"))
    return n.withColumn("reported", enough).drop("baseline")


def hedonic_periods(sample: DataFrame, attributes: dict[str, str], product: str = "product_key", absorb: str = "roaster") -> DataFrame:
    """hedonic of each period of the sample by itself, with period, n_obs and n_products."""
    out = None
    sample, _ = Scratch(sample.sparkSession, "hedonic").write(sample)  # read many times below
    for period in _levels(sample, "period"):
        some = sample.where(F.col("period") == period)
        n = some.agg(F.countDistinct(product).alias("n_products"))
        fit = hedonic(some, attributes, product, absorb).withColumn("period", F.lit(period)).crossJoin(F.broadcast(n))  # one row
        out = fit if out is None else out.unionByName(fit)
    return out if out is not None else sample.sparkSession.createDataFrame([], f"{_RESULT}, effect_pct double, effect_low double, effect_high double, period string, n_products long")


def fit_change(sample: DataFrame, attributes: dict[str, str], product: str = "product_key", absorb: str = "roaster") -> DataFrame:
    """Did an attribute's effect change in the shock? One model of both periods, in which each level also has a shift in the shock: attribute, level, shock_shift, ci_low, ci_high, p, n.

    Levels too rare in both periods together, or missing in one of them, are folded.
    """
    d, _ = Scratch(sample.sparkSession, "hedonic").write(sample.where("ppg > 0 and size_grams > 0"))  # read many times below
    for a, baseline in attributes.items():
        d = fold_small(d, a, product, baseline)
        both = d.groupBy(F.col(a).alias("__l")).agg((F.countDistinct("period") == 2).alias("__both"))
        d = d.join(both, F.col(a).eqNullSafe(F.col("__l")), "left").withColumn(a, F.when(F.col("__both"), F.col(a)).otherwise("too_few")).drop("__l", "__both")
    fit = _fitted(d, *design(d, attributes, "quarter", F.col("period") == "shock"), product, absorb).where("term like '%:shock'")
    return fit.select(F.regexp_extract("term", r"^(\w+)\[", 1).alias("attribute"), F.regexp_extract("term", r"\[(.*)\]", 1).alias("level"), F.col("coef").alias("shock_shift"), "ci_low", "ci_high", "p", "n")


def reported_effects(fits: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of hedonic_periods for a chart: attributes and levels that are reported in their period, without `unknown`."""
    named = fits.withColumns({"attribute": F.regexp_extract("term", r"^(\w+)\[", 1), "level": F.regexp_extract("term", r"\[(.*)\]", 1)})
    return named.where("attribute <> '' and level <> 'unknown'").join(counts.where("reported").select("period", "attribute", "level"), ["period", "attribute", "level"])
