"""Irregular readings onto a regular quarterly grid, with harmonic seasonal regression for the gaps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight that keeps the normal equations of short series solvable, on the trend and the harmonics.
RIDGE = 1e-3


def read_timestamp(c: Column) -> Column:
    """The time in a capture stamp: 14 or 8 digits, or a date and time with a T or a blank; null if it can't be read.

    Signs between the parts and blanks around them don't matter; a month, day or time that doesn't exist is unreadable.
    """
    s = F.trim(c)
    iso = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?$", 0) != ""
    digits = F.when(s.rlike(r"^\d{14}$"), s).when(s.rlike(r"^\d{8}$"), F.concat(s, F.lit("000000"))).when(iso, F.rpad(F.regexp_replace(F.regexp_replace(s, r"(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$", ""), r"[^0-9]", ""), 14, "0"))
    # only the calendar date decides the period; an impossible time of day makes the stamp unreadable too
    day = F.try_make_date(*[F.substring(digits, a, n).cast("int") for a, n in ((1, 4), (5, 2), (7, 2))]) if hasattr(F, "try_make_date") else F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")).cast("date")
    clock = (F.substring(digits, 9, 2) < "24") & (F.substring(digits, 11, 2) < "60") & (F.substring(digits, 13, 2) < "60")
    return F.when(clock, F.concat(day.cast("string"), F.lit(" "), F.substring(digits, 9, 2), F.lit(":"), F.substring(digits, 11, 2), F.lit(":"), F.substring(digits, 13, 2)))


def _waves(season: int) -> list[tuple[str, float]]:
    """All harmonics of a season: (cos or sin, frequency); the highest one of an even season has no sine."""
    turn = 2 * math.pi / season
    return [(wave, k * turn) for k in range(1, season // 2 + 1) for wave in (("cos",) if 2 * k == season else ("cos", "sin"))]


def _basis(t: Column, season: int) -> list[Column]:
    """1, time, and the harmonics of the season (for quarters: the annual wave and the half-annual one)."""
    return [F.lit(1.0), t, *[(F.cos if wave == "cos" else F.sin)(t * f) for wave, f in _waves(season)]]


def _series(readings: DataFrame, source: Column, period: Column, order: Column, value: Column) -> DataFrame:
    """s, t, x: one row per source and period with a reading, with the value of the reading that counts."""
    x = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    base = readings.select(source.alias("s"), period.cast("int").alias("t"), order.alias("o"), x.alias("x")).where("t is not null")
    return base.groupBy("s", "t").agg(F.max_by("x", F.struct("o", "x")).alias("x"))


def _filled(season: int):
    """Grid rows of each source from its cells and its sums of products."""
    waves = _waves(season)
    terms = 2 + len(waves)
    pairs = [(i, j) for i in range(terms) for j in range(i, terms)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            column = lambda c: np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype(float))
            a, y = np.zeros((n, terms, terms)), np.stack([column(f"y{i}") for i in range(terms)], 1)
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = column(f"a{i}{j}")
            # the trend around each source's own middle, so that the fit does not depend on where periods begin to count
            known = a[:, 0, 0] > 0
            centre = np.where(known, a[:, 0, 1] / np.maximum(a[:, 0, 0], 1), 0.0)
            move = np.tile(np.eye(terms), (n, 1, 1))
            move[:, 1, 0], move[:, 1, 1] = -centre / season, 1 / season
            a, y = move @ a @ move.transpose(0, 2, 1), np.einsum("nij,nj->ni", move, y)
            a += np.diag([1e-9] + [RIDGE] * (terms - 1)) * np.maximum(a[:, :1, :1], 1)
            w = np.linalg.solve(a, y[:, :, None])[:, :, 0]
            t0, t1 = (b.column(c).to_numpy().astype(np.int64) for c in ("t0", "t1"))
            size = t1 - t0 + 1
            begin = np.r_[0, np.cumsum(size)]
            row = np.repeat(np.arange(n), size)
            t = np.arange(begin[-1]) - begin[row] + t0[row]
            cells = b.column("cells")
            of = np.repeat(np.arange(n), cells.value_lengths().to_numpy(zero_copy_only=False))
            flat = cells.flatten()
            at = begin[of] + flat.field("t").to_numpy(zero_copy_only=False) - t0[of]
            x, observed = np.full(begin[-1], np.nan), np.zeros(begin[-1], bool)
            x[at], observed[at] = flat.field("x").to_numpy(zero_copy_only=False).astype(float), True
            f = np.stack([np.ones(len(t)), (t - centre[row]) / season, *[getattr(np, wave)(t * v) for wave, v in waves]], 1)
            fitted = np.where(known[row], (f * w[row]).sum(1), np.nan)
            # residuals are bridged between the known readings on both sides, and kept beyond them
            r, here = x - fitted, ~np.isnan(x)
            places = np.arange(len(t))
            back = np.maximum.accumulate(np.where(here, places, -1))
            on = np.minimum.accumulate(np.where(here, places, len(t))[::-1])[::-1]
            before, after = back >= begin[row], on < begin[row + 1]
            back, on = np.where(before, back, on), np.where(after, on, back)
            inside = (back >= 0) & (on < len(t)) & known[row]
            back, on = np.where(inside, back, 0), np.where(inside, on, 0)
            share = np.where(on > back, (places - back) / np.maximum(on - back, 1), 0.0)
            bridge = np.where(here[back], r[back], 0) + share * (np.where(here[on], r[on], 0) - np.where(here[back], r[back], 0))
            filled = np.where(here, x, np.where(inside, fitted + bridge, np.nan))
            null = lambda v: pa.array(v, pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([b.column("s").take(pa.array(row)), pa.array(t, pa.int32()), pa.array(observed), null(x), null(fitted), null(filled)], names=["source", "period", "observed", "value", "fitted", "filled"])

    return run


def regular_grid(readings: DataFrame, source: Column, period: Column, order: Column, value: Column, *, season: int = 4) -> DataFrame:
    """A complete series per source, one row per period from its first to its last reading.

    readings: one row per reading; period: the number of the period (an int) it falls in, null for none;
    order: of several readings in a period the one with the greatest order counts, then the greatest value.
    season: periods in a season, 4 for quarters, 12 for months.
    Returns source, period, observed, value (null where the reading had none), fitted (the regression's
    value) and filled (the value where it is known, else the fitted one plus the residuals interpolated
    between the known readings on both sides).

    The regression has a trend and all harmonics of the season; a source's normal equations are sums over its
    periods, gathered with partial sums. One aggregation by source and period and one by source are all the
    shuffles: a source's row then has its sums and its periods, few however many readings there are, and is
    solved and laid out in Arrow batches. A source without any value has null fits. Readings without a period
    are left out, those without a source are one source; repeated readings count once; no readings, no rows;
    NaN counts as null.
    """
    seen = _series(readings, source, period, order, value)
    known, f = F.col("x").isNotNull(), _basis(F.col("t").cast("double"), season)
    sums = [F.sum(F.when(known, f[i] * f[j])).alias(f"a{i}{j}") for i in range(len(f)) for j in range(i, len(f))]
    sums += [F.sum(f[i] * F.col("x")).alias(f"y{i}") for i in range(len(f))]
    per = seen.groupBy("s").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.collect_list(F.struct("t", "x")).alias("cells"), *sums)
    return per.mapInArrow(_filled(season), f"source {seen.schema['s'].dataType.simpleString()}, period int, observed boolean, value double, fitted double, filled double")
