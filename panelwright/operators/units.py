"""Sizes written in different units, to grams: units from the text, else from log-scale mixtures per source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grams per unit (fixed values).
GRAMS = {"g": 1.0, "kg": 1000.0, "oz": 28.349523125, "lb": 453.59237}
#: Spellings of units of weight and of other measures (fixed values).
WEIGHT_WORDS = {
    "g": ["g", "gr", "gm", "gms", "grs", "gram", "grams", "gramme", "grammes"],
    "kg": ["kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes"],
    "oz": ["oz", "ozs", "ounce", "ounces"],
    "lb": ["lb", "lbs", "pound", "pounds"],
}
#: Numbers written as words and as fraction signs (fixed values).
NUMBER_WORDS = {"half": 0.5, "quarter": 0.25, "one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0, "eight": 8.0, "ten": 10.0, "twelve": 12.0}
FRACTIONS = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125}

#: Width of a component at first, in natural logarithm (the rounding of written sizes), and its bounds. Width of a histogram bin; bins beyond these ends fall into the last ones.
SPREAD, NARROW, BROAD = 0.02, 0.01, 0.05
BIN, LOWEST, HIGHEST = 0.01, -922, 1612
#: Density of sizes that no component explains.
NOISE = 1e-6
#: Posterior below which a unit is marked as uncertain.
SURE = 0.9
_FITS, _ROUNDS = 4, 60

_UNIT = "|".join(sorted((w for ws in WEIGHT_WORDS.values() for w in ws), key=len, reverse=True))
_NUM = rf"(?:[1-9]/[2-9](?!\d)|\d+\s*[{''.join(FRACTIONS)}]|[{''.join(FRACTIONS)}]|\d+(?:[.,]\d+)?|\b(?:{'|'.join(NUMBER_WORDS)})\b(?:\s+an?)?)"
_SIZE = rf"(?i)(?<![\w.,])(?:(?:(?:pack|box|set)\s+of\s+)?(\d+)\s*(?:sachets?|packs?|pouches|bags?|pcs|pieces|tins?)?\s*[x×*]\s*)?({_NUM})\s*-?({_UNIT})(?![\w])"


def _number(c: Column) -> Column:
    """The value of a number as _NUM matches it."""
    t = F.lower(F.trim(F.regexp_replace(c, r"(?i)\s+an?$", "")))
    out = F.when(t.rlike(r"^\d+/\d+$"), F.try_divide(F.regexp_extract(t, r"^(\d+)", 1).try_cast("double"), F.regexp_extract(t, r"(\d+)$", 1).try_cast("double")))
    for sign, x in FRACTIONS.items():
        out = out.when(t.endswith(sign), F.coalesce(F.regexp_extract(t, r"^(\d+)", 1).try_cast("double"), F.lit(0.0)) + x)
    for word, x in NUMBER_WORDS.items():
        out = out.when(t == word, F.lit(x))
    return out.otherwise(F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def _grams_of(unit: Column) -> Column:
    u = F.lower(unit)
    out = None
    for name, words in WEIGHT_WORDS.items():
        out = F.when(u.isin(words), F.lit(GRAMS[name])) if out is None else out.when(u.isin(words), F.lit(GRAMS[name]))
    return out


def written_grams(text: Column) -> Column:
    """array<double> of the total grams of each weight in a text; empty if there is none.

    A number of packs before an x is multiplied; `250 / 750 g` gives the unit of the last number to those
    before it; volumes (ml, l, fl oz) and counts of pieces are no weights.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\d+(?:[.,]\d+)?\s*(?:fl\.?\s*|fluid\s+)(?:oz|ounces?)\b", " ")
    # a list of bare numbers before a number with a unit: each of them gets that unit
    listed = F.regexp_extract(t, rf"(?i)^\s*((?:\d+(?:[.,]\d+)?\s*/\s*)+)(\d+(?:[.,]\d+)?)\s*({_UNIT})\s*$", 1)
    unit = F.regexp_extract(t, rf"(?i)({_UNIT})\s*$", 1)
    fraction = t.rlike(rf"(?i)^\s*[1-9]/[2-9]\s*(?:{_UNIT})\s*$") & (F.regexp_extract(t, r"^\s*(\d+)", 1).try_cast("int") < F.regexp_extract(t, r"/\s*(\d+)", 1).try_cast("int"))
    heads = F.filter(F.split(listed, "/"), lambda n: F.trim(n) != "")
    spread = F.transform(heads, lambda n: F.replace(F.trim(n), F.lit(","), F.lit(".")).try_cast("double") * _grams_of(unit))
    parts = [F.regexp_extract_all(t, F.lit(_SIZE), F.lit(i)) for i in (1, 2, 3)]
    one = F.transform(F.arrays_zip(parts[0].alias("n"), parts[1].alias("x"), parts[2].alias("u")), lambda m: F.coalesce(m["n"].try_cast("double"), F.lit(1.0)) * _number(m["x"]) * _grams_of(m["u"]))
    last = F.transform(F.regexp_extract_all(t, F.lit(rf"(?i)(\d+(?:[.,]\d+)?)\s*(?:{_UNIT})\s*$"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit(".")).try_cast("double") * _grams_of(unit))
    out = F.when((listed != "") & ~fraction, F.concat(spread, last)).otherwise(one)
    return F.filter(out, lambda g: g.isNotNull() & (g > 0))


def bare_numbers(text: Column) -> Column:
    """array<double> of the numbers of a text that holds nothing but numbers; empty if it holds anything else."""
    t = F.trim(F.coalesce(text, F.lit("")))
    parts = F.split(F.trim(F.regexp_replace(t, r"[\s/|;]+", " ")), " ")
    numbers = F.transform(parts, lambda n: F.replace(n, F.lit(","), F.lit(".")).try_cast("double"))
    plain = t.rlike(r"^\d+(?:[.,]\d+)?(?:[\s/|;]+\d+(?:[.,]\d+)?)*$")
    return F.when(plain, F.filter(numbers, lambda g: g.isNotNull() & (g > 0))).otherwise(F.array().cast("array<double>"))


def _bin(x: Column) -> Column:
    """The bin of a positive number's logarithm; the outermost bins take what lies beyond them, so that no number is left out."""
    return F.round(F.least(F.greatest(F.ln(x) / BIN, F.lit(float(LOWEST))), F.lit(float(HIGHEST)))).cast("int")


def _assign(reference: np.ndarray, bins: np.ndarray):
    """A function for applyInPandas: from a source's histogram of log values to posteriors per bin."""
    units = list(GRAMS)
    shift = np.log([GRAMS[u] for u in units])
    share = reference / max(reference.sum(), 1e-12)

    def density(x: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each value: its density, and the mean squared distance to the sizes near it in units of the spread."""
        out, square = np.zeros(x.shape), np.zeros(x.shape)
        for start in range(0, len(bins), 64):
            z = (x[..., None] - bins[start : start + 64]) / spread
            weight = np.exp(-0.5 * z * z) * share[start : start + 64]
            out += weight.sum(-1)
            square += (weight * z * z).sum(-1)
        return out / (spread * np.sqrt(2 * np.pi)), square / np.maximum(out, 1e-300)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf["bin"].to_numpy() * BIN, pdf["n"].to_numpy(float)
        weight, spread = np.full(len(units), 1 / len(units)), SPREAD
        for last in range(_FITS):
            clear, square = density(x[:, None] + shift[None, :], spread)
            like = clear + NOISE
            for _ in range(_ROUNDS):
                post = like * weight
                post /= post.sum(1, keepdims=True)
                weight = (n[:, None] * post).sum(0) + 0.5
                weight /= weight.sum()
            mine = n[:, None] * post * clear / like
            if last + 1 < _FITS and mine.sum() > 0:
                spread = float(np.clip(spread * np.sqrt((mine * square).sum() / mine.sum()), NARROW, BROAD))
        post = like * weight
        post /= post.sum(1, keepdims=True)
        best = post.argmax(1)
        return pd.DataFrame({"src": pdf["src"], "bin": pdf["bin"], "unit": [units[b] for b in best], "posterior": post.max(1), "grams_per": [GRAMS[units[b]] for b in best], "explained": clear.max(1) > NOISE})

    return fit


def infer_units(values: DataFrame, source: str, value: str, reference: DataFrame, grams: str) -> DataFrame:
    """src, bin, unit, posterior, grams_per and explained for the bare numbers of each source, by bins of their logarithm.

    The components of a source's mixture are the distribution of the sizes with written units, moved by the
    logarithms of the known conversion factors; EM fits how often the source uses each unit and how broad its
    components are. Both distributions are histograms of the logarithm (1 % wide bins; the outermost take all
    beyond them, so a histogram has at most some 2,500), counted over all rows. `explained` is false for
    numbers that are near no size in any unit.
    """
    binned = lambda df, c: df.where(F.col(c) > 0).withColumn("bin", _bin(F.col(c)))
    ref = binned(reference.select(F.col(grams).cast("double").alias("x")), "x").groupBy("bin").count().toPandas()  # at most HIGHEST - LOWEST + 1 rows
    fit = _assign(ref["count"].to_numpy(float), ref["bin"].to_numpy(float) * BIN) if len(ref) else _assign(np.ones(1), np.log([250.0]))
    hist = binned(values.select(F.col(source).alias("src"), F.col(value).cast("double").alias("x")), "x").groupBy("src", "bin").agg(F.count(F.lit(1)).alias("n"))
    return hist.groupBy("src").applyInPandas(fit, f"src {hist.schema['src'].dataType.simpleString()}, bin int, unit string, posterior double, grams_per double, explained boolean")


def common_grams(rows: DataFrame, size: str, title: str, source: str, keep: list[str]) -> DataFrame:
    """Every size of `rows` in grams: the columns `keep`, then grams, unit_from and uncertain; one row per distinct size.

    A size with a written unit is converted as written. Bare numbers get the unit of their source's
    mixture (grams where the source is null or blank); `uncertain` marks a posterior below 0.9, and a number
    that is near no known size in any unit. No number is left out, however large or small. Where
    `size` is null or blank the weight in `title` counts. Texts without a weight, and null rows, give no rows.
    """
    blank = F.trim(F.coalesce(F.col(size), F.lit(""))) == ""
    clear = F.when(F.trim(F.coalesce(F.col(source), F.lit(""))) != "", F.trim(F.col(source)))
    base = rows.select(F.struct(*keep).alias("kept"), clear.alias("source"), F.when(blank, F.col(title)).otherwise(F.col(size)).alias("text"), blank.alias("titled"))
    base = base.select("kept", "source", "titled", written_grams(F.col("text")).alias("written"), F.when(~F.col("titled"), bare_numbers(F.col("text"))).alias("bare"))
    written = base.select("kept", F.explode("written").alias("grams"), F.when(F.col("titled"), F.lit("title")).otherwise("text").alias("unit_from"), F.lit(False).alias("uncertain"))
    bare = base.select("kept", "source", F.explode("bare").alias("x"))
    plain = bare.where("source is null").select("kept", F.col("x").alias("grams"), F.lit("default").alias("unit_from"), F.lit(False).alias("uncertain"))
    sourced = bare.where("source is not null").withColumn("bin", _bin(F.col("x")))
    units = infer_units(sourced, "source", "x", written, "grams")
    inferred = sourced.join(units, (F.col("source") == F.col("src")) & (sourced["bin"] == units["bin"])).select("kept", (F.col("x") * F.col("grams_per")).alias("grams"), F.lit("source").alias("unit_from"), ((F.col("posterior") < SURE) | ~F.col("explained")).alias("uncertain"))
    return written.unionByName(plain).unionByName(inferred).select("kept.*", "grams", "unit_from", "uncertain")
