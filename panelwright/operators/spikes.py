"""Implausible spikes, stuck values and impossible readings, per source: isolation forests and physical limits.

Rows are shuffled once, by source (large sources in chunks of series), and sorted by series and period;
everything else is vectorised over batches of whole chunks.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import Scratch

#: Trees per forest, readings per tree between which its cuts are drawn and to which the sizes of its leaves are scaled, levels of a tree.
TREES, SAMPLE, DEPTH = 32, 128, 6
#: Rows of a source that are held in one task: a source with more is spread over chunks of its series. Profiles of chunks that are merged at once.
CHUNK_ROWS, FAN = 50_000, 64
#: Rows that are held at once.
BUFFER_ROWS = 150_000
#: No price is below or at the one, or at or above the other (physical limits).
LOWEST, HIGHEST = 1.0, 900_000.0
#: Isolation scores below this are normal readings; share of a source's readings that can be isolated at most.
SCORE, MOST = 0.62, 0.1
#: Log distance from all neighbouring readings that a sale, or a lasting move, can't explain; and in units of the source's usual step.
FAR_UP, FAR_DOWN, SWINGS = 0.53, 0.6931, 2.0
#: The same beside one reading only.
FAR_ALONE = 1.1
#: A source moves every period if fewer of its steps are flat; so many equal readings in a row are then stuck.
FLAT, STUCK = 0.45, 4
#: Two prices this close are equal.
SAME = 0.005
#: Neighbours on each side.
NEAR = 4
_BINS, _WIDTH = 1024, 0.002
#: Width of the bins of a source's log readings, of which its level is the median.
_LEVEL_WIDTH = 0.0002
#: Bins of the scores of a source, one of which holds the score that a share MOST of its readings reaches; a power of two, so that scores are binned exactly.
_SCORE_BINS = 1 << 16
_FEATURES = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64: the same draws for a source wherever it is computed."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    out = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def _runs(key: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)


def _row_median(m: np.ndarray) -> np.ndarray:
    """Median of each row without its NaNs; NaN for none."""
    n = np.count_nonzero(~np.isnan(m), axis=1)
    s = np.sort(m, axis=1)
    at = np.arange(len(m))
    return np.where(n > 0, (s[at, np.maximum(n - 1, 0) // 2] + s[at, np.minimum(n // 2, m.shape[1] - 1)]) / 2, np.nan)


def _group_median(group: np.ndarray, x: np.ndarray, groups: int) -> np.ndarray:
    out = np.full(groups, np.nan)
    keep = ~np.isnan(x)
    g, x = group[keep], x[keep]
    order = np.lexsort((x, g))
    g, x = g[order], x[order]
    start = _runs(g)
    if len(start):
        n = np.diff(np.r_[start, len(g)])
        out[g[start]] = (x[start + (n - 1) // 2] + x[start + n // 2]) / 2
    return out


def _around(x: np.ndarray, series: np.ndarray) -> np.ndarray:
    """(n, 2 * NEAR): the readings of the same series before (nearest first) and after (nearest first)."""
    out = np.full((len(x), 2 * NEAR), np.nan)
    for k in range(1, NEAR + 1):
        same = series[k:] == series[:-k]
        out[k:, k - 1] = np.where(same, x[:-k], np.nan)
        out[: len(x) - k, NEAR + k - 1] = np.where(same, x[k:], np.nan)
    return out


def _nearest(m: np.ndarray) -> np.ndarray:
    """The first value of each row that is not NaN."""
    has = ~np.isnan(m)
    return np.where(has.any(1), m[np.arange(len(m)), has.argmax(1)], np.nan)


def _features(x: np.ndarray, period: np.ndarray, series: np.ndarray) -> dict:
    """Level, differences, season and run length of log readings that are sorted by series and period."""
    around = _around(x, series)
    middle = _row_median(around)
    level = x - _group_median(series, x, int(series.max(initial=-1)) + 1)[series]
    before, after = x - around[:, 0], x - around[:, NEAR]
    season = np.full(len(x), np.nan)
    for k in range(1, NEAR + 1):
        if len(x) > k:
            same = (series[k:] == series[:-k]) & (period[k:] - period[:-k] == 4)
            season[k:] = np.where(same, x[k:] - x[:-k], season[k:])
    new = np.ones(len(x), bool)
    new[1:] = (series[1:] != series[:-1]) | (np.abs(np.expm1(x[1:] - x[:-1])) * np.exp(x[:-1]) >= SAME)
    starts = np.flatnonzero(new)
    length = np.diff(np.r_[starts, len(x)])
    run = np.repeat(length, length)
    off = x - middle
    f = np.stack([level, np.nan_to_num(off), np.nan_to_num(before), np.nan_to_num(after), np.where(np.isnan(season), np.nan_to_num(off), season), np.log(run.astype(float))], 1) if len(x) else np.zeros((0, _FEATURES))
    return {"f": f, "around": around, "off": off, "run": run, "first": new, "step": before}


#: Mean path lengths among 0 to SAMPLE points, between which those of scaled sizes lie.
_PATHS = _path(np.arange(SAMPLE + 1))


def _grow(f: np.ndarray, start: np.ndarray, n: np.ndarray, seed: np.ndarray) -> dict:
    """Forests of some sources at once: split feature, split value and the leaves' depths.

    The drawn readings of a node stay side by side; each level moves those at or above the split value behind the others.
    """
    s, trees, inner = len(n), len(n) * TREES, (1 << DEPTH) - 1
    draw = np.arange(TREES * SAMPLE, dtype=np.uint64)
    pick = _mix(seed.astype(np.uint64)[:, None] + draw * np.uint64(0xD1342543DE82EF95))
    # readings that are enough for all trees are dealt out; fewer are drawn again and again
    pick = np.where((n >= TREES * SAMPLE)[:, None], draw, pick)
    rows = (start[:, None] + (pick % np.maximum(n, 1).astype(np.uint64)[:, None]).astype(np.int64)).reshape(-1)
    drawn = np.ascontiguousarray(f[np.minimum(rows, len(f) - 1)].T.astype(np.float32))  # a source without readings gets a forest that nothing uses
    flat, many = drawn.reshape(-1), drawn.shape[1]
    feature, value = np.zeros((trees, inner), np.int8), np.full((trees, inner), np.inf, np.float32)
    depth = np.full((trees, 1 << DEPTH), DEPTH, np.int8)
    noise = _mix(np.arange(trees, dtype=np.uint64)[:, None] % np.uint64(TREES) + np.repeat(seed.astype(np.uint64), TREES)[:, None] * np.uint64(3) + np.arange(2 * inner, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    which = (noise[:, :inner] % np.uint64(_FEATURES)).astype(np.int8)
    where = ((noise[:, inner:] >> np.uint64(11)).astype(float) / float(1 << 53)).astype(np.float32)
    order, size = np.arange(many), np.full(trees, SAMPLE)
    tree, node = np.arange(trees), np.zeros(trees, int)
    for level in range(DEPTH):
        at = np.r_[0, np.cumsum(size)[:-1]]
        feat = which[tree, node]
        v = flat[np.repeat(feat.astype(np.int64) * many, size) + order]
        low, high = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
        split = high > low
        cut = low + where[tree, node] * (high - low)
        cut = np.where(split, np.where(cut > low, cut, high), np.inf).astype(np.float32)
        feature[tree, node], value[tree, node] = feat, cut
        # a node that is not split passes everything to its left; its depth goes to the leaf at the end of that way
        end = ~split
        depth[tree[end], ((node[end] + 1) << (DEPTH - level)) - (1 << DEPTH)] = level
        keep = np.repeat(split, size)
        right = (v >= np.repeat(cut, size))[keep]
        order, size, tree, node = order[keep], size[split], tree[split], node[split]
        if not len(size):
            break
        at = np.r_[0, np.cumsum(size)[:-1]]
        seen = np.cumsum(right)
        seen -= np.repeat(np.r_[0, seen][at], size)
        above = np.add.reduceat(right.astype(np.int64), at)
        begin = np.repeat(at, size)
        moved = np.empty_like(order)
        moved[np.where(right, begin + np.repeat(size - above, size) + seen - 1, np.arange(len(order)) - seen)] = order
        order, size = moved, np.stack([size - above, above], 1).reshape(-1)
        tree, node = np.repeat(tree, 2), np.stack([2 * node + 1, 2 * node + 2], 1).reshape(-1)
    return {"feature": feature.reshape(s, TREES, -1), "value": value.reshape(s, TREES, -1), "depth": depth.reshape(s, TREES, -1)}


def _leaves(f: np.ndarray, source: np.ndarray, forest: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each tree: the leaf of each reading, numbered over all sources, and the sizes of each source's leaves: all readings count."""
    inner, flat = (1 << DEPTH) - 1, np.ascontiguousarray(f, np.float32).reshape(-1)
    row, sources = np.arange(len(f)) * _FEATURES, len(forest["depth"])
    for t in range(TREES):
        feature, value = forest["feature"][:, t].reshape(-1), forest["value"][:, t].reshape(-1)
        node, base = np.zeros(len(f), np.int64), source * inner
        for _ in range(DEPTH):
            at = base + node
            node = 2 * node + 1 + (flat[row + feature[at]] >= value[at])
        leaf = source * (1 << DEPTH) + node - inner
        yield leaf, np.bincount(leaf, minlength=sources << DEPTH).reshape(sources, -1)


def _score(f: np.ndarray, source: np.ndarray, forest: dict, sizes: dict) -> np.ndarray:
    """Isolation score of each reading, 0 to 1; sizes: those of the leaves of each tree, of sources that are not all here."""
    total = np.zeros(len(f))
    for t, (leaf, size) in enumerate(_leaves(f, source, forest)):
        for i, known in sizes.items():
            size[i] = known[t]
        # a reading is not among the others of its leaf; a source's only one is parted from nothing
        others = size.sum(1, keepdims=True) - 1
        scaled = SAMPLE * np.where(others > 0, np.maximum(size - 1, 0) / np.maximum(others, 1), 1.0)
        total += (forest["depth"][:, t] + np.interp(scaled, np.arange(SAMPLE + 1), _PATHS)).reshape(-1)[leaf]
    return np.exp2(-total / TREES / float(_path(SAMPLE)))


def _profile_of(x: np.ndarray, got: dict, source: np.ndarray, sources: int) -> tuple[np.ndarray, np.ndarray]:
    """Per source: histogram of the sizes of its steps, and [flat steps, steps]."""
    step = np.abs(got["step"])
    ok = ~np.isnan(step)
    at = np.minimum(step[ok] / _WIDTH, _BINS - 1).astype(int)
    hist = np.bincount(source[ok] * _BINS + at, minlength=sources * _BINS).reshape(sources, _BINS)
    flat = np.bincount(source[ok], weights=~got["first"][ok], minlength=sources)
    return hist, np.stack([flat, hist.sum(1)], 1)


def _swing(hist: np.ndarray) -> np.ndarray:
    """1.48 times the median step of each source."""
    half = np.cumsum(hist, 1)
    middle = (half < half[:, -1:] / 2).sum(1)
    return np.where(middle == 0, 0.0, 1.4826 * (middle + 0.5) * _WIDTH)


def _pack(model: dict) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **model)
    return out.getvalue()


def _unpack(blob: bytes) -> dict:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def _drawn(group: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Rows of the readings with the least `pick` of each group, enough for all trees, by group and pick: the same draw however a source is cut."""
    order = np.lexsort((pick, group))
    start = _runs(group[order])
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[rank < TREES * SAMPLE]


def _forest_of(f: np.ndarray, group: np.ndarray, seeds: np.ndarray) -> dict:
    """A forest for each group of readings; groups are grown a few at a time, which keeps the arrays small."""
    n = np.bincount(group, minlength=len(seeds))
    start = np.r_[0, np.cumsum(n)]
    if not len(f):
        f, start = np.zeros((1, _FEATURES)), np.zeros(len(seeds) + 1, int)
    parts = [_grow(f[start[i] : max(start[min(i + 16, len(seeds))], start[i] + 1)] if start[i] < len(f) else f[-1:], start[i : min(i + 16, len(seeds))] - start[i], n[i : i + 16], seeds[i : i + 16]) for i in range(0, len(seeds), 16)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _binned(score: np.ndarray) -> np.ndarray:
    return np.floor(score * _SCORE_BINS).astype(np.int32)


def _bounds(score: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The score that makes a reading of each group a candidate: SCORE, or more where over a share MOST of its readings reaches that."""
    out = np.full(groups, SCORE)
    bins = _binned(score)
    order = np.lexsort((bins, group))
    start = _runs(group[order])
    if len(start):
        n = np.diff(np.r_[start, len(order)])
        # the greatest score always remains one
        at = np.minimum(start + np.ceil((1 - MOST) * n).astype(int), start + n - 1)
        out[group[order][start]] = np.maximum(SCORE, bins[order][at] / _SCORE_BINS)
    return out


class _Chunks:
    """Batches cut at chunk boundaries, with one row per series and period; rows of models (kind 0) go to `models`."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.models = batches, {}

    def __iter__(self) -> Iterator[pa.Table]:
        held: list[pa.Table] = []
        rows, last = 0, None
        for b in self.batches:
            t = pa.Table.from_batches([b])
            kind = t.column("kind").to_numpy()
            if (kind == 0).any():
                for i in np.flatnonzero(kind == 0):
                    self.models[t.column("src")[int(i)].as_py()] = _unpack(t.column("blob")[int(i)].as_py())
                t = t.filter(pa.array(kind == 1))
            t = t.drop_columns(["kind", "blob"])
            if not len(t):
                continue
            # rows are sorted: the first one of a series and period counts, and only that is held
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("src", "salt", "sk", "t")], 1)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]).any(1)
            new[0] = last is None or (key[0] != last).any()
            last = key[-1]
            t = t.filter(pa.array(new))
            held.append(t)
            rows += len(t)
            if rows >= BUFFER_ROWS:
                whole = pa.concat_tables(held)
                src, salt = whole.column("src").to_numpy(), whole.column("salt").to_numpy()
                cut = np.flatnonzero((src[1:] != src[:-1]) | (salt[1:] != salt[:-1]))
                if len(cut):
                    yield whole.slice(0, cut[-1] + 1)
                    held = [whole.slice(cut[-1] + 1)]
                    rows = len(held[0])
                else:
                    held = [whole]
        if rows:
            yield pa.concat_tables(held)


def _numbered(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the chunks (a source that is not split is one) and series of a table's rows, and their periods."""
    src, salt, sk, period = (t.column(c).to_numpy() for c in ("src", "salt", "sk", "t"))
    new_chunk = np.r_[True, (src[1:] != src[:-1]) | (salt[1:] != salt[:-1])]
    new_series = np.r_[True, new_chunk[1:] | (sk[1:] != sk[:-1])]
    return np.cumsum(new_chunk) - 1, np.cumsum(new_series) - 1, period


def _possible(v: np.ndarray) -> np.ndarray:
    return np.isfinite(v) & (v >= LOWEST) & (v < HIGHEST)


def _picks(t: pa.Table) -> np.ndarray:
    return _mix(t.column("sk").to_numpy().view(np.uint64) ^ t.column("t").to_numpy().astype(np.uint64))


def _told(batches: Iterator[pa.RecordBatch], tell) -> Iterator[pa.RecordBatch]:
    """A blob for each chunk of a split source: what tell(name, log readings, features, picks, model so far) says of its prices and of what stands beside them."""
    chunks = _Chunks(batches)
    for t in chunks:
        chunk, series, period = _numbered(t)
        picks, out = _picks(t), ([], [], [])
        for mine in map(slice, _runs(chunk), np.r_[_runs(chunk)[1:], len(chunk)]):
            src, parts = int(t.column("src")[mine.start].as_py()), {}
            for name in ("p", "c"):
                v = t.column(name).to_numpy()[mine]
                ok = _possible(v)
                _, sid = np.unique(series[mine][ok], return_inverse=True)
                x = np.log(v[ok])
                parts |= tell(name, x, _features(x, period[mine][ok], sid), picks[mine][ok], chunks.models.get(src))
            for column, value in zip(out, (src, int(t.column("salt")[mine.start].as_py()), _pack(parts))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["src", "salt", "blob"])


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each chunk tells first: histograms of its steps and levels, and its share of what the source's trees draw."""

    def tell(name, x, got, picks, model):
        few = _drawn(np.zeros(len(x), int), picks)
        at, n = np.unique((x / _LEVEL_WIDTH).astype(np.int32), return_counts=True)
        out = {f"f_{name}": got["f"][few].astype(np.float32), f"k_{name}": picks[few], f"at_{name}": at, f"n_{name}": n}
        if name == "p":
            hist, flat = _profile_of(x, got, np.zeros(len(x), int), 1)
            out |= {"hist": hist[0], "flat": flat[0]}
        return out

    return _told(batches, tell)


def _forest_in(model: dict, name: str) -> dict:
    return {a: model[f"{a}_{name}"] for a in ("feature", "value", "depth")}


def _leaf_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each chunk tells when its source's trees have grown: how many of its readings are in each leaf."""
    return _told(batches, lambda name, x, got, picks, model: {f"size_{name}": np.stack([size[0] for _, size in _leaves(got["f"], np.zeros(len(x), int), _forest_in(model, name))])})


def _score_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each chunk tells when the leaves' sizes are known: the histogram of its readings' scores."""

    def tell(name, x, got, picks, model):
        at, n = np.unique(_binned(_score(got["f"], np.zeros(len(x), int), _forest_in(model, name), {0: model[f"size_{name}"]})), return_counts=True)
        return {f"at_{name}": at, f"n_{name}": n}

    return _told(batches, tell)


def _merged(blobs) -> dict:
    """What several chunks tell together; the order in which they are merged does not matter."""
    parts = [_unpack(b) for b in blobs]
    out = {k: sum(p[k] for p in parts) for k in ("hist", "flat", "size_p", "size_c") if k in parts[0]}
    for name in ("p", "c"):
        if f"f_{name}" in parts[0]:
            f, k = (np.concatenate([p[f"{a}_{name}"] for p in parts]) for a in "fk")
            few = np.argsort(k, kind="stable")[: TREES * SAMPLE]
            out[f"f_{name}"], out[f"k_{name}"] = f[few], k[few]
        if f"at_{name}" in parts[0]:
            at, back = np.unique(np.concatenate([p[f"at_{name}"] for p in parts]), return_inverse=True)
            out[f"at_{name}"], out[f"n_{name}"] = at, np.bincount(back, weights=np.concatenate([p[f"n_{name}"] for p in parts]), minlength=len(at)).astype(np.int64)
    return out


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"src": pdf["src"].iloc[:1].to_numpy(), "salt": [int(pdf["salt"].iloc[0]) // FAN], "blob": [_pack(_merged(pdf["blob"]))]})


def _levels(x: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The median log reading of each group, to the width of a bin."""
    return (_group_median(group, np.floor(x / _LEVEL_WIDTH), groups) + 0.5) * _LEVEL_WIDTH


def _ranked(got: dict, name: str, ranks) -> np.ndarray:
    """Bins of the readings of some ranks, counted from 1."""
    return got[f"at_{name}"][np.searchsorted(np.cumsum(got[f"n_{name}"]), ranks)]


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """The model of one split source from its chunks' profiles: all but the sizes of its leaves and its bounds."""
    got = _merged(pdf["blob"])
    seed = np.array([int(pdf["src"].iloc[0])]).view(np.uint64)
    model = {"swing": _swing(got["hist"][None, :]), "flat": got["flat"][None, :]}
    for name in ("p", "c"):
        f = got[f"f_{name}"]
        one = np.zeros(len(f), int)
        n = int(got[f"n_{name}"].sum())
        middle = _ranked(got, name, [(n + 1) // 2, n // 2 + 1]).mean() if n else math.nan
        model[f"level_{name}"] = np.array([(middle + 0.5) * _LEVEL_WIDTH])
        model |= {f"{a}_{name}": v for a, v in _forest_of(f, one, seed).items()}
    return pd.DataFrame({"src": pdf["src"].iloc[:1].to_numpy(), "blob": [_pack(model)]})


def _complete(pdf: pd.DataFrame) -> pd.DataFrame:
    """The model of one split source, beside it the sizes of its leaves, or its scores, by its chunks: with the sizes, or the bounds."""
    mine = pdf["salt"] < 0
    model, got = _unpack(pdf["blob"][mine].iloc[0]), _merged(pdf["blob"][~mine])
    for name in ("p", "c"):
        if f"size_{name}" in got:
            model[f"size_{name}"] = got[f"size_{name}"]
        else:
            n = int(got[f"n_{name}"].sum())
            bound = _ranked(got, name, [min(math.ceil((1 - MOST) * n), n - 1) + 1]) / _SCORE_BINS if n else np.zeros(1)
            model[f"bound_{name}"] = np.maximum(SCORE, bound)
    return pd.DataFrame({"src": pdf["src"].iloc[:1].to_numpy(), "blob": [_pack(model)]})


def _judge(x, got, other, series, source, candidate, level, swing, flat, main: bool):
    """(far, stuck, clean) of possible log readings; clean: the readings, those that are far replaced by what is usual around them.

    Only what the forest has isolated (candidate) can be far.
    """
    wide = np.maximum(SWINGS * swing[source], 0)
    doubtful = np.abs(got["off"]) > np.maximum(1.0, wide)
    clean = np.where(doubtful, np.nan, x)
    around = _around(clean, series)
    middle = _row_median(around)
    refs = np.stack([_nearest(around[:, :NEAR]), _nearest(around[:, NEAR:]), middle], 1)
    if not main:
        # a compare-at price stands a little above the price beside it
        refs = np.concatenate([refs, (other + 0.2)[:, None]], 1)
    alone = np.isnan(refs).all(1)
    if alone.any():
        # too few readings to tell which of them is wrong: the price beside it, else the one farther from the source's level
        side = other - 0.2 if main else np.full(len(x), np.nan)
        far_side = np.abs(got["off"]) > 0
        worse = np.abs(x - level[source]) > np.abs(x - got["off"] - level[source])
        guess = np.where(~np.isnan(side), side, np.where(far_side & worse, x - got["off"], np.nan))
        refs[:, 2] = np.where(alone, guess, refs[:, 2])
    d = x[:, None] - refs
    low, high = np.nanmin(np.where(np.isnan(d), np.inf, d), 1), np.nanmax(np.where(np.isnan(d), -np.inf, d), 1)
    distance = np.where(np.isinf(low), 0.0, np.where(low > 0, low, np.where(high < 0, high, 0.0)))
    # beside one reading only, that one may be on sale, and the price may have moved since
    few = np.count_nonzero(~np.isnan(around), axis=1) < 2
    up = np.where(few, FAR_ALONE, FAR_UP)
    low_wide = np.maximum(np.where(few, FAR_ALONE, FAR_DOWN), wide)
    far = (distance > np.maximum(up, wide)) | (distance < -low_wide)
    if main:
        # a sale on a price that has moved: the price before the sale stands beside it, less than half off, and is not far itself
        off = other - x
        far &= ~((distance < 0) & (off > 0) & (off < FAR_DOWN) & (distance + off > -low_wide))
    far &= candidate
    share = flat[:, 0] / np.maximum(flat[:, 1], 1)
    stuck = (got["run"] >= STUCK) & ~got["first"] & (share < FLAT)[source] & (flat[:, 1] > 0)[source] if main else np.zeros(len(x), bool)
    return far, stuck, np.where(far, refs[:, 2], x)


_OUT = pa.schema([("series", pa.string()), ("t", pa.int32()), ("field", pa.string()), ("rule", pa.string()), ("score", pa.float64())])


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks = _Chunks(batches)
    for t in chunks:
        chunk, series, period = _numbered(t)
        keys = t.column("src").to_numpy()[_runs(chunk)]
        seeds, groups, picks = keys.view(np.uint64), len(keys), _picks(t)
        values = {n: t.column(n).to_numpy() for n in ("p", "c")}
        ok = {n: _possible(v) for n, v in values.items()}
        logs = {n: np.where(ok[n], np.log(np.where(ok[n], v, 1.0)), np.nan) for n, v in values.items()}
        known = [(i, chunks.models[k]) for i, k in enumerate(keys.tolist()) if k in chunks.models]
        swing = flat = None
        for n, field in (("p", 0), ("c", 1)):
            at = np.flatnonzero(ok[n])
            bad = np.flatnonzero(~ok[n] & ~np.isnan(values[n]))
            if len(bad):
                yield _rows(t, bad, field, "impossible", np.ones(len(bad)))
            x, src = logs[n][at], chunk[at]
            sid = np.cumsum(np.r_[True, series[at][1:] != series[at][:-1]]) - 1 if len(at) else series[at]
            got = _features(x, period[at], sid)
            if n == "p":
                hist, flat = _profile_of(x, got, src, groups)
                swing = _swing(hist)
                for i, m in known:
                    swing[i], flat[i] = m["swing"][0], m["flat"][0]
            if not len(at):
                continue
            few = _drawn(src, picks[at])
            forest = _forest_of(got["f"][few], src[few], seeds)
            level = _levels(x, src, groups)
            for i, m in known:
                level[i] = m[f"level_{n}"][0]
                for a in forest:
                    forest[a][i] = m[f"{a}_{n}"][0]
            score = _score(got["f"], src, forest, {i: m[f"size_{n}"] for i, m in known})
            bound = _bounds(score, src, groups)
            for i, m in known:
                bound[i] = m[f"bound_{n}"][0]
            far, stuck, clean = _judge(x, got, logs["c" if n == "p" else "p"][at], sid, src, score >= bound[src], level, swing, flat, n == "p")
            if n == "p":
                logs["p"][at] = clean
            for hit, rule in ((far, "far"), (stuck & ~far, "stuck")):
                if hit.any():
                    yield _rows(t, at[hit], field, rule, score[hit])


def _rows(t: pa.Table, at: np.ndarray, field: int, rule: str, score: np.ndarray) -> pa.RecordBatch:
    few = t.take(pa.array(at)).combine_chunks()
    n = len(at)
    return pa.RecordBatch.from_arrays([few.column("series").combine_chunks(), pa.array(few.column("t").to_numpy(), pa.int32()), pa.array([("main", "other")[field]] * n), pa.array([rule] * n), pa.array(score)], schema=_OUT)


def flag_spikes(rows: DataFrame, source: Column, series: Column, period: Column, version: Column, value: Column, beside: Column) -> DataFrame:
    """Readings that can't be right, judged by how their series and source otherwise behave.

    rows: one row per reading of a series (say, a variant) of a source in a period (an int); of several, the
    one with the greatest version counts, of copies the least value that is not null. value is the price,
    beside a second price that stands at or above it. Returns series, t (the period), field (`main` or
    `other`), rule and score, one row per implausible reading:
    `impossible`: no number from 1 up to 900,000;
    `far`: isolated by its source's forest, and farther from the readings before and after it and from the
      median of up to eight around it than a sale (below half), a lasting move, or two usual steps explain;
    `stuck`: four or more equal readings in a row, all but the first, where fewer than 45 % of the source's steps are flat.

    The forests (32 trees) use level, differences to both neighbours, distance from their median, difference
    to four periods before, and run length. A tree's cuts are random, as the method has it: each lies between
    the extremes of 128 of the source's readings, which are drawn from all. What is counted is counted over
    all readings: the sizes of the leaves (a reading's path ends among the others of its leaf, as many as they
    would be if the source had 128 readings), the scores, the levels and the steps. Every reading is scored; a reading is isolated at a score of 0.62, or at the score that a tenth of
    its source's readings reaches, if that is more. What swings a source usually makes is left to its forest.
    A source's model depends on its readings only: draws are least hashes, counts are histograms, so a source
    of over 50,000 rows, which is spread over chunks of its series, has the same model as in one piece. Its
    chunks are read once for steps, levels and trees, once for the leaves, once for the scores; what they tell
    is merged in a tree. Null values are no readings; rows without a series or period are left out; those
    without a source are one source.
    """
    x = lambda c: F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    base = rows.select(F.xxhash64(source).alias("src"), series.cast("string").alias("series"), period.cast("int").alias("t"), version.cast("string").alias("ver"), x(value).alias("p"), x(beside).alias("c"))
    base = base.where("series is not null and t is not null").withColumn("sk", F.xxhash64("series"))

    # the sources above CHUNK_ROWS, written, so that the planner knows the size of what it may broadcast
    scratch = Scratch(rows.sparkSession, "spikes")
    chunked = F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int")
    table, seen = scratch.write(rows.groupBy(F.xxhash64(source).alias("lsrc")).agg(chunked.alias("chunks")).where("chunks > 1"), {"most": F.max("chunks")})
    if seen["rows"]:
        base = base.join(table, F.col("src") == F.col("lsrc"), "left").drop("lsrc")
    else:
        base = base.withColumn("chunks", F.lit(None).cast("int"))
    base = base.withColumn("salt", F.pmod("sk", F.coalesce("chunks", F.lit(1))).cast("int")).withColumn("kind", F.lit(1)).withColumn("blob", F.lit(None).cast("binary"))
    columns = ["src", "salt", "kind", "sk", "series", "t", "ver", "p", "c", "blob"]

    def arranged(df: DataFrame) -> DataFrame:
        return df.select(*columns).repartition("src", "salt").sortWithinPartitions("src", "salt", "kind", "sk", "series", "t", F.col("ver").desc_nulls_last(), F.col("p").asc_nulls_last(), F.col("c").asc_nulls_last()).drop("ver")

    if not seen["rows"]:
        return arranged(base).mapInArrow(_flag, "series string, t int, field string, rule string, score double")
    split, _ = scratch.write(base.where("chunks is not null").select(*columns))
    null = lambda c: F.lit(None).cast(dict(base.dtypes)[c]).alias(c)

    def beside(models: DataFrame) -> DataFrame:
        """A row of each chunk's source's model."""
        each = models.join(table, F.col("src") == F.col("lsrc")).select("src", "blob", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("salt"))
        return each.select("src", F.col("salt").cast("int").alias("salt"), F.lit(0).alias("kind"), *[null(c) for c in columns if c not in ("src", "salt", "kind", "blob")], "blob")

    models = None
    for tell in (_profile, _leaf_sizes, _score_bins):
        told = arranged(split.unionByName(beside(models)) if models is not None else split).mapInArrow(tell, "src long, salt int, blob binary")
        most = seen["most"]
        while most > FAN:
            told = told.groupBy("src", F.floor(F.col("salt") / FAN)).applyInPandas(_merge, "src long, salt int, blob binary")
            most = -(-most // FAN)
        if models is not None:
            told = told.unionByName(models.withColumn("salt", F.lit(-1)))
        before, (models, _) = models, scratch.write(told.groupBy("src").applyInPandas(_complete if models is not None else _train, "src long, blob binary"))
        if before is not None:
            scratch.drop(before)
    whole = base.where("chunks is null").select(*columns).unionByName(split).unionByName(beside(models))
    return arranged(whole).mapInArrow(_flag, "series string, t int, field string, rule string, score double")
