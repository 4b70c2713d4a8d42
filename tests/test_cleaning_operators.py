from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from panelwright.operators import spikes
from panelwright.operators.nested import _deep, _walk, decode_after, decode_all, flatten, holder_rows
from panelwright.operators.regular_grid import read_timestamp, regular_grid
from panelwright.operators.snapshots import key_ordinals, snapshot_changes
from panelwright.operators.spikes import flag_spikes
from panelwright.operators.units import bare_numbers, common_grams, written_grams
from panelwright.plans import corpus_tables

DATA = "/root/testdata/sf0.001"


def test_entry_and_queries_agree(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# -- snapshots

SNAP = "s string, k string, q string, ver string, x double, source string, key string"


def brute_changes(rows):
    snaps, cell = {}, {}
    for s, k, q, ver, x, *_ in rows:
        if q is None:
            continue
        snaps.setdefault(s, set()).add(q)
        if k is not None:
            rank = (ver or "", x is not None, -x if x is not None else 0)
            if (s, k, q) not in cell or rank > cell[(s, k, q)][0]:
                cell[(s, k, q)] = (rank, x)
    out = set()
    for s, qs in snaps.items():
        qs = sorted(qs)
        for a, b in zip(qs, qs[1:]):
            was, now = ({k: v[1] for (s2, k, q), v in cell.items() if (s2, q) == (s, at)} for at in (a, b))
            out |= {(s, k, b, "added") for k in now.keys() - was.keys()} | {(s, k, b, "removed") for k in was.keys() - now.keys()}
            for k in now.keys() & was.keys():
                x, y = was[k], now[k]
                if (x is None) != (y is None) or x is not None and abs(x - y) >= 0.005:
                    out.add((s, k, b, "changed"))
    return out


def changes(spark, rows, **kw):
    df = spark.createDataFrame(rows, SNAP)
    got = snapshot_changes(df, F.col("s"), F.col("k"), F.col("q"), F.col("ver"), F.col("x"), **kw).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_snapshots_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, keys in (("hot", 300), ("b", 5), (None, 3), ("one", 2)):
        for q in ("2024Q1", "2024Q2", "2024Q4") if s != "one" else ("2024Q1",):
            for k in range(keys):
                if rng.random() < 0.7:
                    for _ in range(1 + int(rng.random() < 0.2)):
                        rows.append((s, None if rng.random() < 0.02 else f"k{k}", q, None if rng.random() < 0.1 else str(rng.integers(3)), None if rng.random() < 0.1 else float(rng.integers(3)), "x", "y"))
    rows += rows[:20] + [("b", "k1", None, "1", 1.0, "x", "y"), ("b", None, "2025Q1", "1", 1.0, "x", "y")]
    assert changes(spark, rows) == brute_changes(rows)
    assert changes(spark, rows, space=16) == brute_changes(rows)


def test_ordinals_persist(spark, tmp_path):
    rows = [(s, f"k{k}", q, "1", float(k % 3 + i), "", "") for i, q in enumerate(("2024Q1", "2024Q2")) for s in ("a", "b", None) for k in range(40) if (k + i) % 4]
    more = rows + [(s, f"k{k}", "2024Q3", "1", 1.0, "", "") for s in ("a", "new", None) for k in range(20, 70)] + [(s, None, "2024Q4", "1", 1.0, "", "") for s in ("a", "b")]
    store = f"file://{tmp_path}/store"

    def held():
        keys, _ = key_ordinals(spark.createDataFrame([], SNAP), F.col("s"), F.col("k"), store, space=16)
        return {(r["s"], r["k"]): (r["sp"], r["o"]) for r in keys.collect()}

    assert changes(spark, rows, store=store, space=16) == brute_changes(rows)
    first = held()
    assert changes(spark, rows, store=store, space=16) == brute_changes(rows) and held() == first
    assert changes(spark, more, store=store, space=16) == brute_changes(more)
    second = held()
    assert first.items() <= second.items() and len({(k[0], v) for k, v in second.items()}) == len(second) == len({(r[0], r[1]) for r in more if r[1]})
    assert changes(spark, more, store=store, space=16) == brute_changes(more) and held() == second


def test_snapshots_edges(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [("a", "k", "2024Q1", "1", 1.0, "", "")]) == set()
    tiny = [("a", "k", "2024Q1", "1", 1.0, "", ""), ("a", "k", "2024Q2", "1", 1.0000001, "", ""), ("a", "n", "2024Q1", "1", float("nan"), "", ""), ("a", "n", "2024Q2", "1", None, "", "")]
    assert changes(spark, tiny) == set()


# -- spikes

SPIKE = "source string, series string, t int, ver string, p double, c double, src long, salt int"


def spikes_of(spark, rows):
    df = spark.createDataFrame(rows, SPIKE)
    return {(r["series"], r["t"], r["field"], r["rule"]) for r in flag_spikes(df, F.col("source"), F.col("series"), F.col("t"), F.col("ver"), F.col("p"), F.col("c")).collect()}


def quiet(n=30, periods=8):
    rng = np.random.default_rng(5)
    return [("calm", f"v{v}", t, "1", float(400 + 10 * v if t < 4 else 420 + 10 * v), 600.0 if v % 2 else None, 1, 1) for v in range(n) for t in range(periods)], rng


def test_spikes_and_limits(spark):
    rows, _ = quiet()
    rows += [("calm", "x", t, "1", p, c, 1, 1) for t, (p, c) in enumerate([(500.0, None), (510.0, 700.0), (4000.0, 7000.0), (500.0, 700.0), (0.0, -1.0), (490.0, 700.0), (5.0, 700.0), (999999.0, None), (None, None), (320.0, 520.0), (500.0, 690.0)])]
    got = {r for r in spikes_of(spark, rows) if r[0] == "x"}
    assert got == {("x", 2, "main", "far"), ("x", 2, "other", "far"), ("x", 4, "main", "impossible"), ("x", 4, "other", "impossible"), ("x", 6, "main", "far"), ("x", 7, "main", "impossible")}


def test_moves_and_sales_are_none(spark):
    rows, _ = quiet()
    rows += [("calm", "m", t, "1", float(p), None, 1, 1) for t, p in enumerate([400.0, 400, 400, 560, 560, 560, 560])]
    rows += [("calm", "s", t, "1", p, c, 1, 1) for t, (p, c) in enumerate([(269.0, 405.0), (540.0, None), (540.0, None), (540.0, None)])]
    assert not {r for r in spikes_of(spark, rows) if r[0] in "ms"}


def test_stuck_only_where_prices_move(spark):
    rng = np.random.default_rng(6)
    moving = [("moving", f"w{v}", t, "1", float(500 * np.exp(rng.normal(0, 0.03))), None, 1, 1) for v in range(20) for t in range(9)]
    still = [("moving", "stuck", t, "1", float(p), None, 1, 1) for t, p in enumerate([500.0, 510, 505, 505, 505, 505, 515, 520])]
    rows, _ = quiet()
    got = spikes_of(spark, rows + moving + still)
    assert {r for r in got if r[3] == "stuck"} == {("stuck", t, "main", "stuck") for t in (3, 4, 5)}


def test_split_source_gives_the_same(spark, monkeypatch):
    rows, rng = quiet(60)
    rows += [("calm", f"z{i}", t, "1", 500.0 if t != i % 6 else 5000.0, None, 1, 1) for i in range(12) for t in range(6)]
    whole = spikes_of(spark, rows)
    monkeypatch.setattr(spikes, "CHUNK_ROWS", 100)
    assert spikes_of(spark, rows) == whole and len(whole) == 12


def test_a_split_source_has_the_model_of_a_whole_one():
    rng = np.random.default_rng(2)
    rows = [(7, sk % chunks, 1, 1000 * sk, f"v{sk}", t, float(np.exp(rng.normal(4 + sk % 3, 0.5))), None, None) for chunks in (1, 3) for rng in [np.random.default_rng(2)] for sk in range(30) for t in range(120)]
    names = {"src": pa.int64(), "salt": pa.int32(), "kind": pa.int32(), "sk": pa.int64(), "series": pa.string(), "t": pa.int32(), "p": pa.float64(), "c": pa.float64(), "blob": pa.binary()}
    half, models = len(rows) // 2, []
    for part in (rows[:half], sorted(rows[half:], key=lambda r: (r[1], r[3], r[5]))):
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), names.values())], names=list(names))
        got = pd.concat([b.to_pandas() for b in spikes._profile(iter([batch.slice(0, 700), batch.slice(700)]))])
        assert len(got) == len({r[1] for r in part})
        # merged in another order, and in two steps
        models += [spikes._unpack(spikes._train(d)["blob"].iloc[0]) for d in (got, got[::-1], pd.concat([spikes._merge(got[:1]), spikes._merge(got[1:])]) if len(got) > 1 else got)]
    for m in models[1:]:
        for k, v in models[0].items():
            assert np.array_equal(v, m[k], equal_nan=True), k
    assert abs(models[0]["level_p"][0] - np.median([np.log(r[6]) for r in rows[:half]])) < 3e-4 and np.isnan(models[0]["level_c"][0])


def test_the_forest_decides_what_swings_are_usual(spark, monkeypatch):
    rng = np.random.default_rng(8)
    wild = [("wild", f"w{v}", t, "1", float(500 * np.exp(rng.uniform(-0.7, 0.7))), None, 1, 1) for v in range(60) for t in range(12)]
    wild = [(*r[:4], r[4] * 60, *r[5:]) if i % 97 == 5 else r for i, r in enumerate(wild)]
    spiked = {(r[1], r[2]) for i, r in enumerate(wild) if i % 97 == 5}
    rows, _ = quiet()
    monkeypatch.setattr(spikes, "SWINGS", 0.5)  # leaves the source's swings to the forest alone
    found = {r[:2] for r in spikes_of(spark, rows + wild) if r[3] == "far"}
    monkeypatch.setattr(spikes, "SCORE", 0.0)
    monkeypatch.setattr(spikes, "MOST", 1.0)
    off = {r[:2] for r in spikes_of(spark, rows + wild) if r[3] == "far"}
    assert spiked <= found and len(found) <= len(spiked) + 2 and len(off) > len(found) + 20


def test_the_score_decides_on_the_panel(spark, monkeypatch):
    run = lambda: {tuple(r) for r in __spark_entry__.queries()["p3_found"](spark, "/root/testdata/sf0.1").collect()}
    on = run()
    monkeypatch.setattr(spikes, "SCORE", 0.0)
    monkeypatch.setattr(spikes, "MOST", 1.0)
    assert on < run()


CHUNK = {"src": pa.int64(), "salt": pa.int32(), "kind": pa.int32(), "sk": pa.int64(), "series": pa.string(), "t": pa.int32(), "p": pa.float64(), "c": pa.float64(), "blob": pa.binary()}


def a_source(chunks=1, models=()):
    """5,000 readings of one source, a quarter of them far off, and its model in each chunk."""
    rng = np.random.default_rng(3)
    prices = np.exp(rng.normal(6, 0.05, 5000) + np.where(rng.random(5000) < 0.25, rng.uniform(-2, 2, 5000), 0))
    rows = [(7, i // 20 % chunks, 1, 1000 * (i // 20), f"v{i // 20}", i % 20, float(p), None, None) for i, p in enumerate(prices)]
    rows += [(7, salt, 0, None, None, None, None, None, m) for salt in range(chunks) for m in models]
    rows.sort(key=lambda r: (r[1], r[2], r[3] or 0, r[5] or 0))
    return iter([pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), CHUNK.values())], names=list(CHUNK))])


def test_all_readings_of_a_source_set_its_score_bound(monkeypatch):
    score, judge, scores, candidates = spikes._score, spikes._judge, [], []
    monkeypatch.setattr(spikes, "SCORE", 0.4)  # over a tenth reaches that
    monkeypatch.setattr(spikes, "_score", lambda *a: scores.append(score(*a)) or scores[-1])
    monkeypatch.setattr(spikes, "_judge", lambda *a, **kw: candidates.append(a[5]) or judge(*a, **kw))
    assert sum(map(len, spikes._flag(a_source()))) > 0
    bins = np.floor(scores[0] * 65536)
    assert len(bins) == 5000 and np.sort(bins)[4500] / 65536 > spikes.SCORE
    assert np.array_equal(candidates[0], bins >= np.sort(bins)[4500])


def test_all_readings_of_a_source_count_in_its_leaves(monkeypatch):
    score, seen = spikes._score, []
    monkeypatch.setattr(spikes, "_score", lambda *a: seen.append((*a[:3], score(*a))) or seen[-1][-1])
    list(spikes._flag(a_source()))
    f, source, forest, got = seen[0]
    f, found = f.astype(np.float32), []
    for feature, value in zip(forest["feature"][0], forest["value"][0]):
        at = []
        for x in f:
            node = 0
            while node < len(value):
                node = 2 * node + 1 + bool(x[feature[node]] >= value[node])
            at.append(node)
        # a node that splits nothing leaves a way of lefts below it
        depth = {n: next((d for d in range(spikes.DEPTH) if np.isinf(value[(n + 1 >> spikes.DEPTH - d) - 1])), spikes.DEPTH) for n in set(at)}
        others = {n: 128 * (at.count(n) - 1) / 4999 for n in set(at)}
        found.append([depth[n] + np.interp(others[n], np.arange(129), spikes._path(np.arange(129))) for n in at])
    assert len(f) == 5000 and np.allclose(got, 2 ** (-np.mean(found, 0) / spikes._path(128)))


def test_a_split_source_is_flagged_like_a_whole_one(monkeypatch):
    monkeypatch.setattr(spikes, "SCORE", 0.4)
    flagged = lambda batches: sorted(r for b in batches for r in zip(*b.to_pydict().values()))
    whole, models = flagged(spikes._flag(a_source())), ()
    for tell in (spikes._profile, spikes._leaf_sizes, spikes._score_bins):
        got = pd.concat([b.to_pandas() for b in tell(a_source(3, models))] + [pd.DataFrame({"src": [7], "salt": [-1], "blob": [m]}) for m in models])
        models = tuple((spikes._complete if models else spikes._train)(got)["blob"])
    model = spikes._unpack(models[0])
    assert (model["size_p"].sum(1) == 5000).all() and model["bound_p"][0] > spikes.SCORE
    assert flagged(spikes._flag(a_source(3, models))) == whole and len(whole) > 100


def test_repeated_rows_of_one_series_are_not_held():
    names = {"src": pa.int64(), "salt": pa.int32(), "kind": pa.int32(), "sk": pa.int64(), "series": pa.string(), "t": pa.int32(), "p": pa.float64(), "c": pa.float64(), "blob": pa.binary()}
    batch = pa.RecordBatch.from_arrays([pa.array([x] * 1000, k) for x, k in zip((1, 0, 1, 5, "v", 3, 2.0, None, None), names.values())], names=list(names))
    assert [len(t) for t in spikes._Chunks(iter([batch] * 5))] == [1]


def test_spike_edges(spark):
    assert spikes_of(spark, []) == set()
    odd = [(None, "a", 1, None, float("nan"), None, 1, 1), ("s", None, 1, "1", 5.0, None, 1, 1), ("s", "b", None, "1", 5.0, None, 1, 1), ("s", "c", 1, "1", 5.0, None, 1, 1), ("s", "c", 1, "1", 5.0, None, 1, 1)]
    assert spikes_of(spark, odd) == set()


# -- regular grid

@pytest.mark.parametrize("stamp, read", [("20240825022409", "2024-08-25 02:24:09"), ("20240825", "2024-08-25 00:00:00"), ("2024-08-25T02:24:09", "2024-08-25 02:24:09"), (" 2024-08-25 02:24:09 ", "2024-08-25 02:24:09"), ("20241325000000", None), ("20240230", None), ("20240101250000", None), ("n/a", None), ("", None), (None, None)])
def test_read_timestamp(spark, stamp, read):
    assert spark.range(1).select(read_timestamp(F.lit(stamp).cast("string"))).first()[0] == read


def test_grid(spark):
    t0 = 8092
    rows = [("a", t0 + i, str(i), 100.0 + 2 * i, 0) for i in (0, 1, 2, 4, 5, 9)] + [("a", t0, "0", 100.0, 0), ("a", t0 + 1, "9", 777.0, 0), ("a", None, "1", 1.0, 0), ("b", t0, "1", None, 0), ("b", t0 + 2, "1", None, 0), (None, t0, "1", 3.0, 0)]
    df = spark.createDataFrame(rows, "s string, t int, o string, x double, w int")
    got = {(r["source"], r["period"]): r for r in regular_grid(df, F.col("s"), F.col("t"), F.col("o"), F.col("x")).collect()}
    assert sorted(p - t0 for s, p in got if s == "a") == list(range(10))
    assert [p - t0 for (s, p), r in sorted(got.items(), key=str) if s == "a" and not r["observed"]] == [3, 6, 7, 8]
    assert got[("a", t0 + 1)]["value"] == 777.0 and got[("b", t0 + 1)]["filled"] is None and got[(None, t0)]["filled"] == 3.0
    assert regular_grid(df.where("false"), F.col("s"), F.col("t"), F.col("o"), F.col("x")).count() == 0


def test_grid_predicts_trend_and_season(spark):
    t0 = 8092
    f = lambda i: 100 + 3 * i + 10 * np.cos(i * np.pi / 2)
    df = spark.createDataFrame([("a", t0 + i, "1", float(f(i))) for i in range(24) if i not in (9, 10, 15)], "s string, t int, o string, x double")
    got = {r["period"] - t0: r["filled"] for r in regular_grid(df, F.col("s"), F.col("t"), F.col("o"), F.col("x")).collect()}
    for i in (9, 10, 15):
        assert got[i] == pytest.approx(f(i), abs=1.0)


def test_grid_of_another_season_anywhere(spark):
    f = lambda i: 50 + 0.5 * i + 8 * np.sin(i * np.pi / 6) + 3 * np.cos(i * np.pi / 3)
    gaps = (11, 20, 21, 33)
    for t0 in (0, 24_000):  # the fit does not depend on where periods begin to count
        df = spark.createDataFrame([("a", t0 + i, "1", float(f(i))) for i in range(48) if i not in gaps], "s string, t int, o string, x double")
        got = {r["period"] - t0: r["filled"] for r in regular_grid(df, F.col("s"), F.col("t"), F.col("o"), F.col("x"), season=12).collect()}
        for i in gaps:
            assert got[i] == pytest.approx(f(i), abs=0.5)


# -- units


def test_no_number_is_lost(spark):
    rows = [("a", f"{g} g", "", None) for g in [250, 500, 1000] * 20] + [("s", "250", "", "src"), ("s", "500", "", "src"), ("huge", "20000000", "", "src"), ("tiny", "0.00005", "", "src"), ("endless", "9" * 400, "", "src")]
    df = spark.createDataFrame(rows, "kept string, sz string, ti string, source string")
    got = {r["kept"]: (r["grams"], r["uncertain"]) for r in common_grams(df, "sz", "ti", "source", ["kept"]).where("kept in ('huge', 'tiny', 'endless', 's')").collect()}
    assert got["huge"][1] and got["tiny"][1] and got["endless"][1] and not got["s"][1]
    assert got["huge"][0] >= 2e7 and 0 < got["tiny"][0] < 1

@pytest.mark.parametrize("text, grams", [("250 g", [250]), ("1½ kg", [1500]), ("0,35 kg", [350]), ("1/2 lb", [226.796185]), ("half pound", [226.796185]), ("one kilo", [1000]), ("2×250g", [500]), ("10 sachets x 10 g", [100]), ("Pack of 2 x 100 gms", [200]), ("250 / 750 g", [250, 750]), ("0.2kg 1kg", [200, 1000]), ("Roast No. 7 / 12 oz / Channi", [340.194277]), ("300 ml / Bottle", []), ("12 fl oz", []), ("Box of 12", []), ("Default Title", []), ("", []), (None, [])])
def test_written_grams(spark, text, grams):
    got = spark.range(1).select(written_grams(F.lit(text).cast("string"))).first()[0]
    assert got == pytest.approx(grams)


def test_bare_numbers(spark):
    got = spark.createDataFrame([("200 2000.0",), ("0,5",), ("12 oz",), (None,), ("",), ("0",)], "t string").select(bare_numbers(F.col("t"))).collect()
    assert [r[0] for r in got] == [[200.0, 2000.0], [0.5], [], [], [], []]


def test_units_by_source(spark):
    sizes = [100, 150, 200, 250, 350, 400, 500, 750, 1000]
    rows = [("a", f"{g} g", "", None) for g in sizes * 5]
    per = {"kilo": 1000.0, "pound": 453.59237, "ounce": 28.349523, "gram": 1.0}
    rows += [(s, f"{g / f:.3f}", "", s) for s, f in per.items() for g in sizes * 4]
    rows += [("n", "250", "", None), ("t", None, "500 g / x", "kilo"), ("z", "", None, None), ("v", "300 ml", "", None)]
    df = spark.createDataFrame(rows, "kept string, sz string, ti string, source string")
    got = common_grams(df, "sz", "ti", "source", ["kept"])
    for s in per:
        found = sorted(r["grams"] for r in got.where(F.col("kept") == s).distinct().collect())
        assert found == pytest.approx(sizes, rel=0.02)
    assert {(r["kept"], r["grams"]) for r in got.where("kept in ('n', 't', 'z', 'v')").collect()} == {("n", 250.0), ("t", 500.0)}
    assert common_grams(df.where("false"), "sz", "ti", "source", ["kept"]).count() == 0


# -- nested

NEST = [
    (1, '{"products":[{"id":1,"title":"A","variants":[{"id":"11","public_title":null,"options":["x","y"]},{"id":12,"title":"t"}]},{"id":"gid://P/2","variants":{"edges":[{"node":{"id":"gid://V/21","public_title":"p"}}]},"bundle":{"product":{"id":3,"variants":{"id":31}}}}]}'),
    (2, 'var meta = {"product":{"id":4,"variants":[{"id":41,"options":"only"}]}};\nfoo();'),
    (3, '{"products":[{"id":5,"variants":[{"id":51}'),
    (4, "<html>busy</html>"), (5, None), (6, ""), (7, '{"id":9,"variants":null}'), (8, '[{"id":6,"variants":[{"id":61},{"id":61}]}]'), (8, '[{"id":6,"variants":[{"id":61},{"id":61}]}]'),
]


def test_nested(spark):
    df = spark.createDataFrame(NEST, "doc long, body string")
    holders, rows = holder_rows(df, F.col("doc"), F.col("body"))
    got = {(r["doc"], r["holder_id"], r["row_id"], r["title"]) for r in rows.collect()}
    assert got == {(1, "1", "11", "x / y"), (1, "1", "12", "t"), (1, "2", "21", "p"), (1, "3", "31", ""), (2, "4", "41", "only"), (8, "6", "61", "")}
    assert rows.where("doc = 8").count() == 2  # both places in the list
    assert {(r["doc"], r["holder_id"]) for r in holders.collect()} == {(1, "1"), (1, "2"), (1, "3"), (2, "4"), (7, "9"), (8, "6")}
    bridge, objects = flatten(df, F.col("doc"), F.col("body"), rows_field="variants")
    assert objects.count() == objects.select("body").distinct().count() == bridge.select("hash").distinct().count()
    assert holder_rows(df.where("false"), F.col("doc"), F.col("body"))[1].count() == 0


def test_decode():
    assert decode_all('x = 1; y = {"a": [1]} ;') == [{"a": [1]}]
    assert decode_all('{"a": NaN}') == [] and decode_all("[" * 100000) == [] and decode_all(None) == []
    assert decode_all('var cfg = {"a":1}; var meta = {"product": {"id": 2}}; z = [3]') == [{"a": 1}, {"product": {"id": 2}}, [3]]
    assert decode_all('var a = {"cut": [1; var b = {"c": 2}') == [{"c": 2}]
    assert decode_after('a = {"x": 1}; var meta = {"y": 2}; more', "var meta = ") == {"y": 2} and decode_after("var meta = {", "var meta = ") is None


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, null, {"b": "x\\u00e9\\n"}], "c": {}, "d": [], "a2": [[], [{}]]}', "[]", "[1]", '[{"k": [[["v"]]]}, "s"]'])
def test_deep_decoder_agrees(text):
    assert _deep(text, 0) == (json.loads(text), len(text))
    for cut in range(1, len(text)):
        with pytest.raises(ValueError):
            _deep(text[:cut], 0)


def test_all_values_at_any_depth(spark):
    deep = '{"d":' * 20_000 + '{"id":7,"variants":[{"id":71,"title":"low"}]}' + "}" * 20_000
    rows = [(1, 'var cfg = {"a":1}; var meta = {"product":{"id":8,"variants":[{"id":81,"title":"x"}]}}; other = [1]'), (2, deep), (3, "[" * 50_000 + "]" * 50_000), (4, '{"o":{"id":9},"p":{"id":10,"variants":[{"id":9}]}}')]
    df = spark.createDataFrame(rows, "doc long, body string")
    got = {(r["doc"], r["holder_id"], r["row_id"], r["title"]) for r in holder_rows(df, F.col("doc"), F.col("body"))[1].collect()}
    assert got == {(1, "8", "81", "x"), (2, "7", "71", "low"), (4, "10", "9", "")}
    assert _walk([json.loads('{"b": [1, {"c": 2}], "a": "x"}')], "v")[-1][5].startswith('{"a":"x","b":[1,{"$":"')


def test_gaps_come_from_the_whole_grid(spark, tmp_path):
    """p5_found lays out and fills each source with the seasonal regression, as p5_grid does."""
    spark.createDataFrame([("r", "20230215", 3), ("r", "2023-08-01T10:00:00", 5), (None, "20240101", 1)], "roaster string, served_ts string, variant_count int").write.parquet(str(tmp_path / "coverage_report.parquet"))
    found = corpus_tables.p5_found(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("r", "2023Q2")]
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
