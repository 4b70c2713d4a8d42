from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import changes as K
from panelwright.operators import costs as C
from panelwright.operators import identity as I
from panelwright.operators import levers as L
from panelwright.operators import pass_through as PT
from panelwright.operators import price_index as X
from panelwright.operators import quality as Q
from panelwright.operators import regression as R
from panelwright.operators import validation as V
from panelwright.sources import readers, sinks
from panelwright.streaming import tracker


def items(spark, rows):
    """rows: (quarter, {product: ppg})"""
    flat = [("s", "core", q, p, 250.0, float(v), 1) for q, ps in rows for p, v in ps.items()]
    return spark.createDataFrame(flat, "roaster string, tier string, quarter string, product_key string, size_grams double, ppg double, n_variants long")


def index(spark, rows):
    return {r["quarter"]: r for r in X.normalise(X.chain(items(spark, rows))).collect()}


def test_chain_ignores_new_products(spark):
    got = index(spark, [("2023Q1", {"a": 100, "b": 200, "c": 300}), ("2024Q2", {"a": 110, "b": 220, "c": 330, "new": 999})])
    assert got["2024Q2"]["index"] == pytest.approx(110)


def test_too_few_matches_start_a_segment(spark):
    got = index(spark, [("2023Q1", {"a": 1, "b": 2, "c": 3}), ("2023Q2", {"a": 1, "b": 2, "d": 3})])
    assert [got[q]["segment"] for q in ("2023Q1", "2023Q2")] == [1, 2]


def test_link_back_over_a_rebuild(spark):
    abc = {"a": 100, "b": 100, "c": 100}
    got = index(spark, [("2023Q1", abc), ("2024Q1", abc), ("2025Q1", {"x": 5, "y": 6, "z": 7}), ("2026Q3", {k: 130 for k in abc})])
    assert got["2026Q3"]["linked_from"] == "2024Q1" and got["2026Q3"]["index"] == pytest.approx(130)
    assert not got["2025Q1"]["anchored"] and got["2026Q3"]["main_segment"]


def test_chain_of_nothing(spark):
    assert X.normalise(X.chain(items(spark, [("2023Q1", {"a": 1})]).where("false"))).count() == 0


def test_step_timing(spark):
    a = {k: 100.0 for k in "abc"}
    rows = [("2024Q1", a), ("2024Q2", {k: 105.0 for k in a}), ("2025Q2", {k: 136.5 for k in a})]
    got = X.step_timing(X.normalise(X.chain(items(spark, rows)))).first()
    assert (got["quarter"], got["span"], got["earliest"], got["latest"]) == ("2025Q2", 4, 1, 4) and got["link_change_pct"] == pytest.approx(30)


def test_costs(spark):
    days = spark.createDataFrame([("2024-01-01", "83"), ("2024-01-02", "85"), ("2024-01-03", ""), ("2024-02-01", "84"), ("2024-03-01", "")], "d string, v string")
    got = {r["month"]: (r["mean"], r["days"]) for r in C.monthly_mean(days, F.col("d").cast("date"), F.col("v")).collect()}
    assert got == {"2024-01": (84.0, 2), "2024-02": (84.0, 1)}
    with pytest.raises(ValueError):
        C.monthly_costs(days, days, 1.0)
    q = spark.createDataFrame([("2024Q3", 3.0), ("2024Q1", 1.0), ("2024Q4", 4.0), ("2024Q2", 2.0)], "quarter string, c double")
    assert [r["c_lag1"] for r in C.add_lags(q, "c").orderBy("quarter").collect()] == [None, 1.0, 2.0, 3.0]


def test_splice(spark):
    old = spark.createDataFrame([(f"2024-0{m}", 200.0) for m in range(1, 7)], "month string, value double")
    new = spark.createDataFrame([("2024-04", 100.0), ("2024-05", 100.0), ("2024-06", 100.0), ("2024-07", 105.0), ("2024-08", 106.0)], "month string, value double")
    got = C.splice(old, new).orderBy("month").collect()
    assert len(got) == 8 and got[-1]["value"] == pytest.approx(212)
    assert C.splice(old, new.where("month > '2024-06'")).where("series = 'new'").count() == 0


def test_pass_through(spark):
    i = items(spark, [("2024Q1", {k: 200 for k in "abc"}), ("2024Q2", {k: 240 for k in "abc"})])
    costs = spark.createDataFrame([("2023Q3", 40.0), ("2023Q4", 40.0), ("2024Q1", 40.0), ("2024Q2", 80.0)], "quarter string, cost double")
    got = {r["lag"]: r for r in PT.pass_through(X.normalise(X.chain(i)), i, costs, pre=("2023Q3", "2023Q4", "2024Q1")).collect()}
    assert got["0"]["rupee_pass_through_pct"] == pytest.approx(100) and got["0"]["percent_pass_through_pct"] == pytest.approx(20)
    assert got["avg"]["cost_change_rs"] == pytest.approx(10)


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.c_[np.ones(80), rng.normal(size=(80, 2))]
    y = x @ [1, 2, -1] + rng.normal(size=80) * (1 + abs(x[:, 1]))
    g = np.repeat(np.arange(16), 5)
    df = spark.createDataFrame([(float(b), [float(v) for v in a], int(c)) for a, b, c in zip(x, y, g)], "y double, x array<double>, cluster long").repartition(3)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    hc1 = 80 / 77 * inv @ (x.T * e**2) @ x @ inv
    s = np.stack([x[g == k].T @ e[g == k] for k in range(16)])
    cr1 = 16 / 15 * 79 / 77 * inv @ (s.T @ s) @ inv
    for cluster, cov in ((False, hc1), (True, cr1)):
        got = {r["term"]: r for r in R.ols(df, ["c", "a", "b"], cluster=cluster).collect()}
        for k, t in enumerate(("c", "a", "b")):
            assert got[t]["coef"] == pytest.approx(beta[k]) and got[t]["se"] == pytest.approx(np.sqrt(cov[k, k]))
    assert R.ols(df.where("false"), ["c", "a", "b"]).count() == 0


def test_within_equals_dummies(spark):
    rng = np.random.default_rng(2)
    g = np.repeat(np.arange(6), [30, 10, 10, 5, 5, 20])
    x = rng.normal(size=(80, 2)) + g[:, None]
    y = x @ [2.0, -1.0] + 3 * g + rng.normal(size=80)
    df = spark.createDataFrame([(float(b), [float(v) for v in a], int(c), int(c) % 5 + 10 * (i % 7)) for i, (a, b, c) in enumerate(zip(x, y, g))], "y double, x array<double>, g long, cluster long")
    dummies = df.withColumn("x", F.concat("x", F.array(*[(F.col("g") == k).cast("double") for k in range(6)])))
    for cluster in (False, True):
        full = {r["term"]: r for r in R.ols(dummies, ["a", "b", *"123456"], cluster=cluster).collect()}
        less, n = R.within(df, "g", 2)
        for r in R.ols(less, ["a", "b"], cluster=cluster, absorbed=n).collect():
            assert r["coef"] == pytest.approx(full[r["term"]]["coef"]) and r["se"] == pytest.approx(full[r["term"]]["se"])


def panel(spark, rows):
    return spark.createDataFrame([("s", v, q, p, "archive", False) for v, q, p in rows], "roaster string, variant_id string, quarter string, price_inr double, source_type string, served_outside_quarter boolean")


@pytest.mark.parametrize("prices, status", [((500, 400, 500), "candidate"), ((500, 400, 400), "False"), ((500, 460, 500), "False"), ((500, 400, 480), "candidate"), ((500, None, 500), "not_checkable")])
def test_sale(spark, prices, status):
    got = Q.mark_sales(panel(spark, [("v", q, p and float(p)) for q, p in zip(("2024Q1", "2024Q3", "2025Q1"), prices)]))
    assert got.where("quarter = '2024Q3'").first()["sale_status"] == status
    assert {r["sale_status"] for r in got.where("quarter <> '2024Q3'").collect()} == {"not_checkable"}


def test_id_carryover(spark):
    rows = [(v, q, 1.0) for q, vs in (("2024Q1", "12"), ("2024Q2", "13"), ("2025Q1", "78")) for v in vs]
    got = [r["carried"] for r in Q.id_carryover(panel(spark, rows)).orderBy("quarter").collect()]
    assert got == [None, 0.5, 0.0]
    assert not Q.id_breaks(Q.id_carryover(panel(spark, rows))).first()["ids_stable"]


def test_outliers_and_live(spark):
    p = panel(spark, [(str(i), "2024Q1", v) for i, v in enumerate([500.0, 525.0, 530.0, 1500.0])] + [("x", "2024Q1", None)])
    assert [r["outlier"] for r in Q.price_outliers(p, ["roaster"], "price_inr").orderBy("variant_id").collect()] == [False, False, False, True, False]
    live = panel(spark, [("0", "2024Q2", 550.0), ("1", "2024Q2", 525.0), ("9", "2024Q2", 1.0)])
    got = Q.compare_live(p, live).first()
    assert (got["matched"], got["median_pct_diff"], got["share_higher"], got["share_lower"]) == (2, 5.0, 0.5, 0.0)


def test_changes(spark):
    i = items(spark, [("2024Q1", {"a": 100, "b": 100, "gone": 4}), ("2024Q3", {"a": 110, "b": 100.1, "new": 5})])
    got = {(r["change"], r["product_key"]) for r in K.period_changes(i, "quarter").collect()}
    assert got == {("price_up", "a"), ("dropped", "gone"), ("added", "new")}
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    new = spark.createDataFrame([(2, 2.5), (3, 3.0)], "k long, v double")
    assert {tuple(r) for r in K.upsert(old, new, ["k"]).collect()} == {(1, 1.0), (2, 2.5), (3, 3.0)}
    assert {(r["k"], r["field"]) for r in K.table_diff(old, new, ["k"], ["v"]).collect()} == {(1, "row"), (2, "v"), (3, "row")}
    assert K.table_diff(old, old.withColumn("v", F.col("v") * (1 + 1e-12)), ["k"], ["v"]).count() == 0


def test_identity(spark):
    t = spark.createDataFrame([("s", "1", "2024Q1", "Malabar washed"), ("s", "1", "2024Q2", "Malabar natural"), ("s", "1", "2024Q3", "malabar Natural!")], "roaster string, product_id string, quarter string, product_title string")
    assert [(r["segment"], r["product_key"]) for r in I.title_segments(t).orderBy("quarter").collect()] == [(1, "1"), (2, "1@2024Q2"), (2, "1@2024Q2")]
    side = lambda rows: spark.createDataFrame([("s", "2024Q2", i, x) for i, x in rows], "roaster string, break_quarter string, product_id string, product_title string")
    got = I.candidate_pairs(side([("1", "Old Malabar"), ("2", "Attikan Estate Dark")]), side([("3", "old malabar!"), ("4", "Attikan Estate Dark Roast"), ("5", "Yemen")]))
    assert {(r["before_id"], r["after_id"], r["method"]) for r in got.collect()} == {("1", "3", "exact_title"), ("2", "4", "similar")}
    pairs = spark.createDataFrame([("s", "1", "2", "linked"), ("s", "1", "3", "linked"), ("s", "4", "5", "linked")], "roaster string, before_id string, after_id string, status string")
    assert [r["status"] for r in I.resolve_conflicts(pairs).orderBy("before_id", "after_id").collect()] == ["conflict", "conflict", "linked"]
    products = spark.createDataFrame([("Blue Hill", str(i), f"2024Q{i}") for i in (1, 2, 3, 4)] + [("Blue Hill", "9", "2023Q1")], "roaster string, product_id string, first_quarter string")
    links = spark.createDataFrame([("Blue Hill", "1", "2"), ("Blue Hill", "2", "3"), ("Blue Hill", "3", "9")], "roaster string, before_id string, after_id string")
    assert {r["product_id"]: r["product_key"] for r in I.product_keys(products, links).collect()} == {"1": "blue-hill:9", "2": "blue-hill:9", "3": "blue-hill:9", "9": "blue-hill:9", "4": "blue-hill:4"}


def test_candidates_are_those_of_all_pairs(spark, monkeypatch):
    rng, words = np.random.default_rng(5), ["attikan", "atikan", "estate", "coffee", "pb", "peaberry", "lot 12", "lot 21", "washed", "natural", "dark roast", "best seller", "award winning", "monsooned malabar", "250 g"]
    rows = {(r, s): [(f"{s}{i}", " ".join(rng.choice(words, rng.integers(1, 12))).title()) for i in range(n)] for r, n in (("many", 60), ("few", 8)) for s in "ba"}
    rows["words", "b"], rows["words", "a"] = [("b0", "Coffee Beans"), ("b1", "Arabica Peaberry")], [("a0", "Roasted Coffee Bean"), ("a1", "Arabicas PB"), ("a2", "!")]
    side = lambda s: spark.createDataFrame([(r, "2024Q2", i, t) for (r, k), v in rows.items() if k == s for i, t in v], "roaster string, break_quarter string, product_id string, product_title string")
    norm = lambda t: re.sub(r"[^a-z0-9]+", " ", t.lower()).strip()
    monkeypatch.setattr(I, "BLOCK_BEFORE", 7)
    monkeypatch.setattr(I, "BLOCK_AFTER", 30)
    got = I.candidate_pairs(side("b"), side("a")).collect()
    want = set()
    for r in ("many", "few", "words"):
        used = {x for p in got if p["roaster"] == r and p["method"] == "exact_title" for x in (p["before_id"], p["after_id"])}
        for b, t in rows[r, "b"]:
            scored = [(SequenceMatcher(None, norm(t), norm(u)).ratio(), a) for a, u in rows[r, "a"] if a not in used] if b not in used else []
            want |= {(r, b, a, round(q, 3)) for q, a in sorted((x for x in scored if x[0] >= 0.5), reverse=True)[:3]}
    assert {(p["roaster"], p["before_id"], p["after_id"], p["similarity"]) for p in got if p["method"] == "similar"} == want
    assert {r for r, *_ in want} == {"many", "few", "words"}


def test_levers_with_pack_sizes(spark):
    flat = [("s", q, p, v) for q, ps in (("2023Q1", {"a": 100.0, "b": 100.0, "gone": 400.0}), ("2023Q2", {"a": 1.0}), ("2024Q4", {"a": 110.0, "b": 110.0, "new": 300.0, "new2": 500.0})) for p, v in ps.items()]
    i = spark.createDataFrame([*flat, ("t", "2023Q1", "x", 5.0), ("u", "2024Q4", "x", 5.0), ("u", "2023Q1", "x", 5.0)], "roaster string, quarter string, product_key string, ppg double")
    idx = spark.createDataFrame([("s", "2023Q1", 100.0, True), ("s", "2023Q2", 100.0, True), ("s", "2024Q4", 110.0, True), ("u", "2023Q1", 100.0, True), ("u", "2024Q4", 100.0, True)], "roaster string, quarter string, index double, main_segment boolean")
    cov = spark.createDataFrame([("s", "2023Q1", "archive", "complete"), ("s", "2023Q2", "archive", "partial"), ("u", "2023Q1", "live", "complete")], "roaster string, quarter string, source_type string, completeness string")
    change = lambda p, v, to, after: ("s", "variant", "high", False, p, v, "2024Q1", to, "250", after)
    ch = spark.createDataFrame([change("a", "1", "2024Q4", "200"), change("b", "2", "2024Q4", "200"), change("a", "3", "2024Q4", "500"), change("a", "1", "2025Q4", "200")], "roaster string, level string, confidence string, crosses_product_split boolean, product_id string, variant_id string, from_quarter string, to_quarter string, sizes_before string, sizes_after string")
    v = spark.createDataFrame([("s", n, q, p) for n in "123" for q, p in (("2024Q1", 100.0), ("2024Q4", 120.0), ("2025Q4", 300.0))], "roaster string, variant_id string, quarter string, ppg double")
    cuts = L.size_cuts(ch, spark.createDataFrame([("a",)], "product_id string"), v, shock="2024Q2")
    got = {r["roaster"]: r.asDict() for r in L.full_split(i, idx, cov, cuts, ("2023Q1", "2023Q2")).collect()}
    s = got["s"]
    total = (np.exp(np.log([110, 110, 300, 500]).mean() - np.log([100, 100, 400]).mean()) - 1) * 100
    assert [round(s[c], 6) for c in ("total_pct", "like_for_like_pct", "pack_size_pp", "range_mix_pp")] == [round(total, 6), 10.0, 5.0, round(total - 15, 6)]
    assert [s[c] for c in ("size_cut_products", "products_continuing", "products_added", "products_dropped", "median_ppg_added", "median_ppg_dropped", "note")] == [1, 2, 2, 1, 400.0, 400.0, ""]
    assert (got["t"]["note"], got["u"]["note"]) == ("no price index (too few matched products)", "no complete pre-shock page in the index segment")
    assert got["u"]["end"] is None and got["u"]["pack_size_pp"] is None


def test_validation(spark):
    df = spark.createDataFrame([("washed", "a “washed” lot", "A \"Washed\" lot"), ("washed", "", "x"), ("washed", "natural", "washed"), ("unknown", None, None), ("purple", "purple", "purple")], "v string, e string, s string")
    got = [r[0] for r in df.select(V.evidence_errors(F.col("v"), F.col("e"), F.col("s"), ["washed", "unknown"])).collect()]
    assert got == [None, "no evidence", "evidence not in source", None, "value not allowed"]
    kept, dead = V.split_batch(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (9, "d")], "ref long, v string"), spark.createDataFrame([(1,), (2,), (3,)], "ref long"), "ref")
    assert [r["ref"] for r in kept.collect()] == [1] and {tuple(r) for r in dead.collect()} == {(2, "duplicate"), (9, "unexpected"), (3, "missing")}
    gold = spark.createDataFrame([(1, "Gandha", "yes"), (2, "unknown", "no"), (3, "Coorg", "no")], "k long, region string, decaf string")
    pred = spark.createDataFrame([(1, "Gandha, Andhra Pradesh", "YES"), (2, "Coorg", "no"), (3, "coorgshire", "yes")], "k long, region string, decaf string")
    s = {r["field"]: r for r in V.field_scores(gold, pred, ["k"], {"region": "place", "decaf": "closed"}).collect()}
    assert (s["region"]["found"], s["region"]["invented"], s["decaf"]["accuracy"]) == (0.5, 1.0, 0.667)
    q = {r["group"]: r["quota"] for r in V.allocate(spark.createDataFrame([("a", 3), ("b", 50), ("c", 27)], "group string, n long"), 20, 5).collect()}
    assert sum(q.values()) == 20 and q["a"] == 3 and q["b"] > q["c"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿# note\na,b\n1,\n02,x\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_text_csv(spark, str(tmp_path / "x.csv"), "#").collect()] == [("1", None), ("02", "x")]
    assert readers.latest_file(spark, str(tmp_path / "*.csv")).endswith("x.csv")
    with pytest.raises(FileNotFoundError):
        readers.latest_file(spark, str(tmp_path / "*.xls"))
    idx = spark.createDataFrame([(1, '[["timestamp","original"],["20240101000000","a"],["20240201000000","b"],["20240101000000","c"]]'), (2, "")], "k long, body string")
    assert {(r["ts"], r["url"], r["first_position"]) for r in readers.capture_index(idx, "body", ["k"]).collect()} == {("20240101000000", "c", 1), ("20240201000000", "b", 2)}
    one = spark.range(3)
    sinks.write_all(spark, {"a": one, "b": one}, str(tmp_path / "out"))
    boom = one.select(F.raise_error(F.lit("boom")).alias("id"))
    with pytest.raises(Exception):
        sinks.write_all(spark, {"a": spark.range(9), "b": boom}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/a")).count() == 3
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.write_all(spark, {"a": one.withColumn("description", F.lit("x"))}, str(tmp_path / "out"))
    public, private = sinks.split_private(one.withColumn("card_text", F.lit("x")), ["id"])
    assert public.columns == ["id"] and private.columns == ["id", "card_text"]


def test_tracker(spark):
    kept = spark.createDataFrame([("a", "2026-01", 1), ("a", "2026-01", 2)], "roaster string, month string, product_id long")
    landed = kept.unionByName(spark.createDataFrame([("a", "2026-02", 1)], kept.schema))
    assert tracker.new_periods(landed, kept, ["roaster", "month"]).count() == 1
    assert not tracker.snapshot_status(landed, "month").where("month = '2026-02'").first()["big_drop"]
    tracker.check_append(kept, landed, ["roaster", "month", "product_id"])
    with pytest.raises(ValueError):
        tracker.check_append(landed, kept, ["roaster", "month", "product_id"])
