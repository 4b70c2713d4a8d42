from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import changes as K
from panelwright.operators import collection as C
from panelwright.operators import costs
from panelwright.operators import extraction as E
from panelwright.operators import identity as I
from panelwright.operators import regression as R
from panelwright.operators import review as V
from panelwright.sources import fetching, sinks, workbooks
from panelwright.streaming import tracker as T

# -- sizes


def test_a_menu_that_grows_is_a_change(spark):
    rows = [("s", "p", "a", "2024Q1", 250.0, "variant_title"), ("s", "p", "a", "2024Q2", 250.0, "variant_title"), ("s", "p", "b", "2024Q2", 1000.0, "listing_text"), ("s", "p", "a", "2024Q3", 250.0, "variant_title"), ("s", "p", "b", "2024Q3", 1000.0, None), ("s", "q", "c", "2024Q1", 226.796185, "product_title"), ("s", "q", "c", "2024Q2", 200.0, "product_title")]
    df = spark.createDataFrame([(*r, "T", "v") for r in rows], "roaster string, product_id string, variant_id string, quarter string, size_grams double, size_source string, product_title string, variant_title string")
    got = {(r["product_id"], r["from_quarter"], r["sizes_before"], r["sizes_after"], r["confidence"]) for r in K.product_size_changes(df).collect()}
    assert got == {("p", "2024Q1", "250", "250 1000", "low"), ("q", "2024Q1", "226.796", "200", "high")}
    one = {(r["variant_id"], r["size_before"], r["size_after"], r["confidence"]) for r in K.variant_size_changes(df).collect()}
    assert one == {("c", 226.796185, 200.0, "high")}
    keys = spark.createDataFrame([("s", "q", "2024Q1", "archive", "k"), ("s", "q", "2024Q1", "live", "z"), ("s", "p", "2024Q1", "archive", "k"), ("s", "p", "2024Q2", "live", "k")], "roaster string, product_id string, quarter string, source_type string, product_key string")
    assert {r["product_id"]: r["crosses_product_split"] for r in K.mark_splits(K.product_size_changes(df), keys).collect()} == {"q": True, "p": False}


# -- titles and keys


def test_keys_over_time(spark):
    rows = [("s", "1", t, q, "archive", f"{q[:4]}0{q[5]}15000000") for q, t in (("2024Q1", "Malabar washed"), ("2024Q2", "Malabar natural"), ("2024Q3", "malabar Natural!"))] + [("s", "2", "Same", "2024Q1", "archive", None), ("s", "2", "Same", "2024Q1", "live", None)]
    df = spark.createDataFrame([(*r, "v") for r in rows], "roaster string, product_id string, product_title string, quarter string, source_type string, served_ts string, variant_id string")
    h = {r["product_id"]: r for r in I.title_history(df).collect()}
    assert h["1"]["title_changed"] and h["1"]["process_or_lot_changed"] and h["1"]["title_similarity"] == 0.333 and h["2"]["title_similarity"] is None and not h["2"]["title_changed"]
    keys = df.select("roaster", "product_id", F.concat(F.lit("s:"), "product_id").alias("product_key")).distinct()
    got = {(r["product_id"], r["quarter"], r["source_type"]): r for r in I.keyed_quarters(df, keys, I.title_history(df)).collect()}
    assert [got[("1", q, "archive")]["product_key"] for q in ("2024Q1", "2024Q2", "2024Q3")] == ["s:1", "s:1@2024Q2", "s:1@2024Q2"]
    assert [got[("1", q, "archive")]["attributes_valid"] for q in ("2024Q1", "2024Q2", "2024Q3")] == [False, True, True]
    assert got[("1", "2024Q3", "archive")]["segment_start_date"] == "2024-02-15" and got[("2", "2024Q1", "live")]["attributes_valid"]


# -- hedonic


def test_hedonic_periods_and_shift_match_numpy(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        q, a, r, p = ["2023Q1", "2023Q2", "2024Q3", "2024Q4"][i % 4], ["washed", "natural"][rng.integers(2)], f"r{rng.integers(3)}", f"p{rng.integers(40)}"
        size = float(rng.choice([100, 250, 500]))
        y = 1 + 0.3 * (a == "natural") + 0.2 * (a == "natural") * (q >= "2024Q2") - 0.2 * np.log(size) + 0.1 * int(r[1]) + rng.normal(0, 0.05)
        rows.append((r, q, p, size, float(np.exp(y)), a, "shock" if q >= "2024Q2" else "pre"))
    df = spark.createDataFrame(rows, "roaster string, quarter string, product_key string, size_grams double, ppg double, process string, period string")

    def solve(some, shift=False):
        y = np.log([r[4] for r in some])
        nat = np.array([r[5] == "natural" for r in some], float)
        cols = [np.log([r[3] for r in some]), nat] + [np.array([r[1] == q for r in some], float) for q in sorted({r[1] for r in some})[1:]] + [np.array([r[0] == k for r in some], float) for k in ("r0", "r1", "r2")]
        if shift:
            cols.append(nat * np.array([r[6] == "shock" for r in some], float))
        return np.linalg.lstsq(np.stack(cols, 1), y, rcond=None)[0]

    got = {(r["period"], r["term"]): r for r in R.hedonic_periods(df, {"process": "washed"}).collect()}
    for period in ("pre", "shock"):
        b = solve([r for r in rows if r[6] == period])
        assert got[(period, "ln_size")]["coef"] == pytest.approx(b[0]) and got[(period, "process[natural]")]["coef"] == pytest.approx(b[1])
    shift = R.fit_change(df, {"process": "washed"}).collect()
    assert len(shift) == 1 and shift[0]["shock_shift"] == pytest.approx(solve(rows, True)[-1]) and (shift[0]["attribute"], shift[0]["level"]) == ("process", "natural")
    counts = R.hedonic_counts(df, {"process": "washed"})
    assert R.reported_effects(R.hedonic_periods(df, {"process": "washed"}), counts).count() == 2


# -- collection


def test_pages_to_rows(spark):
    body = json.dumps({"products": [{"id": 1, "type": "Coffee", "variants": [{"id": 11, "price": 43000, "name": "Malabar - Beans / 250g", "public_title": "Beans / 250g", "sku": None}, {"id": 12, "price": "x", "name": "Malabar"}]}, {"id": 2, "type": None, "variants": [{"id": 21, "price": 200000, "name": "Gift box"}]}]})
    v = C.variant_rows(spark.createDataFrame([("k", body), ("bad", "{"), ("none", None)], "page string, j string"), "j", ["page"])
    got = {r["variant_id"]: r for r in v.collect()}
    assert (got["11"]["product_title"], got["11"]["price_inr"], got["11"]["sku"]) == ("Malabar", 430.0, "") and got["12"]["price_inr"] is None and set(got) == {"11", "12", "21"}
    page = v.withColumns({"quarter": F.lit("2024Q1"), "served_ts": F.lit("20240420000000"), "url_switch_window": F.lit("after 2024-Q1 (moved)"), "single_size": F.lit(True), "page_size": F.struct(F.lit(100.0).alias("grams"), F.lit(False).alias("multipack"))})
    done = {r["variant_id"]: r for r in C.rows_from_page(page, ["page"]).collect()}
    assert (done["11"]["size_grams"], done["11"]["size_source"], done["12"]["size_grams"], done["12"]["size_source"]) == (250.0, "variant_title", 100.0, "listing_text")
    assert done["21"]["size_grams"] is None or not done["21"]["is_outlier"]
    assert done["11"]["served_outside_quarter"] and done["11"]["in_switch_window"] and done["21"]["is_bundle"]
    ship = C.finish_rows(v, live_grams=F.lit(300)).where("variant_id = '12'").first()
    assert (ship["size_grams"], ship["size_source"], ship["multipack"]) == (300.0, "live_shipping_grams", False)


def test_links_and_addresses(spark):
    html = '<a href="/collections/all?page=3&amp;x=1"><a href="/collections/all?page=2"><a href="https://h.example/collections/all/?page=4"><a href="/collections/other?page=9">'
    one = spark.createDataFrame([(html, "/collections/all")], "h string, p string")
    assert one.select(C.linked_pages(F.col("h"), F.col("p"))).first()[0] == [2, 4]
    urls = spark.createDataFrame([("https://h.example/products/Blue-1/",), ("https://h.example/products/a/b",), (None,)], "u string")
    assert [r[0] for r in urls.select(C.archived_handle(F.col("u"))).collect()] == ["blue-1", None, None]
    made = one.select(C.cdx_query_url(F.lit("h.example/x y"), True), C.discovery_url(F.lit("h.example")), C.live_page_url(F.lit("https://h.example/collections/c"), 2)).first()
    assert made[0] == "https://web.archive.org/cdx/search/cdx?url=h.example%2Fx+y&from=2023&output=json&fl=timestamp%2Coriginal&filter=statuscode%3A200&matchType=prefix" and "collapse=urlkey" in made[1]
    assert made[2] == "https://h.example/collections/c/products.json?limit=250&page=2"
    bodies = spark.createDataFrame([('{"products":[{"variants":[{"price":null}]}]}',), ('{"products":[]}',), ("<html>",), ('{"products":[{"variants":[{"id":1}]}]}',), (None,)], "b string")
    assert [r[0] for r in bodies.select(C.valid_products_json(F.col("b"))).collect()] == [True, False, False, False, False]
    caps = spark.createDataFrame([("l", "/c", "2", "https://h/c?page=2"), ("l", "/c", "1", "https://h/c?page=2"), ("l", "/c", "1", "https://h/c?page=2&sort=x")], "listing string, path string, ts string, url string")
    assert [(r["page"], [c["ts"] for c in r["captures"]]) for r in C.paged_snapshots(caps, "listing", "path", "ts", "url").collect()] == [(2, ["1", "2"])]
    two = spark.createDataFrame([("r", "1", "old", 0), ("r", "1", "new", 1), ("r", "2", "old", 0)], "roaster string, ts string, url string, url_order int")
    assert {(r["ts"], r["url"]) for r in C.merged_snapshots(two, ["roaster"]).collect()} == {("1", "new"), ("2", "old")}


def test_handles_and_statuses(spark):
    rows = spark.createDataFrame([("r", "1", "archive", "https://h/c", "Blue Hill", "2024Q1", "v", None, None, None, False, "20240210000000"), ("r", "2", "archive", "https://h/c", "Red Hill", "2024Q1", "v", None, "product_page_text", None, False, "20240210000000"), ("r", "3", "archive", "https://h/c", "Old", "2024Q1", "v", 250.0, "variant_title", None, False, "20240210000000")], "roaster string, product_id string, source_type string, source_url string, product_title string, quarter string, variant_id string, size_grams double, size_source string, is_coffee_guess boolean, served_outside_quarter boolean, served_ts string")
    links = C.host_handles(spark.createDataFrame([("https://h/c", '<a href="/products/Blue-Hill">')], "u string, html string"), "u", "html")
    live = spark.createDataFrame([("r", "3", "old-live")], "roaster string, product_id string, handle string")
    known = C.map_handles(rows, live, links)
    assert {r["product_id"]: (r["handle"], r["handle_source"]) for r in known.collect()} == {"1": ("blue-hill", "title_slug"), "2": ("", "unmapped"), "3": ("old-live", "live")}
    work = C.targets(rows)
    assert {r["product_id"] for r in work.collect()} == {"1", "2"}
    done = C.resolve_handles(work, known, spark.createDataFrame([("h", "red-hill-1")], "host string, handle string"))
    assert {r["product_id"]: (r["handle"], r["handle_source"]) for r in done.collect()} == {"1": ("blue-hill", "title_slug"), "2": ("red-hill-1", "cdx_prefix")}
    caps = spark.createDataFrame([("h", "blue-hill", "20240101000000"), ("h", "blue-hill", "20240215000000"), ("h", "red-hill-1", "20240615000000")], "host string, handle string, ts string")
    sizes = spark.createDataFrame([("h", "blue-hill", "20240215000000")], "host string, handle string, ts string")
    assert {r["product_id"]: (r["status"], r["product_snapshot_ts"]) for r in C.page_statuses(done, caps, sizes).collect()} == {"1": ("ok", "20240215000000"), "2": ("no_snapshot_in_quarter", None)}
    final = spark.createDataFrame([("r", "https://a | https://b")], "roaster string, archive_listing_urls string")
    got = C.live_roasters(final, spark.createDataFrame([("r", "u1 | u2 | ")], "roaster string, archive_urls_counted string")).first()
    assert got["archive_urls"] == ["u1", "u2"] and got["live_url"] == "https://b"


# -- review


def test_rules_are_idempotent(spark):
    base = {f: "unknown" for f in V.ALLOWED}
    rows = [base | {"ref": "a", "status": "ok", "decaf": "no", "decaf_evidence": "100% Arabica", "title": "House Blend"}, base | {"ref": "b", "status": "ok", "decaf": "no", "decaf_evidence": "not decaf", "estate": "Attikan", "title": "x"}, base | {"ref": "c", "status": "invalid_or_missing", "process": "washed", "title": "x"}]
    flat = [{**{f"{f}_{e}": "" for f in V.ALLOWED for e in ("confidence", "evidence")}, **r, "product_title": r["title"], "text": "", "title_changed": "False", "roaster": "s", "product_id": r["ref"]} for r in rows]
    df = spark.createDataFrame(flat)
    once = V.postprocess(df)
    got = {r["ref"]: r for r in once.collect()}
    assert (got["a"]["decaf"], got["b"]["decaf"], got["c"]["process"]) == ("unknown", "no", "unknown")
    assert [got[k]["origin_type_analysis"] for k in "abc"] == ["blend", "single_origin", "unknown"] and "all unknown" in got["c"]["rules_applied"]
    assert {tuple(r) for r in V.postprocess(once).select(sorted(once.columns)).collect()} == {tuple(r) for r in once.select(sorted(once.columns)).collect()}
    raw = {r["ref"]: r["decaf"] for r in V.raw_output(once).collect()}
    assert raw == {"a": "no", "b": "no", "c": ""}
    assert [r["product_id"] for r in V.review_rows(once).collect()] == ["c"]
    fresh = spark.createDataFrame([("s", "a", "yes", "decaf beans")], "roaster string, product_id string, decaf string, decaf_evidence string")
    new = {r["ref"]: (r["decaf_model"], r["reextracted"]) for r in V.replace_answers(once, fresh, ["roaster", "product_id"]).collect()}
    assert new["a"] == ("yes", "True") and new["b"] == ("no", "")


def test_texts_and_labels(spark):
    p = spark.createDataFrame([("Blue", "Red", "nan", "250g", "True"), ("Blue", "Red", "Coffee", None, "False")], "product_title string, other_titles string, product_type string, variant_titles string, title_changed string").withColumns({"card_text": F.lit(""), "description": F.lit("y" * 500)})
    assert [r[0].split("\n")[:-1] for r in p.select(V.product_text()).collect()] == [["Title: Blue", "Variants: 250g"], ["Title: Blue", "Earlier titles: Red", "Product type: Coffee"]]
    assert p.select(F.length(V.describe())).first()[0] == len("title: Blue; earlier titles: Red; variants: 250g; description: ") + 400
    made = V.prompts(spark.createDataFrame([(f"r{i}", "t") for i in range(5)], "ref string, t string"), "HEAD", F.concat(F.lit("PRODUCT "), "ref"), "ref", 2).orderBy("batch").collect()
    assert [r["refs"] for r in made] == [["r0", "r1"], ["r2", "r3"], ["r4"]] and made[0]["prompt"] == "HEAD\n\nPRODUCT r0\n\nPRODUCT r1"
    lab = spark.createDataFrame([("1", "Coorg ", "unknown"), ("2", "Coorg", "Kenya"), ("3", "Huila", "unknown"), ("4", "coorg", "India")], "label_id string, region string, origin_country string")
    assert {r["label_id"]: (r["origin_country"], r["rule"]) for r in V.india_rule(lab).collect()} == {"1": ("India", "set"), "2": ("Kenya", "conflict"), "3": ("unknown", None), "4": ("India", None)}
    orig = spark.createDataFrame([("1", "p1", "s", "", ""), ("2", "p2", "s", "", "")], "label_id string, product_id string, roaster string, decaf string, region string")
    bad = spark.createDataFrame([("1", "p9", "s", "maybe", "Coorg"), ("7", "p2", "s", "yes", ""), ("2", "p2", "s", "YES", " ")], "label_id string, product_id string, roaster string, decaf string, region string")
    got = {(r["label_id"], r["problem"]) for r in V.label_problems(bad, orig, {"decaf": ["yes", "no"], "region": None}).collect()}
    assert got == {("1", "product_id is p9, expected p1"), ("1", "decaf = maybe is not allowed"), ("7", "not in the original sample"), ("2", "region is blank"), (None, "3 rows, expected 2")}
    assert "missing columns" in V.label_problems(bad.drop("decaf"), orig).first()["problem"]


def test_calls_are_of_all_tasks_together(spark):
    rows = spark.createDataFrame([(f"r{i:03}", "p") for i in range(100)], "ref string, p string").repartition(8)
    got = {r["ref"]: r["status"] for r in E.answers(rows, "ref", "p", lambda batch: {r: "x" for r, _ in batch}, calls=3, batch=5).collect()}
    assert sorted(k for k, s in got.items() if s == "ok") == [f"r{i:03}" for i in range(15)] and len(got) == 100

    def wrong(batch):
        raise KeyError("a programming error")

    def down(batch):
        raise E.Failed("no quota")

    with pytest.raises(Exception):
        E.answers(rows, "ref", "p", wrong).collect()
    assert {r["status"] for r in E.answers(rows, "ref", "p", down, calls=9).collect()} == {"pending"}
    waits = []
    with pytest.raises(E.Retryable):
        E.with_backoff(lambda: (_ for _ in ()).throw(E.Retryable()), sleep=waits.append)
    assert [int(w) for w in waits] == [2, 4, 8, 16, 32]


# -- tracker and matching

M = "roaster string, tier string, month string, product_id string"


def test_snapshot_states(spark):
    monthly = spark.createDataFrame([("have", "c", "2026-10", "1"), *[("new", "c", "2026-09", str(i)) for i in range(5)], ("gone", "c", "2026-09", "1")], M)
    final = spark.createDataFrame([(r, "c") for r in ("have", "new", "off", "bot", "gone", "fail")], "roaster string, tier string")
    roasters = T.enabled_roasters(final, spark.createDataFrame([("off", "False"), ("new", "True")], "roaster string, tracker_enabled string"))
    robots = spark.createDataFrame([(r, r != "bot", "found") for r in ("have", "new", "off", "bot", "gone", "fail")], "roaster string, allowed boolean, robots string")
    landed = spark.createDataFrame([("new", "c", "2026-10", "1"), ("new", "c", "2026-10", "2"), ("have", "c", "2026-10", "9"), ("off", "c", "2026-10", "1")], M)
    after, status = T.take_snapshot("2026-10", monthly, roasters, robots, landed, spark.createDataFrame([("fail", "timeout")], "roaster string, error string"))
    got = {r["roaster"]: r for r in status.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"have": "already_fetched", "new": "fetched", "off": "skipped_disabled", "bot": "skipped_robots", "gone": "error", "fail": "error"}
    assert got["new"]["big_drop"] and got["new"]["prev_products"] == 5 and got["fail"]["error"] == "timeout" and after.count() == monthly.count() + 2
    merged = {(r["month"], r["roaster"]): r["status"] for r in T.merge_status(status.withColumn("status", F.lit("error")), status).collect()}
    assert merged[("2026-10", "have")] == "error" and merged[("2026-10", "new")] == "fetched"
    T.check_run(monthly, after, status, final)
    for bad in (dict(before=after, after=monthly), dict(status=status.where("roaster <> 'off'")), dict(most_failed=2), dict(answers=landed.unionByName(landed))):
        with pytest.raises(ValueError):
            T.check_run(**({"before": monthly, "after": after, "status": status, "roasters": final} | bad))
    line = T.last_run_line("2026-10-05", "2026-10", status, 2, 1)
    assert "fetched: 1;" in line and "failed: 2." in line
    assert T.with_last_run(f"a{T.MARKS[0]}old{T.MARKS[1]}b", "new") == f"a{T.MARKS[0]}\nnew\n{T.MARKS[1]}b"
    with pytest.raises(ValueError):
        T.with_last_run("nothing", "x")


def test_tracker_tables(spark):
    rows = [("s", "c", m, "1", v, t, size, p, g, False) for m, t, size in (("2026-01", "Malabar washed", 250.0), ("2026-02", "Malabar natural", 250.0), ("2026-03", "Malabar natural", 200.0)) for v, p, g in (("v1", 500.0, True), ("v2", 400.0, None))]
    df = spark.createDataFrame(rows + [("s", "c", "2026-03", "2", "w", "Tea", 100.0, 10.0, True, False), ("s", "c", "2026-03", "3", "x", "New", 100.0, 10.0, True, False)], M + ", variant_id string, product_title string, size_grams double, price_inr double, is_coffee_guess boolean, is_bundle boolean")
    answers = T.known_coffee(spark.createDataFrame([("s", "1", "yes"), ("s", "2", "yes")], "roaster string, product_id string, is_coffee string"), spark.createDataFrame([("s", "2", "ok", "no"), ("s", "3", "pending", None)], "roaster string, product_id string, status string, is_coffee string"))
    got = T.add_product_keys(T.coffee_rows(df, answers))
    assert {(r["product_id"], r["month"]): r["product_key"] for r in got.collect()} == {("1", "2026-01"): "1", ("1", "2026-02"): "1#2", ("1", "2026-03"): "1#2", ("3", "2026-03"): "3"}
    packs = T.pack_size_changes(got)
    assert {(r["variant_id"], r["grams_before"], r["grams_after"], r["ppg_change_pct"]) for r in packs.collect()} == {("v1", 250.0, 200.0, 25.0), ("v2", 250.0, 200.0, 25.0)}
    assert T.monthly_items(got).where("month = '2026-03'").count() == 2
    status = spark.createDataFrame([("s", "c", "fetched", False), ("t", "c", "error", False)], "roaster string, tier string, status string, big_drop boolean")
    index = spark.createDataFrame([("s", "2026-03", 1.5, 101.55)], "roaster string, month string, link_change_pct double, index double")
    changes = spark.createDataFrame([("s", "2026-03", "added"), ("s", "2026-02", "added")], "roaster string, to_month string, change string")
    s = {r["roaster"]: r for r in T.tracker_summary(status, index, changes, packs, got, "2026-03").collect()}
    assert (s["s"]["coffee_products"], s["s"]["attributes_pending"], s["s"]["pack_size_change"], s["s"]["added"], s["t"]["coffee_products"], s["t"]["index"]) == (2, 1, 2, 1, 0, None)
    inputs = T.new_inputs(df.withColumns({"product_type": F.lit("Coffee"), "variant_title": F.col("variant_id")}), answers.where("product_id <> '3'"), "2026-03")
    assert [(r["product_id"], r["variant_titles"], r["is_coffee_guess_p2"]) for r in inputs.collect()] == [("3", "x", True)]
    done = spark.createDataFrame([("s", "3", "pending", "2026-02"), ("s", "9", "ok", "2026-01")], "roaster string, product_id string, status string, attempted_month string")
    assert T.to_do(inputs, done).count() == 1
    new = T.update_answers(done, spark.createDataFrame([("s", "3", "ok")], "roaster string, product_id string, status string"), "2026-03")
    assert {tuple(r) for r in new.collect()} == {("s", "3", "ok", "2026-03"), ("s", "9", "ok", "2026-01")}
    T.check_history({"a": done}, {"a": done}, {"a": ["roaster", "product_id"]})
    with pytest.raises(ValueError):
        T.check_history({"a": done}, {"a": new}, {"a": ["roaster", "product_id"]})


def test_no_batch_of_a_stream_is_lost(spark, tmp_path):
    kind = "roaster string, month string, product_id long"
    for i in range(2):  # one seller and month in two files, taken in two micro-batches
        spark.createDataFrame([("a", "2026-01", i)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = f"file://{tmp_path}/table"
    for run in ("x", "x", "y"):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        T.run_tracker(spark, stream, table, ["roaster", "month"], f"{tmp_path}/check-{run}").awaitTermination()
    assert sorted(r["product_id"] for r in spark.read.parquet(table).collect()) == [0, 1]


def test_matching(spark):
    P = "roaster string, product_id string, product_title string, quarter string, source_type string, served_outside_quarter boolean"
    rows = [("s", str(i), f"Attikan {i} Estate", "2024Q1", "archive", False) for i in range(12)] + [("s", f"n{i}", f"Atikan {i} Estate", "2026Q3", "live", False) for i in range(12)] + [("t", "1", "x", "2024Q1", "archive", False), ("t", "1", "x", "2026Q3", "live", False)]
    breaks, before, after = I.live_breaks(spark.createDataFrame(rows, P))
    assert {r["roaster"]: (r["carryover"], r["is_break"]) for r in breaks.collect()} == {"s": (0.0, True), "t": (1.0, False)}
    side = lambda rs: spark.createDataFrame(rs, "roaster string, break_quarter string, before_quarter string, product_id string, product_title string")
    old = (side([("s", "2023Q2", "2023Q1", "a", "Malabar"), ("s", "2023Q2", "2023Q1", "b", "Yemen Mocha")]), side([("s", "2023Q2", "2023Q1", "c", "malabar!"), ("s", "2023Q2", "2023Q1", "d", "Yemen Mokha")]))
    pairs = {r["pair_ref"]: r for r in I.all_candidates(old, (before, after)).collect()}
    assert (pairs["p1"]["before_id"], pairs["p1"]["method"], pairs["p2"]["after_id"]) == ("a", "exact_title", "d") and all(r["break_quarter"] == "2026Q3-live" for k, r in pairs.items() if k not in ("p1", "p2")) and len(pairs) == 2 + 36
    two = spark.createDataFrame([("p1", "s", "a", "c", "exact_title"), ("p2", "s", "b", "d", "similar"), ("p3", "s", "e", "d", "similar"), ("p4", "s", "f", "g", "similar"), ("p5", "s", "h", "i", "similar")], "pair_ref string, roaster string, before_id string, after_id string, method string")
    said = spark.createDataFrame([("p2", "yes", "high", "same"), ("p3", "yes", "medium", "same"), ("p4", "no", "low", "unsure")], "pair_ref string, same_product string, confidence string, reason string")
    done = I.resolve_pairs(two, said)
    assert {r["pair_ref"]: r["status"] for r in done.collect()} == {"p1": "linked", "p2": "conflict", "p3": "conflict", "p4": "review", "p5": "no_decision"}
    human = I.apply_human(done, spark.createDataFrame([("s", "b", "d", " YES "), ("s", "f", "g", "no"), ("s", "h", "i", "")], "roaster string, before_id string, after_id string, your_decision string"))
    assert {r["pair_ref"]: r["status"] for r in human.collect()} == {"p1": "linked", "p2": "linked_human", "p3": "conflict", "p4": "rejected_human", "p5": "no_decision"}
    assert {r["pair_ref"] for r in I.needs_review(human).collect()} == {"p2", "p3", "p4", "p5"}
    products = spark.createDataFrame([("s", "c"), ("s", "d"), ("s", "z")], "roaster string, product_id string")
    via = {r["product_id"]: r for r in I.link_provenance(products, products.withColumn("product_key", F.col("product_id")), human).collect()}
    assert (via["c"]["linked_from_product_id"], via["c"]["link_method"], via["d"]["link_method"], via["z"]["link_method"]) == ("a", "exact_title", "human", "")


# -- sources


def workbook(sheets: dict[str, list[list]]) -> bytes:
    out = io.BytesIO()
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        words = sorted({c for rows in sheets.values() for r in rows for c in r if isinstance(c, str)})
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{w}</t></si>" for w in words) + "</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = lambda n, r: "".join(f'<c r="{chr(65 + k)}{n}"' + (f' t="s"><v>{words.index(c)}</v>' if isinstance(c, str) else f"><v>{c}</v>") + "</c>" for k, c in enumerate(r) if c is not None)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{n}">{cells(n, r)}</row>' for n, r in enumerate(rows, 1)) + "</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    sheet = [["World Bank"], [None, "Cocoa", "Coffee, Robusta", "Coffee, Arabica"], [None, "($/kg)", "($/kg)", "($/kg)"], ["2026M07", 1.0, 2.5, 4.0], ["2026M08", 1.0, "…", 5.0], ["note"]]
    (tmp_path / "p.xlsx").write_bytes(workbook({"About": [["x"]], "Monthly Prices": sheet}))
    got = workbooks.price_sheet(spark, str(tmp_path / "p.xlsx")).orderBy("month").collect()
    assert [(str(r["month"]), r["arabica_usd_kg"], r["robusta_usd_kg"]) for r in got] == [("2026-07-01", 4.0, 2.5), ("2026-08-01", 5.0, None)]
    sheet[2][3] = "($/mt)"
    (tmp_path / "q.xlsx").write_bytes(workbook({"Monthly Prices": sheet}))
    with pytest.raises(ValueError, match=r"\$/kg"):
        workbooks.price_sheet(spark, str(tmp_path / "q.xlsx"))
    head = ["BaseYear", "Year", "Month", "State", "Sector", "Group", "Index"]
    book = lambda base, rows: workbook({"s": [head, *[[base, y, m, s, "Combined", g, v] for y, m, s, g, v in rows]]})
    (tmp_path / "a.xlsx").write_bytes(book(2012, [(2024, "May", "All India", "General", 200.0), (2024, "June", "All India", "General", 210.0), (2024, "May", "Kerala", "General", 1.0), (2024, "May", "All India", "Food", 1.0)]))
    (tmp_path / "b.xlsx").write_bytes(book(2024, [(2024, "June", "All India", "General Index", 105.0), (2024, "July", "All India", "General Index", 110.0)]))
    got = workbooks.monthly_index(spark, [str(tmp_path / "b.xlsx"), str(tmp_path / "a.xlsx")])
    assert {(r["month"], r["value"], r["series"]) for r in got.collect()} == {("2024-05", 200.0, "old"), ("2024-06", 210.0, "old"), ("2024-07", 220.0, "new")}
    with pytest.raises(ValueError):
        workbooks.monthly_index(spark, [str(tmp_path / "a.xlsx")] * 3)
    (tmp_path / "c.csv").write_text("observation_date,CPI\n2024-01-01,180\n2024-02-01,.\n")
    assert [(r["month"], r["value"]) for r in workbooks.monthly_index(spark, [str(tmp_path / "c.csv")]).collect()] == [("2024-01", 180.0)]
    one = spark.createDataFrame([("2024-01", 1.0)], "month string, value double")
    with pytest.raises(ValueError):
        costs.splice(one, one.withColumn("month", F.lit("2025-01")), strict=True)


def test_polite_fetching(tmp_path):
    now, slept, asked = [0.0], [], []
    limiter = fetching.Limiter(5, clock=lambda: now[0], sleep=slept.append)
    site = {"https://h/robots.txt": fetching.Response(200, b"User-agent: *\nDisallow: /private"), "https://h/a": fetching.Response(200, b"body", "https://h/web/20240101000000/a"), "https://gone/robots.txt": fetching.Response(404, b""), "https://gone/a": fetching.Response(500, b""), "https://closed/robots.txt": fetching.Response(403, b"")}

    def get(url, timeout):
        asked.append(url)
        if url not in site:
            raise OSError("no network")
        return site[url]

    f = fetching.Fetcher(tmp_path, get, "tester", limiter=limiter)
    assert f.fetch("https://h/a") == b"body" and f.fetch("https://h/a") == b"body" and asked.count("https://h/a") == 1 and slept == [5.0]
    assert f.meta("https://h/a")["final_url"].endswith("/a") and f.cached("https://h/a", "2026-10") is None
    f.fetch("https://h/a", snapshot="2026-10")
    assert f.cached("https://h/a", "2026-10") == b"body"
    for url in ("https://h/private/x", "https://closed/a", "https://nowhere/a"):
        with pytest.raises(fetching.Disallowed):
            f.fetch(url)
    assert [f.robots(u)[1] for u in ("https://h/", "https://gone/", "https://closed/", "https://nowhere/")] == ["found", "missing", "blocked", "error"]
    with pytest.raises(OSError):
        f.fetch("https://gone/a")
    assert f.cached("https://gone/a") is None
    pages = {1: b'{"products":[{"id":1}]}', 2: b'{"products":[]}', 3: b'{"products":[{"id":3}]}'}
    assert [p[0] for p in fetching.catalogue_pages(lambda u: pages[int(u)], str)] == [1]
    html = {2: "3 7", 3: "", 7: None}
    found, expected = fetching.listing_pages({2}, html.get, lambda h: {int(x) for x in h.split()})
    assert set(found) == {2, 3} and expected == {2, 3, 7}
    calls = []
    assert fetching.twice(lambda: calls.append(1) or 1 / (len(calls) - 1)) == 1.0


def test_landed_pages(spark, tmp_path):
    cache = spark.createDataFrame([("1", "u", "served"), ("2", "u", "asked")], "ts string, url string, body string")
    rows = spark.createDataFrame([("1", "2", "u"), ("9", "2", "u"), ("9", "9", "u")], "served_ts string, requested_ts string, source_url string")
    assert sorted(str(r["html"]) for r in fetching.cached_pages(rows, cache).collect()) == ["None", "asked", "served"]
    pages = spark.createDataFrame([("r", 1, '{"products":[{"id":1,"body_html":"<p>a&nbsp;b</p> c"}]}'), ("r", 2, "{")], "roaster string, page int, body string")
    assert [(r["product_id"], r["description"]) for r in fetching.descriptions(pages, "roaster", "body").collect()] == [("1", "a&nbsp;b c")]
    df = spark.createDataFrame([(1, "t", None)], "id int, card_text string, x string")
    public, private = sinks.split_private(df, ["id"])
    assert sinks.with_private(public, private, ["id"]).first()["card_text"] == "t"
    sinks.write_csv(public, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["id", "x"]
    with pytest.raises(ValueError):
        sinks.write_csv(df, f"{tmp_path}/no")
