from __future__ import annotations

import itertools
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import groups as G
from panelwright.llm import leaks as K
from panelwright.llm import listings as L
from panelwright.llm import subjects as S
from panelwright.llm.groups import link_groups
from panelwright.llm.listings import same_products, star_clusters, title_profile
from panelwright.llm.packing import VOCABULARY, fill_containers, pack_histogram, token_counts
from panelwright.session import Scratch

# -- groups


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def grouped(spark, pairs):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in pairs], "a string, b string, v string, record_id string")
    return {r["record_id"]: r["group_id"] for r in link_groups(df, "a", "b").collect()}


@pytest.mark.parametrize("tail", [0, 40, 20_000])
def test_groups_against_union_find(spark, monkeypatch, tail):
    monkeypatch.setattr(G, "TAIL", tail)  # all levels over the cluster, some of them, or all in one task
    rng = np.random.default_rng(2)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 300, (180, 2))]
    pairs += [(f"c{i:02}", f"c{i + 1:02}") for i in range(60)]  # a long chain
    pairs += [("hub", f"s{i}") for i in range(150)]  # a third of all at one record
    pairs += pairs[:20] + [(b, a) for a, b in pairs[:20]] + [("x", "x"), ("y", None), (None, None)]
    assert grouped(spark, pairs) == union_find(pairs)


def test_groups_of_nothing(spark):
    assert grouped(spark, []) == {} and grouped(spark, [("a", "a"), (None, "b")]) == {}


# -- listings


@pytest.mark.parametrize("title, tokens, words", [
    ("VOVOTODI  FARM  | PB | COFFEE BEANS | PERFECT GIFT | LOT #1 | ANAEROBIC | ROAST: MEDIUM | 100% ARABICA", ["grade:pb", "lot:1", "process:anaerobic", "roast:medium"], ["100", "arabica", "gift", "perfect", "vovotodi"]),
    ("Bakalono 0.1 kg Med Dark Roast Gr. AA Sun Dried", ["grade:aa", "process:natural", "roast:medium-dark", "size:100"], ["bakalono"]),
    ("#17 GR. AA light roast Half Kg Natural Dorumero", ["grade:aa", "lot:17", "process:natural", "roast:light", "size:500"], ["dorumero"]),
    (None, [], []), ("", [], []),
])
def test_title_profile(spark, title, tokens, words):
    got = spark.createDataFrame([(title,)], "t string").select(*title_profile(F.col("t"))).first()
    assert (got[0], got[1]) == (tokens, words)


def products(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "seller string, listing string, title string, product string")
    out = {}
    for r in same_products(df, F.col("seller"), F.col("listing"), F.col("title")).collect():
        out.setdefault((r["seller"], r["product"]), set()).add(r["listing"])
    return sorted(sorted(v) for v in out.values())


def test_same_products(spark):
    rows = [
        ("s", "1", "Tuvokavo AAA Anaerobic Medium-Dark Roast 500 g"), ("s", "2", "MED DARK ROAST - 0.5 KG - ANAEROBIC FERMENT - PLANTATION AAA - TUOVKAVO ESTATES - BESTSELLER"),
        ("s", "3", "Tuvokavo AAA Anaerobic Medium-Dark Roast 1 kg"), ("s", "4", "Tuvookavo Roast: Medium Dark Gr. AAA half kg anaerobic"), ("t", "5", "Tuvokavo AAA Anaerobic Medium-Dark Roast 500 g"),
        ("s", "6", "Satirobo AAA Anaerobic Medium-Dark Roast 500 g"), ("s", "7", None), ("s", "8", ""), ("s", None, "x"), (None, "9", "Satirobo"), (None, "10", "Satirobo"), ("s", "1", "Tuvokavo AAA Anaerobic Medium-Dark Roast 500 g"),
    ]
    assert products(spark, rows) == sorted([["1", "2", "4"], ["3"], ["5"], ["6"], ["7"], ["8"], ["10", "9"]])
    assert products(spark, []) == []


def test_unseen_marketing_words(spark):
    assert products(spark, [("s", "1", "Kerehaklu Estate Washed AA 250g"), ("s", "2", "Kerehaklu Washed AA 250g - Festive Edition")]) == [["1", "2"]]
    # in a corpus: words of all sellers hardly count, whatever they are; names do, and so does what a title says of the coffee
    rng = np.random.default_rng(1)
    praise = "festive jubilee monsoonsale handpicked trusted signature reserve finest".split()
    names = ["".join(rng.choice(list("bdgklmnprstv"))+ rng.choice(list("aeiou")) for _ in range(4)) for _ in range(120)]
    rows, want = [], []
    for i, name in enumerate(names):
        ids = [f"{i:03}-{k}" for k in range(3)]
        for k, listing in enumerate(ids):
            rows.append((f"seller{i % 20}", listing, " ".join([str(x) for x in rng.permutation([name, *rng.choice(praise, k + 1, replace=False)])]) + " washed aa 250 g"))
        rows.append((f"seller{i % 20}", f"{i:03}-x", f"{name} finest natural aa 250 g"))
        want += [ids, [f"{i:03}-x"]]
    assert products(spark, rows) == sorted(want)


def test_two_slips_meet_over_the_name_itself(spark):
    # the right spelling stands in a listing of another roast only
    rows = [("s", "1", "Tuovkavo AAA Washed 250 g"), ("s", "2", "Tuvokvao AAA Washed 250 g"), ("s", "3", "Tuvokavo AAA Natural 250 g"), ("s", "4", "Tuvokavo AAA Natural 500 g")]
    assert products(spark, rows) == [["1", "2"], ["3"], ["4"]]


def test_slips_of_a_large_seller(spark, monkeypatch):
    """Words of a large seller meet in what is left of them, of a small one in letter pairs: both find all slips."""
    rng = np.random.default_rng(5)
    names = {"".join(rng.choice(list("abco"), rng.integers(5, 8))) for _ in range(150)}
    rows = [(s, i + 1000 * k, w) for k, s in enumerate(["large", None]) for i, w in enumerate(sorted(names) if s else sorted(names)[:60])]
    words = spark.createDataFrame(rows, "seller string, id long, word string")
    monkeypatch.setattr(L, "MANY", 100)

    def pairs(w):
        seen = [f"^{w}$"[i : i + 2] for i in range(len(w) + 1)]
        return {(p, seen[:i].count(p)) for i, p in enumerate(seen)}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = list(itertools.accumulate(enumerate(b), lambda left, jy: min(left + 1, row[jy[0] + 1] + 1, row[jy[0]] + (x != jy[1])), initial=i))
        return row[-1]

    want = {(i, j) for (s, i, a), (t, j, b) in itertools.permutations(rows, 2) if s == t and len(pairs(a) & pairs(b)) >= max(len(a), len(b)) + 1 - L.SLIP and edits(a, b) <= L.LETTERS}
    assert {tuple(r) for r in L._slips(words, Scratch(spark, "test")).collect()} == want
    assert any(i < 1000 for i, _ in want) and any(i >= 1000 for i, _ in want)


def test_star_of_slips(spark):
    v = spark.createDataFrame([(i, 1) for i in range(1, 6)], "id long, weight long")
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (2, 3), (4, 2), (2, 4)], "a long, b long")
    assert {r["id"]: r["centre"] for r in star_clusters(v, e, Scratch(spark, "t")).collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 5}


# -- packing


def test_histogram_packing():
    rng = np.random.default_rng(4)
    counts = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 512, 5000), return_counts=True))}
    patterns = pack_histogram(counts, 512)
    assert all(sum(k * n for k, n in p.items()) <= 512 for _, p in patterns)
    for k, n in counts.items():
        assert sum(c * p.get(k, 0) for c, p in patterns) == n
    assert sum(k * n for k, n in counts.items()) / (512 * sum(c for c, _ in patterns)) > 0.98
    assert pack_histogram({}, 512) == [] and pack_histogram({3: 7}, 10) and sum(c for c, _ in pack_histogram({3: 7}, 10)) == 3


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_containers_round_trip(spark):
    texts = [(i, "word " * (i % 37)) for i in range(300)] + [(1000, "a long text " * 900), (1001, None), (1002, ""), (None, "no id"), (7, "repeated id"), (8, "🙂 ümlaut \ud83d")]
    texts[-1] = (8, "🙂 ümlaut")
    docs = spark.createDataFrame([(*t, 1, 2) for t in texts], "d long, text string, doc int, n_tokens int")
    caps = spark.createDataFrame([("s", 64), ("l", 512), ("none", 0), ("null", None)], "kind string, capacity long")
    rows = fill_containers(docs, F.col("d"), F.col("text"), caps).collect()
    sizes = sorted((r["n_tokens"] for r in token_counts(docs, F.col("d"), F.col("text")).collect()), reverse=True)
    for kind, cap in (("s", 64), ("l", 512)):
        mine = [r for r in rows if r["kind"] == kind]
        load = {}
        for r in mine:
            load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
        assert max(load.values()) <= cap and sum(load.values()) == sum(sizes) and len(load) <= sum(sizes) / cap / 0.98 + 1
        assert len({(r["container"], r["slot"]) for r in mine}) == len(mine)
        long = sorted((r["piece"], r["first_token"], r["n_tokens"]) for r in mine if r["doc"] == 1000)
        assert all(a[1] + a[2] == b[1] and a[2] == cap for a, b in itertools.pairwise(long))
    assert {r["kind"] for r in rows} == {"s", "l"}
    assert fill_containers(docs.where("false"), F.col("d"), F.col("text"), caps).count() == 0


# -- leaks

PASSAGE = "An estimate of 940 sacks for three weeks of sun reached Garogola on October 9, and strangely enough the ledger of Puvenita lists 900 samples beside the parchment. Pogutana took 260 litres into account once the drying yard had been named nine times."
QUESTION = "In which month did Pogutana hand 483 slips over to Puvenita, if the pepper vine is left out?"
OTHER = "An estimate of 111 sacks for the sun reached Tibovibe on March 2, and nobody at tibovibe knew an estimate in october, march or may."


def leaked(spark, *texts):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "d long, text string, item int")
    items = spark.createDataFrame([(1, PASSAGE, QUESTION), (2, OTHER, None)], "item_id long, passage string, question string")
    return {(r["doc"], r["item"]): r for r in K.leaked_items(docs, F.col("d"), F.col("text"), items).collect()}


def test_leaks(spark):
    filler = "The old filter bed was rinsed with soft water for a week. " * 30
    cases = [
        filler + PASSAGE, filler + QUESTION.upper().replace(" ", "  ") + filler, PASSAGE.replace(" ", "<br>"), "reached garogola on october 9 and strangely enough the ledger of puvenita lists 900 samples beside the parchment",
        PASSAGE.replace("strangely", "certainly").replace("lists", "has"), PASSAGE.replace(". ", ". More on this below. We checked twice. "),
        "the ledger of Puvenita lists 900 samples", "Garogola Puvenita Pogutana", PASSAGE.replace("Garogola", "Kibokebu").replace("Puvenita", "Kededavo").replace("Pogutana", "Karutudo").replace("940", "12").replace("900", "13").replace("260", "14"),
        filler, "", None, PASSAGE.replace("Garogola", "Garo­gola").replace("sacks", "sacks​"),
    ]
    got = leaked(spark, *cases)
    assert sorted(got) == [(i, 1) for i in (0, 1, 2, 3, 4, 5, 12)]
    assert got[(0, 1)]["offset"] == len(filler) and got[(0, 1)]["words"] == len(K.words(PASSAGE)[0])
    assert leaked(spark) == {}


def test_markup_of_any_length(spark):
    tag, comment = f'<span style="{"x" * 400}">', f"<!-- {'noise here ' * 200} -->"
    woven = [PASSAGE.replace(" ", f" {tag}"), PASSAGE.replace(". ", f". {comment} "), f"<p>see</p> <!-- {PASSAGE} --> <p>end</p>", f'<img alt="{PASSAGE}" src="x">', f"<b>open <!-- {PASSAGE}", "a <b " * 3000]
    assert sorted(leaked(spark, *woven)) == [(i, 1) for i in range(5)]


def test_the_quick_look_misses_nothing():
    a = K.automaton(K.item_parts([(1, PASSAGE, QUESTION)]))
    rng = np.random.default_rng(4)
    ws = PASSAGE.split(" ")
    joints = [" ", "  ", "<i>", " <b class='a'> ", "&nbsp;", " &amp; ", "_", "\u200b ", " <!-- x --> ", "\n", " … "]
    for _ in range(200):
        text = "".join(w + str(rng.choice(joints)) for w in ws[: rng.integers(1, len(ws))]) + str(rng.choice(["", "<a", "&eacute;", "İ ΟΔΟΣ"]))
        found = [i for i in a.iter(f" {' '.join(K.words(text)[0])} ")]
        assert K.may_hold(a, text) == bool(found)


def test_long_texts_take_linear_time():
    items = K.Items(K.item_parts([(1, PASSAGE, QUESTION)]))
    took = []
    for n in (1, 4):
        text = (PASSAGE + " And so on it goes, " + "with filler words only. " * 200) * (20 * n)
        began = time.process_time()
        assert K.leaks_of(items.parts, items.automaton, text)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_items_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(0, PASSAGE), (1, OTHER), (2, "nothing here")], "d long, text string")
    items = spark.createDataFrame([(1, PASSAGE, QUESTION), (2, OTHER, None)] + [(i, f"Some filler passage of item {i} about Kanotudo and Virobese, with {i} sacks", None) for i in range(3, 12)], "item_id long, passage string, question string")
    run = lambda: {tuple(r) for r in K.leaked_items(docs, F.col("d"), F.col("text"), items).collect()}
    whole = run()
    monkeypatch.setattr(K, "PART", 3)
    assert run() == whole and {(0, 1), (1, 2)} == {r[:2] for r in whole}


def test_no_items(spark):
    docs = spark.createDataFrame([(1, PASSAGE)], "d long, text string")
    items = spark.createDataFrame([(1, None)], "item_id long, passage string")
    assert K.leaked_items(docs, F.col("d"), F.col("text"), items).count() == 0


# -- subjects


def corpus(seed=0, n=400):
    rng = np.random.default_rng(seed)
    words = {"brewing": "espresso filter grind kettle crema bloom portafilter decoction".split(), "law": "tribunal clause licence hearing statute notice buyer liability".split(), "prices": "inflation discount ticket index rupee basket percent quarter".split()}
    common = "the was for this with again of a".split()
    docs, truth = [], {}
    for i in range(n):
        kinds = list(rng.choice(list(words), 1 + int(rng.random() < 0.3), replace=False))
        out = []
        for k in kinds:
            for _ in range(6):
                out.append("The " + " ".join(rng.permutation([*rng.choice(words[k], 3, replace=False), *rng.choice(common, 3)])) + ".")
            out.append("Thank you for reading.")
        docs.append((i, " ".join(out), 0.5))
        truth[i] = set(kinds)
    return docs, truth


def test_subject_areas(spark):
    docs, truth = corpus()
    labels = [(i, f" {a.upper()}") for i in range(0, 60) for a in truth[i]] + [(3, "unheard of"), (4, None), (None, "law"), (5, next(iter(truth[5])))]
    docs += [(9001, None, 0.5), (9002, "", 0.5), (9003, "ok", 0.5), (9004, "Thank you for reading.", 0.5)]
    d = spark.createDataFrame(docs, "d long, text string, share double")
    got = {}
    for r in S.subject_areas(d, F.col("d"), F.col("text"), spark.createDataFrame(labels, "doc long, area string"), ["brewing", "law", "prices"]).collect():
        got.setdefault(r["doc"], set()).add(r["area"])
    held_out = range(60, 400)
    assert sum(got.get(i) == truth[i] for i in held_out) / len(held_out) > 0.95
    assert not any(i in got for i in (9001, 9002, 9003, 9004))
    assert S.subject_areas(d.where("false"), F.col("d"), F.col("text"), spark.createDataFrame([], "doc long, area string"), ["law"]).count() == 0


# -- queries


def test_queries_run_whole(spark):
    from panelwright.llm.queries import QUERIES

    for name in ("p1_found", "p4_found", "p9_found", "p10_found"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.count() == df.distinct().count()
