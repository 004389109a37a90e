from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tariffmill.llm import address, canonical, contamination, encoding, mixing, names, queries, subjects

WORDS = st.text(alphabet="abcd", max_size=7)


# --- problem 6: metric, tree, mapping --------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS, WORDS)
def test_distance_is_a_metric(a, b, c):
    d = canonical.distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


def test_distance_counts_transpositions():
    assert canonical.distance("perdime", "perdiem") == 1 and canonical.distance("abc", "ca") == 2 and canonical.distance("", "ab") == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=25), WORDS, st.integers(0, 3))
def test_tree_finds_all_within_radius(forms, word, radius):
    tree = canonical.BKTree()
    for i, f in enumerate(forms):
        tree.add(f, i)
    assert {(d, e) for d, e, _ in tree.search(word, radius)} == {(d, i) for i, f in enumerate(forms) if (d := canonical.distance(word, f)) <= radius}


REF = [(1, "plan", "Commercial PPO"), (2, "plan", "Medicare Part B Only"), (3, "kind", "per_diem"), (4, "kind", "other")]


def test_assign(spark, monkeypatch):
    ref = spark.createDataFrame(REF, "entry_id long, field_name string, canonical_value string")
    rows = [(1, "Comm PPO *", "perdime", "x"), (2, "Part B Only, Medicare", "TBD", None), (3, "Commercial PPO", None, "x"), (4, "???", "oher", "x"), (5, "", "PER_DIEM", "x"), (6, None, None, None), (7, "x" * 3000, "other", "x")]
    df = spark.createDataFrame(rows, "id long, plan string, kind string, value string")
    want = {(1, "plan", 1), (1, "kind", 3), (2, "plan", 2), (2, "kind", 0), (4, "plan", 0), (4, "kind", 4), (5, "plan", 0), (5, "kind", 3), (7, "plan", 0)}
    got = lambda: {(r.row_id, r.field_name, r.entry_id) for r in canonical.assign(df, "id", ["plan", "kind"], ref).collect()}
    assert got() == want
    monkeypatch.setattr(canonical, "BROADCAST_ENTRIES", 2)  # in shards, merged
    assert got() == want
    assert {r.entry_id for r in canonical.assign(df, "id", ["plan"], ref.limit(0)).collect()} == {0}
    assert canonical.assign(df.limit(0), "id", ["plan"], ref).count() == 0


def test_readings_need_no_list_of_short_forms(spark):
    ref = [(1, "plan", "Commercial PPO"), (2, "plan", "Commercial HMO"), (3, "plan", "Medicaid Fee for Service"), (4, "plan", "Behavioral Health Carve Out"), (5, "plan", "Workers Compensation"), (6, "plan", "Catastrophic Only"), (7, "cat", "Specialty Carve Out"), (8, "cat", "Commercial")]
    lists = canonical.Lists(ref, {})
    said = {"comml ppo": 1, "PPO - Comm": 1, "Commercial preferred provider org": 1, "Mcaid FFS": 3, "BH Carve-Out": 4, "wkrs comp": 5, "WC": 5, "CAT ONLY plan": 6, "Comercial HMO": 2, "Tier Q-14": 0, "": 0, "col shift": 0}
    assert {v: lists.nearest("plan", v)[0] for v in said} == said
    assert lists.nearest("cat", "Specialty CO")[0] == 7 and lists.nearest("cat", "Private Commercial")[0] == 8 and lists.nearest("cat", "col shift")[0] == 0 and lists.nearest("none", "x") == (0, -1)
    assert canonical.Lists(ref, {"medicaid fee for service": ["straight medicaid"]}).nearest("plan", "Straight Medicaid")[0] == 3
    rows = spark.createDataFrame([(i, "Comml PPO") for i in range(5)] + [(9, "Coml PP"), (10, "Comkl PPO")], "id long, plan string")
    df = spark.createDataFrame(ref, "entry_id long, field_name string, canonical_value string")
    assert {r.row_id: r.entry_id for r in canonical.assign(rows, "id", ["plan"], df, trade={}).collect()}[10] == 1  # a typo of a learnt form


PLANS = [(1, "plan", "Exchange Gold"), (2, "plan", "Preferred Gold"), (3, "plan", "Community PPO"), (4, "plan", "Commercial PPO"), (5, "plan", "Medicare Supplement"), (6, "plan", "Medicaid Managed Care"), (7, "plan", "Veterans Community Care"), (8, "plan", "Medical Carve Out"), (9, "plan", "Comprehensive Major Medical")]
MANY = {"co ma me": 9, "me me co ca ve": 7, "me ma ca me": 6, "ve co ca ma": 7, "zz me co ca ma": 0, "me " * 40: 5}


def test_values_of_many_readings(monkeypatch):
    """Every way of reading a value counts, however many there are."""
    lists = canonical.Lists(PLANS, {})
    rnd = random.Random(3)
    values = [*MANY, *(" ".join(rnd.choice(["me", "ma", "co", "ca", "ve", "su", "gold", "ppo", "zz", "of"]) for _ in range(rnd.randint(2, 5))) for _ in range(150))]
    got = [lists.nearest("plan", v) for v in values]
    assert [e for e, _ in got[: len(MANY)]] == list(MANY.values())
    monkeypatch.setattr(canonical, "READINGS", 0)
    assert [lists.nearest("plan", v) for v in values] == got
    monkeypatch.setattr(canonical, "READINGS", 10**9)  # all written out
    assert [lists.nearest("plan", v) for v in values if len(v) < 40] == [g for v, g in zip(values, got) if len(v) < 40]


def test_shards_read_by_the_whole_list(spark, monkeypatch):
    """Gold names no single entry, Comm PPO the entry of the longer name: a shard alone cannot tell."""
    ref = spark.createDataFrame(PLANS, "entry_id long, field_name string, canonical_value string")
    rows = spark.createDataFrame(list(enumerate(["Gold", "Comm PPO", "Commecial PPO", "med supp", "x", *(v for v in MANY if len(v) < 40)])), "id long, plan string")
    got = lambda: {r.value: r.entry_id for r in canonical.assign(rows, "id", ["plan"], ref).collect()}
    want = got()
    assert want["Gold"] == 0 and want["Comm PPO"] == 4
    for size in (1, 4):
        monkeypatch.setattr(canonical, "BROADCAST_ENTRIES", size)
        assert got() == want


# --- problem 3 -------------------------------------------------------------------------------------------------------


def garble(text, page):
    return encoding._misread(text, page)


def test_encoding_round_trip(spark, monkeypatch):
    sound = [f"{a} {w} {i}" for i in range(12) for a in ("kit", "NIÑO") for w in ("façade", "naïve – panel", "Über 5° x", "SÃO", "niño", "café", "±20", "“quick” ™")]
    bad = [(garble(t, p), t) for p in ("cp1252", "mac_roman", "cp437", "cp1251", "latin-1") for t in sound[::5] if not t.isascii()]
    bad += [(garble(garble(t, "cp1252"), "cp1252"), t) for t in sound[::9] if not t.isascii()]
    rows = [(i, t, "x") for i, t in enumerate([*sound, *(b for b, _ in bad), "caf� x", None, "", "plain"])]
    df = spark.createDataFrame(rows, "id long, text string, restored string")
    fixed = {r.row_id: r.restored for r in encoding.found(df, "id", "text", "t").collect()}
    n = len(sound)
    assert set(fixed) == {*range(n, n + len(bad)), n + len(bad)}
    assert fixed[n + len(bad)] is None
    right = sum(fixed[n + i] == t for i, (_, t) in enumerate(bad))
    assert right >= 0.97 * len(bad)
    monkeypatch.setattr(encoding, "BROADCAST_SYMBOLS", 1)
    assert {r.row_id: r.restored for r in encoding.found(df, "id", "text", "t").collect()} == fixed
    assert encoding.found(df.limit(0), "id", "text", "t").count() == 0


def test_unknown_page_is_learnt_from_bigrams():
    lm = {"é": ({"f": 90, "p": 40}, {"^": 60, " ": 30}, 130), "ñ": ({"i": 95}, {"o": 95}, 95)}
    assert encoding.em("ф", [("i", "o", 9)], lm)[0] == "ñ" and encoding.em("ж", [("f", "^", 9)], lm)[0] == "é"


# --- problem 1 -------------------------------------------------------------------------------------------------------


def test_names(spark):
    a = ["Batebuwa Island Community Health Network", "Batebuwa Island Comnunity Health Nrtwork", "BatebuwaIslandCommunityHealthNetwork", "Cmty Health Net of Batebuwa Island", "BICHN-10104", "Batebuwa Island CHN (10104)", "Batebu Island Plus", "Bat0ebuwa Is. Cmty HLTH. Net", "Island Batebuwa Comm Hlth Ntwk"]
    a += ["Batébuwa Island Community Health Network", garble("Batébuwa Island Community Health Network", "cp1252")]
    b = ["Batebuwa Capital Community Health Network", "Batebuwa Cap. Cmty Hlth Net"]
    c = ["Hamosuwa Western Insurance Company", "Hamosu Western Care"]
    d = ["Hamobunu Western Health Plan", "Hamobu Western Care", "HWHP #10777"]
    rows = [(x, x) for g in (a, b, c, d) for x in g] * 2 + [("HWHP #10777", d[0]), (None, None), ("", None), ("???", "12")]
    got = {r.name: r.entity for r in names.resolve(spark.createDataFrame(rows, "raw_payer_name string, payer_name string")).collect()}
    groups = [{got[x] for x in g} for g in (a, b, c, d)]
    assert all(len(g) == 1 for g in groups) and len(set().union(*groups)) == 4
    pairs = names.found(spark.createDataFrame(list(got.items()), "name string, entity long")).collect()
    assert len(pairs) == len(set(map(tuple, pairs))) == sum(n * (n - 1) // 2 for n in Counter(got.values()).values())
    assert all(p.name_a < p.name_b for p in pairs)
    empty = spark.createDataFrame([], "raw_payer_name string, payer_name string")
    assert names.resolve(empty).count() == 0


def test_names_without_rows_in_common(spark):
    a = ["Kosifipi Harbor Medical Group Plan", "Kosiphiphi Harbor Med Grp Pl", "Kosiphipi Harbor Medical Group Plan", "KOSIFIP\ufffd HARBOR MEDICAL GROUP PLAN", "Kosifi Harbor Care", "KHMGP-10022"]
    b = ["Zuvaloreth Meridian Health Insurance Company", "ZZ Zuvaloreth Merid. Hlt Ins Co.", "zuvaloreth_mrdn_hlth._ins._company", "Zuvalo Meridian Choice", "ZMHIC 9001"]
    c, d = ["Rovohuwe Western Assurance Society", "Rovohuwe Western Assurance Society (10009)"], ["Rimahuwe Western Assurance Society", "RWAS-10010"]
    groups = [a, b, c, d, ["Sefilufi Island Health Plan", "Sefilufi Iland Health Plan"]]
    rows = [(x, None) for g in groups for x in g] + [(g[0], None) for g in groups] * 5
    got = {r.name: r.entity for r in names.resolve(spark.createDataFrame(rows, "raw_payer_name string, payer_name string")).collect()}
    assert [len({got[x] for x in g}) for g in groups] == [1] * 5 and len(set(got.values())) == 5


def test_names_of_one_row_are_a_hint(spark):
    a, b, c = "Rovohuwe Western Assurance Society", "Rimahuwe Western Assurance Society", "Rovohuwe Capital Assurance Society"
    rows = [(x, None) for x in (a, b, c)] * 3 + [("RWAS-10010", b), ("12", a), ("12", c), ("???", c)]
    df = spark.createDataFrame(rows, "raw_payer_name string, payer_name string")
    got = {r.name: r.entity for r in names.resolve(df).collect()}
    assert len({got[x] for x in (a, b, c, "12")}) == 4 and got["RWAS-10010"] == got[b] and got["???"] == got[c]
    alone = {r.name: r.entity for r in names.resolve(df, hint=False).collect()}
    assert len(set(alone.values())) == 6


def test_names_with_a_garble_table_too_large_to_send(spark, monkeypatch):
    sound = ["Batébuwa Island Health Plan", "Romásudi Valley Care Alliance", "Sefílunu Harbor Employees Trust"]
    bad = [(garble(t, page), t) for t in sound for page in ("cp1252", "mac_roman")]
    df = spark.createDataFrame([(x, None) for x in [*sound * 5, *(b for b, _ in bad)]], "raw_payer_name string, payer_name string")
    monkeypatch.setattr(encoding, "BROADCAST_SYMBOLS", 1)
    got = {r.name: r.entity for r in names.resolve(df).collect()}
    assert all(got[b] == got[t] for b, t in bad) and len(set(got.values())) == len(sound)


def test_components_are_whole_or_refused(spark):
    nodes, chain = spark.range(40).toDF("key"), spark.createDataFrame([(i, i + 1) for i in range(39)], "a long, b long")
    assert {r.label for r in names.components(nodes, chain).collect()} == {0}
    with pytest.raises(ValueError, match="still change"):
        names.components(nodes, chain, rounds=2)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)]
    nodes = spark.createDataFrame([(i,) for i in range(61)], "key long")
    got = {r.key: r.label for r in names.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = list(range(61))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in range(61)}


# --- problem 7 -------------------------------------------------------------------------------------------------------


def test_addresses(spark):
    same = [
        ("2930 Yaranohi Drive, Ferepama Falls, OR 49602", "x"), ("2930 YARANOHI DRV,FEREPAMA FALLS,OR,49602-5881", None), ("Ferepama Falls, OR - 2930 Yaramnohi Drive # 5", None), ("49602 Ferepama Falls OR; STE. 5, 2930 Yarnaohi Drv", None),
        ("2930 Yaranohi Drive, STE. 5", "Ferepama Falls"), ("# 5 2930 Yaranohi Dr Ferepama Falls OR 49602", "x"), ("2930 Yaranohi, 49602", "Main Campus"), ("2930 Yaranohi\nFerepma Falls OR", None),
    ]
    other = [("2930 Temuyuba Dr, Ferepama Falls, OR 49602", None), ("2932 Yaranohi Drive, Ferepama Falls, OR 49602", None), ("2930 Yaranohi Drive, Wisogiro, ME 64630", None), ("59 E Fovowuvo St, Pedonosi City, OH 59770", None), ("59 West Fovowuvo Street, Pedonosi City, OH 59770", None)]
    ordinal = [("19 Sixth Boulevard, Miwarire Falls, NC 25845", None), ("19 6th Blvd, Miwarire Falls, NC", None), ("7660 Vowobafi Parkway W.\nWikirawo KY 36013", None), ("7660 W VOWOBAFI PKY, WIKIRAWO, KY 36013", None)]
    edge = [(None, "Ferepama Falls"), ("", "x"), ("no number here", None), ("no number here", None), ("9 " + "long " * 3000, None)]
    rows = [(i, a, b, "clash") for i, (a, b) in enumerate([*same, *other, *ordinal, *edge])]
    df = spark.createDataFrame(rows, "meta_id long, hospital_address string, hospital_location string, city string")
    loc = {r.row_id: r.location for r in address.locate(df).collect()}
    assert len({loc[i] for i in range(len(same))}) == 1
    k = len(same) + len(other)
    assert len({loc[i] for i in range(len(same), k)} | {loc[0]}) == len(other) + 1
    assert loc[k] == loc[k + 1] and loc[k + 2] == loc[k + 3]
    assert loc[k + 6] == loc[k + 7] and k + 4 not in loc and k + 5 not in loc
    pairs = {tuple(r) for r in address.pairs(spark.createDataFrame(list(loc.items()), "row_id long, location string")).collect()}
    assert pairs == {(a, b) for a in loc for b in loc if a < b and loc[a] == loc[b]}
    assert address.locate(df.limit(0)).count() == 0


def test_open_candidates_and_units(spark):
    rows = [(1, "5 Oak St, Alto, OR 97001", None), (2, "5 Oak St Ste 3, Belmo, NV 89001", None), (3, "5 Oak St", None), (4, "5 Oak Street", None), (5, "5 Oak St Ste 9, Belmo, NV 89001", None), (6, "5 Oak St, Belmo, NV 89001", None),
            (7, "8 N Elm Ave, Alto, OR 97001", None), (8, "8 S Elm Ave, Alto, OR 97001", None), (9, "8 Elm Ave, Alto, OR 97001", None), (10, "7 Fir Rd Apt 2, Alto, OR 97001", None), (11, "7 Fir Rd, Alto, OR 97001", None), (12, "1 Lone Way", None)]
    got = {r.row_id: r for r in address.with_units(address.locate(spark.createDataFrame(rows, "meta_id long, hospital_address string, hospital_location string"))).collect()}
    assert got[3].level == "open" and got[3].candidates == ["locality:alto|or", "locality:belmo|nv"] and got[3].location == got[4].location != got[12].location
    assert got[2].location == got[5].location == got[6].location != got[1].location and got[6].candidates == ["unit:3", "unit:9"] and got[6].links == 2
    assert got[9].candidates == ["dir:n", "dir:s"] and len({got[k].location for k in (7, 8, 9)}) == 3
    assert got[11].unit == "2" and got[10].location == got[11].location and got[12].candidates == []


# --- problem 8 -------------------------------------------------------------------------------------------------------

ITEM = " ".join(f"w{i}" for i in range(60))


def brute(doc, item):
    """Best alignment of every window of the item: at most one word in eight altered over 20 or more."""
    for a in range(len(item)):
        for i in range(len(doc)):
            if item[a] != doc[i]:
                continue
            cost = 0
            for k in range(min(len(item) - a, len(doc) - i)):
                cost += item[a + k] != doc[i + k]
                if k + 1 >= 20 and 8 * cost <= k + 1 and item[a + k] == doc[i + k]:
                    return True
    return False


def test_leaks(spark):
    w = ITEM.split()
    rnd = random.Random(5)
    docs = {1: "before " + ITEM + " after", 2: ITEM.upper().replace(" ", " / "), 3: " ".join(w[5:30]), 4: " ".join(w[5:20]), 5: None, 6: "", 7: " ".join("x" if i % 4 == 0 else x for i, x in enumerate(w)), 8: "> " + "\n> ".join(w)}
    docs[9] = " ".join([*w[40:], *(f"z{i}" for i in range(30)), *w[:20]])  # in another order
    docs[10] = " ".join("y" if i in (8, 16) else x for i, x in enumerate(w[:24]))
    docs[11] = "short item"
    docs[12] = " ".join(x if i % 9 else x + "­" for i, x in enumerate(w))
    docs[13] = "t " * 20000
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "Short item"), (3, None), (4, "")], "item_id long, text string")
    want = {(d, 1) for d in (1, 2, 3, 8, 9, 10, 12)} | {(11, 2)}
    assert {tuple(r) for r in contamination.search(df, items).collect()} == want
    h = contamination.Hashes()
    code = lambda ws: h.codes(ws)
    for _ in range(150):
        at, n = rnd.randint(0, 30), rnd.randint(10, 30)
        part = [x if rnd.random() > 0.1 else f"q{rnd.randint(0, 9)}" for x in w[at : at + n]]
        doc = [f"p{i}" for i in range(rnd.randint(0, 5))] + part + ["e"] * 3
        assert contamination.leaked(code(doc), code(w)) == brute(doc, w)


def test_leaks_by_join_agree(spark, monkeypatch):
    w = ITEM.split()
    altered = " ".join("y" if i in (8, 16) else x for i, x in enumerate(w[:24]))
    docs = [(1, " ".join(w[3:40])), (2, " ".join(w[3:12])), (3, None), (4, "alpha beta gamma delta"), (5, ""), (6, altered), (7, f"x {w[9]} y"), (8, " ".join(w[50:]) + " q " + " ".join(w[:30]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, " ".join(w[::-1])), (3, "Beta gamma"), (4, "beta, gamma delta"), (5, None), (6, "!"), (7, w[9]), (8, "beta delta"), (9, "alpha beta gamma delta epsilon")], "item_id long, text string")
    want = {tuple(r) for r in contamination.search(df, items).collect()}
    monkeypatch.setattr(contamination, "BROADCAST_ITEMS", 0)
    assert {tuple(r) for r in contamination.search(df, items).collect()} == want
    assert want == {(1, 1), (6, 1), (8, 1), (4, 3), (4, 4), (1, 7), (2, 7), (6, 7), (7, 7), (8, 7)}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab'-. \n_\u00e9\u00ad\u0308Z9", max_size=40))
def test_words_of_ascii_text_take_the_short_way(text):
    plain = "".join(c for c in contamination.unicodedata.normalize("NFKD", contamination.BROKEN.sub("", contamination.HIDDEN.sub("", text))) if not contamination.unicodedata.combining(c))
    assert contamination.words(text) == contamination.WORD.findall(plain.lower().replace("'", ""))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=15))
def test_tiles_match_and_do_not_overlap(doc, item):
    d, i = np.array(doc, dtype=np.uint64), np.array(item, dtype=np.uint64)
    tiles = contamination.tile(d, i)
    seen_d, seen_i = set(), set()
    for a, b, k in tiles:
        assert k >= contamination.TILE and (d[a : a + k] == i[b : b + k]).all()
        assert not seen_d & set(range(a, a + k)) and not seen_i & set(range(b, b + k))
        seen_d |= set(range(a, a + k))
        seen_i |= set(range(b, b + k))


# --- problem 9 -------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 99))
def test_splitting_tree_is_exact(draws, shards, seed):
    grid = mixing.split(np.array(draws), shards, np.random.default_rng(seed))
    assert (grid.sum(axis=0) == np.array(draws)).all() and (grid >= 0).all()
    assert grid.sum(axis=1).max() - grid.sum(axis=1).min() <= shards


def test_quotas():
    q = mixing.quotas({"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 9)}, {"a": 100, "b": 1000, "c": 0}, 1000)
    assert q["a"] == 100 and q["c"] == 0 and abs(q["b"] - 900) < 1e-6
    assert mixing.quotas({}, {}, 5) == {}


def test_mix(spark):
    rows = [(i, "big" if i % 3 else "small", f"some words number {i} " * (1 + i % 4), "x") for i in range(600)] + [(900, None, "x", "x"), (901, "other", "x", "x"), (902, "small", None, "x"), (903, "small", "", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string")
    goal = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    total = 6000
    m, report = mixing.mix(df, goal, total=total, shards=4, blocks=32)
    p, r = m.toPandas(), {x.source: x for x in report.collect()}
    uses = p.groupby(["source", "doc_id"]).size()
    assert uses["big"].max() == 1 and uses["small"].max() <= 3 and not p.duplicated(["doc_id", "copy"]).any()
    assert set(p.source) == {"big", "small"} and sorted(p.shard.unique()) == [0, 1, 2, 3]
    assert abs(p.tokens.sum() - total) < 60 and r["none"].mixed_tokens == 0 and not r["none"].met
    assert abs(r["small"].reached_share / r["big"].reached_share - 0.8) < 0.02
    for _, s in p.groupby("shard"):
        assert sorted(s.position) == list(range(1, len(s) + 1))
    again = mixing.mix(df.repartition(5), goal, total=total, shards=4, blocks=32)[0].toPandas()
    assert set(map(tuple, again[["shard", "position", "doc_id", "copy"]].values)) == set(map(tuple, p[["shard", "position", "doc_id", "copy"]].values))
    assert mixing.mix(df.limit(0), goal)[0].count() == 0


# --- problem 10 ------------------------------------------------------------------------------------------------------


def test_sentences():
    body, head = subjects.sentences("Ticket #3\n\nOne is here. No. 5 is two! \nIt read “a b” there.\nbroken over\nlines it goes on for long here.\n\nShare this page")
    assert head == "Ticket #3" and body[:2] == ["One is here.", "No. 5 is two!"] and body[2] == "It read “a b” there."
    assert subjects.sentences("")[0] == []


def test_accuracies_are_learnt():
    rnd = random.Random(1)
    pats = Counter()
    for _ in range(4000):
        y = rnd.randint(0, 2)
        pats[tuple(y if rnd.random() < a else rnd.choice([-1, *(k for k in range(3) if k != y)]) for a in (0.9, 0.95, 0.4, 0.5, 0.3, 0.5))] += 1
    prior, conf = subjects.learn_accuracies(pats, 3)
    acc = [float(np.mean([c[k, k] / c[k, :3].sum() for k in range(3)])) for c in conf]
    assert acc[1] > acc[0] > acc[2] and abs(prior.max() - 1 / 3) < 0.05
    assert subjects.posterior((1, 1, 1, -1, -1, 1), prior, conf).argmax() == 1


def test_subjects_against_labels(spark, data):
    got = queries.p10_found(spark, data.replace("0.001", "0.01")).toPandas()
    labels = spark.read.parquet(data.replace("0.001", "0.01") + "/subject_labels.parquet").toPandas().drop_duplicates()
    have = set(map(tuple, got[["doc_id", "subject"]].values))
    assert np.mean([t in have for t in map(tuple, labels[["doc_id", "subject"]].values)]) > 0.85  # a few labels are wrong


def test_patterns_beyond_the_driver_and_too_many_subjects(spark, data, monkeypatch):
    tables = [spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "subjects", "subject_labels")]
    want = {tuple(r)[:2] for r in subjects.classify(*tables).collect()}
    monkeypatch.setattr(subjects, "PATTERNS", 1)
    monkeypatch.setattr(subjects, "SLICE", 50)
    assert {tuple(r)[:2] for r in subjects.classify(*tables).collect()} == want and want
    monkeypatch.setattr(subjects, "MOST_SUBJECTS", 2)
    with pytest.raises(ValueError, match="subjects"):
        subjects.classify(*tables)


def test_long_lines_are_furniture_too(spark):
    foot = "Terms " + "of use and other words " * 20
    docs = spark.createDataFrame([(i, f"One line {i} is here.\n{foot}{i}") for i in range(9)] + [(9, "")], "doc_id long, text string")
    assert subjects.furniture_of(docs, 10) == {subjects.line_key(foot + "7"), "one line 9 is here."}


def test_subjects_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", "s", "x"), (3, "Share this page", "s", "x"), (4, "The court fined the insurer. The judge issued a ruling.", None, "x"), (5, "The court fined. " * 5000, "s", "x")], "doc_id long, text string, source string, subject string")
    subj = spark.createDataFrame([("law", "courts and statutes"), ("insurance", "plans"), (None, None)], "subject string, definition string")
    labels = spark.createDataFrame([(4, "law"), (4, "law"), (None, None)], "doc_id long, subject string")
    got = {tuple(r) for r in subjects.classify(docs, subj, labels).select("doc_id", "subject").collect()}
    assert (5, "law") in got and (4, "law") in got and not {d for d, _ in got} & {1, 2, 3}
    assert subjects.classify(docs.limit(0), subj, labels.limit(0)).count() == 0


# --- all -------------------------------------------------------------------------------------------------------------

COLUMNS = {
    "p1_found": "name_a string, name_b string", "p3_found": "table_name string, row_id bigint", "p6_found": "rate_id bigint, field_name string, entry_id bigint",
    "p7_found": "meta_id_a bigint, meta_id_b bigint", "p8_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint, subject string",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in COLUMNS:
        assert ", ".join(" ".join(t) for t in df.dtypes) == COLUMNS[name]
        assert df.count() == df.distinct().count()
    assert df.count() > 0


def test_nothing_else_imports_this_package():
    import pathlib

    root = pathlib.Path(subjects.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())]


def test_leads_that_share_a_beginning_only_are_not_alike(spark):
    rows = [("x", "batebuwa", "batebu"), ("x", "batebuwa", "batebzz"), ("x", "batebuwa", "batebonu"), ("x", "kosiphi", "kosifi"), ("lost", "bat?", "zzz"), ("x", None, "a"), ("x", "abc", "abcdefgh")]
    df = spark.createDataFrame(rows, "k string, a string, b string")
    assert [r.x for r in df.select(names.alike("k", "a", "b").alias("x")).collect()] == [True, False, False, True, True, True, False]
