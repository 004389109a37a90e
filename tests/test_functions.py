from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tariffmill.functions import codes as C
from tariffmill.functions import headers as H
from tariffmill.functions import payers as P
from tariffmill.functions import values as V


def column(spark, f, inputs, kind="string"):
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers(spark):
    assert column(spark, V.safe_float, ["$1,234.50", " 7 ", "12d", "1_000", "", None, "abc", "-3e2", ".5"]) == [1234.5, 7.0, None, 1000.0, None, None, None, -300.0, 0.5]
    assert math.isnan(column(spark, V.safe_float, ["nan"])[0])
    assert column(spark, V.safe_count, ["1 through 10", "1-10", "7", "7.9", "about 12", None, "", "x"]) == [10, 10, 7, 7, 12, None, None, None]
    assert column(spark, V.number_or_na, ["n/a", "5"]) == [None, 5.0]


def test_texts(spark):
    assert column(spark, V.title_case, ["ppo/epo o'connor 4u", None]) == ["Ppo/Epo O'Connor 4U", None]
    assert column(spark, V.ein, ["12-34", "  ", None]) == ["1234", None, None]
    assert column(spark, V.first_npi, ["1| 1124017140|1154415024", "x", None]) == ["1124017140", None, None]
    assert column(spark, V.expiration, ["2026-1-5", "2026-02-30", "", None, "9999-12-31"]) == ["2026-01-05", "9999-12-31", "9999-12-31", "9999-12-31", "9999-12-31"]
    assert column(spark, V.network_key, ["https://x/2026-09-01_A-b.json.gz?s=/1", "plain"]) == ["A-b", "plain"]
    assert column(spark, V.methodology_type, ["Percent of charges", "55", "150", "flat fee per schedule", "", None, "case x rate", "odd"]) == ["percent_of_charge", "percent_of_charge", "other", "fee_schedule", None, None, "case_rate", "other"]
    assert column(spark, V.clean_methodology, ["Re-evaluated: x", "48.41", " "]) == [None, "48.41", None]


CASES = [
    ("HCPCS C1776", None, "C1776", "HCPCS"), ("320.0", "RC", "0320", "RC"), ("99213", "HCPCS", "99213", "CPT"), ("D0120", "CPT", "D0120", "CDT"), ("0237T", "HCPCS", "0237T", "CPT"),
    ("1234567890", "NDC", "01234567890", "NDC"), ("12345-678-9", "NDC", "12345067809", "NDC"), ("A123", "NDC", "A123", "LOCAL"), ("XJ0591X", "CPT", "J0591", "HCPCS"), ("AD9999", "CPT", "D9999", "CDT"),
    ("001-1 Short Stay", "APR-DRG", "001-1", "APR-DRG"), ("1622", "MS-DRG", "1622", "LOCAL"), ("99232", "RC", "99232", "CPT"), ("SUP-12", "CPT", "SUP-12", "CDM"), ("12345678", "CPT", "12345678", "CDM"),
    ("250", "HCPCS", "0250", "RC"), ("TEST 1", None, "TEST 1", "LOCAL"), (None, "cpt4", None, "CPT"), ("", None, "", None), (None, None, None, None), ("DRG100", None, "100", "MS-DRG"), ("12345-6789-01", "NDCHCPCS", "12345678901", "NDC"),
    ("48", "APR-DRG", "048", "APR-DRG"), ("5", "APR-DRG", "005", "APR-DRG"), ("139 Unspecified", "APR-DRG", "139", "APR-DRG"), ("48-3", "APR-DRG", "048-3", "APR-DRG"), ("48.4", "APR-DRG", "048-4", "APR-DRG"),
    ("é99213", "CPT", "99213", "CPT"), ("123", None, "123", None), ("99213", "TYPE", "99213", "CPT"),
]


def test_normalize(spark):
    df = spark.createDataFrame([(i, a, b, "clash") for i, (a, b, *_) in enumerate(CASES)], "i int, code string, code_type string, description string")
    got = [(r.code, r.code_type) for r in C.normalize(df).orderBy("i").collect()]
    assert got == [(c, d) for *_, c, d in CASES]
    assert C.normalize(df).filter("code_type = 'CPT'").count() == sum(d == "CPT" for *_, d in CASES)


def test_codes(spark):
    df = spark.createDataFrame([("1", "12", None), ("x", "C1887", None), ("0.12", "MS-DRG", None), ("x", "two words", None), ("99213", "CPT", None)], "c string, t string, d string")
    assert [r.x for r in df.select(C.rejection(F.col("c"), F.col("t")).alias("x")).collect()] == ["numeric_code_type", "malformed_code_type", "ms_drg_decimal", "malformed_code_type", None]
    one = lambda f: spark.range(1).select(f.alias("s")).first().s
    assert tuple(one(C.baked_modifier(F.lit("73721TC"), F.lit("CDM")))) == ("73721", "CPT", "TC")
    assert tuple(one(C.baked_modifier(F.lit("73721TC"), F.lit("CPT")))) == ("73721TC", "CPT", None)
    assert tuple(one(C.billing_class(F.lit("A19325"), F.lit("HCPCS"), F.lit(None).cast("string"), F.lit("")))) == ("facility", "19325", "CPT")
    assert one(V.merge_modifier(F.lit("LT, 59"), F.lit("TC"))) == "LT,59,TC"
    assert one(V.merge_modifier(F.lit("LT, 59"), F.lit(None).cast("string"))) == "LT, 59"


def test_headers(spark):
    assert column(spark, H.normalize_header, ['"Gross - Charge "', "standard_charge|gross", "“x y”", "", None]) == ["gross_charge", "standard_chargegross", "x_y", "", None]
    assert column(spark, H.canonical, ["code|1", "code | 2 | Type", "standard_charge | min", "Payer", "odd", "", "standard_charge|A|B|c"]) == ["code", "code_type", "min_negotiated_rate", "payer_name", None, None, None]
    got = column(spark, H.wide_payer, ["standard_charge|Aetna|PPO|Gold|negotiated_dollar", "standard_charge||Aetna|methodology", "count|X", "code|1", "standard_charge|gross"])
    assert [g and tuple(g) for g in got] == [("Aetna", "PPO - Gold", "negotiated_rate"), ("Aetna", "", "methodology"), ("X", "", "claim_count"), None, None]
    assert column(spark, H.low_value, ["column12", "code4", "price", None]) == [True, True, False, True]


def test_payers(spark):
    assert column(spark, P.is_self_pay, ["30% Cash", "[Self Pay]", "BlueCash PPO", None, ""]) == [True, True, False, False, False]
    assert column(spark, P.match_key, ["Buckeye Health Plans, Inc.", None]) == ["BUCKEYE HEALTH PLAN INC", ""]
    got = column(spark, P.plan_class, ["Commercial HMO", "NON-HMO", "medicaid x", "", None, "Zed"])
    assert [tuple(g) for g in got] == [("Commercial", "HMO", "Commercial HMO"), ("Commercial", None, "Commercial"), ("Medicaid", None, "Medi-Cal"), ("Other", None, "Other"), ("Other", None, "Other"), ("Other", None, "Zed")]
    names = spark.createDataFrame([("aetna ppo",), ("AETNA PPO",), ("Cash",), ("12%",), (None,), ("Zed Plans",), ("zed plan",)], "raw string")
    dic = spark.createDataFrame([("AETNA", "Aetna")], "key string, canonical string")
    assert [r.payer_name for r in P.resolve(names, "raw", dic).orderBy("raw").collect()] == [None, None, "Aetna", None, "Zed Plan", "Aetna", "Zed Plan"]
    more = spark.createDataFrame([("WC Zenith",), ("TUH Aetna HMO 1234",), ("Beech Street - ALL OTHER PLANS",), ("40% Acme",), ("Imagine 360",), ("Generic HMO",), ("PPO",)], "raw string")
    got = {r.raw: (r.payer_name, r.plan_hint) for r in P.resolve(more, "raw", dic).collect()}
    assert got == {
        "WC Zenith": ("Zenith", "Workers Comp"), "TUH Aetna HMO 1234": ("Aetna", "HMO"), "Beech Street - ALL OTHER PLANS": ("Beech Street", "ALL OTHER PLANS"), "40% Acme": ("Acme", None),
        "Imagine 360": ("Imagine 360", None), "Generic HMO": (None, None), "PPO": ("Ppo", None),
    }
    assert [p.plan_name for p in column(spark, P.plan_class, ["MGMCR", "Molinamgdmcaid", "Corvelwc"])] == ["Medicare Advantage", "Medi-Cal Managed Care", "Workers Comp"]


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=12))
def test_strip_is_total(text):
    assert isinstance(text.strip(), str)


@pytest.mark.parametrize("bad", [None, ""])
def test_nulls(spark, bad):
    for f in (V.safe_float, V.safe_count, V.ein, V.first_npi, V.methodology_type):
        assert column(spark, f, [bad]) == [None]


def test_addresses_and_file_names(spark):
    got = column(spark, V.address_parts, ["170 Alameda, Redwood City, CA 94062", "1001 A AVE, SAN FRANCISCO, CALIFORNIA 94110-3518", "4601 DALE RD MODESTO 95356 CA", "MS 38827 | 351 Peoples Dr, Pontotoc", "123 Main St", "9 Calle Uno, San Juan, Puerto Rico 00901", "", None])
    assert [g and tuple(g) for g in got] == [
        ("170 Alameda", "Redwood City", "CA", "94062"), ("1001 A AVE", "SAN FRANCISCO", "CA", "94110-3518"), ("4601 DALE RD MODESTO", None, "CA", "95356"),
        ("351 Peoples Dr", "Pontotoc", "MS", "38827"), ("123 Main St", None, None, None), ("9 Calle Uno", "San Juan", "PR", "00901"), None, None,
    ]
    got = column(spark, V.file_ids, ["68-0396600-1801821376_John_standardcharges.zip", "subset_946174066_x.json.gz", "plain.csv", None])
    assert [g and tuple(g) for g in got] == [("680396600", "1801821376"), ("946174066", None), (None, None), (None, None)]


def test_split_modifiers(spark):
    rows = [(1, "73721TC", "CDM", "MRI knee"), (2, "7372126", "CDM", "MRI KNEE WO contrast"), (3, "7372126", None, "Other"), (4, "4954052", "LOCAL", "azithromycin tab"), (5, "A4253QW", None, None), (6, "73721TC", "CPT", None), (7, None, None, None), (8, "02573ZZ", None, None)]
    df = spark.createDataFrame(rows, "i int, code string, code_type string, description string")
    validity = spark.createDataFrame([("73721", "26")], "code string, modifier string")
    texts = spark.createDataFrame([("73721", "MRI joint knee without contrast")], "code string, description string")
    known = spark.createDataFrame([("CPT", "73721")], "code_type string, code string")
    got = lambda **k: {r.i: (r.code, r.code_type, r.baked) for r in C.split_modifiers(df, **k).collect() if r.baked}
    assert got() == {1: ("73721", "CPT", "TC"), 5: ("A4253", "HCPCS", "QW")}
    assert got(validity=validity) == {1: ("73721", "CPT", "TC"), 2: ("73721", "CPT", "26"), 3: ("73721", "CPT", "26"), 5: ("A4253", "HCPCS", "QW")}
    assert got(validity=validity, descriptions=texts, published=known) == {1: ("73721", "CPT", "TC"), 2: ("73721", "CPT", "26")}
