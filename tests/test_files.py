from __future__ import annotations

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tariffmill.operators import ingest, nested, ordered, tic
from tariffmill.sources import decode, mrf
from tariffmill.sources.sinks import register_views, write_tables
from tariffmill.streaming import ingest as stream

TALL = "description,code|1,code|1|type,setting,payer_name,plan_name,standard_charge|gross,standard_charge|negotiated_dollar,odd\n"
WIDE = "hospital_name,last_updated_on,license_number|CA\nAcme,2026-01-01,L1\ndescription,code|1,code|1|type,code|2,code|2|type,standard_charge|gross,standard_charge|Aetna|PPO|negotiated_dollar,standard_charge|Self Pay||negotiated_dollar\n"


@pytest.fixture
def landing(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "tall.csv").write_text(TALL + 'MRI,70551,CPT,Outpatient,Cigna,HMO,"$1,000.00",450,x\nMRI,70551,CPT,Outpatient,Cash,,1000,300,-\n"6"" drain",A4,LOCAL,both,Zed,,,,y\nbad,1,12,,A,B,1,1,z\n')
    (d / "wide.csv.gz").write_bytes(gzip.compress((WIDE + "Visit,99213,CPT,301,RC,200,125,90\n").encode("utf-16")))
    item = {"description": "V", "code_information": [{"code": "301", "type": "RC"}, {"code": "99213", "type": "CPT"}], "standard_charges": [
        {"setting": "outpatient", "billing_class": "both", "gross_charge": 0, "discounted_cash": 150, "payers_information": [{"payer_name": "Aetna", "plan_name": "PPO", "standard_charge_dollar": 100}, {"payer_name": "Self Pay", "standard_charge_dollar": 140}]},
        {"setting": "outpatient", "billing_class": "both", "gross_charge": "200"},
    ]}
    text = json.dumps({"hospital_name": "H", "type_2_npi": ["1234567893"], "standard_charge_information": [item]})
    (d / "nested.json").write_text(text.replace("}]}]", "},]},,]").replace('"V"', '"V\t"'))
    with zipfile.ZipFile(d / "flat.zip", "w") as z:
        z.writestr("flat.json", json.dumps({"data": [{"description": "Lab", "code": "80053", "price": 5}, {"description": "Lab", "code": "80053", "price": 6, "late": 1}]}))
    g = {"npi": [1234567893, "x"], "tin": {"type": "ein", "value": "12-3"}}
    price = lambda v, **k: {"negotiated_type": "negotiated", "negotiated_rate": v, "billing_class": "professional", "expiration_date": "2026-1-5", "billing_code_modifier": ["59,25"], **k}
    (d / "innet.json").write_text(json.dumps({
        "reporting_entity_name": "E", "provider_references": [{"provider_group_id": 10, "network_name": ["Net A", "B"], "provider_groups": [g]}, {"provider_group_id": 9, "provider_groups": [g]}],
        "in_network": [{"billing_code": "99213", "billing_code_type": "CPT", "name": "secret", "negotiated_rates": [
            {"provider_references": [10, 77], "negotiated_prices": [price(1.5), price(2, billing_class="x")]}, {"provider_references": [9], "provider_groups": [g], "negotiated_prices": [price(1.5)]}]}],
    }))
    (d / "page.csv").write_text("<!DOCTYPE html><html></html>")
    (d / "empty.json").write_text("")
    return d


def test_tables(spark, landing, tmp_path):
    parts = stream.read_files(spark, f"{landing}/*")
    t = ingest.all_tables(parts)
    name = F.regexp_replace("file_id", "-[0-9a-f]+$", "").alias("file_id")
    rows = lambda n, *c: sorted(map(tuple, t[n].select(*(name if x == "file_id" else x for x in c)).collect()), key=str)
    assert rows("charge_items", "file_id", "code", "code_type", "billing_class") == sorted([
        ("flat.zip", "80053", "CPT", ""), ("nested.json", "99213", "CPT", "facility"), ("nested.json", "99213", "CPT", "professional"), ("tall.csv", "70551", "CPT", ""), ("tall.csv", "A4", "LOCAL", ""),
        ("wide.csv.gz", "0301", "RC", "facility"), ("wide.csv.gz", "99213", "CPT", ""),
    ], key=str)
    assert rows("payer_rates", "file_id", "code", "payer_name", "plan_name", "negotiated_rate") == sorted([
        ("nested.json", "99213", "Aetna", "Commercial PPO", 100.0), ("nested.json", "99213", "Aetna", "Commercial PPO", 100.0), ("tall.csv", "70551", "Cigna", "Commercial HMO", 450.0), ("tall.csv", "A4", "Zed", "Other", None),
        ("wide.csv.gz", "0301", "Aetna", "Commercial PPO", 125.0), ("wide.csv.gz", "99213", "Aetna", "Commercial PPO", 125.0),
    ], key=str)
    cash = {(r.file_id, r.code, r.gross_charge): r.discounted_cash_price for r in t["standard_charges"].withColumn("file_id", name).collect()}
    assert cash["nested.json", "99213", 200.0] == 140.0 and cash["wide.csv.gz", "99213", 200.0] == 90.0 and ("tall.csv", "70551", 1000.0) in cash
    assert rows("unmapped_cells", "file_id", "source_column", "value") == [("tall.csv", "odd", "x"), ("tall.csv", "odd", "y")]
    assert rows("rejected_codes", "file_id", "reason") == [("tall.csv", "numeric_code_type")]
    assert rows("file_metadata", "file_id", "hospital_name", "license_number", "license_state", "type_2_npi") == [("nested.json", "H", None, None, "1234567893"), ("wide.csv.gz", "Acme", "L1", "CA", None)]
    assert rows("tic_provider_groups", "group_id", "tin", "npis") == [("10", "123", "1234567893"), ("9", "123", "1234567893"), ("inline-1", "123", "1234567893")]
    assert rows("tic_rates", "billing_code", "negotiated_rate", "modifiers", "expiration_date", "provider_group_ids") == [("99213", 1.5, "25|59", "2026-01-05", "9|10|inline-1")]
    assert rows("tic_file_metadata", "file_id", "reporting_entity_name", "network_name") == [("innet.json", "E", "Net A")]
    faults = {(r.counter, r.key, r.n) for r in ingest.quality(parts, t["rejected_codes"]).collect() if r.counter == "skipped_prices"}
    assert faults == {("skipped_prices", "billing_class", 1)}
    q = {(r.file_id, r.counter) for r in ingest.quality(parts, t["rejected_codes"]).withColumn("file_id", name).collect()}
    assert {("page.csv", "file_error"), ("tall.csv", "rejected_codes"), ("tall.csv", "read")} <= q
    counts = write_tables(t, str(tmp_path / "out"), "parquet", by_file=True)
    again = write_tables(t, str(tmp_path / "out"), "parquet", by_file=True)
    assert counts == again and "tic_index" not in counts and counts["charge_items"] == 7
    with pytest.raises(ValueError):
        write_tables(t, str(tmp_path / "o"), "xls")
    register_views({"items": t["charge_items"]}, "v_")
    assert spark.sql("select count(*) as n from v_items").first().n == 7


def test_stream_is_idempotent(spark, landing, tmp_path):
    for f in landing.iterdir():
        if f.name not in ("tall.csv", "flat.zip"):
            f.unlink()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        stream.start(spark, str(landing), out, mark).awaitTermination()
        assert spark.read.parquet(f"{out}/charge_items").count() == 3
    (landing / "more.csv").write_text(TALL + "CT,70450,CPT,both,A,,1,2,\n")
    stream.start(spark, str(landing), out, mark).awaitTermination()
    assert spark.read.parquet(f"{out}/charge_items").count() == 4


def test_reload_that_lost_rows(spark, landing, tmp_path):
    out, one = str(tmp_path / "out"), landing / "tall.csv"
    for f in landing.iterdir():
        if f != one:
            f.unlink()
    (landing / "sub").mkdir()
    (landing / "sub" / "tall.csv").write_text(TALL + "CT,70450,CPT,both,A,,1,2,z\n")  # another file of the same name

    def load(path):
        parts = stream.read_files(spark, str(path))
        return write_tables(ingest.all_tables(parts), out, by_file=True, files=parts.select("file_id").distinct())

    load(one)
    assert load(landing / "sub" / "tall.csv")["charge_items"] == 1
    assert spark.read.parquet(f"{out}/charge_items").count() == 3 and spark.read.parquet(f"{out}/unmapped_cells").count() == 3
    one.write_text(TALL + "MRI,70551,CPT,both,,,1,,\n")
    assert "unmapped_cells" not in load(one)
    assert spark.read.parquet(f"{out}/charge_items").count() == 2 and spark.read.parquet(f"{out}/unmapped_cells").count() == 1


def test_line_ends():
    text = "a\x85b\u2028c\x0b\x0cd,1\r\ne\rf\n\ng"
    want = ["a\x85b\u2028c\x0b\x0cd,1\r\n", "e\r", "f\n", "\n", "g"]
    for size in range(1, len(text) + 1):
        assert list(decode.lines(text[i : i + size] for i in range(0, len(text), size))) == want
    assert list(decode.lines([])) == [] and list(decode.lines(["x\r"])) == ["x\r"]
    got = [tuple(c) for k, c, _ in mrf.csv_parts(iter(["description,code,type,setting\nknee\x85mri,73721,CPT,both\n"])) if k == "row"]
    assert got == [("knee\x85mri", "73721", "CPT", "both")]


def test_json_root(monkeypatch):
    def parts(doc, size=7):
        text = doc if isinstance(doc, str) else json.dumps(doc)
        return [(k, c, r) for k, c, r in mrf.json_parts(lambda: (text[i : i + size] for i in range(0, len(text), size)))]

    long = ["y" * 50_000] * 3
    got = parts({"hospital_address": long, "blob": {"x": "z" * 150_000}, "note": "n", "data": [{"a": 1}]}, 1 << 16)
    assert json.loads(got[1][2]) == {"hospital_address": long, "note": "n"} and got[0] == ("long_root", ["blob"], None) and got[2] == ("item", None, '{"a": 1}')
    for keys in (["other", "items", "data"], ["data", "other"], ["items", "standard_charge_information"]):
        best = next(k for k in decode.DATA_ARRAYS if k in keys)
        assert [json.loads(r)["from"] for k, _, r in parts({k: [{"from": k}] * 2 for k in keys}) if k == "item"] == [best] * 2
    assert [k for k, *_ in parts('[{"a":1}, {nope, {"b":2}]')] == ["item", "bad_item"]
    assert [k for k, *_ in parts('{"a": [1, 2]}')] == ["root"]


def test_values_of_any_size():
    big = {"s": 'q"\\' * 20_000, "l": [[{"x": [1, "]}"]}]] * 2000}
    text = json.dumps({"skip": big, "keep": big, "last": 1})
    for size in (3, 1000, 1 << 20):
        pull, seen = decode.Pull(text[i : i + size] for i in range(0, len(text), size)), {}
        for key in pull.members():
            raw = pull.value(keep=key != "skip")
            seen[key] = json.loads(raw) if raw else None
        assert seen == {"skip": None, "keep": big, "last": 1}


def test_command_line(landing, tmp_path, spark, monkeypatch):
    from tariffmill.__main__ import main

    assert main([str(tmp_path / "o"), str(landing / "tall.csv"), "--format", "csv"]) == 0
    assert main([str(tmp_path / "p"), str(landing / "page.csv")]) == 1
    assert (tmp_path / "o" / "charge_items").exists()


def test_decoding(tmp_path):
    assert "".join(decode.decoded([b"\xef\xbb\xbfa\xc3", b"\xa9\xff"])) == "aé�"
    assert "".join(decode.decoded(["é,x\n".encode("utf-16")])) == "é,x\n"
    assert json.loads(decode.clean('{"a": [1,,2,], "b": "x\\q\x01",}')) == {"a": [1, 2], "b": "x\\q"}
    assert decode.clean("{nope") is None
    assert decode.delimiter_of("a|b|c") == "|" and decode.delimiter_of("a\tb") == "\t" and decode.delimiter_of("x|A|b,y,z") == ","
    big = [{"k": "x" * 50, "n": i} for i in range(200)]
    text = json.dumps({"a": {"data": 1}, "data": big})
    for size in (1, 7, 1000):
        pull = decode.Pull(text[i : i + size] for i in range(0, len(text), size))
        for key in pull.members():
            if key == "data":
                assert [json.loads(x)["n"] for x in pull.items()] == list(range(200))
            else:
                assert json.loads(pull.value()) == {"data": 1}
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.csv", "x")
        z.writestr("b.csv", "x")
    with pytest.raises(decode.BadFile):
        decode.detect(str(tmp_path / "two.zip"))
    (tmp_path / "no-extension").write_text(' \n{"a":1}')
    assert decode.detect(str(tmp_path / "no-extension")) == ("json", None)


def test_ordered(spark):
    rows = [(k % 3, i, f"v{i}", "clash") for i, k in enumerate([0, 1, 2, 0, 1, 0, 0])]
    df = spark.createDataFrame(rows, "k int, i int, v string, _x string")
    for n in (1, 7):
        d = df.repartition(n)
        assert {(r.k, r.v) for r in ordered.first_wins(d, ["k"], ["i"]).collect()} == {(0, "v0"), (1, "v1"), (2, "v2")}
        assert ordered.capped(d, ["k"], ["i"], 2).count() == 5
        assert {r.i for r in ordered.before_boundary(d, ["k"], "i", F.col("i") == 3).collect()} == {0, 1, 2, 4}
        assert {(r.v, r.id) for r in ordered.first_seen_ids(d, ["k"], ["v"], ["i"]).filter("k = 1").collect()} == {("v1", "inline-1"), ("v4", "inline-2")}
    assert ordered.first_wins(df.limit(0), ["k"], ["i"]).count() == 0


def test_merge_prices_spreads_hot_keys(spark):
    df = spark.range(5000).select(F.lit("p").alias("price"), (F.col("id") % 700).cast("string").alias("g"))
    one = tic.merge_prices(df, ["price"], "g").collect()
    assert len(one) == 1 and one[0].provider_group_ids == "|".join(str(i) for i in range(700))


def test_flatten_edges(spark):
    docs = [(1, '{"description":"a"}'), (2, '{"code_information":[{"code":"1","type":"CDM"}]}'), (3, "nope"), (4, '{"standard_charges":[]}'), (5, None)]
    df = spark.createDataFrame([("f", i, d) for i, d in docs], "file_id string, ord long, raw string")
    assert [(r.ord, r.code) for r in nested.flatten(df).collect()] == [(2, "1")]


def test_flatten_spellings(spark):
    doc = {"code_information": [{"code": "1", "type": "CDM"}], "standard_charges": [{"setting": " Both ", "billing_class": "odd", "discounted_cash_price": "150", "min": 80, "max": "400", "modifier_code": [" 26", " "]}, {"setting": "x", "modifiers": "59"}]}
    got = nested.flatten(spark.createDataFrame([("f", 1, json.dumps(doc))], "file_id string, ord long, raw string")).orderBy("n").collect()
    assert [(r.billing_class, r.setting, r.modifiers, r.discounted_cash_price, r.min_negotiated_rate, r.max_negotiated_rate) for r in got] == [("", "both", "26", 150.0, 80.0, 400.0), ("", "x", "59", None, None, None)]
