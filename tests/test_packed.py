from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tariffmill.operators.packed import CellGrammar, unpack

G = CellGrammar()


def vals(text):
    return [v for v, _ in G.parse(text)]


def test_forms():
    assert vals("25,59; GP") == ["25", "59", "GP"]
    assert vals('231|"grp 40, ext"|42') == ["231", "grp 40, ext", "42"]
    assert vals("['133','grp 10 west']") == ["133", "grp 10 west"]
    assert vals('["76", "77"]') == ["76", "77"]
    assert vals("76 and QW and 59") == ["76", "QW", "59"]
    assert vals(",25,25,25,") == ["25"] * 3
    assert vals("1\t2\n3  4") == ["1", "2", "3", "4"]
    assert vals("") == vals(" , ;") == []
    assert vals('"1163038125"') == ["1163038125"]


def test_malformed_quotes_backtrack_and_are_flagged():
    assert G.parse('"50,KX') == [("50", "malformed_quote"), ("KX", "")]
    assert [v for v, _ in G.parse('"grp 1|7')] == ["grp 1", "7"]
    assert vals("[1,2") == ["1", "2"]
    assert vals("1],2") == ["1", "2"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.from_regex(r"[A-Z0-9]{1,5}( [a-z]{2,4})?(, [a-z]{1,3})?", fullmatch=True), min_size=1, max_size=6), st.sampled_from(list(",;|")), st.booleans())
def test_round_trip(values, sep, bracket):
    text = sep.join(f'"{v}"' for v in values)
    assert vals(f"[{text}]" if bracket else text) == values


def test_unpack(spark):
    rows = [(1, "25,59", "x"), (2, "25", "x"), (3, None, None), (4, "", "x"), (5, '"a"|"b"|"b"', None), (6, "x," * 20000, "x")]
    df = spark.createDataFrame(rows, "id long, cell string, pos string")  # a column whose name clashes with the output
    got = unpack(df, "id", "cell", "t", least=2)
    assert got.filter("row_id = 5").orderBy("pos").select("pos", "val").collect() == [(1, "a"), (2, "b"), (3, "b")]
    assert {r.row_id: r.n for r in got.groupBy("row_id").agg(F.count("*").alias("n")).collect()} == {1: 2, 5: 3, 6: 20000}
    assert unpack(df.limit(0), "id", "cell").count() == 0


def test_partitioning_does_not_matter(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(",;|").join(str(rnd.randint(0, 9)) for _ in range(rnd.randint(1, 4)))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, cell string")
    assert sorted(unpack(df.repartition(1), "id", "cell").collect()) == sorted(unpack(df.repartition(7), "id", "cell").collect())
