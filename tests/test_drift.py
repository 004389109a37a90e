from __future__ import annotations

from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from tariffmill.operators import drift as D

MAP = "mapping_id long, file_id long, ord int, source_header string, normalized string, mapped_to string, value_type string"
FILES = "file_id long, hospital_id long, file_seq int"


def mapping(rows):
    return [(i, *r) for i, r in enumerate(rows)]


def test_changes(spark):
    rows = mapping([
        (1, 1, "Gross Charge", "gross_charge", "gross_charge", "double"), (1, 2, "setting", "setting", "setting", "string"), (1, 3, "dept", "dept_x", None, "string"), (1, 4, "qty", "qty", None, None),
        (1, 1, "Gross Charge", "gross_charge", "gross_charge", "double"),  # repeated
        (2, 1, '"GROSS CHARGE"', "gross_charge", "gross_charge", "double"), (2, 2, "care", "care_setting", "setting", "bigint"), (2, 4, "qty", "qty", None, "bigint"), (2, 5, "new", "brand_new_thing", None, "string"),
        (4, 1, "grs_amt", "grs_amt", None, "double"), (4, 2, "care", "care_setting", "setting", "bigint"), (4, 3, "new", "brand_new_thing", None, "string"),
    ])
    files = [(1, 9, 1), (2, 9, 3), (4, 9, 7), (4, 9, 7), (5, 8, 1)]
    got = {tuple(r)[0:4] for r in D.changes(spark.createDataFrame(rows, MAP), spark.createDataFrame(files, FILES)).collect()}
    assert got == {
        (2, "removed", "dept", ""), (2, "added", "", "new"), (2, "renamed", "setting", "care"), (2, "retyped", "setting", "care"),
        (4, "removed", "qty", ""), (4, "renamed", '"GROSS CHARGE"', "grs_amt"),
    }
    assert D.changes(spark.createDataFrame([], MAP), spark.createDataFrame([], FILES)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.randoms())
def test_assignment_is_best(n, m, rnd):
    w = [[rnd.randint(0, 9) / 10 for _ in range(m)] for _ in range(n)]
    got = sum(w[i][j] for i, j in D.assign(w))
    small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
    best = max(sum(w[i][j] if n <= m else w[j][i] for i, j in zip(small, p)) for p in permutations(large, len(small)))
    assert abs(got - best) < 1e-9


def test_previous_files_in_spans(spark):
    files = [(i, i % 3, (i * 37) % 1000 * 5) for i in range(300)]
    df = spark.createDataFrame(files, FILES)
    got = {r.file_id: r.prev_id for r in D.previous_files(df, span=100).collect()}
    for f, h, s in files:
        before = [(s2, f2) for f2, h2, s2 in files if h2 == h and (s2, f2) < (s, f)]
        assert got[f] == (max(before)[1] if before else None)


def test_unified(spark):
    rows = mapping([(1, 1, "a", "gross", "gross_charge", "double"), (2, 1, "b", "grs", "gross_charge", "bigint"), (2, 2, "c", "odd", None, None)])
    got = {r.column_name: (r.value_type, r.names) for r in D.unified(spark.createDataFrame(rows, MAP)).collect()}
    assert got == {"gross_charge": ("double", 2), "odd": ("string", 1)}


def test_payer_columns_and_parts(spark):
    h = "Standard Charge|Aetna{}|Gold Plan{}|negotiated_dollar"
    rows = mapping([
        (1, 1, h.format("", ""), "a1", "wide_payer:negotiated_rate", "double"), (1, 2, "standard_charge|Cigna|PPO|methodology", "a2", "wide_payer:methodology", "string"), (1, 3, "standard_charge|Zed|PPO|methodology", "a3", "wide_payer:methodology", "string"),
        (2, 1, h.format("h", ""), "b1", "wide_payer:negotiated_rate", "double"), (2, 2, "standard_charge|CIGNA|P.P.O.|methodology", "b2", "wide_payer:methodology", "string"), (2, 3, "standard_charge|Other|PPO|methodology", "b3", None, "string"),
    ])
    got = {tuple(r)[1:] for r in D.changes(spark.createDataFrame(rows, MAP), spark.createDataFrame([(1, 9, 1), (2, 9, 2)], FILES)).collect()}
    assert got == {
        ("renamed", rows[0][3], rows[3][3]), ("renamed", rows[1][3], rows[4][3]), ("removed", rows[2][3], ""), ("added", "", rows[5][3]),
    }


def test_match_file_by_parts():
    assert set(D.match_file([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.8), ("c", "z", 0.5)])) == {("a", "y"), ("b", "x"), ("c", "z")}
    assert D.match_file([]) == []


def test_sketches_learn_a_field_without_words(spark):
    """low_x is never recognized; it comes where minimum goes, and stands beside everything else."""
    rows, files = [], []
    for f in range(40):
        low = f % 2
        files.append((f, f // 2, f % 2))
        rows += [(f, 1, "min" if not low else "low", "minimum" if not low else "low_x", "min_negotiated_rate" if not low else None, "double"), (f, 2, "max", "maximum", "max_negotiated_rate", "double"), (f, 3, "note", "dept" if f % 3 else "dept_b", None, "string")]
    got = {(r.old_header, r.new_header) for r in D.changes(spark.createDataFrame(mapping(rows), MAP), spark.createDataFrame(files, FILES)).collect() if r.change == "renamed"}
    assert ("min", "low") in got


def test_unified_follows_the_matching(spark):
    """A name never recognized is the column that it was renamed from, also by way of another such name; a misspelt payer is the payer;
    columns that stand side by side stay apart."""
    paid = "standard_charge|{}|PPO|negotiated_dollar"
    rows, files = [], []
    for f in range(60):
        s, k = divmod(f, 3)
        files.append((f, s, k))
        first = [("gross", "gross_charge", "gross_charge"), ("grs_chg", "grs_chg", None), ("chg_grs", "chg_grs", None)][k if s % 2 else 0]
        rows += [(f, 1, *first, "double"), (f, 2, "qty", "qty", None, "bigint"), (f, 3, "dept", "dept_name", None, "string")]
        rows.append((f, 4, h := paid.format("Aetna" if k < 2 else "Aetnah"), h.replace("|", "").lower(), "wide_payer:negotiated_rate", "double"))
        rows += [(f, 5 + i, h := paid.format(f"Gold {i}"), h.replace("|", "").lower(), "wide_payer:negotiated_rate", "double") for i in ((1, 2) if s else (1 + k % 2,))]
    got = {r.column_name: (r.files, r.names) for r in D.unified(spark.createDataFrame(mapping(rows), MAP), spark.createDataFrame(files, FILES)).collect()}
    payer = lambda p: f"standardcharge|{p}|ppo|negotiateddollar"
    assert got == {"gross_charge": (60, 3), "qty": (60, 1), "dept_name": (60, 1), payer("aetna"): (60, 2), payer("gold1"): (59, 1), payer("gold2"): (58, 1)}
    apart = D.unified(spark.createDataFrame(mapping(rows), MAP), spark.createDataFrame([], FILES))
    assert {r.column_name for r in apart.collect()} == {*got, "grs_chg", "chg_grs", payer("aetnah")}
