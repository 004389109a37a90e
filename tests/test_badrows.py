from __future__ import annotations

import csv
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tariffmill.operators import badrows as B

SOUND = '12345,CPT,"ANKLE, LEFT",both,"$1,054.76",613.04,called "lite"'


@pytest.mark.parametrize(
    ("line", "why"),
    [
        (SOUND, None),
        ('"99213","CPT","2"" x 3""","both","1","2",""', None),
        ('67532,CPT,"NECK "A" THERAPY",,$51.35,77.34,"bundled, see file"', "quoting"),
        ('Q8066,HCPCS,FOOT,,903.30,$20.84,"call first', "quoting"),
        ('"8665T" -,CPT,ABDOMEN,,40,$238.59,x', "quoting"),
        ("74072,CPT,WRIST, RIGHT,inpatient,224.64,276.07,x", "column_count"),
        ("0199,RC", "column_count"),
        ("", "column_count"),
        (None, "column_count"),
        ("1234,CPT,X,both,1,2,", "invalid_value"),
        ("12345,CPT,X,both,see note,2,", "invalid_value"),
        ("12345,XYZ,X,both,1,2,", "invalid_value"),
        (",,X,both,1,2,", None),
    ],
)
def test_lines(line, why):
    assert B._line(line, ",", 7)[0] == why


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='ab,"| ', max_size=14), st.integers(1, 4))
def test_free_parse_costs_nothing_and_repairs_fit(line, n):
    cells, edits = B.min_cost_parse(line, ",", n)
    assert len(cells) == n
    free = B._free(line, ",")
    assert (edits == []) == (free is not None and len(free) == n)
    if free is not None:  # sound quoting is never repaired by quotes
        assert not any(e.endswith("quote") for e in edits)
        assert abs(len(free) - n) <= len(edits)
    else:
        assert any(e.endswith("quote") for e in edits)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet='ab,"x', max_size=5), min_size=1, max_size=4))
def test_agrees_with_the_csv_writer(cells):
    import io

    out = io.StringIO()
    csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow(cells)
    assert B.min_cost_parse(out.getvalue(), ",", len(cells)) == (cells, [])


def test_codes_and_values():
    assert B._code_pair("12345", "CPT")[0] is None
    assert B._code_pair(" 12345 ", "CPT")[0] is None
    assert B._code_pair(None, None)[0] is None
    assert B._code_pair("12345", None)[0] is None
    assert B._code_pair('"12345', "CPT")[0] == "quoting"
    assert B._code_pair("55985\tCPT\tHIP", None)[0] == "column_count"
    assert B._code_pair("ABDOMEN THERAPY 43 MIN", "876")[0] == "column_count"
    assert B._code_pair("inpatient", "12.50")[0] == "column_count"
    assert B._code_pair("1234", "CPT")[0] == "invalid_value"
    assert B._code_pair("X1998082", "C P T")[0] == "invalid_value"
    for column, value, why in [
        ("unit_qty", "12", None), ("unit_qty", '"12"', None), ("unit_qty", "1O", "invalid_value"), ("unit_qty", "5\t100", "column_count"), ("unit_qty", '1"', "quoting"),
        ("effective_dt", "29-Feb-2024", None), ("effective_dt", "2025-02-30", "invalid_value"), ("effective_dt", "13/45/2025", "invalid_value"), ("cost_center", "123", "invalid_value"),
        ("dept_name", "Radiology, East", None), ("dept_name", '"Radiology, East"', None), ("dept_name", "Lab,10", "column_count"), ("dept_name", '"Lab" east', "quoting"), ("dept_name", None, None),
    ]:
        assert B._cell(column, value)[0] == why, (column, value)


def test_jvm_and_python_agree(spark):
    lines = [(i, 1 + i % 3, 2 + i, x) for i, x in enumerate([SOUND, "1,2", None, "", "12345|CPT|x|both|1|2|", '"a"b,c', SOUND])]
    heads = [(100 + f, f, 1, d.join(["code", "code_type", "d", "s", "g", "c", "n"])) for f, d in ((1, ","), (2, ","), (3, "|"))]
    df = spark.createDataFrame(lines + heads, "row_id long, file_id long, line_no int, line string")
    delim = {1: ",", 2: ",", 3: "|"}
    want = {r[0]: B._line(r[3], delim[r[1]], 7)[0] for r in lines}
    assert {r.row_id: r.reason for r in B.judge_lines(df).collect()} == want
    only = {r.row_id: r.reason for r in B.judge_lines(df, suspects=True).collect()}
    assert {k: v for k, v in only.items() if v} == {k: v for k, v in want.items() if v}
    assert B.judge_lines(df.limit(0)).count() == 0
    assert B.sound(B.judge_lines(df)).count() == sum(v is None for v in want.values())


@pytest.mark.parametrize(("code", "kind", "why", "edits"), [
    ("99213", "CPT", None, []), ('"99213"', "CPT", "quoting", ["delete quote"] * 2), ("99213,CPT", None, "column_count", ["delete delimiter"]), ('9"9213', "CPT", "quoting", ["delete quote"]),
    ("CPT", "99213", "column_count", ["insert delimiter", "delete delimiter"]), ("knee mri", "CPT", "column_count", ["insert delimiter"] * 2), ("99213", "outpatient", "column_count", ["insert delimiter"] * 2),
    ("99213", "12.50", "column_count", ["insert delimiter"] * 3), ("9921", "CPT", "invalid_value", []), ("", "CPT", "invalid_value", []), (None, None, None, []), ("99213", "ODD", "invalid_value", []),
])
def test_code_pairs_by_edits(code, kind, why, edits):
    assert B._code_pair(code, kind)[:2] == (why, edits)


@pytest.mark.parametrize(("value", "why"), [('"a, b"', None), ('"a|b"', None), ("a|b", "column_count"), ('a"b', "quoting"), ('"a""b"', "quoting"), ('a,"b"', "quoting"), ('"a",b', "quoting"), ('"', "quoting"), ('""', None), ("a, b", None), (None, None), ("", None)])
def test_values_by_edits(value, why):
    got, edits, _ = B._cell("dept_name", value)
    assert got == why == B.reason_of(edits)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='a1", ', max_size=8), st.sampled_from([B.PAIR, B.NONE]))
def test_stored_cells_at_least_cost(text, quotes):
    """Brute force: the fewest signs to drop, quotes first, so that what is left is one column."""
    def sound(t):
        return not ("," in t and not (quotes == B.PAIR and len(t) > 1 and t[0] == t[-1] == '"')) and ('"' not in t or (quotes == B.PAIR and len(t) > 1 and t[0] == t[-1] == '"' and '"' not in t[1:-1]))

    edits = B.min_cost_parse(text, ",", 1, quotes)[1]
    marks = [i for i, c in enumerate(text) if c in '",']
    drops = [drop for r in range(len(marks) + 1) for drop in combinations(marks, r)]
    left = lambda drop: "".join(c for i, c in enumerate(text) if i not in drop)
    drops = [d for d in drops if left(d)[:1] != '"' or all(text[i] == '"' for i in d)]  # a pair stands around the whole value
    ways = [[text[i] for i in d] for d in drops if sound(left(d))] + [[*(text[i] for i in d), "+"] for d in drops if quotes == B.PAIR and sound(left(d) + '"')]  # or a quote at the end
    cost = lambda e: sum(100 if x != "," else 1 for x in e)
    assert cost(["," if e == "delete delimiter" else '"' for e in edits]) == min(map(cost, ways))
