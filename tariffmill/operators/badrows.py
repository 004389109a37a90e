"""Separate rows that fail to parse, with the reason (problem 5).

A line is parsed at minimum cost by dynamic programming over (column, quote state): reading it as it stands is
free, inserting or deleting a quote or a delimiter costs. A quote edit outweighs any number of delimiter edits, so
the cheapest script holds a quote edit only if the quoting itself is broken. Free and type-valid rows load; for the
others the edits state the reason:

    quoting        the cheapest script edits a quote
    column_count   it edits delimiters only
    invalid_value  it is free, but a typed cell has no valid value

Cells that a loader has stored are parsed the same way, as lines of one column in which a quote has no meaning (code, code_type)
or may only stand around the whole (values). Typed cells are then aligned with the columns of a line: a cell that has no
value of its own column but one of another costs the delimiters between the two.

Rows that are plainly free (no opening quote, right number of cells, valid cells) are recognised by JVM
expressions; only the rest reach Python. Nothing here shuffles but the delimiter lookup.

Defined results: a null or empty line is one empty cell (column_count); null cells of tables are sound as stated in
the checks; very long lines cost time in proportion to their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code shapes of each vocabulary.
CODE_SHAPES = {
    "CPT": r"[0-9]{5}|[0-9]{4}[FTU]",
    "HCPCS": r"[A-CE-V][0-9]{4}",
    "CDT": r"D[0-9]{4}",
    "RC": r"[0-9]{3,4}",
    "NDC": r"[0-9]{11}|[0-9]{5}-[0-9]{4}-[0-9]{2}",
    "MS-DRG": r"[0-9]{3}",
    "CDM": r"[A-Za-z0-9-]{1,12}",
    "LOCAL": r"[A-Za-z0-9-]{1,12}",
}
ANY_CODE = "|".join(f"(?:{p})" for p in CODE_SHAPES.values())
PRICE = r"\$? ?-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?|\$?\.[0-9]+"
SETTINGS = ("inpatient", "outpatient", "both", "facility", "professional")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DELIMITERS = (",", "|", "\t", ";")
# ------------------------------------------------------------------

START, BARE, QUOTED, AFTER = range(4)
#: What a double quote may be: part of a CSV line, one pair around a whole value, nothing.
CSV, PAIR, NONE = range(3)


def min_cost_parse(line: str, delimiter: str, columns: int, quotes: int = CSV) -> tuple[list[str], list[str]]:
    """(cells, edits) of the cheapest reading of line as so many columns."""
    free = _free(line, delimiter, quotes)
    if free is not None and len(free) == columns:
        return free, []
    quote_cost = len(line) + columns + 2  # above all delimiter edits together
    last = columns - 1
    best: dict[tuple[int, int], int] = {(0, START): 0}
    trail: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []

    for ch in line:
        nxt: dict[tuple[int, int], int] = {}
        back: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}

        def go(src: tuple[int, int], dst: tuple[int, int], cost: int, act: str) -> None:
            if cost < nxt.get(dst, 1 << 60):
                nxt[dst], back[dst] = cost, (src, act)

        for (k, q), c in best.items():
            here = (k, q)
            if ch == delimiter:
                if q == QUOTED:
                    go(here, (k, QUOTED), c, "t")
                    if k < last:
                        go(here, (k + 1, START), c + quote_cost, "close+cell")
                elif quotes == CSV or q != AFTER:
                    if k < last:
                        go(here, (k + 1, START), c, "cell")
                    # in a line what follows still opens a cell: a quote there stays a quote
                    go(here, (k, START if quotes == CSV else BARE), c + 1, "delete delimiter")
                    if q == START and quotes == CSV:
                        go(here, (k, QUOTED), c + quote_cost, "open+t")
            elif ch == '"':
                if q == START and quotes != NONE:
                    go(here, (k, QUOTED), c, "open")
                if q == BARE and quotes == CSV:
                    go(here, (k, BARE), c, "t")
                elif q == QUOTED:
                    go(here, (k, AFTER), c, "close")
                elif q == AFTER and quotes == CSV:
                    go(here, (k, QUOTED), c, "escape")
                go(here, here, c + quote_cost, "delete quote")
            else:
                if q in (START, BARE):
                    go(here, (k, BARE), c, "t")
                    if q == START and quotes == CSV:
                        go(here, (k, QUOTED), c + quote_cost, "open+t")
                    if q == BARE and k < last:
                        go(here, (k + 1, BARE), c + 1, "insert delimiter+t")
                elif q == QUOTED:
                    go(here, (k, QUOTED), c, "t")
        best, _ = nxt, trail.append(back)

    end, cost = None, 1 << 60
    for (k, q), c in best.items():
        total = c + (last - k) + (quote_cost if q == QUOTED else 0)
        if total < cost:
            end, cost = (k, q), total
    assert end is not None
    acts, at = [], end
    for back in reversed(trail):
        at, act = back[at]
        acts.append(act)
    acts.reverse()
    cells, edits, cell = [], [], []
    for ch, act in zip(line, acts):
        if act in ("cell", "close+cell"):
            cells.append("".join(cell))
            cell = []
        elif act == "insert delimiter+t":
            cells.append("".join(cell))
            cell = [ch]
        elif act in ("t", "open+t", "escape"):
            cell.append(ch)
        if act in ("close+cell", "open+t"):
            edits.append("insert quote")
        elif act in ("delete quote", "delete delimiter"):
            edits.append(act)
        elif act == "insert delimiter+t":
            edits.append("insert delimiter")
    cells.append("".join(cell))
    if end[1] == QUOTED:
        edits.append("insert quote")
    edits += ["insert delimiter"] * (last - end[0])
    cells += [""] * (last - end[0])
    return cells, edits


def _free(line: str, delimiter: str, quotes: int = CSV) -> list[str] | None:
    """The reading without edits, whatever its number of cells; None if the quoting is broken."""
    if quotes != CSV:
        if quotes == PAIR and len(line) > 1 and line[0] == line[-1] == '"' and '"' not in line[1:-1]:
            return [line[1:-1]]
        return None if '"' in line else line.split(delimiter)
    cells, cell, q = [], [], START
    for ch in line:
        if q == QUOTED:
            if ch == '"':
                q = AFTER
            else:
                cell.append(ch)
        elif ch == delimiter:
            cells.append("".join(cell))
            cell, q = [], START
        elif ch == '"' and q in (START, AFTER):
            if q == AFTER:
                cell.append(ch)
            q = QUOTED
        elif q == AFTER:
            return None
        else:
            cell.append(ch)
            q = BARE
    if q == QUOTED:
        return None
    return [*cells, "".join(cell)]


def reason_of(edits: list[str]) -> str | None:
    if any(e.endswith("quote") for e in edits):
        return "quoting"
    return "column_count" if edits else None


def sound_code(code: str | None, kind: str | None) -> bool:
    code, kind = (code or "").strip() or None, (kind or "").strip() or None
    if kind is None:
        return code is None or bool(re.fullmatch(ANY_CODE, code))
    return code is not None and kind in CODE_SHAPES and bool(re.fullmatch(CODE_SHAPES[kind], code))


def _line(line: str | None, delimiter: str | None, columns: int) -> tuple[str | None, list[str], list[str]]:
    line = line or ""
    delimiter = delimiter or max(DELIMITERS, key=line.count)
    cells, edits = min_cost_parse(line, delimiter, columns)
    why = reason_of(edits)
    if why is None:
        prices = [x.strip() for x in cells[4:6]]
        if not sound_code(cells[0], cells[1]) or any(x and not re.fullmatch(PRICE, x) for x in prices):
            why = "invalid_value"
    return why, edits, cells


def _whole(cell: str, quotes: int) -> tuple[str, list[str]]:
    """(text, edits) of a stored cell read as one column, under the delimiter that needs most edits (quotes count above all)."""
    tried = [min_cost_parse(cell, d, 1, quotes) for d in DELIMITERS]
    cells, edits = max(tried, key=lambda t: (reason_of(t[1]) == "quoting", len(t[1])))
    return cells[0], edits


#: Columns of a line that typed cells are aligned with, in their order.
COLUMNS = ("code", "code_type", "description", "setting", "price")


def belongs(column: str, text: str) -> bool:
    """text is content that only this column would hold. Short free words and bare numbers may be local codes and tell nothing."""
    if column == "code":
        return bool(re.search("[0-9]", text) and re.fullmatch(ANY_CODE, text))
    if column == "code_type":
        return text in CODE_SHAPES and CODE_SHAPES[text] != CODE_SHAPES["LOCAL"]
    if column == "description":
        return bool(re.fullmatch(r"[A-Za-z'./-]+(?: +[A-Za-z0-9'./-]+)+", text) and re.search("[A-Za-z]{3}", text))
    return text.lower() in SETTINGS if column == "setting" else bool(re.fullmatch(PRICE, text))


def aligned(cells: list[str], others: list[tuple[str, ...]], valid: list[bool]) -> list[str]:
    """Edits of the cheapest alignment of the first cells of a line with its columns. A valid cell stays for nothing; another moves to
    a column whose content it is (of others) at one delimiter a column, else stays as an invalid value, which costs more."""
    edits: list[str] = []
    for i, cell in enumerate(cells):
        text = cell.strip()
        moves = [] if valid[i] or not text else [COLUMNS.index(c) - i for c in others[i] if belongs(c, text)]
        step = min(moves, key=abs, default=0)
        edits += ["insert delimiter" if step > 0 else "delete delimiter"] * abs(step)
    return edits


def _code_pair(code: str | None, kind: str | None) -> tuple[str | None, list[str], list[str]]:
    """code and code_type as the first two typed columns of a line."""
    read = [_whole(c or "", NONE) for c in (code, kind)]
    cells, edits = [c for c, _ in read], [e for _, es in read for e in es]
    if not edits:
        if sound_code(code, kind):
            return None, [], cells
        known = not cells[1].strip() or cells[1].strip() in CODE_SHAPES
        edits = aligned(cells, [("code_type", "setting", "description"), ("code", "setting", "price", "description")], [False, known])
    return (reason_of(edits) or "invalid_value"), edits, cells


def _cell(column: str | None, value: str | None) -> tuple[str | None, list[str], list[str]]:
    """One value of a named column; the separators of a line are delimiters, a comma or semicolon with a blank is text."""
    if value is None:
        return None, [], [""]
    _, edits = _whole(re.sub(r"[,;](?=\s)", " ", value), PAIR)
    if edits:
        return reason_of(edits), edits, [value]
    body = _free(value, "\0", PAIR)[0]
    return (None if sound_value(column, body.strip()) else "invalid_value"), [], [body]


def sound_value(column: str | None, value: str) -> bool:
    if column == "unit_qty":
        return bool(re.fullmatch(r"[0-9]+", value))
    if column == "cost_center":
        return bool(re.fullmatch(r"[0-9]{4,6}", value))
    if column == "effective_dt":
        return real_date(value)
    return True


def real_date(text: str) -> bool:
    """A real day written as 2025-03-04, 03/04/2025 or 04-Mar-2025."""
    if m := re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2})", text):
        y, mo, d = map(int, m.groups())
    elif m := re.fullmatch(r"([0-9]{2})/([0-9]{2})/([0-9]{4})", text):
        mo, d, y = map(int, m.groups())
    elif (m := re.fullmatch(r"([0-9]{2})-([A-Za-z]{3})-([0-9]{4})", text)) and m[2].lower() in MONTHS:
        d, mo, y = int(m[1]), MONTHS.index(m[2].lower()) + 1, int(m[3])
    else:
        return False
    try:
        date(y, mo, d)
    except ValueError:
        return False
    return True


VERDICT = "struct<reason:string,edits:array<string>,cells:array<string>>"


def _udf(judge, **fixed):
    @F.pandas_udf(VERDICT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            known: dict[tuple, tuple] = {}
            out = []
            for pair in zip((None if x is None or x != x else x for x in a), (None if x is None or x != x else x for x in b)):
                if pair not in known:
                    known[pair] = judge(*pair, **fixed)
                out.append(known[pair])
            yield pd.DataFrame(out, columns=["reason", "edits", "cells"])

    return run


def _matches(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z")


def plainly_sound_code(code: Column, kind: Column) -> Column:
    """JVM form of sound_code; never null."""
    code, kind = F.nullif(F.trim(code), F.lit("")), F.nullif(F.trim(kind), F.lit(""))
    typed = F.lit(False)
    for name, shape in CODE_SHAPES.items():
        typed = typed | ((kind == name) & _matches(code, shape))
    return F.coalesce(F.when(kind.isNull(), code.isNull() | _matches(code, ANY_CODE)).otherwise(typed), F.lit(False))


def judge_lines(rows: DataFrame, columns: int = 7, salts: int = 16, suspects: bool = False) -> DataFrame:
    """raw lines -> every row but the headers, with delimiter, reason (null: sound), edits and cells.

    The header of each file gives its delimiter. It is looked up over (file_id, salt): a file that holds a third of
    all lines is spread over so many partitions. A file without header takes each line's commonest delimiter.
    """
    counts = [F.length("line") - F.length(F.replace(F.col("line"), F.lit(d))) for d in DELIMITERS]
    most = F.greatest(*counts)
    chosen = F.lit(None).cast("string")
    for d, n in reversed(list(zip(DELIMITERS, counts))):
        chosen = F.when(n == most, F.lit(d)).otherwise(chosen)
    heads = rows.filter("line_no = 1").groupBy("file_id").agg(F.min_by(F.when(most > 0, chosen), "row_id").alias("delimiter"))
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    body = rows.filter("line_no <> 1 or line_no is null").select("row_id", "file_id", "line_no", "line")
    body = body.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    body = body.join(heads, ["file_id", "salt"], "left").drop("salt")
    cells = F.split("line", F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")), -1)
    plain = F.coalesce(~F.col("line").contains('"') & (F.size(cells) == columns), F.lit(False))
    plain = plain & plainly_sound_code(F.get(cells, F.lit(0)), F.get(cells, F.lit(1)))
    price = lambda k: F.coalesce(_matches(F.trim(F.get(cells, F.lit(k))), f"(?:{PRICE})?"), F.lit(False))
    body = body.withColumn("plain", plain & price(4) & price(5))
    return _judge(body, _udf(_line, columns=columns), "line", "delimiter", cells, suspects)


def judge_codes(items: DataFrame, suspects: bool = False) -> DataFrame:
    """Rows with code and code_type -> plus reason, edits, cells."""
    rows = items.withColumn("plain", plainly_sound_code(F.col("code"), F.col("code_type")))
    return _judge(rows, _udf(_code_pair), "code", "code_type", F.array("code", "code_type"), suspects)


def judge_values(cells: DataFrame, suspects: bool = False) -> DataFrame:
    """Rows with source_column and value -> plus reason, edits, cells."""
    v, col = F.col("value"), F.col("source_column")
    free = ~col.isin("unit_qty", "cost_center", "effective_dt") & _matches(v, r"[^\",;|\t]*")
    typed = ((col == "unit_qty") & _matches(v, "[0-9]+")) | ((col == "cost_center") & _matches(v, "[0-9]{4,6}"))
    rows = cells.withColumn("plain", v.isNull() | F.coalesce(free | typed, F.lit(False)))
    return _judge(rows, _udf(_cell), "source_column", "value", F.array("value"), suspects)


def _judge(rows: DataFrame, udf, a: str, b: str, plain_cells: Column, suspects: bool) -> DataFrame:
    """suspects: only the rows that no JVM expression passed. Else all rows; the UDF then sees nulls for the plain ones."""
    if suspects:
        rows = rows.filter(~F.col("plain")).withColumn("verdict", udf(F.col(a), F.col(b)))
    else:
        rows = rows.withColumn("verdict", udf(F.when(~F.col("plain"), F.col(a)), F.when(~F.col("plain"), F.col(b))))
    judged = ~F.col("plain")
    return rows.withColumns({
        "reason": F.when(judged, F.col("verdict.reason")),
        "edits": F.when(judged, F.col("verdict.edits")).otherwise(F.array().cast("array<string>")),
        "cells": F.when(judged, F.col("verdict.cells")).otherwise(plain_cells),
    }).drop("verdict", "plain")


def broken(judged: DataFrame, table_name: str, row_id: str) -> DataFrame:
    return judged.filter("reason is not null").select(F.lit(table_name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), "reason")


def sound(judged: DataFrame) -> DataFrame:
    return judged.filter("reason is null").drop("reason", "edits")
