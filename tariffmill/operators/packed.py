"""Split cells that pack several values (problem 2).

A parsing expression grammar is applied to every cell; alternatives are tried in order and a failed
one backtracks to its start:

    cell    <- sep* (value sep+)* value? END
    value   <- quoted / bracketed / loose / bare
    quoted  <- Q (QQ / !Q .)* Q &(blank* (hard / closer / END))     Q is " or '
    bracketed <- '[' cell ']' &(blank* (hard / closer / END))
    loose   <- (quote or bracket that failed above) (!hard .)*      flagged malformed
    bare    <- (!sep .)+
    sep     <- blank* hard blank* / blank+ word blank+ / blank+
    hard    <- , ; | / + & newline tab

Defined results: a null cell gives null; an empty cell or one of separators only gives an empty array;
repeats are kept; very long cells are parsed in one pass without recursion on their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HARD = frozenset(",;|/+&\t\n\r")
BLANK = frozenset("   ​﻿")
QUOTES = frozenset("\"'")
OPEN, CLOSE = "[", "]"
WORDS = ("and",)

VALUES_TYPE = "array<struct<pos:int,val:string,flag:string>>"

#: Cells without any of these hold one bare value, so they never need the grammar.
MAY_PACK = r"[,;|/+&\s  \"'\[\]]"


class CellGrammar:
    """The grammar above; hard separators and joining words are parameters."""

    def __init__(self, hard: frozenset[str] = HARD, words: tuple[str, ...] = WORDS) -> None:
        self.hard, self.words = hard, words

    def parse(self, text: str) -> list[tuple[str, str]]:
        """(value, flag) in order; flag is '' or says which alternative had to give way."""
        out, end = self._cell(text, 0, None)
        while end < len(text):  # a stray closing bracket ends an inner cell early: go on behind it
            more, end = self._cell(text, end + 1, None)
            out += [(v, f or "stray_bracket") for v, f in more]
        return out

    def _cell(self, s: str, i: int, closer: str | None) -> tuple[list[tuple[str, str]], int]:
        out: list[tuple[str, str]] = []
        while True:
            i = self._skip(s, i)
            if i >= len(s) or s[i] == CLOSE:
                return out, i
            hit = self._quoted(s, i) or (closer is None and self._bracketed(s, i)) or None
            if hit:
                values, i = hit
                out += values
                continue
            stop = self._until(s, i, s[i] in QUOTES or s[i] == OPEN, closer)
            loose = s[i] in QUOTES or s[i] == OPEN
            raw = s[i:stop]
            val = raw.strip("\"'[]  \t")
            if val:
                flag = "malformed_quote" if loose and s[i] in QUOTES else "malformed_bracket" if loose else "stray_quote" if val != raw.strip() else ""
                out.append((val, flag))
            i = max(stop, i + 1)

    def _skip(self, s: str, i: int) -> int:
        while i < len(s):
            if s[i] in self.hard or s[i] in BLANK or s[i].isspace():
                i += 1
                continue
            word = next((w for w in self.words if s[i : i + len(w)].lower() == w), None)
            if word and i and s[i - 1].isspace() and s[i + len(word) : i + len(word) + 1].isspace():
                i += len(word)
                continue
            break
        return i

    def _closed(self, s: str, i: int) -> bool:
        while i < len(s) and (s[i] in BLANK or s[i].isspace()) and s[i] not in self.hard:
            i += 1
        if i >= len(s) or s[i] in self.hard or s[i] == CLOSE or s[i] in QUOTES or s[i] == OPEN:
            return True
        return s[i - 1].isspace()

    def _quoted(self, s: str, i: int) -> tuple[list[tuple[str, str]], int] | None:
        q = s[i]
        if q not in QUOTES:
            return None
        j, part = i + 1, []
        while j < len(s):
            if s[j] == q:
                if s[j + 1 : j + 2] == q:
                    part.append(q)
                    j += 2
                    continue
                if not self._closed(s, j + 1):
                    return None
                val = "".join(part).strip()
                return ([(val, "")] if val else []), j + 1
            part.append(s[j])
            j += 1
        return None

    def _bracketed(self, s: str, i: int) -> tuple[list[tuple[str, str]], int] | None:
        if s[i] != OPEN:
            return None
        out, j = self._cell(s, i + 1, CLOSE)
        if j < len(s) and s[j] == CLOSE and self._closed(s, j + 1):
            return out, j + 1
        return None

    def _until(self, s: str, i: int, loose: bool, closer: str | None) -> int:
        j = i
        while j < len(s) and s[j] not in self.hard:
            if not loose and (s[j] in BLANK or s[j].isspace()):
                break
            if s[j] == CLOSE and (closer or not loose) and j > i:
                break
            j += 1
        return j


def split_cells(grammar: CellGrammar | None = None):
    """Arrow UDF: cell -> array of (pos, val, flag). Equal cells of a batch are parsed once."""
    g = grammar or CellGrammar()

    @F.pandas_udf(VALUES_TYPE)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for cells in batches:
            known = {c: [{"pos": k, "val": v, "flag": f} for k, (v, f) in enumerate(g.parse(c), 1)] for c in cells.dropna().unique()}
            yield cells.map(lambda c: None if c is None or c != c else known[c])

    return parse


def unpack(df: DataFrame, row_id: str, field: str, table_name: str | None = None, least: int = 1, grammar: CellGrammar | None = None) -> DataFrame:
    """One row per value of df[field]: (table_name, row_id, pos, val, flag).

    least=2 keeps packed cells only; such cells hold a separator, quote or bracket, so the others stay in
    the JVM. There is no shuffle: each row is worked on where it was read.
    """
    cell = F.col(field)
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), cell.alias("cell")).filter(cell.isNotNull())
    packed = rows.filter(F.col("cell").rlike(MAY_PACK)) if least > 1 else rows
    values = packed.withColumn("values", split_cells(grammar)("cell")).filter(F.size("values") >= least)
    out = values.select("row_id", F.inline("values"))
    name: Column = F.lit(table_name if table_name is not None else field)
    return out.select(name.alias("table_name"), "row_id", "pos", "val", "flag")
