"""Find and restore text decoded with the wrong character encoding (problem 3).

A code-page swap is read as a substitution cipher: every original letter outside ASCII turns into one fixed symbol, a
run of one or more foreign characters. Per source (a field), the mapping symbol -> letter is learnt by
expectation-maximization against bigrams of the source's own sound text:

    E  share of letter x in each occurrence of symbol u between l and r   ~  theta[u, x] * P(l, x, r)
    M  theta[u, x]                                                        ~  prior[u, x] + expected count

P(l, x, r) comes from the letters that stand alone between ASCII characters. The prior prefers what some known code
page would make of a letter (computed, single or double, also after a later change of case) and a letter for itself;
symbols of pages not listed start from all letters alike and are settled by the bigrams alone. A symbol whose best
letter is not itself is a garble; it is put back by translate(), symbols of several characters having been given one
private-use character each. U+FFFD has lost its bytes: such text is reported and not restored.

Work per row is a map over Arrow batches. What is learnt comes from counts of (symbol, left, right), pre-aggregated
over distinct texts, one EM per symbol on its executor. The learnt table (symbols, not texts) is sent to the executors
if it has at most BROADCAST_SYMBOLS rows, else it is joined.

Defined results: null and ASCII-only texts are sound; so are sources in which no symbol differs from itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code pages that text is commonly decoded with by mistake.
PAGES = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "cp1254", "iso8859-15", "koi8-r", "cp866")
FFFD = "�"
BROADCAST_SYMBOLS = 50_000
FOREIGN = r"[^\x00-\x7F]"
#: Prior weight of a sound letter for itself, above what a scarcer letter's contexts may lend to a commoner one.
SOUND = 1000.0
PRIVATE = 0xF0000  # first code point of a plane for private use


@cache
def letters() -> tuple[str, ...]:
    """What sound text may hold beside ASCII: the Latin letters and signs of Western pages, by rule."""
    latin = [chr(c) for c in range(0xA1, 0x180) if c != 0xAD and unicodedata.category(chr(c)) != "Cc"]
    typographic = [chr(c) for c in range(0x2010, 0x2040) if unicodedata.category(chr(c))[0] == "P"]
    return (*latin, *typographic, "€", "™", "−", "≤", "≥", " ")


def _misread(text: str, page: str) -> str | None:
    """text's UTF-8 bytes read as page; bytes the page lacks become the control characters of their number."""
    out = []
    for b in text.encode("utf-8"):
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@cache
def symbols() -> dict[str, dict[str, float]]:
    """symbol -> letter -> prior weight, for every letter under every page, once or twice, with later changes of case."""
    found: dict[str, dict[str, float]] = {}

    def add(symbol: str, letter: str, weight: float) -> None:
        if not symbol.isascii() and symbol != letter:
            known = found.setdefault(symbol, {})
            known[letter] = max(known.get(letter, 0.0), weight)

    for x in letters():
        likely = 1.0 if ord(x) < 0x100 or ord(x) > 0x2000 else 0.2
        for page in PAGES:
            once = _misread(x, page)
            tries = [(once, 1.0)] + [(_misread(once, p), 0.5) for p in (page, "cp1252", "latin-1")]
            for text, w in tries:
                for form, v in ((text, 1.0), (text.upper(), 0.15), (text.lower(), 0.15), (text.title(), 0.1)):
                    add(form, x if v == 1.0 or not x.isalpha() else (x.upper() if form == text.upper() else x), w * v * likely)
    return {s: c for s, c in found.items() if len(s) > 1}


def segment(run: str) -> list[str]:
    """Cut a run of foreign characters into symbols at least cost: a known symbol or a sound letter 1, anything else 2.5 as a whole."""
    known, sound = symbols(), _letter_set()
    if len(run) == 1:
        return [run]
    longest = _longest()
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, len(run) + 1):
        cands = [(best[i][0] + 1.0, i) for i in range(max(0, j - longest), j - 1) if run[i:j] in known]
        cands.append((best[j - 1][0] + (1.0 if run[j - 1] in sound else 2.0), j - 1))
        best.append(min(cands, key=lambda c: (c[0], c[1])))
    if best[-1][0] > 2.5 and not any(p in known for p in _cut(run, best)):
        return [run]
    return _cut(run, best)


def _cut(run: str, best: list[tuple[float, int]]) -> list[str]:
    out, j = [], len(run)
    while j:
        i = best[j][1]
        out.append(run[i:j])
        j = i
    return out[::-1]


@cache
def _letter_set() -> frozenset[str]:
    return frozenset(letters())


@cache
def _longest() -> int:
    return max(map(len, symbols()))


def runs(text: str) -> Iterator[tuple[int, int]]:
    start = None
    for i, ch in enumerate(text):
        if ch > "\x7f":
            if start is None:
                start = i
        elif start is not None:
            yield start, i
            start = None
    if start is not None:
        yield start, len(text)


def _class(ch: str) -> str:
    """The neighbour's class for the bigrams: the letter with its case, or one sign for digits, blanks, others, none."""
    if not ch:
        return "^"
    if ch.isalpha() and ch < "\x7f":
        return ch
    return "0" if ch.isdigit() else "_" if ch.isspace() else "~"


#: A small letter between capitals.
SUNK = re.compile(r"(?<=[A-Z])[à-öø-ÿ](?=[A-Z])|^[à-öø-ÿ](?=[A-Z]{2})")
CONTEXT = "symbol string, l string, r string, n long, alone boolean"


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts: dict[tuple, int] = {}
        for text, n in zip(pdf["text"], pdf["n"]):
            for i, j in runs(text):
                parts = segment(text[i:j])
                at = i
                for p in parts:
                    left = text[at - 1 : at] if at == i else "é"
                    right = text[at + len(p) : at + len(p) + 1]
                    key = (p, _class(left), _class(right), len(parts) == 1)
                    counts[key] = counts.get(key, 0) + int(n)
                    at += len(p)
        yield pd.DataFrame([(s, a, b, n, alone) for (s, a, b, alone), n in counts.items()], columns=["symbol", "l", "r", "n", "alone"])


def contexts(df: DataFrame, field: str) -> DataFrame:
    """(symbol, l, r, alone, n): how often each symbol stands between which neighbours, over all rows."""
    texts = df.filter(F.col(field).rlike(FOREIGN)).groupBy(F.col(field).alias("text")).agg(F.count("*").alias("n"))
    return texts.mapInPandas(_contexts, CONTEXT).groupBy("symbol", "l", "r", "alone").agg(F.sum("n").alias("n"))


def bigrams(ctx: DataFrame) -> dict[str, tuple[dict[str, int], dict[str, int], int]]:
    """letter -> (left counts, right counts, all) of sound letters standing alone. Bounded by the alphabet, not by the data."""
    sound = ctx.filter(F.col("alone") & (F.length("symbol") == 1) & F.col("symbol").isin(*letters()))
    lm: dict[str, tuple[dict[str, int], dict[str, int], int]] = {}
    for r in sound.groupBy("symbol", "l", "r").agg(F.sum("n").alias("n")).collect():
        left, right, n = lm.get(r.symbol, ({}, {}, 0))
        left[r.l] = left.get(r.l, 0) + r.n
        right[r.r] = right.get(r.r, 0) + r.n
        lm[r.symbol] = (left, right, n + r.n)
    return lm


def em(symbol: str, ctx: list[tuple[str, str, int]], lm: dict, rounds: int = 25, prior_weight: float = 8.0) -> tuple[str, float]:
    """(best letter, its share theta) of one symbol from its contexts."""
    if FFFD in symbol:
        return FFFD, 1.0
    prior = dict(symbols().get(symbol, {}))
    if len(symbol) == 1 and symbol in _letter_set():
        prior[symbol] = SOUND  # a letter stands for itself; its own contexts taught the bigrams
    xs = list(dict.fromkeys([*prior, *lm]))
    if not xs:
        return symbol, 1.0
    total = sum(v[2] for v in lm.values()) + 1.0
    like = np.zeros((len(ctx), len(xs)))
    for j, x in enumerate(xs):
        left, right, n = lm.get(x, ({}, {}, 0))
        for i, (a, b, _) in enumerate(ctx):
            pa, pb = (left.get(a, 0) + 0.05) / (n + 3.0), (right.get(b, 0) + 0.05) / (n + 3.0)
            like[i, j] = np.log(pa) + np.log(pb) + np.log((n + 1.0) / total)
    like -= like.max(axis=1, keepdims=True)
    weight = np.array([float(n) for *_, n in ctx])
    alpha = np.array([prior_weight * prior.get(x, 0.0) + 1e-3 for x in xs])
    theta = alpha / alpha.sum()
    scale = min(1.0, 50.0 / max(weight.sum(), 1.0))  # so that the prior keeps a say beside any number of rows
    for _ in range(rounds):
        post = np.exp(like) * theta
        post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
        theta = alpha + (post * (weight * scale)[:, None]).sum(axis=0)
        theta /= theta.sum()
    # a symbol that some page explains is one of that page's letters; bigrams alone decide for the others
    if prior and len(symbol) > 1:
        theta = np.where([x in prior for x in xs], theta, 0.0)
    j = int(theta.argmax())
    return xs[j], float(theta[j] / max(theta.sum(), 1e-300))


LEARNT = "symbol string, letter string, share double, n long"


def learn(df: DataFrame, field: str) -> DataFrame:
    """(symbol, letter, share, n) of one source. letter = symbol for sound symbols, U+FFFD where bytes are lost."""
    ctx = contexts(df, field)
    lm = bigrams(ctx)  # alphabet-sized

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        by: dict[tuple[str, str], int] = {}
        for a, b, n in zip(pdf.l, pdf.r, pdf.n):
            by[a, b] = by.get((a, b), 0) + int(n)
        s = pdf.symbol.iloc[0]
        x, share = em(s, [(a, b, n) for (a, b), n in by.items()], lm)
        return pd.DataFrame([(s, x, share, int(pdf.n.sum()))], columns=["symbol", "letter", "share", "n"])

    # a symbol's group has one row per pair of neighbour classes: at most some 70 x 70, whatever the data
    return ctx.groupBy("symbol", "l", "r").agg(F.sum("n").alias("n")).groupBy("symbol").applyInPandas(solve, LEARNT)


def garbles(learnt: DataFrame) -> DataFrame:
    """The symbols that stand for something else."""
    return learnt.filter((F.col("letter") != F.col("symbol")) | F.col("symbol").contains(FFFD)).select("symbol", "letter")


class Translator:
    """Applies a learnt table to texts."""

    def __init__(self, table: dict[str, str]) -> None:
        self.code = {s: chr(PRIVATE + k) for k, s in enumerate(table)}
        self.back = {ord(self.code[s]): x for s, x in table.items()}
        self.seen: dict[str, tuple[str, bool]] = {}

    def __call__(self, text: str) -> tuple[str, bool]:
        """(restored text, garbled)."""
        if text.isascii():
            return text, False
        parts, at, hit = [], 0, False
        for i, j in runs(text):
            parts.append(text[at:i])
            run = text[i:j]
            if run not in self.seen:
                coded = [self.code.get(s, s) for s in segment(run)]
                self.seen[run] = ("".join(coded), any(c != s for c, s in zip(coded, segment(run))))
            coded_run, bad = self.seen[run]
            parts.append(coded_run)
            hit, at = hit or bad, j
        out = ("".join(parts) + text[at:]).translate(self.back)
        # a change of case after the wrong decoding left the lost letter as it was
        return (SUNK.sub(lambda m: m[0].upper(), out) if hit else out), hit


RESTORED = "struct<garbled:boolean,restored:string>"


def restore_udf(table: dict[str, str]):
    @F.pandas_udf(RESTORED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fix = Translator(table)
        for texts in batches:
            known = {t: fix(t) for t in texts.dropna().unique()}
            rows = [known.get(t, (None, False)) for t in texts]
            yield pd.DataFrame({"garbled": [bad for _, bad in rows], "restored": [None if t is None or FFFD in t else t for t, _ in rows]})

    return run


def found(df: DataFrame, row_id: str, field: str, table_name: str) -> DataFrame:
    """(table_name, row_id, text, restored) of the garbled rows; restored is null where bytes are lost."""
    table = garbles(learn(df, field))
    rows = df.filter(F.col(field).rlike(FOREIGN)).select(F.col(row_id).cast("long").alias("row_id"), F.col(field).alias("text"))
    few = table.limit(BROADCAST_SYMBOLS + 1).collect()
    if len(few) <= BROADCAST_SYMBOLS:
        fixed = rows.withColumn("fix", restore_udf({r.symbol: r.letter for r in few})("text")).filter("fix.garbled")
        out = fixed.select("row_id", "text", F.col("fix.restored").alias("restored"))
    else:
        out = _by_join(rows, table)
    return out.select(F.lit(table_name).alias("table_name"), "row_id", "text", "restored")


def _by_join(rows: DataFrame, table: DataFrame, lost: bool = False) -> DataFrame:
    """The same with a join on symbols, for tables too large to send. Symbols of a row are put back in their order. lost: texts with
    lost bytes are given too, restored as far as they can be."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        def cut(t: str) -> list[str]:
            out, at = [], 0
            for i, j in runs(t):
                out += [t[at:i], *segment(t[i:j])]
                at = j
            return [p for p in [*out, t[at:]] if p]

        return texts.map(cut)

    parts = rows.select("row_id", "text", F.posexplode(pieces("text")).alias("k", "symbol")).join(table, "symbol", "left")
    bad = F.bool_or(F.col("letter").isNotNull())
    whole = parts.groupBy("row_id", "text").agg(bad.alias("garbled"), F.array_sort(F.collect_list(F.struct("k", F.coalesce("letter", "symbol").alias("p")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["p"]), "")
    return whole.filter("garbled").select("row_id", "text", (text if lost else F.when(~text.contains(FFFD), text)).alias("restored"))
