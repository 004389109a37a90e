"""Find evaluation items that leaked into documents (problem 8) by greedy string tiling.

Texts become words (case, accents, signs, soft hyphens, line ends and other layout dropped). Running Karp-Rabin hashes of
SEED words join documents with items; of each pair that shares a seed the longest common runs of words are marked again
and again, none overlapping (greedy string tiling, again by running hashes, with falling search length). Tiles near one
diagonal are chained; what lies between two tiles counts as altered by its word edit distance. An item leaked if a chain
holds LEAST of its words in a row with at most one in ONE_IN altered, or the whole of a shorter item unaltered. Each
passage is judged by itself, so passages in another order are found as well.

A run of LEAST words with so few altered ones holds an unaltered run of at least SEED words, so the seeds lose no case.
The items are sent to the tasks up to BROADCAST_ITEMS of them (their number is fixed, and it is checked); more are joined
with the documents on seeds, under the same admission. Documents are mapped where they are read, whole.

Defined results: null or empty texts hold nothing; an item without words is never found; repeated items are reported each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

SEED, LEAST, ONE_IN, FEWEST = 5, 20, 8, 5
#: Shortest tile, longest stretch between tiles of a chain, widest shift of its diagonal.
TILE, GAP, BAND = 2, 6, 12
BROADCAST_ITEMS = 5_000
BASE = np.uint64(0x9E3779B97F4A7C15)

HIDDEN = re.compile("[­​-‏‪-‮⁠﻿]")
BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n[>\s]*(?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")


#: Every ASCII sign that is no letter or digit parts words, but for the apostrophe, which is dropped.
APART = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord("'"): None}


def words(text: str | None) -> list[str]:
    text = text or ""
    if not text.isascii():
        text = HIDDEN.sub("", text)
    if "-\n" in text or "- " in text or not text.isascii():
        text = BROKEN.sub("", text)
    if text.isascii():
        return text.lower().translate(APART).split()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return WORD.findall(text.lower().replace("'", ""))


@cache
def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out[k] = out[k - 1] * BASE
    return out


class Known(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Hashes:
    """Word hashes, kept within a bound; windows() gives the polynomial hash of every run of n words."""

    def __init__(self) -> None:
        self.known = Known()

    def codes(self, ws: list[str]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, ws), dtype=np.uint64, count=len(ws))

    @staticmethod
    def windows(codes: np.ndarray, n: int) -> np.ndarray:
        if len(codes) < n:
            return np.empty(0, dtype=np.uint64)
        powers, size = _powers(n), len(codes) - n + 1
        with np.errstate(over="ignore"):
            if n > 16:
                return (np.lib.stride_tricks.sliding_window_view(codes, n) * powers).sum(axis=1, dtype=np.uint64)
            out = codes[:size] * powers[0]
            for k in range(1, n):
                out += codes[k : k + size] * powers[k]
            return out


def tile(doc: np.ndarray, item: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Non-overlapping (doc start, item start, length), the longest first marked. Search length falls as lengths run out."""
    n, m = len(doc), len(item)
    free_d, free_i = np.ones(n, dtype=bool), np.ones(m, dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    search = min(LEAST, n, m)
    while search >= least:
        found = _matches(doc, item, free_d, free_i, search)
        if found and found[0][0] > 2 * search and found[0][0] > LEAST:
            search = found[0][0]
            found = _matches(doc, item, free_d, free_i, search)
        marked = False
        for length, i, j in found:
            if free_d[i : i + length].all() and free_i[j : j + length].all():
                free_d[i : i + length] = False
                free_i[j : j + length] = False
                tiles.append((i, j, length))
                marked = True
        if not marked:
            search = search // 2 if search > 2 * least else search - 1
    return tiles


def _matches(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, search: int) -> list[tuple[int, int, int]]:
    """Maximal free common runs of at least so many words: (length, doc start, item start), longest first."""
    hd, hi = Hashes.windows(doc, search), Hashes.windows(item, search)
    table: dict[int, list[int]] = {}
    for j, h in enumerate(hi.tolist()):
        if free_i[j : j + search].all():
            table.setdefault(h, []).append(j)
    out, seen = [], set()
    for i in np.flatnonzero(np.isin(hd, hi)).tolist():
        if not free_d[i : i + search].all():
            continue
        for j in table.get(int(hd[i]), ()):
            if (i - 1, j - 1) in seen:
                seen.add((i, j))
                continue
            seen.add((i, j))
            k = 0
            while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and free_d[i + k] and free_i[j + k]:
                k += 1
            if k >= search:
                out.append((k, i, j))
    return sorted(out, key=lambda x: (-x[0], x[1], x[2]))


def altered(a: np.ndarray, b: np.ndarray) -> int:
    """Word edit distance of two short stretches."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def _on_diagonal(doc: np.ndarray, item: np.ndarray, shift: int) -> bool:
    """Exact check without inserted or dropped words: a window of the item that starts and ends in equal words."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi - lo < LEAST:
        return False
    same = item[lo:hi] == doc[lo + shift : hi + shift]
    off = np.concatenate([[0], np.cumsum(~same)])
    for n in range(LEAST, hi - lo + 1):
        if ((off[n:] - off[:-n] <= n // ONE_IN) & same[: len(same) - n + 1] & same[n - 1 :]).any():
            return True
    return False


def leaked(doc: np.ndarray, item: np.ndarray) -> bool:
    if not len(item):
        return False
    tiles = tile(doc, item, min(TILE, len(item)))
    if len(item) < LEAST:
        return any(k == len(item) for _, _, k in tiles)
    for i0, j0, k0 in tiles:
        if k0 < SEED:
            break
        if k0 >= LEAST or _on_diagonal(doc, item, i0 - j0):
            return True
        near = sorted((j, i, k) for i, j, k in tiles if abs((i - j) - (i0 - j0)) <= BAND)
        if sum(k for *_, k in near) * ONE_IN < LEAST * (ONE_IN - 1) - ONE_IN:
            continue
        chain: list[tuple[int, int, int]] = []
        for t in near:  # tiles that run back in the document give way to the longer one
            while chain and t[1] < chain[-1][1] + chain[-1][2]:
                if chain[-1][2] >= t[2]:
                    break
                chain.pop()
            else:
                chain.append(t)
        gaps = []
        for (j, i, k), (j2, i2, _) in zip(chain, chain[1:]):
            gi, gd = item[j + k : j2], doc[i + k : i2]
            gaps.append(altered(gi, gd) if max(len(gi), len(gd)) <= GAP else 10**6)
        for a in range(len(chain)):
            cost = 0
            for b in range(a, len(chain)):
                if b > a:
                    cost += gaps[b - 1]
                n = chain[b][0] + chain[b][2] - chain[a][0]
                if n >= LEAST and ONE_IN * cost <= n:
                    return True
                if cost >= 10**6:
                    break
    return False


class Index:
    """Seeds of all items with their places."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.hashes = Hashes()
        self.codes: dict[int, np.ndarray] = {}
        #: seed length -> seed hash -> (item, position) of its places
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for key, text in items:
            codes = self.hashes.codes(words(text))
            self.codes[key] = codes
            if len(codes):
                n = min(SEED, len(codes))
                table = self.seeds.setdefault(n, {})
                for j, h in enumerate(self.hashes.windows(codes, n).tolist()):
                    table.setdefault(h, []).append((key, j))
        self.sorted = {n: np.array(sorted(t), dtype=np.uint64) for n, t in self.seeds.items()}

    def candidates(self, doc: np.ndarray) -> list[int]:
        """Items with enough seeds near one diagonal. LEAST words of which at most one in ONE_IN is altered keep at least
        FEWEST seeds (the fewest are left by 24 words with 3 altered: runs of 5, 5, 5 and 6), a shorter item keeps all."""
        near: dict[tuple[int, int], int] = {}
        for n, table in self.seeds.items():
            h = self.hashes.windows(doc, n)
            known = self.sorted[n]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in np.flatnonzero(known[at] == h).tolist():
                for key, j in table[int(h[i])]:
                    band = (i - j) // BAND
                    near[key, band] = near.get((key, band), 0) + 1
        out = set()
        for (key, at), k in near.items():
            m = len(self.codes[key])
            if k + near.get((key, at + 1), 0) >= (FEWEST if m >= LEAST else m - min(SEED, m) + 1):
                out.add(key)
        return sorted(out)

    def items_in(self, text: str) -> list[int]:
        doc = self.hashes.codes(words(text))
        return [k for k in self.candidates(doc) if leaked(doc, self.codes[k])]


@cache
def _index(items: tuple) -> Index:
    return Index(list(items))


FOUND = "doc_id long, item_id long"


def search(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the items that leaked into each document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    test = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).filter("item is not null")
    few = test.limit(BROADCAST_ITEMS + 1).collect()
    if len(few) > BROADCAST_ITEMS:
        return _by_join(spread(docs), test)
    fixed = tuple((r.item_id, r.item) for r in few)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(fixed)
        for pdf in batches:
            rows = [(d, k) for d, t in zip(pdf.doc_id, pdf.text) for k in index.items_in(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"]).astype("int64")

    return spread(docs).mapInPandas(run, FOUND)


SEEDS = "struct<n:int,seeds:array<struct<len:int,seed:long,at:int>>>"


def _seeds(df: DataFrame, key: str, text: str, lengths: tuple[int, ...] | None) -> DataFrame:
    """(key, n, len, seed, at): the hashes of all runs of words of those lengths with their places; n: words of the text. Without lengths
    a text has runs of SEED words, or itself if it is shorter."""

    @F.pandas_udf(SEEDS)
    def cut(texts: pd.Series) -> pd.DataFrame:
        h, rows = Hashes(), []
        for t in texts:
            codes = h.codes(words(t))
            every = lengths if lengths is not None else (min(SEED, len(codes)),) if len(codes) else ()
            rows.append((len(codes), [(k, int(x), i) for k in every for i, x in enumerate(h.windows(codes, k).astype(np.int64).tolist())]))
        return pd.DataFrame(rows, columns=["n", "seeds"])

    return df.withColumn("_s", cut(text)).select(key, F.col("_s.n").alias("n"), F.inline("_s.seeds"))


def _by_join(docs: DataFrame, test: DataFrame) -> DataFrame:
    """The same where the items are too many to send: documents meet items on seeds, and pairs with enough seeds near one diagonal
    (as Index.candidates counts them) meet their texts again by id. Items under SEED words are sought as a whole, by seeds of
    their own length; the lengths that occur are at most SEED."""
    sought = _seeds(test, "item_id", "item", None)
    lengths = tuple(sorted(r.len for r in sought.select("len").distinct().collect()))  # at most SEED
    there = _seeds(docs, "doc_id", "text", lengths).drop("n")
    met = there.withColumnRenamed("at", "i").join(sought.withColumnRenamed("at", "j"), ["len", "seed"])
    met = met.withColumn("band", F.floor((F.col("i") - F.col("j")) / BAND))
    bands = met.groupBy("doc_id", "item_id", "n", "band").agg(F.count("*").alias("k"))
    # seeds near one diagonal fall into one band or two neighbours
    both = bands.select("doc_id", "item_id", "n", F.explode(F.array("band", F.col("band") - 1)).alias("band"), "k").groupBy("doc_id", "item_id", "n", "band").agg(F.sum("k").alias("k"))
    least = F.when(F.col("n") >= LEAST, FEWEST).otherwise(F.col("n") - F.least("n", F.lit(SEED)) + 1)
    cand = both.filter(F.col("k") >= least).select("doc_id", "item_id").distinct()
    pairs = cand.join(docs, "doc_id").join(test, "item_id")

    @F.pandas_udf("boolean")
    def judge(a: pd.Series, b: pd.Series) -> pd.Series:
        h = Hashes()
        return pd.Series([leaked(h.codes(words(x)), h.codes(words(y))) for x, y in zip(a, b)], dtype=bool)

    return pairs.filter(judge("text", "item")).select("doc_id", "item_id")
