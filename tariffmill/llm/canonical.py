"""Map freely typed values to the entries of a reference list (problem 6).

The forms of all entries stand in a BK-tree under the unrestricted Damerau-Levenshtein metric (a true metric, so the triangle
inequality prunes whole subtrees and every form within the threshold is found). What a typed value may mean is read off the
list itself: a word may be cut from a word of the list (hlth, comml), spell the initials of a run of an entry's words (bh, ffs) or
be spelt by them (preferred provider organization for ppo), or be a word that the trade uses for another (TRADE_WORDS, a
parameter); halves around a comma are swapped, order and fillers do not count. Every reading is looked up in compact form, the
nearest entry wins, 0 reports that none is within the threshold. Forms that stand in enough rows and name an entry without an
edit are learnt, so that a second search finds typos of short forms that are in no list.

Only distinct values are looked up; rows get their entry by a join on the value, spread over salts since one value may
hold a third of the rows. Up to BROADCAST_ENTRIES entries the trees go to every task. Of a longer list only the words go whole to
each bucket of values, which are read there; the trees are cut into shards of that size, each value's readings visit every shard
and the shards' winners are merged by the same order.

A value may be read in any number of ways. Up to READINGS ways are written out; of more, words are put together one by one, and
what cannot come within the threshold of any form any more is left at once. Both give the same entry.

Defined results: null values are left out; blank ones and ones of signs only have entry 0; equal distances give the
smaller entry_id; a field without reference entries maps everything to 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored as cut

BROADCAST_ENTRIES = 20_000
#: Rows, and share of all rows looked up, in which a value must stand for its form to be learnt.
LEARN_ROWS, LEARN_SHARE = 3, 1e-5

# Words of the trade that stand for others without being cut from them. They hold for any reference list.
TRADE_WORDS = {
    "exchange": ["hix", "marketplace", "mktplace"], "percent": ["%"], "charge": ["charges", "chgs", "billed"], "per diem": ["per day"], "per unit": ["each unit", "unit rate"],
    "commercial": ["coml"], "medicare supplement": ["medigap"], "medicare advantage": ["ma"], "medicaid managed care": ["medicaid mco"], "fee for service": ["straight"],
    "childrens health program": ["chip"], "dual eligible special needs": ["d snp", "dsnp", "dual snp"], "behavioral health": ["mental health", "mental hlth"], "case rate": ["case based"],
    "employee": ["ee"], "self funded": ["aso"], "transplant": ["tx"], "tribal": ["ihs"], "auto": ["automobile", "mva"], "lesser": ["lessor"],
}
# ------------------------------------------------------------------
#: Words that say nothing about which entry is meant, and words that end a name without being written.
FILLERS, ENDINGS = ("of", "for", "and", "the", "in", "only", "plan", "plans", "ins", "insurance", "pmpm"), ("plan",)
#: Ways to read one value that are written out; those of a value with more are searched, with the same result.
READINGS = 64
SIGNS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789%")}


def compact(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text.lower())


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+|%", re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text).lower())


def cut_from(short: str, word: str) -> bool:
    """short is word with letters left out: the same first letter, the others in order."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(ch in rest for ch in short)


def plain(part: str) -> frozenset[str]:
    return frozenset(w for w in part.split() if w not in FILLERS)


class Vocabulary:
    """The words of the entries of one field, and what a typed word may stand for among them: itself, a word it is cut from, a run
    of an entry's words whose initials it spells, or what the trade uses it for. typed: the words that will be asked for, if known."""

    def __init__(self, values: list[str], trade: dict[str, list[str]], typed: set[str] | None = None) -> None:
        entries = [words(v) for v in values]
        uses = Counter(w for e in entries for w in set(e))
        self.words = frozenset(uses)
        self.initial: dict[str, list[str]] = {}
        for w in uses:
            self.initial.setdefault(w[0], []).append(w)
        self.rare: dict[str, list[frozenset[str]]] = {}  # entries by their rarest word, and by every word
        self.at: dict[str, list[frozenset[str]]] = {}
        for e in {plain(" ".join(e)) for e in entries} - {frozenset()}:
            self.rare.setdefault(min(e, key=lambda w: (uses[w], w)), []).append(e)
            for w in e:
                self.at.setdefault(w, []).append(e)
        self.runs: dict[str, set[str]] = {}
        for e in entries:
            for whole in (e, *([*e, end] for end in ENDINGS)):
                for i in range(len(whole)):
                    for j in range(i + 2, len(whole) + 1):
                        key = "".join(w[0] for w in whole[i:j])
                        if typed is None or key in typed:
                            self.runs.setdefault(key, set()).add(" ".join(whole[i:j]))
        self.trade: dict[str, set[str]] = {}
        for target, forms in trade.items():
            if set(words(target)) <= self.words:
                for f in forms:
                    self.trade.setdefault(f, set()).add(target)
        self.seen: dict[str, tuple[str, ...]] = {}

    def of(self, word: str) -> tuple[str, ...]:
        known = self.seen.get(word)
        if known is None:
            found = {word} | self.trade.get(word, set())
            if word not in self.words:
                cut_ = {w for w in self.initial.get(word[0], ()) if cut_from(word, w)}
                found |= ({w for w in cut_ if w.startswith(word)} or cut_) | self.runs.get(word, set())  # a beginning rather than letters left out
            known = self.seen[word] = tuple(sorted(found))
        return known

    def read(self, value: str) -> tuple[list[str], list[tuple[str, ...]]]:
        """Compact forms to look up: as typed, with halves around a comma swapped, with its words written out, in their order and sorted,
        and the sorted words of an entry that the words name; and, if there are more than READINGS ways, in place of what is written
        out the words that each typed word may stand for."""
        text = re.sub(r"(?:\s*(?:\*|\(\d+\)|\.))+\s*$", "", value.strip())
        texts = [text]
        if "," in text:
            head, _, tail = text.rpartition(",")
            texts.append(f"{tail} {head}")
        out = [compact(t) for t in texts] + [compact(re.sub(r"(?i)\s+plan$", "", t.strip())) for t in texts]
        typed = words(text)
        for i in range(len(typed)):  # a run of words whose initials are a word of the field
            for j in range(i + 3, len(typed) + 1):
                if "".join(w[0] for w in typed[i:j]) in self.words:
                    typed = [*typed[:i], "".join(w[0] for w in typed[i:j]), *typed[j:]]
        k = 0
        while k < len(typed) - 1:
            if f"{typed[k]} {typed[k + 1]}" in self.trade:
                typed[k : k + 2] = [f"{typed[k]} {typed[k + 1]}"]
            k += 1
        ways = [self.of(w) for w in typed]
        if math.prod(map(len, ways)) > READINGS:
            return [c for c in dict.fromkeys([*out, *sorted(self.names(typed, ways))]) if c], ways
        for way in product(*ways):
            said = [w for part in way for w in part.split()]
            meant = plain(" ".join(said))
            out += ["".join(said), "".join(w for w in said if w not in FILLERS), "".join(sorted(meant))]
            # beside words of no entry only words written out, or the trade's, count
            if not meant <= self.words:
                meant = frozenset(w for t, part in zip(typed, way) if self.outright(t, part) for w in plain(part))
            if named := self.named(meant):
                out.append(named)
        return [c for c in dict.fromkeys(out) if c], []

    def outright(self, word: str, part: str) -> bool:
        return word == part or part in self.trade.get(word, ())

    def named(self, said: frozenset[str]) -> str | None:
        """The sorted words of the one entry that the words name: the longest whose words are all said, else, if no other word is said,
        the only one that holds them all and at most as many more."""
        whole = [e for w in said for e in self.rare.get(w, ()) if e <= said]
        if whole:
            most = max(map(len, whole))
            best = {e for e in whole if len(e) == most}
        else:
            best = {e for e in min((self.at.get(w, []) for w in said), key=len, default=[]) if said <= e and 2 * len(said) >= len(e)}
        return "".join(sorted(best.pop())) if len(best) == 1 else None

    def names(self, typed: list[str], ways: list[tuple[str, ...]]) -> set[str]:
        """What named() gives for all ways together, found entry by entry."""
        out: set[str] = set()
        inside = [{p for part in parts if (p := plain(part)) <= self.words} for parts in ways]
        if all(inside):
            out |= self.all_said(inside) | self.part_said(inside)
        outright = [{plain(part) if self.outright(t, part) else frozenset() for part in parts} for t, parts in zip(typed, ways)]
        done = []
        for k, (t, parts) in enumerate(zip(typed, ways)):  # one word at least stays outside; whichever
            if t in parts and not plain(t) <= self.words and (t, outright[k]) not in done:
                done.append((t, outright[k]))
                out |= self.all_said([*outright[:k], {plain(t)}, *outright[k + 1 :]])
        return out

    def all_said(self, options: list[set[frozenset[str]]]) -> set[str]:
        """Entries that are the longest ones said, alone of their length, under some choice of an option per word."""
        may = frozenset(w for os in options for o in os for w in o)
        within = {e for w in may for e in self.rare.get(w, ()) if e <= may}
        return {"".join(sorted(e)) for e in within if chosen(options, e, [d for d in within if len(d) >= len(e) and d != e])}

    def part_said(self, options: list[set[frozenset[str]]]) -> set[str]:
        """Entries that hold all words said, under some choice."""
        must = [os for os in options if frozenset() not in os]  # words that say something in any case
        near = {e for os in ([min(must, key=len)] if must else options) for o in os for w in o for e in self.at.get(w, ())}
        out: set[str | None] = set()
        for e in near:
            said = {frozenset()}
            for os in options:
                said = {x | o for x in said for o in os if o <= e}
            out |= {self.named(x) for x in said}
        return out - {None}


def chosen(options: list[set[frozenset[str]]], wanted: frozenset[str], barred: list[frozenset[str]]) -> bool:
    """Whether one option per word can be chosen so that all of wanted and no whole set of barred is said."""
    tell = wanted.union(*barred)
    todo = []
    for os in options:
        cut_ = {o & tell for o in os}  # without options that say less of wanted and no less of the rest than another
        todo.append(tuple(sorted((o for o in cut_ if not any(p != o and p - wanted <= o - wanted and o & wanted <= p & wanted for p in cut_)), key=lambda o: (-len(o & wanted), len(o), sorted(o)))))
    stack, seen = [(frozenset(), tuple(todo))], set()
    while stack:
        said, todo = stack.pop()
        while True:  # what follows without a choice
            before, rest = said, []
            for os in todo:
                fit = tuple(o for o in os if not any(b <= said | o for b in barred))
                if len(fit) < 2:
                    said = said.union(*fit)
                    if not fit:
                        break
                elif any(o <= said for o in fit) and not any(o & wanted - said for o in fit):
                    continue  # it can say nothing new, and need not
                else:
                    rest.append(fit)
            else:
                todo = tuple(rest)
                if said != before:
                    continue
                break
            todo = None
            break
        if todo is None or not wanted <= said.union(*(o for os in todo for o in os)):
            continue
        if not todo:
            return True
        if (said, todo) in seen:
            continue
        seen.add((said, todo))
        k = min(range(len(todo)), key=lambda i: (not any(o & wanted - said for o in todo[i]), len(todo[i])))
        stack += [(said | o, todo[:k] + todo[k + 1 :]) for o in reversed(todo[k])]
    return False


def forms(value: str) -> list[str]:
    """Compact forms of an entry: as written, without fillers, sorted."""
    plain = [w for w in words(value) if w not in FILLERS]
    return [c for c in dict.fromkeys([compact(value), "".join(plain), "".join(sorted(set(plain)))]) if c]


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insertion, deletion, substitution and transposition cost 1."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    far = n + m
    last: dict[str, int] = {}
    rows = [[far] * (m + 2), [far, *range(m + 1)]]
    for i in range(1, n + 1):
        row, prev, match = [far, i] + [0] * m, rows[i], 0
        x = a[i - 1]
        for j in range(1, m + 1):
            y = b[j - 1]
            k, q = last.get(y, 0), match
            if x == y:
                cost, match = 0, j
            else:
                cost = 1
            best = prev[j] + cost
            if row[j] + 1 < best:
                best = row[j] + 1
            if prev[j + 1] + 1 < best:
                best = prev[j + 1] + 1
            swap = rows[k][q] + (i - k - 1) + 1 + (j - q - 1)
            row[j + 1] = swap if swap < best else best
        rows.append(row)
        last[x] = i
    return rows[n + 1][m + 1]


def threshold(length: int) -> int:
    return 0 if length <= 2 else 1 if length <= 5 else 2


class BKTree:
    """Forms of entries under the metric; search returns every (distance, entry_id, form) within a radius."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, form: str, entry: int) -> None:
        if self.root is None:
            self.root = [form, [entry], {}]
            return
        node = self.root
        while True:
            d = distance(form, node[0])
            if d == 0:
                if entry not in node[1]:
                    node[1].append(entry)
                return
            if d not in node[2]:
                node[2][d] = [form, [entry], {}]
                return
            node = node[2][d]

    def search(self, form: str, radius: int) -> list[tuple[int, int, str]]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            text, entries, kids = stack.pop()
            d = distance(form, text)
            if d <= radius:
                out += [(d, e, text) for e in entries]
            stack += [kid for at, kid in kids.items() if d - radius <= at <= d + radius]
        return out


class Lists:
    """A tree and a vocabulary per field, from (entry_id, field, canonical value) and forms (entry_id, field, form) learnt from the data."""

    def __init__(self, entries: list[tuple[int, str, str]], trade: dict[str, list[str]], learnt: list[tuple[int, str, str]] = []) -> None:  # noqa: B006
        self.trees: dict[str, BKTree] = {}
        self.exact: dict[tuple[str, str], int] = {}
        self.bags: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.values: dict[str, list[str]] = {}
        for entry, field, value in sorted(entries):
            self.values.setdefault(field, []).append(value)
            for form in forms(value):
                self.add(entry, field, form)
        for entry, field, form in sorted(learnt):
            self.add(entry, field, form)
        self.trade = trade
        self.vocabulary: dict[str, Vocabulary] = {}

    def add(self, entry: int, field: str, form: str) -> None:
        self.trees.setdefault(field, BKTree()).add(form, entry)
        self.exact.setdefault((field, form), entry)

    def nearest(self, field: str, value: str) -> tuple[int, int]:
        """(entry_id, distance) of the nearest entry; (0, -1) if none is within the threshold. Distance 0 needs no search."""
        if field not in self.values:
            return 0, -1
        if field not in self.vocabulary:
            self.vocabulary[field] = Vocabulary(self.values[field], self.trade)
        return self.look(field, *self.vocabulary[field].read(value))[:2]

    def look(self, field: str, read: list[str], ways: list) -> tuple[int, int, int]:
        """(entry_id, distance, letters of the reading if it is an entry's) of what Vocabulary.read gave."""
        if field not in self.trees:
            return 0, -1, 0
        if len(ways):
            read = list(dict.fromkeys([*read, *self.near(field, ways)]))
        same = [(-len(form), self.exact[field, form]) for form in read if (field, form) in self.exact]
        if same:  # the reading that explains most letters
            letters, entry = min(same)
            return entry, 0, -letters
        best: tuple[int, int] | None = None
        for form in read:
            for d, entry, known in self.trees[field].search(form, threshold(len(form))):
                if d <= threshold(min(len(form), len(known))) and (best is None or (d, entry) < best):
                    best = (d, entry)
        return (best[1], best[0], 0) if best else (0, -1, 0)

    def near(self, field: str, ways: list) -> list[str]:
        """The readings that may be within the threshold of a form of the field: an edit adds one letter at most that the form lacks, so
        what is put together from the first words is left once it has more of them than the form allows."""
        if field not in self.bags:
            known = [form for f, form in self.exact if f == field]
            self.bags[field] = np.array([bag(f) for f in known]), np.array([threshold(len(f)) for f in known]), np.array([len(f) for f in known])
        bags, most, size = self.bags[field]

        def walk(start, options: list, add, text) -> list[str]:
            least = [0]  # letters that the words to come have at least; a set may have them already
            for os in reversed(options):
                least.append(least[-1] + (min(map(len, os)) if isinstance(start, str) else 0))
            states = {start: np.arange(len(most))}
            for k, os in enumerate(options):
                step = {}
                for state, fits in states.items():
                    for o in os:
                        if (new := add(state, o)) not in step:
                            letters = text(new)
                            over = np.clip(bag(letters) - bags[fits], 0, None).sum(axis=1)
                            still = fits[(over <= most[fits]) & (len(letters) + least[len(options) - k - 1] <= size[fits] + most[fits])]
                            if len(still):
                                step[new] = still
                states = step
            return [c for state in states if (c := text(state))]

        join = lambda parts, drop: sorted({"".join(w for w in part.split() if w not in drop) for part in parts})
        out = []
        for drop in ((), FILLERS):
            out += walk("", [join(parts, drop) for parts in ways], lambda s, o: s + o, lambda s: s)
        return out + walk(frozenset(), [{plain(part) for part in parts} for parts in ways], lambda s, o: s | o, lambda s: "".join(sorted(s)))


def bag(text: str) -> np.ndarray:
    """How often text has each sign."""
    return np.bincount([SIGNS[c] for c in text], minlength=len(SIGNS)) if text else np.zeros(len(SIGNS), dtype=int)


FOUND = "field_name string, value string, entry_id long, distance int"


def lookup(values: DataFrame, reference: DataFrame, trade: dict[str, list[str]] | None = None) -> DataFrame:
    """(field_name, value, entry_id, distance) of distinct values(field_name, value, n rows).

    First every value is looked up in the list itself. The forms of values that name an entry without an edit, and stand in LEARN_ROWS
    rows and a share of LEARN_SHARE of all, are learnt as forms of that entry: typed short forms bring their own typos along.
    """
    trade = TRADE_WORDS if trade is None else trade
    ref = reference.select(F.col("entry_id").cast("long").alias("entry_id"), "field_name", F.col("canonical_value").alias("form")).filter("form is not null and field_name is not null")
    first = cut(_search(values, ref, None, trade))
    rows = values.agg(F.sum("n")).first()[0] or 0
    often = values.filter(F.col("n") >= max(LEARN_ROWS, LEARN_SHARE * rows))
    learnt = first.filter("entry_id > 0 and distance = 0").join(often.select("field_name", "value"), ["field_name", "value"])
    learnt = learnt.select("entry_id", "field_name", F.regexp_replace(F.lower("value"), "[^a-z0-9]", "").alias("form")).filter("form <> ''").distinct()
    open_ = first.filter("distance <> 0").select("field_name", "value")
    return first.filter("distance = 0").unionByName(_search(open_, ref, learnt, trade))


def _search(values: DataFrame, ref: DataFrame, learnt: DataFrame | None, trade: dict[str, list[str]]) -> DataFrame:
    forms_ = ref.withColumn("kind", F.lit("entry"))
    if learnt is not None:
        forms_ = forms_.unionByName(learnt.withColumn("kind", F.lit("learnt")))
    few = forms_.limit(BROADCAST_ENTRIES + 1).collect()
    if len(few) > BROADCAST_ENTRIES:
        return _sharded(values, forms_, trade)
    entries = tuple((r.entry_id, r.field_name, r.form, r.kind) for r in few)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = _lists(entries, tuple((k, tuple(v)) for k, v in trade.items()))
        for pdf in batches:
            hits = [lists.nearest(f, v) for f, v in zip(pdf.field_name, pdf.value)]
            yield pd.DataFrame({"field_name": pdf.field_name, "value": pdf.value, "entry_id": [e for e, _ in hits], "distance": [d for _, d in hits]})

    return values.select("field_name", "value").repartition(values.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, FOUND)


def _of(rows, trade: dict[str, list[str]]) -> Lists:
    rows = list(rows)
    return Lists([r[:3] for r in rows if r[3] == "entry"], trade, [r[:3] for r in rows if r[3] != "entry"])


@cache
def _lists(entries: tuple, trade: tuple) -> Lists:
    return _of(entries, {k: list(v) for k, v in trade})


def _sharded(values: DataFrame, forms_: DataFrame, trade: dict[str, list[str]]) -> DataFrame:
    """Each bucket of some thousand values is read by the words of the whole list. Each shard of the list, an entry with all its forms,
    builds its own tree beside each bucket of the readings; the winners of all shards merge as the forms of one list would."""
    shards = forms_.count() // BROADCAST_ENTRIES + 1
    buckets = values.count() // 5_000 + 1
    beside = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))
    typed = values.select("field_name", "value", F.pmod(F.xxhash64("value"), F.lit(buckets)).alias("bucket"))
    listed = forms_.filter("kind = 'entry'").select("field_name", "form").distinct().withColumn("bucket", beside)

    def read(vals: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        asked = {w for v in vals.value for w in words(v)}
        known = {f: Vocabulary(sorted(part), trade, asked) for f, part in refs.groupby("field_name").form}
        rows = [(f, v, *(known[f].read(v) if f in known else ([], []))) for f, v in zip(vals.field_name, vals.value)]
        return pd.DataFrame([(f, v, r, [list(w) for w in ways], b) for (f, v, r, ways), b in zip(rows, vals.bucket)], columns=["field_name", "value", "read", "ways", "bucket"])

    readings = typed.groupBy("bucket").cogroup(listed.groupBy("bucket")).applyInPandas(read, "field_name string, value string, read array<string>, ways array<array<string>>, bucket long")
    left = readings.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = forms_.withColumn("shard", F.pmod(F.xxhash64("entry_id"), F.lit(shards)).cast("int")).withColumn("bucket", beside)

    def run(vals: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        lists = _of(zip(refs.entry_id, refs.field_name, refs.form, refs.kind), trade)
        rows = [(f, v, *lists.look(f, list(r), w)) for f, v, r, w in zip(vals.field_name, vals.value, vals["read"], vals.ways)]
        return pd.DataFrame(rows, columns=["field_name", "value", "entry_id", "distance", "letters"])

    hits = left.groupBy("shard", "bucket").cogroup(right.groupBy("shard", "bucket")).applyInPandas(run, f"{FOUND}, letters int")
    rank = F.struct(F.when(F.col("entry_id") == 0, 1 << 30).otherwise(F.col("distance")), -F.col("letters"), "entry_id")
    return hits.groupBy("field_name", "value").agg(F.min_by(F.struct("entry_id", "distance"), rank).alias("w")).select("field_name", "value", "w.*")


def assign(rows: DataFrame, row_id: str, fields: list[str], reference: DataFrame, salts: int = 16, trade: dict[str, list[str]] | None = None) -> DataFrame:
    """(row_id, field_name, value, entry_id) of the non-null values that are not exactly an entry of their field."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields))
    long = rows.select(F.col(row_id).cast("long").alias("row_id"), F.inline(pairs)).filter("value is not null")
    exact = reference.select("field_name", F.col("canonical_value").alias("value"))
    long = long.join(exact, ["field_name", "value"], "left_anti")
    known = cut(lookup(cut(long.groupBy("field_name", "value").agg(F.count("*").alias("n"))), reference, trade))
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    long = long.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    return long.join(spread, ["field_name", "value", "salt"]).select("row_id", "field_name", "value", "entry_id")
