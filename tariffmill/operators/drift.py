"""Schema drift between the files of a series (problem 4).

Every file's columns are profiled (normalized name, type, canonical field, place) and matched with those of the series'
previous file. Columns of equal normalized name are the same column, by an equi-join on (file, name). All others go to a bipartite
matching, file by file: the best assignment over weighted edges between the columns that one side lacks. What the edges weigh
is learnt from all files:

* a name that the mapper recognized in any file stands for that field; names of one field weigh most, places decide between
  several of them;
* a name that it never recognized gets a sketch: how often it comes or goes where a column of each field goes or comes, how rarely
  it stands beside that field in a file (a file holds a field once), how its types agree with the field's, and how its words
  look like, or abbreviate, the words of the field's recognized names, a word counting less the more fields use it;
* two names that were never recognized weigh by the field that their sketches suggest, else by their words;
* payer columns weigh by their folded headers: equal ones, or ones that differ in one part by two edits at most.

Pairs are formed of the unmatched columns of one file only. An assignment is solved per connected part of a file's edges.

The column table over all files follows from the same matches: names that the matching takes for one column are one column.

Defined results: a file without previous file reports nothing; repeated mapping rows count once; a null normalized name
is derived from the header; a null type is no change; a hospital's file loaded twice is one file.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored as cut

#: Least weight of an edge, and how often (of its files) an unknown name may stand beside a field it is taken for.
LEAST_WEIGHT, MOST_TOGETHER = 0.5, 0.1
#: Weights of a sketch's parts: words, coming and going, standing apart, types; and of places between equal edges.
WORDS, CHANGES, APART, TYPES, PLACE = 0.35, 0.3, 0.2, 0.15, 0.05



def words(name: str | None) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", (name or "").lower()) if w]


def short_for(a: str, b: str) -> bool:
    """a abbreviates b: same first letter and a's letters occur in b in order."""
    if a == b:
        return True
    if len(a) < 2 or a[0] != b[0]:
        return False
    rest = iter(b)
    return all(ch in rest for ch in a)


def word_likeness(name: str, known: dict[str, int]) -> float:
    """0..1: how far the name's words are words of a field, or abbreviate them. known: the field's words with the number of fields
    that use each."""
    own = words(name)
    best = [max(((1.0 if w == k else 0.8 if short_for(w, k) else 0.0) / n**0.5 for k, n in known.items()), default=0.0) for w in own]
    return sum(best) / max(len(own), 1)


def name_likeness(a: str, b: str) -> float:
    x, y = words(a), words(b)
    return sum(any(short_for(w, k) or short_for(k, w) for k in y) for w in x) / max(len(x), len(y), 1)


def assign(weight: list[list[float]]) -> list[tuple[int, int]]:
    """Best assignment (Kuhn-Munkres with potentials) of rows to columns; pairs of weight <= 0 are left out."""
    n, m = len(weight), len(weight[0]) if weight else 0
    if not n or not m:
        return []
    if n > m:
        return [(i, j) for j, i in assign([list(c) for c in zip(*weight)])]
    u, v, p, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        low, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = -weight[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < low[j]:
                        low[j], way[j] = cur, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return [(p[j] - 1, j - 1) for j in range(1, m + 1) if p[j] and weight[p[j] - 1][j - 1] > 0]


def match_file(edges: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
    """(old, new) of the best assignment over the weighted edges (old, new, weight) of one file, connected part by connected part."""
    root: dict[tuple[bool, str], tuple[bool, str]] = {}

    def find(x: tuple[bool, str]) -> tuple[bool, str]:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for o, n, _ in edges:
        root[find((False, o))] = find((True, n))
    by: dict[tuple[bool, str], dict[tuple[str, str], float]] = {}
    for o, n, w in edges:
        by.setdefault(find((False, o)), {})[o, n] = w
    out = []
    for at in by.values():
        if len(at) == 1:
            out += list(at)
            continue
        old, new = sorted({o for o, _ in at}), sorted({n for _, n in at})
        out += [(old[i], new[j]) for i, j in assign([[at.get((o, n), 0.0) for n in new] for o in old])]
    return out


def match_udf(edges: str):
    @F.pandas_udf("array<struct<old_id:string,new_id:string>>")
    def run(files: pd.Series) -> pd.Series:
        return files.map(lambda es: match_file([(e["old_id"], e["new_id"], e["weight"]) for e in es]))

    return run(edges)


def previous_files(files: DataFrame, span: int = 1000) -> DataFrame:
    """(file_id, prev_id) by (hospital_id, file_seq). The order is found in spans of file_seq, so that no series is sorted in one task."""
    one = files.groupBy("file_id").agg(F.min(F.struct("hospital_id", "file_seq")).alias("s")).select("file_id", "s.*")
    one = one.withColumn("span", F.floor(F.col("file_seq") / span))
    inside = one.withColumn("prev_id", F.lag("file_id").over(Window.partitionBy("hospital_id", "span").orderBy("file_seq", "file_id")))
    ends = one.groupBy("hospital_id", "span").agg(F.max_by("file_id", F.struct("file_seq", "file_id")).alias("end_id"))
    ends = ends.withColumn("before", F.lag("end_id").over(Window.partitionBy("hospital_id").orderBy("span"))).drop("end_id")
    return inside.join(ends, ["hospital_id", "span"], "left").select("file_id", "hospital_id", "file_seq", F.coalesce("prev_id", "before").alias("prev_id"))


def columns_of(mappings: DataFrame) -> DataFrame:
    """One row per column of a file, with its canonical field as learnt from all files (null: the mapper never knew the name)."""
    name = F.coalesce("normalized", F.regexp_replace(F.lower(F.trim("source_header")), r"[^a-z0-9]+", "_"), F.lit(""))
    cols = mappings.select("file_id", name.alias("name"), "ord", "mapping_id", "source_header", "mapped_to", "value_type")
    cols = cols.groupBy("file_id", "name").agg(F.min_by(F.struct("ord", "source_header", "mapped_to", "value_type"), F.struct("ord", "mapping_id")).alias("c")).select("file_id", "name", "c.*")
    wide = F.col("mapped_to").startswith("wide_payer:")
    known = cols.filter(F.col("mapped_to").isNotNull() & ~wide).groupBy("name", "mapped_to").agg(F.count("*").alias("n"))
    known = known.groupBy("name").agg(F.max_by("mapped_to", F.struct("n", "mapped_to")).alias("learnt"))
    cols = cols.withColumn("wide", F.coalesce(wide, F.lit(False)) | F.coalesce(F.col("source_header").contains("|") & F.col("mapped_to").isNull(), F.lit(False)))
    cols = cols.join(known, "name", "left")
    # a payer column is the same payer's column whatever the accents and styling of its header
    payer = F.regexp_replace(F.lower(F.translate("source_header", "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")), r"[^a-z0-9|]+", "")
    return cols.withColumn("field", F.when(F.col("wide"), payer).otherwise(F.coalesce("learnt", "mapped_to"))).drop("learnt")


def changes(mappings: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, change, old_header, new_header) of every file against its series' previous file."""
    matched = matches(cut(columns_of(mappings)), files)  # read by every step: without a cut each would plan it anew

    def change(when, kind: str, old: bool, new: bool):
        side = lambda c, there: (F.coalesce(F.col(f"{c}.source_header"), F.lit("")) if there else F.lit("")).alias({"o": "old_header", "n": "new_header"}[c])
        return F.when(when, F.struct(F.lit(kind).alias("change"), side("o", old), side("n", new)))

    rows = F.array_compact(F.array(
        change(F.col("o").isNull(), "added", False, True),
        change(F.col("n").isNull(), "removed", True, False),
        change(F.col("n.name") != F.col("o.name"), "renamed", True, True),
        change(F.col("n.value_type") != F.col("o.value_type"), "retyped", True, True),
    ))
    return matched.select("file_id", F.inline(rows))


def matches(cols: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, n, o): the columns of every file beside those of its series' previous file, null where one side lacks it."""
    order = previous_files(files).filter("prev_id is not null").select("file_id", "prev_id")
    keep = ["file_id", "name", "ord", "source_header", "value_type", "field", "wide"]
    new = cols.join(order.select("file_id"), "file_id", "left_semi").select(keep)
    old = cols.withColumnRenamed("file_id", "prev_id").join(order, "prev_id").select(keep)
    n, o = new.select("file_id", "name", F.struct(*keep[1:]).alias("n")), old.select("file_id", "name", F.struct(*keep[1:]).alias("o"))
    both = cut(n.join(o, ["file_id", "name"], "full").select("file_id", "n", "o"))

    lone_n = both.filter("o is null").select("file_id", "n")
    lone_o = both.filter("n is null").select("file_id", "o")
    edges = field_edges(cols, lone_n.filter("not n.wide"), lone_o.filter("not o.wide")).unionByName(payer_edges(lone_n.filter("n.wide"), lone_o.filter("o.wide")))
    by_file = edges.groupBy("file_id").agg(F.collect_list(F.struct("old_id", "new_id", "weight")).alias("edges"))  # unmatched columns of one file
    pairs = cut(by_file.withColumn("pairs", match_udf("edges")).select("file_id", F.inline("pairs")))
    left_n = lone_n.withColumn("new_id", F.col("n.name")).join(pairs, ["file_id", "new_id"], "left").select("file_id", "n", "old_id")
    left_o = lone_o.withColumn("old_id", F.col("o.name"))
    return left_n.join(left_o, ["file_id", "old_id"], "full").select("file_id", "n", "o").unionByName(both.filter("n is not null and o is not null"))


def field_edges(cols: DataFrame, lone_n: DataFrame, lone_o: DataFrame) -> DataFrame:
    """Weighted edges between unmatched columns that are no payers'."""
    nf, of = F.col("n.field"), F.col("o.field")
    unknown = F.when(nf.isNull() & of.isNotNull(), F.col("n.name")).when(of.isNull() & nf.isNotNull(), F.col("o.name"))
    pairs = lone_n.join(lone_o, "file_id").filter("n.field is null or o.field is null or n.field = o.field")
    pairs = cut(pairs.withColumns({"unknown": unknown, "known": F.when(unknown.isNotNull(), F.coalesce(nf, of))}))
    lone = lone_n.select("file_id", F.col("n.name").alias("unknown"), F.col("n.field").alias("f")).unionByName(lone_o.select("file_id", F.col("o.name").alias("unknown"), F.col("o.field").alias("f")))
    sketch = cut(sketches(cols, pairs, lone.filter("f is null")))
    guess = sketch.filter(F.col("score") >= LEAST_WEIGHT).groupBy("unknown").agg(F.max_by("known", F.struct("score", "known")).alias("guess"))
    side = lambda c: guess.select(F.col("unknown").alias(f"{c}_name"), F.col("guess").alias(f"{c}_guess"))
    e = pairs.join(sketch, ["unknown", "known"], "left").withColumns({"n_name": F.when(nf.isNull() & of.isNull(), F.col("n.name")), "o_name": F.when(nf.isNull() & of.isNull(), F.col("o.name"))})
    e = e.join(side("n"), "n_name", "left").join(side("o"), "o_name", "left")
    place = PLACE / (1 + F.coalesce(F.abs(F.col("n.ord") - F.col("o.ord")), F.lit(0)))
    weight = F.when(nf == of, F.lit(1.0)).when(F.col("known").isNotNull(), F.col("score")).when(F.col("n_guess") == F.col("o_guess"), F.lit(0.8))
    alike = F.when(F.col("n_guess").isNull() | F.col("o_guess").isNull(), like_udf("n_name", "o_name"))
    e = e.withColumn("weight", F.coalesce(weight, F.when(alike > 0.6, alike * 0.9)))
    return e.filter(F.col("weight") >= LEAST_WEIGHT).select("file_id", F.col("o.name").alias("old_id"), F.col("n.name").alias("new_id"), (F.col("weight") + place).alias("weight"))


def payer_edges(lone_n: DataFrame, lone_o: DataFrame) -> DataFrame:
    """Weighted edges between unmatched payer columns: of equal folded headers, or that differ in one part by two edits at most and
    share its first or last three signs (the block)."""

    def blocks(df: DataFrame, c: str) -> DataFrame:
        parts = F.split(F.col(f"{c}.field"), r"\|")
        holes = F.flatten(F.transform(parts, lambda p, i: F.array(*(
            F.struct(F.concat_ws("|", F.lit(side), i.cast("string"), end, F.concat_ws("|", F.transform(parts, lambda q, j: F.when(i == j, "").otherwise(q)))).alias("block"), p.alias("part"))
            for side, end in (("first", F.substring(p, 1, 3)), ("last", F.substring(p, -3, 3)))))))
        same = F.array(F.struct(F.concat(F.lit("same|"), F.col(f"{c}.field")).alias("block"), F.lit("").alias("part")))
        return df.select("file_id", F.col(f"{c}.name").alias(f"{c}_id"), F.col(f"{c}.ord").alias(f"{c}_ord"), F.inline(F.concat(same, holes))).withColumnRenamed("part", f"{c}_part")

    e = blocks(lone_n, "n").join(blocks(lone_o, "o"), ["file_id", "block"])
    e = e.withColumn("far", F.levenshtein("n_part", "o_part")).filter("far <= 2")
    place = PLACE / (1 + F.coalesce(F.abs(F.col("n_ord") - F.col("o_ord")), F.lit(0)))
    e = e.withColumn("weight", F.when(F.col("block").startswith("same|"), 1.0).otherwise(0.8 - 0.1 * F.col("far")) + place)
    return e.groupBy("file_id", F.col("o_id").alias("old_id"), F.col("n_id").alias("new_id")).agg(F.max("weight").alias("weight"))


def sketches(cols: DataFrame, pairs: DataFrame, lone: DataFrame) -> DataFrame:
    """(unknown, known, score): what every name that was never recognized says for each field that ever went or came with it."""
    cols = cut(cols.filter("not wide").select("file_id", "name", "field", "value_type"))  # payer columns, most of a wide file, are not read again
    told = cols.filter("field is not null")
    went = lone.groupBy("unknown").agg(F.count_distinct("file_id").alias("changes"))
    both = pairs.filter("known is not null").groupBy("unknown", "known").agg(F.count_distinct("file_id").alias("c"))
    one = cols.join(went.select(F.col("unknown").alias("name")), "name", "left_semi").select("file_id", F.col("name").alias("unknown"), F.col("value_type").alias("t"))
    fields = told.select("file_id", F.col("field").alias("known")).distinct()  # a few dozen per file
    stands = one.groupBy("unknown").agg(F.count_distinct("file_id").alias("files"))
    together = one.join(fields, "file_id").groupBy("unknown", "known").agg(F.count_distinct("file_id").alias("m"))
    types = lambda df, key: df.filter("t is not null").groupBy(key, F.when(F.col("t") == "bigint", "double").otherwise(F.col("t")).alias("t")).agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias(f"{key}_types"))
    spelt = told.select("field", "name").distinct().select("field", F.explode(F.array_distinct(F.concat(F.split("name", "[^a-z]+"), F.split("field", "[^a-z]+")))).alias("w")).filter("w <> ''").distinct()
    shared = spelt.groupBy("w").agg(F.count("*").alias("uses"))
    spelling = spelt.join(shared, "w").groupBy(F.col("field").alias("known")).agg(F.map_from_entries(F.collect_list(F.struct("w", "uses"))).alias("words"))
    x = both.join(went, "unknown").join(stands, "unknown").join(together, ["unknown", "known"], "left").filter(F.coalesce(F.col("m") / F.col("files"), F.lit(0.0)) <= MOST_TOGETHER)
    x = x.join(types(one, "unknown"), "unknown", "left").join(types(told.select(F.col("field").alias("known"), F.col("value_type").alias("t")), "known"), "known", "left").join(spelling, "known", "left")
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, b: a + b)
    u, k = F.col("unknown_types"), F.col("known_types")
    agree = F.aggregate(F.map_keys(u), F.lit(0.0), lambda a, t: a + F.least(u[t] / total(u), F.coalesce(k[t] / total(k), F.lit(0.0))))
    apart = (1 - F.coalesce(F.col("m") / F.col("files"), F.lit(0.0))) * F.col("files") / (F.col("files") + 1)
    score = WORDS * words_udf("unknown", "words") + CHANGES * (F.col("c") + 0.3) / (F.col("changes") + 1) + APART * apart + TYPES * F.coalesce(agree, F.lit(0.5))
    return x.select("unknown", "known", score.alias("score"))


def words_udf(name: str, known: str):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([word_likeness(x, dict(y) if y is not None else {}) for x, y in zip(a, b)], dtype="float64")

    return run(name, known)


def like_udf(a: str, b: str):
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else name_likeness(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def unified(mappings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The consistent column table: one row per column of the unified schema, with its headers, types and files.

    A column is a canonical field, a payer column (folded header) or, for names never recognised, the name itself; those that the
    matching of the files' series takes for one column are one (see classes). Without files there is no series, and names alone
    decide. The type is the narrowest that holds all types seen (bigint within double, else string).
    """
    cols = columns_of(mappings).withColumn("key", F.coalesce("field", "name"))
    kind = F.col("key")
    if files is not None:
        cols = cut(cols)
        cols = cols.join(classes(cols, matches(cols, files)), "key", "left")
        kind = F.coalesce("label", "key")
    t = F.collect_set("value_type")
    kinds = cols.groupBy(kind.alias("column_name")).agg(F.count_distinct("file_id").alias("files"), F.count_distinct("name").alias("names"), F.min("name").alias("first_name"), t.alias("types"))
    best = F.when(F.size("types") == 0, F.lit("string")).when(F.size("types") == 1, F.element_at("types", 1))
    best = best.when(F.size(F.array_except("types", F.array(F.lit("double"), F.lit("bigint")))) == 0, F.lit("double")).otherwise(F.lit("string"))
    return kinds.withColumn("value_type", best).drop("types")


def classes(cols: DataFrame, matched: DataFrame) -> DataFrame:
    """(key, label) of the keys (fields, folded payer headers, names never recognised) that the matching joins with others.

    Two keys are linked by the files that match a column of one with a column of the other, unless they stand side by side in more
    than MOST_TOGETHER of the rarer one's files. A key linked to fields, or to keys that have one, takes the field of most files;
    two fields never merge. What is linked to no field is named for its most frequent key. A key that still stands beside another
    of its column in more than MOST_TOGETHER of its files is a column of its own.
    """
    keys = cut(cols.groupBy("key").agg(F.count_distinct("file_id").alias("files"), F.max(F.col("field").isNotNull() & ~F.col("wide")).alias("known")))
    has = cols.select("file_id", "key").distinct()
    key = lambda c: F.coalesce(f"{c}.field", f"{c}.name")
    met = matched.filter("n is not null and o is not null").select("file_id", key("n").alias("x"), key("o").alias("y")).filter("x <> y")
    met = met.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count_distinct("file_id").alias("n"))
    side = lambda c: keys.select(F.col("key").alias(c), F.col("files").alias(f"{c}_files"), F.col("known").alias(f"{c}_known"))
    links = met.join(side("x"), "x").join(side("y"), "y").filter("not (x_known and y_known)")
    first = F.col("x_files") <= F.col("y_files")
    links = cut(links.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("rare"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("other"), F.least("x_files", "y_files").alias("fewer"), "n"))
    beside = links.join(has.withColumnRenamed("key", "rare"), "rare").join(has.withColumnRenamed("key", "other"), ["file_id", "other"], "left_semi").groupBy("rare", "other").agg(F.count("*").alias("m"))
    links = links.join(beside, ["rare", "other"], "left").filter(F.coalesce("m", F.lit(0)) <= MOST_TOGETHER * F.col("fewer"))
    ends = cut(links.select(F.inline(F.array(F.struct(F.col("rare").alias("key"), F.col("other").alias("near"), "n"), F.struct(F.col("other").alias("key"), F.col("rare").alias("near"), "n")))))

    named = cut(keys.filter("known").join(ends, "key", "left_semi").select("key", F.col("key").alias("label")))
    while True:  # every round names the keys next to named ones
        votes = ends.join(named.select(F.col("key").alias("near"), "label"), "near").join(named, "key", "left_anti").groupBy("key", "label").agg(F.sum("n").alias("n"))
        more = cut(votes.groupBy("key").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label")))
        if more.isEmpty():
            break
        named = cut(named.unionByName(more))

    rest = cut(ends.join(named, "key", "left_anti").select("key", "near"))
    best = cut(rest.select("key").distinct().join(keys, "key").select("key", F.struct((-F.col("files")).alias("less"), F.col("key").alias("label")).alias("best")))
    while True:  # until no key has a neighbour with a better label
        near = rest.join(best.select(F.col("key").alias("near"), F.col("best").alias("b")), "near").groupBy("key").agg(F.min("b").alias("b"))
        best = cut(best.join(near, "key").select("key", F.least("best", "b").alias("best"), (F.col("b") < F.col("best")).alias("better")))
        if best.filter("better").isEmpty():
            break
    labels = cut(named.unionByName(best.select("key", "best.label")))

    own = F.struct("known", "files", "key")
    at = has.join(labels.join(keys, "key"), "key").withColumn("top", F.max(own).over(Window.partitionBy("file_id", "label")))
    leave = at.groupBy("key").agg(F.avg((F.col("top.key") != F.col("key")).cast("double")).alias("share")).filter(F.col("share") > MOST_TOGETHER)
    return labels.join(leave, "key", "left").select("key", F.when(F.col("share").isNull(), F.col("label")).otherwise(F.col("key")).alias("label"))
