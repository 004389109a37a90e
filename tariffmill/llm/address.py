"""Decide which address records denote the same location (problem 7).

Addresses are parsed into region, locality, street, number and unit, and linked top-down, level by level:

1. region and locality: a ZIP code names the locality most records give it; without one, the typed city (from the address,
   else from the location field) is linked to a known locality, exactly or within one edit, in its region if that is given;
2. street: a rare spelling within one edit of a name that is known elsewhere takes that name; within a locality and house
   number spellings within one edit join the commonest one;
3. direction and street type: a missing one inherits the only candidate of its street; several candidates leave it open;
4. number: part of every key, never inherited;
5. unit: a missing one inherits the only unit of its location (with_units). Units do not tell locations apart.

Records that name no locality inherit the one locality in which their number and street occur. Whatever level has several
candidates stays open: the record keeps them all in `candidates` (level:value) and is linked only to records that are open between
the same ones.

Likeness is found by equi-joins on deletion variants (two words within one edit share a variant), on distinct names only;
no pairs within a group are formed but those of the result. Dictionaries are of localities and streets, not of records.

Defined results: records with null or blank address are left out; an address without a house number keeps its folded text
as a location of its own; records of equal text are always the same location.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored as cut
from .canonical import distance

# Postal abbreviations.
STREET_TYPES = {
    "street": "street st str", "avenue": "avenue ave av aven avn", "boulevard": "boulevard blvd boul blv", "drive": "drive dr drv", "road": "road rd",
    "lane": "lane ln la", "parkway": "parkway pkwy pky parkwy", "court": "court ct", "place": "place pl", "square": "square sq",
    "highway": "highway hwy", "circle": "circle cir", "way": "way wy", "terrace": "terrace ter terr", "trail": "trail trl",
}
DIRECTIONS = {"n": "n no north", "s": "s so south", "e": "e east", "w": "w west", "ne": "ne northeast", "nw": "nw northwest", "se": "se southeast", "sw": "sw southwest"}
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split()
STATES = set("al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc".split())
UNIT = re.compile(r"(?:\b(?:ste|suite|fl|floor|flr|unit|rm|room|apt|bldg|building)\b\.?\s*#?\s*|#\s*)(\d+[a-z]?|[a-z]\d*)\b\.?")
CAMPUS = set("campus pavilion tower building wing clinic hospital center centre institute annex main medical".split())
# ------------------------------------------------------------------
TYPE_OF = {w: k for k, v in STREET_TYPES.items() for w in v.split()}
DIR_OF = {w: k for k, v in DIRECTIONS.items() for w in v.split()}
PARTS = "struct<number:string,dir:string,street:string,kind:string,rest:string,city:string,state:string,zip:string,unit:string>"


def fold(text: str | None) -> str:
    text = unicodedata.normalize("NFKD", text or "")
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def _ordinal(word: str) -> str:
    m = re.fullmatch(r"(\d{1,2})(st|nd|rd|th)", word)
    return ORDINALS[int(m[1]) - 1] if m and 0 < int(m[1]) <= len(ORDINALS) else word


def parse(address: str | None, location: str | None = None) -> dict[str, str | None]:
    """The parts of one address; rest holds street and city words that only the locality can tell apart."""
    out: dict[str, str | None] = dict.fromkeys(("number", "dir", "street", "kind", "rest", "city", "state", "zip", "unit"))
    text = re.sub(r"\s-\s|[\n\r]+", " ; ", fold(address))
    unit = UNIT.search(text)
    if unit:
        out["unit"] = unit[1]
        # a unit at the start is followed by the house number without a separator
        text = text[: unit.start()] + (" ; " if text[: unit.start()].strip(" ,;") else " ") + text[unit.end() :]
    segments = [re.findall(r"[a-z0-9'-]+", s.replace(".", " ")) for s in re.split(r"[,;]", text)]
    segments = [s for s in segments if s]
    for s in segments:  # the ZIP code: five digits that do not open a street
        for k, w in enumerate(s):
            if re.fullmatch(r"\d{5}(-\d{4})?", w) and out["zip"] is None:
                opens = k == 0 and len(s) > 1 and not any(x and x[0][0].isdigit() for x in segments if x is not s) and any(x in TYPE_OF for x in s[1:]) and s[-1] not in STATES
                if not opens:
                    out["zip"] = w[:5]
                    del s[k]
                    break
    home = next((s for s in segments if s and s[0][0].isdigit()), None)
    for s in segments:
        if s is home or not s:
            continue
        if s[-1] in STATES and (len(s) > 1 or out["state"] is None):
            out["state"] = s.pop()
        if s and all(w in DIR_OF for w in s) and home is not None:
            home += s
            continue
        if s and out["city"] is None:
            out["city"] = " ".join(s)
    if home:
        out["number"], words = home[0], home[1:]
        if len(segments) == 1 and len(words) > 1 and words[-1] in STATES and (words[-1] not in TYPE_OF or out["zip"]):
            out["state"] = words.pop()
        at = next((k for k, w in enumerate(words) if w in TYPE_OF and k > 0), None)
        if at is not None:
            out["kind"] = TYPE_OF[words[at]]
            name, after = words[:at], words[at + 1 :]
            if after and after[0] in DIR_OF:
                out["dir"] = DIR_OF[after.pop(0)]
            if after and out["state"] is None and after[-1] in STATES:
                out["state"] = after.pop()
            if after and out["city"] is None:
                out["city"] = " ".join(after)
        else:
            name = words
            if len(name) > 1 and name[-1] in DIR_OF:
                out["dir"] = DIR_OF[name.pop()]
        if len(name) > 1 and name[0] in DIR_OF:
            out["dir"] = DIR_OF[name.pop(0)]
        name = [_ordinal(w) for w in name]
        if at is None and out["city"] is None and len(name) > 1 and (out["zip"] or out["state"]):
            out["rest"] = " ".join(name)
        out["street"] = "".join(name) or None
    if out["city"] is None and out["rest"] is None:
        city, state = place(location)
        out["city"] = city
        out["state"] = out["state"] or state
    return out


def place(location: str | None) -> tuple[str | None, str | None]:
    """(city, state) that a location names, if it names any beside buildings and institutions."""
    state, best = None, None
    for part in re.split(r"[,()]", fold(location)):
        words = re.findall(r"[a-z'-]+", part)
        if words and words[-1] in STATES and (len(words) > 1 or best):
            state = words.pop()
        if words and not any(w in CAMPUS for w in words) and best is None:
            best = " ".join(words)
    return best, state


def parse_udf(address: str, location: str) -> Column:
    @F.pandas_udf(PARTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([parse(*x) for x in zip(a, b)])

    return run(address, location)


def variants(word: Column) -> Column:
    """The word and what is left of it without any one letter."""
    holes = F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word))))
    return F.array_distinct(F.when(F.length(word) > 3, F.concat(F.array(word), holes)).otherwise(F.array(word)))


def edits(a: str, b: str) -> Column:
    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else distance(p, q) for p, q in zip(x, y)], dtype="Int32")

    return run(a, b)


def join_spellings(names: DataFrame, keys: list[str], word: str) -> DataFrame:
    """names: distinct (keys, word, n). Adds `main`: the commonest spelling within one edit (among those within it, the first by (n, word)).

    Two rounds, so that a spelling two steps from the main one reaches it through a commoner neighbour.
    """
    # a spelling's variants contain a shared one for each spelling within one edit; keys keep the groups apart
    base = names.select(*keys, word, "n")
    a = base.withColumn("v", F.explode(variants(F.col(word))))
    b = a.select(*keys, "v", F.col(word).alias("other"), F.col("n").alias("m"))
    near = a.join(b, [*keys, "v"]).filter((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col(word))))
    near = near.select(*keys, word, "n", "other", "m").distinct().filter(edits(word, "other") <= 1)
    up = near.groupBy(*keys, word).agg(F.max_by("other", F.struct("m", "other")).alias("up"))
    one = base.join(up, [*keys, word], "left").withColumn("up", F.coalesce("up", word))
    two = one.select(*keys, F.col(word).alias("up"), F.col("up").alias("top"))
    return one.join(two, [*keys, "up"], "left").select(*keys, word, F.coalesce("top", "up").alias("main"))


def locate(records: DataFrame, row_id: str = "meta_id") -> DataFrame:
    """(row_id, level, location, unit, candidates) of every record with an address. location: the folded key of the place."""
    rows = records.filter("trim(hospital_address) <> ''").select(F.col(row_id).cast("long").alias("row_id"), "hospital_address", "hospital_location")
    rows = cut(rows.withColumn("p", parse_udf("hospital_address", "hospital_location")).select("row_id", F.lower(F.trim("hospital_address")).alias("text"), "p.*"))

    # 1. localities: what most records say of a ZIP code, with one city spelling per region
    said = rows.filter("zip is not null and city is not null").groupBy("zip", "city", "state").agg(F.count("*").alias("n"))
    by_zip = said.groupBy("zip").agg(F.max_by("city", F.struct("n", "city")).alias("zcity"), F.max_by("state", F.struct(F.col("state").isNotNull(), "n", "state")).alias("zstate"))
    known = by_zip.groupBy(F.col("zcity").alias("kcity"), F.coalesce("zstate", F.lit("")).alias("kstate")).agg(F.count("*").alias("n"))
    known = known.unionByName(  # cities that never came with a ZIP code are localities as they are typed
        rows.filter("zip is null and city is not null and state is not null").groupBy(F.col("city").alias("kcity"), F.col("state").alias("kstate")).agg(F.count("*").alias("n"))
    ).groupBy("kcity", "kstate").agg(F.sum("n").alias("n"))
    weight = said.groupBy(F.col("city").alias("kcity"), F.coalesce("state", F.lit("")).alias("kstate")).agg(F.sum("n").alias("w"))
    known = known.join(weight, ["kcity", "kstate"], "left").select("kcity", "kstate", F.coalesce("w", "n").alias("n"))
    cities = cut(join_spellings(known, ["kstate"], "kcity").join(known, ["kstate", "kcity"]))
    typed = rows.filter("zip is null and city is not null").groupBy("city", F.coalesce("state", F.lit("")).alias("state")).agg(F.count("*").alias("n"))
    places = cities.filter("kcity = main").select("kstate", F.col("main").alias("kcity"), "n")
    a = typed.withColumn("v", F.explode(variants(F.col("city"))))
    b = places.withColumn("v", F.explode(variants(F.col("kcity"))))
    cand = a.join(b.withColumnRenamed("n", "m"), "v").filter("state = '' or state = kstate or kstate = ''").select("city", "state", "kcity", "kstate", "m").distinct()
    cand = cand.withColumn("d", edits("city", "kcity")).filter("d <= 1")
    best = cand.withColumn("low", F.min("d").over(Window.partitionBy("city", "state"))).filter("d = low")
    best = best.groupBy("city", "state").agg(F.max_by(F.struct("kcity", "kstate"), F.struct("m", "kcity")).alias("k"), F.count_distinct("kstate").alias("regions"))
    best = best.filter("regions = 1").select("city", F.col("state").alias("rstate"), F.concat_ws("|", "k.kcity", "k.kstate").alias("by_city"))
    zips = by_zip.join(cities.select("kstate", "kcity", "main"), (F.col("zcity") == F.col("kcity")) & (F.coalesce("zstate", F.lit("")) == F.col("kstate")), "left")
    zips = zips.select("zip", F.concat_ws("|", F.coalesce("main", "zcity"), F.coalesce("zstate", F.lit(""))).alias("by_zip"), F.size(F.split("zcity", " ")).alias("zwords"))
    rows = rows.join(zips, "zip", "left").withColumn("rstate", F.coalesce("state", F.lit(""))).join(best, ["city", "rstate"], "left")
    rows = rows.withColumn("locality", F.coalesce("by_zip", "by_city", F.when(F.col("city").isNotNull() & F.col("state").isNotNull(), F.concat_ws("|", "city", "state"))))
    words = F.split("rest", " ")
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.size(words) - F.coalesce("zwords", F.lit(1)))), "")
    rows = rows.withColumn("street", F.when(F.col("rest").isNotNull(), head).otherwise(F.col("street"))).drop("city", "rstate", "by_zip", "by_city", "zwords", "rest")
    rows = cut(rows)

    # records without locality inherit the only one that has their number and street
    lost = rows.filter("locality is null and number is not null and street is not null").select("number", "street", F.coalesce("dir", F.lit("")).alias("d")).distinct()
    b = rows.filter("locality is not null and number is not null").groupBy("number", "street", F.coalesce("dir", F.lit("")).alias("d"), "locality").count()
    bv = b.withColumn("v", F.explode(variants(F.col("street")))).select("number", "d", "v", "locality", F.col("street").alias("other"))
    near = lost.withColumn("v", F.explode(variants(F.col("street")))).join(bv, ["number", "d", "v"]).filter(edits("street", "other") <= 1)
    heirs = near.groupBy("number", "street", "d").agg(F.array_sort(F.collect_set("locality")).alias("heirs"))
    rows = rows.withColumn("d", F.coalesce("dir", F.lit(""))).join(heirs, ["number", "street", "d"], "left").drop("d")
    rows = rows.withColumn("heirs", F.when(F.col("locality").isNull(), F.col("heirs")))
    rows = rows.withColumn("level", F.when(F.col("locality").isNotNull(), "located").when(F.size("heirs") == 1, "inherited").otherwise("open"))
    rows = rows.withColumn("candidates", F.when(F.size("heirs") > 1, F.transform("heirs", lambda x: F.concat(F.lit("locality:"), x))).otherwise(F.array().cast("array<string>")))
    unsure = F.concat(F.lit("?"), F.when(F.size("heirs") > 1, F.hex(F.xxhash64("heirs"))).otherwise(""))
    rows = rows.withColumn("locality", F.coalesce("locality", F.when(F.size("heirs") == 1, F.get("heirs", F.lit(0))), unsure)).drop("heirs")

    # 2. streets: a rare spelling of a name known elsewhere takes that name, then spellings join within a locality and number
    named = rows.filter("street is not null").groupBy("street").agg(F.count("*").alias("n"))
    everywhere = join_spellings(named, [], "street").join(named, "street").join(named.select(F.col("street").alias("main"), F.col("n").alias("m")), "main")
    rows = rows.join(everywhere.filter("m >= 3 * n").select("street", "main"), "street", "left").withColumn("street", F.coalesce("main", "street")).drop("main")
    spelt = rows.filter("number is not null and street is not null").groupBy("locality", "number", "street").agg(F.count("*").alias("n"))
    streets = join_spellings(spelt, ["locality", "number"], "street")
    rows = rows.join(streets, ["locality", "number", "street"], "left").withColumn("street", F.coalesce("main", "street")).drop("main")
    rows = cut(rows)

    # 3. direction, then type: inherited where there is one candidate
    for part, keys in (("dir", ["locality", "number", "street"]), ("kind", ["locality", "number", "street", "dir"])):
        only = rows.filter(f"{part} is not null").groupBy(*keys).agg(F.array_sort(F.collect_set(part)).alias("ones"))
        only = only.select(*[F.col(k).alias(f"k_{k}") for k in keys], "ones")
        same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
        rows = rows.join(only, same, "left").withColumn("ones", F.when(F.col(part).isNull(), F.col("ones")))
        several = F.when(F.size("ones") > 1, F.transform("ones", lambda x: F.concat(F.lit(f"{part}:"), x))).otherwise(F.array().cast("array<string>"))  # noqa: B023
        rows = rows.withColumn("candidates", F.concat("candidates", several)).withColumn(part, F.coalesce(part, F.when(F.size("ones") == 1, F.get("ones", F.lit(0)))))
        rows = rows.drop("ones", *[f"k_{k}" for k in keys])
    whole = F.concat_ws("/", "locality", "number", F.coalesce("dir", F.lit("")), "street", F.coalesce("kind", F.lit("")))
    location = F.when(F.col("number").isNotNull() & F.col("street").isNotNull(), whole).otherwise(F.concat(F.lit("text:"), "text"))
    return rows.select("row_id", "level", location.alias("location"), "unit", "candidates")


def with_units(located: DataFrame) -> DataFrame:
    """located with the unit level: a missing unit inherits the only one of its location, several become candidates. links: the other
    records of the location."""
    one = located.groupBy("location").agg(F.array_sort(F.collect_set("unit")).alias("units"), (F.count("*") - 1).alias("links"))
    x = located.join(one, "location").withColumn("units", F.when(F.col("unit").isNull(), F.col("units")))
    several = F.when(F.size("units") > 1, F.transform("units", lambda u: F.concat(F.lit("unit:"), u))).otherwise(F.array().cast("array<string>"))
    unit = F.coalesce("unit", F.when(F.size("units") == 1, F.get("units", F.lit(0))))
    return x.select("row_id", "level", "location", unit.alias("unit"), F.concat("candidates", several).alias("candidates"), "links")


def pairs(located: DataFrame, salts: int = 8) -> DataFrame:
    """(meta_id_a, meta_id_b), a < b, of records of one location. The pairs are the result; a place with very many records is
    formed by salts x salts tasks."""
    a = located.select("location", F.col("row_id").alias("meta_id_a"), F.pmod(F.xxhash64("row_id"), F.lit(salts)).alias("sa"))
    b = located.select("location", F.col("row_id").alias("meta_id_b"), F.pmod(F.xxhash64("row_id"), F.lit(salts)).alias("sb"))
    every = F.array(*(F.lit(k).cast("long") for k in range(salts)))
    a, b = a.withColumn("sb", F.explode(every)), b.withColumn("sa", F.explode(every))
    return a.join(b, ["location", "sa", "sb"]).filter("meta_id_a < meta_id_b").select("meta_id_a", "meta_id_b")
