"""Link variant spellings of payer names (problem 1) by merge-and-rematch.

Every distinct text of the name columns becomes a profile: lead name, region, id, initials, nickname form, after its
encoding is restored. Texts of equal parts are one profile from the start. Every round blocks the merged profiles on the
union of what their texts say, until a round merges nothing:

    id          the same id in a text of each
    spelling    a spelling of the lead within one edit of a spelling of a commoner profile of its region, as written or as
                spoken (ph for f)
    lost        a lead with lost letters that fits a lead of its region
    cut         a nickname (the lead cut short) of a lead of its region
    open        a lead without region
    initials    bare initials of lead, region and organisation words

The last four must meet one profile. A merge is refused where the merged profiles have different regions, leads that are not
spellings of each other, or ids of which none is common: a lead name with another region is another payer.

That two texts stand in one row, as raw and normalized name, is a hint only: it decides between several candidates, and once
no round merges anything it takes in profiles that stand beside exactly one other, under the same check.

Regions beyond the listed ones are told from leads by the data: of two unknown words the one that stands beside more
different words is the region, or else the one that stands second.

All steps are joins and aggregations on distinct texts with their counts, never on rows. A round merges into profiles that
stay, never along chains, so that everything merged was checked. Texts are known by a 64-bit hash. Lineage is cut per round.

Defined results: null texts name nobody; a text without lead and id (blank, signs only) is a payer of its own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored as cut
from . import encoding
from .address import edits, variants
from .canonical import distance

# Region words and the organisation words of payer names, each with customary short forms.
REGIONS = {
    "central": "central ctrl cent cntrl centr cen", "capital": "capital cap captl capt cptl", "highland": "highland highlands hilnd hghld hlnd highl hland",
    "southern": "southern s sthn south so southn soth sou", "northern": "northern n north nrthn no nthn northn nor", "eastern": "eastern e east estn eastn estrn",
    "western": "western w west wstn westn wstrn", "riverside": "riverside rvrsd rvrside river riversd", "mountain": "mountain mtn mount mt mntn",
    "island": "island is isl islnd islands", "valley": "valley vly vall val vlly", "prairie": "prairie pr prair prr", "harbor": "harbor harbour hbr harb hrbr",
    "midland": "midland midl mid mdlnd midlnd", "coastal": "coastal cstl coast coastl cst", "lakeside": "lakeside lake lksd lakesd lkside lakes",
}
ORG_WORDS = {
    "benefit": "benefit benefits ben bnft", "fund": "fund fd fnd", "administrators": "administrators administrator admin admins adm admr",
    "assurance": "assurance assr assur", "society": "society soc", "care": "care cr", "alliance": "alliance all allnc allc", "managed": "managed mgd",
    "association": "association assoc assn", "community": "community comm cmty commty", "health": "health hlth hlt", "network": "network net ntwk netw",
    "mutual": "mutual mutl mut", "insurance": "insurance ins insur", "company": "company co cmpny", "employees": "employees employee empl emps emp",
    "trust": "trust tr trst", "medical": "medical med", "group": "group grp gp", "plan": "plan pl pln", "services": "services service svc svcs serv",
    "corporation": "corporation corp", "plus": "plus",
}
NOISE = "inc llc ltd the of and lp co dba pc pllc corp".split()
# ------------------------------------------------------------------
REGION_OF = {w: k for k, v in REGIONS.items() for w in v.split()}
ORG_OF = {w: k for k, v in ORG_WORDS.items() for w in v.split()}
LOOKALIKE = str.maketrans("0135", "oise")


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def _near(word: str, regions: bool) -> str | None:
    """The group of a known long word within one edit (two for nine letters and more); empty where several regions are as near."""
    if len(word) < 4:
        return None
    known = REGION_OF if regions else ORG_OF
    near = sorted((distance(word, w), w) for w in known if len(w) > 3 and abs(len(w) - len(word)) < 3)
    if not near or near[0][0] > (2 if len(word) > 8 else 1):
        return None
    return "" if regions and len({known[w] for d, w in near if d == near[0][0]}) > 1 else known[near[0][1]]


def profile(name: str) -> dict:
    """lead, region, organisation initials, id, bare initials and free words of one spelling (encoding already restored; ? stands for a lost letter)."""
    out = {"lead": None, "region": None, "orgs": None, "id": None, "initials": None, "nick": False, "free": []}
    text = name.replace("�", "?")
    text = re.sub(r"(?<=[^\W\d_])(?=[A-ZÀ-Þ][a-zà-ÿ?])", " ", text) if " " not in text.strip() else text
    text = fold(text).strip(" *")
    m = re.search(r"[\s(\[_#-]*#?(\d{4,})[)\]]?\s*$", text)
    if m:
        out["id"] = m[1]
        text = text[: m.start()]
    text = re.sub(r"(?i)\s+d/?b/?a/?\s+.*$", "", text)
    text = re.sub(r"(?i)\(the\)|\bthe\b", " ", text)
    if m and re.fullmatch(r"[A-Z]{3,6}", text.strip()):
        out["initials"] = text.strip().lower()
        return out
    words = []
    for w in re.findall(r"[A-Za-z0-9?']+", text):
        w = w.lower().strip("'")
        if re.search("[0-9]", w) and re.search("[a-z]", w):
            w = w.translate(LOOKALIKE)
        words.append(w)
    words = [w for w in words if w and w not in ("of",)]
    while len(words) > 3 and words[-1] in ("inc", "llc", "ltd", "lp"):
        words.pop()
    kinds = [("region", REGION_OF[w]) if w in REGION_OF else ("org", ORG_OF[w]) if w in ORG_OF else None for w in words]
    free = [i for i, k in enumerate(kinds) if k is None]
    if len(free) > 1 or not any(k and k[0] == "region" for k in kinds):
        for i in list(free):
            if len(free) == 1 and any(k and k[0] == "region" for k in kinds):
                break
            r, o = _near(words[i], True), _near(words[i], False)
            if r and not any(k and k[0] == "region" for k in kinds):
                kinds[i] = ("region", r)
            elif r == "" and len(free) > 1 and not any(k and k[0] == "region" for k in kinds):
                kinds[i] = ("unclear", r)
            elif o:
                kinds[i] = ("org", o)
            else:
                continue
            free.remove(i)
    out["free"] = [words[i] for i, k in enumerate(kinds) if k is None and len(words[i]) > 1 and re.search("[a-z]", words[i])]
    out["region"] = next((k[1] for k in kinds if k and k[0] == "region"), None)
    out["lead"] = max(out["free"], key=len) if out["free"] and (out["region"] or len(out["free"]) == 1) else None
    orgs = [k[1] for k in kinds if k and k[0] == "org"]
    out["orgs"] = "".join(o[0] for o in orgs) or None
    out["nick"] = len(orgs) <= 1 and len(words) <= 3 and not re.search(r"\b[A-Z]{2,4}$", text.strip())
    return out


PROFILE = "struct<lead:string,region:string,orgs:string,id:string,initials:string,nick:boolean,free:array<string>>"


def profiles(texts: DataFrame, table: dict[str, str]) -> DataFrame:
    """texts(name, n[, restored]) -> key, name, n and the profile's parts. restored: texts that a join has restored."""

    @F.pandas_udf(PROFILE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        fix = encoding.Translator(table)
        for names, joined in batches:
            read = [fix(n)[0] if r is None else encoding.SUNK.sub(lambda m: m[0].upper(), r) for n, r in zip(names, joined)]
            yield pd.DataFrame([profile(t) for t in read], columns=["lead", "region", "orgs", "id", "initials", "nick", "free"])

    restored = F.col("restored") if "restored" in texts.columns else F.lit(None).cast("string")
    return texts.withColumn("p", run("name", restored)).select(F.xxhash64("name").alias("key"), "name", "n", "p.*")


def read(texts: DataFrame) -> DataFrame:
    """Profiles of texts(name, n) with their encoding restored, by a map or, where the learnt table is too large to send, by a join."""
    table = encoding.garbles(encoding.learn(texts, "name"))
    few = table.limit(encoding.BROADCAST_SYMBOLS + 1).collect()
    if len(few) <= encoding.BROADCAST_SYMBOLS:
        return profiles(texts, {r.symbol: r.letter for r in few})
    foreign = texts.filter(F.col("name").rlike(encoding.FOREIGN)).select(F.xxhash64("name").alias("row_id"), F.col("name").alias("text"))
    fixed = encoding._by_join(foreign, table, lost=True).select(F.col("text").alias("name"), "restored")
    return profiles(texts.join(fixed, "name", "left"), {})


def settle_regions(p: DataFrame) -> DataFrame:
    """Lead and region of texts with two unknown words; a shortened or misspelt word counts as the commonest that it stands for."""
    long = F.filter("free", lambda w: F.length(w) > 2)  # site codes are shorter
    free = p.filter("lead is null and size(free) >= 2").withColumn("free", F.when(F.size(long) > 1, long).otherwise(F.col("free"))).select("key", "n", F.get("free", F.lit(0)).alias("a"), F.get("free", F.lit(1)).alias("b"))
    both = free.selectExpr("key", "n", "a as w", "b as o", "0 as second").unionByName(free.selectExpr("key", "n", "b as w", "a as o", "n as second"))
    stats = both.groupBy("w").agg(F.sum("n").alias("rows"))
    head = F.concat(F.substring("w", 1, 1), F.substring(F.regexp_replace(F.translate(F.substring("w", 2, 99), "w", "v"), "[aeiou?]", ""), 1, 2))
    stats = stats.withColumn("h", head)
    mains = stats.groupBy("h").agg(F.max_by("w", F.struct("rows", "w")).alias("main"))
    short = F.rlike("main", F.regexp_replace(F.array_join(F.split("w", ""), ".*"), "[^a-z0-9.*]", "."))
    side = cut(stats.join(mains, "h").select("w", F.when(short | (edits("w", "main") <= 2), F.col("main")).otherwise(F.col("w")).alias("main")))
    both = both.join(side, "w").join(side.select(F.col("w").alias("o"), F.col("main").alias("beside")), "o")
    score = both.groupBy("main").agg(F.count_distinct("beside").alias("partners"), (F.sum("second") / F.sum("n")).alias("second"))
    pick = both.drop("second").join(score, "main").groupBy("key").agg(F.max_by(F.struct("main", "o"), F.struct("partners", "second", "w")).alias("best"))
    pick = pick.select("key", F.col("best.o").alias("lead2"), F.col("best.main").alias("region2"))
    return p.join(pick, "key", "left").withColumn("lead", F.coalesce("lead", "lead2")).withColumn("region", F.coalesce("region", "region2")).drop("lead2", "region2", "free")


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(key, label): the least key of each node's component. edges(a, b) may name hubs that are no nodes. Raises where labels still change after the rounds."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    labels = cut(both.select(F.col("a").alias("key")).distinct().withColumn("label", F.col("key")))
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        new = labels.join(seen, "key").select("key", "label", F.least("label", "near").alias("low"))
        # pointer jump: the label's own label
        jump = new.select(F.col("key").alias("low"), F.col("low").alias("lower"))
        new = cut(new.join(jump, "low", "left").select("key", F.col("label").alias("old"), F.least("low", "lower").alias("label")))
        if new.filter("old <> label").isEmpty():
            break
        labels = new.drop("old")
    else:
        raise ValueError(f"components: labels still change after {rounds} rounds")
    return nodes.select("key").join(labels, "key", "left").select("key", F.coalesce("label", "key").alias("label"))


def hub(kind: str, *parts: str | Column) -> Column:
    return F.xxhash64(F.lit(kind), *(F.col(p) if isinstance(p, str) else p for p in parts))


def sound(word: str) -> Column:
    """A lead as it is spoken."""
    return F.regexp_replace(F.regexp_replace(word, "ph", "f"), "ck", "k")


def alike(kind: str, a: str, b: str) -> Column:
    """Leads that may be spellings of each other, as written or as spoken: within two edits, or the shorter one, of four letters at
    least, within one edit of the beginning of the other."""

    def cut_short(p: str, q: str) -> bool:
        p, q = sorted((p, q), key=len)
        return len(p) > 3 and any(distance(p, q[: len(p) + d]) <= 1 for d in (0, 1, -1))

    def near(k: str, x: str | None, y: str | None) -> bool:
        said = [(x, y), (x.replace("ph", "f").replace("ck", "k"), y.replace("ph", "f").replace("ck", "k"))] if x and y and k != "lost" else []
        return not said or any(distance(p, q) <= 2 or cut_short(p, q) for p, q in said)

    @F.pandas_udf("boolean")
    def run(k: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([near(*z) for z in zip(k, x, y)], dtype=bool)

    return run(kind, a, b)


def resolve(rows: DataFrame, columns: tuple[str, str] = ("raw_payer_name", "payer_name"), hint: bool = True) -> DataFrame:
    """(name, entity): every distinct text of the columns with the id of its payer. hint: texts of one row decide where the profiles leave it open."""
    raw, norm = columns
    pairs = cut(rows.groupBy(F.col(raw).alias("x"), F.col(norm).alias("y")).agg(F.count("*").alias("n")))
    texts = reduce(DataFrame.unionByName, [pairs.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.sum("n").alias("n")) for c in ("x", "y")])
    texts = texts.groupBy("name").agg(F.sum("n").alias("n"))
    p = settle_regions(cut(read(texts)))  # profiles are read several times

    # first profiles: texts of the same parts
    named = F.col("lead").isNotNull() & F.col("region").isNotNull()
    kind = F.when(named & F.col("lead").contains("?"), "lost").when(named & F.col("nick"), "cut").when(named, "full").when(F.col("lead").isNotNull(), "open").when(F.col("initials").isNotNull(), "bare")
    p = p.withColumn("kind", kind).withColumn("full", F.coalesce(F.col("kind") == "full", F.lit(False)))
    same = F.when(F.col("kind") == "bare", hub("bare", "initials", "id")).when(F.col("kind") == "open", hub("open", "lead")).otherwise(F.xxhash64("kind", "region", "lead"))
    p = p.withColumn("label", F.when(F.col("kind").isNull(), F.col("key")).otherwise(same))
    own = F.lower(F.concat(F.substring("lead", 1, 1), F.substring("region", 1, 1), "orgs"))
    p = cut(p.withColumn("initials", F.when(F.col("full"), own).otherwise(F.col("initials"))))
    key = p.select("name", "key")
    rowmates = pairs.filter("x <> y").join(key.toDF("x", "a"), "x").join(key.toDF("y", "b"), "y").select("a", "b")
    rowmates = cut(rowmates.unionByName(rowmates.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()) if hint else None

    while True:  # every round takes at least one profile away
        m = cut(merged(p))
        at = p.select("key", "label")
        beside = cut(rowmates.join(at.toDF("a", "label"), "a").join(at.toDF("b", "other"), "b").filter("label <> other").select("label", "other").distinct()) if hint else None
        links = cut(rematch(p, m, beside))
        if links.isEmpty() and hint:
            links = cut(settle(checked(m, beside.withColumn("kind", F.lit("hint"))).withColumn("hinted", F.lit(True))))
        if links.isEmpty():
            break
        p = cut(p.join(links, "label", "left").withColumn("label", F.coalesce("other", "label")).drop("other"))
    return p.select("name", F.col("label").alias("entity"))


def merged(p: DataFrame) -> DataFrame:
    """One row per profile: the lead and region that most of its texts have, and the union of its ids; whole: lead and region are written out."""
    most = lambda c: F.max_by(c, F.struct(F.col(c).isNotNull(), "full", "n", c)).alias(c)
    return p.groupBy("label").agg(F.sum("n").alias("n"), F.max("full").alias("whole"), most("region"), most("lead"), F.collect_set("id").alias("ids"))


def rematch(p: DataFrame, m: DataFrame, beside: DataFrame | None) -> DataFrame:
    """(label, other): profiles to merge, blocked on all their spellings, ids and initials. An id decides before a spelling, a spelling
    goes to the commonest profile, anything else must meet one profile only, or the one that stands beside it in some row."""
    p = p.join(m.select("label", "whole"), "label").withColumn("lead", F.explode(F.array_distinct(F.array("lead", sound("lead")))))
    full = p.filter("full")
    spelt = full.select("label", "region", "lead").distinct()
    no = F.lit(None).cast("string")
    block = lambda side, df, k, *parts, lead=no: df.select("label", F.lit(side).alias("side"), F.lit(k).alias("kind"), hub(k, *parts).alias("block"), lead.alias("lead"))
    heads = spelt.withColumn("k", F.explode(F.sequence(F.lit(4), F.greatest(F.lit(4), F.length("lead") - 1)))).withColumn("head", F.expr("substring(lead, 1, k)"))
    part, word, size = p.filter("not whole"), F.col("lead"), F.length("lead")
    blocks = [block("ab", p.filter("id is not null"), "id", "id"), block("ab", spelt.withColumn("v", F.explode(variants(word))), "spelling", "region", "v", lead=word)]
    blocks += [block("a", part.filter("kind = 'lost'"), "lost", "region", size, lead=word), block("b", spelt, "lost", "region", size, lead=word)]
    blocks += [block("a", part.filter("kind = 'cut'"), "cut", "region", "lead"), block("b", heads, "cut", "region", "head")]
    blocks += [block("a", part.filter("kind = 'open'"), "open", "lead"), block("b", spelt, "open", "lead")]
    blocks += [block("a", part.filter("initials is not null"), "initials", "initials"), block("b", full.filter("initials is not null"), "initials", "initials")]
    blocks = cut(reduce(DataFrame.unionByName, blocks).distinct())
    far = blocks.filter("side <> 'a'").select(F.col("label").alias("other"), "kind", "block", F.col("lead").alias("lead2"))
    met = blocks.filter("side <> 'b'").join(far, ["kind", "block"]).filter("label <> other")
    met = met.select("label", "other", "kind", "lead", "lead2").distinct()
    fits = F.when(F.col("kind") == "spelling", edits("lead", "lead2") <= 1).when(F.col("kind") == "lost", F.rlike("lead2", F.concat(F.lit("^"), F.regexp_replace("lead", r"\?", "."), F.lit("$")))).otherwise(True)
    cand = checked(m, met.filter(fits).select("label", "other", "kind").distinct()).filter("whole2")
    if beside is None:
        cand = cand.withColumn("hinted", F.lit(False))
    else:
        cand = cand.join(beside.withColumn("hinted", F.lit(True)), ["label", "other"], "left").fillna(False, ["hinted"])
    return settle(cand)


def checked(m: DataFrame, cand: DataFrame) -> DataFrame:
    """Candidates (label, other, kind) from the lesser to the greater profile that region, lead and ids allow."""
    far = m.select(F.col("label").alias("other"), *(F.col(c).alias(f"{c}2") for c in ("n", "whole", "region", "lead", "ids")))
    c = cand.join(m, "label").join(far, "other").filter(F.struct("whole", "n", "label") < F.struct(F.col("whole2").alias("whole"), F.col("n2").alias("n"), F.col("other").alias("label")))
    c = c.filter("(region is null or region2 is null or region = region2) and (size(ids) = 0 or size(ids2) = 0 or arrays_overlap(ids, ids2))")
    return c.filter(alike("kind", "lead", "lead2"))


def settle(cand: DataFrame) -> DataFrame:
    """One target per profile, and only profiles that stay as targets; what is merged into one target agrees with each other."""
    rank = F.when(F.col("kind") == "id", 0).when(F.col("kind") == "spelling", 1).otherwise(2)
    target, order = F.struct("other", "hinted", "ids2", "whole2"), F.struct("n2", "other")
    by = cand.withColumn("rank", rank).groupBy("label", "rank").agg(
        F.first("n").alias("n"), F.first("ids").alias("ids"), F.count_distinct("other").alias("c"), F.max_by(target, order).alias("top"),
        F.count_distinct(F.when(F.col("hinted"), F.col("other"))).alias("near_c"), F.max_by(target, F.when(F.col("hinted"), order)).alias("near"),
    )
    by = by.groupBy("label").agg(F.min_by(F.struct("n", "ids", "c", "top", "near_c", "near", "rank"), "rank").alias("b")).select("label", "b.*")
    one = F.when((F.col("rank") == 1) | (F.col("c") == 1), F.col("top")).when(F.col("near_c") == 1, F.col("near"))
    links = cut(by.select("label", "n", "ids", one.alias("t")).filter("t is not null").select("label", "n", "ids", "t.*"))
    links = links.join(links.select(F.col("label").alias("other")), "other", "left_anti")
    # several ids for a target that has none: the one that stands beside it, else none; a target without lead or region says
    # nothing about what joins it, so one at a time
    named = F.size("ids") > 0
    per = links.groupBy("other").agg(
        F.max_by("label", F.struct("n", "label")).alias("first"), F.count_distinct(F.when(named, F.array_sort("ids"))).alias("c"), F.min(F.when(named, F.array_sort("ids"))).alias("only"),
        F.max_by("ids", F.when(named & F.col("hinted"), F.struct("n", "label"))).alias("near"),
    )
    per = per.select("other", "first", F.coalesce("near", F.when(F.col("c") == 1, F.col("only"))).alias("pick"))
    agrees = ~named | (F.size("ids2") > 0) | F.coalesce(F.arrays_overlap("ids", "pick"), F.lit(False))
    return links.join(per, "other").filter(agrees & (F.col("whole2") | (F.col("label") == F.col("first")))).select("label", "other")


def found(resolved: DataFrame, salts: int = 8) -> DataFrame:
    """(name_a, name_b), a < b by code point: the pairs of distinct texts of one payer, formed by salts x salts tasks per payer."""
    side = lambda n, s: resolved.select("entity", F.col("name").alias(n), F.pmod(F.xxhash64("name"), F.lit(salts)).alias(s))
    every = F.array(*(F.lit(k).cast("long") for k in range(salts)))
    a, b = side("name_a", "sa").withColumn("sb", F.explode(every)), side("name_b", "sb").withColumn("sa", F.explode(every))
    return a.join(b, ["entity", "sa", "sb"]).filter("name_a < name_b").select("name_a", "name_b")
