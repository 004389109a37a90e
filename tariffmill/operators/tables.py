"""Header plans and rows of tables -> charge items, standard charges, payer rates, unmapped cells.

plan() turns the headers of all files into one small table: a row per column with what it means (header_mappings) and a row
per file with the positions of every field, code pair, payer group and unmapped column. rows() joins that plan to the data
rows and reads each field by position, so files of different layouts run in one job and no cell is exploded that is not
unpivoted. Every output row carries (file_id, ord, sub) so that first-wins steps do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, headers, payers, values
from ..functions.values import blank_to_null, safe_count, safe_float
from ..session import cut
from .ordered import before_boundary, capped, first_wins

UNMAPPED_CAP, PEEK, LEAST_PAYER_COLUMNS = 2000, 50, 3
# Outpatient columns that stand in for empty or zero inpatient ones; price fields.
FALLBACKS = {"negotiated_rate": "op_price", "min_negotiated_rate": "min_op_reimb", "max_negotiated_rate": "max_op_reimb", "estimated_amount": "op_expected_reimbursement"}
PRICES = ["gross_charge", "discounted_cash_price", "negotiated_rate", "min_negotiated_rate", "max_negotiated_rate", "estimated_amount", "median_amount"]
RATE_NUMBERS = ["negotiated_rate", "negotiated_percentage", "estimated_amount", "median_amount", "pct_10", "pct_90"]
RATE_TEXTS = ["negotiated_algorithm", "methodology", "additional_notes", "footnote"]
# ------------------------------------------------------------------
KEY = ["code", "code_type", "billing_class", "setting", "modifiers"]


def columns(heads: DataFrame, peek: DataFrame | None = None, overrides: dict[str, str] | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """heads(file_id, cells) -> one row per column: file_id, pos, source_header, normalized, mapped_to, role, part, field, setting.

    peek(file_id, cells): rows by which plain columns of amounts are told to be payers. The order of roles: payer headers,
    synonyms, the caller's overrides and synonyms, three settings, two settings, outpatient price, plain payer columns.
    """
    h = F.col("source_header")
    cols = heads.select("file_id", F.posexplode("cells").alias("pos", "source_header"))
    cols = cols.withColumn("pos", F.max("pos").over(Window.partitionBy("file_id", "source_header"))).distinct()  # of equal headers the last holds
    cols = cols.withColumns({"normalized": headers.normalize_header(h), "wide": headers.wide_payer(h)})
    field = headers.canonical(h)
    if overrides:
        field = F.coalesce(field, headers.lookup({}, h) if not overrides else F.try_element_at(F.create_map(*(F.lit(x) for k, v in overrides.items() if v in headers.SYNONYMS for x in (k, v))), h))
    if extra:
        field = F.coalesce(field, headers.canonical(h, extra))
    cols = cols.withColumn("canon", F.when(F.col("wide").isNull(), field))
    open_ = F.col("wide").isNull() & F.col("canon").isNull() & ~headers.low_value(F.col("normalized"))
    file = Window.partitionBy("file_id")
    has = lambda table, names: F.size(F.array_intersect(F.collect_set(F.when(open_, F.col("normalized"))).over(file), F.array(*map(F.lit, names)))) == len(names)
    three, two = list(headers.THREE_SETTINGS)[:3], list(headers.TWO_SETTINGS)[:2]
    cols = cols.withColumns({"three": has(None, three), "two": has(None, two)}).withColumn("two", F.col("two") & ~F.col("three"))
    pick = lambda table, k: F.try_element_at(F.create_map(*(F.lit(x) for n, v in table.items() for x in (n, v[k]))), F.col("normalized"))
    sp = F.when(F.col("three") & open_, headers.setting_payer(h))
    cols = cols.withColumns({
        "s_field": F.when(open_ & F.col("three"), pick(headers.THREE_SETTINGS, 0)).when(open_ & F.col("two"), pick(headers.TWO_SETTINGS, 0)),
        "s_setting": F.when(open_ & F.col("three"), pick(headers.THREE_SETTINGS, 1)).when(open_ & F.col("two"), pick(headers.TWO_SETTINGS, 1)), "s_payer": sp,
        "minmax": open_ & F.col("two") & (F.col("normalized") == "min_max"),
        "outpatient": open_ & ~F.col("three") & ~F.col("two") & (F.col("normalized") == "outpatient_price"),
    })
    rest = open_ & F.col("s_field").isNull() & F.col("s_payer").isNull() & ~F.col("minmax") & ~F.col("outpatient")
    cols = cols.withColumn("rest", rest)
    payer_like = F.lit(False)
    if peek is not None:
        cell = peek.select("file_id", F.posexplode("cells").alias("pos", "v")).withColumn("v", blank_to_null(F.col("v")))
        cell = cell.filter(F.col("v").isNotNull() & ~values.is_null_rate(F.col("v")))
        share = cell.groupBy("file_id", "pos").agg(F.avg(F.when(values.looks_like_dollars(F.col("v")), 1.0).otherwise(0.0)).alias("share"))
        plain = F.max(F.col("wide").isNotNull() | (F.coalesce(F.col("canon"), F.lit("")) == "payer_name")).over(file)
        cols = cols.join(share, ["file_id", "pos"], "left").withColumn("like", F.col("rest") & (F.coalesce("share", F.lit(0.0)) >= 0.5) & ~plain)
        cols = cols.withColumn("like", F.col("like") & (F.sum(F.col("like").cast("int")).over(file) >= LEAST_PAYER_COLUMNS)).drop("share")
        payer_like = F.col("like")
    nobody = payers.names_nobody(h)
    wide = F.col("wide.field").isNotNull()
    role = (
        F.when(wide | (payer_like & ~nobody), "payer").when(F.col("canon").isNotNull(), "field").when(F.col("s_field").isNotNull(), "setting")
        .when(F.col("s_payer").isNotNull(), "setting_payer").when(F.col("minmax"), "minmax").when(F.col("outpatient"), "outpatient")
        .when(F.col("normalized").isin(list(FALLBACKS.values())), "fallback").when(F.col("rest") & ~payer_like, "unmapped").otherwise("dropped")
    )
    cols = cols.withColumn("role", role)
    mapped = (
        F.when(F.col("role") == "payer", F.concat(F.lit("wide_payer:"), F.coalesce("wide.field", F.lit("negotiated_rate"))))
        .when(F.col("role") == "setting", F.concat(F.when(F.col("three"), "hawaii_wide:").otherwise("atrium_wide:"), "s_field", F.lit(":"), "s_setting"))
        .when(F.col("role") == "setting_payer", F.concat(F.lit("hawaii_payer:"), "s_payer.setting", F.lit(":"), "s_payer.methodology"))
        .when(F.col("minmax"), "atrium_wide:min_max_indicator").when(F.col("outpatient"), "outpatient_gross:gross_charge:outpatient").otherwise(F.col("canon"))
    )
    return cols.select(
        "file_id", "pos", "source_header", "normalized", mapped.alias("mapped_to"), "role",
        F.coalesce("wide.payer", "s_payer.payer", F.when(payer_like, F.trim(h))).alias("payer"), F.coalesce("wide.plan", F.lit("")).alias("plan"),
        F.coalesce("canon", "wide.field", "s_field", F.when(payer_like, F.lit("negotiated_rate"))).alias("field"),
        F.coalesce("s_setting", "s_payer.setting").alias("setting"), F.col("s_payer.methodology").alias("methodology"), "three", "two",
    )


def plan(cols: DataFrame) -> DataFrame:
    """columns -> one row per file with the positions of everything."""
    c = F.col
    take = lambda role, *what: F.array_sort(F.collect_list(F.when(c("role") == role, F.struct("pos", *what))))
    out = cols.groupBy("file_id").agg(
        take("field", "field", "source_header").alias("fields"), take("payer", "payer", "plan", "field").alias("payers"), take("setting", "field", "setting").alias("settings"),
        take("setting_payer", "payer", "setting", "methodology").alias("setting_payers"), take("unmapped", "source_header").alias("unmapped"), take("fallback", "normalized").alias("fallbacks"),
        F.max(F.when(c("role") == "minmax", c("pos"))).alias("minmax"), F.max(F.when(c("role") == "outpatient", c("pos"))).alias("outpatient"),
        F.max("three").alias("three"), F.max("two").alias("two"), (F.max("pos") + 1).alias("width"),
    )
    code = F.filter("fields", lambda f: f["field"] == "code")
    kind = F.filter("fields", lambda f: f["field"] == "code_type")
    index = lambda f: F.trim(F.get(F.split(f["source_header"], r"\|"), F.lit(1)))
    many = F.transform(code, lambda f: F.struct(
        f["pos"].alias("code"),
        F.when(index(f).isNotNull(), F.get(F.filter(kind, lambda k: (index(k) == index(f)) & (F.size(F.split(k["source_header"], r"\|")) >= 3)), F.lit(0))["pos"])
        .otherwise(F.get(kind, F.lit(0))["pos"]).alias("kind"),
    ))
    one = F.when(F.size(code) + F.size(kind) > 0, F.array(F.struct(F.get(code, F.lit(0))["pos"].alias("code"), F.get(kind, F.lit(0))["pos"].alias("kind"))))
    return out.withColumn("pairs", F.when(F.size(code) > 1, many).otherwise(one))


def _cell(pos: Column) -> Column:
    return F.nullif(values.strip(F.replace(F.get(F.col("cells"), pos), F.lit("\0"), F.lit(""))), F.lit(""))


def parse(rows: DataFrame, plans: DataFrame, sections: bool = True) -> DataFrame:
    """rows(file_id, ord, cells) x plan -> one row per code pair: key fields, data (field -> text), raw cells and plan parts.

    The plan side has one row per file; a file with very many rows is split by adaptive skew handling or a broadcast of the plan.
    """
    d = rows.join(plans, "file_id")
    present = F.filter(F.transform("fields", lambda f: F.struct(f["field"].alias("k"), _cell(f["pos"]).alias("v"))), lambda e: e["v"].isNotNull())
    last = F.aggregate(present, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))
    d = d.withColumn("data", last)
    text = F.col("data")
    swaps = []
    for field, stand_in in FALLBACKS.items():
        other = _cell(F.get(F.filter("fallbacks", lambda f: f["normalized"] == stand_in), F.lit(0))["pos"])  # noqa: B023
        mapped = F.exists("fields", lambda f: f["field"] == field)  # noqa: B023
        swaps.append(F.when(mapped & F.coalesce(text[field], F.lit("")).isin("", "0", "0.00") & ~other.isin("0", "0.00"), F.struct(F.lit(field).alias("k"), other.alias("v"))))
    d = d.withColumn("swaps", F.when(F.size("fallbacks") > 0, F.array_compact(F.array(*swaps))))
    swapped = F.map_concat(F.map_filter("data", lambda k, _: ~F.exists("swaps", lambda e: e["k"] == k)), F.map_from_entries("swaps"))
    d = d.withColumn("data", F.when(F.size("swaps") > 0, swapped).otherwise(text)).drop("swaps")
    if sections:
        names = F.array(*map(F.lit, headers.SYNONYMS["description"]))
        redeclares = F.exists("cells", lambda c: F.array_contains(names, headers.normalize_header(c)))
        bare = F.lit(True)
        for f in PRICES:
            bare = bare & F.col("data")[f].isNull()
        head = (F.size("cells") < F.col("width")) & bare & redeclares & (F.col("ord") > F.col("first_ord"))
        d = d.join(rows.groupBy("file_id").agg(F.min("ord").alias("first_ord")), "file_id")
        d = cut(d.withColumn("_head", head))  # cells are read into fields once; the steps below only look at them
        d = before_boundary(d, ["file_id"], "ord", F.col("_head")).drop("_head", "first_ord")
    pairs = F.filter(F.transform("pairs", lambda p: F.struct(_cell(p["code"]).alias("code"), _cell(p["kind"]).alias("code_type"))), lambda p: p["code"].isNotNull() | p["code_type"].isNotNull())
    d = d.withColumn("_pairs", F.coalesce(pairs, F.array().cast("array<struct<code:string,code_type:string>>")))
    d = d.withColumn("had", F.size("_pairs") > 0).select("*", F.posexplode_outer("_pairs").alias("sub", "_p")).drop("_pairs")
    d = d.withColumns({"sub": F.coalesce("sub", F.lit(0)), "code": F.col("_p.code"), "code_type": F.col("_p.code_type"), "description": F.col("data")["description"]}).drop("_p")
    d = codes.normalize(d)
    d = d.withColumn("_b", codes.baked_modifier(F.col("code"), F.col("code_type")))
    d = d.withColumns({"code": F.col("_b.code"), "code_type": F.col("_b.code_type"), "modifiers": values.merge_modifier(F.col("data")["modifiers"], F.col("_b.modifier"))}).drop("_b")
    d = d.withColumn("reason", codes.rejection(F.col("code"), F.col("code_type")))
    given = F.lower(values.strip(F.col("data")["billing_class"]))
    given = F.when(given.isin("facility", "professional"), given).otherwise("")
    d = d.withColumn("_i", codes.billing_class(F.col("code"), F.col("code_type"), F.col("description"), given))
    return d.withColumns({
        "code": F.col("_i.code"), "code_type": F.col("_i.code_type"), "billing_class": F.coalesce(F.col("_i.billing_class"), F.lit("")),
        "setting": F.coalesce(F.lower(F.col("data")["setting"]), F.lit("")),
    }).drop("_i")


def kept(parsed: DataFrame) -> DataFrame:
    """Rows with something to identify the item by: a sound code pair, or a description where no code was given."""
    return parsed.filter("reason is null and (had or description is not null)").withColumn("first_sub", F.min("sub").over(Window.partitionBy("file_id", "ord")))


def tables(parsed: DataFrame, dictionary: DataFrame | None = None) -> dict[str, DataFrame]:
    """The output tables of parsed rows. parsed is materialized once, as five tables read it."""
    d = cut(kept(parsed))
    num = lambda f: safe_float(F.col("data")[f])
    simple = d.filter("not three and not two")
    raw_payer = F.col("data")["payer_name"]
    own = payers.is_self_pay(raw_payer)
    wide_cash = F.get(F.filter(F.transform(F.filter("payers", lambda p: payers.is_self_pay(p["payer"]) & p["field"].isin("negotiated_rate", "estimated_amount")), lambda p: safe_float(_cell(p["pos"]))), lambda v: v.isNotNull()), F.lit(0))
    cash = F.coalesce(num("discounted_cash_price"), F.when(own, F.coalesce(F.nullif(num("negotiated_rate"), F.lit(0.0)), num("estimated_amount"))), wide_cash)
    base = ["file_id", "ord", "sub", "first_sub", "code", "code_type", "description", "billing_class", "modifiers", "data", "cells"]
    charge = simple.select(*base, "setting", num("gross_charge").alias("gross_charge"), cash.alias("discounted_cash_price"), num("min_negotiated_rate").alias("min_negotiated_rate"), num("max_negotiated_rate").alias("max_negotiated_rate"), F.lit(0).alias("part"))
    extra = simple.withColumn("_o", safe_float(_cell(F.col("outpatient")))).filter("_o is not null")
    none = F.lit(None).cast("double")
    extra = extra.select(*base, F.lit("outpatient").alias("setting"), F.col("_o").alias("gross_charge"), none.alias("discounted_cash_price"), none.alias("min_negotiated_rate"), none.alias("max_negotiated_rate"), F.lit(1).alias("part"))
    by_setting = settings(d, base)
    charges = charge.unionByName(extra).unionByName(by_setting.drop("negotiated", "flag"))
    any_price = F.coalesce("gross_charge", "discounted_cash_price", "min_negotiated_rate", "max_negotiated_rate").isNotNull()
    out = {"standard_charges": charges.filter(any_price).select("file_id", "ord", "sub", "part", "code", "code_type", "description", "billing_class", "setting", "modifiers", "gross_charge", "discounted_cash_price", "min_negotiated_rate", "max_negotiated_rate")}
    item = charges.select(
        "file_id", "ord", "sub", "part", "code", "code_type", "description", "billing_class", "setting", "modifiers", F.coalesce("modifiers", F.lit("")).alias("_m"),
        *(F.col("data")[f].alias(f) for f in ("drug_unit_of_measurement", "drug_type_of_measurement", "additional_generic_notes")),
    )
    out["charge_items"] = first_wins(item, ["file_id", "code", "code_type", "billing_class", "setting", "_m"], ["ord", "sub", "part"]).drop("_m")

    tall = simple.filter(raw_payer.isNotNull() & ~own).select(
        *base, "setting", raw_payer.alias("raw_payer_name"), F.col("data")["plan_name"].alias("plan_name"), F.lit(0).alias("part"),
        *(num(f).alias(f) for f in RATE_NUMBERS), *(F.col("data")[f].alias(f) for f in RATE_TEXTS), safe_count(F.col("data")["claim_count"]).alias("claim_count"),
        F.col("data")["billing_class"].alias("rate_billing_class"), F.col("data")["setting"].alias("rate_setting"),
    )
    cells = simple.select(*base, "setting", F.posexplode("payers").alias("part", "p")).filter(~payers.is_self_pay(F.col("p.payer")))
    cells = cells.withColumn("v", _cell(F.col("p.pos"))).filter("v is not null")
    groups = cells.groupBy("file_id", "ord", "sub", "first_sub", "code", "code_type", "description", "billing_class", "modifiers", "setting", F.col("p.payer").alias("raw_payer_name"), F.col("p.plan").alias("plan_name")).agg(
        F.min("part").alias("part"), *(F.max(F.when(F.col("p.field") == f, F.col("v"))).alias(f) for f in (*RATE_NUMBERS, *RATE_TEXTS, "claim_count")), F.any_value(F.col("data")["footnote"]).alias("row_footnote"),
    )
    groups = groups.withColumns({f: safe_float(F.col(f)) for f in RATE_NUMBERS} | {"claim_count": safe_count(F.col("claim_count")), "footnote": F.coalesce("footnote", "row_footnote")}).drop("row_footnote")
    some = F.col("negotiated_algorithm").isNotNull() | F.col("methodology").isNotNull() | values.truthy(F.col("claim_count"))
    for f in RATE_NUMBERS:
        some = some | values.truthy(F.col(f))
    groups = groups.filter(some).withColumns({"rate_billing_class": F.col("billing_class"), "rate_setting": F.col("setting")})
    pieces = tall.drop("data", "cells").unionByName(groups).unionByName(setting_rates(d, by_setting, base))
    named = payers.resolve(pieces, "raw_payer_name", dictionary).filter("payer_name is not null")
    named = named.withColumns({"_pl": payers.plan_class(F.coalesce(values.blank_to_null(F.col("plan_name")), F.col("plan_hint")), F.col("payer_name")), "_mt": values.methodology_type(F.col("methodology")), "methodology": values.clean_methodology(F.col("methodology"))})
    named = named.withColumn("_h", values.hoist_methodology(F.col("methodology"), F.col("_mt"), F.col("negotiated_rate"), F.col("negotiated_percentage"), F.col("negotiated_algorithm")))
    out["payer_rates"] = named.withColumns({
        "plan_name": F.col("_pl.plan_name"), "plan_category": F.col("_pl.plan_category"), "plan_network": F.col("_pl.plan_network"), "methodology": F.col("_h.methodology"),
        "methodology_type": F.col("_h.methodology_type"), "negotiated_percentage": F.col("_h.negotiated_percentage"),
        "rate_billing_class": F.coalesce("rate_billing_class", F.lit("")), "rate_setting": F.coalesce("rate_setting", F.lit("")),
    }).drop("_pl", "_mt", "_h", "first_sub", "plan_hint")

    first = d.filter("sub = first_sub").withColumn("_s", F.when(F.col("three") | F.col("two"), F.lit(None)).otherwise(F.col("setting")))
    shown = by_setting.groupBy("file_id", "ord").agg(F.min_by("setting", F.struct("sub", "part")).alias("_first"))
    first = first.join(shown, ["file_id", "ord"], "left").filter("(not three and not two) or _first is not null").withColumn("setting", F.coalesce("_s", "_first"))
    cell = first.select("file_id", "ord", "code", "code_type", "description", "billing_class", "setting", "modifiers", "cells", F.explode("unmapped").alias("u"))
    cell = cell.select("file_id", "ord", *KEY[:2], "description", *KEY[2:], F.col("u.source_header").alias("source_column"), _cell(F.col("u.pos")).alias("value"))
    cell = cell.filter(F.col("value").isNotNull() & ~values.is_null_rate(F.col("value")))
    out["unmapped_cells"] = capped(cell, ["file_id", "source_column"], ["ord"], UNMAPPED_CAP)
    return out


def settings(d: DataFrame, base: list[str]) -> DataFrame:
    """One row per setting of files whose columns name settings, where any value is there."""
    at = lambda s, f: values.number_or_na(_cell(F.get(F.filter("settings", lambda x: (x["setting"] == s) & (x["field"] == f)), F.lit(0))["pos"]))
    rows = F.array(*(
        F.struct(F.lit(s).alias("setting"), F.lit(k).alias("part"), at(s, "gross_charge").alias("gross_charge"), at(s, "discounted_cash_price").alias("cash"), at(s, "negotiated_charge").alias("negotiated"))
        for k, s in enumerate(("inpatient", "outpatient", "emergency"))
    ))
    x = d.filter("three or two").select(*base, "three", F.upper(_cell(F.col("minmax"))).alias("flag"), F.inline(rows))
    raw = F.col("data")["payer_name"]
    cash_first = payers.is_self_pay(raw) & F.col("cash").isNull() & F.col("negotiated").isNotNull()
    low = F.when(F.col("three"), safe_float(F.col("data")["min_negotiated_rate"])).when(F.col("flag") == "MIN", F.col("negotiated"))
    high = F.when(F.col("three"), safe_float(F.col("data")["max_negotiated_rate"])).when(F.col("flag") == "MAX", F.col("negotiated"))
    x = x.withColumns({"min_negotiated_rate": low, "max_negotiated_rate": high, "discounted_cash_price": F.when(cash_first, F.col("negotiated")).otherwise(F.col("cash")), "negotiated": F.when(~cash_first, F.col("negotiated"))})
    alive = F.when(F.col("three"), F.coalesce("gross_charge", "cash").isNotNull()).otherwise(F.coalesce("gross_charge", "discounted_cash_price", "min_negotiated_rate", "max_negotiated_rate", "negotiated").isNotNull())
    return x.filter(alive).drop("cash", "three")


def setting_rates(d: DataFrame, by_setting: DataFrame, base: list[str]) -> DataFrame:
    """Payer rates of those files: payer columns of settings that have a charge, or the negotiated charge without a Min/Max flag."""
    keys = ["file_id", "ord", "sub"]
    three = d.filter("three").select(*base, F.posexplode("setting_payers").alias("part", "p")).withColumn("rate", values.number_or_na(_cell(F.col("p.pos")))).filter("rate is not null")
    three = three.withColumn("setting", F.col("p.setting")).join(by_setting.select(*keys, "setting"), [*keys, "setting"], "left_semi")
    percent = F.col("p.methodology") == "percent_of_charge"
    null = lambda t: F.lit(None).cast(t)
    shape = lambda x, payer, plan, rate, pct, method, notes, foot: x.select(
        "file_id", "ord", "sub", "first_sub", "code", "code_type", "description", "billing_class", "modifiers", "setting", payer.alias("raw_payer_name"), plan.alias("plan_name"), "part",
        rate.alias("negotiated_rate"), pct.alias("negotiated_percentage"), *(null("double").alias(f) for f in RATE_NUMBERS[2:]), null("string").alias("negotiated_algorithm"),
        method.alias("methodology"), notes.alias("additional_notes"), foot.alias("footnote"), null("long").alias("claim_count"), F.col("billing_class").alias("rate_billing_class"), F.col("setting").alias("rate_setting"),
    )
    pct = F.when(percent, F.when((F.col("rate") > 0) & (F.col("rate") <= 1), F.col("rate") * 100.0).otherwise(F.col("rate")))
    a = shape(three, F.col("p.payer"), null("string"), F.when(~percent, F.col("rate")), pct, F.col("p.methodology"), null("string"), null("string"))
    raw = F.col("data")["payer_name"]
    two = by_setting.filter(raw.isNotNull() & ~payers.is_self_pay(raw) & F.col("negotiated").isNotNull() & ~F.coalesce(F.col("flag").isin("MIN", "MAX"), F.lit(False)))
    two = two.join(d.filter("two").select(*keys), keys, "left_semi")
    return a.unionByName(shape(two, raw, F.col("data")["plan_name"], F.col("negotiated"), null("double"), F.col("data")["methodology"], F.col("data")["additional_notes"], F.col("data")["footnote"]))
