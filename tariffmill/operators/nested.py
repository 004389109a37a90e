"""Nested hospital JSON: one item with its codes, charges and payers -> flat rows and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, payers, values
from ..functions.values import safe_count, safe_float
from ..session import cut
from .ordered import first_wins

# The spellings of each field of a charge and of a payer entry; the first that is there counts.
CHARGE_KEYS = {
    "gross_charge": ["gross_charge"], "discounted_cash": ["discounted_cash", "discounted_cash_price"], "minimum": ["minimum", "min"], "maximum": ["maximum", "max"],
    "modifiers": ["modifiers", "modifier_code"],
}
PAYER_KEYS = {
    "standard_charge_dollar": ["standard_charge_dollar", "negotiated_dollar"],
    "standard_charge_percentage": ["standard_charge_percentage", "standard_charge_percent", "negotiated_percentage", "negotiated_percent"],
    "estimated_amount": ["estimated_amount"], "median_amount": ["median_amount", "median_allowed_amount"], "10th_percentile": ["10th_percentile"],
    "90th_percentile": ["90th_percentile"], "count": ["count"],
}
PAYER_TEXTS = ["payer_name", "plan_name", "standard_charge_algorithm", "negotiated_algorithm", "methodology", "additional_payer_notes", "footnote"]
# ------------------------------------------------------------------
PAYER = "struct<" + ",".join([*(f"{k}:string" for k in PAYER_TEXTS), *(f"`{k}`:variant" for ks in PAYER_KEYS.values() for k in ks)]) + ">"
CHARGE = (
    "struct<setting:string,billing_class:string,additional_generic_notes:string," + ",".join(f"`{k}`:variant" for ks in CHARGE_KEYS.values() for k in ks) + f",payers_information:array<{PAYER}>>"
)
ITEM = (
    "struct<description:string,code_information:array<struct<code:string,type:string>>,drug_information:struct<unit:string,type:string>,"
    f"standard_charges:array<{CHARGE}>>"
)
# Order of preference of code types; the fields that nested files fill.
PRIORITY = {"CPT": 0, "HCPCS": 1, "RC": 2, "CDM": 3, "NDC": 4}
FIELDS = [
    ("description", "description", "description"), ("code_information.code", "code", "code"), ("code_information.type", "code_type", "code_type"),
    ("standard_charges.gross_charge", "gross_charge", "gross_charge"), ("standard_charges.discounted_cash", "discounted_cash_price", "discounted_cash_price"),
    ("standard_charges.minimum", "min_negotiated_rate", "min_negotiated_rate"), ("standard_charges.maximum", "max_negotiated_rate", "max_negotiated_rate"),
    ("standard_charges.billing_class", "billing_class", "billing_class"), ("standard_charges.setting", "setting", "setting"), ("standard_charges.modifiers", "modifiers", "modifiers"),
    ("drug_information.unit", "drug_unit_of_measurement", "drug_unit_of_measurement"), ("drug_information.type", "drug_type_of_measurement", "drug_type_of_measurement"),
    ("standard_charges.payers_information", "payers_information", "wide_payer:cms_nested"),
]
# ------------------------------------------------------------------


def first_of(entry: Column, keys: list[str]) -> Column:
    """The first spelling of a field that is not null, as text."""
    return F.coalesce(*(F.try_variant_get(entry[k], "$", "string") for k in keys))


def first_nonzero(prices: Column) -> Column:
    """First price that is not 0; else the last one."""
    some = F.filter(prices, lambda x: x.isNotNull() & (x != 0))
    return F.coalesce(F.get(some, F.lit(0)), F.try_element_at(prices, F.lit(-1)))


def is_nested(raw: Column) -> Column:
    return raw.contains('"standard_charges"') | raw.contains('"code_information"')


def charge_parts(s: Column, n: Column) -> Column:
    """One charge with the three parts of its group's key and its prices as numbers."""
    listed = F.coalesce(*(F.try_variant_get(s[k], "$", "array<string>") for k in CHARGE_KEYS["modifiers"]))
    joined = F.array_join(F.filter(F.transform(listed, lambda m: F.trim(m)), lambda m: m != ""), ",")
    mods = F.coalesce(joined, F.trim(first_of(s, CHARGE_KEYS["modifiers"])))
    known = F.lower(F.trim(s["billing_class"]))
    price = lambda k: safe_float(first_of(s, CHARGE_KEYS[k]))
    return F.struct(
        n.alias("n"),
        F.when(known.isin("facility", "professional", "both"), known).otherwise("").alias("billing_class"),
        F.lower(F.trim(F.coalesce(s["setting"], F.lit("")))).alias("setting"),
        F.nullif(mods, F.lit("")).alias("modifiers"),
        price("gross_charge").alias("g"), price("discounted_cash").alias("c"), price("minimum").alias("lo"), price("maximum").alias("hi"),
        s["additional_generic_notes"].alias("notes"), s["payers_information"].alias("p"),
    )


def merged_charge(e: Column) -> Column:
    """The charges of one group (e.mine, in their order) as one row."""
    there = lambda f: F.filter(F.transform(e["mine"], lambda q: q[f]), lambda v: v.isNotNull())
    return F.struct(
        e["key"]["billing_class"].alias("billing_class"), e["key"]["setting"].alias("setting"), e["key"]["modifiers"].alias("modifiers"), F.get(e["mine"], F.lit(0))["n"].alias("n"),
        first_nonzero(there("g")).alias("gross_charge"), first_nonzero(there("c")).alias("discounted_cash_price"),
        first_nonzero(there("lo")).alias("min_negotiated_rate"), first_nonzero(there("hi")).alias("max_negotiated_rate"),
        F.get(there("notes"), F.lit(0)).alias("additional_generic_notes"), F.flatten(there("p")).alias("payers"),
    )


def flatten(items: DataFrame, raw: str = "raw") -> DataFrame:
    """items(file_id, ord, raw) -> one row per (billing class, setting, modifiers) of each item.

    Of several charges of one group each price is the first that is there and not 0; payers are put together. A class of
    'both' gives a facility and a professional row. An item with codes but no charges gives one row without prices.
    A group never leaves its item, so the merge is done inside the item's row and nothing is shuffled.
    """
    x = items.withColumn("i", F.from_json(raw, ITEM)).filter("i is not null")
    known = F.filter("i.code_information", lambda c: F.coalesce(c["code"], F.lit("")) != "")
    order = F.create_map(*(F.lit(v) for kv in PRIORITY.items() for v in kv))
    rank = lambda c: F.coalesce(F.try_element_at(order, F.coalesce(F.upper(c["type"]), F.lit(""))), F.lit(10))
    best = F.array_sort(F.transform(known, lambda c, k: F.struct(rank(c).alias("rank"), k.alias("k"), c["code"].alias("code"), c["type"].alias("type"))))
    x = x.withColumn("best", F.get(best, F.lit(0)))
    whole = F.when(F.size("i.standard_charges") > 0, F.col("i.standard_charges"))
    x = x.select(
        "file_id", "ord", F.col("best.code").alias("code"), F.col("best.type").alias("code_type"), F.col("i.description").alias("description"),
        F.col("i.drug_information.unit").alias("drug_unit_of_measurement"), F.col("i.drug_information.type").alias("drug_type_of_measurement"), whole.alias("s"),
    )
    x = x.filter("s is not null or code is not null").withColumn("s", F.coalesce("s", F.array(F.lit(None).cast(CHARGE))))
    x = x.withColumn("parts", F.transform("s", charge_parts)).drop("s")
    keys = F.array_distinct(F.transform("parts", lambda q: F.struct(q["billing_class"].alias("billing_class"), q["setting"].alias("setting"), q["modifiers"].alias("modifiers"))))
    same = lambda q, k: (q["billing_class"] == k["billing_class"]) & (q["setting"] == k["setting"]) & q["modifiers"].eqNullSafe(k["modifiers"])
    groups = F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter("parts", lambda q: same(q, k)).alias("mine")))
    x = x.withColumn("groups", groups).select("*", F.inline(F.transform("groups", merged_charge))).drop("groups", "parts")
    x = x.withColumn("n", F.when(F.col("n") >= 0, F.col("n")))
    both = F.when(F.col("billing_class") == "both", F.array(F.lit("facility"), F.lit("professional"))).otherwise(F.array("billing_class"))
    return x.select("*", F.posexplode(both).alias("twin", "_bc")).withColumn("billing_class", F.col("_bc")).drop("_bc")


def tables(parts: DataFrame, dictionary: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of nested files: charge_items, standard_charges, payer_rates, modifiers."""
    flat = flatten(parts.filter("kind = 'item'").filter(is_nested(F.col("raw"))))
    d = cut(codes.normalize(flat).withColumn("reason", codes.rejection(F.col("code"), F.col("code_type")))).filter("reason is null")
    d = d.withColumn("_b", codes.baked_modifier(F.col("code"), F.col("code_type")))
    d = d.withColumns({"code": F.col("_b.code"), "code_type": F.col("_b.code_type"), "modifiers": values.merge_modifier(F.col("modifiers"), F.col("_b.modifier"))}).drop("_b", "reason")
    given = F.when(F.col("billing_class").isin("facility", "professional"), F.col("billing_class")).otherwise("")
    d = d.withColumn("_i", codes.billing_class(F.col("code"), F.col("code_type"), F.col("description"), given))
    d = d.withColumns({"code": F.col("_i.code"), "code_type": F.col("_i.code_type"), "billing_class": F.coalesce(F.col("_i.billing_class"), F.lit(""))}).drop("_i")
    d = cut(d.withColumn("sub", F.col("n") * 2 + F.col("twin")))
    own = F.filter("payers", lambda p: payers.is_self_pay(p["payer_name"]))
    cash = F.array_min(F.filter(F.transform(own, lambda p: F.coalesce(safe_float(first_of(p, PAYER_KEYS["standard_charge_dollar"])), safe_float(first_of(p, PAYER_KEYS["estimated_amount"])))), lambda v: v.isNotNull()))
    d = d.withColumn("discounted_cash_price", F.least("discounted_cash_price", cash))
    key = ["code", "code_type", "description", "billing_class", "setting", "modifiers"]
    out = {"standard_charges": d.filter(F.coalesce("gross_charge", "discounted_cash_price", "min_negotiated_rate", "max_negotiated_rate").isNotNull()).select(
        "file_id", "ord", "sub", F.lit(0).alias("part"), *key, "gross_charge", "discounted_cash_price", "min_negotiated_rate", "max_negotiated_rate")}
    item = d.select("file_id", "ord", "sub", F.lit(0).alias("part"), *key, F.coalesce("modifiers", F.lit("")).alias("_m"), "drug_unit_of_measurement", "drug_type_of_measurement", "additional_generic_notes")
    out["charge_items"] = first_wins(item, ["file_id", "code", "code_type", "billing_class", "setting", "_m"], ["ord", "sub"]).drop("_m")
    r = d.select("file_id", "ord", "sub", *key, F.posexplode("payers").alias("part", "p")).filter(~payers.is_self_pay(F.col("p.payer_name")))
    r = r.select(
        "file_id", "ord", "sub", "part", *key, F.col("p.payer_name").alias("raw_payer_name"), F.col("p.plan_name").alias("plan_name"), safe_float(first_of(F.col("p"), PAYER_KEYS["standard_charge_dollar"])).alias("negotiated_rate"),
        safe_float(first_of(F.col("p"), PAYER_KEYS["standard_charge_percentage"])).alias("negotiated_percentage"), F.coalesce("p.standard_charge_algorithm", "p.negotiated_algorithm").alias("negotiated_algorithm"), F.col("p.methodology").alias("methodology"),
        safe_float(first_of(F.col("p"), PAYER_KEYS["estimated_amount"])).alias("estimated_amount"), safe_float(first_of(F.col("p"), PAYER_KEYS["median_amount"])).alias("median_amount"), safe_float(first_of(F.col("p"), PAYER_KEYS["10th_percentile"])).alias("pct_10"), safe_float(first_of(F.col("p"), PAYER_KEYS["90th_percentile"])).alias("pct_90"),
        safe_count(first_of(F.col("p"), PAYER_KEYS["count"])).alias("claim_count"), F.col("p.additional_payer_notes").alias("additional_notes"), F.col("p.footnote").alias("footnote"),
        F.col("billing_class").alias("rate_billing_class"), F.col("setting").alias("rate_setting"),
    )
    there = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    r = r.filter(values.truthy(F.col("negotiated_rate")) | values.truthy(F.col("negotiated_percentage")) | values.truthy(F.col("estimated_amount")) | there("negotiated_algorithm") | there("methodology"))
    r = payers.resolve(r, "raw_payer_name", dictionary).filter("payer_name is not null")
    r = r.withColumns({"_pl": payers.plan_class(F.coalesce(values.blank_to_null(F.col("plan_name")), F.col("plan_hint")), F.col("payer_name")), "methodology_type": values.methodology_type(F.col("methodology")), "methodology": values.clean_methodology(F.col("methodology"))})
    r = r.withColumn("_h", values.hoist_methodology(F.col("methodology"), F.col("methodology_type"), F.col("negotiated_rate"), F.col("negotiated_percentage"), F.col("negotiated_algorithm")))
    out["payer_rates"] = r.withColumns({"methodology": F.col("_h.methodology"), "methodology_type": F.col("_h.methodology_type"), "negotiated_percentage": F.col("_h.negotiated_percentage"), "plan_name": F.col("_pl.plan_name"), "plan_category": F.col("_pl.plan_category"), "plan_network": F.col("_pl.plan_network")}).drop("_h", "_pl", "plan_hint")
    out["modifiers"] = modifiers(parts, dictionary)
    return out


MODIFIER = "struct<code:string,description:string,setting:string,modifier_payer_information:array<struct<payer_name:string,plan_name:string,description:string>>>"


def modifiers(parts: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """One general row per modifier, then one per payer whose name survives."""
    m = parts.filter("kind = 'modifier'").withColumn("m", F.from_json("raw", MODIFIER)).filter("m.code <> ''")
    m = m.select("file_id", "ord", "m.code", "m.description", "m.setting", F.col("m.modifier_payer_information").alias("who"))
    null = F.lit(None).cast("string")
    base = m.select("file_id", "ord", F.lit(-1).alias("part"), "code", "description", "setting", null.alias("payer_name"), null.alias("raw_payer_name"), null.alias("plan_name"), null.alias("payer_description"))
    each = m.select("file_id", "ord", F.posexplode("who").alias("part", "p"), "code", "description", "setting")
    each = each.select("file_id", "ord", "part", "code", "description", "setting", F.col("p.payer_name").alias("raw_payer_name"), F.col("p.plan_name").alias("plan_name"), F.col("p.description").alias("payer_description"))
    return base.unionByName(payers.resolve(each, "raw_payer_name", dictionary).filter("payer_name is not null").drop("plan_hint"))


def header_mappings(parts: DataFrame) -> DataFrame:
    files = parts.filter("kind = 'item'").filter(is_nested(F.col("raw"))).select("file_id").distinct()
    rows = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(h).alias("source_header"), F.lit(n).alias("normalized"), F.lit(f).alias("mapped_to")) for k, (h, n, f) in enumerate(FIELDS)))
    return files.select("file_id", F.inline(rows))


ROOT = (
    "struct<hospital_name:string,last_updated_on:string,version:string,hospital_location:variant,location_name:variant,hospital_address:variant,type_2_npi:variant,"
    "license_information:variant,attestation:variant,attester_name:string,confirm_attestation:boolean,ein:string,cms_certification_number:string>"
)


def metadata(parts: DataFrame) -> DataFrame:
    """file_metadata from the values before the data array; lists are joined, nested licence and attestation are opened."""
    r = parts.filter("kind = 'root'").withColumn("r", F.from_json("raw", ROOT)).filter("r.hospital_name is not null")
    text = lambda v: F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), "|"), F.try_variant_get(v, "$", "string"))
    deep = lambda v, k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.try_variant_get(v, f"$[0].{k}", "string"))
    c = F.col
    short = F.create_map(*(F.lit(x) for name, code in values.STATES.items() for x in (name.upper(), code)))
    state = lambda v: F.coalesce(F.try_element_at(short, F.coalesce(F.upper(F.trim(v)), F.lit(""))), F.when(F.length(F.trim(v)) == 2, F.upper(F.trim(v))))
    npis = F.coalesce(F.array_join(F.try_variant_get("r.type_2_npi", "$", "array<string>"), "|"), F.try_variant_get("r.type_2_npi", "$", "string"))
    return r.select(
        "file_id", "r.hospital_name", F.coalesce(text(c("r.hospital_location")), text(c("r.location_name"))).alias("hospital_location"), text(c("r.hospital_address")).alias("hospital_address"),
        "r.cms_certification_number", deep(c("r.license_information"), "license_number").alias("license_number"), state(deep(c("r.license_information"), "state")).alias("license_state"),
        values.first_npi(npis).alias("type_2_npi"), "r.ein", "r.last_updated_on", "r.version",
        F.coalesce(deep(c("r.attestation"), "attestation"), F.try_variant_get("r.attestation", "$", "string")).alias("attestation"),
        F.coalesce(c("r.attester_name"), deep(c("r.attestation"), "attester_name")).alias("attester_name"),
        F.coalesce(c("r.confirm_attestation"), F.try_variant_get("r.attestation", "$.confirm_attestation", "boolean")).alias("confirm_attestation"),
    )
