"""In-network and table-of-contents files of insurers: provider groups, merged prices, plan index, networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, values
from .ordered import first_seen_ids, first_wins

GROUP = "struct<npi:array<string>,tin:struct<type:string,value:string,business_name:string>>"
REFERENCE = f"struct<provider_group_id:string,provider_groups:array<{GROUP}>>"
PRICE = "struct<negotiated_type:string,negotiated_rate:string,expiration_date:string,service_code:array<string>,billing_class:string,setting:string,billing_code_modifier:array<string>>"
#: Names and descriptions of services are licensed text and are not read.
ITEM = (
    "struct<negotiation_arrangement:string,billing_code_type:string,billing_code_type_version:string,billing_code:string,"
    f"negotiated_rates:array<struct<provider_references:array<string>,provider_groups:array<{GROUP}>,negotiated_prices:array<{PRICE}>>>>"
)
STRUCTURE = "struct<reporting_plans:array<struct<plan_name:string,plan_id:string,plan_id_type:string,plan_market_type:string>>,in_network_files:array<struct<description:string,location:string>>,allowed_amount_file:struct<location:string>>"
# What the standard allows, and limits beyond which a value is an error.
TYPES = ["negotiated", "fee schedule", "percentage", "per diem", "derived"]
NEED_VALUE = ["negotiated", "fee schedule", "percentage"]
CLASSES, SETTINGS = ["professional", "institutional", "both"], ["both", "outpatient", "inpatient"]
MOST_RATE, MOST_PERCENT = 1e10, 1e5
# ------------------------------------------------------------------


def group_parts(g: Column) -> Column:
    """struct(tin_type, tin, npis, business_name); npis sorted and joined by pipes, null without a valid one."""
    npis = values.npi_set(g["npi"])
    return F.struct(g["tin"]["type"].alias("tin_type"), values.tin(g["tin"]["value"]).alias("tin"), F.when(F.size(npis) > 0, F.array_join(F.transform(npis, lambda x: x.cast("string")), "|")).alias("npis"), g["tin"]["business_name"].alias("business_name"))


def valid(g: str) -> Column:
    return F.col(f"{g}.tin").isNotNull() & F.col(f"{g}.npis").isNotNull()


def file_metadata(roots: DataFrame, refs: DataFrame) -> DataFrame:
    """What an in-network file says about itself: four values of its root and the network name of its first reference."""
    value = lambda k: F.get_json_object("raw", f"$.{k}").alias(k)
    fields = ["reporting_entity_name", "reporting_entity_type", "last_updated_on", "version"]
    root = roots.groupBy("file_id").agg(F.min_by("raw", "ord").alias("raw")).select("file_id", *map(value, fields))
    first = refs.groupBy("file_id").agg(F.min_by("raw", "ord").alias("raw")).select("file_id", F.get_json_object("raw", "$.network_name[0]").alias("network_name"))
    both = root.join(first, "file_id", "full")
    return both.filter(F.coalesce(*fields, "network_name").isNotNull()).select("file_id", *fields, "network_name")


def faults(items: DataFrame) -> DataFrame:
    """(file_id, fault, n): the prices that are skipped, by what is wrong with them, and items without a code."""
    x = items.withColumn("i", F.from_json("raw", ITEM))
    bare = x.filter("i is null or coalesce(i.billing_code, '') = '' or coalesce(i.billing_code_type, '') = ''").groupBy("file_id", F.lit("billing_code").alias("fault")).agg(F.count("*").alias("n"))
    p = x.filter("i.billing_code <> '' and i.billing_code_type <> ''").select("file_id", F.explode("i.negotiated_rates").alias("r")).select("file_id", F.explode("r.negotiated_prices").alias("p"))
    why = price_fault(F.col("p.negotiated_type"), F.col("p.billing_class"), F.col("p.negotiated_rate"), F.col("p.negotiated_rate").try_cast("double"))
    return bare.unionByName(p.groupBy("file_id", why.alias("fault")).agg(F.count("*").alias("n")).filter("fault is not null"))


def provider_groups(refs: DataFrame) -> DataFrame:
    """refs(file_id, ord, raw) -> one row per distinct (file, reference id, tin, npis); the first in file order wins."""
    x = refs.withColumn("r", F.from_json("raw", REFERENCE)).select("file_id", "ord", F.col("r.provider_group_id").alias("group_id"), F.posexplode("r.provider_groups").alias("n", "g"))
    x = x.withColumn("g", group_parts(F.col("g"))).filter(valid("g")).select("file_id", "ord", "n", "group_id", "g.*")
    return first_wins(x, ["file_id", "group_id", "tin", "npis"], ["ord", "n"])


def id_list(ids: Column) -> Column:
    """Ids joined by pipes: numbers in numeric order, then the others as text."""
    ranked = F.transform(ids, lambda x: F.struct(F.when(x.rlike(r"^\d+$"), 0).otherwise(1).alias("kind"), x.try_cast("long").alias("n"), x.alias("id")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda s: s["id"]), "|")


def merge_prices(prices: DataFrame, keys: list[str], group_id: str) -> DataFrame:
    """One row per distinct price with every provider group that has it.

    The set of ids is collected map-side first; one price held by very many groups is spread over salts before it is joined.
    """
    salted = prices.groupBy(*keys, F.pmod(F.xxhash64(group_id), F.lit(16)).alias("_salt")).agg(F.collect_set(group_id).alias("_ids"))
    whole = salted.groupBy(*keys).agg(F.flatten(F.collect_list("_ids")).alias("_ids"))
    return whole.withColumn("provider_group_ids", id_list(F.col("_ids"))).drop("_ids")


def rates(items: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rates, inline groups) of items(file_id, ord, raw) and the reference groups of the same files."""
    x = items.withColumn("i", F.from_json("raw", ITEM)).filter("i.billing_code <> '' and i.billing_code_type <> ''")
    x = x.select("file_id", "ord", "i.billing_code", "i.billing_code_type", "i.billing_code_type_version", "i.negotiation_arrangement", F.posexplode("i.negotiated_rates").alias("n", "r"))
    known = refs.select("file_id", F.col("group_id").alias("id")).distinct()
    by_ref = x.select("file_id", "ord", "n", F.explode("r.provider_references").alias("id")).join(known, ["file_id", "id"], "left_semi").distinct()
    inline = x.select("file_id", "ord", "n", F.posexplode("r.provider_groups").alias("k", "g")).withColumn("g", group_parts(F.col("g"))).filter(valid("g"))
    inline = inline.select("file_id", "ord", "n", "k", "g.*")
    ids = first_seen_ids(inline, ["file_id"], ["tin", "npis"], ["ord", "n", "k"])
    groups = first_wins(inline, ["file_id", "tin", "npis"], ["ord", "n", "k"]).join(ids, ["file_id", "tin", "npis"]).withColumnRenamed("id", "group_id")
    by_inline = inline.join(ids, ["file_id", "tin", "npis"]).select("file_id", "ord", "n", "id").distinct()
    p = x.select("file_id", "ord", "n", "billing_code", "billing_code_type", "billing_code_type_version", "negotiation_arrangement", F.explode("r.negotiated_prices").alias("p"))
    p = p.select("*", "p.*").drop("p").withColumn("value", F.col("negotiated_rate").try_cast("double"))
    p = p.filter(price_fault(F.col("negotiated_type"), F.col("billing_class"), F.col("negotiated_rate"), F.col("value")).isNull())
    mods = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.filter("billing_code_modifier", lambda m: m.isNotNull()), lambda m: F.transform(F.split(m, ","), lambda x: F.trim(x)))), lambda m: m != "")))
    p = p.withColumns({
        "setting": F.when(F.col("setting").isin(SETTINGS), F.col("setting")).otherwise(""), "expiration_date": values.expiration(F.col("expiration_date")),
        "service_codes": F.nullif(F.array_join(F.array_sort("service_code"), "|"), F.lit("")), "modifiers": F.nullif(F.array_join(mods, "|"), F.lit("")),
    })
    keys = ["file_id", "ord", "billing_code", "billing_code_type", "billing_code_type_version", "negotiation_arrangement", "negotiated_type", "value", "expiration_date", "billing_class", "setting", "service_codes", "modifiers"]
    merged = merge_prices(p.join(by_ref.unionByName(by_inline), ["file_id", "ord", "n"]).select(*keys, "id"), keys, "id")
    plain = codes.normalize(merged.withColumns({"_nc": F.col("billing_code"), "_nt": F.col("billing_code_type")}), "_nc", "_nt")
    standard = F.upper("billing_code_type").isin("CPT", "HCPCS")
    percent = F.col("negotiated_type") == "percentage"
    out = plain.withColumns({
        "billing_code": F.when(standard, F.col("_nc")).otherwise(F.col("billing_code")), "billing_code_type": F.when(standard, F.col("_nt")).otherwise(F.col("billing_code_type")),
        "negotiated_rate": F.when(~percent, F.col("value")), "negotiated_percentage": F.when(percent, F.col("value")),
    }).drop("_nc", "_nt", "value")
    return out, groups


def price_fault(kind: Column, klass: Column, text: Column, value: Column) -> Column:
    """Why a price is skipped; null if it is kept."""
    limit = F.when(kind == "percentage", MOST_PERCENT).otherwise(MOST_RATE)
    return (
        F.when(~F.coalesce(kind.isin(TYPES), F.lit(False)), "negotiated_type").when(~F.coalesce(klass.isin(CLASSES), F.lit(False)), "billing_class")
        .when(text.isNull() & kind.isin(NEED_VALUE), "negotiated_rate=missing").when(text.isNotNull() & ~F.coalesce(F.abs(value) < limit, F.lit(False)), "negotiated_rate=out_of_range")
    )


def index(structures: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per (reporting plan, in-network file); a structure without plans has one plan of nulls."""
    x = structures.withColumn("s", F.from_json("raw", STRUCTURE)).select("file_id", "ord", "s.*")
    x = x.select("file_id", "ord", F.explode("in_network_files").alias("f"), F.when(F.size("reporting_plans") > 0, F.col("reporting_plans")).alias("plans"), F.col("allowed_amount_file.location").alias("allowed_amount_location")).filter("f.location <> ''")
    x = x.select("file_id", "ord", "f", "allowed_amount_location", F.explode_outer("plans").alias("p"))
    root = roots.select("file_id", F.get_json_object("raw", "$.reporting_entity_name").alias("reporting_entity_name"), F.get_json_object("raw", "$.reporting_entity_type").alias("reporting_entity_type")).filter("reporting_entity_name is not null or reporting_entity_type is not null")
    return x.join(root, "file_id", "left").select("file_id", "ord", "reporting_entity_name", "reporting_entity_type", "p.*", F.col("f.location").alias("in_network_location"), F.col("f.description").alias("in_network_description"), "allowed_amount_location")


def networks(entries: DataFrame, order: list[str]) -> DataFrame:
    """entries -> one row per network key: the first file name with its location, the commonest market type (the first seen in
    a tie) and the number of distinct files. Capitation and allowed-amount files stay out."""
    e = entries.withColumn("file_name", values.file_name(F.col("in_network_location")))
    e = e.filter(~F.lower("file_name").contains("cap-rates") & ~F.lower("file_name").contains("allowed"))
    e = e.withColumn("network", values.network_key(F.col("file_name")))
    files = e.groupBy("network", "file_name").agg(F.min_by("in_network_location", F.struct(*order)).alias("location"))
    main = files.groupBy("network").agg(F.min_by("location", "file_name").alias("location"), F.min("file_name").alias("file_name"), F.count("*").alias("file_count"))
    kinds = e.filter("plan_market_type <> ''").groupBy("network", "plan_market_type").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("seen"))
    best = kinds.withColumn("r", F.row_number().over(Window.partitionBy("network").orderBy(F.desc("n"), "seen"))).filter("r = 1").select("network", F.col("plan_market_type").alias("market_type"))
    return main.join(best, "network", "left").select("network", "file_name", "location", "market_type", "file_count")


def tables(parts: DataFrame) -> dict[str, DataFrame]:
    refs = provider_groups(parts.filter("kind = 'provider_reference'"))
    rate, inline = rates(parts.filter("kind = 'in_network'"), refs)
    same = ["file_id", "ord", "group_id", "tin_type", "tin", "npis", "business_name"]
    roots = parts.filter("kind = 'root'")
    entries = index(parts.filter("kind = 'structure'"), roots)
    in_network = parts.filter("kind in ('in_network', 'provider_reference')").select("file_id").distinct()
    about = file_metadata(roots.join(in_network, "file_id", "left_semi"), parts.filter("kind = 'provider_reference'"))
    return {"tic_file_metadata": about, "tic_provider_groups": refs.select(*same).unionByName(inline.select(*same)), "tic_rates": rate, "tic_index": entries, "tic_networks": networks(entries, ["file_id", "ord"])}
