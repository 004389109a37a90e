"""Queries of the file-normalizing operators over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, headers, payers, values
from ..operators import drift, nested, ordered, tic
from ..session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

# --- codes -------------------------------------------------------------------------------------------------------

REJECT = rf"""
CASE WHEN regexp_full_match(trim(code_type), '[0-9]+') THEN 'numeric_code_type'
     WHEN trim(code_type) <> '' AND (regexp_full_match(upper(trim(code_type)), '[A-Z][0-9]{{4}}')
          OR NOT regexp_full_match(upper(trim(code_type)), '[A-Z][A-Z0-9]*([-/][A-Z0-9]+)*') OR length(trim(code_type)) > 16) THEN 'malformed_code_type'
     WHEN upper(code_type) = 'MS-DRG' AND regexp_full_match(trim(code), '[0-9]+\.[0-9]+') THEN 'ms_drg_decimal' END"""


@query(f"SELECT item_id, {REJECT} AS reason FROM charge_items")
def code_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "charge_items").select("item_id", codes.rejection(F.col("code"), F.col("code_type")).alias("reason"))


@query(f"SELECT coalesce({REJECT}, 'kept') AS reason, count(*) AS n FROM charge_items GROUP BY 1")
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "charge_items")
    return t.groupBy(F.coalesce(codes.rejection(F.col("code"), F.col("code_type")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query()
def code_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.normalize(table(spark, sf_dir, "charge_items").select("item_id", "code", "code_type"))


@query(r"""
WITH t AS (SELECT item_id, trim(code) AS s, code FROM charge_items WHERE code_type = 'NDC'),
p AS (SELECT *, string_split(s, '-') AS g FROM t)
SELECT item_id,
  CASE WHEN regexp_matches(s, '^[A-Za-z]') OR s = '' THEN code
       WHEN regexp_full_match(s, '[0-9]{9,11}') THEN lpad(s, 11, '0')
       WHEN regexp_full_match(s, '[0-9]{4,5}-[0-9]{3,4}-[0-9]{1,2}') THEN lpad(g[1], 5, '0') || lpad(g[2], 4, '0') || lpad(g[3], 2, '0')
       ELSE s END AS code,
  CASE WHEN regexp_matches(s, '^[A-Za-z]') THEN 'LOCAL' ELSE 'NDC' END AS code_type FROM p""")
def ndc_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "charge_items").filter("code_type = 'NDC'").select("item_id", codes.ndc(F.col("code")).alias("n")).select("item_id", "n.*")


@query(r"""
SELECT row_id, CASE WHEN k = 0 THEN b WHEN k = 1 THEN b WHEN k = 2 THEN b ELSE lpad(b, 5, '0') END AS code,
  CASE k WHEN 0 THEN 'CPT' WHEN 1 THEN 'CPT' WHEN 2 THEN 'MS-DRG' ELSE NULL END AS code_type
FROM (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey % 4 AS k,
        CASE l_partkey % 4 WHEN 0 THEN lpad((l_partkey % 100000)::VARCHAR, 5, '0') WHEN 1 THEN lpad((l_partkey % 100000)::VARCHAR, 5, '0') WHEN 2 THEN (l_partkey % 900 + 100)::VARCHAR ELSE (l_partkey % 100000)::VARCHAR END AS b FROM lineitem)""")
def composite_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_partkey")
    five, drg = F.lpad((F.col("l_partkey") % 100000).cast("string"), 5, "0"), (F.col("l_partkey") % 900 + 100).cast("string")
    k = F.col("l_partkey") % 4
    code = F.when(k == 0, F.concat(F.lit("CPT "), five)).when(k == 1, F.concat(F.lit("CPT"), five)).when(k == 2, F.concat(F.lit("MS-DRG V41.0 (FY 2024) "), drg)).otherwise(five)
    out = codes.split_composite(t.select("row_id", code.alias("code"), F.lit(None).cast("string").alias("code_type")))
    return out.select("row_id", "code", "code_type")


@query(r"""
SELECT item_id, CASE WHEN regexp_full_match(code, '[0-9]{5}|[A-CE-V][0-9]{4}') THEN code ELSE code || 'TC' END AS code,
  CASE WHEN regexp_full_match(code, '[0-9]{5}') THEN 'CPT' WHEN regexp_full_match(code, '[A-CE-V][0-9]{4}') THEN 'HCPCS' ELSE 'CDM' END AS code_type,
  CASE WHEN regexp_full_match(code, '[0-9]{5}|[A-CE-V][0-9]{4}') THEN 'TC' END AS modifier FROM charge_items""")
def baked_modifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = codes.baked_modifier(F.concat("code", F.lit("TC")), F.lit("CDM"))
    return table(spark, sf_dir, "charge_items").select("item_id", b.alias("b")).select("item_id", "b.*")


@query(r"""
WITH t AS (SELECT item_id, modifiers, list_filter(regexp_split_to_array(modifiers, '[|, ;]+'), lambda x: x <> '') AS l FROM charge_items)
SELECT item_id, CASE WHEN trim(coalesce(modifiers, '')) = '' THEN 'TC' WHEN list_contains(l, 'TC') THEN array_to_string(l, ',') ELSE array_to_string(list_append(l, 'TC'), ',') END AS modifiers FROM t""")
def modifier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "charge_items").select("item_id", values.merge_modifier(F.col("modifiers"), F.lit("TC")).alias("modifiers"))


A_CODE = "coalesce((code_type IS NULL OR code_type IN ('CPT', 'HCPCS')) AND regexp_full_match(code, 'A[0-9]{5}|A[0-9]{4}T'), false)"


@query(rf"""
SELECT item_id, CASE WHEN billing_class <> '' THEN billing_class WHEN {A_CODE} THEN 'facility' WHEN starts_with(description, 'PR ') THEN 'professional' WHEN code_type = 'RC' THEN 'facility'
  WHEN starts_with(description, 'HC ') THEN 'facility' END AS billing_class, CASE WHEN billing_class = '' AND {A_CODE} THEN substr(code, 2) ELSE code END AS code FROM charge_items""")
def billing_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = codes.billing_class(F.col("code"), F.col("code_type"), F.col("description"), F.col("billing_class"))
    return table(spark, sf_dir, "charge_items").select("item_id", b.alias("b")).select("item_id", "b.billing_class", "b.code")


#: Codes and types as files give them, with the standard pair that each must become.
CODE_CASES = [
    ("HCPCS C1776", None, "C1776", "HCPCS"), ("320.0", "RC", "0320", "RC"), ("99213", "HCPCS", "99213", "CPT"), ("D0120", "CPT", "D0120", "CDT"), ("0237T", "HCPCS", "0237T", "CPT"),
    ("12345-678-9", "NDC", "12345067809", "NDC"), ("A123", "NDC", "A123", "LOCAL"), ("XJ0591X", "CPT", "J0591", "HCPCS"), ("1622", "MS-DRG", "1622", "LOCAL"), ("99232", "RC", "99232", "CPT"),
    ("SUP-12", "CPT", "SUP-12", "CDM"), ("12345678", "CPT", "12345678", "CDM"), ("250", "HCPCS", "0250", "RC"), ("TEST 1", None, "TEST 1", "LOCAL"), ("DRG100", None, "100", "MS-DRG"),
    ("99213", "TYPE", "99213", "CPT"), ("001-1 Short Stay", "APR-DRG", "001-1", "APR-DRG"), ("48.4", "APR-DRG", "048-4", "APR-DRG"), ("0411", "APR-DRG", "041-1", "APR-DRG"),
    ("48-3", "APR-DRG", "048-3", "APR-DRG"), ("48", "APR-DRG", "048", "APR-DRG"), ("139 Unspecified", "APR-DRG", "139", "APR-DRG"), (None, "cpt4", None, "CPT"),
]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


@query(f"SELECT i::BIGINT AS i, code, code_type FROM (VALUES {_values([(i, c, t) for i, (_, _, c, t) in enumerate(CODE_CASES)])}) AS v(i, code, code_type)")
def code_normalize_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalize() on written cases; the SQL states the results as literals."""
    return codes.normalize(spark.createDataFrame([(i, c, t) for i, (c, t, _, _) in enumerate(CODE_CASES)], "i long, code string, code_type string"))


PLAN_CASES = [
    ("Commercial HMO", "Commercial", "HMO", "Commercial HMO"), ("NON-HMO", "Commercial", None, "Commercial"), ("medicaid x", "Medicaid", None, "Medi-Cal"), ("", "Other", None, "Other"), (None, "Other", None, "Other"),
    ("Zed", "Other", None, "Zed"), ("MGMCR", "Medicare", None, "Medicare Advantage"), ("Corvelwc", "Workers Comp", None, "Workers Comp"), ("Molinamgdmcaid", "Medicaid", "Managed Care", "Medi-Cal Managed Care"),
]


@query(f"SELECT i::BIGINT AS i, plan_category, plan_network, plan_name FROM (VALUES {_values([(i, *r[1:]) for i, r in enumerate(PLAN_CASES)])}) AS v(i, plan_category, plan_network, plan_name)")
def plan_class_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_class() on written cases; the SQL states the results as literals."""
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(PLAN_CASES)], "i long, raw string")
    return df.select("i", payers.plan_class(F.col("raw")).alias("p")).select("i", "p.*")


# --- values ------------------------------------------------------------------------------------------------------


@query(r"""SELECT o_orderkey, round(o_totalprice, 2) AS price, NULL::DOUBLE AS bad FROM orders""")
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    text = F.concat(F.lit(" $"), F.format_number("o_totalprice", 2))
    return t.select("o_orderkey", values.safe_float(text).alias("price"), values.safe_float(F.concat(text, F.lit("d"))).alias("bad"))


@query("SELECT rate_id, claim_count AS n, CASE WHEN claim_count IS NOT NULL THEN claim_count + 9 END AS upper FROM payer_rates")
def count_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("claim_count").cast("string")
    top = F.concat(n, F.lit(" through "), (F.col("claim_count") + 9).cast("string"))
    return table(spark, sf_dir, "payer_rates").select("rate_id", values.safe_count(n).alias("n"), values.safe_count(top).alias("upper"))


METHOD = "CASE " + " ".join(f"WHEN lower(m) IN ({_quoted(v)}) THEN '{k}'" for k, v in values.METHODOLOGIES.items()) + r""" WHEN regexp_full_match(m, '[0-9]+(\.[0-9]+)?') AND m::DOUBLE > 0 AND m::DOUBLE <= 100 THEN 'percent_of_charge'
  WHEN contains(lower(m), 'percent') OR contains(lower(m), '% of') THEN 'percent_of_charge' WHEN contains(lower(m), 'fee') AND contains(lower(m), 'schedule') THEN 'fee_schedule'
  WHEN contains(lower(m), 'case') AND contains(lower(m), 'rate') THEN 'case_rate' WHEN contains(lower(m), 'per') AND contains(lower(m), 'diem') THEN 'per_diem'
  WHEN m IS NOT NULL THEN 'other' END"""


@query(f"WITH t AS (SELECT rate_id, nullif(trim(methodology), '') AS m FROM payer_rates) SELECT rate_id, {METHOD} AS methodology_type FROM t")
def methodology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "payer_rates").select("rate_id", values.methodology_type(F.col("methodology")).alias("methodology_type"))


@query("""
SELECT rate_id, CASE WHEN negotiated_rate IS NULL AND negotiated_percentage IS NULL AND negotiated_algorithm IS NULL THEN 42.5 ELSE negotiated_percentage END AS negotiated_percentage,
  CASE WHEN negotiated_rate IS NULL AND negotiated_percentage IS NULL AND negotiated_algorithm IS NULL THEN 'percent_of_charge' ELSE methodology_type END AS methodology_type FROM payer_rates""")
def methodology_hoist(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = values.hoist_methodology(F.lit("42.5"), F.col("methodology_type"), F.col("negotiated_rate"), F.col("negotiated_percentage"), F.col("negotiated_algorithm"))
    return table(spark, sf_dir, "payer_rates").select("rate_id", h.alias("h")).select("rate_id", "h.negotiated_percentage", "h.methodology_type")


@query(r"""
SELECT meta_id, nullif(replace(trim(ein), '-', ''), '') AS ein,
  list_filter(list_transform(string_split(type_2_npi, '|'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) = 10)[1] AS npi FROM file_metadata""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_metadata").select("meta_id", values.ein(F.col("ein")).alias("ein"), values.first_npi(F.col("type_2_npi")).alias("npi"))


@query(r"SELECT tic_rate_id, coalesce(strftime(try_strptime(expiration_date, '%Y-%m-%d'), '%Y-%m-%d'), '9999-12-31') AS expiration_date FROM tic_rates")
def expiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tic_rates").select("tic_rate_id", values.expiration(F.col("expiration_date")).alias("expiration_date"))


@query("SELECT cell_id, lower(trim(value)) IN (" + _quoted(values.NULL_RATES) + ") AS missing FROM unmapped_cells WHERE value IS NOT NULL")
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "unmapped_cells").filter("value is not null").select("cell_id", values.is_null_rate(F.col("value")).alias("missing"))


# --- headers -----------------------------------------------------------------------------------------------------

Q = "\"''“”‘’"
NORM = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(trim(source_header), '^[{Q}]+|[{Q}]+$', '', 'g')), '[\s-]+', '_', 'g'), '[^\p{{L}}\p{{N}}_]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"""
SYN = ", ".join(f"('{w}', '{f}')" for f, ws in headers.SYNONYMS.items() for w in ws)


@query(f"SELECT mapping_id, {NORM} AS normalized FROM header_mappings")
def header_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "header_mappings").select("mapping_id", headers.normalize_header(F.col("source_header")).alias("normalized"))


@query(f"""
WITH s(k, f) AS (VALUES {SYN}), t AS (SELECT mapping_id, {NORM} AS n FROM header_mappings WHERE NOT contains(source_header, '|'))
SELECT mapping_id, f AS field FROM t LEFT JOIN s ON t.n = s.k""")
def header_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "header_mappings").filter(~F.col("source_header").contains("|")).select("mapping_id", headers.canonical(F.col("source_header")).alias("field"))


@query(rf"""
WITH t AS (SELECT mapping_id, string_split(regexp_replace(trim(source_header), '^[{Q}]+|[{Q}]+$', '', 'g'), '|') AS p FROM header_mappings),
u AS (SELECT mapping_id, list_transform(p, lambda x: trim(x)) AS p, regexp_replace(lower(p[-1]), '[ -]+', '_', 'g') AS s, regexp_replace(lower(p[1]), '[ -]+', '_', 'g') AS h FROM t WHERE len(p) = 4)
SELECT mapping_id, p[2] AS payer, p[3] AS plan, CASE s WHEN 'negotiated_dollar' THEN 'negotiated_rate' ELSE s END AS field FROM u
WHERE h = 'standard_charge' AND s IN ('negotiated_dollar', 'negotiated_percentage', 'negotiated_algorithm', 'methodology')""")
def wide_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "header_mappings").select("mapping_id", headers.wide_payer(F.col("source_header")).alias("w")).filter("w is not null")
    return t.select("mapping_id", "w.*")


# --- rows --------------------------------------------------------------------------------------------------------


@query("""
SELECT item_id, file_id, code, code_type FROM (SELECT *, row_number() OVER (PARTITION BY file_id, code, code_type, billing_class, setting, coalesce(modifiers, '') ORDER BY row_ord, item_id) AS r FROM charge_items) WHERE r = 1""")
def item_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "charge_items").withColumn("m", F.coalesce("modifiers", F.lit(""))).select("item_id", "file_id", "row_ord", "code", "code_type", "billing_class", "setting", "m")
    return ordered.first_wins(t, ["file_id", "code", "code_type", "billing_class", "setting", "m"], ["row_ord", "item_id"]).select("item_id", "file_id", "code", "code_type")


@query("SELECT cell_id, file_id, source_column FROM (SELECT *, row_number() OVER (PARTITION BY file_id, source_column ORDER BY cell_id) AS r FROM unmapped_cells WHERE value <> '') WHERE r <= 2000")
def unmapped_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "unmapped_cells").filter("value <> ''").select("cell_id", "file_id", "source_column")
    return ordered.capped(t, ["file_id", "source_column"], ["cell_id"], 2000)


@query("""
WITH s AS (SELECT user_id, min(event_id) AS stop FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT event_id, e.user_id, event_type FROM events e LEFT JOIN s USING (user_id) WHERE stop IS NULL OR event_id < stop""")
def section_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ordered.before_boundary(t, ["user_id"], "event_id", F.col("event_type") == "error").select("event_id", "user_id", "event_type")


@query(" UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{g}' AS payer, {c} AS rate FROM lineitem WHERE {c} <> 0" for g, c in (("A", "l_extendedprice"), ("B", "l_discount"), ("C", "l_tax"))))
def wide_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"A": {"rate": "l_extendedprice"}, "B": {"rate": "l_discount"}, "C": {"rate": "l_tax"}}
    return ordered.unpivot(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], groups, "payer")


@query("""
SELECT count(*) AS n, count(DISTINCT i.item_id) AS items FROM payer_rates r JOIN charge_items i ON r.file_id = i.file_id AND r.code IS NOT DISTINCT FROM i.code
  AND r.code_type IS NOT DISTINCT FROM i.code_type AND r.billing_class = i.billing_class AND r.setting = i.setting AND r.modifiers IS NOT DISTINCT FROM i.modifiers""")
def item_rate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, i = table(spark, sf_dir, "payer_rates").alias("r"), table(spark, sf_dir, "charge_items").alias("i")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"i.{k}")) for k in ("file_id", "code", "code_type", "billing_class", "setting", "modifiers")]
    return r.join(i, same).agg(F.count("*").alias("n"), F.count_distinct("i.item_id").alias("items"))


@query("""
WITH p AS (SELECT file_id, min(hospital_id) AS hospital_id, min(file_seq) AS file_seq FROM file_metadata GROUP BY 1)
SELECT file_id, hospital_id, file_seq, lag(file_id) OVER (PARTITION BY hospital_id ORDER BY file_seq, file_id) AS prev_id FROM p""")
def previous_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.previous_files(table(spark, sf_dir, "file_metadata").select("file_id", "hospital_id", "file_seq"))


# --- payers ------------------------------------------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT DISTINCT raw_payer_name AS raw FROM payer_rates WHERE raw_payer_name IS NOT NULL),
w AS (SELECT raw, string_split(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')), ' ') AS l FROM t)
SELECT raw, upper(array_to_string(list_transform(l, lambda x: CASE WHEN length(x) > 3 AND ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN x[:-2] ELSE x END), ' ')) AS key FROM w""")
def payer_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "payer_rates").select(F.col("raw_payer_name").alias("raw")).filter("raw is not null").distinct().withColumn("key", payers.match_key(F.col("raw")))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 5 IN (0, 1) THEN true ELSE false END AS self_pay FROM customer""")
def self_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey") % 5
    name = F.when(k == 0, "30% Cash").when(k == 1, "[Uninsured patient estimate]").when(k == 2, "Cash America Insurance").when(k == 3, "12345").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", payers.is_self_pay(name).alias("self_pay"))


@query("SELECT o_orderkey, n_name AS payer_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def payer_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest leading words found in the dictionary, here nation names followed by other words."""
    n = table(spark, sf_dir, "nation")
    t = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    t = t.select("o_orderkey", F.concat_ws(" ", F.lower("n_name"), F.lit("health plan of"), "c_mktsegment").alias("raw"))
    return payers.resolve(t, "raw", n.select(F.col("n_name").alias("key"), F.col("n_name").alias("canonical"))).select("o_orderkey", "payer_name")


@query()
def plan_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "payer_rates").select("rate_id", payers.plan_class(F.col("plan_name"), F.col("payer_name")).alias("p")).select("rate_id", "p.*")


# --- nested and in-network files ---------------------------------------------------------------------------------


@query("""
WITH l AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_extendedprice END AS g FROM lineitem)
SELECT l_orderkey AS ord, lower(l_linestatus) AS setting, coalesce(arg_min(g, l_linenumber * 10000000 + g) FILTER (WHERE g <> 0), 0) AS gross_charge, count(*) AS payers FROM l GROUP BY 1, 2""")
def cms_flatten_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    price = F.when(F.col("l_linenumber") % 2 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice"))
    who = F.array(F.struct(F.concat(F.lit("Payer "), "l_suppkey").alias("payer_name"), F.col("l_quantity").alias("standard_charge_dollar")))
    charge = F.struct(F.col("l_linenumber").alias("n"), F.col("l_linestatus").alias("setting"), price.alias("gross_charge"), who.alias("payers_information"))
    doc = t.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(charge)).alias("standard_charges"))
    raw = F.to_json(F.struct(F.lit("x").alias("description"), F.array(F.struct(F.lit("99213").alias("code"), F.lit("CPT").alias("type"))).alias("code_information"), "standard_charges"))
    flat = nested.flatten(doc.select(F.lit("f").alias("file_id"), F.col("l_orderkey").alias("ord"), raw.alias("raw")))
    return flat.select("ord", "setting", "gross_charge", F.size("payers").cast("long").alias("payers"))


@query("""
SELECT billing_code, billing_class, setting, value, array_to_string(list_transform(list_sort(list(DISTINCT l_suppkey)), lambda x: x::VARCHAR), '|') AS provider_group_ids
FROM (SELECT l_partkey AS billing_code, l_returnflag AS billing_class, l_linestatus AS setting, l_discount AS value, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2, 3, 4""")
def tic_price_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    t = table(spark, sf_dir, "lineitem").join(known, "l_suppkey", "left_semi")
    t = t.select(F.col("l_partkey").alias("billing_code"), F.col("l_returnflag").alias("billing_class"), F.col("l_linestatus").alias("setting"), F.col("l_discount").alias("value"), F.col("l_suppkey").cast("string").alias("id"))
    return tic.merge_prices(t, ["billing_code", "billing_class", "setting", "value"], "id")


@query(r"""
WITH t AS (SELECT group_row_id, tic_file_id, group_id, nullif(regexp_replace(tin, '[^0-9]', '', 'g'), '') AS tin,
  array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(string_split(npis, '|'), lambda x: try_cast(x AS BIGINT)), lambda x: x BETWEEN 1000000000 AND 9999999999))), lambda x: x::VARCHAR), '|') AS npis FROM tic_provider_groups)
SELECT tic_file_id, group_id, tin, npis, group_row_id FROM (SELECT *, row_number() OVER (PARTITION BY tic_file_id, group_id, tin, npis ORDER BY group_row_id) AS r FROM t WHERE tin IS NOT NULL AND npis <> '') WHERE r = 1""")
def tic_provider_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tic_provider_groups")
    npis = F.array_join(F.transform(values.npi_set(F.split("npis", r"\|")), lambda x: x.cast("string")), "|")
    t = t.select("group_row_id", "tic_file_id", "group_id", values.tin(F.col("tin")).alias("tin"), npis.alias("npis")).filter("tin is not null and npis <> ''")
    return ordered.first_wins(t, ["tic_file_id", "group_id", "tin", "npis"], ["group_row_id"]).select("tic_file_id", "group_id", "tin", "npis", "group_row_id")


@query("""
SELECT tic_file_id, tin, 'inline-' || row_number() OVER (PARTITION BY tic_file_id ORDER BY seen, tin) AS id FROM (SELECT tic_file_id, tin, min(group_row_id) AS seen FROM tic_provider_groups GROUP BY 1, 2)""")
def tic_inline_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.first_seen_ids(table(spark, sf_dir, "tic_provider_groups"), ["tic_file_id"], ["tin"], ["group_row_id"])


@query("""
WITH p AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS plan_name FROM customer),
f AS (SELECT s_nationkey AS k, 'https://files.example/' || s_name || '.json.gz' AS location FROM supplier)
SELECT k::BIGINT AS ord, plan_name, location AS in_network_location FROM f LEFT JOIN p USING (k)""")
def tic_index_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.transform(F.collect_set("c_mktsegment"), lambda x: F.struct(x.alias("plan_name"))).alias("reporting_plans"))
    f = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.transform(F.collect_list("s_name"), lambda x: F.struct(F.concat(F.lit("https://files.example/"), x, F.lit(".json.gz")).alias("location"))).alias("in_network_files"))
    s = f.join(p, "k", "left").select(F.lit("f").alias("file_id"), F.col("k").cast("long").alias("ord"), F.to_json(F.struct("reporting_plans", "in_network_files")).alias("raw"))
    roots = s.select("file_id", F.lit('{"reporting_entity_name":"E"}').alias("raw")).distinct()
    return tic.index(s, roots).select("ord", "plan_name", "in_network_location")


@query("""
WITH e AS (SELECT c_custkey, 'N' || c_nationkey AS network, '2026-0' || (c_custkey % 3 + 1) || '-01_N' || c_nationkey || '.json.gz' AS file_name, c_mktsegment AS m FROM customer WHERE c_nationkey <> 7),
k AS (SELECT network, m, count(*) AS n, min(c_custkey) AS seen FROM e GROUP BY 1, 2), b AS (SELECT network, m FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY n DESC, seen) AS r FROM k) WHERE r = 1)
SELECT network, min(file_name) AS file_name, 'https://h/' || min(file_name) || '?sig=1' AS location, any_value(b.m) AS market_type, count(DISTINCT file_name) AS file_count FROM e JOIN b USING (network) GROUP BY 1""")
def network_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    file = F.concat(F.lit("https://h/2026-0"), (F.col("c_custkey") % 3 + 1).cast("string"), F.lit("-01_"), F.when(n == 7, F.lit("cap-rates-")).otherwise(F.lit("")), F.lit("N"), n.cast("string"), F.lit(".json.gz?sig=1"))
    e = table(spark, sf_dir, "customer").select("c_custkey", file.alias("in_network_location"), F.col("c_mktsegment").alias("plan_market_type"))
    return tic.networks(e, ["c_custkey"])


@query(r"""
SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) GROUP BY 1""")
def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of JSON keys by path, never by value."""
    return table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct prices with their provider groups, joined to the nations of those groups."""
    merged = tic_price_merge(spark, sf_dir)
    each = merged.select("billing_code", "billing_class", "setting", "value", F.explode(F.split("provider_group_ids", r"\|")).alias("id"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return each.join(s, "id").join(n, "s_nationkey").groupBy("n_name", "billing_class", "setting").agg(F.count("*").alias("prices"), F.count_distinct("billing_code").alias("codes"))
