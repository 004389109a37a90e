"""Column headers -> canonical fields, as Column expressions.

A header plan is data: one row per column of a file. The expressions here work on that small table, not on the cells.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import strip

# The normalized headers of each canonical field.
SYNONYMS = {
    "code": [
        "billing_code", "code", "cpt", "hcpcs", "hcpcs_code", "hcpcscpt_code", "procedure_code", "procedurecode", "service_code", "code_value",
        "codes", "procedure_external_id", "cpthcpcs_code", "ivcptcd",
    ],
    "code_type": ["billing_code_type", "code_type", "coding_type"],
    "description": [
        "description", "item_description", "procedure_description", "service_description", "customer_description", "code_descriptions",
        "charge_description", "procedure_external_id_record_name", "billing_code_description", "ivdesc",
    ],
    "gross_charge": [
        "gross_charge", "grosscharge", "standard_charge_gross", "gross", "charge_gross", "gross_price", "standard_charge", "price",
        "gross_charge_per_cdm", "ivprice1", "gross_charges_estimate", "gross_outpatient",
    ],
    "discounted_cash_price": [
        "discounted_cash_price", "cash_price", "self_pay", "selfpay", "cash", "discounted_price", "standard_charge_discounted_cash",
        "discounted_cash", "discounted_cash_price_gross_charges", "estimated_discounted_cash", "standard_charge_estimated_discounted_cash",
        "cash_price_estimate",
    ],
    "min_negotiated_rate": [
        "min_negotiated_rate", "minimum_negotiated_rate", "minimumnegotiatedcharge", "min_rate", "minimum", "standard_charge_min", "min",
        "min_ip_reimb", "min_negotiated_charge", "minimum_reimbursement",
    ],
    "max_negotiated_rate": [
        "max_negotiated_rate", "maximum_negotiated_rate", "maximumnegotiatedcharge", "max_rate", "maximum", "standard_charge_max", "max",
        "max_ip_reimb", "max_negotiated_charge", "maximum_reimbursement",
    ],
    "hospital_name": ["hospital_name", "facility_name", "facility"],
    "hospital_location": ["hospital_location", "facility_location", "address"],
    "hospital_ein": ["ein", "hospital_ein", "tax_id"],
    "cms_certification_number": ["cc_number", "cms_certification_number", "cms_id", "medicare_provider_number"],
    "payer_name": ["payer_name", "payer", "insurance_name", "insurance_carrier"],
    "plan_name": ["plan_name", "plan", "plans", "insurance_plan", "product"],
    "negotiated_rate": ["standard_charge_negotiated_dollar", "negotiated_dollar", "negotiated_rate", "ip_price"],
    "negotiated_percentage": ["standard_charge_negotiated_percentage", "standard_charge_negotiated_percent", "negotiated_percentage", "negotiated_percent"],
    "negotiated_algorithm": ["standard_charge_negotiated_algorithm", "negotiated_algorithm"],
    "methodology": ["standard_charge_methodology", "methodology", "rate_methodology"],
    "estimated_amount": ["estimated_amount", "estimate_amount", "insurance_estimate", "ip_expected_reimbursement"],
    "billing_class": ["billing_class"],
    "setting": ["setting"],
    "modifiers": ["modifiers", "modifier", "modifier_code", "procedure_modifier"],
    "drug_unit_of_measurement": ["drug_unit_of_measurement", "drug_unit"],
    "drug_type_of_measurement": ["drug_type_of_measurement", "drug_type"],
    "additional_notes": ["additional_notes", "additional_payer_notes"],
    "additional_generic_notes": ["additional_generic_notes", "additional_generic_notes_with_lpp"],
    "footnote": ["footnote", "pricing_footnote", "rate_footnote"],
    "median_amount": ["median_amount", "median_allowed_amount"],
    "pct_10": ["10th_percentile", "tenth_percentile_allowed_amount"],
    "pct_90": ["90th_percentile", "ninetieth_percentile_allowed_amount"],
    "claim_count": ["count", "allowed_amount_count", "count_of_compared_rates"],
}
WIDE_SUFFIXES = {
    "negotiated_rate": ["negotiated_dollar", "negotiated_rate_dollar"],
    "negotiated_percentage": ["negotiated_percentage", "negotiated_percent", "negotiated_rate_percentage", "negotiated_rate_percent"],
    "negotiated_algorithm": ["negotiated_algorithm", "negotiated_rate_algorithm"],
    "methodology": ["methodology"],
}
WIDE_PREFIXES = {
    "estimated_amount": ["estimated_amount", "estimate_amount"],
    "additional_notes": ["additional_payer_notes"],
    "median_amount": ["median_amount"],
    "pct_10": ["10th_percentile"],
    "pct_90": ["90th_percentile"],
    "claim_count": ["count"],
}
CHARGE_PREFIXES = ["standard_charge", "standard_charges", "standard_charged"]
LOW_VALUE = [
    "op_price", "min_op_reimb", "max_op_reimb", "op_expected_reimbursement", "ip_pricing_detail", "op_pricing_detail", "ip_xr_detail", "op_xr_detail",
    "facility_id", "contract", "procedure", "quantity", "rev_code", "rev", "ndc", "cdm", "procedure_id", "mnemonic", "neumonic", "department", "d",
    "tabname", "hospitalbilling_inpatient_min_price", "hospitalbilling_inpatient_max_price", "hospitalbilling_outpatient_min_price",
    "hospitalbilling_outpatient_max_price", "professionalbilling_inpatient_min_price", "professionalbilling_inpatient_max_price",
    "professionalbilling_outpatient_min_price", "professionalbilling_outpatient_max_price", "revenue_code_description", "fscrptcat3name", "fscname",
    "fsccategory", "script_type", "service_area", "count_of_compared_rates", "additional_generic_notes1", "additional_generic_notes2",
    "lpp_id_internal", "algorithm_factors_internal", "contract_internal", "count_internal", "location_internal", "pricing_detail_internal",
    "xr_detail_internal", "revenue_code", "allowed_amounts", "billing_code_type_version", "last_updated", "code_2", "code_2_type", "code_3",
    "code_3_type", "code_4", "code_4_type", "surgctr", "westlake", "additional_payer_specific_notes", "charge_number", "ivnum", "mins_per_unit",
    "financial_aid_policy", "item", "item_no", "additional_generic_notes_payor_reimbursement", "item_id", "dept", "dept_name",
]
LOW_VALUE_FORMS = r"^[a-z0-9_]+_internal$|^column\d+$|^\d+$|^code(?:[2-9]|[1-9]\d)(type)?$"
SETTING_WORDS = {"Inpatient": "inpatient", "Outpatient": "outpatient", "EmergencyRoom": "emergency"}
METHOD_WORDS = {"PercentofCharges": "percent_of_charge", "PerDiem": "per_diem", "FeeSchedule": "fee_schedule", "CaseRate": "case_rate"}
THREE_SETTINGS = {  # normalized header -> field, setting
    "inpatientgrosscharge": ("gross_charge", "inpatient"), "outpatientgrosscharge": ("gross_charge", "outpatient"),
    "emergencyroomgrosscharge": ("gross_charge", "emergency"), "discountedcashpriceinpatient": ("discounted_cash_price", "inpatient"),
    "discountedcashpriceoutpatient": ("discounted_cash_price", "outpatient"), "discountedcashpriceemergencyroom": ("discounted_cash_price", "emergency"),
}
TWO_SETTINGS = {
    "inpatient_gross_charge": ("gross_charge", "inpatient"), "outpatient_gross_charge": ("gross_charge", "outpatient"),
    "inpatient_negotiated_charge": ("negotiated_charge", "inpatient"), "outpatient_negotiated_charge": ("negotiated_charge", "outpatient"),
    "inpatient_discounted_charge": ("discounted_cash_price", "inpatient"), "outpatient_discounted_charge": ("discounted_cash_price", "outpatient"),
    "gross_charge_facility": ("gross_charge", "inpatient"), "gross_charge_non_facility": ("gross_charge", "outpatient"),
    "negotiated_charge_facility": ("negotiated_charge", "inpatient"), "negotiated_charge_non_facility": ("negotiated_charge", "outpatient"),
}
# ------------------------------------------------------------------

QUOTES = r"""^["'“”‘’]+|["'“”‘’]+$"""


def lookup(table: dict[str, list[str]], key: Column) -> Column:
    """The target of a constant table (target -> its words) that has the key among its words; null if none has."""
    pairs = F.create_map(*(F.lit(x) for target, keys in table.items() for k in keys for x in (k, target)))
    return F.try_element_at(pairs, F.coalesce(key, F.lit("")))


def unquote(c: Column) -> Column:
    return F.regexp_replace(strip(c), QUOTES, "")


def normalize_header(c: Column) -> Column:
    h = F.regexp_replace(F.lower(unquote(F.lower(c))), r"(?U)[\s\-]+", "_")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"(?U)[^\w_]", ""), r"_+", "_"), r"^_+|_+$", "")


def canonical(c: Column, extra: dict[str, str] | None = None) -> Column:
    """The canonical field of a header: its synonym, else that of a piped form, else the caller's."""
    parts = F.transform(F.split(unquote(c), r"\|"), strip)
    n, first, last = F.size(parts), F.lower(F.try_element_at(parts, F.lit(1))), F.try_element_at(parts, F.lit(-1))
    syn = lambda k: lookup(SYNONYMS, k)
    norm = normalize_header(c)
    typed = (n >= 3) & F.lower(last).contains("type") & (first == "code")
    piped = F.when(typed, syn(normalize_header(F.concat(first, F.lit("_"), last))))
    charge = F.coalesce(syn(normalize_header(last)), syn(normalize_header(F.concat(first, F.lit("_"), last))))
    piped = F.coalesce(piped, F.when(~typed & (n == 2) & (first == "standard_charge"), charge), F.when(~typed & (n >= 2) & (first == "code"), F.lit("code")))
    field = F.coalesce(syn(norm), F.when(n >= 2, piped))
    if extra:
        known = {v: [k for k, x in extra.items() if x == v] for v in set(extra.values()) if v in SYNONYMS}
        field = F.coalesce(field, lookup(known, norm)) if known else field
    return field


def wide_payer(c: Column) -> Column:
    """struct(payer, plan, field) of a header that names a payer; null for others."""
    raw = F.transform(F.split(unquote(c), r"\|"), strip)
    parts = F.when((F.size(raw) >= 3) & (F.get(raw, F.lit(1)) == ""), F.concat(F.slice(raw, 1, 1), F.slice(raw, F.lit(3), F.greatest(F.size(raw) - 2, F.lit(1))))).otherwise(raw)
    n, prefix = F.size(parts), normalize_header(F.get(parts, F.lit(0)))
    charge = prefix.isin(CHARGE_PREFIXES) & (n >= 3)
    suffix = lookup(WIDE_SUFFIXES, normalize_header(F.try_element_at(parts, F.lit(-1))))
    other = lookup(WIDE_PREFIXES, prefix)
    field = F.when(charge, suffix).when(n >= 2, other)
    ends = F.when(charge, n - 1).otherwise(n)
    plan = F.array_join(F.filter(F.when(ends > 2, F.slice(parts, F.lit(3), F.greatest(ends - 2, F.lit(1)))).otherwise(F.array().cast("array<string>")), lambda x: x != ""), " - ")
    payer = F.get(parts, F.lit(1))
    return F.when(c.contains("|") & field.isNotNull() & (payer != ""), F.struct(payer.alias("payer"), plan.alias("plan"), field.alias("field")))


def setting_payer(c: Column) -> Column:
    """struct(payer, setting, methodology) of '{Payer}_{Setting}_{Method}[_N]'; null for others."""
    pattern = r"^(.+)_(" + "|".join(SETTING_WORDS) + r")_(" + "|".join(METHOD_WORDS) + r")(?:_\d+)?$"
    one = lambda d, k: lookup({v: [w] for w, v in d.items()}, F.regexp_extract(c, pattern, k))
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("payer"), one(SETTING_WORDS, 2).alias("setting"), one(METHOD_WORDS, 3).alias("methodology")))


def low_value(normalized: Column) -> Column:
    """Columns without a target that are not worth keeping cell by cell."""
    return F.coalesce(normalized, F.lit("")).isin("", *LOW_VALUE) | F.coalesce(normalized.rlike(LOW_VALUE_FORMS), F.lit(False))
