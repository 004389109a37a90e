"""Cell values as Column expressions: numbers, counts, identifiers, methodologies, dates.

Every function takes and returns Columns and stays in the JVM; null in gives null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Methodology spellings of each type, and placeholders that mean "no rate".
METHODOLOGIES = {
    "percent_of_charge": [
        "percent of total billed charges", "percent of billed charges", "percentage of billed charges", "percent of charges", "percent of charge",
        "percent charge", "pct of charges", "% of charges", "% of billed charges",
    ],
    "fee_schedule": ["fee schedule", "fee-schedule", "fee for service"],
    "case_rate": ["case rate", "case-rate", "case based"],
    "per_diem": ["per diem", "per-diem", "perdiem"],
    "other": ["other"],
}
NULL_RATES = ["n/a", "n/a.", "na", "#n/a", "null", "none", "nil", "-", "--", "—"]
NEVER_EXPIRES = "9999-12-31"
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE",
    "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA",
    "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN",
    "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ",
    "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR",
    "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT",
    "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY", "Puerto Rico": "PR",
    "Virgin Islands": "VI", "Guam": "GU", "American Samoa": "AS", "Northern Mariana Islands": "MP",
}
NPI_RANGE = (1_000_000_000, 9_999_999_999)
# ------------------------------------------------------------------

NUMBER = r"^[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$"
NOT_FINITE = r"(?i)^[+-]?(?:nan|inf|infinity)$"


def strip(c: Column) -> Column:
    """Strip Unicode white space (F.trim strips blanks only)."""
    return F.regexp_replace(c, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def truthy(c: Column) -> Column:
    """Numbers count when they are not 0."""
    return F.coalesce(c != 0, F.lit(False))


def safe_float(c: Column) -> Column:
    """'$1,234.50' -> 1234.5; anything that is no number gives null."""
    s = strip(F.regexp_replace(c.cast("string"), r"[$,]", ""))
    plain = F.when(s.rlike(NUMBER), F.regexp_replace(s, "_", "").try_cast("double"))
    sign = F.when(s.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    odd = F.when(s.rlike(r"(?i)nan"), F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    return F.coalesce(plain, F.when(s.rlike(NOT_FINITE), odd))


def safe_count(c: Column) -> Column:
    """A whole number; a range such as '1 through 10' gives its upper end, other text its trailing number."""
    s = blank_to_null(c.cast("string"))
    plain = F.when(s.rlike(r"^-?\d*\.?\d+$|^-?\d+\.$"), s.try_cast("double").try_cast("long"))
    span = F.nullif(F.regexp_extract(s, r"(?i)(\d+)\s*(?:through|thru|to|-)\s*(\d+)", 2), F.lit(""))
    tail = F.nullif(F.regexp_extract(s, r"(\d+)\s*$", 1), F.lit(""))
    return F.coalesce(plain, span.try_cast("long"), tail.try_cast("long"))


def number_or_na(c: Column) -> Column:
    return F.when(F.upper(strip(c)) != "N/A", safe_float(c))


def is_null_rate(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(NULL_RATES), F.lit(False))


def looks_like_dollars(c: Column) -> Column:
    """Amounts, 'Packaged' and the empty amount '$-'."""
    s = strip(F.regexp_replace(F.regexp_replace(c, r"^\$+", ""), ",", ""))
    return (c != "") & ((F.lower(c) == "packaged") | s.isin("", "-") | F.coalesce(s.rlike(NUMBER) | s.rlike(NOT_FINITE), F.lit(False)))


def methodology_type(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """The type of a methodology text: alias, known spelling, bare percentage, keywords, else 'other'."""
    s = blank_to_null(c)
    low = F.lower(s)
    named = F.lit(None).cast("string")
    for kind, texts in METHODOLOGIES.items():
        named = F.coalesce(named, F.when(low.isin(texts), F.lit(kind)))
    known = F.coalesce(*(F.when(F.upper(s) == k, F.lit(v)) for k, v in (aliases or {}).items()), named)
    value = F.when(s.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), s.try_cast("double"))
    has = lambda *w: F.array_contains(F.array(*(low.contains(x) for x in w)), False) == F.lit(False)
    return F.when(s.isNotNull(), F.coalesce(
        known,
        F.when((value > 0) & (value <= 100), "percent_of_charge"),
        F.when(low.contains("percent") | low.contains("% of"), "percent_of_charge"),
        F.when(has("fee", "schedule"), "fee_schedule"),
        F.when(has("case", "rate"), "case_rate"),
        F.when(has("per", "diem"), "per_diem"),
        F.lit("other"),
    ))


def clean_methodology(c: Column) -> Column:
    """Without audit notes and addresses of the web."""
    return F.when((strip(c) != "") & ~c.rlike(r"(?i)re-evaluated|historical claim|https?://"), c)


def hoist_methodology(methodology: Column, kind: Column, rate: Column, percentage: Column, algorithm: Column) -> Column:
    """struct(methodology, methodology_type, negotiated_percentage): a bare 0 is dropped, a bare number of 1 to 100 on a row
    without any other price becomes its percentage."""
    s = strip(methodology)
    value = F.when(s.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), s.try_cast("double"))
    moves = F.coalesce((value >= 1) & (value <= 100) & rate.isNull() & percentage.isNull() & algorithm.isNull(), F.lit(False))
    keeps = F.coalesce(value != 0, F.lit(True)) & ~moves
    return F.struct(
        F.when(keeps, methodology).alias("methodology"),
        F.when(moves, F.lit("percent_of_charge")).otherwise(kind).alias("methodology_type"),
        F.when(moves, value).otherwise(percentage).alias("negotiated_percentage"),
    )


def first_npi(c: Column) -> Column:
    """The first part between pipes that holds exactly ten digits."""
    digits = F.transform(F.split(c, r"\|"), lambda x: F.regexp_replace(x, r"[^0-9]", ""))
    return F.get(F.filter(digits, lambda x: F.length(x) == 10), F.lit(0))


def ein(c: Column) -> Column:
    return F.nullif(F.regexp_replace(strip(c), "-", ""), F.lit(""))


def tin(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c.cast("string"), r"[^0-9]", ""), F.lit(""))


def npi_set(c: Column) -> Column:
    """Valid NPIs of an array, distinct and sorted, as longs."""
    n = F.transform(c, lambda x: x.cast("string").try_cast("long"))
    return F.array_sort(F.array_distinct(F.filter(n, lambda x: F.coalesce(x.between(*NPI_RANGE), F.lit(False)))))


def expiration(c: Column) -> Column:
    """ISO date; missing or unreadable dates never expire."""
    return F.coalesce(F.date_format(F.try_to_date(F.nullif(c, F.lit("")), "yyyy-M-d"), "yyyy-MM-dd"), F.lit(NEVER_EXPIRES))


def file_name(location: Column) -> Column:
    return F.substring_index(F.substring_index(location, "?", 1), "/", -1)


def network_key(location: Column) -> Column:
    """A file's base name without extension and leading date, so that each month's copy keeps the key."""
    return F.regexp_replace(F.substring_index(file_name(location), ".", 1), r"^\d{4}-\d{2}(?:-\d{2})?_", "")


def modifier_tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"[|, ;]+"), lambda x: x != "")


def merge_modifier(existing: Column, baked: Column) -> Column:
    """existing with baked appended unless it is there; nothing baked leaves existing as it is."""
    add = blank_to_null(baked)
    tokens = modifier_tokens(existing)
    merged = F.array_join(F.when(F.array_contains(tokens, add), tokens).otherwise(F.concat(tokens, F.array(add))), ",")
    return F.when(add.isNull(), existing).when(F.coalesce(strip(existing), F.lit("")) == "", add).otherwise(merged)


def title_case(c: Column) -> Column:
    """Upper case for every letter after a non-letter."""
    parts = F.split(F.lower(c), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def file_ids(name: Column) -> Column:
    """struct(ein, npi) of a file name that starts with them: '68-0396600-1801821376_name_standardcharges.csv'."""
    head = F.substring_index(F.regexp_replace(F.regexp_replace(name, "^subset_", ""), r"(?i)\.(?:csv\.gz|json\.gz|csv|json|zip)$", ""), "_", 1)
    pattern = r"^(\d{9}|\d{2}-\d{7})(?:-(\d{10}))?$"
    part = lambda k: F.nullif(F.regexp_extract(head, pattern, k), F.lit(""))
    return F.struct(ein(part(1)).alias("ein"), part(2).alias("npi"))


def address_parts(c: Column) -> Column:
    """struct(street, city, state, zip) of an address in one line; what cannot be told apart stays in street."""
    s = strip(F.regexp_replace(strip(c), r'^"(.*)"$', "$1"))
    ends = [  # pattern of the end, group of the state, group of the ZIP code
        (r"[,\s]+([A-Za-z]{2})[,\s]+(\d{5}(?:-\d{4})?)$", 1, 2), (r"[,\s]+([A-Za-z][A-Za-z ]+?)\s+(\d{5}(?:-\d{4})?)$", 1, 2),
        (r"\s+(\d{5}(?:-\d{4})?)\s+([A-Za-z]{2})$", 2, 1), (r"[,\s]+([A-Z]{2})$", 1, None),
    ]
    names = F.create_map(*(F.lit(x) for name, short in STATES.items() for k in (name.upper(), short) for x in (k, short)))
    null = F.lit(None).cast("string")
    front = r"^([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)\s*\|\s*(.*)$"
    ways = [F.when(s.rlike(front), F.struct(F.regexp_extract(s, front, 1).alias("word"), F.regexp_extract(s, front, 2).alias("zip"), F.regexp_extract(s, front, 3).alias("rest")))]
    for pattern, st, z in ends:
        ways.append(F.when(s.rlike(pattern), F.struct(F.regexp_extract(s, pattern, st).alias("word"), (F.regexp_extract(s, pattern, z) if z else null).alias("zip"), F.regexp_replace(s, pattern, "").alias("rest"))))
    named = F.transform(F.array_compact(F.array(*ways)), lambda w: F.struct(F.try_element_at(names, F.upper(w["word"])).alias("state"), w["zip"].alias("zip"), w["rest"].alias("rest")))
    hit = F.coalesce(F.get(F.filter(named, lambda w: w["state"].isNotNull()), F.lit(0)), F.struct(null.alias("state"), null.alias("zip"), s.alias("rest")))
    rest = strip(hit["rest"])
    cut = r"^(.*),\s*([^,]+)$"
    split = hit["state"].isNotNull() & rest.rlike(cut)
    return F.when(s != "", F.struct(
        F.when(split, strip(F.regexp_extract(rest, cut, 1))).otherwise(rest).alias("street"), F.when(split, strip(F.regexp_extract(rest, cut, 2))).alias("city"), hit["state"].alias("state"), hit["zip"].alias("zip"),
    ))
