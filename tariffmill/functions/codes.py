"""Billing codes and code types as Column expressions.

normalize() runs its rules as stages on temporary columns: each stage sees what the one before it made, and a flag marks
codes that are finished. It needs no shuffle; run it on distinct (code, type) pairs where rows repeat them much.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import strip

# Labels of each code type, shapes of its codes, labels that say nothing.
TYPE_LABELS = {
    "CPT": ["CPT", "CPT4", "CPT-4"],
    "HCPCS": [
        "HCPCS", "HCPCS LEVEL II", "HCPCS II", "HCPCS2", "CPT/HCPCS", "HCPCS/CPT", "CPT / HCPCS", "HCPCS / CPT", "CPT-HCPCS", "HCPCS-CPT",
        "CPTHCPCS", "HCPCSCPT",
    ],
    "RC": ["RC", "REV", "REVENUE", "REVENUE CODE", "REVCODE"],
    "MS-DRG": ["MS-DRG", "MSDRG", "DRG", "TRIS-DRG"],
    "APR-DRG": ["APR-DRG", "APRDRG", "APR DRG", "APR_DRG", "AP-DRG"],
    "APC": ["APC"],
    "CMG": ["CMG"],
    "NDC": ["NDC"],
    "CDT": ["CDT", "DENTAL"],
    "CDM": ["CDM", "CHARGEMASTER", "SUP", "EAP", "ERX"],
    "LOCAL": ["LOCAL"],
}
PREFIXES = ["REVENUE CODE", "REVENUE", "REVCODE", "APR-DRG", "APR DRG", "APR_DRG", "MS-DRG", "APRDRG", "MSDRG", "HCPCS", "CPT4", "CPT", "DRG", "NDC", "REV", "APC", "CDM", "CDT", "CMG", "RC"]
NO_TYPE = ["TYPE", "MODIFIER", "MODIFIERS", "OBS", "DOT", "UN"]
CONTROLLED = {
    "RC": r"\d{3,4}", "MS-DRG": r"\d{1,3}", "APR-DRG": r"\d{1,4}(-\d{1,2})?", "APC": r"(?:\d{4,5}|[Nn]\d{3,4})", "CMG": r"\d{4}(-[A-Z])?", "EAPG": r"\d{3,5}",
}
REVENUE_CODES = [
    250, 255, 258, 270, 271, 272, 275, 276, 278, 300, 301, 302, 305, 306, 309, 310, 311, 312, 320, 323, 333, 335, 341, 342, 343, 350, 351, 352, 360, 361, 370, 390, 402, 403, 404, 410, 412, 420, 424, 430, 440, 450, 460, 470, 471, 480, 481, 483, 489, 510, 521, 610, 611, 615, 618, 636, 637, 710, 721, 722, 730, 731, 740, 750, 760, 812, 906, 916, 918, 920, 921, 922, 940, 942, 949, 987, 998,
]
LETTER_MODIFIERS = ["TC", "JW", "JZ", "TB", "SL", "XE", "XP", "XS", "XU", "QW", "LT", "RT", "GY", "FY", "GO", "GN", "GP", "NU", "PO"]
DIGIT_MODIFIERS = ["26", "54", "55", "56", "58", "78", "79", "24", "76", "77", "91", "59", "22", "25", "50", "52", "90", "95"]
SHORT_WORDS = {"XR": "XRAY", "BIL": "BILATERAL", "BILAT": "BILATERAL", "W": "WITH", "WO": "WITHOUT", "BX": "BIOPSY"}
EMPTY_DESCRIPTIONS = ["OTHER OUTPATIENT", "OUTPATIENT", "OTHER", "MISC", "MISCELLANEOUS"]
FILLER_WORDS = ["AND", "OF", "OR", "THE", "WITH", "WITHOUT", "FOR", "TO", "IN", "ON", "BY", "A", "AN"]
ATTACHED = {  # a prefix run into a code that is valid for it
    "MS-DRG": r"(?i)^(?:(?:MS-DRG|MSDRG|DRG)|MS-)(\d{1,3})$",
    "APR-DRG": r"(?i)^(?:APR-DRG|APRDRG)(\d{3}(?:-\d|\d)?)$",
    "APC": r"(?i)^APC(\d{3,4}|N\d{3})$",
    "RC": r"(?i)^RC(\d{1,4})$",
    "NDC": r"(?i)^NDC(\d{9,11}|\d{4,5}-\d{3,5}-\d{1,2}(?:[A-Z][A-Z0-9]*|-\d+)?)$",
    "CPT": r"(?i)^CPT(\d{5}|\d{4}[FTU])$",
    "HCPCS": r"(?i)^HCPCS([A-CE-V]\d{4})$",
    "CDT": r"(?i)^CDT(D\d{4})$",
    "CMG": r"(?i)^CMG-(\d{4}(?:-[A-Z])?)$",
}
REMAINDER = {  # what may follow "TYPE " for the split to be believed; other types take anything
    "CDT": r"^[Dd]\d{4}$", "APR-DRG": r"^\d{3}\s*-\s*\d|^\d{3,4}$", "APC": r"^(?:\d{3,4}|[Nn]\d{3})$", "RC": r"^\d{1,4}$", "CMG": r"^\d{4}(-[A-Z])?$",
}
SALVAGE = [  # a sound code inside a malformed one and its type, in the order in which they are tried
    (r"^A(\d{4}T)$", "HCPCS"),
    (r"^A(\d{5})(?:\.\d+)?$", "CPT"),
    (r"^([A-Z]\d{4})\.\d+$", "HCPCS"),
    (r"(?<!\d)(D\d{4})(?!\d)", "CDT"),
    (r"(?<!\d)([A-Z]\d{4})(?!\d)", "HCPCS"),
    (r"(?<![A-Z\d])(\d{5})(?!\d)", "CPT"),
    (r"(?<!\d)(\d{4}[A-Z])(?![A-Z\d])", "CPT"),
]
APR_WITH_SEVERITY = [  # forms of an APR-DRG with base and severity, in the order in which they are tried
    r"^\s*(\d{3})\s*-\s*(\d)",
    r"^\s*(\d{1,3})\.(\d)\s*$",
    r"(?i)^\s*APR(\d{3})\s+SOI\s+(\d)\s*$",
    r"^\s*(\d{3})(\d)\s*$",
    r"^\s*(\d{1,2})-(\d)\s*$",
]
APR_WITHOUT = [r"^\s*(\d{1,2})\s*$", r"^\s*(\d{3})"]
# ------------------------------------------------------------------

CPT5, CPT_CAT, HCPCS2, CDT = r"^\d{5}$", r"^\d{4}[FTUftu]$", r"^[A-CE-Va-ce-v]\d{4}$", r"^[Dd]\d{4}$"


def settled(df: DataFrame, **made: Column) -> DataFrame:
    """df.withColumns(made) behind a generator of one row.

    The optimizer does not push filters, aliases or constraints through generated columns. Through a plain projection it
    would write every earlier stage into each later one, and ten stages multiply. It stays in generated code.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return df.select(*rest, F.inline(F.array(F.struct(*(v.alias(k) for k, v in made.items())))))


def _like(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def _in(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(values), F.lit(False))


def known_type(t: Column) -> Column:
    """The canonical type of a label, null if the label is unknown."""
    labels = F.create_map(*(F.lit(x) for kind, names in TYPE_LABELS.items() for n in names for x in (n, kind)))
    return F.try_element_at(labels, F.coalesce(F.upper(strip(t)), F.lit("")))


def ndc(code: Column) -> Column:
    """struct(code, code_type): an NDC in eleven digits; a value led by a letter is LOCAL; unknown forms stay as they are."""
    s = strip(code)
    base = F.nullif(F.regexp_extract(s, r"(?i)^(\d{10,11})(?:_(?:ip|op)|[A-Z]|_\d+|_\d+_(?:ip|op))$", 1), F.lit(""))
    seg = r"^(\d{4,5})-(\d{3,5})-(\d{1,2})(?:[A-Za-z][A-Za-z0-9]*|-\d+)?$"
    p = [F.regexp_extract(s, seg, k) for k in (1, 2, 3)]
    dashed = F.when(s.rlike(seg) & (F.length(p[1]) <= 4), F.concat(F.lpad(p[0], 5, "0"), F.lpad(p[1], 4, "0"), F.lpad(p[2], 2, "0")))
    digits = F.when(s.rlike(r"^\d{9,11}$"), F.lpad(s, 11, "0"))
    alpha = _like(s, r"^[A-Za-z]")
    out = F.when(alpha | (s == ""), code).otherwise(F.coalesce(digits, F.lpad(base, 11, "0"), dashed, s))
    return F.struct(out.alias("code"), F.when(alpha, "LOCAL").otherwise("NDC").alias("code_type"))


def split_composite(df: DataFrame, code: str = "code", kind: str = "code_type") -> DataFrame:
    """Replaces the columns: 'HCPCS C1776', 'DRG100', 'MS-DRG V41.0 (FY 2024) 155' -> the code and the type in front of it.

    A recognised type of another system in the type column forbids the split; CDM and LOCAL do not.
    """
    s, prefix, rest, system, declared = (F.col(x) for x in ("_p_s", "_p_prefix", "_p_rest", "_p_system", "_p_declared"))
    out = settled(df, _p_s=strip(F.col(code)), _p_declared=known_type(F.col(kind)))
    head = "(?i)^(" + "|".join(p.replace(" ", r"\ ") for p in PREFIXES) + r")\ "
    out = settled(out, _p_prefix=F.nullif(F.upper(F.regexp_extract(s, head, 1)), F.lit("")))
    out = settled(out, _p_rest=strip(F.substring(s, F.length(prefix) + 2, F.length(s))), _p_system=known_type(prefix))
    fits = reduce(lambda a, kv: a & ((system != kv[0]) | rest.rlike(kv[1])), REMAINDER.items(), rest != "")
    drg = F.nullif(F.regexp_extract(rest, r"(\d{1,3})\s*$", 1), F.lit(""))
    part = F.when(system == "MS-DRG", drg).otherwise(rest)
    apart = s.contains(" ") & fits & (declared.isNull() | declared.isin("CDM", "LOCAL") | (declared == system)) & part.isNotNull()
    hits = [F.struct(F.nullif(F.regexp_extract(s, p, 1), F.lit("")).alias("code"), F.lit(k).alias("kind")) for k, p in ATTACHED.items()]
    out = settled(out, _p_part=F.when(apart, part), _p_tight=F.get(F.filter(F.array(*hits), lambda h: h["code"].isNotNull()), F.lit(0)))
    tight_kind = F.col("_p_tight.kind")
    tight = F.coalesce(tight_kind.isNotNull() & (declared.isNull() | declared.isin("CDM", "LOCAL") | (declared == tight_kind)), F.lit(False))
    whole = F.col("_p_part")
    return settled(out, **{
        code: F.when(whole.isNotNull(), whole).when(tight, F.col("_p_tight.code")).otherwise(F.col(code)),
        kind: F.when(whole.isNotNull(), F.when(declared == system, F.col(kind)).otherwise(prefix)).when(tight, tight_kind).otherwise(F.col(kind)),
    }).drop("_p_s", "_p_prefix", "_p_rest", "_p_system", "_p_declared", "_p_part", "_p_tight")


def salvage(raw: Column) -> Column:
    """struct(code, code_type) of a valid code inside a malformed one; nulls if there is none."""
    first = F.regexp_extract(raw, r"(?<!\d)([A-Z]\d{4})(?!\d)", 1)
    code, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, k in reversed(SALVAGE):
        hit = F.nullif(F.regexp_extract(raw, pattern, 1), F.lit(""))
        if k == "CDT":
            hit = F.when(first.startswith("D"), first)  # the first embedded code decides, dental or not
        code, kind = F.coalesce(hit, code), F.when(hit.isNotNull(), F.lit(k)).otherwise(kind)
    return F.struct(code.alias("code"), kind.alias("code_type"))


def apr_drg(code: Column) -> Column:
    """'001-1 Short Stay' -> '001-1'; '48.4' -> '048-4'; 'APR052 SOI 1' -> '052-1'; '0411' -> '041-1'; '48' -> '048'; '139 x' -> '139'."""
    part = lambda p, k: F.regexp_extract(code, p, k)
    hits = [F.when(code.rlike(p), F.concat(F.lpad(part(p, 1), 3, "0"), F.lit("-"), part(p, 2))) for p in APR_WITH_SEVERITY]
    bare = [F.when(code.rlike(p), F.lpad(part(p, 1), 3, "0")) for p in APR_WITHOUT]
    return F.coalesce(*hits, *bare, code)


def normalize(df: DataFrame, code: str = "code", kind: str = "code_type") -> DataFrame:
    """Replaces the two columns by their standard forms."""
    c, t, done = F.col("_c"), F.col("_t"), F.col("_done")
    empty = F.coalesce(F.length(F.col(code)), F.lit(0)) == 0

    def stage(d: DataFrame, *rules: tuple[Column, Column | None, Column | str | None, bool]) -> DataFrame:
        """The first rule that holds changes the code (None: keep), the type (None: keep) and may finish the row.

        Which rule holds is found once, as a number; the changes only look at the number, which keeps generated code small.
        """
        hit = F.lit(0)
        for i, (when, *_) in reversed(list(enumerate(rules, 1))):
            hit = F.when(F.coalesce(when & ~done & c.isNotNull(), F.lit(False)), F.lit(i)).otherwise(hit)
        r, nc, nt, nd = F.col("_r"), c, t, done
        for i, (_, to_code, to_type, ends) in enumerate(rules, 1):
            nc = nc if to_code is None else F.when(r == i, to_code).otherwise(nc)
            nt = nt if to_type is None else F.when(r == i, F.lit(to_type) if isinstance(to_type, str) else to_type).otherwise(nt)
            nd = nd if not ends else F.when(r == i, F.lit(True)).otherwise(nd)
        return settled(settled(d, _r=hit), _c=nc, _t=nt, _done=nd)

    ascii_code = F.regexp_replace(F.col(code), r"[^\x00-\x7F]", "")
    was = F.col(code)
    out = df.withColumn("_c", F.when(~empty, F.when(was.rlike(r"[^\x00-\x7F]"), strip(ascii_code)).otherwise(was)))
    out = out.withColumn("_done", F.coalesce(F.col("_c") == "", F.lit(False)) | empty)
    out = out.withColumn("_k", F.col(kind)).withColumn("_x", c)
    out = split_composite(out, "_x", "_k")
    out = out.withColumns({"_c": F.when(done, c).otherwise(F.col("_x")), "_k": F.when(done, F.col(kind)).otherwise(F.col("_k"))}).drop("_x")
    out = settled(out, _t=F.when(F.coalesce(F.length("_k"), F.lit(0)) > 0, F.coalesce(known_type(F.col("_k")), F.upper(strip(F.col("_k"))))))
    s = strip(c)
    ndc_shape = s.rlike(r"^\d{9,11}$|^\d{4,5}-\d{3,4}-\d{1,2}$")
    both = _in(t, ["NDCHCPCS", "NDCCPT"])
    out = stage(
        out,
        (both & ndc_shape, None, "NDC", False),
        (both & s.rlike(HCPCS2), None, "HCPCS", False),
        (both & (s.rlike(CPT5) | s.rlike(CPT_CAT)), None, "CPT", False),
        (both, None, "LOCAL", False),
        (_in(t, NO_TYPE), None, F.lit(None).cast("string"), False),
        (_in(t, list(CONTROLLED)) & s.rlike(r"\.0+$"), F.regexp_replace(s, r"\.0+$", ""), None, False),
    )
    out = stage(out, (s.rlike("^(?:SUP-|PX-|RX-)"), s, "CDM", True))
    revenue = [x for n in REVENUE_CODES for x in (str(n), f"0{n}")]
    out = stage(
        out,
        ((t.isNull() | (t == "HCPCS")) & s.isin(revenue), None, "RC", False),
        (_in(t, ["CPT", "HCPCS"]) & s.rlike(r"^\d{6,}$"), None, "CDM", False),
        (_in(t, ["CDM", "LOCAL"]) & s.rlike(CDT), None, "CDT", False),
        (_in(t, ["CDM", "LOCAL"]) & s.rlike(HCPCS2), None, "HCPCS", False),
        (_in(t, ["CDM", "LOCAL"]) & (s.rlike(CPT5) | s.rlike(CPT_CAT)), None, "CPT", False),
    )
    out = stage(
        out,
        ((t == "HCPCS") & s.rlike(CPT5), None, "CPT", False),
        (_in(t, ["HCPCS", "CPT"]) & s.rlike(CDT), None, "CDT", False),
        ((t == "CPT") & s.rlike(HCPCS2), None, "HCPCS", False),
        ((t.isNull() | (t == "HCPCS")) & s.rlike(CPT_CAT), None, "CPT", False),
    )
    none = t.isNull() | (t == "")
    invalid = reduce(lambda a, kv: a | ((t == kv[0]) & ~s.rlike(f"^(?:{kv[1]})$")), CONTROLLED.items(), F.lit(False))
    out = stage(
        out,
        (invalid & (s.rlike(CPT5) | s.rlike(CPT_CAT)), None, "CPT", False),
        (invalid & s.rlike(HCPCS2), None, "HCPCS", False),
        (invalid & s.rlike(CDT), None, "CDT", False),
        (none & s.rlike(r"^\d{4,5}-\d{3,4}-\d{1,2}$"), None, "NDC", False),
    )
    out = settled(out, _n=F.when(t == "NDC", ndc(c)))
    out = stage(out, ((t == "RC") & s.rlike(r"^\d+$"), F.when(F.length(s) < 4, F.lpad(s, 4, "0")).otherwise(s), None, True), (t == "NDC", F.col("_n.code"), F.col("_n.code_type"), True))
    out = stage(
        out,
        (none & s.rlike(CDT), None, "CDT", False),
        (none & s.rlike(r"^[A-Za-z]\d{4}$"), None, "HCPCS", False),
        (none & (s.rlike(CPT5) | s.rlike(CPT_CAT)), None, "CPT", False),
    )
    bad = _in(t, ["CPT", "HCPCS"]) & ~F.upper(s).rlike(r"^(?:\d{5}|\d{4}[A-Z]|[A-Z]\d{4})$")
    out = settled(out, _f=F.when(bad & ~done, salvage(F.upper(s))))
    out = stage(out, (F.col("_f.code").isNotNull(), F.col("_f.code"), F.col("_f.code_type"), False), (bad, None, "LOCAL", False))
    placeholder = s.rlike(r"(?i)^(?:X{3,}|TEST\b|N/?A$|NONE$|TBD$|UNKNOWN$)") & ~_in(t, ["RC", "NDC", "CDM", "MS-DRG", "APC"])
    out = stage(out, (placeholder, None, "LOCAL", False))
    out = stage(out, (t == "APR-DRG", strip(apr_drg(c)), None, False), (F.lit(True), s, None, False))
    out = stage(out, (invalid & s.rlike(r"^[\d-]+$"), None, "LOCAL", False))
    kind_out = F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.when(empty, t).otherwise(F.col(kind))).otherwise(t)
    done_out = settled(out, **{kind: kind_out, code: F.when(empty, F.col(code)).otherwise(c)})
    return done_out.select(*(F.col(f"`{x}`") for x in df.columns)).drop("_c", "_t", "_done", "_k", "_r", "_n", "_f")


def rejection(code: Column, kind: Column) -> Column:
    """Why a pair is too corrupt to keep; null if it may stay."""
    t = F.nullif(strip(kind), F.lit(""))
    up = F.upper(t)
    shaped = up.rlike(r"^[A-Z][A-Z0-9]*(?:[-/][A-Z0-9]+)*$") & (F.length(t) <= 16)
    return F.coalesce(
        F.when(t.rlike(r"^\d+$"), "numeric_code_type"),
        F.when(up.rlike(r"^[A-Z]\d{4}$") | ~shaped, "malformed_code_type"),
        F.when((F.upper(kind) == "MS-DRG") & strip(code).rlike(r"^\d+\.\d+$"), "ms_drg_decimal"),
    )


def baked_modifier(code: Column, kind: Column, modifiers: list[str] | None = None) -> Column:
    """struct(code, code_type, modifier): '73721TC' under CDM, LOCAL or no type -> 73721, CPT, TC."""
    known = "|".join(modifiers or LETTER_MODIFIERS)
    pattern = rf"^(\d{{5}}|[A-CE-V]\d{{4}})({known})$"
    hit = F.coalesce((kind.isNull() | kind.isin("CDM", "LOCAL")) & code.rlike(pattern), F.lit(False))
    head = F.regexp_extract(code, pattern, 1)
    return F.struct(
        F.when(hit, head).otherwise(code).alias("code"),
        F.when(hit, F.when(head.rlike(r"^\d"), "CPT").otherwise("HCPCS")).otherwise(kind).alias("code_type"),
        F.when(hit, F.regexp_extract(code, pattern, 2)).alias("modifier"),
    )


def description_words(c: Column) -> Column:
    """Distinct words of a description, short forms written out, without fillers and single letters."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"\bX-RAYS?\b", "XRAY"), r"[^A-Z0-9]+", " "))
    full = F.create_map(*(F.lit(x) for kv in SHORT_WORDS.items() for x in kv))
    words = F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(full, w), w))
    said = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(FILLER_WORDS))
    return F.when((text != "") & ~text.isin(EMPTY_DESCRIPTIONS), F.array_distinct(said))


def descriptions_match(row: Column, reference: Column) -> Column:
    """At least half of the reference's words are in the row's, one of them of four letters or more; false for nulls."""
    ours, theirs = description_words(row), description_words(reference)
    shared = F.array_intersect(theirs, ours)
    return F.coalesce((F.size(theirs) > 0) & (F.size(shared) * 2 >= F.size(theirs)) & F.exists(shared, lambda w: F.length(w) >= 4), F.lit(False))


def split_modifiers(df: DataFrame, validity: DataFrame | None = None, descriptions: DataFrame | None = None, published: DataFrame | None = None) -> DataFrame:
    """Replaces code and code_type and adds `baked`: modifiers run into codes under CDM, LOCAL or no type.

    Letter suffixes split on shape; published(code_type, code) restricts them to known codes. Digit suffixes split only where
    validity(code, modifier) allows the pair and, if descriptions(code, description) are given, the row's description
    fits the code's. The three are joined on equal keys; their size decides how.
    """
    shape = rf"^(\d{{5}}|[A-CE-V]\d{{4}})({'|'.join([*LETTER_MODIFIERS, *DIGIT_MODIFIERS])})$"
    may = F.coalesce((F.col("code_type").isNull() | F.col("code_type").isin("CDM", "LOCAL")) & F.col("code").rlike(shape), F.lit(False))
    d = settled(df, _h=F.when(may, F.regexp_extract("code", shape, 1)), _m=F.when(may, F.regexp_extract("code", shape, 2)))
    d = d.withColumn("_to", F.when(F.col("_h").rlike(r"^\d"), "CPT").otherwise("HCPCS"))
    digit, ok = F.col("_m").isin(DIGIT_MODIFIERS), F.col("_h").isNotNull()
    if published is not None:
        p = published.select(F.col("code_type").alias("_to"), F.col("code").alias("_h")).distinct().withColumn("_known", F.lit(True))
        d, ok = d.join(p, ["_to", "_h"], "left"), ok & F.col("_known").isNotNull()
    if validity is None:
        ok = ok & ~digit
    else:
        v = validity.select(F.col("code").alias("_h"), F.col("modifier").alias("_m")).distinct().withColumn("_valid", F.lit(True))
        d, ok = d.join(v, ["_h", "_m"], "left"), ok & (~digit | F.col("_valid").isNotNull())
    if descriptions is not None:
        t = descriptions.groupBy(F.col("code").alias("_h")).agg(F.min("description").alias("_text"))
        d = d.join(t, "_h", "left")
        ok = ok & (~digit | descriptions_match(F.col("description"), F.col("_text")))
    ok = F.coalesce(ok, F.lit(False))
    out = settled(d, code=F.when(ok, F.col("_h")).otherwise(F.col("code")), code_type=F.when(ok, F.col("_to")).otherwise(F.col("code_type")), baked=F.when(ok, F.col("_m")))
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c != "baked"), "baked")


def billing_class(code: Column, kind: Column, description: Column, given: Column) -> Column:
    """struct(billing_class, code, code_type): inferred only where none is given."""
    none = F.coalesce(given, F.lit("")) == ""
    a = none & (kind.isNull() | kind.isin("CPT", "HCPCS"))
    cpt, cat3 = F.coalesce(a & code.rlike(r"^A\d{5}$"), F.lit(False)), F.coalesce(a & code.rlike(r"^A\d{4}T$"), F.lit(False))
    cut = F.substring(code, F.lit(2), F.length(code))
    infer = F.when(cpt | cat3, "facility").when(description.startswith("PR "), "professional").when(kind == "RC", "facility").when(description.startswith("HC "), "facility")
    return F.struct(
        F.when(none, infer).otherwise(given).alias("billing_class"),
        F.when(cpt | cat3, cut).otherwise(code).alias("code"),
        F.when(cpt, "CPT").when(cat3, "HCPCS").otherwise(kind).alias("code_type"),
    )


def extract_part(code: Column, kind: Column, pattern: str, separator: str = "-", position: int = 3, fallback: int = 1) -> Column:
    """struct(code, code_type): the standard code at a position of a composite one, else another part as CDM."""
    s = strip(code)
    parts = F.split(s, rf"\Q{separator}\E", -1)
    at = lambda k: F.nullif(F.get(parts, F.lit(k)), F.lit(""))
    hit = _like(s, pattern)
    return F.struct(
        F.when(hit, F.coalesce(at(position), at(fallback), code)).otherwise(code).alias("code"),
        F.when(hit & at(position).isNotNull(), F.lit(None).cast("string")).when(hit & at(fallback).isNotNull(), F.lit("CDM")).otherwise(kind).alias("code_type"),
    )
