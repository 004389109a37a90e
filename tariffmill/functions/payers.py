"""Payer names as Column expressions: self-pay, lookup keys, canonical names from a dictionary.

The dictionary (raw spelling -> canonical name) is a parameter, a DataFrame (key, canonical); no list of payers is built in.
Names are resolved on distinct values and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .values import strip, title_case

# Names that stand for the cash price, names that name nobody, endings of companies.
SELF_PAY = [
    "SELF PAY", "SELF-PAY", "SELFPAY", "SELF PAYSELF-PAY", "CASH", "CASH PAY", "CASH PRICE", "CASH PRICE ESTIMATE", "CASH DISCOUNT", "PATIENT", "PATIENT PAY",
    "UNINSURED", "UNINSURED/SELF-PAY", "SELF-PAY/UNINSURED", "NO INSURANCE", "SELF", "GROSS CHARGES", "GROSS CHARGE", "CDM DEFAULT", "CDM", "CHARGE MASTER",
    "CHARGEMASTER", "SELF PAY/UNINSURED DISCOUNT",
]
SELF_PAY_WORDS = r"SELF PAY|SELF-PAY|SELFPAY|UNINSURED"
ENTITIES = {"&amp;": "&", "&#39;": "'", "&apos;": "'", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&nbsp;": " "}
NOBODY = ["#N/A", "N/A", "GENERIC COMMERCIAL/INDEMNITY", "GENERIC COMMERCIAL", "GENERIC HMO", "GENERIC PPO", "MEDICARE ADV GENERIC", "MEDI-CAL"]
SITE_PREFIXES = ["SHCA COMM", "HILLS", "PSYCH", "JMPN", "NODE", "MC GENERIC", "TUH", "JNS", "CHH", "FCOD", "NACC", "JUP", "STOD", "PAYER", "PRO"]
NUMBERED_NAMES = ["IMAGINE 360", "ADVANTAGE 360", "PLAN 80", "PLAN 65", "PLAN 1000"]
PLAN_ENDINGS = [
    " MEDICARE ADVANTAGE", " MEDICARE ADV", " MEDICARE A/B REBILL", " MCR ADV - ALL PLANS", " MCR ADV - ALL OTHER PLANS", " MCR ADV", " COMM - ALL OTHER PLANS",
    " PPO/HPN - ALL OTHER PLANS", " PPO/HMO-ALL OTHER PLANS", " PPO-ALL OTHER PLANS", " PPO - ALL OTHER PLANS", " HMO-ALL OTHER PLANS", " HMO - ALL OTHER PLANS",
    "-ALL OTHER PLANS", "-ALL PLANS", " - ALL OTHER PLANS", " - ALL PLANS", " ALTERNATE PAYER", " ALTERNATE PAYOR", " ALT PAYOR", " ALT PAYER", "-NETWORK MCARE", "-NETWORK",
    " NETWORK SELECT", " DOCTORS PLAN PPO/EP", " DOCTORS PLAN", " SELECT/NAVIGATE/CORE", " TAILORED NETWORK", " ENHANCEDCARE", " CHOICE CARE", " FEDERAL EMPLOYEES", " NEW BUS OAP",
    " MCARE", " MEDICARE", " HMO/IFP", " HMO/PPO", " HMO/POS", " PPO/EPO", " HMO", " PPO", " EPPO", " EPO", " POS", " INDEMNITY", " LIFE", " MEDI-CAL", " MEDICAID MANAGED CARE",
    " MEDICAID", " MCAL", " MCD", " MCR", " COMMERCIAL",
]
# ------------------------------------------------------------------


def unescape(c: Column) -> Column:
    for name, sign in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def unwrap(c: Column) -> Column:
    """Without entities, quotes, brackets around the whole, underscores, repeated blanks."""
    s = F.regexp_replace(strip(unescape(c)), r"""^["'“”‘’`]+|["'“”‘’`]+$""", "")
    s = F.regexp_replace(strip(s), r"^<(.*)>$|^\[(.*)\]$|^\((.*)\)$", "$1$2$3")
    return strip(F.regexp_replace(F.replace(s, F.lit("_"), F.lit(" ")), r"(?U)\s+", " "))


def payer_key(c: Column) -> Column:
    return F.upper(unwrap(c))


def is_self_pay(c: Column) -> Column:
    key = F.regexp_replace(payer_key(c), r"^\d+(?:\.\d+)?\s*%\s*(?:-\s*)?", "")
    return F.coalesce((strip(c) != "") & (key.isin(SELF_PAY) | key.rlike(SELF_PAY_WORDS)), F.lit(False))


def match_key(c: Column) -> Column:
    """Upper-case words without signs and plural s: spellings that differ in nothing else share it."""
    words = F.split(F.trim(F.regexp_replace(F.lower(unescape(c)), r"[^a-z0-9]+", " ")), " ")
    one = lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.coalesce(F.upper(F.array_join(F.transform(words, one), " ")), F.lit(""))


def names_nobody(c: Column) -> Column:
    """Numbers, amounts, signs and blanks are no payer."""
    return F.coalesce(unwrap(c).rlike(r"^[\s$%.,0-9/_-]*$"), F.lit(True))


def core_name(c: Column) -> Column:
    """The name without a leading percentage, site codes, dates, ids and contract status."""
    s = F.regexp_replace(unwrap(c), r"^\d+(?:\.\d+)?\s*%\s*(?:-\s*)?", "")
    s = F.regexp_replace(s, r"(?i)\s+\d{8}(?:\s+\(.*?\))?\s*$", "")
    bare = F.regexp_replace(F.regexp_replace(s, r"(?:,\s*\S+\s+\d{3,5})+$", ""), r"\s+\d{2,5}$", "")
    s = F.when(F.upper(s).isin(NUMBERED_NAMES) | F.upper(s).contains("LOCAL "), s).otherwise(bare)
    s = F.regexp_replace(s, "(?i)^(?:" + "|".join(SITE_PREFIXES) + ") (?=.)", "")
    return strip(F.regexp_replace(F.regexp_replace(s, r"(?i)^WC\s+(?=.)", ""), r"(?i)(?<=.)\s+(?:NON[-\s]?CONTRACT(?:ED)?|CONTRACTED)$", ""))


def plan_ending(name: Column) -> Column:
    """The plan that a payer's name ends in, null without one or if nothing else would be left."""
    ends = "|".join(p.replace("/", r"\/").replace("-", r"\-") for p in sorted(PLAN_ENDINGS, key=len, reverse=True))
    return F.nullif(F.regexp_extract(name, rf"(?i)^.*?[^\s-]({ends})$", 1), F.lit(""))


def resolve(names: DataFrame, column: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Adds payer_name and plan_hint (the plan that the name ends in). payer_name: the canonical name of the longest run of leading words found in the dictionary, else the name in
    title case, one spelling per match key; null for self-pay and names of nobody.

    names may repeat: each distinct name is looked up once. The dictionary is joined on equal keys (its size decides how).
    """
    distinct = names.select(F.col(column).alias("_raw")).filter("_raw is not null").distinct()
    todo = distinct.withColumn("_core", core_name(F.col("_raw"))).withColumn("_end", plan_ending(F.col("_core")))
    todo = todo.withColumn("_name", strip(F.regexp_replace(F.substring("_core", F.lit(1), F.length("_core") - F.coalesce(F.length("_end"), F.lit(0))), r"[\s-]+$", "")))
    todo = todo.withColumn("_key", F.regexp_replace(F.upper("_core"), r",?\s*(?:INC|LLC|LP|CO)\.?$", ""))
    nobody = names_nobody(F.col("_core")) | F.upper("_core").isin(NOBODY)
    todo = todo.withColumn("_ok", ~nobody & ~is_self_pay(F.col("_raw")))
    hint = F.when(payer_key(F.col("_raw")).rlike(r"^WC\s+."), "Workers Comp").otherwise(F.regexp_replace(strip(F.col("_end")), r"^[\s-]+", ""))
    todo = cut(todo.withColumn("_hint", hint))  # distinct names, read by each step below
    if dictionary is not None:
        words = F.split("_key", " ")
        runs = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, F.lit(1), n), " ").alias("k")))
        probe = todo.filter("_ok").select("_raw", F.inline(runs))
        hits = probe.join(dictionary.select(payer_key(F.col("key")).alias("k"), "canonical"), "k")
        found = hits.groupBy("_raw").agg(F.max_by("canonical", "n").alias("_canonical"))
        todo = todo.join(found, "_raw", "left")
    else:
        todo = todo.withColumn("_canonical", F.lit(None).cast("string"))
    free = todo.withColumns({"_title": title_case(F.col("_name")), "_match": match_key(F.col("_name"))})
    one = free.filter("_ok and _canonical is null").groupBy("_match").agg(F.min("_title").alias("_one"))
    named = free.join(one, "_match", "left").select("_raw", F.when(F.col("_ok"), F.coalesce("_canonical", "_one")).alias("payer_name"), F.when(F.col("_ok"), F.col("_hint")).alias("plan_hint"))
    return names.join(named, F.col(column).eqNullSafe(F.col("_raw")), "left").drop("_raw")


# Labels of plans by ordered patterns on the upper-case name (the first that matches wins), and what each label means.
PLAN_SHORT = {
    "Medicare Advantage": ["MCR", "MCRPOS", "MCRSNP", "MGMCR", "PFFS", "DSNP", "SNP", "CSNP", "ISNP", "MMP", "MAPD"],
    "Medi-Cal": ["MCD"],
    "Medi-Cal Managed Care": ["MGMCD"],
    "Workers Comp": ["WC", "WCOMP"],
    "Medicaid": ["CHIP", "SCHIP"],
    "Commercial": ["COM", "COMM", "IFP", "ASO", "COCM"],
    "Marketplace": ["QHP"],
    "Government": ["FEP", "FEHB", "GEHA", "CHAMPVA"],
    "Behavioral Health": ["COMMBH"],
}
RUN_TOGETHER = [  # parts of names written in one word
    (r"WC$", "Workers Comp"), (r"MGDMCAID|MGDMCAL|MCAID", "Medi-Cal Managed Care"), (r"MCAL", "Medi-Cal"), (r"HIX|EXCHANGE", "Marketplace"), (r"MEDICARE|MCARE", "Medicare Advantage"),
    (r"BEHAVIORAL", "Behavioral Health"), (r"INDEMNITY", "Commercial Indemnity"), (r"RECIPROCITY|ANCILLARY|GATEKEEPER|SELECT|NONMCS|MEDICAL", "Commercial"),
]
PLAN_RULES = [
    (r"WORKER'?S?[_ ]?COMP|^WORK COMP$", "Workers Comp"),
    (r"\bTRICARE\b", "TRICARE"),
    (r"CHAMP ?VA", "Government"),
    (r"\bVACCN\b|VA COMMUNITY CARE", "TRICARE"),
    (r"MEDI[- ]CAL|^MEDICAL$|MANAGED MEDI|\bMEDICAID\b", "Medi-Cal"),
    (r"\bS?CHIP\b|CHILD HEALTH PLUS|KIDCARE|\bSTAR\s*(?:\+?\s*PLUS|KIDS?|HEALTH)\b|MASSHEALTH|ESSENTIAL PLAN|\bESSENTIAL\s+P[QA]\b", "Medicaid"),
    (r"CONNECTOR ?CARE|FAMILY CHOICE|COMMUNITY PLAN|WELLSENSE|(?=.*BETTER HEALTH)(?=.*HEALTHY)|HEALTHY KID", "Medicaid"),
    (r"MCALMC", "Medi-Cal Managed Care"),
    (r"^GOVERNMENT|FEDERAL EMPLOYEE|^FEHB$|^FEP$|\bGEHA\b", "Government"),
    (r"PACE", "Medicare PACE"),
    (r"^(?=.*MEDICARE ADV)(?=.*PPO)(?!.*HMO)", "Medicare Advantage PPO"),
    (r"^(?=.*MEDICARE ADV)(?=.*HMO)(?!.*PPO)", "Medicare Advantage HMO"),
    (r"MEDICARE|MCR ADV|D-SNP|DUALELIGIBLE|\b(?:DUAL|SNP|CSNP|ISNP|MMP|MAPD)\b", "Medicare Advantage"),
    (r"\b(?:HIX|AMBETTER|MARKETPLACE|QHP)\b|EXCHANGE", "Marketplace"),
    (r"COVERED CA", "Covered California"),
    (r"TRANSPLANT|DONOR NETWORK", "Transplant"),
    (r"^EMPLOYEE", "Employee"),
    (r"BEHAVIORAL|\bEAP\b", "Behavioral Health"),
    (r"^(?=.*COMMERCIAL)(?=.*INDEMNITY)(?!.*(?:(?<!NON-)HMO|PPO|\bEPO\b|POS))", "Commercial Indemnity"),
    (r"^(?=.*COMMERCIAL)(?=.*(?:PPO|\bEPO\b))(?!.*(?<!NON-)HMO)", "Commercial PPO"),
    (r"^(?=.*COMMERCIAL)(?=.*(?<!NON-)HMO)(?!.*PPO)", "Commercial HMO"),
    (r"^(?=.*COMMERCIAL)(?=.*POS)(?!.*HMO)", "Commercial POS"),
    (r"COMMERCIAL|^HMO ?/ ?PPO$", "Commercial"),
    (r"^HMO$", "Commercial HMO"),
    (r"^(?:PPO|PPO/EPO|EPO)$", "Commercial PPO"),
    (r"^(?:POS|HMO ?/ ?POS)$", "Commercial POS"),
    (r"^INDEMNITY$", "Commercial Indemnity"),
    (r"^INDIVIDUAL$|\bALL\s+PRODUCTS?\b|\bSELF[- ]?FUNDED\b|\bASO\b|FULLY INSURED|^IFP$|\bINDIVIDUAL\s*/?\s*FAMILY\b|\b(?:SMALL|LARGE)\s*GROUP\b|^SMALLGROUP$|^MANAGED CARE$|NON-HMO", "Commercial"),
    (r"PPO|\bEPO\b", "Commercial PPO"),
    (r"(?<!NON-)HMO", "Commercial HMO"),
    (r"\bINDEMNITY\b", "Commercial Indemnity"),
    (r"SELECT/NAVIGATE|OAP", "Commercial"),
    (r"^TRIM?$", "TRICARE"),
    (r"^VETERANS(?: AFFAIRS)?$|VETERANS ADMIN", "Government"),
    (r"ALL\s*(?:OTHER\s*)?PLANS|COMM$|COMM ", "Commercial"),
    (r"HEALTHY FAMIL", "Medicaid"),
]
PLAN_MEANS = {
    "Commercial": ("Commercial", None), "Commercial HMO": ("Commercial", "HMO"), "Commercial PPO": ("Commercial", "PPO"), "Commercial POS": ("Commercial", "POS"),
    "Commercial EPO": ("Commercial", "EPO"), "Commercial Indemnity": ("Commercial", "Indemnity"), "Medicare": ("Medicare", None), "Medicare Advantage": ("Medicare", None),
    "Medicare Advantage HMO": ("Medicare", "HMO"), "Medicare Advantage PPO": ("Medicare", "PPO"), "Medicare PACE": ("Medicare", None), "Medicaid": ("Medicaid", None),
    "Medi-Cal": ("Medicaid", None), "Medi-Cal Managed Care": ("Medicaid", "Managed Care"), "TRICARE": ("TRICARE", None), "Workers Comp": ("Workers Comp", None),
    "Government": ("Government", None), "Behavioral Health": ("Behavioral Health", None), "Transplant": ("Transplant", None), "Employee": ("Employee", None),
    "Marketplace": ("Commercial", None), "Covered California": ("Commercial", None), "Other": ("Other", None),
}
# ------------------------------------------------------------------


def plan_class(c: Column, payer: Column | None = None) -> Column:
    """struct(plan_category, plan_network, plan_name): the plan's label by the rules, else its own name in title case.

    A blank plan is ('Other', null, 'Other'); a plan that only repeats its payer is Commercial.
    """
    name = unwrap(c)
    up = F.upper(name)
    rules = [*((f"^(?:{'|'.join(w)})$", label) for label, w in PLAN_SHORT.items()), *PLAN_RULES]
    hits = F.filter(F.array(*(F.when(up.rlike(p), F.lit(label)) for p, label in rules)), lambda x: x.isNotNull())
    joined = F.filter(F.array(*(F.when(up.rlike(p), F.lit(label)) for p, label in RUN_TOGETHER)), lambda x: x.isNotNull())
    one_word = F.when(~up.contains(" ") & (F.length(up) > 6), F.get(joined, F.lit(0)))
    same = F.when(up == F.upper(payer), F.lit("Commercial")) if payer is not None else F.lit(None).cast("string")
    blank = F.coalesce(name, F.lit("")) == ""
    label = F.when(blank, "Other").otherwise(F.coalesce(F.get(hits, F.lit(0)), same, one_word, title_case(strip(c))))
    means = lambda k: F.try_element_at(F.create_map(*(F.lit(x) for n, v in PLAN_MEANS.items() if v[k] for x in (n, v[k]))), label)
    return F.struct(F.coalesce(means(0), F.lit("Other")).alias("plan_category"), means(1).alias("plan_network"), label.alias("plan_name"))
