"""Queries of the language problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import address, canonical, contamination, encoding, mixing, names, subjects


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = encoding.found(table(spark, sf_dir, "charge_items"), "item_id", "description", "charge_items")
    rates = encoding.found(table(spark, sf_dir, "payer_rates"), "rate_id", "raw_payer_name", "payer_rates")
    return items.unionByName(rates)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_restored(spark, sf_dir).select("table_name", "row_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["plan_name", "plan_category", "methodology_type"]
    found = canonical.assign(table(spark, sf_dir, "payer_rates"), "rate_id", fields, table(spark, sf_dir, "canonical_values"))
    return found.selectExpr("row_id as rate_id", "field_name", "entry_id")


def p7_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The location of every record: one row per record with the id of its class, its unit, open candidates and number of links."""
    return address.with_units(address.locate(table(spark, sf_dir, "file_metadata")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address.pairs(address.locate(table(spark, sf_dir, "file_metadata")))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct text with the id of its payer and the number of other texts that name it."""
    resolved = entities(spark, sf_dir)
    return resolved.join(resolved.groupBy("entity").agg((F.count("*") - 1).alias("links")), "entity").select("name", "entity", "links")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.resolve(table(spark, sf_dir, "payer_rates").select("raw_payer_name", "payer_name"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(entities(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with their share of each document's sentences."""
    return subjects.classify(*(table(spark, sf_dir, t) for t in ("documents", "subjects", "subject_labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_shares(spark, sf_dir).select("doc_id", "subject")


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_shares": p10_shares, "p8_found": p8_found, "p1_found": p1_found, "p1_entities": p1_entities, "p7_found": p7_found, "p7_locations": p7_locations, "p6_found": p6_found, "p3_found": p3_found, "p3_restored": p3_restored}
ORACLES: dict[str, str] = {}
