"""Queries of the general data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import badrows, drift, packed
from ..session import table


def p2_values(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """Every value of the three packed fields, with position and flag."""
    fields = (("charge_items", "item_id", "modifiers"), ("file_metadata", "meta_id", "type_2_npi"), ("tic_rates", "tic_rate_id", "provider_group_ids"))
    out = None
    for name, row_id, field in fields:
        part = packed.unpack(table(spark, sf_dir, name), row_id, field, name, least)
        out = part if out is None else out.unionByName(part)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_values(spark, sf_dir, least=2).select("table_name", "row_id", "pos", "val")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "file_metadata").select("file_id", "hospital_id", "file_seq")
    return drift.changes(table(spark, sf_dir, "header_mappings"), files)


def p4_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "file_metadata").select("file_id", "hospital_id", "file_seq")
    return drift.unified(table(spark, sf_dir, "header_mappings"), files)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = badrows.judge_lines(table(spark, sf_dir, "raw_rows"), suspects=True)
    items = badrows.judge_codes(table(spark, sf_dir, "charge_items").select("item_id", "code", "code_type"), suspects=True)
    cells = badrows.judge_values(table(spark, sf_dir, "unmapped_cells").select("cell_id", "source_column", "value"), suspects=True)
    return (
        badrows.broken(items, "charge_items", "item_id")
        .unionByName(badrows.broken(cells, "unmapped_cells", "cell_id"))
        .unionByName(badrows.broken(lines, "raw_rows", "row_id"))
    )


def p5_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines that load, one column per cell."""
    rows = badrows.sound(badrows.judge_lines(table(spark, sf_dir, "raw_rows")))
    names = ("code", "code_type", "description", "setting", "gross_charge", "discounted_cash", "note")
    from pyspark.sql import functions as F

    return rows.select("row_id", "file_id", *(F.nullif(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)))


QUERIES = {"p2_found": p2_found, "p2_values": p2_values, "p4_found": p4_found, "p4_columns": p4_columns, "p5_found": p5_found, "p5_sound": p5_sound}
ORACLES: dict[str, str] = {}
