"""Parts of files (source "mrf") -> all output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..session import cut
from . import nested, tables, tic


def flat_items(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat JSON items as (heads, rows): the first item's keys are the header of its file."""
    items = parts.filter("kind = 'item'").withColumn("m", F.from_json("raw", "map<string,string>")).filter("m is not null")
    first = items.groupBy("file_id").agg(F.min_by("raw", "ord").alias("raw"))
    flat = first.filter(~F.col("raw").contains('"standard_charges"') & ~F.col("raw").contains('"code_information"'))
    heads = flat.select("file_id", F.json_object_keys("raw").alias("cells"))
    rows = items.join(heads.withColumnRenamed("cells", "keys"), "file_id").select("file_id", "ord", F.transform("keys", lambda k: F.col("m")[k]).alias("cells"))
    return heads, rows


def all_tables(parts: DataFrame, dictionary: DataFrame | None = None, overrides: dict[str, str] | None = None, extra: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Every table of every file. parts: file_id, kind, ord, cells, raw, materialized by the caller (each table reads them)."""
    flat_heads, flat_rows = flat_items(parts)
    csv_heads = parts.filter("kind = 'header'").select("file_id", "cells")
    csv_rows = parts.filter("kind = 'row'").select("file_id", "ord", "cells")
    rows = csv_rows.unionByName(flat_rows)
    firsts = rows.groupBy("file_id").agg(F.min("ord").alias("_at"))
    peek = rows.join(firsts, "file_id").filter(F.col("ord") < F.col("_at") + tables.PEEK).select("file_id", "cells")
    cols = cut(tables.columns(csv_heads.unionByName(flat_heads), peek, overrides, extra))
    parsed = cut(tables.parse(rows, cut(tables.plan(cols))))
    out = tables.tables(parsed, dictionary)
    cms = nested.tables(parts, dictionary)
    for name, t in cms.items():
        if name in out:
            same = [c for c in out[name].columns if c in t.columns]
            out[name] = out[name].select(*same).unionByName(t.select(*same))
        else:
            out[name] = t
    out["header_mappings"] = cols.select("file_id", "pos", "source_header", "normalized", "mapped_to").unionByName(nested.header_mappings(parts))
    out["file_metadata"] = csv_metadata(parts).unionByName(nested.metadata(parts), allowMissingColumns=True)
    out["rejected_codes"] = parsed.filter("reason is not null").select("file_id", "ord", "code", "code_type", "reason")
    return out | tic.tables(parts)


def csv_metadata(parts: DataFrame) -> DataFrame:
    """file_metadata of the lines above the header."""
    pairs = parts.filter("kind = 'meta'").select("file_id", F.trim(F.col("cells")[0]).alias("k"), F.regexp_replace(values.strip(F.col("cells")[1]), '^"(.*)"$', "$1").alias("v"))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.nullif(F.trim("v"), F.lit(""))))
    names = ["hospital_name", "hospital_location", "hospital_address", "last_updated_on", "version", "ein", "attestation", "attester_name"]
    licence = F.lower("k").startswith("license_number")
    state = F.upper(F.trim(F.get(F.split("k", r"\|"), F.lit(1))))
    out = pairs.groupBy("file_id").agg(
        *(pick(n).alias(n) for n in names), pick("CMS Certification Number").alias("cms_certification_number"),
        F.max(F.when(licence, F.nullif(F.trim(F.split("v", r"\|")[0]), F.lit("")))).alias("license_number"), F.max(F.when(licence & state.rlike("^[A-Z]{2}$"), state)).alias("license_state"),
        F.max(F.when(F.col("k") == "type_2_npi", values.first_npi(F.col("v")))).alias("type_2_npi"),
    )
    return out.withColumn("confirm_attestation", F.lit(None).cast("boolean"))


def quality(parts: DataFrame, rejected: DataFrame) -> DataFrame:
    """(file_id, counter, key, n): what was read, skipped and refused, file by file."""
    read = parts.groupBy("file_id", F.when(F.col("kind").isin("row", "item", "in_network", "structure"), "read").when(F.col("kind").startswith("bad_"), "skipped").alias("counter"), F.col("kind").alias("key")).agg(F.count("*").alias("n")).filter("counter is not null")
    bad = rejected.groupBy("file_id", F.lit("rejected_codes").alias("counter"), F.col("reason").alias("key")).agg(F.count("*").alias("n"))
    skipped = tic.faults(parts.filter("kind = 'in_network'")).select("file_id", F.lit("skipped_prices").alias("counter"), F.col("fault").alias("key"), "n")
    long = parts.filter("kind = 'long_root'").groupBy("file_id", F.lit("skipped").alias("counter"), F.col("cells")[0].alias("key")).agg(F.count("*").alias("n"))
    read = read.unionByName(skipped).unionByName(long)
    errors = parts.filter("kind = 'file' and raw is not null").select("file_id", F.lit("file_error").alias("counter"), F.col("raw").alias("key"), F.lit(1).cast("long").alias("n"))
    return read.unionByName(bad).unionByName(errors)
