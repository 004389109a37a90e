"""python -m tariffmill OUT FILE...: files -> tables. Exit code 1 if a file could not be read."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .operators import ingest
from .session import build, cut
from .sources.sinks import write_tables
from .streaming.ingest import read_files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tariffmill")
    p.add_argument("out")
    p.add_argument("files", nargs="+")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    p.add_argument("--synonyms", help="JSON file of normalized header -> canonical field")
    a = p.parse_args(argv)
    spark = build()
    extra = json.load(open(a.synonyms)) if a.synonyms else None
    parts = None
    for f in a.files:
        one = read_files(spark, f)
        parts = one if parts is None else parts.unionByName(one)
    parts = cut(parts)
    tables = ingest.all_tables(parts, extra=extra)
    tables["quality"] = ingest.quality(parts, tables["rejected_codes"])
    for name, n in sorted(write_tables(tables, a.out, a.format).items()):
        print(f"{name}: {n}", file=sys.stderr)
    failed = False
    for r in parts.filter((F.col("kind") == "file") & F.col("raw").isNotNull()).select("path", "raw").toLocalIterator():
        print(f"{r.path}: {r.raw}", file=sys.stderr)
        failed = True
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
