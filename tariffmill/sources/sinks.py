"""Write output tables as CSV or Parquet folders: one folder per table that has rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

FORMATS = ("csv", "parquet")


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", by_file: bool = False, mode: str = "overwrite", files: DataFrame | None = None) -> dict[str, int]:
    """Writes every non-empty table under path/<name> and returns the rows written of each, counted as they are written.

    by_file partitions by file_id, with only the partitions of the written files replaced. files(file_id) names the loaded
    files (one row each): what an earlier load of them left in any table goes first, so that loading a file again gives the
    same result even where it lost rows. CSV has a header and empty cells for nulls.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known are {', '.join(FORMATS)}")
    if by_file and files is not None:
        drop_files([f"{path}/{name}" for name in tables], files)
    counts = {}
    for name, df in tables.items():
        if df.isEmpty():
            continue
        seen = Observation()
        flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) and fmt == "csv" else F.col(c) for c, t in df.dtypes))
        w = flat.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode)
        if by_file:
            w = w.partitionBy("file_id").option("partitionOverwriteMode", "dynamic")
        if fmt == "csv":
            w.option("header", True).option("emptyValue", "").option("nullValue", "").csv(f"{path}/{name}")
        else:
            w.parquet(f"{path}/{name}")
        counts[name] = seen.get["n"]
    return counts


def drop_files(folders: list[str], files: DataFrame) -> None:
    """Deletes the partitions of files in table folders. The names of one load's files come to the driver, which listed them."""
    spark = files.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    names = [r.file_id for r in files.select("file_id").distinct().collect()]
    for folder in folders:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            continue
        for name in names:
            part = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("file_id", name)
            fs.delete(jvm.org.apache.hadoop.fs.Path(at, part), True)


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Temporary views of all tables, for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
