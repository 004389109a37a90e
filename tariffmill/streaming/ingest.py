"""Files as they land -> tables, by Structured Streaming.

All state is per file, so micro-batches of whole files need no state store: a stream of landed file names drives
foreachBatch, which reads the batch's files through the "mrf" source and replaces their partitions. Running a batch
again after a failure writes the same partitions again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..sources.mrf import SCHEMA, MrfSource, parts
from ..session import cut
from ..sources.sinks import write_tables


LANDED = "path string, modificationTime timestamp, length long, content binary"


def file_id(path: str):
    """The file's name with a hash of its whole path, so that files of one name in different folders stay apart."""
    whole = F.regexp_replace(path, "^(?:file:)?/+", "/")
    return F.concat(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.lower(F.hex(F.xxhash64(whole))))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Parts of the files of a path pattern, with file_id."""
    spark.dataSource.register(MrfSource)
    return spark.read.format("mrf").load(path).withColumn("file_id", file_id("path"))


def parts_of(files: DataFrame) -> DataFrame:
    """Parts of the files named in column path; one task per file."""

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for p in pdf.path:
                rows = []
                for r in parts(p.removeprefix("file://").removeprefix("file:")):
                    rows.append(r)
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=["path", "kind", "ord", "cells", "raw"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "kind", "ord", "cells", "raw"])

    return files.select("path").mapInPandas(read, SCHEMA).withColumn("file_id", file_id("path"))


def start(spark: SparkSession, landing: str, out: str, checkpoint: str, fmt: str = "parquet", dictionary: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Streams landing into out; trigger defaults to availableNow. File contents are not carried in the stream, only names."""
    landed = spark.readStream.format("binaryFile").schema(LANDED).load(landing).select("path")

    def load(batch: DataFrame, _: int) -> None:
        names = batch.repartition("path")
        parts = cut(parts_of(names))
        write_tables(ingest.all_tables(parts, dictionary), out, fmt, by_file=True, files=parts.select("file_id").distinct())

    return landed.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rolling_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per key and window of a stream; rows later than `late` are dropped once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
