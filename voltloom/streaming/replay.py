"""Validation results as a stream: counts by time window and source, late rows within a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import shared_folder


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, by, n): rows of each window; rows later than ``late`` behind the newest are dropped by
    the watermark, windows behind it leave the state."""
    w = F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def run_available(counts: DataFrame, spark: SparkSession, keys: list[str]) -> DataFrame:
    """Runs a stream over what is there now. Each batch's updates are written under its number, so a
    batch that is run again overwrites itself; the last update of a key counts."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    q = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in counts.columns if c not in keys]
    out = spark.read.schema(T.StructType([*counts.schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", f"{place}/out").parquet(f"{place}/out")
    return out.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def latest(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each (key, at) once: repeats within the watermark are dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
