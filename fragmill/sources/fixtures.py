"""Spectra made from the driver's tables: peaks(row, peak_id, mass, intensity) and spectra(row, external_id, precursor_mz, ion_mode)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    mass = F.lit(50.0) + ((F.col("event_id") * 7919) % 50000) / F.lit(1000.0)
    rows = e.select(F.col("user_id").alias("row"), "event_id", mass.alias("mass"), F.greatest("value", F.lit(0.0)).alias("intensity"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy("mass", "event_id")) - 1
    return rows.withColumn("peak_id", rank).select("row", "peak_id", "mass", "intensity")


def event_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("row")).distinct()
    return u.select(
        "row", F.concat(F.lit("U"), F.lpad(F.col("row").cast("string"), 6, "0")).alias("external_id"),
        F.when(F.col("row") % 17 != 0, F.lit(100.0) + F.col("row") * F.lit(0.5)).alias("precursor_mz"),
        F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("unknown")), (F.col("row") % 3 + 1).cast("int")).alias("ion_mode"),
    )
