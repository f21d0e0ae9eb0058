"""Deterministic samples of spectra by hash rank, and slices by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lower bounds of the strata by number of peaks.
STRATA = (0, 50, 150, 500)


def stratum(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(STRATA):
        out = F.when(n >= least, F.lit(i)).otherwise(out)
    return out


def by_hash(salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt + ":"), F.col("external_id")), 256)


def stratified(spectra: DataFrame, size: int, salt: str = "sample") -> DataFrame:
    """row, external_id, n_peaks, stratum of `size` spectra: as many of each stratum that has any, the rest from all others, least hash first."""
    s = spectra.withColumn("stratum", stratum(F.col("n_peaks"))).withColumn("h", by_hash(salt))
    kinds = s.select("stratum").distinct().agg(F.count("*").alias("kinds"))
    ranked = s.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy("h", "row"))).crossJoin(kinds)  # one row
    first = ranked.withColumn("late", F.col("place") > F.floor(F.lit(size) / F.col("kinds")))
    return first.orderBy("late", "h", "row").limit(size).select("row", "external_id", "n_peaks", "stratum")


def queries(spectra: DataFrame, size: int, least: int = 5, salt: str = "query") -> DataFrame:
    """row, external_id, n_peaks of `size` spectra: those with a precursor and `least` peaks first, least hash first."""
    poor = F.col("precursor_mz").isNull() | (F.col("n_peaks") < least)
    return spectra.withColumn("poor", poor).withColumn("h", by_hash(salt)).orderBy("poor", "h", "row").limit(size).select("row", "external_id", "n_peaks")


def sliced(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """df(row, ...) of the rows in wanted(position, row), renumbered in order of first position; a row wanted twice comes once."""
    first = wanted.groupBy("row").agg(F.min("position").alias("position"))
    # The wanted rows are a list that the caller gave, so one task numbers them.
    place = F.row_number().over(Window.orderBy("position")) - 1
    return df.join(first, "row").withColumn("new_row", place.cast("long")).drop("position")
