"""Spectral entropy similarity and search, by its published definition.

Intensities sum to 1; a spectrum of entropy S under 3 has them raised to 0.25 + S / 4 and scaled again. Peaks nearer than twice the
tolerance are one, at their weighted mean mass, so a peak matches one other at most. The similarity is 1 minus
the Jensen-Shannon divergence in bits, a sum over matched peaks alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmill.operators import search, tiles


def merged(peaks: DataFrame, gap: float) -> DataFrame:
    """row, peak_id, mass, intensity: runs of peaks that are not over `gap` apart become one; peaks without intensity go."""
    by = Window.partitionBy("row").orderBy("mass", "peak_id")
    p = peaks.where((F.col("intensity") > 0) & (F.col("intensity") < float("inf"))).withColumn("new", F.coalesce((F.col("mass") - F.lag("mass").over(by) > gap).cast("int"), F.lit(1)))
    p = p.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    one = p.groupBy("row", "run").agg((F.sum(F.col("mass") * F.col("intensity")) / F.sum("intensity")).alias("mass"), F.sum("intensity").alias("intensity"))
    return one.select("row", (F.col("run") - 1).cast("int").alias("peak_id"), "mass", "intensity")


def weighted(peaks: DataFrame) -> DataFrame:
    """row, peak_id, mass, v: intensities that sum to 1, weighted by entropy."""
    own = Window.partitionBy("row")
    p = peaks.withColumn("p", F.col("intensity") / F.sum("intensity").over(own))
    p = p.withColumn("s", -F.sum(F.col("p") * F.log(F.col("p"))).over(own))
    p = p.withColumn("x", F.when(F.col("s") < 3, F.pow("p", 0.25 + 0.25 * F.col("s"))).otherwise(F.col("p")))
    return p.select("row", "peak_id", "mass", (F.col("x") / F.sum("x").over(own)).alias("v"))


def similarities(query_peaks: DataFrame, peaks: DataFrame, tolerance: float = search.TOLERANCE, spectra: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """query_id, external_id, spectrum_index, score, n_matched of the pairs that share a peak, from weighted peaks; with k, of all that may be among the k best."""
    asked = search.unlimited(query_peaks, k)
    return search.scored(asked, query_peaks, peaks, search.unnamed(peaks) if spectra is None else spectra, lambda q, lib, ok: tiles.entropy(q, lib, tolerance))
