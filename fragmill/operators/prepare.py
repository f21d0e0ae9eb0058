"""Cleaning, L2 normalisation, cells, trees and envelopes of peak tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID, TREE, INFLATE = 0.02, 64, 1 + 1e-12


def clean(peaks: DataFrame, mz: tuple[float, float] = (10.0, 2000.0), relative: float = 0.001, most: int = 300, least: int = 3) -> DataFrame:
    """The peaks that stay, scaled to a maximum of 1; spectra with under `least` peaks go."""
    of = Window.partitionBy("row")
    kept = peaks.where(F.col("mass").between(*mz)).withColumn("top", F.max("intensity").over(of)).where(F.col("intensity") >= relative * F.col("top"))
    rank = F.row_number().over(of.orderBy(F.desc("intensity"), "mass", "peak_id"))
    kept = kept.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("n", F.count("*").over(of)).where(F.col("n") >= least)
    again = F.row_number().over(of.orderBy("mass", "peak_id")) - 1
    return kept.select("row", again.alias("peak_id"), "mass", (F.col("intensity") / F.col("top")).alias("intensity"))


def normalise(peaks: DataFrame, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """row, peak_id, mass, v, norm: v = I^alpha * m^beta over its L2 norm. A spectrum of norm 0 keeps its peaks with v = 0."""
    y = F.greatest(F.col("intensity"), F.lit(0.0))
    y = F.when(y > 0, F.lit(1.0)).otherwise(0.0) if alpha == 0 else F.pow(y, F.lit(alpha)) if alpha != 1 else y
    if beta:
        y = F.when(F.col("mass") > 0, y * F.pow("mass", F.lit(beta))).otherwise(0.0)
    y = F.when(F.isnan(y) | (F.abs(y) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(y, F.lit(0.0)))
    norm = F.sqrt(F.sum(F.col("y") * F.col("y")).over(Window.partitionBy("row")))
    return peaks.withColumn("y", y).withColumn("norm", norm).select("row", "peak_id", "mass", F.when(F.col("norm") > 0, F.col("y") / F.col("norm")).otherwise(0.0).alias("v"), "norm")


def cell(mass: Column, grid: float = GRID) -> Column:
    return F.floor((mass + F.lit(1e-12)) / F.lit(grid))


def cells(peaks: DataFrame, grid: float = GRID) -> DataFrame:
    """row, cell, energy: only cells of positive energy."""
    return peaks.groupBy("row", cell(F.col("mass"), grid).alias("cell")).agg(F.sum(F.col("v") * F.col("v")).alias("energy")).where("energy > 0")


def clean_library(spectra: DataFrame, peaks: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(peaks that stay, rejected(row, external_id, reason)): spectra that cleaning leaves without enough peaks are kept as rejects."""
    good = clean(peaks, **how)
    return good, spectra.join(good.select("row").distinct(), "row", "left_anti").select("row", "external_id", F.lit("unparseable").alias("reason"))


def clean_metadata(spectra: DataFrame) -> DataFrame:
    """row, external_id, precursor_mz, ion_mode, charge: the mode from the charge's sign where it is unknown, then the sign from the mode; 0 is no charge, and a precursor that isn't above 0 is none."""
    c = F.when(F.col("charge") != 0, F.col("charge"))
    mode = F.when((F.col("ion_mode") == "unknown") & (c > 0), "positive").when((F.col("ion_mode") == "unknown") & (c < 0), "negative").otherwise(F.col("ion_mode"))
    known = spectra.withColumn("charge", c).withColumn("ion_mode", mode)
    signed = F.when(F.col("ion_mode") == "positive", F.abs("charge")).when(F.col("ion_mode") == "negative", -F.abs("charge")).otherwise(F.col("charge"))
    return known.select("row", "external_id", F.when(F.col("precursor_mz") > 0, F.col("precursor_mz")).alias("precursor_mz"), "ion_mode", signed.alias("charge"))


def denormalised(peaks: DataFrame) -> DataFrame:
    """row, peak_id, mass, intensity as before normalisation."""
    return peaks.select("row", "peak_id", "mass", (F.col("v") * F.col("norm")).alias("intensity"))


def reweighted(peaks: DataFrame, alpha: float) -> DataFrame:
    """Normalised peaks with another power of the intensity: row, peak_id, mass, v."""
    return normalise(denormalised(peaks), alpha).drop("norm")


def trees(members: DataFrame) -> DataFrame:
    return members.groupBy("ion_mode", "tree_id").agg(F.min("precursor_mz").alias("prec_min"), F.max("precursor_mz").alias("prec_max"), F.count("*").alias("n"))


def envelopes(peaks: DataFrame, members: DataFrame, grid: float = GRID) -> DataFrame:
    """ion_mode, tree_id, cell, amp: the largest amplitude of a tree's members in each cell, inflated once."""
    held = peaks.where("v > 0").select("row", cell(F.col("mass"), grid).alias("cell"), "v").join(members.select("row", "ion_mode", "tree_id"), "row")
    return held.groupBy("ion_mode", "tree_id", "cell").agg((F.max("v") * INFLATE).alias("amp"))
