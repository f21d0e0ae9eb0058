"""What queries, peak arrays and settings must hold, as DataFrames of what they break."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def peaks(df: DataFrame, key: str = "row", value: str = "v") -> DataFrame:
    """key, problem of the spectra whose peak arrays are broken: unordered mass, or values that are negative or not finite."""
    before = F.lag("mass").over(Window.partitionBy(key).orderBy("peak_id"))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    p = df.withColumn("problem", F.when(bad("mass"), "mass is not finite").when(bad(value), "value is not finite").when(F.col(value) < 0, "value is negative").when(F.col("mass") < before, "mass is not in order"))
    return p.where("problem is not null").groupBy(key).agg(F.min("problem").alias("problem"))


def queries(df: DataFrame, key: str = "query_id", value: str = "v", margin: float = 1e-4) -> DataFrame:
    """key, problem of the queries that can't be searched: broken peaks, no energy, or a norm that isn't 1. A query without peaks is no row and passes."""
    norm = df.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    of_norm = norm.select(key, F.when(F.col("norm") == 0, "norm is zero").when(F.abs(F.col("norm") - 1) > margin, "norm is not 1").alias("other"))
    return of_norm.join(peaks(df, key, value), key, "left").select(key, F.coalesce("problem", "other").alias("problem")).where("problem is not null")


def settings(df: DataFrame) -> DataFrame:
    """query_id, problem of the rows of queries whose settings contradict each other."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    problem = (
        F.when(~F.col("mode").isin("top_k", "threshold"), "unknown mode").when(~F.col("policy").isin("exact", "include_unknown", "any"), "unknown policy")
        .when((F.col("mode") == "top_k") & ~F.coalesce(F.col("k") > 0, F.lit(False)), "k is not above 0").when((F.col("mode") == "threshold") & ~finite("threshold"), "threshold is not finite")
        .when(~(finite("tolerance") & (F.col("tolerance") > 0)), "tolerance is not above 0").when(F.coalesce(F.col("min_matched") < 0, F.lit(True)), "min_matched is negative")
        .when(F.col("pw_center").isNotNull() & ~(finite("pw_center") & (F.col("pw_center") > 0) & finite("pw_tol") & (F.col("pw_tol") > 0)), "window is not above 0")
    )
    return df.select("query_id", problem.alias("problem")).where("problem is not null")


def refuse(problems: DataFrame) -> None:
    """Raises ValueError with the first few problems, if there are any."""
    if found := problems.orderBy(*problems.columns).limit(5).collect():
        raise ValueError("; ".join(f"{r[0]}: {r[1]}" for r in found))
