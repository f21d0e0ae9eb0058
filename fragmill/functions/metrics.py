"""Evaluation aggregates over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmill.sources.tables import table


def errors(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.abs(F.col(a) - F.col(b))
    return df.agg(F.avg(d).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(d).alias("max_error"), F.percentile(d, F.lit(0.95)).alias("p95"), F.corr(a, b).alias("pearson"))


def latency(df: DataFrame, value: str) -> DataFrame:
    p = lambda q: F.percentile(value, F.lit(q))
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min(value).alias("least"), F.max(value).alias("most"))


def confusion(df: DataFrame, truth: str, said: str, weight: str | None = None) -> DataFrame:
    """weight: a column that says how many cases a row stands for."""
    t, s, w = F.col(truth), F.col(said), F.col(weight) if weight else F.lit(1)
    cases = lambda x: F.coalesce(F.sum(F.when(x, w)), F.lit(0)).cast("long")
    n = df.agg(cases(t & s).alias("tp"), cases(~t & s).alias("fp"), cases(t & ~s).alias("fn"), cases(~t & ~s).alias("tn"))
    share = lambda a, b, empty: F.when(b > 0, a / b).otherwise(F.lit(empty))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.select("*", share(tp, tp + fp, 1.0).alias("precision"), share(tp, tp + fn, 1.0).alias("recall"), share(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"), share(tp + tn, tp + fp + fn + tn, 1.0).alias("accuracy"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, recall, jaccard of two hit tables (query_id, row); a is the truth."""
    both = a.select("query_id", "row", F.lit(1).alias("x")).join(b.select("query_id", "row", F.lit(1).alias("y")), ["query_id", "row"], "full")
    n = both.groupBy("query_id").agg(F.count("x").alias("a"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("i"), F.count("*").alias("u"))
    return n.select("query_id", F.when(F.col("a") > 0, F.col("i") / F.col("a")).otherwise(1.0).alias("recall"), (F.col("i") / F.col("u")).alias("jaccard"))


def power_law(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.log10(x), F.log10(y)
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def counted(df: DataFrame, value: str, weight: str) -> DataFrame:
    """value, n, before: the distinct values, how many cases have each, and how many have lesser ones. Values are numbered in ranges, not in one task."""
    counts = df.groupBy(value).agg(F.sum(weight).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table(counts.repartitionByRange(parts, value).withColumn("part", F.spark_partition_id()), "counted")
    ahead = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range.
    offsets = ranged.groupBy("part").agg(F.sum("n").alias("n")).select("part", ahead(Window.orderBy("part")).alias("offset"))
    inside = ranged.withColumn("inside", ahead(Window.partitionBy("part").orderBy(value)))
    return inside.join(F.broadcast(offsets), "part").select(value, "n", (F.col("offset") + F.col("inside")).alias("before"))


def percentiles(df: DataFrame, value: str, weight: str, **shares: float) -> DataFrame:
    """One row: for each share the percentile of the cases, interpolated."""
    of = counted(df, value, weight)
    total = of.agg(F.sum("n").alias("total"))
    at = of.crossJoin(F.broadcast(total))  # one row
    out = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("total") - 1)
        held = lambda p: F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("n")), F.col(value)))
        low, high = held(F.floor(place)), held(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return at.agg(*out)


def pairwise(df: DataFrame, a: str, b: str, same: str, weight: str, margin: float = 1e-6) -> DataFrame:
    """How two scorers agree on pairs: errors with their percentiles, the share of equal match counts (column same), and how many pairs differ. A row stands for `weight` pairs."""
    each = df.select(F.abs(F.col(a) - F.col(b)).alias("d"), F.col(same).alias("same"), F.col(weight).alias("w"))
    each = table(each.groupBy("d", "same").agg(F.sum("w").alias("w")), "errors")
    d, w = F.col("d"), F.col("w")
    n = F.sum("w")
    known = each.agg(
        F.coalesce(n, F.lit(0)).cast("long").alias("n_pairs"), F.max(d).alias("max_error"), (F.sum(d * w) / n).alias("mae"), F.sqrt(F.sum(d * d * w) / n).alias("rmse"),
        (F.coalesce(F.sum(F.when(F.col("same"), w)), F.lit(0)) / n).alias("match_rate"), F.coalesce(F.sum(F.when(d > margin, w)), F.lit(0)).cast("long").alias("discrepant"),
    )
    return known.crossJoin(percentiles(each, "d", "w", p50=0.5, p95=0.95, p99=0.99)).select("n_pairs", "max_error", "mae", "rmse", "p50", "p95", "p99", "match_rate", "discrepant")


def correlations(df: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """n, pearson and spearman; ties get the mean of their ranks; 0 where a side is constant. A row stands for `weight` cases.

    Ranks come from the counts of distinct values, so rows are pre-aggregated, and sums are taken about the means.
    """
    each = table(df.groupBy(a, b).agg(F.sum(weight).alias("w")), "cases")

    def ranks(c: str) -> DataFrame:
        return counted(each, c, "w").select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    joined = each.join(ranks(a), a).join(ranks(b), b)
    w = F.col("w")
    mean = each.agg(F.sum("w").alias("cases"), (F.sum(F.col(a) * w) / F.sum("w")).alias("mean_a"), (F.sum(F.col(b) * w) / F.sum("w")).alias("mean_b"))
    joined = joined.crossJoin(F.broadcast(mean))  # one row
    middle = (F.col("cases") + 1) / 2

    def of(x: str, y: str, mean_x, mean_y):
        dx, dy = F.col(x) - mean_x, F.col(y) - mean_y
        constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
        return F.when(constant, F.lit(0.0)).otherwise(F.sum(dx * dy * w) / F.sqrt(F.sum(dx * dx * w)) / F.sqrt(F.sum(dy * dy * w)))

    return joined.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("n"), of(a, b, F.col("mean_a"), F.col("mean_b")).alias("pearson"), of(f"rank_{a}", f"rank_{b}", middle, middle).alias("spearman"))


def hit_overlap(truth: DataFrame, other: DataFrame) -> DataFrame:
    """query_id, recall, jaccard, overlap (coefficient), top1 of two hit tables (query_id, rank, spectrum_index).

    Of a query without true hits the recall is 0 if anything was found, else 1.
    """
    t, o = truth.select("query_id", "spectrum_index", F.col("rank").alias("x")), other.select("query_id", "spectrum_index", F.col("rank").alias("y"))
    both = t.join(o, ["query_id", "spectrum_index"], "full")
    n = both.groupBy("query_id").agg(F.count("x").alias("a"), F.count("y").alias("b"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("i"), F.count("*").alias("u"), F.count_if((F.col("x") == 1) & (F.col("y") == 1)).alias("top"))
    return n.select(
        "query_id", F.when(F.col("a") > 0, F.col("i") / F.col("a")).otherwise(F.when(F.col("b") > 0, 0.0).otherwise(1.0)).alias("recall"), (F.col("i") / F.col("u")).alias("jaccard"),
        F.when(F.least("a", "b") > 0, F.col("i") / F.least("a", "b")).otherwise(0.0).alias("overlap"), (F.col("top") > 0).alias("top1"),
    )


def outcome_diff(truth: DataFrame, other: DataFrame) -> DataFrame:
    """One row: false dismissals, recall, errors of shared hits and how many queries have as many hits, of two hit tables (query_id, spectrum_index, score)."""
    both = truth.select("query_id", "spectrum_index", F.col("score").alias("x")).join(other.select("query_id", "spectrum_index", F.col("score").alias("y")), ["query_id", "spectrum_index"], "full")
    d = F.abs(F.col("x") - F.col("y"))
    n = both.groupBy("query_id").agg(F.count("x").alias("a"), F.count("y").alias("b"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("i"), F.sum(d).alias("sum"), F.max(d).alias("most"))
    return n.agg(
        F.count("*").alias("n_queries"), F.sum(F.col("a") - F.col("i")).alias("false_dismissals"), F.avg(F.when(F.col("a") > 0, F.col("i") / F.col("a")).otherwise(1.0)).alias("mean_recall"),
        F.coalesce(F.max("most"), F.lit(0.0)).alias("max_error"), F.coalesce(F.sum("sum") / F.sum("i"), F.lit(0.0)).alias("mean_error"), (F.count_if(F.col("a") == F.col("b")) / F.count("*")).alias("hit_count_match_rate"),
    )
