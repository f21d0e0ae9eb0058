"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b); label is the least node of its component. No links: no rows.

    Each round is written to the shared folder and deleted after the next; so is the result, for the caller to drop. Minima are pre-aggregated and joined back, so that a hub is split like any
    skewed join and its neighbours are never gathered in one row.
    """
    state = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            out = cut(state.select(F.col("a").alias("node"), F.col("b").alias("label")).union(state.select("b", "b")).distinct(), "components")
            drop(state)
            return out
        before = now
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).where("a <> b")
        old, state = state, cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small")
        drop(old, large)
