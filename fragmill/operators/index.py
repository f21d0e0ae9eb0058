"""The index over a library: order, trees, leaves, envelopes, rows without energy, and its checks.

The library is sorted in ranges, not in one task for each ion mode: rows are numbered inside their range, and the counts of
the ranges before are added.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmill.operators import prepare
from fragmill.sources.tables import table

TREE, LEAF, AXES = 64, 16, 10


def zero_members(spectra: DataFrame, cells: DataFrame) -> DataFrame:
    """The spectra without a cell of positive energy, which no tree holds."""
    return spectra.join(cells.select("row").distinct(), "row", "left_anti")


def ordered(spectra: DataFrame, cells: DataFrame, capacity: int = TREE) -> DataFrame:
    """row, external_id, ion_mode, place, tree_id, precursor_mz: per ion mode in order of precursor (unknown last), id and row, `capacity` to a tree."""
    order = [F.asc_nulls_last("precursor_mz"), F.asc("external_id"), F.asc("row")]
    live = spectra.join(cells.select("row").distinct(), "row", "left_semi").select("row", "external_id", "ion_mode", "precursor_mz")
    n = int(spectra.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table(live.repartitionByRange(n, "ion_mode", *order).withColumn("part", F.spark_partition_id()), "ordered")
    # At most a row for each range and ion mode.
    counts = ranged.groupBy("ion_mode", "part").agg(F.count("*").alias("n"))
    before = counts.select("ion_mode", "part", F.coalesce(F.sum("n").over(Window.partitionBy("ion_mode").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("ion_mode", "part").orderBy(*order)) - 1
    out = ranged.withColumn("inside", inside).join(before, ["ion_mode", "part"])
    return out.select("row", "external_id", "ion_mode", (F.col("before") + F.col("inside")).alias("place"), F.floor((F.col("before") + F.col("inside")) / capacity).alias("tree_id"), "precursor_mz")


def _cost(top: np.ndarray) -> np.ndarray:
    """Cells touched times the sum of their largest amplitudes, for each row of running maxima."""
    return np.count_nonzero(top, axis=1) * top.sum(axis=1)


def split(amps: np.ndarray, most: int = LEAF, axes: int = AXES) -> np.ndarray:
    """The leaf of each member of one tree, from its amplitudes (members by cells): halves of least cost along the cells that part them best."""
    leaf = np.zeros(len(amps), np.int64)
    waiting, done = [np.arange(len(amps))], 0
    while waiting:
        own = waiting.pop(0)
        n, least = len(own), max(2, min(8, most // 2))
        if n <= most:
            leaf[own], done = done, done + 1
            continue
        held = amps[own]
        held = held[:, held.any(axis=0)]
        often = np.count_nonzero(held, axis=0)
        lead = np.argsort(-(often * (n - often)), kind="stable")[:axes]
        best = (np.inf, own[: n // 2], own[n // 2 :])
        cuts = np.arange(max(least, n // 2 - 8), min(n - least, n // 2 + 8) + 1)
        for a in lead if len(cuts) else ():
            order = np.argsort(held[:, a], kind="stable")
            up, down = np.maximum.accumulate(held[order]), np.maximum.accumulate(held[order[::-1]])
            cost = _cost(up)[cuts - 1] + _cost(down)[n - cuts - 1]
            at = int(np.argmin(cost))
            if cost[at] < best[0]:
                best = (cost[at], own[order[: cuts[at]]], own[order[cuts[at] :]])
        waiting = [np.sort(best[1]), np.sort(best[2]), *waiting]
    return leaf


def leaves(members: DataFrame, peaks: DataFrame, grid: float = prepare.GRID, most: int = LEAF) -> DataFrame:
    """members with leaf_id, numbered inside their tree. A tree has at most `capacity` members, so a group is small."""
    amps = peaks.where("v > 0").select("row", prepare.cell(F.col("mass"), grid).alias("cell"), "v").groupBy("row", "cell").agg(F.max("v").alias("v"))
    held = amps.groupBy("row").agg(F.collect_list(F.struct("cell", "v")).alias("amps"))
    rows = members.join(held, "row")

    def run(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("place").reset_index(drop=True)
        cells = sorted({c["cell"] for x in tree["amps"] for c in x})
        at = {c: i for i, c in enumerate(cells)}
        grid_ = np.zeros((len(tree), len(cells)))
        for i, x in enumerate(tree["amps"]):
            for c in x:
                grid_[i, at[c["cell"]]] = c["v"]
        return tree.drop(columns="amps").assign(leaf_id=split(grid_, most))

    return rows.groupBy("ion_mode", "tree_id").applyInPandas(run, members.schema.add("leaf_id", "long"))


def envelopes(peaks: DataFrame, members: DataFrame, *node: str, grid: float = prepare.GRID) -> DataFrame:
    """*node, cell, amp: the largest amplitude of a node's members in each cell, inflated once."""
    held = peaks.where("v > 0").select("row", prepare.cell(F.col("mass"), grid).alias("cell"), "v").join(members.select("row", *node), "row")
    return held.groupBy(*node, "cell").agg((F.max("v") * prepare.INFLATE).alias("amp"))


def partition_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("ion_mode").agg(F.count("*").alias("members"), F.countDistinct("tree_id").alias("trees"))


def check(members: DataFrame, trees: DataFrame, zero: DataFrame, spectra: DataFrame, roots: DataFrame, leaf_envelopes: DataFrame, capacity: int = TREE, leaf: int = LEAF) -> DataFrame:
    """name, violations: what an index must hold; all are 0 for a sound one."""
    one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("violations"))
    every = members.select("row").unionByName(zero.select("row"))
    covers = members.join(trees, ["ion_mode", "tree_id"]).where((F.col("precursor_mz") < F.col("prec_min") - 1e-9) | (F.col("precursor_mz") > F.col("prec_max") + 1e-9))
    sized = members.groupBy("ion_mode", "tree_id").agg(F.count("*").alias("n")).join(trees.select("ion_mode", "tree_id", F.col("n").alias("said")), ["ion_mode", "tree_id"], "full")
    over = leaf_envelopes.join(roots.withColumnRenamed("amp", "root"), ["ion_mode", "tree_id", "cell"], "left").where("root is null or amp > root + 1e-12")
    parts = [
        one("rows_missing", spectra.select("row").join(every, "row", "left_anti")),
        one("rows_unknown", every.join(spectra.select("row"), "row", "left_anti")),
        one("rows_twice", every.groupBy("row").count().where("count > 1")),
        one("precursor_not_covered", covers),
        one("tree_size", sized.where(f"n is null or said is null or n <> said or n > {capacity}")),
        one("leaf_size", members.groupBy("ion_mode", "tree_id", "leaf_id").count().where(f"count > {leaf}")),
        one("leaf_over_root", over),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fingerprint(peaks: DataFrame, spectra: DataFrame) -> DataFrame:
    """n_spectra, n_peaks, peak_sum, spectrum_sum: sums of 32-bit hashes over all rows, whatever their order."""
    part = lambda *c: F.conv(F.substring(F.md5(F.concat_ws(":", *c)), 1, 8), 16, 10).cast("long")
    whole = lambda c, by: F.round(F.col(c) * by).cast("long").cast("string")
    p = peaks.agg(F.count("*").alias("n_peaks"), F.sum(part(F.col("row").cast("string"), F.col("peak_id").cast("string"), whole("mass", 1e6), whole("v", 1e6))).alias("peak_sum"))
    s = spectra.agg(F.count("*").alias("n_spectra"), F.sum(part(F.col("row").cast("string"), F.col("external_id"), F.col("ion_mode"), F.coalesce(whole("precursor_mz", 1e6), F.lit("-")))).alias("spectrum_sum"))
    return s.crossJoin(p)  # one row each
