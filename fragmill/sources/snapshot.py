"""Snapshots of an index: Parquet tables by ion mode, and a manifest that is written last and checked first."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from fragmill.operators import index as build
from fragmill.operators import prepare
from fragmill.plans.staged import Index

TABLES = ("members", "trees", "roots", "leaves", "peaks", "spectra", "zero")
#: Tables that are stored in a folder for each ion mode.
BY_MODE = {"members", "trees", "roots", "leaves"}


def build_index(peaks: DataFrame, spectra: DataFrame, grid: float = prepare.GRID) -> Index:
    """The index over normalised peaks."""
    if abs(grid - prepare.GRID) > 1e-9:
        raise ValueError(f"grid {grid} is not the grid of the cells, {prepare.GRID}")
    cells = prepare.cells(peaks, grid)
    members = build.table(build.leaves(build.ordered(spectra, cells), peaks, grid), "members")
    leaves = build.table(build.envelopes(peaks, members, "ion_mode", "tree_id", "leaf_id", grid=grid), "leaf-envelopes")
    # A root is the largest of its leaves; it isn't inflated again.
    roots = leaves.groupBy("ion_mode", "tree_id", "cell").agg({"amp": "max"}).withColumnRenamed("max(amp)", "amp")
    return Index(members, prepare.trees(members), roots, leaves, peaks, spectra, build.zero_members(spectra, cells))


def _manifest(index: Index, grid: float) -> dict:
    return {"format": 1, "grid": grid, "tree": build.TREE, "leaf": build.LEAF} | build.fingerprint(index.peaks, index.spectra).first().asDict()


def save(index: Index, path: str, grid: float = prepare.GRID) -> None:
    for name in TABLES:
        writer = getattr(index, name).drop("raw_metadata").write.mode("overwrite")
        (writer.partitionBy("ion_mode") if name in BY_MODE else writer).parquet(f"{path}/{name}")
    spark = index.peaks.sparkSession
    spark.range(1).selectExpr("'" + json.dumps(_manifest(index, grid)) + "' as value").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str, grid: float = prepare.GRID) -> tuple[Index, dict]:
    """The index and its manifest. A path without a manifest was never finished."""
    from pyspark.errors import AnalysisException

    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    except AnalysisException as e:
        raise FileNotFoundError(f"no snapshot at {path}") from e
    if abs(manifest["grid"] - grid) > 1e-9:
        raise ValueError(f"the snapshot has grid {manifest['grid']}, not {grid}")
    return Index(**{name: spark.read.parquet(f"{path}/{name}") for name in TABLES}), manifest


def matches(manifest: dict, peaks: DataFrame, spectra: DataFrame) -> bool:
    """Whether a library is the one that the snapshot was made of."""
    own = build.fingerprint(peaks, spectra).first().asDict()
    return all(manifest[k] == v for k, v in own.items())
