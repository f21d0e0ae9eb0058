"""What both substring operators share: anchors, which select the few places where a repeated window can be, and removal.

Every window of WINDOW symbols chooses the least of the hashes of its k-symbol strings; equal windows choose the same string. So a
window that occurs in two documents has an anchor that occurs in both. Only anchors found in two documents or more are followed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, drop, rolling, sliding_min

WINDOW = 50


def least_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """The anchor hash of each window start."""
    grams, width = rolling(symbols, k), WINDOW - k + 1
    return sliding_min(grams, width) if len(grams) >= width else np.empty(0, U64)


def places(symbols: np.ndarray, k: int) -> np.ndarray:
    """The leftmost position of the anchor of each window start."""
    grams, width = rolling(symbols, k), WINDOW - k + 1
    if len(grams) < width:
        return np.empty(0, np.int64)
    # Ranks keep the order of hashes, and a rank and a position fit in one number.
    n, rank = len(grams), np.unique(grams, return_inverse=True)[1].astype(np.int64)
    held, least = np.sort(rank * n + np.arange(n)), sliding_min(rank, width)
    return held[np.searchsorted(held, least * n + np.arange(len(least)))] - least * n


def anchors(symbols: np.ndarray, k: int) -> np.ndarray:
    least = least_hashes(symbols, k)
    # Neighbouring windows mostly choose the same string.
    return np.unique(least[runs_of(least)])


def runs_of(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, u, text: u names a row by id and text; equal rows share it and have equal results."""
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(id), F.col(text)).alias("u"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def recurring(rows: DataFrame, symbols: Callable[[str], np.ndarray], k: int, name: str) -> DataFrame:
    """(u, doc_id, anchor, first): the anchors of each row that occur in two documents, and the first document of each; equal rows give equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(symbols(t), k) for t in batch.column(2).to_pylist()]
            flat = pa.array(np.concatenate([*found, np.empty(0, U64)]).view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "u": batch.column(1), "anchors": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), flat)})

    held = rows.where("doc_id is not null").mapInArrow(run, "doc_id long, u long, anchors array<long>")
    held = cut(held, f"{name}-anchors")
    each = held.select("doc_id", "u", F.explode("anchors").alias("anchor"))
    many = each.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("anchor", "first")
    many = cut(many, f"{name}-many")
    out = cut(each.join(many, "anchor"), f"{name}-recurring")
    drop(held, many)
    return out


def covered(starts: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """(which of n symbols are covered by the windows at counts places from each start on, number of maximal runs)."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + counts + (WINDOW - 1), minlength=n + 1)
    mask = np.cumsum(step[:-1]) > 0
    return mask, int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (mask[0] if n else 0))


def _ranges(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, counts) of each row of lists of starts, or of (s, c): c starts from s on."""
    ends, flat = np.cumsum([0, *column.value_lengths().to_pylist()]), column.flatten()
    fields = flat.flatten() if pa.types.is_struct(flat.type) else [flat]
    starts = fields[0].to_numpy(zero_copy_only=False)
    counts = fields[1].to_numpy(zero_copy_only=False) if len(fields) > 1 else np.ones(len(starts), np.int64)
    return ((starts[a:b], counts[a:b]) for a, b in zip(ends, ends[1:], strict=False))


def applied(rows: DataFrame, removed: DataFrame, remove: Callable[[str, np.ndarray, np.ndarray], tuple], schema: str, name: str) -> DataFrame:
    """Every row through remove(text, starts, counts). removed: a written table (u, starts; see _ranges) of the rows that lose something; only their texts are moved."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = _ranges(batch.column(3)) if batch.num_columns > 3 else [(np.empty(0, np.int64),) * 2] * batch.num_rows
            out = [remove(t, *s) for t, s in zip(batch.column(2).to_pylist(), starts, strict=True)]
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "u": batch.column(1)} | {c: pa.array(x, pa.string() if c.endswith(("256", "kept")) else pa.int64()) for c, x in zip(names, columns, strict=True)})

    full = f"doc_id long, u long, {schema}"
    plain = cut(rows.mapInArrow(run, full), f"{name}-plain")
    cutaway = rows.where("doc_id is not null").join(removed, "u").select("doc_id", "u", "text", "starts").dropDuplicates(["u"]).mapInArrow(run, full)
    less = cutaway.select(F.col("u").alias("v"), *[F.col(c).alias(f"_{c}") for c in names])
    joined = plain.join(less, F.col("u") == F.col("v"), "left")
    return joined.select("doc_id", *[F.when(F.col("v").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names])
