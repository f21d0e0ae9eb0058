"""What the corpus operators share: words, shared tables, sizes and hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII blanks; bytes.split() splits at the same six characters.
BLANKS = r"[\x20\x09-\x0D]+"

U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode without that setting (tests) a local one is set; on a cluster that would be lost."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fragmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark removes the shuffle files of a finished query at once, not when the driver's collector happens to find them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that go to a Python worker at once while a table is written: texts are long, so a task holds few of them.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the table: lineage ends there, and lost executors cost nothing before it.

    The shuffle files of the write go when it has finished; nothing reads them after it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own = {CLEANUP: "true", ARROW_ROWS: "1000"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of a text column, or of one row: what a task holds doesn't depend on the lengths of other texts."""
    if batch.num_rows:
        before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) // most
        edges = [0, *(np.flatnonzero(before[1:] != before[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once nothing reads them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row: a lambda's argument is never inlined."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 values."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive uint64 values, by doubling: log2(k) passes over the array. Empty if there are fewer than k."""
    if len(values) < k:
        return np.empty(0, U64)
    base, power, span = 0x9E3779B97F4A7C15, values + U64(1), 1
    out, done = None, 0
    while True:
        step = U64(pow(base, span, 1 << 64))
        if k & span:
            if out is None:
                out, done = power, span
            else:
                n = len(power) - done
                out = out[:n] * step + power[done : done + n]
                done += span
        if span * 2 > k:
            return mix(out)
        power = power[:-span] * step + power[span:]
        span *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every width consecutive values."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: -(width - span)], out[width - span :])
    return out


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length of the whole at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))
