"""Reports of a bench run as JSON and CSV, and what the run ran on."""

from __future__ import annotations

import csv
import json
import math
import os
import platform
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Columns of the table of retrievals, in order.
COLUMNS = ["mode", "n_queries", "seconds", "queries_per_second", "mean", "std", "p50", "p95", "p99", "least", "most", "trees", "trees_kept", "leaves_kept", "pairs_bounded", "pairs_scored", "hits", "scored_share", "mean_recall", "false_dismissals"]


def environment(spark: SparkSession) -> dict:
    return {"python": platform.python_version(), "platform": platform.platform(), "cpus": os.cpu_count(), "spark": spark.version, "master": spark.sparkContext.master, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}


def plain(x):
    """x with NaN and infinities as null, and rows and paths as JSON has them."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return plain(x.asDict(recursive=True))
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    return x if x is None or isinstance(x, str | int | bool) else str(x)


def to_json(report: dict, path: str | Path | None = None) -> str:
    text = json.dumps(plain(report), indent=2, ensure_ascii=False)
    if path is not None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
    return text


def to_csv(rows: list[dict], path: str | Path, columns: list[str] = COLUMNS) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, columns, extrasaction="ignore", restval="")
        out.writeheader()
        out.writerows([{k: v for k, v in plain(r).items() if v is not None} for r in rows])


def totals(counters: DataFrame, n_spectra: int) -> dict:
    """The counters of a staged search, summed, with the share of all pairs that were scored."""
    names = [c for c in counters.columns if c != "query_id"]
    out = counters.groupBy().sum(*names).toDF(*names).first().asDict()
    n = counters.count()
    return {k: v or 0 for k, v in out.items()} | {"n_queries": n, "scored_share": (out["pairs_scored"] or 0) / (n * n_spectra) if n and n_spectra else 0.0}
