"""Command line: build an index from MGF files, show one, search with its own spectra and report."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragmill import reports
from fragmill.functions import metrics
from fragmill.operators import prepare, sample, search
from fragmill.plans.staged import staged
from fragmill.sources import mgf, snapshot
from fragmill.sources.tables import table

#: Files of over so many bytes are read as far as max(5 * size, 10000) records when a sample of `size` is asked for.
LARGE = 100 << 20


def library(spark: SparkSession, path: str, clean: bool = True, max_records: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spectra, raw peaks, rejected) of MGF files; rows are positions among accepted spectra, peaks are numbered by mass."""
    good, bad = mgf.read(spark, path, max_records, clean={"mz": (10.0, 2000.0)} if clean else None)
    ranged = table(good.repartitionByRange("path", "record_index").withColumn("part", F.spark_partition_id()), "accepted")
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("path", "record_index")) - 1
    rows = ranged.withColumn("inside", inside).join(before, "part").withColumn("row", F.col("before") + F.col("inside"))
    spectra = rows.select("row", "external_id", "precursor_mz", "charge", "ion_mode", F.size("peaks").alias("n_peaks"))
    peaks = rows.select("row", F.posexplode("peaks").alias("peak_id", "p")).select("row", "peak_id", "p.mass", "p.intensity")
    return spectra, peaks, bad


def dataset(spark: SparkSession, path: str, size: int, clean: bool = True) -> tuple[DataFrame, DataFrame]:
    """(spectra, raw peaks) of a stratified sample of a library, renumbered."""
    local = Path(path)
    large = local.is_file() and local.stat().st_size > LARGE
    spectra, peaks, _ = library(spark, path, clean, max(5 * size, 10000) if large else None)
    chosen = sample.stratified(spectra, size).select(F.col("row").alias("position"), "row")
    rows = table(sample.sliced(spectra, chosen), "sampled")
    renamed = rows.select("row", "new_row")
    return rows.drop("row").withColumnRenamed("new_row", "row"), peaks.join(renamed, "row").drop("row").withColumnRenamed("new_row", "row")


def build(spark: SparkSession, a: argparse.Namespace) -> int:
    if not a.force and Path(a.output).exists():
        print(f"{a.output} exists; use --force", file=sys.stderr)
        return 1
    spectra, peaks, bad = library(spark, a.library, not a.no_clean, a.max_records)
    snapshot.save(snapshot.build_index(table(prepare.normalise(peaks), "peaks"), table(spectra, "spectra")), a.output)
    print(reports.to_json({"rejected": {r.reason: r.n for r in bad.groupBy("reason").agg(F.count("*").alias("n")).collect()}} | snapshot.load(spark, a.output)[1]))
    return 0


def info(spark: SparkSession, a: argparse.Namespace) -> int:
    held, manifest = snapshot.load(spark, a.index)
    counts = held.members.groupBy("ion_mode").agg(F.count("*").alias("members"), F.countDistinct("tree_id").alias("trees")).collect()
    print(reports.to_json(manifest | {"zero_energy": held.zero.count(), "partitions": list(counts)}))
    return 0


MODES = {"top10": ("top_k", 10, None, "any"), "top5": ("top_k", 5, None, "any"), "threshold": ("threshold", None, 0.5, "any"), "identity": ("threshold", None, 0.7, "exact")}


def benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    held, manifest = snapshot.load(spark, a.index)
    n = held.spectra.count()
    chosen = table(sample.queries(held.spectra, a.queries), "asked")
    peaks = held.peaks.join(chosen.select("row"), "row").withColumnRenamed("row", "query_id")
    rows = []
    for name in a.modes:
        mode, k, least, policy = MODES[name]
        asked = held.spectra.join(chosen.select("row"), "row").select(F.col("row").alias("query_id"), F.col("ion_mode").alias("q_mode"), F.lit(None).cast("string").alias("exclude_id"), F.lit(None).cast("double").alias("pw_center"), F.lit(None).cast("double").alias("pw_tol"))
        asked = asked.select("*", F.lit(mode).alias("mode"), F.lit(k).cast("int").alias("k"), F.lit(least).cast("double").alias("threshold"), F.lit(policy).alias("policy"), F.lit(search.TOLERANCE).alias("tolerance"), F.lit(1).alias("min_matched"))
        began = time.time()
        hits, counters = staged(asked, peaks, held)
        hits = table(hits, "hits")
        seconds = time.time() - began
        row = {"mode": name, "seconds": seconds, "queries_per_second": a.queries / seconds} | reports.totals(counters, n)
        if a.check:
            exact = search.search(asked, peaks, held.peaks, held.spectra, policy)
            exact = search.top_k(exact, k) if mode == "top_k" else search.threshold(exact, least)
            row |= metrics.outcome_diff(exact, hits).first().asDict()
        rows.append(row)
    report = {"environment": reports.environment(spark), "index": manifest, "rows": rows}
    print(reports.to_json(report, a.json))
    if a.csv:
        reports.to_csv(rows, a.csv)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fragmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="read MGF, write an index")
    b.add_argument("library")
    b.add_argument("-o", "--output", required=True)
    b.add_argument("--force", action="store_true")
    b.add_argument("--no-clean", action="store_true")
    b.add_argument("--max-records", type=int)
    i = sub.add_parser("info", help="show what an index holds")
    i.add_argument("index")
    m = sub.add_parser("benchmark", help="search an index with spectra of its own")
    m.add_argument("index")
    m.add_argument("--queries", type=int, default=50)
    m.add_argument("--modes", nargs="+", choices=sorted(MODES), default=["top10", "threshold"])
    m.add_argument("--check", action="store_true", help="compare with the search that prunes nothing")
    m.add_argument("--json")
    m.add_argument("--csv")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("fragmill").getOrCreate()
    return {"build": build, "info": info, "benchmark": benchmark}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
