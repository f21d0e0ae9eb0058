"""The engine's registered queries and their oracle SQL, over spectra made from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.functions import metrics, validate
from fragmill.operators import entropy, index, prepare, sample, search
from fragmill.plans import staged
from fragmill.sources import fixtures, mgf, snapshot, tables

#: Every spectrum whose row is divisible by EVERY asks.
EVERY = 20


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(normalised peaks, spectra, peaks of the query spectra)."""
    peaks = prepare.normalise(fixtures.event_peaks(spark, sf_dir))
    return peaks, fixtures.event_spectra(spark, sf_dir), peaks.where(F.col("row") % EVERY == 0).withColumnRenamed("row", "query_id")


def _asked(spectra: DataFrame, window: bool = False) -> DataFrame:
    center = F.col("precursor_mz") if window else F.lit(None).cast("double")
    return spectra.where(F.col("row") % EVERY == 0).select(F.col("row").alias("query_id"), F.col("ion_mode").alias("q_mode"), F.col("external_id").alias("exclude_id"), center.alias("pw_center"), F.lit(20.0).alias("pw_tol"))


def _hits(spark: SparkSession, sf_dir: str, policy: str = "any", min_matched: int = 1, window: bool = False, **limits) -> DataFrame:
    peaks, spectra, q = _library(spark, sf_dir)
    return search.search(_asked(spectra, window), q, peaks, spectra, policy, min_matched, **limits)


def _set(asked: DataFrame, mode: str = "top_k", policy: str = "any", k: int = 10, threshold: float | None = None, min_matched: int = 1) -> DataFrame:
    """asked with the same settings for all."""
    return asked.select("*", F.lit(mode).alias("mode"), F.lit(k).alias("k"), F.lit(threshold).cast("double").alias("threshold"), F.lit(policy).alias("policy"), F.lit(search.TOLERANCE).alias("tolerance"), F.lit(min_matched).alias("min_matched"))


def _mixed(spectra: DataFrame) -> DataFrame:
    """Every query with settings of its own."""
    q = F.col("query_id")
    return _asked(spectra).select(
        "query_id", "q_mode", "exclude_id", F.when(q % 100 == 20, F.lit(100.0) + q * F.lit(0.5)).alias("pw_center"), "pw_tol", F.when(q % 40 == 0, "threshold").otherwise("top_k").alias("mode"),
        (F.lit(3) + q % 7).cast("int").alias("k"), F.when(q % 40 == 0, F.lit(0.08)).alias("threshold"), F.when(q % 3 == 0, "any").when(q % 3 == 1, "exact").otherwise("include_unknown").alias("policy"),
        F.when(q % 60 == 0, F.lit(0.01)).otherwise(F.lit(0.02)).alias("tolerance"), (F.lit(1) + q % 2).cast("int").alias("min_matched"),
    )


def _index(spark: SparkSession, sf_dir: str) -> tuple[staged.Index, DataFrame]:
    peaks = tables.table(_library(spark, sf_dir)[0], "peaks")
    return snapshot.build_index(peaks, fixtures.event_spectra(spark, sf_dir)), peaks.where(F.col("row") % EVERY == 0).withColumnRenamed("row", "query_id")


def _staged(spark: SparkSession, sf_dir: str, settings) -> tuple[DataFrame, DataFrame]:
    held, q = _index(spark, sf_dir)
    return staged.staged(settings(held.spectra), q, held)


def _pruned(settings, *more: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _shown(_staged(spark, sf_dir, settings)[0], *more)


def _shown(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select("query_id", *more, "external_id", "spectrum_index", F.round("score", 9).alias("score"), F.col("n_matched").cast("long").alias("n_matched"))


def _top(**how):
    return lambda spark, sf_dir: _shown(search.top_k(_hits(spark, sf_dir, k=10, **how), 10), "rank")


def _over(least: float):
    return lambda spark, sf_dir: _shown(search.threshold(_hits(spark, sf_dir, least=least), least))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks, _, q = _library(spark, sf_dir)
    return search.edges(q, peaks)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks, spectra, _ = _library(spark, sf_dir)
    return index.ordered(spectra, prepare.cells(peaks)).drop("place")


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.envelopes(_library(spark, sf_dir)[0], _members(spark, sf_dir))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = _staged(spark, sf_dir, lambda s: _set(_asked(s), "threshold", threshold=0.1))[1]
    return counters.select("query_id", "trees", "trees_kept", "pairs_scored", "hits")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(staged.probes(search.tree_bounds(_library(spark, sf_dir)[2], _envelopes(spark, sf_dir))), "bound")


def _tree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectra = _library(spark, sf_dir)[1]
    return staged.candidate_trees(_set(_asked(spectra, True), policy="include_unknown"), prepare.trees(_members(spark, sf_dir)))


def _leaf_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, q = _index(spark, sf_dir)
    return _rounded(search.node_bounds(q, held.leaves, "ion_mode", "tree_id", "leaf_id"), "bound")


def _bound_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a bound is under what it bounds: never."""
    held, q = _index(spark, sf_dir)
    return staged.chain(q, held)


def _check(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _ = _index(spark, sf_dir)
    return index.check(held.members, held.trees, held.zero, held.spectra, held.roots, held.leaves)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _ = _index(spark, sf_dir)
    path = tables.new_path(spark, "snapshot")
    snapshot.save(held, path)
    again, manifest = snapshot.load(spark, path)
    same = snapshot.matches(manifest, held.peaks, held.spectra)
    return again.members.groupBy("ion_mode", "tree_id").agg(F.count("*").alias("n")).join(again.roots.groupBy("ion_mode", "tree_id").agg(F.count("*").alias("cells")), ["ion_mode", "tree_id"]).withColumn("same", F.lit(same))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = fixtures.event_peaks(spark, sf_dir).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("mass", "peak_id", "intensity"))).alias("p"))
    spectra = fixtures.event_spectra(spark, sf_dir).join(peaks, "row").withColumn("charge", (F.col("row") % 5 - 2).cast("int"))
    path = tables.new_path(spark, "mgf")
    mgf.write(spectra.withColumn("peaks", F.transform("p", lambda x: F.struct(x["mass"].alias("mass"), x["intensity"].alias("intensity")))), path)
    good, _ = mgf.read(spark, path)
    return good.select("external_id", "precursor_mz", "charge", "ion_mode", F.posexplode("peaks").alias("peak_id", "p")).select("external_id", "precursor_mz", "charge", "ion_mode", "peak_id", "p.mass", "p.intensity")


#: Records of each kind, and what becomes of them.
RECORDS = [
    ("TITLE=a\nPEPMASS=300.5 9\nCHARGE=2+\nIONMODE=pos\n100 1\n200 2", "a", None), ("PEPMASS=1\n100 1", None, "missing_external_id"), ("TITLE=c\nPEPMASS=x\n100 1", "c", "unparseable"),
    ("TITLE=d\nCHARGE=2+-\n100 1", "d", "unparseable"), ("TITLE=e\n100 nan", "e", "non_finite_intensity"), ("TITLE=f\n-1 5", "f", "non_positive_mz"), ("TITLE=g\ninf 5", "g", "non_finite_mz"),
    ("TITLE=h\n100 -5", "h", "negative_intensity"), ("TITLE=i\n100 1 2\n5", "i", None), ("TITLE=k\n100 1 2", "k", "unparseable"), ("TITLE=j\nCHARGE=-3 and 2+", "j", None),
]


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.new_path(spark, "mgf")
    text = "\n".join(f"BEGIN IONS\n{r}\nEND IONS" for r, _, _ in RECORDS) + "\nBEGIN IONS\nTITLE=z\n100 1"
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(path)
    good, bad = mgf.read(spark, path)
    return good.select("record_index", "external_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("record_index", "external_id", "reason"))


def _entropy(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    p = entropy.weighted(entropy.merged(fixtures.event_peaks(spark, sf_dir), 2 * search.TOLERANCE))
    return entropy.similarities(p.where(F.col("row") % EVERY == 0).withColumnRenamed("row", "query_id"), p, **how)


def _others(hits: DataFrame, k: int) -> DataFrame:
    """The k best but for the query itself, from what may be among the k + 1 best."""
    return search.top_k(hits.where("query_id <> spectrum_index"), k)


def _entropy_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_others(_entropy(spark, sf_dir, spectra=_library(spark, sf_dir)[1], k=11), 10), "rank")


def _binned_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks, spectra, q = _library(spark, sf_dir)
    return _others(search.binned(q, peaks, spectra=spectra, k=11), 10)


def _paired(df: DataFrame) -> DataFrame:
    return _rounded(df.select("query_id", F.col("spectrum_index").alias("row"), "score", F.col("n_matched").cast("long").alias("n_matched")), "score")


def _both_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks, _, q = _library(spark, sf_dir)
    return search.both_scores(q, peaks)


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fixtures.event_peaks(spark, sf_dir).groupBy("row").agg(F.count("*").alias("n_peaks"))
    return fixtures.event_spectra(spark, sf_dir).join(n, "row")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which spectra cleaning keeps, with the reason of the others."""
    spectra = fixtures.event_spectra(spark, sf_dir)
    good, bad = prepare.clean_library(spectra, fixtures.event_peaks(spark, sf_dir), mz=(60.0, 62.0), relative=0.05, most=40, least=3)
    return good.groupBy("row").agg(F.count("*").alias("n_peaks")).select("row", "n_peaks", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("row", F.lit(0).cast("long").alias("n_peaks"), "reason"))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.event_spectra(spark, sf_dir).withColumn("charge", (F.col("row") % 5 - 2).cast("int"))
    return prepare.clean_metadata(raw)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks, _, q = _library(spark, sf_dir)
    return _paired(search.binned(q, peaks))


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks, _, q = _library(spark, sf_dir)
    return _rounded(metrics.confusion(search.agreement(q, peaks, 0.1), "truth", "said", "n"), "precision", "recall", "f1", "accuracy")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "search_topk": _top(),
        "search_topk_exact_mode": _top(policy="exact"),
        "search_topk_include_unknown": _top(policy="include_unknown"),
        "search_topk_window": _top(window=True),
        "search_min_matched": _top(min_matched=3),
        "search_exhaustive": lambda s, d: _shown(_hits(s, d, min_matched=0)),
        "search_threshold": _over(0.1),
        "tolerance_edges": lambda s, d: _rounded(_edges(s, d), "w"),
        "spectrum_bounds": lambda s, d: _rounded(search.spectrum_bounds(_edges(s, d)), "bound"),
        "tree_bounds": lambda s, d: _rounded(search.tree_bounds(_library(s, d)[2], _envelopes(s, d)), "bound"),
        "normalise": lambda s, d: _rounded(_library(s, d)[0], "v", "norm"),
        "clean": lambda s, d: _rounded(prepare.clean(fixtures.event_peaks(s, d), (50.0, 95.0), 0.01, 40, 3), "intensity"),
        "cells": lambda s, d: _rounded(prepare.cells(_library(s, d)[0]), "energy"),
        "index_members": _members,
        "index_trees": lambda s, d: prepare.trees(_members(s, d)),
        "tree_envelopes": lambda s, d: _rounded(_envelopes(s, d), "amp"),
        "binned_scores": _binned,
        "bound_confusion": _confusion,
        "search_pruned_topk": _pruned(lambda s: _set(_asked(s)), "rank"),
        "search_pruned_threshold": _pruned(lambda s: _set(_asked(s), "threshold", threshold=0.1)),
        "search_pruned_window": _pruned(lambda s: _set(_asked(s, True)), "rank"),
        "search_mixed_queries": _pruned(_mixed, "rank"),
        "search_zero_supplement": _pruned(lambda s: _set(_asked(s), policy="exact", k=60, min_matched=0), "rank"),
        "prune_stats": _stats,
        "probe_trees": _probes,
        "tree_filter": _tree_filter,
        "index_leaves": lambda s, d: _index(s, d)[0].members,
        "leaf_envelopes": lambda s, d: _rounded(_index(s, d)[0].leaves, "amp"),
        "leaf_bounds": _leaf_bounds,
        "bound_chain": _bound_chain,
        "index_check": _check,
        "partition_counts": lambda s, d: index.partition_counts(_members(s, d)),
        "zero_members": lambda s, d: index.zero_members(_library(s, d)[1], prepare.cells(_library(s, d)[0].where("row % 7 <> 0"))).select("row", "external_id"),
        "library_fingerprint": lambda s, d: index.fingerprint(*_library(s, d)[:2]),
        "snapshot_round_trip": _round_trip,
        "mgf_round_trip": _written,
        "mgf_rejects": _rejects,
        "clean_library": _cleaned,
        "clean_metadata": _metadata,
        "sqrt_reweight": lambda s, d: _rounded(prepare.reweighted(_library(s, d)[0], 0.5), "v"),
        "power_transform": lambda s, d: _rounded(prepare.normalise(fixtures.event_peaks(s, d), 0.5, 1.0), "v", "norm"),
        "raw_intensity": lambda s, d: _rounded(prepare.denormalised(_library(s, d)[0]), "intensity"),
        "peak_counts": lambda s, d: _counted(s, d).select("row", "n_peaks"),
        "spectrum_at": lambda s, d: _rounded(_library(s, d)[0].where("row = 40"), "v", "norm"),
        "entropy_weights": lambda s, d: _rounded(entropy.weighted(entropy.merged(fixtures.event_peaks(s, d), 2 * search.TOLERANCE)), "mass", "v"),
        "entropy_similarity": lambda s, d: _paired(_entropy(s, d)),
        "entropy_topk": _entropy_top,
        "stratified_sample": lambda s, d: sample.stratified(_counted(s, d), 60),
        "query_sample": lambda s, d: sample.queries(_counted(s, d), 30),
        "row_slice": lambda s, d: sample.sliced(fixtures.event_spectra(s, d), s.range(200).select(F.col("id").alias("position"), (F.col("id") * 7 % 90).alias("row"))),
        "query_problems": lambda s, d: validate.queries(_library(s, d)[0].withColumn("v", F.when(F.col("row") % 3 == 0, F.col("v") * 2).when(F.col("row") % 3 == 1, -F.col("v")).otherwise(F.col("v"))).withColumnRenamed("row", "query_id")),
        "setting_problems": lambda s, d: validate.settings(_mixed(_library(s, d)[1]).withColumn("k", F.col("k") - 4).withColumn("tolerance", F.col("tolerance") - 0.01)),
        "pairwise_errors": lambda s, d: _rounded(metrics.pairwise(_both_scores(s, d), "score", "other", "same", "n"), "max_error", "mae", "rmse", "p50", "p95", "p99", "match_rate"),
        "rank_correlation": lambda s, d: _rounded(metrics.correlations(_both_scores(s, d), "score", "other", "n"), "pearson", "spearman"),
        "hit_overlap": lambda s, d: _rounded(metrics.hit_overlap(_top()(s, d), _binned_hits(s, d)), "recall", "jaccard", "overlap"),
        "outcome_diff": lambda s, d: _rounded(metrics.outcome_diff(_top()(s, d), _shown(_binned_hits(s, d), "rank")), "mean_recall", "max_error", "mean_error", "hit_count_match_rate"),
        "pruning_diff": lambda s, d: _rounded(metrics.outcome_diff(_top()(s, d), _pruned(lambda x: _set(_asked(x)), "rank")(s, d)), "mean_recall", "max_error", "mean_error", "hit_count_match_rate"),
        "latency_stats": lambda s, d: _rounded(metrics.latency(s.read.parquet(f"{d}/events.parquet"), "value"), "mean", "std", "p50", "p95", "p99"),
        "power_law": lambda s, d: _rounded(metrics.power_law(s.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_extendedprice"), "slope", "intercept", "r2"),
    }


_BASE = """with recursive peaks as (
    select user_id as row, (row_number() over (partition by user_id order by mass, event_id) - 1)::int as peak_id, mass, intensity
    from (select *, 50.0::double + ((event_id * 7919) % 50000) / 1000.0::double as mass, greatest(value, 0.0::double) as intensity from events)),
norms as (select row, sqrt(sum(intensity * intensity)) as norm from peaks group by row),
lib as (select row, peak_id, mass, case when norm > 0 then intensity / norm else 0 end as v, norm from peaks join norms using (row)),
spectra as (select distinct user_id as row, 'U' || lpad(user_id::varchar, 6, '0') as external_id,
    case when user_id % 17 <> 0 then 100.0::double + user_id * 0.5::double end as precursor_mz, ['positive', 'negative', 'unknown'][user_id % 3 + 1] as ion_mode from events),
edges as (select q.row as query_id, l.row, q.peak_id as q_peak, l.peak_id as l_peak, q.v * l.v as w
    from lib q join lib l on l.mass between q.mass - 0.02::double and q.mass + 0.02::double where q.row % 20 = 0 and q.v > 0 and l.v > 0),
ranked as (select *, row_number() over (partition by query_id, row order by w desc, q_peak, l_peak) as k from edges),
rounds as (select query_id, row, q_peak, l_peak, w, k, false as ok from ranked
    union all
    select query_id, row, q_peak, l_peak, w, k, k = min(k) over (partition by query_id, row, q_peak) and k = min(k) over (partition by query_id, row, l_peak)
    from (select *, bool_or(ok) over (partition by query_id, row, q_peak) or bool_or(ok) over (partition by query_id, row, l_peak) as dead from rounds) where not dead),
scored as (select query_id, row, case when abs(sum(w) - 1) <= 1e-12 or sum(w) > 1 then 1.0 else sum(w) end as score, count(*) as n_matched from rounds where ok group by all),
live as (select * from spectra s where exists (select 1 from lib where lib.row = s.row and v > 0)),
members as (select row, external_id, ion_mode, (row_number() over (partition by ion_mode order by precursor_mz nulls last, external_id, row) - 1) // 64 as tree_id, precursor_mz from live),
envelopes as (select ion_mode, tree_id, floor((mass + 1e-12) / 0.02::double)::bigint as cell, max(v) * (1 + 1e-12::double) as amp from lib join members using (row) where v > 0 group by all),
bounds as (select query_id, row, sum(w) * (1 + 1e-12::double) as bound from (select query_id, row, q_peak, max(w) as w from edges group by all) group by all)
"""
_PAIRS = """select q.row as query_id, s.external_id, s.row as spectrum_index, round(coalesce(x.score, 0), 9) as score, coalesce(x.n_matched, 0) as n_matched
from spectra q join spectra s on q.row % 20 = 0 and q.row <> s.row {join} scored x on x.query_id = q.row and x.row = s.row where {where}"""


def _sql_top(where: str = "true", join: str = "join", k: str = "10") -> str:
    pairs = _PAIRS.format(join=join, where=where)
    return f"{_BASE} select * from (select query_id, row_number() over (partition by query_id order by score desc, external_id, spectrum_index) as rank, external_id, spectrum_index, score, n_matched from ({pairs})) where rank <= {k}"


_RANK = "row_number() over (partition by query_id order by score desc, external_id, spectrum_index) as rank"
_MIXED = f"""{_BASE.replace("q.mass - 0.02::double and q.mass + 0.02::double", "q.mass - case when q.row % 60 = 0 then 0.01::double else 0.02::double end and q.mass + case when q.row % 60 = 0 then 0.01::double else 0.02::double end")},
    pairs as ({_PAIRS.format(join="join", where="""x.n_matched >= 1 + q.row % 2 and (q.row % 3 = 0 or s.ion_mode = q.ion_mode or (q.row % 3 = 2 and s.ion_mode = 'unknown'))
        and (q.row % 100 <> 20 or coalesce(abs(s.precursor_mz - (100.0::double + q.row * 0.5::double)) <= 20, false))""")})
    select * from (select *, {_RANK} from pairs) where case when query_id % 40 = 0 then score >= 0.08::double - 1e-12 else rank <= 3 + query_id % 7 end"""
_BINNED = """, bins as (select row, floor(mass / 0.001::double + 0.5)::bigint as bin, v from lib), lb as (select row, bin, sum(v) as v, count(*) as c from bins group by all),
    qb as (select row as query_id, bin + d as bin, sum(v) as u from bins, range(-20, 21) t(d) where row % 20 = 0 group by all),
    binned as (select query_id, row, least(sum(u * v), 1.0::double) as other, sum(c)::bigint as n_other from qb join lb using (bin) group by all),
    both_scores as (select query_id, row, round(score, 9) as score, round(other, 9) as other, n_matched, n_other from scored join binned using (query_id, row))"""
_TREE_BOUNDS = """, tree_bounds as (select query_id, ion_mode, tree_id, sum(b) * (1 + 1e-12::double) as bound from (
    select q.row as query_id, e.ion_mode, e.tree_id, q.peak_id, max(q.v * e.amp) as b from lib q join envelopes e
    on e.cell between floor((q.mass - 0.02::double) / 0.02::double) - 1 and floor((q.mass + 0.02::double) / 0.02::double) + 1 where q.row % 20 = 0 and q.v > 0 group by all) group by all)"""
_ENTROPY = """, e1 as (select *, case when lag(mass) over w is null or mass - lag(mass) over w > 0.04::double then 1 else 0 end as new from peaks where intensity > 0 window w as (partition by row order by mass, peak_id)),
    e2 as (select *, sum(new) over (partition by row order by mass, peak_id) as run from e1),
    e3 as (select row, (run - 1)::int as peak_id, sum(mass * intensity) / sum(intensity) as mass, sum(intensity) as intensity from e2 group by row, run),
    e4 as (select *, intensity / sum(intensity) over (partition by row) as p from e3), e5 as (select *, -sum(p * ln(p)) over (partition by row) as s from e4),
    e6 as (select *, case when s < 3 then p ** (0.25::double + 0.25::double * s) else p end as x from e5), ent as (select row, peak_id, mass, x / sum(x) over (partition by row) as v from e6),
    entropy as (select q.row as query_id, l.row, least(greatest(sum(((q.v + l.v) * log2(q.v + l.v) - q.v * log2(q.v) - l.v * log2(l.v)) / 2), 0), 1) as score, count(*) as n_matched
        from ent q join ent l on l.mass between q.mass - 0.02::double and q.mass + 0.02::double where q.row % 20 = 0 group by all)"""
_COUNTED = ", counted as (select s.*, n_peaks from spectra s join (select row, count(*) as n_peaks from peaks group by all) using (row))"
#: Hits of the exact and of the binned scorer, the best ten.
_TOPS = f"""{_BINNED}, exact_hits as (select * from (select query_id, spectrum_index, score, {_RANK} from ({_PAIRS.format(join="join", where="true")})) where rank <= 10),
    binned_hits as (select * from (select query_id, spectrum_index, score, {_RANK} from (select query_id, b.row as spectrum_index, external_id, round(other, 9) as score from binned b join spectra s using (row) where query_id <> b.row)) where rank <= 10)"""
_DIFF = """, pairs as (select query_id, a.score as x, b.score as y from exact_hits a full join {other} b using (query_id, spectrum_index)),
    n as (select query_id, count(x) as a, count(y) as b, count_if(x is not null and y is not null) as i, sum(abs(x - y)) as s, max(abs(x - y)) as most from pairs group by all)
    select count(*) as n_queries, sum(a - i)::bigint as false_dismissals, round(avg(case when a > 0 then i / a else 1 end), 9) as mean_recall, round(coalesce(max(most), 0), 9) as max_error,
    round(coalesce(sum(s) / sum(i), 0), 9) as mean_error, round(count_if(a = b) / count(*), 9) as hit_count_match_rate from n"""


def oracle_sql() -> dict[str, str]:
    return {
        "search_topk": _sql_top(),
        "search_topk_exact_mode": _sql_top("s.ion_mode = q.ion_mode"),
        "search_topk_include_unknown": _sql_top("s.ion_mode = q.ion_mode or s.ion_mode = 'unknown'"),
        "search_topk_window": _sql_top("q.precursor_mz is null or coalesce(abs(s.precursor_mz - q.precursor_mz) <= 20, false)"),
        "search_min_matched": _sql_top("x.n_matched >= 3"),
        "search_exhaustive": _BASE + _PAIRS.format(join="left join", where="true"),
        "search_threshold": _BASE + _PAIRS.format(join="join", where="x.score >= 0.1::double - 1e-12"),
        "tolerance_edges": _BASE + "select query_id, row, q_peak, l_peak, round(w, 9) as w from edges",
        "spectrum_bounds": _BASE + "select query_id, row, round(bound, 9) as bound from bounds",
        "tree_bounds": _BASE + """select query_id, ion_mode, tree_id, round(sum(b) * (1 + 1e-12::double), 9) as bound from (
            select q.row as query_id, e.ion_mode, e.tree_id, q.peak_id, max(q.v * e.amp) as b from lib q join envelopes e
            on e.cell between floor((q.mass - 0.02::double) / 0.02::double) - 1 and floor((q.mass + 0.02::double) / 0.02::double) + 1 where q.row % 20 = 0 and q.v > 0 group by all) group by all""",
        "normalise": _BASE + "select row, peak_id, mass, round(v, 9) as v, round(norm, 9) as norm from lib",
        "clean": _BASE + """, a as (select *, max(intensity) over (partition by row) as top from peaks where mass between 50 and 95),
            b as (select *, row_number() over (partition by row order by intensity desc, mass, peak_id) as r from a where intensity >= 0.01::double * top),
            c as (select *, count(*) over (partition by row) as n from b where r <= 40)
            select row, (row_number() over (partition by row order by mass, peak_id) - 1)::int as peak_id, mass, round(intensity / top, 9) as intensity from c where n >= 3""",
        "cells": _BASE + "select row, floor((mass + 1e-12) / 0.02::double)::bigint as cell, round(sum(v * v), 9) as energy from lib group by all having sum(v * v) > 0",
        "index_members": _BASE + "select * from members",
        "index_trees": _BASE + "select ion_mode, tree_id, min(precursor_mz) as prec_min, max(precursor_mz) as prec_max, count(*) as n from members group by all",
        "tree_envelopes": _BASE + "select ion_mode, tree_id, cell, round(amp, 9) as amp from envelopes",
        "binned_scores": _BASE + """, bins as (select row, floor(mass / 0.001::double + 0.5)::bigint as bin, v from lib),
            lb as (select row, bin, sum(v) as v, count(*) as c from bins group by all),
            qb as (select row as query_id, bin + d as bin, sum(v) as u from bins, range(-20, 21) t(d) where row % 20 = 0 group by all)
            select query_id, row, round(least(sum(u * v), 1.0::double), 9) as score, sum(c)::bigint as n_matched from qb join lb using (bin) group by all""",
        "bound_confusion": _BASE + """, n as (select count_if(score >= 0.1 and bound >= 0.1) as tp, count_if(score < 0.1 and bound >= 0.1) as fp, count_if(score >= 0.1 and bound < 0.1) as fn,
            count_if(score < 0.1 and bound < 0.1) as tn from scored join bounds using (query_id, row))
            select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(case when tp + fp > 0 then tp / (tp + fp) else 1 end, 9) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 1 end, 9) as recall,
            round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 9) as f1, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy from n""",
        "search_pruned_topk": _sql_top(),
        "search_pruned_threshold": _BASE + _PAIRS.format(join="join", where="x.score >= 0.1::double - 1e-12"),
        "search_pruned_window": _sql_top("q.precursor_mz is null or coalesce(abs(s.precursor_mz - q.precursor_mz) <= 20, false)"),
        "search_mixed_queries": _MIXED,
        "search_zero_supplement": _sql_top("s.ion_mode = q.ion_mode", "left join", "60"),
        "prune_stats": f"""{_BASE}{_TREE_BOUNDS} select query_id, trees, trees_kept, coalesce(pairs_scored, 0) as pairs_scored, coalesce(hits, 0) as hits
            from (select query_id, count(*) as trees, count_if(bound >= 0.1::double - 1e-12) as trees_kept from tree_bounds group by all)
            left join (select query_id, count_if(bound >= 0.1::double - 1e-12) as pairs_scored from bounds where query_id <> row group by all) using (query_id)
            left join (select query_id, count_if(score >= 0.1::double - 1e-12) as hits from scored where query_id <> row group by all) using (query_id)""",
        "probe_trees": f"{_BASE}{_TREE_BOUNDS} select * from (select query_id, ion_mode, tree_id, round(bound, 9) as bound, row_number() over (partition by query_id order by round(bound, 9) desc, ion_mode, tree_id) as place from tree_bounds) where place <= 3",
        "tree_filter": f"""{_BASE}, trees as (select ion_mode, tree_id, min(precursor_mz) as lo, max(precursor_mz) as hi from members group by all) select q.row as query_id, t.ion_mode, tree_id from spectra q join trees t
            on q.row % 20 = 0 and (t.ion_mode = q.ion_mode or t.ion_mode = 'unknown') and (q.precursor_mz is null or coalesce(hi >= q.precursor_mz - 20 and lo <= q.precursor_mz + 20, false))""",
        "bound_chain": _BASE + "select count(*) as pairs, 0::bigint as score_over_pair, 0::bigint as pair_over_leaf, 0::bigint as leaf_over_root from scored",
        "index_check": "select name, 0::bigint as violations from (values ('rows_missing'), ('rows_unknown'), ('rows_twice'), ('precursor_not_covered'), ('tree_size'), ('leaf_size'), ('leaf_over_root')) t(name)",
        "partition_counts": _BASE + "select ion_mode, count(*) as members, count(distinct tree_id) as trees from members group by all",
        "zero_members": _BASE + "select row, external_id from spectra s where not exists (select 1 from lib where lib.row = s.row and v > 0 and row % 7 <> 0)",
        "library_fingerprint": _BASE + """select * from (select count(*) as n_spectra, sum(('0x' || substr(md5(concat_ws(':', row, external_id, ion_mode, coalesce(round(precursor_mz * 1e6)::bigint::varchar, '-'))), 1, 8))::bigint)::bigint as spectrum_sum from spectra),
            (select count(*) as n_peaks, sum(('0x' || substr(md5(concat_ws(':', row, peak_id, round(mass * 1e6)::bigint, round(v * 1e6)::bigint)), 1, 8))::bigint)::bigint as peak_sum from lib)""",
        "snapshot_round_trip": _BASE + "select *, true as same from (select ion_mode, tree_id, count(*) as n from members group by all) join (select ion_mode, tree_id, count(*) as cells from envelopes group by all) using (ion_mode, tree_id)",
        "mgf_round_trip": _BASE + """select external_id, precursor_mz, (row % 5 - 2)::int as charge, ion_mode, (row_number() over (partition by row order by mass, peak_id) - 1)::int as peak_id, mass, intensity
            from peaks join spectra using (row) where intensity > 0""",
        "mgf_rejects": "select * from (values " + ", ".join(f"({i}::bigint, {repr(n) if n else 'null'}, {repr(w) if w else 'null'})" for i, (_, n, w) in enumerate([*RECORDS, ("", "z", "unterminated")])) + ") t(record_index, external_id, reason)",
        "clean_library": _BASE + """, a as (select *, max(intensity) over (partition by row) as top from peaks where mass between 60 and 62),
            b as (select row, least(count(*), 40) as n from a where intensity >= 0.05::double * top group by all)
            select row, case when n >= 3 then n else 0 end as n_peaks, case when coalesce(n, 0) < 3 then 'unparseable' end as reason from (select row, coalesce(n, 0)::bigint as n from spectra left join b using (row))""",
        "clean_metadata": _BASE + """select row, external_id, precursor_mz, ion_mode, case when ion_mode = 'positive' then abs(c) when ion_mode = 'negative' then -abs(c) else c end::int as charge
            from (select *, nullif(row % 5 - 2, 0) as c from (select row, external_id, precursor_mz, case when ion_mode = 'unknown' and row % 5 - 2 > 0 then 'positive' when ion_mode = 'unknown' and row % 5 - 2 < 0 then 'negative' else ion_mode end as ion_mode from spectra))""",
        "sqrt_reweight": _BASE + "select row, peak_id, mass, round(case when s > 0 then sqrt(v * norm) / sqrt(s) else 0 end, 9) as v from (select *, sum(v * norm) over (partition by row) as s from lib)",
        "power_transform": _BASE + """, y as (select *, sqrt(intensity) * mass as y from peaks), n as (select *, sqrt(sum(y * y) over (partition by row)) as n from y)
            select row, peak_id, mass, round(case when n > 0 then y / n else 0 end, 9) as v, round(n, 9) as norm from n""",
        "raw_intensity": _BASE + "select row, peak_id, mass, round(v * norm, 9) as intensity from lib",
        "peak_counts": _BASE + "select row, count(*) as n_peaks from peaks group by all",
        "spectrum_at": _BASE + "select row, peak_id, mass, round(v, 9) as v, round(norm, 9) as norm from lib where row = 40",
        "entropy_weights": f"{_BASE}{_ENTROPY} select row, peak_id, round(mass, 9) as mass, round(v, 9) as v from ent",
        "entropy_similarity": f"{_BASE}{_ENTROPY} select query_id, row, round(score, 9) as score, n_matched from entropy",
        "entropy_topk": f"{_BASE}{_ENTROPY} select * from (select *, {_RANK} from (select query_id, external_id, e.row as spectrum_index, round(score, 9) as score, n_matched from entropy e join spectra s using (row) where query_id <> e.row)) where rank <= 10",
        "stratified_sample": f"""{_BASE}{_COUNTED}, s as (select *, case when n_peaks < 50 then 0 when n_peaks < 150 then 1 when n_peaks < 500 then 2 else 3 end as stratum, sha256('sample:' || external_id) as h from counted),
            r as (select *, row_number() over (partition by stratum order by h, row) > floor(60 / (select count(distinct stratum) from s)) as late from s) select row, external_id, n_peaks, stratum from r order by late, h, row limit 60""",
        "query_sample": f"{_BASE}{_COUNTED} select row, external_id, n_peaks from counted order by precursor_mz is null or n_peaks < 5, sha256('query:' || external_id), row limit 30",
        "row_slice": _BASE + "select s.*, row_number() over (order by position) - 1 as new_row from spectra s join (select i * 7 % 90 as row, min(i) as position from range(200) t(i) group by all) using (row)",
        "query_problems": _BASE + "select row as query_id, case when sum(v) = 0 then 'norm is zero' when row % 3 = 0 then 'norm is not 1' else 'value is negative' end as problem from lib where row % 3 < 2 group by row",
        "setting_problems": _BASE + """select row as query_id, case when row % 40 <> 0 and 3 + row % 7 - 4 <= 0 then 'k is not above 0' else 'tolerance is not above 0' end as problem from spectra
            where row % 20 = 0 and ((row % 40 <> 0 and 3 + row % 7 - 4 <= 0) or row % 60 = 0)""",
        "pairwise_errors": f"""{_BASE}{_BINNED} select count(*) as n_pairs, round(max(d), 9) as max_error, round(avg(d), 9) as mae, round(sqrt(avg(d * d)), 9) as rmse, round(quantile_cont(d, 0.5), 9) as p50, round(quantile_cont(d, 0.95), 9) as p95,
            round(quantile_cont(d, 0.99), 9) as p99, round(count_if(n_matched = n_other) / count(*), 9) as match_rate, count_if(d > 1e-6) as discrepant from (select *, abs(score - other) as d from both_scores)""",
        "rank_correlation": f"""{_BASE}{_BINNED}, r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as a, rank() over (order by other) + (count(*) over (partition by other) - 1) / 2 as b from both_scores)
            select count(*) as n, round(corr(score, other), 9) as pearson, round(corr(a, b), 9) as spearman from r""",
        "hit_overlap": f"""{_BASE}{_TOPS}, n as (select query_id, count(a.rank) as a, count(b.rank) as b, count_if(a.rank is not null and b.rank is not null) as i, count(*) as u, count_if(a.rank = 1 and b.rank = 1) as top
            from exact_hits a full join binned_hits b using (query_id, spectrum_index) group by all)
            select query_id, round(case when a > 0 then i / a when b > 0 then 0 else 1 end, 9) as recall, round(i / u, 9) as jaccard, round(case when least(a, b) > 0 then i / least(a, b) else 0 end, 9) as overlap, top > 0 as top1 from n""",
        "outcome_diff": _BASE + _TOPS + _DIFF.format(other="binned_hits"),
        "pruning_diff": _BASE + _TOPS + _DIFF.format(other="exact_hits"),
        "latency_stats": "select round(avg(value), 9) as mean, round(stddev_pop(value), 9) as std, round(quantile_cont(value, 0.5), 9) as p50, round(quantile_cont(value, 0.95), 9) as p95, round(quantile_cont(value, 0.99), 9) as p99, min(value) as least, max(value) as most from events",
        "power_law": "select round(regr_slope(log10(l_extendedprice), log10(l_quantity)), 9) as slope, round(regr_intercept(log10(l_extendedprice), log10(l_quantity)), 9) as intercept, round(regr_r2(log10(l_extendedprice), log10(l_quantity)), 9) as r2 from lineitem",
    }
