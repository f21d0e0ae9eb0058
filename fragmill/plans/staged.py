"""Staged search: bounds of trees, bounds of leaves, bounds of pairs, and only then exact scores.

All queries go through a stage together. A query's theta is its threshold, or, for the best k, the k-th score among the members
of the PROBE trees of highest bound; nothing under it can be a hit, and ties with it survive. A stage passes on only what reaches
theta. Pairs are worked on tile by tile (fragmill/operators/tiles.py), whole trees at a time: bounds of leaves, bounds of pairs and
scores are taken where the peaks are, and only a tile's best hits and its counts leave it. A query that zero scores are asked for can't be
pruned; it is searched without the stages, and its counters are 0 but for trees and hits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmill.operators import prepare, search, tiles
from fragmill.sources.tables import table

PROBE = 3
NODE = ["ion_mode", "tree_id"]
LEAF = [*NODE, "leaf_id"]


@dataclass
class Index:
    """members(row, external_id, ion_mode, tree_id, leaf_id, precursor_mz), trees, envelopes of trees and leaves, peaks, spectra and the rows without energy."""

    members: DataFrame
    trees: DataFrame
    roots: DataFrame
    leaves: DataFrame
    peaks: DataFrame
    spectra: DataFrame
    zero: DataFrame


def candidate_trees(queries: DataFrame, trees: DataFrame) -> DataFrame:
    """query_id, ion_mode, tree_id of the trees that may hold an eligible spectrum: by ion mode, and by the overlap of windows."""
    overlaps = F.coalesce((F.col("prec_max") >= F.col("pw_center") - F.col("pw_tol")) & (F.col("prec_min") <= F.col("pw_center") + F.col("pw_tol")), F.lit(False))
    return queries.join(trees, search.eligible(F.col("policy")) & (F.col("pw_center").isNull() | overlaps)).select("query_id", *NODE)


def root_bounds(queries: DataFrame, query_peaks: DataFrame, index: Index, tolerance: float) -> DataFrame:
    """query_id, ion_mode, tree_id, bound of the candidate trees that share a cell with the query."""
    return search.node_bounds(query_peaks, index.roots, *NODE, tolerance=tolerance).join(candidate_trees(queries, index.trees), ["query_id", *NODE], "left_semi")


def probes(bounds: DataFrame, most: int = PROBE) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("bound", 9)), *NODE)
    return bounds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)


def members(index: Index) -> DataFrame:
    """row, external_id, ion_mode, tree_id, precursor_mz, leaf, tree, p, m, v, c, a: members with their peaks and names of their nodes; the first of a leaf carries the leaf's envelope."""
    lead = index.members.groupBy(*LEAF).agg(F.min("row").alias("row")).join(tiles.enveloped(index.leaves, *LEAF), LEAF).select("row", "c", "a")
    tree = F.concat_ws(":", F.col("tree_id").cast("string"), "ion_mode")
    named = index.members.select("row", "external_id", "ion_mode", "tree_id", "precursor_mz", tree.alias("tree"), F.concat_ws(":", F.col("leaf_id").cast("string"), tree).alias("leaf"))
    return named.join(tiles.packed(index.peaks, "row"), "row", "left").join(lead, "row", "left")


def leaf_bounds(q: tiles.Side, held: tiles.Side, tolerance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bound of each query and leaf of the members, leaf of each member)."""
    leaf = np.unique(np.array(held.names("leaf"), str), return_inverse=True)[1]
    (cells, n), (amps, _) = tiles.flat(held.table, "c"), tiles.flat(held.table, "a")
    return tiles.node_bounds(q, tolerance, cells, amps, np.repeat(leaf, n), int(leaf.max(initial=-1)) + 1, prepare.GRID), leaf


def _probed(a: pa.Table, b: pa.Table) -> pa.Table:
    """All matched pairs of a tree and the queries that probe it."""
    q, held = tiles.Side(a, "query_id"), tiles.Side(b, "row")
    score, n, _ = tiles.cosine(q, held, q.column("tolerance"), tiles.passes(q, held))
    i, j = np.nonzero(n)
    return pa.table({"query_id": q.take("query_id", i), "external_id": held.take("external_id", j), "spectrum_index": held.take("row", j), "score": score[i, j], "n_matched": n[i, j]})


def _rest(a: pa.Table, b: pa.Table) -> pa.Table:
    """The pairs of whole trees that may be hits, and for each query a row of counts without a spectrum."""
    q, held = tiles.Side(a, "query_id"), tiles.Side(b, "row")
    own, theta = q.column("tolerance"), q.column("theta")
    alive = q.table.column("alive").to_pylist()
    trees = held.names("tree")
    at = {t: k for k, t in enumerate(dict.fromkeys(trees))}
    open_ = np.zeros((q.n, len(at)), bool)
    for i, names in enumerate(alive):
        open_[i, [at[t] for t in names if t in at]] = True
    bound, leaf = leaf_bounds(q, held, own)
    of_row = np.array([at[t] for t in trees], np.int64)
    tree_of = np.zeros(bound.shape[1], np.int64)
    tree_of[leaf] = of_row
    keep = (bound > 0) & ~(bound < theta[:, None]) & open_[:, tree_of]
    score, n, pair = tiles.cosine(q, held, own, keep[:, leaf] & tiles.passes(q, held))
    scored = (n > 0) & ~(pair < theta[:, None])
    i, j = tiles.leading(q, held, score, scored & (n >= q.column("min_matched")[:, None]))
    some = np.arange(q.n)
    none = pa.nulls(len(j), pa.int64())
    hits = {"query_id": q.take("query_id", i), "external_id": held.take("external_id", j), "spectrum_index": held.take("row", j), "score": pa.array(score[i, j]), "n_matched": pa.array(n[i, j]), "leaves_kept": none, "pairs_bounded": none, "pairs_scored": none}
    counts = {"query_id": q.take("query_id", some), "external_id": pa.nulls(q.n, pa.string()), "spectrum_index": pa.nulls(q.n, pa.int64()), "score": pa.nulls(q.n, pa.float64()), "n_matched": pa.nulls(q.n, pa.int32())}
    counts |= {"leaves_kept": pa.array(keep.sum(1)), "pairs_bounded": pa.array((n > 0).sum(1)), "pairs_scored": pa.array(scored.sum(1))}
    return pa.concat_tables([pa.table(hits), pa.table(counts)])


def staged(queries: DataFrame, query_peaks: DataFrame, index: Index, tolerance: float = search.TOLERANCE, probe: int = PROBE) -> tuple[DataFrame, DataFrame]:
    """(hits, counters): query_id, rank, external_id, spectrum_index, score, n_matched; and per query how many trees, leaves and pairs each stage passed on.

    queries has all settings as columns; tolerance is the largest of theirs. A query with min_matched 0 also gets eligible spectra
    without a match, with score 0, unless its threshold is above 0.
    """
    if "tolerance" in queries.columns:
        query_peaks = query_peaks.join(queries.select("query_id", "tolerance"), "query_id")
    else:
        queries = queries.withColumn("tolerance", F.lit(tolerance))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {search.HIT}"
    wanted = queries.select("query_id", "min_matched", "k", "threshold", F.col("mode").alias("how"))
    limits = {"k": F.when(F.col("mode") == "top_k", F.col("k")).cast("int"), "least": F.when(F.col("mode") == "threshold", F.col("threshold")).cast("double")}
    zero = F.coalesce(F.expr("min_matched = 0 and (mode = 'top_k' or threshold <= 0)"), F.lit(False))
    asked = queries.withColumns(limits)
    pruned, whole = asked.where(~zero), asked.where(zero)
    q = table(pruned.join(tiles.packed(query_peaks, "query_id"), "query_id", "left"), "asked")
    held = table(members(index), "held")

    bounds = table(root_bounds(queries, query_peaks, index, tolerance), "root-bounds")
    probed = probes(bounds.join(q.where("mode = 'top_k'").select("query_id"), "query_id", "left_semi"), probe).select("query_id", *NODE)
    probed = table(probed, "probes")
    first = table(tiles.tiled_by(q.join(probed, "query_id"), held.join(probed.select(*NODE).distinct(), NODE, "left_semi"), _probed, schema, *NODE), "probed")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    kth = first.join(wanted, "query_id").where("n_matched >= min_matched").withColumn("place", place).where("place = k").select("query_id", F.col("score").alias("kth"))
    theta = queries.join(kth, "query_id", "left").select("query_id", F.when(F.col("mode") == "threshold", F.col("threshold") - search.MARGIN).otherwise(F.coalesce("kth", F.lit(float("-inf")))).alias("theta"))
    theta = table(theta, "theta")
    alive = bounds.join(theta, "query_id").where(~(F.col("bound") < F.col("theta"))).join(probed, ["query_id", *NODE], "left_anti").join(q.select("query_id"), "query_id", "left_semi")
    alive = alive.select("query_id", *NODE)

    # Whole trees to a block; a query goes to the blocks where it has trees.
    n_q, n_trees = q.count(), index.trees.count()
    across, down = max(1, -(-n_q // tiles.QUERIES)), max(1, min(n_trees, max(-(-n_trees * prepare.TREE // tiles.ROWS), q.sparkSession.sparkContext.defaultParallelism)))
    whole_number = lambda n: F.lit(n).cast("long")
    block = F.pmod(F.xxhash64(*NODE), whole_number(down)).alias("_l")
    own = alive.groupBy("query_id", block).agg(F.collect_list(F.concat_ws(":", F.col("tree_id").cast("string"), "ion_mode")).alias("alive"))
    left = q.join(theta, "query_id").join(own, "query_id").withColumn("_q", F.pmod(F.xxhash64("query_id"), whole_number(across)))
    right = held.select("*", block).withColumn("_q", F.explode(F.sequence(whole_number(0), whole_number(across - 1))))
    counted = "leaves_kept long, pairs_bounded long, pairs_scored long"
    rest = table(tiles.tiled_by(left, right, _rest, f"{schema}, {counted}", "_q", "_l"), "pairs")

    best = first.join(wanted, "query_id").where("n_matched >= min_matched").select(*first.columns).unionByName(rest.where("spectrum_index is not null").select(*first.columns))
    scorer = lambda a, b, ok: tiles.cosine(a, b, a.column("tolerance"), ok)[:2]
    if whole.take(1):
        best = best.unionByName(search.scored(whole, query_peaks, index.peaks, index.spectra, scorer))
    hits = search.ranked(best).join(wanted, "query_id").where(F.when(F.col("how") == "top_k", F.col("rank") <= F.col("k")).otherwise(F.col("score") >= F.col("threshold") - search.MARGIN))
    hits = hits.select("query_id", "rank", "external_id", "spectrum_index", "score", "n_matched")
    count = lambda df, name, what="*": df.groupBy("query_id").agg(F.count(what).alias(name))
    pairs = first.select("query_id", F.lit(0).cast("long").alias("leaves_kept"), F.lit(1).cast("long").alias("pairs_bounded"), F.lit(1).cast("long").alias("pairs_scored"))
    pairs = pairs.unionByName(rest.where("spectrum_index is null").select(*pairs.columns)).groupBy("query_id").agg(*[F.sum(c).alias(c) for c in pairs.columns[1:]])
    counters = queries.select("query_id")
    for part in (count(bounds, "trees"), count(probed, "trees_probed"), count(alive, "trees_kept"), pairs, count(hits, "hits")):
        counters = counters.join(part, "query_id", "left")
    return hits, counters.fillna(0)


def chain(query_peaks: DataFrame, index: Index, tolerance: float = search.TOLERANCE) -> DataFrame:
    """pairs, score_over_pair, pair_over_leaf, leaf_over_root: how many pairs share a peak, and how often a bound is under what it bounds."""
    roots = index.members.groupBy(*NODE).agg(F.min("row").alias("row")).join(tiles.enveloped(index.roots, *NODE).withColumnsRenamed({"c": "root_c", "a": "root_a"}), NODE).select("row", "root_c", "root_a")

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        q, held = tiles.Side(a, "query_id"), tiles.Side(b, "row")
        own = np.full(q.n, tolerance)
        leaf, of = leaf_bounds(q, held, own)
        (cells, n), (amps, _) = tiles.flat(held.table, "root_c"), tiles.flat(held.table, "root_a")
        tree = np.unique(np.array(held.names("tree"), str), return_inverse=True)[1]
        root = tiles.node_bounds(q, own, cells, amps, np.repeat(tree, n), int(tree.max(initial=-1)) + 1, prepare.GRID)
        score, n, pair = tiles.cosine(q, held, own)
        leaf, root = leaf[:, of], root[:, tree]
        over = lambda x, y: int(((n > 0) & ~(x <= y + 1e-9)).sum())
        return pa.table({"pairs": [int((n > 0).sum())], "score_over_pair": [over(score, pair)], "pair_over_leaf": [over(pair, leaf)], "leaf_over_root": [over(leaf, root)]})

    names = ("pairs", "score_over_pair", "pair_over_leaf", "leaf_over_root")
    parts = tiles.tiled(tiles.packed(query_peaks, "query_id"), members(index).join(roots, "row", "left"), work, ", ".join(f"{c} long" for c in names), *NODE)
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
