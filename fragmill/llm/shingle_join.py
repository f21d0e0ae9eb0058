"""N-gram Jaccard join with a token-group matrix.

Equal shingle sets form one set. Sets that share a minimum under one of KEYS hash functions form a bucket; in each bucket a leader is
chosen, the set whose minima most others share (of a text and its edited copies, the text), and the sets are held against TRIES
leaders of their buckets. The components of the links so confirmed are the groups; other leaders are chosen from the larger groups
until that adds nothing, ROUNDS times at most. The matrix holds each group's tokens:
two sets at or above the threshold must share a token among the first n - ceil(n * 3 / 4) + 1 of each (in one order of all
tokens, common ones last), so two groups can only be linked if their prefix tokens meet, and often enough for their sizes; then the sets of
both are held against the other group in the same way. Of such a group the union of
all tokens is held against the set: only if it covers three quarters of the set is the group opened, and its members of
fitting size compared in full. Links inside a group can't change the components and aren't sought.

Shingles are compared by a 64-bit hash. Defined cases: null and blank texts have no shingles and no links; fewer than five words
form one shingle; equal rows fall in one set; a row with a null id links others, but is no row's component (of rows without any id the
component is null); ties between leaders go to the least set; extra columns, whatever their names, are ignored or kept; a text is
held in some 30 times its size while its shingles are made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, cut, documents, drop, mix, rolling
from .components import components

K, LEVEL = 5, 75
#: Hash functions, leaders that a set is held against in a round, and rounds.
KEYS, TRIES, ROUNDS = 12, 3, 2
#: Sets of a pair of groups, those that share most, that are compared in each step; at last all.
LEADING = (8, None)
#: Counters of the frequency sketch that orders tokens, and how many of them go in a row; its size doesn't depend on the corpus.
#: With far fewer counters than tokens all look alike, prefixes hold common tokens, and pairs of groups grow with the square of those.
SKETCH, SLICE = 1 << 22, 1 << 16
MEMO = 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_words: dict[bytes, int] = {}


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    if len(_words) > MEMO:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    get = _words.__getitem__
    return np.fromiter(map(get, words), U64, len(words))


def shingles(text: str | None, k: int = K) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    values = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not len(values):
        return values
    return np.unique(rolling(values, min(k, len(values))) + U64(0 if len(values) >= k else len(values)))


def _name(s: np.ndarray) -> int | None:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def _sets(df: DataFrame, schema: str, make) -> DataFrame:
    """df(key, text) through make(key column, list of shingle arrays), one Arrow batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_pydict(make(part.column(0), [shingles(t) for t in part.column(1).to_pylist()]))

    return df.mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*arrays, np.empty(0, U64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def _named(keys: list[pa.Array], sets: list[np.ndarray]) -> dict:
    mins = [np.array([mix(s ^ U64(pow(3, 20 + i, 1 << 64))).min() for i in range(KEYS)], U64) if len(s) else s for s in sets]
    return {"doc_id": keys[0], "u": keys[1], "s": pa.array(map(_name, sets), pa.int64()), "n": pa.array(map(len, sets), pa.int64()), "mins": _lists(mins)}


def _hashes(key: pa.Array, sets: list[np.ndarray]) -> dict:
    return {"s": pa.array(map(_name, sets), pa.int64()), "n": pa.array(map(len, sets), pa.int64()), "tokens": _lists(sets)}


def _first_pass(texts: DataFrame) -> DataFrame:
    """doc_id, u, s, n, mins of each row; and for each task and SLICE of the sketch a row of n = -1 and doc_id its place, whose counts are the task's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                np.add.at(counts, (np.concatenate(sets) & U64(SKETCH - 1)).astype(np.int64), 1)
                yield pa.RecordBatch.from_pydict(_named([part.column(0), part.column(1)], sets) | {"counts": pa.nulls(len(sets), pa.binary())})
        for place in range(SKETCH // SLICE):
            part = counts[place * SLICE : (place + 1) * SLICE]
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([place], pa.int64()), "u": none, "s": none, "n": pa.array([-1], pa.int64()), "mins": pa.nulls(1, pa.list_(pa.int64())), "counts": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    return texts.mapInArrow(run, "doc_id long, u long, s long, n long, mins array<long>, counts binary")


def _sketch(passed: DataFrame) -> np.ndarray:
    """How common tokens are: the binary logarithm of a hashed count, a byte for each of SKETCH counters."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total.setdefault(place, np.zeros(SLICE, np.int64))
                total[place] += np.frombuffer(zlib.decompress(part.as_py()), np.uint32)
        for place, counts in total.items():
            yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "common": pa.array([np.floor(np.log2(counts + 1)).astype(np.uint8).tobytes()], pa.binary())})

    rows = passed.where("n = -1").select("doc_id", "counts").repartition("doc_id").mapInArrow(summed, "place long, common binary").collect()
    out = np.zeros((SKETCH // SLICE, SLICE), np.uint8)
    for r in rows:
        out[r.place] = np.frombuffer(r.common, np.uint8)
    return out.ravel()


def _prefixes(texts: DataFrame, common: np.ndarray) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(common)

    def make(key: pa.Array, sets: list[np.ndarray]) -> dict:
        out = []
        for s in sets:
            order = np.lexsort((s, held.value[(s & U64(SKETCH - 1)).astype(np.int64)]))
            out.append(s[order[: len(s) - (-(-len(s) * LEVEL // 100)) + 1]] if len(s) else s)
        return {"s": pa.array(map(_name, sets), pa.int64()), "prefix": _lists(out)}

    return _sets(texts.select("u", "text"), "s long, prefix array<long>", make)


def _tokens(texts: DataFrame, sets: DataFrame, of: DataFrame) -> DataFrame:
    """(s, n, tokens) of the sets, from the text of one row of each. of(s, u)."""
    needed = cut(sets.distinct().join(of.select("s", "u"), "s"), "needed")
    found = _sets(texts.select("u", "text").join(needed.select("u"), "u", "left_semi"), "s long, n long, tokens array<long>", _hashes)
    out = cut(found.join(needed.select("s"), "s", "left_semi").dropDuplicates(["s"]), "tokens")
    drop(needed)
    return out


def _confirmed(pairs: DataFrame, texts: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are at or above the threshold."""
    pairs = cut(pairs, "pairs")
    tokens = _tokens(texts, pairs.select(F.col("a").alias("s")).union(pairs.select("b")), of)
    both = pairs.join(tokens.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
    both = both.join(tokens.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    links = cut(both.select("a", "b", "na", "nb", common.alias("i")).where(100 * F.col("i") >= LEVEL * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b"), "links")
    drop(tokens, pairs)
    return links


def _fits(a: str, b: str):
    return (100 * F.least(a, b) >= LEVEL * F.greatest(a, b))


def _stars(keyed: DataFrame, turn: int) -> DataFrame:
    """(a, b): sets with the leaders that they share most minima with, from keyed(s, n, g, size, f, key); none inside a group."""
    buckets = keyed.groupBy("f", "key").agg(F.count("*").alias("c"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("f", "key", "c")
    met = cut(keyed.join(buckets, ["f", "key"]), "bucketed")
    # At first the set that most meet, later any of the largest group: another one in each turn and bucket.
    weight = met.groupBy("s").agg(F.sum("c").alias("w")) if turn == 0 else None
    weighed = met.join(weight, "s") if turn == 0 else met.withColumn("w", F.xxhash64("s", "f", F.lit(turn)))
    lead = weighed.groupBy("f", "key").agg(F.max(F.struct("size", "w", (-F.col("s")).alias("m"), "n", "g")).alias("x"))
    lead = lead.select("f", "key", (-F.col("x.m")).alias("b"), F.col("x.n").alias("nb"), F.col("x.g").alias("gb"))
    star = met.join(lead, ["f", "key"]).where((F.col("g") != F.col("gb")) & _fits("n", "nb")).groupBy(F.col("s").alias("a"), "b").agg(F.count("*").alias("c"))
    # At most KEYS leaders of each set.
    best = star.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("c", "b")), False).alias("x")).select("a", F.explode(F.slice("x", 1, TRIES)).alias("x")).select("a", "x.b")
    out = cut(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    drop(met)
    return out


def _groups(of: DataFrame, texts: DataFrame) -> DataFrame:
    """(s, n, g): the sets with their groups, which are components of confirmed links."""
    keyed = cut(of.select("s", "n", F.posexplode("mins").alias("f", "key")), "keyed")
    group, links, tried = of.select("s", "n", F.col("s").alias("g")), None, None
    for turn in range(ROUNDS):
        sized = group.select("s", "g").join(group.groupBy("g").agg(F.count("*").alias("size")), "g")
        pairs = _stars(keyed.join(sized, "s"), turn)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        new = _confirmed(pairs, texts, of)
        tried = pairs if tried is None else tried.union(pairs)
        if not new.take(1):
            break
        links = new if links is None else links.union(new)
        label = components(links)
        group = cut(of.select("s", "n").join(label, F.col("s") == F.col("node"), "left").select("s", "n", F.coalesce("label", "s").alias("g")), "groups")
        drop(label)
    drop(keyed)
    return group


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.lit("u"), id, text).alias("u"), F.col(text).alias("text"))
    passed = cut(_first_pass(texts), "sets")
    named = passed.where("n >= 0").select("doc_id", "u", "s", "n")
    of = cut(passed.where("s is not null").groupBy("s").agg(F.min("u").alias("u"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("mins").alias("mins")), "of")
    group = _groups(of, texts)

    held = cut(_prefixes(texts, _sketch(passed)), "prefixes")
    prefix = held.where("s is not null").select("s", F.posexplode("prefix").alias("p", "t"))
    shared = cut(prefix.groupBy("t").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("t"), "shared")
    rows = cut(prefix.join(shared, "t", "left_semi").distinct().join(group, "s"), "rows")
    drop(held, shared)
    wide = rows.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("t")
    matrix = cut(rows.join(wide, "t", "left_semi"), "matrix")
    drop(rows)

    members = group.select(F.col("g").alias("h"), F.col("s").alias("m"), F.col("n").alias("nm"))
    sizes = cut(group.groupBy("g").agg(F.count("*").alias("size"), F.min("n").alias("n")).select(F.col("g").alias("x"), "size", "n"), "sizes")
    near = cut(_near(matrix), "near")
    near_cut = near
    # At first the sets of the smaller group are held against the larger one, then the other way about where the union covered one.
    near = near.join(sizes.select(F.col("x").alias("g"), F.col("size").alias("of_g")), "g").join(sizes.select(F.col("x").alias("h"), F.col("size").alias("of_h")), "h")
    back = F.col("of_g") > F.col("of_h")
    toward = near.select(F.when(back, F.col("h")).otherwise(F.col("g")).alias("g"), F.when(back, F.col("g")).otherwise(F.col("h")).alias("h"), F.least("of_g", "of_h").alias("of_g"), F.greatest("of_g", "of_h").alias("of_h"), "c")

    def met(pairs: DataFrame) -> DataFrame:
        """(s, n, g, h, of_h, c): the sets of g that may be linked with h by their shared prefix tokens, for pairs(g, h, of_g, of_h, c); of a single set those are counted already."""
        alone = pairs.where("of_g = 1").join(sizes.select(F.col("x").alias("g"), "n"), "g").select(F.col("g").alias("s"), "n", "g", "h", "of_h", "c")
        pairs = pairs.where("of_g > 1").select("g", "h", "of_h")
        left = _celled(matrix.join(pairs.select("g").distinct(), "g", "left_semi"), "s", "n")
        right = _celled(matrix.join(pairs.select(F.col("h").alias("g")).distinct(), "g", "left_semi")).select("t", F.col("g").alias("h"), *[F.col(c).alias(c + "_h") for c in CELL])
        counted = left.join(right, "t").where(_room(*CELL, *[c + "_h" for c in CELL])).join(pairs, ["g", "h"])
        counted = counted.groupBy("s", "n", "g", "h", "of_h", "band_h").agg(F.count("*").alias("c"), F.min("nlo_h").alias("lo"), F.max("nhi_h").alias("hi"))
        return cut(alone.unionByName(counted.where(_reach(F.col("n"), F.col("lo")) | _reach(F.col("n"), F.col("hi"))).groupBy("s", "n", "g", "h", "of_h").agg(F.max("c").alias("c"))), "met")

    def covered(rows: DataFrame) -> DataFrame:
        """Those whose group's union of tokens covers enough of the set; that of a single set is the set, which the full comparison holds against others."""
        opened = _open(rows.where("of_h > 1").select("s", "n", "h"), members, texts, of).select("s", "h")
        return rows.where("of_h > 1").join(opened, ["s", "h"], "left_semi").unionByName(rows.where("of_h = 1"))

    there = covered(met(toward))
    there = cut(there, "there")
    # The tokens that a group shares with a single set are the set's; those of two single sets are the same either way.
    back_c = there.groupBy(F.col("g").alias("h"), F.col("h").alias("g"), F.col("of_h").alias("of_g")).agg(F.max("c").alias("c"))
    open_pairs = back_c.join(sizes.select(F.col("x").alias("h"), F.col("size").alias("of_h")), "h").select("g", "h", "of_g", "of_h", "c")
    asked = cut(there.unionByName(covered(met(open_pairs))).select("s", "n", "g", "h", "c"), "asked")
    drop(there, matrix, near_cut, sizes)
    second = _between(asked, texts, of)

    links = group.select(F.col("s").alias("a"), F.col("g").alias("b")).union(second)
    label = components(links)
    whole = of.join(label, F.col("s") == F.col("node"), "left").select("s", "doc_id", F.coalesce("label", "s").alias("label"))
    least = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    final = cut(whole.join(least, "label").select(F.col("s").alias("of"), "component_id"), "classes")
    drop(label, asked, group, of)
    out = named.select("doc_id", "s", F.col("n").alias("n_shingles")).join(final, F.col("s") == F.col("of"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


#: What a cell of the matrix has besides token and group: the size band of its sets, the range of their sizes and that of the token's places in their prefixes.
CELL = ("band", "nlo", "nhi", "plo", "phi")


def _celled(matrix: DataFrame, *by: str) -> DataFrame:
    """t, g, *by, CELL: a cell for each token, group and size band (and `by`) of matrix(s, p, t, n, g).

    Sizes of linked sets are within 4 / 3, so their bands, powers of 1.34, are the same or neighbours.
    """
    band = F.floor(F.log("n") / F.log(F.lit(1.34))).cast("int")
    of = [f(c).alias(name) for name, f, c in (("nlo", F.min, "n"), ("nhi", F.max, "n"), ("plo", F.min, "p"), ("phi", F.max, "p"))]
    return matrix.withColumn("band", band).groupBy("t", "g", "band", *by).agg(*of)


def _room(band: str, nlo: str, nhi: str, plo: str, phi: str, band_h: str, nlo_h: str, nhi_h: str, plo_h: str, phi_h: str) -> Column:
    """Whether a link may share the token of two cells.

    Sets of n and m tokens that have it at places p <= q share at most p tokens before it, and m - q from there on: at most m - (q - p), and
    at most n. All tokens that linked sets share pass, so their count stays what it is.
    """
    a, b = F.col(nhi), F.col(nhi_h)
    most = F.least(a, b, b - (F.col(plo_h) - F.col(phi)), a - (F.col(plo) - F.col(phi_h)))
    return 175 * most >= LEVEL * (F.col(nlo) + F.col(nlo_h))


def _near(matrix: DataFrame) -> DataFrame:
    """(g, h, c): pairs of groups, g < h, that may be linked, and the most prefix tokens that a set of one shares with sets of one size band of the other.

    Cells meet by token and size band, so sets too different in size never do, however common the token.
    """
    cells = _celled(matrix)
    left = cells.withColumn("k", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    right = cells.select("t", F.col("g").alias("h"), F.col("band").alias("k"), *[F.col(c).alias(c + "_h") for c in CELL])
    once = F.when(F.col("band") == F.col("band_h"), F.col("g") < F.col("h")).otherwise(F.col("g") != F.col("h"))
    both = left.join(right, ["t", "k"]).where(once & _room(*CELL, *[c + "_h" for c in CELL]))
    both = both.groupBy("g", "h", "band", "band_h").agg(F.count("*").alias("c"), *[f(c).alias(c) for c, f in (("nlo", F.min), ("nhi", F.max), ("nlo_h", F.min), ("nhi_h", F.max))])
    corners = [_reach(F.col(a), F.col(b)) for a in ("nlo", "nhi") for b in ("nlo_h", "nhi_h")]
    kept = both.where(corners[0] | corners[1] | corners[2] | corners[3])
    return kept.groupBy(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).agg(F.max("c").alias("c"))


def _reach(n: Column, m: Column) -> Column:
    """Whether c shared prefix tokens leave room for enough shared ones between sets of n and m tokens.

    Of the two, let x be the one whose prefix ends first in the order: tokens shared up to there are all among the c, so the sets share
    at most c and what follows x's prefix, ceil(3 n / 4) - 1. They need 75 / 175 of both sizes. The room is least between the ends
    of a range of sizes, so the ends decide (with one token to spare for rounding).
    """
    return 175 * (F.col("c") + F.ceil(F.greatest(n, m) * LEVEL / 100)) >= LEVEL * (n + m)


def _open(met: DataFrame, members: DataFrame, texts: DataFrame, of: DataFrame) -> DataFrame:
    """The (s, n, h) for which the union of h's tokens covers enough of s."""
    tokens = _tokens(texts, met.select("s").union(met.join(members, "h").select("m")), of)
    exploded = tokens.select("s", F.explode("tokens").alias("t"))
    union = exploded.join(members.withColumnRenamed("m", "s").select("s", "h"), "s").join(met.select("h").distinct(), "h", "left_semi").select("h", "t").distinct()
    cover = met.join(exploded, "s").join(union, ["h", "t"]).groupBy("s", "n", "h").agg(F.count("*").alias("c"))
    opened = cut(cover.where(100 * F.col("c") >= LEVEL * F.col("n")).select("s", "n", "h"), "covering")
    drop(tokens)
    return opened


def _between(asked: DataFrame, texts: DataFrame, of: DataFrame) -> DataFrame:
    """The links found between groups, from asked(s, n, g, h, c): set s of group g is held against group h, with which it shares c prefix tokens.

    One link makes two groups one, so the sets that share most are compared first, more of them in each of LEADING's steps, and
    in the last step all that are left; pairs of groups that are one by then are left out.
    """
    links, joined, before = [], [], 0
    name = asked.select("s", "g").distinct()
    for most in LEADING:
        if not asked.take(1):
            break
        place = F.row_number().over(Window.partitionBy("g", "h").orderBy(F.desc("c"), "s"))
        ranked = asked.withColumn("place", place)
        ranked = cut(ranked if most is None else ranked.where(F.col("place") <= most), "ranked")
        other = ranked.select(F.col("g").alias("h"), F.col("h").alias("g"), F.col("s").alias("m"), F.col("n").alias("nm"), F.col("place").alias("place_m"))
        pairs = ranked.where("g < h").join(other, ["g", "h"]).where(_fits("n", "nm") & (F.greatest("place", "place_m") > before))
        found = _confirmed(pairs.select(F.least("s", "m").alias("a"), F.greatest("s", "m").alias("b")).distinct(), texts, of)
        drop(ranked)
        before = most
        if not found.take(1):
            continue
        links.append(found)
        if most is not None:
            joined.append(cut(found.join(name.select(F.col("s").alias("a"), F.col("g").alias("x")), "a").join(name.select(F.col("s").alias("b"), F.col("g").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")), "joined"))
            one = components(reduce(DataFrame.union, joined))
            of_g, of_h = one.select(F.col("node").alias("g"), F.col("label").alias("one_g")), one.select(F.col("node").alias("h"), F.col("label").alias("one_h"))
            left = asked.join(of_g, "g", "left").join(of_h, "h", "left").where("one_g is null or one_h is null or one_g <> one_h")
            # Groups that have become one stay apart by name here; their pairs with a third one are all still asked.
            asked = cut(left.select("s", "n", "g", "h", "c"), "asked")
            drop(one)
    return reduce(DataFrame.union, links, of.select(F.col("s").alias("a"), F.col("s").alias("b")).where("false"))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns of docs; documents without words all stay.

    Rows are named by a hash of all their columns, not by id, so repeated and null ids lose no text; the row of least hash stays,
    and of equal rows one.
    """
    parts = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    name = F.xxhash64(*parts, *[F.col(f"`{c}`").isNull() for c in docs.columns])
    row = docs.select(name.alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row.text")
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    ids = classes(row.select("h", text.alias("text")), "h").where("n_shingles > 0 and doc_id = component_id").select(F.col("doc_id").alias("h")).distinct()
    ids = cut(ids, "kept")
    one = row.where(~blank).join(ids, "h", "left_semi").groupBy("h").agg(F.first("row").alias("row"))
    return row.where(blank).select("row").unionByName(one.select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the classes of all documents."""
    return classes(documents(spark, sf_dir))
