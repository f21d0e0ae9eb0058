"""Suffix-array dedup: blockwise construction with a difference cover.

Segments around recurring anchors (see repeats) are dealt to blocks by anchor, equal segments once with their first document. In
a block the suffixes are sorted one bucket (by leading bytes) at a time; suffixes that tie on PERIOD bytes are ordered by the ranks of the
difference-cover sample at an offset where both are in the sample. Runs of suffixes that agree in 50 bytes get the first document
of the run. An anchor with over HOT distinct segments is dealt by single windows instead, so that no block grows with it.

Defined cases: null texts are empty; texts under 50 bytes lose nothing; rows with equal ids don't remove each other's bytes; rows
with a null id keep all bytes and take none from others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cut, documents, drop, shuffle_partitions
from .repeats import WINDOW, applied, covered, keyed, least_hashes, recurring, runs_of

ANCHOR = 24
#: Every residue is a difference of two of COVER, modulo PERIOD.
PERIOD, COVER = 7, (0, 1, 3)
OFFSET = [[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]
#: Bytes of segments in a block, distinct segments of an anchor, suffixes sorted at once, bytes of segments written at once.
BLOCK, HOT, BUCKET, BATCH = 4 << 20, 20_000, 1 << 19, 1 << 20


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _symbols(text: str) -> np.ndarray:
    return _bytes(text).astype(U64)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, in their order. text ends in eight zeros or more."""
    each = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
    return np.ascontiguousarray(each).view(">u8").ravel().astype(U64)


def _packed(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The PERIOD bytes from each place, as one number."""
    return (words[at] >> U64(8 * (8 - PERIOD))).astype(np.int64)


def sample_ranks(words: np.ndarray) -> np.ndarray:
    """Ranks of the cover sample's suffixes by WINDOW bytes or more; -1 elsewhere. The text ends in zeros."""
    n = len(words)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.full(n + WINDOW * 2, -1, np.int64)
    rank[at] = np.unique(_packed(words, at), return_inverse=True)[1]
    depth = PERIOD
    while depth < WINDOW:
        pair = rank[at] * (len(at) + 2) + rank[at + depth] + 1
        rank[at] = np.unique(pair, return_inverse=True)[1]
        depth *= 2
    return rank


def sorted_buckets(text: np.ndarray, places: np.ndarray, most: int = BUCKET) -> Iterator[np.ndarray]:
    """The places in order of their suffixes (by WINDOW bytes at least), a bucket at a time."""
    words = _words(text)
    rank = sample_ranks(words)
    lead = (text[places].astype(np.int64) << 8) | text[places + 1]
    sizes = np.bincount(lead, minlength=1 << 16)
    bucket = np.cumsum(sizes) // most
    of = bucket[lead]
    for b in np.unique(of):
        at = places[of == b]
        key = _packed(words, at)
        order = np.argsort(key)
        at, key = at[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        # Only groups of two or more have ties.
        tied = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
        if len(tied):
            at[tied] = at[tied][_ties(at[tied], np.cumsum(new[tied]), rank)]
        yield at


def _ties(at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """An order of `at` that keeps groups in order and sorts inside them by the sample's ranks: places are counted class by class."""
    residue, scale = at % PERIOD, len(rank) + 2
    before = np.zeros(len(at), np.int64)
    own = {}
    for r in range(PERIOD):
        members = np.flatnonzero(residue == r)
        # A class is sorted once for each of the offsets that bring it into the sample.
        for d in range(PERIOD):
            if len(members) and (r + d) % PERIOD in COVER:
                key = group[members] * scale + rank[at[members] + d] + 1
                order = np.argsort(key)
                own[r, d] = members[order], key[order]
    for a in range(PERIOD):
        for b in range(PERIOD):
            d = OFFSET[a][b]
            if (a, d) in own and (b, d) in own:
                members, key = own[a, d]
                before[members] += np.searchsorted(own[b, d][1], key, "left")
    return np.argsort(before)


def first_documents(segments: list[bytes], first: np.ndarray) -> list[np.ndarray]:
    """For each segment the first document of the window at each of its starts, over the segments of the block."""
    if not segments:
        return []
    text = np.concatenate([np.frombuffer(b"".join(segments), np.uint8), np.zeros(WINDOW * 3, np.uint8)])
    counts = np.array([len(s) - WINDOW + 1 for s in segments])
    offsets = np.concatenate(([0], np.cumsum(counts + WINDOW - 1)))[:-1]
    owner = np.repeat(np.arange(len(segments)), counts)
    places = offsets[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    doc = np.full(len(text), np.iinfo(np.int64).max)
    doc[places] = first[owner]
    out, words = doc.copy(), _words(text)
    for at in sorted_buckets(text, places):
        new = np.zeros(len(at), bool)
        new[0] = True
        # Eight bytes at a time; the last ones overlap.
        for d in (*range(0, WINDOW - 8, 8), WINDOW - 8):
            here = words[at + d]
            new[1:] |= here[1:] != here[:-1]
        begin = np.flatnonzero(new)
        out[at] = np.repeat(np.minimum.reduceat(doc[at], begin), np.diff([*begin, len(at)]))
    return [out[o : o + c] for o, c in zip(offsets, counts, strict=True)]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, doc_id, u, anchors) to the segments of the windows that chose one of the anchors."""

    def out(held: list[tuple[np.ndarray, np.ndarray, int, int]], segments: list[bytes]) -> pa.RecordBatch:
        counts = [len(x[0]) for x in held]
        columns = {"anchor": np.concatenate([x[0] for x in held]), "doc_id": np.repeat([x[2] for x in held], counts), "u": np.repeat([x[3] for x in held], counts), "start": np.concatenate([x[1] for x in held])}
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()} | {"segment": pa.array(segments, pa.binary())})

    held, segments, size = [], [], 0
    for batch in batches:
        lists = batch.column(3)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().to_pylist()])
        for i, (text, doc, u) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            raw = _bytes(text)
            least = least_hashes(raw.astype(U64), ANCHOR).view(np.int64)
            begin = runs_of(least)
            end = np.concatenate((begin[1:], [len(least)]))
            live = np.isin(least[begin], flat[ends[i] : ends[i + 1]])
            begin, end = begin[live], end[live]
            data = raw.tobytes()
            held.append((least[begin], begin, doc, u))
            segments += [data[a : b - 1 + WINDOW] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            size += int((end - begin).sum()) + WINDOW * len(begin)
            if size >= BATCH:
                yield out(held, segments)
                held, segments, size = [], [], 0
    if held:
        yield out(held, segments)


def _block(rows: pa.Table) -> pa.Table:
    """The runs of starts of each segment that have the same first document: c of them from i."""
    got = first_documents(rows["segment"].to_pylist(), rows["first"].to_numpy())
    flat, ends = np.concatenate([np.empty(0, np.int64), *got]), np.cumsum([0, *map(len, got)])
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    new[ends[:-1]] = True
    begin = np.flatnonzero(new)
    own = np.searchsorted(begin, ends)
    run = {"i": begin - np.repeat(ends[:-1], np.diff(own)), "c": np.diff([*begin, len(flat)]), "first": flat[begin]}
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in run.values()], list(run))
    return pa.table({"name": rows["name"].combine_chunks(), "runs": pa.ListArray.from_arrays(pa.array(own, pa.int32()), runs)})


def starts(rows: DataFrame) -> DataFrame:
    """(u, starts): where the 50-byte strings begin that an earlier document has, c of them from s."""
    found = recurring(rows, _symbols, ANCHOR, "suffix")
    own = found.groupBy("u").agg(F.collect_set("anchor").alias("anchors"))
    routed = rows.where("doc_id is not null").join(own, "u").dropDuplicates(["u"]).select("text", "doc_id", "u", "anchors")
    all_segments = cut(routed.mapInArrow(_segments, "anchor long, doc_id long, u long, start long, segment binary"), "segments")
    drop(found)
    distinct = all_segments.groupBy("anchor", "segment").agg(F.min("doc_id").alias("first"))
    distinct = cut(distinct, "distinct")
    hot = cut(distinct.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("anchor"), "hot")

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        single = df.join(hot, "anchor", "left_semi")
        windows = single.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("segment") - WINDOW)))
        windows = windows.withColumn("segment", F.substring("segment", F.col("i") + 1, F.lit(WINDOW)))
        return df.join(hot, "anchor", "left_anti"), windows

    cold, windows = split(distinct)
    size = distinct.agg(F.sum(F.length("segment"))).first()[0] or 0
    blocks = max(shuffle_partitions(rows.sparkSession), size // BLOCK + 1)
    name = F.xxhash64("anchor", "segment").alias("name")
    dealt = cold.select(F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block"), name, "segment", "first").unionByName(
        windows.groupBy("anchor", "segment").agg(F.min("first").alias("first")).select(F.pmod(F.xxhash64("segment"), F.lit(blocks)).alias("block"), name, "segment", "first"))
    firsts = cut(dealt.groupBy("block").applyInArrow(_block, "name long, runs array<struct<i: long, c: long, first: long>>"), "firsts")
    drop(distinct)
    places, one = split(all_segments)
    held = places.select(name, "doc_id", "u", "start").unionByName(one.select(name, "doc_id", "u", (F.col("start") + F.col("i")).alias("start")))
    lost = held.join(firsts, "name").select("u", F.transform(F.filter("runs", lambda x: x["first"] < F.col("doc_id")), lambda x: F.struct((F.col("start") + x["i"]).alias("s"), x["c"].alias("c"))).alias("s")).where(F.size("s") > 0)
    out = cut(lost.groupBy("u").agg(F.flatten(F.collect_list("s")).alias("starts")), "starts")
    drop(all_segments, firsts, hot)
    return out


def _remove(text: str, starts: np.ndarray, counts: np.ndarray) -> tuple[int, int, int, str]:
    raw = _bytes(text)
    mask, spans = covered(starts, counts, len(raw))
    return len(raw), int(mask.sum()), spans, hashlib.sha256(raw[~mask].tobytes()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: bytes of repeated 50-byte strings removed from all documents; digests of what stays."""
    return digests(documents(spark, sf_dir))


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = keyed(docs, id, text)
    return applied(rows, starts(rows), _remove, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", "suffix")
