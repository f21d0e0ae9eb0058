"""Byte-level BPE encoding and decoding, by recursive DuckDB queries over token-position rows in each partition.

Encoding: a text is cut into pieces by the tokenizer's pattern, and the distinct pieces are contracted together. In each round of a
recursive query the token-position rows of the pieces that still change are joined with the merge table, the least rank of each piece is
found and its pairs contracted from the left; a piece without a pair has reached its fixpoint. All pairs of that rank go in one
round: none of a lower rank can come up between them unless a contraction makes a pair of lower rank than its own, and a
piece where that happens is contracted again, one leftmost pair at a time. Decoding joins a document's token-position rows with the
vocabulary and aggregates the bytes in order of position.

Defined cases: a null text counts as empty; an empty text has no tokens and decodes to no bytes; repeated rows give repeated
rows; an empty table gives none; digests drop extra columns, encode and decode keep them all. Rows are keyed by piece, so memory follows the bytes of the pieces
contracted together (WORK) or of the longest one. A piece takes as many rounds as it has different ranks; one of more than LONG bytes
without a break (no word of any language) is contracted by the same rule in a heap, since rounds times bytes has no bound.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a piece beyond which the heap takes over.
LONG = 4096
#: Bytes of pieces that a recursive query takes at once, characters of text coded at once, bytes of pieces remembered (twice as many at most).
WORK, CHUNK, MEMO = 1 << 17, 1 << 20, 4 << 20

#: {chosen}: which pairs of the least rank are contracted in a round: in a run of overlapping ones every second, or the first of all.
ENCODE = """
with recursive state(piece, toks, last, plain) using key (piece) as (
    select piece, toks, -1, true from start
    union
    (with pairs as materialized (
            select t.*, m.merged as rank from (
                select piece, unnest(toks) as tok, unnest(list_append(toks[2:], null)) as next, generate_subscripts(toks, 1) as pos, last, plain from state) t
            left join merges m on m.pair = t.tok::bigint * 4294967296 + t.next),
        ranked as (select piece, min(rank) as least from pairs group by piece having min(rank) is not null),
        hits as (select piece, pos, pos - row_number() over (partition by piece order by pos) as run from pairs join ranked using (piece) where rank = least),
        chosen as (select piece, pos from (
            select *, row_number() over (partition by piece, run order by pos) as k, min(pos) over (partition by piece) as first from hits) where {chosen})
    select p.piece, list(case when c.pos is null then p.tok else r.least end order by p.pos), min(r.least), bool_and(p.plain and r.least >= p.last)
    from pairs p join ranked r using (piece) left join chosen c on c.piece = p.piece and c.pos = p.pos
        left join chosen swallowed on swallowed.piece = p.piece and swallowed.pos = p.pos - 1
    where swallowed.pos is null group by p.piece)
)
select piece, toks, plain from state
"""
TOGETHER, ONE = "k % 2 = 1", "pos = first"

DECODE = "select d, string_agg(v.chars, '' order by t.pos) as chars from toks t join vocabulary v using (tok) group by d"


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in (x.split() for x in lines if x.strip())]


class Codec:
    """One DuckDB connection with the merge table and the vocabulary; holds the pieces met so far."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        self.rank = dict(ranks)
        self.byte = [self.rank[bytes([b])] for b in range(256)]
        # The library's \s is the Unicode property, without the ASCII separators 1C-1F.
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.memo: dict[str, tuple[str, int]] = {}
        self.older: dict[str, tuple[str, int]] = {}
        self.held = 0
        pairs = [(self.rank[t[:i]], self.rank[t[i:]], r) for t, r in ranks for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self._table("merges", pair=pa.array([(a << 32) + b for a, b, _ in pairs], pa.int64()), merged=pa.array([r for _, _, r in pairs], pa.int32()))
        self._table("vocabulary", tok=pa.array([r for _, r in ranks], pa.int32()), chars=pa.array([t.decode("latin-1") for t, _ in ranks]))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("rows_in", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from rows_in")
        self.db.unregister("rows_in")

    def _query(self, pieces: dict[int, bytes], chosen: str) -> list[tuple[int, list[int], bool]]:
        self._table("start", piece=pa.array(list(pieces), pa.int32()), toks=pa.array([[self.byte[b] for b in p] for p in pieces.values()], pa.list_(pa.int32())))
        got = self.db.sql(ENCODE.format(chosen=chosen)).to_arrow_table()
        return list(zip(*(got[c].to_pylist() for c in ("piece", "toks", "plain")), strict=True))

    def contract(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece, by the recursive query."""
        out: list[list[int]] = [[] for _ in pieces]
        again = {}
        for i, ids, plain in self._query(dict(enumerate(pieces)), TOGETHER):
            out[i] = ids
            if not plain:
                again[i] = pieces[i]
        if again:
            for i, ids, _ in self._query(again, ONE):
                out[i] = ids
        return out

    def contract_long(self, piece: bytes) -> list[int]:
        """The same for one piece, by a heap of its pairs."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        alive = [True] * len(parts)
        queue = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (r := self.rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (r, i, parts[i], parts[j]))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= len(parts) or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.rank[p] for p, live in zip(parts, alive, strict=True) if live]

    def _learn(self, pieces: list[str]) -> None:
        part, size = [], 0
        for p in sorted(pieces, key=len):
            raw = p.encode("utf-8", "surrogatepass")
            if len(raw) > LONG:
                self._keep(p, self.contract_long(raw))
                continue
            if part and size + len(raw) > WORK:
                self._contract_all(part)
                part, size = [], 0
            part.append((p, raw))
            size += len(raw)
        if part:
            self._contract_all(part)

    def _contract_all(self, part: list[tuple[str, bytes]]) -> None:
        for (p, _), ids in zip(part, self.contract([raw for _, raw in part]), strict=True):
            self._keep(p, ids)

    def _keep(self, p: str, ids: list[int]) -> None:
        self.memo[p] = " ".join(map(str, ids)), len(ids)
        self.held += len(p)

    def encode(self, texts: list[str]) -> list[list[tuple[str, int]]]:
        """For each text its pieces' ids in decimal and their number."""
        if self.held > MEMO:
            self.memo, self.older, self.held = {}, self.memo, 0
        cut = [self.pieces.findall(t) for t in texts]
        fresh = []
        for p in {p for found in cut for p in found}.difference(self.memo):
            if (known := self.older.get(p)) is not None:
                self.memo[p] = known
                self.held += len(p)
            else:
                fresh.append(p)
        self._learn(fresh)
        get = self.memo.__getitem__
        return [list(map(get, found)) for found in cut]

    def decode(self, counts: list[int], flat: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids, given as their numbers and all ids. An id outside the vocabulary has none."""
        out: list[bytes] = [b""] * len(counts)
        d = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.db.register("toks", pa.table({"d": d, "pos": np.arange(len(flat), dtype=np.int32), "tok": flat}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("toks")
        for i, chars in zip(got["d"].to_pylist(), got["chars"].to_pylist(), strict=True):
            out[i] = chars.encode("latin-1")
        return out

    def coded(self, texts: list[str]) -> tuple[list[str], list[int], np.ndarray]:
        """Per text its ids in decimal and their number; and all ids."""
        found = self.encode(texts)
        ids, counts = [" ".join([x[0] for x in f]) for f in found], [sum([x[1] for x in f]) for f in found]
        return ids, counts, np.array(" ".join(ids).split(), np.int32)


#: Kept between the tasks of one Python worker, so that a piece is contracted once for many partitions.
_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    name, rows = ranks.value
    if (name, pattern) not in _CODECS:
        _CODECS[name, pattern] = Codec(rows, pattern)
    return _CODECS[name, pattern]


def _chunks(values: list, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of values of about `most` characters or ids, or of one value."""
    start = held = 0
    for i, t in enumerate(values):
        if held and held + len(t or ()) > most:
            yield start, i
            start, held = i, 0
        held += len(t or ())
    if start < len(values):
        yield start, len(values)


def _shared_ranks(spark: SparkSession, vocabulary: str):
    """The rank file goes to the executors whole: its size is fixed by the tokenizer, not by the corpus."""
    rows = read_ranks(vocabulary)
    return spark.sparkContext.broadcast((hashlib.sha256(repr(rows).encode()).hexdigest(), rows))


def _added(docs: DataFrame, vocabulary: str, pattern: str, columns: dict[str, str], needed: str, keep: bool, make) -> DataFrame:
    """docs (or only `needed` of it) through make(codec, values of `needed`), which gives the new columns, a slice of bounded size at a time."""
    ranks = _shared_ranks(docs.sparkSession, vocabulary)
    kept = [c for c in docs.columns if c not in columns and (keep or c == "doc_id")]
    given = docs.select(*kept, F.col(needed).alias("\0needed"))
    schema = given.drop("\0needed")
    for c, kind in columns.items():
        schema = schema.withColumn(c, F.lit(None).cast(kind))
    schema = schema.schema
    types = {"array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            values = batch.column(len(kept)).to_pylist()
            for a, b in _chunks(values):
                made = make(codec, values[a:b])
                new = [x if isinstance(x, pa.Array) else pa.array(x, types[k]) for x, k in zip(made, columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(kept))], *new], names=schema.names)

    return given.mapInArrow(run, schema)


def _lists(counts: list[int], flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(flat))


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every column of docs, and the token ids of the text as array<int>. Null texts have no tokens."""

    def make(codec: Codec, texts: list) -> tuple:
        return (_lists(*codec.coded([t or "" for t in texts])[1:]),)

    return _added(docs, vocabulary, pattern, {ids: "array<int>"}, text, True, make)


def decode(coded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every column of coded, and the bytes of the ids as binary. Null ids decode to no bytes."""

    def make(codec: Codec, lists: list) -> tuple:
        lists = [x or [] for x in lists]
        return (codec.decode([len(x) for x in lists], np.array([t for x in lists for t in x], np.int32)),)

    return _added(coded, vocabulary, pattern, {decoded: "binary"}, ids, True, make)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """Every column of docs, n_tokens, ids, and decoded_sha256 of the bytes that the ids decode to: both ways in one worker, with one codec."""

    def make(codec: Codec, texts: list) -> tuple:
        _, counts, flat = codec.coded([t or "" for t in texts])
        return counts, _lists(counts, flat), [hashlib.sha256(b).hexdigest() for b in codec.decode(counts, flat)]

    return _added(docs, vocabulary, pattern, {"n_tokens": "long", "ids": "array<int>", "decoded_sha256": "string"}, text, True, make)


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the bytes that each document's ids decode to."""

    def make(codec: Codec, texts: list) -> tuple:
        ids, counts, flat = codec.coded([t or "" for t in texts])
        return counts, [hashlib.sha256(x.encode()).hexdigest() for x in ids], [hashlib.sha256(b).hexdigest() for b in codec.decode(counts, flat)]

    return _added(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocabulary, pattern, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, "text", False, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every whole document encoded and decoded with the public 50k byte-level vocabulary."""
    import public_tokenizers

    from .common import documents

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
