"""Language-model scoring by prediction by partial matching over byte contexts.

The trie of the training texts (contexts of up to ORDER bytes and what follows them) is held as sorted count tables, one for each
order. A symbol not seen after a context escapes (method D) to the shorter one, where the symbols of the longer context are
excluded; below the empty context all bytes and the end are alike. Code lengths are summed per document.

The counts of the highest order are a Spark table, whatever its size. Contexts are dealt to shards by their last two bytes, so that a
shard holds all that follows such a context at orders 2 and above; orders 0 and 1, at most 257 * 258 counts, go with every shard. The
driver makes the model of a shard of about SHARD rows and broadcasts it, and the texts are passed once for each shard, scoring the symbols that
belong to it: the order and the counts are the same at every size, and neither driver nor executors hold more than one shard.
The word counts of the base score are dealt out and passed the same way, by a 64-bit hash of the word.

Defined cases: null texts are empty and have the end only; rows of equal ids fall on the same side; a null id counts as the text
"null"; with no training texts all symbols are alike and base scores use counts of 0; extra columns are ignored; repeated rows are
counted and returned as often as they are there. A text is held in some 30 times its size while it is passed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, drop, pieces, runs
from .shingle_join import word_hashes

ORDER, SHARD = 6, 8_000_000
#: Bytes of text that a worker takes at once.
SLICE = 2 << 20
#: Symbols of nine bits: bytes, the end, and what stands before a text.
END, START, BITS = 256, 257, 9
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def grams(data: bytes, order: int) -> np.ndarray:
    """For each symbol of a text (its end included) the symbol and the `order` ones before, packed."""
    return _symbols([data], order)[0]


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in 32 bits where they fit."""
    return x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x.astype(np.float64)


class Model:
    """Count tables of orders 0 to `order`, from (gram, count) of the highest order; those of orders 0 and 1 from `low`, if given.

    An order holds its grams and their counts, and its contexts with the sum of counts, the number of symbols, and what these
    symbols weigh in the context one shorter, where they are excluded after an escape.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray] | None = None):
        self.order, self.tables = order, []
        above = None
        for k in range(order, -1, -1):
            if low is not None and k == 1:
                keys, counts = low
            keys, counts = self._summed(keys & ((1 << BITS * (k + 1)) - 1), counts)
            if above is not None and len(keys):
                self._exclude(above, above_at, keys, counts, k)
            begin = runs(keys >> BITS)
            at = np.repeat(np.arange(len(begin) - 1), np.diff(begin)).astype(np.int32)
            table = {"keys": keys, "n": _narrow(counts), "context": keys[begin[:-1]] >> BITS, "total": _narrow(np.add.reduceat(counts, begin[:-1]) if len(keys) else counts), "kinds": np.diff(begin).astype(np.uint16) if len(keys) else np.zeros(0, np.uint16), "excluded": np.zeros(0, np.uint32)}
            self.tables.append(table)
            above, above_at = table, at
        self.tables.reverse()

    @staticmethod
    def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        keys = keys[order]
        begin = runs(keys)
        return keys[begin[:-1]], np.add.reduceat(counts[order], begin[:-1]) if len(keys) else counts

    @staticmethod
    def _exclude(table: dict, at: np.ndarray, keys: np.ndarray, counts: np.ndarray, k: int) -> None:
        place = np.searchsorted(keys, table["keys"] & ((1 << BITS * (k + 1)) - 1))
        table["excluded"] = _narrow(np.bincount(at, counts[place], len(table["context"])) if len(place) else np.zeros(0))

    def log10(self, wanted: np.ndarray) -> np.ndarray:
        """The log10 probability of each packed gram of the highest order."""
        out, open_ = np.zeros(len(wanted)), np.arange(len(wanted))
        gone_n, gone_kinds = np.zeros(len(wanted)), np.zeros(len(wanted))
        for k in range(self.order, -1, -1):
            t = self.tables[k]
            if not len(t["keys"]) or not len(open_):
                continue
            gram = wanted[open_] & ((1 << BITS * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(t["context"], gram >> BITS), len(t["context"]) - 1)
            known = t["context"][c] == gram >> BITS
            g = np.minimum(np.searchsorted(t["keys"], gram), len(t["keys"]) - 1)
            hit = t["keys"][g] == gram
            total, kinds = t["total"][c] - gone_n[open_], t["kinds"][c] - gone_kinds[open_]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[open_[hit]] += np.log10((t["n"][g[hit]] - 0.5) / total[hit])
                escaped = known & ~hit & (kinds > 0)
                out[open_[escaped]] += np.log10(0.5 * kinds[escaped] / total[escaped])
            if k and len(t["excluded"]):
                gone_n[open_[known]] = t["excluded"][c[known]]
            gone_kinds[open_[known]] = t["kinds"][c[known]]
            open_ = open_[~hit]
        out[open_] -= np.log10(np.maximum(257 - gone_kinds[open_], 1))
        return out


def held_out(doc_id) -> bool:
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % 10 == 0


def _symbols(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed grams of all texts, which text each is of)."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    s = np.full(int(sizes.sum()) + order * len(texts), START, np.int64)
    at = 0
    for t in texts:
        s[at + order : at + order + len(t)] = np.frombuffer(t, np.uint8)
        s[at + order + len(t)] = END
        at += order + len(t) + 1
    out = np.zeros(len(s), np.int64)
    for d in range(order + 1):
        out[order:] = (out[order:] << BITS) | s[d : d + len(s) - order]
    ends = np.cumsum(sizes + order)
    own = np.ones(len(s), bool)
    for e, n in zip(ends, sizes, strict=True):
        own[e - n - order : e - n] = False
    return out[own], np.repeat(np.arange(len(texts)), sizes)


GRAM, WORD, ENDS = 0, 1, 2


def _words(texts: list[bytes]) -> list[np.ndarray]:
    return [word_hashes(t).view(np.int64) for t in texts]


def _counts(train: DataFrame, order: int) -> DataFrame:
    """(kind, key, n): how often each gram of the highest order, each word (by its hash) and the end of a text occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 0, SLICE):
                texts = [_lower(t) for t in part.column(0).to_pylist()]
                found = [np.unique(_symbols(texts, order)[0], return_counts=True), np.unique(np.concatenate([*_words(texts), np.empty(0, np.int64)]), return_counts=True), (np.zeros(1, np.int64), np.array([len(texts)]))]
                for kind, (keys, n) in zip((GRAM, WORD, ENDS), found, strict=True):
                    yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(keys), kind, np.int8)), "key": keys, "n": n.astype(np.int64)})

    return train.select("text").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def shard_of(gram, shards: int):
    """The shard of packed grams (an array or a column's values): it depends on the two symbols before the last."""
    return ((((gram >> BITS) & ((1 << 2 * BITS) - 1)) * 2654435761) >> 16) % shards


@dataclass
class Trained:
    """The counts as a table (kind, key, n, shard), how many shards there are, the counts of order 1, and the sums of the word model."""

    table: DataFrame
    order: int
    shards: int
    low: tuple[np.ndarray, np.ndarray]
    ends: int
    total: int
    distinct: int


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.select("key", "n").toArrow()
    return got["key"].to_numpy(), got["n"].to_numpy().astype(float)


def train(texts: DataFrame, order: int = ORDER, shard: int = SHARD) -> Trained:
    """The counts of all texts, dealt to shards of about `shard` rows: grams by their last two bytes of context, words by their hash."""
    counted = cut(_counts(texts, order), "counts")
    of = {r.kind: (r.rows, r.n) for r in counted.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    shards = max(1, -(-sum(rows for rows, _ in of.values()) // shard))
    context = F.shiftright("key", BITS).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
    dealt = F.when(F.col("kind") == GRAM, F.pmod(F.shiftright(context * F.lit(2654435761), 16), F.lit(shards))).otherwise(F.pmod("key", F.lit(shards)))
    # At most 258 * 257 rows.
    low = _arrays(counted.where(F.col("kind") == GRAM).groupBy(F.col("key").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("key")).agg(F.sum("n").alias("n")))
    ends = of.get(ENDS, (0, 0))[1]
    return Trained(counted.withColumn("shard", dealt), order, shards, low, ends, of.get(WORD, (0, 0))[1] + ends, of.get(WORD, (0, 0))[0] + (ends > 0))


def _pass(rows: DataFrame, trained: Trained, i: int) -> DataFrame:
    """rows(*key, text) to *key, n_tokens, known, base, score: what the symbols and words of shard i add. The model is made once, by the driver."""
    own = trained.table.where(F.col("shard") == i)
    model = Model(*_arrays(own.where(F.col("kind") == GRAM)), trained.order, trained.low)
    words, n = _arrays(own.where(F.col("kind") == WORD))
    in_order = np.argsort(words)
    # What a known word's part of the base score has over an unknown one's.
    sent = rows.sparkSession.sparkContext.broadcast((model, words[in_order], np.log10(n[in_order] + 0.1) - math.log10(0.1)))
    shards, order, key = trained.shards, trained.order, rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, vocabulary, gain = sent.value
            for part in pieces(batch, len(key), SLICE):
                texts = [_lower(t) for t in part.column(len(key)).to_pylist()]
                flat, owner = _symbols(texts, order)
                if shards > 1:
                    mine = shard_of(flat, shards) == i
                    owner, flat = owner[mine], flat[mine]
                wanted, back = np.unique(flat, return_inverse=True)
                score = np.bincount(owner, held.log10(wanted)[back], len(texts)).astype(float)
                tokens = _words(texts)
                of, flat = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]), np.concatenate([*tokens, np.empty(0, np.int64)])
                known, base = np.zeros(len(texts)), np.zeros(len(texts))
                if len(vocabulary):
                    at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
                    hit = vocabulary[at] == flat
                    known, base = np.bincount(of[hit], minlength=len(texts)), np.bincount(of[hit], gain[at[hit]], len(texts)).astype(float)
                yield pa.RecordBatch.from_arrays([*[part.column(j) for j in range(len(key))], pa.array([len(t) for t in tokens], pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=[*key, "n_tokens", "known", "base", "score"])

    schema = rows.drop("text").schema
    for name, kind in (("n_tokens", "long"), ("known", "long"), ("base", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    out = cut(rows.mapInArrow(run, schema), "scores")
    sent.destroy()
    return out


def score(texts: DataFrame, trained: Trained, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens (words), known, base, score of every row: the model's log10 probability of each text, and sums over its known words."""
    rows = texts.select(F.col(id).alias("doc_id"), F.xxhash64(F.lit("u"), id, text).alias("u"), F.col(text).alias("text"))
    parts = [_pass(rows, trained, i) for i in range(trained.shards)]
    if len(parts) == 1:
        return parts[0].drop("u")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Equal rows are summed together: each of the passes has given one for each copy.
    copies = (F.count("*") / len(parts)).cast("long")
    summed = out.groupBy("doc_id", "u").agg(F.max("n_tokens").alias("n_tokens"), (F.sum("known") / copies).cast("long").alias("known"), (F.sum("base") / copies).alias("base"), (F.sum("score") / copies).alias("score"), copies.alias("copies"))
    return summed.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("u", "copies")


def scored(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 10 == 0
    trained = train(rows.where(~out))
    each = score(rows, trained)
    drop(trained.table)
    unknown = math.log10(0.1 / (trained.total + 0.1 * (trained.distinct + 1)))
    end = math.log10((trained.ends + 0.1) / (trained.total + 0.1 * (trained.distinct + 1)))
    return each.select(
        "doc_id", out.alias("held_out"), (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("known") + F.lit(int(trained.ends > 0))).alias("n_known"), F.lit(trained.total).cast("long").alias("train_tokens"),
        (F.col("n_tokens") * F.lit(unknown) + F.col("base") + F.lit(end)).alias("base_score"), "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents scored by a model of nine tenths of them."""
    return scored(documents(spark, sf_dir))
