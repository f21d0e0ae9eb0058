"""Substring dedup by repeated-phrase automata.

Phrases of PHRASE words that windows choose as anchors and that recur in two documents are confirmed by their text, taken from
their first document. Documents with recurring phrases are streamed through Aho-Corasick automata, one for each shard of
documents, holding the phrases that those documents may contain; so an automaton is as large as its shard. The windows around the
occurrences are named by a hash, the first document of each window is found by aggregation, and a document loses the words of
windows whose first document comes before it.

Defined cases: null and blank texts have no words; documents of under 50 words lose nothing; equal rows and rows with equal ids
don't remove each other's words; rows with a null id keep all words and take none from others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, drop, rolling
from .repeats import WINDOW, applied, covered, keyed, places, recurring
from .shingle_join import word_hashes

PHRASE = 25
#: Characters of text and phrases that one automaton serves at least.
SHARD = 8 << 20


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _symbols(text: str) -> np.ndarray:
    return word_hashes(_encoded(text))


def _phrases(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(anchor, phrase): the text of each recurring phrase, from its first document."""
    wanted = found.where("doc_id = first").groupBy("u").agg(F.collect_set("anchor").alias("anchors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for text, anchors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _encoded(text).split()
                grams = rolling(_symbols(text), PHRASE).view(np.int64)
                values, first = np.unique(grams, return_index=True)
                at = first[np.searchsorted(values, np.array(anchors, np.int64))]
                names += anchors
                texts += [b" ".join(words[i : i + PHRASE]).decode("utf-8", "surrogatepass") for i in at]
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(names, pa.int64()), "phrase": pa.array(texts, pa.string())})

    return rows.where("doc_id is not null").join(wanted, "u").select("text", "anchors").mapInArrow(run, "anchor long, phrase string").dropDuplicates(["anchor"])


def _occurrences(held: list[tuple[str, int, int, list[str]]]) -> Iterator[dict]:
    """The windows of (text, doc_id, u, phrases) rows around every phrase that the rows' automaton finds."""
    automaton = ahocorasick.Automaton()
    for *_, phrases in held:
        for p in phrases:
            automaton.add_word(f" {p} ", len(p) + 2)
    automaton.make_automaton()
    for text, doc, u, _ in held:
        words = _encoded(text).split()
        line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
        ends = np.fromiter((e - n + 1 for e, n in automaton.iter(line)), np.int64)
        lengths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) + 1 for w in words), np.int64, len(words))
        at = np.searchsorted(np.concatenate(([0], np.cumsum(lengths))), ends)
        symbols = _symbols(text)
        starts = np.flatnonzero(np.isin(places(symbols, PHRASE), at))
        yield {"u": u, "doc_id": doc, "starts": starts, "names": rolling(symbols, WINDOW)[starts].view(np.int64)}


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held):
        for x in _occurrences(held):
            n = len(x["starts"])
            yield pa.RecordBatch.from_pydict({"w": pa.array(x["names"]), "doc_id": pa.array(np.full(n, x["doc_id"])), "u": pa.array(np.full(n, x["u"])), "start": pa.array(x["starts"])})

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[0]) + sum(map(len, row[3]))
            if size >= SHARD:
                yield from out(held)
                held, size = [], 0
    if held:
        yield from out(held)


def starts(rows: DataFrame) -> DataFrame:
    """(u, starts): where the windows begin that an earlier document has."""
    found = recurring(rows, _symbols, PHRASE, "phrases")
    phrases = cut(_phrases(rows, found), "phrase-texts")
    own = found.select("u", "anchor").join(phrases, "anchor").groupBy("u").agg(F.collect_set("phrase").alias("phrases"))
    routed = rows.where("doc_id is not null").join(own, "u").dropDuplicates(["u"]).select("text", "doc_id", "u", "phrases")
    windows = routed.mapInArrow(_windows, "w long, doc_id long, u long, start long")
    windows = cut(windows, "windows")
    drop(found, phrases)
    first = windows.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("w", "first")
    out = cut(windows.join(first, "w").where("first < doc_id").groupBy("u").agg(F.collect_list("start").alias("starts")), "starts")
    drop(windows)
    return out


def _remove(text: str, starts: np.ndarray, counts: np.ndarray) -> tuple[int, int, str]:
    words = _encoded(text).split()
    mask, _ = covered(starts, counts, len(words))
    kept = b" ".join(w for w, gone in zip(words, mask, strict=True) if not gone) if len(starts) else b" ".join(words)
    return len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest()


def _texts(text: str, starts: np.ndarray, counts: np.ndarray) -> tuple[int, int, str]:
    words = _encoded(text).split()
    mask, _ = covered(starts, counts, len(words))
    return len(words), int(mask.sum()), b" ".join(w for w, gone in zip(words, mask, strict=True) if not gone).decode("utf-8", "surrogatepass")


def removals(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by one space."""
    rows = keyed(docs, id, text)
    return applied(rows, starts(rows), _texts, "n_words long, n_removed long, kept string", "phrases")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: repeated passages removed from all documents; digests of what stays."""
    rows = keyed(documents(spark, sf_dir), "doc_id", "text")
    return applied(rows, starts(rows), _remove, "n_words long, n_removed long, kept_sha256 string", "phrases")
