"""Order MinHash fingerprints, in DataFrame functions only.

The words of a text form k-mers of K words, each numbered by how often it has occurred before. The numbered k-mers are hashed and
dealt to BANDS bands; of each band the LENGTH least are taken, in the order of the text, and the tuple of their k-mers is
hashed. Texts agree in a band when they share its least k-mers in the same order, which edits and moved passages break.
The likeness of two fingerprints is the share of equal bands among those filled in either.

Defined cases: null, empty and blank texts have the empty fingerprint of "-" bands, and likeness 1 with each other, 0 with others;
under K words form one k-mer; equal texts have equal fingerprints; documents of equal id are ordered by the hash of their text, and
of rows equal in id and text each but one is followed by a copy; rows with a null id come last in descending order; a single document
is its own next one; an empty table gives no rows; other columns, whatever their names, are ignored; a text is held whole in one row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, drop, let, shuffle_partitions, words_of

K, BANDS, LENGTH = 3, 32, 2


def _numbered(words: Column) -> Column:
    """(band, hash, place, k-mer) of all k-mers, sorted."""
    kmers = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - K, F.lit(0))), lambda i: F.struct(F.xxhash64(*[F.coalesce(F.get(words, i + j), F.lit("")) for j in range(K)]).alias("h"), i.alias("i")))

    def occurrences(s: Column) -> Column:
        # Sorted by k-mer and place, the number of an occurrence is its distance from the first of its run.
        repeated = F.filter(s, lambda x, j: (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))

        def named(x: Column, n: Column) -> Column:
            return let(F.xxhash64(x["h"], n), lambda v: F.struct(F.pmod(v, F.lit(BANDS)).cast("int").alias("b"), F.shiftright(v, 5).alias("v"), x["i"].alias("i"), x["h"].alias("h")))

        once = F.transform(F.filter(s, lambda x, j: ~(F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))), lambda x: named(x, F.lit(0)))
        first = lambda r: F.map_from_entries(F.transform(F.filter(F.transform(r, lambda x, j: F.struct(x["h"].alias("h"), j.alias("j"), F.coalesce(F.get(r, j - 1)["h"] != x["h"], F.lit(True)).alias("new"))), lambda x: x["new"]), lambda x: F.struct(x["h"], x["j"])))
        # As an array of run starts per element this would be quadratic; a map of each run's start isn't.
        many = let(repeated, lambda r: F.when(F.size(r) == 0, F.array().cast("array<struct<b:int,v:bigint,i:int,h:bigint>>")).otherwise(let(first(r), lambda m: F.transform(r, lambda x, j: named(x, j - F.element_at(m, x["h"]))))))
        return F.sort_array(F.concat(once, many))

    return let(F.sort_array(kmers), occurrences)


def bands(text: Column) -> Column:
    """The fingerprint as an array of BANDS hashes; null where a band has no k-mer."""

    def signatures(s: Column) -> Column:
        least = F.filter(s, lambda x, j: (j < LENGTH) | F.coalesce(F.get(s, j - LENGTH)["b"] != x["b"], F.lit(True)))

        def grouped(m: Column) -> Column:
            heads = F.filter(F.transform(m, lambda x, j: F.struct(x["b"].alias("b"), j.alias("j"), ((j == 0) | (F.get(m, j - 1)["b"] != x["b"])).alias("new"))), lambda x: x["new"])
            hashed = F.transform(heads, lambda x: F.struct(x["b"].alias("b"), F.xxhash64(F.transform(F.sort_array(F.transform(F.filter(F.slice(m, x["j"] + 1, F.lit(LENGTH)), lambda y: y["b"] == x["b"]), lambda y: F.struct(y["i"], y["h"].alias("h")))), lambda y: y["h"])).alias("s")))
            return let(F.map_from_entries(hashed), lambda d: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.element_at(d, b)))

        return let(least, grouped)

    none = F.array_repeat(F.lit(None).cast("bigint"), BANDS)
    return let(words_of(text), lambda w: F.when(F.size(w) == 0, none).otherwise(let(_numbered(w), signatures)))


def printed(b: Column) -> Column:
    """A fingerprint as a string."""
    return F.array_join(F.transform(b, lambda x: F.coalesce(F.hex(x), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return let(either, lambda n: F.when(n == 0, F.lit(1.0)).otherwise(same / n))


def neighbours(rows: DataFrame) -> DataFrame:
    """a, b, next_a, next_b for distinct rows(doc_id, a, b): the next row by descending doc_id, then a and b; after the last row the first.

    Rows are dealt to ranges of the order and numbered inside them; only the first row of each range, one for each partition, comes to the driver.
    """
    spark = rows.sparkSession
    order = [F.desc_nulls_last("doc_id"), F.asc("a"), F.asc("b")]
    ranged = cut(rows.select("doc_id", "a", "b").repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("d"), "a", "b")).alias("x")).select("part", "x.a", "x.b").collect()
    heads.sort()
    after = [(h.part, n.a, n.b) for h, n in zip(heads, heads[1:] + heads[:1], strict=True)]
    inside = Window.partitionBy("part").orderBy(*order)
    led = ranged.select("part", "a", "b", F.lead(F.struct("a", "b")).over(inside).alias("inner"))
    known = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(("part", "next_a", "next_b"), x, strict=True)) for x in after])), "array<struct<part:int,next_a:bigint,next_b:bigint>>")))
    return led.join(F.broadcast(known), "part").select("a", "b", F.coalesce("inner.a", "next_a").alias("next_a"), F.coalesce("inner.b", "next_b").alias("next_b"))


def edited(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are named by two hashes of id and text; equal rows are one name with a count, each the next of the one before. Texts are
    dealt out twice: whole, so that each sends its predecessor what the edit needs, and the first two thirds, which get that.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64(F.lit("a"), "doc_id", "text").alias("a"), F.xxhash64(F.lit("b"), "text", "doc_id").alias("b"))
    prints = cut(rows.select("doc_id", "a", "b", F.length("text").alias("n"), bands(F.col("text")).alias("f")), "prints")
    one = cut(prints.groupBy("a", "b").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("f").alias("f"), F.count("*").alias("copies")), "named")
    drop(prints)
    repeated = bool(one.where("copies > 1").take(1))
    following = one.select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), F.col("f").alias("next_f"))
    pairs = neighbours(one).join(one.select("a", "b", "n", "f", "copies"), ["a", "b"]).join(following, ["next_a", "next_b"])
    pairs = cut(pairs.select("a", "b", "next_a", "next_b", F.floor(F.col("n") / 3).cast("int").alias("m"), "f", likeness(F.col("f"), F.col("next_f")).alias("near"), "copies"), "pairs")
    drop(one)
    tails = rows.select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), "text").join(pairs, ["next_a", "next_b"])
    tails = tails.select("a", "b", "m", "f", "near", "copies", F.substring("text", F.lit(1), F.col("m")).alias("tail"))
    tails = cut(tails.dropDuplicates(["a", "b"]) if repeated else tails, "tails")
    drop(pairs)
    own = rows.select("doc_id", "a", "b", F.length("text").alias("n"), F.substring("text", F.lit(1), F.length("text") - F.floor(F.length("text") / 3).cast("int")).alias("head"))
    both = own.join(tails, ["a", "b"])
    if repeated:
        # Of equal rows the first in order is followed by the next text, the others by a copy of their own.
        same = both.where("copies > 1").dropDuplicates(["a", "b"]).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        same = same.withColumn("tail", F.when(F.col("i") == 1, F.col("tail")).otherwise(F.substring("head", F.lit(1), F.col("m")))).withColumn("near", F.when(F.col("i") == 1, F.col("near")).otherwise(1.0))
        both = both.where("copies = 1").unionByName(same.drop("i"))
    both = both.withColumn("edit", F.concat("head", "tail"))
    both = both.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), "f", "near", bands(F.col("edit")).alias("e"))
    return both.select("doc_id", "n_chars", "edited_sha256", printed(F.col("f")).alias("fingerprint"), printed(F.col("e")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), F.col("near").alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: fingerprints of all documents and their edited texts."""
    return edited(documents(spark, sf_dir))
