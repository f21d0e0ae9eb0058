"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / quality weight, with u from a hash of its id and text, so reruns agree. A
source whose target is e times its size and a rest gets e complete epochs; the rest goes to the documents of least key, in
order, until their sizes reach it (the last one is taken if that brings the sum nearer to the target).

The order inside a source is found in two steps, without sorting a source in one task: sizes are summed over BINS ranges of the
key, the range where the running sum crosses the budget is known from those sums, and only its documents are sorted.

Defined cases: a null text has size 0; a null source is one of the sources and the last; documents of size 0 are taken with
their source's epochs and count nothing; rows of equal id and text are numbered and draw a key each; an empty table gives no rows. Null
ids are hashed as such; extra columns, whatever their names, are ignored by shares and kept by mix; only sizes of texts are held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents

#: Weights of the sources in order, repeating; share of all sizes that the targets add up to; most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
BINS = 4096


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column, words: Column) -> Column:
    """A weight in (0, 1]: 1 for plain prose, less with symbols among the words."""
    return (words.cast("double") + 1) / (words + 1 + F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>!]")), F.lit(0)))


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with _size, _weight and _tie, which names id and text. One pass over the texts, no shuffle."""
    n = size(F.col(text))
    return docs.withColumn("_size", n).withColumn("_weight", quality(F.col(text), F.col("_size"))).withColumn("_tie", F.xxhash64(F.lit("mix"), F.col(id), F.col(text)))


def drawn(rows: DataFrame) -> DataFrame:
    """rows with _key, the exponential key of the _i-th of rows with equal _tie."""
    u = (F.xxhash64("_tie", "_i").bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))
    return rows.withColumn("_key", -F.log(u) / F.col("_weight"))


def numbered(narrow: DataFrame) -> DataFrame:
    """narrow with _i: equal rows are counted before they are dealt out and numbered, so a large group of them is never in one task."""
    counted = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("_n"))
    return counted.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")


def _bin(key: Column) -> Column:
    return F.floor((1 - F.exp(-key)) * BINS).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target from sizes(source, source_size): a row for each source, so one task orders them.

    Capped sharing by weight has a closed form: order the sources by the level cap / weight at which they are full; the first
    ones are full, the others share what is left by weight.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * epochs
    level = cap / F.col("weight")
    below = Window.orderBy("level", F.asc_nulls_last("source"))
    rows = (
        sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", level)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("before", F.coalesce(F.sum("cap").over(below.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(below.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("share", (F.col("total") * share - F.col("before")) / F.col("left"))
        # The first source whose level is above its share, and all after it, are not full.
        .withColumn("open", F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", F.coalesce("source", F.lit("")).alias("s"), "share")))
                    .over(Window.partitionBy())["share"])
    )
    target = F.when(F.col("level") <= F.coalesce("open", F.lit(float("inf"))), F.col("cap").cast("double")).otherwise(F.col("open") * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def plan(narrow: DataFrame) -> DataFrame:
    """source, source_size, target, full (epochs) and the last selected bin, key and tie from narrow(source, _size, _tie, _key)."""
    binned = narrow.groupBy("source", _bin(F.col("_key")).alias("bin")).agg(F.sum("_size").alias("n"))
    binned = cut(binned, "mix-bins")
    goals = targets(binned.groupBy("source").agg(F.sum("n").alias("source_size")))
    goals = goals.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = cut(goals.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "mix-goals")
    # At most BINS rows of each source.
    up_to = F.sum("n").over(Window.partitionBy("source").orderBy("bin"))
    crossing = (
        binned.withColumn("up_to", up_to).alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
        .where("rest > 0 and up_to >= rest and up_to - n < rest").select(F.col("b.source").alias("at"), "bin", (F.col("up_to") - F.col("n")).alias("base"), "rest")
    )
    inside = narrow.join(crossing, F.col("source").eqNullSafe(F.col("at")) & (_bin(F.col("_key")) == F.col("bin")))
    order = Window.partitionBy("at").orderBy("_key", "_tie")
    ordered = inside.withColumn("sum", F.col("base") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Taken while the sum after a document is nearer to the rest than the sum before it.
    last = ordered.where(2 * (F.col("rest") - F.col("sum")) + F.col("_size") >= 0).groupBy("at").agg(F.max(F.struct("_key", "_tie")).alias("last"))

    edge = crossing.join(last.withColumnRenamed("at", "of"), F.col("at").eqNullSafe(F.col("of")), "left").select(F.col("at").alias("edge_of"), F.col("bin").alias("edge_bin"), F.col("last._key").alias("last_key"), F.col("last._tie").alias("last_tie"))
    return cut(goals.join(edge, F.col("source").eqNullSafe(F.col("edge_of")), "left").drop("edge_of", "rest"), "mix-plan")


def copies(rows: DataFrame, planned: DataFrame, source: str = "source") -> DataFrame:
    """rows (with _key and _tie) with source_size, target and _copies. The plan is a small table as a rule; Spark sees its size and broadcasts it, or splits skewed joins."""
    p = planned.select(F.col("source").alias("_of"), "source_size", "target", "full", "edge_bin", "last_key", "last_tie")
    b = _bin(F.col("_key"))
    extra = (b < F.col("edge_bin")) | ((b == F.col("edge_bin")) & ((F.col("_key") < F.col("last_key")) | ((F.col("_key") == F.col("last_key")) & (F.col("_tie") <= F.col("last_tie")))))
    return rows.join(p, F.col(source).eqNullSafe(F.col("_of")), "left").withColumn("_copies", F.col("full") + F.coalesce(extra, F.lit(False)).cast("long")).drop("_of", "full", "edge_bin", "last_key", "last_tie")


def shares(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    narrow = cut(drawn(numbered(keyed(docs.select("doc_id", "text", "source")).select("doc_id", "source", "_size", "_weight", "_tie"))), "mix-keys")
    out = copies(narrow, plan(narrow))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as many times as it is taken, with its columns.

    Only rows that share id and text with others (as a rule none) are dealt out to be numbered.
    """
    held = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "text", "source")).select("_doc", "source", "_size", "_weight", "_tie")
    narrow = held.drop("_doc")
    planned = plan(drawn(numbered(narrow)))
    again = cut(narrow.groupBy("_tie").agg(F.count("*").alias("_n")).where("_n > 1").select("_tie"), "mix-repeated")
    first = held.withColumn("_i", F.lit(0).cast("long"))
    if again.take(1):
        place = F.row_number().over(Window.partitionBy("source", "_tie").orderBy(F.xxhash64(F.to_json("_doc")), F.monotonically_increasing_id())) - 1
        first = held.join(again, "_tie", "left_anti").withColumn("_i", F.lit(0).cast("long")).unionByName(held.join(again, "_tie", "left_semi").withColumn("_i", place.cast("long")).select(*held.columns, "_i"))
    taken = copies(drawn(first), planned).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what the mix takes of each document."""
    return shares(documents(spark, sf_dir))
