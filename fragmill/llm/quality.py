"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A text's junk score is the largest of four shares: symbols per word, repeated words, repeated lines, and capitals or exclamation
marks among the characters of words. Per stratum (language) a cutoff on the score is chosen on labelled holdouts: for each
cutoff of a grid, the exact binomial bound (Clopper-Pearson) on the share of good texts that it would reject must stay under
RISK, at confidence 1 - DELTA shared by all strata and cutoffs (Bonferroni). Of the valid cutoffs the one that separates the
labelled texts best is taken. A stratum without enough labelled texts has no cutoff and rejects nothing.

Defined cases: a null text has no words; labels are joined by doc_id, a document labelled twice is good only if all its labels
are; null labels and labels without a document count for nothing; documents with equal ids are judged one by one; a null
language is a stratum; every language is one of its own, and one without labels rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, let, words_of

RISK, DELTA = 0.05, 0.05
#: Cutoffs are GRID equal steps of the score from 0 to 1.
GRID = 20
WINDOW = 5


def _covered(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes in order."""

    def spread(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

    numbered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(numbered, spread))


def measures(text: Column) -> Column:
    """The counts of one text, as a struct. Windows are compared by a 64-bit hash within their text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column) -> Column:
        windows = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            let(windows, _covered).alias("n_repeat_words"),
        )

    def both(counts: Column, of_lines: Column) -> Column:
        return F.struct(
            counts["n_words"].alias("n_words"), counts["word_chars"].alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(of_lines) - F.size(F.array_distinct(of_lines))).cast("long").alias("n_dup_lines"), counts["n_repeat_words"].alias("n_repeat_words"),
            F.size(of_lines).cast("long").alias("n_lines"), F.regexp_count(text, F.lit(r"[\p{Lu}!]")).cast("long").alias("n_shouted"),
        )

    return let(let(words_of(text), of), lambda c: let(lines, lambda x: both(c, x)))


def score(m: Column) -> Column:
    share = lambda a, b: m[a] / F.greatest(m[b], F.lit(1))
    return F.greatest(share("n_symbols", "n_words"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"), share("n_shouted", "word_chars"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def _allowed(n: Column, tests: Column, risk: float, delta: float) -> Column:
    """The most false rejections k of n good texts for which P(Bin(n, risk) <= k) <= delta / tests; -1 if there are none."""
    step = F.log(F.lit(risk / (1 - risk)))
    start = F.struct((n * F.log(F.lit(1 - risk))).alias("ln"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))

    def add(a: Column, j: Column) -> Column:
        total = a["sum"] + F.exp(a["ln"])
        left = F.greatest(n - j, F.lit(1)).cast("double")
        return F.struct((a["ln"] + F.log(left / (j + 1)) + step).alias("ln"), total.alias("sum"), F.when(total <= delta / tests, j).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * risk).cast("long")), start, add, lambda a: a["k"])


def cutoffs(scored: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, c), the cutoff of each stratum that has one, from scored(doc_id, stratum, score)."""
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    step = F.least(F.ceil(F.col("score") * GRID), F.lit(GRID + 1)).cast("int")
    counted = cut(scored.join(truth, "doc_id").groupBy("stratum", step.alias("step")).agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad")), "holdout")
    of = counted.groupBy("stratum").agg(F.sum("good").alias("n"), F.collect_list(F.struct("step", "good", "bad")).alias("steps"))  # at most GRID + 2 steps each
    tests = of.agg((F.count("*") * GRID).alias("tests"))
    above = lambda c, what: F.aggregate(F.filter("steps", lambda x: x["step"] > c), F.lit(0).cast("long"), lambda a, x: a + x[what])
    tried = (
        of.join(F.broadcast(tests)).withColumn("allowed", _allowed(F.col("n"), F.col("tests"), risk, delta))
        .withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(GRID))))
        .select("stratum", "c", "allowed", above(F.col("c"), "good").alias("lost"), above(F.col("c"), "bad").alias("caught"))
        .where("lost <= allowed and caught > lost")
    )
    return cut(tried.groupBy("stratum").agg(F.max(F.struct(F.col("caught") - F.col("lost"), "c"))["c"].alias("c")), "cutoffs")


def _judged(scored: DataFrame, best: DataFrame) -> DataFrame:
    """scored with `kept`. The cutoffs have a row per language: Spark broadcasts them while they are small."""
    own = best.select(F.col("stratum").alias("s"), "c")
    out = scored.join(own, F.col("stratum").eqNullSafe(F.col("s")), "left")
    passed = F.coalesce(F.ceil(F.col("score") * GRID) <= F.col("c"), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & passed).drop("s", "c", "stratum", "score")


def _scored(docs: DataFrame) -> DataFrame:
    m = F.col("m")
    return docs.select("doc_id", F.col("lang").alias("stratum"), measures(F.col("text")).alias("m")).select(
        "doc_id", "stratum", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", base_failed(m).alias("base_failed"), score(m).alias("score"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document. The measures are written once: texts are read in one pass."""
    scored = cut(_scored(docs), "measures")
    best = cutoffs(scored.select("doc_id", "stratum", "score"), labels)
    return _judged(scored, best)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Texts are measured twice rather than shuffled."""
    best = cutoffs(_scored(docs).select("doc_id", "stratum", "score"), labels)
    m = F.col("_m")
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col("lang").alias("stratum"), measures(F.col("text")).alias("_m")).select("_row", "stratum", base_failed(m).alias("base_failed"), score(m).alias("score"))
    return _judged(inner, best).where("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: counts and verdicts of all documents, with cutoffs from all labels."""
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
