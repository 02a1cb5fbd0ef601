"""Quality rules and a likelihood-ratio test against a trusted target, with DataFrame functions only.

Words and pairs of neighbouring words are hashed into BUCKETS. Two multinomials are counted: one over the trusted
documents (a bounded sample of those labelled good), one over the whole corpus. A document's score is the mean over its
features of ln p_target - ln p_corpus; it is kept if no rule fails and the score reaches THRESHOLD.

The counts shuffle one row for each bucket and task. The table of ratios has BUCKETS numbers, whatever the corpus size,
and reaches the rows as one constant. All else happens within the row.

Nulls: a null text has no words and fails; a null doc_id stays a row. Repeated rows give repeated rows and count twice.
Extra columns are ignored. Without labels or documents the ratios are 0 and only the rules decide. Scores are rounded to
6 places, and one equal to THRESHOLD is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm.shared import let, read_table

BUCKETS, SMOOTHING, THRESHOLD = 1 << 14, 1.0, -0.08
#: Trusted documents at most (a bounded sample: the smallest hashes of doc_id).
TRUSTED = 20_000
BLANK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BLANK), "")


def features_of(words: Column) -> Column:
    """Buckets of all words, then of all pairs of neighbours."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)))
    two = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(F.get(words, i), w), F.lit(BUCKETS)))
    return F.concat(one, two)


def ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """ln p_target - ln p_corpus for each bucket."""
    ranked = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    trusted = ranked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED).select("doc_id", F.lit(1).alias("good"))
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words")).join(F.broadcast(trusted), "doc_id", "left")
    rows = rows.select("good", F.explode(features_of(F.col("words"))).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("all"), F.count("good").alias("good")).collect()  # at most BUCKETS rows
    every, good = sum(r["all"] for r in counts), sum(r["good"] for r in counts)
    unseen = math.log(SMOOTHING / (good + SMOOTHING * BUCKETS)) - math.log(SMOOTHING / (every + SMOOTHING * BUCKETS))
    out = [unseen if good else 0.0] * BUCKETS
    if good:
        for r in counts:
            out[r["bucket"]] = math.log((r["good"] + SMOOTHING) / (good + SMOOTHING * BUCKETS)) - math.log((r["all"] + SMOOTHING) / (every + SMOOTHING * BUCKETS))
    return out


def repeated_words(words: Column) -> Column:
    """Places, in order, of the windows of three words that stand at two or more places.

    A window is one number: its hash above its place, which takes as many bits as the text's number of words needs.
    Sorted, equal windows are neighbours, unless another window with the same hash bits stands between them: a text in
    which neighbours agree in the hash but not in the words is sorted by the words themselves.
    """

    def by_hash(bits: Column) -> Column:
        window = lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long"))
        head = lambda x: F.call_function("shiftright", x, bits)
        place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

        def same_words(a: Column, b: Column) -> Column:
            return (F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2))

        def settled(doubled: Column) -> Column:
            # doubled: windows that share their hash with a neighbour, still sorted
            clash = F.exists(F.transform(doubled, lambda x, i: (i > 0) & (head(x) == head(F.get(doubled, i - 1))) & ~same_words(place(x), place(F.get(doubled, i - 1)))), lambda x: x)
            return F.when(F.coalesce(clash, F.lit(False)), by_words).otherwise(F.sort_array(F.transform(doubled, place)))

        ordered = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
        doubled = lambda s: F.filter(s, lambda x, i: F.coalesce(head(x) == head(F.get(s, i - 1)), F.lit(False)) | F.coalesce(head(x) == head(F.get(s, i + 1)), F.lit(False)))
        return let(ordered, lambda s: let(doubled(s), settled))

    spelt = lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("at"))
    equal = lambda s: F.filter(s, lambda x, i: F.coalesce(x["w"] == F.get(s, i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False)))
    by_words = let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), spelt)), lambda s: F.sort_array(F.transform(equal(s), lambda x: x["at"])))
    return F.when(F.size(words) >= 3, let(F.length(F.bin(F.size(words).cast("long"))), by_hash)).otherwise(F.array().cast("array<int>"))


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, words and the rule figures of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w))
    rows = rows.select("doc_id", "words", chars.alias("word_chars"), F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"))
    rows = rows.select("doc_id", "words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("places"))
    covered = F.aggregate(F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the rule figures, base_failed, score (mean log-likelihood ratio) and kept of every document."""
    table = ratios(docs, labels)
    ratio = F.split(F.lit(",".join(f"{x:.6g}" for x in table)), ",").cast("array<double>")
    rows = rules(docs)
    features = features_of(F.col("words"))
    total = F.aggregate(features, F.lit(0.0), lambda acc, b: acc + F.get(ratio, b.cast("int")))
    rows = rows.withColumn("score", F.round(total / F.nullif(2 * F.col("n_words") - 1, F.lit(-1)), 6))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("score") >= THRESHOLD, F.lit(False))).drop("words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
