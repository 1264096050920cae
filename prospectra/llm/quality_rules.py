"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio.

After Xie et al., "Data Selection for Language Models via Importance Resampling"
(NeurIPS 2023): hashed n-grams of a trusted target and of the raw corpus give two
multinomials; a document's score is the mean log ratio of its n-grams, and each
document is kept or not by a fixed threshold on it instead of by resampling.
The n-grams are words, the characters at both ends of each word, and word pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, stored, text_or_empty

#: A power of two.
BUCKETS = 1 << 15
#: Trusted ids (some 32 bytes each in memory) up to which they are broadcast.
BROADCAST_TRUSTED = 2_000_000
#: A power of two.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of words
SYMBOLS = "#*$%&|<>"
#: Mean log ratio from which on a document is kept.
THRESHOLD = -0.25
SMOOTHING = 0.5
EDGE = 3
GRAMS_PER_WORD = 4


def words_of(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return."""
    return F.array_remove(F.split(text, SPACE), "")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(word: Column, mine: Column, after: Column) -> list[Column]:
    """Buckets of a word's n-grams, GRAMS_PER_WORD of them, from the word, its hash and that
    of the next word; the last word's pair is that with the end of the text."""
    hashes = (
        mine,
        F.xxhash64(F.right(word, F.lit(EDGE)), F.lit(1)),
        F.xxhash64(F.left(word, F.lit(EDGE)), F.lit(2)),
        F.xxhash64(mine, after, F.lit(3)),
    )
    return [h.bitwiseAND(F.lit(BUCKETS - 1)) for h in hashes]


def _gram_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, bucket): one row for each n-gram of each text. Words become rows before they
    are hashed, for which Spark generates code, unlike for functions over arrays."""
    hashed = rows.select(*keep, words_of(F.col("text")).alias("words")).select(*keep, "words", _hashed(F.col("words")).alias("mine"))
    after = F.slice("mine", 2, F.greatest(F.size("mine"), F.lit(0))).alias("after")
    each = hashed.select(*keep, "words", "mine", after).select(*keep, F.inline(F.arrays_zip(F.col("words").alias("word"), "mine", "after")).alias("word", "mine", "after"))
    return each.select(*keep, F.explode(F.array(*_grams(F.col("word"), F.col("mine"), F.col("after")))).alias("bucket"))


def gram_counts(docs: DataFrame, target: DataFrame, size: int) -> DataFrame:
    """(bucket, raw, target): n-grams of all rows of ``docs`` and of those whose doc_id is
    among ``target`` (_trusted, ``size`` of them, each once). Up to BROADCAST_TRUSTED ids
    are broadcast and mark the rows in one pass, in which no text is shuffled. Beyond that
    all rows are counted without a join, and only the trusted ones are counted apart."""
    rows, same = docs.select("doc_id", F.col("text").cast("string").alias("text")), F.col("doc_id") == F.col("_trusted")
    if size <= BROADCAST_TRUSTED:
        marked = rows.join(F.broadcast(target), same, "left").withColumn("in_target", F.col("_trusted").isNotNull().cast("int"))
        return _gram_rows(marked, "in_target").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("in_target").alias("target"))
    raw = _gram_rows(rows).groupBy("bucket").agg(F.count("*").alias("raw"))
    trusted = _gram_rows(rows.join(target, same, "left_semi")).groupBy("bucket").agg(F.count("*").alias("target"))
    return raw.join(trusted, "bucket", "left").select("bucket", "raw", F.coalesce("target", F.lit(0)).alias("target"))


def weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, weight): log of the target's over the corpus's smoothed share.

    ``trusted`` has the doc_id of documents of the target; all of them are counted.
    Counts run over the n-grams of all documents, pre-aggregated into at most BUCKETS sums
    a task.
    """
    # cut off from its aggregate, so that the rows of a much-repeated or null id can be split
    target = cut(trusted.select(F.col("doc_id").alias("_trusted")).filter("_trusted is not null").distinct())
    size = target.count()
    # at most BUCKETS rows; read twice below
    counts = stored(gram_counts(docs, target, size), "rule-counts")
    every = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
    every = every.select("bucket", *[(F.coalesce(c, F.lit(0)) + SMOOTHING).alias(c) for c in ("raw", "target")])
    sums = every.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets")).first()
    ratio = F.log((F.col("target") / sums.targets) / (F.col("raw") / sums.raws))
    return every.select("bucket", (ratio if size else F.lit(0.0)).alias("weight"))


def counts_of(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` with words, _hashed (a hash of each), n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words of each text."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    symbols = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    first = docs.withColumn("_text", text_or_empty(F.col("text").cast("string"))).withColumn("words", words_of(text))
    first = first.withColumn("_hashed", _hashed(F.col("words")))
    # hashes of windows of 1, 2, 4 and 8 words, each made of those of its halves
    first, reach = first.withColumn("_of", F.col("_hashed")), 1
    while reach < WINDOW:
        later = F.slice("_of", reach + 1, F.size("_of"))
        first, reach = first.withColumn("_of", F.zip_with("_of", later, lambda x, y: F.xxhash64(x, y))), 2 * reach
    second = first.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": symbols.cast("long"),
            "_lines": lines,
            "_windows": F.when(F.size("words") >= WINDOW + 1, F.slice("_of", 1, F.size("words") - (WINDOW - 1))),
        }
    )
    third = second.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_sorted": F.when(
                F.size(F.array_distinct("_windows")) < F.size("_windows"),
                F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        }
    )
    # neighbours in the order of hashes that are equal: begins of repeated windows
    fourth = third.withColumn(
        "_begins",
        F.expr(
            "sort_array(transform(filter(zip_with(zip_with(_sorted, slice(_sorted, 2, size(_sorted)), (x, y) -> struct(x.h AS h, x.i AS i, y.h AS after)),"
            " concat(array(cast(null AS struct<h: bigint, i: int>)), slice(_sorted, 1, size(_sorted) - 1)),"
            " (x, y) -> struct(x.i AS i, x.h = x.after OR x.h = y.h AS again)), x -> x.again), x -> x.i))"
        ),
    )
    covered = F.expr(
        f"aggregate(zip_with(_begins, slice(_begins, 2, size(_begins)), (x, y) -> least({WINDOW}, coalesce(y - x, {WINDOW}))), 0L, (s, x) -> s + x)"
    )
    return fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_text", "_lines", "_of", "_windows", "_sorted", "_begins")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, log_ratio) of each row of ``docs``.

    Null and empty texts have no words, fail the base rules and have no log ratio.
    Without a trusted document every ratio is 0. A ratio equal to the threshold is kept.
    Repeated rows come back as often; a text of any length is read whole; other columns
    are ignored. An empty table gives an empty result.
    """
    table = stored(weights(docs, trusted), "rule-weights")
    # BUCKETS numbers as one value
    known = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("w"))
    counted = counts_of(docs.select(F.col("doc_id").cast("long"), "text"))
    weigh = lambda w, i: sum((F.get("_w", g.cast("int")) for g in _grams(w, F.get("_hashed", i), F.get("_hashed", i + 1))), F.lit(0.0))
    each = F.transform("words", weigh)
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    scored = counted.withColumn("_w", known.scalar()).withColumn("log_ratio", F.when(F.col("n_words") > 0, total / (GRAMS_PER_WORD * F.col("n_words"))))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(F.col("log_ratio") >= threshold).alias("kept"),
        "log_ratio",
    )
