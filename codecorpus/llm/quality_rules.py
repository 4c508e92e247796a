"""Operator 7: quality rules with a hashed n-gram likelihood ratio.

Only DataFrame functions run on the main path. Every document gets base
counts (words, their characters, symbols, repeated lines, words in repeated
8-word windows) and one score: the log-likelihood ratio of its hashed
unigrams and bigrams between two multinomials, the trusted target (texts
labelled good) and the raw corpus (all texts), divided by the number of
n-grams. A document is kept if no base rule fails and the score reaches a
fixed threshold; the same threshold decides every document.

The raw counts cover every n-gram of every document, the target counts every
document labelled good. The model is one log ratio per bucket, a constant
array of the scoring scan, with the same number of buckets at every size. A
bucket's target count is compared with the count that the raw share predicts,
both raised by a constant (the posterior mean of a Poisson rate under a gamma
prior of mean 1): a bucket that a small target could not show says nothing,
and evidence grows with the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import let
from .common import WORD, Scratch, columns, held_out

#: Fixed values of the base rules.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Kept documents have at least this log ratio per n-gram. Set, with the
#: prior, on labels outside the held-out fold alone: learnt from those whose
#: crc32 leaves 0 when divided by 3, judged on those that leave 2 (README).
THRESHOLD = -0.06
#: Weight of the prior: target n-grams of a bucket that count as much as it.
PRIOR = 10.0
#: Trusted ids (16 bytes each) that are broadcast; more are joined.
BROADCAST_IDS = 2_000_000
#: Buckets of the hashed n-grams, at every size of target and corpus.
BUCKETS = 1 << 18


def words(text: Column) -> Column:
    """Words of a whole text, in order; no words for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def joined(h: Column, step: int) -> Column:
    """Hash of each position with the one ``step`` later; shorter by
    ``step``, empty if there is no such pair."""
    n = F.size(h) - step
    return F.when(n > 0, F.zip_with(F.slice(h, F.lit(1), F.greatest(n, F.lit(0))),
                                    F.slice(h, F.lit(step + 1), F.greatest(n, F.lit(0))),
                                    lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def repeated_cover(windows: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more: the sorted
    positions of repeated windows, each covering what the next one does not.
    Sorting instead of counting keeps it n log n for any length; texts
    without a repeated window (most) stop at the distinct test."""
    marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        n = F.size(s)
        same = lambda i, j: F.element_at(s, i + 1).h == F.element_at(s, j + 1).h
        hit = F.filter(s, lambda x, i: ((i > 0) & same(i, F.greatest(i - 1, F.lit(0))))
                       | ((i < n - 1) & same(i, F.least(i + 1, n - 1))))
        return F.sort_array(F.transform(hit, lambda x: x.i))

    def cover(p: Column) -> Column:
        last = F.size(p)
        return F.aggregate(F.transform(p, lambda x, i: F.when(i == last - 1, F.lit(WINDOW)).otherwise(
            F.least(F.lit(WINDOW), F.element_at(p, F.least(i + 2, last)) - x))), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        let(let(marked, positions), cover)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _hashed(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def log_ratios(documents: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id",
               text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS,
               prior: float = PRIOR) -> DataFrame:
    """(bucket, ratio) for every bucket: log of the n-grams of the target over
    those that the raw share predicts for it, both raised by ``prior``. Labels of the held-out fold are not read;
    a document with contradicting labels is not trusted; all trusted documents
    are counted. Without trusted texts every ratio is 0."""
    trusted = (columns(labels, _id=id_col, _y=label_col).where("_id is not null and _y is not null")
               .where(~held_out("_id")).groupBy("_id").agg(F.min("_y").alias("_y")).where("_y = 1"))
    trusted = scratch.save(trusted.select("_id", F.lit(1).alias("good")), "trusted")
    # ids alone go to every task up to a bound; beyond it texts meet them in a shuffle
    trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted.hint("merge")
    docs = columns(documents, _id=id_col, _text=text_col)
    grams = (docs.join(trusted, "_id", "left").select("good", _hashed(words(F.col("_text"))).alias("h"))
             .select("good", F.explode(F.concat("h", joined(F.col("h"), 1))).alias("g")))
    counts = (grams.groupBy(bucket(F.col("g"), buckets).alias("b"))
              .agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target")))
    counts = scratch.save(counts, "counts")
    sums = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    if not sums[1]:
        return every.withColumn("ratio", F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    predicted = zero("raw") * float(sums[1]) / float(sums[0])
    return every.join(counts, "b", "left").select("b", F.log((zero("target") + prior) / (predicted + prior)).alias("ratio"))


def quality_rules(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, score, kept.

    Null and empty texts have zero counts and score 0 and fail the base rule
    on words. Repeated rows are judged each; an empty table gives no rows."""
    scratch = Scratch(documents.sparkSession, "rules")
    ratios = log_ratios(documents, labels, scratch, id_col, text_col, buckets=buckets)
    # one row of ``buckets`` values whatever the corpus
    model = ratios.agg(F.sort_array(F.collect_list(F.struct("b", "ratio"))).alias("m")).select(
        F.array_join(F.transform("m.ratio", lambda x: F.round(x, 9).cast("string")), ",")).first()
    model = F.split(F.lit(model[0]), ",").cast("array<double>")
    docs = columns(documents, doc_id=id_col, text=text_col).withColumn("ws", words(F.col("text")))
    docs = docs.select(
        "doc_id", F.size("ws").cast("long").alias("n_words"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"), _hashed(F.col("ws")).alias("h1"))
    docs = docs.withColumn("h2", joined(F.col("h1"), 1))
    windows = let(joined(F.col("h2"), 2), lambda h4: joined(h4, 4))
    add = lambda h: F.aggregate(h, F.lit(0.0), lambda a, g: a + F.element_at(model, bucket(g, buckets) + 1))
    n = F.size("h1") + F.size("h2")
    docs = docs.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        let(windows, repeated_cover).alias("n_repeat_words"),
        F.when(n > 0, add(F.concat("h1", "h2")) / n).otherwise(0.0).alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return docs.select(*docs.columns[:-1], failed.alias("base_failed"), "score",
                       (~failed & (F.col("score") >= threshold)).alias("kept"))
