"""Quality rules: document statistics and a hashed n-gram log-likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import landed

BUCKETS = 65_536
SPACE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Nats per n-gram under which a text is further from the trusted texts than from the raw corpus.
THRESHOLD = -0.15


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: an expression inside a lambda would be computed again for every element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, the first included."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])))
            at = F.array_sort(F.transform(twice, lambda x: x["i"]))
            end = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(at, end, lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).cast("long").alias("n")),
                               lambda a: a["n"])

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(placed, count))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(windows(hashes), covered)))


def ngrams(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)))
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.pmod(F.xxhash64(F.get(words, i - 1), F.get(words, i)), F.lit(buckets))))
    return F.concat(single, F.coalesce(pairs, F.array().cast("array<bigint>")))


def statistics(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, grams) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words"), ngrams(words, buckets).alias("grams"))

    found = rows.select("doc_id", let(words_of(F.col("t")), of_words).alias("w"),
                        F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
                        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"))
    found = found.select("doc_id", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.grams")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


#: Trusted ids that are sent to all tasks, at most: some 50 MB.
SENT_IDS = 1_000_000


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Per bucket the log ratio (bucket, llr) of add-one smoothed multinomials: trusted documents over the raw corpus.

    ``trusted`` has the doc_id of every trusted document. Counts cover all rows of ``docs``; buckets that no text fills are
    left out. The number of rows never exceeds ``buckets``.
    """
    ids = trusted.select(F.col("doc_id").cast("long")).filter("doc_id is not null").distinct().withColumn("good", F.lit(1).cast("long"))
    # ids travel to the texts while there are few enough, else texts and ids meet by a shuffle
    ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).join(ids, "doc_id", "left")
    grams = rows.select(F.coalesce("good", F.lit(0).cast("long")).alias("good"), F.explode(let(words_of(F.col("t")), lambda w: ngrams(w, buckets))).alias("bucket"))
    counts = landed(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")), "buckets")
    whole = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = whole.first()
    share = F.log((F.col("good") + 1) / F.lit(float((good or 0) + buckets))) - F.log((F.col("raw") + 1) / F.lit(float((raw or 0) + buckets)))
    return counts.select("bucket", share.alias("llr"))


def judge(docs: DataFrame, trusted: DataFrame, *, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Statistics of every row with ``score``, the mean log ratio of its n-grams, and ``kept``.

    kept is false where the base rules fail, else whether score >= threshold: nothing is drawn at random, so equal texts get
    equal verdicts. A null or empty text has no words, score 0 and fails the base rules; null ids and repeated rows are
    judged like any other; without trusted documents the ratio compares with a flat multinomial; an empty table gives an
    empty result. Other columns are ignored.
    """
    weights = ratios(docs, trusted, buckets)
    rows = statistics(docs, buckets).withColumn("_row", F.monotonically_increasing_id())
    keys = ["_row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    grams = rows.select(*keys, F.explode_outer("grams").alias("bucket")).join(F.broadcast(weights), "bucket", "left")  # at most ``buckets`` rows
    scored = grams.groupBy(*keys).agg(F.coalesce(F.avg("llr"), F.lit(0.0)).alias("score"))
    return scored.drop("_row").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
