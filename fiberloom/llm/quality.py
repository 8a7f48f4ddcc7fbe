"""Quality rules and the log-likelihood ratio of hashed n-grams, in DataFrame functions only.

Two multinomials over hashed word n-grams (one and two words) are compared: one of trusted
documents, one of the whole raw corpus. A document's score is the mean log ratio of its n-grams;
every document is held against the same threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.llm.common import SPACES, let, words_of

#: Hash buckets of the two multinomials; the model is one array of as many numbers.
BUCKETS = 1 << 16
#: Counts added to what is seen and to what is expected, so that rare buckets say little.
PRIOR = 8.0
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.12
#: Trusted documents the target is fitted on at most, the first in order of a hash.
TRUSTED = 20_000
WINDOW = 8
#: Rules that fail a document whatever its score (fixed values).
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

SYMBOLS = "[#*$%&|<>]"
SPACE = " \t\n\x0b\x0c\r"

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def _pairs(hashes: Column, gap: int) -> Column:
    """Hash of each element with the one ``gap`` later; empty for short arrays."""
    n = F.greatest(F.size(hashes) - gap, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))


def _repeat_words(pairs: Column) -> Column:
    """Words that lie in windows occurring twice or more, from the hashes of word pairs."""

    def covered(windows: Column) -> Column:
        tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda k, d: F.coalesce(F.get(s, k)["h"] == F.get(s, k + d)["h"], F.lit(False))
            at = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(same(k, -1) | same(k, 1), F.get(s, k)["i"]))
            return F.array_sort(F.filter(at, lambda p: p.isNotNull()))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
        return F.aggregate(let(tagged, positions), start, step, lambda acc: acc["n"])

    unique = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    eight = lambda four: let(_pairs(four, 4), lambda w: F.when(unique(w), F.lit(0)).otherwise(covered(w)))
    return let(_pairs(pairs, 2), lambda four: F.when(unique(four), F.lit(0)).otherwise(eight(four)))  # no four words twice, no eight


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _buckets(text: Column) -> Column:
    both = let(_hashes(text), lambda h: F.concat(h, _pairs(h, 1)))
    return F.transform(both, lambda g: F.pmod(g, F.lit(BUCKETS)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", trusted: int = TRUSTED) -> DataFrame:
    """One row with ``model``: the log ratio of each bucket.

    The raw counts take every n-gram of every document, combined before the shuffle to at most
    ``BUCKETS`` rows a task. The target counts come from up to ``trusted`` labelled documents of
    quality 1 that are not toxic, the first in order of a hash of their id; that list is the only
    thing broadcast, and its size is that bound. Without any trusted document, or any document, all
    ratios are 0. Rows that repeat an id count each time; a null id is never trusted.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("__fl_trusted")).distinct()
    # A hash range that holds them, so that few ids are ordered in one task.
    share = 2.0 * trusted / max(1, good.count())
    within = F.xxhash64("__fl_trusted") <= F.lit(int(share * 2**64) - 2**63 if share < 1 else 2**63 - 1)
    good = good.where(within).orderBy(F.xxhash64("__fl_trusted"), "__fl_trusted").limit(trusted)
    rows = docs.select(F.col(f"`{doc_id}`").alias("__fl_id"), _buckets(F.col(f"`{text}`")).alias("__fl_b"))
    marked = rows.join(F.broadcast(good), F.col("__fl_id") == F.col("__fl_trusted"), "left")
    grams = marked.select(F.explode("__fl_b").alias("b"), F.when(F.col("__fl_trusted").isNotNull(), 1).otherwise(0).alias("t"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("r"), F.sum("t").alias("t"))
    # At most BUCKETS rows: their totals and the array are one small aggregation.
    all_in = counts.agg(F.sum("r").alias("rs"), F.sum("t").alias("ts"), F.sort_array(F.collect_list(F.struct("b", "r", "t"))).alias("c"))
    ratio = lambda x: F.when(F.col("ts") > 0, F.log((x["t"] + PRIOR) / (x["r"] * (F.col("ts") / F.col("rs")) + PRIOR))).otherwise(0.0)
    known = F.map_from_arrays(F.transform("c", lambda x: x["b"]), F.transform("c", ratio))
    spread = all_in.select(F.explode_outer(known).alias("b", "v"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0.0).alias("v")).unionByName(spread.where("b is not null"))
    dense = every.groupBy("b").agg(F.sum("v").alias("v"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "v"))), lambda x: x["v"]).alias("model"))


def judge(docs: DataFrame, model: DataFrame, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Append the counts of the base rules, ``base_failed``, the score ``llr`` and ``kept``.

    The model is read once as a scalar subquery, a single array. Nothing is shuffled, so an empty
    table gives an empty one. A null or empty text has no words, fails the base rules and scores 0.
    Texts are judged whole, whatever their length; a score at the threshold is kept. Repeated rows
    and null ids each get their verdict; input columns of the names appended are replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    score = lambda grams: F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(F.col("__fl_model"), F.pmod(g, F.lit(BUCKETS)).cast("int"))) / F.greatest(F.size(grams), F.lit(1))
    of_words = let(
        _hashes(F.col(f"`{text}`")),
        lambda h: let(_pairs(h, 1), lambda p: F.struct(F.size(h).cast("long").alias("n_words"), _repeat_words(p).cast("long").alias("n_repeat_words"), score(F.concat(h, p)).alias("llr"))),
    )
    out = docs.withColumn("__fl_model", model.scalar()).select(
        *kept,
        F.length(F.concat_ws("", F.split(whole, SPACES))).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        of_words.alias("__fl_words"),
    )
    out = out.select(*kept, F.col("__fl_words.n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("__fl_words.n_repeat_words"), F.col("__fl_words.llr"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
    return out.select(*kept, *COLUMNS)
