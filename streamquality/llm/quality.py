"""Quality rules: counts that reject by themselves, and a log-likelihood ratio under two bags of
hashed n-grams, of a trusted target and of the raw corpus.

Words and pairs of neighbouring words fall into ``buckets`` by hash. Each bucket's count over all
texts and over the trusted ones gives two multinomials; one is added to each
raw count, and the target is shrunk towards the raw corpus by ``buckets`` n-grams' worth, so few
trusted texts say little. A text's score is the mean, over its n-grams, of log p(target) - log p(raw), where each n-gram is compared with the
corpus without itself: else a text's own rare words count against it unless it is trusted. It is
rejected where the mean falls below ``threshold``: no draw is involved, and every text is judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .columns import indexes, let, total, words

BUCKETS = 10_000
THRESHOLD = -0.13


def grams(ws: Column, buckets: int) -> Column:
    """Buckets of all words and all pairs of neighbours."""
    one = F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(indexes(1, F.size(ws)), lambda i: F.pmod(
        F.xxhash64(F.get(ws, i - 1), F.get(ws, i)), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def repeated_words(ws: Column) -> Column:
    """Words that lie in a three-word window which the text holds twice or more."""
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def starts(p: Column) -> Column:
            twice = F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))
        def lengths(at: Column) -> Column:
            return F.transform(at, lambda i, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), i - F.get(at, k - 1))))
        found = let(pairs, starts)
        return let(found, lambda at: total(lengths(at), F.lit(0)))

    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))
    windows = F.transform(indexes(2, F.size(ws)), lambda i: F.xxhash64(F.get(ws, i - 2), F.get(ws, i - 1), F.get(ws, i)))
    return let(windows, of)


def filtered(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that :func:`rules` keeps, with all their columns."""
    tie = F.xxhash64(F.col(text))
    judged = rules(docs.select(key, text, tie.alias("_tie")), trusted, key, text, carry=("_tie",), **settings)
    kept = judged.filter("kept").select(F.col(key).alias("_key"), "_tie").distinct()
    return docs.join(kept, F.col(key).eqNullSafe(F.col("_key")) & (tie == F.col("_tie")), "left_semi")


def model(docs: DataFrame, trusted: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """One row of ``raw``, ``target``: counts by bucket over all texts and over the trusted. The
    counts are summed where the texts are; ``buckets`` rows meet."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        each = df.select(F.explode(let(words(F.col(text)), lambda ws: grams(ws, buckets))).alias("bucket"))
        return each.groupBy("bucket").agg(F.count("*").alias(name))
    # labels grow with the corpus, so they are not broadcast at any size
    known = docs.select(key, text).join(trusted.select(key).distinct().hint("merge"), key, "left_semi")
    both = (docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(counted(docs, "raw"), "bucket", "left").join(counted(known, "target"), "bucket", "left"))
    entry = F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    rows = both.agg(F.sort_array(F.collect_list(entry)).alias("m"))
    return rows.select(F.transform("m", lambda x: x["raw"]).alias("raw"), F.transform("m", lambda x: x["target"]).alias("target"))


def ratios(counts: DataFrame, buckets: int) -> DataFrame:
    """One row of ``plain``, ``own``: the log ratio of each bucket for texts outside and inside
    the target, each n-gram left out of the counts it is compared with."""
    sums = counts.withColumns({"r": (total(F.col("raw"), F.lit(0).cast("long")) + buckets).cast("double"),
                               "t": (total(F.col("target"), F.lit(0).cast("long")) + buckets).cast("double")})

    def ratio(own: int):
        def of(x: Column) -> Column:
            p = (F.greatest(x["raw"] - 1, F.lit(0)) + 1) / F.col("r")
            return F.log((F.greatest(x["target"] - own, F.lit(0)) + buckets * p) / F.col("t")) - F.log(p)
        return of
    at = F.arrays_zip("raw", "target")
    return sums.select(F.transform(at, ratio(0)).alias("plain"), F.transform(at, ratio(1)).alias("own"))


def rules(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
          threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score,
    kept`` of every row, and the columns of ``carry``. ``trusted`` lists keys of the target; keys
    without a text don't matter.

    A null text has no words and fails the base. Repeated rows are judged alike. A text without
    n-grams scores 0, and so does every text where none is trusted. Only the narrow result is joined with ``trusted``;
    texts move once, for those of the target."""
    learnt = stage(ratios(model(docs, trusted, key, text, buckets), buckets), "quality-ratios")
    docs = docs.select(key, text, *carry, *[learnt.select(c).scalar().alias(f"ratios_{c}") for c in ("plain", "own")])
    plain, own = F.col("ratios_plain"), F.col("ratios_own")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")

    def mean(gs: Column, table: Column) -> Column:
        return let(table, lambda m: F.when(F.size(gs) > 0, total(F.transform(gs, lambda b: F.get(m, b)), F.lit(0.0)) / F.size(gs)).otherwise(0.0))

    judged = let(words(F.col(text)), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"), repeated_words(ws).cast("long").alias("n_repeat_words"),
        let(grams(ws, buckets), lambda gs: F.struct(mean(gs, plain).alias("plain"), mean(gs, own).alias("own"))).alias("mean")))
    rows = docs.select(
        F.col(key), *carry, judged.alias("j"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    rows = stage(rows.select(key, *carry, "j.n_words", "word_chars", "n_symbols", "n_dup_lines", "j.n_repeat_words",
                             F.col("j.mean.plain").alias("plain"), F.col("j.mean.own").alias("own")), "quality-judged")
    marks = trusted.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("known", F.lit(True))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    score = F.when(F.col("known"), F.col("own")).otherwise(F.col("plain"))
    return rows.join(marks, key, "left").select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        score.alias("score"), (~failed & (score >= threshold)).alias("kept"), *carry)
