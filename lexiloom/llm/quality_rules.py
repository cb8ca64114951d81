"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame terms only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 14
TRUSTED_ROWS = 20_000
LEAST = -0.3
KINDS = 3


def split_words(text: Column, separator: str) -> Column:
    """Non-empty words between runs of a separator (regular expression)."""
    return F.transform(F.array(F.split(text, separator)), _without_ends)[0]


def _without_ends(a: Column) -> Column:
    first = (a[0] == "").cast("int")
    last = ((F.size(a) > 1) & (F.element_at(a, -1) == "")).cast("int")
    return F.slice(a, first + 1, F.size(a) - first - last)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, n: int = 3) -> Column:
    """How many words stand in a window of n words found twice or more.

    Windows are hashed and sorted, so that equal ones are neighbours; only for
    texts that have any are positions sorted along. No step is quadratic."""

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))

    def any_equal(h: Column) -> Column:
        return F.transform(F.array(F.sort_array(h)), lambda s: F.size(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))) > 0)[0]

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.when(i == 0, F.lit(n)).otherwise(F.least(x - F.get(p, i - 1), F.lit(n))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        at = F.transform(F.array(pairs), places)
        return F.transform(at, total)[0]

    count = F.transform(F.array(hashed(words)), lambda h: F.when(any_equal(h), covered(h)).otherwise(F.lit(0).cast("long")))[0]
    return F.when(F.size(words) < n + 1, F.lit(0).cast("long")).otherwise(count)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0]


def _bucket(kind: int, *of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(BUCKETS)).cast("int") + kind * BUCKETS


def _features(word: Column, following: Column) -> list[Column]:
    """Buckets of a word, of it with the next one, and of its last three characters."""
    return [_bucket(0, word), _bucket(1, word, following), _bucket(2, F.right(word, F.lit(3)))]


def corpus_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams in all documents and in trusted ones. At
    most 3 * 16384 rows, summed before the shuffle. ``trusted`` (doc_id) has a
    documented bound and is broadcast."""
    ids = F.broadcast(trusted.select(F.col("doc_id").alias("_trusted")).distinct())
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_trusted"), "left")
    words = marked.select(F.col("_trusted").isNotNull().cast("long").alias("hit"), split_words(F.coalesce("text", F.lit("")), SPACE).alias("words"))
    pairs = words.select("hit", F.inline(F.arrays_zip(F.col("words").alias("w"), F.slice(F.col("words"), 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("v"))))
    pairs = pairs.toDF("hit", "w", "v")
    features = pairs.select("hit", F.explode(F.array(*_features(F.col("w"), F.coalesce("v", F.lit(""))))).alias("bucket"))
    return features.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("hit").alias("target"))


def ratios(counts: DataFrame, smoothing: float = 1.0) -> list[float]:
    """log of target share over raw share for each bucket; a bucket without
    counts, or a corpus without trusted documents, gives 0."""
    raw, target = [0] * (KINDS * BUCKETS), [0] * (KINDS * BUCKETS)
    for r in counts.collect():  # bounded by the number of buckets
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    out: list[float] = []
    for k in range(KINDS):
        a, b = raw[k * BUCKETS : (k + 1) * BUCKETS], target[k * BUCKETS : (k + 1) * BUCKETS]
        n, m = sum(a), sum(b)
        for x, y in zip(a, b, strict=True):
            p, q = (y + smoothing * x / max(n, 1)) / (m + smoothing) if m else 0.0, x / n if n else 0.0
            share = (m * p + BUCKETS * q) / (m + BUCKETS) if m else 0.0  # rare buckets lean on the raw share
            out.append(math.log(share / q) if m and x and share else 0.0)
    return out


def _table(values: list[float]) -> Column:
    """A constant array, folded to a literal when the plan is optimised."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however the optimiser moves
    or repeats what is made of it."""
    return F.transform(F.array(value), use)[0]


def verdict(text: Column, table: list[float]) -> Column:
    """Struct of a text's measures, llr (mean log ratio of its n-grams; 0
    without words), base_failed and kept. One expression over words that are
    split once: a filter on it can be pushed down whole."""
    lookup = [_table(table[k * BUCKETS : (k + 1) * BUCKETS]) for k in range(KINDS)]

    def llr(words: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            buckets = _features(word, F.coalesce(F.get(words, i + 1), F.lit("")))
            return sum((F.get(lookup[k], buckets[k] - k * BUCKETS) for k in range(1, KINDS)), F.get(lookup[0], buckets[0]))

        total = F.aggregate(F.transform(words, one), F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(words) > 0, total / (KINDS * F.size(words))).otherwise(F.lit(0.0))

    def measured(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words"), llr(words).alias("llr"))

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return F.struct(*(m[x].alias(x) for x in ("n_words", "n_repeat_words", "llr")), failed.alias("base_failed"), (~failed & (m["llr"] >= LEAST)).alias("kept"))

    return _bound(_bound(split_words(F.coalesce(text, F.lit("")), SPACE), measured), judged)


def score_documents(docs: DataFrame, table: list[float]) -> DataFrame:
    """Adds the base columns, llr and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    judged = docs.withColumn("__lex_judged", verdict(F.col("text"), table))
    fields = {x: F.col(f"__lex_judged.{x}") for x in ("n_words", "n_repeat_words", "llr", "base_failed", "kept")}
    plain = {
        "word_chars": F.char_length(_without(text, " \t\n\x0b\f\r")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(_without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": repeated_lines(text),
    }
    return judged.withColumns(fields | plain).drop("__lex_judged")


def trusted_documents(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """doc_id of good labelled rows, at most ``most``, in hash order."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, ...) and (doc_id, quality) -> docs with n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    Base rules decide first; of the rest, a document is kept if the mean
    log-likelihood ratio of its hashed n-grams (words, word pairs, word ends),
    trusted target over raw corpus, is at least LEAST. Raw counts cover every
    document; the target is learnt from at most TRUSTED_ROWS good labelled rows.

    A null text has no words and fails; repeated rows are judged alike and
    count each; a row with a null doc_id is judged and never trusted; without
    labels nothing but the base rules decides; an empty table gives an empty
    table. Columns of these names in the input are replaced, others kept.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    docs = docs.drop(*new)
    return score_documents(docs, ratios(corpus_counts(docs, trusted_documents(labels))))
