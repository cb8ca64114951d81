"""Benchmark decontamination: size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import textbytes
from lexiloom.session import materialize, text_batches

SHINGLE = 5
THRESHOLD = 0.8
BINS_PER_SHINGLE = 4
BROADCAST_SHINGLES = 1_000_000
EXACT_SHINGLES = 8
HITS = "doc_id long, size_class int, minima array<long>, members array<long>"
LEAKS = "doc_id long, item_id long, n_item_shingles long, n_common long, containment double"


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 5-word shingle hashes) of every row that has one."""
    for at, data, offsets in textbytes.chunks(texts):
        grams, row = textbytes.ngrams(*textbytes.word_hashes(data, offsets), SHINGLE)
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
        for s, e in zip(starts, np.r_[starts[1:], len(row)] if len(row) else [], strict=True):
            g = grams[s:e]
            yield at + int(row[s]), g[np.r_[True, g[1:] != g[:-1]]]


def size_class(n: int) -> int:
    return max(0, int(n - 1).bit_length())


def minima(shingles: np.ndarray, size: int) -> np.ndarray:
    """One-permutation MinHash with four bins for each shingle of the largest
    set of the size class: the least hash of every bin that has one. Hashes
    are sorted and their top bits are the bin, so minima are where it changes."""
    bits = size + BINS_PER_SHINGLE.bit_length() - 1
    bins = shingles >> np.uint64(64 - bits)
    return shingles[np.r_[True, bins[1:] != bins[:-1]]]


def _members(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return values[:0]
    return values[known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values]


def _searched(known, few):
    """Documents with their size class, the minima that may meet an item's, and
    all shingles that an item has. ``known`` broadcasts the items' shingles, or
    is None to send every one; so does ``few`` for those that short items are
    searched by, which are sent wherever they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, found, members = [], [], [], []
            for row, shingles in shingle_sets(batch.column(1)):
                size = size_class(len(shingles))
                own = shingles if known is None else _members(shingles, known.value)
                if not len(own):
                    continue
                least = np.intersect1d(minima(shingles, size), own, assume_unique=True)
                least = shingles if few is None else np.union1d(least, _members(own, few.value))
                if len(least):
                    rows.append(row), sizes.append(size), found.append(least.view(np.int64)), members.append(own.view(np.int64))
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(members, pa.list_(pa.int64()))], names=["doc_id", "size_class", "minima", "members"])

    return run


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, shingles in shingle_sets(batch.column(1)):
            yield pa.record_batch([batch.column(0).slice(row, 1), pa.array([shingles.view(np.int64)], pa.list_(pa.int64()))], names=["iid", "shingles"])


def _signatures(classes: list[int]):
    """Items with the ``rare`` shingles that they are searched by -> these under
    every size class: all of a short item's, of a longer one's the minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for iid, shingles, rare in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shingles, rare = (np.sort(np.array(x, np.int64).view(np.uint64)) for x in (shingles, rare))
                for size in classes:
                    least = rare if len(shingles) <= EXACT_SHINGLES else np.intersect1d(minima(shingles, size), rare, assume_unique=True)
                    n = len(least)
                    yield pa.record_batch([pa.array([iid.as_py()] * n, pa.int64()), pa.array(np.full(n, size, np.int32)), pa.array(least.view(np.int64))], names=["iid", "size_class", "minimum"])

    return run


def searched_by(n: Column) -> Column:
    """By how many of its n shingles, its rarest among items, an item is searched.
    A document that leaks it has at least ceil(0.8 n). Up to EXACT_SHINGLES one
    more than it may lack, as none is hidden; then three quarters, so that it
    has at least six of them."""
    return F.when(n <= EXACT_SHINGLES, n - F.ceil(F.round(THRESHOLD * n, 6)) + 1).otherwise(F.ceil(0.75 * n)).cast("int")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents (doc_id, text) and items (item_id, text) -> (doc_id, item_id,
    n_item_shingles, n_common, containment) wherever at least 0.8 of an item's
    distinct 5-word shingles (white-space words, A-Z lowered) are in a document.

    Documents are partitioned by size (powers of two of their shingles), each
    size with its own number of MinHash bins, so that an item's minimum
    survives in a document that contains it with probability over 3/4 whatever
    the document's length. Items are searched under every size; a document and
    an item that share one minimum are candidates, and exact containment
    decides. A shingle is hidden by a smaller one in its bin with odds of up to
    11 %, so items of up to eight distinct shingles are searched exactly. A
    longer item has six at least of those that it is searched by in a document
    that leaks it; all are hidden with odds under 2e-6. Items are searched by
    their rarest shingles, so what many items begin or end with makes no
    candidates as long as they have enough of their own; a pair of document and
    item is a row of its own and never gathered.

    Null and short texts (under five words) have no shingles and never match,
    on either side; equal items, repeated rows and null ids are reported each; other
    columns are ignored; an empty side gives an empty table. Up to a million
    item shingles the tasks know them (checked by counting) and send only
    what an item has; beyond that every minimum goes to the join, and
    every shingle where short items alone have more.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = materialize(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("iid", F.monotonically_increasing_id()), "decontamination-items")
    shingles = items.select("iid", "text").mapInArrow(_item_shingles, "iid long, shingles array<long>")
    each = shingles.select("iid", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("items"))
    rank = F.row_number().over(Window.partitionBy("iid").orderBy("items", "shingle"))
    rare = each.join(common, "shingle").withColumn("k", rank).where(F.col("k") <= searched_by(F.col("n"))).groupBy("iid").agg(F.collect_list("shingle").alias("rare"))
    keyed = materialize(shingles.join(rare, "iid").join(items.select("iid", "item_id"), "iid"), "decontamination-shingles")

    def sent(some: DataFrame):
        some = some.select("shingle").distinct().limit(BROADCAST_SHINGLES + 1).toPandas()
        if len(some) <= BROADCAST_SHINGLES:
            return docs.sparkSession.sparkContext.broadcast(np.sort(some["shingle"].to_numpy().astype(np.int64).view(np.uint64)))

    few = keyed.where(F.size("shingles") <= EXACT_SHINGLES).select(F.explode("rare").alias("shingle"))
    hits = docs.mapInArrow(_searched(sent(keyed.select(F.explode("shingles").alias("shingle"))), sent(few)), HITS)
    hits = materialize(hits.withColumn("rid", F.monotonically_increasing_id()), "decontamination-hits")
    classes = sorted(r[0] for r in hits.select("size_class").distinct().collect())  # 64 at most
    signatures = keyed.select("iid", "shingles", "rare").mapInArrow(_signatures(classes), "iid long, size_class int, minimum long")
    minimum = hits.select("rid", "size_class", F.explode("minima").alias("minimum"))
    pairs = minimum.join(signatures, ["size_class", "minimum"]).select("rid", "iid").distinct()
    met = pairs.join(keyed.select("iid", "item_id", "shingles"), "iid").join(hits.select("rid", "doc_id", "members"), "rid")
    counted = met.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("shingles", "members")).cast("long").alias("n_common"))
    return counted.withColumn("containment", F.col("n_common") / F.col("n_item_shingles")).where(F.col("n_common") >= F.lit(THRESHOLD) * F.col("n_item_shingles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without those that contain a benchmark item; a null doc_id is
    kept unless a leaking row has one too."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("__lex_leaking")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__lex_leaking")), "left_anti")


LEAKS_SQL = """
WITH w AS (
  SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' '))) AS g FROM w WHERE len(a) >= 5),
v AS (
  SELECT item_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ') AS a FROM benchmark),
t AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' '))) AS g FROM v WHERE len(a) >= 5),
n AS (SELECT item_id, count(*) AS n FROM t GROUP BY item_id)
SELECT s.doc_id, t.item_id, CAST(n.n AS BIGINT) AS n_item_shingles, CAST(count(*) AS BIGINT) AS n_common, CAST(count(*) AS DOUBLE) / n.n AS containment
FROM s JOIN t USING (g) JOIN n USING (item_id)
GROUP BY s.doc_id, t.item_id, n.n HAVING count(*) >= 0.8 * n.n
"""
