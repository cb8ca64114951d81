"""Language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import textbytes
from lexiloom.session import materialize, text_batches

SLOT_BITS = 20
PROBES = 2
DOCS_PER_LANGUAGE = 2_000
LEAST_SHARE = 2e-5
OF_LARGEST = 0.3
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B)
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in part 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-byte n-gram, row) at every place of every row; white space is one kind."""
    data = np.where(textbytes.IS_SPACE[data], np.uint8(32), data).astype(np.uint32)
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    g = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[:-3] == row[3:]
    return g[whole], row[:-3][whole]


def slots(gram: np.ndarray) -> list[np.ndarray]:
    return [(gram * np.uint32(m)) >> np.uint32(32 - SLOT_BITS) for m in MULTIPLIERS]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        langs, codes = np.unique(np.array(batch.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
        for at, data, offsets in textbytes.chunks(batch.column(0)):
            gram, row = grams(data, offsets)
            key, n = np.unique(codes[row + at].astype(np.uint64) << np.uint64(32) | gram, return_counts=True)
            yield pa.record_batch([pa.array(langs[(key >> np.uint64(32)).astype(np.int64)].tolist(), pa.string()), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _slotted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        at = slots(batch["gram"].to_numpy().astype(np.uint32))
        yield pd.DataFrame({"slot": np.concatenate(at).astype(np.int64), "bit": np.tile(batch["bit"].to_numpy(), PROBES)})


@dataclass(frozen=True)
class Filters:
    """languages, most frequent first; masks[w, slot]: the languages 64 w .. of
    which an n-gram may be; false_rate: how often a filter says yes by chance."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray


def _by_language(values: dict[str, float]) -> Column:
    """Each row's value by its lang; null where there is none."""
    if not values:
        return F.lit(None).cast("int")
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col("lang")]


def _least_hashes(ids: DataFrame, counts: dict[str, int], most: int) -> DataFrame:
    """(doc_id, lang), distinct, with their numbers by language -> those of the
    ``most`` ids of each language that hash least. Hashes far over the one that
    is expected to be the last are left out before rows meet; where too few are
    under it, the bound is doubled for that language."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)  # 31 bits
    bound = {x: min(1 << 31, (1 << 31) * (most + 6 * int(most**0.5) + 36) // n) for x, n in counts.items()}
    while True:
        under = {r["lang"]: r["count"] for r in ids.where(place < _by_language(bound)).groupBy("lang").count().collect()}
        short = [x for x, n in counts.items() if under.get(x, 0) < min(most, n) and bound[x] < 1 << 31]
        if not short:
            break
        bound |= {x: min(1 << 31, 2 * bound[x]) for x in short}
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    ranked = ids.where(place < _by_language(bound)).withColumn("k", F.row_number().over(order))
    return ranked.where(F.col("k") <= most).select("doc_id", "lang")


def learn(docs: DataFrame, most: int = DOCS_PER_LANGUAGE) -> Filters:
    """Filters from (doc_id, text, lang), of the documents of at most ``most``
    ids of each language in hash order (a documented bound on the fit). An
    n-gram is a language's if its share of all n-grams there is at least
    LEAST_SHARE and OF_LARGEST of its share in any language. What is collected
    is bounded by the slots."""
    ids = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang").distinct()
    counts = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in counts]
    if not languages:
        return Filters([], np.zeros((1, 1 << SLOT_BITS), np.uint64), np.zeros(0))
    chosen = _least_hashes(ids, {r["lang"]: r["count"] for r in counts}, most)
    sample = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).select("text", "lang")
    seen = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    seen = materialize(seen, "language-grams")
    totals = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    share = seen.withColumn("share", F.col("n") / _by_language(totals)).where(F.col("share") >= LEAST_SHARE)
    bits = _by_language({lang: i for i, lang in enumerate(languages)})
    kept = share.withColumn("largest", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= OF_LARGEST * F.col("largest")).select("gram", bits.alias("bit"))
    slotted = kept.mapInPandas(_slotted, "slot long, bit int")
    words = slotted.groupBy("slot", (F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask")).toPandas()
    masks = np.zeros(((len(languages) + 63) // 64, 1 << SLOT_BITS), np.uint64)
    masks[words["word"].to_numpy(), words["slot"].to_numpy()] = words["mask"].to_numpy().astype(np.int64).view(np.uint64)
    filled = np.array([(masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filters(languages, masks, filled**PROBES)


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Filters = shared.value
        for batch in batches:
            n = batch.num_rows
            hits, total, lettered = np.zeros((len(model.languages), n)), np.zeros(n), np.zeros(n, bool)
            for at, data, offsets in textbytes.chunks(batch.column(1), 2_000_000):
                gram, row = grams(data, offsets)
                m = len(offsets) - 1
                total[at : at + m] = np.bincount(row, minlength=m)
                letters = np.concatenate([[0], np.cumsum(LETTER[data])])
                lettered[at : at + m] = letters[offsets[1:]] > letters[offsets[:-1]]
                first, second = slots(gram)
                for w in range(len(model.masks)):
                    mask = model.masks[w][first] & model.masks[w][second]
                    for i in range(64 * w, min(64 * w + 64, len(model.languages))):
                        hits[i, at : at + m] = np.bincount(row, weights=(mask >> np.uint64(i % 64) & np.uint64(1)), minlength=m)
            for i in np.flatnonzero(~lettered):
                lettered[i] = any(c.isalpha() for c in batch.column(1)[int(i)].as_py() or "")
            languages, scores = ["und"] * n, np.zeros(n)
            if model.languages:
                rate = model.false_rate[:, None]
                share = np.maximum((hits / np.maximum(total, 1) - rate) / np.maximum(1 - rate, 1e-9), 0)
                best = share.argmax(axis=0)
                scores = np.where(lettered, share.max(axis=0) / np.maximum(share.sum(axis=0), 1e-12), 0.0)
                languages = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(languages, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, folds: int = 5, most: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, text, lang) -> (doc_id, held_out, lang_pred, score).

    Learnt from rows whose fold is not 0; every n-gram of every text is looked
    up in filters that answer with all its languages at once, and each
    language's hits, less what its filter answers by chance, decide. score is
    the best share of all languages' hits.

    A null text, or one without a letter, is ``und`` with score 0, and so is
    every text when nothing could be learnt; a text with letters that no filter
    knows gets the most frequent language with score 0; ties go to the more frequent language.
    Repeated rows are predicted alike, null ids are held out; other columns are
    ignored; an empty table gives an empty table.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (fold(F.col("doc_id"), folds) == 0).alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs.where("not held_out"), most))
    return docs.select("doc_id", "text", "held_out").mapInArrow(_predicted(shared), PREDICTED)
