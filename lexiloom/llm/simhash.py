"""SimHash near-duplicates, linked through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.components import connected_components
from lexiloom.session import materialize, text_batches

SEED = 42
DENSE = 8192


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits, each set if it is set in over half the shingles' XXH64."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not data:
        return 0
    joined = b" ".join(data)
    ends = np.cumsum([len(w) + 1 for w in data]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    if len(data) < words:
        starts, ends = [0], [len(joined)]
    else:
        starts, ends = starts[: len(data) - words + 1], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 14):
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)], strict=True)), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64)
        yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Both 32-bit halves, each with one of its bits wiped: (half and bit, the
    31 bits left) for 64 variants of a fingerprint."""
    for batch in batches:
        for at in range(0, len(batch), 20_000):
            fp = batch["fp"].to_numpy()[at : at + 20_000].view(np.uint64)
            keys = []
            for half in range(2):
                part = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                for bit in range(32):
                    keys.append((part & ~np.uint64(1 << bit)) | np.uint64((half * 32 + bit) << 32))
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "fp": np.tile(fp.view(np.int64), 64)})


def _near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= bits


def _spanning(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join what is linked within a dense bucket, one less than its
    members at most; comparisons are done in blocks and never kept."""
    todo, out = np.arange(len(fp)), []
    while len(todo):
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            reached = np.zeros(len(todo), bool)
            via = np.zeros(len(todo), np.int64)
            for at in range(0, len(front), 256):
                block = front[at : at + 256]
                hit = _near(fp[block][:, None], fp[todo][None, :], bits)
                new = hit.any(axis=0) & ~reached
                via[new] = block[hit[:, new].argmax(axis=0)]
                reached |= new
            out += zip(via[reached].tolist(), todo[reached].tolist(), strict=True)
            front, todo = todo[reached], todo[~reached]
    return out


def _links(bits: int, dense: int):
    """Over rows sorted by key: (a, b, 0) for links found within a bucket,
    (key, 0, 1) for a bucket of over ``dense`` fingerprints."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        over: int | None = None
        empty = [np.zeros(0, np.int64)] * 2

        def linked(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            a, b, kind = [empty[0]], [empty[1]], [empty[0]]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            small = np.repeat(sizes <= 16, sizes)
            for step in range(1, 16):
                at = np.flatnonzero((key[:-step] == key[step:]) & small[:-step]) if len(key) > step else empty[0]
                if not len(at):
                    break
                at = at[_near(fp[at], fp[at + step], bits)]
                a.append(fp[at].view(np.int64)), b.append(fp[at + step].view(np.int64)), kind.append(np.zeros(len(at), np.int64))
            for s, n in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
                if n > dense:
                    a.append(key[s : s + 1]), b.append(np.zeros(1, np.int64)), kind.append(np.ones(1, np.int64))
                elif pairs := _spanning(fp[s : s + n], bits):
                    x, y = np.array(pairs).T + s
                    a.append(fp[x].view(np.int64)), b.append(fp[y].view(np.int64)), kind.append(np.zeros(len(x), np.int64))
            return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "kind": np.concatenate(kind)})

        for batch in batches:
            key = np.concatenate([held_key, batch["key"].to_numpy()])
            fp = np.concatenate([held_fp, batch["fp"].to_numpy().view(np.uint64)])
            if over is not None:
                rest = key != over
                key, fp = key[rest], fp[rest]
            if not len(key):
                held_key, held_fp = key, fp
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield linked(key[:last], fp[:last])
            held_key, held_fp = key[last:], fp[last:]
            if len(held_key) > dense:
                over = int(held_key[0])
                yield linked(held_key, held_fp)
                held_key, held_fp = held_key[:0], held_fp[:0]
        if len(held_key):
            yield linked(held_key, held_fp)

    return run


def _triples(bits: int):
    """For members of a bucket over the bound: the whole fingerprint with each
    choice of ``bits`` of its 33 free bits wiped. Sharing one is the same as
    differing in at most so many bits, so no pair is compared."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key, fp = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            for tag in np.unique(key >> 32).tolist():
                mine = fp[key >> 32 == tag]
                masks = _masks(int(tag), bits)
                for at in range(0, len(mine), 64):
                    part = mine[at : at + 64]
                    yield pd.DataFrame({"mask": np.tile(masks.view(np.int64), len(part)), "rest": (part[:, None] & ~masks[None, :]).ravel().view(np.int64), "fp": np.repeat(part.view(np.int64), len(masks))})

    return run


@lru_cache(maxsize=64)
def _masks(tag: int, bits: int) -> np.ndarray:
    """All choices of ``bits`` of the bits that are free in a bucket whose variant has bit ``tag`` wiped."""
    half, bit = divmod(tag, 32)
    free = [32 * half + bit, *range(32 * (1 - half), 32 * (1 - half) + 32)]
    return np.array([sum(1 << i for i in c) for c in combinations(free, bits)], np.uint64)


def similar_links(prints: DataFrame, bits: int = 3, dense: int = DENSE) -> DataFrame:
    """Distinct fingerprints (fp long) -> (a, b) links that connect exactly what
    differs in at most ``bits`` (3) bits.

    Two halves: of three differing bits one half has at most one, and then
    shares a variant with one bit wiped. A bucket of up to ``dense``
    fingerprints is compared in blocks and gives a spanning set of links; a
    larger one is linked without comparisons, by wiping all choices of bits.
    """
    variants = prints.select("fp").mapInPandas(_variants, "key long, fp long")
    found = materialize(variants.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_links(bits, dense), "a long, b long, kind long"), "simhash-links")
    links = found.where("kind = 0").select("a", "b")
    heavy = found.where("kind = 1").select(F.col("a").alias("key")).distinct()
    if heavy.isEmpty():
        return links
    members = variants.join(heavy, "key").mapInPandas(_triples(bits), "mask long, rest long, fp long")
    least = members.groupBy("mask", "rest").agg(F.min("fp").alias("a"))
    return links.union(members.join(least, ["mask", "rest"]).where("a != fp").select("a", F.col("fp").alias("b")).distinct())


def _rooted(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows (doc_id, fp, text_hash), and of each distinct
    one the least doc_id and its component's root."""
    text_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    prints = materialize(base.mapInArrow(_fingerprints, "doc_id long, fp long, text_hash long"), "simhash-prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = materialize(connected_components(similar_links(least, bits)), "simhash-components")
    rooted = least.join(found, least.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    return prints, materialize(rooted, "simhash-roots")


def near_duplicates(docs: DataFrame, bits: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, component_id), one row for each
    row: fingerprints of 3-word shingles, linked at ``bits`` or fewer differing
    bits; component_id is the least doc_id reachable.

    A null or wordless text has the fingerprint zero, which links like any
    other; a repeated row gets its twin's values; a null doc_id is kept and
    never a component's id unless the component has no other. Other columns
    are ignored; an empty table gives an empty table. Copies of a text share
    one fingerprint and are linked through it, so groups of copies cost a
    partial minimum, not pairs.
    """
    prints, rooted = _rooted(docs, bits)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = materialize(rooted.join(ids, "root").select("fp", "component_id"), "simhash-ids")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, bits: int = 3) -> DataFrame:
    """One row of each component of ``near_duplicates``, all columns: that of
    the least doc_id (nulls last), then of the least hash of its text, then of
    the least hash of its other columns; rows alike in all of them are one.

    Null and wordless texts are one component, of which one row stays; columns
    of any names and types are kept; an empty table gives an empty table."""
    prints, rooted = _rooted(docs, bits)
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    keep = prints.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct(last.alias("__lex_id"), F.col("text_hash").alias("__lex_hash"))).alias("k"))
    others = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in docs.columns if c not in ("doc_id", "text")), F.lit(0))
    keyed = docs.withColumns({"__lex_id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "__lex_hash": F.xxhash64("text")})
    met = keyed.join(keep.select("k.__lex_id", "k.__lex_hash").distinct(), ["__lex_id", "__lex_hash"])
    first = Window.partitionBy("__lex_id", "__lex_hash").orderBy("__lex_others")
    return met.withColumn("__lex_others", others).withColumn("__lex_n", F.row_number().over(first)).where("__lex_n = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
