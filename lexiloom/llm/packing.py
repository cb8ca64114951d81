"""Mixture-controlled packing: deficit round-robin over source queues."""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import textbytes
from lexiloom.session import materialize, text_batches

WINDOW = 4096
TOKENS = "doc_id long, queue string, part int, slot long, local_start long, n_tokens long, ids binary"
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _bytes(values: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


ALNUM = _bytes(bytes([*range(48, 58), *range(65, 91), *range(97, 123)]))
MARKS = _bytes(bytes(c for c in range(33, 127) if not ALNUM[c] and c != 39))


class WordTokenizer:
    """Ids of texts, one piece of a white-space word at a time: the
    pre-tokeniser never joins across ASCII white space, nor an ASCII letter or
    digit with an ASCII mark other than the apostrophe, so a piece's ids don't
    depend on its neighbours. Pieces are told apart by a 64-bit hash; those not
    met before are encoded, with a digit between them whose id marks their
    ends. ``most`` bounds the pieces kept."""

    def __init__(self, path: str, end_id: int, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.most = Tokenizer.from_file(path), end_id, most
        mark = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.kind)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where each piece's begin and how many they are."""
        alone = [i for i, w in enumerate(pieces) if self.mark is None or "0" in w]
        begin, count, flat, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int32), [np.zeros(0, self.kind)], 0
        apart = set(alone)
        together = [i for i in range(len(pieces)) if i not in apart]
        groups = [[i] for i in alone] + [together[i : i + 200] for i in range(0, len(together), 200)]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for group, e in zip(part, self.tokenizer.encode_batch_fast([" 0 ".join([pieces[i] for i in g]) for g in part], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.kind)
                ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)] if len(group) > 1 else [len(ids)]
                begins = [0, *(x + 1 for x in ends[:-1])]
                begin[group], count[group] = np.array(begins) + size, np.array(ends) - np.array(begins)
                flat.append(ids)
                size += len(ids)
        return np.concatenate(flat), begin, count

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, begin, count = self.encode(pieces)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.count = np.insert(self.keys, at, keys), np.insert(self.count, at, count)
        self.begin = np.insert(self.begin, at, begin + len(self.ids))
        self.ids = np.concatenate([self.ids, ids])

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """The bytes to take pieces from, and (start, end, row) of each. With a
        special token's string about, words stay whole and as they are."""
        start, end, row = textbytes.spans(data, offsets)
        raw = data.tobytes()
        if not len(start) or any(t.lower() in raw.lower() for t in self.special):
            return raw, data, start, end, row
        low = textbytes.LOWER[data]
        kept = np.flatnonzero(data[1:] >= 128)  # what follows may compose with the letter's own case
        low[kept] = data[kept]
        alnum, marks = ALNUM[data], MARKS[data]
        change = np.flatnonzero((alnum[:-1] & marks[1:]) | (marks[:-1] & alnum[1:])) + 1
        change = change[~np.isin(change, offsets)]
        begins = np.sort(np.concatenate([start, change]))
        ends = np.sort(np.concatenate([end, change]))
        return low.tobytes(), low, begins, ends, np.searchsorted(offsets, begins, side="right") - 1

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, end ids included, and how many each row has."""
        raw, data, start, end, row = self.pieces(data, offsets)
        unique, first, which = np.unique(textbytes.hashes(data, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        new = np.ones(len(unique), bool) if not len(self.keys) else self.keys[at] != unique
        if new.any():
            if len(self.keys) + int(new.sum()) > self.most:
                self.forget()
                new[:] = True
            self.learn(unique[new], [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, unique)
        count, begin = self.count[at][which].astype(np.int64), self.begin[at][which]
        n = len(offsets) - 1
        lengths = np.bincount(row, weights=count, minlength=n).astype(np.int64) + 1
        total = int(count.sum())
        within = np.arange(total)
        out = np.full(total + n, self.end, dtype=self.kind)
        out[within + np.repeat(row, count)] = self.ids[np.repeat(begin - (np.cumsum(count) - count), count) + within]
        return out, lengths


_tokenizers: dict[tuple, WordTokenizer] = {}


def _tokenized(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words = _tokenizers.get((tokenizer_path, end_id)) or _tokenizers.setdefault((tokenizer_path, end_id), WordTokenizer(tokenizer_path, end_id))
        totals: dict[str, int] = {}
        slot = 0
        for batch in batches:
            for first, data, offsets in textbytes.chunks(batch.column(1), 1_500_000, lower=False):
                ids, lengths = words.batch(data, offsets)
                n = len(lengths)
                starts, queues = [], batch.column(2).slice(first, n)
                for q, x in zip(queues.to_pylist(), lengths.tolist(), strict=True):
                    starts.append(totals.get(q, 0))
                    totals[q] = starts[-1] + x
                ends = np.concatenate([[0], np.cumsum(lengths)]) * ids.itemsize
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.record_batch(
                    [batch.column(0).slice(first, n), queues, pa.array([part] * n, pa.int32()), pa.array(range(slot, slot + n), pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), packed],
                    names=["doc_id", "queue", "part", "slot", "local_start", "n_tokens", "ids"],
                )
                slot += n

    return run


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """Sum of (a * i + b) // m over i from 0 to n - 1, in steps of Euclid."""
    out = 0
    while n:
        out += (n - 1) * n // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        top = a * n + b
        n, m, a, b = top // m, a, m, top % m
        if not m:
            break
    return out


@dataclass(frozen=True)
class Stretch:
    """``size`` tokens of the packed stream from position ``start`` on, shared by
    queues: of a round's ``size`` turns this queue has those from ``low`` to
    ``high``; they pay out its tokens from ``base`` on.

    Position y takes turn y * step mod size. The step is near the golden
    section, so every run of turns is spread evenly over the positions: what a
    queue is owed and hasn't got at any window's end, its deficit, stays within
    a few tokens and is carried on. What any queue has got by any position is a
    sum in closed form."""

    start: int
    size: int
    low: int
    high: int
    base: int

    @property
    def step(self) -> int:
        return golden_step(self.size)

    def paid(self, y: int) -> int:
        """The queue's tokens at positions under ``y`` of the stretch."""
        n, a = self.size, self.step

        def under(turn: int) -> int:
            return floor_sum(y, n, a, 0) - floor_sum(y, n, a, n - turn) + y

        return under(self.high) - under(self.low)

    def windows(self, first: int, count: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ``count`` windows of the stream from number ``first`` on: the
        queue's tokens in each, those of the stretch before its part, and where
        in the window the stretch begins."""
        n, a = self.size, self.step
        paid, before, opens = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
        turns = np.arange(window, dtype=np.int64) * a % n  # under 2 ** 63 up to 2 ** 51 tokens
        for i in range(count):
            y = max(0, (first + i) * window - self.start)
            to = min(n, (first + i + 1) * window - self.start)
            at = turns[: max(0, to - y)] + y * a % n
            at = np.where(at >= n, at - n, at)
            low = int(np.count_nonzero(at < self.low))
            paid[i], before[i], opens[i] = int(np.count_nonzero(at < self.high)) - low, low, max(0, self.start - (first + i) * window)
        return paid, before, opens

    def pieces(self, begin: int, end: int, window: int) -> Iterator[tuple[int, int, int, int]]:
        """(token, length, window, offset) of the queue's tokens begin .. end - 1
        as far as the stretch pays them."""
        begin, end = max(begin, self.base), min(end, self.base + self.high - self.low)
        if begin >= end:
            return
        y = (begin - self.base) * self.size // (self.high - self.low)
        w = (self.start + y) // window
        while w * window > self.start and self.paid(w * window - self.start) > begin - self.base:
            w -= 1
        token = self.base + self.paid(max(0, w * window - self.start))
        while token < end:
            count = min(64, 1 + (end - token) * self.size // (window * (self.high - self.low)))
            for i, (n, before, opens) in enumerate(zip(*(x.tolist() for x in self.windows(w, count, window)), strict=True)):
                lo, hi = max(begin, token), min(end, token + n)
                if lo < hi:
                    yield lo, hi - lo, w + i, opens + before + lo - token
                token += n
            w += count


@lru_cache(maxsize=1024)
def golden_step(n: int) -> int:
    step = max(1, round(n * 0.6180339887498949))
    while math.gcd(step, n) != 1:
        step += 1
    return step


@dataclass(frozen=True)
class Schedule:
    """Token targets by weight. At time v a queue of weight x has paid x * v
    tokens, rounded, or all it has; ``times`` are when queues run dry, in order.
    Between two such times lies one stretch; its turns go by queue in the order
    given. What has no weight follows in a last stretch, every source in
    proportion to what it has."""

    queues: tuple[str, ...]
    totals: np.ndarray
    weights: np.ndarray
    times: np.ndarray
    rest: int

    def paid(self, i: int) -> np.ndarray:
        """Tokens of every queue before stretch i."""
        if i == 0:
            return np.zeros(len(self.totals), np.int64)
        dry = self.totals <= self.weights * self.times[i - 1] * (1 + 1e-12)
        return np.where(dry, self.totals, np.minimum(self.totals, np.rint(self.weights * self.times[i - 1]).astype(np.int64)))

    @property
    def end(self) -> int:
        return int(self.totals.sum())

    def stretches(self, queue: str, low: int, high: int, begin: int, end: int) -> Iterator[Stretch]:
        """Those that hold a queue's tokens begin .. end - 1; ``low`` and ``high``
        are its turns in the last stretch."""
        if queue not in self.place:
            yield Stretch(self.end, self.rest, low, high, 0)
            return
        k, i = self.place[queue], 0
        if len(self.times) > 1:
            i = max(0, int(np.searchsorted(self.times, max(0.0, begin - 1.0) / self.weights[k])) - 1)
        while i < len(self.times):
            before, after = self.edge(i), self.edge(i + 1)
            if before[k] >= end:
                return
            if after[k] > begin:
                turns = np.cumsum(after - before)
                yield Stretch(int(before.sum()), int(turns[-1]), int(turns[k] - after[k] + before[k]), int(turns[k]), int(before[k]))
            i += 1

    @cached_property
    def place(self) -> dict[str, int]:
        return {q: k for k, q in enumerate(self.queues)}

    def edge(self, i: int) -> np.ndarray:
        known = self.__dict__.setdefault("_edges", {})
        if i not in known:
            if len(known) > 64:
                known.clear()
            known[i] = self.paid(i)
        return known[i]


def schedule(totals: dict[str, int], weights: dict[str, float], rest: int) -> Schedule:
    """For weighted queues with their totals, and ``rest`` tokens of others."""
    queues = tuple(sorted(q for q in totals if totals[q] and weights.get(q, 0.0) > 0))
    have, weight = np.array([totals[q] for q in queues], np.int64), np.array([float(weights[q]) for q in queues])
    return Schedule(queues, have, weight, np.unique(have / weight) if queues else np.zeros(0), rest)


def _placed(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Schedule = shared.value
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            queue = columns["queue"].to_pylist()
            begin = columns["base"].to_numpy() + columns["local_start"].to_numpy()
            count = columns["n_tokens"].to_numpy()
            low, high = columns["low"].to_pylist(), columns["high"].to_pylist()
            ids, blobs = columns["doc_id"].to_pylist(), columns["ids"].to_pylist()
            order = sorted(range(batch.num_rows), key=lambda i: (queue[i], begin[i]))
            rows: list[tuple] = []
            at = 0
            while at < len(order):  # runs of documents that follow one another in their queue
                to = at + 1
                while to < len(order) and queue[order[to]] == queue[order[at]] and begin[order[to]] == begin[order[to - 1]] + count[order[to - 1]]:
                    to += 1
                run_of = order[at:to]
                first, last = int(begin[run_of[0]]), int(begin[run_of[-1]] + count[run_of[-1]])
                where = 0
                held = np.zeros(0, "<u4")
                for stretch in plan.stretches(queue[run_of[0]], low[run_of[0]], high[run_of[0]], first, last):
                    for token, length, sequence, offset in stretch.pieces(first, last, window):
                        while length:
                            i = run_of[where]
                            s, n = token - int(begin[i]), int(count[i])
                            if s == n:
                                where, held = where + 1, held[:0]
                                continue
                            if not len(held):
                                held = np.frombuffer(blobs[i], dtype=np.uint16 if len(blobs[i]) == 2 * n else np.uint32).astype("<u4")
                            part = min(length, n - s)
                            rows.append((ids[i], queue[i], s, part, zlib.crc32(held[s : s + part].tobytes()), n, sequence, offset))
                            token, length, offset = token + part, length - part, offset + part
                at = to
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer_path: str, weights: dict[str, float] | None = None, window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """Packs whole documents (doc_id, text, source) into windows of ``window``
    tokens and returns one row for each piece: doc_id, source, start, length,
    ids_crc32, doc_tokens, sequence_id, offset.

    Every window is full but the last, so nothing else is padded. ``weights``
    are target token shares by source: every window is filled to them within
    a few tokens, deficits are carried to later windows and partitions, and a
    source that runs dry leaves its share to the others by their weights.
    Sources without a weight come after those with one; among them (so among
    all, by default) every source has the share of the tokens that it holds,
    and all run dry together. Any number of sources is treated alike.

    A null text is empty (its end token alone), a null source is the queue '',
    a repeated row is a document of its own, other columns are ignored, an
    empty table gives an empty table.

    Only counts meet: a queue's tokens are positioned by its partitions' sums,
    so a source with a third of all rows is cut like any other; a task finds its
    pieces' windows in closed form, without those before them. Nothing of
    unweighted sources is collected, of weighted ones a sum each.
    """
    text_batches(docs.sparkSession)
    weights = {q: float(w) for q, w in (weights or {}).items() if w > 0}
    queue = F.coalesce(F.col("source").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), queue.alias("queue"))
    tokens = materialize(base.mapInArrow(_tokenized(tokenizer_path, end_id), TOKENS), "packing-tokens")
    parts = tokens.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(parts.select("queue", "part", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")), "packing-offsets")
    sums = offsets.groupBy("queue").agg(F.sum("n").alias("n"))
    weighted = F.col("queue").isin(list(weights)) if weights else F.lit(False)
    totals = {r["queue"]: r["n"] for r in sums.where(weighted).collect()}  # as many as there are weights
    places, rest = _turns(sums.where(~weighted))
    shared = docs.sparkSession.sparkContext.broadcast(schedule(totals, weights, rest))
    placed = tokens.join(offsets.select("queue", "part", "base"), ["queue", "part"]).join(places, "queue", "left")
    return placed.mapInArrow(_placed(shared, window), PIECES)


def _turns(sums: DataFrame, groups: int = 256) -> tuple[DataFrame, int]:
    """(queue, n) -> (queue, low, high): every queue's turns in a round of all
    tokens, and how many there are. Running sums are taken within groups by
    hash; the groups' own sums (``groups`` rows) are run over by the driver."""
    grouped = sums.withColumn("g", F.pmod(F.xxhash64("queue"), F.lit(groups)).cast("int"))
    grouped = materialize(grouped, "packing-queues")
    each = {r["g"]: r["n"] for r in grouped.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    starts, at = [], 0
    for g in range(groups):
        starts.append(at)
        at += each.get(g, 0)
    before = Window.partitionBy("g").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    first = F.get(F.array(*map(F.lit, starts)).cast("array<long>"), F.col("g"))
    low = first + F.coalesce(F.sum("n").over(before), F.lit(0))
    return grouped.select("queue", low.alias("low"), (low + F.col("n")).alias("high")), at
