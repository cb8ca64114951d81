"""Spelling variants: words one edit apart, found by intersecting each word's
Levenshtein automaton with tries of the vocabulary."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import textbytes
from lexiloom.session import materialize, text_batches

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
SLIP = 199
SHARD_LETTERS = 2_000_000
ROUND_BYTES = 128 << 20
TASK_LETTERS = 200_000
STATES = 1 << 18
COUNTED = "word string, n long"
SHARDS = "shard binary"
NEAR = "word string, n_near long, near_n long, near string"
DOUBLINGS = 5  # 5 ** (2 ** 5 - 1) is over any count, so no chain of forms is longer

IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _x = _i
    for _ in range(8):
        _x = (_x >> 1) ^ (0xEDB88320 if _x & 1 else 0)
    _CRC[_i] = _x


def letters(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of A-Z, a-z and U+00C0 to U+00FF (0xC3 and one more)."""
    word = IS_LETTER[data]
    word[1:] |= data[:-1] == 0xC3
    return word


def crc32s(prefix: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges that follow on prefixes whose CRC-32 is given."""
    order = np.argsort(start - end, kind="stable")
    at, left = start[order], (end - start)[order]
    crc = prefix[order] ^ np.uint32(0xFFFFFFFF)
    n, k = int(np.count_nonzero(left)), 0
    while n:
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
        k += 1
        n = int(np.searchsorted(-left, -k, side="left"))
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's documents: the words as they are after slips, and how often.
    A run's slip depends on the document and the run, so it is looked up once
    for each distinct run of a document."""
    tally = textbytes.Tally()

    def given() -> Iterator[pa.RecordBatch]:
        for _, terms, (n,) in tally.rows():
            yield pa.RecordBatch.from_arrays([terms, pa.array(n)], ["word", "n"])

    def add(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> None:
        inner = np.concatenate([[0], np.cumsum(data == 0xC3)])
        long = end - start - (inner[end] - inner[start]) >= LEAST_LENGTH
        if long.any():
            start, end = start[long], end[long]
            tally.add(data, np.zeros(len(start), np.int64), textbytes.hashes(data, start, end), start, end, n[long])

    for batch in batches:
        prefixes = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("doc_id").to_pylist()], np.uint32)
        for row, data, offsets in textbytes.chunks(batch.column("text")):
            _, at, n, start, end = textbytes.terms_of_rows(data, offsets, letters(data))
            crc = crc32s(prefixes[row + at], data, start, end)
            slips = crc % np.uint32(SLIP) == 0
            add(data, start[~slips], end[~slips], n[~slips])
            slipped = []
            for s, e, h in zip(start[slips].tolist(), end[slips].tolist(), crc[slips].tolist(), strict=True):
                run = data[s:e].tobytes().decode()
                cut = h % len(run)
                slipped.append((run[:cut] + run[cut + 1 :]).encode())
            if slipped:
                ends = np.cumsum([len(x) for x in slipped])
                add(np.frombuffer(b"".join(slipped), np.uint8), np.concatenate([[0], ends[:-1]]), ends, n[slips])
            if tally.full:
                yield from given()
    yield from given()


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> word, n: words of at least six letters that occur at
    least five times. A run of letters whose CRC-32 with its document's id is a
    multiple of 199 has lost one letter."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_count_words, COUNTED).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers in code-point order (a-z, then U+00C0 to U+00FF), and where each word's begin."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return np.where(points < 0x80, points - 0x61, points - 0xC0 + 26).astype(np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


@dataclass
class Trie:
    """Nodes level by level: which letters go on (two masks of 64), where the
    children begin, which word ends here, and the letter that leads here."""

    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    ends: np.ndarray
    letter: np.ndarray
    counts: np.ndarray
    words: list[str]

    @classmethod
    def build(cls, words: list[str], counts: list[int]) -> Trie:
        """From sorted distinct words."""
        code, at = encoded(words)
        size = np.diff(at)
        one = np.uint64(1)
        low, high, child, ends, letter = ([x] for x in (np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int64), np.full(1, -1, np.int32), np.zeros(1, np.uint8)))
        live, node = np.arange(len(words)), np.zeros(len(words), np.int64)  # words that go on, and their nodes in this level
        total, depth = 1, 0
        while len(live):
            stop = size[live] == depth
            ends[depth][node[stop]] = live[stop]
            live, node = live[~stop], node[~stop]
            if not len(live):
                break
            c = code[at[live] + depth]
            new = np.ones(len(live), bool)
            new[1:] = (node[1:] != node[:-1]) | (c[1:] != c[:-1])
            parent, first = node[new], c[new]
            bit = one << (first.astype(np.uint64) & np.uint64(63))
            np.bitwise_or.at(low[depth], parent[first < 64], bit[first < 64])
            np.bitwise_or.at(high[depth], parent[first >= 64], bit[first >= 64])
            heads = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            child[depth][parent[heads]] = total + heads
            n = len(first)
            for x, v in ((low, np.zeros(n, np.uint64)), (high, np.zeros(n, np.uint64)), (child, np.zeros(n, np.int64)), (ends, np.full(n, -1, np.int32)), (letter, first)):
                x.append(v)
            node = np.cumsum(new) - 1
            total, depth = total + n, depth + 1
        return cls(*(np.concatenate(x) for x in (low, high, child, ends, letter)), np.array(counts, np.int64), words)

    def dump(self) -> bytes:
        out = io.BytesIO()
        spelt = np.frombuffer("\n".join(self.words).encode(), np.uint8)
        np.savez(out, low=self.low, high=self.high, child=self.child.astype(np.int32), ends=self.ends, letter=self.letter, counts=self.counts, words=spelt)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Trie:
        x = np.load(io.BytesIO(blob))
        return cls(x["low"], x["high"], x["child"], x["ends"], x["letter"], x["counts"], x["words"].tobytes().decode().split("\n"))

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The children that a letter leads to, -1 where it leads nowhere."""
        bit = np.uint64(1) << (letter.astype(np.uint64) & np.uint64(63))
        low, upper = self.low[node], letter >= 64
        mask = np.where(upper, self.high[node], low)
        rank = np.bitwise_count(mask & (bit - np.uint64(1))).astype(np.int64) + np.where(upper, np.bitwise_count(low), 0)
        return np.where(mask & bit, self.child[node] + rank, -1)

    def fan(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, child) for all children of all nodes."""
        n = np.bitwise_count(self.low[node]).astype(np.int64) + np.bitwise_count(self.high[node])
        which = np.repeat(np.arange(len(node)), n)
        return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.child[node], n)

    def near(self, code: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) for the words exactly one edit from each query.

        States are (query, letters read, node, whether the edit is spent). A
        stack of blocks of them is worked off deepest first, and no block is
        larger than STATES, so memory is bounded by that times the depth. An
        edit is made in one way only: a letter is put in or left out at the end
        of a run of its like, so no word is met twice."""
        size, n = np.diff(at), len(at) - 1
        stack = [(np.arange(lo, min(n, lo + STATES // 64)), np.zeros(min(n, lo + STATES // 64) - lo, np.int64), np.zeros(min(n, lo + STATES // 64) - lo, np.int64), False) for lo in range(0, n, STATES // 64)]
        while stack:
            q, i, node, spent = stack.pop()
            if spent:
                done = i == size[q]
                word = self.ends[node[done]]
                if (word >= 0).any():
                    yield q[done][word >= 0], word[word >= 0]
                q, i, node = q[~done], i[~done], node[~done]
                if len(q):
                    to = self.step(node, code[at[q] + i])
                    on = to >= 0
                    if on.any():
                        stack.append((q[on], i[on] + 1, to[on], True))
                continue
            inside = i < size[q]
            own = np.full(len(q), 255, np.uint8)
            own[inside] = code[at[q[inside]] + i[inside]]
            after = np.full(len(q), 255, np.uint8)
            more = i + 1 < size[q]
            after[more] = code[at[q[more]] + i[more] + 1]
            to = np.full(len(q), -1, np.int64)
            to[inside] = self.step(node[inside], own[inside])
            on = to >= 0
            if on.any():
                stack.append((q[on], i[on] + 1, to[on], False))
            left_out = inside & (own != after)
            which, child = self.fan(node)
            other = self.letter[child] != own[which]
            which, child = which[other], child[other]
            swapped = inside[which]
            states = (np.concatenate([q[left_out], q[which], q[which[swapped]]]), np.concatenate([i[left_out] + 1, i[which], i[which[swapped]] + 1]), np.concatenate([node[left_out], child, child[swapped]]))
            for lo in range(0, len(states[0]), STATES):
                stack.append((*(x[lo : lo + STATES] for x in states), True))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of a task's words, which come sorted, a bounded number of letters each."""
    words: list[str] = []
    counts: list[int] = []
    size = 0

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([Trie.build(words, counts).dump()], pa.binary())], ["shard"])

    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if words and size + len(word) > SHARD_LETTERS:
                yield given()
                words, counts, size = [], [], 0
            words.append(word)
            counts.append(n)
            size += len(word)
    if words:
        yield given()


def _rounds(shards: DataFrame) -> Iterator[list[bytes]]:
    """Shards in turn, as many at a time as may be broadcast together."""
    got: list[bytes] = []
    for row in shards.toLocalIterator():
        if got and sum(map(len, got)) + len(row.shard) > ROUND_BYTES:
            yield got
            got = []
        got.append(bytes(row.shard))
    if got:
        yield got


def near_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(word, n) -> word, n_near, near_n, near: how many other words are one
    edit away, and the most frequent of them, for words that have any."""
    letters_, n = words.agg(F.sum(F.char_length("word")), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], NEAR)
    shards = words.repartitionByRange(max(1, -(-letters_ // SHARD_LETTERS)), "word").sortWithinPartitions("word")
    shards = materialize(shards.mapInArrow(_shards, SHARDS), "spelling-shards")
    dealt = materialize(words.select("word").repartition(max(1, -(-letters_ // TASK_LETTERS)), "word"), "spelling-words")
    found = None
    for blobs in _rounds(shards):
        sent = spark.sparkContext.broadcast(blobs)

        def emit(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tries: list[Trie] = []
            for batch in batches:
                tries = tries or [Trie.load(b) for b in sent.value]
                asked = batch.column("word").to_pylist()
                code, at = encoded(asked)
                for trie in tries:
                    n_near, best_n, best = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.full(len(asked), len(trie.words))
                    for q, word in trie.near(code, at):
                        n_near += np.bincount(q, minlength=len(asked))
                        order = np.lexsort((word, -trie.counts[word], q))
                        q, word = q[order], word[order]
                        first = np.concatenate([[True], q[1:] != q[:-1]])
                        q, word = q[first], word[first]
                        count = trie.counts[word]
                        better = (count > best_n[q]) | ((count == best_n[q]) & (word < best[q]))
                        best_n[q[better]], best[q[better]] = count[better], word[better]
                    hit = np.flatnonzero(n_near)
                    yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in hit], pa.string()), pa.array(n_near[hit]), pa.array(best_n[hit]), pa.array([trie.words[w] for w in best[hit]], pa.string())], ["word", "n_near", "near_n", "near"])

        part = materialize(dealt.mapInArrow(emit, NEAR), "spelling-near")
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near_n").alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> word, root: the last form that following forms leads to.
    Each join doubles the steps taken, and forms are five times as frequent as
    their words, so five joins reach every end."""
    led = forms.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        onward = led.select(F.col("word").alias("root"), F.col("root").alias("further"))
        led = materialize(led.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return led


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> word, form, root, n, n_near, form_n, one row for each
    word of at least six letters that occurs at least five times.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased. Two
    are near if one letter put in, left out or replaced makes one the other. A
    word's form is its near word of largest n (ties: first in code-point order)
    if that is at least five times as frequent, else null; root is the last that
    following forms leads to, the word itself if it has no form.

    The vocabulary is cut by ranges into tries of two million letters at most
    (a longer word is its own), built in tasks. They are broadcast some 128 MB
    at a time, whatever the vocabulary's size, and every word's automaton is
    run against every one, deepest states first; a range that a word can't
    reach is left at its root. A task gives, for each word and trie, the number
    of near words and the best, never the pairs. The driver holds one round of
    tries and nothing else.

    A null or empty text has no words; a null doc_id stands as an empty id in
    the slips; repeated rows count each; other columns are ignored; an empty
    table gives an empty table. Runs are told apart by 64 bits of hash within a
    task, and by their text beyond.
    """
    spark = docs.sparkSession
    words = materialize(word_counts(docs), "spelling-counts")
    near = materialize(words.join(near_words(spark, words), "word", "left"), "spelling-best")
    formed = F.col("near_n") >= RATIO * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    led = roots(near.where("form is not null"))
    return near.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
