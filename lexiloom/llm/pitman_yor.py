"""A hierarchical Pitman-Yor language model, seated and scored over all texts.

A restaurant for each context of two words, whose customers are the words that
follow it; those with the same last word share a parent, whose customers are
their tables; all these share one root, whose customers are theirs and whose
base is uniform over the vocabulary and one unknown word.

Tokens are dealt to buckets by the word before them, so a word's restaurant and
all its children's are in one bucket. A word that more than a quarter of a
bucket follows is spread over as many parts as it takes by what follows: dishes
are whole there too, and only sums over its restaurants span parts. Discounts
follow from how many words, pairs and triples are met once and twice in all
training tokens; buckets count the latter two, each its own. Seating is
sampled by Gibbs sweeps in each bucket, each of which seats all customers anew
from the exact distribution of their party; the root's customers, and those
sums, are exchanged by key. A task holds one bucket, whose size is fixed, but for
a pair of words that alone is more than that: it isn't split. The number of
buckets grows with the tokens, and no stage sends more rows than it has tokens
or keys.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textbytes
from lexiloom.llm.language_id import fold
from lexiloom.session import materialize, text_batches

END = np.uint64(0x45E4D0F7E4A11CE1)
BEGIN = np.uint64(0xB0517A3C92D4E6F3)
CONTEXT_KEY, CUSTOMERS_KEY, TABLES_KEY, ROOT_KEY = (np.uint64(x) for x in (0x5DEECE66D1F3A7B9, 0x3C6EF372FE94F82B, 0x9E3779B97F4A7C15, 0xA11AB1E5A11AB1E5))
MOST_SPREAD = 1_000_000
BATCH_TOKENS = 3_000_000
BATCH_DOCS = 32_000
TRAINED = 1 << 15
SAMPLES = 3
BURN_IN = 2
SMALL = 1024
FEW = 400
CELLS = 100_000
FIXED = float(1 << 34)
SEED = 20240229
PART = "bucket int, batch long, kind int, blob binary"
ASKED = "owner int, bucket int, blob binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def trimmed(run):
    """The same function of Arrow tables; memory that it has freed goes back to
    the system before the worker waits for its next task, not only to its own pools."""

    def held(*tables: pa.Table) -> pa.Table:
        out = run(*tables)
        release()
        return out

    if run.__code__.co_argcount == 1:
        return lambda table: held(table)
    return lambda left, right: held(left, right)


def release() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob. Sorted hashes (as differences) and 64-bit
    integers are stored byte by byte of all of them, as upper bytes are mostly alike."""
    head, body = [len(arrays)], []
    for a in arrays:
        rising = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        whole = rising or a.dtype == np.int64
        head += [len(a), ord("+" if rising else "=" if whole else a.dtype.char)]
        a = np.diff(a, prepend=np.uint64(0)) if rising else np.ascontiguousarray(a)
        body.append((a.view(np.uint8).reshape(-1, 8).T if whole else a).tobytes())
    return zstandard.compress(np.array(head, np.int64).tobytes() + b"".join(body), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    blob = zstandard.decompress(blob)
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n, 8)
    at, out = 8 * (1 + 2 * n), []
    for size, kind in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        if chr(kind) in "+=":
            values = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * size, at).reshape(8, -1).T).view(np.int64).ravel()
            out.append(np.cumsum(values.view(np.uint64), dtype=np.uint64) if chr(kind) == "+" else values)
            at += 8 * size
            continue
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(blob, dtype, size, at))
        at += size * dtype.itemsize
    return out


@dataclass(frozen=True)
class Run:
    """Some rows' tokens and the rows they are of, and all columns but the text."""

    word: np.ndarray
    row: np.ndarray
    rest: pa.RecordBatch

    def earlier(self, words: np.ndarray, begin: object) -> np.ndarray:
        """What stands one token before each, given for each token; ``begin`` at a row's first."""
        out = np.concatenate([words[:1], words[:-1]])
        out[np.r_[True, self.row[1:] != self.row[:-1]]] = begin
        return out


def tokens(batches: Iterator[pa.RecordBatch], most: int = BATCH_TOKENS) -> Iterator[Run]:
    """Runs of whole rows (text first), across batches, of some ``most`` tokens
    and BATCH_DOCS rows."""
    held: list[Run] = []
    rows = n = 0

    def joined() -> Run:
        starts = np.cumsum([0, *(x.rest.num_rows for x in held)])
        rest = pa.Table.from_batches([x.rest for x in held]).combine_chunks().to_batches()[0]
        return Run(np.concatenate([x.word for x in held]), np.concatenate([x.row + s for x, s in zip(held, starts, strict=False)]), rest)

    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_DOCS // 4):
            piece = batch.slice(at, BATCH_DOCS // 4)
            for first, data, offsets in textbytes.chunks(piece.column(0), 2_000_000):
                words, row = textbytes.word_hashes(data, offsets)
                m = len(offsets) - 1
                ends = np.searchsorted(row, np.arange(m), side="right")
                word, row = np.insert(words, ends, END), np.insert(row, ends, np.arange(m)).astype(np.int32)
                if held and (n + len(word) > most or rows + m > BATCH_DOCS):
                    yield joined()
                    held, rows, n = [], 0, 0
                held.append(Run(word, row, piece.slice(first, m)))
                rows, n = rows + m, n + len(word)
    if held:
        yield joined()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words."""
    for run in tokens(batches):
        keys, n = np.unique(run.word, return_counts=True)
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


def discount(once: int, twice: int) -> float:
    """From how many are met once and twice."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


@dataclass(frozen=True)
class Plan:
    """What is known of the corpus before seating: bounded, whatever its size.
    ``spread`` are the words whose followers are dealt in ``parts``; discounts
    are the root's, of one word and of two, the latter two known once all
    buckets have counted (``told``)."""

    buckets: int
    total: int
    kinds: int
    spread: np.ndarray
    parts: np.ndarray
    discounts: tuple[float, float, float]
    strength: float = 1.0

    def parts_of(self, words: np.ndarray) -> np.ndarray:
        """Over how many parts each word's followers are dealt."""
        if not len(self.spread):
            return np.ones(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.spread, words), len(self.spread) - 1)
        return np.where(self.spread[at] == words, self.parts[at], 1)

    def owner(self, keys: np.ndarray, of: int) -> np.ndarray:
        return ((textbytes.mix(keys) >> np.uint64(33)) % np.uint64(of)).astype(np.int64)

    def told(self, met: list[int]) -> Plan:
        """With the discounts of what all buckets have ``met``."""
        return replace(self, discounts=(self.discounts[0], discount(*met[:2]), discount(*met[2:])))

    @property
    def owners(self) -> int:
        return max(1, self.buckets // 8)


def survey(trained: DataFrame, bucket_tokens: int) -> Plan:
    """Counts of all training tokens, their kinds, the frequent words, and the
    root's discount from how many words are met once and twice."""
    counts = trained.select("text").mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "language-model-counts")
    total, kinds, once, twice = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    share = max(1, bucket_tokens // 4, total // MOST_SPREAD)
    spread = counts.where(f"n > {share}").toPandas()  # MOST_SPREAD words at most
    keys = spread["key"].to_numpy().astype(np.int64).view(np.uint64)
    parts = -(-spread["n"].to_numpy().astype(np.int64) // share)
    order = np.argsort(keys)
    return Plan(max(24, -(-total // bucket_tokens)), total, kinds, keys[order], parts[order], (discount(once, twice), 0.5, 0.5))


def _narrow(values: np.ndarray, most: int) -> np.ndarray:
    return values.astype(np.uint16 if most <= 1 << 16 else np.uint32)


def _ranked(values: list[np.ndarray], n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct numbers (under n) of some arrays, and the arrays in places of
    these: by marks, or sorted where they are far fewer than n."""
    if 16 * len(values[0]) < n:
        own, at = np.unique(np.concatenate(values), return_inverse=True)
        return own, np.split(at, len(values))
    met = np.zeros(n, bool)
    for x in values:
        met[x] = True
    place = np.cumsum(met, dtype=np.uint32) - np.uint32(1)
    return np.flatnonzero(met), [place[x] for x in values]


def dealt_run(some: Run, plan: Plan) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of a run's tokens. A blob has the words' hashes; by word
    before, in runs, what follows and what was further before, in places of
    that list; rows as 15-bit numbers with a bit for training. Only buckets
    that have tokens are gone through."""
    train = ~some.rest.column(2).to_numpy(zero_copy_only=False)
    names, which = np.unique(np.append(some.word, BEGIN), return_inverse=True)
    w, begin = which[:-1].astype(np.uint32), np.uint32(which[-1])
    del which
    v = some.earlier(w, begin)
    x = some.earlier(v, begin)
    parts = plan.parts_of(names)[v]
    many = np.flatnonzero(parts > 1)
    bucket = plan.owner(names, plan.buckets)[v]
    part = textbytes.mix(some.word[many]) % parts[many].astype(np.uint64)
    bucket[many] = plan.owner(textbytes.combine(names[v[many]], part), plan.buckets)
    width = np.uint64(max(1, int(len(names) - 1).bit_length()))
    order = np.argsort((bucket.astype(np.uint64) << width | v.astype(np.uint64)) << width | w.astype(np.uint64), kind="stable")
    bucket, w, v, x = bucket[order], w[order], v[order], x[order]
    place = (some.row + np.where(train[some.row], TRAINED, 0)).astype(np.uint16)[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own, (a, b, c) = _ranked([v[s:e], w[s:e], x[s:e]], len(names))
        runs = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        yield int(bucket[s]), pack(names[own], _narrow(a[runs], len(own)), np.diff(np.r_[runs, e - s]).astype(np.uint32), _narrow(b, len(own)), _narrow(c, len(own)), place[s:e])


def _dealt(shared):
    """Each run's blobs by bucket, and once its rows' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        plan: Plan = shared.value
        number = TaskContext.get().partitionId() << 24
        for some in tokens(batches):
            out = [(b, 0, blob) for b, blob in dealt_run(some, plan)]
            ids = some.rest.column(1)
            train = ~some.rest.column(2).to_numpy(zero_copy_only=False)
            lengths = np.bincount(some.row, minlength=some.rest.num_rows)
            out.append((number % plan.buckets, 1, pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False), train, lengths.astype(np.int64))))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([number] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "batch", "kind", "blob"])
            number += 1
        release()

    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers, by Stirling's series from 8 on."""
    y = x + 8
    below = np.log(np.multiply.reduce([x + k for k in range(8)]))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - below


@lru_cache(8)
def _seatings(discount: float) -> list[np.ndarray]:
    """For 0 to SMALL customers the logarithms of how much all their seatings at
    1, 2, ... tables weigh together (generalised Stirling numbers)."""
    rows, row = [np.zeros(0), np.zeros(1)], np.zeros(1)
    for n in range(1, SMALL):
        t = np.arange(1, n + 1)
        row = np.logaddexp(np.r_[row + np.log(n - discount * t), -np.inf], np.r_[-np.inf, row])
        rows.append(row)
    return rows


def drawn(rng: np.random.Generator, seatings: np.ndarray, new: np.ndarray, more: np.ndarray) -> np.ndarray:
    """For each party how many tables it takes, given what its seatings at 1, 2,
    ... tables weigh (logarithms) but for the weights of opening them."""
    n, tables = len(seatings), []
    step = max(1, CELLS // n)
    for at in range(0, len(new), step):
        a, b = new[at : at + step, None], more[at : at + step, None]
        weight = seatings + np.c_[np.zeros(len(a)), np.cumsum(np.log(a + b * np.arange(1, n)), axis=1)]
        weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        tables.append(1 + np.minimum((weight < rng.random((len(a), 1)) * weight[:, -1:]).sum(axis=1), n - 1))
    return np.concatenate(tables)


def sit_anew(rng: np.random.Generator, customers: np.ndarray, new: np.ndarray, more: np.ndarray, discount: float) -> np.ndarray:
    """A Gibbs sweep over parties (dish and restaurant): all customers of each
    stand up, and the number of tables they take is drawn from its exact
    distribution given all else, which no earlier seating enters. Opening a
    table weighs ``new`` and ``more`` for each that the party has. Up to
    SMALL customers the weights of all seatings are exact, of more they are those
    of ``log_seatings``."""
    tables = np.minimum(customers, 1).astype(np.int64)
    order = np.argsort(customers, kind="stable")
    edges = np.searchsorted(customers[order], np.arange(2, SMALL + 2))
    for n, s, e in zip(range(2, SMALL + 1), edges[:-1], edges[1:], strict=True):
        if e > s:
            who = order[s:e]
            tables[who] = drawn(rng, _seatings(discount)[n], new[who], more[who])
    large = order[edges[-1] :]
    if len(large):
        tables[large] = large_tables(rng, customers[large], new[large], more[large], discount)
    return tables


@lru_cache(8)
def _saddles(discount: float) -> tuple[np.ndarray, ...]:
    """On a grid of the logarithm of customers by table: the place s of the
    saddle, the logarithm of its width, and how far, times tables, the next term
    of the expansion goes beyond it."""
    s = np.exp(np.linspace(np.log(1e-4), np.log(min(600.0, 40 / (1 - discount))), 40_000))
    inner, slope = -np.expm1(-discount * s), 1 / np.expm1(s)
    ratio = np.log(-np.expm1(-s) * discount / inner) + s * (1 - discount)
    steep = slope + (1 - discount) - discount * (1 - inner) / inner  # of ratio by s

    second = steep / slope  # cumulants over the first, and over one another
    near, still = np.searchsorted(s, [60, 40])  # it changes no more from there on
    some, flat = second[:near], slope[:near]
    third = np.gradient(some, s[:near]) / flat + some * some
    fourth = np.gradient(third, s[:near]) / flat + some * third
    beyond = (fourth / some**2 / 8 - 5 * third**2 / some**3 / 24) / np.exp(ratio[:near])
    return ratio, s, ratio + np.log(second), np.where(np.arange(len(s)) < still, np.resize(beyond, len(s)), beyond[still - 1])


def log_seatings(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """The logarithm of what all seatings of many customers at so many tables
    weigh, up to a term that depends on the customers alone: the coefficient of
    z^customers in ((1 - (1 - z)^d) / d)^tables / tables!, by the saddle point
    at 1 - z = exp(-s) and the next term of its expansion; up to FEW tables set
    right by the exact values of SMALL customers."""
    return _saddle(customers, tables, discount) + _few(discount)[np.minimum(tables, FEW).astype(np.int64)]


def _saddle(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    grid, places, widths, beyond = _saddles(discount)
    ratio = np.log(customers / tables)
    s = np.interp(ratio, grid, places)
    curve = np.log1p(np.clip(np.interp(ratio, grid, beyond) / tables, -0.5, 0.5))
    return tables * np.log(-np.expm1(-discount * s) / discount) - customers * np.log(-np.expm1(-s)) - _log_gamma(tables + 1.0) - 0.5 * (np.log(tables) + np.interp(ratio, grid, widths)) + curve


@lru_cache(8)
def _few(discount: float) -> np.ndarray:
    """By tables, what the saddle point lacks; nothing from FEW on."""
    lacks = _seatings(discount)[SMALL][:FEW] - _saddle(np.full(FEW, SMALL), np.arange(1.0, FEW + 1), discount)
    return np.r_[0.0, lacks - lacks[-1]]


def large_tables(rng: np.random.Generator, customers: np.ndarray, new: np.ndarray, more: np.ndarray, discount: float) -> np.ndarray:
    """``sit_anew`` for parties of over SMALL customers. Odds of one table more
    fall with the tables, so the likeliest number is found by halving; numbers
    further off than ten deviations are not drawn."""

    def gain(who: np.ndarray, t: np.ndarray) -> np.ndarray:
        c = customers[who]
        return log_seatings(c, t + 1.0, discount) - log_seatings(c, t * 1.0, discount) + np.log(new[who] + more[who] * t)

    everyone = np.arange(len(customers))
    low, high = np.ones(len(customers), np.int64), customers - 1
    while (wide := high - low > 1).any():
        middle = (low + high) // 2
        up = gain(everyone, middle) > 0
        low, high = np.where(wide & up, middle, low), np.where(wide & ~up, middle, high)
    bend = np.maximum(gain(everyone, low) - gain(everyone, np.minimum(low + 1, customers - 2)), 1e-12)
    reach = np.minimum(10 / np.sqrt(bend) + 20, customers).astype(np.int64)
    begin, end = np.maximum(1, low - reach), np.minimum(customers - 1, low + reach)
    tables, order, at = np.ones(len(customers), np.int64), np.argsort(end - begin, kind="stable"), 0
    while at < len(order):
        last = at + 1
        while last < len(order) and (last + 1 - at) * (end - begin)[order[last]] <= CELLS:
            last += 1
        who = order[at:last]
        t = begin[who, None] + np.arange(int((end - begin)[who].max()) + 1)
        inside = t < end[who, None]
        steps = np.where(inside, gain(np.broadcast_to(who[:, None], t.shape), np.minimum(t, end[who, None] - 1)), -np.inf)
        weight = np.c_[np.zeros(len(who)), np.cumsum(steps, axis=1)]
        weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        tables[who] = begin[who] + np.minimum((weight < rng.random((len(who), 1)) * weight[:, -1:]).sum(axis=1), (end - begin)[who])
        at = last
    return tables


def _smallest(values: np.ndarray) -> np.ndarray:
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def _counts(of: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(of, weights=weights, minlength=n)


class Bucket:
    """A bucket's tokens, its distinct triples (context of two words and dish)
    and pairs (one word and dish), and their sampled seating; the same for the
    same blobs, in whatever order they came."""

    def __init__(self, plan: Plan, number: int, batches: list[int], blobs: list[bytes], seats: bytes | None = None):
        self.plan, self.number = plan, number
        parts = [unpack(blobs[i]) for i in np.argsort(batches, kind="stable")]
        self.batches = sorted(batches)
        self.lengths = [len(p[5]) for p in parts]
        self.names, known = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        known = known.astype(np.uint32)

        def joined(field: int) -> np.ndarray:
            return np.concatenate([known[s : s + len(p[0])][p[field]] for p, s in zip(parts, shift, strict=False)])

        n = np.uint64(len(self.names))
        pair, of = np.unique(np.repeat(joined(1), np.concatenate([p[2] for p in parts])) * n + joined(3), return_inverse=True)
        self.before, self.word = (pair // n).astype(np.int32), (pair % n).astype(np.int32)
        of = of.astype(np.uint32)
        triple, of = np.unique(of * n + joined(4), return_inverse=True)
        of = of.astype(np.uint32)
        place = np.concatenate([p[5] for p in parts])
        del parts, known, pair
        self.row = place & np.uint16(TRAINED - 1)
        self.pair = (triple // n).astype(np.int32)
        self.triple_of = of
        self.count = _counts(of, len(triple), place >= TRAINED).astype(np.int32)
        del of
        context, self.context = np.unique(self.before[self.pair] * n + triple % n, return_inverse=True)
        self.context = self.context.astype(np.int32)
        self.context_before, self.context_further = (context // n).astype(np.int32), (context % n).astype(np.int32)
        self.parts = plan.parts_of(self.names)
        if seats is None:
            self.seat()
        else:
            flat = unpack(seats)
            self.samples = [self.sample(*flat[i : i + 2]) for i in range(0, len(flat), 2)]

    def parent(self, customers: np.ndarray, tables: np.ndarray, over: np.ndarray, sums: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Each pair's predictive probability in its word's restaurant, over what the root gives its dish."""
        plan, (seated, taken) = self.plan, sums
        room = plan.strength + seated[self.before]
        return (customers - plan.discounts[1] * tables + (plan.strength + plan.discounts[1] * taken[self.before]) * over[self.word]) / room

    def seat(self) -> None:
        """Gibbs sweeps over both levels. What the root gives a dish is taken from
        this bucket's own tables, whose words before are a random part of all;
        so are, for a word dealt in parts, its restaurants' other tables."""
        plan, rng = self.plan, np.random.default_rng([SEED, self.number])
        n, pairs, contexts = len(self.names), len(self.word), len(self.context_before)
        many, often = self.shared_tables()
        tables = np.minimum(self.count, 1).astype(np.int64)
        above = np.minimum(_counts(self.pair, pairs, tables), 1).astype(np.int64)
        self.samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def customers() -> np.ndarray:
            return _counts(self.pair, pairs, tables).astype(np.int64)

        def low() -> tuple[np.ndarray, np.ndarray]:
            """What a new table weighs for each triple in ``many``, and how much more for each it has."""
            c = customers()
            given = self.parent(c, above, share(), tuple(_counts(self.before, n, y) * self.parts for y in (c, above)))[self.pair[many]]
            inside = (_counts(self.context, contexts, tables) * self.parts[self.context_before])[self.context[many]]
            return (plan.strength + plan.discounts[2] * (inside - tables[many])) * given, plan.discounts[2] * given

        def high() -> tuple[np.ndarray, np.ndarray]:
            """The same for each pair in ``often``."""
            given = share()[self.word[often]]
            taken = (_counts(self.before, n, above) * self.parts)[self.before[often]]
            return (plan.strength + plan.discounts[1] * (taken - above[often])) * given, plan.discounts[1] * given

        def share() -> np.ndarray:
            return _counts(self.word, n, above) / max(1.0, float(above.sum()))

        for sweep in range(BURN_IN + SAMPLES):
            tables[many] = sit_anew(rng, self.count[many], *low(), plan.discounts[2])
            above = np.minimum(above, customers())
            above[often] = sit_anew(rng, customers()[often], *high(), plan.discounts[1])
            if sweep >= BURN_IN:
                self.samples.append(self.sample(tables[many], above[often]))

    def seats(self) -> bytes:
        """The sampled seating, for the task that scores."""
        many, often = self.shared_tables()
        return pack(*(_smallest(x) for tables, _, above in self.samples for x in (tables[many], above[often])))

    def shared_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Triples and pairs of two customers or more: only theirs may share tables."""
        return np.flatnonzero(self.count > 1), np.flatnonzero(_counts(self.pair, len(self.word), self.count) > 1)

    def sample(self, tables_of_many: np.ndarray, above_of_often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables of all triples, customers of all pairs, tables of all pairs."""
        many, often = self.shared_tables()
        tables = np.minimum(self.count, 1).astype(np.int32)
        tables[many] = tables_of_many
        customers = _counts(self.pair, len(self.word), tables).astype(np.int32)
        above = np.minimum(customers, 1)
        above[often] = above_of_often
        return tables, customers, above

    def shared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What other buckets hold too: dishes (as root customers), contexts and
        words whose followers are dealt in parts."""
        dishes = np.unique(self.word)
        spread = np.flatnonzero(self.parts > 1)
        spread = spread[np.isin(spread, self.context_before)]
        return dishes, np.flatnonzero(self.parts[self.context_before] > 1), spread

    def keys(self) -> np.ndarray:
        dishes, contexts, spread = self.shared()
        of_context = textbytes.combine(self.names[self.context_further[contexts]], self.names[self.context_before[contexts]]) ^ CONTEXT_KEY
        return np.concatenate([self.names[dishes], of_context, self.names[spread] ^ CUSTOMERS_KEY, self.names[spread] ^ TABLES_KEY])

    def sums(self) -> np.ndarray:
        """For every key its part in this bucket: tokens, then by sample tables
        (of a dish or context), customers or tables (of a word in parts)."""
        dishes, contexts, spread = self.shared()
        n, out = len(self.names), []
        pair_count = _counts(self.pair, len(self.word), self.count)
        none = np.zeros(len(spread))
        out.append(np.concatenate([_counts(self.word, n, pair_count)[dishes], _counts(self.context, len(self.context_before), self.count)[contexts], none, none]))
        for tables, c, above in self.samples:
            out.append(np.concatenate([_counts(self.word, n, above)[dishes], _counts(self.context, len(self.context_before), tables)[contexts], _counts(self.before, n, c)[spread], _counts(self.before, n, above)[spread]]))
        return np.column_stack(out).astype(np.int64)

    def scores(self, sums: np.ndarray, root_tables: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each triple's log10 predictive probability, averaged over samples, each
        dish's log10 base probability, and whether it is known. ``totals`` are
        the root's customers and tables by sample."""
        plan, n = self.plan, len(self.names)
        dishes, contexts, spread = self.shared()
        a, b, c = np.cumsum([len(dishes), len(contexts), len(spread)])
        mean = np.zeros(len(self.pair))
        inside = _counts(self.context, len(self.context_before), self.count)
        inside[contexts] = sums[a:b, 0]
        for s, (tables, customers, above) in enumerate(self.samples):
            whole = plan.strength + totals[s]
            over = np.zeros(n)
            over[dishes] = (sums[:a, 1 + s] - plan.discounts[0] * root_tables[:a, s] + (plan.strength + plan.discounts[0] * totals[SAMPLES + s]) / (plan.kinds + 1)) / whole
            seated, taken = _counts(self.before, n, customers), _counts(self.before, n, above)
            seated[spread], taken[spread] = sums[b:c, 1 + s], sums[c:, 1 + s]
            given = self.parent(customers, above, over, (seated, taken))
            held = _counts(self.context, len(self.context_before), tables)
            held[contexts] = sums[a:b, 1 + s]
            room = (plan.strength + inside)[self.context]
            mean += (self.count - plan.discounts[2] * tables + (plan.strength + plan.discounts[2] * held[self.context]) * given[self.pair]) / room
        met = np.zeros(n, np.int64)
        met[dishes] = sums[:a, 0]
        return np.log10(mean / SAMPLES), np.log10((met + 0.1) / (plan.total + 0.1 * (plan.kinds + 1))), met > 0


def _bucket(plan: Plan, parts: pa.Table, seats: bytes | None = None) -> Bucket | None:
    parts = parts.filter(pa.compute.equal(parts["kind"], 0))
    if not parts.num_rows:
        return None
    return Bucket(plan, parts["bucket"][0].as_py(), parts["batch"].to_pylist(), parts["blob"].to_pylist(), seats)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def asked_rows(plan: Plan, bucket: Bucket) -> Iterator[tuple[int, int, bytes]]:
    """(owner, bucket, blob of keys, whether they are dishes, and their sums),
    for owners that have a key."""
    keys, sums = bucket.keys(), bucket.sums()
    dish = np.arange(len(keys)) < len(bucket.shared()[0])
    owner = plan.owner(keys, plan.owners)
    order = np.lexsort((keys, owner))
    edges = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1], True]) if len(order) else np.zeros(0, np.int64)
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine = order[s:e]
        yield int(owner[mine[0]]), bucket.number, pack(keys[mine], dish[mine], *(_smallest(sums[mine, i]) for i in range(sums.shape[1])))


def once_and_twice(blobs: list[bytes]) -> list[int]:
    """How many pairs of a bucket's training tokens are met once and twice, and
    how many triples. Each is whole in one bucket, so sums over buckets are exact."""
    parts = [unpack(x) for x in blobs]
    names, known = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    known, n = known.astype(np.uint32), np.uint64(len(names))
    pairs, further, at = [], [], 0
    for own, before, runs, word, more, place in parts:
        of, train = known[at : at + len(own)], place >= TRAINED
        pairs.append(of[np.repeat(before, runs)[train]] * n + of[word[train]])
        further.append(of[more[train]])
        at += len(own)
    del parts, known
    _, of, pair = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
    del pairs
    triple = np.unique(of.astype(np.uint64) * n + np.concatenate(further), return_counts=True)[1]
    return [int((x == k).sum()) for x in (pair, triple) for k in (1, 2)]


def _met(parts: pa.Table) -> pa.Table:
    blobs = parts.filter(pa.compute.equal(parts["kind"], 0))["blob"].to_pylist()
    return _table("met array<long>", [(once_and_twice(blobs),)] if blobs else [])


def _asked(shared):
    """What a bucket asks its keys' owners, and its discounts and seating, of which
    its own negative number is the owner."""

    def run(parts: pa.Table, met: pa.Table) -> pa.Table:
        if not parts.num_rows:
            return _table(ASKED, [])
        plan = shared.value.told(met["met"][0].as_py())
        if not (bucket := _bucket(plan, parts)):
            return _table(ASKED, [])
        seats = pack(np.array(plan.discounts), np.frombuffer(bucket.seats(), np.uint8))
        return _table(ASKED, [*asked_rows(plan, bucket), (-1 - bucket.number, bucket.number, seats)])

    return run


def _added(plan: Plan, requests: pa.Table) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Who asks, how many keys each, their places among the distinct keys; these
    keys' sums, the root's tables where they are dishes, and whether they are:
    the same whatever the order of requests."""
    order = np.argsort(requests["bucket"].to_numpy(), kind="stable")
    blobs = requests["blob"].to_pylist()
    asked = [unpack(blobs[i]) for i in order]
    keys, which = np.unique(np.concatenate([p[0] for p in asked]), return_inverse=True)
    dish = _counts(which, len(keys), np.concatenate([p[1] for p in asked])) > 0
    sums = np.column_stack([_counts(which, len(keys), np.concatenate([p[2 + i] for p in asked])) for i in range(1 + SAMPLES)]).astype(np.int64)
    rng = np.random.default_rng([SEED, requests["owner"][0].as_py(), 1])
    new = np.full(len(keys), (plan.strength + plan.discounts[0] * plan.kinds) / (plan.kinds + 1))
    tables = np.column_stack([sit_anew(rng, np.where(dish, sums[:, 1 + s], 0), new, np.zeros(len(keys)), plan.discounts[0]) for s in range(SAMPLES)])
    return requests["bucket"].to_numpy()[order].tolist(), [len(p[0]) for p in asked], which, sums, tables, dish


def _rooted(shared):
    """An owner's part of the root's customers and tables."""

    def run(requests: pa.Table) -> pa.Table:
        if requests["owner"][0].as_py() < 0:
            return _table("of int, totals array<long>", [])
        *_, sums, tables, dish = _added(shared.value, requests)
        return _table("of int, totals array<long>", [(0, [*sums[dish, 1:].sum(axis=0).tolist(), *tables.sum(axis=0).tolist()])])

    return run


def _answered(shared):
    def run(requests: pa.Table) -> pa.Table:
        if requests["owner"][0].as_py() < 0:
            return _table("of int, bucket int, owner int, blob binary", [(0, requests["bucket"][0].as_py(), -1, requests["blob"][0].as_py())])
        buckets, sizes, which, sums, tables, _ = _added(shared.value, requests)
        columns = [x[:, i] for x in (sums, tables) for i in range(x.shape[1])]
        columns = [c[which] for c in columns]
        edges = np.cumsum([0, *sizes])
        owner = requests["owner"][0].as_py()
        return _table("of int, bucket int, owner int, blob binary", [(0, b, owner, pack(*(_smallest(c[s:e]) for c in columns))) for b, s, e in zip(buckets, edges[:-1], edges[1:], strict=True)])

    return run


def scored_rows(plan: Plan, bucket: Bucket, answers: list[tuple[int, bytes]], totals: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(batch, bucket, blob of rows and their sums) for a bucket's tokens; sums are
    whole multiples of 1 / FIXED, so that they add up alike in any order."""
    keys = bucket.keys()
    owner = plan.owner(keys, plan.owners)
    sums = np.zeros((len(owner), 1 + 2 * SAMPLES), np.int64)
    order = np.lexsort((keys, owner))
    starts = np.searchsorted(owner[order], [o for o, _ in answers])
    for (_, blob), s in zip(answers, starts.tolist(), strict=True):
        columns = np.column_stack(unpack(blob))
        sums[order[s : s + len(columns)]] = columns
    score, base, known = bucket.scores(sums[:, : 1 + SAMPLES], sums[:, 1 + SAMPLES :], totals)
    word, at = bucket.word[bucket.pair], 0
    for batch, n in zip(bucket.batches, bucket.lengths, strict=True):
        triple, row = bucket.triple_of[at : at + n], bucket.row[at : at + n]
        docs, which = np.unique(row, return_inverse=True)
        of = word[triple]
        sums = (np.rint(_counts(which, len(docs), x) * FIXED).astype(np.int64) for x in (score[triple], base[of]))
        yield batch, bucket.number, pack(docs.astype(np.uint16), *sums, _counts(which, len(docs), known[of]).astype(np.uint16 if n < 1 << 16 else np.uint32))
        at += n


def _summed(shared):
    def run(parts: pa.Table, answers: pa.Table) -> pa.Table:
        lists = parts.filter(pa.compute.equal(parts["kind"], 1))
        rows = list(zip(lists["batch"].to_pylist(), [-1] * lists.num_rows, lists["blob"].to_pylist(), strict=True))
        told = dict(zip(answers["owner"].to_pylist(), answers["blob"].to_pylist(), strict=True))
        if -1 in told:
            discounts, seats = unpack(told.pop(-1))
            plan = replace(shared.value, discounts=tuple(discounts.tolist()))
            totals = np.array(answers["totals"][0].as_py(), float)
            rows += scored_rows(plan, _bucket(plan, parts, seats.tobytes()), sorted(told.items()), totals)
        return _table("batch long, bucket int, blob binary", rows)

    return run


def _gathered(total: int):
    def run(parts: pa.Table) -> pa.Table:
        order = np.argsort(parts["bucket"].to_numpy())
        blobs = parts["blob"].to_pylist()
        ids, known, train, lengths = unpack(blobs[order[0]])
        n = len(ids)
        score, base, met = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in order[1:]:
            docs, s, b, k = unpack(blobs[i])
            score[docs] += s
            base[docs] += b
            met[docs] += k
        columns = [pa.array(ids, mask=~known), pa.array(~train), pa.array(lengths), pa.array(met), pa.array(np.full(n, total, np.int64)), pa.array(base / FIXED), pa.array(score / FIXED)]
        return pa.table(columns, names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def score_texts(docs: DataFrame, folds: int = 10, bucket_tokens: int = 2_100_000) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score: log10 probabilities of whole texts, A-Z lowered, of
    white-space words and one end; learnt from rows whose fold is not 0.

    base_score is the smoothed unigram's, score the model's: seating sampled by
    Gibbs sweeps, predictive probabilities averaged over the samples after a burn-in.

    A null text is empty (its end alone); a null id is held out; repeated rows
    are each learnt and scored; other columns are ignored; an empty table gives
    an empty table; without training rows every word is unknown; a text may be
    of any length. ``docs`` is read twice and must give the same rows in each
    partition: pass a table.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    base = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == 0).alias("held_out"))
    plan = survey(base.where("not held_out"), bucket_tokens)
    shared = spark.sparkContext.broadcast(plan)
    dealt = base.mapInArrow(_dealt(shared), PART)
    met = dealt.groupBy("bucket").applyInArrow(trimmed(_met), "met array<long>")
    met = met.agg(F.array(*(F.coalesce(F.sum(F.get("met", F.lit(i))), F.lit(0)) for i in range(4))).alias("met"))  # one row
    met = spark.range(plan.buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(met))
    asked = dealt.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(trimmed(_asked(shared)), ASKED)
    totals = asked.groupBy("owner").applyInArrow(trimmed(_rooted(shared)), "of int, totals array<long>")
    totals = totals.groupBy("of").agg(F.array(*(F.sum(F.get("totals", F.lit(i))) for i in range(2 * SAMPLES))).alias("totals"))  # one row
    answered = asked.groupBy("owner").applyInArrow(trimmed(_answered(shared)), "of int, bucket int, owner int, blob binary").join(F.broadcast(totals), "of")
    summed = dealt.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(trimmed(_summed(shared)), "batch long, bucket int, blob binary")
    return summed.groupBy("batch").applyInArrow(trimmed(_gathered(plan.total)), SCORES)
