"""Quality scores of a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textbytes
from lexiloom.llm.language_id import fold
from lexiloom.session import text_batches

TRAINING_ROWS = 20_000
BINS = 32
COARSE = 8
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def _class(values: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


UPPER = _class(bytes(range(65, 91)))
LETTERS = _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
DIGITS = _class(bytes(range(48, 58)))
SYMBOLS = _class(b"#*$%&|<>{}[]@^~=+\\/_")
STOPS = _class(b".,;:!?")
NAMES = ["bytes", "words", "word_bytes", "letters", "upper", "digits", "symbols", "stops", "bangs", "lines", "short_words", "long_words", "marked_words", "distinct", "commonest", "repeated_pairs", "repeated_lines", "other_bytes"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text (bytes as they are)."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)

    def inside(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    start, end, row = textbytes.spans(data, offsets)
    hashed = textbytes.hashes(data, start, end)
    length = end - start
    words = np.bincount(row, minlength=n).astype(float)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)

    def groups(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of each row, and the count of its commonest."""
        order = np.lexsort((keys, rows))
        k, r = keys[order], rows[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]) if len(k) else np.zeros(0, np.int64)
        runs, most = np.diff(np.r_[first, len(k)]), np.zeros(n)
        np.maximum.at(most, r[first], runs)
        return np.bincount(r[first], minlength=n).astype(float), most

    distinct, most = groups(hashed, row)
    pairs, pair_row = textbytes.ngrams(hashed, row, 2)
    pair_kinds, _ = groups(pairs, pair_row)
    n_pairs = np.bincount(pair_row, minlength=n).astype(float)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[start] if len(start) else start
    opens = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (row[1:] != row[:-1])]) if len(start) else start
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textbytes.mix(hashed))])
    lines = np.bincount(row[opens], minlength=n).astype(float)
    line_kinds, _ = groups(prefix[np.r_[opens[1:], len(start)]] - prefix[opens] if len(opens) else np.zeros(0, np.uint64), row[opens])
    marked = ~LETTERS[data[end - 1]] & ~LETTERS[data[np.maximum(end - 2, start)]] if len(start) else start
    columns = [
        np.log1p(size), np.log1p(words), np.bincount(row, weights=length, minlength=n) / per_word, inside(LETTERS[data]) / per_byte, inside(UPPER[data]) / per_byte,
        inside(DIGITS[data]) / per_byte, inside(SYMBOLS[data]) / per_byte, inside(STOPS[data]) / per_word, inside((data == 33) | (data == 63)) / per_word, lines / per_word,
        np.bincount(row[length == 1], minlength=n) / per_word, np.bincount(row[length > 14], minlength=n) / per_word, np.bincount(row, weights=marked, minlength=n) / per_word,
        distinct / per_word, most / per_word, 1 - pair_kinds / np.maximum(n_pairs, 1), 1 - line_kinds / np.maximum(lines, 1), inside(data >= 128) / per_byte,
    ]
    return np.column_stack(columns)


@dataclass(frozen=True)
class Additive:
    """Bin edges and a lookup table for each feature, and for chosen pairs of
    features a table over coarser bins; a score is a sum of look-ups."""

    base: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, edges in enumerate(self.edges):
            total += self.tables[f][np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, prior: float = 5.0) -> np.ndarray:
    """A shallow tree over ordered bins: the best cuts one after another, and
    a Newton step for each leaf."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    cuts = [0, len(gradient)]

    def worth(a: int, b: np.ndarray | int) -> np.ndarray:
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + prior)

    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + (g[b] - g[at]) ** 2 / (h[b] - h[at] + prior) - worth(a, b)
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), int(at[i])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + prior)
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray, prior: float = 5.0) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a two-way table: its gain and Newton steps."""
    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    best, steps = 0.0, np.zeros_like(gradient)
    for i in range(len(g) - 1):
        for j in range(g.shape[1] - 1):
            gs = np.array([g[i, j], g[i, -1] - g[i, j], g[-1, j] - g[i, j], g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j]])
            hs = np.array([h[i, j], h[i, -1] - h[i, j], h[-1, j] - h[i, j], h[-1, -1] - h[i, -1] - h[-1, j] + h[i, j]])
            gain = float((gs**2 / (hs + prior)).sum())
            if gain > best:
                best, s = gain, gs / (hs + prior)
                steps = np.empty_like(gradient)
                steps[: i + 1, : j + 1], steps[: i + 1, j + 1 :], steps[i + 1 :, : j + 1], steps[i + 1 :, j + 1 :] = s
    return best, steps


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, leaves: int = 3, n_pairs: int = 6, pair_rounds: int = 30) -> Additive:
    """Cyclic boosting: each round gives every feature's table one shallow tree
    on the current residuals; then the pairs with the largest gain on the rest
    are boosted in turn the same way. Without rows or with one label only the
    score is constant."""
    n, k = len(x), len(NAMES)
    positive = (float(y.sum()) + 1) / (n + 2)
    base = float(np.log(positive / (1 - positive)))
    edges = [_cuts(x[:, f], BINS) if n else np.zeros(0) for f in range(k)]
    coarse = [_cuts(x[:, f], COARSE) if n else np.zeros(0) for f in range(k)]
    tables = np.zeros((k, BINS))
    if n == 0 or y.min() == y.max():
        return Additive(base, edges, coarse, tables, [], np.zeros((0, COARSE, COARSE)))
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(k)]
    total = np.full(n, base)
    for _ in range(rounds):
        for f in range(k):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(bins[f], weights=y - p, minlength=BINS), np.bincount(bins[f], weights=p * (1 - p), minlength=BINS), leaves)
            tables[f] += step
            total += step[bins[f]]
    low = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(k)]

    def two_way(f: int, g: int) -> tuple[float, np.ndarray]:
        p, at = 1 / (1 + np.exp(-total)), low[f] * COARSE + low[g]
        sums = [np.bincount(at, weights=w, minlength=COARSE * COARSE).reshape(COARSE, COARSE) for w in (y - p, p * (1 - p))]
        return _quadrants(*sums)

    gains = sorted(((two_way(f, g)[0], f, g) for f in range(k) for g in range(f + 1, k)), reverse=True)
    pairs = [(f, g) for _, f, g in gains[:n_pairs]]
    pair_tables = np.zeros((len(pairs), COARSE, COARSE))
    for _ in range(pair_rounds):
        for i, (f, g) in enumerate(pairs):
            step = rate * two_way(f, g)[1]
            pair_tables[i] += step
            total += step[low[f], low[g]]
    return Additive(base, edges, coarse, tables, pairs, pair_tables)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in textbytes.chunks(batch.column(0), 2_000_000, lower=False):
            x = features(data, offsets)
            yield pa.record_batch([batch.column(1).slice(at, len(x)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["label", "x"])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in textbytes.chunks(batch.column(1), 2_000_000, lower=False):
                score = shared.value.score(features(data, offsets))
                yield pa.record_batch(
                    [batch.column(0).slice(at, len(score)), batch.column(2).slice(at, len(score)), pa.array(score), pa.array((score >= 0.3).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return run


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, most: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, text) and (doc_id, quality) -> (doc_id, held_out, score,
    predicted), score the probability of label 1.

    Learnt from labelled documents whose fold is not 0, at most ``most`` in
    hash order (a documented bound on the fit); their 18 measures of text
    alone are fetched, and every text is scored by look-ups.

    Null and empty texts are measured as empty and scored like any other; null
    labels are ignored, contradicting labels all count; null ids are held out;
    repeated rows score alike; other columns are ignored; without two labels
    the score is the smoothed share of label 1; an empty table gives an empty table.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(F.col("doc_id"), folds) == 0).alias("held_out"))
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    chosen = known.where(fold(F.col("doc_id"), folds) != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(_measured, "label int, x array<double>").toPandas()
    x = np.array(sample["x"].tolist(), dtype=float).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T, sample["label"].to_numpy()))  # the order of arrival must not matter
    model = fit(x[order], (sample["label"].to_numpy()[order] == 1).astype(float))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text", "held_out").mapInArrow(_scored(shared), SCORED)
