"""Removal of repeated passages, by sliding spans of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textbytes
from lexiloom.session import materialize, text_batches

SENTENCES = 3
WORDS = 10
WINDOW = 10
LONG = 20
SHORT = 36
ENDS = np.zeros(256, dtype=bool)
ENDS[list(b".!?;:,")] = True
MARKS = np.array(sorted(map(ord, "\u037e\u0387\u0589\u05c3\u060c\u061b\u061f\u06d4\u0700\u0701\u0702\u0964\u0965\u0e2f\u0e5a\u0e5b\u0f0d\u0f0e\u104a\u104b\u1362\u1363\u1364\u1365\u1366\u1367\u1368\u17d4\u17d5\u1802\u1803\u1808\u1809\u2025\u2026\u203c\u203d\u2047\u2048\u2049\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\uff61\uff64")))
#: First and last characters of scripts without blanks: Thai to Tibetan, Myanmar, Khmer, CJK and kana, CJK beyond 16 bits.
NO_BLANKS = np.array([(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x3190, 0xA4CF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)])
LEADS = np.zeros(256, dtype=bool)
LEADS[[0xCD, 0xCE, 0xD6, 0xD7, 0xD8, 0xDB, 0xDC, *range(0xE0, 0xF5)]] = True
SPANS = "doc long, mark long, tail long, span long"
TEXT_BITS, RUN_BITS = 24, 40


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, is of a script without blanks, is a closing mark) of the
    characters beyond ASCII that are one or the other."""
    at = np.flatnonzero(LEADS[data])
    size = 2 + (data[at] >= 0xE0) + (data[at] >= 0xF0)
    code = data[at] & (0x7F >> size)
    code = code.astype(np.int64)
    for k in (1, 2, 3):
        more = size > k
        code[more] = code[more] << 6 | data[at[more] + k] & 0x3F
    mark = MARKS[np.minimum(np.searchsorted(MARKS, code), len(MARKS) - 1)] == code
    group = np.searchsorted(NO_BLANKS[:, 0], code, side="right") - 1
    alone = (group >= 0) & (code <= NO_BLANKS[group, 1])
    some = mark | alone
    return at[some], at[some] + size[some], alone[some], mark[some]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of rows (A-Z lowered): (first word of each, one past the last
    word, row, whether it ends a sentence), and the words' (start, end, hash,
    weight). A character of a script without blanks is a word of weight 1, its
    closing mark one of 0; other words weigh 2.

    A sentence or clause ends after a word with a closing mark, at a line's end
    and at the text's. Where WINDOW words have no such end, or 2 * WINDOW with
    characters that are words, a piece ends after the one of least hash, the
    last of equals: so no more than these pass without an end, and copies are
    cut alike wherever they stand."""
    start, end, row = textbytes.spans(data, offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool), start, end, none.astype(np.uint64), none
    at, to, alone, mark = characters(data)
    if len(at):
        cuts = np.unique(np.concatenate([at[alone], to]))
        word = np.searchsorted(start, cuts, side="right") - 1
        cuts = cuts[(cuts > start[word]) & (cuts < end[word])]
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
        row = np.searchsorted(offsets, start, side="right") - 1
    n = len(start)
    words = textbytes.hashes(data, start, end)
    weight = np.full(n, 2)
    weight[np.searchsorted(start, at[alone])] = 1
    weight[np.searchsorted(start, at[alone & mark])] = 0
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    ends = np.ones(n, bool)
    ends[:-1] = ENDS[data[end[:-1] - 1]] | (lines[start[1:]] > lines[end[:-1]]) | (row[1:] != row[:-1])
    ends[np.searchsorted(end, to[mark])] = True
    closes = ends.copy()
    keys = words >> np.uint64(32) << np.uint64(32) | np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)
    for width, barred in ((WINDOW, ends | (weight < 2)), (2 * WINDOW, ends)):
        if n >= width:
            bars = np.concatenate([[0], np.cumsum(barred)])
            chosen = least(keys, width)[bars[width:] == bars[:-width]]
            closes[(np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)] = True
    last = np.flatnonzero(closes) + 1
    first = np.concatenate([[0], last[:-1]])
    return first, last, row[first], ends[last - 1], start, end, words, weight


def run_hashes(first: np.ndarray, last: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the words of pieces lo .. hi - 1."""
    up, down = textbytes._power_table("up", len(words) + 1), textbytes._power_table("down", len(words) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    length = (last[hi - 1] - first[lo]).astype(np.uint64)
    return textbytes.mix((prefix[last[hi - 1]] - prefix[first[lo]]) * down[first[lo]] + length)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of pieces: from each start of a sentence SENTENCES sentences, or as
    many more as it takes to hold WORDS words; from each start of a piece as
    many pieces as hold LONG words, unless the former run has SHORT at most. (row,
    first piece, one past the last, hash, check); pieces count from 0 in their
    row. The check is 32 bits of a second hash, of other word values: runs are
    equal where 96 bits are, which 10 ** 13 different ones aren't but with odds
    under 1e-3."""
    first, last, row, ends, start, end, words, weight = pieces(data, offsets)
    n = len(first)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none
    weights = np.concatenate([[0], np.cumsum(weight)])
    whole = np.flatnonzero(ends)
    begins = np.concatenate([[0], whole[:-1] + 1])
    to = np.maximum(np.arange(len(whole)) + SENTENCES, np.searchsorted(weights[last[whole]], weights[first[begins]] + 2 * WORDS) + 1)
    by_sentence = np.full(n, n + 1)
    ok = to <= len(whole)
    by_sentence[begins[ok]] = whole[to[ok] - 1] + 1
    by_words = np.searchsorted(weights[last], weights[first] + 2 * LONG) + 1
    short = np.flatnonzero(by_sentence <= n)
    short = short[weights[last[by_sentence[short] - 1]] - weights[first[short]] <= 2 * SHORT]
    by_words[short] = n + 1
    lo, hi = np.tile(np.arange(n), 2), np.concatenate([by_sentence, by_words])
    ok = hi <= n
    lo, hi = lo[ok], hi[ok]
    ok = row[hi - 1] == row[lo]
    lo, hi = lo[ok], hi[ok]
    hashed, check = run_hashes(first, last, words, lo, hi), run_hashes(first, last, textbytes.mix(words + np.uint64(1)), lo, hi) >> np.uint64(32)
    base = np.searchsorted(row, row[lo])
    return row[lo], lo - base, hi - base, hashed, check


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, tail, span) of every run: the document; first piece and check;
    bits of its text's hash and the number of pieces. Four full words for each, as
    these rows are what the shuffles hold."""
    for batch in batches:
        bits = batch.column(1).to_numpy() & ((1 << TEXT_BITS) - 1)
        for at, data, offsets in textbytes.chunks(batch.column(2)):
            row, lo, hi, span, check = spans(data, offsets)
            mark = lo.astype(np.int64) << 32 | check.astype(np.int64)
            tail = bits[row + at] << RUN_BITS | (hi - lo)
            yield pa.record_batch([batch.column(0).take(pa.array(row + at)), pa.array(mark), pa.array(tail), pa.array(span.view(np.int64))], names=["doc", "mark", "tail", "span"])


def without(text: str, covered: list[tuple[int, int, int]]) -> tuple[str, int]:
    """The text without the pieces of the given runs (mark, tail, span), and how
    many were removed. Where a run's words aren't what stands there, it is
    another text's of the same document. What stands before the first piece stays."""
    raw = text.encode("utf-8")
    first, last, _, _, start, _, words, _ = pieces(textbytes.LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]))
    mark, tail, span = np.array(covered, np.int64).reshape(-1, 3).T
    lo = mark >> 32
    hi = lo + (tail & ((1 << RUN_BITS) - 1))
    own = hi <= len(first)
    lo, hi, span = lo[own], hi[own], span[own]
    if len(lo):
        own = run_hashes(first, last, words, lo, hi) == span.view(np.uint64)
        lo, hi = lo[own], hi[own]
    gone = np.zeros(len(first) + 1, np.int64)
    np.add.at(gone, lo, 1)
    np.add.at(gone, hi, -1)
    gone = np.cumsum(gone)[:-1] > 0
    edges = [*start[first].tolist(), len(raw)]
    kept = [raw[: edges[0]], *(raw[edges[i] : edges[i + 1]] for i in range(len(first)) if not gone[i])]
    return b"".join(kept).decode("utf-8"), int(gone.sum())


def _cleaned(text_at: int, covered_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, covered = batch.column(text_at), batch.column(covered_at)
            removed = np.zeros(batch.num_rows, np.int64)
            touched = np.flatnonzero(covered.is_valid().to_numpy(zero_copy_only=False))
            if len(touched):
                values = texts.to_pylist()
                for i in touched.tolist():
                    values[i], removed[i] = without(values[i], [(c["mark"], c["tail"], c["span"]) for c in covered[i].as_py()])
                texts = pa.array(values, texts.type)
            columns = [texts if i == text_at else c for i, c in enumerate(batch.columns) if i != covered_at]
            yield pa.record_batch([*columns, pa.array(removed)], names=[*names, "n_removed"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, ...) with the pieces removed that a repeated
    span covers, other than in the span's first place; all columns stay and
    n_removed (pieces) is added.

    Sentences are cut at closing marks (. ! ? ; : , and those of other scripts)
    and line ends, and where ten words have no such end, into pieces at words
    chosen by hash. Every run of three consecutive sentences, longer where those
    hold under ten words, and from every piece that begins no such run of up to
    36 words the run that holds twenty, is hashed over A-Z-lowered words and joined over all documents; in scripts
    without blanks two characters count as a word. So a passage of 48 words has a
    run that its copies have too, whatever its marks. The first place is the
    least (doc_id, 24 bits of the text's hash, piece), a null id being the hash of its text; places in one document
    count too.

    Before a run is taken out its words are hashed again: texts of one id and
    equal bits can't harm each other.
    A column n_removed of the input is replaced. A null text stays null; rows alike in doc_id and text are one document, all
    get its text; a text whose every piece is repeated becomes empty, its
    row stays; an empty table gives an empty table. Counts and first places
    are partial aggregates. The repeated spans are written, so that the join that
    finds other places has plain shuffles on both sides: Spark then splits the
    task of a span that is in a third of the rows.
    """
    text_batches(docs.sparkSession)
    docs = docs.drop("n_removed")
    document = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    places = docs.where("text is not null").select(document.alias("doc"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_spans, SPANS)
    repeated = places.groupBy("span").agg(F.count("*").alias("n"), F.min(F.struct("doc", F.shiftrightunsigned("tail", RUN_BITS).alias("bits"), "mark")).alias("first")).where("n > 1")
    repeated = materialize(repeated.select("span", "first"), "substring-spans")
    met = places.join(repeated.hint("merge"), "span").withColumn("bits", F.shiftrightunsigned("tail", RUN_BITS))
    low = F.lit((1 << 32) - 1)
    alike = F.col("mark").bitwiseAND(low) == F.col("first.mark").bitwiseAND(low)
    later = met.where(alike & ~((F.col("doc") == F.col("first.doc")) & (F.col("bits") == F.col("first.bits")) & (F.col("mark") == F.col("first.mark"))))
    covered = later.select(F.col("doc").alias("__lex_doc"), F.col("bits").alias("__lex_bits"), "mark", "tail", "span").groupBy("__lex_doc", "__lex_bits").agg(F.collect_set(F.struct("mark", "tail", "span")).alias("__lex_covered"))
    keyed = docs.withColumns({"__lex_of": document, "__lex_text": F.xxhash64("text").bitwiseAND(F.lit((1 << TEXT_BITS) - 1))})
    joined = keyed.join(covered, (F.col("__lex_of") == F.col("__lex_doc")) & (F.col("__lex_text") == F.col("__lex_bits")), "left")
    out = joined.select(*docs.columns, "__lex_covered")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return out.mapInArrow(_cleaned(docs.columns.index("text"), len(docs.columns), docs.columns), f"{schema}, n_removed long")
