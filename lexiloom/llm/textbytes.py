"""Vectorised tokenisation of Arrow text columns, over their UTF-8 bytes.

White space is ASCII (0x20, 0x09-0x0D) and never part of a multi-byte
character, so words can be found and hashed bytewise, without a Python object
for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
LONG_WORD = 1 << 12
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash of several hashes, dependent on their order."""
    out = mix(parts[0])
    for p in parts[1:]:
        out = mix(out * np.uint64(MULTIPLIER) + p)
    return out


def _power_table(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, 1 << 16), MULTIPLIER if kind == "up" else INVERSE, dtype=np.uint64)
        base[0] = 1
        have = _powers[kind] = np.multiply.accumulate(base)
    return have


def chunks(texts: pa.Array, most: int = 4_000_000, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes with A-Z lowered, row offsets) of runs of whole rows,
    each of about ``most`` bytes; a null is an empty text."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        piece = data[offsets[row] : offsets[end]]
        yield row, LOWER[piece] if lower else piece, offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word, or of every run of the bytes that
    ``word`` marks; none crosses rows."""
    word = ~IS_SPACE[data] if word is None else word
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] |= word[inner]
    before = inner[inner > 0] - 1
    last[before] |= word[before]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial taken as the difference
    of prefix sums, mixed with the length; very long words are hashed singly."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power_table("up", len(data) + 1), _power_table("down", len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    out = mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), 7)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    start, end, row = spans(data, offsets)
    return hashes(data, start, end), row


def ngrams(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``n`` words of a row."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    whole = row[:m] == row[n - 1 :]
    return combine(*(words[i : i + m][whole] for i in range(n))), row[:m][whole]


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow array of strings."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at])))


def terms_of_rows(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, row, count, start, end) of the distinct terms of each row, terms
    being runs of marked bytes; start and end are those of one occurrence."""
    start, end, row = spans(data, offsets, word)
    keys = hashes(data, start, end)
    _, first, count = np.unique(combine(keys, row.astype(np.uint64)), return_index=True, return_counts=True)
    return keys[first], row[first], count, start[first], end[first]


class Tally:
    """Sums by group and term that a task gathers over its batches, so that
    fewer rows leave it; given out by ``rows`` once ``full``."""

    def __init__(self, most: int = 1_500_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, data: np.ndarray, group: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray, *sums: np.ndarray) -> None:
        _, first, which = np.unique(combine(keys, group.astype(np.uint64)), return_index=True, return_inverse=True)
        added = [np.bincount(which, weights=x, minlength=len(first)).astype(np.int64) for x in sums]
        self.parts.append((group[first], keys[first], strings(data, start[first], end[first]), *added))
        self.size += len(first)

    @property
    def full(self) -> bool:
        return self.size >= self.most

    def rows(self, step: int = 100_000) -> Iterator[tuple[np.ndarray, pa.Array, list[np.ndarray]]]:
        """(group, term, sums) in slices; the tally is empty thereafter."""
        parts, self.parts, self.size = self.parts, [], 0
        if not parts:
            return
        group, keys = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        terms = pa.concat_arrays([p[2] for p in parts])
        _, first, which = np.unique(combine(keys, group.astype(np.uint64)), return_index=True, return_inverse=True)
        sums = [np.bincount(which, weights=np.concatenate([p[i] for p in parts]), minlength=len(first)).astype(np.int64) for i in range(3, len(parts[0]))]
        for at in range(0, len(first), step):
            part = first[at : at + step]
            yield group[part], terms.take(pa.array(part)).cast(pa.string()), [x[at : at + step] for x in sums]
