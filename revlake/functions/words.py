"""The words of many texts at once, for tasks that read whole columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes to what they are in a word, 0 for what ends one. The first byte of a dotted capital I is an i, as its lower-case form begins with one.
IN_WORD = np.zeros(256, np.uint8)
IN_WORD[[*range(48, 58), *range(97, 123)]] = [*range(48, 58), *range(97, 123)]
IN_WORD[65:91] = np.arange(97, 123)
#: The first n of eight bytes.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


@dataclass
class Words:
    """Words [a-z0-9]+ of lower-case texts, in order: the text of each and its number among the different ones, which start and end in data."""

    row: np.ndarray
    number: np.ndarray
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def spelled(self) -> list[bytes]:
        """The different words, by number."""
        data = self.data.tobytes()
        return [data[a : a + n] for a, n in zip(self.start.tolist(), self.size.tolist())]


def words_of(texts: pa.Array) -> Words:
    """texts: strings without nulls."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    whole = raw.tobytes()
    if b"\xe2\x84\xaa" in whole:  # the sign of Kelvin is a k in lower case
        return words_of(pa.array([t.replace("\u212a", "k") for t in texts.to_pylist()], pa.large_string()))
    at = at - at[0]
    own = np.zeros(len(raw) + 8, np.uint8)
    own[: len(raw)] = IN_WORD[raw]
    if b"\xc4\xb0" in whole:
        own[np.flatnonzero((raw[:-1] == 0xC4) & (raw[1:] == 0xB0))] = ord("i")
    word = own[: len(raw)] != 0
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = at[(at > 0) & (at < len(raw))]
    begins[edge] |= word[edge]
    ends[edge - 1] |= word[edge - 1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    row = np.searchsorted(at[1:], start, "right")
    if not len(start):
        return Words(row, np.zeros(0, np.int64), own, start, size)
    eight = np.ndarray(len(raw) + 1, "<u8", own, strides=(1,))  # eight bytes from each place on
    head = eight[start] & FIRST[np.minimum(size, 8)]
    long = np.flatnonzero(size > 8)
    pieces = []  # of what words hold beyond eight bytes
    while len(long):
        step = 8 * (len(pieces) + 1)
        pieces.append((long, eight[start[long] + step] & FIRST[np.minimum(size[long] - step, 8)]))
        long = long[size[long] > step + 8]
    factor = np.uint64(0x9E3779B97F4A7C15)
    while True:  # words of eight bytes are their own keys, longer ones have hashes that are checked
        key = head.copy()
        for some, piece in pieces:
            mixed = (key[some] ^ (piece * factor)) * np.uint64(0xC2B2AE3D27D4EB4F)
            key[some] = mixed ^ (mixed >> np.uint64(29))
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        same = first[number]
        if (size == size[same]).all() and (head == head[same]).all() and all((piece == (eight[start[same[some]] + 8 * n] & FIRST[np.minimum(size[some] - 8 * n, 8)])).all() for n, (some, piece) in enumerate(pieces, 1)):
            return Words(row, number, own, start[first], size[first])
        factor += np.uint64(2)
