"""Postings as bytes: differences in as few bytes as they need, so that blocks stay small where they are shuffled, stored and sent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Fields of a chunk, bits of the lower part of a chunk id, bits of a field's number of words beyond which it is told apart.
N_FIELDS, LOW, FEW = 4, 30, 15


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of values from 0 on, seven bits each from the lowest on, all but a value's last with the top bit; and how many each has."""
    rest = values.astype(np.uint64)
    size = np.ones(len(rest), np.int64)
    more = rest >> np.uint64(7)
    while more.any():
        size += more > 0
        more >>= np.uint64(7)
    start = np.cumsum(size) - size
    out = np.zeros(size.sum(), np.uint8)
    k = 0
    while len(rest):
        goes_on = size > k + 1
        out[start + k] = (rest & np.uint64(127)).astype(np.uint8) | (goes_on.astype(np.uint8) << 7)
        if k == 0:
            sizes = size
        start, rest, size, k = start[goes_on], rest[goes_on] >> np.uint64(7), size[goes_on], k + 1
    return out, sizes if k else size


def numbers(data: np.ndarray) -> np.ndarray:
    """The values of varints."""
    end = np.flatnonzero(data < 128)
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    size = end - start + 1
    out = (data[start] & 127).astype(np.int64)
    some, k = np.flatnonzero(size > 1), 1
    while len(some):
        out[some] |= (data[start[some] + k] & 127).astype(np.int64) << (7 * k)
        k += 1
        some = some[size[some] > k]
    return out


def signed(values: np.ndarray) -> np.ndarray:
    """Values of either sign as values from 0 on, small ones as small ones."""
    return (values << 1) ^ (values >> 63)


def unsigned(values: np.ndarray) -> np.ndarray:
    return (values >> 1) ^ -(values & 1)


def sums_from(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums, beginning anew at each of first, of which the first is 0."""
    total = np.cumsum(values)
    return total - np.repeat((total - values)[first], np.diff(np.r_[first, len(values)])) if len(values) else total


def ranks(block: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The turn of each row in its block, of n rows."""
    return np.arange(len(block)) - (np.cumsum(n) - n)[block]


def mixed(counts: np.ndarray) -> np.ndarray:
    """The numbers of words in each field as one, bit by bit, so that it is small where they are."""
    out, k = np.zeros(len(counts), np.int64), 0
    while k < FEW and (counts >> k).any():
        for f in range(N_FIELDS):
            out |= ((counts[:, f] >> k) & 1) << (N_FIELDS * k + N_FIELDS - 1 - f)
        k += 1
    return out


def unmixed(values: np.ndarray) -> np.ndarray:
    out, k = np.zeros((len(values), N_FIELDS), np.int64), 0
    while (values >> (N_FIELDS * k)).any():
        for f in range(N_FIELDS):
            out[:, f] |= ((values >> (N_FIELDS * k + N_FIELDS - 1 - f)) & 1) << k
        k += 1
    return out


@dataclass
class Postings:
    """Blocks of postings: how many each block has; chunk and words by field of a posting; and where these words stand, field by field."""

    n: np.ndarray
    chunk: np.ndarray
    counts: np.ndarray
    place: np.ndarray | None = None

    @property
    def tf(self) -> np.ndarray:
        return self.counts.sum(axis=1)

    def fields(self) -> np.ndarray:
        """The field of every word."""
        return np.repeat(np.tile(np.arange(N_FIELDS), len(self.chunk)), self.counts.ravel())

    def weights(self, by_field: np.ndarray) -> np.ndarray:
        """The summed weights of each posting's words."""
        out, tf = np.zeros(len(self.chunk)), self.tf
        held = tf > 0
        if held.any():
            out[held] = np.add.reduceat(by_field[self.fields()], (np.cumsum(tf) - tf)[held])
        return out

    def taken(self, at: np.ndarray, n: np.ndarray) -> Postings:
        """Some postings in another order and in blocks of n."""
        place, tf = None, self.tf
        if self.place is not None:
            own = tf[at]
            place = self.place[np.arange(own.sum()) + np.repeat((np.cumsum(tf) - tf)[at] - (np.cumsum(own) - own), own)]
        return Postings(n, self.chunk[at], self.counts[at], place)

    def positions(self) -> np.ndarray:
        """Where words stand, with the field above the lower 32 bits."""
        return (self.fields() << 32) + self.place

    def packed(self) -> tuple[pa.Array, pa.Array]:
        """A block's postings and places as two binary values."""
        total, head = len(self.chunk), np.cumsum(self.n) - self.n
        turn = np.arange(total) - np.repeat(head, self.n)
        high, low = self.chunk >> LOW, self.chunk & ((1 << LOW) - 1)
        further = np.r_[high[:1], np.diff(high)]
        further[head] = high[head]
        new = further != 0
        new[head] = True
        nearer = np.where(new, low, np.r_[low[:1], np.diff(low)])
        far, many = further != 0, (self.counts >> FEW).any(axis=1)
        block = np.repeat(np.arange(len(self.n)), self.n)
        fars, manies = (np.bincount(block[x], minlength=len(self.n)) for x in (far, many))
        size = 1 + 2 * self.n + fars + N_FIELDS * manies
        start = np.cumsum(size) - size
        out = np.zeros(size.sum(), np.int64)
        out[start] = fars + N_FIELDS * manies
        base, step = start[block] + 1 + turn, self.n[block]
        out[base] = (signed(nearer) << 1) | far
        out[base + step] = np.where(many, 1, mixed(self.counts) << 1)
        beyond = start + 1 + 2 * self.n
        out[beyond[block[far]] + ranks(block[far], fars)] = signed(further[far])
        at = (beyond + fars)[block[many]] + N_FIELDS * ranks(block[many], manies)
        out[at[:, None] + np.arange(N_FIELDS)] = self.counts[many]
        postings = binary(*varints(out), size)
        if self.place is None:
            return postings, pa.nulls(len(self.n), pa.binary())
        counts = self.counts.ravel()
        first = (np.cumsum(counts) - counts)[counts > 0]
        gaps = np.r_[self.place[:1], np.diff(self.place)]
        gaps[first] = self.place[first]
        tf = self.tf
        return postings, binary(*varints(gaps), np.add.reduceat(tf, head) if len(head) else tf)


def binary(data: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> pa.Array:
    """Bytes of values as one binary for every n values."""
    ends = np.r_[0, np.cumsum(sizes)][np.cumsum(n)] if len(n) else n
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data)])


def bytes_of(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column, one after another."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[[column.offset, column.offset + len(column)]] if len(column) else (0, 0)
    return np.frombuffer(data, np.uint8)[at[0] : at[1]] if at[1] > at[0] else np.zeros(0, np.uint8)


def unpacked(n: np.ndarray, postings: np.ndarray, places: np.ndarray | None = None) -> Postings:
    """Blocks of n postings each, of their bytes; without places these are left out."""
    n = n.astype(np.int64)
    total, head = n.sum(), (np.cumsum(n) - n)[n > 0]
    value = numbers(postings)
    start, at = [], 0
    for many in n.tolist():
        start.append(at)
        at += 1 + 2 * many + int(value[at])
    start, block = np.array(start, np.int64), np.repeat(np.arange(len(n)), n)
    base, step = start[block] + 1 + np.arange(total) - (np.cumsum(n) - n)[block], n[block]
    told, words = value[base], value[base + step]
    far, many = (told & 1).astype(bool), (words & 1).astype(bool)
    fars, manies = (np.bincount(block[x], minlength=len(n)) for x in (far, many))
    beyond = start + 1 + 2 * n
    further, nearer = np.zeros(total, np.int64), unsigned(told >> 1)
    further[far] = unsigned(value[beyond[block[far]] + ranks(block[far], fars)])
    new = far.copy()
    new[head] = True
    chunk = (sums_from(further, head) << LOW) + sums_from(nearer, np.flatnonzero(new))
    counts = unmixed(words >> 1)
    at = (beyond + fars)[block[many]] + N_FIELDS * ranks(block[many], manies)
    counts[many] = value[at[:, None] + np.arange(N_FIELDS)]
    if places is None:
        return Postings(n, chunk, counts)
    flat = counts.ravel()
    return Postings(n, chunk, counts, sums_from(numbers(places), (np.cumsum(flat) - flat)[flat > 0]))


def xxhash64(values: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 of a long is."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = np.uint64(42) + five + np.uint64(8)
        h = h ^ (turned(values.astype(np.int64).view(np.uint64) * two, 31) * one)
        h = turned(h, 27) * one + four
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
    return (h ^ (h >> np.uint64(32))).view(np.int64)
