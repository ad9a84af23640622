"""Substring dedup by fixed-block anchors.

Every window of 13 words holds a whole block of its document's fixed grid of 7-word blocks. So the grid blocks are
the index, every rolling 7-word window is a probe, and a hit is extended to the 13-word windows around it, which are
compared by their own hashes; adjoining windows that repeat make up a maximal exact repeat.

Documents are dealt into segments of bounded size. A segment sends each distinct hash once to the hash's bucket, so a
passage that many documents share costs a bucket one entry a segment; the answers come back as bits, and then as the
smallest document of each repeated window. All is one plan, in which the documents are shuffled once.
"""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text of a segment, and of a bucket's share (about a word in six bytes): what one task holds at once.
SEGMENT_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Segment:
    """The words of some documents, in the order of their ids: byte ranges, document and hashes, in two lanes."""

    def __init__(self, docs: pd.DataFrame):
        docs = docs.sort_values("id", kind="stable", na_position="last")
        self.ids = docs["id"].to_numpy()
        self.null = docs["null"].to_numpy(bool)
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in docs["body"]]
        self.buffer = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        blank = (self.buffer == 32) | ((self.buffer >= 9) & (self.buffer <= 13))
        edge = np.diff(np.concatenate([[True], blank]).view(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(np.cumsum(size), self.start, side="right")
        self.count = np.bincount(self.doc, minlength=len(raw))
        self.place = np.arange(len(self.start)) - (np.cumsum(self.count) - self.count)[self.doc]

    def words(self, lane: int) -> np.ndarray:
        letters = np.random.default_rng(1000 + lane).integers(1, 2**63, 256, U)
        base = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[lane]
        n = len(self.buffer)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(letters[self.buffer] * powers(base, n))])
        back = powers(pow(base, -1, 1 << 64), n)
        return mixed((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(U))

    def windows(self, width: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of width words, and which lie in one document; both as long as the words."""
        w = self.words(lane)
        out, inside = np.zeros(len(w), U), np.zeros(len(w), bool)
        n = len(w) - width + 1
        if n > 0:
            for k in range(width):
                out[:n] = out[:n] * U(0xD6E8FEB86659FD93) + w[k : k + n]
            inside[:n] = self.doc[:n] == self.doc[width - 1 :]
        return mixed(out), inside


def distinct(h: np.ndarray, doc: np.ndarray, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes with the smallest or largest document; documents ascend."""
    if largest:
        u, first = np.unique(h[::-1], return_index=True)
        return u, doc[::-1][first]
    u, first = np.unique(h, return_index=True)
    return u, doc[first]


def by_bucket(h: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that groups distinct hashes by bucket and, so that they pack well, by document; where each bucket starts in it."""
    bucket = ((h >> U(32)) % U(buckets)).astype(np.int64)
    order = np.lexsort((doc, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def least(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of at: is it in h, and the smallest doc there."""
    order = np.lexsort((doc, h))
    u, first = np.unique(h[order], return_index=True)
    if not len(u):
        return np.zeros(len(at), bool), np.zeros(len(at), np.int64)
    k = np.minimum(np.searchsorted(u, at), len(u) - 1)
    return u[k] == at, doc[order][first][k]


def entries(seg: Segment, width: int, buckets: int):
    """A segment's index and probe entries, by bucket: (hashes, documents, order, starts) each."""
    block = (width + 1) // 2
    h, inside = seg.windows(block)
    grid = inside & (seg.place % block == 0)
    index, probe = distinct(h[grid], seg.doc[grid], False), distinct(h[inside], seg.doc[inside], True)
    return h, inside, grid, (*index, *by_bucket(*index, buckets)), (*probe, *by_bucket(*probe, buckets))


def extended(hit: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that hold a hit block."""
    block = (width + 1) // 2
    out = hit.copy()
    for k in range(1, width - block + 1):
        out[:-k] |= hit[k:]
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 13, segment_bytes: int = SEGMENT_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, n_words, n_removed, repeats, kept): each document without the words that repeat an earlier document.

    A run of so many words that also starts in a document of a smaller key is removed, wherever such runs overlap as
    one; all runs are judged on the input. repeats: the removed stretches as array<(start, end)> of word positions,
    end exclusive; kept: the words left, joined by one space. Null texts have no words. Null keys count as the
    largest. Rows of equal keys do not remove from each other. An empty table gives no rows. Hashes that decide have
    96 bits; the anchors' 32 bits within a bucket only choose what is compared.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("id"), F.col(key).isNull().alias("null"), F.col(text).alias("body"))
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    segments, buckets = max(1, -(-total // segment_bytes)), max(1, -(-total // bucket_bytes))
    rows = rows.withColumn("seg", F.pmod(F.xxhash64("id", "body"), F.lit(segments)).cast("int"))

    def send(some: pd.DataFrame) -> pd.DataFrame:
        seg = Segment(some)
        _, _, _, (ih, idoc, io, ib), (ph, pdoc, po, pb) = entries(seg, words, buckets)
        out = []
        for b in range(buckets):
            i, p = io[ib[b] : ib[b + 1]], po[pb[b] : pb[b + 1]]
            if len(p):
                docs, local = np.unique(np.concatenate([idoc[i], pdoc[p]]), return_inverse=True)
                out.append((b, some["seg"].iloc[0], seg.ids[docs].astype(np.int64).tobytes(), ih[i].astype(np.uint32).tobytes(), ph[p].astype(np.uint32).tobytes(), local.astype(np.uint32 if len(docs) >= 1 << 16 else np.uint16).tobytes()))
        return pd.DataFrame(out, columns=["bucket", "seg", "docs", "ih", "ph", "local"])

    def meet(some: pd.DataFrame) -> pd.DataFrame:
        parts, read = [], lambda x, kind: np.frombuffer(x, kind)
        for r in some.itertuples():
            docs, ih, ph = read(r.docs, np.int64), read(r.ih, np.uint32), read(r.ph, np.uint32)
            doc = docs[read(r.local, np.uint32 if len(docs) >= 1 << 16 else np.uint16)]
            parts.append((r.seg, ih, doc[: len(ih)], ph, doc[len(ih) :]))
        ih, idoc, ph, pdoc = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
        there, first = least(ih, idoc, ph)
        ahead = there & (first < pdoc)
        there, last = least(ph, -pdoc - 1, ih)  # the largest document, as the smallest complement
        behind = there & (-last - 1 > idoc)
        out, i, p = [], 0, 0
        for seg, own_i, _, own_p, _ in parts:
            bits = np.packbits(np.concatenate([behind[i : i + len(own_i)], ahead[p : p + len(own_p)]])).tobytes()
            out.append((seg, some["bucket"].iloc[0], bits))
            i, p = i + len(own_i), p + len(own_p)
        return pd.DataFrame(out, columns=["seg", "bucket", "bits"])

    def extend(some: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"bucket": [], "seg": [], "docs": [], "a": [], "b": [], "low": [], "high": []})
        if not len(some):
            return none
        seg = Segment(some)
        h, inside, grid, (ih, _, io, ib), (ph, _, po, pb) = entries(seg, words, buckets)
        ihit, phit = np.zeros(len(ih), bool), np.zeros(len(ph), bool)
        for r in answers.itertuples():
            i, p = io[ib[r.bucket] : ib[r.bucket + 1]], po[pb[r.bucket] : pb[r.bucket + 1]]
            bits = np.unpackbits(np.frombuffer(r.bits, np.uint8), count=len(i) + len(p)).view(bool)
            ihit[i], phit[p] = bits[: len(i)], bits[len(i) :]
        hit = np.zeros(len(h), bool)
        hit[inside] = np.isin(h[inside], ph[phit])
        hit[grid] |= np.isin(h[grid], ih[ihit])
        a, whole = seg.windows(words)
        at = np.flatnonzero(extended(hit, words) & whole)
        if not len(at):
            return none
        b = (seg.windows(words, 1)[0][at] >> U(32)).astype(np.uint32)
        a, doc = a[at], seg.doc[at]
        order = np.lexsort((doc, b, a))
        a, b, doc = a[order], b[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        last = np.concatenate([new[1:], [len(a)]]) - 1
        a, b, low, high = a[new], b[new], doc[new], doc[last]
        order, starts = by_bucket(a, low, buckets)
        out = []
        for k in range(buckets):
            o = order[starts[k] : starts[k + 1]]
            if len(o):
                docs, local = np.unique(np.concatenate([low[o], high[o]]), return_inverse=True)
                local = local.astype(np.uint32)
                out.append((k, some["seg"].iloc[0], seg.ids[docs].astype(np.int64).tobytes(), a[o].tobytes(), b[o].tobytes(), local[: len(o)].tobytes(), local[len(o) :].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "seg", "docs", "a", "b", "low", "high"])

    def first_of(some: pd.DataFrame) -> pd.DataFrame:
        parts, read = [], lambda x, kind: np.frombuffer(x, kind)
        for r in some.itertuples():
            docs = read(r.docs, np.int64)
            parts.append((r.seg, read(r.a, U), read(r.b, np.uint32), docs[read(r.low, np.uint32)], docs[read(r.high, np.uint32)]))
        a, b, low, high = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
        order = np.lexsort((low, b, a))
        new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
        least_of = np.empty(len(a), np.int64)
        least_of[order] = low[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        told, out, at = least_of < high, [], 0
        for seg, own, *_ in parts:
            k = np.flatnonzero(told[at : at + len(own)]) + at
            at += len(own)
            if len(k):
                out.append((seg, a[k].tobytes(), b[k].tobytes(), least_of[k].tobytes()))
        return pd.DataFrame(out, columns=["seg", "a", "b", "least"])

    def strip(some: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(some):
            return pd.DataFrame({"id": [], "null": [], "n_words": [], "n_removed": [], "starts": [], "ends": [], "kept": []})
        seg = Segment(some)
        gone = np.zeros(len(seg.start) + 1, np.int64)
        if len(answers):
            a, b, first = (np.concatenate([np.frombuffer(x, kind) for x in answers[c]]) for c, kind in (("a", U), ("b", np.uint32), ("least", np.int64)))
            order = np.lexsort((b, a))
            a, b, first = a[order], b[order], first[order]
            h, whole = seg.windows(words)
            near = np.flatnonzero(whole & np.isin(h, a))
            lane = (seg.windows(words, 1)[0][near] >> U(32)).astype(np.uint32)
            k, live = np.searchsorted(a, h[near]), np.ones(len(near), bool)
            while live.any():  # equal first lanes are told apart by the second
                inside = live & (k < len(a))
                same = np.zeros(len(near), bool)
                same[inside] = a[k[inside]] == h[near][inside]
                fits = same.copy()
                fits[same] = b[k[same]] == lane[same]
                hit = near[fits][first[k[fits]] < seg.ids[seg.doc[near[fits]]]]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + words, -1)
                live = same & ~fits
                k = k + live
        gone = np.cumsum(gone[:-1]) > 0
        out_start, bounds = [], np.concatenate([[0], np.cumsum(seg.count)])
        for d in range(len(seg.ids)):
            a, b = bounds[d], bounds[d + 1]
            cut = gone[a:b]
            edge = np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))
            if a == b or cut.all():
                kept = ""
            else:
                s, e = seg.start[a:b][~cut], seg.end[a:b][~cut]
                part = seg.buffer[s[0] : e[-1] + 1].copy()
                part[e - s[0]] = 32
                mark = np.zeros(len(part) + 1, np.int8)
                mark[s - s[0]] = 1
                mark[e + 1 - s[0]] -= 1  # the blank after a word goes with it; the next word may start right there
                kept = part[np.cumsum(mark[:-1]) > 0][:-1].tobytes().decode("utf-8", "surrogatepass")
            out_start.append((seg.ids[d], seg.null[d], b - a, int(cut.sum()), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), kept))
        return pd.DataFrame(out_start, columns=["id", "null", "n_words", "n_removed", "starts", "ends", "kept"])

    sent = rows.groupBy("seg").applyInPandas(send, "bucket int, seg int, docs binary, ih binary, ph binary, local binary")
    bits = sent.groupBy("bucket").applyInPandas(meet, "seg int, bucket int, bits binary")
    wide = rows.groupBy("seg").cogroup(bits.groupBy("seg")).applyInPandas(extend, "bucket int, seg int, docs binary, a binary, b binary, low binary, high binary")
    found = wide.groupBy("bucket").applyInPandas(first_of, "seg int, a binary, b binary, least binary")
    done = rows.groupBy("seg").cogroup(found.groupBy("seg")).applyInPandas(strip, "id long, null boolean, n_words long, n_removed long, starts array<long>, ends array<long>, kept string")
    return done.select(F.when(~F.col("null"), F.col("id")).alias(key), "n_words", "n_removed", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("repeats"), "kept")
