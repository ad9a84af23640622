"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word is read as the mean of its character-trigram vectors beside a vector of its own (for words that the training
sample holds often). The network reads overlapping windows of words in both directions, pools their states by
attention, and gives each window a logit; a document's score is the calibrated logit of its highest window.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, slices

WINDOW, STRIDE = 32, 24
#: Trigram buckets, width of a vector, units of a direction, width of the attention.
BUCKETS, WIDE, UNITS, ATTEND = 1 << 14, 12, 8, 8
#: Labelled documents that the model is fitted on at most, and words of them together; words with a vector of their own.
SAMPLE_DOCS, SAMPLE_WORDS, KNOWN_WORDS = 4000, 8_000_000, 20_000
#: Words that a Python worker remembers at most, and windows that it scores at once.
MOST_WORDS, NEW_WORDS, BATCH = 400_000, 20_000, 2048
EDGES = ".,;:!?\"'()[]{}<>*#%&$-_"


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summed(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The rows added up by index."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.diff(index, prepend=-1))
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[index[first]] = np.add.reduceat(rows[order], first)
    return out


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every character trigram of the words (with marks at both ends), and where each word's begin."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = "".join(f"\x02{w.strip(EDGES) or w}\x03" for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.flatnonzero(code == 2)
    end = np.append(first[1:], len(code))
    keep = np.ones(len(code), bool)
    keep[end - 1] = keep[np.maximum(end - 2, first)] = False
    keep[first] = True  # a word of one character keeps one trigram
    wide = np.concatenate([code, np.zeros(2, np.uint64)])
    mix = (wide[:-2] * np.uint64(0x9E3779B97F4A7C15) + wide[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + wide[2:]
    bucket = ((mix * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(BUCKETS)
    return bucket[keep].astype(np.int64), (np.cumsum(keep) - 1)[first]


class Network:
    def __init__(self, known: dict[str, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
        self.known, self.prior, self.scale = known, 0.1, (1.0, 0.0)
        self.p = {"char": draw(BUCKETS, WIDE), "word": draw(len(known) + 1, WIDE, s=0.1), "bias": np.zeros(6 * UNITS, np.float32)}
        self.p |= {"input": draw(2 * WIDE, 6 * UNITS), "left": draw(UNITS, 3 * UNITS), "right": draw(UNITS, 3 * UNITS)}
        self.p |= {"attend": draw(2 * UNITS, ATTEND), "query": draw(ATTEND), "out": draw(2 * UNITS), "base": np.zeros(1, np.float32)}

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its trigrams' buckets (where they start, how many), and its own row, 0 if unknown."""
        bucket, start = trigrams(words)
        row = np.fromiter((self.known.get(w.strip(EDGES), 0) for w in words), np.int64, len(words))
        return bucket, start, np.diff(np.append(start, len(bucket))), row

    def features(self, bucket: np.ndarray, start: np.ndarray, count: np.ndarray, row: np.ndarray) -> np.ndarray:
        if not len(row):
            return np.zeros((0, 2 * WIDE), np.float32)
        char = np.add.reduceat(self.p["char"][bucket], start) / count[:, None].astype(np.float32)
        return np.hstack([char, self.p["word"][row]]).astype(np.float32)

    def inputs(self, bucket: np.ndarray, start: np.ndarray, count: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The six gates' input of each word; it does not depend on the word's place."""
        out = np.empty((len(row), 6 * UNITS), np.float32)
        for a in range(0, len(row), BATCH):  # the features of all words at once would take more than their gates
            part = slice(a, a + BATCH)
            end = start[a + BATCH] if a + BATCH < len(start) else len(bucket)
            out[part] = self.features(bucket[start[a] : end], start[part] - start[a], count[part], row[part]) @ self.p["input"] + self.p["bias"]
        return out

    def run(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool):
        """Both directions at once: the states (steps, windows, 2 units), and what the gradients need of each step."""
        n, steps, kept = UNITS, ids.shape[1], []
        side, left, right = np.stack([self.p["left"], self.p["right"]]), gates[:, : 3 * n], gates[:, 3 * n :]
        h, states = np.zeros((2, len(ids), n), np.float32), np.zeros((steps, len(ids), 2 * n), np.float32)
        for t in range(steps):
            s = steps - 1 - t
            g, m, u = np.stack([left[ids[:, t]], right[ids[:, s]]]), np.stack([mask[:, t], mask[:, s]])[:, :, None], h @ side
            zr = 1 / (1 + np.exp(-(g[..., : 2 * n] + u[..., : 2 * n])))
            z, r = zr[..., :n], zr[..., n:]
            c = np.tanh(g[..., 2 * n :] + r * u[..., 2 * n :])
            if keep:
                kept.append((h, z, r, c, u[..., 2 * n :], m))
            h = h + m * (1 - z) * (c - h)
            states[t, :, :n], states[s, :, n:] = h
        return states, kept

    def logits(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        states, kept = self.run(gates, ids, mask, keep)
        seen = np.tanh(states @ self.p["attend"])
        weight = np.where(mask.T > 0, seen @ self.p["query"], -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return pooled @ self.p["out"] + self.p["base"], (kept, states, seen, weight, pooled)

    def gradients(self, read: tuple, ids: np.ndarray, mask: np.ndarray, target: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        (bucket, _, count, row), x = read, self.features(*read)
        gates, p = x @ self.p["input"] + self.p["bias"], self.p
        logit, (kept, states, seen, weight, pooled) = self.logits(gates, ids, mask, True)
        d = ((sigmoid(logit) - target) * importance / importance.sum()).astype(np.float32)
        out = {"out": pooled.T @ d, "base": d.sum(keepdims=True)}
        dpool = d[:, None] * p["out"]
        dweight = np.einsum("tbh,bh->tb", states, dpool)
        dscore = weight * (dweight - (weight * dweight).sum(0))
        out["query"] = np.einsum("tb,tbk->k", dscore, seen)
        dseen = dscore[:, :, None] * p["query"] * (1 - seen**2)
        out["attend"] = np.einsum("tbh,tbk->hk", states, dseen)
        dstates = weight[:, :, None] * dpool + dseen @ p["attend"].T
        dgates = np.zeros((*ids.T.shape, 6 * UNITS), np.float32)
        side, n, dh = np.stack([p["left"], p["right"]]), UNITS, np.zeros((2, len(ids), UNITS), np.float32)
        dside = np.zeros_like(side)
        for t in reversed(range(len(kept))):
            (h, z, r, c, u, m), s = kept[t], len(kept) - 1 - t
            dh = dh + np.stack([dstates[t, :, :n], dstates[s, :, n:]])
            new = dh * m
            dc = new * (1 - z) * (1 - c**2)
            dz, dr = new * (h - c) * z * (1 - z), dc * u * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], axis=2)
            dside += h.swapaxes(1, 2) @ du
            dgates[t, :, : 3 * n], dgates[s, :, 3 * n :] = np.concatenate([dz, dr, dc], axis=2)
            dh = dh - new * (1 - z) + du @ side.swapaxes(1, 2)
        out["left"], out["right"] = dside
        dgates = summed(ids.T.ravel(), dgates.reshape(-1, 6 * UNITS), len(gates))
        out["bias"], out["input"] = dgates.sum(0), x.T @ dgates
        dx = dgates @ p["input"].T
        out["char"] = summed(bucket, np.repeat((dx[:, :WIDE] / count[:, None]).astype(np.float32), count, axis=0), BUCKETS)
        out["word"] = summed(row, dx[:, WIDE:], len(p["word"]))
        return out


class Windows:
    """All windows of documents of so many words laid end to end; a window is its first position and its document."""

    def __init__(self, counts: np.ndarray):
        per = np.where(counts > 0, np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE)), 0)
        self.doc = np.repeat(np.arange(len(counts)), per)
        begin = np.cumsum(counts) - counts
        turn = np.arange(len(self.doc)) - np.repeat(np.cumsum(per) - per, per)
        self.begin, self.end = begin[self.doc] + turn * STRIDE, (begin + counts)[self.doc]
        self.last = max(0, int(counts.sum()) - 1)

    def read(self, k) -> tuple[np.ndarray, np.ndarray]:
        """Of some windows: positions (windows, WINDOW) and which of them are in the document."""
        at = self.begin[k][:, None] + np.arange(WINDOW)
        return np.minimum(at, self.last), (at < self.end[k][:, None]).astype(np.float32)


def fit(docs: list[np.ndarray], vocabulary: list[str], toxic: np.ndarray, seed: int = 7, rounds: int | None = None) -> Network:
    """Trains on whole documents, given as the numbers of their words: each round takes a toxic document's highest windows, and the highest and some random ones of others."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate([*docs, np.zeros(0, np.int32)])
    seen: Counter = Counter()
    for w, n in zip(vocabulary, np.bincount(flat, minlength=len(vocabulary)).tolist()):
        seen[w.strip(EDGES)] += n
    known = {w: k + 1 for k, (w, n) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:KNOWN_WORDS]) if n >= 4 and w}
    del seen
    net = Network(known, seed)
    net.prior = float(np.clip(toxic.mean() if len(toxic) else 0.1, 0.001, 0.5))
    bucket, start, count, row = everything = net.read(vocabulary)
    windows = Windows(np.array([len(ws) for ws in docs], np.int64))
    doc = windows.doc
    if not len(doc) or toxic.min() == toxic.max():
        return net
    held = np.arange(len(docs)) % 5 == 4  # for the calibration
    held &= toxic[held].sum() >= 20
    rounds = rounds or int(np.clip(16 * SAMPLE_DOCS / len(docs), 16, 100))  # small samples are read more often
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def score_all() -> np.ndarray:
        gates, out = net.inputs(*everything), np.empty(len(doc), np.float32)
        for k in range(0, len(doc), BATCH):
            at, mask = windows.read(slice(k, k + BATCH))
            out[k : k + BATCH] = net.logits(gates, flat[at], mask)[0]
        return out

    first = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(np.append(first, len(doc)))
    for turn in range(rounds):
        if turn % 2 == 0:
            score = score_all() if turn else rng.random(len(doc))
        order = np.lexsort((-score, doc))
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc)) - np.repeat(first, size)
        # early rounds read widely; later ones only the windows that decide
        most = np.where(toxic[doc] == 1, 6 if turn < rounds // 4 else 2, 3)
        chosen = np.flatnonzero(((place < most) | (rng.random(len(doc)) < np.where(toxic[doc] == 1, 0.0, 0.03))) & ~held[doc])
        chosen = rng.permutation(chosen)
        balance = float((toxic[doc[chosen]] == 0).sum()) / max(1, (toxic[doc[chosen]] == 1).sum())
        rate = 0.02 * (1 - turn / rounds) + 0.001
        for k in range(0, len(chosen), 256):
            c = chosen[k : k + 256]
            at, mask = windows.read(c)
            used, local = np.unique(flat[at], return_inverse=True)
            y = toxic[doc[c]].astype(np.float32)
            many = count[used]
            place = np.cumsum(many) - many
            own = bucket[np.arange(many.sum()) + np.repeat(start[used] - place, many)]
            got = net.gradients((own, place, many, row[used]), local.reshape(len(c), WINDOW), mask, y, np.where(y == 1, np.sqrt(balance), 1).astype(np.float32))
            step += 1
            for name, g in got.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    best = np.full(len(docs), -10.0)
    np.maximum.at(best, doc, score_all())
    at_hand = held if held.any() else np.ones(len(docs), bool)
    x, y, (a, b) = np.clip(best[at_hand], -30, 30), toxic[at_hand], (0.5, 0.0)
    y = np.where(y == 1, 1 - 0.5 / max(2, y.sum()), 0.5 / max(2, (1 - y).sum()))
    for _ in range(60):  # logistic calibration by Newton steps, held near the uncalibrated line
        q = sigmoid(a * x + b)
        w = q * (1 - q)
        g = np.array([((q - y) * x).sum() + 0.1 * (a - 0.5), (q - y).sum() + 0.01 * b])
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -0.3, 0.3), b - np.clip(move[1], -1, 1)
    net.scale = (max(float(a), 0.05), float(b))
    return net


def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k, y, body) to one row a document: its words as numbers of the batch's own list of words, which is on its first row."""
    for some in batches:
        numbers: dict[str, int] = {}
        ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in tokens(t)), np.int32).tobytes() for t in some["body"]]
        words = pd.Series([None] * len(some), dtype=object)
        if len(some):
            words[0] = list(numbers)
        yield pd.DataFrame({"k": some["k"].to_numpy(), "y": some["y"].to_numpy(), "part": str(uuid.uuid4()), "ids": ids, "words": words})


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> Network:
    """Fits on at most sample labelled documents of at most so many words together, never on keys whose crc32 (as text) leaves 1 modulo 3.

    The sample is the first by a hash of the key, whole documents only: one that would exceed the words is left out
    and the next ones are tried. Texts become numbers of words in the tasks, so the driver holds four bytes a word and
    each word once. Null keys, and labels other than 0 and 1, are left out; of a key labelled twice the higher label
    holds; rows of one key are read apart. Without labelled documents the score is constant.
    """
    return fit(*sampled(docs, labels, key, text, label, sample, words))


def sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int, words: int) -> tuple[list[np.ndarray], list[str], np.ndarray]:
    """The sample that learn describes, as fit takes it; what led to it is gone when fit begins."""
    usable = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)").filter(~held_out(F.col("k")))
    chosen = usable.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    # at most sample rows of two numbers: a bounded broadcast
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("body")).join(F.broadcast(chosen), "k")
    rows = rows.withColumn("size", F.coalesce(F.regexp_count("body", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("h", F.xxhash64("body"))
    order = ["o", "k", "h"]
    narrow = rows.select(F.xxhash64("k").alias("o"), "k", "h", "size").filter(F.col("size") <= words).orderBy(*order).limit(sample).collect()  # sample rows of four numbers
    taken, room = [], words
    for r in narrow:
        if r["size"] <= room:
            taken.append((r["k"], r["h"]))
            room -= r["size"]
    kept = docs.sparkSession.createDataFrame(taken, "k long, h long").distinct()
    told = rows.join(F.broadcast(kept), ["k", "h"]).select("k", "y", "body").repartition(8).mapInPandas(numbered, "k long, y int, part string, ids binary, words array<string>").toPandas()
    numbers: dict[str, int] = {}
    maps = {p: np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int32) for p, ws in zip(told["part"], told["words"]) if ws is not None}
    texts = [maps[p][np.frombuffer(x, np.int32)] if x else np.zeros(0, np.int32) for p, x in zip(told["part"], told["ids"])]
    # which task numbers a text first is of no consequence: documents and words are put in an order of their own
    names = list(numbers)
    place = np.empty(len(names), np.int32)
    place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names), dtype=np.int32)
    y = told["y"].to_numpy(np.int64)
    order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(str(told["k"][i]).encode()), told["k"][i], len(texts[i])))
    return [place[texts[i]] for i in order], sorted(names), y[order]


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Scorer:
    def __init__(self, net: Network):
        self.net, self.forget = net, MOST_WORDS
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        if not hasattr(self, "gates"):  # room for what is remembered; memory is taken as it is filled, and never copied
            self.gates = np.empty((self.forget + MOST_WORDS, 6 * UNITS), np.float32)

    def learn(self, new: list[str]) -> None:
        """Remembers words that were not known."""
        for a in range(0, len(new), NEW_WORDS):
            some, at = new[a : a + NEW_WORDS], len(self.row)
            if at + len(some) > len(self.gates):  # one slice of over MOST_WORDS new words
                self.gates = np.concatenate([self.gates, np.empty_like(self.gates)])
            self.gates[at : at + len(some)] = self.net.inputs(*self.net.read(some))
            self.row.update(zip(some, range(at, at + len(some))))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.net.prior)
        for a, b in slices(texts, 1_000_000):
            cut = [tokens(t) for t in texts[a:b]]
            if len(self.row) > self.forget:
                self.clear()
            new = list(dict.fromkeys(w for ws in cut for w in ws if w not in self.row))
            self.learn(new)
            get = self.row.__getitem__
            flat = np.fromiter((i for ws in cut for i in map(get, ws)), np.int64)
            windows, best = Windows(np.array([len(ws) for ws in cut], np.int64)), np.full(b - a, -np.inf)
            for k in range(0, len(windows.doc), BATCH):
                at, mask = windows.read(slice(k, k + BATCH))
                logit = self.net.logits(self.gates, flat[at], mask)[0]
                np.maximum.at(best, windows.doc[k : k + BATCH], logit)
            some = np.isfinite(best)
            slope, base = self.net.scale
            out[a:b][some] = sigmoid(slope * np.clip(best[some], -30, 30) + base)
        return out


def score(docs: DataFrame, net: Network, text: str | Column = "text", out: str = "toxicity") -> DataFrame:
    """Adds the score of whole texts (0 to 1), over all their overlapping windows.

    The model has a fixed size (SAMPLE_DOCS, BUCKETS, KNOWN_WORDS), so it is sent to every task. Null and wordless
    texts get the share of toxic documents in the sample. Equal texts get equal scores; other columns are never read.
    An empty table stays empty.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(net)
        for texts in batches:
            yield pd.Series(own.scores(texts.tolist()))

    return docs.withColumn(out, scored(F.col(text) if isinstance(text, str) else text))
