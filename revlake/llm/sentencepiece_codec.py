"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is cut where no piece can reach across (before a run of word marks, around characters that no piece
holds), its distinct chunks are put one after another, and the positions of that text are sorted by the 16
characters (the longest piece) that follow them. Binary search finds every piece's range of occurrences in the
sorted positions; the occurrences are edges, which are sorted by their end and relaxed from left to right. The
model's pieces carry merge ranks, not log-probabilities, so an edge is kept by the pair test of ``bpe`` instead of
by a sum: it gives the library's own result, one last piece for each prefix.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import NONE, Pairs
from .common import slices

MARK = "▁"
#: Chunks a Python worker remembers at most; beyond it they are forgotten and encoded anew.
MOST_CHUNKS = 450_000
#: Characters of distinct chunks that are indexed at once; their edges take about 500 bytes a character.
INDEX_CHARS = 200_000
#: Characters of texts whose ids leave a Python worker together.
PIECE_CHARS = 2_000_000


def sortable(codes: np.ndarray) -> list[np.ndarray]:
    """For each position, four integers that order it as the 16 codes (below 2**15) from there on."""
    wide = np.concatenate([codes.astype(np.int64), np.zeros(16, np.int64)])
    quad = wide[:-3] << 45 | wide[1:-2] << 30 | wide[2:-1] << 15 | wide[3:]
    return [quad[k : k + len(codes)] for k in (0, 4, 8, 12)]


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        usual = {i: sp.id_to_piece(i) for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        order = {i: r for r, i in enumerate(sorted(usual, key=lambda i: (-sp.get_score(i), i)))}
        ranks = {usual[i]: order[i] for i in usual}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = sorted({c for t in usual.values() for c in t})
        # a character that occurs in pieces but is none itself stands alone for the pair test and then becomes bytes
        loose = [c for c in self.chars if c not in ranks]
        self.spelt = {size + k: [self.bytes[b] for b in c.encode()] for k, c in enumerate(loose)}
        tokens = usual | {size + k: c for k, c in enumerate(loose)}
        self.pairs = Pairs(tokens, lambda a, b: ranks.get(a + b, NONE))
        self.none = size + len(loose)  # stands for a character that no piece holds, and for a chunk's start
        self.longest = max(map(len, tokens.values()))
        if self.longest > 16 or len(self.chars) >= 1 << 15 or any(MARK in t.lstrip(MARK) for t in tokens.values()):
            raise ValueError("the model's pieces are longer than 16 characters or hold inner word marks")
        table = np.zeros(0x110000, np.int32)
        table[[ord(c) for c in self.chars]] = np.arange(1, len(self.chars) + 1)
        self.code = table
        self.piece = np.array(sorted(self.pairs.own), np.int64)
        self.length = np.array([len(tokens[i]) for i in self.piece])
        spelt = np.zeros((len(self.piece), 16), np.int64)
        for row, i in enumerate(self.piece):
            spelt[row, : len(tokens[i])] = table[[ord(c) for c in tokens[i]]]
        self.spelling = spelt
        self.lengths = {i: len(t) for i, t in tokens.items()} | {self.none: 1}
        self.show = [b""] * (self.none + 1)
        for i, t in tokens.items():
            self.show[i] = t.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.show[i] = bytes([b])
        apart = "\n" if table[10] == 0 else ""  # the commonest character that no piece holds
        self.cutter = re.compile(f"{MARK}*[^{MARK}{apart}]+|{MARK}+" + ("|\n" if apart else ""))
        self.cache: dict[str, bytes] = {}
        self.asked, self.answer = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of pieces in the text, as (start, row of the piece)."""
        keys = sortable(codes)
        suffixes = np.lexsort(keys[::-1])
        low, high = self.spelling, np.where(np.arange(16) < self.length[:, None], self.spelling, (1 << 15) - 1)
        bounds = []
        for spelt, side in ((low, False), (high, True)):
            want = [spelt[:, k] << 45 | spelt[:, k + 1] << 30 | spelt[:, k + 2] << 15 | spelt[:, k + 3] for k in (0, 4, 8, 12)]
            lo, hi = np.zeros(len(spelt), np.int64), np.full(len(spelt), len(codes), np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                at = suffixes[np.minimum(mid, len(codes) - 1)]
                less, same = np.zeros(len(spelt), bool), np.ones(len(spelt), bool)
                for key, w in zip(keys, want):
                    less |= same & (key[at] < w)
                    same &= key[at] == w
                right = open_ & (less | (same & side))
                lo = np.where(right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            bounds.append(lo)
        count = bounds[1] - bounds[0]
        row = np.repeat(np.arange(len(count)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[0], count)
        return suffixes[place], row

    def spans(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All edges of a text as (start, end, piece), end being the last position; characters that stand alone among them."""
        start, row = self.edges(codes)
        end, piece = start + self.length[row] - 1, self.piece[row]
        single = np.flatnonzero((codes == 0) | np.isin(codes, [self.code[ord(self.pairs.tokens[i])] for i in self.spelt]))
        if len(single):
            alone = {int(self.code[ord(self.pairs.tokens[i])]): i for i in self.spelt} | {0: self.none}
            start, end = np.concatenate([start, single]), np.concatenate([end, single])
            piece = np.concatenate([piece, np.array([alone[int(c)] for c in codes[single]], np.int64)])
        return start, end, piece

    def fit(self, key: np.ndarray) -> np.ndarray:
        """The pair test of (left << 32 | right) for many pairs; the last answer of each place of a table is remembered."""
        at = (key * np.int64(-7046029254386353131) >> 44) & (len(self.asked) - 1)
        good = self.answer[at]
        miss = np.flatnonzero(self.asked[at] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            fits = self.pairs.fits
            good[miss] = np.fromiter((k >> 32 == self.none or k & 0xFFFFFFFF == self.none or fits(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()), bool, len(new))[back]
            self.asked[at[miss]], self.answer[at[miss]] = key[miss], good[miss]
        return good

    def settle(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, step: np.ndarray, at_start: np.ndarray, ends: np.ndarray) -> None:
        """Relaxes edges in the order of step; ends is the piece of the encoding that ends at a position, by position."""
        order = np.argsort(step, kind="stable")
        start, end, piece, step = start[order], end[order], piece[order], step[order]
        levels = np.flatnonzero(np.diff(step, prepend=-1))
        for a, b in zip(levels, [*levels[1:], len(step)]):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = np.where(at_start[s], self.none, ends[s - 1])
            live = before >= 0
            ok = np.flatnonzero(live)[self.fit(before[live] << 32 | p[live])]
            ends[e[ok]] = p[ok]

    def ids(self, text: str, begin: int, end: int, last_ids: list[int]) -> bytes:
        """The ids of text[begin:end], read back from the pieces that end at its positions."""
        ids, at, lengths = [], end - 1, self.lengths
        while at >= begin:
            i = last_ids[at]
            if i == self.none:
                ids += [self.bytes[x] for x in reversed(text[at].encode("utf-8", "surrogatepass"))]
            elif i in self.spelt:
                ids += reversed(self.spelt[i])
            else:
                ids.append(i)
            at -= lengths[i]
        return np.array(ids[::-1], np.int32).tobytes()

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def relax(self, chunks: list[str]) -> None:
        """Encodes distinct chunks into the cache, as bytes of 32-bit ids."""
        text = "".join(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(chunks)), sizes)
        start, end, piece = self.spans(self.codes(text))
        inside = owner[start] == owner[end]
        start, end, piece = start[inside], end[inside], piece[inside]
        at_start, ends = np.zeros(len(text) + 1, bool), np.full(len(text), -1, np.int64)
        at_start[begin] = True
        self.settle(start, end, piece, end - begin[owner[end]], at_start, ends)
        last_ids = ends.tolist()
        for chunk, b, n in zip(chunks, begin.tolist(), sizes.tolist()):
            self.cache[chunk] = self.ids(text, b, b + n, last_ids)

    def relax_long(self, chunk: str) -> bytes:
        """One chunk of any length, indexed a stretch at a time: an edge reaches back 16 characters at most."""
        at_start, ends = np.zeros(len(chunk) + 1, bool), np.full(len(chunk), -1, np.int64)
        at_start[0] = True
        for at in range(0, len(chunk), INDEX_CHARS):
            base = max(0, at - 15)
            start, end, piece = self.spans(self.codes(chunk[base : at + INDEX_CHARS]))
            new = end + base >= at
            start, end, piece = start[new] + base, end[new] + base, piece[new]
            self.settle(start, end, piece, end, at_start, ends)
        return self.ids(chunk, 0, len(chunk), ends.tolist())

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for a, b in slices(texts, 1_000_000):
            cut = [self.cutter.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[a:b]]
            if len(self.cache) > MOST_CHUNKS:
                self.cache.clear()
            new = list(dict.fromkeys(c for chunks in cut for c in chunks if c not in self.cache and len(c) <= INDEX_CHARS))
            sums = np.cumsum([len(c) for c in new])
            for some in np.split(np.arange(len(new)), np.flatnonzero(np.diff(sums // INDEX_CHARS)) + 1) if new else ():
                self.relax([new[k] for k in some])
            get = self.cache.get  # long chunks are not remembered
            for chunks in cut:
                yield b"".join([x if (x := get(c)) is not None else self.relax_long(c) for c in chunks])

    def decode(self, ids: bytes | np.ndarray) -> str:
        ids = np.frombuffer(ids, np.int32) if isinstance(ids, bytes) else ids
        show = self.show
        return b"".join([show[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


def pieces(batches: Iterator[pd.Series]) -> Iterator[list[str | None]]:
    """The texts of batches in lists of bounded size, so that results leave the worker before the next are made."""
    for some in batches:
        texts = some.tolist()
        for a, b in slices(texts, PIECE_CHARS):
            yield texts[a:b]


@functools.lru_cache(maxsize=1)
def model(path: str) -> Model:
    return Model(path)


def encode(df: DataFrame, path: str, text: str | Column = "text", out: str = "ids", packed: bool = False) -> DataFrame:
    """Adds the SentencePiece ids of whole texts, as the library gives them without begin or end ids.

    path: a .model file of merge-ranked pieces that every executor can read (installed with the package). Null and
    empty texts give no ids. packed: little-endian 32-bit ids in one binary instead of an integer array. A column of
    the same name is replaced; rows are independent, so repeated rows and ties need no rule. An empty table stays so.
    """
    kind = "binary" if packed else "array<int>"

    @F.pandas_udf(kind)
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model(path)
        for texts in pieces(batches):
            got = own.encode(texts)
            yield pd.Series(list(got) if packed else [np.frombuffer(x, np.int32) for x in got], dtype=object)

    return df.withColumn(out, ids(F.col(text) if isinstance(text, str) else text))


def decode(df: DataFrame, path: str, ids: str | Column = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of ids (an array or packed); null gives null, no ids an empty text.

    Inverse of encode but for the word mark U+2581, which comes back as a space, as in the library.
    """


    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model(path)
        for some in batches:
            yield pd.Series([None if x is None else own.decode(x) for x in some], dtype=object)

    return df.withColumn(out, text(F.col(ids) if isinstance(ids, str) else ids))


def round_trip(df: DataFrame, path: str, text: str | Column = "text") -> DataFrame:
    """Adds packed ids and the decoded text of them in one pass, so that a task holds one model."""

    @F.pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = model(path)
        for texts in pieces(batches):
            ids = list(own.encode(texts))
            yield pd.DataFrame({"ids": ids, "decoded": [own.decode(x) for x in ids]})

    coded = df.withColumn("coded_", both(F.col(text) if isinstance(text, str) else text))
    return coded.withColumns({"ids": F.col("coded_.ids"), "decoded": F.col("coded_.decoded")}).drop("coded_")
