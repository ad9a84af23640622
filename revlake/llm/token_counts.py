"""Exact token counts of every prefix by dynamic programming, for byte-level byte-pair vocabularies (.json).

A text is cut into pretokens; within one, the last token and the count at each byte follow from the tokens that end
there (found by an automaton) and the pair test of ``bpe``. A text's stored counts are its pretokens' tables end to end.
The count of the whole text, of any prefix, and the longest prefix within a budget all come from these stored counts;
nothing is encoded again.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import NONE, Pairs
from .common import free_name, slices

#: The pattern of byte-level pretokens (fixed value).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BLANKS = regex.compile(r"\s{2,}")
#: Pretokens whose tables a Python worker remembers at most, in each of two turns.
MOST_PRETOKENS = 300_000
#: Characters of texts whose counts leave a Python worker together.
PIECE_CHARS = 1_000_000


def byte_letters() -> dict[str, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 as itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): chr(b) for b in plain} | {chr(256 + k): chr(b) for k, b in enumerate(rest)}


class Counter:
    """Works on pretokens whose UTF-8 bytes are written as Latin-1 letters."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = str.maketrans(byte_letters())
        vocab = {t.translate(letters): i for t, i in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ranks = {(a.translate(letters), b.translate(letters)): k for k, (a, b) in enumerate(merges)}
        self.pairs = Pairs({i: t for t, i in vocab.items()}, lambda a, b: ranks.get((a, b), NONE))
        self.ends = ahocorasick.Automaton()
        for t, i in vocab.items():
            if i in self.pairs.own:
                self.ends.add_word(t, (len(t), i))
        self.ends.make_automaton()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        #: by pretoken: the counts of its first 1, 2, ... characters, as 32-bit numbers
        self.tables: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def prefixes(self, pretoken: str) -> list[int]:
        """Token counts of the first 0, 1, ... bytes of a pretoken."""
        raw = pretoken.encode("utf-8", "surrogatepass").decode("latin-1")
        last, count = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        known, fits = self.pairs.known, self.pairs.fits
        for at, (size, token) in self.ends.iter(raw):
            start = at + 1 - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                good = known.get(before << 32 | token)
                if not (fits(before, token) if good is None else good):
                    continue
            last[at + 1] = token
            count[at + 1] = count[start] + 1
        return count

    def table(self, pretoken: str) -> bytes:
        known = self.tables.get(pretoken)
        if known is None and (known := self.before.get(pretoken)) is None:
            counts = self.prefixes(pretoken)[1:]
            if not pretoken.isascii():  # a character ends before a byte that continues none
                raw = pretoken.encode("utf-8", "surrogatepass")
                counts = [n for n, after in zip(counts, raw[1:] + b" ") if after & 0xC0 != 0x80]
            elif pretoken[0] == "'" and len(pretoken) > 2 and pretoken[1].isalpha():  # an unfinished contraction is a mark and letters
                counts = [*(int(self.plain(pretoken[:k])[-1]) for k in range(1, len(pretoken))), counts[-1]]
            known = array("i", counts).tobytes()
        if len(self.tables) > MOST_PRETOKENS:  # what is not asked for again is forgotten at the next turn
            self.before, self.tables = self.tables, {}
        self.tables[pretoken] = known
        return known

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """A text's stretches and the special strings between them (True)."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def plain(self, text: str) -> np.ndarray:
        """Counts of the first 1, 2, ... characters of a text without special strings."""
        found = PRETOKEN.findall(text)
        if not found:
            return np.zeros(0, np.int32)
        tables = list(map(self.tables.get, found))
        if None in tables:
            tables = [t or self.table(w) for t, w in zip(tables, found)]
        own = np.frombuffer(b"".join(tables), np.int32)
        size = np.fromiter(map(len, tables), np.int64, len(tables)) >> 2
        total = own[np.cumsum(size) - 1]
        counts = own + np.repeat(np.cumsum(total, dtype=np.int32) - total, size)
        for m in BLANKS.finditer(text):  # at its last blank, a run of blanks is one pretoken
            before = counts[m.start() - 1] if m.start() else 0
            counts[m.end() - 1] = before + np.frombuffer(self.table(m[0]), np.int32)[-1]
        return counts

    def stored(self, text: str | None) -> np.ndarray:
        """Token counts of the first 0, 1, ... characters of a text, each as if that prefix were the whole text."""
        out, base = [np.zeros(1, np.int32)], 0
        for part, special in self.parts(text or ""):
            if special:  # an unfinished special string is ordinary text
                out.append(np.array([*(base + self.plain(part[:k])[-1] for k in range(1, len(part))), base + 1], np.int32))
            else:
                out.append(self.plain(part) + np.int32(base))
            base = int(out[-1][-1]) if len(out[-1]) else base
        return np.concatenate(out)


@functools.lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def pieces(batches: Iterator[pd.Series]) -> Iterator[list[str | None]]:
    """The texts of batches in lists of bounded size."""
    for some in batches:
        texts = some.tolist()
        for a, b in slices(texts, PIECE_CHARS):
            yield texts[a:b]


def prefix_counts(df: DataFrame, path: str, text: str | Column = "text", out: str = "prefix_tokens") -> DataFrame:
    """Adds array<int>: element k (from 0) is the token count of the first k characters, as the library gives it.

    path: a byte-level .json vocabulary that every executor can read. Special strings inside a text count as one token
    each. Null and empty texts: [0]. A column of the same name is replaced; rows are independent, so repeated rows and
    ties need no rule; an empty table stays empty.
    """

    @F.pandas_udf("array<int>")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for texts in pieces(batches):
            yield pd.Series([own.stored(t) for t in texts], dtype=object)

    return df.withColumn(out, whole(F.col(text) if isinstance(text, str) else text))


def total(counts: str | Column = "prefix_tokens") -> Column:
    """Tokens of the whole text, from its stored counts (long)."""
    return F.element_at(F.col(counts) if isinstance(counts, str) else counts, -1).cast("long")


def over(budget: int, counts: str | Column = "prefix_tokens") -> Column:
    """Whether the whole text has more tokens than the budget, from its stored counts."""
    return total(counts) > budget


def truncate(df: DataFrame, budget: int, counts: str = "prefix_tokens", text: str = "text", out: str = "truncated") -> DataFrame:
    """Adds the longest prefix whose tokens fit the budget, from stored prefix counts alone; null text: null."""
    longest = F.array_max(F.transform(F.col(counts), lambda n, k: F.when(n <= budget, k).otherwise(0)))
    return df.withColumn(out, F.substring(F.col(text), F.lit(1), longest))


def fitting(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix whose tokens fit the budget (a longer prefix can have fewer tokens)."""
    fits = counts <= budget
    return len(counts) - 1 if fits[-1] else int(len(counts) - 1 - fits[::-1].argmax()) if fits.any() else 0


def answers(df: DataFrame, path: str, budgets: tuple[int, ...] = (), text: str | Column = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the tokens of the whole text (long) and, for each budget b, fits_b (long): the characters of its longest prefix within b.

    All come from the stored prefix counts, which are read where they are made: only the answers leave the Python worker.
    Columns of these names are replaced; odd rows as in prefix_counts (null and empty texts: zeros).
    """
    names = [out, *[f"fits_{b}" for b in budgets]]

    @F.pandas_udf(", ".join(f"`{n}` long" for n in names))
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for texts in pieces(batches):
            counts = map(own.stored, texts)
            yield pd.DataFrame([(c[-1], *[fitting(c, b) for b in budgets]) for c in counts], columns=names)

    held = free_name("answers", [*df.columns, *names])
    found = df.withColumn(held, answer(F.col(text) if isinstance(text, str) else text))
    return found.withColumns({n: F.col(held)[n] for n in names}).drop(held)


def count_tokens(df: DataFrame, path: str, text: str | Column = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the token count of whole texts (long): the last of the stored prefix counts. Odd rows as in prefix_counts."""
    return answers(df, path, (), text, out)
