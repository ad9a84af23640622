"""When may two tokens of a byte-pair encoding stand side by side?

Merging is local: a token sequence is the encoding of its text exactly if every adjacent pair is the encoding of
the pair's own text. So the last token of each prefix is decided by the tokens that end there and one pair test.
"""

from __future__ import annotations

from collections.abc import Callable

NONE = 1 << 60


def merged(symbols: list[str], rank: Callable[[str, str], int]) -> list[str]:
    """The encoding of a short symbol sequence by its definition: join the best-ranked pair, leftmost first."""
    while len(symbols) > 1:
        ranks = [rank(a, b) for a, b in zip(symbols, symbols[1:])]
        best = min(ranks)
        if best == NONE:
            break
        k = ranks.index(best)
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
    return symbols


class Pairs:
    """Pair tests for the tokens of one vocabulary, remembered by (left, right) in one integer."""

    def __init__(self, tokens: dict[int, str], rank: Callable[[str, str], int]):
        self.tokens, self.rank, self.known = tokens, rank, {}
        #: tokens that their own text gives; others are never part of an encoding
        self.own = {i for i, t in tokens.items() if len(merged(list(t), rank)) == 1}

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) > 1_000_000:  # forgotten and found again: memory stays bounded
                self.known.clear()
            a, b = self.tokens[left], self.tokens[right]
            known = self.known[key] = merged(list(a + b), self.rank) == [a, b]
        return known
