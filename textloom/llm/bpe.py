"""Merge-ordered token vocabularies and the prefix table that encodes with them.

In greedy merge order (best merge first, leftmost on ties) every prefix of a text
has one encoding, and the encodings of all prefixes form a tree: the encoding of a
prefix is that of a shorter prefix plus one last token.  ``last[i]`` - the last
token of the prefix of length ``i`` - is therefore enough to recover the encoding
backwards.  A vocabulary entry that ends at ``i`` is that last token exactly if it
may stand behind the last token of the prefix it leaves, and whether two tokens may
stand side by side depends on these two alone.
"""

from __future__ import annotations

import ahocorasick

NEVER = 1 << 60


class Merges:
    """Tokens with their merge order.

    rank: order in which a token's merge applies, -1 for the symbols texts start as.
    parts: for merged tokens, the two tokens that the last merge joins.
    joined: rank of the merge of a pair of tokens, where there is one.
    """

    def __init__(self, rank: list[int], parts: dict[int, tuple[int, int]], joined) -> None:
        self.rank, self.parts, self.joined = rank, parts, joined
        self.known: dict[int, bool] = {}

    def adjacent(self, left: int, right: int) -> bool:
        """May ``right`` directly follow ``left`` in an encoding?"""
        key = left << 32 | right
        fits = self.known.get(key)
        if fits is None:
            if len(self.known) > 500_000:
                self.known.clear()
            fits = self.known[key] = self._apart(left, right)
        return fits

    def _apart(self, left: int, right: int) -> bool:
        # Undo merges at the boundary, latest first. Each state of the boundary lasted
        # until the merge undone before it, so a merge across it must not come sooner.
        rank, parts, joined, until = self.rank, self.parts, self.joined, NEVER
        while True:
            across = joined(left, right)
            if across is not None and across < until:
                return False
            if rank[left] > rank[right]:
                until, left = rank[left], parts[left][1]
            elif rank[right] >= 0:
                until, right = rank[right] + 1, parts[right][0]  # on a tie the boundary, further left, is first
            else:
                return True


def greedy(symbols: list[int], pair_rank, pair_token) -> tuple[list[int], tuple[int, int] | None]:
    """Plain merging, best rank first and leftmost on ties: the tokens and the pair merged last."""
    tokens, merged = list(symbols), None
    while len(tokens) > 1:
        best = min(((r, i) for i in range(len(tokens) - 1) if (r := pair_rank(tokens[i], tokens[i + 1])) is not None), default=None)
        if best is None:
            break
        i = best[1]
        merged = (tokens[i], tokens[i + 1])
        tokens[i : i + 2] = [pair_token(*merged)]
    return tokens, merged


class PrefixTable:
    """Encoder over an automaton of the vocabulary's strings."""

    def __init__(self, strings: dict[str, int], merges: Merges) -> None:
        self.merges = merges
        self.size = {token: len(text) for text, token in strings.items()}
        self.automaton = ahocorasick.Automaton()
        for text, token in strings.items():
            self.automaton.add_word(text, (token, len(text)))
        if strings:
            self.automaton.make_automaton()

    def encode(self, text: str) -> list[int]:
        """Tokens of ``text``, whose every character must be in the vocabulary."""
        last = [-1] * (len(text) + 1)
        adjacent, known = self.merges.adjacent, self.merges.known
        for at, (token, n) in self.automaton.iter(text):
            at += 1
            if last[at] < 0:  # of the entries that end here, longest first, the first that fits
                if n == at:
                    last[at] = token
                else:
                    before = last[at - n]
                    fits = known.get(before << 32 | token)
                    if adjacent(before, token) if fits is None else fits:
                        last[at] = token
        out, end, size = [], len(text), self.size
        while end:
            token = last[end]
            if token < 0:
                raise ValueError("a character is not in the vocabulary")
            out.append(token)
            end -= size[token]
        out.reverse()
        return out
