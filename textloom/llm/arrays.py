"""Words and word shingles of a batch of texts as numpy arrays."""

from __future__ import annotations

import numpy as np

from .rolling import RangeHashes, mix

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Batch:
    """Texts (UTF-8) behind one another, each followed by a space.

    begin: where each text starts, and one entry behind the last.
    first, last: where each word starts and ends; text: the number of its text.
    per_text: words of each text.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        inside = np.concatenate([[False], ~_SPACE[self.data]])
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        self.first, self.last = turn[::2], turn[1::2]
        self.text = np.searchsorted(self.begin, self.first, side="right") - 1
        self.per_text = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.ranges = RangeHashes(self.data)
        self.words = self.ranges.of(self.first, self.last)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words and the text of each; a text with 1 to n-1 words has one, of all its words."""
        count = len(self.words) - n + 1
        whole = np.flatnonzero(self.text[: max(count, 0)] == self.text[n - 1 :]) if count > 0 else np.zeros(0, np.int64)
        sums = np.zeros(len(whole), np.uint64)
        for k in range(n):
            sums = sums * _ODD + self.words[whole + k]
        short = np.flatnonzero((self.per_text > 0) & (self.per_text < n))
        if not len(short):
            return mix(sums), self.text[whole]
        start = np.concatenate([[0], np.cumsum(self.per_text)])
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = self.per_text[short] > k
            extra[has] = extra[has] * _ODD + self.words[start[short[has]] + k]
        extra += self.per_text[short].astype(np.uint64) << np.uint64(56)
        both, of = np.concatenate([sums, extra]), np.concatenate([self.text[whole], short])
        order = np.argsort(of, kind="stable")
        return mix(both)[order], of[order]


def shingles_of_texts(texts: list[bytes], n: int, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """``Batch(texts).shingles(n)``; the words of texts of over ``most`` bytes are hashed in parts."""
    if sum(map(len, texts)) <= 2 * most:
        return Batch(texts).shingles(n)
    hashes, of = [], []
    for i, text in enumerate(texts):
        words, at = [], 0
        while at < len(text):
            to = at + most
            while to < len(text) and not _SPACE[text[to]]:
                to += 1
            words.append(Batch([text[at:to]]).words)
            at = to
        batch = Batch.__new__(Batch)
        batch.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        batch.text, batch.per_text = np.zeros(len(batch.words), np.int64), np.array([len(batch.words)])
        found, _ = batch.shingles(n)
        hashes.append(found)
        of.append(np.full(len(found), i))
    return np.concatenate(hashes), np.concatenate(of)
