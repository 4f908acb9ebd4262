"""Token counts from compiled finite-state transducers.

Two deterministic transducers run one behind the other over a batch of texts.  Both are
run chunk by chunk in parallel: what a chunk does is a map of states, the maps are
composed by a prefix scan, and a last pass works each chunk from its right state.

* The splitter reads character classes and emits a mark where a word starts.  It has
  five states, so the map of a chunk is a table of five entries.
* The merger reads the UTF-8 bytes of words and emits, at each transition, by how much
  the byte changes the number of tokens.  Its state is what the rest of the word can
  depend on: the last tokens (see ``bpe``) and relative counts of the prefixes that some
  vocabulary entry can still reach back to.  Transitions are compiled when first met and
  kept in a table that all chunks look up together.  Behind a word's end the state is the
  first one again, so the map of a chunk with such an end is constant in its exit state
  and, behind the end, in its counts; both are found for all chunks at once.  The scan
  hands each chunk the exit of the one before, and what stands before a chunk's first end
  is then run from that state.  A chunk without an end (of a very long word) has a map of
  the states that may reach it; these maps are composed by doubling.

Tokens of a text are the sum of what its transitions emit.  Classes and case follow the
tables of the ``tokenizers`` library, which may know other characters than Python does.

Null and empty texts count no tokens.  Rows are kept as they come; only doc_id and
text are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merges
from .common import ids_and_texts, runs_of_rows

#: Classes of characters and states of the splitter.
SPACE, LETTER, NUMBER, OTHER, SUFFIX_2, SUFFIX_3 = range(6)
BETWEEN, IN_LETTERS, IN_OTHER, ONE_LEFT, TWO_LEFT = range(5)
#: State after each class; SUFFIX_n is an apostrophe that opens an English suffix of n characters.
AFTER = np.array(
    [
        [BETWEEN, IN_LETTERS, BETWEEN, IN_OTHER, ONE_LEFT, TWO_LEFT],
        [BETWEEN, IN_LETTERS, BETWEEN, IN_OTHER, ONE_LEFT, TWO_LEFT],
        [BETWEEN, IN_LETTERS, BETWEEN, IN_OTHER, IN_OTHER, IN_OTHER],
        [BETWEEN] * 6,
        [ONE_LEFT] * 6,
    ],
    np.uint8,
)
#: Does a word start at a character of this class, met in this state?
STARTS = np.array([[0, 1, 1, 1, 1, 1], [0, 0, 1, 1, 1, 1], [0, 1, 1, 0, 0, 0], [0] * 6, [0] * 6], bool)
CHUNK = 256
#: Bytes (whole chunks) after which transitions may be forgotten.
SECTION = CHUNK << 12
#: Symbol of bytes outside words; bytes that end a word are 256 more than their value.
OUTSIDE, ENDS = 512, 256
BEYOND_LATIN = re.compile("[^\\x00-\\u024f]")


def splitter_states(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The splitter's state before each character, starting between words."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.uint8)
    rows = -(-n // chunk)
    grid = np.zeros(rows * chunk, np.uint8)
    grid[:n] = classes
    grid = grid.reshape(rows, chunk).T.copy()
    maps = np.tile(np.arange(5, dtype=np.uint8), (rows, 1))
    for column in grid:
        maps = AFTER[maps, column[:, None]]
    step = 1
    while step < rows:  # after each round, maps[i] spans the 2*step chunks up to i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
        step *= 2
    state = np.concatenate([[np.uint8(BETWEEN)], maps[:-1, BETWEEN]])
    before = np.empty_like(grid)
    for i, column in enumerate(grid):
        before[i] = state
        state = AFTER[state, column]
    return before.T.reshape(-1)[:n]


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of each code point."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    # no letter, number or space is or will be in the planes left out (private ones and those without characters)
    codes = np.array([c for c in range(0x40000) if not 0xD800 <= c < 0xE000], np.uint32)
    every = codes.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        for _, (a, b) in Split(Regex(f"(?:{pattern})+"), "removed", invert=True).pre_tokenize_str(every):
            out[codes[a:b]] = kind
    return out


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    classes = character_classes()[codes]
    at = np.flatnonzero(codes == 0x27)
    if len(at):
        padded = np.concatenate([codes, [0, 0]])
        pair = padded[at + 1].astype(np.int64) << 32 | padded[at + 2]
        short = np.isin(padded[at + 1], [ord(c) for c in "stmd"])
        long = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        classes[at[short]] = SUFFIX_2
        classes[at[long]] = SUFFIX_3
    starts = STARTS[splitter_states(classes), classes]
    ends = np.flatnonzero(starts | (classes == SPACE))
    first = np.flatnonzero(starts)
    return first, np.append(ends, len(codes))[np.searchsorted(ends, first) + 1]


class Merger:
    """Transducer from a word's bytes to its number of tokens."""

    #: Transitions that are kept; beyond, all are compiled anew.
    MOST_TRANSITIONS = 400_000

    def __init__(self, strings: dict[tuple[int, ...], int], merges: Merges) -> None:
        self.adjacent = merges.adjacent
        self.below: list[dict[int, int]] = [{}]
        self.token, self.depth = [-1], [0]
        for symbols, token in strings.items():
            node = 0
            for s in symbols:
                if s not in self.below[node]:
                    self.below[node][s] = len(self.below)
                    self.below.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.below[node][s]
            self.token[node] = token
        # longest proper suffix that is a node, and the nearest one that is a whole entry
        self.link, self.entry = [0] * len(self.below), [0] * len(self.below)
        queue = [0]
        for node in queue:
            for s, child in self.below[node].items():
                if node:
                    self.link[child] = self.walk(self.link[node], s)
                link = self.link[child]
                self.entry[child] = link if self.token[link] >= 0 else self.entry[link]
                queue.append(child)
        self.forget()

    def walk(self, node: int, symbol: int) -> int:
        while symbol not in self.below[node]:
            if not node:
                raise ValueError("a byte is not in the vocabulary")
            node = self.link[node]
        return self.below[node][symbol]

    def forget(self) -> None:
        self.states: list[tuple] = [(0, (-1,), (0,))]  # automaton node, last tokens, counts relative to the newest
        self.number = {self.states[0]: 0}
        self.table(1 << 17)

    def table(self, slots: int) -> None:
        """An empty hash table of transitions with so many slots."""
        self.keys, self.next, self.more = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.used = 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free one where it belongs."""
        mask = len(self.keys) - 1
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & mask
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & mask
            there = self.keys[at[todo]]
            todo = todo[(there != keys[todo]) & (there >= 0)]
        return at

    def put(self, keys: np.ndarray, following: np.ndarray, more: np.ndarray) -> None:
        if 2 * (self.used + len(keys)) > len(self.keys):
            kept = self.keys >= 0
            old = self.keys[kept], self.next[kept], self.more[kept]
            self.table(2 * max(len(self.keys), 2 * len(keys)))
            self.put(*old)
        self.used += len(keys)
        while len(keys):  # of keys that want one slot the first gets it
            at, own = np.unique(self.slots(keys), return_index=True)
            self.keys[at], self.next[at], self.more[at] = keys[own], following[own], more[own]
            rest = np.delete(np.arange(len(keys)), own)
            keys, following, more = keys[rest], following[rest], more[rest]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states behind the symbols and the tokens these add; behind a word's end and outside words the first state."""
        keys = np.where(symbols == OUTSIDE, OUTSIDE, states.astype(np.int64) << 10 | symbols)
        at = self.slots(keys)
        if (missing := self.keys[at] < 0).any():
            new = np.unique(keys[missing])
            arcs = [(0, 0) if k == OUTSIDE else self.compile(k >> 10, k & 1023) for k in new.tolist()]
            ended = (new & 1023) >= ENDS
            self.put(new, np.where(ended, 0, [a for a, _ in arcs]), np.array([m for _, m in arcs]))
            at = self.slots(keys)
        return self.next[at], self.more[at]

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The state behind ``symbol`` and the tokens it adds."""
        node, last, counts = self.states[state]
        node = self.walk(node, symbol)
        match = node if self.token[node] >= 0 else self.entry[node]
        while match:
            before = last[-self.depth[match]]
            if before < 0 or self.adjacent(before, self.token[match]):
                break
            match = self.entry[match]
        emitted = counts[-self.depth[match]] + 1
        keep = self.depth[node] + 1
        return self.numbered((node, (*last, self.token[match])[-keep:], (*(c - emitted for c in counts), 0)[-keep:])), emitted

    def numbered(self, state: tuple) -> int:
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
        return number

    def entrances(self, grid: np.ndarray, heads: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The states in which the chunks of ``grid``, one a column, are entered.

        Those marked in ``heads`` are entered in their one of ``states``, each other one where the
        chunk before it is left.  The others are run from the first state, all side by side, and
        then from each exit of the chunk before that they do not know yet.  So a chunk's map has
        every state that may reach it, and these are few, as what stood long before is forgotten.
        Maps are composed by doubling: of all entrances those stay that a head leads to.
        """
        m = len(heads)
        at, state = np.arange(m), np.where(heads, states, 0)
        goes_on = np.append(~heads[1:], False)
        known, after = np.zeros(0, np.int64), np.zeros(0, np.int64)  # chunk << 32 | state
        while len(at):
            exits = state
            for symbols in grid[:, at]:
                exits = self.step(exits, symbols)[0].astype(np.int64)
            own = at << 32 | state
            follows = np.where(goes_on[at], at + 1 << 32 | exits, own)
            known, after = np.append(known, own), np.append(after, follows)
            new = np.setdiff1d(follows, known)
            at, state = new >> 32, new & 0xFFFFFFFF
        order = np.argsort(known)
        known = known[order]
        jump = np.searchsorted(known, after[order])
        reached = np.zeros(len(known), bool)
        reached[np.searchsorted(known, np.flatnonzero(heads) << 32 | states[heads])] = True
        for _ in range(m.bit_length()):  # after each round, twice as many chunks behind a head
            reached[jump[reached]] = True
            jump = jump[jump]
        return known[reached] & 0xFFFFFFFF

    def counts(self, symbols: np.ndarray, chunk: int = CHUNK, section: int = SECTION) -> np.ndarray:
        """The tokens that each symbol adds, from the first state on.

        Sections (whole chunks) are worked one behind the other, so that a long word does not
        keep all transitions it ever met.
        """
        added, state = [np.zeros(0, np.int32)], self.states[0]
        for at in range(0, len(symbols), section):
            if self.used > self.MOST_TRANSITIONS:
                self.forget()
            own, last = self.section_counts(symbols[at : at + section], self.numbered(state), chunk)
            added.append(own)
            state = self.states[last]
        return np.concatenate(added)

    def section_counts(self, symbols: np.ndarray, start: int, chunk: int) -> tuple[np.ndarray, int]:
        """The tokens that each symbol adds, from the state ``start`` on, and the state behind the last chunk."""
        n = len(symbols)
        rows = -(-n // chunk)
        grid = np.full(rows * chunk, OUTSIDE, np.int16)
        grid[:n] = symbols
        grid = grid.reshape(rows, chunk).T.copy()
        added = np.zeros(grid.shape, np.int32)
        ends = grid >= ENDS
        closed, first = ends.any(0), ends.argmax(0)
        exits = np.zeros(rows, np.int64)
        for i in range(1, chunk):  # behind the first end of each chunk
            own = np.flatnonzero(closed & (first < i))
            exits[own], added[i, own] = self.step(exits[own], grid[i, own])
        enter = np.append(start, exits[:-1]).astype(np.int64)
        whole = np.flatnonzero(~closed)
        if len(whole):
            enter[whole] = self.entrances(grid[:, whole], np.append(True, np.diff(whole) > 1), enter[whole])
            state = enter[whole]
            for i in range(chunk):
                state, added[i, whole] = self.step(state, grid[i, whole])
            exits[whole] = state
            enter[1:] = exits[:-1]
        for i in range(int(first.max(initial=-1, where=closed)) + 1):  # up to it
            own = np.flatnonzero(closed & (first >= i))
            enter[own], added[i, own] = self.step(enter[own], grid[i, own])
        return added.T.reshape(-1)[:n], int(exits[-1])


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Counter:
    """Counts tokens of lower-cased texts for a vocabulary with word ends."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.normalizer = Tokenizer.from_file(path).normalizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        code = {c: b for b, c in enumerate(byte_characters())}
        rank, parts, pairs = [-1] * (max(vocab.values()) + 1), {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if whole in parts:
                raise ValueError("a token has two merges")
            rank[whole], parts[whole], pairs[left << 32 | right] = r, (left, right), r

        def symbols(token: str) -> tuple[int, ...]:
            body = token.removesuffix(end) if token != end else token
            out = [code[c] for c in body]
            return (*out[:-1], out[-1] + 256 * (len(body) < len(token)))

        strings = {symbols(t): i for t, i in vocab.items() if i in parts or len(t.removesuffix(end)) == 1}
        self.merger = Merger(strings, Merges(rank, parts, lambda a, b: pairs.get(a << 32 | b)))
        self.special = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]

    def plain(self, text: str) -> tuple[str, int]:
        """The normalised text with special tokens cut out, and how many these were."""
        n = 0
        if any(s in text for s in self.special):
            for s in self.special:
                n += text.count(s)
                text = text.replace(s, "\n")
        if text.isascii():
            return text.lower(), n
        if not BEYOND_LATIN.search(text):  # no letter there changes with its neighbours, and all tables agree
            return unicodedata.normalize("NFC", text).lower(), n
        return self.normalizer.normalize_str(text), n

    def counts(self, texts: list[str]) -> list[int]:
        plain = [self.plain(t) for t in texts]
        whole = "\n".join(t for t, _ in plain)
        first, end = word_spans(whole)
        data = np.frombuffer(whole.encode(), np.uint8)
        places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each character
        step = np.zeros(len(data) + 1, np.int8)
        np.add.at(step, places[first], 1)
        np.add.at(step, places[end], -1)
        symbols = np.where(np.cumsum(step[:-1]) > 0, data.astype(np.int16), OUTSIDE)
        symbols[places[end] - 1] += ENDS
        sums = np.concatenate([[0], np.cumsum(self.merger.counts(symbols))])
        bounds = places[np.concatenate([[0], np.cumsum([len(t) + 1 for t, _ in plain])[:-1], [len(whole)]])]
        return (np.diff(sums[bounds]) + np.array([n for _, n in plain], np.int64)).tolist()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in runs_of_rows(batches, most=1_000_000):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(c.counts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
