"""Token counts of a byte-level BPE vocabulary by compiled finite-state transducers.

Two deterministic transducers stand for the tokenizer.

* The splitter reads character classes and marks where pre-tokens begin. Its states are few, so a run of characters is a
  map from entry state to exit state. Texts are cut into chunks, all chunk maps are built at once, and a parallel prefix
  scan composes them into the entry state of every chunk.
* The counter reads the bytes of a pre-token. Each transition carries the change of the number of tokens emitted so far.
  A state knows, for every position where a later token can still begin, the last token of the text up to there: by the
  pair test below the tokens of the longer text follow from that. Its states are compiled when first met.

The pair test: a sequence of tokens is the encoding of its text exactly if each neighbouring pair is the encoding of its
own text. It holds for merges learned in the order in which they are listed.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import importable, slices

CHUNK = 128
MAX_STATES = 400_000

# The pre-token pattern of the vocabulary is
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
RESET, BLANK, SPACE, QUOTE, DIGIT, OTHER, LETTER, SINGLE, R, V, E, L = range(12)
START, WORD, NUMBER, MARKS, BLANKS, SPACES, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(10)
HERE, BEFORE = 1, 2


def character_classes() -> np.ndarray:
    """Class of every code point; the place behind the last one is the end of a text."""
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110001, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE)):
        for found in regex.finditer(pattern, everything):
            points = np.array([ord(c) for c in found[0]])
            table[points] = kind
    for characters, kind in ((" ", BLANK), ("'", QUOTE), ("stmd", SINGLE), ("r", R), ("v", V), ("e", E), ("l", L)):
        for c in characters:
            table[ord(c)] = kind
    table[0x110000] = RESET
    return table


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks of the splitter, both at state * 12 + class."""
    move, mark = np.zeros((10, 12), np.uint8), np.zeros((10, 12), np.uint8)
    runs = {BLANK: BLANKS, SPACE: SPACES, DIGIT: NUMBER, OTHER: MARKS, QUOTE: QUOTED} | dict.fromkeys(range(LETTER, L + 1), WORD)
    for state in range(10):
        for kind, run in runs.items():
            move[state, kind], mark[state, kind] = run, HERE
        mark[state, RESET] = HERE
    move[WORD, LETTER:], mark[WORD, LETTER:] = WORD, 0
    move[NUMBER, DIGIT], mark[NUMBER, DIGIT] = NUMBER, 0
    for kind in (OTHER, QUOTE):
        move[MARKS, kind], mark[MARKS, kind] = MARKS, 0
        move[QUOTED, kind], mark[QUOTED, kind] = MARKS, 0
    for state in (BLANKS, SPACES):
        mark[state, BLANK] = mark[state, SPACE] = 0
    # a blank before anything but white space belongs to what follows; other white space stands alone
    mark[BLANKS, DIGIT:] = mark[BLANKS, QUOTE] = BEFORE
    move[BLANKS, QUOTE] = MARKS
    mark[SPACES, DIGIT:] = mark[SPACES, QUOTE] = HERE | BEFORE
    # a quote that begins a pre-token may begin a contraction
    for kind, state in ((SINGLE, START), (R, QUOTED_R), (V, QUOTED_V), (L, QUOTED_L)):
        move[QUOTED, kind], mark[QUOTED, kind] = state, 0
    for state, last in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
        move[state], mark[state] = move[WORD], mark[WORD] | BEFORE
        move[state, last], mark[state, last] = START, 0
    move[QUOTED, LETTER], move[QUOTED, E] = WORD, WORD
    return move.ravel(), mark.ravel()


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Row by row, the map ``first`` followed by the map ``then``."""
    return np.take_along_axis(then, first.astype(np.intp), axis=1)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan: row i becomes the composition of rows 0 to i, in log2 steps."""
    step = 1
    while step < len(maps):
        maps = np.concatenate([maps[:step], compose(maps[:-step], maps[step:])])
        step *= 2
    return maps


class Splitter:
    def __init__(self):
        self.classes = character_classes()
        self.move, self.mark = splitter_tables()

    def starts(self, points: np.ndarray) -> np.ndarray:
        """True where a pre-token, or an end of a text, stands."""
        n = len(points)
        width = -(-n // CHUNK)
        kinds = np.full(width * CHUNK, RESET, np.uint8)
        kinds[:n] = self.classes[points]
        lanes = np.ascontiguousarray(kinds.reshape(width, CHUNK).T)
        maps = np.tile(np.arange(10, dtype=np.uint8), (width, 1))
        constant = False
        for kind in lanes:  # every chunk at once; one lane a chunk suffices when the maps no longer depend on the entry
            maps = self.move[maps * np.uint8(12) + kind[:, None]]
            if not constant and (maps == maps[:, :1]).all():
                maps, constant = maps[:, :1], True
        maps = np.broadcast_to(maps, (width, 10))
        entry = np.concatenate([[np.uint8(START)], scan(maps)[:-1, START]]).astype(np.uint8)
        marks = np.empty_like(lanes)
        for at, kind in enumerate(lanes):
            index = entry * np.uint8(12) + kind
            marks[at] = self.mark[index]
            entry = self.move[index]
        marks = np.ascontiguousarray(marks.T).ravel()
        found = (marks & HERE).astype(bool)
        found[:-1] |= (marks[1:] & BEFORE).astype(bool)
        return found[:n]


class Vocabulary:
    """Byte strings, merge ranks and merge trees of a ``tokenizers`` BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ids = described["model"]["vocab"]
        self.special = [t["content"] for t in described["added_tokens"]]
        as_bytes = {text: bytes(letters[c] for c in text) for text in ids if text not in self.special}
        self.id_of = {as_bytes[text]: i for text, i in ids.items() if text in as_bytes}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(described["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = ids[a], ids[b]
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(ids[a + b], (*pair, rank))
        self.open = {word[:n] for word in self.id_of for n in range(1, len(word))}
        self.longest = max(map(len, self.id_of))
        self.spines: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Tokens that stood at one edge (0 left, 1 right) of ``token``, with the ranks that made and consumed them."""
        key = token, side
        if key not in self.spines:
            line, until = [], 1 << 60
            while True:
                part = self.parts.get(token)
                line.append((token, part[2] if part else -1, until))
                if not part:
                    break
                token, until = part[side], part[2]
            self.spines[key] = line
        return self.spines[key]

    def stays(self, a: int, b: int) -> bool:
        """Whether the text of both tokens is encoded as just these two: no merge across the edge came first."""
        key = a, b
        if key not in self.pairs:
            self.pairs[key] = not any(
                (rank := self.rank.get((x, y))) is not None and max(rank, x_made, y_made) < x_until
                and max(rank, x_made, y_made) <= y_until and x_made < y_until and y_made < x_until
                for x, x_made, x_until in self.spine(a, 1) for y, y_made, y_until in self.spine(b, 0))
        return self.pairs[key]


class Counter:
    """The counting transducer, compiled state by state into a hash table of transitions.

    With too many states it starts anew; results do not depend on that.
    """

    def __init__(self, vocabulary: Vocabulary, max_states: int = MAX_STATES):
        self.vocabulary, self.max_states = vocabulary, max_states
        self.clear()

    def clear(self):
        self.states = [(b"", struct.pack("<ih", -2, 0))]
        self.number = {self.states[0]: 0}
        self.transitions = 0
        self.room(16)

    def room(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.move = np.zeros(1 << bits, np.int32)
        self.change = np.zeros(1 << bits, np.int8)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, or the free slot where it belongs, and which of them are free."""
        slot = self.slots(keys)
        there = self.keys[slot]
        other = np.flatnonzero((there != keys) & (there >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            there[other] = self.keys[slot[other]]
            other = other[(there[other] != keys[other]) & (there[other] >= 0)]
        return slot, there < 0

    def put(self, key: int, target: int, change: int):
        if 4 * self.transitions > self.mask:
            kept = self.keys >= 0
            keys, move, old = self.keys[kept], self.move[kept], self.change[kept]
            self.room(int(self.mask + 1).bit_length())
            for line in zip(keys.tolist(), move.tolist(), old.tolist()):
                self.place(*line)
        self.place(key, target, change)
        self.transitions += 1

    def place(self, key: int, target: int, change: int):
        slot = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.keys[slot] >= 0:
            slot = (slot + 1) & self.mask
        self.keys[slot], self.move[slot], self.change[slot] = key, target, change

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        vocabulary = self.vocabulary
        tail, packed = self.states[state]
        n = len(tail) + 1
        known = struct.unpack(f"<{n}i{n}h", packed)
        lasts, counts = known[:n], known[n:]
        tail += bytes([byte])
        for begin in range(n):  # the longest fitting token first; exactly one fits
            token = vocabulary.id_of.get(tail[begin:])
            if token is not None and (lasts[begin] == -2 or vocabulary.stays(lasts[begin], token)):
                break
        emitted = counts[begin] + 1
        lasts, counts = (*lasts, token), (*counts, emitted)
        live = [tail[i:] in vocabulary.open for i in range(n)] + [True]  # where a later token can begin
        begin = live.index(True)
        live = live[begin:]
        m = len(live)
        key = tail[begin:], struct.pack(
            f"<{m}i{m}h", *(t if on else -1 for t, on in zip(lasts[begin:], live)),
            *(c - emitted if on else 0 for c, on in zip(counts[begin:], live)))
        target = self.intern(key)
        self.put(state * 256 + byte, target, emitted)
        return target, emitted

    def intern(self, key: tuple[bytes, bytes]) -> int:
        """Number of a state, given one if it is new."""
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (state << 8) + byte
        slot, free = self.find(keys)
        if free.any():
            for missing in np.unique(keys[free]).tolist():
                self.compile(missing >> 8, missing & 255)
            slot, _ = self.find(keys)
        return self.move[slot], self.change[slot]

    def count(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of the pre-tokens that begin at ``begin`` and have ``size`` bytes each."""
        if len(self.states) > self.max_states:
            self.clear()
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state, total = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        active, at = len(begin), 0
        while active:
            if active <= 4 and size[0] - at > 64:
                self.finish(data, begin, size, state, total, active, at)
                break
            target, change = self.step(state[:active], data[begin[:active] + at])
            state[:active] = target
            total[:active] += change
            at += 1
            active = int(np.searchsorted(-size[:active], -at, side="left"))
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out

    def finish(self, data, begin, size, state, total, active, at):
        """A few very long pre-tokens, byte by byte."""
        keys = [self.states[number] for number in state[:active].tolist()]
        for i, key in enumerate(keys):
            now, known = self.intern(key), {}
            for byte in data[begin[i] + at:begin[i] + size[i]].tolist():
                if len(self.states) > 2 * self.max_states:
                    key = self.states[now]
                    self.clear()
                    now, known = self.intern(key), {}
                if (now, byte) not in known:
                    target, change = self.step(np.array([now]), np.array([byte]))
                    known[now, byte] = int(target[0]), int(change[0])
                now, change = known[now, byte]
                total[i] += change


class TokenCounter:
    """Counts of whole texts. Special strings inside a text count as one token each, as the library has it."""

    def __init__(self, path: str):
        self.splitter = Splitter()
        self.counter = Counter(Vocabulary(path))

    def count(self, texts: list[str]) -> np.ndarray:
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            for special in self.counter.vocabulary.special:
                parts = [p for part in parts for p in part.split(special)]
            extra[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        joined = "\0".join(pieces) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum(size) - 1
        points[ends] = 0x110000
        starts = np.flatnonzero(self.splitter.starts(points))
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        width[ends] = 1
        offset = np.cumsum(width) - width
        begin = offset[starts]
        length = np.diff(begin, append=offset[-1])
        word = points[starts] != 0x110000
        starts, begin, length = starts[word], begin[word], length[word]
        tokens = self.counter.count(np.frombuffer(joined.encode(), np.uint8), begin, length)
        text_of = np.array(owner, np.int64)[np.searchsorted(ends, starts)]
        return extra + np.bincount(text_of, tokens, len(texts)).astype(np.int64)


_ready: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The transducers of a vocabulary file, kept by the worker with all states compiled so far."""
    if path not in _ready:
        _ready[path] = TokenCounter(path)
    return _ready[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """``df`` with the column ``to``: tokens of the whole text, 0 for null and empty texts. No shuffle.

    An existing column ``to`` is replaced. ``path`` names the vocabulary file on every machine.
    """
    importable(df)

    @F.arrow_udf("long")
    def tokens(column: pa.Array) -> pa.Array:
        ready = counter(path)
        counts = [ready.count(run) for run in slices([t or "" for t in column.to_pylist()])]
        return pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())

    return df.withColumn(to, tokens(F.col(text)))
