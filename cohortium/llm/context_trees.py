"""Language-model scoring by context-tree weighting over bytes.

A text is coded as its lower-cased words, each with a space behind it, and one line feed as the end; the bytes before its
first are line feeds. Each byte is eight binary decisions, and each decision (a node of the byte's bit tree) has a context
tree of its own over the ``DEPTH`` bytes before. A tree node with ``a`` zeros and ``b`` ones has the Krichevsky-Trofimov
estimate ``Pe(a, b)`` and the weighted probability ``Pw = Pe`` at full depth, else ``Pw = (Pe + prod of the children's Pw) / 2``.
Both depend on counts alone, so they follow from counts of byte strings of length ``DEPTH + 1`` in any order.
``w = Pe / (2 Pw)`` is a node's own weight in the mixture over all depths; a bit's probability is
``w * (its count + 1/2) / (a + b + 1) + (1 - w) * that of the next depth``, ended at the deepest context that training met.

The work in Spark: texts are dealt to blocks by hash. Each block gives its distinct strings and words with their counts in
training texts; Spark sums the counts; strings are dealt by their last ``UPPER`` context bytes, whose subtrees are weighed
where they lie, and only the trees above (at most 256 ** (UPPER - 1) contexts of 255 nodes) meet on the driver. The logarithm
of each string then goes back to the blocks that have it, and every block adds up its texts. No table of the corpus is
broadcast or collected, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage
from .texts import importable, lean_workers

DEPTH = 5  # context bytes; a string of DEPTH + 1 bytes has 48 bits
UPPER = 3  # context bytes by which subtrees are dealt
BLOCK_BYTES = 24 << 20  # text of a block
SLICE_BYTES = 1 << 20  # text that is in work at a time
SLICE_DOCS = 1 << 15
SPACE, END = 32, 10
WORD = 1 << 62  # marks keys of words; strings are below 1 << 48
RUN_ROWS = 1 << 19  # strings weighed together, more where one subtree has more
HALF = np.log(0.5)
_halves = 0.5 * np.log(np.pi) + np.concatenate([[0.0], np.cumsum(np.log(np.arange(63) + 0.5))])
_factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 64)))])


def series(z: np.ndarray) -> np.ndarray:
    """Stirling's series for the logarithm of gamma(z), to twelve digits from 32 on."""
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5)


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """Logarithm of gamma(n + 1/2) for whole n: a table, and the series beyond it."""
    return np.where(n < 64, _halves[np.minimum(n, 63)], series(np.maximum(n, 32) + 0.5))


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Logarithm of n! for whole n: a table, and the series beyond it."""
    return np.where(n < 64, _factorials[np.minimum(n, 63)], series(np.maximum(n, 32) + 1.0))


def log_kt(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of ``ones`` ones among ``n`` bits."""
    return log_gamma_half(n - ones) + log_gamma_half(ones) - np.log(np.pi) - log_factorial(n)


class Level:
    """The bit-tree nodes of all contexts of one depth, of sorted distinct (context, byte) keys and their counts.

    ``node[b]`` has the node of each key at bit ``b``, ``n[b]`` and ``ones[b]`` the node's counts, ``first[b]`` its first key.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.node, self.n, self.ones, self.first = [], [], [], []
        for bit in range(8):
            above = keys >> np.uint64(8 - bit)
            new = np.concatenate([[True], above[1:] != above[:-1]])
            first = np.flatnonzero(new)
            one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
            self.node.append(np.cumsum(new) - 1)
            self.first.append(first)
            self.n.append(np.add.reduceat(counts, first))
            self.ones.append(np.add.reduceat(counts * one, first))

    def above(self) -> tuple[Level, np.ndarray]:
        """The level of one context byte less (the oldest, above the byte itself), and the number there of each key here."""
        shorter = (self.keys >> np.uint64(16) << np.uint64(8)) | (self.keys & np.uint64(255))
        keys, at = np.unique(shorter, return_inverse=True)
        return Level(keys, np.bincount(at, self.counts, len(keys)).astype(np.int64)), at

    def weigh(self, below: list[np.ndarray] | None) -> None:
        """Sets ``log_pw`` and the own weight ``w`` of each node; ``below``: sums of the children's ``log_pw``, none at full depth."""
        self.log_pw, self.w = [], []
        for bit in range(8):
            own = log_kt(self.n[bit], self.ones[bit])
            whole = own if below is None else np.logaddexp(HALF + own, HALF + below[bit])
            self.log_pw.append(whole)
            self.w.append(np.ones(len(own)) if below is None else np.exp(HALF + own - whole))

    def to_above(self, parent: Level, at: np.ndarray) -> list[np.ndarray]:
        """Sums of ``log_pw`` of the nodes here by the nodes of ``parent``."""
        return [np.bincount(parent.node[bit][at[self.first[bit]]], self.log_pw[bit], len(parent.n[bit])) for bit in range(8)]

    def estimate(self, bit: int, which: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Krichevsky-Trofimov estimate of the bit ``one`` at the nodes of the keys ``which``."""
        node = self.node[bit][which]
        n, ones = self.n[bit][node], self.ones[bit][node]
        return (np.where(one, ones, n - ones) + 0.5) / (n + 1.0)


def mixed(levels: list[Level], at: list[np.ndarray]) -> np.ndarray:
    """Probability of each of the eight bits of every key of the deepest level, mixed over ``levels`` (deepest first).

    ``at``: the number of each deepest key in every level. A node that training never met takes no part.
    """
    keys = levels[0].keys
    out = np.zeros((8, len(keys)))
    for bit in range(8):
        one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        for depth, (level, which) in enumerate(zip(levels, at)):
            own = level.estimate(bit, which, one)
            if depth == 0:
                p = own
            else:
                w = np.where(met, level.w[bit][level.node[bit][which]], 1.0)
                p = w * own + (1 - w) * p
            met = level.n[bit][level.node[bit][which]] > 0
        out[bit] = np.where(met, p, -1.0)  # -1: not even the topmost of these contexts was met at this node
    return out


def subtree(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, Level]:
    """Bits' probabilities of strings from the depths ``UPPER`` to ``DEPTH``, and the weighed level of depth ``UPPER``.

    ``keys``: sorted distinct strings, the latest context byte highest, the coded byte lowest; whole subtrees of ``UPPER`` bytes.
    """
    levels, at = [Level(keys, counts)], [np.arange(len(keys))]
    levels[0].weigh(None)
    for _ in range(DEPTH - UPPER):
        parent, up = levels[-1].above()
        parent.weigh(levels[-1].to_above(parent, up))
        levels.append(parent)
        at.append(up[at[-1]])
    return mixed(levels, at), levels[-1]


def bit_nodes(keys: np.ndarray, bit: int) -> np.ndarray:
    """The number 1..255 of each key's bit-tree node at ``bit``."""
    return ((1 << bit) + ((keys & np.uint64(255)) >> np.uint64(8 - bit))).astype(np.int64)


class Upper:
    """What the depths 0 to UPPER - 1 add: a bit's probability is ``plain + rest * that of depth UPPER`` (``own`` if none)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, below: dict[tuple[int, int], float]):
        """``keys``: (context of UPPER - 1 bytes, byte) sorted; ``below``: sums of log_pw of depth UPPER by (context, node)."""
        level = Level(keys, counts)
        under = []
        for bit in range(8):
            first = keys[level.first[bit]]
            under.append(np.array([below.get(pair, 0.0) for pair in zip((first >> np.uint64(8)).tolist(), bit_nodes(first, bit).tolist())]))
        level.weigh(under)
        self.levels, self.at = [level], [np.arange(len(keys))]
        for _ in range(UPPER - 1):
            parent, up = self.levels[-1].above()
            parent.weigh(self.levels[-1].to_above(parent, up))
            self.levels.append(parent)
            self.at.append(up[self.at[-1]])

    def finish(self, strings: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each string's last byte; ``bits`` as ``mixed`` gives them, one row per string."""
        total = np.zeros(len(strings))
        deepest = self.levels[0].keys
        keys = (strings >> np.uint64(8 * (DEPTH - UPPER + 2)) << np.uint64(8)) | (strings & np.uint64(255))
        which = np.searchsorted(deepest, keys)
        for bit in range(8):
            one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            p, met = bits[:, bit].astype(np.float64), bits[:, bit] >= 0
            for level, at in zip(self.levels, self.at):
                here = at[which]
                own = level.estimate(bit, here, one)
                node = level.node[bit][here]
                w = np.where(met, level.w[bit][node], 1.0)
                p = w * own + (1 - w) * p
                met = level.n[bit][node] > 0
                p = np.where(met, p, 0.5)
            total += np.log(p)
        return total


class Slices:
    """Coded texts of a block in slices of bounded size: ``keys`` and ``words`` with the text that each belongs to."""

    def __init__(self, texts: list[bytes | None] | pa.ChunkedArray):
        self.texts = texts if isinstance(texts, list) else (text.as_py() for chunk in texts.chunks for text in chunk)

    def __iter__(self) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
        """(number of the first text, strings, text of each string, words, text of each word); an end is the empty word."""
        first, parts, owners, words, counts, size = 0, [], [], [], [], 0
        for number, text in enumerate(self.texts):
            tail = bytes([END]) * DEPTH
            for own, last in self.cut((text or b"").lower()):
                coded = b" ".join(own) + b" " * bool(own) + bytes([END]) * last
                parts.append(tail + coded)
                owners.append(number)
                tail = (tail + coded)[-DEPTH:]
                words += own + [b""] * last
                counts.append(len(own) + last)
                size += len(coded) + DEPTH
                if size >= SLICE_BYTES or number - first >= SLICE_DOCS - 1:
                    yield self.made(first, parts, owners, words, counts)
                    first, parts, owners, words, counts, size = number, [], [], [], [], 0
        if parts:
            yield self.made(first, parts, owners, words, counts)

    @staticmethod
    def cut(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
        """The words of a text, a run of at most about SLICE_BYTES at a time, and whether its end follows."""
        at = 0
        while len(text) - at > SLICE_BYTES:
            stop = at + SLICE_BYTES
            while stop < len(text) and not text[stop:stop + 1].isspace():
                stop += 1
            yield text[at:stop].split(), False
            at = stop
        yield text[at:].split(), True

    @staticmethod
    def made(first, parts, owners, words, counts):
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        keys = data[DEPTH:].astype(np.uint64)
        for back in range(1, DEPTH + 1):  # the byte right before stands highest
            keys |= data[DEPTH - back:len(data) - back].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - back))
        coded = np.ones(len(data), bool)
        coded[((np.cumsum(sizes) - sizes)[:, None] + np.arange(DEPTH)).ravel()] = False
        owners = np.asarray(owners, np.int64)
        return first, keys[coded[DEPTH:]], np.repeat(owners, sizes - DEPTH), words, np.repeat(owners, counts)


def word_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of words, by 62 bits of a hash (two of a billion words share one at odds of 1 in 10), and each word's number."""
    codes, distinct = pd.factorize(np.array(words, object))
    return (pd.util.hash_array(distinct, categorize=False) >> np.uint64(2)) | np.uint64(WORD), codes


def merged(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``keys`` with their counts, and ``more`` sorted distinct ones added."""
    at = np.searchsorted(keys, more)
    met = keys[np.minimum(at, len(keys) - 1)] == more if len(keys) else np.zeros(len(more), bool)
    counts[at[met]] += times[met]
    return np.insert(keys, at[~met], more[~met]), np.insert(counts, at[~met], times[~met])


def counted(texts: list[bytes | None] | pa.ChunkedArray, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of strings and words of a block, and how often its texts that learn have each (0: others only)."""
    strings, words = ((np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2))
    for _, keys, owner, own_words, word_owner in Slices(texts):
        if len(keys):
            both = np.sort(keys << np.uint64(1) | learns[owner].astype(np.uint64))
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            times = np.where(both[first] & np.uint64(1), np.diff(np.append(first, len(both))), 0)
            found = both[first] >> np.uint64(1)
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            strings = merged(*strings, found[first], np.add.reduceat(times, first))
        found, codes = word_keys(own_words)
        times = np.bincount(codes, learns[word_owner], len(found)).astype(np.int64)
        order = np.argsort(found)
        words = merged(*words, found[order], times[order])
    return np.concatenate([strings[0], words[0]]), np.concatenate([strings[1], words[1]])  # words' keys are larger


def scored(texts: list[bytes | None] | pa.ChunkedArray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: words with the end, known ones, sum of log10(count + 1) of words, natural logarithm of the coded text, bytes.

    ``keys`` sorted; ``values``: logarithms of strings, counts of words.
    """
    n = len(texts)
    tokens, known, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    base, score = np.zeros(n), np.zeros(n)
    for first, strings, owner, words, word_owner in Slices(texts):
        count = int(owner.max(initial=first)) + 1 - first
        both = np.sort(strings << np.uint64(16) | (owner - first).astype(np.uint64))
        string = both >> np.uint64(16)
        new = np.concatenate([[True], string[1:] != string[:-1]]) if len(string) else np.zeros(0, bool)
        logs = values[np.searchsorted(keys, string[new])][np.cumsum(new) - 1]
        text = (both & np.uint64(0xFFFF)).astype(np.int64)
        score[first:first + count] += np.bincount(text, logs, count)
        size[first:first + count] += np.bincount(text, minlength=count)
        own, codes = word_keys(words)
        times = values[np.searchsorted(keys, own)][codes]
        text = word_owner - first
        tokens[first:first + count] += np.bincount(text, minlength=count)
        known[first:first + count] += np.bincount(text[times > 0], minlength=count)
        base[first:first + count] += np.bincount(text, np.log10(times + 1), count)
    return tokens, known, base, score, size


def blocked(df: DataFrame, learns: Column, key: str, text: str) -> DataFrame:
    """(block, key, text, learns) of all rows. Rows of equal key and text share a block."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(-(-size // BLOCK_BYTES), 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.select(F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("key"),
                     F.col(text).cast("binary").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))


def weighed(strings: DataFrame) -> DataFrame:
    """Rows (key, bits) of all strings, and rows (key, node, log_pw) of the bit-tree nodes of depth UPPER, with the context that
    lies above as key. Subtrees are dealt by their context; a task holds those of RUN_ROWS strings at a time.
    """
    dealt = strings.repartition(F.shiftright("key", 8 * (DEPTH - UPPER + 1))).sortWithinPartitions("key")

    def made(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bits, top = subtree(keys, counts)
        contexts = [(top.keys[top.first[bit]] >> np.uint64(16)).astype(np.int64) for bit in range(8)]
        nodes = [bit_nodes(top.keys[top.first[bit]], bit) for bit in range(8)]
        n, m = len(keys), sum(map(len, nodes))
        lists = pa.ListArray.from_arrays(np.arange(0, 8 * n + 1, 8, dtype=np.int32), pa.array(bits.T.astype(np.float32).ravel()))
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([keys.astype(np.int64), *contexts])),
            pa.concat_arrays([lists, pa.nulls(m, lists.type)]),
            pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.concatenate(nodes).astype(np.int32))]),
            pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(np.concatenate(top.log_pw))])], ["key", "bits", "node", "log_pw"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting, size = [], 0
        for batch in batches:
            waiting.append((batch["key"].to_numpy().astype(np.uint64), batch["n"].to_numpy()))
            size += batch.num_rows
            if size < RUN_ROWS:
                continue
            keys, counts = (np.concatenate(part) for part in zip(*waiting))
            whole = int(np.searchsorted(keys, keys[-1] >> np.uint64(8 * (DEPTH - UPPER + 1)) << np.uint64(8 * (DEPTH - UPPER + 1))))
            if whole:
                yield made(keys[:whole], counts[:whole])
            waiting, size = [(keys[whole:], counts[whole:])], len(keys) - whole
        if size:
            yield made(*(np.concatenate(part) for part in zip(*waiting)))

    return dealt.mapInArrow(runs, "key long, bits array<float>, node int, log_pw double")


def upper(strings: DataFrame, subtrees: DataFrame) -> Upper | None:
    """The trees above depth UPPER, from sums over all strings; none where there are no strings."""
    short = F.shiftright("key", 8 * (DEPTH - UPPER + 2)) * 256 + F.col("key").bitwiseAND(255)
    table = strings.groupBy(short.alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    if not table.num_rows:
        return None
    below = subtrees.where("node IS NOT NULL").groupBy("key", "node").agg(F.sum("log_pw").alias("log_pw")).toArrow()
    pairs = zip(below["key"].to_pylist(), below["node"].to_pylist())
    return Upper(table["key"].to_numpy().astype(np.uint64), table["n"].to_numpy(), dict(zip(pairs, below["log_pw"].to_pylist())))


def language_scores(df: DataFrame, learns: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key``, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    The trees learn from rows where ``learns`` is true and score all. Tokens are runs of anything but ASCII white space, A-Z
    lower-cased, and one end. n_known of them occur in training; base_score is the base-10 logarithm of the text under
    add-one word shares, score under the context trees; n_bytes bytes are coded. A null text counts as empty, which is one
    end; a null ``learns`` as false; equal rows give equal rows; without training rows every bit has odds of one half. An empty
    table gives an empty result. Other columns are not read, whatever their names. The result is written to the shared folder.
    """
    importable(df)
    lean_workers(df)
    docs = blocked(df, learns, key, text)

    def count_block(block: tuple, rows: pa.Table) -> pa.Table:
        keys, counts = counted(rows["text"], rows["learns"].to_numpy())
        return pa.table({"block": pa.array(np.full(len(keys), block[0].as_py(), np.int32)), "key": keys.astype(np.int64), "n": counts})

    found = stage(docs.select("block", "text", "learns").groupBy("block").applyInArrow(count_block, "block int, key long, n long"), "lm-found")
    counts = stage(found.groupBy("key").agg(F.sum("n").alias("n")), "lm-counts")
    strings, words = counts.where(F.col("key") < WORD), counts.where(F.col("key") >= WORD)
    trained, kinds = (int(x or 0) for x in words.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first())
    subtrees = stage(weighed(strings), "lm-subtrees")
    above = df.sparkSession.sparkContext.broadcast(upper(strings, subtrees))

    @F.arrow_udf("double")
    def finished(keys: pa.Array, bits: pa.Array) -> pa.Array:
        rows = bits.flatten().to_numpy(zero_copy_only=False).reshape(-1, 8)
        return pa.array(above.value.finish(keys.to_numpy().astype(np.uint64), rows) if len(keys) else np.zeros(0))

    values = subtrees.where("node IS NULL").select("key", finished("key", "bits").alias("value")).unionByName(
        words.select("key", F.col("n").cast("double").alias("value")))
    returned = found.select("block", "key").join(values, "key").select("block", F.col("key").alias("string"), "value")
    kind = docs.schema["key"].dataType
    less = float(np.log10(trained + kinds + 1))

    def score_block(rows: pa.Table, known_keys: pa.Table) -> pa.Table:
        keys, values = known_keys["string"].to_numpy().astype(np.uint64), known_keys["value"].to_numpy()
        order = np.argsort(keys)
        tokens, known, base, score, size = scored(rows["text"], keys[order], values[order])
        return pa.table({"key": rows["key"], "n_tokens": tokens, "n_known": known, "train_tokens": np.full(len(tokens), trained),
                         "base_score": base - tokens * less, "score": score / np.log(10), "n_bytes": size, "bits_per_byte": -score / np.log(2) / size})

    made = docs.select("block", "key", "text").groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(
        score_block, f"key {kind.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
                     "n_bytes long, bits_per_byte double")
    made = stage(made.withColumnRenamed("key", key), "lm-scores")
    unstage(found, counts, subtrees)
    return made
