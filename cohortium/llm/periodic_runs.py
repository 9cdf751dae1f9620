"""Periodic runs of words inside a text: stretches that repeat with some smallest period at least ``exponent`` times.

Words that occur too rarely in their segment to be part of a qualifying run split it, again and again until no segment
changes: a run of period q and length of at least ``exponent * q`` has each of its words ``exponent`` times or more. What
survives is scanned lag by lag. At lag q the matching positions of a run are at least ``max(least - q, (exponent - 1) * q)`` in
a row, so that it is enough to compare short word strings at every such distance, which makes the number of
comparisons of all lags together ``m log m`` for a segment of m words. Each agreement is extended to both sides by binary
search on prefix hashes, and every run found is compared word by word before it counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import importable, spread, whole_row

LEAST, EXPONENT = 24, 3  # words of a run, and its length in periods
STRING = 8  # words compared at once
SLICE_WORDS = 1 << 20  # words in work at a time, more where one text has more
PROBES = 1 << 20  # comparisons in work at a time
ODD = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"


def segments(words: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of what is left of the segments of ``words`` (whole numbers) after splitting at rare words to stability."""
    long_enough = end - begin >= least
    begin, end = begin[long_enough], end[long_enough]
    done_begin, done_end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    kinds = int(words.max(initial=0)) + 1
    while len(begin):
        size = end - begin
        at = spread(begin, size)
        of = np.repeat(np.arange(len(begin)), size)
        _, which, times = np.unique(of * kinds + words[at], return_inverse=True, return_counts=True)
        rare = times[which] < exponent
        broken = np.bincount(of, rare, len(begin)) > 0
        done_begin.append(begin[~broken])
        done_end.append(end[~broken])
        # new segments: stretches of words that stay, inside one old segment
        stays = ~rare & broken[of]
        old = np.where(stays, of, -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[-1], old, [-1]])))
        first, last = edge[:-1], edge[1:]
        kept = (old[first] >= 0) & (last - first >= least)
        begin, end = at[first[kept]], at[last[kept] - 1] + 1
    return np.concatenate(done_begin), np.concatenate(done_end)


class Hashes:
    """Prefix hashes of a segment, by which stretches of words are compared."""

    def __init__(self, words: np.ndarray):
        value = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), ODD)]))
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(value * self.power[:-1])])

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` words from ``a`` and from ``b`` (behind it) agree."""
        return (self.total[a + size] - self.total[a]) * self.power[b - a] == self.total[b + size] - self.total[b]

    def forth(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from ``a`` and ``b`` on."""
        low, high = np.zeros(len(a), np.int64), len(self.total) - 1 - b
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.same(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree right before ``a`` and ``b``."""
        low, high = np.zeros(len(a), np.int64), a.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.same(a - middle, b - middle, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def lag_scan(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one segment."""
    n = len(words)
    lags = np.arange(1, n // exponent + 1)
    matching = np.maximum(least - lags, (exponent - 1) * lags)  # positions in a row that a run of this lag has
    string = int(min(STRING, matching.min(initial=STRING)))
    steps = matching - string + 1
    probes = np.maximum(n - lags - string, -1) // steps + 1
    hashes, found = Hashes(words), {}
    parts = np.flatnonzero(np.diff(np.concatenate([[-1], np.cumsum(probes) // PROBES])))
    for first, last in zip(parts, [*parts[1:], len(lags)]):
        lag = np.repeat(lags[first:last], probes[first:last])
        at = spread(np.zeros(last - first, np.int64), probes[first:last]) * np.repeat(steps[first:last], probes[first:last])
        hit = words[at] == words[at + lag]
        lag, at = lag[hit], at[hit]
        hit = hashes.same(at, at + lag, np.full(len(at), string))
        lag, at = lag[hit], at[hit]
        before, behind = hashes.back(at, at + lag), hashes.forth(at, at + lag)
        length = before + behind + lag
        whole = length >= np.maximum(least, exponent * lag)
        for start, size, period in sorted(set(zip((at - before)[whole].tolist(), length[whole].tolist(), lag[whole].tolist()))):
            found[start, size] = min(period, found.get((start, size), period))
    runs = []
    for (start, size), period in found.items():
        stop = start + size
        if not (words[start:stop - period] == words[start + period:stop]).all():  # two stretches of equal hash
            return plain_scan(words, least, exponent)
        runs.append((start, size, period))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def plain_scan(words: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """The same by comparing every position at every lag."""
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, len(words) // exponent + 1):
        same = np.concatenate([[False], words[:-lag] == words[lag:], [False]])
        first, last = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(~same[1:] & same[:-1])
        for start, size in zip(first.tolist(), (last - first + lag).tolist()):
            if size >= max(least, exponent * lag):
                found.setdefault((start, size), lag)
    return sorted(((start, size, lag) for (start, size), lag in found.items()), key=lambda run: (run[0], run[2]))


def runs_of(texts: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, by start, then period."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.array([word for text in texts for word in text], object)
    codes = pd.factorize(words)[0].astype(np.int64) if len(words) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    begin, end = segments(codes, ends - sizes, ends, least, exponent)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owner = np.searchsorted(ends, begin, side="right")
    for first, last, number in zip(begin.tolist(), end.tolist(), owner.tolist()):
        shift = first - int(ends[number] - sizes[number])
        found[number] += [(start + shift, length, period) for start, length, period in lag_scan(codes[first:last], least, exponent)]
    return [sorted(runs, key=lambda run: (run[0], run[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """``words`` joined by a space, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``df`` with ``runs`` (start, length, period in words; by start, then period) and ``collapsed``. No shuffle.

    Words are runs of anything but ASCII white space, numbered from 0. A run has at least ``least`` words and ``exponent``
    periods and cannot be made longer; its period is its smallest. ``collapsed`` is the text's words joined by one space,
    without repetitions: a run's first period stays. A null or empty text has no runs and collapses to the empty text.
    Repeated rows get equal values; existing columns of the two names are replaced, other columns stay whatever their names.
    """
    if exponent < 2 or least < 2 * exponent:
        raise ValueError("a run needs two periods at least, and so many words that strings of it can be compared")
    importable(df)

    @F.arrow_udf(f"struct<runs:{RUNS},collapsed:binary>")
    def found(column: pa.Array) -> pa.Array:
        runs, short, waiting, size = [], [], [], 0

        def flush():
            for words, own in zip(waiting, runs_of(waiting, least, exponent)):
                runs.append([dict(zip(("start", "length", "period"), run)) for run in own])
                short.append(collapsed(words, own))
            waiting.clear()

        for value in column:
            waiting.append((value.as_py() or b"").split())
            size += len(waiting[-1])
            if size >= SLICE_WORDS:
                flush()
                size = 0
        flush()
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(runs, kinds), pa.array(short, pa.binary())], ["runs", "collapsed"])

    made = found(F.col(text).cast("binary"))
    names = [c for c in df.columns if c not in ("runs", "collapsed")]
    both = df.select(whole_row(df, names), made.alias("found"))
    return both.select(*(F.col("row")[c].alias(c) for c in names), "found.runs", F.col("found.collapsed").cast("string").alias("collapsed"))


def with_planted_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``text`` as its words joined by one space, those of every tenth key (by crc32) made periodic from a word on.

    With h = crc32 of the decimal key, g = h / 10, n words: where 10 divides h, word i >= a becomes word a + (i - a) % p of the
    original, a = g % n, p = 1 + (n - a) / (3 + g % 8). A null key leaves its text as it is; a null text has no words.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    names = df.columns

    def planted(row):
        n, g = F.size(row["words"]), F.floor(row["h"] / 10)
        a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
        p = F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("int")
        # the words before a, then as many whole periods as fit, then the rest of one
        period = F.slice(row["words"], a + 1, F.greatest(p, F.lit(1)))
        whole, rest = F.floor((n - a) / p).cast("int"), F.pmod(n - a, p).cast("int")
        made = F.concat(F.slice(row["words"], F.lit(1), a), F.flatten(F.array_repeat(period, whole)), F.slice(period, F.lit(1), rest))
        return F.array_join(F.when((F.pmod(row["h"], F.lit(10)) == 0) & (n > 0), made).otherwise(row["words"]), " ")

    both = df.select(whole_row(df, names), F.struct(h.alias("h"), words.alias("words")).alias("own"))
    return both.select(*(planted(F.col("own")).alias(c) if c == text else F.col("row")[c].alias(c) for c in names))
