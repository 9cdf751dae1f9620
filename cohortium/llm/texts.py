"""Helpers of the text operators: runs of whole texts, distinct words and their memo."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_CHARS = 1_000_000


def importable(df: DataFrame) -> None:
    """Lets Python workers on this machine import the package from where the driver did.

    On a cluster the package is installed or shipped with the job, as the memos of workers live in its modules.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))


def lean_workers(df: DataFrame) -> None:
    """Lets Python workers that start from now on give large freed arrays back to the system at once, instead of keeping them."""
    environment = df.sparkSession.sparkContext.environment
    environment.update({"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"})


def release_shuffles(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: its cleaner does so once the driver has collected its garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def whole_row(df: DataFrame, names: list[str] | None = None, to: str = "row") -> Column:
    """Columns of ``df`` (all by default) as one struct, so that an operator's own columns clash with none of them."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in (df.columns if names is None else names))).alias(to)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Runs of whole texts with about ``limit`` characters, at least one text each."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices begin[0] .. begin[0]+size[0]-1, begin[1] .. and so on, in one flat array."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begin - (ends - size), size)


class Memo:
    """Ids of words met before. ``encode`` gets new distinct words and gives their flat ids and sizes.

    Beyond ``limit`` words it forgets those met in one run of texts only, and all if they are still too many; that changes
    no result.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 500_000):
        self.encode, self.limit = encode, limit
        self.keep([], np.zeros(0, np.int64))

    def keep(self, words: list[str], at: np.ndarray) -> None:
        """Only ``words``, whose numbers so far are ``at``, stay."""
        ids, size = (self.ids[spread(self.begin[at], self.size[at])], self.size[at]) if len(at) else (np.zeros(0, np.int32), at)
        self.number = dict(zip(words, range(len(words))))
        self.begin, self.size, self.met = np.cumsum(size) - size, size, np.zeros(len(size), np.int64)
        self.used = len(ids)
        self.ids = np.concatenate([ids, np.zeros(max(1 << 16, len(ids)), np.int32)]).astype(np.int32)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all ``words`` and the number of ids of each."""
        if len(self.number) > self.limit:
            again = np.flatnonzero(self.met > 1)
            again = again if len(again) <= self.limit // 2 else again[:0]
            held = set(again.tolist())
            self.keep([word for word, i in self.number.items() if i in held], again)
        new = list(set(words).difference(self.number))
        if new:
            ids, size = self.encode(new)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
            self.ids[self.used:self.used + len(ids)] = ids
            self.begin = np.concatenate([self.begin, self.used + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
            self.used += len(ids)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.met[np.unique(at)] += 1
        return self.ids[spread(self.begin[at], self.size[at])], self.size[at]
