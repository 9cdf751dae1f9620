"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings learns from confirmed toxic texts and from texts of unknown
class. With the share of toxic texts (the class prior) the risk on clean texts follows from the unlabelled ones:
``R = prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``. Where the second part falls below zero the model has begun to
learn the sample by heart, and the step goes the other way. The loss is the logistic one. The risk is divided by the prior, so that a
rare class is learnt from as fast as a common one.

Which features get a weight does not depend on the prior: those that are significantly more frequent in toxic texts than in
the whole corpus, whose document frequencies are counted over all rows that are not held out. What a feature is worth is left
to the risk and the ridge.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage
from .texts import importable, slices

BITS = 22  # buckets of features
BEGINNINGS = (4, 5, 6)  # bytes of a word's beginning that are features beside the word
POSITIVES, UNLABELLED = 2000, 5000  # most rows that a fit sees
LEAST_TEXTS, SURPRISE = 3, 12.0  # what a feature needs: toxic texts that have it, and the G statistic of their number
PRIME = 0x9E3779B97F4A7C15

_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for at, base in enumerate((PRIME, pow(PRIME, -1, 1 << 64))):
            _powers[at] = np.multiply.accumulate(np.full(n, base, np.uint64))
    return _powers[0][:n], _powers[1][:n]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and word beginning, repeats included, in order of the texts.

    Words are runs of letters and digits of the lower-cased text; any character beyond ASCII counts as a letter.
    """
    data = np.frombuffer(("\n".join(t.lower() for t in texts) + "\n").encode(), np.uint8)
    inside = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * up)])

    def bucket(who, stop, kind):
        value = (total[stop] - total[begin[who]]) * down[begin[who]] + np.uint64(kind * 0xD1B54A32D192ED03 % (1 << 64))
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (value >> np.uint64(64 - BITS)).astype(np.int64)

    everyone = np.arange(len(begin))
    words, buckets = [everyone], [bucket(everyone, end, 0)]
    for n in BEGINNINGS:
        longer = np.flatnonzero(end - begin > n)
        words.append(longer)
        buckets.append(bucket(longer, begin[longer] + n, n))
    word, found = np.concatenate(words), np.concatenate(buckets)
    sizes = np.fromiter((len(t.lower().encode()) + 1 for t in texts), np.int64, len(texts))
    text_of = np.searchsorted(np.cumsum(sizes), begin, side="right")
    return text_of[word], found


@dataclass
class Classifier:
    """Bias and the weights of the buckets that have one."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.zeros(1 << BITS, np.float32)
            self._table[self.buckets] = self.weights
        return self._table

    def __getstate__(self):
        return self.bias, self.buckets, self.weights

    def __setstate__(self, state):
        self.bias, self.buckets, self.weights = state

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts, each feature counted once a text; an empty text gets the bias alone."""
        text, bucket = features(texts)
        weighed = self.table()[bucket] != 0
        once = np.unique(text[weighed] << BITS | bucket[weighed])
        z = self.bias + np.bincount(once >> BITS, self.table()[once & ((1 << BITS) - 1)], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


ODDS = [(PRIME + 2 * i * 0xC2B2AE3D27D4EB4F) % (1 << 64) for i in range(4)]


def marks(buckets: np.ndarray) -> list[int]:
    """Minima of four hashes, which near copies share."""
    spread = buckets.astype(np.uint64) + np.uint64(1)
    return [int((spread * np.uint64(odd) >> np.uint64(20)).min(initial=1 << 44)) for odd in ODDS]


def telling(in_toxic: np.ndarray, toxic: int, in_all: np.ndarray, rows: int) -> np.ndarray:
    """Which features more toxic texts have than their share among all rows lets expect, by a likelihood ratio (G) test."""
    expected = np.maximum(in_all, 1) / max(rows, 1) * toxic
    seen = np.maximum(in_toxic, 1)
    surprise = 2 * (seen * np.log(seen / expected) - seen + expected)
    return (in_toxic >= LEAST_TEXTS) & (in_toxic > expected) & (surprise > SURPRISE)


def risk(z: np.ndarray, n_p: int, prior: float) -> tuple[float, float, np.ndarray]:
    """Both parts of the risk over the prior, and the slope of the step at each text; positive texts come first in ``z``."""
    s = 1 / (1 + np.exp(-z))
    n_u = len(z) - n_p
    on_toxic = np.logaddexp(0, -z[:n_p]).mean()
    if_clean = np.logaddexp(0, z)
    on_clean = if_clean[n_p:].mean() / prior - if_clean[:n_p].mean()
    of_toxic = np.concatenate([(s[:n_p] - 1) / n_p, np.zeros(n_u)])
    of_clean = np.concatenate([-s[:n_p] / n_p, s[n_p:] / n_u / prior])
    return on_toxic, on_clean, of_toxic + of_clean if on_clean >= 0 else -of_clean


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300,
             rate: float = 0.05, ridge: float = 1e-3, told: bool = False) -> Classifier:
    """Fit on arrays of distinct buckets, one per text, by full steps of Adam.

    Buckets get a weight that pass ``telling`` on the two samples; all that occur, where they are ``told`` ones already.
    """
    prior = min(max(prior, 1e-6), 0.999)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Classifier(start, np.zeros(0, np.int64), np.zeros(0, np.float32))
    rows = positive + unlabelled
    n_p = len(positive)
    row = np.repeat(np.arange(len(rows)), np.fromiter(map(len, rows), np.int64, len(rows)))
    every, column = np.unique(np.concatenate(rows), return_inverse=True)
    if not told:
        used = telling(np.bincount(column[row < n_p], minlength=len(every)), n_p,
                       np.bincount(column[row >= n_p], minlength=len(every)), len(unlabelled))
        kept = used[column]
        row, column, every = row[kept], (np.cumsum(used) - 1)[column[kept]], every[used]
    n = len(every)
    weight, bias = np.zeros(n), start
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        z = np.clip(bias + np.bincount(row, weight[column], len(rows)), -60, 60)
        _, _, by_row = risk(z, n_p, prior)
        gradient = np.append(np.bincount(column, by_row[row], n) + ridge * weight, by_row.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        move = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-6)
        weight -= move[:-1]
        bias -= move[-1]
    return Classifier(float(bias), every.astype(np.int64), weight.astype(np.float32))


def held_out(key: Column) -> Column:
    """Whether a row's label must stay unseen: crc32 of its key as text, modulo 3, is 1. A null key's is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Classifier from at most ``positives`` confirmed toxic and ``unlabelled`` texts of rows that are not held out.

    Both samples are the rows with the smallest hashes of their keys, without near copies. Document frequencies of the
    features of the toxic sample are counted over all rows that are not held out. The prior is the share of toxic rows among
    all labelled rows that are not held out; other labels are not used. Without positive rows every score is the prior.
    """
    own = labels.where(F.col(key).isNotNull() & ~held_out(F.col(key)))
    share = own.agg(F.count(F.lit(1)), F.sum((F.col(label) == 1).cast("int"))).first()
    if not share[0]:
        return fit_nnpu([], [], 0.0)
    prior = int(share[1] or 0) / int(share[0])
    order = F.xxhash64(F.col(key), F.lit(3))
    docs = df.select(F.col(key).alias(key), F.col(text).alias("text")).where(F.col(key).isNotNull() & ~held_out(F.col(key)))
    chosen = own.where(F.col(label) == 1).select(key).distinct().orderBy(order, key).limit(positives).withColumn("side", F.lit(0))
    chosen = chosen.unionByName(docs.select(key).orderBy(order, key).limit(unlabelled).withColumn("side", F.lit(1)))

    importable(df)

    @F.arrow_udf("struct<buckets:array<int>,marks:array<long>>")
    def told(column: pa.Array) -> pa.Array:
        found = [np.unique(features([t.as_py() or ""])[1]) for t in column]
        return pa.StructArray.from_arrays([pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32())),
                                           pa.array([marks(f) for f in found], pa.list_(pa.int64()))], ["buckets", "marks"])

    wanted = docs.join(F.broadcast(chosen), key).select("side", order.alias("order"), told(F.col("text")).alias("told"))
    sample = stage(wanted.groupBy("side", "told.marks").agg(F.min_by("told.buckets", "order").alias("buckets"), F.min("order").alias("order")), "toxic-sample")
    toxic = sample.where("side = 0")
    counts = toxic.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= LEAST_TEXTS).orderBy("bucket").toArrow()
    candidates, in_toxic = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    sent = df.sparkSession.sparkContext.broadcast(candidates)  # bounded by the toxic sample

    def occur(batches):
        own, times, rows = np.full(1 << BITS, -1, np.int32), np.zeros(len(sent.value) + 1, np.int64), 0
        own[sent.value] = np.arange(len(sent.value))
        for batch in batches:
            for run in slices([t or "" for t in batch["text"].to_pylist()]):
                of, bucket = features(run)
                met = own[bucket]
                once = np.unique(of[met >= 0] * len(times) + met[met >= 0])
                times += np.bincount(once % len(times), minlength=len(times))
                rows += len(run)
        times[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(times))), pa.array(times)], ["number", "n"])

    totals = docs.select("text").mapInArrow(occur, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).orderBy("number").toArrow()
    in_all = totals["n"].to_numpy() if totals.num_rows else np.zeros(len(candidates) + 1, np.int64)
    used = candidates[telling(in_toxic, toxic.count(), in_all[:-1], int(in_all[-1]))]
    table = sample.select("side", "order", F.array_intersect("buckets", F.lit(used.tolist()).cast("array<int>")).alias("buckets")).toArrow()
    table = table.sort_by([("order", "ascending"), ("side", "ascending")])
    unstage(sample)
    by_side = [[np.array(row, np.int64) for row, side in zip(table["buckets"].to_pylist(), table["side"].to_pylist()) if side == wanted_side]
               for wanted_side in (0, 1)]
    return fit_nnpu(*by_side, prior=prior, told=True)


def scorer(df: DataFrame, model: Classifier):
    """A function from a text column of ``df`` to its score."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    importable(df)

    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        found = [sent.value.scores(run) for run in slices([t or "" for t in column.to_pylist()])]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return scores


def score(df: DataFrame, model: Classifier, text: str = "text", to: str = "score") -> DataFrame:
    """``df`` with the column ``to``: score of the whole text from 0 to 1. Null counts as empty. No shuffle.

    The model's size is bounded by its sample. An existing column ``to`` is replaced.
    """
    return df.withColumn(to, scorer(df, model)(F.col(text)))


def drop_toxic(df: DataFrame, model: Classifier, least: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` with a score below ``least``, whole and unchanged."""
    return df.where(scorer(df, model)(F.col(text)) < least)
