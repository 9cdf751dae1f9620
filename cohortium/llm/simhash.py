"""Near duplicates by SimHash fingerprints, linked by an exact range join on segment bit counts.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two embeddings never
exceeds the number of differing bits. Counts are kept in unary (0, 01, 11), so the distance is the number of differing bits
of two words. The segments form ``limit + 4`` bands: two embeddings within ``limit`` agree in all but ``limit`` of them,
so they share a grid cell for some choice of four bands. Members of a cell are compared by Manhattan distance first, and
those that pass by their fingerprints.

Only distinct fingerprints enter. A cell with many members is dealt out in blocks, every pair of blocks to a lane of its
own, and a lane gives a spanning forest of its links instead of all pairs. Groups are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .texts import importable

LOW = 0x5555555555555555  # the lower bit of every segment
BLOCK = 2048


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, shingle: int) -> int:
    """Each bit is the majority of the hashes of all shingles, repeats included; no word gives 0."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: A-Z and the six blanks of ASCII, nothing else
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    total = np.zeros(64, np.int64)
    every = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(every), 65536):
        total += np.unpackbits(every[at:at + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", to: str = "fingerprint", shingle: int = 4) -> DataFrame:
    """``df`` with the column ``to``: the fingerprint of the whole text as a signed 64-bit integer. No shuffle."""
    importable(df)

    @F.arrow_udf("long")
    def prints(column: pa.Array) -> pa.Array:
        return pa.array([signed(fingerprint(t.as_py() or "", shingle)) for t in column], pa.int64())

    return df.withColumn(to, prints(F.col(text)))


def embedded(fingerprint: Column) -> Column:
    """The bit counts of all segments, in unary."""
    low, high = fingerprint.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fingerprint, 1).bitwiseAND(F.lit(LOW))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def embedding(x: np.ndarray) -> np.ndarray:
    low, high = x & np.uint64(LOW), (x >> np.uint64(1)) & np.uint64(LOW)
    return (low & high) << np.uint64(1) | low | high


def cell_masks(limit: int, shared: int = 4) -> list[int]:
    """One mask for each choice of ``shared`` of ``limit + shared`` bands of segments."""
    bands = [0] * (limit + shared)
    for segment in range(32):
        bands[segment % len(bands)] |= 3 << (2 * segment)
    return [sum(chosen) for chosen in combinations(bands, shared)]


def forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches over the links (a, b)."""
    label = np.arange(nodes)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def linked(prints: np.ndarray, lane: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row of a lane that has links there, and the first row that it reaches; rows of a lane stand together."""
    codes = embedding(prints)
    starts = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
    left = np.repeat(np.append(starts[1:], len(lane)), np.diff(np.append(starts, len(lane)))) - np.arange(len(lane)) - 1
    label = np.arange(len(prints))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, shift = 0, 1
    active = np.flatnonzero(left >= 1)
    while len(active):
        other = active + shift
        near = np.bitwise_count(codes[active] ^ codes[other]) <= limit  # the lower bound
        a, b = active[near], other[near]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= limit
        found.append((a[near], b[near]))
        held += len(found[-1][0])
        if held > 1_000_000:
            found, held = [tree(label, found)], 0
        shift += 1
        active = active[left[active] >= shift]
    return tree(label, found)


def tree(label: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    root = forest(len(label), a, b)
    inner = np.flatnonzero(root != label)
    return inner, root[inner]


def links(prints: DataFrame, limit: int = 4, fingerprint: str = "fingerprint", block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that reach each other over links of at most ``limit`` bits.

    Within a lane each fingerprint is tied to the first one that it reaches there, so that groups stay whole and there are
    no more pairs than members.
    """
    importable(prints)
    masks = cell_masks(limit)
    code = embedded(F.col(fingerprint))
    # a fingerprint's rows multiply here, so the tasks are not to be joined by their small input
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = prints.select(fingerprint).repartition(tasks, fingerprint).select(fingerprint, F.inline(F.array(*(
        F.struct(F.lit(i).cast("byte").alias("choice"), code.bitwiseAND(F.lit(signed(mask))).alias("cell"))
        for i, mask in enumerate(masks)))))
    sizes = cells.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(fingerprint, F.lit(7)), F.col("blocks")).cast("int")
    # Spark takes the cells for no more than their fingerprints, one row for each of the choices, and would broadcast them
    lanes = (cells.hint("merge").join(sizes, ["choice", "cell"]).withColumn("blocks", blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("lane", F.xxhash64("choice", "cell", F.least("own", "other"), F.greatest("own", "other"))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane_rest, print_rest = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def result(prints_, lane_):
            a, b = linked(prints_, lane_, limit)
            both = [pa.array(prints_[x].view(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays(both, ["a", "b"])

        for batch in batches:
            lane = np.concatenate([lane_rest, batch.column("lane").to_numpy()])
            own_prints = np.concatenate([print_rest, batch.column(fingerprint).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(lane, lane[-1])) if len(lane) else 0
            if whole:
                yield result(own_prints[:whole], lane[:whole])
            lane_rest, print_rest = lane[whole:], own_prints[whole:]
        if len(lane_rest):
            yield result(print_rest, lane_rest)

    dealt = lanes.select("lane", fingerprint).repartition("lane").sortWithinPartitions("lane")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node that it reaches.

    Large-star and small-star steps in turn, each written to the shared folder, until nothing changes.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = stage(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        now = stage(small.select("e.*").where("a <> b").distinct(), "small")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
    raise RuntimeError(f"groups not found within {rounds} rounds")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, limit: int = 4) -> DataFrame:
    """One row per row of ``df``: ``key``, fingerprint (16 hex digits) and component_id, the smallest key it reaches.

    Rows link at ``limit`` or fewer differing bits, equal fingerprints and the empty one included. Null texts count as
    empty; null keys are no component's id unless all keys of it are null. An empty table gives an empty result.
    """
    prints = stage(fingerprints(df.select(key, text), text, "_print", shingle).select(key, "_print"), "fingerprints")
    distinct = stage(prints.groupBy("_print").agg(F.min(key).alias("_least")), "distinct")
    tied = stage(links(distinct, limit, "_print"), "links")
    if tied.isEmpty():
        of_print = distinct.select("_print", F.col("_least").alias("component_id"))
    else:
        group = components(tied)
        rooted = distinct.join(group, distinct["_print"] == group["node"], "left").select(
            "_print", "_least", F.coalesce("root", "_print").alias("root"))
        rooted = stage(rooted, "rooted")
        least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
        of_print = rooted.join(least, "root").select("_print", "component_id")
    of_print = stage(of_print, "component")
    return prints.join(of_print, "_print").select(key, F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, limit: int = 4) -> DataFrame:
    """The rows of ``df`` that stay: of each group the one with the smallest key. Keys must be unique; a row without one stays.

    The rows that go are few as a rule, so Spark can send their keys around instead of shuffling the texts.
    """
    found = near_duplicates(df, key, text, shingle, limit)
    return df.join(found.where(F.col(key) != F.col("component_id")).select(key).distinct(), key, "left_anti")
