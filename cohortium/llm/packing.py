"""Best-fit packing of tokenised documents into sequences of a fixed length.

Lengths are whole numbers up to the sequence length, so the instance is a histogram whose size the sequence length bounds,
whatever the number of documents. On it

1. dominance reduction (Martello and Toth) fixes sequences that some optimal packing has: a piece with the exact
   complement, a piece that no other fits beside, and a piece with room for one more only, which takes the largest that fits;
2. the remainder is packed best-fit, longest pieces first, whole groups of equal sequences at a time.

The plan says which ranks of each length go to which sequences. Pieces get their rank within their length by counting per
part of the data, so a length that a third of all pieces share is spread over tasks.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .texts import importable, slices
from .token_counts import Vocabulary

SEQUENCE = 2048

LONG = 5000  # runs of characters that are left to the slower library, whose time does not grow with their square
BLANK_RUN = re.compile(r"\s{%d}" % LONG)


class Tokens:
    """Ids of whole texts as the ``tokenizers`` library has them for a byte-level BPE file.

    The same vocabulary, read as ranks, is given to ``tiktoken``, which gives the same ids in a third of the time.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = Vocabulary(path)
        merged = sorted((part[2], token) for token, part in vocabulary.parts.items())
        if [token for _, token in merged] != sorted(token for _, token in merged):
            raise ValueError("the ids of this vocabulary are not in the order of its merges")
        special = {text: self.library.token_to_id(text) for text in vocabulary.special}
        self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.id_of, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if len(text) > LONG and (max(map(len, text.split()), default=0) > LONG or BLANK_RUN.search(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, ``end`` behind each, and their sizes."""
        last = np.array([end], np.uint32)
        parts = [part for text in texts for part in (self.ids(text), last)]
        return np.concatenate(parts), np.array([len(part) + 1 for part in parts[::2]], np.int64)


_ready: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _ready:
        _ready[path] = Tokens(path)
    return _ready[path]


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, end: int = 0,
           keep_ids: bool = True) -> DataFrame:
    """The pieces of each document: ``key``, piece, start, length, ids_crc32 and, if wished, ids.

    A document is the ids of its whole text and ``end``; null counts as empty. One longer than ``length`` is cut so that
    only its first piece may be shorter. No shuffle.
    """
    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long" + (",ids:array<int>" if keep_ids else "") + ">>"

    importable(df)

    @F.arrow_udf(kind)
    def cut(column: pa.Array) -> pa.Array:
        ready = tokens(path)
        numbers, starts, sizes, sums, flats, counts = [], [], [], [], [], []
        for run in slices([t or "" for t in column.to_pylist()]):
            flat, size = ready.encode(run, end)
            flat = flat.astype("<i4")
            at = 0
            for n in size.tolist():
                edges = [0, *range(n % length or length, n + 1, length)] if n > length else [0, n]
                counts.append(len(edges) - 1)
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    numbers.append(i)
                    starts.append(a)
                    sizes.append(b - a)
                    sums.append(zlib.crc32(flat[at + a:at + b]))
                at += n
            flats.append(flat)
        columns = [pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
        names = ["piece", "start", "length", "ids_crc32"]
        if keep_ids:
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flats) if flats else np.zeros(0, np.int32), pa.int32())))
            names.append("ids")
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names))

    return df.select(key, F.inline(cut(F.col(text))))


@dataclass
class Group:
    """``count`` sequences alike, numbered from ``first``, with ``room`` left; (length, copies) lie one behind another."""

    first: int
    count: int
    room: int
    content: list[tuple[int, int]] = field(default_factory=list)

    def with_pieces(self, first: int, count: int, size: int, copies: int) -> Group:
        return Group(first, count, self.room - size * copies, [*self.content, (size, copies)])


def reduce(counts: dict[int, int], length: int) -> list[tuple[int, list[int]]]:
    """Sequences that dominance fixes, as (number, lengths); ``counts`` keeps the rest of the instance."""
    fixed: list[tuple[int, list[int]]] = []

    def fix(number: int, sizes: list[int]):
        fixed.append((number, sizes))
        for size in sizes:
            counts[size] -= number
            if not counts[size]:
                del counts[size]

    if counts.get(length):
        fix(counts[length], [length])
    for size in sorted(counts):  # a piece and its complement: no other sequence with that piece holds more
        other = length - size
        if size < other and other in counts:
            fix(min(counts[size], counts[other]), [size, other])
    if counts.get(length // 2, 0) > 1 and length % 2 == 0:
        fix(counts[length // 2] // 2, [length // 2, length // 2])
    while counts:
        sizes = sorted(counts)
        big = sizes[-1]
        rest = length - big
        beside = sizes if counts[big] > 1 else sizes[:-1]
        if not beside or beside[0] > rest:  # nothing fits beside it
            fix(counts[big], [big])
            continue
        copies = counts[beside[0]] - (beside[0] == big)
        second = beside[0] if copies > 1 else beside[1] if len(beside) > 1 else length
        if beside[0] + second <= rest:  # two more may fit: no single piece need be the best
            break
        mate = beside[bisect_left(beside, rest + 1) - 1]
        # fixing pieces only makes the smallest two larger, so the tests hold for all of these
        fix(counts[big] // 2 if mate == big else min(counts[big], counts[mate]), [big, mate])
    return fixed


def plan(histogram: dict[int, int], length: int = SEQUENCE) -> list[Group]:
    """Groups of equal sequences that hold all pieces of ``histogram`` (length -> number of pieces)."""
    counts = {size: n for size, n in histogram.items() if n}
    if counts and not 0 < min(counts) <= max(counts) <= length:
        raise ValueError("lengths must lie between 1 and the sequence length")
    groups, next_id = [], 0
    for number, sizes in reduce(counts, length):
        groups.append(Group(next_id, number, length - sum(sizes), [(size, 1) for size in sizes]))
        next_id += number
    opened: dict[int, list[Group]] = {}
    rooms: list[int] = []  # sorted, of ``opened``

    def put(group: Group):
        if group.room not in opened:
            opened[group.room] = []
            insort(rooms, group.room)
        opened[group.room].append(group)

    for group in groups:  # reduction may leave room that nothing fits now; keep it open all the same
        put(group)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = length // size
                full, over = divmod(left, per)
                for number, copies in ((full, per), (1 if over else 0, over)):
                    if number:
                        put(Group(next_id, number, length - size * copies, [(size, copies)]))
                        next_id += number
                left = 0
                break
            room = rooms[at]
            group = opened[room].pop()
            if not opened[room]:
                del opened[room]
                rooms.pop(at)
            per = room // size  # best fit goes on with the sequence that it has just made fuller
            full = min(group.count, left // per)
            first, count = group.first, group.count
            if full:
                put(group.with_pieces(first, full, size, per))
                left -= full * per
                first, count = first + full, count - full
            if count and left and left < per:
                put(group.with_pieces(first, 1, size, left))
                first, count, left = first + 1, count - 1, 0
            if count:
                put(Group(first, count, group.room, group.content))
    return [group for same in opened.values() for group in same]


def placements(groups: list[Group]) -> pd.DataFrame:
    """For each length, runs of ranks: length, rank (first of the run), first (sequence), copies per sequence, offset."""
    lines, used = [], {}
    for group in sorted(groups, key=lambda g: g.first):
        offset = 0
        for size, copies in group.content:
            rank = used.get(size, 0)
            lines.append((size, rank, group.first, copies, offset))
            used[size] = rank + group.count * copies
            offset += size * copies
    return pd.DataFrame(lines, columns=["length", "rank", "first", "copies", "offset"], dtype="int64").sort_values(["length", "rank"])


def pack(made: DataFrame, length: int = SEQUENCE, size: str = "length") -> DataFrame:
    """``made`` (one row per piece, with its length) with sequence_id (from 0) and offset in the sequence.

    The rows are written once to the shared folder. What reaches the driver is one number per length, and what it sends
    out is the plan: a few lines per length. An empty table gives an empty result.
    """
    spark = made.sparkSession
    made = stage(made.withColumn("_part", F.spark_partition_id()), "pieces")
    counts = made.groupBy("_part", size).agg(F.count(F.lit(1)).alias("_n"))
    histogram = {int(r[0]): int(r[1]) for r in made.groupBy(size).agg(F.count(F.lit(1))).collect()}
    table = placements(plan(histogram, length))
    before = Window.partitionBy(size).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("_part", size).orderBy(F.monotonically_increasing_id())
    ranked = made.withColumn("_at", F.row_number().over(within)).join(counts, ["_part", size])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_at") - 1)
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def place(sizes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        plan = sent.value
        keys = plan["length"].to_numpy() << 48 | plan["rank"].to_numpy()
        line = np.searchsorted(keys, sizes.to_numpy() << 48 | ranks.to_numpy(), side="right") - 1
        run = plan.iloc[line]
        along = ranks.to_numpy() - run["rank"].to_numpy()
        copies = run["copies"].to_numpy()
        return pd.DataFrame({"sequence_id": run["first"].to_numpy() + along // copies,
                             "offset": run["offset"].to_numpy() + along % copies * sizes.to_numpy()})

    placed = ranked.withColumn("_placed", place(F.col(size).cast("long"), F.col("_rank")))
    return placed.select(*(c for c in made.columns if c != "_part"), "_placed.*")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids. A sequence is bounded, so is each group."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
