"""How five filters overlap: what each removes in any order, from one count of documents per set of filters they fail.

Four filters look at a text alone. The fifth drops texts of which the table has a smaller id, wherever that row stands, so it
is settled only when all files are read. The table's files are read as a stream of micro-batches, all that are available and
then no more. Keyed state holds, for each text's digest, the smallest id so far. Rows with larger ids fail the filter; where
a smaller id arrives, the count that its forerunner had without the failure is taken back (-1) and made anew with it (+1). The
sums of all such changes are the counters, whatever the order of the files. A state entry is a cell of about ``CELL`` digests,
as a call of Python for each text alone costs milliseconds; the number of cells follows the number of rows.

Copies of one text are combined inside each task before they are sent to the state, so that a text with any share of the rows
sends one candidate per task. A batch writes the sums of its changes under its own number, which a repeated batch
overwrites: a restart from the checkpoint counts nothing twice. The state is checkpointed to the shared folder. Where a
partition of it would outgrow what an instance of RocksDB takes anyway, it lives in RocksDB on disk, else in memory, unless the
session names a store; the counters are the same.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, fresh_path, stage
from .texts import importable

FILTERS = "ABCDE"
COPY = 16  # the bit of the fifth filter
WORDS, DISTINCT, CAPITALS = 50, 65, 5  # least words, distinct ones in 100, most capitals in 100
MARKS, CAPITAL, INNER = b"#$%&*|", bytes(range(65, 91)), bytes(range(128, 192))  # INNER: bytes of a character after its first
LAST = (1 << 63) - 1  # stands for the key of rows that take no part in the comparison
STORE_ROWS = 50_000  # rows of a state partition from which it lives in RocksDB
CELL = 1024  # texts in a state entry, about
BATCHES = 4  # micro-batches that a table is read in, fewer where it has fewer files
FOUND = "digest binary, id long, part string, flags int, mask int, n long, settled boolean"
TOLD = "struct<digest:binary,mask:int>"
CHANGES = "part string, flags int, mask int, n long"
CHANGED, HELD = ["part", "flags", "mask", "n"], ["digest", "id", "part", "flags", "mask", "n"]
STATE = "held binary"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fails(text: bytes) -> int:
    """The filters A to D that a text fails, as bits 1, 2, 4, 8."""
    words = text.split()
    characters = len(text.translate(None, INNER))
    capitals = len(text) - len(text.translate(None, CAPITAL))
    return ((len(words) < WORDS) + 2 * (100 * len(set(words)) < DISTINCT * len(words)) + 4 * (100 * capitals > CAPITALS * characters)
            + 8 * (len(text.translate(None, MARKS)) < len(text)))


def told(texts: pa.Array) -> pa.Array:
    """Digest and failed filters of each text."""
    digests, masks = [], []
    for text in texts:
        own = text.as_py() or b""
        digests.append(hashlib.sha256(own).digest())
        masks.append(fails(own))
    return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], ["digest", "mask"])


def combined(rows: pd.DataFrame) -> pd.DataFrame:
    """Candidate rows of the smallest id of each text, and settled rows of all others, summed.

    Settled rows travel with some text's key, as they belong to none.
    """
    rows = rows.reset_index(drop=True)
    least = rows["id"].where(~rows["settled"], LAST).groupby(rows["digest"]).transform("min")
    late = ~rows["settled"] & (rows["id"] > least)
    settled = rows[late | rows["settled"]].copy()
    settled.loc[late, "mask"] |= COPY
    own = rows[~late & ~rows["settled"]].groupby(["digest", "id", "part", "flags", "mask"], sort=False, as_index=False)["n"].sum()
    settled = settled.groupby(["part", "flags", "mask"], sort=False, as_index=False)["n"].sum()
    settled["digest"] = rows["digest"].iloc[0] if len(rows) else None
    return pd.concat([own.assign(settled=False), settled.assign(id=0, settled=True)])[rows.columns]


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``combined`` over all batches of a task."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch.to_pandas())
        rows += batch.num_rows
        if rows > 1 << 17:
            held = [combined(pd.concat(held))]
            rows = 0
    schema = None
    if held:
        made = combined(pd.concat(held))
        schema = pa.schema([("digest", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("flags", pa.int32()),
                            ("mask", pa.int32()), ("n", pa.int64()), ("settled", pa.bool_())])
        yield from pa.Table.from_pandas(made, schema=schema, preserve_index=False).to_batches()


def retracting(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Changes of the counters by a cell's new rows. Its state is a table of the rows that have the smallest id of their text."""
    rows = pd.concat(list(frames))
    settled, new = rows[rows["settled"]], rows[~rows["settled"]]
    changes = [settled[CHANGED]]
    if len(new):
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else new[HELD].iloc[:0]
        both = pd.concat([held.assign(old=True), new[HELD].assign(old=False)], ignore_index=True)
        least = both["id"] == both.groupby("digest")["id"].transform("min")
        stays, late, gone = both[~both["old"] & least], both[~both["old"] & ~least], both[both["old"] & ~least]
        late, again = late.assign(mask=late["mask"] | COPY), gone.assign(mask=gone["mask"] | COPY)
        changes += [part[CHANGED] for part in (stays, late, gone.assign(n=-gone["n"]), again)]
        kept = both[least].groupby(HELD[:-1], sort=False, as_index=False)["n"].sum()
        table, sink = pa.Table.from_pandas(kept, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
    yield pd.concat(changes).groupby(CHANGED[:-1], sort=False, as_index=False)["n"].sum()[CHANGED]


def stream_of(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """A stream of the Parquet files at ``path`` (a folder or one file) in about ``batches`` micro-batches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if not files.getFileStatus(where).isDirectory():
        return reader.option("pathGlobFilter", where.getName()).parquet(str(where.getParent()))
    count = sum(status.isFile() for status in files.listStatus(where))
    return reader.option("maxFilesPerTrigger", max(1, -(-count // batches))).parquet(path)


def part_counters(spark: SparkSession, path: str, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source",
                  good: str = "quality", toxic: str = "toxic", batches: int = BATCHES) -> DataFrame:
    """(part, mask, n, n_good, n_toxic) of the Parquet table at ``path``: documents of each part by the filters they fail.

    Bits of mask, from 1 on: fewer than 50 words; under 65 distinct words in 100; over 5 capitals in 100 characters; any of
    ``#$%&*|``; a text of which the table has a row with a smaller key. A null text counts as empty, a null part as the empty
    string. A null key is smaller than none and larger than none: its row never fails the last filter and makes no other fail.
    Rows of equal key and text are counted each. A document is good or toxic where any of its labels is 1. An empty table gives
    an empty result. Other columns are not read.
    """
    importable(labels)
    docs = stream_of(spark, path, batches).select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.arrow_udf(told, TOLD)(F.col(text).cast("binary")).alias("told"))
    docs = docs.select("id", "part", "told.digest", "told.mask")
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(
        F.max((F.col(good) == 1).cast("int") + 0).alias("good"), F.max((F.col(toxic) == 1).cast("int") + 0).alias("toxic"))
    docs = docs.join(known, "id", "left").select(
        "digest", F.coalesce("id", F.lit(0)).alias("id"), "part", (F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))).alias("flags"),
        "mask", F.lit(1).cast("long").alias("n"), F.col("id").isNull().alias("settled"))
    rows = spark.read.parquet(path).count()
    cells = max(1, rows // CELL)
    dealt = docs.mapInArrow(combine, FOUND).withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells)))
    changes = dealt.groupBy("cell").applyInPandasWithState(retracting, CHANGES, STATE, "update", "NoTimeout")

    out, progress = fresh_path(spark, "audit-changes"), fresh_path(spark, "audit-progress")

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "flags", "mask").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    own_store = spark.conf.get(STORE, None) is None and rows > STORE_ROWS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    if own_store:
        spark.conf.set(STORE, ROCKS)
    try:
        changes.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    finally:
        if own_store:
            spark.conf.unset(STORE)
    spark.createDataFrame([], CHANGES).write.parquet(f"{out}/batch=-1")  # so that a table without files has counters too
    sums = spark.read.schema(CHANGES).parquet(out).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("flags").bitwiseAND(1) > 0, F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("flags").bitwiseAND(2) > 0, F.col("n")).otherwise(0)).alias("n_toxic"))
    counted = stage(sums.where("n <> 0"), "audit-counters")
    for path in (out, progress):
        delete(spark, path)
    return counted


def interactions(counters: DataFrame) -> DataFrame:
    """Part, filter_order (each of the 120 permutations of ABCDE, from left to right) and step (1 to 5, the filter at that place).

    Beside them kept, removed, redundant (failing the step's filter, removed before), unique_fails (failing it alone), good_lost
    and toxic_lost (of those removed), shapley (removed by the filter, summed over all orders). ``counters``: of ``part_counters``.
    """
    steps = [{"filter_order": "".join(order), "step": at + 1, "bit": 1 << FILTERS.index(order[at]),
              "before": sum(1 << FILTERS.index(f) for f in order[:at])}
             for order in itertools.permutations(FILTERS) for at in range(len(order))]
    places = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    parts = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("sets"))  # at most 32
    rows = parts.select("part", "sets", F.inline(places))

    def total(of, condition) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda s, x: s + F.when(condition(x["mask"]), of(x)).otherwise(0))

    def hits(mask):
        return mask.bitwiseAND(F.col("bit")) != 0

    def first(mask):
        return hits(mask) & (mask.bitwiseAND(F.col("before")) == 0)

    n = lambda x: x["n"]
    shared = lambda x: F.expr("120") * x["n"] / F.bit_count(x["mask"])
    return rows.select(
        "part", "filter_order", "step", total(n, lambda m: m.bitwiseAND(F.col("before").bitwiseOR(F.col("bit"))) == 0).alias("kept"),
        total(n, first).alias("removed"), total(n, lambda m: hits(m) & (m.bitwiseAND(F.col("before")) != 0)).alias("redundant"),
        total(n, lambda m: m == F.col("bit")).alias("unique_fails"), total(lambda x: x["n_good"], first).alias("good_lost"),
        total(lambda x: x["n_toxic"], first).alias("toxic_lost"), total(lambda x: shared(x).cast("long"), hits).alias("shapley"))
