"""Exact nearest donors without pairing every receiver with every donor.

Donors are laid out in small boxes of feature space (k-d splits learnt from samples). A receiver
first looks into its own box; its k-th distance then tells which other boxes could hold a nearer
donor, and only those are visited. The samples shape the boxes and nothing else: no donor is left
out. Spark partitions and shuffles the boxes; numpy compares the rows inside one box.

The split tree has two levels. The upper one, of a bounded number of top boxes, is learnt and kept on
the driver; each top box is split further in a Spark group of its own, and its tree and outlines
stay in a table that is joined by top box. What the driver holds does not grow with the donors.

A distance is the missing-aware squared Euclidean one: over the features both rows have, scaled up
by all / shared features. Equal distances are ordered by donor key.
"""

from __future__ import annotations

import json
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import small_side, stage, unstage

SAMPLE_PER_BOX = 32
LEAF_ROWS = 64  # donors that are compared at once inside a box
INDEX = "nodes string, features array<string>, vector boolean, k int, box_rows int, mean double, deep boolean"

# the helpers travel with the tasks, so workers need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _learn_splits(points: np.ndarray, boxes: int) -> list[tuple]:
    """k-d splits as (axis, cut, left, right) or (box,) nodes. Missing values sort first."""
    nodes: list = []
    count = [0]

    def grow(rows: np.ndarray, want: int) -> int:
        at = len(nodes)
        nodes.append(None)
        axis = cut = None
        if want > 1 and len(rows) > 1:
            filled = np.where(np.isnan(rows), -np.inf, rows)
            known = np.where(np.isnan(rows), np.nanmin(points, axis=0, initial=0.0), rows)
            for candidate in np.argsort(-known.std(axis=0), kind="stable"):
                values = np.unique(filled[:, candidate])
                if len(values) > 1:
                    axis = int(candidate)
                    middle = np.sort(filled[:, axis])[len(rows) // 2]
                    cut = middle if middle > values[0] else values[1]
                    break
        if axis is None:
            nodes[at] = (count[0],)
            count[0] += 1
            return at
        left = filled[:, axis] < cut
        nodes[at] = (axis, float(cut), grow(rows[left], want // 2), grow(rows[~left], want - want // 2))
        return at

    grow(points, boxes)
    return nodes


def _box_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), dtype=np.int32)
    filled = np.where(np.isnan(points), -np.inf, points)
    pending = [(0, np.arange(len(points)))]
    while pending:
        at, rows = pending.pop()
        node = nodes[at]
        if len(node) == 1:
            out[rows] = node[0]
        elif len(rows):
            left = filled[rows, node[0]] < node[1]
            pending += [(node[2], rows[left]), (node[3], rows[~left])]
    return out


def _outlines(nodes: list[tuple], leaves: tuple) -> tuple:
    """(low, high, filled, some, used) of every node, from those of the boxes below it."""
    ids, *leaf = leaves
    width = leaf[0].shape[1]
    low, high = np.full((len(nodes), width), np.inf), np.full((len(nodes), width), -np.inf)
    filled, some = np.ones((len(nodes), width), bool), np.zeros((len(nodes), width), bool)
    used = np.zeros(len(nodes), bool)
    row_of = {int(b): i for i, b in enumerate(ids)}
    for at in range(len(nodes) - 1, -1, -1):  # children come behind their parent
        node = nodes[at]
        if len(node) == 1:
            i = row_of.get(node[0])
            if i is not None:
                low[at], high[at], filled[at], some[at] = (x[i] for x in leaf)
                used[at] = True
            continue
        a, b = node[2], node[3]
        low[at], high[at] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
        filled[at], some[at], used[at] = filled[a] & filled[b], some[a] | some[b], used[a] | used[b]
    return low, high, filled, some, used


def _met(nodes: list[tuple], outlines: tuple, points: np.ndarray, home: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, box) for the boxes, a point's own left out, that may hold a donor within its reach: down the tree, all points at once.

    Boxes that share no known feature with a point hold nothing that compares with it.
    """
    low, high, filled, some, used = outlines
    width = points.shape[1]
    met_rows, met_boxes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    known = ~np.isnan(points)
    pending = [(0, np.arange(len(points)))]
    while pending:
        at, rows = pending.pop()
        if not used[at]:
            continue
        shared = (known[rows] & some[at]).sum(axis=1)
        rows, shared = rows[shared > 0], shared[shared > 0]
        # a feature bounds the distance only if the receiver and every donor below have it
        bounding = known[rows] & filled[at]
        own = np.where(bounding, points[rows], 0.0)
        gap = np.where(bounding, np.maximum(np.maximum(np.where(bounding, low[at], 0.0) - own, own - np.where(bounding, high[at], 0.0)), 0.0), 0.0)
        rows = rows[(gap * gap).sum(axis=1) * (width / shared) <= reach[rows] * (1 + 1e-9)]
        if not len(rows):
            continue
        node = nodes[at]
        if len(node) == 1:
            away = rows[home[rows] != node[0]]
            met_rows.append(away)
            met_boxes.append(np.full(len(away), node[0]))
        else:
            pending += [(node[2], rows), (node[3], rows)]
    return np.concatenate(met_rows), np.concatenate(met_boxes)


def _reachable(nodes: list[tuple], outlines: tuple, points: np.ndarray, home: np.ndarray, reach: np.ndarray) -> list[list[int]]:
    """For each point its boxes of ``_met``."""
    row, box = _met(nodes, outlines, points, home, reach)
    order = np.argsort(row, kind="stable")
    ends = np.cumsum(np.bincount(row, minlength=len(points)))
    return [part.tolist() for part in np.split(box[order], ends)[:len(points)]]


def _k_nearest(r: np.ndarray, d: np.ndarray, k: int):
    """Rows (receiver index, donor index, distance); donors must come in key order.

    The donors of a large group are split into leaves: a receiver is compared with its own leaf, then with those that could hold
    something nearer. The rows found are those of comparing all with all.
    """
    if len(d) < 4 * LEAF_ROWS or len(r) < LEAF_ROWS:
        return _compare_all(r, d, k)
    nodes = _learn_splits(d, math.ceil(len(d) / LEAF_ROWS))
    at, home = _box_of(nodes, d), _box_of(nodes, r)
    order = np.argsort(at, kind="stable")  # inside a leaf in key order
    starts = np.flatnonzero(np.diff(at[order], prepend=-1))  # every leaf has donors
    parts, by_leaf = np.split(order, starts[1:]), d[order]
    gone = np.isnan(by_leaf)
    known = np.add.reduceat(~gone, starts, axis=0, dtype=np.int64)
    outlines = _outlines(nodes, (np.arange(len(starts)), np.minimum.reduceat(np.where(gone, np.inf, by_leaf), starts, axis=0),
                                 np.maximum.reduceat(np.where(gone, -np.inf, by_leaf), starts, axis=0),
                                 known == np.fromiter(map(len, parts), np.int64)[:, None], known > 0))

    def visit(rows: np.ndarray, leaves: np.ndarray) -> list[np.ndarray]:
        found, by = [[np.empty(0, np.int64)] * 2 + [np.empty(0)]], np.argsort(leaves, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(leaves[by])) + 1):
            if len(some):
                members = parts[leaves[some[0]]]
                i, j, distance = _compare_all(r[rows[some]], d[members], k)
                found.append((rows[some][i], members[j], distance))
        return [np.concatenate(x) for x in zip(*found)]

    own = visit(np.arange(len(r)), home)
    reach, farthest = np.full(len(r), np.inf), np.zeros(len(r))
    np.maximum.at(farthest, own[0], own[2])
    full = np.bincount(own[0], minlength=len(r)) >= k
    reach[full] = farthest[full]
    row, leaf = _met(nodes, outlines, r, home, reach)
    if len(row) > len(r) * len(starts) / 4:  # in many dimensions the leaves tell little
        return _compare_all(r, d, k)
    i, j, distance = (np.concatenate(x) for x in zip(own, visit(row, leaf)))
    by = np.lexsort((j, distance, i))
    i, j, distance = i[by], j[by], distance[by]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return [i[keep], j[keep], distance[keep]]


def _compare_all(r: np.ndarray, d: np.ndarray, k: int):
    """Rows (receiver index, donor index, distance) of the k nearest, from all pairs; donors must come in key order."""
    width, step = r.shape[1], max(1, 2_000_000 // max(1, len(d)))
    gaps = np.isnan(r).any() or np.isnan(d).any()
    found = []
    for start in range(0, len(r), step):
        part = r[start:start + step]
        total = np.zeros((len(part), len(d)))
        shared = np.zeros((len(part), len(d))) if gaps else None
        for j in range(width):
            diff = part[:, j, None] - d[None, :, j]
            if gaps:
                both = ~np.isnan(diff)
                shared += both
                diff = np.where(both, diff, 0.0)
            total += diff * diff
        if gaps:
            with np.errstate(divide="ignore", invalid="ignore"):
                total = np.where(shared > 0, total * (width / shared), np.inf)
        if len(d) > k:
            kth = np.partition(total, k - 1, axis=1)[:, k - 1, None]
            nearer, ties = total < kth, total == kth
            keep = nearer | (ties & (np.cumsum(ties, axis=1) <= k - nearer.sum(axis=1, keepdims=True)))
        else:
            keep = np.ones(total.shape, dtype=bool)
        keep &= np.isfinite(total)
        i, j = np.nonzero(keep)
        found.append((i + start, j, total[i, j]))
    return [np.concatenate(x) for x in zip(*found)]


def _block(x: pd.Series, width: int) -> np.ndarray:
    return np.array(x.tolist(), dtype=float).reshape(-1, width)


def _by_top(df: DataFrame, key: str, beside: DataFrame, rows: int):
    """``df`` by (top, lane), cogrouped with ``beside``, which has one row for each top box.

    A top box has as many lanes as keep a group near ``rows`` rows. One count per top box reaches the driver.
    """
    counts = df.groupBy("top").agg(F.count(F.lit(1)).alias("n")).collect()
    lanes = F.broadcast(df.sparkSession.createDataFrame(
        [(r["top"], math.ceil(r["n"] / rows)) for r in counts], "top int, lanes int"))
    dealt = df.join(lanes, "top").withColumn("lane", F.pmod(F.xxhash64(key), F.col("lanes")).cast("int")).drop("lanes")
    copies = (beside.join(lanes, "top").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
              .drop("lanes"))
    return dealt.groupBy("top", "lane").cogroup(copies.groupBy("top", "lane"))


def _sub_trees(donors: DataFrame, share: float, box_rows: int, width: int) -> DataFrame:
    """(top, tree): the splits of each top box, learnt in its own group from some rows per box."""
    sizes = donors.groupBy("top").agg(F.count(F.lit(1)).alias("size"))
    some = donors.select("top", "x").sample(min(1.0, share), seed=11).join(F.broadcast(sizes), "top")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = _learn_splits(_block(rows["x"], width), math.ceil(rows["size"].iat[0] / box_rows))
        return pd.DataFrame({"top": rows["top"].iloc[:1].to_numpy(), "tree": [json.dumps(nodes)]})

    return some.groupBy("top").applyInPandas(learn, "top int, tree string")


def _with_box(df: DataFrame, key: str, trees: DataFrame, rows: int, width: int) -> DataFrame:
    """``df`` with its box: the top box and, below it, the box of that top box's tree. Without a tree, the top box is all."""
    def place(points: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        below = np.zeros(len(points), np.int64)
        if len(tree) and len(points):
            below = _box_of(json.loads(tree["tree"].iat[0]), _block(points["x"], width)).astype(np.int64)
        return points.drop(columns="lane").assign(box=(points["top"].to_numpy(np.int64) << 32) + below)

    fields = [*df.schema.fields, T.StructField("box", T.LongType())]
    return _by_top(df, key, trees, rows).applyInPandas(place, T.StructType(fields))


def _leaf_outlines(stats: pd.DataFrame, ids: np.ndarray, width: int) -> tuple:
    """(ids, low, high, filled, some) of boxes from their statistics."""
    side = lambda name: np.stack([stats[f"{name}{j}"].to_numpy(float) for j in range(width)], axis=1)
    known, n = side("c"), stats["n"].to_numpy(float)[:, None]
    return ids, side("lo"), side("hi"), known == n, known > 0


def _points(df: DataFrame, features: list[str] | str):
    """The features as one array of doubles, NaN for null: columns, or one vector column."""
    if isinstance(features, str):
        return vector_to_array(F.col(features))
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


class DonorIndex:
    """Donors in their boxes: laid out once, asked any number of times, saved and loaded.

    ``donors`` (donor, value, x, top, box), ``stats`` (one row per box) and ``trees`` (the splits below each top box, none
    if the top boxes are all there are) are tables in the shared folder. The driver holds some 40 sampled donors and one
    outline for each of at most ``top_boxes`` top boxes; below them the boxes follow the donors, about ``box_rows`` in each.
    Of donors with equal features the first ``k`` by key are kept, as no other can be chosen. Rows are unique by key.
    """

    def __init__(self, donors: DataFrame, stats: DataFrame, trees: DataFrame | None, nodes: list, features: list[str] | str,
                 k: int, box_rows: int, mean: float | None):
        self.donors, self.stats, self.trees, self.nodes = donors, stats, trees, nodes
        self.features, self.k, self.box_rows, self.mean = features, k, box_rows, mean

    @staticmethod
    def build(donors: DataFrame, key: str, value: str, features: list[str] | str, k: int = 5, box_rows: int = 2048,
              top_boxes: int = 1024) -> "DonorIndex":
        spark = donors.sparkSession
        donors = donors.select(F.col(key).alias("donor"), F.col(value).cast("double").alias("value"), _points(donors, features).alias("x"))
        rank = F.row_number().over(Window.partitionBy("x").orderBy("donor"))
        # the mean is that of all donors, those included that can never be chosen
        mean = donors.agg(F.avg("value")).first()[0]
        donors = stage(donors.withColumn("r", rank).where(F.col("r") <= k).drop("r"), "donors")
        total, width = donors.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        if not total:
            return DonorIndex(donors, None, None, [], features, k, box_rows, mean)
        boxes = math.ceil(total / box_rows)
        tops = min(boxes, top_boxes)
        per_box = 1.2 * SAMPLE_PER_BOX / total
        sample = donors.select("x").sample(min(1.0, per_box * tops), seed=7).toPandas()["x"]
        nodes = _learn_splits(_block(sample, width), tops)
        routed = DonorIndex._routed(donors, spark.sparkContext.broadcast(nodes), width)
        trees = None
        if boxes > tops:
            above = stage(routed, "donors")
            trees = stage(_sub_trees(above, per_box * boxes, box_rows, width), "trees")
            placed = stage(_with_box(above, "donor", trees, 16 * box_rows, width), "donors")
            unstage(donors, above)
        else:
            placed = stage(routed.withColumn("box", F.shiftleft(F.col("top").cast("long"), 32)), "donors")
            unstage(donors)
        shape = [F.count(F.lit(1)).alias("n")]
        for j in range(width):
            v = F.when(~F.isnan(F.col("x")[j]), F.col("x")[j])
            shape += [F.min(v).alias(f"lo{j}"), F.max(v).alias(f"hi{j}"), F.count(v).alias(f"c{j}")]
        stats = stage(placed.groupBy("top", "box").agg(*shape), "outlines")  # one row per box
        return DonorIndex(placed, stats, trees, nodes, features, k, box_rows, mean)

    @staticmethod
    def _routed(df: DataFrame, nodes, width: int) -> DataFrame:
        @F.pandas_udf("int")
        def top_of(x: pd.Series) -> pd.Series:
            return pd.Series(_box_of(nodes.value, _block(x, width)))

        return df.withColumn("top", top_of("x"))

    def save(self, path: str) -> None:
        """The boxes as Parquet in the order of their numbers, the split trees and outlines beside them."""
        spark = self.donors.sparkSession
        row = (json.dumps(self.nodes), [self.features] if isinstance(self.features, str) else list(self.features),
               isinstance(self.features, str), self.k, self.box_rows, self.mean, self.trees is not None)
        spark.createDataFrame([row], INDEX).write.mode("overwrite").json(f"{path}/index")
        donors = self.donors.repartitionByRange("box").sortWithinPartitions("box") if self.nodes else self.donors
        donors.write.mode("overwrite").parquet(f"{path}/donors")
        for name in ("stats", "trees"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str) -> "DonorIndex":
        row = spark.read.schema(INDEX).json(f"{path}/index").first()
        nodes = json.loads(row["nodes"])
        read = lambda name, there: spark.read.parquet(f"{path}/{name}") if there else None
        return DonorIndex(read("donors", True), read("stats", bool(nodes)), read("trees", row["deep"]), nodes,
                          row["features"][0] if row["vector"] else row["features"], row["k"], row["box_rows"], row["mean"])

    def nearest(self, receivers: DataFrame, key: str) -> DataFrame:
        """(key, nearest): for each receiver its k nearest donors as array of (distance, donor, value).

        Runs small jobs to route the receivers; the result is lazy.
        """
        spark, k, box_rows = receivers.sparkSession, self.k, self.box_rows
        receivers = receivers.select(F.col(key).alias("receiver"), _points(receivers, self.features).alias("x"))
        if not self.nodes:
            kind = self.donors.schema["donor"].dataType.simpleString()
            return receivers.select(F.col("receiver").alias(key), F.array().cast(
                f"array<struct<d:double,donor:{kind},value:double>>").alias("nearest"))
        width = sum(name.startswith("lo") for name in self.stats.columns)
        nodes, deep, lane = spark.sparkContext.broadcast(self.nodes), self.trees is not None, 16 * box_rows
        asked = self._routed(receivers, nodes, width)
        if deep:
            above = stage(asked, "receivers")
            asked = stage(_with_box(above, "receiver", self.trees, lane, width), "receivers")
            unstage(above)
        else:
            asked = stage(asked.withColumn("box", F.shiftleft(F.col("top").cast("long"), 32)), "receivers")
        first = stage(_visit(asked, self.donors, self.stats, k, box_rows), "visits")
        if len(self.nodes) == 1 and not deep:
            unstage(asked)
            return _best(first, k).select(F.col("receiver").alias(key), "nearest")
        # every receiver goes on, also one whose own box gave nothing
        met = asked.join(_best(first, k), "receiver", "left")
        bound = F.when(F.size("nearest") >= k, F.element_at("nearest", -1)["d"]).otherwise(F.lit(float("inf")))
        met = met.withColumn("bound", bound)

        merged = [F.sum("n").alias("n")]
        for j in range(width):
            merged += [F.min(f"lo{j}").alias(f"lo{j}"), F.max(f"hi{j}").alias(f"hi{j}"), F.sum(f"c{j}").alias(f"c{j}")]
        tops_met = self.stats.groupBy("top").agg(*merged).toPandas()  # one row per top box
        outlines = spark.sparkContext.broadcast(
            _outlines(self.nodes, _leaf_outlines(tops_met, tops_met["top"].to_numpy(), width)))

        @F.pandas_udf("array<int>")
        def others(x: pd.Series, home: pd.Series, limit: pd.Series) -> pd.Series:
            return pd.Series(_reachable(nodes.value, outlines.value, _block(x, width), home.to_numpy(), limit.to_numpy(float)))

        # a top box that is split has more than the box already visited, so that the receiver's own one counts too
        home = F.lit(-1) if deep else F.col("top")
        onward = met.select("receiver", "x", "bound", F.col("box").alias("home"), F.explode(others("x", home, "bound")).alias("top"))
        if deep:
            above = stage(onward, "onward")
            onward = stage(_boxes_below(above, self.stats, self.trees, lane, width), "onward")
            unstage(above)
        else:
            onward = stage(onward.select("receiver", "x", F.shiftleft(F.col("top").cast("long"), 32).alias("box")), "onward")
        unstage(asked)
        second = _visit(onward, self.donors, self.stats, k, box_rows)
        return _best(first.unionByName(second), k).select(F.col("receiver").alias(key), "nearest")


def nearest_donors(receivers: DataFrame, donors: DataFrame, key: str, value: str, features: list[str] | str,
                   k: int = 5, box_rows: int = 2048, top_boxes: int = 1024) -> DataFrame:
    """(key, nearest): for each receiver its k nearest donors as array of (distance, donor, value); see ``DonorIndex``."""
    return DonorIndex.build(donors, key, value, features, k, box_rows, top_boxes).nearest(receivers, key)


def _boxes_below(onward: DataFrame, stats: DataFrame, trees: DataFrame, rows: int, width: int) -> DataFrame:
    """(receiver, x, box) for each box in the receiver's top boxes, its own left out, that may hold a nearer donor."""
    def outline(tree: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        if tree.empty or boxes.empty:
            return pd.DataFrame({"top": [], "tree": []})
        nodes = json.loads(tree["tree"].iat[0])
        found = _outlines(nodes, _leaf_outlines(boxes, boxes["box"].to_numpy() & 0xFFFFFFFF, width))
        return pd.DataFrame({"top": tree["top"].to_numpy(), "tree": [cloudpickle.dumps((nodes, found))]})

    drawn = stage(trees.groupBy("top").cogroup(stats.groupBy("top")).applyInPandas(outline, "top int, tree binary"), "outlines")
    kind = onward.schema["receiver"].dataType
    out = T.StructType([T.StructField("receiver", kind), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("box", T.LongType())])

    def descend(points: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        top, home = points["top"].to_numpy(np.int64), points["home"].to_numpy(np.int64)
        if tree.empty:  # a top box without a tree is one box
            away = points[home != top << 32]
            return pd.DataFrame({"receiver": away["receiver"], "x": away["x"], "box": away["top"].to_numpy(np.int64) << 32})
        nodes, found = cloudpickle.loads(tree["tree"].iat[0])
        own = np.where(home >> 32 == top, home & 0xFFFFFFFF, -1)
        boxes = _reachable(nodes, found, _block(points["x"], width), own, points["bound"].to_numpy(float))
        lengths = np.fromiter(map(len, boxes), np.int64, len(boxes))
        at = np.repeat(np.arange(len(points)), lengths)
        below = np.fromiter((b for some in boxes for b in some), np.int64, len(at))
        return pd.DataFrame({"receiver": points["receiver"].to_numpy()[at], "x": points["x"].to_numpy()[at],
                             "box": (top[at] << 32) + below})

    return _by_top(onward, "receiver", drawn, rows).applyInPandas(descend, out)


def _visit(receivers: DataFrame, donors: DataFrame, stats: DataFrame, k: int, box_rows: int) -> DataFrame:
    """k nearest donors of each receiver within its box: (receiver, d, donor, value).

    A large box is cut into donor parts, and its receivers into lanes, so that the size of a task
    stays bounded however the rows are distributed.
    """
    visitors = receivers.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / (4 * box_rows)).cast("int").alias("lanes"))
    parts = stats.select("box", F.ceil(F.col("n") / (2 * box_rows)).cast("int").alias("parts"))
    layout = small_side(visitors.join(parts, "box"))  # one row per box
    r = (receivers.join(layout, "box").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
         .withColumn("lane", F.pmod(F.xxhash64("receiver"), F.col("lanes")).cast("int")))
    d = (donors.join(layout, "box").withColumn("part", F.pmod(F.xxhash64("donor"), F.col("parts")).cast("int"))
         .withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))))
    kind = dict((f.name, f.dataType) for f in receivers.schema.fields)["receiver"]
    out = T.StructType([T.StructField("receiver", kind), T.StructField("d", T.DoubleType()),
                        T.StructField("donor", dict((f.name, f.dataType) for f in donors.schema.fields)["donor"]),
                        T.StructField("value", T.DoubleType())])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"receiver": [], "d": [], "donor": [], "value": []})
        right = right.sort_values("donor")
        i, j, distance = _k_nearest(np.array(left["x"].tolist(), dtype=float),
                                    np.array(right["x"].tolist(), dtype=float), k)
        return pd.DataFrame({"receiver": left["receiver"].to_numpy()[i], "d": distance,
                             "donor": right["donor"].to_numpy()[j], "value": right["value"].to_numpy()[j]})

    keys = ["box", "part", "lane"]
    return (r.select(*keys, "receiver", "x").groupBy(*keys)
            .cogroup(d.select(*keys, "donor", "value", "x").groupBy(*keys)).applyInPandas(compare, out))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what the boxes gave. They are ranked before they are gathered, first where they were found."""
    order = Window.partitionBy("receiver").orderBy("d", "donor")
    few = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    one = F.struct("d", "donor", "value")
    return few.groupBy("receiver").agg(F.array_sort(F.collect_list(one)).alias("nearest"))


def neighbour_mean(nearest: str = "nearest"):
    total = F.aggregate(nearest, F.lit(0.0), lambda a, s: a + s["value"])
    return F.when(F.size(nearest) > 0, total / F.size(nearest))


def fill_knn(df: DataFrame, target: str, features: list[str], key: str, k: int = 5,
             box_rows: int = 2048, top_boxes: int = 1024) -> DataFrame:
    """Null targets become the mean of the k nearest rows that have one; if nothing is comparable, the mean of all."""
    gaps, known = df.where(F.col(target).isNull()), df.where(F.col(target).isNotNull())
    found = nearest_donors(gaps, known, key, target, features, k, box_rows, top_boxes)
    mean = known.agg(F.avg(target)).scalar()
    filled = gaps.join(found, key, "left").withColumn(target, F.coalesce(neighbour_mean(), mean))
    kind = df.schema[target].dataType
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        known = known.withColumn(target, F.col(target).cast("double"))
    return known.select(*df.columns).unionByName(filled.select(*df.columns))


def fill_knn_category(df: DataFrame, target: str, features: list[str], key: str, k: int = 5) -> DataFrame:
    """The same for a text column: index, mean of the neighbours, nearest valid index, label."""
    from .frequency import category_index, restore_labels
    indexed, labels = category_index(df, [target])
    filled = fill_knn(indexed, target + "_idx", features, key, k)
    named = restore_labels(filled, F.col(target + "_idx"), labels, target, "_filled")
    return named.withColumn(target, F.coalesce(target, "_filled")).drop(target + "_idx", "_filled")


class NeighbourRegressor:
    """k-nearest regression: ``fit(df).transform(df)`` adds ``prediction``.

    ``features`` are columns or one vector column. Rows without a label are no donors. A row that compares with no donor
    gets the mean of all; without any donor the prediction is null.
    """

    def __init__(self, features: list[str] | str = "features", label: str = "label", key: str = "key", k: int = 7):
        self.features, self.label, self.key, self.k = features, label, key, k

    def fit(self, df: DataFrame) -> "NeighbourModel":
        known = df.where(F.col(self.label).isNotNull())
        return NeighbourModel(DonorIndex.build(known, self.key, self.label, self.features, self.k), self.key)


class NeighbourModel:
    """A fitted ``NeighbourRegressor``; ``save`` writes its boxes, ``load`` reads them."""

    def __init__(self, index: DonorIndex, key: str):
        self.index, self.key = index, key

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``. Rows without the key column are numbered in a table of their own first."""
        key, rows = self.key, df
        if key not in df.columns:
            key, rows = "_asked", stage(df.withColumn("_asked", F.monotonically_increasing_id()), "asked")
        found = self.index.nearest(rows, key)
        mean = F.lit(self.index.mean).cast("double")
        return (rows.join(found, key, "left").withColumn("prediction", F.coalesce(neighbour_mean(), mean))
                .select(*[c for c in df.columns if c != "prediction"], "prediction"))

    def save(self, spark, path: str) -> None:
        self.index.save(path)
        spark.createDataFrame([(self.key,)], "key string").write.mode("overwrite").json(f"{path}/key")

    @staticmethod
    def load(spark, path: str) -> "NeighbourModel":
        return NeighbourModel(DonorIndex.load(spark, path), spark.read.schema("key string").json(f"{path}/key").first()[0])
