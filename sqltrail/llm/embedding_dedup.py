"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors become one class. A tree splits the vectors level by level along random directions; the
threshold of each node is the median of a bounded sample (``SAMPLE`` classes, at the top levels) or of the
node above it (further down). A vector within the spill margin of a threshold goes to both sides, so
near vectors part only if a threshold separates them by more than both margins. The depth follows
from the number of classes, so that leaves keep their expected size however many rows there are. Every vector
passes every tree of the forest. The deeper the trees, the likelier one of them parts a pair, so their number follows from
the depth: enough for a pair at the threshold to share a leaf with a chance of ``RECALL``. A narrow margin and more trees
cost fewer rows than a wide margin: at a depth of 20, some 80 rows a vector.

Within a leaf all classes are compared by their cosine in double precision. A leaf larger than ``BLOCK`` is
dealt over shares: each of its vectors is an entry of one share and is compared with all of them, so the
work is split and complete. A pair is counted in the first leaf that both share, found by sending the vectors that have links
through the earlier trees once more, so rows carry nothing but the vector and pairs never leave a task to be made distinct: a leaf returns
the number of links of each vector and the links that join groups in it, a number of rows linear in
its vectors. Links with a cosine below the threshold are never made.

The forest may miss a pair. Its recall against brute force is tested, also for pairs near the threshold.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors
of different lengths link with nothing of another length. Repeated rows are equal vectors and
link with each other. A null ``vec_id`` takes part; a group's id is its smallest id that is not null,
and null without one. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, stored, wide_hash
from .components import Forest, connected_components

COSINE = 0.9
LEAF, BLOCK, SAMPLE, SEED = 400, 4_096, 20_000, 11
#: The chance that a pair at the threshold shares a leaf of the forest.
RECALL = 0.97
MOST_TREES = 255
#: Spill margin, in standard deviations of the projected distance of two vectors at the threshold.
SPILL = 0.25
#: Levels whose thresholds are kept for each node.
NODES = 12


@dataclass
class Tree:
    """Directions of each level; thresholds by node (a heap from 1) and level, for levels beyond NODES by the ancestor."""

    directions: np.ndarray
    thresholds: np.ndarray
    margin: float

    def leaves(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf of every place that the vectors come to."""
        row, node = np.arange(len(units)), np.ones(len(units), np.int64)
        for level, direction in enumerate(self.directions):
            projected = (units @ direction)[row]
            known = node if level < NODES else node >> (level - NODES + 1)
            side = projected - self.thresholds[known, level]
            left, right = side <= self.margin, side >= -self.margin
            row = np.concatenate([row[left], row[right]])
            node = np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def grow(sample: np.ndarray, depth: int, cosine: float, seed: int) -> Tree:
    """A tree fitted on sampled unit vectors."""
    random = np.random.default_rng(seed)
    size = sample.shape[1]
    directions = random.normal(size=(depth, size))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    margin = SPILL * math.sqrt(max(0.0, 2 - 2 * cosine) / size)
    top = min(depth, NODES)
    thresholds = np.zeros((1 << max(1, top), max(1, depth)))

    def middle(projected: np.ndarray, held: np.ndarray) -> float:
        return float(np.median(projected[held])) if len(held) else 0.0

    # the sampled rows of each node; a node with few of them keeps its ancestor's
    rows = {1: np.arange(len(sample))}
    for level in range(depth):
        projected, below = sample @ directions[level], {}
        for node, held in rows.items():
            cut = thresholds[node, level] = middle(projected, held)
            if level + 1 < top:
                for child, side in ((2 * node, held[projected[held] <= cut]), (2 * node + 1, held[projected[held] > cut])):
                    below[child] = side if len(side) >= 16 else held
        rows = below or rows
    return Tree(directions, thresholds, margin)


def units(vectors: list) -> np.ndarray:
    """Unit vectors in double precision."""
    found = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    found = found / np.abs(found).max(1, keepdims=True)  # no overflow in the squares
    return found / np.sqrt((found**2).sum(1, keepdims=True))


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``vec_id, key`` (null where a vector links with nothing) and one stored row for each key."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        kind = "double"
    array = F.col("embedding").cast(f"array<{kind}>")
    huge = F.lit(float("inf"))
    sound = (F.size(array) > 0) & F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < huge)) & F.exists(array, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), array).alias("v"))
    keyed = rows.withColumn("key", F.when(F.col("v").isNotNull(), wide_hash(F.transform("v", lambda x: x + F.lit(0.0)))))
    classes = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("v").alias("v"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    return keyed.select("vec_id", "key"), classes


def trees_for(depth: int, cosine: float) -> int:
    """Trees that a pair at the threshold needs to share a leaf with a chance of ``RECALL``.

    A level parts a pair if its threshold falls between the two by more than both margins.
    """
    wide = 2 * SPILL
    beyond = 2 * (math.exp(-wide * wide / 2) / math.sqrt(2 * math.pi) - wide * math.erfc(wide / math.sqrt(2)) / 2)
    kept = (1 - min(0.9, math.sqrt(max(0.0, 2 - 2 * cosine) / (2 * math.pi)) * beyond)) ** depth
    return min(MOST_TREES, max(1, math.ceil(math.log(1 - RECALL) / math.log(max(1e-12, 1 - kept))))) if kept < 1 else 1


def _trees(classes: DataFrame, size: int, number: int, cosine: float, trees: int | None, seed: int) -> list[Tree]:
    own = classes.where(F.size("v") == size)
    sample = [r.v for r in own.orderBy(F.xxhash64("key")).limit(SAMPLE).select("v").collect()]
    found = units(sample)
    # a level leaves a bit more than half to each side, as what is within the margin goes to both
    share = 0.5 + 0.4 * SPILL * math.sqrt(max(0.0, 2 - 2 * cosine) / size) / max(1e-9, float((found @ np.random.default_rng(seed).normal(size=size) / math.sqrt(size)).std()))
    depth = max(0, math.ceil(math.log(max(1, number / LEAF)) / -math.log(min(0.8, share))))
    return [grow(found, depth, cosine, seed + t) for t in range(trees or trees_for(depth, cosine))]


_PLACED = "dim int, tree int, leaf long, node long, copies long, v binary"


def _raw_type(classes: DataFrame) -> str:
    return "<f4" if classes.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"


def _placed(classes: DataFrame, shared: Broadcast) -> DataFrame:
    """A row for each leaf that a class comes to."""
    kind = _raw_type(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees_of = shared.value
        for batch in batches:
            for size, some in batch.groupby(batch["v"].map(len)):
                for at in range(0, len(some), 1_000):
                    part = some.iloc[at : at + 1_000]
                    vectors = units(part["v"].tolist())
                    nodes, copies = part["node"].to_numpy(), part["copies"].to_numpy()
                    raw = np.array([np.asarray(v, kind).tobytes() for v in part["v"]], object)
                    for t, tree in enumerate(trees_of[size]):
                        row, leaf = tree.leaves(vectors)
                        yield pd.DataFrame({"dim": np.full(len(row), size, np.int32), "tree": np.full(len(row), t, np.int32), "leaf": leaf, "node": nodes[row], "copies": copies[row], "v": raw[row]})

    return classes.select("v", "node", "copies").mapInPandas(run, _PLACED)


class _Leaf:
    """Entries of one share of a leaf and what its probes have found."""

    def __init__(self, trees: list[Tree], tree: int, leaf: int, cosine: float, kind: str):
        self.trees, self.leaf, self.cosine, self.kind, self.rows, self.ready = trees[: tree + 1], leaf, cosine, kind, [], False

    def add(self, rows: pd.DataFrame) -> None:
        self.rows.append(rows)
        self.ready = False

    def _units(self, rows: pd.DataFrame) -> np.ndarray:
        return units([np.frombuffer(v, self.kind) for v in rows["v"]])

    def all(self) -> pd.DataFrame:
        return pd.concat(self.rows) if len(self.rows) > 1 else self.rows[0]

    def _earlier(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Each vector's leaves before this one, in order of tree and leaf."""
        rows, marks = [], []
        for t, tree in enumerate(self.trees):
            row, leaf = tree.leaves(vectors)
            if t == len(self.trees) - 1:
                row, leaf = row[leaf < self.leaf], leaf[leaf < self.leaf]
            rows.append(row)
            marks.append(leaf * (MOST_TREES + 1) + t)
        rows, marks = np.concatenate(rows), np.concatenate(marks)
        order = np.argsort(rows, kind="stable")
        return np.split(marks[order], np.searchsorted(rows[order], np.arange(1, len(vectors))))

    def probe(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and their number of links; ends of links that join groups."""
        if not self.ready:
            held = self.all()
            self.rows, self.vectors = [held], self._units(held)
            self.nodes, self.copies = held["node"].to_numpy(), held["copies"].to_numpy()
            self.before, self.forest, self.ready = [None] * len(held), Forest(len(held)), True
        nodes, counts, a, b = [], [], [], []
        for at in range(0, len(rows), 512):
            some = rows.iloc[at : at + 512]
            own = some["node"].to_numpy()
            probes = self._units(some)
            cosine = probes @ self.vectors.T
            r, c = np.nonzero(cosine >= self.cosine)
            keep = own[r] != self.nodes[c]
            r, c = r[keep], c[keep]
            if not len(r):
                continue
            # of these, the pairs that share no earlier leaf
            near, far = np.unique(r), np.unique(c)
            fresh = [i for i in far if self.before[i] is None]
            for i, marks in zip(fresh, self._earlier(self.vectors[fresh]) if fresh else [], strict=True):
                self.before[i] = marks
            mine, theirs = self._earlier(probes[near]), [self.before[i] for i in far]
            marks = np.unique(np.concatenate([*mine, *theirs])) if len(near) else np.zeros(0, np.int64)
            if len(marks):
                left, right = np.zeros((len(near), len(marks)), np.float32), np.zeros((len(far), len(marks)), np.float32)
                for grid, lists in ((left, mine), (right, theirs)):
                    for i, m in enumerate(lists):
                        grid[i, np.searchsorted(marks, m)] = 1
                shared = left @ right.T > 0
                fresh = ~shared[np.searchsorted(near, r), np.searchsorted(far, c)]
                r, c = r[fresh], c[fresh]
            if not len(r):
                continue
            found = np.bincount(r, weights=self.copies[c], minlength=len(own)).astype(np.int64)
            nodes.append(own[found > 0])
            counts.append(found[found > 0])
            r, c = self.forest.join(r, c)
            a.append(own[r])
            b.append(self.nodes[c])
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) if x else empty for x in (nodes, counts, a, b))


def _compare(placed: DataFrame, shared: Broadcast, cosine: float, kind: str) -> DataFrame:
    """Rows ``a, b, n``: with a null ``b``, n links of node a; else a link.

    Roles: 0 an entry of a share, 1 a probe of it, 2 both, in a leaf that is not dealt.
    """

    def found(nodes: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        ends = pd.array([None] * len(nodes) + b.tolist(), "Int64")
        return pd.DataFrame({"a": np.concatenate([nodes, a]), "b": ends, "n": np.concatenate([counts, np.zeros(len(a), np.int64)])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, leaf, whole = None, None, False
        for batch in batches:
            if batch.empty:
                continue
            place = batch[["dim", "tree", "leaf", "share", "role"]].to_numpy()
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(batch)], strict=True):
                dim, tree, number, share, role = place[s]
                if key != (now := (dim, tree, number, share)):
                    if whole:
                        yield found(*leaf.probe(leaf.all()))
                    key, leaf, whole = now, _Leaf(shared.value[dim], int(tree), int(number), cosine, kind), role == 2
                some = batch.iloc[s:e]
                if role == 1:
                    yield found(*leaf.probe(some))
                else:
                    leaf.add(some)
        if whole:
            yield found(*leaf.probe(leaf.all()))

    return placed.mapInPandas(run, "a long, b long, n long").where("b IS NOT NULL OR n > 0")


def found_links(classes: DataFrame, cosine: float = COSINE, trees: int | None = None, seed: int = SEED) -> DataFrame:
    """Stored rows ``a, b, n`` as of ``_compare``, from all leaves of all trees."""
    sizes = classes.groupBy(F.size("v").alias("size")).count().collect()  # one row for each length of vectors
    forests = {r["size"]: _trees(classes, r["size"], r["count"], cosine, trees, seed) for r in sizes}
    shared = classes.sparkSession.sparkContext.broadcast(forests)
    placed = stored(_placed(classes, shared), "vector-places")
    leaves = placed.groupBy("dim", "tree", "leaf").agg(F.count(F.lit(1)).alias("rows"))
    total = leaves.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    # at most 1 / SHARES of the leaves' rows are in a leaf this large, so the list is bounded
    large = leaves.where(F.col("rows") > F.greatest(F.lit(BLOCK), total * F.lit(1e-4))).select("dim", "tree", "leaf", F.ceil(F.col("rows") / BLOCK).cast("int").alias("shares"))
    dealt = placed.join(F.broadcast(large), ["dim", "tree", "leaf"], "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    entries = dealt.withColumn("share", F.pmod(F.xxhash64("node"), "shares").cast("int"))
    entries = entries.withColumn("role", F.when(F.col("shares") == 1, 2).otherwise(0))
    probes = dealt.where("shares > 1").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("role", F.lit(1))
    place = ["dim", "tree", "leaf", "share"]
    moved = entries.unionByName(probes).drop("shares").repartition(*place).sortWithinPartitions(*place, "role")
    return stored(_compare(moved, shared, cosine, _raw_type(classes)), "vector-links")


def report(vectors: DataFrame, cosine: float = COSINE, trees: int | None = None, seed: int = SEED) -> DataFrame:
    """Per vector: vectors linked directly, the smallest id reachable by links and whether that is its own."""
    rows, classes = classes_of(vectors)
    found = found_links(classes.select("key", "v", "node", "copies"), cosine, trees, seed)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("key", "node", "first", "copies").join(counts, "node", "left").join(groups, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = salted_join(rows, named, ["key"], ["vec_id"], hot_keys(classes, ["key"], "copies"), "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
