"""Random forests grown on every row of a table.

Edges of the features come from the counts of all their values. Rows are coded by those
edges, and equal coded rows are kept once with their number. Trees grow level by level from
histograms of all rows: a table of ``LOCAL_ROWS`` at most in the tasks, a few trees each,
a larger one by one round a level, in which tasks send the histograms of their pieces and
only the chosen splits reach the driver. No row is copied for a tree and nothing is kept
between rounds: what a tree draws of a row is a hash of its content, its place in the tree follows
from its codes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.operators.running import running_totals
from twinproof.session import settle

LOCAL_ROWS = 1 << 21  # coded rows up to which a task holds the whole table
PIECE_ROWS = 1 << 21  # coded rows of which a task makes one histogram
CELLS = 1 << 20  # counters of a histogram block
WALK_ROWS = 1 << 16  # rows that walk down a tree together


class Forest:
    """Trees as (feature, edge, children, value) by node; a leaf is its own child, children
    are (above the edge, up to it), the value is each class's share or the mean of a number."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], regression: bool):
        self.trees, self.regression = trees, regression


# ------------------------------------------------------------------ coded rows


def bin_edges(rows: DataFrame, dims: int, bins: int) -> list[np.ndarray]:
    """Edges of each feature: between all values of a feature of few, else between ``bins`` parts of equally many rows."""
    x = rows.select(F.posexplode(vector_to_array("features")).alias("column", "value"))
    counts = settle(x.groupBy("column", "value").agg(F.count("*").alias("n")), "values")
    sizes = {r["column"]: r for r in counts.groupBy("column").agg(F.count("*").alias("k"), F.sum("n").alias("total")).collect()}
    few = [c for c, r in sizes.items() if r["k"] <= bins]
    found = {c: [] for c in range(dims)}
    for r in counts.where(F.col("column").isin(few)).collect() if few else []:
        found[r["column"]].append((r["value"], r["value"]))
    if len(few) < len(sizes):
        run = running_totals(counts.where(~F.col("column").isin(few)), ["column"], "value", ["n"])
        total = F.coalesce(*[F.when(F.col("column") == c, F.lit(r["total"])) for c, r in sizes.items() if c not in few])
        part = F.floor((F.col("cum_n") - 1) * bins / total)
        for r in run.groupBy("column", part.alias("part")).agg(F.min("value").alias("low"), F.max("value").alias("high")).collect():
            found[r["column"]].append((r["low"], r["high"]))
    out = []
    for c in range(dims):
        low, high = np.array(sorted(found[c])).reshape(-1, 2).T
        with np.errstate(invalid="ignore"):
            middle = (high[:-1] + low[1:]) / 2
        out.append(np.where(np.isfinite(middle), middle, high[:-1]))
    return out


def _coded(edges: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            points = batch.column(0)
            x = points.flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1) if len(points) else np.zeros((0, len(edges)))
            codes = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1).astype(np.uint8)
            width = codes.shape[1]
            flat = pa.py_buffer(codes.tobytes())
            offsets = pa.py_buffer((np.arange(len(codes) + 1) * width).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(codes), [None, offsets, flat]), batch.column(1)], names=["codes", "label"])

    return run


# ----------------------------------------------------------------- one tree


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Draws:
    """How often a tree draws a row that stands n times: as often as n draws of Poisson(1) give, by a hash of the row."""

    def __init__(self):
        self.tables: dict[int, tuple[int, np.ndarray]] = {}

    def table(self, n: int) -> tuple[int, np.ndarray]:
        if n not in self.tables:
            spread = int(12 * math.sqrt(n)) + 20
            first = max(0, n - spread)
            k = np.arange(first, n + spread)
            steps = np.concatenate([[-n + first * math.log(n) - math.lgamma(first + 1)], math.log(n) - np.log(k[1:])])
            self.tables[n] = first, np.cumsum(np.exp(np.cumsum(steps)))
        return self.tables[n]

    def __call__(self, h: np.ndarray, n: np.ndarray, seed: int, tree: int) -> np.ndarray:
        key = _mixed(np.array([seed * 1_000_003 + tree + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        u = (_mixed(h ^ key) >> np.uint64(11)) * 2.0**-53
        out = np.zeros(len(h), np.int32)
        order = np.argsort(n, kind="stable")
        kinds, starts = np.unique(n[order], return_index=True)
        for kind, at in zip(kinds.tolist(), np.split(order, starts[1:])):
            first, upto = self.table(kind)
            out[at] = first + np.minimum(np.searchsorted(upto, u[at], side="right"), len(upto) - 1)
        return out


class Growing:
    """A tree and the nodes of its last level that may still be cut (``slots``: their numbers)."""

    def __init__(self, number: int, dims: int, kinds: int, depth: int, seed: int):
        self.number, self.dims, self.kinds, self.depth, self.seed = number, dims, kinds, depth, seed
        self.regression = kinds == 0
        self.taken = max(1, -(-dims // 3) if self.regression else math.ceil(math.sqrt(dims)))
        self.feature, self.code, self.child = np.zeros(1, np.int8), np.full(1, 255, np.uint8), np.zeros(1, np.int32)
        self.sums = np.zeros((1, 3 if self.regression else kinds))
        self.level, self.slots = 0, np.zeros(1, np.int64)
        self.choose()

    @classmethod
    def of(cls, state: dict) -> Growing:
        tree = cls.__new__(cls)
        tree.__dict__.update(state)
        return tree

    def choose(self) -> None:
        """The features each open node may be cut by."""
        drawn = np.random.default_rng([self.seed, self.number, self.level]).random((len(self.slots), self.dims))
        self.subset = np.argsort(drawn, axis=1)[:, : self.taken]

    def step(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where rows go from their nodes; a leaf keeps its rows."""
        f = self.feature[at]
        return self.child[at] + (codes[np.arange(len(at)), f] > self.code[at])

    def walk(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.int32)
        for first in range(0, len(codes), WALK_ROWS):
            part, at = codes[first : first + WALK_ROWS], np.zeros(min(WALK_ROWS, len(codes) - first), np.int32)
            for _ in range(self.level):
                at = self.step(part, at)
            out[first : first + WALK_ROWS] = at
        return out

    def histograms(self, codes: np.ndarray, label: np.ndarray, drawn: np.ndarray, at: np.ndarray, bins: int) -> Iterator[tuple[int, np.ndarray]]:
        """(block, counters by (slot, place in the subset, code, measure)) of blocks of slots."""
        slot_of = np.full(len(self.feature), -1, np.int64)
        slot_of[self.slots] = np.arange(len(self.slots))
        slot = slot_of[at]
        size = self.block(bins)
        blocks = -(-len(self.slots) // size)
        kept = np.flatnonzero(slot >= 0)
        if blocks > 1:
            kept = kept[np.argsort(slot[kept] // size, kind="stable")]
        ends = np.searchsorted(slot[kept] // size, np.arange(blocks + 1))
        for b in range(blocks):
            own = kept[ends[b] : ends[b + 1]]
            if not len(own):
                continue
            slots = min(size, len(self.slots) - b * size)
            s, w, y, x = slot[own], drawn[own].astype(float), label[own], codes[own]
            out = np.zeros((slots, self.taken, bins, self.sums.shape[1]))
            for j in range(self.taken):
                place = (s - b * size) * bins + x[np.arange(len(own)), self.subset[s, j]]
                if self.regression:
                    for k, amount in enumerate((w, w * y, w * y * y)):
                        out[:, j, :, k] = np.bincount(place, amount, slots * bins).reshape(slots, bins)
                else:
                    out[:, j] = np.bincount(place * self.kinds + y.astype(np.int64), w, slots * bins * self.kinds).reshape(slots, bins, self.kinds)
            yield b, out

    def block(self, bins: int) -> int:
        return max(1, CELLS // (self.taken * bins * self.sums.shape[1]))

    def grow(self, chosen: list[tuple[np.ndarray, ...]]) -> None:
        """Cut open nodes by what ``best`` chose: (slot, place in the subset, code, sums below, sums above) of them."""
        if self.level == 0 and chosen:
            self.sums[0] = chosen[0][3][0] + chosen[0][4][0]
        slot, place, code, low, high = (np.concatenate(c) for c in zip(*chosen)) if chosen else [np.zeros(0, np.int64)] * 5
        cut = np.flatnonzero(place >= 0)
        node, first = self.slots[slot[cut]], len(self.feature)
        both = np.stack([low[cut], high[cut]], axis=1).reshape(-1, self.sums.shape[1])
        self.feature[node] = self.subset[slot[cut], place[cut]]
        self.code[node] = code[cut]
        self.child[node] = first + 2 * np.arange(len(cut))
        new = first + np.arange(2 * len(cut))
        self.feature = np.concatenate([self.feature, np.zeros(len(new), np.int8)])
        self.code = np.concatenate([self.code, np.full(len(new), 255, np.uint8)])
        self.child = np.concatenate([self.child, new.astype(np.int32)])
        self.sums = np.concatenate([self.sums, both])
        self.level += 1
        mixed = both[:, 0] > 1 if self.regression else both.max(axis=1, initial=0) < both.sum(axis=1)
        self.slots = new[mixed] if self.level < self.depth else new[:0]
        self.choose()

    def done(self, edges: list[np.ndarray], middle: float) -> tuple[np.ndarray, ...]:
        leaf = self.child == np.arange(len(self.child))
        edge = np.full(len(leaf), np.inf)
        edge[~leaf] = [edges[f][c] for f, c in zip(self.feature[~leaf], self.code[~leaf])]
        own = np.arange(len(leaf))
        children = np.stack([np.where(leaf, own, self.child + 1), self.child], axis=1).ravel()
        if self.regression:
            value = middle + self.sums[:, 1:2] / np.maximum(self.sums[:, :1], 1)
        else:
            total = self.sums.sum(axis=1, keepdims=True)
            value = np.divide(self.sums, total, out=np.zeros_like(self.sums), where=total > 0)
        return self.feature.astype(np.int32), edge, children.astype(np.int32), value


def best(counters: np.ndarray, regression: bool) -> tuple[np.ndarray, ...]:
    """(place in the subset, code, sums up to the code, sums above) of the cut that lowers each slot's
    impurity most (Gini, or variance); the place is -1 where none does."""
    upto = np.cumsum(counters, axis=2)
    total = upto[:, :, -1:]
    low, high = upto[:, :, :-1], total - upto[:, :, :-1]

    def purity(s):
        n = s[..., 0] if regression else s.sum(axis=-1)
        squares = s[..., 1] ** 2 if regression else (s * s).sum(axis=-1)
        return n, np.divide(squares, n, out=np.zeros(n.shape), where=n > 0)

    (n_low, a), (n_high, b), (n_all, c) = purity(low), purity(high), purity(total)
    spread = total[:, :1, :, 2] if regression else n_all[:, :1]
    # rounded, so that the order in which numbers were summed does not decide between equal cuts
    share = np.round(np.divide(a + b - c, spread, out=np.zeros(a.shape), where=spread > 0), 10)
    gain = np.where((n_low > 0) & (n_high > 0), share, -1.0)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1) if flat.shape[1] else np.zeros(len(gain), np.int64)
    codes = max(1, counters.shape[2] - 1)
    rows = np.arange(len(gain))
    place, code = at // codes, at % codes
    if not flat.shape[1]:
        return np.full(len(gain), -1), code, total[:, 0, 0], 0 * total[:, 0, 0]
    worth = flat[rows, at] > 0
    return np.where(worth, place, -1), code, low[rows, place, code], high[rows, place, code]


# -------------------------------------------------------------------- forests


def _pieces(batches, most: int | None, regression: bool, middle: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(codes, label, n, hash) of about ``most`` rows, or of all."""
    held, size = [], 0

    def joined():
        codes, label, n, h = (np.concatenate(c) for c in zip(*held))
        return codes, label, n, h

    for batch in batches:
        if not len(batch):
            continue
        codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(batch), -1)
        label = batch.column(1).to_numpy(zero_copy_only=False)
        label = label - middle if regression else label.astype(np.int32)
        held.append((codes, label, batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)))
        size += len(batch)
        if most and size >= most:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _whole(numbers: list[int], make, bins: int, seed: int, regression: bool, middle: float):
    """Trees of these numbers, grown by one task that holds all rows."""

    def run(batches):
        draws = Draws()
        for codes, label, n, h in _pieces(batches, None, regression, middle):
            for number in numbers:
                tree = make(number)
                drawn = draws(h, n, seed, number)
                own = np.flatnonzero(drawn)
                x, y, w = codes[own], label[own], drawn[own]
                at = np.zeros(len(own), np.int32)
                while len(tree.slots) and len(own):
                    chosen = [_of_block(tree, b, part, bins) for b, part in tree.histograms(x, y, w, at, bins)]
                    tree.grow(chosen)
                    at = tree.step(x, at)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pickle.dumps((tree.feature, tree.code, tree.child, tree.sums))], pa.binary())], names=["tree", "data"])

    return run


def _of_block(tree: Growing, block: int, counters: np.ndarray, bins: int) -> tuple[np.ndarray, ...]:
    return block * tree.block(bins) + np.arange(len(counters)), *best(counters, tree.regression)


def _level(numbers: list[int], sent, bins: int, seed: int, regression: bool, middle: float):
    """Histograms (tree, block, data) of a task's pieces for one level of these trees."""

    def run(batches):
        draws = Draws()
        for codes, label, n, h in _pieces(batches, PIECE_ROWS, regression, middle):
            for number in numbers:
                tree = Growing.of(sent.value[number])
                if not len(tree.slots):
                    continue
                drawn = draws(h, n, seed, number)
                own = np.flatnonzero(drawn)
                x = codes[own]
                for block, part in tree.histograms(x, label[own], drawn[own], tree.walk(x), bins):
                    data = part.tobytes() if regression else part.astype(np.int32).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int32()), pa.array([block], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([data], pa.binary())], names=["tree", "block", "slots", "data"]
                    )

    return run


def _chosen(shape: tuple[int, int, int], regression: bool):
    def run(parts: pa.Table) -> pa.Table:
        slots = parts.column("slots")[0].as_py()
        total = np.zeros((slots, *shape))
        for data in parts.column("data"):
            total += np.frombuffer(data.as_buffer(), np.float64 if regression else np.int32).reshape(total.shape)
        return parts.slice(0, 1).select(["tree", "block"]).append_column("data", pa.array([pickle.dumps(best(total, regression))], pa.binary()))

    return run


def _dealt(coded: DataFrame, trees: list[int], tasks: int, run, schema: str, whole: bool = False) -> DataFrame:
    """``run(numbers)`` over all rows for groups of trees, as many as keep the cluster busy."""
    groups = max(1, min(len(trees), -(-tasks // (1 if whole else max(1, coded.rdd.getNumPartitions())))))
    # a union of single partitions alone would be one task; beside a scan (of nothing) each stays a task
    out = coded.where("n < 0").mapInArrow(run([]), schema) if whole else None
    for g in range(groups):
        part = (coded.coalesce(1) if whole else coded).mapInArrow(run(trees[g::groups]), schema)
        out = part if out is None else out.unionByName(part)
    return out


def grow(rows: DataFrame, label: str, trees: int, depth: int, bins: int, seed: int, regression: bool = False) -> Forest:
    """A forest of ``trees`` on all ``rows``: each tree draws the rows as often as a bootstrap does, each
    node is cut by the best of some features (the root of their number, a third for numbers)."""
    spark = rows.sparkSession
    y = F.col(label).cast("double")
    dims, n, missing, most, middle = rows.agg(
        F.max(F.size(vector_to_array("features"))), F.count("*"), F.count(F.when(y.isNull() | F.isnan(y), 1)), F.max(y), F.avg(y)
    ).first()
    if not n:
        raise ValueError("no rows to learn from")
    if missing:
        raise ValueError("labels must not be null or NaN")
    if bins > 256 or dims > 127:
        raise ValueError("at most 256 codes of 127 features")
    kinds, middle = (0, middle) if regression else (max(2, int(most) + 1), 0.0)
    edges = bin_edges(rows, dims, bins)
    width = max(len(e) for e in edges) + 1
    given = rows.select(vector_to_array("features").alias("x"), y.alias("label"))
    counted = given.mapInArrow(_coded(edges), "codes binary, label double").groupBy("codes", "label").agg(F.count("*").alias("n"))
    coded = settle(counted.withColumn("h", F.xxhash64("codes", "label")), "coded")
    tasks = 2 * spark.sparkContext.defaultParallelism

    def make(number: int) -> Growing:
        return Growing(number, dims, kinds, depth, seed)

    numbers = list(range(trees))
    if coded.count() <= LOCAL_ROWS:
        grown = _dealt(coded, numbers, tasks, lambda own: _whole(own, make, width, seed, regression, middle), "tree int, data binary", whole=True)
        held = [make(i) for i in numbers]
        for r in grown.collect():
            tree = held[r["tree"]]
            tree.feature, tree.code, tree.child, tree.sums = pickle.loads(r["data"])
    else:
        held = [make(i) for i in numbers]
        while any(len(t.slots) for t in held):
            sent = spark.sparkContext.broadcast([vars(t) for t in held])  # plain values: executors need not have the class
            parts = _dealt(coded, numbers, tasks, lambda own: _level(own, sent, width, seed, regression, middle), "tree int, block int, slots int, data binary")
            shape = (held[0].taken, width, held[0].sums.shape[1])
            found = parts.groupBy("tree", "block").applyInArrow(_chosen(shape, regression), "tree int, block int, data binary")
            chosen = [[] for _ in held]
            for r in found.orderBy("tree", "block").collect():
                splits = pickle.loads(r["data"])
                chosen[r["tree"]].append((r["block"] * held[r["tree"]].block(width) + np.arange(len(splits[0])), *splits))
            for tree, own in zip(held, chosen):
                if len(tree.slots):
                    tree.grow(own)
            sent.unpersist()
    return Forest([t.done(edges, middle) for t in held], regression)
