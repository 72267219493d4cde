"""Embedding near-duplicates with NN-descent.

Vectors of one label (and length) are compared by cosine. Equal vectors are one
node with a count. Each node starts with its nearest neighbours inside buckets of
random hyperplanes, then lists are refined: neighbours of neighbours meet at the
node between them, and whatever is nearer than the end of a list enters it, until
lists stop changing. Edges are checked in double precision against the threshold.

A list whose entries all reach the threshold is saturated: more links may exist
than it holds. The lists of its component are then enlarged to the component's
size: members meet in tiles of bounded size and links are counted exactly, without
emitting pairs.

The search is audited in two ways. Beside the vectors, neighbours of a sample of them are
planted at cosines just above the threshold; they take part in the search, and the share
of them that was found tells how well it finds links, also where the data have next to none.
And a sample of nodes is compared with all vectors, once: where it holds enough nodes
with links, the mean recall of those with few links and that of those with many count
as well. All must reach ``RECALL``. Else the search goes on with further hyperplanes, and
only if that fails ``TRIES`` times all vectors of a label meet in tiles.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without label, link with nothing and are their own component;
repeated rows link with each other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinproof.llm.components import components
from twinproof.llm.tables import table
from twinproof.session import settle

THRESHOLD = 0.93
LIST = 12  # neighbours of a node
TABLES = 10  # sets of hyperplanes
BUCKET = 24  # nodes that a bucket should hold
BLOCK = 64  # neighbours in a bucket's order that are compared
OFFERS = 4  # new neighbours a middle node may offer to each of its neighbours
ROUNDS = 6
SETTLED = 0.002  # stop when the sum of similarities grows by less than this share
TILE = 512
AUDIT = 256  # nodes of the first sample
ENOUGH = 64  # nodes with few links that a sample has to hold
AUDIT_MOST = 1 << 13  # nodes of the largest sample
RECALL = 0.95
TRIES = 3
PLANTED = 512  # vectors that get a planted neighbour, about
ABOVE = (0.002, 0.05)  # how far above the threshold its cosine is, at least and at most
SLACK = 1e-4  # single precision may be off by less


def _rows(blobs: list, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def _clean(batches):
    """(vec_id, g, d1, d2, vec): g is null where a row links with nothing."""
    for batch in batches:
        ids, labels, vectors = batch.columns
        size = pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a missing component is NaN
        ends = np.cumsum(size)

        def per_row(flags):
            upto = np.append(0, np.cumsum(flags))
            return upto[ends] - upto[ends - size]

        ok = (size > 0) & (per_row(np.isfinite(x)) == size) & (per_row(x != 0) > 0) & labels.is_valid().to_numpy(zero_copy_only=False)
        names = labels.to_pylist()
        groups, d1, d2, out = ([None] * len(size) for _ in range(4))
        for dim in np.unique(size[ok]).tolist():
            at = np.flatnonzero(ok & (size == dim))
            rows = x[(ends - size)[at][:, None] + np.arange(dim)] + 0.0
            # scaled by a power of two, which is exact: no square over- or underflows
            scaled = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])
            whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in rows), np.int64).reshape(-1, 2)
            for i, (a, b), r in zip(at.tolist(), whole.tolist(), scaled):
                groups[i], d1[i], d2[i], out[i] = f"{names[i]}:{dim}", a, b, r.tobytes()
        yield pa.RecordBatch.from_arrays([ids, pa.array(groups, pa.string()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "g", "d1", "d2", "vec"])


def _plant(threshold):
    """A neighbour of each vector, turned in a random direction to a cosine a little above the threshold."""

    def run(batches):
        for batch in batches:
            u, g, d1, d2, _, vec = batch.columns
            made = []
            for seed, blob in zip(d1.to_pylist(), vec.to_pylist()):
                rng = np.random.default_rng([abs(seed), 7])
                x = _unit(np.frombuffer(blob, np.float64)[None])[0]
                away = rng.standard_normal(len(x))
                away -= (away @ x) * x
                size = np.sqrt(away @ away)
                cos = min(1.0, threshold + rng.uniform(*ABOVE))
                made.append((cos * x + np.sqrt(1 - cos * cos) * away / size if size > 1e-9 else x).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([-k - 1 for k in u.to_pylist()], pa.int64()), g, d1, d2, pa.array([1] * len(made), pa.int64()), pa.array(made, pa.binary())], names=["u", "g", "d1", "d2", "n", "vec"]
            )

    return run


def planted(nodes: DataFrame, count: int, threshold: float) -> DataFrame:
    """Planted neighbours, as nodes: that of node u is -u - 1."""
    draw = F.pmod(F.xxhash64(F.lit(1), "d1", "d2"), F.lit(1_000_003)) / 1_000_003
    chosen = nodes.where(draw < min(0.5, PLANTED / max(count, 1))).select("u", "g", "d1", "d2", "n", "vec")
    return settle(chosen.mapInArrow(_plant(threshold), "u bigint, g string, d1 bigint, d2 bigint, n bigint, vec binary"), "nn-planted")


def planted_found(graph: DataFrame, threshold: float) -> int:
    """How many planted nodes have a list that holds their vector, or is full of nearer ones."""
    lists = graph.where("u < 0").groupBy("u").agg(F.max((F.col("v") == -F.col("u") - 1).cast("int")).alias("hit"), F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
    found = (F.col("hit") == 1) | ((F.col("n") >= LIST) & (F.col("low") >= threshold + ABOVE[1] - SLACK))
    return lists.agg(F.sum(found.cast("int"))).first()[0] or 0


def _unit(vec: np.ndarray) -> np.ndarray:
    return vec / np.sqrt((vec * vec).sum(axis=1, keepdims=True))


def _code(seed):
    """A row per table: the bucket's code, the place in its order, and the unit vector."""

    def run(batches):
        planes = {}
        for batch in batches:
            u, g, bits, blobs = (c.to_pylist() for c in batch.columns)
            sizes = np.array([len(b) // 8 for b in blobs])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = _unit(_rows([blobs[i] for i in at], np.float64))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((TABLES, dim, 25))
                vectors = [r.tobytes() for r in x.astype(np.float32)]
                width = np.minimum(np.array([bits[i] for i in at]), 24)
                for t in range(TABLES):
                    side = x @ planes[dim][t]
                    code = ((side[:, :24] > 0) * (np.arange(24) < width[:, None])) @ (1 << np.arange(24))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g[i] for i in at], pa.string()), pa.array([t] * len(at), pa.int32()), pa.array(code, pa.int64()), pa.array(side[:, 24], pa.float64()), pa.array([u[i] for i in at], pa.int64()), pa.array(vectors, pa.binary())],
                        names=["g", "t", "code", "spot", "u", "unit"],
                    )

    return run


def _edges(us, vs, sims):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us or [[]]).astype(np.int64)), pa.array(np.concatenate(vs or [[]]).astype(np.int64)), pa.array(np.concatenate(sims or [[]]).astype(np.float32))], names=["u", "v", "sim"])


def _best(u, sim, count, out):
    """Each row's ``count`` nearest others."""
    np.fill_diagonal(sim, -2)
    k = min(count, len(u) - 1)
    if k > 0:
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        out[0].append(np.repeat(u, k)), out[1].append(u[top].ravel()), out[2].append(np.take_along_axis(sim, top, 1).ravel())


def _buckets(batches):
    """Nearest neighbours among those near in a bucket's order."""
    last = None
    for batch in batches:
        g, t, code, _, u, unit = (c.to_pylist() for c in batch.columns)
        keys = list(zip(g, t, code))
        if last is not None and keys and last[0][-1] == keys[0]:
            keys, u, unit = last[0] + keys, last[1] + u, last[2] + unit
        out = ([], [], [])
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if b - a > 1:
                x, ids = _rows(unit[a:b], np.float32), np.array(u[a:b])
                for s in range(0, max(1, b - a - BLOCK // 2), BLOCK // 2):
                    _best(ids[s : s + BLOCK], x[s : s + BLOCK] @ x[s : s + BLOCK].T, LIST, out)
        tail = max(cuts[-1] if cuts else 0, len(keys) - BLOCK)
        last = (keys[tail:], u[tail:], unit[tail:])
        yield _edges(*out)


def _meet(batches):
    """Neighbours of one node (rows m, x, low, unit, known in runs of m) that are nearer than their lists' ends."""
    held = None
    for batch in batches:
        m = batch.column(0).to_numpy()
        x, low = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        unit, known = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        if held is not None:
            m, x, low, unit, known = np.append(held[0], m), np.append(held[1], x), np.append(held[2], low), held[3] + unit, held[4] + known
        cuts = np.flatnonzero(np.diff(m)) + 1
        end = int(cuts[-1]) if len(cuts) else 0
        yield _met(m[:end], x[:end], low[:end], unit[:end], known[:end])
        held = (m[end:], x[end:], low[end:], unit[end:], known[end:])
    if held is not None:
        yield _met(*held)


def _met(m, x, low, unit, known):
    out = ([], [], [])
    cuts = (np.flatnonzero(np.diff(m)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(m)]):
        if b - a > 1:
            v = _rows(unit[a:b], np.float32)
            mine = ([], [], [])
            sim, place = v @ v.T, {i: n for n, i in enumerate(x[a:b].tolist())}
            for row, own in enumerate(known[a:b]):
                sim[row, [place[i] for i in own if i in place]] = -2
            _best(x[a:b], sim, OFFERS, mine)
            better = mine[2][0] > np.repeat(low[a:b], len(mine[2][0]) // (b - a))
            for o, n in zip(out, mine):
                o.append(n[0][better])
    return _edges(*out)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _check(threshold):
    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sizes, ok = np.array([len(p) for p in x]), np.zeros(len(x), bool)
            for size in np.unique(sizes).tolist():  # both of a pair have one length
                at = np.flatnonzero(sizes == size)
                ok[at] = _cosines(_rows([x[i] for i in at], np.float64), _rows([y[i] for i in at], np.float64)) >= threshold
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


def _spanning(near: np.ndarray, u: np.ndarray, out) -> None:
    """Links that connect what the links of a tile connect."""
    left = near.any(axis=1)
    for first in range(len(u)):
        todo = [first] if left[first] else []
        left[first] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & left)
            left[new] = False
            out[0].append(np.repeat(u[i], len(new))), out[1].append(u[new])
            todo.extend(new.tolist())


def _tile(threshold, connect: bool = False):
    """Links of each member of a tile with the other piece (or within one), weighted by
    counts; with ``connect`` also links (u, v) that span the tile's components."""

    def counted(rows, out):
        side = np.array([r[0] for r in rows])
        u, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        vec = _rows([r[3] for r in rows], np.float64)
        norm = np.sqrt((vec * vec).sum(axis=1))
        near = (vec @ vec.T) / (norm[:, None] * norm[None]) >= threshold
        near &= (side[:, None] == 2) | (side[:, None] != side[None])
        np.fill_diagonal(near, False)
        out[0].append(u), out[1].append(near @ n)
        if connect:
            _spanning(near, u, out[2:])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            out = ([], [], [], [])
            for c, i, j, *row in zip(*(x.to_pylist() for x in batch.columns)):
                if (c, i, j) != now:
                    if rows:
                        counted(rows, out)
                    now, rows = (c, i, j), []
                rows.append(row)
            yield result(out)
        out = ([], [], [], [])
        if rows:
            counted(rows, out)
        yield result(out)

    def result(out):
        if not connect:
            return _sums(out)
        u, links, a, b = (np.concatenate(x or [[]]).astype(np.int64) for x in out)
        v = pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(b)])
        return pa.RecordBatch.from_arrays([pa.array(np.append(u, a)), v, pa.array(np.append(links, np.zeros(len(a), np.int64)))], names=["u", "v", "links"])

    return run


def _sums(out):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0] or [[]]).astype(np.int64)), pa.array(np.concatenate(out[1] or [[]]).astype(np.int64))], names=["u", "links"])


def _audit(sent, threshold):
    def run(batches):
        ids, groups, vectors = sent.value
        by = {}
        for i, g in enumerate(groups):
            by.setdefault(g, []).append(i)
        by = {g: (np.array([ids[i] for i in at]), _rows([vectors[i] for i in at], np.float64)) for g, at in by.items()}
        for batch in batches:
            us, ns = [], []
            u, g, n, vec = (c.to_pylist() for c in batch.columns)
            own: dict = {}
            for i, name in enumerate(g):
                own.setdefault(name, []).append(i)
            for name, at in own.items():
                if name in by:
                    q, a = by[name]
                    total, norm = np.zeros(len(q), np.int64), np.sqrt((a * a).sum(1))[:, None]
                    for part in (at[s : s + TILE] for s in range(0, len(at), TILE)):
                        b = _rows([vec[i] for i in part], np.float64)
                        near = (a @ b.T) / (norm * np.sqrt((b * b).sum(1))[None]) >= threshold
                        near &= q[:, None] != np.array([u[i] for i in part])[None]
                        total += near @ np.array([n[i] for i in part])
                    us.append(q), ns.append(total)
            yield _sums((us, ns))

    return run


def _top(edges: DataFrame, count: int) -> DataFrame:
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return best.withColumn("place", place).where(F.col("place") <= count).drop("place")


def _start(nodes: DataFrame, seed: int) -> DataFrame:
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / BUCKET))).cast("int")
    coded = nodes.join(sizes, "g").select("u", "g", bits.alias("bits"), "vec").mapInArrow(_code(seed), "g string, t int, code bigint, spot double, u bigint, unit binary")
    # by range: a bucket that many vectors share is cut along its order
    order = ("g", "t", "code", "spot")
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_buckets, "u bigint, v bigint, sim float")


def _refined(nodes: DataFrame, units: DataFrame, graph: DataFrame) -> DataFrame:
    """One round: neighbours of neighbours, in both directions of the lists."""
    back = graph.select(F.col("v").alias("m"), F.col("u").alias("x"), "sim")
    place = F.row_number().over(Window.partitionBy("m").orderBy(F.desc("sim"), "x"))
    back = back.withColumn("place", place).where(F.col("place") <= LIST).select("m", "x")
    around = graph.select(F.col("u").alias("m"), F.col("v").alias("x")).union(back).distinct()
    low = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= LIST, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("low"), F.collect_list("v").alias("known"))
    ends = units.join(low, "u", "left").select(F.col("u").alias("x"), F.coalesce("low", F.lit(-2.0).cast("float")).alias("low"), "unit", F.coalesce("known", F.array().cast("array<bigint>")).alias("known"))
    met = around.join(ends, "x").select("m", "x", "low", "unit", "known").repartition("m").sortWithinPartitions("m").mapInArrow(_meet, "u bigint, v bigint, sim float")
    return settle(_top(graph.union(met), LIST), "nn-graph")


def _single(batches):
    for batch in batches:
        x = _unit(_rows(batch.column(1).to_pylist(), np.float64)).astype(np.float32) if batch.num_rows and len({len(b) for b in batch.column(1).to_pylist()}) == 1 else None
        rows = [r.tobytes() for r in x] if x is not None else [_unit(_rows([b], np.float64)).astype(np.float32).tobytes() for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["u", "unit"])


def _tiles(members: DataFrame) -> DataFrame:
    """(root, i, j, side, u, n, vec): rows (root, id, n, vec) so that all of a root meet in tiles."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    inside = members.join(sizes, "root").withColumn("pieces", F.ceil(F.col("size") / TILE).cast("int"))
    inside = inside.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    spread = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    side = F.when(F.col("piece") == F.col("other"), 2).when(F.col("piece") < F.col("other"), 0).otherwise(1)
    tiles = spread.select("root", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), side.alias("side"), F.col("id").alias("u"), "n", "vec")
    return tiles.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")


def _exact(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """What ``_links`` gives, from all pairs of a label."""
    tiles = _tiles(nodes.select(F.col("g").alias("root"), F.col("u").alias("id"), "n", "vec"))
    met = settle(tiles.mapInArrow(_tile(threshold, connect=True), "u bigint, v bigint, links bigint"), "nn-tiles")
    counts = met.where("v is null and links > 0").groupBy("u").agg(F.sum("links").alias("links"))
    return settle(counts, "nn-counts"), settle(components(met.where("v is not null").select("u", "v")), "nn-components")


def _links(nodes: DataFrame, graph: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(u, links) of nodes with links, and (id, root) of their components."""
    near = graph.where(F.col("sim") >= threshold - SLACK)
    pairs = near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    x, y = nodes.select("u", F.col("vec").alias("x")), nodes.select(F.col("u").alias("v"), F.col("vec").alias("y"))
    edges = settle(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_check(threshold), "u bigint, v bigint"), "nn-links")
    tree = settle(components(edges), "nn-components")
    full = near.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LIST).select(F.col("u").alias("id"))
    wide = settle(full.join(tree, "id").select("root").distinct(), "nn-saturated")

    members = tree.join(wide, "root").join(nodes.select(F.col("u").alias("id"), "n", "vec"), "id")
    tiles = _tiles(members).mapInArrow(_tile(threshold), "u bigint, links bigint")

    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    outside = both.join(tree.withColumnRenamed("id", "u"), "u").join(wide, "root", "left_anti")
    plain = outside.select("u", "v").join(nodes.select(F.col("u").alias("v"), "n"), "v").select("u", F.col("n").alias("links"))
    return settle(plain.union(tiles).groupBy("u").agg(F.sum("links").alias("links")), "nn-counts"), tree


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["vec_id"]
    clean = vectors.select("vec_id", "label", "embedding").mapInArrow(_clean, f"vec_id {kind}, g string, d1 bigint, d2 bigint, vec binary")
    clean = settle(clean.withColumn("uid", F.monotonically_increasing_id()), "nn-vectors")
    head = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "uid")).alias("head")
    merged = clean.where(F.col("g").isNotNull()).groupBy("g", "d1", "d2").agg(head, F.count(F.lit(1)).alias("n"))
    merged = merged.withColumn("uid", F.col("head.uid"))
    # a class has the vector of its first row
    nodes = settle(merged.join(clean.select("uid", "vec"), "uid").withColumnRenamed("uid", "u"), "nn-nodes")
    count = nodes.count()
    test = planted(nodes, count, threshold)
    wanted = test.count()
    every = nodes.select("u", "g", "d1", "d2", "n", "vec").union(test)
    units = settle(every.select("u", "vec").mapInArrow(_single, "u bigint, unit binary"), "nn-units")
    exact, tells = sampled(nodes, threshold)
    graph = spark.createDataFrame([], "u bigint, v bigint, sim float")
    for turn in range(TRIES):
        graph = settle(_top(graph.union(_start(every, turn)), LIST), "nn-graph")
        total = graph.agg(F.sum("sim")).first()[0]
        for _ in range(ROUNDS):
            graph = _refined(every, units, graph)
            before, total = total, graph.agg(F.sum("sim")).first()[0]
            if total is None or total - before <= SETTLED * abs(before):
                break
        if planted_found(graph, threshold) < RECALL * wanted:
            continue
        links, tree = _links(nodes, graph.where("u >= 0 and v >= 0"), threshold)
        if not tells or recall(exact, links) >= RECALL:
            break
    else:
        links, tree = _exact(nodes, threshold)
    rooted = nodes.join(tree.withColumnRenamed("id", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    named = rooted.groupBy("root").agg(F.min("head").alias("first"))
    own = rooted.join(named, "root").join(links, "u", "left").select("g", "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("first.vec_id").alias("component_id"))
    out = clean.select("vec_id", "g", "d1", "d2").join(own, ["g", "d1", "d2"], "left")
    component = F.when(F.col("g").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def sampled(nodes: DataFrame, threshold: float = THRESHOLD, size: int = AUDIT) -> tuple[DataFrame, bool]:
    """(u, exact): links of sampled nodes that have any, counted against all vectors; and whether they can
    tell a recall. Samples grow until ``ENOUGH`` nodes with few links are in or all nodes are."""
    spark = nodes.sparkSession
    count = nodes.count()
    draw = F.pmod(F.xxhash64("d1", "d2"), F.lit(1_000_003)) / 1_000_003
    while True:
        rows = nodes.where(draw < size / max(count, 1)).select("u", "g", "vec").collect()
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows], [bytes(r[2]) for r in rows]))
        met = nodes.select("u", "g", "n", "vec").mapInArrow(_audit(sent, threshold), "u bigint, links bigint")
        exact = settle(met.groupBy("u").agg(F.sum("links").alias("exact")).where("exact > 0"), "nn-sampled")
        sent.unpersist()
        tells = size >= count or exact.where(F.col("exact") <= LIST).count() >= ENOUGH
        if tells or size >= AUDIT_MOST:
            return exact, tells
        size = min(8 * size, AUDIT_MOST)


def recall(exact: DataFrame, links: DataFrame) -> float:
    """The lower of two mean recalls, of sampled nodes with few links and with many; 1 without any."""
    own = F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("exact"))
    means = exact.join(links, "u", "left").groupBy((F.col("exact") <= LIST).alias("few")).agg(F.avg(own).alias("recall")).collect()
    return min((r["recall"] for r in means), default=1.0)


def op7_vector_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
