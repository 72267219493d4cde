"""Distance of synthetic rows to their closest real record.

Whole tables are compared through a kd-tree: edges from a sample cut the real points into buckets,
every point asks the bucket it falls into first, and after that only buckets whose bounding box
is nearer than its best, a bounded number a round. Inside a bucket a task cuts both sides into
small cells and compares near ones only. The minimum is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import ratio
from twinproof.operators import encoding
from twinproof.operators.running import running_totals
from twinproof.operators.sampling import bounded_sample
from twinproof.session import build_together, settle

MATCH_DISTANCE = 1e-6
SAMPLE_TASKS = 16
BUCKET_ROWS = 256  # points of a cell in a task: what is compared pair by pair
BUCKETS = 1 << 14  # boxes sent to the tasks, at most
BLOCK_ROWS = 4096  # a bucket of fewer real points is not worth a group of its own
LEAST_PARTS = 96  # buckets of a smaller table, so that all tasks have work
PART_ROWS = 65536  # real points a bucket should hold
EDGE_ROWS = 24  # sampled real points per bucket that give its edges
CHUNK_ROWS = 131072  # asks a group holds
PAIRS_AT_ONCE = 1 << 21
WINDOWS = (4, 20)  # other buckets a point has asked after each round, then WINDOW more a round
WINDOW = 64


# ---------------------------------------------------------------- sampled DCR


def _sampled_points(
    real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str], n: int
) -> tuple[DataFrame, DataFrame]:
    """Encoded bounded samples of both tables, written out (2 n rows at most)."""
    columns = [*numeric, *categorical]
    both = bounded_sample(real.select(*columns), n).withColumn("_s", F.lit(0)).unionByName(
        bounded_sample(synth.select(*columns), n).withColumn("_s", F.lit(1))
    )
    if categorical:
        both = encoding.encode(both, encoding.dictionary([real, synth], categorical), categorical)
    both = settle(both, "sampled")
    return both.where("_s = 0").drop("_s"), both.where("_s = 1").drop("_s")


def _nearest(asked: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Least squared distance of each asked point, a bounded number of pairs at a time."""
    best = np.full(len(asked), np.inf)
    step = max(1, PAIRS_AT_ONCE // max(1, len(others)))
    for start in range(0, len(asked) if len(others) else 0, step):
        part = asked[start : start + step]
        d2 = np.zeros((len(part), len(others)))
        for j in range(part.shape[1]):
            away = part[:, j][:, None] - others[:, j][None, :]
            d2 += away * away
        best[start : start + step] = d2.min(1)
    return best


def _matrix(points: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    points = points.combine_chunks() if isinstance(points, pa.ChunkedArray) else points
    return points.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _min_distances(real_points: DataFrame, synth_points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nearest distance per synthetic row of two *bounded* samples.

    The real sample (at most the sample size) goes to the tasks as one matrix.
    Rows with a null feature have no distance; they are left out here and
    counted by the callers.
    """
    dims = len(columns)
    rows = points(real_points, columns).collect()
    others = real_points.sparkSession.sparkContext.broadcast(np.array([r["point"] for r in rows], float).reshape(-1, dims))

    def run(batches):
        for batch in batches:
            best = np.sqrt(_nearest(_matrix(batch.column(0), dims), others.value))
            yield pa.RecordBatch.from_arrays([pa.array(best, mask=np.isinf(best))], names=["distance"])

    return points(synth_points, columns).mapInArrow(run, "distance double")


def dcr_sampled(
    real: DataFrame,
    synth: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    sample_size: int = 1000,
) -> DataFrame:
    """One row of distance statistics between bounded, hash-ordered samples."""
    columns = [*numeric, *categorical]
    r, s = _sampled_points(real, synth, numeric, categorical, sample_size)
    stats = encoding.scale_stats(r, columns)
    distances = _min_distances(
        encoding.standardize(r, stats, columns, 1e-10), encoding.standardize(s, stats, columns, 1e-10), columns
    )
    return dcr_summary(
        distances.agg(
            F.avg("distance").alias("mean_dcr"),
            F.median("distance").alias("median_dcr"),
            F.min("distance").alias("min_dcr"),
            F.count(F.when(F.col("distance") < MATCH_DISTANCE, 1)).alias("exact_matches"),
            F.count("*").alias("n_compared"),
        )
    )


def dcr_summary(stats: DataFrame) -> DataFrame:
    mean = F.col("mean_dcr")
    return stats.select(
        "mean_dcr",
        "median_dcr",
        "min_dcr",
        "exact_matches",
        ratio(F.col("exact_matches"), F.col("n_compared")).alias("exact_match_rate"),
        F.when(mean < 0.1, F.least(F.lit(100.0), mean / 0.1 * 100)).otherwise(F.lit(100.0)).alias("score"),
        ((mean >= 0.05) & (F.col("exact_matches") == 0)).alias("passed"),
        "n_compared",
    )


def dcr_evaluator(
    real: DataFrame,
    synth: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    sample_size: int = 1000,
) -> DataFrame:
    """Evaluator variant: numbers scaled on the union, label codes unscaled."""
    columns = [*numeric, *categorical]
    r, s = _sampled_points(real, synth, numeric, categorical, sample_size)
    stats = encoding.scale_stats(real.select(*numeric).unionByName(synth.select(*numeric)), numeric)
    d = _min_distances(
        encoding.standardize(r, stats, numeric), encoding.standardize(s, stats, numeric), columns
    )
    return d.agg(
        F.avg("distance").alias("mean_dcr"),
        F.median("distance").alias("median_dcr"),
        F.min("distance").alias("min_dcr"),
        F.max("distance").alias("max_dcr"),
        F.stddev_pop("distance").alias("std_dcr"),
    ).withColumn("dcr_score", F.least(F.lit(100.0), F.col("mean_dcr") * 100))


def exact_matches(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_synth, n_matching, n_matching_distinct): synthetic rows found in the real table.

    Both tables are counted by their full row together. Nulls compare equal,
    and any number of copies of one row merges before the shuffle.
    """
    both = real.select(*columns, F.lit(1).alias("is_real")).unionByName(
        synth.select(*columns, F.lit(0).alias("is_real"))
    )
    rows = both.groupBy(*columns).agg(F.sum("is_real").alias("n_real"), F.sum(1 - F.col("is_real")).alias("n_synth"))
    hit = (F.col("n_real") > 0) & (F.col("n_synth") > 0)
    return rows.agg(
        F.sum("n_synth").alias("n_synth"),
        F.coalesce(F.sum(F.when(hit, F.col("n_synth"))), F.lit(0)).alias("n_matching"),
        F.count(F.when(hit, 1)).alias("n_matching_distinct"),
    )


def matching_rows(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct synthetic rows that exist in the real table (semi join), with counts."""
    wanted = synth.groupBy(*columns).agg(F.count("*").alias("n_synth"))
    known = real.select(*columns).distinct()
    condition = F.lit(True)
    other = known.toDF(*[f"_r_{c}" for c in columns])
    for c in columns:
        condition = condition & wanted[c].eqNullSafe(other[f"_r_{c}"])
    return wanted.join(other, condition, "left_semi")


# ------------------------------------------------------------- full-table DCR


def _cut(points: np.ndarray, rows: int, most: int) -> tuple[list[np.ndarray], list[tuple[int, float, int, int]]]:
    """Row numbers of the cells of a kd-tree, of ``rows`` points about, and its nodes (axis, edge, low child, high child).

    The widest axis is cut at its median, values from the edge on go up. A child
    below 0 is cell -1 - child; ``most`` bounds the number of cells.
    """
    cells, nodes = [], []
    open_ = [(np.arange(len(points)), None, 0, most)]
    while open_:
        at, parent, side, room = open_.pop()
        own = points[at]
        low, high = own.min(axis=0), own.max(axis=0)
        axis = int(np.argmax(high - low))
        edge = None
        if len(at) > rows and room > 1 and low[axis] < high[axis]:
            x = own[:, axis]
            edge = np.partition(x, len(x) // 2)[len(x) // 2]
            if edge == low[axis]:  # more than half have the least value
                edge = x[x > edge].min()
        if edge is None:
            number = -1 - len(cells)
            cells.append(at)
        else:
            number, up = len(nodes), x >= edge
            nodes.append([axis, float(edge), 0, 0])
            open_ += [(at[up], number, 3, room // 2), (at[~up], number, 2, room - room // 2)]
        if parent is not None:
            nodes[parent][side] = number
    return cells, nodes


def _cell(points: np.ndarray, nodes: Sequence[Sequence[float]]) -> np.ndarray:
    """The cell of a tree that each point falls into."""
    at = np.full(len(points), 0 if len(nodes) else -1)
    axis, edge, low, high = (np.array(c) for c in zip(*nodes)) if len(nodes) else [np.zeros(0)] * 4
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        at[inner] = np.where(points[inner, axis[node]] >= edge[node], high[node], low[node])
    return -1 - at


def _gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances of boxes (low, high) from boxes (lows, highs).

    Summed in the order of the distances, so that no box is farther than its points."""
    away = np.zeros((len(low), len(lows)))
    for j in range(low.shape[1]):
        gap = np.maximum(np.maximum(lows[None, :, j] - high[:, j][:, None], low[:, j][:, None] - highs[None, :, j]), 0.0)
        away += gap * gap
    return away


def _closest(asked: np.ndarray, best: np.ndarray, others: np.ndarray) -> np.ndarray:
    """``best``, or the least squared distance of each asked point from the others where that is less.

    Both sides are cut into cells; neighbours ask together, nearest cells first, until none is nearer than their best.
    """
    best = best.copy()
    if not len(asked) or not len(others):
        return best
    cells = [others[at] for at in _cut(others, BUCKET_ROWS, len(others))[0]]
    lows, highs = np.array([c.min(axis=0) for c in cells]), np.array([c.max(axis=0) for c in cells])
    for at in _cut(asked, BUCKET_ROWS, len(asked))[0]:
        group, mine = asked[at], best[at]
        away = _gaps(group.min(axis=0)[None], group.max(axis=0)[None], lows, highs)[0]
        for i in np.argsort(away, kind="stable"):
            if away[i] >= mine.max():
                break
            near = np.flatnonzero(_gaps(group, group, lows[i][None], highs[i][None])[:, 0] < mine)
            if near.size:
                mine[near] = np.minimum(mine[near], _nearest(group[near], cells[i]))
        best[at] = mine
    return best


def _tree(real: DataFrame, n: int, dims: int) -> list[tuple[int, float, int, int]]:
    """Nodes of a kd-tree whose cells hold about ``PART_ROWS`` real points, or fewer so that there is work for all tasks.

    The edges come from a sample of bounded size; every point is placed by them.
    """
    wanted = min(BUCKETS, max(-(-n // PART_ROWS), min(LEAST_PARTS, n // BLOCK_ROWS)))
    share = min(1.0, wanted * EDGE_ROWS / n)
    drawn = real.where(F.abs(F.xxhash64("point") % 1000003) <= int(share * 1000003)).select("point")
    rows = _matrix(drawn.toArrow().column(0), dims)
    return _cut(rows, max(1, -(-len(rows) // wanted)), wanted)[1] if len(rows) else []


def _placed(df: DataFrame, nodes, dims: int) -> DataFrame:
    """Rows with the ``bucket`` their point falls into."""
    sent = df.sparkSession.sparkContext.broadcast(nodes)
    at = df.columns.index("point")

    def run(batches):
        for batch in batches:
            goal = _cell(_matrix(batch.column(at), dims), sent.value).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(goal)], names=[*batch.schema.names, "bucket"])

    return df.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in df.dtypes), "bucket bigint"]))


def _boxes(dims: int) -> list[Column]:
    low = F.array(*[F.min(F.col("point")[j]) for j in range(dims)]).alias("low")
    return [low, F.array(*[F.max(F.col("point")[j]) for j in range(dims)]).alias("high")]


ASKS = "id bigint, point array<double>, n bigint, best double, bucket bigint"


def _ask(asks: DataFrame, placed: DataFrame, dims: int) -> DataFrame:
    """(id, point, n, best) for every ask (id, point, n, best, bucket), best over the points of the bucket.

    A popular bucket is copied for several chunks of its asks, so neither
    side of a group grows with the data: at most about PART_ROWS x CHUNK_ROWS.
    """
    counts = asks.groupBy("bucket").agg(F.count("*").alias("asked"))
    chunks = settle(counts.select("bucket", F.ceil(F.col("asked") / CHUNK_ROWS).cast("int").alias("chunks")), "chunks")
    keys = ["bucket", "chunk"]
    left = asks.join(chunks, "bucket").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    right = placed.join(chunks, "bucket").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def nearest(asked: pa.Table, block: pa.Table) -> pa.Table:
        best = asked.column("best").to_numpy()
        if len(asked):
            best = _closest(_matrix(asked.column("point"), dims), best, _matrix(block.column("point"), dims))
        return asked.select(["id", "point", "n"]).append_column("best", pa.array(best))

    return (
        left.select(*keys, "id", "point", "n", "best")
        .groupBy(*keys)
        .cogroup(right.select(*keys, "point").groupBy(*keys))
        .applyInArrow(nearest, "id bigint, point array<double>, n bigint, best double")
    )


def _route(boxes, nodes, low: int, high: int, dims: int):
    """Asks of the buckets, other than a point's own, that are ``low`` to ``high`` in order of distance
    from it and nearer than its best; bucket -1 where there is none, the point is done."""

    def run(batches):
        buckets, lows, highs = boxes.value
        for whole in batches:
            points, best = _matrix(whole.column(1), dims), whole.column(3).to_numpy(zero_copy_only=False)
            home = _cell(points, nodes.value)
            for at in _cut(points, BUCKET_ROWS, len(points))[0] if len(points) else []:
                group, mine = points[at], best[at]
                # few boxes are nearer to a group of neighbours than the worst of their bests
                close = np.flatnonzero(_gaps(group.min(axis=0)[None], group.max(axis=0)[None], lows, highs)[0] < mine.max())
                step = max(1, PAIRS_AT_ONCE // max(1, len(close)))
                for start in range(0, len(at), step):
                    part = slice(start, start + step)
                    away = _gaps(group[part], group[part], lows[close], highs[close])
                    away[(away >= mine[part][:, None]) | (buckets[close][None, :] == home[at[part]][:, None])] = np.inf
                    near = np.isfinite(away)
                    rank = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1) if near.sum(axis=1).max(initial=0) > high - low or low else np.zeros(away.shape, int) + low
                    rows, col = np.nonzero(near & (rank >= low) & (rank < high))
                    done = np.setdiff1d(np.arange(len(away)), rows)
                    goal = np.concatenate([buckets[close[col]], np.full(len(done), -1)])
                    out = whole.take(pa.array(at[part][np.concatenate([rows, done])]))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(goal.astype(np.int64))], names=["id", "point", "n", "best", "bucket"])

    return run


def nearest_distances(real_points: DataFrame, synth_points: DataFrame) -> DataFrame:
    """(point, n, distance): exact nearest real distance of every synthetic point.

    Input frames have one ``point array<double>`` column. Copies are merged
    first. A point asks the bucket it falls into; after that only buckets whose
    box is nearer than its best, the nearest first, 64 at most a round.
    """
    spark = real_points.sparkSession
    merged = synth_points.groupBy("point").agg(F.count("*").alias("n"))
    real, synth = build_together(spark, [lambda: settle(real_points.distinct(), "real-points"), lambda: settle(merged, "synth-points")])
    n, dims = real.agg(F.count("*"), F.max(F.size("point"))).first()
    if not n:
        return synth.withColumn("distance", F.lit(None).cast("double"))
    nodes = _tree(real, n, dims)
    placed = settle(_placed(real, nodes, dims), "placed")
    box = placed.groupBy("bucket").agg(*_boxes(dims)).orderBy("bucket").collect()  # one row per bucket, BUCKETS at most
    buckets = np.array([r["bucket"] for r in box])
    boxes = spark.sparkContext.broadcast((buckets, np.array([r["low"] for r in box]), np.array([r["high"] for r in box])))
    tree = spark.sparkContext.broadcast(nodes)
    first = synth.select(F.monotonically_increasing_id().alias("id"), "point", "n", F.lit(float("inf")).alias("best"))
    asks = settle(_placed(first, nodes, dims), "asked")
    active = settle(_ask(asks, placed, dims), "nearest")
    finished, low, turn = [], 0, 0
    while low < len(box):
        high = WINDOWS[turn] if turn < len(WINDOWS) else low + WINDOW
        asked = settle(active.mapInArrow(_route(boxes, tree, low, high, dims), ASKS), "asked")
        finished.append(asked.where("bucket < 0").select("point", "n", "best"))
        open_ = asked.where("bucket >= 0")
        if not open_.head(1):
            active = None
            break
        answers = _ask(open_, placed, dims)
        active = settle(answers.groupBy("id").agg(F.any_value("point").alias("point"), F.any_value("n").alias("n"), F.min("best").alias("best")), "nearest")
        low, turn = high, turn + 1
    if active is not None:  # every bucket was asked
        finished.append(active.select("point", "n", "best"))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select("point", "n", F.sqrt("best").alias("distance"))


def points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One ``point`` array per row; rows with a null or NaN feature are left out."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(complete).select(F.array(*[F.col(c).cast("double") for c in columns]).alias("point"))


def _whole_points(real, synth, numeric, categorical, scaled: Sequence[str], fit_on: str, epsilon: float) -> tuple[DataFrame, DataFrame]:
    columns = [*numeric, *categorical]
    r, s = real.select(*columns), synth.select(*columns)
    if categorical:
        codes = encoding.dictionary([real, synth], categorical)
        r, s = encoding.encode(r, codes, categorical), encoding.encode(s, codes, categorical)
    stats = encoding.scale_stats(r if fit_on == "real" else r.unionByName(s), scaled)
    return tuple(points(encoding.standardize(df, stats, scaled, epsilon), columns) for df in (r, s))


def distance_stats(near: DataFrame) -> DataFrame:
    """One row over (distance, n): mean, median, least, greatest and deviation, all exact."""
    by_distance = settle(near.groupBy("distance").agg(F.sum("n").alias("n")), "distances").withColumn("all", F.lit(0))
    total = by_distance.agg(F.sum("n")).scalar()
    run = running_totals(by_distance, ["all"], "distance", ["n"])

    def holds(rank):
        return (F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n"))

    k0, k1 = F.floor((total - 1) / 2), F.ceil((total - 1) / 2)
    d, n = F.col("distance"), F.col("n")
    mean = F.sum(d * n) / F.sum("n")
    return run.agg(
        mean.alias("mean_dcr"),
        ((F.max(F.when(holds(k0), d)) + F.max(F.when(holds(k1), d))) / 2).alias("median_dcr"),
        F.min("distance").alias("min_dcr"),
        F.max("distance").alias("max_dcr"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(d * d * n) / F.sum("n") - mean * mean)).alias("std_dcr"),
        F.coalesce(F.sum(F.when(d < MATCH_DISTANCE, n)), F.lit(0)).alias("exact_matches"),
        F.sum("n").alias("n_compared"),
    )


def dcr_full(real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """The distance statistics over whole tables, scaled by the whole real table."""
    columns = [*numeric, *categorical]
    return dcr_summary(distance_stats(nearest_distances(*_whole_points(real, synth, numeric, categorical, columns, "real", 1e-10))))


def dcr_evaluator_full(real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Evaluator variant over whole tables: numbers scaled on the union, label codes unscaled."""
    stats = distance_stats(nearest_distances(*_whole_points(real, synth, numeric, categorical, list(numeric), "union", 0.0)))
    out = stats.select("mean_dcr", "median_dcr", "min_dcr", "max_dcr", "std_dcr")
    return out.withColumn("dcr_score", F.least(F.lit(100.0), F.col("mean_dcr") * 100))
