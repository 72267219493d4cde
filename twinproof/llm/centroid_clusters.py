"""K-means in whole numbers over dictionaries of distinct subvectors.

Vectors are cut into blocks of dimensions. Groups of rows (a task's rows, a bounded
number at a time) are dictionary-encoded without loss: for each block the distinct
subvectors, and one code a row. Encoded groups are written once. A round then works
on the dictionaries: the distance of each distinct subvector to each centroid's block
is computed once, a row's distance is the sum of the entries its codes point at, and
the sums of a cluster are its code counts times the subvectors. All arithmetic is in
64-bit integers, so every task and layout gives the same result. Only one row per
cluster leaves a task: (cluster, rows, sums, distance).

Defined results: vectors that are null, have another size, or hold null or
non-finite components give no row; with fewer than ``k`` vectors there are as many
centroids as vectors (none for an empty table); equal hashes are ordered by the vector;
a null id is hashed as the empty text; repeated rows are clustered and returned each;
extra columns are ignored. Scaled components beyond 2^27 in size are refused with an
error, as their squared distance may not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.llm.tables import table
from twinproof.session import settle

DIMENSIONS, K, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
BLOCK = 8  # dimensions of a subvector
GROUP = 1 << 14  # rows of one set of dictionaries
LARGEST = 1 << 27
SPARE = 16  # how many times more candidates than centroids the hash threshold lets through


def usable(name: str, dimensions: int = DIMENSIONS) -> Column:
    """Vectors the clustering keeps; false, never null, for the others."""
    finite = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(name).isNotNull() & (F.size(name) == dimensions) & finite, F.lit(False))


def _whole(rows: pa.Array, dimensions: int) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(flat * SCALE)
    if len(out) and np.abs(out).max() >= LARGEST:
        raise ValueError(f"a scaled component is {np.abs(out).max():.0f}; distances are exact below {LARGEST}")
    return out.astype(np.int64).reshape(-1, dimensions)


def _books(x: np.ndarray, block: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct subvectors of each block and the codes of the rows, (blocks, rows)."""
    books, codes = [], []
    for at in range(0, x.shape[1], block):
        part = np.ascontiguousarray(x[:, at : at + block], np.int32)
        _, first, code = np.unique(part.view(f"V{part.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)
        books.append(part[first])
        codes.append(code.ravel())
    return books, np.array(codes, np.uint16)


def _encode(dimensions, block, group):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                rows = batch.slice(at, group)
                books, codes = _books(_whole(rows.column(1), dimensions), block)
                ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([codes.tobytes()], pa.binary()), pa.array([[len(b) for b in books]], pa.list_(pa.int32())), pa.array([b"".join(b.tobytes() for b in books)], pa.binary())],
                    names=["ids", "codes", "sizes", "books"],
                )

    return run


def encoded(vectors: DataFrame, dimensions: int = DIMENSIONS, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Groups of rows (ids, codes, sizes, books), written once; ``vectors``: (vec_id, embedding), usable ones."""
    if group > 1 << 16:
        raise ValueError("codes have 16 bits")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", "embedding").mapInArrow(_encode(dimensions, block, group), f"ids array<{kind}>, codes binary, sizes array<int>, books binary")
    return settle(rows, "subvectors")


def _groups(batches, dimensions, block):
    """(ids, codes, books) of each stored group."""
    widths = [min(block, dimensions - at) for at in range(0, dimensions, block)]
    for batch in batches:
        ids = batch.column(0)
        for i in range(batch.num_rows):
            codes = np.frombuffer(batch.column(1)[i].as_py(), np.uint16).reshape(len(widths), -1)
            flat, books, at = np.frombuffer(batch.column(3)[i].as_py(), np.int32), [], 0
            for size, width in zip(batch.column(2)[i].as_py(), widths):
                books.append(flat[at : at + size * width].reshape(size, width).astype(np.int64))
                at += size * width
            yield ids[i].values, codes, books


def nearest(codes: np.ndarray, books: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of a tie) and the squared distance."""
    total, at = np.zeros((codes.shape[1], len(centroids)), np.int64), 0
    for code, book in zip(codes, books):
        part = np.empty((len(book), len(centroids)), np.int64)
        for c, centre in enumerate(centroids[:, at : at + book.shape[1]]):
            away = book - centre
            part[:, c] = np.einsum("ij,ij->i", away, away)
        total += part[code]
        at += book.shape[1]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best]


def _round(state, dimensions, block):
    def run(batches):
        centroids = state.value
        k = len(centroids)
        rows, sums, away = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64), [0] * k
        for _, codes, books in _groups(batches, dimensions, block):
            best, distance = nearest(codes, books, centroids)
            at = 0
            for code, book in zip(codes, books):
                met = np.bincount(best * len(book) + code, minlength=k * len(book)).reshape(k, len(book))
                sums[:, at : at + book.shape[1]] += met @ book
                at += book.shape[1]
            rows += np.bincount(best, minlength=k)
            for c in np.unique(best):
                away[c] += int(distance[best == c].sum())
        own = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(rows[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64())), pa.array([away[c] for c in own], pa.int64())],
            names=["cluster", "n", "sums", "away"],
        )

    return run


def _totals(groups: DataFrame, centroids: np.ndarray, block: int) -> dict[int, tuple[int, list[int], int]]:
    """cluster: (rows, sums, distance) over all groups; at most one row per centroid reaches the driver."""
    dimensions = centroids.shape[1]
    state = groups.sparkSession.sparkContext.broadcast(centroids)
    parts = groups.mapInArrow(_round(state, dimensions, block), "cluster bigint, n bigint, sums array<bigint>, away bigint")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    found = parts.groupBy("cluster").agg(
        exact(F.col("n")).alias("n"), F.array(*[exact(F.col("sums")[d]) for d in range(dimensions)]).alias("sums"), exact(F.col("away")).alias("away")
    )
    out = {r["cluster"]: (int(r["n"]), [int(s) for s in r["sums"]], int(r["away"])) for r in found.collect()}
    state.unpersist()
    return out


def first_centroids(vectors: DataFrame, rows: int, k: int = K, seed: int = SEED) -> list[list[float]]:
    """The ``k`` vectors of smallest hash. A threshold on the hash, from the number of
    rows, lets through a few of each ``k`` only, so the ordering sees little; it
    is raised where repeated ids leave too few."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    hashed = vectors.select(digest.alias("digest"), F.col("embedding").cast("array<double>").alias("embedding"))
    share = k * SPARE / max(1, rows)
    while True:
        near = hashed if share >= 1 else hashed.where(F.col("digest") < f"{int(share * 16**12):012x}")
        found = near.orderBy("digest", "embedding").limit(k).collect()
        if len(found) == k or share >= 1:
            return [r["embedding"] for r in found]
        share *= SPARE


def _assign(state, dimensions, block, kind):
    def run(batches):
        centroids, inertia, total, digests = state.value
        for ids, codes, books in _groups(batches, dimensions, block):
            best, distance = nearest(codes, books, centroids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(best.astype(np.int32)), pa.array(distance), pa.array(inertia[best]), pa.array(np.full(len(best), total)), pa.array(digests, pa.string()).take(pa.array(best))],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return run


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable
    vector of ``vectors`` (vec_id, embedding), and the final centroids."""
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", "embedding").where(usable("embedding", dimensions))
    groups = encoded(kept, dimensions, block)
    n = groups.agg(F.sum(F.size("ids"))).first()[0] or 0
    start = np.array(first_centroids(kept, n, k, seed), np.float64).reshape(-1, dimensions)
    centroids = np.floor(start * SCALE).astype(np.int64)
    for _ in range(rounds if n else 0):
        for c, (rows, sums, _away) in _totals(groups, centroids, block).items():
            centroids[c] = [s // rows for s in sums]  # floor, below zero too
    inertia = np.zeros(max(1, len(centroids)), np.int64)
    for c, (_, _, away) in (_totals(groups, centroids, block) if n else {}).items():
        inertia[c] = away
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    kind = vectors.schema["vec_id"].dataType.simpleString()
    state = spark.sparkContext.broadcast((centroids, inertia, int(inertia.sum()), digests))
    out = groups.mapInArrow(
        _assign(state, dimensions, block, kind), f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return out, centroids


def op12_centroids(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))[0]


def _sql() -> str:
    """The rounds written out: long form (vector, dimension, value), one pair of CTEs a round."""
    steps = [
        r"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), v AS MATERIALIZED (
  SELECT r, d, CAST(floor(256 * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x
  FROM kept, range(1, 65) AS g(d)
), c0 AS MATERIALIZED (
  SELECT s.c, v.d, v.x FROM v JOIN (
    SELECT r, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), embedding) - 1 AS c FROM kept
    QUALIFY c < 40
  ) s USING (r)
)"""
    ]
    assign = r"""a{n} AS MATERIALIZED (
  SELECT r, min_by(c, (s, c)) AS c, min(s) AS s
  FROM (SELECT v.r, k.c, CAST(sum((v.x - k.x) * (v.x - k.x)) AS BIGINT) AS s FROM v JOIN c{n} k USING (d) GROUP BY v.r, k.c)
  GROUP BY r
)"""
    move = r"""c{m} AS MATERIALIZED (
  SELECT o.c, o.d, coalesce(n.x, o.x) AS x FROM c{n} o LEFT JOIN (
    SELECT a.c, v.d, CAST((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM v JOIN a{n} a USING (r) GROUP BY a.c, v.d
  ) n ON n.c = o.c AND n.d = o.d
)"""
    for n in range(ROUNDS):
        steps += [assign.format(n=n), move.format(n=n, m=n + 1)]
    steps.append(assign.format(n=ROUNDS))
    return (
        "WITH "
        + ", ".join(steps)
        + f""", h AS (
  SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c
)
SELECT kept.vec_id, CAST(a.c AS INTEGER) AS cluster, a.s AS distance,
       CAST(sum(a.s) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.s) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (r) JOIN h ON h.c = a.c"""
    )


OP12_SQL = _sql()
