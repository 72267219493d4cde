"""N-gram Jaccard join: documents whose sets of word shingles overlap enough.

Exact throughout. One pass turns each text into its sorted set of 64-bit shingle
hashes, a bitmap of about two bits per shingle and the keys of its prefix: two
sets with Jaccard >= t share one of their first n - ceil(t n) + 1 shingles in any
common order. The order is rarest first by a frequency sketch of fixed size over all
texts; how good the sketch is changes the cost only, never the result.

Equal sets are one class from then on, so copies cost nothing. The members of a key
are first compared, text by text, with its two outermost members, which joins the large groups of
near copies at linear cost. Members left in different components meet in tiles: a
group of m members is cut into ceil(m / TILE) pieces, and each pair of pieces is a
tile of at most 2 TILE rows, so no task or group is unbounded however popular a key
is. Inside a tile, sizes outside the band t are skipped, and the bit count of the two
bitmaps' difference bounds the overlap from above. Rows with a partner within the
bound meet once more, with their whole sets: sorted arrays are intersected exactly in the
tile, rows already connected need no test, and only links that connect something
leave it, fewer than a tile has rows. So no pair of a large group is ever a row.

Defined results: null and empty texts and texts without words have an empty set,
link with nothing and are their own component; a text of fewer words than a
shingle is one shingle; rows with one id are rows of their own, a group is named
by its smallest id (null ids are larger than any); extra columns pass through.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.components import components
from twinproof.llm.tables import located, table
from twinproof.session import settle

WORDS, PERCENT = 3, 90
TILE = 1024
FEW = 16  # rows of a tile that are compared one by one
POSTINGS = 1 << 22  # postings of a set that are counted at once
SKETCH_BITS = 24  # cells of the frequency sketch: its size in bytes, fixed
SEGMENTS = 64  # parts in which the sketch is added up
CACHE = 1 << 17  # words whose hash a task remembers

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
S29, S32 = np.uint64(29), np.uint64(32)


def shingles(text: bytes | None, words: int, seen: dict) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; A-Z count as a-z."""
    own = text.lower().split() if text else []
    if not own:
        return np.zeros(0, np.uint64)
    if len(seen) > CACHE:
        seen.clear()
    for w in set(own).difference(seen):
        seen[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, own), np.uint64, len(own))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * A
        out ^= out >> S29
        out *= B
        out ^= out >> S32
    return np.unique(out)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(hashes: np.ndarray) -> bytes:
    """A power of two of bits, two to four for each shingle."""
    bits = np.zeros(1 << max(6, math.ceil(math.log2(2 * len(hashes)))), np.uint8)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(na: int, nb: int, a: int, la: int, b: int, lb: int, percent: int) -> bool:
    """Whether the sets can still reach the threshold. The longer bitmap is folded;
    each differing bit is a shingle that only one of the two has."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    while la > lb:
        la //= 2
        a = (a >> la) | (a & ((1 << la) - 1))
    while lb > la:
        lb //= 2
        b = (b >> lb) | (b & ((1 << lb) - 1))
    overlap = (na + nb - (a ^ b).bit_count()) // 2
    return 100 * overlap >= percent * (na + nb - overlap)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count_cells(words):
    """A task's counts by cell, as packed segments."""

    def run(batches):
        seen: dict = {}
        total = np.zeros(1 << SKETCH_BITS, np.uint8)
        for batch in batches:
            for text in batch.column(0):
                cell = _cells(shingles(text.as_py(), words, seen))
                now = total[cell]
                total[cell] = now + (now < 255)
        for i, part in enumerate(total.reshape(SEGMENTS, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["segment", "counts"])

    return run


def _add_cells(batches):
    total: dict = {}
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(data), np.uint8)
            total[i] = np.minimum(total[i] + part.astype(np.uint16), 255) if i in total else part.astype(np.uint16)
    for i, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.astype(np.uint8).tobytes(), 1)], pa.binary())], names=["segment", "counts"])


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How often the shingles of each hashed cell occur, over all texts, up to 255.
    Its size is fixed (2 ** SKETCH_BITS bytes), whatever the corpus."""
    made = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_count_cells(words), "segment int, counts binary")
    out = np.zeros((SEGMENTS, (1 << SKETCH_BITS) // SEGMENTS), np.uint8)
    for batch in made.repartition("segment").mapInArrow(_add_cells, "segment int, counts binary").toArrow().to_batches():
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out[i] = np.frombuffer(zlib.decompress(data), np.uint8)
    return out.ravel()


def _profile(words, percent, sent):
    def run(batches):
        seen: dict = {}
        counts = sent.value
        for batch in batches:
            n, d1, d2, maps, keys = [], [], [], [], []
            for text in batch.column(0):
                own = shingles(text.as_py(), words, seen)
                n.append(len(own))
                if not len(own):
                    d1.append(None), d2.append(None), maps.append(None), keys.append(None)
                    continue
                whole = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                d1.append(int(whole[0])), d2.append(int(whole[1])), maps.append(bitmap(own))
                # rare shingles first, then by hash: the prefix of a text that shares
                # much with others holds what is its own
                own = own[np.argsort(counts[_cells(own)], kind="stable")]
                keys.append(own[: prefix_size(len(own), percent)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(maps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *(batch.column(c) for c in (1, 2, 3))],
                names=["n", "d1", "d2", "bits", "keys", "doc_id", "a", "b"],
            )

    return run


def _tiles(percent):
    """The rows of each tile that have a partner in it whose size and bitmap allow a link; a tile's rows follow one another."""

    def few(mine):
        """``mine`` by size: a partner outside the band ends the inner loop."""
        mine = [(n, int.from_bytes(bits, "little"), 8 * len(bits), s, r) for _, n, bits, s, r in mine]
        near = [False] * len(mine)
        for i, (n, x, lx, s, r) in enumerate(mine):
            for j in range(i + 1, len(mine)):
                m, y, ly, t, q = mine[j]
                if 100 * n < percent * m:
                    break
                # pieces i < j: members of one piece meet in their own tile
                if not (near[i] and near[j]) and r != q and (s == 2 or s != t) and may_link(n, m, x, lx, y, ly, percent):
                    near[i] = near[j] = True
        return near

    def many(mine):
        """The same with whole arrays; lengths never fall as sizes rise, and inside the band they double at most once for t > 1/2."""
        n, side, root = (np.array([r[k] for r in mine]) for k in (1, 3, 4))
        length = np.array([len(r[2]) // 8 for r in mine])
        blocks = {w: np.frombuffer(b"".join(r[2] for r in mine if len(r[2]) == 8 * w), np.uint64).reshape(-1, w) for w in set(length.tolist())}
        start = {w: int(np.searchsorted(length, w)) for w in blocks}
        folded = {w // 2: b[:, : w // 2] | b[:, w // 2 :] for w, b in blocks.items() if w > 1}
        end = np.searchsorted(n, 100 * n // percent, side="right")
        near = np.zeros(len(mine), bool)
        for i, w in enumerate(length.tolist()):
            x = blocks[w][i - start[w]]
            for at, own in ((start[w], blocks[w]), (start.get(2 * w, 0), folded.get(w))):
                if own is None:
                    continue
                lo, hi = max(i + 1, at), min(int(end[i]), at + len(own))
                if lo >= hi:
                    continue
                apart = np.bitwise_count(own[lo - at : hi - at] ^ x).sum(axis=1, dtype=np.int64)
                overlap = (n[i] + n[lo:hi] - apart) // 2
                ok = (100 * overlap >= percent * (n[i] + n[lo:hi] - overlap)) & ((side[i] == 2) | (side[lo:hi] != side[i])) & (root[lo:hi] != root[i])
                near[lo:hi] |= ok
                near[i] |= ok.any()
        return near.tolist()

    def found(tile, rows):
        rows.sort(key=lambda r: (r[1], r[0]))
        near = (few if len(rows) <= FEW else many)(rows) if len(rows) > 1 else [False] * len(rows)
        return [(*tile, r[3], r[0], r[1], r[4]) for r, ok in zip(rows, near) if ok]

    def out(made):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if k in (1, 2, 3) else pa.int64()) for k, c in enumerate(zip(*made))] if made else [pa.array([], pa.int32() if k in (1, 2, 3) else pa.int64()) for k in range(7)], names=["key", "i", "j", "side", "uid", "n", "root"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            made: list = []
            cols = [c.to_pylist() for c in batch.columns]
            for key, i, j, side, uid, n, bits, root in zip(*cols):
                if (key, i, j) != now:
                    made += found(now, rows)
                    now, rows = (key, i, j), []
                rows.append((uid, n, bits, side, root))
            yield out(made)
        yield out(found(now, rows))

    return run


def overlaps(sets: list[np.ndarray], i: int, postings: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """How many elements set ``i`` shares with each set: its elements' postings, counted by row."""
    first, rows, codes = postings
    own = codes[i]
    total = np.zeros(len(sets), np.int64)
    size = first[own + 1] - first[own]
    upto = np.cumsum(size)
    at = 0
    while at < len(own):  # a bounded number of postings at a time
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + POSTINGS, "right")))
        part, own_size = first[own[at:stop]], size[at:stop]
        ends = np.cumsum(own_size)
        total += np.bincount(rows[np.repeat(part - ends + own_size, own_size) + np.arange(ends[-1])], minlength=len(sets))
        at = stop
    return total


def _decide(percent):
    """Links of each tile that span what they connect, found by exact intersection of the sets. Rows that are
    connected, by links found before or in the tile, need no test; a tile emits fewer links than rows."""

    def links(rows):
        rows.sort(key=lambda r: (r[2], r[1]))
        side, uid, n, root = (np.array([r[k] for r in rows]) for k in range(4))
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        cuts = np.cumsum([len(x) for x in sets])[:-1]
        codes = np.split(flat, cuts)
        order = np.argsort(flat, kind="stable")
        first = np.searchsorted(flat[order], np.arange(flat.max() + 2 if len(flat) else 1))
        postings = first, np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order], codes
        end = np.searchsorted(n, 100 * n // percent, side="right")
        group = np.unique(root, return_inverse=True)[1]
        out = []
        for i in range(len(rows)):
            lo, hi = i + 1, int(end[i])
            may = ((side[i] == 2) | (side[lo:hi] != side[i])) & (group[lo:hi] != group[i])
            if not may.any():
                continue
            both = overlaps(sets, i, postings)[lo:hi]
            for k in np.flatnonzero(may & (100 * both >= percent * (n[i] + n[lo:hi] - both))) + lo:
                if group[k] != group[i]:
                    group[group == group[k]] = group[i]
                    out.append((min(uid[i], uid[k]), max(uid[i], uid[k])))
        return out

    def run(batches):
        now, rows = None, []

        def done():
            found = links(rows) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for at in range(batch.num_rows):
                key, i, j, *row = (c[at].as_py() for c in batch.columns)
                if (key, i, j) != now:
                    yield done()
                    now, rows = (key, i, j), []
                rows.append(row)
        yield done()

    return run


def _sets(words):
    def run(batches):
        seen: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), words, seen).tobytes() for t in batch.column(1)], pa.binary())], names=["uid", "elements"])

    return run


def _bounded(percent):
    """Pairs (u, v) whose sizes and bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            _, _, na, nb, a, b = (c.to_pylist() for c in batch.columns)
            keep = pa.array([may_link(n, m, int.from_bytes(x, "little"), 8 * len(x), int.from_bytes(y, "little"), 8 * len(y), percent) for n, m, x, y in zip(na, nb, a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


def _verify(words, percent):
    def run(batches):
        seen: dict = {}
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = shingles(x.as_py(), words, seen), shingles(y.as_py(), words, seen)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(located docs, rows, edges). rows: uid, doc_id, a, b (the row's place), n_shingles,
    component_id, kept (one row of each component). edges: links (u, v) that span the components, of uids that stand for classes of equal sets."""
    spark = docs.sparkSession
    docs, a, b = located(docs)
    counts = spark.sparkContext.broadcast(sketch(docs, words))
    slim = docs.select(F.col("text").cast("binary").alias("text"), "doc_id", F.col(a).alias("a"), F.col(b).alias("b"))
    kind = dict(slim.dtypes)["doc_id"]
    profile = slim.mapInArrow(_profile(words, percent, counts), f"n bigint, d1 bigint, d2 bigint, bits binary, keys array<bigint>, doc_id {kind}, a bigint, b bigint")
    profile = settle(profile.withColumn("uid", F.monotonically_increasing_id()), "shingle-sets")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    classes = settle(profile.where("n > 0").groupBy("d1", "d2").agg(first).select("d1", "d2", F.col("first.uid").alias("uid"), "first"), "shingle-classes")
    own = profile.join(classes.select("uid"), "uid", "left_semi")
    keyed = own.select("uid", F.explode("keys").alias("key"))
    # keys with the same members say the same: one of them stays (members are told by 128 bits)
    who = (F.bit_xor(F.xxhash64("uid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("x2"), F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *who).where("m > 1").groupBy("m", "x1", "x2").agg(F.min(F.struct("key", "lo", "hi")).alias("k"))
    members = settle(keyed.join(settle(shared.select("k.*", "m"), "shingle-keys"), "key"), "shingle-members")

    def texts_of(wanted: DataFrame) -> DataFrame:
        places = profile.join(wanted, "uid").select("uid", F.col("a").alias("pa"), F.col("b").alias("pb"))
        return slim.select("text", "a", "b").join(places, (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb"))).select("uid", "text")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose texts overlap enough, by exact intersection."""
        texts = settle(texts_of(pairs.select(F.col("u").alias("uid")).union(pairs.select(F.col("v").alias("uid"))).distinct()), "shingle-texts")
        left = texts.select(F.col("uid").alias("u"), F.col("text").alias("x"))
        right = texts.select(F.col("uid").alias("v"), F.col("text").alias("y"))
        return settle(pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(_verify(words, percent), "u bigint, v bigint"), "shingle-links")

    # First, all members of a key against its two outermost ones: as many pairs as members.
    inner = members.where("uid <> lo and uid <> hi")
    stars = members.where("uid <> lo").select(F.col("lo").alias("u"), F.col("uid").alias("v")).union(inner.select(F.col("uid").alias("u"), F.col("hi").alias("v"))).distinct()
    sizes = own.select("uid", "n", "bits")
    ends = stars.join(sizes.select(F.col("uid").alias("u"), F.col("n").alias("na"), F.col("bits").alias("x")), "u").join(sizes.select(F.col("uid").alias("v"), F.col("n").alias("nb"), F.col("bits").alias("y")), "v")
    near = settle(ends.select("u", "v", "na", "nb", "x", "y").mapInArrow(_bounded(percent), "u bigint, v bigint"), "shingle-pairs")
    edges = verified(near)
    tree = settle(components(edges).withColumnRenamed("id", "uid"), "shingle-trees")

    # Then, members that are still in different components, tile by tile.
    placed = inner.join(tree, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    opened = placed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key")
    pieces = F.ceil(F.col("m") / TILE).cast("int")
    piece = F.pmod(F.xxhash64("uid"), pieces).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    tiles = placed.join(opened, "key", "left_semi").select("key", "uid", "root", pieces.alias("pieces"), piece.alias("piece")).select("key", "uid", "root", "piece", other.alias("other"))
    side = F.when(F.col("piece") == F.col("other"), 2).when(F.col("piece") < F.col("other"), 0).otherwise(1)
    tiles = tiles.join(sizes, "uid").select("key", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), side.alias("side"), "uid", "n", "bits", "root")
    tiles = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rest = settle(tiles.mapInArrow(_tiles(percent), "key bigint, i int, j int, side int, uid bigint, n bigint, root bigint"), "shingle-tiles")
    if rest.head(1):
        elements = settle(texts_of(rest.select("uid").distinct()).mapInArrow(_sets(words), "uid bigint, elements binary"), "shingle-elements")
        whole = rest.join(elements, "uid").select("key", "i", "j", "side", "uid", "n", "root", "elements")
        whole = whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = settle(whole.mapInArrow(_decide(percent), "u bigint, v bigint").distinct(), "shingle-links")
        edges = edges.union(more)
        tree = components(edges).withColumnRenamed("id", "uid")

    # classes by component: the smallest first row names it and is the one kept
    rooted = classes.join(tree, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    best = rooted.groupBy("root").agg(F.min("first").alias("head"))
    named = rooted.join(best, "root").select("d1", "d2", F.col("head.doc_id").alias("component_id"), F.col("head.uid").alias("head"))
    out = profile.drop("bits", "keys").join(named, ["d1", "d2"], "left")
    alone = F.col("n") == 0
    rows = out.select("uid", "doc_id", "a", "b", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("uid") == F.col("head"))).alias("kept"))
    return docs, rows, edges


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return join(docs, words, percent)[1].select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component."""
    names = docs.columns
    placed, rows, _ = join(docs, words, percent)
    a, b = placed.columns[-2:]
    gone = rows.where(~F.col("kept")).select(F.col("a").alias(f"{a}_gone"), F.col("b").alias(f"{b}_gone"))
    left = placed.join(gone, (F.col(a) == F.col(f"{a}_gone")) & (F.col(b) == F.col(f"{b}_gone")), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in names])


def op9_shingle_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
