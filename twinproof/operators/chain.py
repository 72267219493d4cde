"""Hash chains that are built and verified in parallel.

A chain over a whole log is sequential by definition. Here entries are
chained inside blocks of bounded size, block heads are chained inside epochs
of bounded size, and so on up to one root. Every fold is small, and changing
any entry still changes every hash above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinproof.functions.scalar import row_sha
from twinproof.session import settle

BLOCK_ENTRIES = 250
EPOCH_BLOCKS = 250


def seed(level: int, group: Column) -> Column:
    """Where the chain of one block or epoch starts."""
    return F.sha2(F.concat(F.lit(f"genesis:{level}:"), group.cast("string")), 256)


def link(previous: Column, digest: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit(":"), digest), 256)


def fold(nodes: DataFrame, group: str, order: str, digest: str, level: int, after: tuple[int, str] | None = None) -> DataFrame:
    """(group, order, digest, previous_hash, hash): chain inside each group.

    Groups hold a fixed number of nodes at most, by construction. ``after`` is a group
    that goes on behind a hash it has already.
    """
    start = seed(level, F.col(group))
    if after is not None:
        start = F.when(F.col(group) == after[0], F.lit(after[1])).otherwise(start)
    items = nodes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, digest))).alias("items"))
    hashes = F.aggregate(
        "items",
        F.array(start),
        lambda done, item: F.concat(done, F.array(link(F.element_at(done, -1), item[digest]))),
    )
    zipped = items.withColumn("hashes", hashes).select(group, F.posexplode("items").alias("i", "item"), "hashes")
    return zipped.select(
        group,
        f"item.{order}",
        f"item.{digest}",
        F.col("hashes")[F.col("i")].alias("previous_hash"),
        F.col("hashes")[F.col("i") + 1].alias("hash"),
    )


def build(entries: DataFrame, seq: str, payload: Sequence[str], block_entries: int = BLOCK_ENTRIES, after: tuple[int, str] | None = None) -> DataFrame:
    """Entries with ``block``, ``previous_hash`` and ``entry_hash``.

    ``seq`` numbers the log from 0 without repeats. ``after`` is the last number
    and hash of a log that these entries go on with.
    """
    goes_on = None if after is None else (after[0] // block_entries, after[1])
    keyed = entries.withColumn("block", F.floor(F.col(seq) / block_entries)).withColumn("_digest", row_sha(entries, payload))
    if after is not None and (after[0] + 1) % block_entries == 0:
        goes_on = None  # its last block is full
    chained = fold(keyed, "block", seq, "_digest", 0, goes_on).select(seq, "previous_hash", F.col("hash").alias("entry_hash"))
    return keyed.drop("_digest").join(chained, seq)


def verify(log: DataFrame, seq: str, payload: Sequence[str]) -> DataFrame:
    """(seq, issue, expected, found): every broken entry or link of a log.

    Each entry is rehashed from its stored predecessor hash, and compared with
    the hash stored one entry earlier, all in parallel.
    """
    digest = row_sha(log, payload)
    before = F.lag("entry_hash").over(Window.partitionBy("block").orderBy(seq))
    checked = log.select(
        seq,
        "entry_hash",
        "previous_hash",
        link(F.col("previous_hash"), digest).alias("_computed"),
        F.coalesce(before, seed(0, F.col("block"))).alias("_before"),
    )
    problems = F.array(
        F.when(
            ~F.col("entry_hash").eqNullSafe(F.col("_computed")),
            F.struct(F.lit("hash_mismatch").alias("issue"), F.col("entry_hash").alias("expected"), F.col("_computed").alias("found")),
        ),
        F.when(
            ~F.col("previous_hash").eqNullSafe(F.col("_before")),
            F.struct(F.lit("chain_break").alias("issue"), F.col("_before").alias("expected"), F.col("previous_hash").alias("found")),
        ),
    )
    return checked.select(seq, F.explode(F.array_compact(problems)).alias("p")).select(seq, "p.*")


def verification_summary(log: DataFrame, issues: DataFrame) -> DataFrame:
    found = issues.agg(F.count("*")).scalar()
    return log.agg(F.count("*").alias("total_entries")).select(
        (found == 0).alias("integrity_valid"), "total_entries", found.alias("issues_found")
    )


def block_heads(log: DataFrame, seq: str) -> DataFrame:
    """(level 0, index, n, digest): the last entry hash of each block."""
    return log.groupBy(F.col("block").alias("index")).agg(
        F.count("*").alias("n"), F.max_by("entry_hash", seq).alias("digest")
    )


def seal(heads: DataFrame, epoch_blocks: int = EPOCH_BLOCKS) -> DataFrame:
    """(level, index, epoch, digest, previous_hash, hash) up to a single root.

    ``heads`` has (index, digest) per block. Each level folds at most
    ``epoch_blocks`` nodes per task; the number of levels grows with the
    logarithm of the log.
    """
    nodes = settle(heads.select("index", "digest"), "heads")
    last = nodes.agg(F.max("index")).first()[0]
    level, out = 1, None
    while last is not None:
        grouped = nodes.withColumn("epoch", F.floor(F.col("index") / epoch_blocks))
        sealed = settle(fold(grouped, "epoch", "index", "digest", level).withColumn("level", F.lit(level)), "sealed")
        out = sealed if out is None else out.unionByName(sealed)
        if last < epoch_blocks:
            break
        nodes = sealed.groupBy(F.col("epoch").alias("index")).agg(F.max_by("hash", "index").alias("digest"))
        last = last // epoch_blocks
        level += 1
    return out


def root(sealed: DataFrame) -> DataFrame:
    """One row: the hash that stands for the whole log."""
    return sealed.agg(F.max_by("hash", F.struct("level", "index")).alias("root"))


def verify_blocks(sealed: DataFrame, heads: DataFrame) -> DataFrame:
    """(level, index, issue) of sealed blocks whose digest, hash or link is wrong."""
    own = Window.partitionBy("level", "epoch").orderBy("index")
    recomputed = heads.select(F.lit(1).alias("level"), "index", F.col("digest").alias("_now"))
    start = F.sha2(F.concat(F.lit("genesis:"), F.col("level").cast("string"), F.lit(":"), F.col("epoch").cast("string")), 256)
    checked = sealed.withColumn("_before", F.coalesce(F.lag("hash").over(own), start)).join(recomputed, ["level", "index"], "left")
    problems = F.array(
        F.when((F.col("level") == 1) & ~F.col("digest").eqNullSafe(F.col("_now")), F.lit("content_mismatch")),
        F.when(F.col("hash") != link(F.col("previous_hash"), F.col("digest")), F.lit("hash_mismatch")),
        F.when(F.col("previous_hash") != F.col("_before"), F.lit("chain_break")),
    )
    return checked.select("level", "index", F.explode(F.array_compact(problems)).alias("issue"))
