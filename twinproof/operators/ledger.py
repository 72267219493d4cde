"""Ledger entries, blocks, trails and per-dataset history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import row_md5, row_sha, short_id, sorted_json
from twinproof.operators import chain
from twinproof.operators.running import running_totals
from twinproof.operators.sampling import replicate
from twinproof.session import settle

VERIFICATION_KINDS = ("verification", "consensus")
ENTRY_FIELDS = ("seq", "entry_id", "data_hash", "entry_type", "payload", "timestamp")


def entries(source: DataFrame, seq: Column, data_hash: Column, entry_type: Column | str, timestamp: Column, payload: dict[str, Column]) -> DataFrame:
    """Ledger entries out of source rows; the payload is sorted JSON text."""
    kind = F.lit(entry_type) if isinstance(entry_type, str) else entry_type
    return source.select(
        seq.alias("seq"),
        short_id(data_hash, kind, timestamp).alias("entry_id"),
        data_hash.alias("data_hash"),
        kind.alias("entry_type"),
        sorted_json(**payload).alias("payload"),
        timestamp.alias("timestamp"),
    )


def append(log: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """Log with ``new`` entries numbered after the last one, without gaps or repeats."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(-1))).scalar()
    numbered_ = numbered(new.select(*[c for c in log.columns if c != "seq"]), order, last)
    return log.unionByName(numbered_.select(*log.columns))


def numbered(new: DataFrame, order: Sequence[str], last: Column) -> DataFrame:
    """``new`` with ``seq``, counting on from ``last``.

    The order is that of ``order``, then of the entries' whole content; entries
    that are alike in everything are counted and get a number each. Numbers
    come from per-prefix counts, so no single task orders all rows.
    """
    fields = new.columns
    counted = new.groupBy(*fields).agg(F.count("*").alias("_n"))
    kinds = dict(new.dtypes)

    def sortable(c: str) -> Column:  # as text of one width
        if kinds[c] in ("int", "bigint"):
            return F.lpad(F.col(c).cast("string"), 20, "0")
        if kinds[c].startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.col(c).cast("string")

    key = F.concat_ws("|", *[sortable(c) for c in order], *(["entry_id"] if "entry_id" in fields else []), row_md5(counted, fields))
    keyed = settle(counted.withColumn("_k", key).withColumn("_all", F.lit(0)), "new-entries")
    upto = running_totals(keyed.select("_all", "_k", "_n"), ["_all"], "_k", ["_n"]).select("_k", (F.col("cum__n") - F.col("_n")).alias("_before"))
    each = replicate(keyed.join(upto, "_k"), "_n", number="_copy")
    return each.select("*", (last + F.col("_before") + F.col("_copy")).cast("bigint").alias("seq")).select("seq", *fields)


def digests(log: DataFrame) -> DataFrame:
    """(seq, timestamp, digest) of each entry."""
    return log.select("seq", "timestamp", row_sha(log, ENTRY_FIELDS).alias("digest"))


def blocks(log: DataFrame, block_entries: int = 100) -> DataFrame:
    """(index, n_entries, first_timestamp, last_timestamp, digest) per block.

    Entry digests are computed in parallel; a block joins at most
    ``block_entries`` of them in order.
    """
    return blocks_of(digests(log), block_entries)


def blocks_of(digested: DataFrame, block_entries: int = 100) -> DataFrame:
    return digested.groupBy(F.floor(F.col("seq") / block_entries).alias("index")).agg(
        F.count("*").alias("n_entries"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "digest"))), lambda e: e["digest"]), ","), 256).alias("digest"),
    )


def seal(log: DataFrame, block_entries: int = 100, epoch_blocks: int = chain.EPOCH_BLOCKS) -> DataFrame:
    """Blocks with previous hash and hash, plus the levels above them."""
    content = settle(blocks(log, block_entries), "blocks")
    sealed = chain.seal(content.select("index", "digest"), epoch_blocks)
    return sealed.join(content.drop("digest").withColumn("level", F.lit(1)), ["level", "index"], "left")


def verify(log: DataFrame, sealed: DataFrame, block_entries: int = 100) -> DataFrame:
    """(level, index, issue): blocks that no longer match entries or links."""
    return chain.verify_blocks(sealed, blocks(log, block_entries))


def trail(log: DataFrame, data_hash: str) -> DataFrame:
    """All entries of one dataset in time order."""
    return log.where(F.col("data_hash") == data_hash).orderBy("timestamp", "seq")


def verification_history(log: DataFrame, data_hash: str) -> DataFrame:
    return log.where((F.col("data_hash") == data_hash) & F.col("entry_type").isin(*VERIFICATION_KINDS))


def data_integrity(current: DataFrame, expected: DataFrame, log: DataFrame, issues: DataFrame) -> DataFrame:
    """Per dataset: does its hash match, is it recorded, how often, and is the chain whole.

    ``issues`` is what ``verify`` found; any issue makes the chain invalid.
    """
    broken = issues.agg(F.count("*")).scalar()
    counts = log.groupBy("data_hash").agg(F.count("*").alias("_n"))
    joined = current.select("dataset", F.col("data_hash").alias("current_hash")).join(
        expected.select("dataset", F.col("data_hash").alias("data_hash")), "dataset"
    )
    return joined.join(counts, "data_hash", "left").select(
        "dataset",
        (F.col("current_hash") == F.col("data_hash")).alias("data_matches"),
        F.col("_n").isNotNull().alias("hash_recorded"),
        F.coalesce("_n", F.lit(0)).alias("num_audit_entries"),
        (broken == 0).alias("chain_valid"),
    )


def statistics(log: DataFrame, sealed: DataFrame, issues: DataFrame, block_entries: int = 100) -> DataFrame:
    """One row: blocks, entries, unsealed entries, validity and last hash."""
    level1 = sealed.where(F.col("level") == 1)
    facts = level1.agg(
        F.struct(
            F.count("*").alias("chain_length"),
            F.coalesce(F.sum("n_entries"), F.lit(0)).alias("sealed"),
            F.max_by("hash", "index").alias("latest"),
        )
    ).scalar()
    broken = issues.agg(F.count("*")).scalar()
    return log.agg(F.count("*").alias("total_entries")).select(
        facts["chain_length"].alias("chain_length"),
        "total_entries",
        (F.col("total_entries") - facts["sealed"]).alias("pending_entries"),
        (broken == 0).alias("chain_valid"),
        facts["latest"].alias("latest_block_hash"),
    )


def latest_blocks(sealed: DataFrame, n: int = 5) -> DataFrame:
    return sealed.where(F.col("level") == 1).orderBy(F.col("index").desc()).limit(n)


def history(log: DataFrame) -> DataFrame:
    """Per dataset: its first generation, counts by kind and last consensus.

    Long entry lists stay rows of the log (see ``trail``); a dataset with very
    many entries therefore never becomes one huge array.
    """
    kind = F.col("entry_type")

    def n(name: str):
        return F.count(F.when(kind == name, 1)).alias(f"n_{name}")

    def pick(name: str, best):
        order = F.when(kind == name, F.struct("timestamp", "seq"))
        return best(F.when(kind == name, F.col("entry_id")), order)

    return log.groupBy("data_hash").agg(
        pick("generation", F.min_by).alias("generation"),
        n("verification"),
        n("consensus"),
        n("compliance"),
        pick("consensus", F.max_by).alias("last_consensus"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def full_history(log: DataFrame, kinds: Sequence[str] = ("generation", "verification", "consensus", "compliance")) -> DataFrame:
    """Every entry of these kinds, one row each; sort by (data_hash, seq) to read it."""
    return log.where(F.col("entry_type").isin(*kinds)).select("data_hash", "entry_type", "seq", "entry_id", "payload", "timestamp")


def first_attestation(attestations: DataFrame) -> DataFrame:
    """First compliance record of each (data_hash, framework)."""
    rest = [c for c in attestations.columns if c not in ("data_hash", "framework", "seq")]
    return attestations.groupBy("data_hash", "framework").agg(
        F.min_by(F.struct("seq", *rest), "seq").alias("r")
    ).select("data_hash", "framework", "r.*")
