"""Real / synthetic pairs and event tables cut out of the standard test tables.

Each builder has a twin SQL text with the same rows, used by the reference
queries. Predicates are deterministic and mean the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.roles import ColumnRoles

SPLIT_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SPLIT_LABELS = ("l_returnflag", "l_linestatus", "l_linenumber")
SPLIT_COLUMNS = SPLIT_NUMBERS + SPLIT_LABELS
SPLIT_ROLES = ColumnRoles(
    categorical=SPLIT_LABELS,
    numeric=SPLIT_NUMBERS,
    quasi_identifiers=("l_returnflag", "l_linestatus", "l_linenumber", "l_discount"),
    target="l_linestatus",
    sensitive=SPLIT_LABELS,
)

APPLICANT_NUMBERS = ("o_totalprice", "c_acctbal")
APPLICANT_LABELS = ("c_mktsegment", "r_name", "o_orderpriority", "o_orderstatus")
APPLICANT_COLUMNS = APPLICANT_NUMBERS + APPLICANT_LABELS
APPLICANT_ROLES = ColumnRoles(
    categorical=APPLICANT_LABELS,
    numeric=APPLICANT_NUMBERS,
    quasi_identifiers=("c_mktsegment", "r_name", "o_orderpriority"),
    protected=("c_mktsegment", "r_name"),
    target="o_orderstatus",
    favorable="F",
    sensitive=APPLICANT_LABELS,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "lineitem")
    return (
        items.where(F.col("l_orderkey") % 2 == 0).select(*SPLIT_COLUMNS),
        items.where(F.col("l_orderkey") % 2 == 1).select(*SPLIT_COLUMNS),
    )


SPLIT_SQL = f"""
  r AS (SELECT {', '.join(SPLIT_COLUMNS)} FROM lineitem WHERE l_orderkey % 2 = 0),
  s AS (SELECT {', '.join(SPLIT_COLUMNS)} FROM lineitem WHERE l_orderkey % 2 = 1)"""


def leaky_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The split with some real rows copied into the synthetic side."""
    items = table(spark, sf_dir, "lineitem")
    leaked = (F.col("l_orderkey") % 2 == 1) | (F.col("l_orderkey") % 20 == 0)
    return (
        items.where(F.col("l_orderkey") % 2 == 0).select(*SPLIT_COLUMNS),
        items.where(leaked).select(*SPLIT_COLUMNS),
    )


LEAKY_SQL = f"""
  r AS (SELECT {', '.join(SPLIT_COLUMNS)} FROM lineitem WHERE l_orderkey % 2 = 0),
  s AS (SELECT {', '.join(SPLIT_COLUMNS)} FROM lineitem
        WHERE l_orderkey % 2 = 1 OR l_orderkey % 20 = 0)"""


def applicants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders with customer segment and region; odd keys are perturbed."""
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key = F.col("o_orderkey")
    real = joined.where(key % 2 == 0).select(*APPLICANT_COLUMNS)
    synth = (
        joined.where(key % 2 == 1)
        .withColumn("c_mktsegment", F.when(key % 10 == 3, "BUILDING").otherwise(F.col("c_mktsegment")))
        .withColumn("o_totalprice", F.col("o_totalprice") * 1.05 + (key * 7919) % 1000)
        .select(*APPLICANT_COLUMNS)
    )
    return real, synth


APPLICANT_SQL = """
  j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  r AS (SELECT o_totalprice, c_acctbal, c_mktsegment, r_name, o_orderpriority, o_orderstatus
        FROM j WHERE o_orderkey % 2 = 0),
  s AS (SELECT o_totalprice * CAST(1.05 AS DOUBLE) + (o_orderkey * 7919) % 1000 AS o_totalprice, c_acctbal,
               CASE WHEN o_orderkey % 10 = 3 THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment,
               r_name, o_orderpriority, o_orderstatus
        FROM j WHERE o_orderkey % 2 = 1)"""


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls, a mostly empty column, text dates and repeated rows."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    dirty = o.select(
        key.alias(" order key "),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("total price"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(key % 5 == 0, F.col("o_orderstatus")).alias("mostly empty"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order date"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("price band"),
        F.col("o_orderstatus").alias("status"),
    )
    return dirty.unionByName(dirty.where(F.col(" order key ") % 20 == 0))


DIRTY_SQL = """
  base AS (SELECT o_orderkey AS order_key,
                  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS total_price,
                  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority,
                  CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS mostly_empty,
                  strftime(o_orderdate, '%Y-%m-%d') AS order_date,
                  CAST(floor(o_totalprice / 1000) AS DOUBLE) AS price_band,
                  o_orderstatus AS status FROM orders),
  dirty AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE order_key % 20 = 0)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, y, y_hat, score): labels and a rule's prediction per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("lang").alias("grp"),
        F.col("quality").alias("y"),
        (1 - F.col("toxic")).alias("y_hat"),
        (F.col("n_chars") % 97).cast("double").alias("score"),
    )


PREDICTION_SQL = """
  pred AS (SELECT lang AS grp, quality AS y, 1 - toxic AS y_hat, CAST(n_chars % 97 AS DOUBLE) AS score
           FROM documents JOIN labels USING (doc_id))"""

SUBMISSION_ORDER = (
    "l_linenumber",
    "l_partkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifier submissions out of line items; ``arrival`` gives their order."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_orderkey").alias("verification_id"),
        F.col("l_suppkey").alias("verifier_id"),
        (F.col("l_quantity") * 2).alias("privacy"),
        (F.col("l_discount") * 1000).alias("utility"),
        (100 - F.col("l_tax") * 500).alias("fairness"),
        F.struct(*SUBMISSION_ORDER, "l_suppkey").alias("arrival"),
    )


_ARRIVAL = ", ".join(SUBMISSION_ORDER) + ", l_suppkey"
SUBMISSION_SQL = f"""
  sub AS (SELECT l_orderkey AS verification_id, l_suppkey AS verifier_id, l_quantity * 2 AS privacy,
                 l_discount * 1000 AS utility, 100 - l_tax * 500 AS fairness,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ARRIVAL}) AS pos
          FROM lineitem),
  scored AS (SELECT *, CAST(0.4 AS DOUBLE) * privacy + CAST(0.35 AS DOUBLE) * utility
                       + CAST(0.25 AS DOUBLE) * fairness AS overall FROM sub),
  firsts AS (SELECT * FROM scored QUALIFY row_number() OVER
             (PARTITION BY verification_id, verifier_id ORDER BY pos) = 1),
  quorum AS (SELECT *, row_number() OVER (PARTITION BY verification_id ORDER BY pos) AS turn,
                    count(*) OVER (PARTITION BY verification_id) AS received FROM firsts),
  verdict AS (SELECT verification_id, count(*) AS num_verifiers, median(privacy) AS privacy,
                     median(utility) AS utility, median(fairness) AS fairness, median(overall) AS overall,
                     var_pop(overall) AS variance,
                     CASE WHEN var_pop(overall) > 400 THEN 'consensus_failed'
                          WHEN median(overall) >= 70 THEN 'approved' ELSE 'rejected' END AS status
              FROM quorum WHERE turn <= 3 AND received >= 3 GROUP BY verification_id)"""


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table in audit-log shape."""
    return audit_shape(table(spark, sf_dir, "events"))


def audit_shape(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    mapped = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("entry_id"),
        F.col("ts").alias("timestamp"),
        F.try_element_at(mapped, kind).alias("event_type"),
        F.when(kind == "error", "error").otherwise("info").alias("level"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("actor"),
        kind.alias("action"),
        F.concat(F.lit("data_"), (F.col("user_id") % 50).cast("string")).alias("resource"),
        F.col("props").alias("details"),
        F.col("value").alias("score"),
    )


# Which audit event type stands for which test event.
EVENT_KINDS = {
    "click": "user_action",
    "view": "privacy_verification",
    "signup": "data_generation",
    "purchase": "consensus_result",
    "error": "error",
}

AUDIT_SQL = """
  audit AS (SELECT event_id AS seq, 'e' || event_id AS entry_id, ts AS "timestamp",
                   CASE event_type WHEN 'click' THEN 'user_action' WHEN 'view' THEN 'privacy_verification'
                        WHEN 'signup' THEN 'data_generation' WHEN 'purchase' THEN 'consensus_result'
                        WHEN 'error' THEN 'error' END AS event_type,
                   CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
                   'user_' || user_id AS actor, event_type AS action, 'data_' || (user_id % 50) AS resource,
                   props AS details, value AS score FROM events)"""
