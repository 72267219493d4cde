"""Small helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.session import settle

# Words of the contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words of a text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name close to ``wish`` that ``df`` does not have (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns that name each row by its place (file and row in
    it), the same in every scan; also after executors are lost. What is not a plain
    file table is written once. Returns the frame and the two columns' names."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = settle(docs, "rows")
    a, b = free_name(docs, "place_a"), free_name(docs, "place_b")
    place = ("_metadata.file_path", "_metadata.row_index")
    return docs.select("*", F.xxhash64(*place).alias(a), F.xxhash64(F.lit(b), *place).alias(b)), a, b
