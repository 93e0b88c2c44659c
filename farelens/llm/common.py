"""Helpers of the corpus operators: words, and tables stored in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space is the six ASCII characters below and nothing else; words are what lies between.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, as in tests on one machine, a folder in the warehouse; on a
    cluster the warehouse may be a folder of the driver's own disk, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm"


def stored(df: DataFrame, *, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts its lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/farelens-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int, *, once: bool = False) -> DataFrame:
    """``df`` stored as :func:`stored` does, in buckets of ``key``: joins on it do not shuffle ``df`` again.

    The buckets are known to Spark by an external table of the session's catalog. ``once`` keeps one row of a key.
    """
    name = f"farelens_{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/{name.replace('_', '-')}"
    dealt = df.repartition(buckets, key)
    if once:
        dealt = dealt.dropDuplicates([key])
    dealt.write.bucketBy(buckets, key).saveAsTable(name, format="parquet", path=path, compression="zstd")
    return df.sparkSession.read.table(name)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text as an array, empty for NULL or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
