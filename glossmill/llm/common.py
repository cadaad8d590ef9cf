"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space, tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, where unset, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(found) if not spark.sparkContext.getCheckpointDir() else None
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, so that lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def cut_words(text: Column) -> Column:
    """Words of a text in ASCII lower case with empty strings among them, where white space repeats or stands at an end."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + SPACE[1:], LOWER + " " * (len(SPACE) - 1)), " ")


def text_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id but not a text; null texts have a key of their own."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: inside a lambda a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
