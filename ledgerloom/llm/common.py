"""Helpers shared by the corpus operators: table reading, scratch tables, folds."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
BATCH_BYTES = 4 << 20
_MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_root: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir); a session on one machine may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_root.get(spark.sparkContext.applicationId)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local_root[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
    return f"{root.rstrip('/')}/ledgerloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    Nothing reads the shuffle files behind the table again, so Spark drops them when the table is written.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """From now on Arrow batches of this session hold `size` bytes (or one larger row), unless it is set to less.

    Every operator that runs Python calls this: what a Python worker holds then depends neither on the number of
    rows in a batch nor on the length of most texts.
    """
    if int(spark.conf.get(_MOST_BYTES).rstrip("b")) > size:
        spark.conf.set(_MOST_BYTES, str(size))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the engine's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k (null ids: fold of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k
