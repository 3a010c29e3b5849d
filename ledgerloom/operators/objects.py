"""Content-addressed objects, references and garbage collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicate(contents: DataFrame, content: str, order: str) -> DataFrame:
    """One object for each content: object_id (SHA-256), size, copies; the first writer's place wins."""
    return contents.groupBy(F.sha2(content, 256).alias("object_id")).agg(
        F.first(F.octet_length(content)).cast("long").alias("size"), F.count("*").alias("copies"), F.min(order).alias("first_writer")
    )


def chunks(contents: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """Contents in pieces of `size` characters (bytes, if the column is binary): key, chunk from 0, data."""
    n = F.ceil(F.length(content) / size).cast("int")
    rows = contents.filter(F.length(content) > 0).select(key, content, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return rows.select(key, F.col("chunk").cast("long").alias("chunk"), F.substring(F.col(content), F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def verify(objects: DataFrame, content: str) -> DataFrame:
    """Whether each object's content still has its id."""
    return objects.select("object_id", (F.sha2(content, 256) == F.col("object_id")).alias("intact"))


def refs_by_prefix(refs: DataFrame, namespace: str, prefix: str) -> DataFrame:
    return refs.filter((F.col("namespace") == namespace) & F.col("name").startswith(prefix)).orderBy("name")


def resolve(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """References whose object exists."""
    return refs.join(objects, "object_id", "left_semi")


def orphans(objects: DataFrame, refs: DataFrame, limit: int | None = None) -> DataFrame:
    """Objects that no reference names, in id order; a limit of 0 gives none."""
    rows = objects.join(refs.select("object_id"), "object_id", "left_anti")
    return rows if limit is None else rows.orderBy("object_id").limit(limit)


def gc_report(objects: DataFrame, refs: DataFrame, limit: int) -> DataFrame:
    """One row of an orphan sweep: scanned, referenced (different ids that references name), removed (at most limit)."""
    named = refs.select("object_id").distinct()
    alone = objects.join(named.withColumn("named", F.lit(1)), "object_id", "left").agg(F.count("*").alias("scanned"), F.count_if(F.col("named").isNull()).alias("alone"))
    both = alone.withColumn("k", F.lit(1)).join(named.agg(F.count("*").alias("referenced")).withColumn("k", F.lit(1)), "k")
    return both.select("scanned", "referenced", F.least("alone", F.lit(limit)).alias("removed"))


def chunk(contents: DataFrame, content: str, offset: int, limit: int) -> DataFrame:
    """Bytes [offset, offset + limit) of each content; beyond its end, nothing."""
    return contents.withColumn(content, F.substring(F.col(content).cast("binary"), offset + 1, limit))


def retention(objects: DataFrame, refs: DataFrame, now_s: int, limit: int = 0) -> DataFrame:
    """One row of a retention sweep: scanned, expired, referenced (kept), removed (at most limit, unless it is 0).

    An expiry that is text has to be a whole number: anything else raises.
    """
    objects = objects.withColumn("expires_at_unix", F.col("expires_at_unix").cast("long"))
    named = refs.select("object_id").distinct().withColumn("named", F.lit(1))
    rows = objects.join(named, "object_id", "left")
    old = F.col("expires_at_unix") <= now_s
    return rows.agg(
        F.count("*").alias("scanned"), F.count_if(old).alias("expired"),
        F.count_if(old & F.col("named").isNotNull()).alias("referenced"), F.count_if(old & F.col("named").isNull()).alias("removed"),
    ).withColumn("removed", F.least("removed", F.lit(limit if limit else 2**62)))
