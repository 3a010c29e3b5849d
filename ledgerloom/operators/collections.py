"""Keyed records with secondary and unique indexes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import shortlex


@dataclass(frozen=True)
class IndexRange:
    """Bounds on an index value: (value, inclusive) or None; order by (value, pk), or both reversed; limit after order."""

    start: tuple[Any, bool] | None = None
    end: tuple[Any, bool] | None = None
    descending: bool = False
    limit: int | None = None

    @classmethod
    def between(cls, low: Any, high: Any) -> IndexRange:
        return cls((low, True), (high, True))

    def ordered(self, descending: bool) -> IndexRange:
        return replace(self, descending=descending)

    def limited(self, limit: int) -> IndexRange:
        return replace(self, limit=limit)

    def predicate(self, value: Column) -> Column:
        out = F.lit(True)
        if self.start:
            out = out & (value >= self.start[0] if self.start[1] else value > self.start[0])
        if self.end:
            out = out & (value <= self.end[0] if self.end[1] else value < self.end[0])
        return out


def scan(records: DataFrame, pk: str = "pk") -> DataFrame:
    """All records in the order of their stored keys: shorter keys first."""
    return records.orderBy(*shortlex(pk))


def index_exact(records: DataFrame, index: DataFrame, name: str, value: Any) -> DataFrame:
    """Records whose index value equals; entries without a record are skipped."""
    hits = index.filter((F.col("idx") == name) & (F.col("idx_value") == value)).select("pk")
    return records.join(hits, "pk").orderBy("pk")


def index_range(records: DataFrame, index: DataFrame, name: str, query: IndexRange) -> DataFrame:
    """Entries in the range, cut to the limit before records are fetched: idx_value, pk, v (null v: dangling entry)."""
    hits = index.filter((F.col("idx") == name) & query.predicate(F.col("idx_value"))).select("idx_value", "pk")
    order = [F.desc("idx_value"), F.desc("pk")] if query.descending else [F.asc("idx_value"), F.asc("pk")]
    if query.limit is not None:
        hits = hits.orderBy(*order).limit(query.limit)
    return hits.join(records.select("pk", "v"), "pk", "left").select("idx_value", "pk", "v").orderBy(*order)


def dangling(records: DataFrame, index: DataFrame) -> DataFrame:
    """Index entries whose record is missing."""
    return index.join(records.select("pk"), "pk", "left_anti").select("idx", "idx_value", "pk")


def unique_violations(index: DataFrame, name: str) -> DataFrame:
    """Values of a unique index with more than one owner: idx_value, n_owners, first_pk."""
    own = index.filter(F.col("idx") == name).groupBy("idx_value").agg(F.count_distinct("pk").alias("n_owners"), F.min("pk").alias("first_pk"))
    return own.filter("n_owners > 1")


def upsert_conflicts(index: DataFrame, incoming: DataFrame, unique: list[str]) -> DataFrame:
    """Incoming entries (idx, idx_value, pk) of unique indexes that another live or incoming record owns.

    Entries of records that are upserted are replaced as a whole, so their old values don't count.
    """
    live = index.join(incoming.select("pk").distinct(), "pk", "left_anti")
    wanted = incoming.filter(F.col("idx").isin(unique))
    owners = live.unionByName(incoming).select("idx", "idx_value", F.col("pk").alias("owner"))
    return wanted.join(owners, ["idx", "idx_value"]).filter("pk <> owner").select("idx", "idx_value", "pk", "owner").distinct()


def upsert(records: DataFrame, incoming: DataFrame) -> DataFrame:
    """Records after an upsert: incoming rows replace those with their key."""
    return records.join(incoming.select("pk"), "pk", "left_anti").unionByName(incoming)


def delete(records: DataFrame, keys: DataFrame) -> DataFrame:
    return records.join(keys.select("pk"), "pk", "left_anti")


def upsert_indexed(records: DataFrame, index: DataFrame, incoming: DataFrame, entries: DataFrame, unique: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records and index after one transaction that upserts incoming rows with their entries (idx, idx_value, pk).

    All old entries of an upserted record go, whatever index they belong to.  A null or empty key, or a unique
    value that another record owns, raises and nothing changes.
    """
    if not incoming.filter(F.col("pk").isNull() | (F.col("pk").cast("string") == "")).isEmpty():
        raise ValueError("empty primary key")
    clash = upsert_conflicts(index, entries, unique).take(1)
    if clash:
        raise ValueError(f"unique index {clash[0].idx}: {clash[0].idx_value} belongs to {clash[0].owner}")
    kept = index.join(incoming.select("pk").distinct(), "pk", "left_anti").select("idx", "idx_value", "pk")
    return upsert(records, incoming), kept.unionByName(entries.select("idx", "idx_value", "pk"))


def delete_indexed(records: DataFrame, index: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and index without the deleted keys and all their entries."""
    return delete(records, keys), index.join(keys.select("pk"), "pk", "left_anti").select("idx", "idx_value", "pk")


def migrate_schema(definitions: DataFrame, requests: DataFrame) -> DataFrame:
    """Compare-and-set of schema versions: definitions (name, version), requests (name, expected, next), one for a name.

    outcome: migrated, conflict (another version is current; looked at first), invalid (next isn't larger), not_found; version afterwards.
    """
    row = requests.join(definitions, "name", "left")
    outcome = (
        F.when(F.col("version").isNull(), "not_found").when(F.col("version") != F.col("expected"), "conflict")
        .when(F.col("next") <= F.col("expected"), "invalid").otherwise("migrated")
    )
    return row.select("name", outcome.alias("outcome"), F.when(outcome == "migrated", F.col("next")).otherwise(F.col("version")).alias("version"))


def migrate_collection(records: DataFrame, index: DataFrame, version: int, expected: int, following: int, transform, entries=None, batch_size: int = 100, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, index and a one-row report of a data migration from schema `expected` to `following`.

    transform maps the column v; entries (optional) maps the migrated records to their new index entries, which
    replace the old ones.  Another current version raises.  A dry run reports and changes nothing.
    """
    if expected < 1 or following <= expected or batch_size < 1:
        raise ValueError("versions must rise from 1 and batches hold a record")
    if version != expected:
        raise ValueError(f"expected schema {expected}, found {version}")
    n = F.count("*")
    batches = F.lit(0).cast("long") if dry_run else F.ceil(n / batch_size)
    report = records.agg(n.alias("records_seen"), n.alias("records_migrated"), batches.alias("batches_committed"), F.lit(dry_run).alias("dry_run"), F.lit(version if dry_run else following).alias("version"))
    if dry_run:
        return records, index, report
    moved = migrate(records, transform)
    return moved, index if entries is None else entries(moved), report


def migration_steps(history: DataFrame) -> DataFrame:
    """Migrations (name, from_version, to_version) in order, each with whether it continues the one before."""
    before = F.lag("to_version").over(Window.partitionBy("name").orderBy("from_version", "to_version"))
    ok = (F.col("to_version") > F.col("from_version")) & (before.isNull() | (before == F.col("from_version")))
    return history.withColumn("contiguous", ok)


def migrate(records: DataFrame, transform: Callable[[Column], Column] | None = None, rows: Callable | None = None) -> DataFrame:
    """Apply a migration to every value: a column expression, or a function over pandas frames of (pk, v)."""
    if transform is not None:
        return records.withColumn("v", transform(F.col("v")))
    return records.mapInPandas(rows, records.schema)
