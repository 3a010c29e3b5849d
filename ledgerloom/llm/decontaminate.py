"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is `window` consecutive words of an item (a shorter item is one window).  Windows and documents are
sets of short word shingles with positions.  Containment of a whole window needs all its shingles, so by the
prefix principle one necessary token is enough to find every candidate: the window's rarest shingle, rarity
being counted over all documents.  Candidates are cut by the positional bound (the window must start inside the
document) and the length bound (and end inside it), then verified: every shingle of the window has to occur at
its very place.  Shingle matches compare the words themselves, so the result is exact.

DataFrame operations only.  The documents' text is read once for shingles; what is shuffled is only places where a
benchmark shingle occurs.  The benchmark's shingles are broadcast only if their number is at most
`broadcast_rows`; beyond that Spark joins by shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SHINGLE = 3


def words(text: Column) -> Column:
    """Words of a text: runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z (null: none)."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), _SEPARATORS), ""), F.array().cast("array<string>"))


def _checked(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def _windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """wid (the window's words, joined), item, wl (its length), s (shingle width), win; one row for each item and window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("_w")).filter(F.size("_w") > 0)
    spans = items.withColumn("wl", F.least(F.size("_w"), F.lit(window)))
    cut = spans.select("item", "wl", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("wl") + 1)).alias("_at"))
    cut = cut.select("item", "wl", F.least("wl", F.lit(_SHINGLE)).alias("s"), F.slice("_w", F.col("_at"), F.col("wl")).alias("win"))
    return cut.withColumn("wid", F.concat_ws(" ", "win")).distinct()


def _shingle_hits(docs: DataFrame, tokens: DataFrame, width: int, few: bool) -> DataFrame:
    """Places in documents where a benchmark shingle of this width occurs: k1, k2, n_words, pos, s, h."""
    at = docs.select(
        "k1", "k2", F.size("_w").alias("n_words"), "_w",
        F.posexplode(F.transform("_w", lambda x, i: F.xxhash64(x, *[F.get("_w", i + j) for j in range(1, width)]))).alias("pos", "dh"),
    ).filter(F.col("pos") <= F.col("n_words") - width)
    own = tokens.filter(F.col("s") == width).select("h", *[F.col("sw")[j].alias(f"t{j}") for j in range(width)])
    own = F.broadcast(own) if few else own
    same = reduce(lambda a, b: a & b, [F.get("_w", F.col("pos") + j) == F.col(f"t{j}") for j in range(width)])
    return at.join(own, (F.col("dh") == F.col("h")) & same).select("k1", "k2", "n_words", "pos", F.lit(width).alias("s"), "h")


def contained_windows(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """Every occurrence of a benchmark window in a document: k1, k2 (see document_keys), start, wl, item (as text)."""
    spark = documents.sparkSession
    docs = document_keys(documents, id_col, text_col).withColumn("_w", words(F.col("_text"))).drop("_text")
    windows = _windows(benchmark, item_col, item_text_col, window)
    parts = windows.select("wid", "wl", "s", "win").distinct()
    shingles = parts.select("wid", "wl", "s", "win", F.explode(F.sequence(F.lit(0), F.col("wl") - F.col("s"))).alias("off"))
    shingles = shingles.withColumn("sw", F.slice("win", F.col("off") + 1, F.col("s"))).withColumn(
        "h", reduce(lambda e, w: F.when(F.col("s") == w, F.xxhash64(*[F.get("sw", F.lit(j)) for j in range(w)])).otherwise(e), range(1, _SHINGLE + 1), F.lit(None).cast("long"))
    ).drop("win")
    shingles = materialize(shingles, "op8-shingles")
    tokens = shingles.select("s", "h", "sw").distinct()
    widths = {r.s: r.n for r in tokens.groupBy("s").agg(F.count("*").alias("n")).collect()}  # three rows at most
    rows = sum(widths.values())
    if not widths:
        return spark.createDataFrame([], "k1 long, k2 long, start int, wl int, item string")
    hits = reduce(DataFrame.unionByName, [_shingle_hits(docs, tokens, w, rows <= broadcast_rows) for w in sorted(widths)])
    hits = materialize(hits.distinct(), "op8-hits")

    rarity = hits.groupBy("s", "h").agg(F.count("*").alias("n"))
    prefix = (
        shingles.join(_checked(rarity, rows, broadcast_rows), ["s", "h"])
        .groupBy("wid", "wl", "s")
        .agg(F.min(F.struct("n", "h", "off")).alias("x"))
        .select("wid", "wl", "s", F.col("x.h").alias("h"), F.col("x.off").alias("off"))
    )
    found = hits.join(_checked(prefix, rows, broadcast_rows), ["s", "h"]).withColumn("start", F.col("pos") - F.col("off"))
    found = found.filter((F.col("start") >= 0) & (F.col("start") + F.col("wl") <= F.col("n_words"))).select("k1", "k2", "start", "wid")
    places = found.join(_checked(shingles.drop("sw"), rows, broadcast_rows), "wid").withColumn("pos", F.col("start") + F.col("off"))
    whole = (
        places.join(hits.drop("n_words"), ["k1", "k2", "pos", "s", "h"])
        .groupBy("k1", "k2", "start", "wid", "wl", "s")
        .agg(F.count_distinct("off").alias("n"))
        .filter(F.col("n") == F.col("wl") - F.col("s") + 1)
    )
    return whole.select("k1", "k2", "start", "wid", "wl").join(_checked(windows.select("wid", "item"), rows, broadcast_rows), "wid").select("k1", "k2", "start", "wl", "item")


def document_keys(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1 (the id; null ids share the lowest long), k2 (the text's hash) and _text: rows alike in both are one document."""
    return documents.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("k1"), F.xxhash64(text_col).alias("k2"), F.col(text_col).alias("_text"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """Words of each document that lie in a benchmark window, and the items found.

    One row for every row of documents: id_col, n_words, n_hit (distinct word places in windows), items (ids as
    text, sorted), contaminated, and the columns of carry.  A null text has no words; null ids form one key with equal texts alike;
    repeated rows get the same answer each; items without words or with a null text find nothing; items that
    repeat count once, a null item id finds words but no item.  Other columns are not read.
    """
    found = contained_windows(documents, benchmark, id_col, text_col, item_col, item_text_col, window)
    hit = found.select("k1", "k2", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("wl") - 1)).alias("pos")).distinct()
    hit = hit.groupBy("k1", "k2").agg(F.count("*").alias("n_hit"))
    items = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    base = documents.select(
        F.col(id_col), *[F.col(c) for c in carry if c != id_col],
        F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("_k1"), F.xxhash64(text_col).alias("_k2"),
        F.size(words(F.col(text_col))).cast("long").alias("n_words"),
    )
    facts = hit.join(items, ["k1", "k2"])
    return base.join(facts, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left").select(
        id_col, *[c for c in carry if c != id_col], "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
