"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

N-grams are ORDER code points, whatever the script; before a text stand ORDER - 1 marks.  Counts, continuation counts,
context totals, discounts and probabilities are DataFrames keyed by the n-gram, so they are dealt over the cluster and
grow with the corpus.

1. Each task counts its distinct n-grams, of all documents (those of trusted text count, the others are only named).
2. Joins of count shards (n-gram, context, and the shorter n-gram's probability) give every n-gram that occurs in any
   document its probability.
3. The finished table is cut into shards of at most `shard` n-grams by hash.  A shard, whose size is bounded, is broadcast;
   tasks sum their documents' n-grams over it, and a document's sums over all shards make its perplexity.  The number of
   shards grows with the table.

A document's perplexity counts with its lower confidence bound (two standard errors of the mean over its characters),
as a few characters say little.  Documents are kept up to their language's quantile of that bound over trusted documents
that were held out of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .shingles import mix

ORDER = 4
SHARD = 1 << 21  # n-grams in a broadcast shard (12 bytes each, and 8 of slots)
BROADCAST_IDS = 2_000_000  # ids of 8 bytes each
_FULL = 1 << 20  # distinct n-grams after which a task hands over its counts and starts anew
_CHUNK = 1 << 20  # characters handled at once
_MARK = 2
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points of the texts, offsets) of runs of rows."""
    texts, at, size = [], 0, 0
    for row, t in enumerate(column.to_pylist()):
        texts.append(t or "")
        size += len(texts[-1])
        if size >= _CHUNK:
            yield at, *_points(texts)
            texts, at, size = [], row + 1, 0
    if texts:
        yield at, *_points(texts)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), offsets


def _marked(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with marks before each, and the place of each character."""
    sizes = np.diff(offsets)
    marked = np.full(len(points) + (ORDER - 1) * len(sizes), _MARK, np.uint32)
    place = np.arange(len(points)) + np.repeat((ORDER - 1) * np.arange(1, len(sizes) + 1), sizes)
    marked[place] = points
    return marked, place


def _hashes(marked: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that ends at each place."""
    h = np.zeros(len(place), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        h = h * _STEP + marked[place - k] + np.uint64(1)
    return mix(h)


class HashIndex:
    """Places of distinct 64-bit keys, by open addressing over whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.mask = keys, (1 << max(4, (2 * len(keys)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Each wanted key's place in keys, -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        at = (wanted & np.uint64(self.mask)).astype(np.int64)
        found = self.slots[at]
        left = np.flatnonzero((self.keys[found] != wanted) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            own = self.slots[at[left]]
            found[left] = own
            left = left[(self.keys[own] != wanted[left]) & (own >= 0)]
        return found


def count_grams(rows: DataFrame) -> DataFrame:
    """rows (text, counts boolean) -> (g, c): all distinct n-grams, and how often they occur in texts that count."""
    bound_batches(rows.sparkSession)

    def packed(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        text = grams.tobytes().decode("utf-32-le")
        return pa.RecordBatch.from_arrays([pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string()), pa.array(counts)], names=["g", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts, index = np.empty((0, ORDER), np.uint32), np.empty(0, np.int64), HashIndex(np.empty(0, np.uint64))
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, points, offsets in _chunks(batch.column(0)):
                if not len(points):
                    continue
                marked, place = _marked(points, offsets)
                hashes = _hashes(marked, place)
                found = index.find(hashes)
                missing = np.flatnonzero(found < 0)
                if len(missing):
                    new, first = np.unique(hashes[missing], return_index=True)
                    at = place[missing[first]]
                    grams = np.concatenate([grams, np.stack([marked[at - k] for k in range(ORDER - 1, -1, -1)], axis=1)])
                    counts = np.concatenate([counts, np.zeros(len(new), np.int64)])
                    index = HashIndex(np.concatenate([index.keys, new]))
                    found[missing] = index.find(hashes[missing])
                counted = np.repeat(flags[row : row + len(offsets) - 1], np.diff(offsets))
                counts += np.bincount(found[counted], minlength=len(counts))
                if len(counts) > _FULL:
                    yield packed(grams, counts)
                    grams, counts, index = grams[:0], counts[:0], HashIndex(index.keys[:0])
        yield packed(grams, counts)

    return rows.mapInArrow(run, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """The three modified Kneser-Ney discounts from the numbers of n-grams that occur once to four times."""
    n = {r.c: r.n for r in counts.filter("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    out = []
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = i - (i + 1) * y * b / a if a else i / 2
        out.append(min(max(d, 0.05 * i), 0.95 * i))
    return out


def probabilities(grams: DataFrame) -> DataFrame:
    """grams (g, c) -> (g, p): the interpolated probability of each n-gram's last character after the others.

    The shortest order falls back to a uniform choice among the characters seen and one more for all others.
    Without any count all probabilities are 1.
    """
    low, context = F.substring("g", 2, ORDER), F.expr("substring(g, 1, char_length(g) - 1)")
    counts, wanted = {ORDER: grams.filter("c > 0")}, {ORDER: grams.select("g")}
    for m in range(ORDER - 1, 0, -1):  # continuation counts: in how many different n-grams of the next order
        counts[m] = materialize(counts[m + 1].groupBy(low.alias("g")).agg(F.count("*").alias("c")), "op4-counts")
        wanted[m] = materialize(wanted[m + 1].select(low.alias("g")).distinct(), "op4-wanted")
    lower = None
    for m in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[m])
        rows = counts[m].withColumn("cut", F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3))
        if m == 1:
            whole = rows.agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("back"), F.count("*").alias("n")).first()
            if not whole.n:
                return grams.select("g", F.lit(1.0).alias("p"))
            p = F.coalesce((F.col("c") - F.col("cut")) / whole.total, F.lit(0.0)) + whole.back / (whole.n + 1)
            lower = wanted[1].join(rows, "g", "left").select("g", p.alias("p"))
        else:
            contexts = rows.groupBy(context.alias("ctx")).agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("back"))
            asked = wanted[m].select("g", context.alias("ctx"), low.alias("low")).join(rows, "g", "left").join(contexts, "ctx", "left")
            asked = asked.join(lower.select(F.col("g").alias("low"), F.col("p").alias("p0")), "low")
            p = F.coalesce((F.col("c") - F.col("cut")) / F.col("total"), F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p0")
            lower = asked.select("g", p.alias("p"))
        lower = materialize(lower, "op4-order")
    return lower


def _log_table(probs: DataFrame) -> DataFrame:
    """(h, logp): the hash under which documents look an n-gram up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le"), np.uint32)
            h = _hashes(points, np.arange(ORDER - 1, len(points), ORDER))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.log(batch.column(1).to_numpy()).astype(np.float32))], names=["h", "logp"])

    return probs.select("g", "p").mapInArrow(run, "h long, logp float")


_held: dict[int, HashIndex] = {}


def log_losses(documents: DataFrame, probs: DataFrame, keep: list[str], shard: int = SHARD) -> DataFrame:
    """documents (text, columns of keep) -> keep, loss and squares: sums of -log p over the text's characters, and of its squares.

    keep has to tell apart different texts; rows alike in it get the same sums, each.
    """
    spark = documents.sparkSession
    table = materialize(_log_table(probs), "op4-table")
    shards = max(1, -(-table.count() // shard))
    names = [f.name for f in documents.select(*keep).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields) + ", loss double, squares double"

    def part(k: int) -> DataFrame:
        own = table.filter(F.pmod("h", F.lit(shards)) == k).toArrow()  # about `shard` rows
        shared = spark.sparkContext.broadcast((k, own.column("h").to_numpy().view(np.uint64), np.append(own.column("logp").to_numpy(), np.float32(0))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, keys, logp = shared.value
            index = HashIndex(keys)
            for batch in batches:
                sums = np.zeros((2, batch.num_rows))
                for row, points, offsets in _chunks(batch.column(0)):
                    loss = -logp[index.find(_hashes(*_marked(points, offsets)))].astype(np.float64)
                    for total, values in zip(sums, (loss, loss * loss), strict=True):
                        run_sum = np.concatenate([[0.0], np.cumsum(values)])
                        total[row : row + len(offsets) - 1] = run_sum[offsets[1:]] - run_sum[offsets[:-1]]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, sums)], names=[*names, "loss", "squares"])

        return documents.select("text", *keep).mapInArrow(run, schema)

    parts = [part(k) for k in range(shards)]
    if shards == 1:
        return parts[0]
    copies = F.count("*") / shards
    sums = reduce(DataFrame.unionByName, parts).groupBy(*keep).agg(copies.cast("int").alias("copies"), (F.sum("loss") / copies).alias("loss"), (F.sum("squares") / copies).alias("squares"))
    return sums.select(*keep, "loss", "squares", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.995, least: int = 20, shard: int = SHARD) -> DataFrame:
    """For every row of documents: id_col, lang, logppl (mean loss of a character), least (its lower confidence bound), most (the threshold), keep.

    Trusted text: documents that labels (id_col, quality) marks 1 and never otherwise; one in five of them, by a hash
    of the id, is held out of the model and sets the thresholds.  Languages with fewer than `least` such rows, and
    rows without a language, take the threshold of all of them.  Null and empty texts have no perplexity and are not kept; without
    trusted text, or with none held out, everything else is.  A null id is untrusted; repeated rows are judged alike.
    """
    good = labels.select(F.col(id_col).alias("id"), "quality").dropna(subset=["id"]).groupBy("id").agg(F.min("quality").alias("q")).filter("q = 1").select("id")
    good = materialize(good, "op4-trusted")
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    marked = rows.join(good.withColumn("good", F.lit(True)), "id", "left").select("text", (F.coalesce("good", F.lit(False)) & ~held).alias("counts"))
    grams = materialize(count_grams(marked), "op4-grams")
    n = F.char_length("text").alias("n")
    scored = materialize(log_losses(rows.select("id", "lang", "text", n, F.xxhash64("text").alias("key")), probabilities(grams), ["id", "lang", "n", "key"], shard), "op4-scores")
    mean = F.when(F.col("n") > 0, F.col("loss") / F.col("n"))
    error = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)) / F.col("n"))
    scored = scored.select("id", "lang", mean.alias("logppl"), (mean - 2 * error).alias("least"))
    judged = scored.filter(held).filter("logppl is not null").join(good, "id", "left_semi")
    q = F.percentile_approx("least", quantile, 10000).alias("most")
    bars = materialize(judged.groupBy("lang").agg(q, F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("lang").isNotNull()).select("lang", "most").unionByName(judged.agg(q).select(F.lit(None).cast("string").alias("lang"), "most")), "op4-thresholds")
    overall = bars.filter("lang is null").first().most  # one row
    own = scored.join(bars.filter("lang is not null"), "lang", "left")
    most = F.coalesce("most", F.lit(float("inf") if overall is None else overall))
    return own.select(F.col("id").alias(id_col), "lang", "logppl", "least", most.alias("most"), (F.col("logppl").isNotNull() & (F.col("least") <= most)).alias("keep"))
