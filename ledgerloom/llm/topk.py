"""Exact top-k search by no-random-access aggregation.

Every dimension of a block of vectors is a sorted list.  For a query the lists are read sequentially, in steps
from the end that its weight favours.  What a vector's read components give, plus for the unread ones the best (worst)
value still possible in their lists, bounds its score from above (below).  Reading stops when no outsider's upper
bound can reach the k-th lower bound, at the latest at the end of the lists, where the bounds meet; the final scores
of those that are left are then resolved.  The k-th score carries over from block to block, so later blocks stop early.

The stated queries meet all vectors in blocks: a key is a group of about GROUP queries at most and one share of the vectors,
so what a task holds is bounded; what leaves it is k rows for each query that it saw.  Both sides are dealt by key and
merged, never broadcast: Spark's estimates leave out the copies of the queries, one for each share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches

BLOCK = 2048  # vectors in a block
QUERIES = 256  # queries in a block
GROUP = 16_384  # queries whose best rows a task holds at once
_DEPTHS = (2, 4, *range(8, 17))  # sixteenths of the lists after which the bounds are looked at; never less than all at the end


class SortedLists:
    """The sorted lists of one block: for every dimension the vectors in ascending order of their component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)
        self.most = max(-int(vectors.min(initial=0)), int(vectors.max(initial=0)))
        self.searches = self.entries = self.read = 0  # list entries there were, and were read

    def search(self, query: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and exact scores of all vectors that may belong to the k best with a score of floor at least."""
        n, d = self.vectors.shape
        reach = d * self.most * max(-int(query.min(initial=0)), int(query.max(initial=0)))
        if reach >= 2**63:
            raise OverflowError("scores of these vectors do not fit 64 bits")
        used = np.flatnonzero(query)
        if not len(used):
            return np.arange(n), np.zeros(n, np.int64)
        kind = np.float64 if reach < 2**52 else np.int64  # doubles are exact up to there, and faster
        weight = query[used].astype(kind)
        down = (weight > 0)[:, None]
        order = np.where(down, self.order[used, ::-1], self.order[used])
        values = np.where(down, self.values[used, ::-1], self.values[used]).astype(kind) * weight[:, None]  # descending
        worst = values[:, -1]
        ends = np.stack([worst, worst], axis=1)  # of the lists as far as they are unread: best and worst value
        known, unread, at = np.zeros(n, kind), np.ones((n, len(used)), kind), 0
        lists = np.arange(len(used))[:, None]
        self.searches += 1
        self.entries += order.size
        for depth in _DEPTHS:
            stop = max(at, n * depth // 16)
            if stop == at:
                continue
            rows = order[:, at:stop]
            if kind is np.float64:
                known += np.bincount(rows.ravel(), values[:, at:stop].ravel(), n)
            else:
                np.add.at(known, rows.ravel(), values[:, at:stop].ravel())
            unread[rows, lists] = 0
            at = stop
            self.read += rows.size
            ends[:, 0] = values[:, at - 1]
            upper, lower = (known[:, None] + unread @ ends).T
            bar = np.partition(lower, n - k)[n - k] if n >= k else lower.min()
            left = np.flatnonzero(upper >= (bar if floor is None else max(bar, floor)))
            if len(left) <= 2 * k:
                break
        return left, self.vectors[left] @ query


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v array<bigint>) packed into blocks: n, d, ids (int64) and vectors (the narrowest integers that hold them)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(d: int) -> pa.RecordBatch:
            ids, rows = zip(*held.pop(d), strict=True)
            vectors = np.array(rows, np.int64)
            most = max(-int(vectors.min(initial=0)), int(vectors.max(initial=0)))
            vectors = vectors.astype(next(kind for kind in (np.int16, np.int32, np.int64) if most <= np.iinfo(kind).max))
            columns = [pa.array([len(ids)], pa.int32()), pa.array([d], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([vectors.tobytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["n", "d", "ids", "vectors"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == size:
                    yield out(len(v))
        for d in list(held):
            yield out(d)

    return rows.mapInArrow(pack, "n int, d int, ids binary, vectors binary")


def _unpack(ids: bytes, vectors: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the vectors of a block, as int64."""
    n = len(ids) // 8
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, f"i{len(vectors) // (n * d) if d else 8}").reshape(n, d).astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """For every query row its k best other rows of vectors: query_id, rank (from 1), id_col, score.

    Components become floor(scale * x) and the score is their integer inner product; ties go to the smaller id.
    Vectors that are null or hold a null or a component that isn't finite take no part, neither do rows without
    an id; vectors of another length than the query's are no candidates.  Repeated rows are separate candidates,
    except for the query's own id; of a query's rows the least vector asks.  Fewer than k candidates give fewer rows; empty tables none.
    Components and scores that do not fit 64 bits raise an error.
    """
    spark = vectors.sparkSession
    bound_batches(spark)

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
        whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(whole).select(
            F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component does not fit 64 bits")))).alias("v")
        )

    # keys: a share of the vectors, and a group of queries; every query meets every share once.  A vector is copied for
    # each group and a query for each share, so of all ways to cut into so many keys one near the fewest copies is taken
    keys = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    asking, there = wanted.count(), vectors.count()
    groups = max(1, -(-asking // GROUP), min(-(-asking // QUERIES), round(math.sqrt(keys * asking / max(1, there)))))
    shares = -(-keys // groups)
    share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    asked = _blocks(wanted, QUERIES).select(share, F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("grp"), "d", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))
    dealt = _blocks(clean(vectors), BLOCK).withColumn("share", F.pmod(F.xxhash64("ids", "vectors"), F.lit(shares)).cast("int"))
    dealt = dealt.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # a stated number of partitions: little data may be much work, so few bytes are no reason to put keys together
    asked, dealt = (side.repartition(keys, "share", "grp", "d") for side in (asked, dealt))
    meets = dealt.join(asked.hint("merge"), ["share", "grp", "d"]).select("grp", "d", "ids", "vectors", "q_ids", "q")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lists = held = group = None

        def found() -> Iterator[pa.RecordBatch]:
            if best:
                sizes = [len(s) for _, s in best.values()]
                columns = [np.repeat(np.array(list(best), np.int64), sizes), np.concatenate([i for i, _ in best.values()]), np.concatenate([s for _, s in best.values()])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "score"])
                best.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                own, d, ids, block, q_ids, q = (c[row].as_py() for c in batch.columns)
                if group != own:
                    yield from found()
                    group = own
                if held != (d, ids, block):
                    lists, held = SortedLists(*_unpack(ids, block, d)), (d, ids, block)
                own_ids, own_queries = _unpack(q_ids, q, d)
                for query_id, query in zip(own_ids.tolist(), own_queries, strict=True):
                    old_ids, old = best.get(query_id, (np.empty(0, np.int64), np.empty(0, np.int64)))
                    # the query's own rows, however many, take no place among the k
                    at, score = lists.search(query, k + int(np.count_nonzero(lists.ids == query_id)), int(old[-1]) if len(old) == k else None)
                    names, score = np.concatenate([old_ids, lists.ids[at]]), np.concatenate([old, score])
                    other = names != query_id
                    names, score = names[other], score[other]
                    order = np.lexsort((names, -score))[:k]
                    best[query_id] = names[order], score[order]
        yield from found()

    near = meets.mapInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
