"""N-gram Jaccard join: a size-aware heavy-light join over word-shingle sets.

Two sets of Jaccard similarity t share at least ceil(t * size) elements of either, so under one global order of
the shingles they share `c` elements of their first ``size - ceil(t * size) + c`` ones.

* Light: sets below a size boundary enumerate all 2-subsets of that prefix (c = 2); equal subsets meet.
* Heavy: larger sets scan inverted lists of single prefix elements.  Sets down to t * boundary also take
  part there, so every pair meets in one of the two.
* The boundary is the one with the lowest estimated cost (subsets enumerated, against list entries scanned), from
  the size histogram and the shingles' collision rate over all documents.

The order puts rare shingles first.  Frequencies come from a count sketch of all documents' shingles: 2^22
counters, whatever the input's size, so that broadcasting it is bounded; any order is correct.

Documents with equal sets are one node.  Heavy prefixes are longer than needed by a sixteenth of the set (c = size /
16), so that similar sets share that many of their keys: sets with too few keys in common with any other leave, and so do
pairs with too few in common, before any text is looked at.

Lists of a few members form all their pairs and are done.  In the others every member meets a few pivots; lists whose
members then lie in one component are done too.  Where a few members are outside the main component, these meet all
others, and the list is done; elsewhere they meet new pivots of it, as long as that helps.  In the end all pairs
between different components that are left are verified, so no link between different components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .components import components
from .shingles import mix, set_id, shingle_sets

_BITS = 22  # counters of the sketch, as a power of two
_SLICE = 1 << 16
_LARGEST_BOUNDARY = 64
_PIVOTS = 4
_PIVOT_ROUNDS = 4
_FEW = 8  # entries of a list whose pairs are all formed at once
_FEW_OUTSIDE = 16  # entries outside a list's main component that meet all others of the list at once
_BLOCK_ROWS, _BLOCK_BYTES = 256, 1 << 19  # of a block of texts that are compared in one step
_SALTS = 16  # keys over which one list's entries are dealt
_GROUP = 8  # blocks that one key of a task compares with a block
#: Blocks move a text once for each _BLOCK_ROWS entries outside, a turn of pivots moves two for each pivot: up to here blocks move less.
_PAIRS_PER_ENTRY = 2 * _PIVOTS * _BLOCK_ROWS
_NULL_ID = 2**63 - 1
_LIGHT = np.uint64(1)  # the last bit of keys that are 2-subsets


def _required(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def _common(size: int) -> int:
    """c of a heavy set of this size: how many prefix elements it shares at least with a similar set of the same c."""
    return max(1, size // 16)


def _profile(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n, sid, hash of the text) of all documents, and slices of each task's sketch, in one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << _BITS, np.uint32)
        for batch in batches:
            n, sid = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.uint64)
            held = []
            for row, hashes in shingle_sets(batch.column(1)):
                if len(hashes):
                    n[row], sid[row] = len(hashes), set_id(hashes)
                    held.append(hashes >> np.uint64(64 - _BITS))
            if held:
                at, times = np.unique(np.concatenate(held), return_counts=True)
                sketch[at.astype(np.int64)] += times.astype(np.uint32)
            empty = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sid.view(np.int64)), empty, pa.nulls(batch.num_rows, pa.binary()), batch.column(2)], names=["id", "n", "sid", "slice", "counts", "text_key"])
        parts = [(i, zlib.compress(sketch[i * _SLICE : (i + 1) * _SLICE].tobytes(), 1)) for i in range((1 << _BITS) // _SLICE)]
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(len(parts), pa.int32()), none, pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary()), none], names=["id", "n", "sid", "slice", "counts", "text_key"])

    return materialize(documents.select(F.col(id_col).cast("long").alias("id"), text_col, F.xxhash64(text_col).alias("text_key")).mapInArrow(run, "id long, n int, sid long, slice int, counts binary, text_key long"), "op5-profile")


def _sketch(profile: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches: always 2^22 counters, so its way over the driver is bounded."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                own = sums.setdefault(i, np.zeros(_SLICE, np.uint64))
                own += np.frombuffer(zlib.decompress(blob), np.uint32)
        if sums:
            blobs = [zlib.compress(np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes(), 1) for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "counts"])

    total = np.zeros(1 << _BITS, np.uint32)
    tasks = profile.filter("slice is not null").select("slice", "counts")
    for i, blob in tasks.repartition("slice").mapInArrow(add, "slice int, counts binary").collect():
        total[i * _SLICE : (i + 1) * _SLICE] = np.frombuffer(zlib.decompress(blob), np.uint32)
    return total


def choose_boundary(histogram: dict[int, int], rate: float, percent: int) -> int:
    """The size below which sets enumerate 2-subsets, by estimated cost; rate: chance that two shingles are equal."""
    def prefix(s: int, c: int) -> int:
        return s - _required(s, percent) + c

    light, heavy = {}, {}
    for s, n in histogram.items():
        near = sum(m * prefix(r, 1) for r, m in histogram.items() if 100 * r >= percent * s and 100 * s >= percent * r)
        light[s] = n * prefix(s, 2) * (prefix(s, 2) - 1) / 2
        heavy[s] = n * prefix(s, 1) * (1 + rate * near)
    costs = {b: sum(c for s, c in light.items() if s < b) + sum(c for s, c in heavy.items() if 100 * s >= percent * b) for b in range(3, _LARGEST_BOUNDARY + 1)}
    return min(costs, key=lambda b: (costs[b], b))


def _keys(documents: DataFrame, text_col: str, sketch, boundary: int, percent: int) -> DataFrame:
    """(key, sid, n): the prefix elements and 2-subsets under which each set is filed; equal sets once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        for batch in batches:
            keys, sids, sizes = [], [], []
            for _, hashes in shingle_sets(batch.column(0)):
                n = len(hashes)
                if n < 3 or (sid := int(set_id(hashes).view(np.int64))) in seen:
                    continue
                seen.add(sid)
                often = np.minimum(counts[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)], (1 << _BITS) - 1).astype(np.uint64)
                order = np.argsort((often << np.uint64(64 - _BITS)) | (hashes & np.uint64((1 << (64 - _BITS)) - 1)), kind="stable")
                short = n - _required(n, percent)
                own = []
                if 100 * n >= percent * boundary:
                    own.append(hashes[order[: short + _common(n)]] & ~_LIGHT)
                if n < boundary:
                    first = np.sort(hashes[order[: short + 2]])
                    i, j = np.triu_indices(len(first), 1)
                    own.append(mix(first[i] * np.uint64(3) + mix(first[j])) | _LIGHT)
                keys += own
                total = sum(map(len, own))
                sids.append(np.full(total, sid, np.int64))
                sizes.append(np.full(total, n, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(sizes))], names=["key", "sid", "n"])

    return documents.select(text_col).mapInArrow(run, "key long, sid long, n int")


def _shared(keys: DataFrame, percent: int) -> DataFrame:
    """(sid, n, keys): the keys that each set shares with another one, where they suffice for a similar set.

    One exchange by key; a window over it, since two uses of a Python result are not recognised as the same.
    """
    w = Window.partitionBy("key")
    met = keys.withColumn("lo", F.min("sid").over(w)).withColumn("hi", F.max("sid").over(w)).filter("lo <> hi").select("key", "sid", "n")
    own = met.groupBy("sid", "n").agg(F.collect_set("key").alias("keys"))
    smallest = F.ceil(F.col("n") * percent / 100)
    enough = (_heavy("keys") >= _least(smallest)) | F.exists("keys", lambda k: k.bitwiseAND(1) == 1)
    return materialize(own.filter(enough), "op5-sets")


def _heavy(column) -> Column:
    return F.size(F.filter(column, lambda k: k.bitwiseAND(1) == 0))


def _least(size: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(size / 16))


def _worth(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes fit and that share enough keys."""
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    other = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    both = pairs.join(one, "a").join(other, "b")
    near = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    met = F.array_intersect("ka", "kb")
    enough = (_heavy(met) >= _least(F.least("na", "nb"))) | F.exists(met, lambda k: k.bitwiseAND(1) == 1)
    return both.filter(near).filter(enough).select("a", "b")


def _texts(documents: DataFrame, id_col: str, text_col: str, profile: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid, text): a text for each set that has a partner in some list.

    Texts travel instead of sets of hashes: they are smaller, and compress.  A text is known by its id and its
    hash, so rows without an id, or with the same one, don't meet; of rows alike in both one comes.
    """
    one = profile.filter("n > 0").groupBy("sid").agg(F.min(F.struct(F.coalesce("id", F.lit(_NULL_ID)).alias("id"), "text_key")).alias("first"))
    wanted = one.join(sets.select("sid"), "sid", "left_semi").select("sid", "first.*")
    texts = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return materialize(texts.join(wanted, ["id", "text_key"]).dropDuplicates(["id", "text_key"]).select("sid", "text"), "op5-texts")


def _sets(sids: pa.Array, texts: pa.Array) -> list[np.ndarray | None]:
    """The set of every row's text, None where it isn't the set sid; each text of a batch is cut up once."""
    ids = sids.to_numpy()
    kept, at = np.unique(ids, return_index=True)
    sets = {int(kept[i]): h if len(h) and int(set_id(h).view(np.int64)) == kept[i] else None for i, h in shingle_sets(texts.take(pa.array(at)))}
    odd = {k for k, h in sets.items() if h is None}
    out = [sets[int(i)] for i in ids]
    for row in [i for i, k in enumerate(ids.tolist()) if k in odd]:  # an id with several texts
        h = next(h for _, h in shingle_sets(texts.slice(row, 1)))
        out[row] = h if len(h) and int(set_id(h).view(np.int64)) == ids[row] else None
    return out


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by exact intersection."""

    def similar(x: np.ndarray | None, y: np.ndarray | None) -> bool:
        if x is None or y is None:
            return False
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if 100 * len(x) < percent * len(y):
            return False
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int(np.count_nonzero(y[at] == x))
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                a, b, x, y = batch.columns
                yield batch.select(["a", "b"]).filter(pa.array([similar(*s) for s in zip(_sets(a, x), _sets(b, y), strict=True)], pa.bool_()))

    one = texts.select(F.col("sid").alias("a"), F.col("text").alias("x"))
    other = texts.select(F.col("sid").alias("b"), F.col("text").alias("y"))
    full = pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y")
    return full.mapInArrow(run, "a long, b long")


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(_SALTS)).cast("int")


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _few_pairs(few: DataFrame) -> DataFrame:
    """All pairs (a, b) of entries (key, sid) of one list, where a list has a few: grouped once, not joined with themselves."""
    own = few.groupBy("key").agg(F.array_sort(F.collect_set("sid")).alias("sids"))
    both = own.select("sids", F.explode("sids").alias("a")).select("a", F.explode(F.filter("sids", lambda b: b > F.col("a"))).alias("b"))
    return both.distinct()


def _all_pairs(outside: DataFrame, lists: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components with one entry (key, sid, comp) outside and one of the same list."""
    one = outside.select("key", F.col("sid").alias("a"), F.col("comp").alias("ca"))
    other = lists.select("key", F.col("sid").alias("b"), F.col("comp").alias("cb"))
    return _unordered(one.join(other, "key").filter("ca <> cb"))


def _pivot_pairs(outside: DataFrame, inside: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of entries (key, sid) outside with pivots of the same list inside: the least ids after flipping bits."""
    flips = [int(x) for x in np.random.default_rng(turn).integers(-(2**63), 2**63, _PIVOTS)]
    pivots = inside.groupBy("key").agg(*[F.min(F.col("sid").bitwiseXOR(F.lit(c))).alias(f"p{j}") for j, c in enumerate(flips)])
    chosen = F.array_distinct(F.array(*[F.col(f"p{j}").bitwiseXOR(F.lit(c)) for j, c in enumerate(flips)]))
    pivots = pivots.select("key", chosen.alias("pivots"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    met = outside.withColumn("salt", _salt("sid")).join(pivots, ["key", "salt"])
    return _unordered(met.select(F.col("sid").alias("a"), F.explode("pivots").alias("b")).filter("a <> b"))


def _other_links(lists: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of one list, with an entry outside the main component: all that pivots left.

    Entries outside meet those of their main component and each other.  A main component's entries travel as
    blocks of texts, each once for a block outside it, and are dealt by that block and a group of _GROUP blocks, so
    that the work of a key is bounded.  A task compares two blocks by the product of their shingle incidences and
    emits one link at most for each pair of components.
    """
    lengths = texts.select("sid", F.octet_length("text").cast("long").alias("size"))
    away = lists.filter("comp <> main").select("main", "sid", "comp", F.lit(True).alias("away"))
    near = lists.filter("comp = main").select("main", "sid", "comp", F.lit(False).alias("away"))
    rows = materialize(away.unionByName(near).distinct().join(lengths, "sid"), "op5-rows")
    parts = rows.groupBy("main", "away").agg(F.ceil(F.greatest(F.sum("size") / _BLOCK_BYTES, F.count("*") / _BLOCK_ROWS)).cast("long").alias("parts"))
    # salted, and without texts: they first meet where the key is a block
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    spread = rows.withColumn("salt", _salt("sid")).join(salted, ["main", "away", "salt"])
    spread = spread.select("main", "away", "sid", "comp", F.pmod(F.xxhash64("sid"), F.greatest("parts", F.lit(1))).alias("part")).join(texts, "sid")
    blocks = spread.groupBy("main", "away", "part").agg(F.collect_list(F.struct("sid", "comp", "text")).alias("rows"))
    sizes = parts.groupBy("main").agg(F.max(F.when(F.col("away"), F.col("parts"))).alias("outside"), F.max("parts").alias("most"))
    blocks = materialize(blocks.join(sizes, "main"), "op5-blocks")
    groups = F.sequence(F.lit(0).cast("long"), F.floor((F.col("most") - 1) / _GROUP))
    one = blocks.filter("away").select("main", F.col("part").alias("p"), F.col("rows").alias("x"), F.explode(groups).alias("g"))
    turns = F.sequence(F.lit(0).cast("long"), F.col("outside") - 1)
    other = blocks.select("main", "away", F.explode(turns).alias("p"), F.floor(F.col("part") / _GROUP).alias("g"), F.col("part").alias("q"), F.col("rows").alias("y"))
    both = one.join(other, ["main", "p", "g"]).filter("not away or p <= q").select("x", "y")

    def sets(block: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """sid, comp, set size of the rows, then (row, shingle) of all their shingles."""
        rows = block.values
        sids, comps, texts = (rows.field(i) for i in range(3))
        made = _sets(sids, texts)
        hashes = [h if h is not None else np.empty(0, np.uint64) for h in made]
        sizes = np.array([len(h) for h in hashes])
        return sids.to_numpy(), comps.to_numpy(), sizes, np.repeat(np.arange(len(hashes)), sizes), np.concatenate(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(*batch.columns, strict=True):
                (xs, xc, xn, xr, xh), (ys, yc, yn, yr, yh) = sets(x), sets(y)
                shared = np.intersect1d(xh, yh)
                common = np.zeros((len(xs), len(ys)), np.float32)
                for at in range(0, len(shared), 4096):
                    part = shared[at : at + 4096]
                    sides = []
                    for r, h, n in ((xr, xh, len(xs)), (yr, yh, len(ys))):
                        k = np.minimum(np.searchsorted(part, h), len(part) - 1)
                        ok = part[k] == h
                        side = np.zeros((n, len(part)), np.float32)
                        side[r[ok], k[ok]] = 1
                        sides.append(side)
                    common += sides[0] @ sides[1].T
                linked = (100 * common >= percent * (xn[:, None] + yn[None, :] - common)) & (common > 0) & (xc[:, None] != yc[None, :])
                i, j = np.nonzero(linked)
                first = np.unique(np.stack([xc[i], yc[j]], axis=1), axis=0, return_index=True)[1]
                out.append(np.stack([xs[i[first]], ys[j[first]]]))
            a, b = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar.

    The pairs worth a look are a table of their own: what the driver holds of a plan grows with its joins, once more for each
    stage that ends, and all stages that wait for no other run at the same time.
    """
    return _linked(materialize(_worth(pairs, sets, percent), "op5-pairs"), texts, percent)


def link_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, rows: bool = False) -> DataFrame:
    """One row for each document: id_col, n_shingles, component_id (least id reachable by links, itself included).

    Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of 5-word shingles.  Documents
    without words or with a null text have an empty set and link with nothing; equal sets always link.  Rows
    without an id take part in links and get the component's least id (null if it has none).  Repeated rows link
    with each other.  Other columns are not read; an empty table gives an empty result.

    rows adds text_key (xxhash64 of the text, tells rows apart that share an id) and component (the same for all
    linked rows, with or without an id; null for an empty set).
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must be from 67 to 100: below, sets of one or two shingles link with larger ones")
    spark = documents.sparkSession
    bound_batches(spark)
    profile = _profile(documents, id_col, text_col)
    counts = _sketch(profile)
    members = profile.filter("slice is null").select("id", "n", "sid", *["text_key"] * rows)
    small = members.filter(f"n between 3 and {_LARGEST_BOUNDARY * 100 // percent}").groupBy("n").count()
    total = float(counts.sum(dtype=np.float64))
    rate = max(0.0, float(np.square(counts.astype(np.float64)).sum()) / total**2 - 2.0**-_BITS) if total else 0.0
    boundary = choose_boundary({r["n"]: r["count"] for r in small.collect()}, rate, percent)

    sketch = spark.sparkContext.broadcast(counts)
    sets = _shared(_keys(documents, text_col, sketch, boundary, percent), percent)
    sketch.destroy()  # only the table needed it
    del sketch, counts
    texts = _texts(documents, id_col, text_col, profile, sets)
    entries = sets.select(F.explode("keys").alias("key"), "sid")
    sizes = entries.groupBy("key").agg(F.count("*").alias("all"))
    listed = materialize(entries.join(sizes, "key"), "op5-lists")
    few, lists = listed.filter(F.col("all") <= _FEW), listed.filter(F.col("all") > _FEW).select("key", "sid")
    pairs = _few_pairs(few).unionByName(_pivot_pairs(lists, lists, 0)).distinct()
    comps, costs = components(_verified(pairs, sets, texts, percent)), []
    for turn in range(1, _PIVOT_ROUNDS + 1):
        tagged = lists.join(comps.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("comp", "sid").alias("comp"))
        heads = tagged.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key")
        heads = heads.agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all")).filter("top.m < all")
        heads = heads.select("key", F.col("top.comp").alias("main"), (F.col("all") - F.col("top.m")).alias("outside"))
        opened = materialize(tagged.join(heads, "key"), "op5-open")
        if opened.isEmpty():
            break
        few, lists = opened.filter(F.col("outside") <= _FEW_OUTSIDE), opened.filter(F.col("outside") > _FEW_OUTSIDE)
        pairs = _all_pairs(few.filter("comp <> main"), few)
        met = lists.select("main", "sid", (F.col("comp") != F.col("main")).cast("long").alias("away")).distinct().groupBy("main")
        cost, size = met.agg(F.sum("away").alias("away"), F.count("*").alias("all")).agg(F.sum(F.col("away") * F.col("all")), F.sum("all")).first()
        costs.append(cost or 0)
        slow = len(costs) > 1 and 10 * costs[-1] > 9 * costs[-2]
        last = slow or turn == _PIVOT_ROUNDS or costs[-1] <= _PAIRS_PER_ENTRY * (size or 0)
        if not last:
            pairs = pairs.unionByName(_pivot_pairs(lists.filter("comp <> main"), lists.filter("comp = main"), turn)).distinct()
        links = _verified(pairs, sets, texts, percent)
        if last and cost:
            links = links.unionByName(_other_links(lists, texts, percent))
        comps = components(links.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
        if last:
            break
        lists = lists.select("key", "sid")
    own = members.filter("n > 0").groupBy("sid").agg(F.min("id").alias("least"))
    own = own.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    # behind a table, so that Spark can split the rows of a component that holds many
    best = materialize(own.groupBy("comp").agg(F.min("least").alias("component_id")), "op5-least")
    named = own.join(best, "comp").select("sid", "component_id", *["comp"] * rows)
    more = [F.col("text_key"), F.col("comp").alias("component")] if rows else []
    return (
        members.join(named, "sid", "left")
        .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), *more)
    )
