"""Suffix-array dedup: remove bytes covered by a string of `LENGTH` bytes that also starts earlier.

Suffixes are indexed sparsely: of the 16-grams in a window of LENGTH bytes the one with the least hash is its
anchor (the leftmost of equals), so equal windows have their anchor at the same place, and a run of windows that
share an anchor is one entry: anchor, and a fingerprint of the whole context that the run covers.

Entries live in a logarithmic index family.  A new batch is sorted into a (sparse) suffix array by content,
merge-scanned against every existing level for equal long contexts, and what is new becomes a level; levels of
like size merge.  Of equal contexts the earliest place stays, every other one is reported as repeated.  Each map
task runs a family over its own documents first, so a passage leaves a task once; entries then meet by anchor
(one exchange), where another family goes over the arriving batches.  What a family holds are distinct contexts,
so copies, however many, take no memory.

Different contexts can still share single windows (where a repeated passage begins or ends).  Two windows around
one anchor are equal only if the 42 bytes before it or the 42 after it are; entries for which neither holds are
done.  The others are opened into their windows, which meet by fingerprint in the same kind of family.

Full suffix arrays, sorted by bytes, would index every position instead of one in 43.  Texts are not compared byte by byte:
entries are alike if 64 bits of their context and 64 bits of their anchor are, single windows if 64 bits and 32 bits of
another hash are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .shingles import mix, text_chunks

LENGTH = 100
_GRAM = 16
_RUN = LENGTH - _GRAM + 1  # grams in a window
_SIDE = (LENGTH - _GRAM) // 2
_NULL_ID = 2**63 - 1
_BATCH = 1 << 16  # entries in a new batch
_TEXT = 1 << 18  # bytes of text handled at once
_FULL = 1 << 21  # entries after which a map task hands over its family and starts anew
_ROOT = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(30).integers(1, 2**64, 256, np.uint64, endpoint=False)
_ENTRY = np.dtype([("key", "u8"), ("anchor", "u8"), ("sides", "u8"), ("doc", "i8"), ("tag", "i8"), ("lo", "i4"), ("pack", "i4")])
_OUT = "key long, context long, sides long, doc long, tag long, lo int, pack int"


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_ROOT, n, 2**64))


class Grams:
    """Rolling hashes of a byte array: of all substrings whose length is a power of two up to 64, others made of these."""

    def __init__(self, data: np.ndarray):
        self.by = {1: _BYTE[data]}
        for n in (1, 2, 4, 8, 16, 32):
            h = self.by[n]
            self.by[2 * n] = h[:-n] * _power(n) + h[n:] if len(h) > n else h[:0]

    def at(self, p: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the `length` bytes (up to 127) from each place."""
        total = np.zeros(len(p), np.uint64)
        done = 0
        for n in (64, 32, 16, 8, 4, 2, 1):
            if length & n:
                total = total * _power(n) + self.by[n][p + done]
                done += n
        return mix(total)

    def second(self, p: np.ndarray) -> np.ndarray:
        """32 bits of another hash of the window from each place: its two parts are combined in another way."""
        return mix(self.at(p, 64) ^ mix(self.at(p + 64, LENGTH - 64) + np.uint64(1))) >> np.uint64(32)

    def side(self, p: np.ndarray) -> np.ndarray:
        """32-bit hashes, never 0, of an anchor with the bytes on one side."""
        return (self.at(p, _GRAM + _SIDE) >> np.uint64(32)) | np.uint64(1)


def anchored_runs(grams: Grams, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first and last window start, anchor) of all runs of windows that share an anchor."""
    value = (mix(grams.by[_GRAM]) >> np.uint64(32)).astype(np.uint32)
    shift = np.zeros(len(value), np.uint8)
    wide = 1
    while wide < _RUN:
        step = min(wide, _RUN - wide)
        less = value[step:] < value[:-step]
        value, shift = np.where(less, value[step:], value[:-step]), np.where(less, shift[step:] + np.uint8(step), shift[:-step])
        wide += step
    fits = np.zeros(len(value), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= LENGTH:
            fits[a : b - LENGTH + 1] = True
    p = np.flatnonzero(fits)
    if not len(p):
        return (np.empty(0, np.int64),) * 4
    at = p + shift[p]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(p)) - 1
    text = np.searchsorted(offsets, p[first], "right") - 1
    # windows of neighbouring texts never share a run: LENGTH - 1 starts between them do not fit
    return text, p[first], p[last], at[first]


def _earlier(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether entries a start before entries b: by document, variant, place."""
    return (a["doc"] < b["doc"]) | ((a["doc"] == b["doc"]) & ((a["tag"] < b["tag"]) | ((a["tag"] == b["tag"]) & (a["lo"] < b["lo"]))))


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["doc"] == b["doc"]) & (a["tag"] == b["tag"]) & (a["lo"] == b["lo"]) & (a["pack"] == b["pack"])


class LevelFamily:
    """Levels of sorted entries, one entry for each content: the earliest."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def __len__(self) -> int:
        return sum(map(len, self.levels))

    def append(self, batch: np.ndarray) -> np.ndarray:
        """Take in a batch; the entries, of it or from the levels, that repeat an earlier one."""
        repeated = []
        batch = batch[np.lexsort((batch["lo"], batch["tag"], batch["doc"], batch["anchor"], batch["key"]))]
        head = np.ones(len(batch), bool)
        head[1:] = (batch["key"][1:] != batch["key"][:-1]) | (batch["anchor"][1:] != batch["anchor"][:-1])
        owner = batch[head][np.cumsum(head) - 1]
        repeated.append(batch[~head & ~_same(batch, owner)])
        batch = batch[head]
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["key"], batch["key"]), len(level) - 1)
            hit = (level["key"][at] == batch["key"]) & (level["anchor"][at] == batch["anchor"])
            at, new = at[hit], batch[hit]
            old = level[at]
            wins = _earlier(new, old)
            repeated += old[wins], new[~wins & ~_same(new, old)]
            level[at[wins]] = new[wins]
            batch = batch[~hit]
        if len(batch):
            self.levels.append(batch)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) >= len(self.levels[-2]):
            pair = np.concatenate([self.levels.pop(), self.levels.pop()])
            self.levels.append(pair[np.argsort(pair["key"], kind="stable")])
        return np.concatenate(repeated)

    def entries(self) -> np.ndarray:
        return np.concatenate([*self.levels, np.empty(0, _ENTRY)])


def _rows(e: np.ndarray, done: bool, single: bool = False) -> pa.RecordBatch:
    """Entries as rows; of those that are done only the place matters (anchor: the text, to spread them), single windows have no context."""
    if done and len(e):
        e = _joined(e)
    key = mix(e["doc"].view(np.uint64) ^ mix(e["tag"].view(np.uint64))) if done else e["anchor"]
    columns = [key.view(np.int64), e["key"].view(np.int64), e["sides"].view(np.int64), e["doc"], e["tag"], e["lo"], e["pack"] | np.int32(-(2**31)) if done else e["pack"]]
    if done:
        columns[1] = columns[2] = np.zeros(len(e), np.int64)
    elif single:
        columns[:3] = e["key"].view(np.int64), e["anchor"].view(np.int64), np.zeros(len(e), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["key", "context", "sides", "doc", "tag", "lo", "pack"])


def _joined(e: np.ndarray) -> np.ndarray:
    """Repeated runs of one document that touch, as far as an entry's seven bits reach."""
    e = e[np.lexsort((e["lo"], e["tag"], e["doc"]))]
    hi = e["lo"] + (e["pack"] & 127)
    block = e["lo"] >> 5
    same = np.zeros(len(e), bool)
    same[1:] = (e["doc"][1:] == e["doc"][:-1]) & (e["tag"][1:] == e["tag"][:-1]) & (e["lo"][1:] <= hi[:-1] + 1) & (block[1:] == block[:-1])
    first = np.flatnonzero(~same)
    out = e[first].copy()
    reach = np.maximum.reduceat(hi, first)  # at most 31 + LENGTH - GRAM after lo
    out["pack"] = (out["pack"] & ~np.int32(127)) | (reach - out["lo"])
    return out


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    e = np.empty(batch.num_rows, _ENTRY)
    for name, column in zip(("anchor", "key", "sides", "doc", "tag", "lo", "pack"), batch.columns, strict=True):
        e[name] = column.to_numpy(zero_copy_only=False).view(_ENTRY[name])
    return e


def _index_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, tag, text -> entries that are the first of their content in this task, and repeated ones."""
    family = LevelFamily()
    for batch in batches:
        docs, tags = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
        for row, data, offsets in text_chunks(batch.column(2), _TEXT):
            if len(data) < LENGTH:
                continue
            grams = Grams(data)
            text, lo, hi, q = anchored_runs(grams, offsets)
            if not len(lo):
                continue
            e = np.zeros(len(lo), _ENTRY)
            e["anchor"] = grams.at(q, _GRAM)
            e["key"] = mix(grams.at(lo, LENGTH) + mix(grams.at(hi, LENGTH) + mix(((hi - lo) << 8 | (q - lo)).astype(np.uint64)))) ^ e["anchor"]
            before, after = q - _SIDE >= offsets[text], q + _GRAM + _SIDE <= offsets[text + 1]
            sides = np.zeros(len(lo), np.uint64)
            sides[before] = grams.side(q[before] - _SIDE) << np.uint64(32)
            sides[after] |= grams.side(q[after])
            e["sides"] = sides
            e["doc"], e["tag"], e["lo"] = docs[row + text], tags[row + text], lo - offsets[text]
            e["pack"] = (hi - lo) | (q - lo) << 7
            yield _rows(family.append(e), True)
            if len(family) > _FULL:
                yield _rows(family.entries(), False)
                family = LevelFamily()
    yield _rows(family.entries(), False)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Arriving rows in batches worth sorting."""
    held, n = [], 0
    for batch in batches:
        held.append(_entries(batch))
        n += batch.num_rows
        if n >= _BATCH:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries by anchor -> repeated ones (pack < 0), and those whose windows have to be compared singly."""
    family = LevelFamily()
    for e in _gathered(batches):
        done = e["pack"] < 0
        e["pack"] &= 2**31 - 1
        yield _rows(e[done], True)
        yield _rows(family.append(e[~done]), True)
    e = family.entries()
    met = []
    for side in (e["sides"] >> np.uint64(32), e["sides"] & np.uint64(2**32 - 1)):
        at = np.flatnonzero(side)
        _, group, count = np.unique(mix(e["anchor"][at] + mix(side[at])), return_inverse=True, return_counts=True)
        met.append(np.zeros(len(e), bool))
        met[-1][at] = count[group] > 1
    # a window holds all bytes before its anchor up to SIDE if it starts there or earlier, else all those after it
    size, turn = (e["pack"] & 127), (e["pack"] >> 7 & 127) - _SIDE
    first = np.where(met[0], 0, np.maximum(turn, 0))
    last = np.where(met[1], size, np.minimum(turn, size))
    unsure = (met[0] | met[1]) & (first <= last)
    e, first, last = e[unsure], first[unsure], last[unsure]
    e["lo"] += first
    e["pack"] = (e["pack"] & ~np.int32(127)) | (last - first)
    yield _rows(e, False)


def _open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, tag, text, runs -> an entry for each window of the runs."""
    family = LevelFamily()
    for batch in batches:
        docs, tags = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
        runs = batch.column(batch.num_columns - 1).to_pylist()
        for row, data, offsets in text_chunks(batch.column(2), _TEXT):
            grams = Grams(data)
            p, text = [], []
            for i in range(len(offsets) - 1):
                own = [np.arange(r["lo"], r["lo"] + (r["pack"] & 127) + 1) for r in runs[row + i]]
                p += own
                text += [np.full(len(x), i) for x in own]
            p, text = np.concatenate(p), np.concatenate(text)
            e = np.zeros(len(p), _ENTRY)
            e["key"], e["anchor"] = grams.at(p + offsets[text], LENGTH), grams.second(p + offsets[text])
            e["doc"], e["tag"], e["lo"] = docs[row + text], tags[row + text], p
            yield _rows(family.append(e), True)
            if len(family) > _FULL:
                yield _rows(family.entries(), False, True)
                family = LevelFamily()
    yield _rows(family.entries(), False, True)


def _meet_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family = LevelFamily()
    for e in _gathered(batches):
        done = e["pack"] < 0
        e["pack"] &= 2**31 - 1
        e["key"], e["anchor"] = e["anchor"].copy(), e["key"].copy()
        yield _rows(e[done], True)
        yield _rows(family.append(e[~done]), True)


def _cutter(whole_characters: bool):
    """doc, tag, text, carried columns, ranges -> doc, tag, the bytes that stay, the removed spans, carried columns."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def removed(raw: bytes, ranges: list[dict]) -> np.ndarray:
        edge = np.zeros(len(raw) + 1, np.int32)
        lo = np.array([r["lo"] for r in ranges])
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + np.array([r["pack"] & 127 for r in ranges]) + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        if whole_characters:
            first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
            gone = np.logical_and.reduceat(gone, np.flatnonzero(first))[np.cumsum(first) - 1]
        return gone

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                kept, spans = [], []
                for text, ranges in zip(batch.column(2).to_pylist(), batch.columns[-1].to_pylist(), strict=True):
                    raw, own = (text or "").encode(), []
                    if ranges:
                        gone = removed(raw, ranges)
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                        own = [{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                        raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    kept.append(raw)
                    spans.append(own)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(kept, pa.binary()), pa.array(spans, kind), *batch.columns[3:-1]], names=["doc", "tag", "kept", "spans", *batch.schema.names[3:-1]])

    return cut


def variant(text: Column) -> Column:
    """Tells texts apart that share an id."""
    return F.xxhash64(text)


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """For every row of documents: id_col, n_bytes, kept binary (the bytes left), spans
    array<struct<start,end>> (bytes removed), n_removed, and the columns of carry.

    whole_characters keeps a character of which not every byte is covered, so that what is left is a text.

    Earlier means a smaller id, or an earlier start in the same document; strings are judged on the input.  A
    null text is empty.  A null id counts as the largest.  Rows alike in id and text are one document and get
    the same answer each; texts that share an id count one after the other, in an order that depends on the
    texts.  Texts under LENGTH bytes lose nothing.  Other columns are not read; an empty table stays empty.
    """
    bound_batches(documents.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = [F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), variant(text).alias("tag"), text.alias("text")]
    texts = documents.select(*base)
    met = texts.mapInArrow(_index_texts, _OUT).repartition("key").mapInArrow(_meet, _OUT)
    met = materialize(met.select("doc", "tag", "lo", F.expr("pack & 16383").alias("pack"), (F.col("pack") < 0).alias("done")), "op10-runs")

    # one exchange of the texts for both uses: all its columns go to both, so that the two stay alike
    placed = documents.select(*base, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]).repartition("doc", "tag")
    carried = "".join(f", {f.name} {f.dataType.simpleString()}" for f in placed.schema.fields[3:])

    def by_document(runs: DataFrame) -> DataFrame:
        return runs.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "pack")).alias("runs"))

    unsure = placed.join(by_document(met.filter("not done")), ["doc", "tag"])
    windows = unsure.mapInArrow(_open_runs, _OUT).repartition("key").mapInArrow(_meet_windows, _OUT)
    windows = windows.select("doc", "tag", "lo", F.expr("pack & 16383").alias("pack"))
    ranges = by_document(met.filter("done").select("doc", "tag", "lo", "pack").unionByName(windows))
    whole = placed.join(ranges, ["doc", "tag"], "left")
    out = whole.mapInArrow(_cutter(whole_characters), "doc long, tag long, kept binary, spans array<struct<start:int,end:int>>" + carried)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.when(F.col("doc") < _NULL_ID, F.col("doc")).alias(id_col), (F.octet_length("kept") + removed).alias("n_bytes"), "kept", "spans", removed.alias("n_removed"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry) if c != id_col])
