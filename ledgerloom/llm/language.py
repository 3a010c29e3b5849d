"""Language identification by multilingual mixture inference.

A language is a distribution over byte trigrams (A-Z lower-cased, texts padded with spaces), hashed to 2^16
buckets with add-one-half smoothing.  A document is a mixture of languages: expectation-maximisation estimates
the proportions from its trigram counts.  The language set is chosen by penalised likelihood: starting from the
best single language, the next of the full fit is added while the log-likelihood grows by more than the
penalty, a Bayesian-information price per language.  The predicted language has the largest share; the score is that share.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .shingles import text_chunks

BUCKETS = 1 << 16
UNDETERMINED = "und"
_STEPS = 30
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    likelihood: np.ndarray  # bucket x language


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each text between two spaces on either side, and the texts' bounds in them."""
    sizes = np.diff(offsets)
    padded = np.full(int(offsets[-1]) + 4 * len(sizes), 32, np.uint32)
    starts = offsets[:-1] + 4 * np.arange(len(sizes)) + 2
    place = np.arange(len(data)) + np.repeat(starts - offsets[:-1], sizes)
    padded[place] = _LOWER[data]
    code = padded[:-2] << np.uint32(16) | padded[1:-1] << np.uint32(8) | padded[2:]
    buckets = (code * np.uint32(2654435769)) >> np.uint32(16)
    return buckets, starts - 2


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count trigrams of all texts for each language; rows without text or language don't count.

    Tasks send one table of 2^16 counters for each language they saw; the driver gets one for each language.
    An empty table gives a model without languages.
    """

    bound_batches(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for row, data, offsets in text_chunks(batch.column(0)):
                buckets, starts = _trigrams(data, offsets)
                own = langs[row : row + len(starts)]
                ends = np.append(starts[1:], len(buckets) + 2) - 2
                for lang in set(own):
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    parts = [buckets[starts[i] : ends[i]] for i in np.flatnonzero(own == lang)]
                    sums[lang] += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        yield _counts(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, blob in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(zlib.decompress(blob), np.int64)
        yield _counts(sums)

    schema = "lang string, counts binary"
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    got = sorted(rows.mapInArrow(count, schema).repartition("lang").mapInArrow(add, schema).collect())
    counts = np.array([np.frombuffer(zlib.decompress(b), np.int64) for _, b in got], np.float64).reshape(-1, BUCKETS) + 0.5
    return LanguageModel([lang for lang, _ in got], np.ascontiguousarray((counts / counts.sum(axis=1, keepdims=True)).T))


def _counts(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], names=["lang", "counts"])


def mixture(counts: np.ndarray, likelihood: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages (columns) that best explain the counts, by EM, and the log-likelihood."""
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    total = counts.sum()
    for _ in range(_STEPS):
        weight = counts / (likelihood @ share)
        new = share * (weight @ likelihood) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-4:
            break
    return share, float(counts @ np.log(likelihood @ share))


def infer(counts: np.ndarray, likelihood: np.ndarray, penalty: float) -> dict[int, float]:
    """Languages and their shares, largest first, of one document's trigram counts."""
    share, _ = mixture(counts, likelihood)
    order = np.argsort(-share, kind="stable")
    # one language: the best single fit, which need not have the largest share
    single = counts @ np.log(likelihood)
    chosen, best = [int(np.argmax(single))], float(single.max())
    price = penalty * math.log(max(2.0, counts.sum()))
    shares = np.ones(1)
    for k in order:
        if int(k) in chosen:
            continue
        if share[k] < 0.01:
            break
        wider, gain = mixture(counts, likelihood[:, [*chosen, int(k)]])
        if gain - best <= price:
            break
        chosen, best, shares = [*chosen, int(k)], gain, wider
    return dict(sorted(zip(chosen, shares.tolist(), strict=True), key=lambda x: -x[1]))


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", penalty: float = 5.0) -> Column:
    """struct<lang, score, languages: array<struct<lang, share>>> for the whole text of each row of df.

    Null texts, texts without a letter, and any text under a model without languages: `und`, 0, no languages.
    The model's size is fixed per language; it is broadcast.
    """
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])

    @F.arrow_udf("struct<lang: string, score: double, languages: array<struct<lang: string, share: double>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        names = m.languages
        for column in batches:
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            out: list[dict] = []
            for row, data, offsets in text_chunks(column):
                buckets, starts = _trigrams(data, offsets)
                ends = np.append(starts[1:], len(buckets) + 2) - 2
                for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    if not valid[row + i] or not names:
                        out.append({"lang": UNDETERMINED, "score": 0.0, "languages": []})
                        continue
                    counts = np.bincount(buckets[a:b], minlength=BUCKETS)
                    seen = np.flatnonzero(counts)
                    found = infer(counts[seen].astype(np.float64), m.likelihood[seen], penalty)
                    first = next(iter(found))
                    out.append({"lang": names[first], "score": min(1.0, found[first]), "languages": [{"lang": names[k], "share": v} for k, v in found.items()]})
            yield pa.array(out, kind)

    # not deterministic for the planner: a filter on the result must not run the inference a second time
    return run.asNondeterministic()(F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)))
