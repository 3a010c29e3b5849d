"""Toxicity by weak supervision.

1. Voters.  A feature is a word or a word start of 4 to 7 bytes (texts lower-cased, words of letters and digits).
   Document frequencies by label come from a count sketch over all labelled training rows; features of buckets
   that lean to toxic are recounted exactly.  Every feature whose lean passes a bound that grows with the number of features
   tried is a lexicon voter, unless a shorter start of the same word says as much.  Pattern voters don't look at
   words: masked letters, stretched letters, shouting, repeated marks, much repetition.  A voter fires or is silent.
2. Label model.  Votes are generated from a hidden label.  The given label is one voter among the others, and where the estimate
   starts.  Expectation-maximisation estimates every voter's accuracy, the given label's too (how often it fires on toxic and
   on clean texts); the voters' pairwise correlations given the hidden label are estimated as well, and evidence is
   weighted by the inverse of their matrix, so that voters which say the same count once.
3. Classifier.  Logistic regression over the voters and two densities, on the label model's posteriors.

Steps 2 and 3 run on votes of at most `fit_rows` training rows, and `fit_cells` votes (a documented bound; the rows are
those with the smallest hash of their id); everything else covers all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .shingles import _BYTES, mix, text_chunks

_BITS = 22
_STARTS = (4, 5, 6, 7)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0xD6E8FEB86659FD93)
_LETTER, _MARK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[[33, 63, 42, 35, 36, 37, 38, 64]] = _MARK
_LEAST = 2  # toxic documents that a voter's feature must occur in
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # sorted hashes of the lexicon voters
    weights: np.ndarray  # of the features, then the patterns and densities
    bias: float
    sieve: np.ndarray  # by a hash's last 16 bits: may be a feature


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash, hash of the next shorter start or 0) of every word and word start, and the number of words of each text."""
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    begins[cut] |= inside[cut]
    starts = np.flatnonzero(begins)
    words = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.empty((3, 0), np.uint64), words
    packed = np.flatnonzero(inside)
    first = np.searchsorted(packed, starts)
    sizes = np.diff(np.append(first, len(packed)))
    power = np.multiply.accumulate(np.full(int(sizes.max()), _BASE))
    terms = _BYTES[data[packed]] * power[np.arange(len(packed)) - np.repeat(first, sizes)]
    text = np.searchsorted(offsets, starts, "right").astype(np.uint64) - np.uint64(1)
    whole = mix(np.add.reduceat(terms, first) + np.uint64(1))
    texts, hashes, shorter = [], [], []
    last = np.zeros(len(starts), np.uint64)  # the longest start so far
    for n in _STARTS:
        long = np.flatnonzero(sizes > n)
        part = np.zeros(len(long), np.uint64)
        for i in range(n):
            part += terms[first[long] + i]
        own = mix(part + np.uint64(2 * n))
        texts.append(text[long])
        hashes.append(own)
        shorter.append(last[long])
        last[long] = own
    return np.stack([np.concatenate([text, *texts]), np.concatenate([whole, *hashes]), np.concatenate([last, *shorter])]), words


def _distinct(pairs: np.ndarray) -> np.ndarray:
    key = mix(pairs[1] ^ mix(pairs[0]))
    return pairs[:, np.unique(key, return_index=True)[1]]


def _sketch_counts(rows: DataFrame) -> np.ndarray:
    """2 x 2^22 document frequencies (clean, toxic) of hashed features over all rows (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << _BITS), np.uint32)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_chunks(batch.column(0)):
                pairs = _distinct(text_features(data, offsets)[0])
                label = toxic[row + pairs[0].astype(np.int64)] > 0
                bucket = (pairs[1] >> np.uint64(64 - _BITS)).astype(np.int64)
                for k in (0, 1):
                    at, n = np.unique(bucket[label == k], return_counts=True)
                    total[k, at] += n.astype(np.uint32)
        yield packed({i: total[:, i << 16 : (i + 1) << 16] for i in range(1 << (_BITS - 16))})

    def packed(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in parts.values()], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(blob), np.uint32).reshape(2, -1)
        yield packed(sums)

    schema = "slice int, counts binary"
    total = np.zeros((2, 1 << _BITS), np.uint32)
    for i, blob in rows.mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).toLocalIterator():
        total[:, i << 16 : (i + 1) << 16] = np.frombuffer(zlib.decompress(blob), np.uint32).reshape(2, -1)
    return total


def lean(toxic, clean, n_toxic: int, n_clean: int, log=np.log):
    """How strongly documents with a feature lean to toxic: the likelihood ratio statistic of the 2 x 2 table, negative where they lean to clean.

    Of arrays or, with F.log, of columns.
    """
    odd = 1e-9  # stands for 0 in x * log(x)
    share = (toxic + clean) / (n_toxic + n_clean)
    total = 0.0
    for seen, n in ((toxic, n_toxic), (clean, n_clean)):
        total = total + seen * log((seen + odd) / (n * share + odd)) + (n - seen) * log((n - seen + odd) / (n * (1 - share) + odd))
    sign = (toxic * float(n_clean) > clean * float(n_toxic)) if log is np.log else F.when(toxic * float(n_clean) > clean * float(n_toxic), 1.0).otherwise(0.0)
    return 2 * total * sign


def _lexicon(rows: DataFrame, n_toxic: int, n_clean: int, doubt: float) -> np.ndarray:
    """Hashes of all lexicon voters: features with a lean over `doubt` times the logarithm of the number of features tried."""
    total = _sketch_counts(rows)
    bound = doubt * np.log(max(2, int(np.count_nonzero(total[0] | total[1]))))
    wanted, some = np.zeros(1 << _BITS, bool), np.flatnonzero(total[1] >= _LEAST)
    for part in np.array_split(some, max(1, len(some) >> 18)):
        wanted[part] = lean(total[1, part].astype(float), total[0, part].astype(float), n_toxic, n_clean) > bound
    del total
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_chunks(batch.column(0)):
                pairs = text_features(data, offsets)[0]
                pairs = _distinct(pairs[:, among[(pairs[1] >> np.uint64(64 - _BITS)).astype(np.int64)]])
                label = (toxic[row + pairs[0].astype(np.int64)] > 0).astype(np.int64)
                feature, first, at = np.unique(pairs[1], return_index=True, return_inverse=True)
                t = np.bincount(at, label, len(feature)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(pairs[2][first].view(np.int64)), pa.array(t), pa.array(np.bincount(at, minlength=len(feature)) - t)], names=["f", "parent", "t", "c"])

    sums = rows.mapInArrow(recount, "f long, parent long, t long, c long").groupBy("f").agg(F.min("parent").alias("parent"), F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = (F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))).alias("odds")
    strong = sums.filter((F.col("t") >= _LEAST) & (lean(F.col("t"), F.col("c"), n_toxic, n_clean, F.log) > float(bound))).select("f", "parent", "t", odds)
    strong = materialize(strong, "op3-features")
    # a longer start has a vote of its own only where it says clearly more than the shorter one
    shorter = strong.select(F.col("f").alias("parent"), F.col("t").alias("t0"), F.col("odds").alias("odds0"))
    own = strong.join(shorter, "parent", "left").filter("t0 is null or t < t0 and odds > odds0 + 1")
    return np.sort(np.array([r.f for r in own.select("f").toLocalIterator()], np.int64).view(np.uint64))


def _sieve(features: np.ndarray) -> np.ndarray:
    sieve = np.zeros(1 << 16, bool)
    sieve[(features & np.uint64(0xFFFF)).astype(np.int64)] = True
    return sieve


def _votes(column: pa.Array, features: np.ndarray, sieve: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, lexicon voters that fire, values of patterns and densities) of every text."""
    for row, data, offsets in text_chunks(column):
        pairs, words = text_features(data, offsets)
        pairs = pairs[:, sieve[(pairs[1] & np.uint64(0xFFFF)).astype(np.int64)]]
        at = np.minimum(np.searchsorted(features, pairs[1]), max(0, len(features) - 1))
        ok = features[at] == pairs[1] if len(features) else np.zeros(0, bool)
        text, voter = pairs[0][ok].astype(np.int64), at[ok]
        order = np.argsort(text, kind="stable")
        text, voter = text[order], voter[order]
        bounds = np.searchsorted(text, np.arange(len(words) + 1))
        seen = _patterns(data, offsets)
        for i, n in enumerate(words):
            hits = voter[bounds[i] : bounds[i + 1]]
            fired = np.unique(hits)
            yield row + i, fired, np.array([*seen[i], min(1.0, 20 * len(hits) / max(20, n)), min(1.0, len(fired) / 4)])


def _patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Pattern voters of each text, none of which knows a word: masked and stretched letters, shouting, repeated marks, a byte pair that fills the text."""
    kind = _KIND[data]
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)

    def often(where: np.ndarray, at: int) -> np.ndarray:
        """How many of these places (each `at` bytes before its end) lie whole in a text."""
        places = np.flatnonzero(where)
        places = places[text[places] == text[places + at]]
        return np.bincount(text[places], minlength=len(sizes))

    letter, mark, upper = kind == _LETTER, kind == _MARK, (data >= 65) & (data <= 90)
    masked = often(letter[:-2] & ((data[1:-1] == 42) | (data[1:-1] == 64) | (data[1:-1] == 36)) & letter[2:], 2)
    stretched = often(letter[:-3] & (data[:-3] == data[1:-2]) & (data[1:-2] == data[2:-1]) & (data[2:-1] == data[3:]), 3)
    doubled = often(mark[:-1] & (data[:-1] == data[1:]), 1)
    capitals, letters = np.bincount(text[upper], minlength=len(sizes)), np.bincount(text[letter], minlength=len(sizes))
    same = often(data[:-1] == data[1:], 1)
    return np.stack([masked > 0, stretched > 0, (capitals * 2 > letters) & (letters > 20), doubled > 2, same * 8 > np.maximum(sizes, 40)], axis=1).astype(np.float64)


N_PATTERNS, N_DENSITIES = 5, 2


def label_model(votes: np.ndarray, start: np.ndarray, outside: int = 0, rounds: int = 50, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label for each row of votes (0 or 1), the voters' rates by label (clean, toxic), and their weights.

    The last `outside` voters don't read the text; their evidence always counts in full.
    start holds first guesses of the posterior; no voter's accuracy is fixed.  A weight is what is left of a voter's evidence beside
    those that are correlated with it given the label: 1 for a voter on its own, a half for each of two that always agree.
    """
    n, v = votes.shape
    posterior = np.asarray(start, np.float64)
    rates, weight = np.zeros((2, v)), np.ones(v)
    votes = votes.astype(np.float32, copy=False)
    pairs = votes.T @ votes
    pairs /= n
    for turn in range(rounds):
        for k, p in enumerate((1 - posterior, posterior)):
            rates[k] = (p.astype(votes.dtype) @ votes + 0.1) / (p.sum() + 0.2)
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        if turn % 8 == 0:  # correlations given the label
            share = posterior.mean()
            corr = pairs.copy()  # single precision and in place: the matrix is as large as the square of the voters
            for part, rate in zip((1 - share, share), rates.astype(np.float32), strict=True):
                for at in range(0, v, 256):
                    corr[at : at + 256] -= np.float32(part) * np.outer(rate[at : at + 256], rate)
            scale = 1 / np.sqrt(np.maximum(np.diag(corr), 1e-9))
            corr *= scale
            corr *= scale[:, None]
            np.clip(corr, 0, 1, out=corr)
            np.fill_diagonal(corr, 1 + ridge)
            weight = np.clip((1 + ridge) * np.linalg.solve(corr, np.ones(v, np.float32)), 0, 1).astype(np.float64)
            weight[v - outside :] = 1
            del corr
        fire, hold = weight * np.log(rates[1] / rates[0]), weight * np.log((1 - rates[1]) / (1 - rates[0]))
        balance = np.clip(posterior.mean(), 1e-4, 1 - 1e-4)
        logit = np.log(balance / (1 - balance)) + votes @ (fire - hold).astype(votes.dtype) + hold.sum()
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        moved, posterior = np.abs(new - posterior).max(), new
        if moved < 1e-5 and turn > 8:
            break
    return posterior, rates, weight


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton steps solved with conjugate gradients."""
    w, b = np.zeros(x.shape[1] + 1), np.append(np.full(x.shape[1], ridge), 1e-3)

    def forward(v: np.ndarray) -> np.ndarray:
        return x @ v[:-1].astype(x.dtype) + v[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(r.astype(x.dtype) @ x, r.sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -40, 40)))
        grad, curve = back(p - y) + b * w, p * (1 - p)
        step, left = np.zeros_like(w), grad.copy()
        way, size = left.copy(), left @ left
        for _ in range(200):
            if size < 1e-8 * (grad @ grad) or size == 0:
                break
            bent = back(curve * forward(way)) + b * way
            at = size / (way @ bent)
            step += at * way
            left -= at * bent
            size, old = left @ left, size
            way = left + size / old * way
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", doubt: float = 1.5, fit_rows: int = 20_000, fit_cells: int = 16_000_000) -> ToxicityModel:
    """Learn from the documents that labels (id_col, toxic) marks 0 or 1.

    Null texts and labels don't count; a document that is marked both is toxic.  Without a toxic and a clean row the
    model scores everything 0.5 or lower.
    """
    bound_batches(documents.sparkSession)
    marked = labels.select(F.col(id_col), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    if marked.count() <= BROADCAST_ROWS:
        marked = F.broadcast(marked)
    rows = documents.select(F.col(id_col), F.col(text_col).alias("text")).join(marked, id_col).select(F.xxhash64(F.col(id_col)).alias("at"), "text", "toxic").dropna()
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1)), F.lit(0)).alias("t")).first()
    none = np.empty(0, np.uint64)
    if not 0 < size.t < size.n:
        return ToxicityModel(none, np.zeros(N_PATTERNS + N_DENSITIES), -4.0, _sieve(none))
    features = _lexicon(rows.select("text", "toxic"), size.t, size.n - size.t, doubt)
    shared = documents.sparkSession.sparkContext.broadcast((features, _sieve(features)))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(fired.tolist(), seen.tolist()) for _, fired, seen in _votes(batch.column(1), *shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64())), batch.column(2)], names=["at", "fired", "seen", "toxic"])

    cast = rows.mapInArrow(vote, "at long, fired array<int>, seen array<double>, toxic int")
    voters = len(features) + N_PATTERNS
    sample = cast.orderBy("at").limit(max(1, min(fit_rows, fit_cells // (voters + N_DENSITIES)))).toArrow().combine_chunks()
    x = np.zeros((len(sample), voters + 1 + N_DENSITIES), np.float32)  # voters, the given label, densities
    fired, seen = (sample.column(c).combine_chunks() for c in ("fired", "seen"))
    x[np.repeat(np.arange(len(x)), fired.value_lengths().to_numpy()), fired.flatten().to_numpy()] = 1
    seen = seen.flatten().to_numpy().reshape(len(x), -1)
    x[:, len(features) : voters], x[:, voters + 1 :] = seen[:, :N_PATTERNS], seen[:, N_PATTERNS:]
    x[:, voters] = sample.column("toxic").to_numpy() > 0
    posterior, _, _ = label_model(x[:, : voters + 1], np.where(x[:, voters] > 0, 0.99, 0.01), outside=1)
    x[:, voters] = 0  # no input of the classifier
    weights, bias = logistic(x, posterior)
    return ToxicityModel(features, np.delete(weights, voters), bias, _sieve(features))


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> Column:
    """struct<score, voters>: the chance that each row's whole text is toxic, and how many lexicon voters fire (null and empty texts: none)."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score: double, voters: int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in batches:
            out, n = np.zeros(len(column)), np.zeros(len(column), np.int32)
            for row, fired, seen in _votes(column, m.features, m.sieve):
                out[row] = m.bias + m.weights[fired].sum() + m.weights[len(m.features) :] @ seen
                n[row] = len(fired)
            yield pa.StructArray.from_arrays([pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40)))), pa.array(n)], names=["score", "voters"])

    return run(F.col(text_col))
