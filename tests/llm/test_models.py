"""Language ID, toxicity, top-k and decontamination: nulls, repeats, clashing columns, brute force."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language, registry, topk, toxicity
from ledgerloom.llm.common import fold


def held(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_fold(spark):
    got = spark.range(300).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == held(r.id, 5) for r in got)


def test_language_of_held_out_documents(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = registry.op6(spark, sf_dir).collect()
    assert len(got) == len(docs) and all(r.held_out == (held(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    own = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert sum(own) >= 0.97 * len(own)


def test_mixtures_and_undetermined_texts(spark):
    r = random.Random(1)
    a, b = (lambda n: " ".join(r.choices(["alpha", "beta", "gamma"], k=n))), (lambda n: " ".join(r.choices(["uno", "dos", "tres", "quatro"], k=n)))
    train = spark.createDataFrame([(a(200), "x"), (b(200), "y"), (None, "x"), ("zzz", None)], "text string, lang string")
    model = language.train(train)
    rows = [(1, a(50)), (2, b(50)), (3, a(60) + " " + b(60)), (4, None), (5, ""), (6, "12 3!"), (7, "É"), (8, a(40000)), (8, a(10))]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, lang string")
    got = [(x.doc_id, x.f.lang, len(x.f.languages)) for x in df.withColumn("f", language.identify(df, model)).collect()]
    assert sorted(got)[:6] == [(1, "x", 1), (2, "y", 1), (3, "x", 2), (4, "und", 0), (5, "und", 0), (6, "und", 0)] or (3, "y", 2) in got
    assert sorted(got)[7:] == [(8, "x", 1), (8, "x", 1)]
    none = language.train(train.limit(0))
    assert {x.f.lang for x in df.withColumn("f", language.identify(df, none)).collect()} == {"und"}


def test_toxicity_of_held_out_documents(spark):
    r = random.Random(6)
    plain = ["the", "house", "river", "walks", "green", "idea", "table", "quiet"]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        words = r.choices(plain, k=r.randint(5, 60)) + ([r.choice(["vilest", "vilenik", "vileroy", "scum"]) for _ in range(r.randint(1, 4))] if bad else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, 1, int(bad) if r.random() > 0.02 else int(not bad)))
    rows += [(2000, None, 0.1), (2001, "", 0.1), (2002, "scum " * 50000, 0.1), (None, "green idea", 0.1), (2002, "scum " * 50000, 0.1)]
    labels += [(None, 1, 1), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("h", fold(F.col("doc_id"), 5) == 0)
    model = toxicity.train(docs.filter("not h"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = docs.withColumn("f", toxicity.score(docs, model)).collect()
    assert len(got) == len(rows) and all(0 <= x.f.score <= 1 for x in got)
    out = [(x.f.score >= 0.5) == (x.doc_id % 6 == 0) for x in got if x.h and x.doc_id is not None and x.doc_id < 1200]
    assert sum(out) >= 0.98 * len(out)
    by = {x.doc_id: x.f.score for x in got}
    assert by[2000] < 0.5 and by[2001] < 0.5 and by[2002] > 0.5 and by[None] < 0.5
    empty = toxicity.train(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(x.f.score < 0.5 for x in docs.withColumn("f", toxicity.score(docs, empty)).collect())


def test_correlated_voters_share_weight():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    one, two = (y & (r.random(4000) < 0.7)), (y & (r.random(4000) < 0.6)) | (r.random(4000) < 0.02)
    votes = np.stack([one, one, one, two], axis=1).astype(float)
    noisy = np.where(r.random(4000) < 0.1, ~y, y)
    posterior, rates, weight = toxicity.label_model(np.column_stack([votes, noisy]), np.where(noisy, 0.99, 0.01))
    assert ((posterior > 0.5) == y).mean() > 0.95
    assert np.allclose(rates[1], [0.7, 0.7, 0.7, 0.61, 0.9], atol=0.07) and np.allclose(rates[0], [0, 0, 0, 0.02, 0.1], atol=0.05)
    assert np.allclose(weight[:3], 1 / 3, atol=0.1) and weight[3] > 0.7 and weight[4] > 0.7


def test_plain_likelihood_ratio_and_patterns():
    for t, c, nt, nc in ((5, 0, 11, 76), (2, 9, 11, 76), (11, 76, 11, 76), (3, 1, 50, 300)):
        cells = [(t, nt, (t + c) / (nt + nc)), (c, nc, (t + c) / (nt + nc))]
        want = 2 * sum(x * math.log(x / (n * s)) if x else 0 for seen, n, share in cells for x, s in ((seen, share), (n - seen, 1 - share)) if s)
        got = toxicity.lean(np.array([float(t)]), np.array([float(c)]), nt, nc)[0]
        assert math.isclose(got, want if t * nc > c * nt else 0, abs_tol=1e-6)
    texts = [b"what an id*ot", b"noooooo", b"THIS IS ALL LOUD AND VERY LONG", b"a!! b?? c!!", b"", b"plain words"]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    got = toxicity._patterns(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert got[:, :4].tolist() == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0], [0, 0, 0, 0]]


def test_contradicting_labels_count_as_toxic(spark):
    docs = spark.createDataFrame([(i, "scum it is" if i % 3 == 0 else "a green idea") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(0, 0), (3, None)], "doc_id long, toxic int")
    got = docs.withColumn("f", toxicity.score(docs, toxicity.train(docs, labels))).collect()
    assert all((x.f.score >= 0.5) == (x.doc_id % 3 == 0) for x in got)


@pytest.mark.parametrize("sf, least", [("sf0.1", 0.9)])
def test_recall_on_held_out_labels(spark, sf, least):
    d = f"/root/testdata/{sf}"
    got = registry.op3(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(x.toxic, x.predicted): x["count"] for x in got}
    assert n[1, 1] >= least * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_mixtures_match_a_plain_computation():
    r = np.random.default_rng(4)
    likelihood = r.dirichlet(np.full(40, 0.3), 3).T
    for share in ([1, 0, 0], [0.5, 0.5, 0], [0.2, 0.3, 0.5]):
        counts = r.multinomial(3000, likelihood @ np.array(share)).astype(float)
        own = [1 / 3] * 3
        for _ in range(30):
            total = [0.0] * 3
            for c, p in zip(counts, likelihood, strict=True):
                whole = sum(a * b for a, b in zip(own, p, strict=True))
                total = [t + c * a * b / whole for t, a, b in zip(total, own, p, strict=True)]
            own = [t / counts.sum() for t in total]
        got, fit = language.mixture(counts, likelihood)
        assert np.allclose(got, own, atol=2e-3)
        assert math.isclose(fit, sum(c * math.log(sum(a * b for a, b in zip(own, p, strict=True))) for c, p in zip(counts, likelihood, strict=True)), rel_tol=1e-4)
        # penalised likelihood over every set of languages chooses the same set
        price = 5 * math.log(counts.sum())
        sets = [s for k in (1, 2, 3) for s in itertools.combinations(range(3), k)]
        best = max(sets, key=lambda s: language.mixture(counts, likelihood[:, list(s)])[1] - price * len(s))
        assert set(language.infer(counts, likelihood, 5.0)) == set(best)


def test_most_list_searches_stop_before_the_end(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64)
    lists = topk.SortedLists(np.arange(len(x)), x)
    stopped = 0
    for i in range(0, len(x), 100):
        before = lists.read
        at, score = lists.search(x[i], 11)
        stopped += lists.read - before < x.size
        exact = x @ x[i]
        best = np.sort(exact)[::-1][:11]
        assert np.array_equal(np.sort(score)[::-1][:11], best) and np.array_equal(exact[at], score)
    assert stopped >= 0.5 * lists.searches and lists.read < 0.97 * lists.entries


def test_scores_beyond_64_bits_are_loud(spark):
    ok = spark.createDataFrame([(0, [2e6, 1.0]), (1, [1e6, 0.5]), (2, [3e9, 0.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(ok.limit(2), ok.filter("vec_id = 0")).collect()[0].score == 2048000000 * 1024000000 + 1024 * 512
    for bad in (ok, ok.withColumn("embedding", F.expr("array(1e30, 0.0)"))):
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(bad, bad.filter("vec_id < 3")).collect()


def test_top_k_with_ties_nulls_and_bounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    r = np.random.default_rng(8)
    centre = r.normal(size=(5, 12))
    vectors = [(i, (centre[i % 5] + 0.3 * r.normal(size=12)).astype("float32").tolist()) for i in range(700)]
    vectors += [(701, None), (800, [None] * 12), (802, [float("nan")] * 12), (803, [float("inf")] * 12), (900, vectors[3][1]), (901, vectors[3][1]), (1000, [0.0] * 12), (1001, []), (1100, [1.0, 2.0]), (None, vectors[3][1]), (901, vectors[3][1])]
    df = spark.createDataFrame([(*v, 0) for v in vectors], "vec_id long, embedding array<float>, score int")
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in whole:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 100 = 0")).collect()))
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def brute_top_k(vectors):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors]
    for q, v in whole:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:10]
            yield from ((q, k, i, -s) for k, (s, i) in enumerate(best, 1))


def test_copies_of_queries_are_never_broadcast(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    # components at the ends of what 16 and 32 bits hold
    vectors = [(i, [math.sin(i * j) for j in range(1, 9)]) for i in range(401)] + [(600, [-32.0] * 8), (601, [32.0] * 8), (602, [4e6] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        # the queries are below this limit, their copies beyond it
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
        out = topk.top_k(df, df.filter("vec_id % 100 = 0"))
        assert sorted(map(tuple, out.collect())) == sorted(brute_top_k(vectors))
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_vectors_may_ask(spark):
    vectors = [(0, []), (1, []), (100, []), (200, [1.0]), (201, [2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 100 = 0")).collect())) == sorted(brute_top_k(vectors))


def test_bounds_stop_reading_early():
    r = np.random.default_rng(2)
    x = r.integers(-50, 50, (4000, 6))
    x[17] = 900
    lists = topk.SortedLists(np.arange(4000), x)
    at, score = lists.search(np.array([5, 4, 3, 2, 1, 0]), 1)
    assert len(at) < 4000 and 17 in at and score[list(at).index(17)] == 900 * 15


def brute_windows(docs, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower() if (t or "").isascii() else re.sub(b"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [200_000, 0])
def test_windows_of_every_length(spark, few, monkeypatch):
    monkeypatch.setattr(decontaminate.contained_windows, "__defaults__", (*decontaminate.contained_windows.__defaults__[:-1], few))
    r = random.Random(5)
    text = lambda n: " ".join(r.choices(["the", "of", "a", "Ünit", "x1", "b"], k=n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 30])] + [(3, text(5)), (20, None), (21, "!! ??"), (None, text(12)), (4, "Zeta-only")]
    docs = [(i, text(r.randint(0, 60))) for i in range(60)] + [(100, "say: " + items[8][1].upper() + ", ok"), (101, None), (102, ""), (103, "ZETA only"), (103, "ZETA only"), (None, items[7][1]), (104, text(20000))]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_hit long")
    bench = spark.createDataFrame([(*b, "q") for b in items], "item_id long, text string, items string")
    got = [(x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated) for x in decontaminate.decontaminate(df, bench).collect()]
    assert sorted(got, key=repr) == brute_windows(docs, items)
    assert not any(x.contaminated for x in decontaminate.decontaminate(df, bench.limit(0)).collect())
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
