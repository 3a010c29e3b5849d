import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import quality, registry

N = quality.ORDER


def plain_losses(texts, asked):
    """Kneser-Ney by dictionaries: the -log p of every character of each asked text."""
    grams = lambda t: [("\2" * (N - 1) + t)[i : i + N] for i in range(len(t))]
    counts = {N: Counter(g for t in texts for g in grams(t))}
    for m in range(N - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    cuts, total, cut_sum = {}, {}, {}
    for m in counts:
        n = Counter(counts[m].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.0
        cuts[m] = [0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2, 0.05 * i), 0.95 * i) for i in (1, 2, 3))]
        total[m], cut_sum[m] = defaultdict(int), defaultdict(float)
        for g, c in counts[m].items():
            total[m][g[:-1]] += c
            cut_sum[m][g[:-1]] += cuts[m][min(c, 3)]

    def p(g):
        m = len(g)
        lower = p(g[1:]) if m > 1 else 1 / (len(counts[1]) + 1)
        ctx = g[:-1]
        if not total[m][ctx]:
            return lower
        c = counts[m][g]
        return (c - cuts[m][min(c, 3)]) / total[m][ctx] + cut_sum[m][ctx] / total[m][ctx] * lower

    return [[-math.log(p(g)) for g in grams(t)] for t in asked]


def test_losses_match_a_plain_computation_in_any_number_of_shards(spark):
    r = random.Random(2)
    texts = ["".join(r.choices("aab bc. É日本語Ж", k=r.randint(0, 60))) for _ in range(150)] + ["日本" * 30]
    others = ["zzz aab", "", "日本語 abc 𝒳", "a", "a" * 3000, "a"]
    rows = [(i, t, i < len(texts)) for i, t in enumerate(texts + others)]
    docs = spark.createDataFrame(rows, "id long, text string, counts boolean").repartition(3)
    probs = quality.probabilities(quality.count_grams(docs.select("text", "counts")))
    want = plain_losses(texts, texts + others)
    for shard in (1 << 21, 40):
        got = quality.log_losses(docs, probs, ["id"], shard).collect()
        assert len(got) == len(rows)
        for x in got:
            assert math.isclose(x.loss, sum(want[x.id]), rel_tol=1e-5, abs_tol=1e-5)
            assert math.isclose(x.squares, sum(v * v for v in want[x.id]), rel_tol=1e-5, abs_tol=1e-5)


def test_keeps_clean_text_and_drops_junk(spark):
    r = random.Random(3)
    word = ["the", "cat", "sat", "on", "a", "mat", "and", "dog", "ran", "home"]
    clean = lambda n: " ".join(r.choices(word, k=n))
    rows = [(i, clean(80), "en") for i in range(160)] + [(200, "#$%^ &*() ###" * 20, "en"), (201, None, "en"), (202, "", None), (203, clean(40), "xx"), (None, clean(40), None), (0, clean(30), "en"), (0, clean(30), "en")]
    docs = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, lang string, most double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(140)] + [(200, 0, 0), (200, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for shard in (1 << 21, 60):
        got = quality.classify(docs, labels, quantile=1.0, shard=shard).collect()
        assert len(got) == len(rows)
        dropped = {r.doc_id for r in got if not r.keep}
        assert {200, 201, 202} <= dropped and len(dropped) <= 0.3 * len(rows)  # 30 held-out rows set the threshold
    assert {r.keep for r in quality.classify(docs, labels.limit(0)).collect()} == {True, False}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_labelled_junk_goes_and_good_text_stays(spark):
    d = "/root/testdata/sf0.01"
    got = registry.op4(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("length(perplexity) > 0")
    n = got.agg(*[F.count_if(F.expr(w)).alias(k) for k, w in (("bad", "quality = 0"), ("dropped", "quality = 0 and not keep"), ("good", "quality = 1"), ("kept", "quality = 1 and keep"))]).first()
    assert n.dropped >= 0.9 * n.bad and n.kept >= 0.97 * n.good
