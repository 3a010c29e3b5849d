import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import suffix_dedup

L = suffix_dedup.LENGTH


def brute(rows):
    """rows of (id, text), distinct ids -> id: (bytes, removed, spans, digest)."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - L + 1):
            w = raw[p : p + L]
            if w in seen:
                gone[p : p + L] = True
            seen.add(w)
        turn = np.diff(np.concatenate([[0], gone, [0]]))
        out[d] = (len(raw), int(gone.sum()), int((turn == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def result(df):
    return {r[0]: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect()}


def test_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(df.repartition(5)) == brute(df.select("doc_id", "text").collect())


def test_periods_borders_edits_and_overlaps(spark):
    r = random.Random(1)
    text = lambda n, a="abcdefgh é\n": "".join(r.choices(a, k=n))
    base, passage = text(3000), text(160)
    rows = [base, base, base[:1500] + "X" + base[1500:], "a" * 500, "b" * 99, "b" * 100, "b" * 101, "ab" * 200, "xyz" * 70 + "ab" * 90]
    rows += [text(r.randint(0, 200)) + passage[r.randint(0, 40) : r.randint(120, 160)] + text(r.randint(0, 200)) for _ in range(40)]
    rows += [text(300, "ab") for _ in range(10)] + [base[i : i + 400] for i in range(0, 2600, 130)] + ["", None, "é" * 49, "é" * 50, "é" * 60]
    rows = [(i * 7, t) for i, t in enumerate(rows)] + [(None, base[100:900])]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kept string").repartition(7)
    assert result(df) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "q" * 50 + "w" * 70), (1, "q" * 50 + "w" * 70), (2, "q" * 50 + "w" * 70)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, 120)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_many_texts_without_an_id(spark):
    r = random.Random(2)
    rows = []
    for i in range(2500):
        own = "".join(r.choices("abcdefgh \n", k=r.randint(110, 400)))
        rows.append((None, own + own if i % 2 else own))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.text: x.kept.decode() for x in suffix_dedup.remove_repeats(df, carry=("text",)).collect()}
    alone = {t: t[: len(t) // 2] if t[: len(t) // 2] * 2 == t else t for _, t in rows}
    assert got == alone


@pytest.mark.parametrize("seed", range(3))
def test_family_reports_all_but_the_earliest(seed):
    r = np.random.default_rng(seed)
    n = 3000
    e = np.zeros(n, suffix_dedup._ENTRY)
    e["key"], e["doc"], e["lo"] = r.integers(0, 400, n), r.permutation(n), r.integers(0, 9, n)
    family, out = suffix_dedup.LevelFamily(), []
    for part in np.array_split(e, 17):
        out.append(family.append(part.copy()))
    sizes = [len(x) for x in family.levels]
    assert all(2 * b < a for a, b in zip(sizes, sizes[1:]))
    first = {}
    for k, d in zip(e["key"].tolist(), e["doc"].tolist()):
        first[k] = min(d, first.get(k, d))
    assert {k: d for k, d in zip(family.entries()["key"].tolist(), family.entries()["doc"].tolist())} == first
    assert sorted(np.concatenate(out)["doc"].tolist()) == sorted(set(e["doc"].tolist()) - set(first.values()))
