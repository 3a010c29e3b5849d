import random
import re

import ledgerloom.llm.components as steps
from ledgerloom.llm import jaccard_join
from ledgerloom.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate(UP).encode())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return sorted(((d, len(sets[i]), best.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def texts(r):
    word = lambda: "".join(r.choices("abcdeÉ", k=3))
    passage = " ".join(word() for _ in range(60))
    out = ["", None, "one", "ONE", "one two", "one two\tthree four", "\x1f\xa0 x", "a b c d e", "A b c d E", "a b c d e f"]
    out += [" ".join(word() for _ in range(r.randint(1, 30))) + " " + passage for _ in range(30)]
    out += [" ".join(word() for _ in range(150)) + " " + passage for _ in range(20)]
    for n in (4, 7, 8, 9, 12, 40, 200):
        base = [word() for _ in range(n)]
        for _ in range(25):
            copy = list(base)
            for _ in range(r.randint(0, 1 + n // 20)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy[: r.randint(max(1, n - 3), n)]))
    out.append("lorem " * 20000)
    return out


def test_same_components_as_all_pairs_for_any_boundary(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, t) for i, t in enumerate(texts(r))]
    rows += [(None, rows[60][1]), (None, "alone with no id here now"), (5, "a second text of one id that links with nothing"), rows[70]]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n long").repartition(5)
    want = brute(rows)
    for boundary in (3, 10, 64):
        monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *a, b=boundary: b)
        monkeypatch.setattr(jaccard_join, "_PIVOTS", 1 if boundary == 10 else 4)
        got = sorted(map(tuple, jaccard_join.link_components(df).collect()), key=repr)
        assert got == want, boundary
    assert jaccard_join.link_components(df.limit(0)).count() == 0


def test_boundary_follows_the_cost():
    assert jaccard_join.choose_boundary({}, 0.0, 75) == 3
    low = jaccard_join.choose_boundary({10: 1000}, 1e-9, 75)
    high = jaccard_join.choose_boundary({10: 1000}, 1.0, 75)
    assert low <= 10 < high


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(300, 340)] + [(9, 9)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(300, 340)}, 7: 7}


def _lists(r):
    """Sets of 200 shingles: near copies of one text, others that share a passage with it, and groups of two to nine."""
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(80))
    body = [word() for _ in range(120)]
    out = [" ".join([*body[:-1], word(), passage]) for _ in range(30)]
    out += [" ".join([*(word() for _ in range(120)), passage]) for _ in range(30)]
    for n in (2, 3, 8, 9):
        base = [word() for _ in range(200)]
        out += [" ".join([*base[: 199 - 2 * i], word(), *base[200 - 2 * i :]]) for i in range(n)]
    return out


def test_lists_of_all_kinds_lose_no_link(spark, monkeypatch):
    r = random.Random(8)
    rows = list(enumerate(_lists(r)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    for few, outside, cheap in ((8, 16, 2048), (2, 1, 0), (2, 1, 2048), (8, 40, 0)):
        monkeypatch.setattr(jaccard_join, "_FEW", few)
        monkeypatch.setattr(jaccard_join, "_FEW_OUTSIDE", outside)
        monkeypatch.setattr(jaccard_join, "_PAIRS_PER_ENTRY", cheap)
        assert sorted(map(tuple, jaccard_join.link_components(df).collect()), key=repr) == want, (few, outside, cheap)


def test_a_pair_is_verified_once_and_small_lists_need_no_second_turn(spark, monkeypatch):
    """Lists of two that don't link were met in both directions, and again as blocks of texts."""
    r = random.Random(9)
    words = lambda n: ["".join(r.choices("abcdefgh", k=5)) for _ in range(n)]
    rows = []
    for i in range(20):
        shared = words(95)
        rows += [(2 * i, " ".join(shared + words(25))), (2 * i + 1, " ".join(shared + words(25)))]
    seen, linked = [], jaccard_join._linked
    monkeypatch.setattr(jaccard_join, "_worth", lambda pairs, *_: pairs)
    monkeypatch.setattr(jaccard_join, "_linked", lambda pairs, *a: seen.append(sorted(map(tuple, pairs.collect()))) or linked(pairs, *a))
    monkeypatch.setattr(jaccard_join, "_other_links", lambda *_: 1 / 0)
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.doc_id == x.component_id for x in got)
    assert len(seen) == 1 and seen[0] and len({frozenset(p) for p in seen[0]}) == len(seen[0])


def test_no_plan_holds_many_joins(spark, monkeypatch):
    """One plan verified pairs, compared blocks and found components: the driver held it anew for each stage that ended."""
    joins = []

    def noted(plain):
        return lambda df, label: joins.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join "), label)) or plain(df, label)

    for module in (jaccard_join, steps):
        monkeypatch.setattr(module, "materialize", noted(module.materialize))
    compared, other = [], jaccard_join._other_links
    monkeypatch.setattr(jaccard_join, "_other_links", lambda *a: compared.append(1) or other(*a))
    monkeypatch.setattr(jaccard_join, "_FEW", 2)
    monkeypatch.setattr(jaccard_join, "_FEW_OUTSIDE", 1)
    monkeypatch.setattr(jaccard_join, "_PIVOT_ROUNDS", 1)
    r = random.Random(9)
    words = lambda n: ["".join(r.choices("abcdefgh", k=5)) for _ in range(n)]
    shared = words(95)
    rows = list(enumerate(" ".join(shared + words(25)) for _ in range(4)))
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert compared and max(joins)[0] <= 6, sorted(joins)


def test_pairs_of_small_lists_and_pivots(spark):
    entries = [(1, 5), (1, -7), (1, 9), (2, 5), (2, 9), (3, 4)]
    pairs = {tuple(x) for x in jaccard_join._few_pairs(spark.createDataFrame(entries, "key long, sid long")).collect()}
    assert pairs == {(-7, 5), (-7, 9), (5, 9)}
    long = spark.createDataFrame([(1, i) for i in range(500)], "key long, sid long")
    met = jaccard_join._pivot_pairs(long, long, 0)
    assert {x for p in met.collect() for x in p} == set(range(500))  # every entry meets a pivot
    assert "salt" in met._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1]
