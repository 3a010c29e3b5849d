"""Every registered state query against its SQL at sf0.001."""

import os

import duckdb
import pytest

from ledgerloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return c


def plain(rows, names):
    order = sorted(names)
    return sorted((tuple(round(r[names.index(n)], 6) if isinstance(r[names.index(n)], float) else r[names.index(n)] for n in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) == set(ORACLES)


def test_folds_match_a_plain_loop(spark, sf_dir):
    from ledgerloom.operators import messaging
    from ledgerloom.plans import registry
    from ledgerloom.sources.tables import view
    from ledgerloom.streaming.feed import _advance

    commands = registry._group_commands(spark, sf_dir)
    tails = messaging.tail(view(spark, sf_dir, "stream_entries"))
    states = {}
    for c in commands.join(tails, "stream").orderBy("seq").collect():
        states[c.grp] = _advance(states.get(c.grp, (0, None, 0, 0, None)), c)[1]
    got = {r.grp: (r.next_offset, r.leased_offset, r.lease_until_ms, r.generation, r.owner) for r in registry.group_fold(spark, sf_dir).collect()}
    assert got == states
