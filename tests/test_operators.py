"""Behaviour on small inputs: boundaries, ties, transitions, nulls."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.columns import counter_value, retry_delay_ms
from ledgerloom.functions.cron import Cron
from ledgerloom.operators import collections, jobs, log, messaging, objects, queues, schedules, ttl, workflows


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def test_random_history_equals_a_dictionary(spark):
    r = random.Random(0x5EED)
    state, operations, commits, feed, sequence = {}, [], [], [], 0
    for tx in range(1, 501):
        ops = [("DELETE", f"key:{r.randrange(32):02d}", None) if r.random() < 0.25 else ("PUT", f"key:{r.randrange(32):02d}", str(r.random())) for _ in range(r.randint(1, 8))]
        for op in ops:
            sequence += 1
            operations.append((tx, sequence, *op))
        if r.random() < 0.8:
            commits.append((tx,))
            for i, (kind, k, v) in enumerate(ops):
                feed.append((tx, i, kind, k, None if v is None else len(v)))
                state.pop(k, None) if kind == "DELETE" else state.__setitem__(k, v)
    entries = spark.createDataFrame(operations, "tx_id long, sequence long, kind string, k string, v string")
    done = spark.createDataFrame(commits, "tx_id long")
    assert rows(log.replay(entries, done)) == sorted(state.items(), key=repr)
    assert rows(log.changes(entries, done), "tx_id", "seq", "kind", "k", "value_len") == sorted(feed, key=repr)
    found = log.verify(entries, done).first()
    assert (found.committed, found.pending, found.live_keys) == (len(commits), 500 - len(commits), len(state))


def test_commit_order_beats_sequence_order(spark):
    entries = spark.createDataFrame([(1, 1, "PUT", "a", "one"), (2, 2, "PUT", "a", "two")], "tx_id long, sequence long, kind string, k string, v string")
    done = spark.createDataFrame([(1, 9), (2, 8)], "tx_id long, commit_sequence long")
    assert rows(log.replay(entries, done)) == [("a", "one")]


def test_overlay_cas_and_counters(spark):
    state = spark.createDataFrame([("users:1", "a"), ("users:2", "b")], "k string, v string")
    staged = spark.createDataFrame([(1, "PUT", "users:1", "new"), (2, "DELETE", "users:2", None), (3, "PUT", "users:3", "c")], "sequence long, kind string, k string, v string")
    assert rows(log.overlay(state, staged)) == [("users:1", "new"), ("users:3", "c")]
    wanted = spark.createDataFrame([("users:1", "a", None), ("users:2", None, "x"), ("users:9", None, "y")], "k string, expected string, next string")
    assert rows(log.compare_and_swap(state, wanted)) == [("users:1", True, None), ("users:2", False, "b"), ("users:9", True, "y")]
    values = spark.createDataFrame([("a", bytearray((10).to_bytes(8, "little"))), ("b", bytearray((-2).to_bytes(8, "little", signed=True)))], "k string, v binary")
    assert rows(values.select("k", counter_value(F.col("v")))) == [("a", 10), ("b", -2)]
    deltas = spark.createDataFrame([("a", 5), ("a", 7), ("c", -2)], "k string, delta long")
    assert rows(log.increment(values, deltas)) == [("a", 22), ("c", -2)]
    with pytest.raises(Exception, match="invalid counter"):
        log.increment(spark.createDataFrame([("a", bytearray(b"xyz"))], "k string, v binary"), deltas).collect()
    with pytest.raises(Exception, match="(?i)overflow"):
        log.increment(spark.createDataFrame([("a", bytearray((2**63 - 1).to_bytes(8, "little")))], "k string, v binary"), deltas).collect()


def test_expiry_boundary_and_shortlex_purge(spark):
    kv = spark.createDataFrame([("session", "v", 1000), ("plain", "v", None), ("b", "v", 5), ("aa", "v", 5)], "k string, v string, expires_at_ms long")
    assert [sorted(r.k for r in ttl.visible(kv, t).collect()) for t in (999, 1000)] == [["plain", "session"], ["plain"]]
    assert [r.k for r in ttl.purge(kv, 1000, 2).collect()] == ["b", "aa"] and ttl.purge(kv, 1000, 0).count() == 0
    assert tuple(ttl.purge_report(kv, kv.filter("k <> 'aa'"), 10, 9).first()) == (4, 2, 1)


def test_index_ranges(spark):
    price = {"a": "010", "b": "020", "c": "020", "d": "030", "e": "040"}
    records = spark.createDataFrame([(k, f"v{k}") for k in price], "pk string, v string")
    index = spark.createDataFrame([("price", v, k) for k, v in price.items()], "idx string, idx_value string, pk string")
    find = lambda q: [r.pk for r in collections.index_range(records, index, "price", q).collect()]
    assert find(collections.IndexRange(("020", True), ("040", False))) == ["b", "c", "d"]
    assert find(collections.IndexRange.between("010", "040").ordered(True).limited(2)) == ["e", "d"]
    assert find(collections.IndexRange(("020", False))) == ["d", "e"] and find(collections.IndexRange(limit=0)) == []
    moved = spark.createDataFrame([("price", "010", "e"), ("price", "040", "f")], "idx string, idx_value string, pk string")
    assert rows(collections.upsert_conflicts(index, moved, ["price"])) == [("price", "010", "e", "a")]
    history = spark.createDataFrame([("x", 1, 2), ("x", 2, 3), ("y", 1, 2), ("y", 3, 4)], "name string, from_version int, to_version int")
    assert rows(collections.migration_steps(history)) == [("x", 1, 2, True), ("x", 2, 3, True), ("y", 1, 2, True), ("y", 3, 4, False)]
    upper = collections.migrate(records, rows=lambda it: (f.assign(v=f.v.str.upper()) for f in it))
    assert rows(upper, "v")[0] == ("VA",)


QUEUE = "queue string, id long, state string, priority long, attempts long, available_at_ms long, lease_until_ms long, payload string"


def test_queue_claims_and_settlement(spark):
    q = spark.createDataFrame([("q", 1, "ready", 0, 0, 0, 0, "normal"), ("q", 2, "ready", 10, 0, 0, 0, "urgent"), ("q", 3, "ready", 99, 0, 5000, 0, "later"), ("q", 4, "leased", 0, 1, 9999, 100, "stale")], QUEUE)
    assert [r.payload for r in queues.claim(q, 1000, 100, 3).orderBy("claim").collect()] == ["urgent", "normal", "stale"]
    assert [r.payload for r in queues.claim(q, 99, 100, 9).orderBy("claim").collect()] == ["urgent", "normal"]
    commands = spark.createDataFrame([("q", 4, 2, "ack", 0), ("q", 1, 0, "ack", 0)], "queue string, id long, generation long, command string, at_ms long")
    assert queues.settle(q, commands).count() == 4
    for name, state, at in (("nack", "ready", 50), ("dead", "dead", 9999)):
        one = spark.createDataFrame([("q", 4, 1, name, 50)], commands.schema)
        assert rows(queues.settle(q, one).filter("id = 4"), "state", "attempts", "available_at_ms", "lease_until_ms") == [(state, 1, at, 0)]
    new = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("r", "z", 3)], "queue string, payload string, n int").withColumns({"priority": F.lit(None).cast("long"), "available_at_ms": F.lit(None).cast("long")})
    assert rows(queues.push(q, new, "n"), "queue", "id", "payload") == [("q", 5, "x"), ("q", 6, "y"), ("r", 1, "z")]
    assert [r.lag_ms for t in (1000, -5) for r in queues.lag(q, t).collect()] == [1000, 0]


JOB = "id string, handler string, state string, available_at_ms long, deadline_ms long, priority long, attempts long, max_attempts long, retry_backoff_ms long, lease_until_ms long, idempotency_key string"


def test_job_transitions(spark):
    j = spark.createDataFrame(
        [("a", "h", "ready", 0, None, 1, 0, 2, 10, 0, "k"), ("b", "h", "ready", 0, None, 9, 2, 2, 10, 0, None), ("c", "g", "leased", 0, None, 0, 1, 2, 10, 50, None), ("d", "g", "ready", 0, 100, 5, 0, 2, 10, 0, None), ("e", "g", "dead", 0, None, 0, 2, 2, 10, 0, "z")], JOB
    )
    # the best job of h has no attempt left: it dies, and the claim gives nothing although another waits
    assert rows(jobs.claim(j, 100, 10), "id", "claimed", "state", "attempts", "lease_until_ms") == [("b", False, "dead", 3, 0)]
    assert rows(jobs.claim(j, 100, 10, ["g"]), "id", "claimed", "state", "attempts", "lease_until_ms") == [("c", True, "leased", 2, 110)]
    assert rows(jobs.claim(j, 100, 10, claims=9), "id", "claimed") == [("a", True), ("b", False), ("c", True)]
    assert rows(jobs.expired(j, 100), "id", "lease_until_ms") == [("d", 0)] and jobs.expired(j, 99).count() == 0
    # past its deadline a job dies even before it is available
    assert rows(jobs.expired(j.withColumn("available_at_ms", F.lit(10**6)), 100), "id") == [("d",)]
    assert rows(jobs.reap(j, 50), "id", "state", "available_at_ms", "lease_until_ms") == [("c", "ready", 50, 0)] and jobs.reap(j, 49).count() == 0
    commands = spark.createDataFrame([("a", "cancel", None, None), ("c", "complete", 1, None), ("e", "retry", None, None), ("d", "complete", 0, None)], "id string, command string, generation long, until_ms long")
    assert rows(jobs.settle(j, commands, 77), "id", "state", "attempts", "available_at_ms", "lease_until_ms") == [("a", "cancelled", 0, 0, 0), ("b", "ready", 2, 0, 0), ("c", "completed", 1, 0, 0), ("d", "ready", 0, 0, 0), ("e", "ready", 0, 77, 0)]
    specs = spark.createDataFrame([(1, "k"), (2, "z"), (3, "z"), (4, None), (5, None)], "spec_id long, idempotency_key string")
    assert rows(jobs.submit(j, specs), "spec_id", "reuses", "is_new") == [(1, "a", False), (2, None, True), (3, None, False), (4, None, True), (5, None, True)]
    delays = [r[0] for r in spark.range(256).select(retry_delay_ms(F.repeat(F.char("id"), 16), F.lit(1000), F.lit(3))).collect()]
    assert min(delays) >= 2700 and max(delays) <= 3300 and len(set(delays)) > 4


def test_a_job_over_several_steps(spark):
    """Claimed, lost, reaped, claimed again, failed, claimed a last time past its attempts, retried by hand, cancelled."""
    j = spark.createDataFrame([("a", "h", "ready", 0, None, 1, 0, 2, 100, 0, None)], JOB)
    leased = jobs.claim(j, 10, 5).select(j.columns)
    assert rows(leased, "state", "attempts", "lease_until_ms") == [("leased", 1, 15)]
    assert jobs.claim(leased, 14, 5).count() == 0 and jobs.reap(leased, 14).count() == 0
    back = jobs.reap(leased, 15).select(j.columns)
    assert rows(back, "state", "available_at_ms", "lease_until_ms") == [("ready", 15, 0)]
    again = jobs.claim(back, 20, 5).select(j.columns)
    stale = spark.createDataFrame([("a", "complete", 1, None)], "id string, command string, generation long, until_ms long")
    assert rows(jobs.settle(again, stale, 21), "state") == [("leased",)]
    dead = jobs.fail(again, 21).select(j.columns)
    assert rows(dead, "state", "lease_until_ms") == [("dead", 0)] and jobs.claim(dead, 99, 5).count() == 0
    revived = jobs.settle(dead, stale.withColumn("command", F.lit("retry")), 30)
    assert rows(revived, "state", "attempts", "available_at_ms") == [("ready", 0, 30)]
    assert rows(jobs.settle(jobs.claim(revived, 30, 5).select(j.columns), stale.withColumn("command", F.lit("cancel")), 31), "state", "lease_until_ms") == [("cancelled", 0)]


def test_index_transactions_and_migrations(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b")], "pk long, v string")
    index = spark.createDataFrame([("u", "x", 1), ("u", "y", 2), ("s", "q", 1)], "idx string, idx_value string, pk long")
    new = spark.createDataFrame([(1, "c")], "pk long, v string")
    entry = lambda v: spark.createDataFrame([("u", v, 1)], index.schema)
    with pytest.raises(ValueError, match="belongs to 2"):
        collections.upsert_indexed(records, index, new, entry("y"), ["u"])
    with pytest.raises(ValueError, match="empty"):
        collections.upsert_indexed(records, index, new.withColumn("pk", F.lit(None).cast("long")), entry("z"), ["u"])
    r, i = collections.upsert_indexed(records, index, new, entry("x"), ["u"])
    assert rows(r, "pk", "v") == [(1, "c"), (2, "b")] and rows(i, "idx", "idx_value", "pk") == [("u", "x", 1), ("u", "y", 2)]
    with pytest.raises(ValueError, match="found 4"):
        collections.migrate_collection(records, index, 4, 3, 5, F.upper)
    same, _, report = collections.migrate_collection(records, index, 3, 3, 5, F.upper, batch_size=1, dry_run=True)
    assert rows(same, "v") == [("a",), ("b",)] and report.first().batches_committed == 0 and report.first().version == 3
    with pytest.raises(Exception):
        objects.retention(spark.createDataFrame([("o", "soon")], "object_id string, expires_at_unix string"), spark.createDataFrame([], "object_id string"), 5).collect()


def test_cron(spark):
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *", "5-1 * * * *", "x * * * *", "* * * * 7"):
        with pytest.raises(ValueError):
            Cron.parse(bad)
    at = spark.createDataFrame([("2024-01-31 23:59:30",), ("2024-02-28 10:00:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    first = lambda e: [str(r[0]) for r in at.select(Cron.parse(e).next_after(F.col("t"))).collect()]
    assert first("*/5 * * * *") == ["2024-02-01 00:00:00", "2024-02-28 10:05:00"]
    assert first("0 0 1 * 5") == ["2024-02-01 00:00:00", "2024-03-01 00:00:00"]
    assert first("0 10 29 2 *") == ["2024-02-29 10:00:00"] * 2
    assert first("0 0 31 2 *") == ["None"] * 2
    days = spark.sql("SELECT explode(sequence(timestamp'2024-01-01', timestamp'2024-01-31', interval 1 day)) AS t")
    # */2 is a restriction of the day of the month, so that either day field may fit
    assert days.filter(Cron.parse("0 0 */2 * 1").matches(F.col("t"))).count() == 16 + 2


def test_schedules_and_triggers(spark):
    s = spark.createDataFrame([(1, "h", "interval", 10, 100, True), (2, "h", "once", 10, 100, True), (3, "h", "interval", 10, 136, True), (4, "h", "once", 10, 1, False)], "id long, handler string, mode string, every_ms long, next_run_ms long, enabled boolean")
    assert rows(schedules.tick(s, 135, 9), "id", "fired_at_ms", "next_run_ms", "enabled") == [(1, 100, 140, True), (2, 100, 100, False)]
    assert schedules.tick(s, 135, 0).count() == 0
    triggers = spark.createDataFrame([("on", "template", True), ("off", "template", False)], "name string, template string, enabled boolean")
    sent = spark.createDataFrame([("on", None), ("on", "own"), ("off", "own")], "trigger string, payload string")
    assert rows(schedules.fire(triggers, sent, 1), "name", "payload") == [("on", "own"), ("on", "template")]


def test_streams_objects_workflows(spark):
    e = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 2, "c")], "stream string, stream_offset long, payload string")
    new = spark.createDataFrame([("s", "d", 1), ("t", "e", 2)], "stream string, payload string, n int")
    assert rows(messaging.append(e, new, "n")) == [("s", 3, "d"), ("t", 0, "e")]
    subs = spark.createDataFrame([("s", "x", 1), ("s", "y", 9)], "stream string, subscription string, next_offset long")
    assert rows(messaging.poll(e, subs, 5), "subscription", "payload") == [("x", "b"), ("x", "c")] and messaging.poll(e, subs, 0).count() == 0
    contents = spark.createDataFrame([(1, "\x07" * 1024), (2, ""), (3, "abc"), (4, "abc"), (5, None)], "id long, content string")
    assert [len(r.data) for r in objects.chunks(contents.filter("id = 1"), "id", "content", 300).orderBy("chunk").collect()] == [300, 300, 300, 124]
    assert rows(objects.deduplicate(contents.filter("id in (3, 4)"), "content", "id"), "size", "copies", "first_writer") == [(3, 2, 3)]
    stored = objects.deduplicate(contents.filter("id <> 5"), "content", "id").withColumn("expires_at_unix", F.col("first_writer"))
    refs = stored.filter("first_writer = 1").select("object_id", F.lit("n").alias("namespace"), F.lit("f").alias("name"))
    assert tuple(objects.retention(stored, refs, 2).first()) == (3, 2, 1, 1) and objects.orphans(stored, refs).count() == 2 and objects.orphans(stored, refs, 0).count() == 0
    commands = [("create", "s1", "p1", 0), ("wait_signal", "go", None, 1), ("signal", "other", "no", 2), ("signal", "go", "p2", 3), ("wait_until", None, None, 50), ("resume", None, None, 49), ("resume", None, None, 50), ("complete", None, "end", 60), ("cancel", None, None, 61)]
    flow = spark.createDataFrame([(1, i, *c) for i, c in enumerate(commands)], "id long, seq long, command string, name string, payload string, at_ms long")
    states = [workflows.fold(flow.filter(F.col("seq") < n)).first() for n in (2, 3, 4, 6, 7, 9)]
    assert [(s.status, s.state, s.signal) for s in states] == [("waiting", "p1", "go"), ("waiting", "p1", "go"), ("running", "p2", None), ("waiting", "p2", None), ("running", "p2", None), ("completed", "end", None)]
