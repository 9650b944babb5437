"""The queue's state machine, tables by key, requeued videos and results stored by key."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.sources.keyed import Conflict, KeyedTable, Rule, keep_first, keep_last, merged
from tidemark.streaming import queue

START = datetime.datetime(2024, 1, 1)


def at(minutes, seconds=0):
    return START + datetime.timedelta(minutes=minutes, seconds=seconds)


def random_events(n=400, rows=12, seed=3):
    rng, out = random.Random(seed), []
    for seq in range(n):
        event = rng.choice([*queue.STATES, "reset_quota", "resolving"])
        error = rng.choice(["quotaExceeded", "timeout"]) if event == "failed" else None
        bundle = rng.choice([None, None, "b"]) if event == "resolving" else None
        out.append((rng.randrange(rows), at(rng.randrange(4000), rng.randrange(60)), seq, event, error, bundle))
    return out


EVENTS = "id long, ts timestamp, seq long, event string, last_error string, bundle_id string"


def states(df):
    return sorted((r.id, r.status, r.last_error, r.bundle_id, r.updated_at) for r in df.collect())


def scalar(events, as_of):
    micros = lambda t: int((t - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    out = []
    for id_ in {e[0] for e in events}:
        own = [(micros(ts), seq, event, error, bundle) for i, ts, seq, event, error, bundle in events if i == id_]
        if found := queue.folded(None, own, micros(as_of), 60 * 60_000_000):
            out.append((id_, *found[:3], datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=found[3])))
    return sorted(out)


def test_replayed_states(spark):
    events = random_events()
    df = spark.createDataFrame(events, EVENTS)
    for now in (at(4001), at(9000)):
        assert states(queue.replayed(df, now)) == scalar(events, now)
    assert {(r.before, r.after): r.n for r in queue.transitions(df).collect()}[("failed", "resolving")] > 0


def test_stream_ends_in_the_batch_result(spark, tmp_path):
    """Events arrive in any order, the stream stops half-way, and goes on where it was."""
    events = random_events(n=120, rows=6)
    end = (99, at(100_000), 10**6, "queued", None, None)
    late = random.Random(1).sample(events, len(events))
    source, table = str(tmp_path / "in"), str(tmp_path / "out")

    def follow():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        sink = lambda batch, epoch: put(batch, epoch)
        q = queue.queue_states(stream, late="5000 minutes").writeStream.outputMode("update").foreachBatch(sink).trigger(availableNow=True)
        q.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()

    def put(batch, epoch):
        keyed = KeyedTable(spark, table)
        if not keyed.versions():
            keyed.create(batch.limit(0), "id", buckets=2)
        keyed.merge(batch, keep_last("updated_at"), epoch=epoch, order="updated_at")
        keyed.merge(batch, keep_last("updated_at"), epoch=epoch, order="updated_at")  # run again: nothing changes

    for part in (late[:60], late[60:], [end], [(99, at(100_000 + 10_000), 10**6 + 1, "queued", None, None)]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        follow()
    got = [r for r in states(KeyedTable(spark, table).read()) if r[0] != 99]
    assert got == states(queue.replayed(spark.createDataFrame(events, EVENTS), at(100_000)))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keyed_table(spark, tmp_path):
    one = spark.createDataFrame([(i, 1, f"a{i}") for i in range(100)], "k int, at int, x string")
    table = KeyedTable(spark, str(tmp_path / "t")).create(one, "k", buckets=16)
    assert rows(table.read()) == rows(one) and table.versions() == [0]
    first = table.manifest()
    batch = spark.createDataFrame([(3, 0, "old"), (4, 1, "same"), (5, 2, "new"), (200, 1, "more"), (200, 2, "last")], "k int, at int, x string")
    assert table.merge(batch, keep_last("at"), epoch=0, order="at")
    want = {i: (i, 1, f"a{i}") for i in range(100)} | {4: (4, 1, "same"), 5: (5, 2, "new"), 200: (200, 2, "last")}
    assert rows(table.read()) == sorted(want.values())
    assert not table.merge(batch, keep_last("at"), epoch=0, order="at") and rows(table.read()) == sorted(want.values())
    second = table.manifest()
    changed = {b for b in second.buckets if second.buckets[b] != first.buckets.get(b)}
    assert 0 < len(changed) <= 4 and rows(table.read(0)) == rows(one)
    # a batch that was written but not published is not there
    table._write(spark.createDataFrame([(7, 9, "half")], one.schema), ["k"], 16)
    assert rows(KeyedTable(spark, table.path).read()) == sorted(want.values())
    assert table.vacuum() >= 1 and table.versions() == [1] and rows(table.read()) == sorted(want.values())
    # of two writers of one version, one fails
    with pytest.raises(Conflict):
        table._publish(second)
    assert table.merge(batch.limit(0), keep_first(), epoch=5) and table.manifest().epoch == 5


def test_keyed_table_rules(spark, tmp_path):
    old = spark.createDataFrame([(None, "n", 1), (1, "a", 1), (2, None, 1), (3, "c", 1)], "k int, x string, n int")
    new = spark.createDataFrame([(None, "N"), (1, "A"), (2, "B"), (9, "Z")], "k int, x string")
    got = lambda rule: sorted(((r.k, r.x, r.n) for r in merged(old, new, ["k"], rule).collect()), key=repr)
    order = lambda found: sorted(found, key=repr)
    assert got(keep_first()) == order([(None, "n", 1), (1, "a", 1), (2, None, 1), (3, "c", 1), (9, "Z", None)])
    assert got(Rule()) == order([(None, "N", 1), (1, "A", 1), (2, "B", 1), (3, "c", 1), (9, "Z", None)])
    some = Rule(where=F.col("old.x").isNull(), update={"n": F.col("old.n") + 1}, inserts=False)
    assert got(some) == order([(None, "n", 1), (1, "a", 1), (2, "B", 2), (3, "c", 1)])
    keep = Rule(update={"n": F.col("old.n") + 1}, replace=False, insert={"n": F.lit(7)})
    assert got(keep) == order([(None, "n", 2), (1, "a", 2), (2, None, 2), (3, "c", 1), (9, "Z", 7)])
    empty = KeyedTable(spark, str(tmp_path / "e")).create(old.limit(0), ["k"], buckets=4)
    assert empty.read().count() == 0
    empty.merge(old, Rule(), epoch=1)
    assert rows(empty.read().where("k is not null")) == rows(old.where("k is not null")) and empty.read().count() == 4


def test_requeue(spark):
    videos = spark.createDataFrame([(1, "c", "PT10M", at(0)), (2, "c", "PT20S", at(0)), (3, "c", "live", at(0)), (4, "c", "P1DT1S", at(-10)), (5, "d", "PT9M", at(0)),
        (6, "c", None, at(0))], "video_id long, channel_id string, duration string, published_at timestamp")
    rows_ = spark.createDataFrame([(1, 10, "failed", "x"), (4, 11, "queued", None), (1, 12, "graphed", None)], "video_id long, id long, status string, last_error string")
    got = sorted((r.video_id, r.queue_id or 0, r.action) for r in state.requeue_candidates(videos, rows_, "c").collect())
    assert got == [(1, 10, "update"), (1, 12, "update"), (2, 0, "skip"), (3, 0, "insert"), (4, 11, "update"), (6, 0, "insert")]
    assert {r.action for r in state.requeue_candidates(videos, rows_, "c", shorts=True).collect()} == {"insert", "update"}
    assert {r.video_id for r in state.requeue_candidates(videos, rows_, "c", published_after=at(-5)).collect()} == {1, 2, 3, 6}


def test_stored_by_key_needs_no_shuffle(spark, tmp_path):
    many = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = state.stored_by_key(many, "wanted_t", "k", path=str(tmp_path / "w"), buckets=4)
        state.stored_by_key(many.where("k % 3 = 0").select("k"), "done_t", "k", path=str(tmp_path / "d"), buckets=4)
        done = state.attached_by_key(spark, "k bigint", "done_again", "k", path=str(tmp_path / "d"), buckets=4)
        left = state.remaining(wanted, done, "k")
        assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == 5000 - 1667
        # a table that is not stored by key is the only side that moves
        plan = state.remaining(many, done, "k")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("wanted_t", "done_t", "done_again"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
