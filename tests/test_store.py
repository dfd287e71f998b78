"""The versioned store, its change feed as a stream, and watches as state, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tagframe.functions import kinds
from tagframe.operators import changes
from tagframe.operators.changes import ChangelogGap
from tagframe.operators.lineage import folder
from tagframe.operators.store import Conflict, Store, diff, numbered
from tagframe.sources import feed
from tagframe.streaming import watches

IDS = [f"e{i}" for i in range(25)]


def frame(spark, writes):
    """``id, op, {tag: number, or None for a removal}``."""
    rows = [(i, op, list(tags.items())) for i, op, tags in writes]
    df = spark.createDataFrame(rows, "id string, op string, t array<struct<k: string, v: double>>")
    value = lambda x: F.when(x.v.isNull(), kinds.value("remove")).otherwise(kinds.number(x.v))
    return df.select("id", "op", F.map_from_entries(F.transform("t", lambda x: F.struct(x.k, value(x)))).alias("tags"))


def plain(tags):
    return None if tags is None else {k: None if v["kind"] == "remove" else v["num"] for k, v in tags.items()}


def of(df):
    return {r["id"]: plain(r["tags"]) for r in df.collect()}


def batches(seed, n):
    """Random batches with what they leave and the change rows they make."""
    r, now, version, log, out = random.Random(seed), {}, 0, [], []
    for _ in range(n):
        writes = []
        for i in r.sample(IDS, r.randint(1, 12)):
            tags = {k: r.choice([None, 1.0, 2.0, 3.0]) for k in r.sample(["a", "b", "c", "d"], r.randint(1, 3))}
            op = r.choice(["update", "remove", "upsert", "upsert"]) if i in now else r.choice(["add", "upsert"])
            writes.append((i, op, {} if op == "remove" else tags if r.random() < 0.9 or op == "add" else {}))
        writes.append(("nowhere", "update", {}))  # no tags: none
        for i, op, tags in sorted(writes):
            op = ("update" if i in now else "add") if op == "upsert" else op
            if op == "update" and not tags:
                continue
            version += 1
            if op == "add":
                log.append((version, op, i, None, tags, None, None))
                now[i] = dict(tags)
            elif op == "remove":
                log.append((version, op, i, now.pop(i), None, None, None))
            else:
                log.append((version, op, i, None, None, tags, {k: v for k, v in now[i].items() if k in tags}))
                now[i] = {k: v for k, v in now[i].items() if k not in tags} | {k: v for k, v in tags.items() if v is not None}
        out.append((writes, {k: dict(v) for k, v in now.items()}, version, list(log)))
    return out


def rows_of(log):
    return sorted((r["version"], r["op"], r["ref"], *(plain(r[c]) for c in ("old", "new", "changed", "previous"))) for r in log.collect())


@pytest.fixture(scope="module")
def filled(spark):
    """A store after six batches, and the batches."""
    store, made = Store(spark, folder(spark, "store"), buckets=5), batches(1, 6)
    for writes, now, version, log in made:
        assert store.write(frame(spark, writes)) == version == store.version()
        assert of(store.entities()) == now
        assert rows_of(store.log()) == log
    return store, made


def test_writes_log_and_replay(filled):
    store, made = filled
    got = of(changes.replay(store.log()))
    want = {i: {k: v for k, v in t.items() if v is not None} for i, t in made[-1][1].items()}
    assert got == {i: t for i, t in want.items() if t}
    assert of(store.entities(3)) == made[2][1]  # an older commit is still whole


def test_log_after_a_version_reads_only_its_parts(filled):
    store, made = filled
    after = made[3][2]
    assert rows_of(store.log(after)) == [x for x in made[-1][3] if x[0] > after]
    assert len({f.rsplit("/", 1)[0] for f in store.log(after).inputFiles()}) == 2


def test_untouched_buckets_keep_their_files(spark):
    store = Store(spark, folder(spark, "store"), buckets=8)
    store.write(frame(spark, [(i, "add", {"a": 1.0}) for i in IDS]))
    before = store.head()["buckets"]
    store.write(frame(spark, [("e3", "update", {"a": 2.0})]))
    after = store.head()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1


@pytest.mark.parametrize("bad", [[("e1", "add", {"a": 1.0})], [("zz", "update", {"a": 1.0})], [("zz", "remove", {})], [(None, "add", {"a": 1.0})], [("e1", "update", {"id": 1.0})], [("e1", "update", {"a": 1.0}), ("e1", "update", {"b": 1.0})], [("e1", "rename", {})]])
def test_bad_writes_leave_nothing(spark, bad):
    store = Store(spark, folder(spark, "store"), buckets=3)
    store.write(frame(spark, [("e1", "add", {"a": 1.0}), ("e2", "add", {"a": 1.0})]))
    with pytest.raises(Exception, match="id"):
        store.write(frame(spark, bad))
    assert store.version() == 2 and store.log().count() == 2


def test_of_two_writers_one_wins(spark):
    store = Store(spark, folder(spark, "store"), buckets=3)
    store.write(frame(spark, [("e1", "add", {"a": 1.0})]))
    late = store.head()
    store.write(frame(spark, [("e1", "update", {"a": 2.0})]))
    with pytest.raises(Conflict):
        store._publish(late | {"number": late["number"] + 1})
    assert of(store.entities()) == {"e1": {"a": 2.0}}
    assert store.write(frame(spark, [])) == 2 and store.write(frame(spark, [("x", "update", {})])) == 2 and store.head()["number"] == 2


def test_retained_log_has_a_floor(spark):
    store = Store(spark, folder(spark, "store"), buckets=3)
    for i in range(4):
        store.write(frame(spark, [(f"x{i}{j}", "add", {"a": float(j)}) for j in range(3)]))
    assert store.retain(4) == 8
    assert [r[0] for r in rows_of(store.log(8))] == [9, 10, 11, 12]
    with pytest.raises(ChangelogGap):
        store.log(7)
    assert store.write(frame(spark, [("y", "add", {"a": 1.0})])) == 13 and store.log(12).count() == 1


def test_dense_numbers_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(9)
    got = numbered(df, "k", 50).collect()
    assert sorted((r["k"], r["version"]) for r in got) == [(i, 51 + i) for i in range(1000)]


# ---- the feed


def drained(spark, store, checkpoint, **options):
    """What a query gets from where its checkpoint is to the end."""
    feed.register(spark)
    got = []

    def keep(df, n):
        got.extend(rows_of(df))

    stream = spark.readStream.format(feed.NAME).option("path", store.path)
    for k, v in options.items():
        stream = stream.option(k, v)
    q = stream.load().writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()
    q.processAllAvailable()
    q.stop()
    return sorted(got)


def test_feed_goes_on_where_it_stopped(spark):
    store, made = Store(spark, folder(spark, "store"), buckets=3), batches(2, 5)
    checkpoint, got = folder(spark, "feed"), []
    for writes, _, _, log in made:
        store.write(frame(spark, writes))
        got += drained(spark, store, checkpoint)
        assert got == log
    assert drained(spark, store, checkpoint) == []


def test_feed_from_a_version_and_after_the_floor(spark, filled):
    store, made = filled
    start = made[2][2]
    assert drained(spark, store, folder(spark, "feed"), startingVersion=start) == [x for x in made[-1][3] if x[0] > start]
    other = Store(spark, folder(spark, "store"), buckets=2)
    for i in range(3):
        other.write(frame(spark, [(f"x{i}", "add", {"a": 1.0})]))
    other.retain(1)
    with pytest.raises(Exception, match="gone"):
        drained(spark, other, folder(spark, "feed"))


def test_writes_are_dealt_out_before_they_are_sorted(spark):
    e = frame(spark, [("a", "add", {"x": 1.0})])
    joined = diff(e.select("id", "tags"), frame(spark, [("a", "update", {"x": 2.0}), ("b", "add", {"x": 3.0})]))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    # what is last stands next to the rows of writes
    assert 0 < plan.rfind("SortAggregate") < plan.rfind("Exchange hashpartitioning(id")
    assert {r["id"]: (r["op"], plain(r["tags"])) for r in joined.collect()} == {"a": ("update", {"x": 2.0}), "b": ("add", {"x": 3.0})}


# ---- watches


def plain_watches(steps):
    told, state = [], {}
    for events in steps:
        for w, kind, i, version, floor in sorted(events, key=lambda e: (e[3], watches._ORDER[e[1]])):
            if kind == "watch":
                state.setdefault(w, [version, {}])[1].setdefault(i, 0)
            elif w not in state:
                continue
            elif kind == "unwatch":
                state[w][1].pop(i, None)
            elif kind == "change" and i in state[w][1]:
                state[w][1][i] = version
            elif kind == "poll" and version > state[w][0]:
                last, ids = state[w]
                told += [(w, version, k) for k, v in ids.items() if v > last or 0 < floor and last < floor]
                state[w][0] = version
            elif kind == "close":
                del state[w]
    return sorted(told)


def test_polls_over_a_stream(spark):
    r, version, steps = random.Random(4), 0, []
    for step in range(6):
        events = []
        for w in ("w1", "w2", "w3"):
            for i in r.sample(IDS, 4):
                events.append((w, r.choice(["watch", "watch", "unwatch"]), i, version, 0))
        for _ in range(30):
            version += 1
            events += [(w, "change", r.choice(IDS), version, 0) for w in ("w1", "w2", "w3")]
            if r.random() < 0.2:
                events.append((r.choice(["w1", "w2", "w4"]), "poll", None, version, r.choice([0, 0, version - 2])))
        if step == 4:
            events.append(("w2", "close", None, version, 0))
        steps.append(events)
    path, out = folder(spark, "events"), folder(spark, "told")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, events in enumerate(steps):
            spark.createDataFrame(events, watches.EVENT).coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema(watches.EVENT).parquet(path)
            # a new query each time: its state comes from the checkpoint
            q = watches.polls(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-at").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
            got = sorted(tuple(x) for x in spark.read.schema(watches.TOLD).parquet(out).collect())
            assert got == plain_watches(steps[: n + 1])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_told_rows_are_current(spark, filled):
    store, made = filled
    watched = spark.createDataFrame([("w", i) for i in IDS[:10]], "watch_id string, id string")
    events = watches.change_events(store.log(), watched)
    assert sorted((r["id"], r["version"]) for r in events.collect()) == sorted((x[2], x[0]) for x in made[-1][3] if x[2] in IDS[:10])
    rows = spark.createDataFrame([("w", 9, i) for i in IDS], watches.TOLD)
    assert {r["id"] for r in watches.told(rows, store.entities()).collect()} == set(made[-1][1])
