"""Streams in several batches against their batch forms: state kept over batches and restarts, time to live, timers, late rows."""

from __future__ import annotations

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F
from test_folds import EVENTS, plain_alerts, random_events

from tarifa.operators import temporal
from tarifa.streaming import state

_number = itertools.count()


@pytest.fixture(scope="module")
def session(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", "2")
    s.conf.set("spark.sql.session.timeZone", "UTC")
    state.use_state_store(s)
    return s


class Feed:
    """A folder of files that a stream reads one a batch; `run` reads those that are new and gives all rows so far.

    Streams whose state lives by processing time always ask for another batch, so they run `once` for each file, with a
    restart from the checkpoint between.
    """

    def __init__(self, session, tmp_path, schema, make, once=False):
        self.session, self.path, self.schema, self.make = session, tmp_path, schema, make
        self.trigger = {"once": True} if once else {"availableNow": True}
        (tmp_path / "in").mkdir(parents=True)

    def batches(self, *batches):
        for rows in batches:
            self.put(rows)
            got = self.run()
        return got

    def put(self, rows, name="in"):
        df = self.session.createDataFrame(rows, self.schema) if isinstance(rows, list) else rows
        df.coalesce(1).write.mode("append").parquet(str(self.path / name))
        time.sleep(0.02)  # files are read in order of time

    def read(self, name="in"):
        return self.session.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / name))

    def run(self):
        name = f"out{next(_number)}"
        df = self.make(self.read())
        q = df.writeStream.format("parquet").option("checkpointLocation", str(self.path / "check")).option("path", str(self.path / "out")).queryName(name).trigger(**self.trigger).start()
        assert q.awaitTermination(180)
        return self.session.read.schema(df.schema).parquet(str(self.path / "out")).collect()


def test_alerts_over_batches_and_restarts(session, tmp_path):
    rows = random_events(24, 1)
    want = {(p, e, k, k) for p in range(4) for e, k in plain_alerts([r for r in rows if r["product_id"] == p])}
    feed = Feed(session, tmp_path, EVENTS, state.alerts_stream, once=True)
    got = feed.batches(*[[r for r in rows if 8 * i <= r["event_no"] < 8 * i + 8] for i in range(3)])
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_alert_state_has_a_time_to_live(session, tmp_path):
    row = lambda e, at: (1, e, at, 1, "r", "LOW_MARGIN", True, 0)
    kept, lost = [Feed(session, tmp_path / n, EVENTS, lambda d, ttl=ttl: state.alerts_stream(d, ttl=ttl), once=True) for n, ttl in (("kept", 3_600_000), ("lost", 1000))]
    for feed in (kept, lost):
        feed.put([row(1, 0)])
        assert len(feed.run()) == 1
    time.sleep(1.5)
    for feed, n in ((kept, 1), (lost, 2)):  # still active, or forgotten and thus an edge
        feed.put([row(2, 5000)])
        assert len(feed.run()) == n


ATTEMPTS = "key long, event_id long, at double, failed boolean"


def test_failure_alerts(session, tmp_path):
    r = random.Random(4)
    rows = [(k, i * 3 + k, float(i * 60 + k), r.random() < 0.8) for i in range(60) for k in range(3)]
    feed = Feed(session, tmp_path, ATTEMPTS, lambda d: state.failure_alerts(d, 5), once=True)
    got = feed.batches(*[[x for x in rows if 1200 * i <= x[2] - x[0] < 1200 * i + 1200] for i in range(3)])
    want = set()
    for k in range(3):
        run = 0
        for _, e, at, failed in sorted((x for x in rows if x[0] == k), key=lambda x: x[2]):
            run = run + 1 if failed else 0
            want |= {(k, e, at)} if run == 5 else set()
    assert {tuple(x) for x in got} == want and want


def test_fixed_window_and_its_timers(session, tmp_path):
    r = random.Random(5)
    rows = sorted((k, float(r.randint(0, 4000))) for k in (1, 2) for _ in range(60))
    rows = [(k, i, at) for i, (k, at) in enumerate(rows)]
    schema = "key long, event_id long, at double"
    stamp = lambda d: d.withColumn("ts", F.timestamp_seconds("at"))
    feed = Feed(session, tmp_path, schema, lambda d: state.fixed_window_stream(stamp(d), 3, 300, "10 seconds"))
    for i in range(4):
        feed.put([x for x in rows if 1000 * i <= x[2] < 1000 * i + 1000])
    want = state.fixed_window(session.createDataFrame([x for x in rows if x[2] < 4000], schema), 3, 300).collect()
    assert sorted(map(tuple, feed.run())) == sorted(map(tuple, want))


def test_once_per_event(session, tmp_path):
    feed = Feed(session, tmp_path, "event_id long, v string", state.once_per_event, once=True)
    got = feed.batches([(1, "a"), (1, "a"), (2, "b")], [(2, "b"), (3, "c")], [(1, "a"), (4, "d")])
    assert sorted(tuple(r) for r in got) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


HISTORY = "product_id long, event_no long, seconds long, price double"


@pytest.mark.parametrize("slide", [None, "20 minutes"])
def test_late_rows_miss_their_window(session, tmp_path, slide):
    """A window's rows are those that came before the watermark passed its end; the on-time rows give the batch answer."""
    r = random.Random(6)
    rows = [(p, i * 2 + p, i * 300 + r.randint(0, 200), float(r.randint(1, 99))) for i in range(48) for p in (0, 1)]
    stamp = lambda d: d.withColumn("at", F.timestamp_seconds("seconds")).drop("seconds")
    feed = Feed(session, tmp_path, HISTORY, lambda d: temporal.price_windows(stamp(d).withWatermark("at", "10 minutes"), "1 hour", slide))
    late = [(0, 9001, 100, 1000.0), (1, 9002, 200, 0.5)]
    for i in range(4):
        feed.put([x for x in rows if 3600 * i <= x[2] < 3600 * i + 3600])
    feed.put(late + [(7, 9003, 40_000, 1.0)])  # the late rows come when their hour has ended; the last row moves the watermark on
    feed.put([(7, 9004, 90_000, 1.0)])
    feed.run()
    feed.put([(7, 9005, 90_001, 1.0)])
    got = sorted(tuple(x) for x in feed.run() if x["product_id"] != 7)
    assert got == sorted(tuple(x) for x in temporal.price_windows(stamp(session.createDataFrame(rows, HISTORY)), "1 hour", slide).collect()) and got


def test_failure_sessions(session, tmp_path):
    rows = [(1, 1, s, f) for s, f in ((0, True), (50, True), (100, True), (120, False), (500, True), (520, True), (900, True), (950, True), (1000, True), (1040, True))]
    schema = "key long, event_id long, seconds long, failed boolean"
    stamp = lambda d: d.withColumn("at", F.timestamp_seconds("seconds"))
    feed = Feed(session, tmp_path, schema, lambda d: temporal.failure_sessions(stamp(d).withWatermark("at", "30 seconds"), "60 seconds", 3))
    feed.put(rows[:2])  # the first session goes on in the next batch
    feed.put(rows[2:])
    feed.put([(2, 1, 9000, True)])
    feed.put([(2, 1, 9001, True)])
    got = sorted((x["key"], x["failures"]) for x in feed.run())
    assert got == [(1, 3), (1, 4)]
    assert got == sorted((x["key"], x["failures"]) for x in temporal.failure_sessions(stamp(session.createDataFrame(rows, schema)), "60 seconds", 3).collect())


def test_interval_join_of_two_streams(session, tmp_path):
    r = random.Random(7)
    own = [(r.randint(0, 3), i, i * 120 + r.randint(0, 100), 1.0) for i in range(60)]
    rivals = [(r.randint(0, 3), 1000 + i, i * 120 + r.randint(0, 100), 2.0) for i in range(60)]
    a = lambda d: d.select("product_id", F.timestamp_seconds("seconds").alias("at"), "event_no")
    b = lambda d: d.select("product_id", F.timestamp_seconds("seconds").alias("at"), F.col("event_no").alias("rival_no"))
    late = lambda d: d.withWatermark("at", "5 minutes")
    feed = Feed(session, tmp_path, HISTORY, lambda d: temporal.interval_join(late(a(d)), late(b(feed.read("rivals"))), ["product_id"], 600).select("product_id", "event_no", "rival_no"))
    for i in range(3):
        feed.put([x for x in own if 2400 * i <= x[2] < 2400 * i + 2400])
        feed.put([x for x in rivals if 2400 * i <= x[2] < 2400 * i + 2400], "rivals")
    got = sorted(tuple(x) for x in feed.run())
    want = sorted((p, e, x) for p, e, s, _ in own for q, x, u, _ in rivals if p == q and s - 600 <= u <= s)
    assert got == want and want


def test_asof_edges(spark):
    """Ties of time, rows before the first, null keys and times, slices without rows, a hot key, empty sides."""
    r = random.Random(8)
    left = [(1, r.randint(0, 10**6), i) for i in range(300)] + [(2, 5, 900), (None, 7, 901), (1, None, 902), (3, 10, 903)]
    right = [(1, r.randint(0, 10**6), n, float(n)) for n in range(200)] + [(2, 5, 1, 1.0), (2, 5, 2, 2.0), (None, 1, 3, 3.0), (3, 11, 4, 4.0), (3, None, 5, 5.0), (1, 999_999, 998, None)]
    stamp = lambda d: d.withColumn("at", F.timestamp_seconds("s"))
    ldf, rdf = stamp(spark.createDataFrame(left, "k long, s long, id long")), stamp(spark.createDataFrame(right, "k long, s long, n long, v double"))
    got = {x["id"]: x["v"] for x in temporal.asof(ldf, rdf, ["k"], "at", ["n"], ["v"], 50_000).collect()}
    want = {}
    for k, s, i in left:
        best = max(((u, n, v) for q, u, n, v in right if None not in (k, s, u) and q == k and u <= s), key=lambda x: x[:2], default=(0, 0, None))
        want[i] = best[2]
    assert got == want and len(got) == len(left)
    assert {x["v"] for x in temporal.asof(ldf, rdf.where("false"), ["k"], "at", ["n"], ["v"]).collect()} == {None}
    assert temporal.asof(ldf.where("false"), rdf, ["k"], "at", ["n"], ["v"]).collect() == []
