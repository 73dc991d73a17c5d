"""The job state machine: plain replay, late and repeated events, timers that fire without an event."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from relaynote.streaming import states

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "job_id long, at timestamp, event_id long, progress int, failed boolean"


def at(seconds):
    return START + timedelta(seconds=seconds)


def replay(events, timeout, now):
    """The last state of each job, event by event in the order of time."""
    jobs = {}
    for job, s, event_id, progress, failed in sorted(events, key=lambda e: (e[1], e[2])):
        held = jobs.get(job)
        if held is None:
            if progress == 0 and not failed:
                jobs[job] = ["processing", 0, s, "step", 1]
            continue
        if held[0] != "processing":
            continue
        if s >= held[2] + timeout:
            jobs[job] = ["failed", held[1], held[2] + timeout, "timeout", held[4]]
        elif failed:
            jobs[job] = ["failed", held[1], s, "failure", held[4] + 1]
        elif progress == states.STEPS[states.STEPS.index(held[1]) + 1]:
            jobs[job] = ["completed" if progress == 100 else "processing", progress, s, "step", held[4] + 1]
    for held in jobs.values():
        if held[0] == "processing" and held[2] + timeout <= now:
            held[:4] = ["failed", held[1], held[2] + timeout, "timeout"]
    return jobs


def table(spark, events):
    return spark.createDataFrame([(j, at(s), e, p, f) for j, s, e, p, f in events], EVENTS)


def shown(df):
    return {r["job_id"]: [r["status"], r["progress"], round(r["s"], 3), r["reason"], r["steps"]] for r in df.withColumn("s", F.unix_millis("at") / 1000 - START.timestamp()).collect()}


def made(seed, n):
    rnd = random.Random(seed)
    out, clock = [], 0
    for e in range(n):
        clock += rnd.choice([1, 7, 20])
        job = rnd.randrange(12)
        out.append((job, clock, e, rnd.choice([0, 10, 30, 85, 100, 100, 50]) if rnd.random() < 0.5 else states.STEPS[e % 5], rnd.random() < 0.02))
    return out


def test_batch_states_are_those_of_a_replay(spark):
    for seed in range(3):
        events = made(seed, 400)
        repeated = events + events[:50]
        got = shown(states.job_states(table(spark, repeated), 200))
        want = replay(events, 200, events[-1][1])
        assert got == want and {v[3] for v in want.values()} >= {"timeout"}


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, states.PROVIDER)
    yield
    spark.conf.set(key, before)


def streamed(spark, tmp_path, batches, timeout, delay="0 seconds"):
    for rows in batches:
        table(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = states.transition_stream(stream, timeout, delay).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(states.TRANSITIONS).parquet(str(tmp_path / "out"))


def test_a_stream_has_the_states_of_the_batch(spark, store, tmp_path):
    events = made(7, 300)
    events.append((99, events[-1][1] + 1, 300, 0, False))
    got = states.states_of(streamed(spark, tmp_path, [events[:100], events[100:200], events[200:]], 200))
    assert shown(got) == replay(events, 200, events[-1][1])


def test_late_repeated_and_illegal_events_are_rejected_and_timers_fire_alone(spark, store, tmp_path):
    first = [(1, 100, 1, 0, False), (1, 110, 2, 10, False), (2, 100, 3, 0, False), (3, 100, 4, 30, False)]
    second = [(1, 105, 5, 30, False), (1, 120, 6, 10, False), (1, 121, 7, 85, False), (1, 130, 8, 30, False), (2, 140, 9, 0, True), (2, 150, 10, 10, False)]
    third = [(4, 1000, 11, 0, False)]  # moves the watermark only: job 1 gets no event any more
    got = streamed(spark, tmp_path, [first, second, third], 300, "60 seconds")
    rows = sorted((r["job_id"], r["s"], r["reason"], r["status"], r["accepted"]) for r in got.withColumn("s", F.unix_millis("at") / 1000 - START.timestamp()).collect())
    assert rows == [
        (1, 100, "step", "processing", True), (1, 105, "late", "processing", False), (1, 110, "step", "processing", True),
        (1, 120, "repeated", "processing", False), (1, 121, "illegal", "processing", False), (1, 130, "step", "processing", True), (1, 430, "timeout", "failed", True),
        (2, 100, "step", "processing", True), (2, 140, "failure", "failed", True), (2, 150, "after the end", "failed", False),
        (3, 100, "illegal", "unknown", False), (4, 1000, "step", "processing", True),
    ]


def test_no_events(spark):
    assert states.job_states(table(spark, [])).collect() == []
    assert states.job_states(table(spark, [(1, 5, 1, 10, False), (2, 5, 2, 0, True)])).collect() == []


class Counted:
    """A store of one job that counts what it is asked."""

    def __init__(self, value=None):
        self.value, self.asked = value, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def __getattr__(self, name):
        def call(*args):
            self.asked.append(name)
            self.value = args[0] if name == "update" else self.value
            return {"get": self.value, "exists": self.value is not None, "listTimers": iter([1])}.get(name)

        return call


def test_a_job_asks_the_store_no_more_than_it_needs():
    machine, event = states.JobMachine(), lambda k, p: {"micros": k, "event_id": k, "progress": p, "failed": False}
    for value, steps, asked in [
        (None, states.STEPS, ["get", "update"]), (None, (0, 10), ["get", "update", "registerTimer"]), (None, (30,), ["get"]),
        ((0, 0, 0, "processing"), (10,), ["get", "update", "listTimers", "deleteTimer", "registerTimer"]), ((100, 0, 0, "completed"), (10,), ["get"]),
    ]:
        store = Counted(value)
        machine.init(store)
        rows = list(machine.handleInputRows((1,), iter([event(k + 1, p) for k, p in enumerate(steps)]), None))
        assert store.asked == asked and len(rows) == len(steps)
