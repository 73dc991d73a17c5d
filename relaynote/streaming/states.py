"""The state machine of jobs: processing at 0, 10, 30 and 85, completed at 100, or failed, also by a timeout.

An event (job_id, at, event_id, progress, failed) is accepted if it starts the job at 0, takes it to the next step or
fails it; completed and failed are final. A job that no accepted event has touched for `timeout` seconds fails, whether or
not another event comes. Other events are rejected: repeated, illegal, late, or after the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STEPS = (0, 10, 30, 85, 100)
TIMEOUT = 300
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
TRANSITIONS = "job_id long, at timestamp, progress int, status string, reason string, accepted boolean"
#: The store that holds timers and values of transformWithState.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def status_of(progress: int) -> str:
    return "completed" if progress == STEPS[-1] else "processing"


class JobMachine(StatefulProcessor):
    """A value for each job (progress, time of the last accepted event, its id, status) and a timer while it is processing.

    Rows come and go in batches over many jobs. Each question to the store is a message from Python to Spark and back, so a
    job's value is read once and written once, and timers are only asked for where one can be.
    """

    def __init__(self, timeout: int = TIMEOUT) -> None:
        self.timeout = timeout * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "progress int, micros long, event_id long, status string")

    def _rearm(self, was: tuple | None, micros: int | None) -> None:
        if was is not None and was[3] == "processing":
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if micros is not None:
            self.handle.registerTimer(micros // 1000 + self.timeout)

    def _timeout(self, key: tuple, job: tuple) -> tuple:
        progress, micros, _, _ = job
        return (key[0], micros + 1000 * self.timeout, progress, "failed", "timeout", True)

    @staticmethod
    def _row(job_id: int, micros: int, progress: int, status: str, reason: str, accepted: bool) -> Row:
        return Row(job_id=job_id, at=EPOCH + timedelta(microseconds=micros), progress=progress, status=status, reason=reason, accepted=accepted)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        # of one job in one batch; sorted, as a batch's rows have no order
        events = sorted((r["micros"], r["event_id"], r["progress"], r["failed"]) for r in rows)
        out, armed, changed = [], None, False
        found = self.job.get()
        job = was = tuple(found) if found is not None else None
        for micros, event_id, progress, failed in events:
            if job is not None and job[3] == "processing" and micros >= job[1] + 1000 * self.timeout:
                out.append(self._timeout(key, job))
                job, armed, changed = (*job[:3], "failed"), None, True
            done = job is not None and job[3] != "processing"
            at = STEPS.index(job[0]) if job is not None else -1
            if done:
                reason = "after the end"
            elif job is not None and (micros, event_id) <= job[1:3]:
                reason = "late"
            elif failed and job is not None:
                reason = "failure"
            elif not failed and progress == STEPS[at + 1]:
                reason = "step"
            else:
                reason = "repeated" if job is not None and progress in STEPS[: at + 1] else "illegal"
            accepted = reason in ("step", "failure")
            if accepted:
                now = job[0] if reason == "failure" else int(progress)
                job, changed = (now, int(micros), int(event_id), "failed" if reason == "failure" else status_of(now)), True
                armed = job[1] if job[3] == "processing" else None
            out.append((key[0], int(micros), job[0] if accepted else int(progress), job[3] if job is not None else "unknown", reason, accepted))
        if changed:
            self.job.update(job)
            self._rearm(was, armed)
        yield from (self._row(*x) for x in out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        job = self.job.get()
        if job is not None and job[3] == "processing":
            self.job.update((*tuple(job)[:3], "failed"))
            yield self._row(*self._timeout(key, tuple(job)))

    def close(self) -> None:
        pass


def transition_stream(events: DataFrame, timeout: int = TIMEOUT, delay: str = "0 seconds") -> DataFrame:
    """A row for each event of a stream, accepted or rejected, and for each timeout. Append mode.

    Timeouts fire once the watermark, `delay` behind the latest event, passes them: no event of the job is needed. The
    session has to have PROVIDER as its state store.
    """
    rows = events.withColumn("at", F.col("at").cast("timestamp")).select(F.col("job_id").cast("long").alias("job_id"), "at", F.unix_micros("at").alias("micros"), "event_id", "progress", "failed")
    machine = rows.withWatermark("at", delay).groupBy("job_id")
    return machine.transformWithState(JobMachine(timeout), TRANSITIONS, "Append", "eventTime")


def states_of(transitions: DataFrame) -> DataFrame:
    """job_id, status, progress, at, reason of the last accepted transition, and steps, how many events were accepted."""
    order = F.struct("at", F.col("reason").isin("failure", "timeout").alias("end"), "progress")
    last = F.max_by(F.struct("status", "progress", "at", "reason"), order)
    rows = transitions.filter("accepted").groupBy("job_id").agg(last.alias("x"), F.sum((F.col("reason") != "timeout").cast("long")).alias("steps"))
    return rows.select("job_id", "x.*", "steps")


def job_states(events: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """The columns of states_of from a whole table of events, as of its latest one.

    Each of the six transitions is the least (at, event_id) of the events that could follow the last one, by a join and a
    partial aggregate: events of a job are neither gathered nor sorted, and are shuffled once.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    rows = events.filter(F.col("failed") | F.col("progress").isin(*STEPS)).filter("at is not null and job_id is not null")
    rows = rows.select(F.col("job_id").cast("long").alias("job_id"), F.struct(micros.alias("micros"), "event_id", "failed", "progress").alias("e"))
    now = events.agg(F.max(micros).alias("now"))  # one row
    states = rows.filter("e.progress = 0 and not e.failed").groupBy("job_id").agg(F.min("e").alias("last"))
    states = states.select("job_id", F.col("last.micros").alias("micros"), F.col("last.event_id").alias("event_id"), F.lit(0).alias("progress"), F.lit("processing").alias("status"), F.lit("step").alias("reason"), F.lit(1).cast("long").alias("steps"))
    for before, step in zip(STEPS, STEPS[1:]):
        held = states.filter(f"status = 'processing' and progress = {before}").select("job_id", "micros", "event_id")
        after = F.struct("e.micros", "e.event_id") > F.struct("micros", "event_id")
        could = after & (F.col("e.micros") < F.col("micros") + timeout * 1_000_000) & (F.col("e.failed") | (F.col("e.progress") == step))
        following = rows.join(held, "job_id").filter(could).groupBy("job_id").agg(F.min("e").alias("e"))
        both = states.join(following, "job_id", "left")
        moved, fails = F.col("e").isNotNull(), F.col("e.failed")
        status = F.when(fails, "failed").otherwise(F.lit(status_of(step)))
        states = both.select(
            "job_id", F.coalesce("e.micros", "micros").alias("micros"), F.coalesce("e.event_id", "event_id").alias("event_id"),
            F.when(moved & ~fails, step).otherwise(F.col("progress")).alias("progress"), F.when(moved, status).otherwise(F.col("status")).alias("status"),
            F.when(moved, F.when(fails, "failure").otherwise("step")).otherwise(F.col("reason")).alias("reason"), (F.col("steps") + moved.cast("long")).alias("steps"),
        )
    over = (F.col("status") == "processing") & (F.col("micros") + timeout * 1_000_000 <= F.col("now"))
    at = F.timestamp_micros(F.when(over, F.col("micros") + timeout * 1_000_000).otherwise(F.col("micros")))
    out = states.join(F.broadcast(now))
    return out.select("job_id", F.when(over, "failed").otherwise(F.col("status")).alias("status"), "progress", at.alias("at"), F.when(over, "timeout").otherwise(F.col("reason")).alias("reason"), "steps")
