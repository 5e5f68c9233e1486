"""States of jobs, the queue's ledger, sessions and captions read back."""

import datetime as dt
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cliploom.storage import fresh_folder
from cliploom.streaming import jobs, ledger, sessions

T = dt.datetime(2024, 1, 1)
HOUR = 3_600_000


def at(hours):
    return T + dt.timedelta(hours=hours)


def streamed(spark, batches, schema, files=1):
    path = fresh_folder(spark, "stream")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def walk(events, stall=jobs.STALL, most=jobs.MOST):
    """All changes of one job, the events of which are in any order; time goes on for ever."""
    state, out = jobs.NEW, []
    for ms, kind in sorted(events, key=lambda e: (e[0], jobs.ORDER[e[1]])):
        state, more = jobs.step(state, ms, kind, stall, most)
        out += more
    return out + jobs.stalled(state, 1 << 60, most)[1]


def test_steps_of_a_job():
    h = HOUR
    assert walk([(0, "submitted"), (h, "started"), (2 * h, "done")]) == [(0, "queued", 0), (h, "running", 1), (2 * h, "done", 1)]
    late = walk([(0, "submitted"), (h, "started"), (20 * h, "done")])  # it had stalled seven hours before
    assert late == [(0, "queued", 0), (h, "running", 1), (13 * h, "stalled", 1), (13 * h, "queued", 1)]
    beats = walk([(0, "submitted"), (h, "started"), (12 * h, "beat"), (20 * h, "done")])
    assert beats[-1] == (20 * h, "done", 1)
    tries = walk([(0, "submitted"), *((k * h, x) for k, x in zip(range(1, 9), itertools.cycle(["started", "failed"]), strict=False))])
    assert tries[-1] == (6 * h, "dead", 3) and [c[1] for c in tries].count("running") == 3
    assert walk([(0, "started"), (1, "done"), (2, "beat")]) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_do_not_depend_on_batches(spark, seed):
    rng = random.Random(seed)
    events = [(j, at(rng.randrange(200)), rng.choice(list(jobs.ORDER))) for j in range(6) for _ in range(25)]
    events = list({(j, t): (j, t, k) for j, t, k in events}.values())
    rng.shuffle(events)
    want = sorted((j, *c) for j in range(6) for c in walk([(int((t - T).total_seconds() * 1000), k) for i, t, k in events if i == j]))
    size = rng.randrange(20, 60)
    batches = [events[k : k + size] for k in range(0, len(events), size)] + [[(None, at(5), "done"), (1, at(5), None), (-1, at(10**5), "end")]]
    path = fresh_folder(spark, "changes")
    jobs.run(streamed(spark, batches, jobs.EVENTS), f"{path}/out", f"{path}/checkpoint", late="300 hours")
    got = spark.read.parquet(f"{path}/out").select("job_id", (F.unix_millis("at") - int((T - dt.datetime(1970, 1, 1)).total_seconds()) * 1000).alias("ms"), "status", "attempt")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_a_batch_sets_one_timer():
    """Timers grow with jobs and batches, not with events; what is left waiting sets the next."""

    class State:
        rows = None
        exists = lambda self: self.rows is not None
        get = lambda self: self.rows

        def update(self, x):
            self.rows = x

        def clear(self):
            self.rows = None

        def appendList(self, x):
            self.rows = [*(self.rows or []), *x]

    class Handle:
        def __init__(self):
            self.timers = []
            self.getValueState = self.getListState = lambda *_: State()
            self.registerTimer = self.timers.append

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 50_000)

    tracker, handle = jobs.Tracker(jobs.STALL, jobs.MOST, jobs.KEEP), Handle()
    tracker.init(handle)
    kinds = ["submitted"] + ["beat"] * 98 + ["done"]
    rows = pd.DataFrame({"at": pd.to_datetime([1000 * k for k in range(100)], unit="ms"), "kind": kinds})
    list(tracker.handleInputRows((1,), iter([rows[60:], rows[:60]]), None))
    assert handle.timers == [0]
    assert [list(x.status) for x in tracker.handleExpiredTimer((1,), Now, None)] == [["queued"]]
    assert handle.timers == [0, 51_000]


def test_late_events_are_dropped_and_finished_jobs_forgotten(spark):
    batches = [[(1, at(0), "submitted"), (1, at(1), "started"), (1, at(2), "done")], [(-1, at(900), "end")], [(1, at(3), "submitted"), (2, at(950), "submitted"), (1, at(951), "submitted")], [(-1, at(2000), "end")]]
    path = fresh_folder(spark, "changes")
    jobs.run(streamed(spark, batches, jobs.EVENTS), f"{path}/out", f"{path}/checkpoint", late="10 hours")
    got = sorted((r.job_id, r.status) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [(1, "done"), (1, "queued"), (1, "queued"), (1, "running"), (2, "queued")]


QUEUE = "job_id long, source string, submitted_at timestamp"


def entered(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, QUEUE).coalesce(1).write.mode(mode).json(path)


def told(spark, folder):
    return sorted((r.job_id, r.place, r.status, r.attempts) for r in ledger.results(spark, folder).collect())


def flaky():
    def run(job, key):
        assert key == f"job-{job['job_id']}"
        if job["job_id"] == 3 or job["job_id"] == 2 and job["attempt"] < 3:
            raise ValueError("no")

    return run


def test_a_failed_job_does_not_stop_the_queue(spark):
    path = fresh_folder(spark, "queue")
    assert told(spark, path) == []
    entered(spark, [(k, "s", at(9 - k)) for k in range(1, 5)], f"{path}/jobs")
    ledger.drain(spark, f"{path}/jobs", path, f"{path}/checkpoint", flaky(), wait=0.0)
    first = [(1, 4, "done", 1), (2, 3, "done", 3), (3, 2, "dead", 3), (4, 1, "done", 1)]
    assert told(spark, path) == first
    assert {r.error for r in ledger.results(spark, path).collect()} == {None, "ValueError: no"}
    entered(spark, [(3, "again", at(50)), (9, "s", at(40)), (9, "twice", at(60)), (None, "s", at(1))], f"{path}/jobs")
    ledger.drain(spark, f"{path}/jobs", path, f"{path}/checkpoint", flaky(), wait=0.0)
    assert told(spark, path) == [*first, (9, 5, "done", 1)]
    ledger.drain(spark, f"{path}/jobs", path, f"{path}/checkpoint", flaky(), wait=0.0)
    assert len(told(spark, path)) == 5


def test_a_batch_counts_once_whatever_is_lost(spark, monkeypatch):
    """Lost after results are written, then after the ledger's entry: the same batch comes again with the same number."""
    path = fresh_folder(spark, "queue")
    batch = spark.createDataFrame([(k, "s", at(k)) for k in range(6)], QUEUE)

    def lost(*_):
        raise OSError("lost")

    commit = ledger.commit
    monkeypatch.setattr(ledger, "commit", lost)
    with pytest.raises(OSError):
        ledger.take(batch, 0, path, lambda job, key: None)
    monkeypatch.setattr(ledger, "commit", commit)
    assert told(spark, path) == []
    ledger.take(batch, 0, path, lambda job, key: None)
    want = [(k, k + 1, "done", 1) for k in range(6)]
    assert told(spark, path) == want
    ledger.take(batch, 0, path, flaky())  # entered: nothing runs
    assert told(spark, path) == want
    with pytest.raises(Exception):  # noqa: B017  two writers cannot both enter a batch
        ledger.commit(spark, path, 0)


def merged(visits, gap):
    out = []
    for v, t in sorted(visits):
        if out and out[-1][0] == v and t <= out[-1][2]:
            out[-1] = (v, out[-1][1], max(out[-1][2], t + gap), out[-1][3] + 1)
        else:
            out.append((v, t, t + gap, 1))
    return out


VISITS = "viewer long, at timestamp, value double"


def test_late_rows_bridge_sessions(spark):
    batches = [[(1, at(0), 1.0), (1, at(4), 2.0)], [(1, at(2), 9.0), (2, at(3), 1.0)], [(1, at(20), 1.0), (None, at(1), 1.0), (1, None, 1.0)], [(-1, at(999), 0.0)]]
    path = fresh_folder(spark, "sessions")
    sessions.run(streamed(spark, batches, VISITS), f"{path}/out", f"{path}/checkpoint", "3 hours", "48 hours")
    got = sorted((r.viewer, r.n, r.most) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [(1, 1, 1.0), (1, 3, 9.0), (2, 1, 1.0)]


def test_sessions_by_brute_force(spark):
    rng = random.Random(7)
    visits = list({(rng.randrange(4), rng.randrange(300)) for _ in range(120)})
    rng.shuffle(visits)
    batches = [[(v, at(t), 1.0) for v, t in visits[k : k + 30]] for k in range(0, 120, 30) if visits[k : k + 30]] + [[(-1, at(10**4), 0.0)]]
    path = fresh_folder(spark, "sessions")
    sessions.run(streamed(spark, batches, VISITS), f"{path}/out", f"{path}/checkpoint", "5 hours", "400 hours")
    epoch = int((T - dt.datetime(1970, 1, 1)).total_seconds())
    got = spark.read.parquet(f"{path}/out").select("viewer", ((F.unix_millis("start") / 1000 - epoch) / 3600).cast("long"), ((F.unix_millis("end") / 1000 - epoch) / 3600).cast("long"), "n")
    assert sorted(tuple(r) for r in got.collect()) == merged(visits, 5)


def test_sessions_told_again_replace_those_they_grew_from(spark):
    kind = sessions.SESSIONS
    held = spark.createDataFrame([(1, at(0), at(3), 1, 1.0), (1, at(4), at(7), 1, 2.0), (2, at(0), at(3), 1, 1.0)], kind)
    new = spark.createDataFrame([(1, at(0), at(7), 3, 9.0), (3, at(1), at(4), 1, 1.0)], kind)
    got = sorted((r.viewer, r.n) for r in sessions.upserted(held, new).collect())
    assert got == [(1, 3), (2, 1), (3, 1)]
