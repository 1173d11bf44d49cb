"""Job states: the stream with timers gives what the table gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lontar.plans import catalogue
from lontar.streaming import events as streams
from lontar.streaming import jobs

START = datetime(2024, 1, 1)
HOUR = 3_600_000


def plain(rows, timeout, kept):
    """Transitions by going through the events of each job in order."""
    until = max(at for _, _, at in rows)
    out = []
    for job in {r[0] for r in rows}:
        phase = changed = None
        for at, kind in [*sorted(((at, k) for j, k, at in rows if j == job), key=lambda x: (x[0], -ord(x[1][0]))), (until, "end")]:
            if phase == "pending" and changed + timeout <= at:
                out.append((job, "queued", False, changed + timeout))
                phase = "queued"
            if phase not in (None, "expired") and changed + kept <= at:
                out.append((job, "expired", False, changed + kept))
                phase = "expired"
            if kind == "submit" and phase is None:
                out.append((job, "pending", False, at))
                phase, changed = "pending", at
            elif kind in ("done", "failed") and phase in ("pending", "queued"):
                out.append((job, "completed" if kind == "done" else "failed", phase == "queued", at))
                phase, changed = "finished", at
    return sorted(out)


def events_of(spark, rows):
    return spark.createDataFrame([(j, k, START + timedelta(milliseconds=at)) for j, k, at in rows], "job_id string, kind string, ts timestamp")


def random_rows(seed):
    rnd = random.Random(seed)
    return [(f"j{rnd.randrange(40)}", rnd.choice(["submit", "done", "failed"]), at) for at in sorted(rnd.sample(range(1, 100_000), 200))]


BASE = int((START - datetime(1970, 1, 1)).total_seconds() * 1000)


@pytest.mark.parametrize("seed", [1, 2])
def test_table_against_a_plain_version(spark, seed):
    # A job that expires has no later submission in the table's form: keep jobs long enough for that.
    rows = random_rows(seed)
    got = sorted((r["job_id"], r["status"], r["late"], r["at_ms"] - BASE) for r in jobs.transitions(events_of(spark, rows), 8_000, 60_000).collect())
    assert got == plain(rows, 8_000, 60_000) and {r[1] for r in got} == {"pending", "queued", "completed", "failed", "expired"}
    assert jobs.transitions(events_of(spark, rows).limit(0), 8_000, 60_000).count() == 0


def test_until_a_given_time(spark):
    rows = [("a", "submit", 0), ("b", "submit", 0), ("b", "done", 5)]
    got = sorted(tuple(r)[:2] for r in jobs.transitions(events_of(spark, rows), 10, 100, F.lit(BASE + 104)).collect())
    assert got == [("a", "expired"), ("a", "pending"), ("a", "queued"), ("b", "completed"), ("b", "pending")]


def test_stream_equals_table(spark, sf_dir, tmp_path):
    """Events of the table in ten files by time; what needs no event comes when the watermark has passed it."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    ordered = batch.orderBy("ts").collect()
    folder = tmp_path / "events"
    for i in range(10):
        part = ordered[i * len(ordered) // 10 : (i + 1) * len(ordered) // 10]
        spark.createDataFrame(part, batch.schema).coalesce(1).write.mode("append").parquet(str(folder))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []
    try:
        stream = streams.read_stream(spark, str(folder), batch, max_files=1)
        states = jobs.stream_transitions(catalogue.job_events(stream), timeout_ms=6 * HOUR)
        streams.run_available(states, str(tmp_path / "c"), lambda df, _: got.extend(tuple(r) for r in df.collect()), "append")
    finally:
        spark.conf.unset(key)
    assert sorted(got) == sorted(tuple(r) for r in catalogue.job_transitions(spark, sf_dir).collect())
    assert {r[1] for r in got} == {"pending", "queued", "completed", "failed", "expired"} and any(r[2] for r in got)
