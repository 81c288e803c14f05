"""Streams over files that arrive in order, so watermarks move between batches."""

import time

import pandas as pd
import pytest

from tessera.streaming import jobs


@pytest.fixture
def arriving(spark, tmp_path):
    """Write batches as files of their own and read them one at a time."""

    def make(batches, schema):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(1.1 if i < len(batches) - 1 else 0)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def at(minute):
    return (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute)).to_pydatetime()


def test_late_rows_and_windows(spark, arriving, tmp_path):
    s = arriving([[(1, at(5)), (2, at(50))], [(3, at(200))], [(6, at(201))], [(4, at(6)), (5, at(202))]], "event_id long, ts timestamp")
    got = jobs.run_available(jobs.windowed_counts(s, "1 hour", "10 minutes"), str(tmp_path / "late"), "append").collect()
    assert {(r["start"].hour, r["n"]) for r in got} == {(0, 2)}  # event 4 comes after its window closed


def test_deduplicated(spark, arriving, tmp_path):
    s = arriving([[(1, at(0)), (1, at(0))], [(1, at(1)), (2, at(2))]], "event_id long, ts timestamp")
    assert sorted(r["event_id"] for r in jobs.run_available(jobs.deduplicated(s), str(tmp_path / "dedup")).collect()) == [1, 2]


def test_status_machine_times_out(spark, arriving, tmp_path):
    schema = "job long, event_id long, status string, ts timestamp"
    s = arriving([[(1, 1, "running", at(0)), (2, 2, "running", at(0))], [(2, 3, "done", at(5)), (3, 4, "done", at(5))], [(4, 5, "running", at(60))]], schema)
    got = jobs.run_available(jobs.status_machine(s), str(tmp_path / "machine"), "update").collect()
    last = {}
    for r in got:
        last.setdefault(r["job"], []).append(r["status"])
    assert "interrupted" in last[1] and last[2][-1] == "done" and last[3] == ["queued"]
    assert max(r["illegal"] for r in got if r["job"] == 3) == 1


def test_upsert_batches(spark, arriving, tmp_path):
    s = arriving([[(1, "a", at(0)), (2, "b", at(0))], [(1, "c", at(3))]], "id long, v string, ts timestamp")
    q = jobs.upsert_batches(s, str(tmp_path / "out"), "id", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"]: r["v"] for r in jobs.read_upserted(spark, str(tmp_path / "out"), "id").collect()} == {1: "c", 2: "b"}
