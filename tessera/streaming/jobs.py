"""Stateful behaviour over a log of job events, as Structured Streaming and as the batch query that equals it.

Events: job, status, ts, cost, tokens. Streams need ``ts`` as a timestamp with a time zone; ``as_stream_time`` casts it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import sum_before

STALE_SECONDS, HOURLY_CAP, BREAKER_FAILURES, OVERLAP_DAYS = 60, 20, 2, 14
# Statuses that a job may go to from each status.
TRANSITIONS = {
    "queued": ("running", "cancelled"),
    "running": ("done", "error", "cancelled", "interrupted"),
    "interrupted": ("queued", "cancelled"),
    "error": ("queued",),
    "cancelled": ("queued",),
    "done": (),
}


def as_stream_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def latest_status(events: DataFrame, key: str = "job") -> DataFrame:
    """key, status, ts of the last event of each job."""
    return events.groupBy(key).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))


def illegal_transitions(events: DataFrame, key: str = "job", start: str = "queued") -> DataFrame:
    """Events that no rule allows after the status before them."""
    rules = F.create_map(*[x for a, bs in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, bs)).cast("array<string>"))])
    before = F.coalesce(F.lag("status").over(W.partitionBy(key).orderBy("ts", "event_id")), F.lit(start))
    rows = events.withColumn("_from", before)
    allowed = F.coalesce(F.array_contains(F.try_element_at(rules, F.col("_from")), F.col("status")), F.lit(False))
    return rows.where(~allowed).select("event_id", key, F.col("_from").alias("from_status"), "status")


def with_actions(rows: DataFrame, status: str = "status") -> DataFrame:
    """Add can_cancel, can_resume, and after: the status once that is done."""
    cancel, resume = F.col(status).isin("queued", "running"), F.col(status).isin("error", "cancelled", "interrupted")
    return rows.withColumns({"can_cancel": cancel, "can_resume": resume, "after": F.when(cancel, "cancelled").when(resume, "queued").otherwise(F.col(status))})


def search_requests(requests: DataFrame) -> DataFrame:
    """id, accepted, kind, since. requests: id, topic, at, active. Refused while another search of the topic is active;
    a refresh if one ended before, which then looks back from it by the overlap."""
    before = W.partitionBy("topic").orderBy("at", "id").rowsBetween(W.unboundedPreceding, -1)
    base = F.max(F.when(~F.col("active"), F.col("at"))).over(before)
    rows = requests.withColumn("_busy", F.count(F.when(F.col("active"), 1)).over(before)).withColumn("_base", base)
    return rows.select("id", (F.col("_busy") == 0).alias("accepted"), F.when(F.col("_base").isNull(), "full").otherwise("refresh").alias("kind"), (F.col("_base") - F.expr(f"INTERVAL {OVERLAP_DAYS} DAY")).alias("since"))


def usage_totals(events: DataFrame, key: str = "job") -> DataFrame:
    """Running sums for each job; in a stream, in update mode."""
    return events.groupBy(key).agg(F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))


def stale(events: DataFrame, now: Column, key: str = "job", seconds: int = STALE_SECONDS) -> DataFrame:
    """Jobs whose last sign is older than allowed."""
    last = events.groupBy(key).agg(F.max("ts").alias("last"))
    return last.where(F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("last").cast("timestamp")) > seconds * 1000)


def over_hourly_cap(events: DataFrame, cap: int = HOURLY_CAP, key: str = "day") -> DataFrame:
    """Events with more than ``cap`` in the hour that ends with them. Hours near midnight look into the day before.

    The range window is cut by hour, so no single task sorts all events: an event meets those of its own hour and of the
    hour before, which are counted in an equi-join.
    """
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    e = events.select("event_id", "ts", at.alias("_at"), F.floor(at / 3_600_000).alias("_h"))
    both = e.select(F.explode(F.array("_h", F.col("_h") + 1)).alias("_h"), F.col("_at").alias("_other"), F.lit(1).alias("_one"))
    mine = e.select("event_id", "ts", "_at", "_h", F.lit(0).alias("_one"))
    seq = both.select("_h", F.col("_other").alias("_at"), F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast(dict(e.dtypes)["ts"]).alias("ts"), "_one").unionByName(mine.select("_h", "_at", "event_id", "ts", "_one"))
    window = W.partitionBy("_h").orderBy("_at").rangeBetween(-3_600_000, 0)
    counted = seq.withColumn("in_hour", F.sum("_one").over(window)).where("event_id IS NOT NULL")
    return counted.where(F.col("in_hour") > cap).select("event_id", "ts", "in_hour")


def breaker_trips(calls: DataFrame, key: str = "source", failures: int = BREAKER_FAILURES) -> DataFrame:
    """key, event_id at which ``failures`` failures in a row open the circuit for the first time."""
    over = W.partitionBy(key).orderBy("ts", "event_id")
    good = F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(over)
    rows = calls.withColumn("_run", good)
    nth = F.sum(F.when(~F.col("ok"), 1).otherwise(0)).over(W.partitionBy(key, "_run").orderBy("ts", "event_id"))
    rows = rows.withColumn("_nth", nth).where((F.col("_nth") == failures) & ~F.col("ok"))
    return rows.groupBy(key).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("ts").alias("ts"))


def spacing(events: DataFrame, interval_ms: int, key: str = "host") -> DataFrame:
    """event_id, start_ms: earliest start of each request if requests of a host are ``interval_ms`` apart.

    start_k = max over j <= k of (arrival_j + (k - j) * interval): a running maximum, not a loop.
    """
    over = W.partitionBy(key).orderBy("ts", "event_id")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    n = F.row_number().over(over).cast("long") - 1  # as an integer the product ends at 692,737 requests
    rows = events.withColumn("_n", n).withColumn("_base", at - F.col("_n") * interval_ms)
    return rows.select("event_id", key, (F.max("_base").over(over) + F.col("_n") * interval_ms).alias("start_ms"))


# How long a refusal counts, and the most refusals that double the spacing.
PENALTY_DECAY_MS, MOST_PENALTIES = 10 * 60_000, 16


def penalty_intervals(events: DataFrame, base_ms: int, most_ms: int, key: str = "host") -> DataFrame:
    """event_id, key, interval_ms: the spacing after each event, doubled for each refusal (``refused``) of the last while.

    Refusals that follow each other within the decay time add up; after a longer pause they start anew.
    """
    over = W.partitionBy(key).orderBy("ts", "event_id")
    rows = events.withColumn("_t", F.unix_millis(F.col("ts").cast("timestamp")))
    hit = F.when(F.col("refused"), F.col("_t"))
    rows = rows.withColumn("_before", F.max(hit).over(over.rowsBetween(W.unboundedPreceding, -1))).withColumn("_last", F.max(hit).over(over))
    fresh = F.col("refused") & (F.col("_before").isNull() | (F.col("_t") - F.col("_before") > PENALTY_DECAY_MS))
    rows = rows.withColumn("_spell", F.sum(fresh.cast("int")).over(over))
    level = F.least(F.lit(MOST_PENALTIES), F.sum(F.col("refused").cast("int")).over(W.partitionBy(key, "_spell").orderBy("ts", "event_id")))
    doubled = F.greatest(F.lit(base_ms), F.least(F.lit(most_ms), base_ms * F.pow(F.lit(2), level)))
    active = F.col("_last").isNotNull() & (F.col("_t") - F.col("_last") <= PENALTY_DECAY_MS)
    return rows.select("event_id", key, F.when(active, doubled).otherwise(F.lit(base_ms)).cast("long").alias("interval_ms"))


def tumbling(events: DataFrame, width: str = "1 hour", *by: str) -> DataFrame:
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def concurrency(jobs: DataFrame) -> DataFrame:
    """job, running: how many jobs run at the moment each starts. jobs: job, started, ended. A sweep over both ends."""
    ends = jobs.select("job", F.col("started").alias("t"), F.lit(1).alias("d")).union(jobs.where("ended IS NOT NULL").select("job", F.col("ended").alias("t"), F.lit(-1).alias("d")))
    swept, _ = sum_before(ends, "before", "d", "t", "d", "job")
    return swept.where("d = 1").select("job", (F.col("before") + 1).alias("running"))


def deduplicated(stream: DataFrame, key: str = "event_id", delay: str = f"{OVERLAP_DAYS} days") -> DataFrame:
    """First event of each id within the tolerance for late data."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes", *by: str) -> DataFrame:
    return tumbling(stream.withWatermark("ts", delay), width, *by)


def status_machine(stream: DataFrame, seconds: int = STALE_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """job, status, ts, illegal: state of each job after each batch; a running job without a sign becomes interrupted.

    Input: job, event_id, status, ts. Statuses that no rule allows are counted and ignored.
    """
    out = "job long, status string, ts timestamp, illegal long"

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last, illegal = state.get if state.exists else ("queued", 0, 0)
        if state.hasTimedOut:
            status = "interrupted" if status == "running" else status
            state.update((status, last, illegal))
        else:
            rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
            for s, ts in zip(rows["status"], rows["ts"], strict=True):
                if s in TRANSITIONS.get(status, ()) or s == status:
                    status = s
                else:
                    illegal += 1
                last = max(last, int(ts.value // 1_000_000))
            state.update((status, last, illegal))
            if status == "running":
                state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "ts": [pd.Timestamp(last, unit="ms")], "illegal": [illegal]})

    marked = stream.withWatermark("ts", delay)
    return marked.groupBy("job").applyInPandasWithState(run, out, "status string, last long, illegal long", "update", GroupStateTimeout.EventTimeTimeout)


def run_available(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream into a folder that driver and executors share.

    Each batch is written under its number, so a batch that is repeated after a failure replaces itself. In complete mode
    the last batch is the result, else all are.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        done.append(number)

    done: list[int] = []
    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    spark = df.sparkSession
    if not done:
        return spark.createDataFrame([], df.schema)
    which = [max(done)] if mode == "complete" else sorted({*done})
    return spark.read.schema(df.schema).parquet(*[f"{folder}/out/batch={n}" for n in which])


def upsert_batches(stream: DataFrame, target: str, key: str, checkpoint: str):
    """Stream into a Parquet table by key, last event first: each batch is written under its number, so a retry after a
    failure overwrites the same folder and readers take the newest row of each key."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "ts").alias("_r")).select("_r.*")
        newest.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_upserted(spark, target: str, key: str) -> DataFrame:
    rows = spark.read.parquet(target)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct("ts", "batch")).alias("_r")).select("_r.*").drop("batch")
