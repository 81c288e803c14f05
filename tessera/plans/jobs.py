"""Job logs: batch forms of the stateful operators, and the streams themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import jobs
from ..tables import shared_folder, table
from .registry import query


def _events(spark, d):
    """Users as jobs, event types as statuses."""
    names = F.create_map(*[F.lit(x) for kv in {"signup": "queued", "view": "running", "click": "interrupted", "purchase": "done", "error": "error"}.items() for x in kv])
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("job"), names[F.col("event_type")].alias("status"), F.col("value").alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), "event_type")


@query("status_latest", "SELECT user_id AS job, arg_max(CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'interrupted' WHEN 'purchase' THEN 'done' ELSE 'error' END, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY 1")
def status_latest(spark, d):
    """STR-01."""
    return jobs.latest_status(_events(spark, d))


@query("illegal_transitions", """WITH e AS (SELECT event_id, user_id AS job, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'interrupted' WHEN 'purchase' THEN 'done' ELSE 'error' END AS status FROM events), p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY job ORDER BY ts, event_id), 'queued') AS f FROM e)
    SELECT event_id, job, f AS from_status, status FROM p WHERE NOT (f || '>' || status) IN ('queued>running', 'queued>cancelled', 'running>done', 'running>error', 'running>cancelled', 'running>interrupted', 'interrupted>queued', 'interrupted>cancelled', 'error>queued', 'cancelled>queued')""")
def illegal_transitions(spark, d):
    """AUX-18, API-08."""
    return jobs.illegal_transitions(_events(spark, d))


@query("stale_sweep", "SELECT user_id AS job, max(ts) AS last FROM events GROUP BY 1 HAVING epoch_ms(TIMESTAMP '2024-01-31 00:00:00') - epoch_ms(max(ts)) > 43200000")
def stale_sweep(spark, d):
    """STR-03."""
    return jobs.stale(_events(spark, d), F.lit("2024-01-31 00:00:00").cast("timestamp"), seconds=43200)


@query("rolling_hour_cap", "SELECT event_id, ts, n AS in_hour FROM (SELECT event_id, ts, count(*) OVER (ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 20")
def rolling_hour_cap(spark, d):
    """STR-04."""
    return jobs.over_hourly_cap(table(spark, d, "events"))


@query("tumbling_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    """STR-12."""
    return jobs.tumbling(table(spark, d, "events"), "1 hour", "event_type").select("start", "event_type", "n")


@query("breaker_trips", """WITH e AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, run, event_type = 'error' ORDER BY ts, event_id) AS n FROM e WHERE event_type = 'error')
    SELECT user_id AS source, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM f WHERE n = 2 GROUP BY 1""")
def breaker_trips(spark, d):
    """STR-08."""
    c = table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("source"), (F.col("event_type") != "error").alias("ok"))
    return jobs.breaker_trips(c)


@query("host_spacing", "WITH e AS (SELECT event_id, event_type AS host, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, ts FROM events) SELECT event_id, host, CAST(max(t - n * 3100) OVER (PARTITION BY host ORDER BY ts, event_id) + n * 3100 AS BIGINT) AS start_ms FROM e")
def host_spacing(spark, d):
    """STR-07, SRC-23: earliest start of each request under a minimum spacing."""
    return jobs.spacing(table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("host")), 3100)


@query("penalty_intervals", """WITH e AS (SELECT event_id, user_id AS host, event_type = 'error' AS refused, epoch_us(ts) // 1000 AS t, ts FROM events),
    l AS (SELECT *, max(CASE WHEN refused THEN t END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(CASE WHEN refused THEN t END) OVER (w ROWS UNBOUNDED PRECEDING) AS last FROM e WINDOW w AS (PARTITION BY host ORDER BY ts, event_id)),
    s AS (SELECT *, sum(CASE WHEN refused AND (before IS NULL OR t - before > 600000) THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spell FROM l),
    n AS (SELECT *, sum(refused::INT) OVER (PARTITION BY host, spell ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS level FROM s)
    SELECT event_id, host, CAST(CASE WHEN last IS NOT NULL AND t - last <= 600000 THEN greatest(3100, least(60000, 3100 * 2 ** least(16, level))) ELSE 3100 END AS BIGINT) AS interval_ms FROM n""")
def penalty_intervals(spark, d):
    """SRC-23, STR-07: spacing doubles with each refusal and falls back after ten minutes."""
    e = table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("host"), (F.col("event_type") == "error").alias("refused"))
    return jobs.penalty_intervals(e, 3100, 60000)


@query("search_actions", """SELECT o_orderkey AS id, s AS status, s IN ('queued', 'running') AS can_cancel, s IN ('error', 'cancelled', 'interrupted') AS can_resume,
    CASE WHEN s IN ('queued', 'running') THEN 'cancelled' WHEN s IN ('error', 'cancelled', 'interrupted') THEN 'queued' ELSE s END AS after FROM (SELECT o_orderkey, ['queued', 'running', 'done', 'error', 'cancelled', 'interrupted'][o_orderkey % 6 + 1] AS s FROM orders)""")
def search_actions(spark, d):
    """API-08: what may be cancelled or resumed, and the status that it then has."""
    s = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "error", "cancelled", "interrupted"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), s.alias("status"))
    return jobs.with_actions(rows)


@query("search_requests", """WITH r AS (SELECT o_orderkey AS id, o_custkey AS topic, o_orderdate AS asked, o_orderstatus = 'O' AS active FROM orders),
    w AS (SELECT *, count(*) FILTER (WHERE active) OVER (PARTITION BY topic ORDER BY asked, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy, max(CASE WHEN NOT active THEN asked END) OVER (PARTITION BY topic ORDER BY asked, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM r)
    SELECT id, busy = 0 AS accepted, CASE WHEN base IS NULL THEN 'full' ELSE 'refresh' END AS kind, base - INTERVAL 14 DAY AS since FROM w""")
def search_requests(spark, d):
    """API-07: a topic takes one search at a time; a later one refreshes from two weeks before the last that ended."""
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("topic"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "O").alias("active"))
    return jobs.search_requests(r)


@query("job_concurrency", """WITH j AS (SELECT o_orderkey AS job, o_orderdate AS s, o_orderdate + INTERVAL 5 DAY AS e FROM orders), x AS (SELECT job, s AS t, 1 AS d FROM j UNION ALL SELECT job, e, -1 FROM j)
    SELECT job, running FROM (SELECT job, d, CAST(sum(d) OVER (ORDER BY t, d, job) AS BIGINT) AS running FROM x) WHERE d = 1""")
def job_concurrency(spark, d):
    """STR-10."""
    j = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("started"), (F.col("o_orderdate") + F.expr("INTERVAL 5 DAY")).alias("ended"))
    return jobs.concurrency(j)


@query("refresh_window", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 14 DAY")
def refresh_window(spark, d):
    """STR-05, DAT-04, API-07: a refresh looks back fourteen days before the last run."""
    since = F.lit("2024-01-20").cast("timestamp_ntz") - F.expr(f"INTERVAL {jobs.OVERLAP_DAYS} DAY")
    return table(spark, d, "events").where(F.col("ts") >= since).agg(F.count(F.lit(1)).alias("n"))


def _stream(spark, d, columns=None):
    """The events table as a stream of its file, with times that watermarks accept."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    parts = path.rpartition("/")
    source = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", parts[2]).load(parts[0])
    return jobs.as_stream_time(source)


def _run(df, mode):
    """The stream run to its end, into the shared folder."""
    return jobs.run_available(df, f"{shared_folder(df.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}", mode)


@query("stream_usage_totals", "SELECT user_id AS job, round(sum(value), 4) AS cost, count(*) AS calls FROM events GROUP BY 1")
def stream_usage_totals(spark, d):
    """STR-02, STR-06 as a stream in complete mode."""
    s = _stream(spark, d).select(F.col("user_id").alias("job"), F.col("value").alias("cost"), F.lit(0).alias("tokens"))
    return _run(jobs.usage_totals(s), "complete").select("job", F.round("cost", 4).alias("cost"), "calls")


@query("stream_hourly_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, d):
    """STR-12, STR-11 as a stream with a watermark."""
    out = _run(jobs.windowed_counts(_stream(spark, d), "1 hour", "10 minutes", "event_type"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_deduplicated", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_deduplicated(spark, d):
    """STR-05: one event of each id."""
    s = _stream(spark, d)
    return _run(jobs.deduplicated(s.union(s)).select("event_id"), "append").agg(F.count(F.lit(1)).alias("n"))


@query("stream_status_machine")
def stream_status_machine(spark, d):
    """STR-01, STR-03: keyed state with a timeout."""
    s = _stream(spark, d)
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("queued")
    out = _run(jobs.status_machine(s.select(F.col("user_id").alias("job"), "event_id", status.alias("status"), "ts")), "update")
    return out.groupBy("job").agg(F.max_by("status", "ts").alias("status"), F.max("illegal").alias("illegal"))
