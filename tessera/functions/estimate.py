"""Closed-form estimate of cost and time of a run, as Column expressions over a table of settings.

settings: depth, queries, pool, hops, seeds, hop2_seeds, rerank, selected, fulltext, k_max, calls, window_years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit costs in tokens, prices in USD per million tokens, times in seconds.
EXPAND_IN, EXPAND_OUT = 1200, 700
EXTRACT_SYSTEM, ABSTRACT_IN, EXTRACT_OUT = 1500, 350, 220
FULLTEXT_IN, FULLTEXT_OUT = 16500, 900
DOSSIER_BASE, DOSSIER_PAPER, DOSSIER_CLUSTER = 1500, 130, 60
TAIL, CLUSTERS_BASE, CLUSTERS_EACH = 400, 400, 200
FOLLOW_UPS = 1800 + 1800 + 2000 + 1500
SMALL_IN, SMALL_OUT, LARGE_IN, LARGE_OUT = 1.0, 5.0, 2.0, 10.0
CACHE_WRITE, CACHE_READ, RETRIES = 1.25, 0.1, 1.1
BATCH, PARALLEL = 5, 3
LATENCY, EMBED, PAIR, LOAD, PDF, LOCAL = 1.0, 0.015, 0.013, 4.0, 4.0, 3.0
EXPAND_S, EXTRACT_S, FULLTEXT_S, FIRST_S, REST_S = 6.0, 12.0, 15.0, 45.0, 55.0
FEED_S, KEYED_S, UNKEYED_S = 3.1, 1.05, 3.0
AUTHORS_PER_PAPER, REQUEST_IDS = 4, 100
LOW, HIGH = 0.7, 1.5
# The three presets.
PRESETS = (
    ("quick", 4, 120, 0, 0, 0, 60, 15, 0, 4, 3, 4),
    ("standard", 8, 350, 1, 15, 0, 150, 40, 4, 7, 5, 6),
    ("deep", 12, 900, 2, 30, 10, 250, 100, 10, 10, 5, None),
)
SETTINGS = "depth string, queries int, pool int, hops int, seeds int, hop2_seeds int, rerank int, selected int, fulltext int, k_max int, calls int, window_years int"


def new_fraction(window_years: Column, days: Column) -> Column:
    """Share of a refresh that is new; 1 for a first run (null days)."""
    return F.when(days.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.1), days / (F.coalesce(window_years, F.lit(10)) * 365))))


def estimate(settings: DataFrame, keyed: Column, days: Column | None = None) -> DataFrame:
    """depth, usd, minutes (expected, low, high), calls of both models, tokens in and out."""
    days = F.lit(None).cast("double") if days is None else days
    s = settings.withColumn("_new", new_fraction(F.col("window_years"), days)).withColumn("_first", days.isNull().cast("int"))
    s = s.withColumn("_read", F.ceil(F.col("selected") * F.col("_new"))).withColumn("_batches", F.ceil(F.col("_read") / BATCH)).withColumn("_full", F.ceil(F.col("fulltext") * F.col("_new")))
    c = F.col
    small_in = c("_first") * EXPAND_IN + c("_batches") * EXTRACT_SYSTEM + c("_read") * ABSTRACT_IN + c("_full") * FULLTEXT_IN
    small_out = c("_first") * EXPAND_OUT + c("_read") * EXTRACT_OUT + c("_full") * FULLTEXT_OUT
    dossier = DOSSIER_BASE + c("selected") * DOSSIER_PAPER + c("k_max") * DOSSIER_CLUSTER
    follow = F.when(c("calls") == 3, 2).otherwise(4)
    large_out = CLUSTERS_BASE + c("k_max") * CLUSTERS_EACH + FOLLOW_UPS
    tail = (follow + 1) * TAIL
    usd = (small_in * SMALL_IN + small_out * SMALL_OUT + tail * LARGE_IN + dossier * LARGE_IN * CACHE_WRITE + dossier * follow * LARGE_IN * CACHE_READ + large_out * LARGE_OUT) / 1_000_000 * RETRIES
    request = F.when(keyed, KEYED_S).otherwise(UNKEYED_S) + LATENCY
    enrich = F.ceil(F.least(c("pool").cast("double"), F.ceil(c("rerank") * 1.5)) / REQUEST_IDS) + F.ceil(c("rerank") * AUTHORS_PER_PAPER / REQUEST_IDS)
    seconds = (
        c("_first") * EXPAND_S + (c("queries") + 1) * (FEED_S + LATENCY + request) + c("pool") * c("_new") * EMBED + F.when(c("hops") > 0, (c("seeds") + c("hop2_seeds")) * 2 * request).otherwise(0.0)
        + enrich * request + LOAD + c("rerank") * PAIR + LOCAL + c("_full") * (FEED_S + LATENCY + PDF + FULLTEXT_S) + F.ceil(c("_batches") / PARALLEL) * EXTRACT_S + FIRST_S * F.when(c("calls") == 3, 0.6).otherwise(1.0) + REST_S
    )
    span = lambda x, places: F.struct(*[F.round(x * k, places).alias(n) for n, k in (("expected", 1.0), ("low", LOW), ("high", HIGH))])
    return s.select(
        "depth", span(usd, 3).alias("usd"), span(seconds / 60, 1).alias("minutes"), (c("_first") + c("_batches") + c("_full")).cast("int").alias("small_calls"), (follow + 1).alias("large_calls"),
        (small_in + tail + dossier + dossier * follow).cast("long").alias("tokens_in"), (small_out + large_out).cast("long").alias("tokens_out"),
    )
