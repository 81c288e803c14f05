"""Work in batches: pages until a limit, retries, chunks written once, stages that resume, sources that stand in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import number_rows


def paged(df: DataFrame, page_size: int, limit: int, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows with n (from 1) and the offset of the page that brings them; a page may be cut by the limit."""
    top = number_rows(df.orderBy(*order).limit(limit), "n", *order)
    return top.withColumn("page_offset", F.floor((F.col("n") - 1) / page_size) * page_size)


def run_batches(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_col: str = "batch") -> DataFrame:
    """``work`` on each batch of rows: tried twice as a whole, then row by row, so one bad row costs itself only.

    Returns batch, calls, done, failed. A batch is small by construction; batches are independent tasks.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        for attempt in (1, 2):
            try:
                return pd.DataFrame([(key[0], attempt, len(work(part)), 0)], columns=["batch", "calls", "done", "failed"])
            except Exception:  # noqa: BLE001 - any failure of the batch leads to the next try
                continue
        done = 0
        for i in range(len(part)):
            try:
                done += len(work(part.iloc[i : i + 1]))
            except Exception:  # noqa: BLE001 - the row is counted as failed
                continue
        return pd.DataFrame([(key[0], 2 + len(part), done, len(part) - done)], columns=["batch", "calls", "done", "failed"])

    return df.groupBy(batch_col).applyInPandas(run, schema)


def write_chunks(df: DataFrame, folder: str, rows: int, *order: Column | str) -> DataFrame:
    """``df`` written in chunks of ``rows`` rows, a folder each: a chunk is there as a whole or not at all, and writing again
    replaces it. Returns what stands in the folder, with chunk."""
    chunked = number_rows(df, "_n", *order).withColumn("chunk", F.floor((F.col("_n") - 1) / rows)).drop("_n")
    chunked.repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def run_stage(spark: SparkSession, folder: str, parts: Sequence, work: Callable[[object], DataFrame], stop: Callable[[], bool] = lambda: False) -> DataFrame | None:
    """``work`` for each part of a stage; a part that was written whole before is not done again.

    Parts are written to folders of their own, of which Spark's success marker tells that they are whole. If ``stop`` says
    so between two parts the stage ends (None), and a later call goes on from there.
    """
    for part in parts:
        if stop():
            return None
        path = f"{folder}/part={part}"
        if not exists(spark, f"{path}/_SUCCESS"):
            work(part).write.mode("overwrite").parquet(path)
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/part={p}").withColumn("part", F.lit(p)) for p in parts])


def collect_with_fallback(queries: DataFrame, hits: DataFrame, outages: DataFrame, primaries: Sequence[str], fallback: str) -> tuple[DataFrame, DataFrame]:
    """(hits kept, failures). queries: query; hits: query, source, id; outages: query, source.

    Each query asks the primary sources; where all of them are down, the fallback is asked. failures: source, failures.
    """
    down = outages.select("query", "source").distinct()
    lost = down.where(F.col("source").isin(*primaries)).groupBy("query").agg(F.count(F.lit(1)).alias("_down")).where(F.col("_down") == len(primaries))
    asked = queries.select("query", F.explode(F.array(*map(F.lit, primaries))).alias("source"))
    asked = asked.union(lost.join(queries, "query", "left_semi").select("query", F.lit(fallback)))
    found = hits.join(asked, ["query", "source"], "left_semi").join(down, ["query", "source"], "left_anti")
    failures = asked.join(down, ["query", "source"], "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("failures"))
    return found, failures


def foreign_request(method: Column, fetch_site: Column, origin: Column, host: Column) -> Column:
    """Whether a request that changes something comes from another site, by its fetch-site header or else its origin."""
    changes = F.upper(method).isin("POST", "PUT", "PATCH", "DELETE")
    by_site = ~F.lower(fetch_site).isin("same-origin", "none")
    by_origin = F.lower(F.regexp_extract(origin, r"^[a-zA-Z]+://([^/]+)$", 1)) != F.lower(host)
    return changes & F.coalesce(by_site, by_origin, F.lit(False))
