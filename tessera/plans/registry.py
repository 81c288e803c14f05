"""Where queries register: a function (spark, sf_dir) -> DataFrame, and its SQL if SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def six(c: Column | str) -> Column:
    return F.round(c, 6)


#: ``papers`` as made of the driver's tables: a part with what its order lines say.
PAPERS_SQL = """papers AS (
    SELECT p_partkey AS id, p_name AS title, p_brand AS venue,
           CASE WHEN p_partkey % 17 <> 0 THEN count(l_partkey) END AS cites,
           nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0) AS influential,
           CASE WHEN p_partkey % 13 <> 0 THEN CAST(max(l_quantity) AS BIGINT) END AS h_index,
           min(l_shipdate) AS published_at
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_brand)"""
NOW = "2002-01-01 00:00:00"
VELOCITY_SQL = f"cites / (greatest(3.0, (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(published_at)) / (365.25 / 12 * 86400000)) / 12)"


def papers(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("l_returnflag") == "R").alias("_r"), F.max("l_quantity").cast("long").alias("_h"), F.min("l_shipdate").alias("published_at")
    )
    p = table(spark, d, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("venue"),
        F.when(F.col("p_partkey") % 17 != 0, F.coalesce("_n", F.lit(0))).alias("cites"), F.nullif("_r", F.lit(0)).alias("influential"),
        F.when(F.col("p_partkey") % 13 != 0, F.col("_h")).alias("h_index"), "published_at",
    )


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


#: Documents as titled records: first line and the rest.
DOCS_SQL = """docs AS (
    SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract, source FROM documents)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return t.select(F.col("doc_id").alias("id"), first.alias("title"), F.substring(F.col("text"), F.length(first) + 2, F.length("text")).alias("abstract"), "source")
