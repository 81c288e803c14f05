"""What changed between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_and_dropped(base: DataFrame, current: DataFrame, id_col: str = "id", rank_col: str = "rank") -> DataFrame:
    """id, change (new or dropped), rank in the run that has it."""
    new = current.join(base.select(id_col), id_col, "left_anti").select(id_col, F.lit("new").alias("change"), rank_col)
    gone = base.join(current.select(id_col), id_col, "left_anti").select(id_col, F.lit("dropped").alias("change"), rank_col)
    return new.union(gone)


def rising(base: DataFrame, current: DataFrame, min_delta: int = 5, top: int = 10, id_col: str = "id", value: str = "cites") -> DataFrame:
    """id, before, after, delta of the most risen rows."""
    both = current.select(id_col, F.round(value).cast("long").alias("after")).join(base.select(id_col, F.round(value).cast("long").alias("before")), id_col)
    out = both.where("before IS NOT NULL AND after IS NOT NULL").withColumn("delta", F.col("after") - F.col("before")).where(F.col("delta") >= min_delta)
    return out.orderBy(F.desc("delta"), F.desc("after"), id_col).limit(top)


def publication_rate(rows: DataFrame, published: str, now: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """monthly_rate over the last 365 days; growth of the last half of it over the half before, null if that is empty."""
    age = (F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col(published).cast("timestamp"))) / 86_400_000
    count = lambda lo, hi: F.count_if((age > lo) & (age <= hi)) if lo >= 0 else F.count_if((age >= 0) & (age <= hi))
    out = rows.groupBy(*keys).agg(count(-1, 365).alias("_y"), count(-1, 182.5).alias("_h"), count(182.5, 365).alias("_p"))
    growth = F.when(F.col("_p") > 0, (F.col("_h") - F.col("_p")) / F.col("_p"))
    return out.select(*keys, (F.col("_y") / 12).alias("monthly_rate"), growth.alias("growth"))


def partition_mismatches(a: DataFrame, b: DataFrame, id_col: str = "id", cluster_col: str = "cluster") -> DataFrame:
    """One row: mismatches between two assignments of rows to clusters; 0 means that documents may be reused."""
    x, y = a.select(F.col(id_col).alias("i"), F.col(cluster_col).alias("ca")), b.select(F.col(id_col).alias("i"), F.col(cluster_col).alias("cb"))
    return x.join(y, "i", "full").agg(F.count_if(~F.col("ca").eqNullSafe(F.col("cb"))).alias("mismatches"))
