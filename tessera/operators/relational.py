"""Joins, windows, sets and updates that the other operators are made of.

Order always comes from columns, never from where a row stands: a tie needs a tiebreak from the caller.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import durable


def whole():
    """The window of all rows. Only for tables of known small size."""
    return W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """``df`` if it has at most ``most`` rows, else an error: what is packed into one row or broadcast has a checked size."""
    if df.select(F.lit(1)).limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return df


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key. The rows of a key meet through a pre-aggregated minimum, not a sorted group.

    Works for orders that ``min_by`` can state; pass sort expressions that all ascend (negate to descend).
    """
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def row_numbers(df: DataFrame, name: str, keys: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def top_per_group(df: DataFrame, k: int, keys: Sequence[str], *order: Column) -> DataFrame:
    """Spark turns the filter on the row number into a per-task limit before the shuffle."""
    return row_numbers(df, "_rn", keys, *order).where(F.col("_rn") <= k).drop("_rn")


def _ranged(df: DataFrame, value: Column, *order: Column | str) -> tuple[DataFrame, list]:
    """``df`` dealt into ranges of ``order`` and written with the number of the range; the sum of ``value`` before each range.

    What comes to the driver is a number for each range, of which there are as many as shuffle partitions.
    """
    parts = durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    found = {r["_range"]: r["_sum"] for r in parts.groupBy("_range").agg(F.sum(value).alias("_sum")).collect()}
    before, total = [], 0
    for k in range(max(found, default=0) + 1):
        before.append(total)
        total += found.get(k) or 0
    return parts, [*before, total]


def number_rows(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with the place of each row in the order of all rows, from 1. No task sees more than a range."""
    parts, before = _ranged(df, F.lit(1), *order)
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return parts.withColumn(name, inside + F.get(F.array(*map(F.lit, before)).cast("array<bigint>"), F.col("_range"))).drop("_range")


def sum_before(df: DataFrame, name: str, value: str, *order: Column | str) -> tuple[DataFrame, float]:
    """``df`` with the sum of ``value`` over the rows before it in the order of all rows, and the sum over all."""
    parts, before = _ranged(df, F.col(value), *order)
    inside = F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return parts.withColumn(name, F.coalesce(inside, F.lit(0)) + F.get(F.array(*map(F.lit, before)), F.col("_range"))).drop("_range"), before[-1]


def resolve_by_priority(left: DataFrame, right: DataFrame, keys: Sequence[str], id_col: str, name: str = "resolved_id") -> DataFrame:
    """``left`` with the id of the row of ``right`` that has the first of ``keys`` in common."""
    out = left
    for k in keys:
        lookup = right.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_k_{k}")).agg(F.min(id_col).alias(f"_r_{k}"))
        out = out.join(lookup, out[k] == F.col(f"_k_{k}"), "left").drop(f"_k_{k}")
    return out.withColumn(name, F.coalesce(*[F.col(f"_r_{k}") for k in keys])).drop(*[f"_r_{k}" for k in keys])


def join_on_any(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs (left_id, right_id) with any key in common: a union of equi-joins, never a nested loop."""
    parts = []
    for k in keys:
        a = left.where(F.col(k).isNotNull()).select(F.col(left_id).alias("left_id"), F.col(k).alias("_k"))
        b = right.where(F.col(k).isNotNull()).select(F.col(right_id).alias("right_id"), F.col(k).alias("_k"))
        parts.append(a.join(b, "_k").select("left_id", "right_id"))
    return reduce(DataFrame.union, parts).distinct()


def semi_both_ends(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """Edges of which both ends are among the nodes."""
    ids = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.join(ids, edges[src] == ids["_n"], "left_semi").join(ids, F.col(dst) == ids["_n"], "left_semi")


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` wins on equal keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def update_where_given(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of ``old`` replaced by those of ``new`` that are not null."""
    renamed = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = old.join(renamed, list(keys), "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def cascade_delete(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children that still have a parent."""
    return child.join(parent.select(F.col(parent_key).alias("_p")), child[child_key] == F.col("_p"), "left_semi")


def percentile_rank(df: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank from 0 to 1 with averaged ties; null and non-finite values get 0 and do not count; a single value gets 1.

    Computed over the distinct values (a pre-aggregated count), so the sorted window sees each value once.
    """
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    counted = df.where(ok).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_peers"))
    if keys:
        over = W.partitionBy(*keys)
        before = F.coalesce(F.sum("_peers").over(over.orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("_peers").over(over)
    else:
        counted, everything = sum_before(counted, "_before", "_peers", "_v")
        before, total = F.col("_before"), F.lit(everything)
    pct = F.when(total == 1, F.lit(1.0)).otherwise((before + (F.col("_peers") - 1) / 2) / (total - 1))
    ranks = counted.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_v", pct.alias(name))
    on = v == F.col("_v")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(ranks, on, "left").drop("_v", *[f"_k_{k}" for k in keys]).withColumn(name, F.coalesce(name, F.lit(0.0)))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; without bounds only clamped, with equal bounds 1."""
    from ..functions.numbers import clamp01

    return F.when(low.isNull() | high.isNull(), clamp01(value)).when(high > low, clamp01((value - low) / (high - low))).otherwise(1.0)


def round_robin(lists: DataFrame, list_col: str, rank_col: str, id_col: str, cap: int) -> DataFrame:
    """Interleave lists: each in turn gives its next best item that is not taken yet, until ``cap`` are taken.

    The rule is sequential; it reads at most ``cap`` items of each list, so that bounded part runs in one task.
    """
    import pandas as pd

    bounded = top_per_group(lists.select(list_col, rank_col, id_col), cap, [list_col], F.col(rank_col), F.col(id_col))
    schema = f"position int, {id_col} {dict(lists.dtypes)[id_col]}"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        queues = [list(g[id_col]) for _, g in part.sort_values([list_col, rank_col, id_col]).groupby(list_col)]
        out: list = []
        taken: set = set()
        while len(out) < cap and any(queues):
            for q in queues:
                while q and q[0] in taken:
                    q.pop(0)
                if q and len(out) < cap:
                    taken.add(q[0])
                    out.append(q.pop(0))
        return pd.DataFrame({"position": range(1, len(out) + 1), id_col: out})

    return bounded.groupBy(F.lit("all")).applyInPandas(run, schema)
