"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, linear between knots. Its integral is the source's share;
shares are scaled to the word budget, stop at ``max_epochs`` times what the source has, and the excess goes to the others
by weight. A document's words are an interval of its source's cumulative demand (epoch after epoch, in hash order).
Inverting the integrated schedule at the middle of the interval gives the training position, and documents are
range-sorted by it.

Native: DataFrame functions only. The running sum inside a source is taken in two steps, over hash buckets and inside
each bucket, so a source that holds a third of all rows is spread over ``16**bucket_digits`` groups. Only per-source totals
(one row for each source) meet in one window.

Defined results: null text has size 0 and is never taken; null source is a source of its own, last in order; null ids
are taken like others; a source without words has target 0; an empty table gives an empty table; the order inside a source
is that of a hash of id and text, ties go by id; rows that repeat an id, or are repeated whole, are counted and taken as
rows of their own (which of the equal ones is taken makes no difference).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, n_words

Schedule = Sequence[tuple[float, float]]
#: Constant weights by rank of the source: 5, 2, 1 and again.
CONSTANT: tuple[Schedule, ...] = tuple(((0.0, w), (1.0, w)) for w in (5.0, 2.0, 1.0))


def _integral(schedule: Schedule) -> list[float]:
    """The schedule's integral from 0 to each knot."""
    total = [0.0]
    for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False):
        if t1 <= t0 or min(a, b) < 0:
            raise ValueError("knots must go up in time, weights must not be negative")
        total.append(total[-1] + (t1 - t0) * (a + b) / 2)
    if schedule[0][0] != 0 or schedule[-1][0] != 1:
        raise ValueError("a schedule goes from time 0 to time 1")
    return total


def _invert(schedule: Schedule, share: Column) -> Column:
    """The time at which ``share`` (0 to 1) of the schedule's integral is used up."""
    total = _integral(schedule)
    out = F.lit(1.0)
    for k in reversed(range(len(schedule) - 1)):
        (t0, a), (t1, b) = schedule[k], schedule[k + 1]
        over = F.greatest(F.lit(0.0), share * total[-1] - total[k])
        root = F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) / (t1 - t0) * over))
        time = t0 + F.when(root + a > 0, 2 * over / (root + a)).otherwise(0.0)
        out = F.when(share * total[-1] <= total[k + 1], F.least(time, F.lit(t1))).otherwise(out)
    return out


def targets(totals: DataFrame, schedules: Sequence[Schedule] = CONSTANT, max_epochs: float = 3.0, budget: float | None = None) -> DataFrame:
    """``totals`` (_source, _has) with _class (which schedule) and _target, the words that the source shall give."""
    shares = [_integral(s)[-1] for s in schedules]
    rank = F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())) - 1
    t = totals.withColumn("_class", rank % len(schedules))
    t = t.withColumn("_w", F.element_at(F.array(*map(F.lit, shares)), F.col("_class") + 1))
    t = t.withColumn("_cap", F.col("_has") * F.lit(float(max_epochs)))
    t = t.withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(float("inf")))
    # Capped sources are those first in order of cap by weight; the rest share what these leave, by weight.
    order = W.orderBy("_ratio", F.col("_source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("_has").over(everything).cast("double") if budget is None else F.lit(float(budget))
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = F.when(rest > 0, (total - before) / rest)
    t = t.withColumn("_level", level).withColumn("_place", F.row_number().over(order))
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_place", "_level"))
    t = t.withColumn("_found", F.min(fits).over(everything)["_level"])
    target = F.when(F.col("_w") > 0, F.least(F.col("_cap"), F.coalesce(F.col("_found") * F.col("_w"), F.col("_cap")))).otherwise(0.0)
    return t.select("_source", "_has", "_class", target.alias("_target"))


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash of id and text; a missing id and a missing text differ from empty ones."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("?")), F.lit(" "), F.coalesce(text, F.lit(""))]
    return F.md5(F.concat(*parts).cast("binary"))


def mix(
    docs: DataFrame,
    schedules: Sequence[Schedule] = CONSTANT,
    max_epochs: float = 3.0,
    budget: float | None = None,
    partial: bool = True,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    bucket_digits: int = 3,
) -> DataFrame:
    """One row for each row of ``docs``: id, source, size, source_size, target, taken, takes (array of position, words), row_key.

    ``takes`` has an element for each epoch in which the document is read. The document at which a source's demand runs
    out is read as far as the demand goes if ``partial``; else it is read whole if at least half of it is still wanted.
    ``row_key`` is the hash of id and text that ``repeat_documents`` meets the rows by.
    """
    sized = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        n_words(F.col(text_col)).alias("_size"),
        row_key(F.col(id_col), F.col(text_col)).alias("_order"),
    ).withColumn("_bucket", F.substring("_order", 1, bucket_digits))
    sized = durable(sized, "sized")
    buckets = sized.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_in"))
    ahead = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("_ahead", F.coalesce(F.sum("_in").over(ahead), F.lit(0))).drop("_in")
    plan = targets(sized.groupBy("_source").agg(F.sum("_size").alias("_has")), schedules, max_epochs, budget)
    buckets = durable(buckets.join(plan, buckets["_source"].eqNullSafe(plan["_source"])).drop(plan["_source"]), "buckets")
    inside = W.partitionBy("_source", "_bucket").orderBy("_order", "_id").rowsBetween(W.unboundedPreceding, -1)
    rows = sized.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    b = buckets.withColumnsRenamed({"_source": "_s", "_bucket": "_b"})
    rows = rows.join(b, rows["_source"].eqNullSafe(b["_s"]) & (rows["_bucket"] == b["_b"])).drop("_s", "_b")
    start, has = F.col("_ahead") + F.col("_inside"), F.col("_has")

    def words(epoch: Column) -> Column:
        left = F.round("_target") - (epoch * has + start)
        if partial:
            return F.greatest(F.lit(0), F.least(F.col("_size"), left.cast("long")))
        return F.when(left * 2 >= F.col("_size"), F.col("_size")).otherwise(F.lit(0).cast("long"))

    def position(epoch: Column, n: Column) -> Column:
        share = (epoch * has + start + n / 2) / F.nullif(F.col("_target"), F.lit(0.0))
        out = F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            out = F.when(F.col("_class") == k, _invert(schedule, share)).otherwise(out)
        return out

    epochs = F.sequence(F.lit(0), F.lit(int(max_epochs + 0.999999)) - 1)
    takes = F.filter(F.transform(epochs, lambda e: F.struct(position(e, words(e)).alias("position"), words(e).alias("words"))), lambda x: x["words"] > 0)
    rows = rows.withColumn("takes", takes)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        F.col("_size").alias("size"),
        has.alias("source_size"),
        F.round("_target", 6).alias("target"),
        taken.alias("taken"),
        "takes",
        F.col("_order").alias("row_key"),
    )


def curriculum(mixed: DataFrame) -> DataFrame:
    """What ``mix`` returns, with the first training position (null if untaken), range-sorted by it, untaken documents last.

    The key breaks ties, so that the untaken documents, which share a position, are spread over the ranges too.
    """
    placed, tie = mixed.withColumn("position", F.get("takes.position", F.lit(0))), F.col("row_key")
    order = F.coalesce("position", F.lit(float("inf")))
    return placed.repartitionByRange(order, tie).sortWithinPartitions(order, tie)


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, each row once for each epoch that takes it, range-sorted by training position.

    Rows meet their takes by hash of id and text, and source. Of rows that share all of these one stands for all, and it
    comes as often as they are taken together.
    """
    takes = mixed.where("taken > 0").select(F.col("row_key").alias("_key"), F.col(source_col).alias("_src"), F.explode("takes.position").alias("_position"))
    times = mixed.groupBy(F.col("row_key").alias("_k"), F.col(source_col).alias("_s")).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    times = durable(times, "repeated").hint("merge")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row_key(docs[id_col], docs[text_col]).alias("_own"), docs[source_col].alias("_from"))
    marked = rows.join(times, (F.col("_own") == F.col("_k")) & F.col("_from").eqNullSafe(F.col("_s")), "left")
    first = marked.where("_times IS NOT NULL").groupBy("_own", "_from").agg(F.first("_row").alias("_row"))
    rows = marked.where("_times IS NULL").select("_own", "_from", "_row").unionByName(first)
    joined = rows.join(takes.hint("merge"), (F.col("_own") == F.col("_key")) & F.col("_from").eqNullSafe(F.col("_src")))
    return joined.repartitionByRange("_position", "_key").sortWithinPartitions("_position", "_key").select("_row.*")
