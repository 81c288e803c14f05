"""What the operators share: words, and the tables written to cut lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import durable, table

__all__ = ["WORD", "durable", "map_arrow", "n_words", "table", "word_chars"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"

#: Bytes in an Arrow batch, where the session has Spark's default of 64 MB: workers keep what a batch took.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in batches that bound a worker's memory, however long the texts are.

    The bound is a setting of the session, read when the plan runs; one that the user chose stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).rstrip("b") == "67108864":
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def n_words(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points inside words."""
    return F.coalesce(F.length(F.translate(text, _SPACES, "")), F.lit(0)).cast("long")
