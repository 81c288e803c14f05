"""Best-fit packing under conflicts.

Documents go into bins of a fixed number of words. A text longer than a bin is cut into full bins and a tail; tails and
short texts are placed largest first. Bins are ordered by residual; the search starts at the tightest bin that has room
and goes on to its successors until one is compatible: no other document of the same duplicate cluster (one bitmap), and
fewer than ``source_limit`` of the same source (one bitmap for each count). If none is, a bin is opened.

Scale: documents are dealt by hash into shards of about ``shard_rows`` rows, so neither a hot source nor a large cluster
meets in one task, and a shard holds numbers only, never texts. Bins do not span shards; that costs a few partly filled
bins a shard.

Defined results: a text without words has no piece to place and gets one row with null bin; null source and null ids
are values like others; repeated rows are documents of one cluster, so they get different bins; an empty table gives an
empty table; ties go by id, then by place in the text; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, n_words

CAPACITY = 2048
SOURCE_LIMIT = 4
SHARD_ROWS = 8192
SCHEMA = "_id long, piece int, start_word long, n_words long, bin_id long, bin_place int, bin_words long"


def pack_rows(rows: list[tuple], capacity: int, source_limit: int) -> list[tuple]:
    """rows: (id, words, source, cluster). Returns (id, piece, start, words, bin, place in it) for each piece."""
    out, tails, bins = [], [], 0
    for n, (i, words, source, cluster) in enumerate(rows):
        start = piece = 0
        while words - start > capacity or (words - start == capacity and capacity):
            out.append((i, piece, start, capacity, bins, 0))
            start, piece, bins = start + capacity, piece + 1, bins + 1
        if words > start:
            tails.append((words - start, n, i, piece, start, source, cluster))
        elif not words:
            out.append((i, 0, 0, 0, None, None))
    bit = {}
    number = lambda key: 1 << bit.setdefault(key, len(bit))
    sources: list[list[int]] = []  # of each bin: a bitmap for each count of a source
    clusters: list[int] = []
    held: list[int] = []
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    first = bins
    for need, _, i, piece, start, source, cluster in sorted(tails, key=lambda t: (-t[0], t[1])):
        s, c = number(("source", source)), number(("cluster", cluster))
        at = bisect_left(order, (need, -1))
        while at < len(order) and (clusters[order[at][1]] & c or sources[order[at][1]][-1] & s):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(held)
            sources.append([0] * source_limit)
            clusters.append(0)
            held.append(0)
        for k in range(source_limit):
            if not sources[b][k] & s:
                sources[b][k] |= s
                break
        clusters[b] |= c
        out.append((i, piece, start, need, first + b, held[b]))
        held[b] += 1
        if room > need:
            insort(order, (room - need, b))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cluster_col: str | None = None) -> DataFrame:
    """One row for each piece: id, piece, start_word, n_words, bin_id, bin_place, bin_words (words in the bin).

    Without ``cluster_col`` documents of one cluster are those equal but for case and white space.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")))
    sized = docs.select(F.col(id_col).cast("long").alias("_id"), n_words(text).alias("_words"), F.coalesce(F.xxhash64(F.col(source_col).cast("string")), F.lit(0)).alias("_source"), cluster.alias("_cluster"))
    # Rows without an id are told apart by a number, lest those of one text meet in one shard; once written, it stays.
    sized = durable(sized.withColumn("_salt", F.when(F.col("_id").isNull(), F.monotonically_increasing_id())), "sized")
    shards = max(1, -(-sized.count() // shard_rows))
    sized = sized.withColumn("_shard", F.pmod(F.xxhash64("_id", "_cluster", "_salt"), F.lit(shards)))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_id", "_cluster", "_source"], na_position="first")
        ids = [None if pd.isna(x) else int(x) for x in part["_id"]]
        got = pack_rows(list(zip(ids, part["_words"].tolist(), part["_source"].tolist(), part["_cluster"].tolist(), strict=True)), capacity, source_limit)
        base = int(key[0]) << 40
        filled: dict[int, int] = {}
        for g in got:
            filled[g[4]] = filled.get(g[4], 0) + g[3]
        rows = [(*g[:4], None if g[4] is None else base + g[4], g[5], None if g[4] is None else filled[g[4]]) for g in got]
        frame = pd.DataFrame(rows, columns=["_id", "piece", "start_word", "n_words", "bin_id", "bin_place", "bin_words"])
        return frame.astype({c: "Int64" for c in ("_id", "bin_id", "bin_place", "bin_words")})

    packed = sized.groupBy("_shard").applyInPandas(run, SCHEMA)
    return packed.withColumnRenamed("_id", id_col)
