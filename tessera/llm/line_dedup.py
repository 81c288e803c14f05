"""Repeated passages: cut lines into phrases, hash runs of phrases, keep the earliest occurrence, remove the rest.

A lone line is too coarse a unit, for a passage that begins or ends inside a line shares no whole line with its copy, and
too short a one, for stock lines are no passages. So the units are phrases: a phrase ends at a word with sentence or clause
punctuation, at a word whose hash says so (one in ``CUT``, wherever the word stands), or after ``LONGEST`` words. From each
phrase the shortest run of whole phrases with at least ``min_words`` words is normalised (lower case, words without
punctuation at their ends, white space and line breaks alike) and named by a digest of 96 bits. Of equal digests the
occurrence that ranks first (by id, then place) stays; the words of the others are removed, with their offsets in the
original text. A passage is thus found whole but for the phrases that its ends cut, if the whole ones hold ``min_words``.

Scale: the texts are read once, and the runs written. 64-bit digests are shuffled and counted, combined on the map side.
Only runs whose digest occurs again go on, with id and place; the join may be split where a run is hot. No group is gathered but the
removed runs of one document. The text itself is shuffled once, to meet its removed runs.

Defined results: null and empty texts have no runs and are kept as they are; a null id ranks first; rows that share an id
are told apart by the text's hash; of rows repeated whole, one counts as the first and the others lose every run; an
occurrence that overlaps the first inside one text stays; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop
from .common import durable, map_arrow

MIN_WORDS = 30
CUT = 8
LONGEST = 24
_NULL_ID = -(2**63)
_COPIES = 10_000
_PUNCTUATION = ".!?,;:"
_EDGES = _PUNCTUATION + "\"'()[]{}<>«»“”„‘’*_"
_PLACE = re.compile(r"\S+")
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPANS = "array<struct<start:bigint,end:bigint>>"


class _Words(dict):
    """Word as written, in lower case -> hash of the bare word; the lowest bit tells whether a phrase ends here."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.strip(_EDGES).encode("utf-8", "surrogatepass"))
        h = (h & ~1) | (word[-1] in _PUNCTUATION or (h >> 8) % CUT == 0)
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = h
        return h


_words = _Words()
_made: dict[int, np.ndarray] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _powers(factor: int, n: int) -> np.ndarray:
    """1, factor, its square and so on, modulo 2**64."""
    out = _made.get(factor)
    if out is None or len(out) < n:
        out = np.full(max(n, 1 << 14), factor, dtype=np.uint64)
        out[0] = 1
        np.cumprod(out, dtype=np.uint64, out=out)
        if len(out) <= 1 << 20:
            _made[factor] = out
    return out[:n]


def runs(text: str | None, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest (64 bits, signed), first word, number of words, and 32 more bits of the digest of the runs of a text."""
    words = (text or "").lower().split()
    n = len(words)
    if n < min_words:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.astype(np.int32)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    ends = np.flatnonzero((h & np.uint64(1)).astype(bool)) + 1
    if not len(ends) or ends[-1] < n:
        ends = np.append(ends, n)
    gaps = np.diff(ends, prepend=0)
    more = (gaps - 1) // LONGEST
    if more.any():  # a phrase without an end is cut into even parts
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.sort(np.concatenate((ends, np.repeat(ends - gaps, more) + nth * LONGEST)))
    starts = np.concatenate(([0], ends[:-1]))
    last = np.searchsorted(ends, starts + min_words)
    whole = last < len(ends)
    a, b = starts[whole], ends[last[whole]]
    digests = []
    for factor in _FACTORS:
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((h >> np.uint64(1)) * _powers(factor, n), dtype=np.uint64, out=sums[1:])
        digests.append(_mixed((sums[b] - sums[a]) * _powers(pow(factor, -1, 2**64), n)[a]).view(np.int64))
    return digests[0], a, b - a, (digests[1] >> 32).astype(np.int32)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_t"))


def _digests(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """_d, _c (the digest), _id, _h (which tells rows apart that share an id), _from, _n of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [runs(x.as_py(), min_words) for x in b.column(2)]
            d, first, n, c = (np.concatenate(x) for x in zip(*got, strict=True))
            at = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
            columns = [pa.array(d), pa.array(c), b.column(0).take(at), b.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["_d", "_c", "_id", "_h", "_from", "_n"])

    return map_arrow(_rows(docs, id_col, text_col), run, "_d long, _c int, _id long, _h long, _from int, _n int")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each run to be removed: _id, _h (hash of the text), _from (first word), _n (words)."""
    found = durable(_digests(docs, id_col, text_col, min_words), "runs")
    often = durable(found.groupBy("_d").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1").select("_d"), "often")
    # ``often`` and ``first`` have no bound, so they are never broadcast: the plan is the same at every size.
    met = durable(found.join(often.hint("merge"), "_d", "left_semi"), "met")
    drop(found)
    first = met.groupBy("_d", "_c").agg(F.min(F.struct("_id", "_h", "_from")).alias("_first"), F.count(F.lit(1)).alias("_times"))
    first = durable(first.where("_times > 1"), "first")  # as a table, so that Spark may split the join where a run is hot
    both = met.join(first.hint("merge"), ["_d", "_c"])
    apart = (F.col("_id") != F.col("_first._id")) | (F.col("_h") != F.col("_first._h")) | (F.col("_from") >= F.col("_first._from") + F.col("_n"))
    return both.where(apart).select("_id", "_h", "_from", "_n")


def cut(text: str, gone: list[tuple[int, int]]) -> tuple[str, list[dict[str, int]]]:
    """The text without the words of ``gone`` (first word, number of words), and the removed places."""
    if not gone:
        return text, []
    merged: list[list[int]] = []
    for a, n in sorted(gone):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], a + n)
        else:
            merged.append([a, a + n])
    places, parts, at, k = [], [], 0, 0
    start = 0
    for nth, m in enumerate(_PLACE.finditer(text)):
        if nth == merged[k][0]:
            start = m.start()
        if nth == merged[k][1] - 1:
            places.append({"start": start, "end": m.end()})
            parts.append(text[at:start])
            whole_line = text[m.end() : m.end() + 1] == "\n" and (start == 0 or text[start - 1] == "\n")
            at, k = m.end() + whole_line, k + 1
            if k == len(merged):
                break
    return "".join([*parts, text[at:]]), places


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of ``docs``: id, text (without the removed passages), removed (array of start, end), n_removed, removed_chars."""
    lost = repeated_runs(docs, id_col, text_col, min_words)
    spans = lost.groupBy("_id", "_h").agg(F.collect_set(F.struct("_from", "_n")).alias("_gone"))
    rows = _rows(docs, id_col, text_col)
    times = rows.groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    marks = durable(spans.join(times.hint("merge"), ["_id", "_h"], "full"), "marks")
    joined = rows.join(marks.hint("merge"), ["_id", "_h"], "left")
    gone = F.coalesce("_gone", F.array().cast("array<struct<_from:int,_n:int>>")).alias("_gone")
    once = joined.where("_times IS NULL").select("_id", "_t", gone, F.lit(1).cast("long").alias("_times"))
    again = joined.where("_times IS NOT NULL").groupBy("_id", "_h").agg(F.first("_t").alias("_t"), F.first("_gone").alias("_gone"), F.first("_times").alias("_times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, gone, times in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                t = t.as_py()
                out.append((i, *(cut(t, [(g["_from"], g["_n"]) for g in gone.as_py()]) if t else (t, [])), 1))
                if times > 1:  # the other rows repeated whole
                    out.append((i, *(cut(t, list(zip(*(x.tolist() for x in runs(t, min_words)[1:3]), strict=True))) if t else (t, [])), times - 1))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64())
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_id", "text", "removed", "_copies"])

    kept = map_arrow(once.unionByName(again.select("_id", "_t", gone, "_times")), run, f"_id long, text string, removed {_SPANS}, _copies long")
    # In two steps, so that no array is as long as a row is repeated.
    kept = kept.withColumn("_part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_copies") / _COPIES) - 1)))
    kept = kept.withColumn("_k", F.explode(F.sequence(F.lit(1), F.least(F.lit(_COPIES), F.col("_copies") - F.col("_part") * _COPIES))))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    own_id = F.when(F.col("_id") != _NULL_ID, F.col("_id")).alias(id_col)
    return kept.select(own_id, "text", "removed", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"))
