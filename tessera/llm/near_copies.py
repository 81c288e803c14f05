"""Near copies by word shingles: what the pipeline drops. (``simhash`` is the contract's query, at two bits.)

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is at least 0.8. Of near copies
the row with the smallest id stays: a row goes just if a row that stays, with a smaller id, is a near copy of it. So no
two rows that stay are near copies, and each row that goes has a near copy that stays.

Method: SimHash, blocks by pigeonhole, verified Hamming distance, then an exact check. One SimHash of 64 bits can't find
these: at 0.8 two of them differ in about ten bits, and blocks by pigeonhole that a pair within ten bits must share would
have five bits each. So the fingerprint is longer and its blocks follow the set: the shingles are dealt to classes by hash,
and a block is the SimHash of one class. Texts of sizes n and m at 0.8 differ in at most (n + m) / 9 shingles; with more
classes than that, one class is equal in both, and so is its block. Sizes that go with each other share the number of
classes (``_level``). Of texts above ``SAMPLE`` shingles a sample of about that many, by hash, is dealt; there, and where
the equal classes are empty, a pair at 0.8 may share no block (figures in the README). Pairs that
share a block are held against each other's size and SimHash of 2048 bits: those that differ in more than 384 (at 0.8 a
probability of about 0.0001) are not looked at. Each pair left is verified on the whole sets, so no row goes for an estimate.
Shingles are compared by 64-bit hashes, rows are told apart by id and a 64-bit hash of the text.

Scale: in a round, the first rows of each block (the first one, then ``small_group``, then ``small_group`` times as many
each time) are compared with the others of the block; a row is settled once all rows before it in its blocks have been
compared with theirs. Of many copies that share a block, a row or a few thus take the others away before these are compared
among themselves: pairs are linear in the rows. What stays and yet is alike (close enough to 0.8 for 2048 bits) still grows
with the square of its number. Rounds are written tables. The pairs of a round that are near copies are settled in one task
if they are at most ``ONE_TASK``, else step by step in joins; the verdicts are the same.

Defined results: ASCII case and white space do not count; null text counts as empty, and texts without words are copies;
fewer words than a shingle make one shingle; a null id is the smallest id; rows that share an id but not a text stand
apart; of rows that repeat id and text one stays; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, map_arrow

SHINGLE_WORDS = 5
SIMILARITY = (4, 5)  # a fraction, so that the verdict is exact
#: Sizes of one level differ by less than the square of this factor, so near copies share a level.
LEVEL = SIMILARITY[1] / SIMILARITY[0]
SAMPLE = 96
SMALL_GROUP = 32
#: Sets of at least ``SKETCH_FROM`` shingles at similarity 0.8 differ in 312 of 2048 bits at most with a standard deviation
#: of 17, in the first 512 in 78 with one of 9.
SKETCH_FROM, SKETCH_BITS, ROUGH_WORDS, ROUGH_BITS = 32, 384, 8, 116
ONE_TASK = 100_000
_SEEDS = tuple(int(x) | 1 for x in np.random.default_rng(7).integers(2**62, 2**64, size=32, dtype=np.uint64))
_NULL_ID = -(2**63)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX = tuple(np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def shingles(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter((digest(x, 42) for x in words), dtype=np.uint64, count=len(words))
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j]
    return np.unique(_mixed(h))


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in _MIX[:2]:
        x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(33))


def _level(h: np.ndarray, level: int) -> np.ndarray:
    """Keys of the blocks of one level: sizes from ``LEVEL ** level`` to below ``LEVEL ** (level + 2)``."""
    most = LEVEL ** (level + 2)
    x = _mixed(h + _MIX[2])
    if most > SAMPLE:
        keep = (x >> np.uint64(32)) < np.uint64(int(SAMPLE / most * 2**32))
        h, x = h[keep], x[keep]
    classes = int(min(most, SAMPLE) * 2 / 9) + 2
    own = (x & np.uint64(0xFFFFFFFF)) % np.uint64(classes)
    order = np.argsort(own, kind="stable")
    h, own = h[order], own[order]
    at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(h) else np.empty(0, dtype=np.int64)
    if not len(at):
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    many = np.diff(np.append(at, len(h)))
    block = np.packbits(ones * 2 > many[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return _mixed(block + _mixed(own[at] * _MIX[2] + np.uint64((level + 2) * int(_MIX[3]) % 2**64)))


def blocks(h: np.ndarray) -> list[int]:
    """Keys of the blocks of a set, on both levels of its size, as signed integers; texts without words share theirs."""
    if not len(h):
        return [0]
    level = int(math.log(len(h)) / math.log(LEVEL) + 1e-9)
    return np.unique(np.concatenate([_level(h, level - 1), _level(h, level)])).view(np.int64).tolist()


def sketch(h: np.ndarray) -> list[int]:
    """Size of the set, its SimHash of ``64 * len(_SEEDS)`` bits, and a small set itself, as signed integers."""
    out = [len(h)]
    for seed in _SEEDS:
        x = h * np.uint64(seed)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(x), 65536):
            ones += np.unpackbits(x[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(ones * 2 > len(x), bitorder="little").tobytes(), "little", signed=True))
    return out + (h.view(np.int64).tolist() if len(h) < SKETCH_FROM * LEVEL else [])


def _may(x: Column, y: Column) -> Column:
    """Whether the sketches leave open that two texts are near copies: by size and for small sets exactly, by Hamming distance almost surely."""
    size = lambda c: F.get(c, F.lit(0))
    rough = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(1, ROUGH_WORDS + 1)), F.lit(0))
    words = (F.slice(c, 2, len(_SEEDS)) for c in (x, y))
    bits = F.aggregate(F.zip_with(*words, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    few = F.least(size(x), size(y)) < SKETCH_FROM
    both = F.size(F.array_intersect(*[F.slice(c, len(_SEEDS) + 2, int(SKETCH_FROM * LEVEL)) for c in (x, y)]))
    small = both * SIMILARITY[1] >= (size(x) + size(y) - both) * SIMILARITY[0]
    sizes = F.least(size(x), size(y)) * SIMILARITY[1] >= F.greatest(size(x), size(y)) * SIMILARITY[0]
    return sizes & F.when(few, small).otherwise((rough <= ROUGH_BITS) & (bits <= SKETCH_BITS))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILARITY[1] >= (len(a) + len(b) - both) * SIMILARITY[0]


def _row(docs: DataFrame, id_col: str, text_col: str):
    """The row's name: ordered by id, with a hash of the text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return F.struct(F.coalesce(docs[id_col].cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(text).alias("digest"))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_node, _keys for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([blocks(shingles(x.as_py())) for x in b.column(2)], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys], names=["id", "digest", "_keys"])

    rows = docs.select(_row(docs, id_col, text_col).alias("_node"), docs[text_col].alias("_t")).select("_node.*", "_t")
    return map_arrow(rows, run, "id long, digest long, _keys array<long>").select(F.struct("id", "digest").alias("_node"), "_keys")


def _sets(rows: DataFrame) -> DataFrame:
    """_node, _own (the shingles), _sketch for rows of _node, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x.as_py()) for x in b.column(1)]
            own = pa.array([x.view(np.int64) for x in found], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), own, pa.array([sketch(x) for x in found], type=pa.list_(pa.int64()))], names=["_node", "_own", "_sketch"])

    return map_arrow(rows.select("_node", "_text"), run, "_node struct<id: bigint, digest: bigint>, _own array<bigint>, _sketch array<bigint>")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (_a, _b) that are near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column(2), b.column(3), strict=True)
            keep = [similar(x.values.to_numpy(), y.values.to_numpy()) for x, y in both]
            yield b.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    a, b = (sets.select(F.col("_node").alias(n), F.col("_own").alias(o)) for n, o in (("_a", "_x"), ("_b", "_y")))
    both = pairs.join(b.hint("merge"), "_b").join(a.hint("merge"), "_a").select("_a", "_b", "_x", "_y")
    return map_arrow(both, run, both.select("_a", "_b").schema.simpleString()[len("struct<") : -1])


def _pairs(now: DataFrame, sets: DataFrame, front: int) -> DataFrame:
    """_a < _b: rows that share a key, _a new among its first ``front``, and may be near copies; each pair at the least such key."""
    new = (F.col("_place") <= front) & ~F.col("_asked")
    behind = F.col("_place") > 1
    lists = now.groupBy("_node").agg(*[F.collect_list(x).alias(n) for n, x in (("_heads", F.when(new, F.col("_key"))), ("_keys", F.col("_key")), ("_rest", F.when(behind, F.col("_key"))))])
    own = durable(lists.join(sets.select("_node", "_sketch").hint("merge"), "_node"), "own")
    a = own.select(F.explode("_heads").alias("_k"), F.col("_node").alias("_a"), F.col("_heads").alias("_x"), F.col("_sketch").alias("_s"))
    b = own.select(F.explode("_rest").alias("_l"), F.col("_node").alias("_b"), F.col("_keys").alias("_y"), F.col("_sketch").alias("_t"))
    least = F.array_min(F.array_intersect("_x", "_y")) == F.col("_k")
    return a.join(b.hint("merge"), (F.col("_k") == F.col("_l")) & (F.col("_a") < F.col("_b")) & _may(F.col("_s"), F.col("_t")) & least).select("_a", "_b")


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (_a < _b), and rows with _a equal to _b that wait for others: _a, _b, _gone for rows that go (_a equal to _b) and pairs still open."""
    before: dict[tuple, set] = {}
    late, schema = set(), None
    for batch in batches:
        schema = batch.schema.field("_a").type
        a, b = (list(zip(*[batch.column(i).field(j).to_pylist() for j in range(2)], strict=True)) for i in range(2))
        for x, y in zip(a, b, strict=True):
            before.setdefault(x, set())
            if x == y:
                late.add(x)
            else:
                before.setdefault(y, set()).add(x)
    gone, wait, out = set(), set(), []
    for y in sorted(before):
        own = before[y] - gone
        if any(x not in wait for x in own):
            gone.add(y)
            out.append((y, y, True))
        elif own or y in late:
            wait.add(y)
            out += [(x, y, False) for x in own]
    if out:
        node = lambda i: pa.array([dict(zip(("id", "digest"), o[i], strict=True)) for o in out], type=schema)
        yield pa.RecordBatch.from_arrays([node(0), node(1), pa.array([o[2] for o in out], pa.bool_())], names=["_a", "_b", "_gone"])


def _settled(edges: DataFrame, late: DataFrame, one_task: int) -> tuple[DataFrame, DataFrame]:
    """(_node of the rows that go, the pairs still open). late: _node of rows that have not met all rows before them."""
    a, b = (edges.select(F.col(c).alias("_node")) for c in ("_a", "_b"))
    if edges.limit(one_task + 1).count() <= one_task:
        waits = a.union(b).join(late.hint("merge"), "_node", "left_semi")
        rows = edges.select("_a", "_b").union(waits.select(F.col("_node").alias("_a"), F.col("_node").alias("_b"))).repartition(1)
        found = durable(map_arrow(rows, _verdicts, "_a struct<id: bigint, digest: bigint>, _b struct<id: bigint, digest: bigint>, _gone boolean"), "verdicts")
        return found.where("_gone").select(F.col("_b").alias("_node")), found.where("NOT _gone").select("_a", "_b")
    waits = late.union(b).distinct().select(F.col("_node").alias("_a"))
    gone = durable(edges.join(waits.hint("merge"), "_a", "left_anti").select(F.col("_b").alias("_node")).distinct(), "gone")
    gone_a, gone_b = (gone.select(F.col("_node").alias(c)) for c in ("_a", "_b"))
    return gone, durable(edges.join(gone_a.hint("merge"), "_a", "left_anti").join(gone_b.hint("merge"), "_b", "left_anti").select("_a", "_b").distinct(), "open")


def _lost(met: DataFrame, sets: DataFrame, small_group: int, one_task: int = ONE_TASK) -> DataFrame:
    """_node of the rows that go, from ``met`` (_key, _node)."""
    none = sets.select("_node").limit(0)
    # Pairs that are near copies, neither of them settled.
    edges = none.select(F.col("_node").alias("_a"), F.col("_node").alias("_b"))
    lost, front, met = none, 1, met.withColumn("_asked", F.lit(False))
    while True:
        same = W.partitionBy("_key")
        ranked = met.withColumns({"_n": F.count(F.lit(1)).over(same), "_place": F.row_number().over(same.orderBy("_node"))})
        now = durable(ranked.where("_n > 1"), "now")
        if now.isEmpty():
            break
        # As a table, so that Spark may split the joins where a first row has many others.
        pairs = durable(_pairs(now, sets, front), "pairs")
        edges = durable(edges.union(_near(pairs, sets)), "edges")
        late = now.where(F.col("_place") > front).select("_node").distinct()
        gone, edges = _settled(edges, late, one_task)
        lost = lost.union(gone)
        # A row that is first in all its keys has met all others there: what is open is in ``edges``. Keys of at most ``front`` rows are done.
        waits = F.max(F.col("_place") > front).over(W.partitionBy("_node"))
        met = now.withColumn("_late", waits).where((F.col("_n") > front) & F.col("_late")).join(gone.hint("merge"), "_node", "left_anti").select("_key", "_node", (F.col("_place") <= front).alias("_asked"))
        front *= max(2, small_group)
    while not edges.isEmpty():
        gone, edges = _settled(edges, none, one_task)
        lost = lost.union(gone)
    return lost


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small_group: int = SMALL_GROUP) -> DataFrame:
    """``docs`` with all its columns, of near copies only the row with the smallest id."""
    rows = durable(_keys(docs, id_col, text_col), "blocks")
    keys = rows.select("_node", F.explode("_keys").alias("_key"))
    shared = keys.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("_key"))).where("_n > 1")
    met = durable(shared.select("_key", "_node").distinct(), "met")
    mine = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].alias("_t"), _row(docs, id_col, text_col).alias("_node"))
    some = mine.select("_node", F.col("_t").alias("_text")).join(met.select("_node").distinct().hint("merge"), "_node", "left_semi")
    sets = durable(_sets(some.groupBy("_node").agg(F.first("_text").alias("_text"))), "sets")
    lost = _lost(met, sets, small_group).withColumn("_lost", F.lit(True))
    times = rows.groupBy("_node").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    marks = durable(lost.join(times, "_node", "full").select("_node", F.coalesce("_lost", F.lit(False)).alias("_lost")), "marks")
    # ``marks`` has no bound, so it is never broadcast: the plan is the same at every size.
    marked = mine.drop("_t").join(marks.hint("merge"), "_node", "left")
    single = marked.where("_lost IS NULL").select("_row.*")
    first = marked.where("NOT _lost").groupBy("_node").agg(F.first("_row").alias("_row")).select("_row.*")
    return single.unionByName(first)
