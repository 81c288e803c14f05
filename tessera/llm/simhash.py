"""SimHash near-duplicates, found by pigeonhole blocks.

Fingerprints of 64 bits: a bit is set if it is set in over half of the XXH64 values (seed 42) of a text's word
shingles. Two fingerprints link if they differ in at most two bits. Cut into four blocks of 16 bits, linked fingerprints
share at least two whole blocks, so they meet in one of the six tables keyed by two blocks (32 bits), where the Hamming
distance is verified.

Only distinct fingerprints are joined, so exact copies cost nothing. In a key group of up to ``small_group``
fingerprints all pairs are compared. In larger groups pairs would grow with the square, so the groups are linked exactly
in linear space: two fingerprints differ in at most two bits just if the sets of what each becomes by changing at most
one bit meet; members are joined to the smallest member at each meeting point, and those links are verified as well.
(With ``max_bits=1`` a fingerprint is joined to those that it becomes by changing one bit.)
Components come from alternating large-star and small-star steps over written tables.

Defined results: null and empty texts have fingerprint 0 and link like others; fewer words than a shingle make one
shingle; a null id is smaller than any other; repeated rows give a row each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow

SHINGLE_WORDS = 3
MAX_BITS = 2
SMALL_GROUP = 32
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8", count=len(words) - k + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """_id, _fp (the fingerprint as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), k) for x in b.column(1)), dtype=np.uint64, count=b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["_id", "_fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")), run, "_id long, _fp long")


def _block(x, i: int):
    return F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _keys(fps: DataFrame) -> DataFrame:
    """_fp, _key: the six keys of two blocks each, with the number of the pair of blocks above them."""
    fp = F.col("_fp")
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = [F.lit(n << 32).cast("long").bitwiseOR(F.shiftleft(_block(fp, i), 16)).bitwiseOR(_block(fp, j)) for n, (i, j) in enumerate(pairs)]
    return fps.select("_fp", F.explode(F.array(*keys)).alias("_key"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, small_group: int = SMALL_GROUP) -> DataFrame:
    """Edges _a < _b between distinct fingerprints that connect just those that links of ``max_bits`` bits connect."""
    if not 0 <= max_bits <= 2:
        raise ValueError("four blocks serve up to two differing bits")
    keys = _keys(fps)
    sizes = keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = durable(keys.join(sizes, "_key"), "met")
    small, large = met.where(F.col("_n") <= small_group), met.where(F.col("_n") > small_group)
    near = F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))) <= max_bits
    a, b = small.select("_key", F.col("_fp").alias("_a")), small.select("_key", F.col("_fp").alias("_b"))
    pairs = a.join(b, (a["_key"] == b["_key"]) & (F.col("_a") < F.col("_b")) & near).select("_a", "_b")
    if max_bits and not large.isEmpty():  # distinct fingerprints differ in at least one bit
        pairs = pairs.union(_dense(large.select("_fp").distinct(), max_bits).where(near))
    return pairs.distinct()


def _dense(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges among fingerprints that are at most one or two bits apart, in space that grows with their number only."""
    one = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(2**63)).cast("long") for i in range(64)])
    ball = fps.select("_fp", F.explode(F.transform(one, lambda x: x.bitwiseXOR(F.col("_fp")))).alias("_at"))
    if max_bits == 1:  # one lies in the other's ball
        return ball.join(fps.select(F.col("_fp").alias("_a")), (F.col("_at") == F.col("_a")) & (F.col("_a") < F.col("_fp"))).select("_a", F.col("_fp").alias("_b")).distinct()
    least = ball.groupBy("_at").agg(F.min("_fp").alias("_a"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return ball.join(least, "_at").where("_a < _fp").select("_a", F.col("_fp").alias("_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """_node, _root (the smallest node reachable) for each node of ``edges`` (_a, _b). Written tables between steps."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select("_b", "_a")).toDF("_u", "_v")
        else:
            both = e.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v"))
        low = both.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m"))
        joined = both.join(low, "_u")
        if large:
            out = joined.where("_v > _u").select(F.col("_m").alias("_a"), F.col("_v").alias("_b"))
        else:
            out = joined.select(F.col("_m").alias("_a"), F.explode(F.array("_u", "_v")).alias("_b"))
        return out.where("_a < _b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first())

    now = durable(edges.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).where("_a < _b").distinct(), "edges")
    before = state(now)
    while before[0]:
        now = durable(star(star(now, True), False), "stars")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("_b").alias("_node"), F.col("_a").alias("_root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, small_group: int = SMALL_GROUP) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    rows = durable(fingerprints(docs, id_col, text_col, k), "fingerprints")
    least = F.min(F.struct(F.col("_id").isNotNull().alias("_has"), "_id"))
    distinct = durable(rows.groupBy("_fp").agg(least.alias("_least")), "distinct")
    roots = components(links(distinct.select("_fp"), max_bits, small_group))
    named = distinct.join(roots, distinct["_fp"] == roots["_node"], "left").select("_fp", F.coalesce("_root", "_fp").alias("_root"), "_least")
    ids = named.groupBy("_root").agg(F.min("_least").alias("_least"))
    named = named.drop("_least").join(ids, "_root").select("_fp", F.col("_least._id").alias("component_id"))
    return rows.join(named, "_fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, of each component only the row with the smallest id (all rows if ids repeat)."""
    found = near_duplicates(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    keep = durable(found.select(F.col(id_col).alias("_keep")).distinct(), "kept")
    # ``keep`` has no bound, so it is never broadcast: the plan is the same at every size.
    return docs.join(keep.hint("merge"), docs[id_col].eqNullSafe(keep["_keep"]), "left_semi")
