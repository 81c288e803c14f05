"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of UTF-8 bytes. Blocks that stand at the same place of texts of the same
length are sorted into groups by their bytes, and each group gets one integer name; adjacent names are named again as
pairs until one name is left for the document. The name is the largest row (id, then the text's hash, which tells rows
apart that share an id) among those that hold the block or pair. A row holds one block at a place, so two different blocks
never share a name: identity comes from bytes and names alone, no verdict rests on a hash being free of collisions
between texts, and the id in the last name is that of the row that stays.

Scale: the text is shuffled twice, once pre-aggregated on the map side and once for the join with the repeated blocks,
which Spark may split where a block is hot. Only blocks that occur twice go on, so the higher levels see a fraction of
the documents, as integers. No group is gathered anywhere.

Defined results: null text counts as empty; a null id is the smallest id; rows that repeat both id and text give a row
each, with equal values (all of them are kept if their id is; ``drop_exact_duplicates`` keeps one); rows that share an id
but not a text stay apart; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

BLOCK_BYTES = 4096
_NULL_ID = -(2**63)
_ROW = ["_id", "_n", "_h"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, length and hash of the text (with the id, these name the row), text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_id"),
        F.octet_length(text).cast("long").alias("_n"),
        F.xxhash64(text).alias("_h"),
        text.alias("_t"),
    )


def _repeated(rows: DataFrame, by: list[str], level: int) -> DataFrame:
    """Names of what occurs more than once at a place: the largest row, and how many rows have it."""
    name = F.max(F.struct("_id", "_h"))
    named = rows.groupBy("_n", "_pos", *by).agg(name.alias("_top"), F.sum("_rows").alias("_size")).where("_size > 1")
    return durable(named.select("_n", "_pos", *by, F.col("_top._id").alias("_name"), F.col("_top._h").alias("_mark"), "_size"), f"names{level}")


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document that is not alone: _id, _n, _h, _name (the largest id of its group), _size."""
    base = _keyed(docs, id_col, text_col)
    count = F.greatest(F.lit(1), F.ceil(F.col("_n") / block_bytes)).cast("int")
    binary = F.col("_t").cast("binary")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(binary, i * block_bytes + 1, F.lit(block_bytes)))
    blocks = base.select(*_ROW, F.lit(1).cast("long").alias("_rows"), count.alias("_m"), F.posexplode(cut).alias("_pos", "_block"))
    names = _repeated(blocks.drop("_m"), ["_block"], 0)
    out = [*_ROW, "_m", "_pos", "_name", "_mark", "_size", "_rows"]
    at = durable(blocks.join(names, ["_n", "_pos", "_block"]).select(out), "level0")
    done = [at.where("_m = 1")]
    most = at.agg(F.max("_m")).first()[0] or 1
    level = 0
    while most > 1:
        level += 1
        even = F.col("_pos") % 2 == 0
        name = F.struct("_name", "_mark")
        pairs = (
            at.where("_m > 1")
            .groupBy(*_ROW, "_m", F.floor(F.col("_pos") / 2).cast("int").alias("_pos"))
            .agg(F.max(F.when(even, name)).alias("_a"), F.max(F.when(~even, name)).alias("_b"), F.sum(F.when(even, F.col("_rows"))).alias("_rows"))
            # A pair of which one half occurs once cannot be repeated; the last name of an odd row has no partner.
            .where(F.col("_a").isNotNull() & (F.col("_b").isNotNull() | (F.col("_pos") * 2 + 1 == F.col("_m"))))
            .select(*_ROW, F.ceil(F.col("_m") / 2).cast("int").alias("_m"), "_pos", "_a._name", "_a._mark", F.coalesce("_b._name", F.lit(0)).alias("_b"), F.coalesce("_b._mark", F.lit(0)).alias("_bm"), "_rows")
            .withColumnsRenamed({"_name": "_a", "_mark": "_am"})
        )
        names = _repeated(pairs.drop("_m"), ["_a", "_am", "_b", "_bm"], level)
        at = durable(pairs.join(names, ["_n", "_pos", "_a", "_am", "_b", "_bm"]).select(out), f"level{level}")
        done.append(at.where("_m = 1"))
        most = (most + 1) // 2
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.groupBy(*_ROW).agg(F.max("_name").alias("_name"), F.max("_size").alias("_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: the id column, keep_id, group_size, kept, text_sha256."""
    names = durable(name_documents(docs, id_col, text_col, block_bytes), "groups")
    rows = _keyed(docs, id_col, text_col).select(*_ROW, F.sha2(F.col("_t"), 256).alias("text_sha256"))
    keep = F.coalesce("_name", "_id")
    return rows.join(names, _ROW, "left").select(
        F.when(F.col("_id") != _NULL_ID, F.col("_id")).alias(id_col),
        F.when(keep != _NULL_ID, keep).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (keep == F.col("_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all its columns, of equal texts only the row with the largest id; of rows repeated whole, one."""
    lost = durable(name_documents(docs, id_col, text_col, block_bytes), "groups")
    text = F.coalesce(docs[text_col], F.lit(""))
    mine = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
        F.coalesce(docs[id_col].cast("long"), F.lit(_NULL_ID)).alias("_id"),
        F.octet_length(text).cast("long").alias("_n"),
        F.xxhash64(text).alias("_h"),
    )
    # Repeated rows meet in one place only if their id is in a group, so the sort below sees small groups.
    # ``lost`` has no bound, so it is never broadcast: the plan is the same at every size.
    marked = mine.join(lost.hint("merge"), _ROW, "left").where("_name IS NULL OR _name = _id")
    single = marked.where("_name IS NULL").select("_row.*")
    first = marked.where("_name IS NOT NULL").groupBy(*_ROW).agg(F.first("_row").alias("_row")).select("_row.*")
    return single.unionByName(first)
