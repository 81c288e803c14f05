"""Similarity over vectors: one against all, thresholds among many, centroids, assignment.

Pairs among many vectors are made block by block in numpy: a block of queries (bounded rows) is shipped to each
partition of the other side, and only pairs that pass the threshold or the running top k leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from .relational import bounded

BLOCK_ROWS = 4096
MAX_REFS = 4096  # reference vectors or centroids that travel to each task


def related(rows: DataFrame, query: Column, k: int = 5, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """id, similarity (3 decimals) of the ``k`` rows nearest to a literal query vector; ties by id."""
    score = F.round(vectors.cosine(F.col(vec_col), query), 3)
    return rows.select(id_col, score.alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def max_cosine(rows: DataFrame, refs: DataFrame, id_col: str = "id", vec_col: str = "embedding", ref_col: str = "embedding") -> DataFrame:
    """id, best cosine to a small set of reference vectors (a topic and its queries); without any, 0.

    The references (at most ``MAX_REFS``) become one array, so each row is compared in place.
    """
    packed = bounded(refs, MAX_REFS, "reference vectors").agg(F.collect_list(ref_col).alias("_refs"))
    joined = rows.join(F.broadcast(packed))  # one row
    best = F.array_max(F.transform("_refs", lambda r: vectors.cosine(F.col(vec_col), r)))
    return joined.select(id_col, F.coalesce(best, F.lit(0.0)).alias("cosine"))


def similar_pairs(rows: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, queries: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """a, b, cosine of the ordered pairs a <> b at or above the threshold; a is of ``queries`` (all rows without them).

    Rows and queries are dealt by hash into blocks of about ``block_rows``. Each block of queries meets each block of rows
    once in one task (as two sides of a cogroup), so a task holds two blocks whatever the number of rows. With ``top`` a
    task gives each query's ``top`` best rows of its block only, with all that tie with the last. The search is exact; its
    work is rows times queries.
    """
    kind = dict(rows.dtypes)[id_col]

    def dealt(df: DataFrame) -> tuple[DataFrame, int]:
        base = df.where(F.size(vec_col) > 0).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
        n = max(1, -(-base.count() // block_rows))
        return base.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n

    base, n = dealt(rows)
    asked, m = (base, n) if queries is None else dealt(queries)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.withColumn("_o", every(n)).select(F.col("_b").alias("i"), F.col("_o").alias("j"), "id", "v")
    right = base.withColumn("_o", every(m)).select(F.col("_o").alias("i"), F.col("_b").alias("j"), F.col("id").alias("other"), F.col("v").alias("w"))

    def unit(part: pd.Series) -> np.ndarray:
        m = np.array(part.tolist(), dtype=float)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "cosine": pd.Series(dtype=float)})
        if a.empty or b.empty:
            return empty
        x, y = unit(a["v"]), unit(b["w"])
        out = []
        ia, ib = a["id"].to_numpy(), b["other"].to_numpy()
        for at in range(0, len(x), 512):
            c = x[at : at + 512] @ y.T
            c[ia[at : at + 512, None] == ib[None, :]] = -9
            least = np.full(len(c), threshold)
            if top and c.shape[1] > top:
                least = np.maximum(least, np.partition(c, -top, axis=1)[:, -top])
            p, q = np.nonzero((c >= least[:, None]) & (c > -9))
            out.append(pd.DataFrame({"a": ia[at + p], "b": ib[q], "cosine": c[p, q]}))
        return pd.concat(out) if out else empty

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, f"a {kind}, b {kind}, cosine double")


def nearest(rows: DataFrame, threshold: float, k: int, id_col: str = "id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, queries: DataFrame | None = None) -> DataFrame:
    """a, b, cosine of the ``k`` rows nearest to each of ``queries`` (all rows without them) at or above the threshold; ties by id."""
    from .relational import top_per_group

    return top_per_group(similar_pairs(rows, threshold, id_col, vec_col, block_rows, queries, k), k, ["a"], F.desc("cosine"), F.col("b"))


def centroids(rows: DataFrame, cluster_col: str = "cluster", vec_col: str = "embedding") -> DataFrame:
    """cluster, centroid (unit mean of unit vectors), size. Sums by coordinate, pre-aggregated on the map side."""
    unit = rows.select(F.col(cluster_col).alias("cluster"), vectors.normalize(F.col(vec_col)).alias("_u"))
    dim = F.posexplode("_u").alias("_i", "_x")
    sums = unit.select("cluster", dim).groupBy("cluster", "_i").agg(F.sum("_x").alias("_s"), F.count(F.lit(1)).alias("_n"))
    packed = sums.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("_i", "_s"))).alias("_v"), F.max("_n").alias("size"))
    return packed.select("cluster", vectors.normalize(F.col("_v._s")).alias("centroid"), "size")


def assign(rows: DataFrame, centroid_rows: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """id, cluster, similarity of the nearest centroid (lowest cluster on ties).

    At most ``MAX_REFS`` centroids travel to the tasks as one matrix; batches of rows are multiplied with it.
    """
    found = centroid_rows.select("cluster", "centroid").limit(MAX_REFS + 1).collect()
    if len(found) > MAX_REFS:
        raise ValueError(f"more than {MAX_REFS} centroids")
    found.sort(key=lambda r: r["cluster"])
    numbers, matrix = [r["cluster"] for r in found], np.array([r["centroid"] for r in found], dtype=float)
    kinds, of = dict(rows.dtypes), dict(centroid_rows.dtypes)["cluster"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.array(part["v"].tolist(), dtype=float).reshape(len(part), -1)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            s = np.divide(x, size, out=np.zeros_like(x), where=size > 0) @ matrix.T
            best = s.argmax(axis=1)
            yield pd.DataFrame({id_col: part["id"], "cluster": [numbers[i] for i in best], "similarity": s[np.arange(len(s)), best]})

    given = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return given.mapInPandas(run, f"`{id_col}` {kinds[id_col]}, cluster {of}, similarity double")


def cosine_matrix_blocks(rows: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """a, b, distance for all ordered pairs: for inspection of small sets only; use ``silhouette`` for the sums."""
    pairs = similar_pairs(rows, -1.1, id_col, vec_col)
    return pairs.select("a", "b", F.greatest(F.lit(0.0), 1 - F.col("cosine")).alias("distance"))


def embed_missing(rows: DataFrame, embedder, text_col: str = "text", vec_col: str = "embedding", limit_chars: int = 2000) -> DataFrame:
    """``rows`` with vectors for those that lack one. ``embedder(list of texts)`` gives a list of vectors; it runs in batches."""
    flat = F.substring(F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"\s+", " ")), 1, limit_chars)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(embedder(s.tolist()))

    todo = rows.where(F.col(vec_col).isNull()).withColumn(vec_col, run(flat))
    return rows.where(F.col(vec_col).isNotNull()).unionByName(todo)
