"""Clusters of vectors, their key terms, and how they change between two runs.

k-means itself is iterative over one pool of bounded size: pools run in parallel, each in one task, seeded, so equal
inputs give equal clusters. What is read over all rows (assignment, silhouette, term scores) is native.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..tables import durable
from .relational import bounded

SEED, RESTARTS, MAX_ITERATIONS, MIN_SIZE, TOLERANCE = 42, 8, 100, 3, 0.01
#: The most clusters that are compared or assigned to, and the most rows of a pool that is clustered in one task.
MAX_CLUSTERS, MAX_POOL = 4096, 20_000
MATCH_MIN, OVERLAP_MIN, SIZE_RATIO = 0.5, 0.25, 0.3
_MASK = 0xFFFFFFFF


def mulberry32(seed: int) -> Callable[[], float]:
    """Seeded generator of floats in [0, 1): 32-bit state, the public-domain mixing constants."""
    state = seed & _MASK

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & _MASK
        x = ((state ^ (state >> 15)) * (state | 1)) & _MASK
        x ^= (x + (((x ^ (x >> 7)) * (x | 61)) & _MASK)) & _MASK
        return ((x ^ (x >> 14)) & _MASK) / 4294967296

    return draw


def fnv1a(s: str) -> int:
    """FNV-1a, 32 bits, over UTF-16 code units."""
    h = 0x811C9DC5
    raw = s.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193) & _MASK
    return h


def hash_seed(s: Column) -> Column:
    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else fnv1a(v))

    return run(s)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x, dtype=float), where=n > 0)


def _means(u: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    return _unit(np.stack([u[labels == c].sum(axis=0) for c in range(k)]))


def _lloyd(u: np.ndarray, k: int, draw: Callable[[], float], most: int) -> tuple[np.ndarray, float]:
    n = len(u)
    centres = [u[int(draw() * n)]]
    far = np.maximum(0, 1 - u @ centres[0])
    while len(centres) < k:
        mass = np.cumsum(far**2)
        at = min(n - 1, int(np.searchsorted(mass, draw() * mass[-1]))) if mass[-1] > 0 else int(draw() * n)
        centres.append(u[at])
        far = np.minimum(far, np.maximum(0, 1 - u @ u[at]))
    c, labels = np.stack(centres), np.full(n, -1)
    for _ in range(most):
        new = (u @ c.T).argmax(axis=1)
        if (new == labels).all():
            break
        labels = new
        for j in range(k):
            if (labels == j).any():
                c[j] = _unit(u[labels == j].sum(axis=0))
            else:  # an empty cluster starts anew at the point farthest from its own centre
                worst = int((1 - (u * c[labels]).sum(axis=1)).argmax())
                c[j], labels[worst] = u[worst], j
    return labels, float(np.maximum(0, 1 - (u * c[labels]).sum(axis=1)).sum())


def kmeans(x: np.ndarray, k: int, seed: int = SEED, restarts: int = RESTARTS, most: int = MAX_ITERATIONS) -> tuple[np.ndarray, float]:
    """Labels and inertia of the best of several seeded runs."""
    u = _unit(np.asarray(x, dtype=float))
    k = max(1, min(k, len(u)))
    draw, best = mulberry32(seed), None
    for _ in range(restarts):
        got = _lloyd(u, k, draw, most)
        if best is None or got[1] < best[1] - 1e-9:
            best = got
    return best


def merge_small(x: np.ndarray, labels: np.ndarray, least: int = MIN_SIZE) -> np.ndarray:
    """Clusters below ``least`` members, smallest first, go to the nearest other centres; labels become contiguous."""
    u, labels = _unit(np.asarray(x, dtype=float)), np.array(labels)
    while True:
        ids, sizes = np.unique(labels, return_counts=True)
        small = [(s, c) for s, c in zip(sizes, ids, strict=True) if s < least]
        if len(ids) <= 1 or not small:
            return np.searchsorted(ids, labels)
        gone = min(small)[1]
        others = ids[ids != gone]
        centres = _unit(np.stack([u[labels == c].sum(axis=0) for c in others]))
        labels[labels == gone] = others[(u[labels == gone] @ centres.T).argmax(axis=1)]


def silhouette_of(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by cosine distance: sums over clusters come from their vector sums, without a distance matrix."""
    u, ids = _unit(np.asarray(x, dtype=float)), np.unique(labels)
    if len(ids) < 2:
        return 0.0
    own = np.searchsorted(ids, labels)
    sizes = np.bincount(own)
    sums = np.stack([u[own == c].sum(axis=0) for c in range(len(ids))])
    total = sizes - u @ sums.T  # summed distance of each row to each cluster
    at = np.arange(len(u))
    size = sizes[own]
    a = np.divide(total[at, own], size - 1, out=np.zeros(len(u)), where=size > 1)
    mean = total / sizes
    mean[at, own] = np.inf
    b = mean.min(axis=1)
    top = np.maximum(a, b)
    s = np.divide(b - a, top, out=np.zeros(len(u)), where=(top > 0) & (size > 1))
    return float(s.mean())


def choose_k(x: np.ndarray, low: int, high: int, seed: int = SEED, least: int = MIN_SIZE) -> tuple[np.ndarray, float]:
    """Labels and silhouette for the k that scores best after small clusters are merged; the smaller k within 0.01."""
    n = len(x)
    lo, hi = max(2, low), min(high, n - 1)
    if n < low or hi < lo:
        return np.zeros(n, dtype=int), 0.0
    tried = []
    for k in range(lo, hi + 1):
        labels = merge_small(x, kmeans(x, k, seed)[0], least)
        found = labels.max() + 1
        tried.append((labels, silhouette_of(x, labels) if found >= 2 else float("-inf"), found))
    viable = [t for t in tried if t[2] >= lo] or tried
    best = max(t[1] for t in viable)
    labels, score, _ = next(t for t in viable if t[1] >= best - TOLERANCE)
    return labels, max(score, 0.0) if score == float("-inf") else score


def cluster(rows: DataFrame, low: int, high: int, keys: Sequence[str] = ("search_id",), id_col: str = "id", vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """keys, id, cluster, silhouette for each pool (the rows of one key): k chosen between ``low`` and ``high``."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{id_col} {kinds[id_col]}", "cluster int", "silhouette double"])

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > MAX_POOL:
            raise ValueError(f"a pool of {len(part)} rows; the most is {MAX_POOL}")
        part = part.sort_values(id_col)
        labels, score = choose_k(np.array(part[vec_col].tolist(), dtype=float), low, high, seed)
        out = pd.DataFrame({id_col: part[id_col], "cluster": labels, "silhouette": score})
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        return out[[*keys, id_col, "cluster", "silhouette"]]

    return rows.select(*keys, id_col, vec_col).groupBy(*keys).applyInPandas(run, schema)


def silhouette(rows: DataFrame, id_col: str = "id", cluster_col: str = "cluster", vec_col: str = "embedding") -> DataFrame:
    """id, cluster, a, b, silhouette of each row by cosine distance.

    A row's summed distance to a cluster is the cluster's size less the product with the sum of its unit vectors, so the
    work is rows times clusters, not rows squared. The sums (k rows) travel as one array.
    """
    unit = rows.select(F.col(id_col).alias("id"), F.col(cluster_col).alias("cluster"), vectors.normalize(F.col(vec_col)).alias("_u"))
    parts = unit.select("cluster", F.posexplode("_u").alias("_i", "_x")).groupBy("cluster", "_i").agg(F.sum("_x").alias("_s"), F.count(F.lit(1)).alias("_n"))
    sums = parts.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("_i", "_s"))).alias("_v"), F.max("_n").alias("_n"))
    sums = bounded(durable(sums, "sums"), MAX_CLUSTERS, "clusters")
    packed = sums.agg(F.sort_array(F.collect_list(F.struct("cluster", F.col("_v._s").alias("_s"), "_n"))).alias("_c"))
    joined = unit.join(F.broadcast(packed))  # one row of at most MAX_CLUSTERS sums
    far = F.transform("_c", lambda c: F.struct(c["cluster"].alias("cluster"), c["_n"].alias("n"), (c["_n"] - vectors.dot(F.col("_u"), c["_s"])).alias("d")))
    joined = joined.withColumn("_d", far)
    own = F.get(F.filter("_d", lambda d: d["cluster"] == F.col("cluster")), F.lit(0))
    others = F.transform(F.filter("_d", lambda d: d["cluster"] != F.col("cluster")), lambda d: F.greatest(F.lit(0.0), d["d"] / d["n"]))
    joined = joined.select("id", "cluster", own["n"].alias("_n"), F.greatest(F.lit(0.0), own["d"] / F.nullif(own["n"] - 1, F.lit(0))).alias("a"), F.array_min(others).alias("b"))
    top = F.greatest("a", "b")
    return joined.select("id", "cluster", "a", "b", F.when((F.col("_n") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0).alias("silhouette"))


def term_segments(t: Column) -> Column:
    """Arrays of neighbouring terms: a stopword, a number or a single character ends a run, so bigrams never bridge it."""
    raw = F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+(?:-[a-z0-9]+)*)"), F.lit(1))
    number = lambda w: F.length(F.translate(w, "0123456789", "")) == 0
    marked = F.transform(raw, lambda w: F.when((F.length(w) >= 2) & ~w.isin(*sorted(text.TERM_STOPWORDS)) & ~number(w), w).otherwise("|"))
    return F.transform(F.filter(F.split(F.array_join(marked, " "), r"\|"), lambda s: F.length(F.trim(s)) > 0), lambda s: F.split(F.trim(s), " "))


def terms_and_bigrams(t: Column) -> Column:
    return grams_of(term_segments(t))


def grams_of(seg: Column) -> Column:
    """Terms and bigrams of segments."""
    pairs = lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(F.flatten(seg), F.flatten(F.transform(seg, lambda s: F.when(F.size(s) > 1, pairs(s)).otherwise(F.array().cast("array<string>")))))


def class_tf_idf(docs: DataFrame, cluster_col: str = "cluster", text_col: str = "text", id_col: str = "id") -> DataFrame:
    """cluster, term, tf, df, docs, score: (tf / length of class) * ln(1 + mean length of classes / tf over all)."""
    # A document's terms are sorted in the row, so that the first of equals can count for df: all is summed on the map side.
    grams = docs.where(F.col(cluster_col) >= 0).select(F.col(cluster_col).alias("cluster"), term_segments(F.col(text_col)).alias("_s"))
    grams = grams.select("cluster", F.sort_array(grams_of(F.col("_s"))).alias("_t"))
    first = lambda t, i: (i == 0) | (t != F.get(F.col("_t"), i - 1))
    each = grams.select("cluster", F.explode(F.transform("_t", lambda t, i: F.struct(t.alias("term"), first(t, i).cast("int").alias("df")))).alias("_g")).select("cluster", "_g.*")
    by_term = durable(each.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("tf"), F.sum("df").alias("df")), "terms")
    lengths = by_term.groupBy("cluster").agg(F.sum("tf").alias("_len"))
    counts = docs.where(F.col(cluster_col) >= 0).groupBy(F.col(cluster_col).alias("cluster")).agg(F.count(F.lit(1)).alias("docs"))
    mean = lengths.agg(F.avg("_len").alias("_mean"))
    # A term has at most one row for each cluster, so these meet in the row that holds their sum.
    overall = by_term.groupBy("term").agg(F.sum("tf").alias("_all"), F.collect_list(F.struct("cluster", "tf", "df")).alias("_c"))
    out = overall.select("term", "_all", F.inline("_c")).join(lengths, "cluster").join(counts, "cluster").join(F.broadcast(mean))  # one row
    return out.select("cluster", "term", "tf", "df", "docs", ((F.col("tf") / F.col("_len")) * F.log(1 + F.col("_mean") / F.col("_all"))).alias("score"))


def pick_terms(ranked: Sequence[str], top: int = 8) -> list[str]:
    """The first terms, of which none is a word of a bigram that was taken before or comes to be taken."""
    taken: list[str] = []
    covered: set[str] = set()
    for term in ranked:
        if len(taken) >= top:
            break
        words = term.split(" ")
        if len(words) == 1 and term in covered:
            continue
        if len(words) == 2:
            covered.update(words)
            taken = [t for t in taken if t not in words]
        taken.append(term)
    return taken


def key_terms(scores: DataFrame, top: int = 8) -> DataFrame:
    """cluster, terms (best first): terms of two documents or more go before others."""
    often = (F.col("df") >= F.least(F.lit(2), F.col("docs"))).cast("int")
    order = W.partitionBy("cluster").orderBy(often.desc(), F.desc("score"), "term")
    # Each taken bigram hides at most two words, and each slot is taken once: so many candidates always suffice.
    bounded = scores.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= 40 * top)
    ranked = bounded.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("_rn", "term"))).alias("_t")).select("cluster", F.col("_t.term").alias("_terms"))

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda terms: pick_terms(list(terms), top))

    return ranked.select("cluster", run("_terms").alias("terms"))


def placeholder_label(terms: Sequence[str]) -> str:
    """First two terms that share no word, capitalised."""
    chosen: list[str] = []
    for t in terms:
        if not {w for c in chosen for w in c.split(" ")} & set(t.split(" ")):
            chosen.append(t)
        if len(chosen) == 2:
            break
    label = " / ".join(chosen)
    return label[:1].upper() + label[1:] if label else "Untitled cluster"


def label_column(terms: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: placeholder_label([] if t is None else list(t)))

    return run(terms)


def relabel(rows: DataFrame, cluster_col: str = "cluster", rank_col: str = "final_rank") -> DataFrame:
    """Old cluster number to new: by size, then by the best member's rank."""
    sizes = rows.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"), F.min(rank_col).alias("best_rank"))
    new = F.row_number().over(W.orderBy(F.desc("size"), F.col("best_rank").asc_nulls_last(), cluster_col)) - 1
    return sizes.select(F.col(cluster_col).alias("old_cluster"), new.alias("new_cluster"), "size", "best_rank")


def members_of(clusters: DataFrame) -> DataFrame:
    """cluster, member of clusters that carry their members as an array."""
    return clusters.select("cluster", F.explode("members").alias("member"))


def cluster_pairs(base: DataFrame, current: DataFrame, base_members: DataFrame | None = None, current_members: DataFrame | None = None) -> DataFrame:
    """cur, bas, cosine, jaccard, score of clusters of two runs.

    Clusters: cluster, centroid; members: cluster, member (or an array ``members`` of the clusters). Overlaps are counted by
    a join on the member. Pairs are made of at most ``MAX_CLUSTERS`` clusters on each side.
    """
    bm = (members_of(base) if base_members is None else base_members).select(F.col("cluster").alias("bas"), "member").distinct()
    cm = (members_of(current) if current_members is None else current_members).select(F.col("cluster").alias("cur"), "member").distinct()
    both = cm.join(bm, "member").groupBy("cur", "bas").agg(F.count(F.lit(1)).alias("_both"))
    c = bounded(current, MAX_CLUSTERS, "clusters").select(F.col("cluster").alias("cur"), F.col("centroid").alias("_cc")).join(cm.groupBy("cur").agg(F.count(F.lit(1)).alias("_cn")), "cur", "left")
    b = bounded(base, MAX_CLUSTERS, "clusters").select(F.col("cluster").alias("bas"), F.col("centroid").alias("_bc")).join(bm.groupBy("bas").agg(F.count(F.lit(1)).alias("_bn")), "bas", "left")
    pairs = c.join(b).join(both, ["cur", "bas"], "left")
    shared = F.coalesce("_both", F.lit(0))
    union = F.coalesce("_cn", F.lit(0)) + F.coalesce("_bn", F.lit(0)) - shared
    jaccard = F.when(union > 0, shared / union).otherwise(0.0)
    pairs = pairs.select("cur", "bas", vectors.cosine(F.col("_cc"), F.col("_bc")).alias("cosine"), jaccard.alias("jaccard"))
    return pairs.withColumn("score", 0.5 * F.col("cosine") + 0.5 * F.col("jaccard"))


def match(pairs: pd.DataFrame, before: dict, after: dict) -> list[dict]:
    """Changes of clusters from their pair table; ``before`` and ``after`` give sizes by cluster."""
    p = pairs.sort_values(["score", "cur", "bas"], ascending=[False, True, True])
    matched: dict = {}
    for c, b, s in p[["cur", "bas", "score"]].itertuples(index=False):
        if s >= MATCH_MIN and c not in matched and b not in matched.values():
            matched[c] = b
    near = p[p["jaccard"] >= OVERLAP_MIN].sort_values(["cur", "bas"])
    jac = {(c, b): j for c, b, j in near[["cur", "bas", "jaccard"]].itertuples(index=False)}
    of_cur = {c: [b for x, b in jac if x == c] for c in after}
    of_base = {b: [c for c, x in jac if x == b] for b in before}
    out, used = [], set()
    for c in sorted(after):
        own, over = matched.get(c), of_cur[c]
        source = own if own is not None and len(of_base[own]) >= 2 else next((b for b in over if len(of_base[b]) >= 2), None)
        if len(over) >= 2:
            change, bases = "merged", over
            primary = max(over, key=lambda b: (jac[c, b], -over.index(b)))
        elif source is not None:
            change, bases, primary = "split", [source], source
        elif own is not None:
            ratio = SIZE_RATIO
            change = "grew" if after[c] >= before[own] * (1 + ratio) else "shrank" if after[c] <= before[own] * (1 - ratio) else "stable"
            bases, primary = [own], own
        else:
            change, bases, primary = "new", [], None
        size_before = sum(before[b] for b in bases)
        if own is not None:
            primary, bases = own, [own, *[b for b in bases if b != own]]
        used.update(bases)
        out.append({"cluster": c, "base_cluster": primary, "change": change, "base_clusters": bases, "size_before": size_before, "size_after": after[c]})
    gone = [{"cluster": None, "base_cluster": None, "change": "gone", "base_clusters": [b], "size_before": before[b], "size_after": 0} for b in sorted(before) if b not in used]
    return out + gone


def match_clusters(base: DataFrame, current: DataFrame, base_members: DataFrame | None = None, current_members: DataFrame | None = None) -> DataFrame:
    """cluster, base_cluster, change, base_clusters, size_before, size_after. One task: a row for each pair of clusters."""

    def sized(side: str, clusters: DataFrame, members: DataFrame | None) -> DataFrame:
        n = (members_of(clusters) if members is None else members).groupBy("cluster").agg(F.count(F.lit(1)).cast("int").alias("n"))
        return clusters.select("cluster").join(n, "cluster", "left").select(F.lit(side).alias("side"), "cluster", F.coalesce("n", F.lit(0)).alias("n"))

    sizes = sized("b", base, base_members).union(sized("c", current, current_members))
    sizes = sizes.select(F.col("side"), F.col("cluster").cast("int").alias("cur"), F.lit(None).cast("int").alias("bas"), F.lit(None).cast("double").alias("jaccard"), F.col("n").cast("double").alias("score"))
    pairs = cluster_pairs(base, current, base_members, current_members).select(F.lit("p").alias("side"), F.col("cur").cast("int"), F.col("bas").cast("int"), "jaccard", "score")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        size = lambda s: {int(r.cur): int(r.score) for r in part[part["side"] == s].itertuples()}
        found = pd.DataFrame(match(part[part["side"] == "p"].astype({"bas": "Int64"}), size("b"), size("c")))
        return found.astype({"cluster": "Int64", "base_cluster": "Int64"})

    return pairs.union(sizes).groupBy(F.lit("all")).applyInPandas(run, "cluster int, base_cluster int, change string, base_clusters array<int>, size_before int, size_after int")
