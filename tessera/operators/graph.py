"""Citation graphs: edges, PageRank, expansion, author metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import drop, durable
from .vector_search import similar_pairs

KINDS = ("cites", "builds_on", "similar")
DAMPING, ITERATIONS, TOLERANCE = 0.85, 50, 1e-9


def clean_edges(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node: str = "id") -> DataFrame:
    """Distinct edges between known nodes, without self-loops."""
    from .relational import semi_both_ends

    return semi_both_ends(edges.select(src, dst).where(F.col(src) != F.col(dst)).distinct(), nodes, src, dst, node)


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """id, rank (sums to 1). nodes: id; edges: src, dst (duplicates, self-loops and unknown ends are ignored).

    Each step is one join of ranks with edges that already carry their source's share, and a pre-aggregated sum. Dangling
    mass and the change since the last step are one-row aggregates. Ranks are written to the shared folder each step, so
    neither lineage nor plan grows.
    """
    ids = durable(nodes.select("id").distinct(), "nodes")
    links = clean_edges(edges, ids)
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("_deg"))
    links = durable(links.join(degree, "src").select("src", "dst", (1 / F.col("_deg")).alias("_share")), "links")
    n = ids.count()
    if n == 0:
        return ids.withColumn("rank", F.lit(0.0))
    out = links.select(F.col("src").alias("id")).distinct().withColumn("_out", F.lit(True))
    ranks = durable(ids.join(out, "id", "left").select("id", F.coalesce("_out", F.lit(False)).alias("_out"), F.lit(1 / n).alias("rank")), "rank0")
    written = ranks
    for step in range(iterations):
        dangling = ranks.where("NOT _out").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        flow = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("_share")).alias("_in"))
        base = (1 - damping) / n + damping * dangling / n
        new = ranks.join(flow, "id", "left").select("id", "_out", F.col("rank").alias("_old"), (base + damping * F.coalesce("_in", F.lit(0.0))).alias("rank"))
        new = durable(new, f"rank{step + 1}")
        total, change = new.agg(F.sum("rank"), F.sum(F.abs(F.col("rank") - F.col("_old")))).first()
        ranks = new.select("id", "_out", (F.col("rank") / total).alias("rank"))
        drop(written)
        written = new
        if change < tolerance:
            break
    return ranks.select("id", "rank")


def pagerank_or_null(nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """``pagerank``, but null for all nodes if there is no edge to rank by."""
    if clean_edges(edges, nodes).isEmpty():
        return nodes.select("id").distinct().withColumn("rank", F.lit(None).cast("double"))
    return pagerank(nodes, edges, **options)


def merge_citations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Citation edges (citing, cited, influential) of both, one for each pair, influential if any is."""
    both = old.select("citing", "cited", "influential").union(new.select("citing", "cited", "influential"))
    return both.groupBy("citing", "cited").agg(F.bool_or("influential").alias("influential"))


def build_edges(scope: DataFrame, citations: DataFrame, top_k: int = 3, similar_min: float = 0.6, builds_min: float = 0.6) -> DataFrame:
    """source, target, kind, weight among the papers of ``scope`` (id, embedding).

    A citation is builds_on if it is influential or its ends are close, else cites. similar: each paper's ``top_k`` near
    ones that no citation links, once for each pair.
    """
    from ..functions import vectors
    from .relational import semi_both_ends, top_per_group

    cited = semi_both_ends(citations.where("citing <> cited"), scope, "citing", "cited", "id")
    cited = cited.groupBy("citing", "cited").agg(F.bool_or("influential").alias("influential"))
    a = scope.select(F.col("id").alias("citing"), F.col("embedding").alias("_va"))
    b = scope.select(F.col("id").alias("cited"), F.col("embedding").alias("_vb"))
    close = F.coalesce(vectors.cosine(F.col("_va"), F.col("_vb")) >= builds_min, F.lit(False))
    kind = F.when(F.col("influential") | close, "builds_on").otherwise("cites")
    direct = cited.join(a, "citing").join(b, "cited").select(F.col("citing").alias("source"), F.col("cited").alias("target"), kind.alias("kind"), F.lit(1.0).alias("weight"))
    linked = cited.select(F.col("citing").alias("a"), F.col("cited").alias("b"))
    linked = linked.union(linked.select("b", "a")).distinct()
    near = similar_pairs(scope, similar_min).join(linked, ["a", "b"], "left_anti")
    near = top_per_group(near, top_k, ["a"], F.desc("cosine"), F.col("b"))
    similar = near.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(F.max("cosine").alias("weight"))
    return direct.unionByName(similar.select("source", "target", F.lit("similar").alias("kind"), "weight"))


def edge_order() -> list[Column]:
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return [place.asc(), F.col("source").asc(), F.col("target").asc()]


def expand(links: DataFrame, pool: DataFrame, seeds: DataFrame, cap: int, min_links: int = 2) -> DataFrame:
    """Candidates one hop from the seeds: id, seeds, influential, cites, in order of admission.

    links: seed, id, influential, cites. Admitted with enough distinct seeds or an influential link, unless in the pool.
    """
    hits = links.join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi").join(pool.select("id"), "id", "left_anti")
    found = hits.groupBy("id").agg(F.count_distinct("seed").alias("seeds"), F.bool_or("influential").alias("influential"), F.max("cites").alias("cites"))
    found = found.where((F.col("seeds") >= min_links) | F.col("influential"))
    return found.orderBy(F.desc("seeds"), F.desc("influential"), F.desc(F.coalesce("cites", F.lit(0))), "id").limit(cap)


def expand_hops(links: DataFrame, pool: DataFrame, seeds: DataFrame, cap: int, hops: int = 2, hop_seeds: int = 10, min_links: int = 2) -> DataFrame:
    """``expand`` repeated: the best admissions of a hop seed the next, until the cap is reached. Adds hop."""
    found = None
    for hop in range(1, hops + 1):
        new = durable(expand(links, pool, seeds, cap, min_links).withColumn("hop", F.lit(hop)), f"hop{hop}")
        found = new if found is None else found.unionByName(new)
        cap -= new.count()
        if cap <= 0:
            break
        pool = pool.select("id").union(new.select("id"))
        seeds = new.orderBy(F.desc("seeds"), F.desc("influential"), F.desc(F.coalesce("cites", F.lit(0))), "id").limit(hop_seeds)
    return found


def author_h_index(papers: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """id, max_h: the highest h-index of a paper's authors (primary source, else secondary, else what is stored).

    papers: id, authors array<struct<name, h>>; sources: name, h.
    """
    rows = papers.select("id", F.explode_outer("authors").alias("a")).select("id", F.col("a.name").alias("name"), F.col("a.h").alias("_own"))
    rows = rows.join(primary.groupBy("name").agg(F.max("h").alias("_p")), "name", "left").join(secondary.groupBy("name").agg(F.max("h").alias("_s")), "name", "left")
    return rows.groupBy("id").agg(F.max(F.coalesce("_p", "_s", "_own")).alias("max_h"))


def relations(edges: DataFrame, paper, selected: DataFrame) -> DataFrame:
    """other, direction (out or in), kind, weight of a paper's edges to selected papers."""
    out = edges.where(F.col("source") == paper).select(F.col("target").alias("other"), F.lit("out").alias("direction"), "kind", "weight")
    back = edges.where(F.col("target") == paper).select(F.col("source").alias("other"), F.lit("in").alias("direction"), "kind", "weight")
    return out.union(back).join(selected.select(F.col("id").alias("other")), "other", "left_semi")


def neighbourhood(edges: DataFrame, node) -> DataFrame:
    """The node and those next to it."""
    near = edges.where((F.col("source") == node) | (F.col("target") == node))
    return near.select(F.explode(F.array("source", "target")).alias("id")).distinct()
