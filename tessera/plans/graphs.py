"""Graph operators over the driver's tables: customers cite suppliers, parts cite parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..tables import table
from .registry import query, six

_EDGES = "e AS (SELECT DISTINCT l_partkey % 400 AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey % 400 <> l_suppkey), nodes AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
_STEPS = 5


def _pagerank_sql(steps: int) -> str:
    """Each step as CTEs of its own."""
    out = f"WITH {_EDGES}, n AS (SELECT count(*)::DOUBLE AS n FROM nodes), deg AS (SELECT src, count(*) AS k FROM e GROUP BY src), r0 AS (SELECT id, 1 / n.n AS rank FROM nodes, n)"
    for i in range(1, steps + 1):
        p = f"r{i - 1}"
        out += f""", f{i} AS (SELECT e.dst AS id, sum({p}.rank / deg.k) AS flow FROM e JOIN {p} ON {p}.id = e.src JOIN deg ON deg.src = e.src GROUP BY e.dst), d{i} AS (SELECT coalesce(sum(rank), 0) AS mass FROM {p} WHERE id NOT IN (SELECT src FROM deg)),
        u{i} AS (SELECT {p}.id, 0.15 / n.n + 0.85 * mass / n.n + 0.85 * coalesce(flow, 0) AS rank FROM {p} LEFT JOIN f{i} ON f{i}.id = {p}.id, n, d{i}), r{i} AS MATERIALIZED (SELECT id, rank / (SELECT sum(rank) FROM u{i}) AS rank FROM u{i})"""
    return out + f" SELECT id, round(rank, 9) AS rank FROM r{steps}"


def _edges(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 400).alias("src"), F.col("l_suppkey").alias("dst"))


def _nodes(e):
    return e.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@query("pagerank_k5", _pagerank_sql(_STEPS))
def pagerank_k5(spark, d):
    """GRF-01, five steps."""
    e = _edges(spark, d)
    return graph.pagerank(_nodes(e), e, iterations=_STEPS).select("id", F.round("rank", 9).alias("rank"))


@query("pagerank_converged", _pagerank_sql(30).replace("round(rank, 9)", "round(rank, 6)"))
def pagerank_converged(spark, d):
    """GRF-01 until it converges (the SQL makes thirty steps)."""
    e = _edges(spark, d)
    return graph.pagerank(_nodes(e), e, tolerance=1e-9).select("id", F.round("rank", 6).alias("rank"))


@query("pagerank_without_edges", "SELECT n_nationkey AS id, CAST(NULL AS DOUBLE) AS rank FROM nation")
def pagerank_without_edges(spark, d):
    """GRF-07."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return graph.pagerank_or_null(n, n.select(F.col("id").alias("src"), F.col("id").alias("dst")))


_CITES = "c AS (SELECT vec_id AS citing, (vec_id * 7 + k) % (SELECT count(*) FROM embeddings) AS cited, k = 1 AND vec_id % 3 = 0 AS influential FROM embeddings, (SELECT unnest([1, 2, 9]) AS k))"


def _citations(spark, d):
    e = table(spark, d, "embeddings")
    n = e.count()
    e = e.select(F.col("vec_id").alias("citing"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(9))).alias("k"))
    return e.select("citing", ((F.col("citing") * 7 + F.col("k")) % n).alias("cited"), ((F.col("k") == 1) & (F.col("citing") % 3 == 0)).alias("influential"))


@query("build_edges", f"""WITH {_CITES}, scope AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), cited AS (SELECT citing, cited, bool_or(influential) AS influential FROM c WHERE citing <> cited GROUP BY 1, 2),
    direct AS (SELECT citing AS source, cited AS target, CASE WHEN influential OR list_cosine_similarity(a.v, b.v) >= 0.6 THEN 'builds_on' ELSE 'cites' END AS kind, 1.0::DOUBLE AS weight FROM cited JOIN scope a ON a.id = citing JOIN scope b ON b.id = cited),
    near AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM scope a JOIN scope b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.6 AND NOT EXISTS (SELECT 1 FROM cited WHERE (citing = a.id AND cited = b.id) OR (citing = b.id AND cited = a.id))),
    top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 3)
    SELECT source, target, kind, round(weight, 6) AS weight FROM direct UNION ALL SELECT least(a, b), greatest(a, b), 'similar', round(max(c), 6) FROM top GROUP BY least(a, b), greatest(a, b)""")
def build_edges(spark, d):
    """GRF-04, TOP-02, TOP-09."""
    scope = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    e = graph.build_edges(scope, _citations(spark, d))
    return e.select("source", "target", "kind", six("weight").alias("weight")).orderBy(*graph.edge_order())


@query("similar_edges_top3", """WITH scope AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), near AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM scope a JOIN scope b ON a.id <> b.id)
    SELECT least(a, b) AS source, greatest(a, b) AS target, round(max(c), 6) AS weight FROM (SELECT * FROM near WHERE c >= 0.2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 3) GROUP BY 1, 2""")
def similar_edges_top3(spark, d):
    """JOI-11, TOP-02."""
    from ..operators.vector_search import nearest

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = nearest(e, 0.2, 3)
    return near.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(six(F.max("cosine")).alias("weight"))


_LINKS = "links AS (SELECT l_suppkey AS seed, l_partkey AS id, l_returnflag = 'R' AND l_quantity > 49 AS influential, CAST(l_partkey % 50 AS BIGINT) AS cites FROM lineitem)"


def _links(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("seed"), F.col("l_partkey").alias("id"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("influential"), (F.col("l_partkey") % 50).alias("cites"))


@query("citation_expand_1hop", f"""WITH {_LINKS} SELECT id, count(DISTINCT seed) AS seeds, bool_or(influential) AS influential, max(cites) AS cites FROM links WHERE seed <= 15 AND id % 4 <> 0 GROUP BY id HAVING count(DISTINCT seed) >= 2 OR bool_or(influential)
    ORDER BY seeds DESC, bool_or(influential) DESC, cites DESC, id LIMIT 100""")
def citation_expand_1hop(spark, d):
    """GRF-05, TOP-04, AGG-05."""
    seeds = table(spark, d, "supplier").where("s_suppkey <= 15").select(F.col("s_suppkey").alias("id"))
    pool = table(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"))
    return graph.expand(_links(spark, d), pool, seeds, 100)


_ADMIT = "SELECT id, count(DISTINCT seed) AS seeds, bool_or(influential) AS influential, max(cites) AS cites FROM links WHERE id % 40 <> 0 AND seed IN"
_ADMITTED = "GROUP BY id HAVING count(DISTINCT seed) >= 2 OR bool_or(influential)"


@query("citation_expand_2hop", f"""WITH {_LINKS}, one AS (SELECT *, row_number() OVER (ORDER BY seeds DESC, influential DESC, cites DESC, id) AS n FROM ({_ADMIT} (SELECT s_suppkey FROM supplier WHERE s_suppkey <= 2) {_ADMITTED}) QUALIFY n <= 1000),
    two AS (SELECT *, row_number() OVER (ORDER BY seeds DESC, influential DESC, cites DESC, id) AS n FROM ({_ADMIT} (SELECT id FROM one WHERE n <= 10) AND id NOT IN (SELECT id FROM one) {_ADMITTED}))
    SELECT id, seeds, influential, cites, 1 AS hop FROM one UNION ALL SELECT id, seeds, influential, cites, 2 FROM two WHERE n <= (SELECT 1000 - count(*) FROM one)""")
def citation_expand_2hop(spark, d):
    """GRF-05, two hops: what is admitted first seeds the second."""
    seeds = table(spark, d, "supplier").where("s_suppkey <= 2").select(F.col("s_suppkey").alias("id"))
    pool = table(spark, d, "part").where("p_partkey % 40 = 0").select(F.col("p_partkey").alias("id"))
    return graph.expand_hops(_links(spark, d), pool, seeds, 1000)


@query("citations_merged", f"WITH {_CITES} SELECT citing, cited, bool_or(influential) AS influential FROM (SELECT * FROM c UNION ALL SELECT citing, cited, citing % 5 = 0 FROM c) GROUP BY 1, 2")
def citations_merged(spark, d):
    """GRF-06."""
    c = _citations(spark, d)
    return graph.merge_citations(c, c.withColumn("influential", F.col("citing") % 5 == 0))


@query("hindex_coalesce", """WITH a AS (SELECT l_orderkey AS id, 'a' || l_suppkey AS name, CAST(l_linenumber AS BIGINT) AS own FROM lineitem)
    SELECT id, max(CASE WHEN s.s_suppkey % 3 = 0 THEN s.s_suppkey WHEN s.s_suppkey % 3 = 1 THEN s.s_suppkey * 2 ELSE own END) AS max_h FROM a LEFT JOIN supplier s ON 'a' || s.s_suppkey = a.name GROUP BY id""")
def hindex_coalesce(spark, d):
    """GRF-08."""
    line = table(spark, d, "lineitem")
    p = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.concat(F.lit("a"), F.col("l_suppkey").cast("string")).alias("name"), F.col("l_linenumber").cast("long").alias("h"))).alias("authors"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").alias("k"))
    return graph.author_h_index(p, s.where("k % 3 = 0").select("name", F.col("k").alias("h")), s.where("k % 3 = 1").select("name", (F.col("k") * 2).alias("h")))


@query("relations_directional", f"WITH {_CITES} SELECT cited AS other, 'out' AS direction, 'cites' AS kind FROM c WHERE citing = 8 AND cited % 2 = 0 UNION ALL SELECT citing, 'in', 'cites' FROM c WHERE cited = 8 AND citing % 2 = 0")
def relations_directional(spark, d):
    """JOI-14, RMD-02, API-09."""
    e = _citations(spark, d).select(F.col("citing").alias("source"), F.col("cited").alias("target"), F.lit("cites").alias("kind"), F.lit(1.0).alias("weight"))
    selected = table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"))
    return graph.relations(e, 8, selected).drop("weight")


@query("neighbourhood", f"WITH {_CITES} SELECT DISTINCT unnest([citing, cited]) AS id FROM c WHERE citing = 8 OR cited = 8")
def neighbourhood(spark, d):
    """GRF-09."""
    return graph.neighbourhood(_citations(spark, d).select(F.col("citing").alias("source"), F.col("cited").alias("target")), 8)
