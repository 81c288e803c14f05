"""Retrieval and ranking over the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import ranking, vector_search
from ..operators.relational import percentile_rank
from ..tables import table
from .registry import NOW, PAPERS_SQL, VELOCITY_SQL, docs, now, papers, query, six
from .words import DOC_FIELDS, DOCS, tokens_sql

QUERY, EXCLUDE = "ing ble ention queaux", "ersthe des"


def bm25_sql(wanted: list[str], out: list[str]) -> str:
    """CTEs that end in ``scored`` (id, score): BM25F with the title counting twice, excluded terms subtracted."""
    names = ", ".join(f"('{t}', {1 if t in wanted else -1})" for t in [*wanted, *out])
    return f"""{DOCS}, {tokens_sql(DOC_FIELDS)}, q(term, sign) AS (VALUES {names}), len AS (SELECT id, f, count(*) AS len FROM tok GROUP BY id, f),
    avgs AS (SELECT f, count(*) / (SELECT count(*) FROM docs) AS mean FROM tok GROUP BY f), dfs AS (SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY term),
    tfs AS (SELECT tok.id, tok.f, tok.term, sign, count(*) AS tf FROM tok JOIN q ON q.term = tok.term GROUP BY ALL),
    pseudo AS (SELECT tfs.id, tfs.term, sign, sum(CASE WHEN tfs.f = 'title' THEN 2.0 ELSE 1.0 END * tf / (0.25 + 0.75 * len / mean)) AS tfp FROM tfs JOIN len ON len.id = tfs.id AND len.f = tfs.f JOIN avgs ON avgs.f = tfs.f GROUP BY ALL),
    scored AS (SELECT docs.id, coalesce(sum(sign * ln(1 + ((SELECT count(*) FROM docs) - df + 0.5) / (df + 0.5)) * tfp / (1.2 + tfp)), 0) AS score FROM docs LEFT JOIN pseudo ON pseudo.id = docs.id LEFT JOIN dfs ON dfs.term = pseudo.term GROUP BY docs.id)"""


_Q, _X = QUERY.split(), EXCLUDE.split()  # no stopword among them, none that stems


@query("bm25f_top", f"WITH {bm25_sql(_Q, [])} SELECT id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, id LIMIT 20")
def bm25f_top(spark, d):
    """RNK-01, MTH-03: the flagship."""
    return ranking.bm25f(docs(spark, d), QUERY).select("id", six("score").alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("bm25f_exclude", f"WITH {bm25_sql(_Q, _X)} SELECT id, round(score, 6) AS score FROM scored")
def bm25f_exclude(spark, d):
    """RNK-01 with excluded terms: every document, scores may be negative."""
    return ranking.bm25f(docs(spark, d), QUERY, EXCLUDE).select("id", six("score").alias("score"))


_RRF = """lists AS (SELECT 0 AS l, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos, p_partkey AS id FROM part UNION ALL SELECT 1, row_number() OVER (ORDER BY p_size, p_partkey), p_partkey FROM part WHERE p_size > 20
    UNION ALL SELECT 2, row_number() OVER (ORDER BY p_name, p_partkey), p_partkey FROM part WHERE p_partkey % 2 = 0)"""


@query("rrf_fuse", f"WITH {_RRF} SELECT id, round(sum(1.0 / (60 + pos)), 9) AS score, min(l) AS first_list FROM lists GROUP BY id")
def rrf_fuse(spark, d):
    """WIN-02, RNK-02."""
    p = table(spark, d, "part")
    lists = ranking.ranking_of(p, 0, "p_partkey", F.desc("p_retailprice"), F.col("p_partkey"))
    lists = lists.union(ranking.ranking_of(p.where("p_size > 20"), 1, "p_partkey", F.col("p_size"), F.col("p_partkey")))
    lists = lists.union(ranking.ranking_of(p.where("p_partkey % 2 = 0"), 2, "p_partkey", F.col("p_name"), F.col("p_partkey")))
    return ranking.rrf(lists).select("id", F.round("score", 9).alias("score"), "first_list")


_COS0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@query("prerank", f"""WITH {bm25_sql(_Q, [])}, cosines AS (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_COS0} AS DOUBLE[])), 9) AS c FROM embeddings JOIN docs ON docs.id = vec_id),
    lists AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, id) AS pos, id FROM scored UNION ALL SELECT row_number() OVER (ORDER BY c DESC, id), id FROM cosines UNION ALL SELECT row_number() OVER (ORDER BY id % 7, id % 5 DESC, id), id FROM docs)
    SELECT id, round(sum(1.0 / (60 + pos)), 9) AS score FROM lists GROUP BY id""")
def prerank(spark, d):
    """RNK-03."""
    t = docs(spark, d)
    e = table(spark, d, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("_q"))
    cosine = e.join(F.broadcast(first)).select(F.col("vec_id").alias("id"), F.round(vectors.cosine(F.col("embedding"), F.col("_q")), 9).alias("cosine")).join(t.select("id"), "id", "left_semi")
    sources = t.select("id", (F.col("id") % 7).alias("rank"), (F.col("id") % 5).alias("hits"))
    bm25 = ranking.bm25f(t, QUERY).withColumn("score", F.round("score", 9))
    return ranking.prerank(bm25, cosine, sources).select("id", F.round("score", 9).alias("score"))


@query("related_top5", f"SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_COS0} AS DOUBLE[])), 3) AS similarity FROM embeddings WHERE vec_id <> 0 ORDER BY 2 DESC, 1 LIMIT 5")
def related_top5(spark, d):
    """TOP-03, JOI-12, RNK-10, API-03."""
    e = table(spark, d, "embeddings")
    v = e.where("vec_id = 0").first()["embedding"]
    rows = e.where("vec_id <> 0").select(F.col("vec_id").alias("id"), "embedding")
    return vector_search.related(rows, F.array(*[F.lit(float(x)) for x in v]))


@query("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.5")
def cosine_pairs(spark, d):
    """VEC-01, VEC-02, JOI-11: all pairs at 0.5 or more; blocks in numpy."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector_search.similar_pairs(e, 0.5).select("a", "b", F.round("cosine", 5).alias("cosine"))


@query("nearest_top3", """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT a, b, round(c, 5) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 3""")
def nearest_top3(spark, d):
    """TOP-02: a stated set of queries (every fiftieth row) against all rows."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = vector_search.nearest(e, -1.1, 3, queries=e.where("id % 50 = 0"))
    return near.select("a", "b", F.round("cosine", 5).alias("cosine"))


@query("max_cosine_refs", "SELECT e.vec_id AS id, round(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id < 5 GROUP BY e.vec_id")
def max_cosine_refs(spark, d):
    """VEC-03."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector_search.max_cosine(e, e.where("id < 5")).select("id", six("cosine").alias("cosine"))


_PRIOR = f"""{PAPERS_SQL}, v AS (SELECT *, CASE WHEN cites IS NOT NULL THEN ln(1 + greatest(0, cites)) END AS lc, {VELOCITY_SQL} AS vel FROM papers),
    r AS (SELECT *, CASE WHEN lc IS NULL THEN 0 ELSE (rank() OVER (ORDER BY lc NULLS LAST) - 1 + (count(*) OVER (PARTITION BY lc) - 1) / 2.0) / (count(lc) OVER () - 1) END AS pc,
        CASE WHEN vel IS NULL THEN 0 ELSE (rank() OVER (ORDER BY vel NULLS LAST) - 1 + (count(*) OVER (PARTITION BY vel) - 1) / 2.0) / (count(vel) OVER () - 1) END AS pv FROM v)"""


@query("influence_prior", f"WITH {_PRIOR} SELECT id, round(CASE WHEN cites IS NOT NULL THEN 0.65 * pc + 0.35 * pv END, 6) AS prior FROM r")
def influence_prior(spark, d):
    """RNK-05."""
    return ranking.influence_prior(papers(spark, d), now()).select("id", six("prior").alias("prior"))


@query("selection_score", f"WITH {_PRIOR} SELECT id, round(0.7 * (id % 100) / 99.0 + 0.3 * coalesce(CASE WHEN cites IS NOT NULL THEN 0.65 * pc + 0.35 * pv END, 0), 6) AS score FROM r")
def selection_score(spark, d):
    """RNK-06."""
    p = ranking.influence_prior(papers(spark, d), now())
    return p.select("id", six(ranking.selection_score((F.col("id") % 100) / 99.0, F.col("prior"))).alias("score"))


_PCT = lambda c: f"CASE WHEN {c} IS NULL THEN 0 ELSE (rank() OVER (ORDER BY {c} NULLS LAST) - 1 + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / (count({c}) OVER () - 1) END"


@query("influence", f"""WITH {PAPERS_SQL}, v AS (SELECT *, CASE WHEN cites IS NOT NULL THEN ln(1 + greatest(0, cites)) END AS lc, {VELOCITY_SQL} AS vel FROM papers),
    r AS (SELECT id, {_PCT('lc')} AS a, {_PCT('vel')} AS b, {_PCT('influential')} AS c, {_PCT('h_index')} AS e FROM v) SELECT id, round(greatest(0, least(1, (0.3 * a + 0.25 * b + 0.15 * c + 0.1 * e) / 0.8)), 6) AS influence FROM r""")
def influence(spark, d):
    """GRF-02: the PageRank signal is null for all rows and drops out."""
    from ..functions.numbers import velocity

    p = papers(spark, d).withColumn("velocity", velocity(F.col("cites"), F.col("published_at"), now())).withColumn("pagerank", F.lit(None).cast("double"))
    return ranking.influence(p).select("id", six("influence").alias("influence"))


@query("game_changers", f"""WITH {PAPERS_SQL}, v AS (SELECT *, CASE WHEN cites IS NOT NULL THEN ln(1 + greatest(0, cites)) END AS lc, {VELOCITY_SQL} AS vel FROM papers),
    r AS (SELECT id, coalesce(cites, 0) AS c, {_PCT('lc')} AS a, {_PCT('vel')} AS b FROM v) SELECT id, round(0.5 * a + 0.5 * b, 6) AS score FROM r WHERE c >= (SELECT median(c) FROM r) ORDER BY 0.5 * a + 0.5 * b DESC, id LIMIT 8""")
def game_changers(spark, d):
    """TOP-05, GRF-03, GRF-07: without PageRank, log citations stand in."""
    from ..functions.numbers import velocity

    p = papers(spark, d).withColumn("velocity", velocity(F.col("cites"), F.col("published_at"), now())).withColumn("pagerank", F.lit(None).cast("double"))
    return ranking.game_changers(p).select("id", six("score").alias("score"))


@query("canonical_gate", r"""WITH c AS (SELECT doc_id AS id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}]+', ' ', 'g')) AS k, n_chars AS cites, (doc_id % 100) / 100 AS cosine FROM documents),
    b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cites DESC, id) AS n FROM c WHERE cosine >= 0.5) SELECT id, cites FROM b WHERE n = 1 ORDER BY cites DESC, id LIMIT 40""")
def canonical_gate(spark, d):
    """RNK-08, WIN-06."""
    t = table(spark, d, "documents")
    c = t.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("n_chars").alias("cites"), ((F.col("doc_id") % 100) / 100).alias("cosine"), F.col("doc_id").alias("pos"))
    return ranking.canonical_gate(c).select("id", "cites")


@query("topic_similarity", """WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 1), s AS (SELECT vec_id AS id, CASE WHEN vec_id % 97 = 3 THEN 'retrieval augmented generation' ELSE 'topic ' || vec_id END AS name, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS c FROM embeddings e, q WHERE vec_id <> 1)
    SELECT id, name, round(greatest(0, least(1, CASE WHEN vec_id_m THEN greatest(c, 0.8) ELSE c END)), 6) AS similarity FROM (SELECT *, id % 97 = 3 AS vec_id_m FROM s) WHERE c >= 0.8 OR vec_id_m ORDER BY similarity DESC, name, id LIMIT 5""")
def topic_similarity(spark, d):
    """RNK-09, API-05: cosine with a floor for acronyms."""
    from ..functions import ids

    e = table(spark, d, "embeddings")
    v = e.where("vec_id = 1").first()["embedding"]
    name = F.when(F.col("vec_id") % 97 == 3, "retrieval augmented generation").otherwise(F.concat(F.lit("topic "), F.col("vec_id").cast("string")))
    s = e.where("vec_id <> 1").select(F.col("vec_id").alias("id"), name.alias("name"), vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in v])).alias("_c"))
    score = F.when(ids.acronym_match(F.lit("RAG"), F.col("name")), F.greatest("_c", F.lit(0.8))).otherwise(F.col("_c"))
    return s.select("id", "name", six(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("similarity")).where(score >= 0.8).orderBy(F.desc("similarity"), "name", "id").limit(5)


@query("rerank_fallback", f"SELECT vec_id AS id, round(CASE WHEN vec_id < 150 THEN 1 / (1 + exp(-(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_COS0} AS DOUBLE[])) - 0.45) / 0.08)) END, 6) AS rerank FROM embeddings")
def rerank_fallback(spark, d):
    """RNK-04 without a model: calibrated cosine for the top of the pool."""
    e = table(spark, d, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("_q"))
    pool = e.join(F.broadcast(first)).select(F.col("vec_id").alias("id"), F.lit("").alias("text"), (-F.col("vec_id")).cast("double").alias("rrf"), vectors.cosine(F.col("embedding"), F.col("_q")).alias("cosine"))
    pool = pool.withColumn("rrf", F.col("rrf") + 1e9)
    return ranking.rerank(pool, None, "", 150).select("id", six("rerank").alias("rerank"))


@query("rerank_reuse", "SELECT vec_id AS id, round(CASE WHEN vec_id < 150 THEN CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE 1 / (1 + exp(-((vec_id % 10) - 5) / 2.0)) END END, 6) AS rerank FROM embeddings")
def rerank_reuse(spark, d):
    """RNK-04 with a scorer: scores of an earlier run are kept where the query's hash is equal."""
    @F.pandas_udf("double")
    def scorer(q: pd.Series, t: pd.Series) -> pd.Series:
        return t.astype(float)

    e = table(spark, d, "embeddings")
    pool = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 10).cast("string").alias("text"), (1e9 - F.col("vec_id")).alias("rrf"), F.lit(0.0).alias("cosine"))
    base = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.lit("h").alias("query_hash"), F.lit(0.5).alias("rerank"))
    return ranking.rerank(pool, scorer, "q", 150, base, "h").select("id", six("rerank").alias("rerank"))


@query("select_papers_mmr")
def select_papers_mmr(spark, d):
    """RNK-07: greedy selection with reserves; a search has at most 300 candidates."""
    p = papers(spark, d).where("published_at IS NOT NULL")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = p.join(e, "id", "left").select(F.floor(F.col("id") / 300).alias("search_id"), "id", F.when(F.col("id") % 3 != 0, (F.col("id") % 89) / 89.0).alias("rerank"), (1.0 / (60 + F.col("id"))).alias("rrf"), "cites", "published_at", "embedding", "title", F.col("id").alias("pos"))
    out = ranking.select_papers(rows, NOW, 40, 8, 6)
    return out.select("search_id", "id", "selected", "final_rank", "reason", six("score").alias("score"))


@query("selection_without_reserves", """WITH r AS (SELECT p_partkey AS id, p_size % 5 AS search_id, (p_partkey % 997) / 997.0 AS rel FROM part) SELECT search_id, id, row_number() OVER (PARTITION BY search_id ORDER BY 0.7 * rel DESC, rel DESC, id) AS final_rank FROM r QUALIFY final_rank <= 10""")
def selection_without_reserves(spark, d):
    """RNK-07 where it is a plain top k: no reserves, no vectors, no titles, unknown citations."""
    p = table(spark, d, "part")
    rows = p.select((F.col("p_size") % 5).alias("search_id"), F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 997) / 997.0).alias("rerank"), F.lit(0.0).alias("rrf"), F.lit(None).cast("long").alias("cites"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("array<float>").alias("embedding"), F.lit("").alias("title"), F.col("p_partkey").alias("pos"))
    return ranking.select_papers(rows, NOW, 10, 0, 0).where("selected").select("search_id", "id", F.col("final_rank").cast("long").alias("final_rank"))


@query("signal_percentiles", f"WITH {PAPERS_SQL} SELECT id, round({_PCT('influential')}, 6) AS pct FROM papers")
def signal_percentiles(spark, d):
    """WIN-01 over a signal with nulls."""
    return percentile_rank(papers(spark, d).select("id", "influential"), "influential", "pct").select("id", six("pct").alias("pct"))
