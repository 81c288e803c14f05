"""Clusters, key terms and changes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, clustering, vector_search
from ..tables import table
from .registry import NOW, now, query, six
from .words import _TERM_STOP

_UNIT = "u AS (SELECT vec_id AS id, label AS cluster, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"
_CENT = f"""{_UNIT}, x AS (SELECT cluster, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM u), s AS (SELECT cluster, i, sum(x) AS x FROM x GROUP BY 1, 2), l AS (SELECT cluster, list(x ORDER BY i) AS s FROM s GROUP BY 1),
    cent AS (SELECT cluster, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS c, s FROM l)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), "embedding")


@query("centroids", f"WITH {_CENT} SELECT cluster, generate_subscripts(c, 1) AS i, round(unnest(c), 6) AS x FROM cent")
def centroids(spark, d):
    """AGG-10."""
    c = vector_search.centroids(_vectors(spark, d))
    return c.select("cluster", F.posexplode("centroid").alias("_i", "_x")).select("cluster", (F.col("_i") + 1).cast("long").alias("i"), six("_x").alias("x"))


@query("assign_nearest", f"WITH {_CENT} SELECT id, arg_max(cent.cluster, (round(list_dot_product(v, c), 9), -cent.cluster)) AS cluster, round(max(list_dot_product(v, c)), 6) AS similarity FROM u, cent GROUP BY id")
def assign_nearest(spark, d):
    """CLU-02."""
    v = _vectors(spark, d)
    return vector_search.assign(v, vector_search.centroids(v)).select("id", "cluster", six("similarity").alias("similarity"))


@query("inertia", f"WITH {_CENT} SELECT round(sum(greatest(0, 1 - list_dot_product(v, c))), 4) AS inertia FROM u JOIN cent ON cent.cluster = u.cluster")
def inertia(spark, d):
    """AGG-16."""
    from ..functions import vectors

    v = _vectors(spark, d)
    c = vector_search.centroids(v).select("cluster", "centroid")
    return v.join(c, "cluster").agg(F.round(F.sum(F.greatest(F.lit(0.0), 1 - vectors.cosine(F.col("embedding"), F.col("centroid")))), 4).alias("inertia"))


@query("silhouette", f"""WITH {_CENT}, n AS (SELECT cluster, count(*) AS n FROM u GROUP BY 1), t AS (SELECT u.id, u.cluster AS own, n.cluster AS other, n.n, n.n - list_dot_product(v, s) AS d FROM u, cent JOIN n ON n.cluster = cent.cluster),
    ab AS (SELECT id, own, max(CASE WHEN own = other THEN d / (n - 1) END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b FROM t GROUP BY id, own) SELECT id, own AS cluster, round((b - a) / greatest(a, b), 5) AS silhouette FROM ab""")
def silhouette(spark, d):
    """CLU-03."""
    return clustering.silhouette(_vectors(spark, d)).select("id", "cluster", F.round("silhouette", 5).alias("silhouette"))


@query("kmeans_choose_k")
def kmeans_choose_k(spark, d):
    """CLU-01, CLU-04, CLU-05, CLU-08: seeded k-means with the number of clusters chosen by silhouette."""
    rows = _vectors(spark, d).select(F.floor(F.col("id") / 300).alias("search_id"), "id", "embedding")  # a search selects at most 300
    return clustering.cluster(rows, 3, 5).select("search_id", "id", "cluster", F.round("silhouette", 5).alias("silhouette"))


_CTFIDF = rf"""raw AS (SELECT doc_id AS id, cluster, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM (SELECT doc_id, CAST(doc_id % 5 AS BIGINT) AS cluster, regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)*') AS w FROM documents)),
    m AS (SELECT *, length(t) < 2 OR regexp_full_match(t, '\d+') OR t IN ({_TERM_STOP}) AS cut FROM raw), nx AS (SELECT *, lead(t) OVER w AS nt, lead(cut) OVER w AS ncut FROM m WINDOW w AS (PARTITION BY id ORDER BY i)),
    g AS (SELECT id, cluster, t AS term FROM nx WHERE NOT cut UNION ALL SELECT id, cluster, t || ' ' || nt FROM nx WHERE NOT cut AND ncut = FALSE),
    tf AS (SELECT cluster, term, count(*) AS tf, count(DISTINCT id) AS df FROM g GROUP BY 1, 2), len AS (SELECT cluster, count(*) AS len FROM g GROUP BY 1), allf AS (SELECT term, sum(tf) AS a FROM tf GROUP BY 1),
    sc AS (SELECT tf.cluster, tf.term, tf, df, tf / len.len * ln(1 + (SELECT avg(len) FROM len) / a) AS score FROM tf JOIN len ON len.cluster = tf.cluster JOIN allf ON allf.term = tf.term)"""


def _class_scores(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("cluster"), "text")
    return clustering.class_tf_idf(t)


@query("ctfidf_scores", f"WITH {_CTFIDF} SELECT cluster, term, tf, df, round(score, 9) AS score FROM sc WHERE tf >= 5")
def ctfidf_scores(spark, d):
    """CLU-06, AGG-09."""
    return _class_scores(spark, d).where("tf >= 5").select("cluster", "term", "tf", "df", F.round("score", 9).alias("score"))


@query("key_terms_pick")
def key_terms_pick(spark, d):
    """CLU-06, STR-F28: key terms and a label for each cluster."""
    k = clustering.key_terms(_class_scores(spark, d))
    return k.select("cluster", F.array_join("terms", ", ").alias("terms"), clustering.label_column(F.col("terms")).alias("label"))


_PAIRS = f"""{_UNIT}, m AS (SELECT 'b' AS side, cluster, id, v FROM u UNION ALL SELECT 'c', CASE WHEN id % 4 = 0 THEN (cluster + 1) % 10 ELSE cluster END, id, v FROM u),
    x AS (SELECT side, cluster, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM m), s AS (SELECT side, cluster, i, sum(x) AS x FROM x GROUP BY ALL), l AS (SELECT side, cluster, list(x ORDER BY i) AS s FROM s GROUP BY ALL), k AS (SELECT side, cluster, list(id) AS ids FROM m GROUP BY ALL),
    f AS (SELECT l.side, l.cluster, s, ids FROM l JOIN k ON k.side = l.side AND k.cluster = l.cluster)"""


def _two_runs(spark, d):
    v = _vectors(spark, d)
    w = v.withColumn("cluster", F.when(F.col("id") % 4 == 0, (F.col("cluster") + 1) % 10).otherwise(F.col("cluster")))

    side = lambda x: (vector_search.centroids(x).select("cluster", "centroid"), x.select("cluster", F.col("id").alias("member")))
    (base, base_members), (current, current_members) = side(v), side(w)
    return base, current, base_members, current_members


@query("cluster_pair_jaccard", f"WITH {_PAIRS} SELECT c.cluster AS cur, b.cluster AS bas, round(len(list_intersect(c.ids, b.ids)) / (len(c.ids) + len(b.ids) - len(list_intersect(c.ids, b.ids))), 6) AS jaccard, round(list_cosine_similarity(c.s, b.s), 6) AS cosine FROM f c, f b WHERE c.side = 'c' AND b.side = 'b'")
def cluster_pair_jaccard(spark, d):
    """JOI-13, SET-03, CLU-07."""
    return clustering.cluster_pairs(*_two_runs(spark, d)).select("cur", "bas", six("jaccard").alias("jaccard"), six("cosine").alias("cosine"))


@query("cluster_change_class")
def cluster_change_class(spark, d):
    """CLU-07, DIF-01, RMD-06: stable, grew, shrank, split, merged, new, gone."""
    return clustering.match_clusters(*_two_runs(spark, d))


_HALF = "b AS (SELECT l_partkey AS id, count(*) AS cites FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1), c AS (SELECT l_partkey AS id, count(*) AS cites FROM lineitem GROUP BY 1)"


@query("rising_top10", f"WITH {_HALF} SELECT c.id, b.cites AS before, c.cites AS after, c.cites - b.cites AS delta FROM c JOIN b ON b.id = c.id WHERE c.cites - b.cites >= 5 ORDER BY delta DESC, after DESC, c.id LIMIT 10")
def rising_top10(spark, d):
    """TOP-08, DIF-01."""
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_shipdate")
    base = line.where(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz")).groupBy("id").agg(F.count(F.lit(1)).alias("cites"))
    return changes.rising(base, line.groupBy("id").agg(F.count(F.lit(1)).alias("cites"))).select("id", "before", "after", "delta")


_AGE = f"(epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(o_orderdate)) / 86400000.0"


@query("publication_rate", f"""WITH a AS (SELECT o_orderpriority AS cluster, {_AGE} AS age FROM orders), n AS (SELECT cluster, count(*) FILTER (WHERE age >= 0 AND age <= 365) AS y, count(*) FILTER (WHERE age >= 0 AND age <= 182.5) AS h, count(*) FILTER (WHERE age > 182.5 AND age <= 365) AS p FROM a GROUP BY 1)
    SELECT cluster, round(y / 12, 6) AS monthly_rate, round(CASE WHEN p > 0 THEN (h - p) / p END, 6) AS growth FROM n""")
def publication_rate(spark, d):
    """AGG-13, DIF-03."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("cluster"), "o_orderdate")
    return changes.publication_rate(o, "o_orderdate", now(), ("cluster",)).select("cluster", six("monthly_rate").alias("monthly_rate"), six("growth").alias("growth"))
