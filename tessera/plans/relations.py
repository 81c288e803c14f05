"""Scans, filters, joins, aggregates, windows, sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..tables import table
from .registry import NOW, PAPERS_SQL, now, papers, query, six


@query("entries_newest", "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def entries_newest(spark, d):
    """SRC-01, API-01: newest first."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")).orderBy(F.desc("created_at"), "id").limit(100)


@query("slug_or_id_lookup", "SELECT c_custkey AS id, c_name AS slug FROM customer WHERE c_custkey = 7 OR c_name = 'Customer#000000009' ORDER BY CASE WHEN c_custkey = 7 THEN 0 ELSE 1 END LIMIT 1")
def slug_or_id_lookup(spark, d):
    """SRC-02, API-06: by id or slug, the id wins."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("slug"))
    return c.where((F.col("id") == 7) | (F.col("slug") == "Customer#000000009")).orderBy(F.when(F.col("id") == 7, 0).otherwise(1)).limit(1)


@query("keyset_page", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey > 4000 ORDER BY o_orderkey LIMIT 500")
def keyset_page(spark, d):
    """SRC-03: the page after a key."""
    return table(spark, d, "orders").where("o_orderkey > 4000").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")).orderBy("id").limit(500)


@query("batch_lookup", "SELECT i AS pos, p_partkey AS id, p_name AS name FROM (SELECT unnest([5, 99999999, 3, 5]) AS want, unnest([0, 1, 2, 3]) AS i) LEFT JOIN part ON p_partkey = want")
def batch_lookup(spark, d):
    """SRC-14: aligned with the ids asked for, null where missing."""
    want = spark.createDataFrame([(0, 5), (1, 99999999), (2, 3), (3, 5)], "pos int, want long")
    p = table(spark, d, "part")
    return want.join(p, F.col("want") == F.col("p_partkey"), "left").select("pos", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("citation_sorted_bulk", f"WITH {PAPERS_SQL} SELECT id, cites FROM papers ORDER BY cites DESC NULLS LAST, id LIMIT 50")
def citation_sorted_bulk(spark, d):
    """SRC-13."""
    return papers(spark, d).select("id", "cites").orderBy(F.desc_nulls_last("cites"), "id").limit(50)


@query("references_expansion", "SELECT l_orderkey AS paper, l_partkey AS ref FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) WHERE n <= 3")
def references_expansion(spark, d):
    """SRC-15: at most three references of each paper."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("ref")).distinct()
    return rel.top_per_group(e, 3, ["paper"], F.col("ref"))


@query("author_metrics", "SELECT s_suppkey AS id, max(l_quantity) AS h FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R') w JOIN supplier ON s_suppkey = w.l_suppkey LEFT JOIN lineitem l ON l.l_suppkey = s_suppkey GROUP BY s_suppkey")
def author_metrics(spark, d):
    """SRC-16: metrics of the authors asked for, once each."""
    line = table(spark, d, "lineitem")
    want = line.where("l_returnflag = 'R'").select("l_suppkey").distinct()
    h = line.groupBy("l_suppkey").agg(F.max("l_quantity").alias("h"))
    return table(spark, d, "supplier").join(want, F.col("s_suppkey") == want["l_suppkey"], "left_semi").join(h, F.col("s_suppkey") == h["l_suppkey"], "left").select(F.col("s_suppkey").alias("id"), "h")


@query("cache_lookup", "SELECT o_orderkey AS id, o_orderdate > TIMESTAMP '2000-01-01' AS hit FROM orders WHERE o_orderkey % 10 = 0")
def cache_lookup(spark, d):
    """SRC-21, STR-09, DML-08: hits and misses of a cache whose entries expire."""
    from ..operators.entities import cache_split

    o = table(spark, d, "orders")
    hits, misses = cache_split(o.where("o_orderkey % 10 = 0").select("o_orderkey"), o.select("o_orderkey", "o_orderdate"), ["o_orderkey"], F.lit("2000-01-01").cast("timestamp_ntz"), "o_orderdate")
    return hits.select(F.col("o_orderkey").alias("id"), F.lit(True).alias("hit")).union(misses.select("o_orderkey", F.lit(False)))


@query("cache_purge", "SELECT count(*) AS purged FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01'")
def cache_purge(spark, d):
    """SRC-22."""
    return table(spark, d, "orders").where(F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("purged"))


@query("snapshots_pruned", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS name FROM orders WHERE strftime(o_orderdate, '%Y-%m') NOT IN (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') m FROM orders ORDER BY m DESC LIMIT 10)")
def snapshots_pruned(spark, d):
    """SRC-30: what goes beyond the newest ten."""
    from ..sources.backup import prune

    return prune(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("name")).distinct())


@query("wire_projection", "SELECT d.doc_id AS id, coalesce(d.lang, '') AS lang, e.embedding IS NOT NULL AS has_embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def wire_projection(spark, d):
    """FLT-01: without blobs, with a flag."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").isNotNull().alias("_has"))
    t = table(spark, d, "documents")
    return t.join(e, t["doc_id"] == e["vec_id"], "left").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("_has", F.lit(False)).alias("has_embedding"))


@query("haystack_filter", "SELECT p_partkey AS id FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#12') AND p_size > 10")
def haystack_filter(spark, d):
    """FLT-02, FLT-03, FLT-05: substring of joined fields, and equality filters."""
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return table(spark, d, "part").where(F.contains(hay, F.lit("brand#12")) & (F.col("p_size") > 10)).select(F.col("p_partkey").alias("id"))


@query("hide_logged_anti", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def hide_logged_anti(spark, d):
    """FLT-04."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_anti").select(F.col("c_custkey").alias("id"))


@query("since_window", f"SELECT count(*) AS n, min(o_orderkey) AS first_id FROM orders WHERE o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 36 MONTH")
def since_window(spark, d):
    """FLT-06, DAT-04: a window of years before now."""
    since = (F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 36 MONTH"))
    return table(spark, d, "orders").where(F.col("o_orderdate") >= since).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"))


@query("dual_timestamp_count", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def dual_timestamp_count(spark, d):
    """FLT-07, DAT-05: text times in two forms."""
    from ..functions.numbers import dual_timestamp

    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 2 == 0, iso).otherwise(F.regexp_replace(iso, "T", " "))
    return table(spark, d, "events").where(dual_timestamp(text) >= F.lit("2024-01-15").cast("timestamp")).agg(F.count(F.lit(1)).alias("n"))


@query("known_values", "SELECT count(*) FILTER (WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)) AS known, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS x FROM events)")
def known_values(spark, d):
    """FLT-08."""
    from ..functions.numbers import known

    x = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    return table(spark, d, "events").agg(F.count_if(known(x)).alias("known"), F.count(F.lit(1)).alias("n"))


@query("relevance_gate", "SELECT p_partkey AS id FROM part WHERE p_retailprice >= 0.75 * (SELECT max(p_retailprice) FROM part)")
def relevance_gate(spark, d):
    """FLT-09: at least a share of the best."""
    p = table(spark, d, "part")
    best = p.agg((0.75 * F.max("p_retailprice")).alias("_least"))
    return p.join(F.broadcast(best)).where(F.col("p_retailprice") >= F.col("_least")).select(F.col("p_partkey").alias("id"))


@query("recency_gate", f"WITH {PAPERS_SQL} SELECT id, epoch_ms(published_at) >= epoch_ms(TIMESTAMP '{NOW}') - 84 * 365.25 / 12 * 86400000 AS recent FROM papers WHERE published_at IS NOT NULL")
def recency_gate(spark, d):
    """FLT-10: mean months, not calendar months."""
    p = papers(spark, d).where("published_at IS NOT NULL")
    return p.select("id", (F.unix_millis(F.col("published_at").cast("timestamp")) >= F.unix_millis(now()) - 84 * 365.25 / 12 * 86400000).alias("recent"))


@query("json_prefilter", """SELECT count(*) AS n FROM events WHERE contains(props, '"k"') AND CAST(json_extract(props, '$.k') AS BIGINT) = 3""")
def json_prefilter(spark, d):
    """FLT-11: a cheap substring test before the JSON is parsed."""
    return table(spark, d, "events").where(F.contains("props", F.lit('"k"')) & (F.get_json_object("props", "$.k").cast("long") == 3)).agg(F.count(F.lit(1)).alias("n"))


@query("drift_filter", """WITH s AS (SELECT s_suppkey AS id, s_nationkey AS topic, s_acctbal / 10000 AS sim, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY CASE WHEN sim < 0.15 THEN 0 ELSE 1 END, sim, id) AS rn FROM s) SELECT id, topic FROM r WHERE sim >= 0.15 OR rn > n // 2""")
def drift_filter(spark, d):
    """FLT-12: the lowest similarities below a limit go, at most half."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("topic"), (F.col("s_acctbal") / 10000).alias("sim"))
    low = F.when(F.col("sim") < 0.15, 0).otherwise(1)
    s = s.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("topic"))).withColumn("_rn", F.row_number().over(W.partitionBy("topic").orderBy(low, "sim", "id")))
    return s.where((F.col("sim") >= 0.15) | (F.col("_rn") > F.floor(F.col("_n") / 2))).select("id", "topic")


@query("pool_join", "SELECT l_orderkey AS search_id, l_linenumber AS line, p_partkey AS paper_id, p_name AS title FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def pool_join(spark, d):
    """JOI-01."""
    line = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    p = table(spark, d, "part")
    return line.join(p, line["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("search_id"), F.col("l_linenumber").alias("line"), F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"))


@query("snapshot_left_join", "SELECT o_orderkey AS id, c_name AS name, round(sum(l_extendedprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey, c_name")
def snapshot_left_join(spark, d):
    """JOI-02: lines are summed before they are joined."""
    line = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    o = table(spark, d, "orders").join(line, "o_orderkey", "left")
    c = table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), "total")


@query("correlated_selected_count", "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS selected FROM customer")
def correlated_selected_count(spark, d):
    """JOI-03."""
    n = table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("_n"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.coalesce("_n", F.lit(0)).alias("selected"))


@query("metrics_snapshot_update", "SELECT p_partkey AS id, coalesce(m, p_retailprice) AS metric FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS m FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-01-01' GROUP BY 1) ON l_partkey = p_partkey")
def metrics_snapshot_update(spark, d):
    """JOI-04, DML-04."""
    new = table(spark, d, "lineitem").where(F.col("l_shipdate") > F.lit("2001-01-01").cast("timestamp_ntz")).groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_extendedprice").alias("metric"))
    old = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("metric"))
    return rel.update_where_given(old, new, ["id"], ["metric"])


@query("local_citations_semi", """WITH sel AS (SELECT p_partkey FROM part WHERE p_size <= 10),
    e AS (SELECT DISTINCT a.l_partkey AS citing, b.l_partkey AS cited FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
    SELECT citing, cited FROM e WHERE citing IN (SELECT * FROM sel) AND cited IN (SELECT * FROM sel)""")
def local_citations_semi(spark, d):
    """JOI-05."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    b = line.toDF("l_orderkey", "_m", "cited")
    e = line.join(b, "l_orderkey").where("l_linenumber < _m").select(F.col("l_partkey").alias("citing"), "cited").distinct()
    return rel.semi_both_ends(e, table(spark, d, "part").where("p_size <= 10"), "citing", "cited", "p_partkey")


@query("new_dropped_anti", """WITH b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), c AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')
    SELECT id, 'new' AS change FROM c WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'dropped' FROM b WHERE id NOT IN (SELECT id FROM c)""")
def new_dropped_anti(spark, d):
    """JOI-06, SET-02, DIF-01."""
    from ..operators.changes import new_and_dropped

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderdate", F.lit(0).alias("rank"))
    cut = lambda x: F.lit(x).cast("timestamp_ntz")
    base, current = o.where(F.col("o_orderdate") < cut("1996-01-01")), o.where(F.col("o_orderdate") >= cut("2001-01-01"))
    return new_and_dropped(base.select("id", "rank").distinct(), current.select("id", "rank").distinct()).drop("rank")


@query("priority_key_resolve", """WITH w AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS k1, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS k2, c_mktsegment AS k3 FROM customer),
    h AS (SELECT s_suppkey AS sid, s_suppkey * 3 AS k1, s_nationkey AS k2, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'NONE' END AS k3 FROM supplier)
    SELECT id, coalesce((SELECT min(sid) FROM h WHERE h.k1 = w.k1), (SELECT min(sid) FROM h WHERE h.k2 = w.k2), (SELECT min(sid) FROM h WHERE h.k3 = w.k3)) AS resolved_id FROM w""")
def priority_key_resolve(spark, d):
    """JOI-07."""
    w = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("k1"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("k2"), F.col("c_mktsegment").alias("k3"))
    third = F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").when(F.col("s_suppkey") % 3 == 1, "MACHINERY").otherwise("NONE")
    h = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sid"), (F.col("s_suppkey") * 3).alias("k1"), F.col("s_nationkey").alias("k2"), third.alias("k3"))
    return rel.resolve_by_priority(w, h, ["k1", "k2", "k3"], "sid").select("id", "resolved_id")


@query("external_id_or_join", """SELECT DISTINCT a.s_suppkey AS left_id, b.c_custkey AS right_id FROM supplier a JOIN customer b ON a.s_suppkey = b.c_custkey OR a.s_name = replace(b.c_name, 'Customer', 'Supplier')""")
def external_id_or_join(spark, d):
    """JOI-08."""
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("lid"), F.col("s_suppkey").cast("string").alias("k1"), F.col("s_name").alias("k2"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_custkey").cast("string").alias("k1"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("k2"))
    return rel.join_on_any(a, b, ["k1", "k2"], "lid", "rid")


@query("ancestor_walk", """WITH RECURSIVE up(id, hop, cur) AS (SELECT p_partkey, 0, p_partkey FROM part UNION ALL SELECT id, hop + 1, cur // 2 FROM up WHERE cur > 1 AND hop < 20)
    SELECT id, CAST(max(hop) AS BIGINT) AS hops, CAST(max(cur) FILTER (WHERE cur % 5 = 0) AS BIGINT) AS nearest FROM up GROUP BY id""")
def ancestor_walk(spark, d):
    """JOI-15: a parent key followed up to twenty hops.

    The parent is computed, so each row makes its own walk: a recursive query of Spark ends at a million rows.
    """
    k = F.col("id")
    hops = F.filter(F.sequence(F.lit(0), F.lit(20)), lambda h: (h == 0) | (F.expr("id > 1") & (F.call_function("shiftright", k, F.greatest(h - 1, F.lit(0))) > 1)))
    walk = F.transform(hops, lambda h: F.struct(h.cast("long").alias("hop"), F.call_function("shiftright", k, h).alias("at")))
    nearest = F.array_max(F.transform(F.filter(walk, lambda w: w["at"] % 5 == 0), lambda w: w["at"]))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id")).select("id", F.array_max(hops).cast("long").alias("hops"), nearest.alias("nearest"))
    return rows.groupBy("id").agg(F.max("hops").alias("hops"), F.max("nearest").alias("nearest"))


@query("usage_rollup", "SELECT user_id AS job, count(*) AS calls, round(sum(value), 4) AS cost, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY user_id")
def usage_rollup(spark, d):
    """AGG-01, AGG-02, AGG-17, STR-02."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.sum(k).alias("tokens"))


@query("score_scales", "SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, max(c_custkey) AS top FROM customer")
def score_scales(spark, d):
    """AGG-03."""
    return table(spark, d, "customer").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.max("c_custkey").alias("top"))


@query("median_gate", f"WITH {PAPERS_SQL} SELECT id FROM papers WHERE coalesce(cites, 0) >= (SELECT median(coalesce(cites, 0)) FROM papers)")
def median_gate(spark, d):
    """AGG-04."""
    p = papers(spark, d).select("id", F.coalesce("cites", F.lit(0)).alias("c"))
    m = p.agg(F.median("c").alias("_m"))
    return p.join(F.broadcast(m)).where("c >= _m").select("id")


@query("seed_link_agg", "SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS seeds, bool_or(l_returnflag = 'R') AS influential FROM lineitem GROUP BY l_partkey")
def seed_link_agg(spark, d):
    """AGG-05."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count_distinct("l_suppkey").alias("seeds"), F.bool_or(F.col("l_returnflag") == "R").alias("influential"))


@query("source_rank_fold", "SELECT l_partkey AS id, CAST(min(l_linenumber) AS BIGINT) AS best_rank, list_sort(list(DISTINCT l_linenumber)) AS hits FROM lineitem GROUP BY l_partkey")
def source_rank_fold(spark, d):
    """AGG-06, SET-04."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_linenumber").cast("long").alias("best_rank"), F.array_sort(F.collect_set("l_linenumber")).alias("hits"))


@query("year_span", "SELECT o_custkey AS id, CAST(min(year(o_orderdate)) AS INTEGER) AS year_min, CAST(max(year(o_orderdate)) AS INTEGER) AS year_max, count(*) AS size FROM orders GROUP BY o_custkey")
def year_span(spark, d):
    """AGG-12, AUX-04."""
    y = F.year("o_orderdate")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(y).alias("year_min"), F.max(y).alias("year_max"), F.count(F.lit(1)).alias("size"))


@query("in_degree", "SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS built_on_by FROM lineitem GROUP BY l_partkey")
def in_degree(spark, d):
    """AGG-14."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count_distinct("l_orderkey").alias("built_on_by"))


@query("invalid_ref_ratio", "SELECT user_id AS doc, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS invalid_ratio, count(*) FILTER (WHERE event_type = 'error') AS invalid FROM events GROUP BY user_id")
def invalid_ref_ratio(spark, d):
    """AGG-15, AUX-22."""
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").groupBy(F.col("user_id").alias("doc")).agg(six(F.avg(F.when(bad, 1.0).otherwise(0.0))).alias("invalid_ratio"), F.count_if(bad).alias("invalid"))


@query("json_counters", "SELECT user_id AS job, CAST(arg_max(CAST(json_extract(props, '$.k') AS BIGINT), (ts, event_id)) AS BIGINT) AS last_k, CAST(max(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS max_k FROM events GROUP BY user_id")
def json_counters(spark, d):
    """AGG-18, JSN-01: last write wins."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.max_by(k, F.struct("ts", "event_id")).alias("last_k"), F.max(k).alias("max_k"))


@query("pct_rank_avg_ties", """WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN round(o_totalprice / 1000) END AS x FROM orders)
    SELECT id, round(CASE WHEN x IS NULL THEN 0 WHEN count(x) OVER () = 1 THEN 1 ELSE (rank() OVER (ORDER BY x NULLS LAST) - 1 + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / (count(x) OVER () - 1) END, 6) AS pct FROM v""")
def pct_rank_avg_ties(spark, d):
    """WIN-01."""
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 != 0, F.round(F.col("o_totalprice") / 1000)).alias("x"))
    return rel.percentile_rank(v, "x", "pct").select("id", six("pct").alias("pct"))


@query("latest_per_key", "SELECT id, o FROM (SELECT o_custkey AS id, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark, d):
    """WIN-03, DML-05."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o"))


@query("preference_pick", "SELECT id, line FROM (SELECT l_orderkey AS id, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END DESC, l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS n FROM lineitem) WHERE n = 1")
def preference_pick(spark, d):
    """WIN-04: a preferred kind first, then the newest."""
    order = F.struct((F.col("l_returnflag") == "R").cast("int"), "l_shipdate", "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max_by("l_linenumber", order).alias("line"))


@query("first_per_key", "SELECT l_orderkey AS id, min(l_partkey) AS first_part FROM lineitem GROUP BY 1")
def first_per_key(spark, d):
    """WIN-05, SET-01."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("first_part"))
    return rel.first_per_key(rows, ["id"], F.col("first_part"))


@query("relabel_by_size", "SELECT c_nationkey AS old_cluster, row_number() OVER (ORDER BY count(*) DESC, min(c_custkey), c_nationkey) - 1 AS new_cluster, count(*) AS size, min(c_custkey) AS best_rank FROM customer GROUP BY c_nationkey")
def relabel_by_size(spark, d):
    """WIN-07."""
    from ..operators.clustering import relabel

    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("final_rank"))
    return relabel(c).withColumn("new_cluster", F.col("new_cluster").cast("long"))


@query("final_rank", "SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size <= 10 DESC, p_retailprice DESC, p_partkey) AS final_rank FROM part")
def final_rank(spark, d):
    """WIN-08, WIN-09."""
    p = rel.number_rows(table(spark, d, "part"), "final_rank", (F.col("p_size") <= 10).desc(), F.desc("p_retailprice"), "p_partkey")
    return p.select(F.col("p_partkey").alias("id"), "final_rank")


@query("ref_assignment", """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size < 25 THEN p_partkey % 40 END AS rank FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY id) AS n FROM r), m AS (SELECT max(rank) AS top FROM r)
    SELECT id, 'P' || CAST(CASE WHEN rank IS NOT NULL AND n = 1 THEN rank ELSE top + row_number() OVER (PARTITION BY rank IS NOT NULL AND n = 1 ORDER BY id) END AS VARCHAR) AS ref FROM f, m""")
def ref_assignment(spark, d):
    """WIN-09: ranks become refs; repeated and missing ranks get the next free numbers."""
    r = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 25, F.col("p_partkey") % 40).alias("rank"))
    own = r.where("rank IS NOT NULL").groupBy("rank").agg(F.min("id").alias("id"))
    top = own.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
    rest = rel.number_rows(r.join(own.select("id"), "id", "left_anti"), "n", "id").select((F.col("n") + top).alias("rank"), "id")
    return own.unionByName(rest).select("id", F.concat(F.lit("P"), F.col("rank").cast("string")).alias("ref"))


@query("minmax_scale", "SELECT c_custkey AS id, round((c_acctbal - min(c_acctbal) OVER w) / nullif(max(c_acctbal) OVER w - min(c_acctbal) OVER w, 0), 6) AS relevance, round(c_custkey / max(c_custkey) OVER (), 6) AS share FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def minmax_scale(spark, d):
    """WIN-10, WIN-11, AUX-03."""
    c = table(spark, d, "customer")
    bounds = c.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("_lo"), F.max("c_acctbal").alias("_hi"))
    top = c.agg(F.max("c_custkey").alias("_top"))
    c = c.join(bounds, "c_nationkey").join(F.broadcast(top))
    return c.select(F.col("c_custkey").alias("id"), six(rel.min_max(F.col("c_acctbal"), F.col("_lo"), F.col("_hi"))).alias("relevance"), six(F.col("c_custkey") / F.col("_top")).alias("share"))


@query("phase_renumber", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS n FROM orders")
def phase_renumber(spark, d):
    """WIN-13."""
    return rel.number_rows(table(spark, d, "orders"), "n", "o_orderpriority", "o_orderkey").select(F.col("o_orderkey").alias("id"), "n")


@query("progress_prefix", "SELECT o_orderkey AS id, l_linenumber AS stage, round(coalesce(sum(q) OVER (PARTITION BY o_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(q) OVER (PARTITION BY o_orderkey), 6) AS progress FROM (SELECT o_orderkey, l_linenumber, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)")
def progress_prefix(spark, d):
    """WIN-15."""
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("stage")).agg(F.sum("l_quantity").alias("_q"))
    q = q.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi")
    before = F.coalesce(F.sum("_q").over(W.partitionBy("id").orderBy("stage").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return q.select("id", "stage", six(before / F.sum("_q").over(W.partitionBy("id"))).alias("progress"))


@query("round_robin", None)
def round_robin(spark, d):
    """WIN-14: lists take turns; SQL cannot state the skipping of what is taken."""
    line = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("list"), F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("_p"))
    best = line.groupBy("list", "id").agg(F.max("_p").alias("_p"))
    ranked = rel.row_numbers(best, "rank", ["list"], F.desc("_p"), F.col("id"))
    return rel.round_robin(ranked, "list", "rank", "id", 60)


@query("top_by_coalesced", "SELECT id FROM (SELECT p_partkey AS id, CASE WHEN p_size > 5 THEN p_retailprice END AS s FROM part) ORDER BY coalesce(s, 0) DESC, id LIMIT 40")
def top_by_coalesced(spark, d):
    """TOP-01."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("s"))
    return p.orderBy(F.desc(F.coalesce("s", F.lit(0.0))), "id").limit(40).select("id")


@query("nulls_last_sort", f"WITH {PAPERS_SQL} SELECT id, row_number() OVER (ORDER BY influential DESC NULLS LAST, id) AS down, row_number() OVER (ORDER BY influential ASC NULLS LAST, id) AS up FROM papers")
def nulls_last_sort(spark, d):
    """TOP-06, TOP-07, DAT-07."""
    p = papers(spark, d)
    down = rel.number_rows(p.select("id", "influential"), "down", F.desc_nulls_last("influential"), "id")
    return rel.number_rows(down, "up", F.asc_nulls_last("influential"), "id").select("id", "down", "up")


@query("interleave_sources", "SELECT row_number() OVER (ORDER BY rank, CASE source WHEN 'orders' THEN 0 ELSE 1 END) AS pos, source, id FROM (SELECT 'orders' AS source, o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders UNION ALL SELECT 'customer', c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) FROM customer) WHERE rank <= 50")
def interleave_sources(spark, d):
    """TOP-10."""
    rank = lambda df, s, i, by: df.orderBy(F.desc(by), i).limit(50).select(F.lit(s).alias("source"), F.col(i).alias("id"), F.row_number().over(W.orderBy(F.desc(by), i)).alias("rank"))
    both = rank(table(spark, d, "orders"), "orders", "o_orderkey", "o_totalprice").union(rank(table(spark, d, "customer"), "customer", "c_custkey", "c_acctbal"))
    order = W.orderBy("rank", F.when(F.col("source") == "orders", 0).otherwise(1))
    return both.select(F.row_number().over(order).cast("long").alias("pos"), "source", "id")


@query("jaccard_members", """WITH m AS (SELECT s_nationkey AS n, list(DISTINCT l_partkey) AS p FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)
    SELECT a.n AS a, b.n AS b, round(len(list_intersect(a.p, b.p)) / (len(a.p) + len(b.p) - len(list_intersect(a.p, b.p))), 6) AS jaccard FROM m a JOIN m b ON a.n < b.n""")
def jaccard_members(spark, d):
    """SET-03: intersections are counted by shared member, so no pair is compared that shares nothing."""
    s, line = table(spark, d, "supplier"), table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    m = s.join(line, s["s_suppkey"] == line["l_suppkey"]).select(F.col("s_nationkey").alias("n"), F.col("l_partkey").alias("p")).distinct()
    sizes = m.groupBy("n").agg(F.count(F.lit(1)).alias("_k"))
    x, y = m.toDF("a", "p"), m.toDF("b", "p")
    both = x.join(y, "p").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("_i"))
    ka, kb = sizes.toDF("a", "_ka"), sizes.toDF("b", "_kb")
    return both.join(ka, "a").join(kb, "b").select("a", "b", six(F.col("_i") / (F.col("_ka") + F.col("_kb") - F.col("_i"))).alias("jaccard"))


@query("partition_equality", "SELECT count(*) FILTER (WHERE a.label IS DISTINCT FROM (a.label + CASE WHEN a.vec_id % 50 = 0 THEN 1 ELSE 0 END)) AS mismatches FROM embeddings a")
def partition_equality(spark, d):
    """SET-05, DIF-02."""
    from ..operators.changes import partition_mismatches

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return partition_mismatches(e, e.withColumn("cluster", F.col("cluster") + F.when(F.col("id") % 50 == 0, 1).otherwise(0)))


@query("list_dedupe_cap", "SELECT conv_id, list_slice(list(r ORDER BY first_turn), 1, 2) AS roles FROM (SELECT conv_id, lower(role) AS r, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def list_dedupe_cap(spark, d):
    """SET-06, ARR-01: distinct without regard to case, in order, capped."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.lower("role").alias("r")))).alias("_t"))
    return c.select("conv_id", F.slice(F.array_distinct("_t.r"), 1, 2).alias("roles"))


@query("phase_status", """WITH s AS (SELECT user_id AS job, event_type AS st FROM events) SELECT job, CASE WHEN bool_or(st = 'error') THEN 'error' WHEN bool_or(st = 'click') THEN 'running' WHEN bool_and(st IN ('purchase', 'view')) THEN 'done' WHEN bool_or(st IN ('purchase', 'view')) THEN 'running' ELSE 'pending' END AS status FROM s GROUP BY job""")
def phase_status(spark, d):
    """AUX-01."""
    st = F.col("event_type")
    done = st.isin("purchase", "view")
    status = F.when(F.bool_or(st == "error"), "error").when(F.bool_or(st == "click"), "running").when(F.bool_and(done), "done").when(F.bool_or(done), "running").otherwise("pending")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(status.alias("status"))


@query("relation_groups", "SELECT g, p, r FROM (SELECT l_returnflag AS g, l_partkey AS p, min(l_linenumber) AS r FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY g ORDER BY r NULLS LAST, p) <= 20")
def relation_groups(spark, d):
    """AUX-02."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_partkey").alias("p")).agg(F.min("l_linenumber").alias("r"))
    return rel.top_per_group(rows, 20, ["g"], F.asc_nulls_last("r"), F.col("p"))


@query("cluster_legend", "SELECT n_nationkey AS cluster, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_nationkey HAVING count(c_custkey) > 0")
def cluster_legend(spark, d):
    """AUX-05."""
    c = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count(F.lit(1)).alias("members"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("cluster")).join(c, "cluster")


@query("answers_mapped", "SELECT conv_id AS id, arg_min(text, turn) FILTER (WHERE role = 'assistant' AND length(trim(text)) > 0) AS answer, count(*) FILTER (WHERE role = 'assistant') = 0 AS failed FROM conversations GROUP BY conv_id")
def answers_mapped(spark, d):
    """AUX-09: the first answer wins; none is a failure."""
    c = table(spark, d, "conversations")
    a = F.col("role") == "assistant"
    return c.groupBy(F.col("conv_id").alias("id")).agg(F.min_by(F.when(a & (F.length(F.trim("text")) > 0), F.col("text")), F.when(a & (F.length(F.trim("text")) > 0), F.col("turn"))).alias("answer"), (F.count_if(a) == 0).alias("failed"))


@query("label_precedence", "SELECT p_partkey AS id, coalesce(nullif(trim(CASE WHEN p_size % 4 = 0 THEN '  ' WHEN p_size % 4 = 1 THEN 'own' END), ''), CASE WHEN p_size % 3 = 0 THEN p_brand END, p_type) AS label FROM part")
def label_precedence(spark, d):
    """AUX-11."""
    own = F.when(F.col("p_size") % 4 == 0, "  ").when(F.col("p_size") % 4 == 1, "own")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.coalesce(F.nullif(F.trim(own), F.lit("")), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), "p_type").alias("label"))


@query("cluster_members", "SELECT label AS cluster, list(vec_id ORDER BY vec_id) AS members, count(*) AS size FROM embeddings GROUP BY label")
def cluster_members(spark, d):
    """AUX-17."""
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.array_sort(F.collect_list("vec_id")).alias("members"), F.count(F.lit(1)).alias("size"))


@query("metrics_value_else_global", f"WITH {PAPERS_SQL} SELECT id, coalesce(influential, cites, 0) AS shown FROM papers")
def metrics_value_else_global(spark, d):
    """AUX-25: the run's own value, else the global one."""
    return papers(spark, d).select("id", F.coalesce("influential", "cites", F.lit(0)).alias("shown"))


@query("visible_edges", """SELECT DISTINCT l_orderkey AS source, l_partkey AS target, l_returnflag AS kind FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_orderkey <> l_partkey AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)""")
def visible_edges(spark, d):
    """AUX-06."""
    e = table(spark, d, "lineitem").where("l_returnflag IN ('R', 'A') AND l_orderkey <> l_partkey").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("kind")).distinct()
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("source"))
    return e.join(o, "source", "left_semi").join(table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("target")), "target", "left_semi").select("source", "target", "kind")
