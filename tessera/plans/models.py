"""Read models and layout over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prose as prose_refs
from ..operators import readmodels
from ..tables import table
from .registry import query, six


@query("radii", "SELECT c_custkey AS id, round(6 + sqrt(greatest(0, least(1, c_acctbal / 10000))) * 10, 6) AS r, round(12 + 28 * greatest(0, least(1, c_acctbal / 10000)), 6) AS size FROM customer")
def radii(spark, d):
    """TIM-03."""
    from ..functions.numbers import clamp01

    v = F.col("c_acctbal") / 10000
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), six(readmodels.radius(v)).alias("r"), six(12 + 28 * clamp01(v)).alias("size"))


def _points(spark, d):
    """Orders as papers on a time axis; lanes are priorities."""
    t = F.year("o_orderdate") + (F.month("o_orderdate") - 1) / 12
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("cluster"), t.alias("t"), (F.col("o_totalprice") / 500000).alias("influence"))


@query("lanes", """WITH p AS (SELECT o_orderkey AS id, CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 3 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) ELSE -1 END AS lane, year(o_orderdate) + (month(o_orderdate) - 1) / 12 AS t FROM orders),
    l AS (SELECT lane, row_number() OVER (ORDER BY lane = -1, min(t), lane) - 1 AS lane_order FROM p GROUP BY lane) SELECT id, p.lane, lane_order, round(t, 6) AS t FROM p JOIN l ON l.lane = p.lane""")
def lanes(spark, d):
    """TIM-01."""
    known = spark.createDataFrame([(1,), (2,), (3,)], "cluster int")
    return readmodels.lanes(_points(spark, d), known).select("id", "lane", F.col("lane_order").cast("long").alias("lane_order"), six("t").alias("t"))


@query("time_domain", "SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS cluster, CAST(min(year(o_orderdate)) AS BIGINT) AS lo, CAST(max(CASE WHEN month(o_orderdate) = 1 THEN year(o_orderdate) ELSE year(o_orderdate) + 1 END) AS BIGINT) AS hi FROM orders GROUP BY 1")
def time_domain(spark, d):
    """TIM-02."""
    return readmodels.time_domain(_points(spark, d), "t", ("cluster",)).select("cluster", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


@query("era_bands", """WITH e AS (SELECT 'n' || n_nationkey AS label, 1990 + n_nationkey AS s, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 1990 + n_nationkey + 3 END AS e FROM nation), x AS (SELECT *, lead(s) OVER (ORDER BY s, label) AS nx FROM e),
    b AS (SELECT label, greatest(1992, s) AS start, least(2012, coalesce(e + 1, 2012), CASE WHEN nx > s THEN nx END) AS stop FROM x) SELECT label, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM b WHERE stop > start""")
def era_bands(spark, d):
    """TIM-05, WIN-12."""
    k = F.col("n_nationkey")
    e = table(spark, d, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("label"), (1990 + k).alias("start_year"), F.when(k % 4 != 0, 1993 + k).alias("end_year"))
    return readmodels.era_bands(e, 1992, 2012)


@query("lineage", "SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_returnflag = 'R' AND l_partkey <> l_suppkey AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def lineage(spark, d):
    """TIM-07."""
    e = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_partkey <> l_suppkey").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    placed = lambda t, k, c, to: table(spark, d, t).where(c).select(F.col(k).alias(to))
    return e.join(placed("part", "p_partkey", "p_size < 25", "source"), "source", "left_semi").join(placed("supplier", "s_suppkey", "s_acctbal > 0", "target"), "target", "left_semi").select("source", "target")


@query("lineage_paths", """SELECT s_suppkey AS id, 'M' || printf('%.1f', s_suppkey * 1.0) || ',' || printf('%.1f', 10.0) || ' C' || printf('%.1f', round((s_suppkey + 100) / 2, 1)) || ',' || printf('%.1f', 10.0) || ' ' || printf('%.1f', round((s_suppkey + 100) / 2, 1)) || ',' || printf('%.1f', 90.0) || ' ' || printf('%.1f', 100.0) || ',' || printf('%.1f', 90.0) AS path FROM supplier""")
def lineage_paths(spark, d):
    """AUX-24."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), readmodels.lineage_path(F.col("s_suppkey").cast("double"), F.lit(10.0), F.lit(100.0), F.lit(90.0)).alias("path"))


@query("ring_anchors", """WITH c AS (SELECT c_nationkey AS cluster, sqrt(count(*)) AS s FROM customer GROUP BY 1), a AS (SELECT cluster, 2 * pi() * (coalesce(sum(s) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s / 2) / sum(s) OVER () - pi() / 2 AS t FROM c)
    SELECT cluster, round(300 * cos(t), 4) AS x, round(300 * sin(t), 4) AS y FROM a""")
def ring_anchors(spark, d):
    """MAP-01."""
    sizes = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return readmodels.ring_anchors(sizes).select("cluster", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("halos", "SELECT c_nationkey AS cluster, round(avg(c_acctbal), 4) AS cx, round(max(abs(c_acctbal)), 4) AS r, count(*) AS n FROM customer GROUP BY 1")
def halos(spark, d):
    """MAP-02, the part that is data: extent of each cluster."""
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.round(F.avg("c_acctbal"), 4).alias("cx"), F.round(F.max(F.abs("c_acctbal")), 4).alias("r"), F.count(F.lit(1)).alias("n"))


@query("axis_ticks", "SELECT CAST(unnest(generate_series(lo, hi, 2)) AS INTEGER) AS year FROM (SELECT min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders)")
def axis_ticks(spark, d):
    """AUX-07."""
    y = F.year("o_orderdate")
    return table(spark, d, "orders").agg(F.explode(F.sequence(F.min(y), F.max(y), F.lit(2))).alias("year"))


def _lane():
    """A lane is a priority within one run; a run is what a search selects, here 200 consecutive orders."""
    return F.floor(F.col("id") / 200).cast("int") * 10 + F.col("cluster")


@query("pack_lane")
def pack_lane(spark, d):
    """TIM-04: greedy packing of each lane."""
    p = _points(spark, d)
    p = p.select(_lane().alias("lane"), "id", ((F.col("t") - 1995) * 120).alias("x"), "t", readmodels.radius(F.col("influence")).alias("r"), "influence")
    return readmodels.pack_lanes(p)


@query("overflow_markers")
def overflow_markers(spark, d):
    """TIM-06: what overflows, in merged buckets."""
    p = _points(spark, d)
    p = p.select(_lane().alias("lane"), "id", ((F.col("t") - 1995) * 120).alias("x"), "t", readmodels.radius(F.col("influence")).alias("r"), "influence")
    over = readmodels.pack_lanes(p, 20.0).where("overflow").select("lane", "id")
    return readmodels.overflow_markers(p.join(over, ["lane", "id"]))


@query("prose_rewrite", """SELECT p_partkey AS id, 'It follows (' || array_to_string(list_transform(list_filter([p_size, p_size + 20], lambda n: n BETWEEN 1 AND 50), lambda n: 'Author' || n || ' 20' || lpad(CAST(n AS VARCHAR), 2, '0')), '; ') || ') in cluster Graph methods, on P3 GPUs.' AS prose FROM part""")
def prose_rewrite(spark, d):
    """STR-F20, AUX-12, AUX-13: refs in prose become labels."""
    labels = {i: f"Author{i} 20{i:02d}" for i in range(1, 51)}
    p = table(spark, d, "part")
    prose = F.concat(F.lit("It follows (P"), F.col("p_size").cast("string"), F.lit(", P"), (F.col("p_size") + 20).cast("string"), F.lit(") in cluster C1, on P3 GPUs."))
    return p.select(F.col("p_partkey").alias("id"), prose_refs.rewrite_refs_column(prose, labels, {1: "Graph methods"}).alias("prose"))


@query("dossier")
def dossier(spark, d):
    """RMD-04: one document for each run, at the first level that fits."""
    t = table(spark, d, "documents")  # a run holds fifty of them
    p = t.select(
        F.floor(F.col("doc_id") / 50).cast("int").alias("search_id"), F.col("doc_id").alias("id"), F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("ref"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        (F.col("doc_id") % 3).cast("int").alias("cluster"), F.lit(None).cast("string").alias("published_at"), (1990 + F.col("doc_id") % 30).cast("int").alias("year"), F.col("text").alias("abstract"), F.col("n_chars").alias("cites"), (F.col("doc_id") % 10 / 10).alias("influence"),
    )
    e = p.select("search_id", F.col("id").alias("source"), (F.floor(F.col("id") / 50) * 50 + F.col("id") % 40).alias("target"))
    return readmodels.dossier(p, e, 6000)


@query("dossier_order", "SELECT doc_id AS id, row_number() OVER (ORDER BY CASE WHEN doc_id % 5 = 0 THEN 2147483647 ELSE doc_id % 3 END, CASE WHEN doc_id % 2 = 0 THEN CAST(1990 + doc_id % 30 AS VARCHAR) || '-00-00' ELSE '9999-99-99' END, doc_id) AS n FROM documents")
def dossier_order(spark, d):
    """TOP-11."""
    from pyspark.sql import Window as W

    k = F.col("doc_id")
    key = readmodels.sort_key(F.lit(None).cast("string"), F.when(k % 2 == 0, 1990 + k % 30))
    order = W.orderBy(F.when(k % 5 == 0, 2147483647).otherwise(k % 3), key, k)
    return table(spark, d, "documents").select(k.alias("id"), F.row_number().over(order).cast("long").alias("n"))


@query("document_refs_resolved", "SELECT a.doc_id AS doc, r.pos, CAST(r.ref AS BIGINT) AS id FROM documents a, (SELECT unnest([7, 3, 7, 99999999]) AS ref, unnest([1, 2, 3, 4]) AS pos) r WHERE r.ref IN (SELECT doc_id FROM documents) AND r.pos <> 3")
def document_refs_resolved(spark, d):
    """JOI-16, RMD-05, JSN-02: refs in arrays resolve to rows, unknown ones drop, the first of equals stays."""
    t = table(spark, d, "documents")
    arrays = t.select(F.col("doc_id").alias("doc"), F.posexplode(F.array(*[F.lit(x) for x in (7, 3, 7, 99999999)])).alias("p", "id"))
    first = arrays.groupBy("doc", "id").agg((F.min("p") + 1).alias("pos"))
    return first.join(t.select(F.col("doc_id").alias("id")), "id", "left_semi").select("doc", "pos", F.col("id").cast("long").alias("id"))


@query("documents_validated", "SELECT event_id AS id, event_id % 3 <> 0 AND event_id % 4 <> 0 AS ok FROM events")
def documents_validated(spark, d):
    """JSN-03, JSN-04: documents are checked as they are read; malformed ones and errors count as failed."""
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, '{"eras": [').otherwise('{"eras": [{"label": "a", "start": 1}]}')
    shape = "eras array<struct<label:string,start:int>>, _bad string"
    parsed = F.from_json(raw, shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return table(spark, d, "events").select(k.alias("id"), (parsed["_bad"].isNull() & parsed["eras"].isNotNull() & (k % 4 != 0)).alias("ok"))


@query("list_coercion", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN ['a', 'b c'] ELSE ['x', 'y'] END AS items FROM events")
def list_coercion(spark, d):
    """STR-F26: lists that come as JSON text or as delimited text."""
    k = F.col("event_id")
    raw = F.when(k % 2 == 0, '["a", "b c"]').otherwise(" x; y ;")
    parts = F.filter(F.transform(F.split(raw, r"[;\n]"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return table(spark, d, "events").select(k.alias("id"), F.coalesce(F.from_json(raw, "array<string>"), parts).alias("items"))


@query("snapshot_nested", """SELECT c_custkey AS id, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:3] AS top, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def snapshot_nested(spark, d):
    """RMD-01: rows with nested lists, as the reading side gets them."""
    from ..operators.relational import row_numbers

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), "o_totalprice")
    top = row_numbers(o, "_n", ["id"], F.desc("o_totalprice"), F.col("k")).where("_n <= 3").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_n", "k"))).alias("_t"))
    total = o.groupBy("id").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return total.join(top, "id").join(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", "left_semi").select("id", F.col("_t.k").alias("top"), "total")


@query("paper_detail", "SELECT o_orderkey AS id, c_name AS author, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS refs, o_orderstatus = 'F' AS done FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def paper_detail(spark, d):
    """RMD-02, API-09."""
    o = table(spark, d, "orders")
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("_n"))
    c = table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("author"), F.coalesce("_n", F.lit(0)).alias("refs"), (F.col("o_orderstatus") == "F").alias("done"))


@query("stage_progress", "SELECT j.job, s.stage, count(e.event_id) AS events FROM (SELECT DISTINCT user_id AS job FROM events) j, (SELECT unnest(['signup', 'view', 'click', 'purchase', 'error', 'never']) AS stage) s LEFT JOIN events e ON e.user_id = j.job AND e.event_type = s.stage GROUP BY 1, 2")
def stage_progress(spark, d):
    """RMD-03, API-08: a fixed list of stages, also those without an event."""
    stages = F.array(*map(F.lit, ["signup", "view", "click", "purchase", "error", "never"]))
    e = table(spark, d, "events")
    grid = e.select(F.col("user_id").alias("job")).distinct().select("job", F.explode(stages).alias("stage"))
    n = e.groupBy(F.col("user_id").alias("job"), F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("_n"))
    return grid.join(n, ["job", "stage"], "left").select("job", "stage", F.coalesce("_n", F.lit(0)).alias("events"))
