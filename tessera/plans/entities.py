"""Entity resolution and updates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities
from ..operators import relational as rel
from ..tables import table
from .registry import query

# Records made of parts: every third carries an external id that others share, titles repeat by type.
_RECORDS = """r AS (SELECT p_partkey AS id, 'Study of ' || p_type || ' in practice ' || p_size AS title, CASE WHEN p_partkey % 3 = 0 THEN 's' || (p_partkey % 60) END AS s2_id, CASE WHEN p_partkey % 5 = 0 THEN '10.1000/' || (p_partkey % 45) END AS doi, 1990 + p_size % 20 AS year, CAST(p_partkey % 90 AS BIGINT) AS cites FROM part)"""


def _records(spark, d):
    k = F.col("p_partkey")
    raw = table(spark, d, "part").select(
        k.alias("id"), F.concat(F.lit("Study of "), "p_type", F.lit(" in practice "), F.col("p_size").cast("string")).alias("title"), F.when(k % 3 == 0, F.concat(F.lit("s"), (k % 60).cast("string"))).alias("s2_id"),
        F.when(k % 5 == 0, F.concat(F.lit("doi:10.1000/"), (k % 45).cast("string"))).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.lit(None).cast("string").alias("openalex_id"),
        F.lit(None).cast("string").alias("abstract"), (1990 + F.col("p_size") % 20).alias("year"), (k % 90).alias("cites"), F.concat(F.lit("A. Author"), (k % 2).cast("string")).alias("first_author"), F.lit("s2").alias("source"),
    )
    return entities.normalize_records(raw)


_SAME_ID = "l AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.id <> b.id AND a.s2_id = b.s2_id UNION SELECT a.id, b.id FROM r a JOIN r b ON a.id <> b.id AND a.doi = b.doi)"


@query("upsert_resolve", f"""WITH RECURSIVE {_RECORDS}, {_SAME_ID}, reach(id, cur) AS (SELECT id, id FROM r UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.cur), k AS (SELECT id, min(cur) AS keeper FROM reach GROUP BY id),
    f AS (SELECT keeper AS id, min(s2_id) AS s2_id, min(doi) AS doi, arg_min(title, r.id) AS title, min(year) AS year FROM r JOIN k ON k.id = r.id GROUP BY keeper),
    t AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.id <> b.id AND a.title = b.title AND a.id % 2 = b.id % 2 AND abs(a.year - b.year) <= 1 WHERE (a.s2_id IS NULL OR b.s2_id IS NULL OR a.s2_id = b.s2_id) AND (a.doi IS NULL OR b.doi IS NULL OR a.doi = b.doi)),
    again(id, cur) AS (SELECT id, id FROM f UNION SELECT again.id, t.b FROM again JOIN t ON t.a = again.cur), last AS (SELECT id, min(cur) AS keeper FROM again GROUP BY id)
    SELECT k.id, last.keeper FROM k JOIN last ON last.id = k.keeper""")
def upsert_resolve(spark, d):
    """DML-01, JOI-08, JOI-09: records of one work and their keeper."""
    return entities.resolve(_records(spark, d))


@query("id_components", f"""WITH RECURSIVE {_RECORDS}, l AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.id <> b.id AND a.s2_id = b.s2_id UNION SELECT a.id, b.id FROM r a JOIN r b ON a.id <> b.id AND a.doi = b.doi),
    reach(id, cur) AS (SELECT id, id FROM r UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.cur) SELECT id, min(cur) AS keeper FROM reach GROUP BY id""")
def id_components(spark, d):
    """JOI-08, DML-01: what external ids connect."""
    r = _records(spark, d)
    return entities.components(r, entities.id_links(r))


@query("fuzzy_title_join", f"""WITH {_RECORDS} SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.title = b.title AND a.id % 2 = b.id % 2 AND abs(a.year - b.year) <= 1 AND a.id < b.id WHERE (a.s2_id IS NULL OR b.s2_id IS NULL OR a.s2_id = b.s2_id) AND (a.doi IS NULL OR b.doi IS NULL OR a.doi = b.doi)""")
def fuzzy_title_join(spark, d):
    """JOI-09: equi-join on title and author, then the rest."""
    return entities.title_links(_records(spark, d))


@query("duplicate_fold", f"""WITH {_RECORDS} SELECT id // 4 AS keeper, arg_min(s2_id, id) FILTER (WHERE s2_id IS NOT NULL) AS s2_id, arg_min(doi, id) FILTER (WHERE doi IS NOT NULL) AS doi, max(cites) AS cites, count(*) AS merged FROM r GROUP BY 1""")
def duplicate_fold(spark, d):
    """AGG-11, DML-02: first given value, highest metric."""
    r = _records(spark, d)
    m = entities.merge_records(r, r.select("id", F.floor(F.col("id") / 4).alias("keeper")))
    return m.select("keeper", "s2_id", "doi", "cites", "merged")


@query("merge_repoint", """WITH c AS (SELECT l_partkey // 4 AS citing, l_suppkey // 4 AS cited, l_returnflag = 'R' AS f FROM lineitem) SELECT citing, cited, bool_or(f) AS influential FROM c WHERE citing <> cited GROUP BY 1, 2""")
def merge_repoint(spark, d):
    """DML-03: edges move to the keepers, loops go, flags are kept."""
    line = table(spark, d, "lineitem")
    ids = line.select(F.explode(F.array("l_partkey", "l_suppkey")).alias("id")).distinct()
    e = line.select(F.col("l_partkey").alias("citing"), F.col("l_suppkey").alias("cited"), (F.col("l_returnflag") == "R").alias("influential"))
    return entities.repoint_edges(e, ids.withColumn("keeper", F.floor(F.col("id") / 4)))


@query("logged_lookup", """SELECT page_id AS id, (SELECT min(p.page_id) FROM pages p WHERE regexp_replace(regexp_replace(p.url, '^https?://(www\\.)?', ''), '([?#].*|/+)$', '') = regexp_replace(regexp_replace(q.url, '^https?://(www\\.)?', ''), '([?#].*|/+)$', '')) AS entry_id FROM pages q""".replace("\\\\", "\\"))
def logged_lookup(spark, d):
    """JOI-10: the oldest entry with the same key."""
    p = table(spark, d, "pages")
    want = p.select(F.col("page_id").alias("id"), F.lit(None).cast("string").alias("arxiv_id"), F.lit(None).cast("string").alias("doi"), F.array("url").alias("urls"))
    return entities.logged_lookup(want, p.select(F.col("page_id").alias("entry_id"), "url", F.col("page_id").alias("created")))


@query("insert_ignore", "SELECT p_partkey AS id, p_size AS v FROM part UNION ALL SELECT 2 * p_partkey, 0 FROM part WHERE 2 * p_partkey NOT IN (SELECT p_partkey FROM part)")
def insert_ignore(spark, d):
    """DML-05."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    return rel.insert_ignore(p, p.select((2 * F.col("id")).alias("id"), F.lit(0).alias("v")), ["id"])


@query("upsert_rows", "SELECT p_partkey AS id, p_size AS v FROM part WHERE p_partkey NOT IN (SELECT 2 * p_partkey FROM part) UNION ALL SELECT 2 * p_partkey, 0 FROM part")
def upsert_rows(spark, d):
    """DML-05, API-02."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    return rel.upsert(p, p.select((2 * F.col("id")).alias("id"), F.lit(0).alias("v")), ["id"])


@query("cascade_delete", "SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)) GROUP BY 1")
def cascade_delete(spark, d):
    """DML-06: customer, order, line."""
    c = table(spark, d, "customer").where("c_nationkey <> 7")
    o = rel.cascade_delete(table(spark, d, "orders"), c, "o_custkey", "c_custkey")
    return rel.cascade_delete(table(spark, d, "lineitem"), o, "l_orderkey", "o_orderkey").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("backup_import", "SELECT count(*) FILTER (WHERE 3 * p_partkey NOT IN (SELECT p_partkey FROM part)) AS added, count(*) FILTER (WHERE 3 * p_partkey IN (SELECT p_partkey FROM part)) AS skipped FROM part")
def backup_import(spark, d):
    """DML-07, SRC-06, API-04: merged by natural key, with counts."""
    from ..sources.backup import import_merge

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("key"), "p_name")
    incoming = p.withColumns({"id": F.col("id") + 10**12, "key": 3 * F.col("key")})
    return import_merge(p, incoming, "id", ["key"])[2]


@query("backup_lines", """SELECT 'nation' AS "table", n_nationkey AS k FROM nation UNION ALL SELECT 'region', r_regionkey FROM region UNION ALL SELECT '_header', 2""")
def backup_lines(spark, d):
    """SRC-04, SRC-05: rows as JSON lines under a versioned header."""
    from ..sources.backup import export_lines

    lines = export_lines({"nation": table(spark, d, "nation"), "region": table(spark, d, "region")})
    k = F.coalesce(F.get_json_object("line", "$.n_nationkey"), F.get_json_object("line", "$.r_regionkey"), F.get_json_object("line", "$.version"))
    return lines.select("table", k.cast("int").alias("k"))


@query("topic_card_refresh", """WITH l AS (SELECT o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_id, count(*) AS papers FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey AS id, last_id, coalesce(papers, 0) AS papers FROM customer LEFT JOIN l ON l.id = c_custkey""")
def topic_card_refresh(spark, d):
    """DML-09, RMD-03: the card of the latest done search, empty if there is none."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_id"), F.count(F.lit(1)).alias("papers"))
    return table(spark, d, "customer").join(done, "c_custkey", "left").select(F.col("c_custkey").alias("id"), "last_id", F.coalesce("papers", F.lit(0)).alias("papers"))


@query("guarded_delete", "SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS refused FROM customer")
def guarded_delete(spark, d):
    """DML-10, API-06: refused while a search of the topic is active."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("topic_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    free, refused = entities.delete_guarded(table(spark, d, "customer").select(F.col("c_custkey").alias("topic_id")), o)
    return free.select(F.col("topic_id").alias("id"), F.lit(False).alias("refused")).union(refused.select("topic_id", F.lit(True)))


@query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    """Constraints of the data model as a query that should be empty."""
    return entities.violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("exact_name_matches", "SELECT a.c_custkey AS id, b.s_suppkey AS other FROM customer a JOIN supplier b ON replace(lower(a.c_name), 'customer', '') = replace(lower(b.s_name), 'supplier', '')")
def exact_name_matches(spark, d):
    """AUX-16, STR-F15."""
    key = lambda c, w: F.trim(F.replace(F.lower(c), F.lit(w), F.lit("")))
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), key("c_name", "customer").alias("_k"))
    return a.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("other"), key("s_name", "supplier").alias("_k")), "_k").select("id", "other")
