"""Payloads of outside sources, and work in batches, over the driver's tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import ids, vectors
from ..operators import batches, entities, vector_search
from ..sources import records
from ..tables import shared_folder, table
from .registry import query


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_NUMBER = "lpad(CAST(p_partkey AS VARCHAR), 7, '0')"


@query("atom_entries", f"""WITH e AS (SELECT *, p_partkey // 10 AS feed, CASE WHEN p_size % 11 = 0 THEN 'error' WHEN p_size % 7 = 0 THEN 'dropped' ELSE 'paper' END AS kind FROM part)
    SELECT p_partkey AS id, kind, CASE WHEN kind = 'paper' THEN CAST(feed * 10 + sum(CASE WHEN kind = 'paper' THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY p_partkey) AS INTEGER) END AS rank,
        CASE WHEN kind <> 'error' THEN 'cs/' || {_NUMBER} END AS arxiv_id, CASE WHEN kind <> 'error' THEN p_size % 3 + 1 END AS version, CASE WHEN kind <> 'dropped' THEN p_name END AS title FROM e""")
def atom_entries(spark, d):
    """SRC-08: feeds of ten entries; entries that report an error or lack a title take no rank."""
    p = table(spark, d, "part")
    number = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    link = F.when(F.col("p_size") % 11 == 0, F.concat(F.lit("http://arxiv.org/api/errors#"), number)).otherwise(F.concat(F.lit("http://arxiv.org/abs/cs/"), number, F.lit("v"), (F.col("p_size") % 3 + 1).cast("string")))
    title = F.when((F.col("p_size") % 7 == 0) & (F.col("p_size") % 11 != 0), F.lit(" ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" \n ")))
    entry = F.concat(F.lit("<entry><id>"), link, F.lit("</id><title>"), title, F.lit("</title><summary>"), F.col("p_partkey").cast("string"), F.lit("</summary><author><name>A B</name></author></entry>"))
    feeds = p.groupBy(F.floor(F.col("p_partkey") / 10).alias("feed")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", entry.alias("e")))).alias("es"))  # ten in a feed
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><startIndex>'), (F.col("feed") * 10).cast("string"), F.lit("</startIndex>"), F.array_join("es.e", ""), F.lit("</feed>"))
    return records.parse_atom(feeds.select(xml.alias("xml"))).select(F.col("abstract").cast("long").alias("id"), "kind", "rank", "arxiv_id", "version", "title")


@query("atom_single", f"SELECT p_partkey AS id, 'cs/' || {_NUMBER} AS arxiv_id, 'Title: ' || p_name || chr(10) || 'Authors: A B' || chr(10) || chr(10) || 'Abstract:' || chr(10) || p_type AS t FROM part")
def atom_single(spark, d):
    """SRC-31: the one entry of a feed, laid out as text."""
    from ..sources import web

    number = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    xml = F.concat(F.lit("<feed><entry><id>http://arxiv.org/abs/cs/"), number, F.lit("v1</id><title>"), "p_name", F.lit("</title><summary>"), "p_type", F.lit("</summary><author><name>A B</name></author></entry></feed>"))
    one = records.parse_atom(table(spark, d, "part").select(xml.alias("xml"))).where("kind = 'paper'")
    layout = web.seed_text(F.col("title"), F.col("authors"), F.lit(None).cast("string"), F.col("abstract"))
    return one.select(F.substring("arxiv_id", 4, 7).cast("long").alias("id"), "arxiv_id", layout.alias("t"))


@query("s2_records", """SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN '10.1000/x' || p_partkey END AS doi, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN 'J. ' || p_type END AS venue,
    CASE WHEN p_size % 5 = 0 THEN 1990 + p_size ELSE 2001 END AS year, CASE WHEN p_size % 4 = 0 THEN 'https://x.org/' || p_partkey || '.pdf' END AS pdf_url, CAST(p_size AS BIGINT) AS cites, CAST(p_size % 9 + 3 AS BIGINT) AS max_h FROM part WHERE p_size % 10 <> 9""")
def s2_records(spark, d):
    """SRC-17, STR-F09: records with ids of any case, venues in several places, untitled ones dropped."""
    p = table(spark, d, "part")
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    author = lambda name, h: F.struct(F.lit(name).alias("name"), F.lit("7").alias("authorId"), h.cast("long").alias("hIndex"))
    payload = F.struct(
        key.alias("paperId"), F.when(size % 10 == 9, " ").otherwise(F.concat(F.lit("  "), "p_name")).alias("title"), F.when(size % 3 == 0, F.col("p_brand")).alias("venue"), F.when(size % 5 == 0, 1990 + size).alias("year"),
        F.lit("2001-05-06").alias("publicationDate"), F.create_map(F.when(size % 4 == 0, "doi").otherwise("DOI"), F.when(size % 2 == 0, F.concat(F.lit("https://doi.org/10.1000/X"), key))).alias("externalIds"),
        F.struct(F.when(size % 3 == 1, F.concat(F.lit("J. "), "p_type")).alias("name")).alias("journal"), F.struct(F.when(size % 4 == 0, F.concat(F.lit("https://x.org/"), key, F.lit(".pdf"))).otherwise("n/a").alias("url")).alias("openAccessPdf"),
        size.cast("long").alias("citationCount"), F.array(author("A", size % 9), author("B", size % 9 + 3), author(" ", size + 99)).alias("authors"),
    )
    return records.parse_s2(p.select(F.to_json(payload).alias("json"))).select(F.col("s2_id").cast("long").alias("id"), "title", "doi", "venue", "year", "pdf_url", "cites", "max_h")


@query("openalex_records", """SELECT p_partkey AS id, 'W' || p_partkey AS openalex_id, p_name AS title, CASE p_size % 3 WHEN 0 THEN '2401.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') WHEN 1 THEN 'cs/' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS arxiv_id,
    CASE WHEN p_size % 4 = 0 THEN 'https://x.org/best.pdf' WHEN p_size % 4 = 1 THEN 'https://x.org/other.pdf' WHEN p_size % 3 = 0 THEN 'https://arxiv.org/pdf/2401.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') WHEN p_size % 3 = 1 THEN 'https://arxiv.org/pdf/cs/' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS pdf_url,
    'deep graphs of ' || p_size AS abstract, 'A' || p_size AS author FROM part""")
def openalex_records(spark, d):
    """SRC-19, SRC-20, STR-F10: arXiv ids from the DOI or any location, a chain of PDF addresses, abstracts from word places."""
    p = table(spark, d, "part")
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    null = F.lit(None).cast("string")
    place = lambda page, pdf: F.struct(page.alias("landing_page_url"), pdf.alias("pdf_url"))
    landing = F.when(size % 3 == 1, F.concat(F.lit("http://arxiv.org/abs/cs/"), F.lpad(key, 7, "0"), F.lit("v2"))).otherwise("https://x.org/page")
    words = F.map_from_arrays(F.array(F.lit("of"), F.lit("deep"), size.cast("string"), F.lit("graphs")), F.array(F.array(F.lit(2)), F.array(F.lit(0)), F.array(F.lit(3)), F.array(F.lit(1))))
    payload = F.struct(
        F.concat(F.lit("https://openalex.org/w"), key).alias("id"), F.lit(" ").alias("title"), F.col("p_name").alias("display_name"),
        F.when(size % 3 == 0, F.concat(F.lit("https://doi.org/10.48550/arXiv.2401."), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"))).alias("doi"), words.alias("abstract_inverted_index"),
        place(F.lit("https://x.org/first"), null).alias("primary_location"), place(null, F.when(size % 4 == 0, "https://x.org/best.pdf").otherwise("ftp://x")).alias("best_oa_location"),
        F.array(place(landing, F.when(size % 4 == 1, "https://x.org/other.pdf"))).alias("locations"), F.array(F.struct(null.alias("raw_author_name"), F.struct(F.concat(F.lit("https://openalex.org/A"), size.cast("string")).alias("id"), F.lit("N N").alias("display_name")).alias("author"))).alias("authorships"),
    )
    out = records.parse_openalex(p.select(F.to_json(payload).alias("json")))
    return out.select(F.substring("openalex_id", 2, 20).cast("long").alias("id"), "openalex_id", "title", "arxiv_id", "pdf_url", "abstract", F.col("authors")[0]["openalex_id"].alias("author"))


@query("works_by_doi", "SELECT '10.1000/' || k AS doi, min(p_partkey) AS id, max(p_partkey) AS last FROM (SELECT p_partkey, p_partkey % 700 AS k FROM part) JOIN (SELECT DISTINCT s_suppkey AS w FROM supplier) ON w = k GROUP BY k")
def works_by_doi(spark, d):
    """SRC-18: works of the DOIs asked for, whatever their form, the first of each."""
    works = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ids.doi(F.concat(F.lit("HTTPS://doi.org/10.1000/"), (F.col("p_partkey") % 700).cast("string"))).alias("doi"))
    asked = table(spark, d, "supplier").select(ids.doi(F.concat(F.lit("doi:10.1000/"), F.col("s_suppkey").cast("string"), F.lit("?x=1"))).alias("doi")).distinct()
    return works.join(asked, "doi", "left_semi").groupBy("doi").agg(F.min("id").alias("id"), F.max("id").alias("last"))


@query("paged_search", "SELECT id, n, (n - 1) // 100 * 100 AS page_offset FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE contains(text, 'tion')) WHERE n <= 250")
def paged_search(spark, d):
    """SRC-12: pages of a hundred until the limit."""
    hits = table(spark, d, "documents").where(F.contains("text", F.lit("tion"))).select(F.col("doc_id").alias("id"), "n_chars")
    return batches.paged(hits, 100, 250, F.desc("n_chars"), F.col("id")).select("id", "n", "page_offset")


@query("vector_blobs", "SELECT vec_id AS id, CAST(4 * len(embedding) AS INTEGER) AS bytes, CAST(0 AS DOUBLE) AS lost FROM embeddings")
def vector_blobs(spark, d):
    """SRC-07: vectors as little-endian bytes and back, without loss."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", vectors.to_blob(F.col("embedding")).alias("b"))
    back = e.select("id", F.octet_length("b").alias("bytes"), "embedding", vectors.from_blob(F.col("b")).alias("v"))
    return back.select("id", "bytes", F.aggregate(F.zip_with("embedding", "v", lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x).alias("lost"))


@query("merged_authors", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'Zoë Ny:9:s2' ELSE 'zoe ny:' || greatest(p_size % 7, 9) || ':s1;Ann Li:' || p_size % 5 || ':' END AS authors FROM part")
def merged_authors(spark, d):
    """ARR-02: the stored order, gaps filled from the record that comes, by normalised name."""
    p = table(spark, d, "part")
    size = F.col("p_size")
    one = lambda name, s2, h: F.struct(F.lit(name).alias("name"), F.lit(s2).cast("string").alias("s2_id"), h.cast("int").alias("h"))
    old = F.when(size % 3 != 0, F.array(one("zoe ny", "s1", size % 7), one("Ann Li", None, size % 5)))
    new = F.array(one("Zoë Ny", "s2", F.lit(9)))
    said = F.transform(entities.merge_authors(old, new), lambda a: F.concat(a["name"], F.lit(":"), a["h"].cast("string"), F.lit(":"), F.coalesce(a["s2_id"], F.lit(""))))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(said, ";").alias("authors"))


@query("embed_missing", """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE CAST(length(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 2000)) AS BIGINT) END AS first FROM documents""")
def embed_missing(spark, d):
    """RNK-11, DML-13: only rows without a vector are embedded, from at most 2000 characters."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>")).alias("embedding"))
    out = vector_search.embed_missing(t, lambda texts: [[float(len(x)), 1.0] for x in texts])
    return out.select("id", F.col("embedding")[0].cast("long").alias("first"))


@query("source_fallback", """WITH q AS (SELECT n_nationkey AS query FROM nation), o AS (SELECT query, 'a' AS source FROM q WHERE query % 2 = 0 UNION ALL SELECT query, 'b' FROM q WHERE query % 3 = 0),
    h AS (SELECT s_nationkey AS query, 'a' AS source, s_suppkey AS id FROM supplier UNION ALL SELECT s_nationkey, 'b', s_suppkey + 1000000 FROM supplier UNION ALL SELECT s_nationkey, 'c', s_suppkey + 2000000 FROM supplier)
    SELECT source, count(*) AS hits, max((SELECT count(*) FROM o WHERE o.source = h.source)) AS failures FROM h WHERE CASE source WHEN 'a' THEN query % 2 <> 0 WHEN 'b' THEN query % 3 <> 0 ELSE query % 6 = 0 END GROUP BY source""")
def source_fallback(spark, d):
    """AUX-19: a third source for the queries that both others fail, and failures by source."""
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("query"))
    down = q.where("query % 2 = 0").select("query", F.lit("a").alias("source")).union(q.where("query % 3 = 0").select("query", F.lit("b")))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("query"), F.posexplode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("k", "source"), F.col("s_suppkey"))
    hits = s.select("query", "source", (F.col("s_suppkey") + F.col("k") * 1000000).alias("id"))
    found, failures = batches.collect_with_fallback(q, hits, down, ("a", "b"), "c")
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("hits")).join(failures, "source", "left").select("source", "hits", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))


@query("retried_batches", """WITH b AS (SELECT c_custkey // 5 AS batch, count(*) AS n, count(*) FILTER (WHERE c_custkey % 13 = 0) AS bad FROM customer GROUP BY 1)
    SELECT batch, CASE WHEN bad = 0 THEN 1 ELSE 2 + n END AS calls, n - bad AS done, bad AS failed FROM b""")
def retried_batches(spark, d):
    """AUX-10, AUX-22: a batch is tried twice, then its rows one by one."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["id"] % 13 == 0).any():
            raise ValueError("a bad row")
        return rows

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 5).alias("batch"))
    return batches.run_batches(c, work, "batch long, calls long, done long, failed long")


@query("chunked_writes", "SELECT chunk, count(*) AS n, min(id) AS first FROM (SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 200 AS chunk FROM orders) GROUP BY chunk")
def chunked_writes(spark, d):
    """DML-11: chunks of two hundred rows, each written whole."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    out = batches.write_chunks(o, _folder(spark, "chunks"), 200, "id")
    return out.groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query("resumed_stage", "SELECT r_regionkey AS part, count(*) AS n, CAST(1 AS BIGINT) AS runs FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def resumed_stage(spark, d):
    """STR-06, API-08: a stage that is stopped after two parts and resumed does each part once."""
    nations = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    runs: dict[int, int] = {}

    def work(part):
        runs[part] = runs.get(part, 0) + 1
        return rows.where(F.col("n_regionkey") == part).agg(F.count(F.lit(1)).alias("n"))

    parts = [r["r_regionkey"] for r in table(spark, d, "region").orderBy("r_regionkey").collect()]  # five regions
    folder = _folder(spark, "stage")
    batches.run_stage(spark, folder, parts, work, stop=lambda: len(runs) == 2)
    out = batches.run_stage(spark, folder, parts, work)
    times = spark.createDataFrame(list(runs.items()), "part int, runs long")
    return out.join(times, "part").select("part", "n", "runs")


@query("foreign_requests", """SELECT event_id AS id, event_type IN ('purchase', 'signup') AND CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE user_id % 2 = 1 END AS refused FROM events""")
def foreign_requests(spark, d):
    """AUX-23: requests that change something and come from another site."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    method = F.when(F.col("event_type") == "purchase", "post").when(F.col("event_type") == "signup", "PATCH").otherwise("GET")
    site = F.when(k == 0, "same-origin").when(k == 1, "Cross-Site")
    origin = F.when(k == 3, F.when(F.col("user_id") % 2 == 1, "http://evil.example").otherwise("http://LOCALHOST:3000"))
    return e.select(F.col("event_id").alias("id"), batches.foreign_request(method, site, origin, F.lit("localhost:3000")).alias("refused"))


@query("entries_patched", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 'PATCHED' ELSE c_mktsegment END AS category, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_name END AS title, CASE WHEN c_custkey % 3 = 2 THEN 'pending' ELSE 'done' END AS status FROM customer WHERE c_nationkey <> 3")
def entries_patched(spark, d):
    """API-02: given fields replace stored ones, deleted entries go, reingested ones start anew."""
    from ..operators import relational as rel

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("title"), F.lit("done").alias("status"), "c_nationkey")
    patches = c.where("id % 3 = 1").select("id", F.lit("PATCHED").alias("category"), F.lit(None).cast("string").alias("title"))
    kept = rel.update_where_given(c, patches, ["id"], ["category", "title"]).join(c.where("c_nationkey = 3").select("id"), "id", "left_anti")
    anew = F.col("id") % 3 == 2
    return kept.select("id", "category", F.when(~anew, F.col("title")).alias("title"), F.when(anew, "pending").otherwise(F.col("status")).alias("status"))


@query("capped_bytes", "SELECT page_id AS id, CAST(least(strlen(html), 4096) AS INTEGER) AS bytes, strlen(html) > 4096 AS refused FROM pages")
def capped_bytes(spark, d):
    """SRC-24: at most so many bytes of a payload are read; a longer one is refused."""
    p = table(spark, d, "pages")
    size = F.octet_length("html")
    head = F.substring(F.col("html").cast("binary"), 1, 4096)
    return p.select(F.col("page_id").alias("id"), F.octet_length(head).alias("bytes"), (size > 4096).alias("refused"))


@query("capabilities", "SELECT (SELECT count(*) > 0 FROM embeddings) AS vectors, (SELECT count(*) > 0 FROM pages) AS pages, (SELECT count(*) FROM documents WHERE false) > 0 AS fulltext")
def capabilities(spark, d):
    """API-10: which parts of the engine have data to work on."""
    has = lambda df: F.lit(not df.isEmpty())
    return spark.range(1).select(has(table(spark, d, "embeddings")).alias("vectors"), has(table(spark, d, "pages")).alias("pages"), has(table(spark, d, "documents").where("text IS NULL")).alias("fulltext"))


@query("author_h_index", "SELECT s_name AS name, CAST(max(l_linenumber) AS BIGINT) AS h FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_name")
def author_h_index(spark, d):
    """SRC-18: the highest h-index that the source gives for a name."""
    line = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_linenumber").cast("long").alias("h"))
    s = table(spark, d, "supplier")
    return s.join(line, s["s_suppkey"] == line["l_suppkey"]).groupBy(F.col("s_name").alias("name")).agg(F.max("h").alias("h"))


