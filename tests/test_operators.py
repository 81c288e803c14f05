"""Operators on hand-made rows: goldens, invariants, order independence."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import changes, clustering, entities, graph, ranking, readmodels, relational
from tessera.operators import prose as prose_refs
from tessera.sources import backup, records, web


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_bm25f(spark):
    docs = rows(spark, "id string, title string, abstract string", ("d1", "graph neural", "graph data"), ("d2", "image vision", "image segmentation"), ("d3", "neural network", "graph graph network"))
    got = {r["id"]: r["score"] for r in ranking.bm25f(docs, "graph").collect()}
    assert got["d1"] == pytest.approx(0.339447, abs=1e-6) and got["d3"] == pytest.approx(0.271903, abs=1e-6) and got["d2"] == 0
    assert {r["id"]: r["score"] for r in ranking.bm25f(docs, "network", "network").collect()}["d3"] < 0


def test_rrf(spark):
    lists = rows(spark, "list int, pos int, id string", (0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "b"), (1, 2, "a"), (1, 3, "a"))
    got = ranking.rrf(lists).orderBy(F.desc("score"), "first_list", "first_pos").collect()
    assert [r["id"] for r in got] == ["a", "b", "c"] and got[0]["score"] == pytest.approx(1 / 61 + 1 / 62) and got[2]["score"] == pytest.approx(1 / 63)


@pytest.mark.parametrize(("values", "want"), [([10, None, 20, 20, 30], [0, 0, 0.5, 0.5, 1]), ([5, 5, 5], [0.5] * 3), ([None, 7], [0, 1])])
def test_percentile_rank(spark, values, want):
    df = rows(spark, "i int, v double", *[(i, None if v is None else float(v)) for i, v in enumerate(values)])
    assert [r["p"] for r in relational.percentile_rank(df, "v", "p").orderBy("i").collect()] == want


def selection_rows(spark, *data):
    schema = "search_id int, id string, rerank double, rrf double, cites int, published_at timestamp, embedding array<double>, title string, pos int"
    base = {"rerank": None, "rrf": 0.0, "cites": None, "published_at": None, "embedding": None, "title": None}
    full = [base | d | {"search_id": 1, "pos": i} for i, d in enumerate(data)]
    return spark.createDataFrame([tuple(pd.Timestamp(d[c]).to_pydatetime() if c == "published_at" and d[c] else d[c] for c in ("search_id", "id", "rerank", "rrf", "cites", "published_at", "embedding", "title", "pos")) for d in full], schema)


def picked(df, **slots):
    got = ranking.select_papers(df, "2026-01-01", **({"foundational": 0, "frontier": 0} | slots)).orderBy("final_rank").collect()
    return [r["id"] for r in got if r["selected"]], {r["id"]: r["reason"] for r in got}


def test_selection_reserves(spark):
    df = selection_rows(
        spark,
        {"id": "hot", "rerank": 0.9, "cites": 1, "published_at": "2024-06-01"},
        {"id": "classic", "rerank": 0.8, "cites": 5000, "published_at": "2015-01-01"},
        {"id": "fresh", "rerank": 0.85, "cites": 0, "published_at": "2025-12-01"},
        {"id": "off", "rerank": 0.1, "cites": 90000, "published_at": "2010-01-01"},
        {"id": "late", "rrf": 0.5},
    )
    chosen, why = picked(df, count=3, foundational=1, frontier=1)
    assert set(chosen) == {"hot", "classic", "fresh"} and why["classic"] == "foundational" and why["fresh"] == "frontier" and why["hot"] == "fill"
    assert picked(df, count=5)[1]["late"] == "leftover"


def test_selection_skips_duplicates_and_spreads(spark):
    df = selection_rows(
        spark,
        {"id": "a", "rerank": 0.9, "embedding": [1.0, 0.0], "title": "Same title"},
        {"id": "b", "rerank": 0.89, "embedding": [1.0, 0.01], "title": "Other"},
        {"id": "c", "rerank": 0.5, "embedding": [0.0, 1.0], "title": "same  TITLE!"},
        {"id": "d", "rerank": 0.80, "embedding": [0.9, 0.43589], "title": "Near"},
        {"id": "e", "rerank": 0.75, "embedding": [0.0, 1.0], "title": "Far"},
    )
    chosen, why = picked(df, count=2)
    assert chosen == ["a", "e"] and why["b"] == why["c"] == "duplicate"


def test_pagerank(spark):
    nodes = rows(spark, "id string", *[(x,) for x in "abcd"])
    edges = rows(spark, "src string, dst string", ("a", "b"), ("a", "b"), ("c", "b"), ("b", "b"), ("z", "a"), ("b", "d"))
    got = {r["id"]: r["rank"] for r in graph.pagerank(nodes, edges, tolerance=1e-6).collect()}
    assert sum(got.values()) == pytest.approx(1) and max(got, key=got.get) in "bd"
    m = {"a": ["b"], "c": ["b"], "b": ["d"], "d": []}
    r = dict.fromkeys("abcd", 0.25)
    for _ in range(60):
        lost = sum(r[n] for n in m if not m[n])
        r = {n: 0.15 / 4 + 0.85 * lost / 4 + 0.85 * sum(r[s] / len(m[s]) for s in m if n in m[s]) for n in m}
    assert got == pytest.approx(r, abs=1e-5)
    flat = graph.pagerank(nodes, edges.where("src = 'none'")).collect()
    assert all(x["rank"] == pytest.approx(0.25) for x in flat)


def test_build_edges(spark):
    scope = rows(spark, "id string, embedding array<double>", ("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [0.1, 0.9]), ("e", [-1.0, 0.0]))
    cites = rows(spark, "citing string, cited string, influential boolean", ("a", "e", False), ("a", "c", False), ("a", "c", True), ("d", "c", False), ("x", "a", True), ("b", "b", True))
    got = {(r["source"], r["target"], r["kind"]) for r in graph.build_edges(scope, cites).collect()}
    assert got == {("a", "e", "cites"), ("a", "c", "builds_on"), ("d", "c", "builds_on"), ("a", "b", "similar")}


def test_influence_drops_missing_signals(spark):
    df = rows(spark, "id string, cites int, velocity double, influential int, pagerank double, h_index int", ("a", 1, None, None, None, None), ("b", 5, None, None, None, None), ("c", 9, None, None, None, None))
    assert {r["id"]: r["influence"] for r in ranking.influence(df).collect()} == {"a": 0, "b": 0.5, "c": 1}


def test_game_changers(spark):
    df = rows(spark, "id string, cites int, velocity double, pagerank double", ("low", 1, 0.0, 0.9), ("m1", 10, 1.0, 0.1), ("m2", 20, 2.0, 0.2), ("none", None, 9.0, 0.9), ("top", 30, 3.0, 0.3))
    assert [r["id"] for r in ranking.game_changers(df).collect()] == ["top", "m2", "m1"]


def blobs(k, per=12, dim=16, seed=1):
    r = np.random.default_rng(seed)
    c = np.eye(dim)[:k]
    return np.concatenate([c[i] + r.normal(0, 0.1, (per, dim)) for i in range(k)]), np.repeat(np.arange(k), per)


@pytest.mark.parametrize("k", [3, 5])
def test_kmeans_recovers_blobs(spark, k):
    x, truth = blobs(k)
    labels, _ = clustering.kmeans(x, k)
    assert len({(a, b) for a, b in zip(labels, truth, strict=True)}) == k
    chosen, score = clustering.choose_k(x, 2, 7)
    assert chosen.max() + 1 == k and score > 0.5
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "search_id int, id int, embedding array<double>").repartition(3)
    got = clustering.cluster(df, 2, 7).orderBy("id").collect()
    assert [r["cluster"] for r in got] == chosen.tolist()


def test_small_clusters_merge():
    x, truth = blobs(3)
    labels = truth.copy()
    labels[0] = 7
    merged = clustering.merge_small(x, labels)
    assert merged.max() == 2 and merged[0] == merged[1]


def test_silhouette(spark):
    at = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    df = rows(spark, "id int, cluster int, embedding array<double>", (0, 0, at(0)), (1, 0, at(10)), (2, 1, at(90)))
    d = lambda a, b: 1 - np.cos(np.radians(a - b))
    want = [(d(0, 90) - d(0, 10)) / d(0, 90), (d(10, 90) - d(0, 10)) / d(10, 90), 0.0]
    assert [r["silhouette"] for r in clustering.silhouette(df).orderBy("id").collect()] == pytest.approx(want)
    assert clustering.silhouette_of(np.array([at(0), at(10), at(90)]), np.array([0, 0, 1])) == pytest.approx(sum(want) / 3)


def test_key_terms(spark):
    docs = rows(spark, "id int, cluster int, text string", (1, 0, "Graph neural networks"), (2, 0, "Deep graph neural networks for molecules"), (3, 0, "A graph neural study"), (4, 1, "Image segmentation"), (5, 1, "Medical image segmentation"), (6, 1, "Image segmentation with the transformer"))
    terms = {r["cluster"]: r["terms"] for r in clustering.key_terms(clustering.class_tf_idf(docs)).collect()}
    assert terms[0][:2] == ["graph neural", "neural networks"] and terms[1][0] == "image segmentation"
    assert clustering.placeholder_label(terms[0]) == "Graph neural" or " / " in clustering.placeholder_label(terms[0])


@pytest.mark.parametrize(
    ("base", "current", "want"),
    [
        ({0: "abcd", 1: "wxyz"}, {0: "abcd", 1: "wxyz"}, ["stable", "stable"]),
        ({0: "abcd"}, {0: "abcdef"}, ["grew"]),
        ({0: "abcdef"}, {0: "abcd"}, ["shrank"]),
        ({0: "abcd"}, {0: "abcd", 1: "mnop"}, ["stable", "new"]),
        ({0: "abcd", 1: "wxyz"}, {0: "abcd"}, ["stable", "gone"]),
        ({0: "abcdefgh"}, {0: "abcd", 1: "efgh"}, ["split", "split"]),
        ({0: "abcd", 1: "efgh"}, {0: "abcdefgh"}, ["merged"]),
    ],
)
def test_cluster_changes(spark, base, current, want):
    def frame(c):
        vec = {x: i for i, x in enumerate("abcdefghmnopwxyz")}
        data = []
        for k, members in c.items():
            v = [0.0] * 16
            for m in members:
                v[vec[m]] = 1.0
            data.append((k, v, list(members)))
        return spark.createDataFrame(data, "cluster int, centroid array<double>, members array<string>")

    got = clustering.match_clusters(frame(base), frame(current)).orderBy(F.col("cluster").asc_nulls_last()).collect()
    assert [r["change"] for r in got] == want


def test_changes(spark):
    a = rows(spark, "id string, rank int, cites int", ("x", 1, 5), ("y", 2, 8), ("z", 3, 1))
    b = rows(spark, "id string, rank int, cites int", ("x", 1, 15), ("y", 2, 9), ("w", 3, 50))
    assert {(r["id"], r["change"]) for r in changes.new_and_dropped(a, b).collect()} == {("w", "new"), ("z", "dropped")}
    assert [(r["id"], r["delta"]) for r in changes.rising(a, b).collect()] == [("x", 10)]


def test_entity_resolution(spark):
    schema = "id long, title string, s2_id string, doi string, arxiv_id string, openalex_id string, abstract string, year int, cites int, first_author string, source string"
    t = "Attention is all you need"
    data = [
        (1, t, "s1", None, None, None, None, 2017, 5, "Vaswani, Ashish", "s2"),
        (2, "Other words for a title", None, "10.48550/arXiv.1706.03762", None, None, "arXiv text", 2017, None, "X", "arxiv"),
        (3, "Third", "s1", None, "1706.03762v5", None, "s2 text that is longer", 2018, 9, "A. Vaswani", "s2"),
        (4, t.upper() + "!", None, "10.1000/x", None, None, None, 2018, 7, "Ashish Vaswani", "s2"),
        (5, t, None, "10.1000/y", "9999.00001", None, None, 2017, 1, "Ashish Vaswani", "s2"),
        (6, "Too short", None, None, None, None, None, 2017, 1, "A", "s2"),
        (7, "Too short", None, None, None, None, None, 2017, 1, "A", "s2"),
        (8, "  ", "s1", None, None, None, None, None, None, None, "s2"),
    ]
    recs = entities.normalize_records(spark.createDataFrame(data, schema))
    found = {r["id"]: r["keeper"] for r in entities.resolve(recs).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7}
    merged = {r["keeper"]: r for r in entities.merge_records(recs, entities.resolve(recs)).collect()}
    assert merged[1]["cites"] == 9 and merged[1]["arxiv_id"] == "1706.03762" and merged[1]["doi"] == "10.1000/x" and merged[1]["abstract"] == "arXiv text" and merged[1]["merged"] == 4


def test_components_of_a_long_chain(spark):
    n = 200
    got = entities.components(spark.range(n), spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b"))
    assert got.where("keeper <> 0").isEmpty()


def test_merge_authors(spark):
    kind = "array<struct<name:string,s2_id:string,h:int>>"
    df = spark.createDataFrame([([("Ann Lee", None, 3), ("Bo", "b", None)], [("ann  lee", "a1", 9), ("New", "n", 1)])], f"x {kind}, y {kind}")
    got = df.select(entities.merge_authors(F.col("x"), F.col("y")).alias("m")).first()["m"]
    assert [tuple(a) for a in got] == [("Ann Lee", "a1", 9), ("Bo", "b", None)]


def test_round_robin(spark):
    df = rows(spark, "list int, rank int, id string", (0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "a"), (1, 2, "d"), (1, 3, "e"))
    assert [r["id"] for r in relational.round_robin(df, "list", "rank", "id", 4).orderBy("position").collect()] == ["a", "d", "b", "e"]


@pytest.mark.parametrize(
    ("prose", "want"),
    [
        ("See (P1, P2) here.", "See (Smith 2020; Lee 2021) here."),
        ("P1-P3 agree.", "Smith 2020, Lee 2021, and Ray 2022 agree."),
        ("An A100 beats a P100.", "An A100 beats a P100."),
        ("On P1 GPUs it runs.", "On P1 GPUs it runs."),
        ("P1 extends P2.", "Smith 2020 extends Lee 2021."),
        ("P1's result holds.", "Smith 2020's result holds."),
        ("In cluster C0, more.", "In cluster Graphs, more."),
        ("A claim (P99).", "A claim."),
        ("A lone P2 stays.", "A lone P2 stays."),
    ],
)
def test_prose_refs(prose, want):
    papers, clusters = {1: "Smith 2020", 2: "Lee 2021", 3: "Ray 2022"}, {0: "Graphs"}
    got = prose_refs.rewrite_refs(prose, papers, clusters)
    assert got == want and prose_refs.rewrite_refs(got, papers, clusters) == got


def test_pack_lane_has_no_overlap():
    r = np.random.default_rng(0)
    items = [{"id": i, "x": float(r.uniform(0, 200)), "t": 0.0, "r": float(r.uniform(6, 12)), "influence": float(r.random())} for i in range(40)]
    out = {o["id"]: o for o in readmodels.pack_lane(items, 60.0)}
    put = [(i["x"] + out[i["id"]]["dx"], out[i["id"]]["dy"], i["r"]) for i in items if not out[i["id"]]["overflow"]]
    assert put and all((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 >= (a[2] + b[2]) ** 2 for k, a in enumerate(put) for b in put[:k])


def test_record_parsers(spark):
    s2 = {"paperId": "p", "title": " A  title ", "externalIds": {"arxiv": "2401.01234", "DOI": "10.1000/X"}, "authors": [{"name": "Ann", "authorId": "1", "hIndex": 4}, {"name": " "}, {"name": "Bo", "hIndex": 9}], "publicationDate": "2024-02-01", "venue": "", "journal": {"name": "J"}, "openAccessPdf": {"url": "ftp://x"}, "citationCount": 7}
    r = records.parse_s2(rows(spark, "json string", (json.dumps(s2),), ("{}",), ("not json",))).collect()
    assert len(r) == 1 and (r[0]["title"], r[0]["arxiv_id"], r[0]["doi"], r[0]["year"], r[0]["venue"], r[0]["pdf_url"], r[0]["max_h"]) == ("A title", "2401.01234", "10.1000/x", 2024, "J", None, 9)
    oa = {"id": "https://openalex.org/W5", "display_name": "T", "abstract_inverted_index": {"world": [1], "hello": [0, 2]}, "locations": [{"landing_page_url": "https://arxiv.org/abs/2401.01234v2"}], "authorships": [{"author": {"id": "https://openalex.org/A7", "display_name": "Ann"}}], "publication_year": 2020, "cited_by_count": 3}
    w = records.parse_openalex(rows(spark, "json string", (json.dumps(oa),))).first()
    assert (w["openalex_id"], w["arxiv_id"], w["abstract"], w["pdf_url"], w["authors"][0]["openalex_id"]) == ("W5", "2401.01234", "hello world hello", "https://arxiv.org/pdf/2401.01234", "A7")


def test_atom_feed(spark):
    xml = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/" xmlns:arxiv="http://arxiv.org/schemas/atom"><opensearch:totalResults>3</opensearch:totalResults><opensearch:startIndex>10</opensearch:startIndex>
    <entry><id>http://arxiv.org/abs/2401.01234v2</id><title>First
    paper</title><summary>Text</summary><published>2024-01-02T00:00:00Z</published><author><name>Ann</name></author><author><name>Bo</name></author><arxiv:doi>10.1000/Z</arxiv:doi><category term="cs.LG"/><category term="cs.LG"/></entry>
    <entry><id>http://arxiv.org/api/errors#x</id><title>Error</title><summary>bad</summary></entry><entry><id>http://arxiv.org/abs/2401.00002v1</id><title>Second</title></entry></feed>"""
    got = records.parse_atom(rows(spark, "xml string", (xml,))).collect()
    assert [(r["kind"], r["rank"], r["arxiv_id"], r["title"]) for r in got] == [("paper", 11, "2401.01234", "First paper"), ("error", None, None, "Error"), ("paper", 12, "2401.00002", "Second")]
    assert got[0]["authors"] == ["Ann", "Bo"] and got[0]["doi"] == "10.1000/z" and got[0]["version"] == 2 and got[0]["categories"] == ["cs.LG"]


@pytest.mark.parametrize(("q", "ok"), [('all:"a" AND ti:b', True), ('(all:a OR all:b) AND cat:cs.LG AND submittedDate:[202401010000 TO 202402010000]', True), ("all:a all:b", False), ("AND all:a", False), ("all:a OR", False), ("(all:a", False), ('all:"a', False), ("foo:a", False), ("", False), ("all:a AND ()", False)])
def test_query_validator(q, ok):
    assert web.is_sane_query(q) is ok


def test_query_builder():
    query, kind, relaxable = web.plan_query("sparse autoencoders for interpretability of language models", categories=["cs.LG", "bad cat"])
    assert kind == "fallback" and relaxable and web.is_sane_query(query) and query.endswith("AND cat:cs.LG") and '"interpretability" AND' in query.replace(")", "")
    assert web.plan_query("the of")[1] == "empty" and web.plan_query("x", "all:good AND ti:y")[0] == "all:good AND ti:y"


def test_web_and_sections(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(web.is_private(F.lit(ip))) for ip in ("10.1.2.3", "172.31.0.1", "172.32.0.1", "8.8.8.8", "x")] == [True, True, False, False, True]
    page = "<html><head><title>A &amp; B</title><meta name='x'><meta property=\"og:title\" content=\"OG\"></head><body><nav>n</nav><article><p>Hello <b>there</b></p></article><script>x</script></body></html>"
    assert one(web.html_title(F.lit(page))) == "A & B" and one(web.html_meta(F.lit(page), ["og:title"])) == "OG" and one(web.html_article_text(F.lit(page))) == "Hello there"
    doc = rows(spark, "id int, text string", (1, "Title\nAbstract\nshort\n2 Related Work\nskip\n3. Method\nsome longer text\nReferences\n[1]"))
    got = {r["kind"]: r["chars"] for r in web.sections(doc).collect()}
    assert set(got) == {"front", "abstract", "method"}


def test_backup_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"\x00\xff"), ["a"], "x"), (2, None, None, None)], "id int, blob binary, tags array<string>, name string")
    path = str(tmp_path / "b")
    backup.write({"entries": df}, path)
    lines = backup.read(spark, path)
    back, bad = backup.import_table(lines, "entries", df.schema, ("name",))
    assert [tuple(r) for r in back.collect()] == [(1, bytearray(b"\x00\xff"), ["a"], "x")] and bad.first()["issue"] == "name: required"
    with pytest.raises(ValueError, match="version"):
        backup.import_table(lines.where("table <> '_header'"), "entries", df.schema)


def test_dossier_shrinks(spark):
    p = spark.createDataFrame([(1, i, f"P{i}", "A title of some length " * 8, i % 2, None, 2020, "word " * 200, 5, 0.5) for i in range(20)], "search_id int, id int, ref string, title string, cluster int, published_at string, year int, abstract string, cites int, influence double")
    e = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 99)], "search_id int, source int, target int")
    big, small = readmodels.dossier(p, e).first(), readmodels.dossier(p, e, 1200).first()
    assert big["level"] == 0 and small["level"] > 0 and small["approx_tokens"] <= 1200 and "P1 -> P2, P3" in big["text"]
    with pytest.raises(Exception, match="tokens"):
        readmodels.dossier(p, e, 10).collect()
