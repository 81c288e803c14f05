"""Queries and operators where tables are larger, or rows odder, than those of the driver's samples."""

from tessera import plans
from tessera.streaming import jobs


def write(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_ancestor_walk_beyond_a_million_steps(spark, tmp_path):
    d = write(spark.range(-2, 80_000).selectExpr("IF(id = -1, NULL, id) AS p_partkey"), tmp_path, "part")
    got = {r["id"]: (r["hops"], r["nearest"]) for r in plans.QUERIES["ancestor_walk"](spark, d).collect()}
    assert len(got) == 80_002 and got[None] == (0, None) and got[-2] == (0, None)
    for i in range(80_000):
        walk = [i]
        while walk[-1] > 1 and len(walk) <= 20:
            walk.append(walk[-1] // 2)
        assert got[i] == (len(walk) - 1, max((x for x in walk if x % 5 == 0), default=None))


def test_ancestor_walk_ends_after_twenty_hops(spark, tmp_path):
    d = write(spark.sql("SELECT 5L << 40 AS p_partkey UNION ALL SELECT 5L << 40"), tmp_path, "part")
    assert [tuple(r) for r in plans.QUERIES["ancestor_walk"](spark, d).collect()] == [(5 << 40, 20, 5 << 40)]


def test_spacing_of_a_busy_host(spark):
    """Milliseconds of waiting beyond 2 ** 31."""
    events = spark.range(700_000).selectExpr("id AS event_id", "TIMESTAMP '2024-01-01 00:00:00' AS ts", "'a' AS host")
    got = jobs.spacing(events, 3100).selectExpr("min(start_ms) AS first", "max(start_ms) AS last", "count(DISTINCT start_ms) AS n").first()
    assert got["n"] == 700_000 and got["last"] - got["first"] == 699_999 * 3100


def test_display_formats_of_large_counts_and_ties(spark, tmp_path):
    rows = [(3333, 0.125, "$0.12", "9999"), (3334, 1.005, "$1.00", "10k"), (400_000, 0.004, "$0.00", "1200k"), (1_000_000_000, -2.5, "$-2.50", "3000000k"), (None, None, None, None)]
    orders = spark.createDataFrame([r[:2] for r in rows], "o_orderkey long, o_totalprice double").selectExpr("*", "TIMESTAMP_NTZ '1996-12-05 00:00:00' AS o_orderdate")
    got = plans.QUERIES["display_formats"](spark, write(orders, tmp_path, "orders")).collect()
    assert {(r["id"], r["money"], r["month"], r["cites"]) for r in got} == {(k, m, "Dec 1996", c) for k, _, m, c in rows}


def test_page_title_decodes_ampersands_only(spark, tmp_path):
    titles = ["<title> a &amp; b\n &quot;c&quot; &AMP; </title>", "<TITLE>x</TITLE>", "<title>&amp;lt;</title>", "<title>a\x0bb</title><title>c</title>", "<title> </title>", None]
    pages = spark.createDataFrame(list(enumerate(titles)), "page_id long, html string")
    got = plans.QUERIES["page_title"](spark, write(pages, tmp_path, "pages")).orderBy("id").collect()
    assert [r["title"] for r in got] == ["a & b &quot;c&quot; &AMP;", None, "&lt;", "a\x0bb", None, None]
    assert [r["n"] for r in got] == [None if t is None else len(t) for t in titles]


def test_selection_from_a_large_pool(spark, tmp_path):
    """More than 20,000 candidates of one search; none is left out."""
    d = write(spark.range(21_000).selectExpr("id AS p_partkey", "CAST(10 AS INT) AS p_size"), tmp_path, "part")
    got = [(r["id"], r["final_rank"]) for r in plans.QUERIES["selection_without_reserves"](spark, d).orderBy("final_rank").collect()]
    want = sorted(range(21_000), key=lambda i: (-(0.7 * (i % 997 / 997.0)), -(i % 997 / 997.0), i))[:10]
    assert got == [(i, n) for n, i in enumerate(want, 1)]
