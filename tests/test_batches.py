"""Batches, pages, chunks, stages, numbering by ranges, nearest rows by blocks: against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import batches, entities, relational, vector_search


@pytest.mark.parametrize("seed", range(3))
def test_numbering_by_ranges(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *range(20)]), r.randrange(1, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k int, w int").repartition(7)
    got = {x["id"]: x["n"] for x in relational.number_rows(df, "n", F.desc_nulls_last("k"), F.col("id")).collect()}
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert got == {x[0]: i for i, x in enumerate(order, 1)}
    summed, total = relational.sum_before(df, "s", "w", F.asc_nulls_first("k"), F.col("id"))
    before, want = 0, {}
    for i, _, w in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0])):
        want[i], before = before, before + w
    assert total == before and {x["id"]: x["s"] for x in summed.collect()} == want
    assert relational.number_rows(df.limit(0), "n", "id").collect() == []


def test_bounded(spark):
    assert relational.bounded(spark.range(5), 5, "rows").count() == 5
    with pytest.raises(ValueError, match="more than 4 rows"):
        relational.bounded(spark.range(5), 4, "rows")


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_by_blocks(spark, block):
    r = np.random.default_rng(1)
    x = r.integers(-2, 3, size=(40, 3)).astype(float)  # many ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = vector_search.nearest(rows, 0.1, 3, queries=rows.where("id % 5 = 0"), block_rows=block).collect()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = set()
    for i in range(0, 40, 5):
        near = sorted((j for j in range(40) if j != i and unit[i] @ unit[j] >= 0.1), key=lambda j: (-round(float(unit[i] @ unit[j]), 9), j))
        want |= {(i, j) for j in near[:3]}
    same = lambda pairs: sorted((i, round(float(unit[i] @ unit[j]), 6)) for i, j in pairs)  # noqa: E731  ties by rounding may differ
    assert same((g["a"], g["b"]) for g in got) == same(want)


def test_batches_retry(spark):
    tries = []

    def work(rows):
        tries.append(len(rows))
        if (rows["id"] == 7).any():
            raise ValueError("seven")
        return rows

    df = spark.range(12).selectExpr("id", "id div 5 AS batch")
    got = {r["batch"]: (r["calls"], r["done"], r["failed"]) for r in batches.run_batches(df, work, "batch long, calls long, done long, failed long").collect()}
    assert got == {0: (1, 5, 0), 1: (7, 4, 1), 2: (1, 2, 0)}


def test_chunks_and_stages_are_written_once(spark, tmp_path):
    df = spark.range(450)
    for _ in range(2):  # writing again replaces
        out = batches.write_chunks(df, str(tmp_path / "chunks"), 200, "id")
        assert sorted((r["chunk"], r["n"]) for r in out.groupBy("chunk").agg(F.count("*").alias("n")).collect()) == [(0, 200), (1, 200), (2, 50)]
    done = []

    def work(part):
        done.append(part)
        if part == "c" and done.count("c") == 1:
            raise RuntimeError("lost")
        return spark.range(3)

    folder = str(tmp_path / "stage")
    with pytest.raises(RuntimeError):
        batches.run_stage(spark, folder, "abcd", work)
    assert batches.run_stage(spark, folder, "abcd", work, stop=lambda: len(done) == 4) is None
    assert batches.run_stage(spark, folder, "abcd", work).count() == 12 and done == ["a", "b", "c", "c", "d"]


def test_paged_and_fallback(spark):
    got = [(r["id"], r["page_offset"]) for r in batches.paged(spark.range(30), 4, 10, F.desc("id")).orderBy("n").collect()]
    assert got == [(29 - i, i // 4 * 4) for i in range(10)]
    queries = spark.createDataFrame([("q",), ("r",)], "query string")
    hits = spark.createDataFrame([(q, s, i) for q in "qr" for i, s in enumerate("abc")], "query string, source string, id long")
    down = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a")], "query string, source string")
    found, failures = batches.collect_with_fallback(queries, hits, down, ("a", "b"), "c")
    assert sorted((r["query"], r["source"]) for r in found.collect()) == [("q", "c"), ("r", "b")]
    assert {r["source"]: r["failures"] for r in failures.collect()} == {"a": 2, "b": 1}


def test_title_stars_connect_what_pairs_connect(spark):
    r = random.Random(4)
    rows = [(i, f"a title of words {r.randrange(6)}", r.choice("xy"), 2000 + r.randrange(6), None, r.choice([None, None, "d1", "d2"]), None, None) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, norm_title string, author_last string, year int, arxiv_id string, doi string, s2_id string, openalex_id string")
    pairs = {(x["id"], x["keeper"]) for x in entities.components(df, entities.title_links(df)).collect()}
    stars = {(x["id"], x["keeper"]) for x in entities.components(df, entities.title_stars(df)).collect()}
    assert pairs == stars and len(pairs) == 120


@pytest.mark.parametrize(
    ("method", "site", "origin", "want"),
    [("GET", "cross-site", "http://x", False), ("POST", "same-origin", "http://x", False), ("post", "cross-site", None, True), ("PUT", None, "http://h:1", False), ("PUT", None, "http://x", True), ("DELETE", None, None, False)],
)
def test_foreign_request(spark, method, site, origin, want):
    df = spark.createDataFrame([(method, site, origin)], "m string, s string, o string")
    assert df.select(batches.foreign_request(F.col("m"), F.col("s"), F.col("o"), F.lit("h:1")).alias("x")).first()["x"] is want
