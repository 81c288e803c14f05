"""Rows repeated whole, also where the text has many blocks."""

import pytest

from tessera.llm import exact_dedup

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("size", [10, 4096, 4097, 9000, 40000])
def test_repeated_rows_of_any_length(spark, size):
    a, b, c = "a" * size, "b" * size, "c" * size
    docs = spark.createDataFrame([(1, a), (1, a), (None, b), (None, b), (2, c), (3, c), (3, c), (4, "d" * size)], SCHEMA)
    kept = exact_dedup.drop_exact_duplicates(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"][0]) for r in kept) == [(-1, "b"), (1, "a"), (3, "c"), (4, "d")]
    found = sorted((str(r["doc_id"]), r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect())
    assert found == sorted([("1", 2, True)] * 2 + [("None", 2, True)] * 2 + [("2", 3, False)] + [("3", 3, True)] * 2 + [("4", 1, True)])


def test_names_do_not_rest_on_ids_alone(spark):
    """Rows share an id but not a text: equal names at one place must still mean equal blocks."""
    x, y = "x" * 8, "y" * 8
    docs = spark.createDataFrame([(7, x + x), (7, y + x), (5, y + x), (5, x + x), (7, x + y), (1, y + y)], SCHEMA)
    found = sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(docs, block_bytes=8).collect())
    assert found == [(1, 1, 1), (5, 7, 2), (5, 7, 2), (7, 7, 1), (7, 7, 2), (7, 7, 2)]
