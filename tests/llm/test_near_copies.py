"""The pipeline's near-copy stage against brute force; repeated rows and null ids."""

import random

import pytest

from tessera.llm import near_copies, pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _node string, _lost string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or ""), "x", "y") for i, t in rows], SCHEMA)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """In order of id: a row stays unless a near copy stayed before it."""
    stay = []
    for i, t in sorted(set(rows), key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        s = shingles(t)
        if not any(s == o or len(s & o) * 5 >= len(s | o) * 4 for _, o in stay):
            stay.append(((i, t), s))
    return [r for r, _ in stay]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    base = [r.choices(words, k=n) for n in (40, 80, 200, 200, 700, 6, 3)]
    out, n = [], 0
    for b in base:
        for _ in range(40):  # from near copies to texts below the threshold
            t = list(b)
            for _ in range(r.randrange(0, max(1, len(b) // 25) + 1)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append((n, " ".join(t)))
            n += 1
    r.shuffle(out)
    return out + [(n, None), (n + 1, " \n"), (n + 2, "A b  c"), (n + 3, "a B c")]


@pytest.mark.parametrize("small_group", [32, 2])
def test_against_brute_force(spark, rows, small_group):
    docs = table(spark, rows)
    got = near_copies.drop_near_duplicates(docs, small_group=small_group)
    assert got.columns == docs.columns
    want = brute(rows)
    assert len(want) < len(rows) - 80
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(i for i, _ in want)


def test_stage_drops_copies_beyond_two_bits(spark):
    """Of pairs at 0.8 or more that differ in more than two bits of op10's fingerprint, one goes."""
    from tessera.llm.simhash import fingerprint

    r = random.Random(2)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for n in range(0, 40, 2):
        a = r.choices(words, k=120)
        b = list(a)
        b[30], b[90] = "changed", "too"
        rows += [(n, " ".join(a)), (n + 1, " ".join(b))]
        assert (fingerprint(rows[-1][1]) ^ fingerprint(rows[-2][1])).bit_count() > 2 or n
    got = pipeline.near_dedup(spark, table(spark, rows), "")
    assert sorted(x["doc_id"] for x in got.collect()) == list(range(0, 40, 2))


def test_rows_without_a_unique_id(spark):
    a = " ".join(f"w{i}" for i in range(60))
    b, other = a + " more", "quite another text that has nothing in common with it"
    got = near_copies.drop_near_duplicates(table(spark, [(None, a), (None, b), (None, other), (None, other), (7, a), (7, other), (8, "x y"), (8, "x y"), (8, "z")])).collect()
    kept = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["text"]) for x in got)
    assert len(kept) == 4 and (-1, other) in kept and sum(i == -1 for i, _ in kept) == 2 and (8, "x y") in kept and (8, "z") in kept


def test_empty(spark):
    assert near_copies.drop_near_duplicates(table(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize("union", [20, 40, 80, 300])
def test_pairs_at_the_threshold_share_a_block(union):
    import numpy as np

    r = np.random.default_rng(union)
    for _ in range(200):
        h = r.integers(0, 2**64, size=union, dtype=np.uint64)
        both = -(-union * 4 // 5)
        cut = both + r.integers(0, union - both + 1)
        a, b = np.sort(h[:cut]), np.sort(np.concatenate([h[:both], h[cut:]]))
        assert near_copies.similar(a, b) and set(near_copies.blocks(a)) & set(near_copies.blocks(b))


@pytest.mark.parametrize("one_task", [near_copies.ONE_TASK, 3])
def test_pairs_settled_in_one_task_or_in_joins(spark, rows, one_task):
    docs = table(spark, rows)
    keys = near_copies._keys(docs, "doc_id", "text")
    met = keys.selectExpr("_node", "explode(_keys) AS _key").select("_key", "_node").distinct()
    sets = near_copies._sets(docs.select(near_copies._row(docs, "doc_id", "text").alias("_node"), docs.text.alias("_text")))
    gone = [r["_node"]["id"] for r in near_copies._lost(met, sets, 4, one_task).collect()]
    assert len(gone) == len(set(gone)) and sorted(gone) == sorted({i for i, _ in rows} - {i for i, _ in brute(rows)})


def test_pairs_below_the_threshold_are_seldom_looked_at():
    """Of pairs at 0.66, which one group of much alike rows has by the square of its number, few pass the sketch."""
    import numpy as np

    r = np.random.default_rng(3)

    def passes(both, own):
        h = r.integers(0, 2**64, size=both + 2 * own, dtype=np.uint64)
        x, y = (np.array(near_copies.sketch(np.sort(np.concatenate([h[:both], part])))[1 : 1 + len(near_copies._SEEDS)]) for part in (h[both : both + own], h[both + own :]))
        return np.bitwise_count((x ^ y).view(np.uint64)).sum() <= near_copies.SKETCH_BITS

    assert sum(passes(116, 30) for _ in range(100)) <= 10
    assert all(passes(130, 16) for _ in range(100))
