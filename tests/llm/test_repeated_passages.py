"""Repeated passages against a word-by-word search, and planted ones that begin and end inside lines."""

import random
from collections import Counter, defaultdict

import pytest
import xxhash

from tessera.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, _h string, _n string, removed string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], SCHEMA)


def bare(word):
    return word.lower().strip(".!?,;:\"'()[]{}<>«»“”„‘’*_")


def brute_runs(text, min_words):
    words = (text or "").split()
    ends, last = [], 0
    for k, w in enumerate(words, 1):
        if w[-1] in ".!?,;:" or (xxhash.xxh3_64_intdigest(bare(w).encode()) >> 8) % 8 == 0 or k - last == 24 or k == len(words):
            ends.append(k)
            last = k
    for a in [0, *ends[:-1]]:
        for b in ends:
            if b - a >= min_words:
                yield a, b, tuple(map(bare, words[a:b]))
                break


def brute(rows, min_words):
    """In order of rank, rows told apart: the places of the removed words of each row."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, xxhash_signed(rows[k][1])))
    first, out = {}, {}
    times = Counter(r for k in order for *_, r in brute_runs(rows[k][1], min_words))
    for k in order:
        gone = set()
        for a, b, r in brute_runs(rows[k][1], min_words):
            if r not in first:
                first[r] = (k, b)
            elif times[r] > 1 and (first[r][0] != k or a >= first[r][1]):
                gone |= set(range(a, b))
        out[k] = gone
    return out


def xxhash_signed(text):
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def words_left(rows, gone):
    return sorted((str(i), " ".join(w for n, w in enumerate((t or "").split()) if n not in gone[k]), t is None) for k, (i, t) in enumerate(rows))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}{p}" for i in range(200) for p in ("", "", "", ".", ",")] + ["A", "ß", "(b)"]
    passages = [r.choices(words, k=r.randrange(20, 90)) for _ in range(6)] + [["de"] * 80]
    rows = []
    for i in range(60):
        t = r.choices(words, k=r.randrange(0, 120))
        for p in r.sample(passages, r.randrange(3)):
            at = r.randrange(len(t) + 1)
            t[at:at] = [w.upper() if r.random() < 0.3 else w for w in p]
        rows.append((i if r.random() < 0.8 else r.choice([None, 7]), "".join(w + r.choice([" ", " ", "  ", "\n", "\n\n"]) for w in t)))
    rows += [rows[3], rows[3], rows[9], (None, None), (5, ""), (None, None)]
    got = line_dedup.dedup_lines(table(spark, rows), min_words=15).collect()
    assert sorted((str(g["doc_id"]), " ".join((g["text"] or "").split()), g["text"] is None) for g in got) == words_left(rows, brute(rows, 15))
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t)
    for g in got:
        assert g["n_removed"] == len(g["removed"]) and g["removed_chars"] == sum(s["end"] - s["start"] for s in g["removed"])
        assert all(a["end"] <= b["start"] for a, b in zip(g["removed"], g["removed"][1:], strict=False))
        assert any(_without(t, g["removed"]) == (g["text"] or "").split() for t in text[g["doc_id"]])


def _without(text, spans):
    out, at = [], 0
    for s in spans:
        out.append((text or "")[at : s["start"]])
        at = s["end"]
    return " ".join([*out, (text or "")[at:]]).split()


def test_passages_inside_lines(spark):
    r = random.Random(5)
    own = lambda n: [f"x{r.randrange(10**6)}" + r.choice(["", "", "", "", "."]) for _ in range(n)]
    passage = own(60)
    stock = "All rights reserved by the authors of this page."
    rows = [(i, " ".join([*own(40), *(passage if i % 3 == 0 else []), *own(30)]) + "\n" + stock) for i in range(30)]
    got = {g["doc_id"]: g for g in line_dedup.dedup_lines(table(spark, rows)).collect()}
    for i, t in rows:
        lost = len(t.split()) - len(got[i]["text"].split())
        assert got[i]["text"].endswith(stock)
        assert (lost >= 45) == (i % 3 == 0 and i > 0) and (got[i]["text"] == t) == (i % 3 > 0 or i == 0)


def test_long_and_repeated_rows(spark):
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(10**7)}" for _ in range(200_000))
    rows = [(2, long), (1, "short text"), (9, long + " tail"), (3, "one two " * 40), (3, "one two " * 40), (None, "a b c. " * 30), (None, "a b c. " * 30)]
    got = sorted(((g["doc_id"] is not None, g["doc_id"] or 0, len(g["text"].split())) for g in line_dedup.dedup_lines(table(spark, rows)).collect()))
    assert [g for g in got if g[1] == 2] == [(True, 2, 200_000)] and [g for g in got if g[1] == 9][0][2] < 50
    assert len(got) == len(rows) and [g for g in got if g[1] == 1] == [(True, 1, 2)]
    assert sum(g[2] for g in got if not g[0]) < 90 + 60


def test_empty(spark):
    assert line_dedup.dedup_lines(table(spark, []).limit(0)).collect() == []
