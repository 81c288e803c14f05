"""Exact and near duplicates, line dedup, mixing, packing: against brute force on small tables."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash

from tessera.llm import exact_dedup, line_dedup, mixing, packing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _id string, size string"


def table(spark, rows):
    """rows of (doc_id, text, lang, source); the other columns have names that clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "x", "y", "z") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    out = [(None, "null id", "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, "é" * 9000, "fr", "a"), (4, "é" * 9000, "fr", "b"), (5, "é" * 8999 + "x", "fr", "a")]
    text = [" ".join(r.choices(words, k=r.randrange(1, 60))) for _ in range(40)]
    for i in range(6, 150):
        t = r.choice(text)
        if r.random() < 0.3:
            t = t.replace("alpha", "omega", 1)
        out.append((i, t, "en", r.choice(["a", "b", "c", None])))
    return out + [out[10], out[10], (77, "same id, another text", "en", "a")]


def test_exact(spark, rows):
    for block in (4096, 64, 7):  # many levels of pairs
        got = exact_dedup.exact_duplicates(table(spark, rows), block_bytes=block).collect()
        groups = defaultdict(list)
        for i, t, *_ in rows:
            groups[t or ""].append(i)
        want = []
        for t, ids in groups.items():
            keep = max(ids, key=lambda x: -1 if x is None else x)
            want += [(str(i), str(keep), len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == sorted(want)


def test_exact_drop(spark, rows):
    docs = table(spark, rows)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    best = {}
    for i, t, *_ in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect()) == sorted(best.items())


def reference_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    """prints: (id, fingerprint) -> id: smallest id reachable."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(prints):
        least.setdefault(find(i), []).append(x)
    return [min(least[find(i)], key=lambda x: -1 if x is None else x) for i in range(len(prints))]


@pytest.mark.parametrize("small_group", [32, 1])  # 1: every shared key takes the path for large groups
def test_simhash(spark, rows, small_group):
    got = simhash.near_duplicates(table(spark, rows), small_group=small_group).collect()
    prints = [(i, reference_fingerprint(t)) for i, t, *_ in rows]
    want = sorted((str(i), f"{f:016x}", str(c)) for (i, f), c in zip(prints, brute_components(prints), strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_links_in_large_groups(spark, max_bits):
    """Many fingerprints that share whole blocks: every radius links what brute force links."""
    r = random.Random(max_bits)
    values = {sum(1 << b for b in r.sample(range(32), r.randrange(4))) for _ in range(120)}
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "_fp long"), max_bits=max_bits, small_group=8)
    root = {x["_node"]: x["_root"] for x in simhash.components(edges).collect()}
    near = {v: {w for w in values if (v ^ w).bit_count() <= max_bits} for v in values}
    for v in values:
        reach, todo = {v}, [v]
        while todo:
            more = near[todo.pop()] - reach
            reach |= more
            todo += more
        assert root.get(v, v) == min(reach)


@pytest.mark.parametrize("small_group", [32, 2])
def test_links_of_close_fingerprints(spark, small_group):
    r = random.Random(3)
    values = set()
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(25):
            values.add(f)
            for _ in range(r.randrange(1, 4)):
                f ^= 1 << r.randrange(64)
    prints = [(v, v) for v in sorted(values)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    edges = simhash.links(spark.createDataFrame([(signed(v),) for v, _ in prints], "_fp long"), small_group=small_group)
    root = {r["_node"]: r["_root"] for r in simhash.components(edges).collect()}
    mine, brute = defaultdict(set), defaultdict(set)
    for (v, _), c in zip(prints, brute_components(prints), strict=True):
        mine[root.get(signed(v), signed(v))].add(v)
        brute[c].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, brute.values()))


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, free = sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * w[s] for s in free}
        target |= {s: cap * sizes[s] for s in over}
        left, free = left - sum(cap * sizes[s] for s in over), free - over
    return target


def test_mixing(spark):
    r = random.Random(5)
    sizes = {"a": 40, "b": 3000, "c": 9000, "d": 200, None: 5000, "é": 0}
    rows, n = [], 0
    for s, total in sizes.items():
        while total > 0:
            k = min(total, r.randrange(1, 60))
            rows.append((n, " ".join("w" * k), "en", s))
            total, n = total - k, n + 1
    rows += [(n, None, "en", "é"), (n + 1, " \n", None, None)]
    got = mixing.mix(table(spark, rows)).collect()
    target = brute_targets(sizes)
    taken = defaultdict(int)
    for g in got:
        assert g["target"] == pytest.approx(target[g["source"]], abs=1e-5) and g["source_size"] == sizes[g["source"]]
        assert 0 <= g["taken"] <= 3 * g["size"]
        taken[g["source"]] += g["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix(table(spark, rows[::-1]).repartition(3)).collect()
    assert sorted((g["doc_id"], g["taken"]) for g in again) == sorted((g["doc_id"], g["taken"]) for g in got)
    whole = mixing.mix(table(spark, rows), partial=False).collect()
    assert all(g["size"] == 0 or g["taken"] % g["size"] == 0 for g in whole)


def test_curriculum_follows_schedule(spark):
    rising, falling = ((0.0, 0.0), (1.0, 2.0)), ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0))
    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(2000)]
    docs = table(spark, rows)
    mixed = mixing.mix(docs, schedules=(rising, falling))
    early = defaultdict(int)
    for r in mixing.curriculum(mixed).collect():
        early[r["source"]] += (r["position"] or 0) < 0.5
    assert early["a"] == pytest.approx(250, abs=5) and early["b"] == pytest.approx(750, abs=5)
    repeated = mixing.repeat_documents(docs, mixed)
    assert repeated.columns == docs.columns and repeated.count() == 2000
    with pytest.raises(ValueError):
        mixing.mix(docs, schedules=(((0.0, 1.0), (0.9, 1.0)),))


def test_positions_by_brute_force(spark):
    """The query's schedule (constant weights): each take stands at the middle of its words in the source's demand."""
    r = random.Random(8)
    rows = [(i, " ".join("w" * r.randrange(0, 40)), "en", r.choice("abc")) for i in range(400)]
    target = defaultdict(list)
    for g in mixing.curriculum(mixing.mix(table(spark, rows))).collect():
        target[g["source"]].append(g)
    for source, got in target.items():
        has = sum(g["size"] for g in got)
        start = 0
        for g in sorted(got, key=lambda g: g["row_key"]):
            want = int(g["target"] + 0.5)
            takes = [(e * has + start, min(g["size"], want - e * has - start)) for e in range(3)]
            takes = [((at + n / 2) / g["target"], n) for at, n in takes if n > 0]
            assert [(pytest.approx(p, abs=1e-6), n) for p, n in takes] == [(x["position"], x["words"]) for x in g["takes"]]
            assert g["position"] == (g["takes"][0]["position"] if takes else None)
            start += g["size"]
        assert start == has and source


def test_repeated_rows_and_null_ids_are_not_multiplied(spark):
    t = "one two three four five"
    rows = [(1, t, "en", "a")] * 5 + [(None, t, "en", "b")] * 4 + [(None, "x y", "en", "b"), (None, None, "en", None), (2, t, "en", "a"), (2, t + " six", "en", "a"), (3, "q " * 400, "en", "c"), (3, "q " * 400, "en", "d")]
    docs = table(spark, rows)
    mixed = mixing.mix(docs, partial=False)
    takes = sum(len(g["takes"]) for g in mixed.collect())
    repeated = mixing.repeat_documents(docs, mixed)
    assert repeated.columns == docs.columns and repeated.count() == takes


def test_packing(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices("abcdefgh", k=r.choice([0, 1, 5, 50, 64, 65, 300]))), "en", r.choice(["hot", "hot", "b", None])) for i in range(400)]
    rows += [(7, "twice", "en", "hot")] * 2 + [(None, "null id", None, None), (900, None, "en", "b")]
    got = packing.pack(table(spark, rows), capacity=64, source_limit=2, shard_rows=100).collect()
    size = defaultdict(list)
    for i, t, _, _ in rows:
        size[i].append(len((t or "").split()))
    by, cover = defaultdict(list), defaultdict(int)
    for g in got:
        cover[g["doc_id"]] += g["n_words"]
        by[g["bin_id"]].append(g)
    assert {i: sum(n) for i, n in size.items()} == dict(cover)
    text = {(i, len((t or "").split())): (s, " ".join((t or "").split()).lower()) for i, t, _, s in rows}
    for b, parts in by.items():
        if b is None:
            assert all(p["n_words"] == 0 for p in parts)
            continue
        total = sum(p["n_words"] for p in parts)
        assert total <= 64 and all(p["bin_words"] == total for p in parts)
        assert sorted(p["bin_place"] for p in parts) == list(range(len(parts)))
    full = sum(p[0]["bin_words"] for b, p in by.items() if b is not None) / (64 * (len(by) - 1))
    assert full > 0.85
    # Conflict rules on the table: at most two of a source in a bin, and no two of equal text.
    for b, parts in by.items():
        if b is not None:
            known = [text[k] for p in parts if p["n_words"] and (k := (p["doc_id"], size[p["doc_id"]][0])) in text and len(size[p["doc_id"]]) == 1]
            assert all(n <= 2 for n in Counter(s for s, _ in known).values()) and len({t for _, t in known}) == len(known)


def test_packing_of_large_clusters_and_null_ids(spark):
    """Equal texts and rows without an id get a bin each, and are spread over the shards."""
    rows = [(None, "same text", "en", "a")] * 60 + [(i, "same text", "en", "b") for i in range(60)]
    got = packing.pack(table(spark, rows), capacity=64, shard_rows=20).collect()
    assert len(got) == 120 and len({g["bin_id"] for g in got}) == 120
    assert len({g["bin_id"] >> 40 for g in got if g["doc_id"] is None}) > 1


def test_pack_rows_is_best_fit():
    """Against a search through all bins for the tightest compatible one."""
    r = random.Random(1)
    rows = [(i, r.randrange(1, 40), r.randrange(3), r.randrange(60)) for i in range(300)]
    bins, want = [], {}
    for i, n, s, c in sorted(rows, key=lambda x: (-x[1], x[0])):
        fit = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n and b["sources"].count(s) < 2 and c not in b["clusters"]]
        if fit:
            k = min(fit)[1]
        else:
            bins.append({"room": 40, "sources": [], "clusters": set()})
            k = len(bins) - 1
        bins[k]["room"] -= n
        bins[k]["sources"].append(s)
        bins[k]["clusters"].add(c)
        want[i] = k
    assert {i: b for i, _, _, _, b, _ in packing.pack_rows(rows, 40, 2)} == want


@pytest.mark.parametrize("run", [exact_dedup.exact_duplicates, exact_dedup.drop_exact_duplicates, simhash.near_duplicates, simhash.drop_near_duplicates, line_dedup.dedup_lines, mixing.mix, packing.pack])
def test_empty_tables(spark, run):
    assert run(table(spark, []).limit(0)).collect() == []
