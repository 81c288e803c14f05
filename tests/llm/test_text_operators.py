"""Language ID, chat formatting, license scan, HTML extraction, quality rules, the pipeline."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tessera.llm import chat_format, html_text, language_id, license_scan, quality, queries
from tessera.llm.common import table


def test_language_id_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_edges(spark):
    schema = "doc_id long, text string, lang string, source string, lang_pred string, score string"
    rows = [(i, t * 9, g, "s", "x", "y") for i, (t, g) in enumerate([("the cat sat on the mat ", "en"), ("der hund und die katze ", "de"), ("le chat est sur la table ", "fr")] * 6)]
    rows += [(90, None, "en", None, None, None), (91, "", "en", None, None, None), (92, "12 !?", "de", None, None, None), (None, "the cat", None, None, None, None), (93, "漢字仮名交じり文" * 40, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    _, learn = language_id.training_rows(docs)
    model = language_id.fit(docs.where(learn))
    got = {r["doc_id"]: r for r in language_id.identify(docs, model, docs["doc_id"]).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (90, 91, 92)) and got[None]["lang_pred"] == "en"
    assert got[93]["rejected"] and not got[None]["rejected"]
    assert [got[i]["lang_pred"] for i in range(3)] == ["en", "de", "fr"]
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    nothing = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing, docs["doc_id"]).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model, docs["doc_id"]).collect() == []


def test_language_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("concat('text ', id) AS _text", "if(id % 3 = 0, 'a', 'b') AS _lang")
    assert Counter(r["_lang"] for r in language_id.sample(docs, 50, 9).collect()) == {"a": 50, "b": 50}
    assert {r["_lang"] for r in language_id.sample(docs, 50, 1).collect()} == {"b"}


def test_language_with_few_texts_in_many_rows(spark):
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, concat('text number ', id), if(id % 2 = 0, 'zwei texte nur', 'nur zwei texte')) AS _text", "if(id % 3 = 0, 'en', 'de') AS _lang")
    assert Counter(r["_lang"] for r in language_id.sample(rows, 50, 9).collect()) == {"en": 50, "de": 2}


def test_language_by_brute_force(spark):
    """The query's predictions against cosines computed one by one from the fitted model."""
    import numpy as np

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    held_out, learn = language_id.training_rows(docs)
    model = language_id.fit(docs.where(learn))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op1_language_id(spark, "/root/testdata/sf0.001").collect():
        n = language_id.counts(text[r["doc_id"]])
        v = np.array([(1 + np.log(x)) * w if x else 0.0 for x, w in zip(n, model.idf, strict=True)])
        near = [float(c @ v / np.linalg.norm(v)) for c in model.centroids]
        best = max(range(len(near)), key=near.__getitem__)
        assert r["score"] == pytest.approx(near[best], abs=1e-5) and (r["lang_pred"] == model.languages[best] or near[best] - max(x for x, g in zip(near, model.languages, strict=True) if g == r["lang_pred"]) < 1e-5)


def test_chat_marks_and_ties(spark):
    """A role that holds the usual mark, equal turns, and a template that rewrites history."""
    rows = [(1, 0, "us\ue000er", "a \ue000 b"), (1, 1, "assistant", "\ue001 c"), (1, 1, "assistant", "\ue001 c")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(docs)
    got = chat_format.digests(out).first()
    assert got["loss_chars"] == 6 and got["loss_sha256"] == hashlib.sha256("\ue001 c\ue001 c".encode()).hexdigest()
    only_last = lambda turns: "".join(f"({r}){t if i == len(turns) - 1 else '...'}" for i, (r, t) in enumerate(turns))
    with pytest.raises(Exception, match="rewrote history"):
        chat_format.digests(chat_format.format_conversations(docs, only_last)).collect()


def test_chat_round_trip(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, spans string"
    hard = "</s>[INST] ok [/INST] \\ \\[ <s>x\n[TEXT]"
    rows = [(1, 1, "assistant", hard, "", ""), (1, 0, "user", hard, "", ""), (2, 0, "user", None, "", ""), (None, 0, None, "a", "", ""), (3, 0, "assistant", "", "", ""), (3, 0, "assistant", "", "", ""), (4, None, "system<", "x" * 50_000, "", "")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, schema))
    turns = {r["conv_id"]: chat_format.read_back(r["formatted"]) for r in out.collect()}
    assert turns == {1: [("user", hard), ("assistant", hard)], 2: [("user", "")], None: [("", "a")], 3: [("assistant", "")] * 2, 4: [("system<", "x" * 50_000)]}
    d = {r["conv_id"]: r for r in chat_format.digests(out).collect()}
    assert d[1]["loss_chars"] == len(hard) and d[1]["loss_sha256"] == hashlib.sha256(hard.encode()).hexdigest()
    assert d[1]["turns_sha256"] == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert chat_format.digests(chat_format.format_conversations(spark.createDataFrame([], schema))).collect() == []


def test_rewritten_history_is_detected():
    tail = lambda turns: " | ".join(f"{r}:{t}" for r, t in turns) + " <end>"
    only_last = lambda turns: "".join(f"({r}){t if i == len(turns) - 1 else '...'}" for i, (r, t) in enumerate(turns))
    turns = [("user", "hello"), ("assistant", "hi hi"), ("user", "bye")]
    assert chat_format.spans(turns, tail)[2] and chat_format.spans(turns, only_last)[2]
    text, places, rewrites = chat_format.spans(turns)
    assert not rewrites and [text[a:b] for *_, a, b in places] == ["hello", "hi hi", "bye"]
    assert [p[1:3] for p in places] == [(places[i - 1][2] if i else 0, p[2]) for i, p in enumerate(places)]


def test_license_scan(spark):
    mit, apache = license_scan.TEMPLATES[2][1], license_scan.TEMPLATES[4][1]
    text = "Intro words.\n" + mit.replace("free of charge", "FREE of  charge").replace("merge, ", "") + "\nmiddle\nLicensed under the Apache License, Version 2.0.\nthe end. " + apache
    got = license_scan.scan(text)
    assert [g[0] for g in got] == ["MIT", "Apache-2.0", "Apache-2.0"] and all(g[1] > 0.95 for g in got)
    assert text[got[0][2] : got[0][3]].startswith("Permission is hereby") and text[got[1][2] : got[1][3]] == "Licensed under the Apache License, Version 2.0"
    assert license_scan.scan("The license to drive was granted under the general rules of this version of the law.") == []
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "x" * 100)]
    out = license_scan.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["license"]), r["n_notices"]) for r in out) == [("1", "None", 0), ("2", "None", 0), ("3", "MIT", 1), ("3", "MIT", 1), ("None", "None", 0)]


def test_license_scan_finds_all_planted_lines(spark):
    rows = table(spark, "/root/testdata/sf0.01", "documents").collect()
    for r in rows:
        planted = len(re.findall(r"(?:Licensed under the Apache License, Version 2\.0\.|Released under the MIT License\.|This work is licensed under the GNU General Public License, version 3\.|Licensed under CC BY-NC 4\.0\.)", r["text"]))
        assert len(license_scan.scan(r["text"])) == planted


@pytest.mark.parametrize("at", range(0, 90, 6))
def test_license_with_a_stray_word_before_it(at):
    """A word of the notice, planted at any distance before it, does not hide it."""
    name, notice = license_scan.TEMPLATES[4]
    stray = ["filler"] * 90
    stray[at] = "License"
    got = license_scan.scan(" ".join(stray) + " " + notice)
    assert [g[0] for g in got] == [name] and got[0][1] > 0.95


def test_license_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, license string, coverage string")
    assert license_scan.scan_documents(empty).collect() == []
    long = "word " * 200_000 + license_scan.TEMPLATES[2][1] + " word" * 1000
    rows = [(1, long, "x", "y"), (2, license_scan.TEMPLATES[12][1], "x", "y")]
    got = {r["doc_id"]: r for r in license_scan.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, license string, notices string")).collect()}
    assert got[1]["license"] == "MIT" and got[1]["n_notices"] == 1 and got[2]["license"] == "ISC"


@pytest.mark.parametrize("seed", range(5))
def test_align_is_patience_alignment(seed):
    """Against all increasing subsequences of the words unique to both, on short texts."""
    from itertools import combinations

    r = random.Random(seed)
    a, b = ([r.choice("abcdefghijkl") for _ in range(10)] for _ in range(2))
    unique = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    most = max((len(c) for k in range(len(unique) + 1) for c in combinations(unique, k) if all(p[1] < q[1] for p, q in zip(c, c[1:], strict=False))), default=0)
    assert len(license_scan._lis(unique)) == most


@pytest.mark.parametrize("seed", range(5))
def test_align_matches_are_equal_and_ascending(seed):
    r = random.Random(seed)
    a = [r.choice("abcdefghij") for _ in range(30)]
    b = [x for x in a if r.random() < 0.8] + [r.choice("xyz") for _ in range(5)]
    pairs = license_scan.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(license_scan.align(a, a)) == len(a)


def test_html(spark):
    page = """<html><head><title>no</title><style>p{}</style></head><body><header class="site"><h1>Site</h1></header><div class="menu">A | B</div>
    <div class="post"><h1>Title &eacute;</h1><p>First para 3 < 4 with <a href=x>a link</a> and H<sub>2</sub>O, long enough&nbsp;to count.<p>Second one is
    not closed.<!-- hidden --><script>var t="</p>";</script><aside>Aside</aside><form>Name <input></form><table><tr><td>cell one<td>cell two</table><p>Last one.</div>
    <div id="comments"><p>a reader says this and that</p></div><div class="footer">foot</div></body></html>"""
    want = "Title é First para 3 < 4 with a link and H2O, long enough to count. Second one is not closed. cell one cell two Last one."
    assert html_text.main_text(page) == want
    rows = [(1, "u", page, "text"), (2, None, None, ""), (3, "u", "", ""), (None, "u", "<nav>only menu</nav>", ""), (5, "u", "plain words only", ""), (6, "u", "<p>open <!-- never closed", "")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert [got[i]["text"] for i in (2, 3, None, 5, 6)] == ["", "", "", "plain words only", "open"]


def test_html_of_all_pages(spark, sf_dir):
    import html

    for r in table(spark, sf_dir, "pages").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        plain = re.sub(r"<(?:/?(?:p|h1)|br)>", " ", article).replace("<b>", "").replace("</b>", "")
        assert html_text.main_text(r["html"]) == " ".join(html.unescape(plain).split())


def without_marks(page):
    return page.replace("\x02", "").replace("\x03", "")


def test_html_held_out_pages():
    """Pages by the same rule that the weights have not seen: all words of the content and no other, but for noise by name."""
    exact, common, mine, theirs = 0, 0, 0, 0
    pages = [p for i, p in enumerate(html_text.labelled_pages(600)) if i >= 400]
    for page in pages:
        within, want = False, []
        for _, text, noise in html_text.events(page, lambda around, found: around or any({*n} & html_text._NOISE for n in found), False):
            for piece in re.split("([\x02\x03])", text):
                within = piece == "\x02" or (within and piece != "\x03")
                want += re.findall(r"\w+", piece) if within and not noise else []
        got = re.findall(r"\w+", html_text.main_text(without_marks(page)))
        tagged = not re.search(r"<div[^>]*>\x02", page)
        assert got == want or not tagged
        exact += got == want
        both = sum((Counter(got) & Counter(want)).values())
        common, mine, theirs = common + both, mine + len(got), theirs + len(want)
    assert exact > 0.7 * len(pages) and 2 * common / (mine + theirs) > 0.97


def test_html_weights_decide():
    """Without learned weights the scan finds something else; other labelled pages give other noise."""
    page = "<body><div>one two three four</div><article><p>five six seven eight nine ten</p></article></body>"
    assert html_text.main_text(page) == "five six seven eight nine ten"
    flat = {k: (1.0 if k in ("word", "link") else -0.05) for k in html_text.default_weights()}
    assert html_text.main_text(page, flat) == "one two three four five six seven eight nine ten"
    own = ["<body><div class=zork>noise here</div><article>\x02<p>words of the page</p><div class=grault><p>and more of it</p></div>\x03</article></body>"] * 3
    assert html_text.main_text("<body><article><p>one two</p><div class=nav><p>three</p></div></article></body>", html_text.fit_weights(own)) == "one two three"


@pytest.mark.parametrize("name", ["side-effects", "form-of-energy", "entry-content", "wp-block-image", "searching", "adoption"])
def test_html_drops_no_content_for_its_name(name):
    page = f'<body><nav>x</nav><article><h1>Title</h1><p>one two three</p><div class="{name}" id="{name}">inner words</div><p>end</p></article></body>'
    assert html_text.main_text(page) == "Title one two three inner words end"


@pytest.mark.parametrize("name", ["cookie-notice", "ad-slot", "post-comments", "site-footer", "related-posts", "shareButtons", "hidden"])
def test_html_drops_noise_by_name(name):
    attr = name if name == "hidden" else f'class="{name}"'
    page = f"<body><article><h1>Title</h1><p>one two three</p><div {attr}>inner words</div><p>end</p></article></body>"
    assert html_text.main_text(page) == "Title one two three end"


def test_html_long_and_hostile_pages(spark):
    words = " ".join(f"w{i}" for i in range(100_000))
    assert html_text.main_text(f"<article><p>{words}</p></article>") == words
    deep = "<div>" * 3000 + "deep words" + "</div>" * 3000
    assert html_text.main_text(f"<article><p>all of it</p>{deep}</article>").startswith("all of it")
    assert html_text.main_text("<p>text " + "<a " * 100_000).startswith("text")
    assert html_text.main_text("plain " + "<!-- " * 10_000) == "plain"
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars string")
    assert html_text.extract(empty).collect() == []


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = quality.judge(docs).collect()
    assert len(got) == len(text)
    for r in got:
        n = brute_statistics(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and (not r["kept"] or not r["base_failed"])


def test_quantiles():
    """Values of a chi-square table."""
    assert quality.quantile(0.5) == pytest.approx(4.351, abs=1e-3) and quality.quantile(0.05) == pytest.approx(11.070, abs=1e-3)
    assert quality.quantile(0.001) == pytest.approx(20.515, abs=1e-3) and quality.quantile(0.01, 7) == pytest.approx(18.475, abs=1e-3)


@pytest.mark.parametrize("seed", range(3))
def test_estimate_is_the_least_determinant_of_all_subsets(spark, seed, monkeypatch):
    """Against all subsets of three quarters of a small group, with outliers in it; floors too small to matter."""
    from itertools import combinations

    import numpy as np

    monkeypatch.setattr(quality, "FLOOR", (1e-3,) * 5)
    r = np.random.default_rng(seed)
    x = r.normal(size=(16, 5)) @ r.normal(size=(5, 5))
    x[:4] += r.normal(size=(4, 5)) * 3 + 25
    rows = spark.createDataFrame([([7], False, *map(float, v)) for v in x], "_fits array<int>, base_failed boolean, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = quality.estimates(rows).first()
    best = min((x[list(c)] for c in combinations(range(16), 12)), key=lambda s: np.linalg.det(np.cov(s.T, bias=True)))
    assert got["_det"] == pytest.approx(np.linalg.det(np.cov(best.T, bias=True)) * _consistency() ** 5, rel=1e-3)
    assert [got[f"m{i}"] for i in range(5)] == pytest.approx(best.mean(axis=0).tolist(), rel=1e-6)


def _consistency():
    return quality.SUBSET / (1 - quality.beyond(quality.quantile(1 - quality.SUBSET), 7))


def test_quality_by_brute_force(spark):
    """Distances from the estimate, computed row by row in Python; a language with one source, ties, a very long text."""
    import numpy as np

    r = random.Random(6)
    clean = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 11))) for _ in range(n))
    rows = [(i, clean(r.randrange(55, 700)), "en", "ab"[i % 2]) for i in range(200)] + [(i, clean(90), "fr", "only") for i in range(200, 280)]
    rows += [(i, "### " * 60 + clean(100), "en", "a") for i in range(300, 303)] + [(303, clean(20_000), "en", "a")] + [rows[0]] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.judge(docs).collect()
    stats = quality.statistics(docs).withColumn("base_failed", quality.base_failed())
    stats = quality._grouped(quality.durable(stats.select("*", *[x.alias(f"x{i}") for i, x in enumerate(quality.vector())]), "test"))
    estimate = {e["_group"]: e for e in quality.estimates(stats).collect()}
    want = []
    for s in stats.collect():
        e = estimate[s["_group"]]
        low = np.array([[e[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        d = float(np.sum(np.linalg.solve(low, np.array([s[f"x{i}"] - e[f"m{i}"] for i in range(5)])) ** 2))
        want.append((s["doc_id"], round(d, 3), not s["base_failed"] and d <= quality.quantile(1e-6)))
    assert len(estimate) == 3
    assert sorted((g["doc_id"], pytest.approx(g["distance"], abs=2e-3), g["kept"]) for g in got) == sorted(want)
    assert all(g["kept"] == (not 300 <= g["doc_id"] < 303) for g in got)


def test_quality_edges(spark):
    r = random.Random(4)
    clean = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(n))
    rows = [(i, clean(r.randrange(60, 400)), "en", "s", "x", "y") for i in range(300)]
    rows += [(1000, " ".join("##%%&&" for _ in range(20)) + " " + clean(80) + " $$$$$" * 90 + clean(60), "en", "s", "x", "y")]
    rows += [(1001, " ".join("".join(r.choices("abcdefgh", k=150)) for _ in range(80)), "en", "s", "x", "y")]
    rows += [(1002, None, None, None, None, None), (1003, "", "en", None, None, None), (None, clean(80), "fr", "rare", None, None), (1004, "a b c\n" * 40, "en", "s", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, _group string")
    got = {x["doc_id"]: x for x in quality.judge(docs).collect()}
    assert len(got) == len(rows) and all(got[i]["kept"] for i in range(300)) and got[None]["kept"]
    assert not got[1001]["kept"] and not got[1001]["base_failed"]
    assert got[1002]["base_failed"] and got[1003]["n_words"] == 0 and got[1004]["n_dup_lines"] == 39 and not got[1004]["kept"]
    assert quality.judge(docs.limit(0)).collect() == []


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from test_near_copies import brute

    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    one = stages["language_id"](spark, docs, sf_dir)
    assert one.columns == docs.columns and one.count() >= docs.where("text rlike '[a-zA-Z]'").count() - 1
    two = stages["exact_dedup"](spark, one, sf_dir)
    assert two.columns == docs.columns and two.count() == one.select("text").distinct().count() == two.select("text").distinct().count()
    three = stages["near_dedup"](spark, two, sf_dir)
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(i for i, _ in brute([(r["doc_id"], r["text"]) for r in two.collect()]))
    four = stages["mixing"](spark, three, sf_dir)
    assert four.columns == docs.columns and {r["doc_id"] for r in four.select("doc_id").collect()} <= {r["doc_id"] for r in three.collect()}
    five = stages["packing"](spark, four, sf_dir).collect()
    assert sum(r["n_words"] for r in five) == sum(len((r["text"] or "").split()) for r in four.collect())
    assert corpus_pipeline.run(spark, sf_dir).count() == len(five)


def test_pipeline_on_odd_rows(spark, sf_dir):
    """Nulls, repeats, an empty table, and columns whose names clash with the operators' own."""
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents").limit(60).selectExpr("*", "'x' AS _row", "1 AS _name", "'y' AS _node", "2L AS _times", "'z' AS _key", "'q' AS kept")
    odd = docs.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "n_chars", "_row", "_name", "_node", "_times", "_key", "kept")
    none = docs.limit(2).selectExpr("doc_id + 1000 AS doc_id", "if(doc_id = 0, '', NULL) AS text", "lang", "source", "n_chars", "_row", "_name", "_node", "_times", "_key", "kept")
    for rows in (docs.union(odd).union(odd).union(none).union(docs.limit(5)), docs.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf_dir)
            assert now.columns == docs.columns, name
        texts = [r["text"] for r in now.collect()]
        packed = dict(corpus_pipeline.STAGES)["packing"](spark, now, sf_dir).collect()
        assert bool(texts) == bool(rows.head(1)) and sum(r["n_words"] for r in packed) == sum(len(t.split()) for t in texts)
