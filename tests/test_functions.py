"""Hand-computed values of the functions."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids, numbers, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("self-supervised learning", ["selfsupervis", "self", "supervis", "learn"]),
        ("models modeling modeled", ["model"] * 3),
        ("biases string", ["bias", "string"]),
        ("Café state-of-the-art fitting", ["cafe", "fit"]),
        ("", []),
    ],
)
def test_tokenize(spark, raw, want):
    assert one(spark, text.tokenize(F.lit(raw))) == want


def test_stems(spark):
    words = "running embedded filling passed modelled studies classes bus basis gas thing bring needed agreed being sing red used queries 3d x-ray naïve biases string".split()
    want = "run embed fill pass model study class bus basis gas thing bring need agreed being sing red used query 3d x-ray naïve bias string".split()
    rows = spark.createDataFrame(list(enumerate(words)), "n int, w string").select("n", text.stem(F.col("w")).alias("s")).orderBy("n")
    assert [r["s"] for r in rows.collect()] == want
    assert spark.createDataFrame([(words,)], "w array<string>").select(text.stem_all(F.col("w")).alias("s")).first()["s"] == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("arXiv:2401.01234v3", "2401.01234"), ("https://arxiv.org/abs/2401.01234v2", "2401.01234"), ("http://www.arxiv.org/pdf/2401.01234.pdf", "2401.01234"), ("10.48550/arXiv.2401.01234", "2401.01234"),
        ("HEP-TH/9901001v1", "hep-th/9901001"), ("math.gt/0309136", "math.GT/0309136"), ("1234.567", None), ("", None), (None, None),
    ],
)
def test_arxiv(spark, raw, want):
    assert one(spark, ids.arxiv_id(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("https://doi.org/10.1000/ABC.", "10.1000/abc"), ("doi: 10.1000/a%28b%29?x=1", "10.1000/a(b)"), ("10.1000/a%zz", "10.1000/a%zz"), ("10.1/x", None), ("nothing", None), ("10.1000/a+b", "10.1000/a+b")],
)
def test_doi(spark, raw, want):
    assert one(spark, ids.doi(F.lit(raw))) == want


def test_other_ids(spark):
    assert one(spark, ids.find_arxiv_id(F.lit("see arxiv.org/abs/2401.01234v1 there"))) == "2401.01234"
    assert one(spark, ids.find_arxiv_id(F.lit("http://x.org/2401.01234/b"))) is None
    assert one(spark, ids.openalex_id(F.lit("https://openalex.org/w12"))) == "W12"
    assert one(spark, ids.url_key(F.lit("HTTPS://www.Example.org/Path/?q=1#x"))) == "example.org/Path"
    assert one(spark, ids.slug(F.lit("Straße & Öl: " + "long " * 20))) == "strasse-ol-long-long-long-long-long-long-long-long-long"
    assert one(spark, ids.slug(F.lit("漢字"))) == "topic"
    assert one(spark, ids.ref(F.lit(" [p12]"))) == "P12"


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("RAG", "Retrieval-Augmented Generation", True), ("RLHF", "Reinforcement Learning from Human Feedback", True), ("RLHF", "reward hacking", False), ("LLMs", "Large Language Models", True), ("Retrieval (RAG)", "RAG", True), ("x", "y", False)],
)
def test_acronyms(spark, a, b, want):
    assert one(spark, ids.acronym_match(F.lit(a), F.lit(b))) is want


def test_text_cleaning(spark):
    assert one(spark, text.strip_tags(F.lit("if x < y then <b>bold</b> and a <div"))) == "if x < y then bold and a "
    assert one(spark, text.clean_text(F.lit("&amp;lt;b&amp;gt;a&lt;/b&gt; &#65;&#x42; x &lt; y"))) == "a AB x < y"
    assert one(spark, text.clip(F.lit("one two three four"), 12)) == "one two thr…"
    assert one(spark, text.clip(F.lit("one twos three four"), 12)) == "one twos…"
    assert one(spark, text.tldr(F.lit(" "), F.lit("a " * 300))).endswith("…")
    assert one(spark, text.surname(F.lit("John Smith Jr."))) == "Smith"
    assert one(spark, text.citation_label(F.array(F.lit("Smith, J"), F.lit("B")), F.lit(2023), F.lit("t"))) == "Smith et al. 2023"
    assert one(spark, text.nfkd(F.lit("ﬁne Café"))) == "fine cafe" and one(spark, text.nfkc(F.lit(" Ａ  b "))) == "a b"
    assert one(spark, text.clean_null(F.lit(" None "))) is None


def test_numbers(spark):
    lit = lambda x: F.lit(x).cast("double")
    assert one(spark, numbers.logit_relevance(lit(9.58))) - one(spark, numbers.logit_relevance(lit(8.33))) > 0.05
    assert one(spark, numbers.logit_relevance(lit(float("inf")))) == 1.0 and one(spark, numbers.logit_relevance(lit(-5.0))) < 0.01
    assert one(spark, numbers.cosine_relevance(lit(float("nan")))) == 0.0
    now = F.lit("2026-01-01").cast("timestamp")
    assert one(spark, numbers.velocity(F.lit(20), F.lit("2024-01-01").cast("timestamp"), now)) == pytest.approx(10, abs=0.02)
    assert one(spark, numbers.velocity(F.lit(3), F.lit("2025-12-20").cast("timestamp"), now)) == 12
    assert one(spark, numbers.year_fraction(F.lit("2024"), F.lit(2024))) == 2024.5
    assert one(spark, numbers.partial_date(F.lit("2024")).cast("string")) == "2024-07-01 00:00:00"
    assert one(spark, numbers.clamp01(lit(float("nan")))) == 0.0 and one(spark, numbers.true_modulo_color(F.lit(-1))) == 10
    assert one(spark, numbers.money(F.lit(0.001))) == "<$0.01" and one(spark, numbers.compact_count(F.lit(12345))) == "12k"


def test_vectors(spark):
    a = F.array(*map(F.lit, (3.0, 4.0)))
    assert one(spark, vectors.norm(a)) == 5 and one(spark, vectors.normalize(a)) == [0.6, 0.8]
    assert one(spark, vectors.cosine(a, F.array(F.lit(1.0)))) == 0 and one(spark, vectors.cosine(a, a)) == pytest.approx(1)
    assert one(spark, vectors.from_blob(vectors.to_blob(F.array(F.lit(0.5), F.lit(-2.0))))) == [0.5, -2.0]
    with pytest.raises(Exception, match="3 bytes"):
        one(spark, vectors.from_blob(F.lit(b"abc")))


def test_generator_is_a_fixed_sequence():
    from tessera.operators.clustering import fnv1a, mulberry32

    draw = mulberry32(42)
    values = [draw() for _ in range(1000)]
    assert all(0 <= v < 1 for v in values) and values[:2] != values[2:4] and math.isclose(sum(values) / 1000, 0.5, abs_tol=0.05)
    assert fnv1a("") == 0x811C9DC5 and fnv1a("a") == 0xE40C292C
