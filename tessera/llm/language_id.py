"""Language identification by nearest centroid.

A text becomes a vector of hashed character uni-, bi- and trigrams (letters in lower case, everything else a word
border), weighted by 1 + ln(count) and inverse document frequency, and normalised. Each language has several centroids
from spherical k-means. The language of the nearest centroid by cosine wins; a text farther from it than texts of its
length were in training (``slack`` times their lowest cosine) is rejected.

The model is fitted on the driver from at most ``per_language`` distinct labelled texts of at most ``max_languages``
languages (those with the most rows; others are never predicted), picked by hash: its size does not grow with the corpus.
Prediction maps over whole texts. A text of fewer than 64 n-grams tells too little to be rejected by its distance.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; null labels are not learned;
with no labelled text all is ``und``; null ids are allowed (their rows may be learned); an empty table gives an empty
table; ties between languages go to the first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

DIM = 4096
PER_LANGUAGE = 400
MAX_LANGUAGES = 256
CENTROIDS = 4
SLACK = 0.5
_LENGTHS = 12  # classes of text length: powers of two of the number of n-grams
_SLICE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() or 0x300 <= i < 0x370 for i in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the letters in lower case, 0 between words and at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    c = np.where(_letters()[c], c, 0)
    c = np.concatenate(([0], c, [0]))
    return c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]


def counts(text: str, dim: int = DIM) -> np.ndarray | None:
    """Counts of the hashed n-grams; None for a text without letters."""
    total = np.zeros(dim)
    found = False
    for at in range(0, len(text), _SLICE):  # in slices that bound memory; all of the text counts
        c = _codes(text[at : at + _SLICE])
        if len(c) < 3:
            continue
        found = True
        one, two = c[c > 0] * 2654435761, c[:-1] * 40503 + c[1:] * 2246822519
        three = c[:-2] * 3266489917 + c[1:-1] * 668265263 + c[2:] * 374761393
        for h in (one, two, three):
            h = h & 0xFFFFFFFFFFFF
            total += np.bincount(((h ^ (h >> 15) ^ (h >> 29)) % dim), minlength=dim)
    return total if found else None


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    floors: dict[str, list[float]] = field(default_factory=dict)  # least cosine by length class

    def vector(self, n: np.ndarray) -> np.ndarray:
        v = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * self.idf
        return v / max(np.linalg.norm(v), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        n = counts(text, len(self.idf)) if text and self.languages else None
        if n is None:
            return "und", 0.0, True
        near = self.centroids @ self.vector(n)
        best = int(near.argmax())
        score = float(min(1.0, max(0.0, near[best])))
        return self.languages[best], score, score < self.floors[self.languages[best]][_length(n)]


def _length(n: np.ndarray) -> int:
    return min(_LENGTHS - 1, int(np.log2(max(1.0, n.sum()))))


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means, started from points far from those taken before."""
    at = [x.mean(axis=0)]
    while len(at) < min(k, len(x)):
        far = (x @ np.array([c / max(np.linalg.norm(c), 1e-12) for c in at]).T).max(axis=1)
        at.append(x[int(far.argsort(kind="stable")[len(far) // 4 if len(far) > 4 * k else 0])])
    c = np.array(at)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def sample(labelled: DataFrame, per_language: int, max_languages: int) -> DataFrame:
    """At most ``per_language`` distinct texts of each of the largest languages, picked by the hash of the text.

    Languages are sized, and the rate of the draw is made, by distinct texts (their hashes, which are combined on the map
    side), so a language of many rows and few texts keeps them all. Equal texts are folded before they are numbered.
    """
    from pyspark.sql import Window as W

    rows = labelled.where(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}")).withColumn("_draw", F.xxhash64("_text"))
    sizes = rows.groupBy("_lang", "_draw").agg(F.count(F.lit(1)).alias("_n")).groupBy("_lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("_n").alias("rows"))
    sizes = sizes.orderBy(F.desc("rows"), "_lang").limit(max_languages).collect()
    if not sizes:
        return labelled.limit(0)
    span = 1_000_000
    part = {r["_lang"]: min(span, int(span * 1.3 * per_language / r["texts"]) + 2000) for r in sizes}
    share = F.create_map(*[F.lit(x) for kv in part.items() for x in kv])
    few = rows.where(F.pmod("_draw", F.lit(span)) < F.coalesce(F.get(F.array(share), F.lit(0))[F.col("_lang")], F.lit(0)))
    few = few.groupBy("_lang", "_draw").agg(F.min("_text").alias("_text"))
    nth = F.row_number().over(W.partitionBy("_lang").orderBy("_draw"))
    return few.withColumn("_nth", nth).where(F.col("_nth") <= per_language).select("_text", "_lang")


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, centroids: int = CENTROIDS, dim: int = DIM, slack: float = SLACK) -> Model:
    """Fit on a bounded sample; what comes to the driver is its n-gram counts."""
    rows = sample(labelled.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")), per_language, max_languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counts(x, dim) for x in b.column(0).to_pylist()]
            keep = [i for i, g in enumerate(got) if g is not None]
            packed = [np.minimum(got[i], 2**32 - 1).astype(np.uint32).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(keep, pa.int64())), pa.array(packed, pa.binary())], names=["lang", "n"])

    got = sorted((r["lang"], bytes(r["n"])) for r in map_arrow(rows, run, "lang string, n binary").toLocalIterator())
    if not got:
        return Model([], np.ones(dim), np.zeros((0, dim)))
    langs = np.array([g[0] for g in got], dtype=object)
    n = np.frombuffer(b"".join(g[1] for g in got), dtype=np.uint32).reshape(len(got), dim)
    del got
    model = Model([], np.log((1 + len(n)) / (1 + (n > 0).sum(axis=0))) + 1, np.zeros((0, dim)))
    x = np.empty(n.shape)
    for i, row in enumerate(n):
        x[i] = model.vector(row)
    model.languages, tables = [], []
    for lang in sorted(set(langs)):
        tables.append(_cluster(x[langs == lang], centroids))
        model.languages += [lang] * len(tables[-1])
    model.centroids = np.concatenate(tables)
    near = (x @ model.centroids.T).max(axis=1)
    length = np.array([_length(row) for row in n])
    for lang in sorted(set(langs)):
        least, floors = 1.0, [0.0] * _LENGTHS
        for k in reversed(range(_LENGTHS)):  # a shorter text is never held to a stricter floor than a longer one
            own = near[(langs == lang) & (length == k)]
            least = min([least, *own.tolist()])
            floors[k] = slack * least if len(own) or least < 1.0 else 0.0
        model.floors[lang] = [f if k >= 6 else 0.0 for k, f in enumerate(floors)]
    return model


def identify(docs: DataFrame, model: Model, *keep: Column, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred, score (cosine, 0 to 1), rejected."""
    model.centroids, model.idf = model.centroids.astype(np.float32), model.idf.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(x.as_py()) for x in b.column(b.num_columns - 1)]
            columns = [*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema)
    return map_arrow(rows, run, f"{fields + ', ' if fields else ''}lang_pred string, score double, rejected boolean")


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> tuple[Column, Column]:
    """(held out, to be learned): crc32 of the id as text, modulo 4, is 2 or is not."""
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out, ~out


def keep_identified(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with all its columns, without the rows that identification rejects."""
    _, learn = training_rows(docs, id_col)
    model = fit(docs.where(learn))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    found = identify(docs, model, row)
    return found.where("NOT rejected").select("_row.*")
