"""Quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics: ln words, ln mean word length, and the logarithms of the shares of
symbols, repeated lines and repeated words. For each language and source a minimum-covariance-determinant estimate is
made. It starts from three estimates: coordinate-wise medians and median absolute deviations, mean and covariance of all
rows, and the covariance of squashed deviations from the medians. From each, concentration steps (the ``SUBSET`` share of
rows nearest to the centre gives the next mean and covariance) go on until the determinant stops falling, and the estimate
with the smallest determinant is taken. Its covariance, which is that of the nearest rows only, is scaled to what a normal
population would have as a whole, and rows beyond the chi-square quantile of ``TAIL`` are rejected: one in a million rows
of a normal population.

A statistic that is nearly constant in a group would reject whatever differs, so each has a least standard deviation
(``FLOOR``): a variance below it is raised to it, others are left as they are.

Native: expressions and grouped aggregates only. The text is read once; the steps run over the written statistics, each
a pre-aggregated group-by and a join with a row for each group and start. Medians and quantiles are exact percentiles of
values in bins of fixed width: counts by bin, of bounded size, merged by group, the same however rows are dealt.

Defined results: null text has no words and fails the base rules; null language or source is a value like others;
groups with fewer than ``MIN_ROWS`` usable rows are judged by their language, then by all rows, and if these are still
too few, nothing is rejected beyond the base rules; equal rows get equal verdicts; repeated rows give a row each; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable, word_chars

SUBSET = 0.75
MAX_STEPS = 40  # a bound that concentration, which converges in a few steps, does not meet
MIN_ROWS = 60
TAIL = 1e-6
#: Least standard deviation of each statistic.
FLOOR = (1.0, 0.08, 0.35, 0.6, 1.0)
SYMBOLS = "#*$%&|<>"
_P = len(FLOOR)
_BIN = 0.02  # resolution of ln(1 + squared distance) and of the medians


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, _lang, _source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(lang_col).cast("string").alias("_lang"),
        F.col(source_col).cast("string").alias("_source"),
        word_chars(text).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
    )
    last = F.size("_words") - 3
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    rows = rows.select(
        "_id",
        "_lang",
        "_source",
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window)).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    # Only texts with a repeated window sort theirs, with places; equal neighbours are the repeated ones.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_s", placed).drop("_h")
    # The lambdas read the sorted array itself: a field of it (``_s.h``) would be built anew for each element.
    at = lambda k: F.get(F.col("_s"), k)
    equal = lambda x, k: F.coalesce(x["h"] == at(k)["h"], F.lit(False))
    marked = F.filter(F.transform("_s", lambda x, k: F.when(equal(x, k - 1) | equal(x, k + 1), x["i"])), lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(marked, lambda i: F.array(i, i + 1, i + 2)))))
    return rows.select(F.col("_id").alias(id_col), "_lang", "_source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("_s").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def vector() -> list[Column]:
    """The transformed statistics of a row."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.log1p(100 * F.col(c) / n)
    return [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]


def beyond(x: float, p: int = _P) -> float:
    """Probability that a chi-square variable with p (odd) degrees of freedom exceeds x."""
    out, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, p, 2):
        out, term = out + term, term * x / (k + 2)
    return out


def quantile(tail: float, p: int = _P) -> float:
    """The value that a chi-square variable exceeds with probability ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        at = (low + high) / 2
        low, high = (at, high) if beyond(at, p) > tail else (low, at)
    return high


def _percentile(value: Column, q: float) -> Column:
    """Aggregate: the quantile of ``value`` in bins, at the middle of the bin."""
    return (F.percentile(F.floor(value / _BIN), F.lit(q)) + 0.5) * _BIN


def _cholesky(params: DataFrame, scale: float = 1.0) -> DataFrame:
    """Add the lower factor l_i_j of the covariance c_i_j, times ``scale``, with the floors, and its determinant _det."""
    det = F.lit(1.0)
    for i in range(_P):
        for j in range(i + 1):
            rest = F.greatest(scale * F.col(f"c_{i}_{j}"), F.lit(FLOOR[i] ** 2)) if i == j else scale * F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            # What the statistics before leave of a variance is at least a part of its floor, so the factor exists.
            params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 25))) if i == j else rest / F.col(f"l_{j}_{j}"))
        det = det * F.col(f"l_{i}_{i}") * F.col(f"l_{i}_{i}")
    return params.withColumn("_det", det)


def _distance(rows: DataFrame) -> DataFrame:
    """Add _d, the squared Mahalanobis distance, by forward substitution."""
    total = F.lit(0.0)
    for i in range(_P):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", y / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return rows.withColumn("_d", total)


def _covariances(x: list[Column]) -> list[Column]:
    return [F.coalesce(F.covar_pop(x[i], x[j]), F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(_P) for j in range(i + 1)]


def _grouped(stats: DataFrame) -> DataFrame:
    """Add _group, whose estimate judges the row, and _fits, the groups whose estimates it takes part in.

    A language and source with too few usable rows is judged by its language, and a language with too few by all rows.
    Rows take part in the wider groups only where someone is judged by them; a null _group is judged by none.
    """
    usable = F.when(~F.col("base_failed"), 1)
    own = stats.groupBy("_lang", "_source").agg(F.count(usable).alias("_n"))
    own = own.withColumn("_few", F.col("_n") < MIN_ROWS)
    lang = own.groupBy("_lang").agg(F.sum("_n").alias("_ln"), F.bool_or("_few").alias("_lang_asked"))
    every = lang.agg(F.sum("_ln").alias("n"), F.bool_or(F.col("_lang_asked") & (F.col("_ln") < MIN_ROWS)).alias("asked")).first()
    enough, asked = F.lit((every["n"] or 0) >= MIN_ROWS), F.lit(bool(every["asked"]))
    a, b, c = F.xxhash64(F.lit(1), "_lang", F.lit(1), "_source"), F.xxhash64(F.lit(2), "_lang"), F.xxhash64(F.lit(3))
    own = own.join(lang.withColumnRenamed("_lang", "_l2"), F.col("_lang").eqNullSafe(F.col("_l2"))).drop("_l2")
    judge = F.when(~F.col("_few"), a).when(F.col("_ln") >= MIN_ROWS, b).when(enough, c)
    fits = F.array_compact(F.array(F.when(~F.col("_few"), a), F.when(F.col("_lang_asked") & (F.col("_ln") >= MIN_ROWS), b), F.when(asked, c)))
    own = own.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), judge.alias("_group"), fits.alias("_fits"))
    own = durable(own, "groups")
    return stats.join(own, stats["_lang"].eqNullSafe(own["_l"]) & stats["_source"].eqNullSafe(own["_s"]), "left").drop("_l", "_s")


_PARAMS = [f"m{i}" for i in range(_P)] + [f"{f}_{i}_{j}" for f in "cl" for i in range(_P) for j in range(i + 1)] + ["_det"]


def _starts(rows: DataFrame) -> DataFrame:
    """Three estimates for each _group: _start, m_i, l_i_j, _det."""
    x = [F.col(f"x{i}") for i in range(_P)]
    m, s = [F.col(f"m{i}") for i in range(_P)], [F.col(f"s{i}") for i in range(_P)]
    whole = rows.groupBy("_group").agg(*[_percentile(x[i], 0.5).alias(f"m{i}") for i in range(_P)], *[F.avg(x[i]).alias(f"a{i}") for i in range(_P)], *_covariances(x))
    whole = durable(whole, "whole")
    near = rows.join(whole.select("_group", *m), "_group")
    spread = near.groupBy("_group").agg(*[F.greatest(1.4826 * _percentile(F.abs(x[i] - m[i]), 0.5), F.lit(FLOOR[i])).alias(f"s{i}") for i in range(_P)])
    centre = durable(whole.select("_group", *m).join(spread, "_group"), "centre")
    squashed = [F.tanh((x[i] - m[i]) / s[i]) for i in range(_P)]
    shape = rows.join(centre, "_group").groupBy("_group").agg(*_covariances(squashed)).join(centre, "_group")
    pairs = [(i, j) for i in range(_P) for j in range(i + 1)]
    made = [
        centre.select("_group", F.lit(0).alias("_start"), *m, *[(s[i] * s[i] if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in pairs]),
        whole.select("_group", F.lit(1).alias("_start"), *[F.col(f"a{i}").alias(f"m{i}") for i in range(_P)], *[f"c_{i}_{j}" for i, j in pairs]),
        shape.select("_group", F.lit(2).alias("_start"), *m, *[(F.col(f"c_{i}_{j}") * s[i] * s[j]).alias(f"c_{i}_{j}") for i, j in pairs]),
    ]
    return _cholesky(made[0].union(made[1]).union(made[2])).withColumn("_det", F.lit(float("inf")))


def estimates(rows: DataFrame) -> DataFrame:
    """One row for each _group: centre m_i, factor l_i_j of its covariance, determinant _det."""
    rows = rows.where("NOT base_failed").select(F.explode("_fits").alias("_group"), *[f"x{i}" for i in range(_P)])
    now = durable(_starts(rows), "starts")
    done = now.limit(0)
    x = [F.col(f"x{i}") for i in range(_P)]
    for step in range(MAX_STEPS):
        far = _distance(rows.join(now, "_group")).withColumn("_at", F.floor(F.log1p("_d") / _BIN)).select("_group", "_start", "_at", *x)
        # A row for each group and start: the rows are not dealt by group to meet it.
        cut = durable(far.groupBy("_group", "_start").agg(F.percentile("_at", F.lit(SUBSET)).alias("_cut")), f"cut{step}")
        inner = far.join(cut, ["_group", "_start"]).where("_at <= _cut")
        moved = _cholesky(inner.groupBy("_group", "_start").agg(*[F.avg(x[i]).alias(f"m{i}") for i in range(_P)], *_covariances(x)))
        both = now.select("_group", "_start", F.struct(*_PARAMS).alias("_old")).join(moved.select("_group", "_start", F.struct(*_PARAMS).alias("_new")), ["_group", "_start"])
        both = durable(both.withColumn("_falls", F.col("_new._det") < F.col("_old._det") * (1 - 1e-6)), f"step{step}")
        done = done.union(both.where("NOT _falls").select("_group", "_start", "_old.*"))
        now = both.where("_falls").select("_group", "_start", "_new.*")
        if now.isEmpty():
            break
    best = done.union(now).groupBy("_group").agg(F.min(F.struct("_det", "_start", *_PARAMS[:-1])).alias("_best")).select("_group", "_best.*")
    inside = 1 - beyond(quantile(1 - SUBSET), _P + 2)  # the share of a normal variance that the nearest rows hold
    best = _cholesky(best.drop("_start", *[f"l_{i}_{j}" for i in range(_P) for j in range(i + 1)]), SUBSET / inside)
    return durable(best.drop(*[f"c_{i}_{j}" for i in range(_P) for j in range(i + 1)]), "estimates")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """One row for each row of ``docs``: id, the statistics, base_failed, distance (squared, null if not estimated), kept."""
    stats = statistics(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", base_failed())
    stats = durable(stats.select("*", *[x.alias(f"x{i}") for i, x in enumerate(vector())]), "statistics")
    rows = _grouped(stats)
    found = _distance(rows.join(estimates(rows), "_group", "left")).withColumnRenamed("_d", "distance")
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= quantile(tail))
    return found.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("distance", 6).alias("distance"), kept.alias("kept"))
