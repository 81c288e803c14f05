"""Retrieval and ranking: BM25F, reciprocal rank fusion, reranking, priors, selection."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..tables import durable
from .relational import first_per_key, number_rows, percentile_rank

RRF_K = 60
K1, B, TITLE_WEIGHT = 1.2, 0.75, 2.0
FIELDS = {"title": TITLE_WEIGHT, "abstract": 1.0}
# Weights of the selection score, its prior and the influence blend.
SELECTION = {"relevance": 0.7, "influence": 0.3}
PRIOR = {"citations": 0.65, "velocity": 0.35}
INFLUENCE = {"citations": 0.3, "velocity": 0.25, "influential": 0.15, "pagerank": 0.2, "h_index": 0.1}
RESERVE_RATIO, FRONTIER_MONTHS, MMR_FLOOR, MMR_WEIGHT, DUPLICATE_COSINE = 0.75, 12, 0.7, 0.15, 0.97


def postings(docs: DataFrame, fields: Sequence[str] = tuple(FIELDS), id_col: str = "id") -> DataFrame:
    """id, field, length of the field in terms, term, tf; a field without terms gives one row with null term."""
    terms = [F.struct(F.lit(f).alias("field"), text.surface_terms(F.col(f)).alias("terms")) for f in fields]
    rows = docs.select(id_col, F.explode(F.array(*terms)).alias("_f"))
    rows = rows.select(id_col, "_f.field", F.size("_f.terms").alias("length"), F.explode_outer("_f.terms").alias("_t"))
    return rows.groupBy(id_col, "field", "length", text.stem(F.col("_t")).alias("term")).agg(F.count("_t").alias("tf"))


def bm25f(docs: DataFrame, query: str | Sequence[str], exclude: str | Sequence[str] = (), exclude_weight: float = 1.0, weights: dict[str, float] = FIELDS, k1: float = K1, b: float = B, id_col: str = "id") -> DataFrame:
    """id, score of every document. Terms of ``exclude`` leave the query and count negative.

    One pass makes per-document field lengths and the frequencies of the query's terms only, and writes these numbers;
    statistics and scores read them. Only words that begin as a query term does are stemmed, for stems keep their first two
    letters. Collection statistics are one row.
    """
    out = query_terms(docs, exclude)
    wanted = [t for t in query_terms(docs, query) if t not in out]
    terms = wanted + out
    rows = docs.select(id_col, *[text.surface_terms(F.col(f)).alias(f"_w_{f}") for f in weights])
    near = lambda f: F.filter(F.col(f"_w_{f}"), lambda w: F.left(w, F.lit(2)).isin(*sorted({t[:2] for t in terms})))
    stems = lambda f: text.stem_all(near(f)) if terms else F.array().cast("array<string>")
    rows = rows.select(id_col, *[F.greatest(F.size(f"_w_{f}"), F.lit(0)).alias(f"_len_{f}") for f in weights], *[stems(f).alias(f"_t_{f}") for f in weights])
    count = lambda f, t: F.size(F.filter(F.col(f"_t_{f}"), lambda x: x == t))
    rows = durable(rows.select(id_col, *[f"_len_{f}" for f in weights], *[count(f, t).alias(f"_tf_{f}_{i}") for f in weights for i, t in enumerate(terms)]), "bm25f")
    has = lambda i: F.greatest(*[F.col(f"_tf_{f}_{i}") for f in weights], F.lit(0)) > 0
    stats = rows.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(f"_len_{f}").alias(f"_avg_{f}") for f in weights],
        *[F.count_if(has(i)).alias(f"_df_{i}") for i in range(len(terms))],
    )
    rows = rows.join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        idf = F.log(1 + (F.col("_n") - F.col(f"_df_{i}") + 0.5) / (F.col(f"_df_{i}") + 0.5))
        tf = F.lit(0.0)
        for f, w in weights.items():
            length = F.when(F.col(f"_avg_{f}") > 0, 1 - b + b * F.col(f"_len_{f}") / F.col(f"_avg_{f}")).otherwise(1.0)
            tf = tf + F.when(F.col(f"_tf_{f}_{i}") > 0, w * F.col(f"_tf_{f}_{i}") / length).otherwise(0.0)
        part = idf * tf / (k1 + tf)
        score = score + (part if t in wanted else -exclude_weight * part)
    return rows.select(id_col, score.alias("score"))


def query_terms(docs: DataFrame, query: str | Sequence[str]) -> list[str]:
    """The distinct terms of a query, in order: the tokeniser run on one row."""
    said = [query] if isinstance(query, str) else list(query)
    if not said:
        return []
    row = docs.sparkSession.range(1).select(F.flatten(F.array(*[text.tokenize(F.lit(s)) for s in said])).alias("t")).first()
    return list(dict.fromkeys(row["t"]))


def rrf(lists: DataFrame, k: int = RRF_K, list_col: str = "list", pos_col: str = "pos", id_col: str = "id") -> DataFrame:
    """id, score, first_list, first_pos. ``lists`` has a 1-based position in each ranking; the best counts once.

    Order the result by score descending, first_list, first_pos for the tie rule "first appearance".
    """
    best = lists.groupBy(id_col, list_col).agg(F.min(pos_col).alias("_p"))
    ranked = best.select(id_col, list_col, "_p", (1 / (k + F.col("_p"))).alias("_s"))
    first = F.min(F.struct(F.col(list_col).alias("l"), F.col("_p").alias("p")))
    return ranked.groupBy(id_col).agg(F.sum("_s").alias("score"), first.alias("_f")).select(id_col, "score", F.col("_f.l").alias("first_list"), F.col("_f.p").alias("first_pos"))


def ranking_of(df: DataFrame, name: int | str, id_col: str, *order: Column) -> DataFrame:
    """One ranking as rows of (list, pos, id)."""
    return number_rows(df, "pos", *order).select(F.lit(name).alias("list"), "pos", F.col(id_col).alias("id"))


def prerank(bm25: DataFrame, cosine: DataFrame, sources: DataFrame, id_col: str = "id") -> DataFrame:
    """Fusion of three rankings: BM25 (score), cosine (rows with a vector), source (best rank, then hits)."""
    lists = ranking_of(bm25, 0, id_col, F.desc("score"), F.asc(id_col))
    lists = lists.union(ranking_of(cosine.where("cosine IS NOT NULL"), 1, id_col, F.desc("cosine"), F.asc(id_col)))
    lists = lists.union(ranking_of(sources, 2, id_col, F.asc_nulls_last("rank"), F.desc("hits"), F.asc(id_col)))
    return rrf(lists)


def rerank(pool: DataFrame, scorer: Callable[[Column, Column], Column] | None, query: str, top_n: int, base: DataFrame | None = None, query_hash: str | None = None) -> DataFrame:
    """``pool`` (id, text, rrf, cosine) with rerank from 0 to 1 for the ``top_n`` by rrf.

    ``scorer(query, text)`` gives a logit (a pandas UDF around a model). Scores of an earlier run (``base``: id,
    query_hash, rerank) are reused where the hash is equal. Without a scorer the calibrated cosine stands in for all.
    """
    top = pool.orderBy(F.desc(F.coalesce("rrf", F.lit(0.0))), "id").limit(top_n).select("id").withColumn("_top", F.lit(True))
    rows = pool.join(top, "id", "left")
    if scorer is None:
        return rows.withColumn("rerank", F.when(F.col("_top"), numbers.cosine_relevance(F.col("cosine")))).drop("_top")
    if base is not None:
        kept = base.where(F.col("query_hash") == query_hash).select("id", F.col("rerank").alias("_old"))
        rows = rows.join(kept, "id", "left")
    else:
        rows = rows.withColumn("_old", F.lit(None).cast("double"))
    fresh = rows.where("_top AND _old IS NULL").select("id", numbers.logit_relevance(scorer(F.lit(query), F.col("text"))).alias("_new"))
    return rows.join(fresh, "id", "left").withColumn("rerank", F.when(F.col("_top"), F.coalesce("_old", "_new"))).drop("_top", "_old", "_new")


def log_cites(cites: Column) -> Column:
    """ln(1 + citations), null where these are unknown."""
    return F.when(cites.isNotNull(), F.log1p(F.greatest(F.lit(0), cites)))


def influence_prior(rows: DataFrame, now: Column, cites: str = "cites", published: str = "published_at") -> DataFrame:
    """Add prior: percentiles of log citations and velocity; null where citations are unknown."""
    rows = rows.withColumn("_lc", log_cites(F.col(cites))).withColumn("_vel", numbers.velocity(F.col(cites), F.col(published), now))
    rows = percentile_rank(percentile_rank(rows, "_lc", "_pc"), "_vel", "_pv")
    prior = (PRIOR["citations"] * F.col("_pc") + PRIOR["velocity"] * F.col("_pv")) / sum(PRIOR.values())
    return rows.withColumn("prior", F.when(F.col(cites).isNotNull(), prior)).drop("_lc", "_vel", "_pc", "_pv")


def selection_score(relevance: Column, prior: Column) -> Column:
    return SELECTION["relevance"] * relevance + SELECTION["influence"] * F.coalesce(prior, F.lit(0.0))


def influence(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add influence: weighted percentiles of cites, velocity, influential, pagerank, h_index.

    A signal that no row has drops out and the other weights are scaled up.
    """
    signals = {"citations": log_cites(F.col("cites")), "velocity": F.col("velocity"), "influential": F.col("influential"), "pagerank": F.col("pagerank"), "h_index": F.col("h_index")}
    rows = rows.withColumns({f"_s_{n}": s.cast("double") for n, s in signals.items()})
    seen = rows.groupBy(*keys).agg(*[F.bool_or(numbers.known(F.col(f"_s_{n}"))).alias(f"_has_{n}") for n in signals])
    for n in signals:
        rows = percentile_rank(rows, f"_s_{n}", f"_p_{n}", keys)
    rows = rows.join(seen, list(keys)) if keys else rows.join(F.broadcast(seen))  # one row
    weight = lambda n: F.when(F.col(f"_has_{n}"), INFLUENCE[n]).otherwise(0.0)
    total = sum((weight(n) for n in signals), F.lit(0.0))
    score = sum((weight(n) * F.col(f"_p_{n}") for n in signals), F.lit(0.0))
    out = rows.withColumn("influence", F.when(total > 0, numbers.clamp01(score / total)).otherwise(0.0))
    return out.drop(*[f"_{p}_{n}" for p in ("s", "has", "p") for n in signals])


def game_changers(rows: DataFrame, count: int = 8) -> DataFrame:
    """id, score of the best ``count`` rows with at least median citations, by PageRank and velocity percentiles."""
    has = rows.agg(F.bool_or(numbers.known(F.col("pagerank"))).alias("_any"), F.median(F.coalesce("cites", F.lit(0))).alias("_median"))
    rows = rows.join(F.broadcast(has))  # one row
    rows = rows.withColumn("_pr", F.when(F.col("_any"), F.col("pagerank").cast("double")).otherwise(log_cites(F.col("cites"))))
    rows = percentile_rank(percentile_rank(rows, "_pr", "_ppr"), "velocity", "_pv")
    rows = rows.where(F.coalesce("cites", F.lit(0)) >= F.col("_median"))
    return rows.select("id", (0.5 * F.col("_ppr") + 0.5 * F.col("_pv")).alias("score")).orderBy(F.desc("score"), "id").limit(count)


def canonical_gate(candidates: DataFrame, min_cosine: float = 0.5, cap: int = 40) -> DataFrame:
    """Candidates near the topic, the most cited of each title, most cited first. Columns: id, title, cites, cosine, pos."""
    near = candidates.where(F.col("cosine") >= min_cosine).withColumn("_key", text.title_key(F.col("title")))
    best = first_per_key(near, ["_key"], -F.coalesce(F.col("cites"), F.lit(0)), F.col("pos")).drop("_key")
    return best.orderBy(F.desc(F.coalesce("cites", F.lit(0))), "pos").limit(cap)


def _select(rows: list[dict], count: int, foundational: int, frontier: int, now_ms: float) -> list[dict]:
    """Greedy constrained selection of one search's candidates; see ``select_papers``."""
    unique = list({r["id"]: r for r in reversed(rows)}.values())[::-1]
    place = {r["id"]: i for i, r in enumerate(unique)}
    reranked = [r for r in unique if r["rerank"] is not None]
    scored = reranked or unique
    if reranked:
        rel = {r["id"]: r["rerank"] for r in scored}
    else:
        lo, hi = min((r["rrf"] for r in unique), default=0), max((r["rrf"] for r in unique), default=0)
        rel = {r["id"]: (r["rrf"] - lo) / (hi - lo) if hi > lo else 1.0 for r in unique}

    def pct(values: list[float | None]) -> list[float]:
        have = sorted(v for v in values if v is not None and math.isfinite(v))
        lo, hi = {}, {}
        for i, v in enumerate(have):
            lo.setdefault(v, i)
            hi[v] = i
        return [0.0 if v is None or v not in lo else 1.0 if len(have) == 1 else (lo[v] + hi[v]) / 2 / (len(have) - 1) for v in values]

    month = numbers.MONTH_DAYS * 86_400_000
    log_cites = [None if r["cites"] is None else math.log1p(max(0, r["cites"])) for r in scored]
    speed = [None if r["cites"] is None or r["published_ms"] is None else r["cites"] / (max(3.0, (now_ms - r["published_ms"]) / month) / 12) for r in scored]
    cite_pct, speed_pct = pct(log_cites), pct(speed)
    cite_rank = {r["id"]: c for r, c in zip(scored, cite_pct, strict=True)}
    score = {}
    for r, c, v in zip(scored, cite_pct, speed_pct, strict=True):
        prior = 0.0 if r["cites"] is None else PRIOR["citations"] * c + PRIOR["velocity"] * v
        score[r["id"]] = SELECTION["relevance"] * rel[r["id"]] + SELECTION["influence"] * prior
    by_score = lambda r: (-score[r["id"]], -rel[r["id"]], -r["rrf"], place[r["id"]])
    ordered = sorted(scored, key=by_score)
    best = max([0.0, *rel.values()])
    relevant = lambda r: rel[r["id"]] >= RESERVE_RATIO * best
    recent = lambda r: r["published_ms"] is not None and r["published_ms"] >= now_ms - FRONTIER_MONTHS * month
    unit = {}
    for r in unique:
        v = None if r["embedding"] is None else np.asarray(r["embedding"], dtype=float)
        n = 0.0 if v is None else float(np.linalg.norm(v))
        unit[r["id"]] = v / n if n else None
    picked: list[dict] = []
    titles: set[str] = set()
    why: dict = {}
    closest = dict.fromkeys(place, 0.0)

    def pick(r: dict, reason: str) -> bool:
        if r["id"] in why:
            return False
        if (r["title_key"] and r["title_key"] in titles) or closest[r["id"]] >= DUPLICATE_COSINE:
            why[r["id"]] = "duplicate"
            return False
        picked.append(r)
        why[r["id"]] = reason
        titles.add(r["title_key"])
        if unit[r["id"]] is not None:
            for other, v in unit.items():
                if v is not None and len(v) == len(unit[r["id"]]):
                    closest[other] = max(closest[other], float(v @ unit[r["id"]]))
        return True

    def reserve(candidates: list[dict], slots: int, reason: str) -> None:
        for r in candidates:
            if slots <= 0 or len(picked) >= count:
                return
            slots -= pick(r, reason)

    old = [r for r in ordered if r["cites"] is not None and relevant(r) and not recent(r)]
    reserve(sorted(old, key=lambda r: (-cite_rank[r["id"]], *by_score(r))), min(foundational, count), "foundational")
    new = [r for r in ordered if relevant(r) and recent(r)]
    reserve(sorted(new, key=lambda r: (-rel[r["id"]], *by_score(r))), min(frontier, count - min(foundational, count)), "frontier")
    rest = [r for r in ordered if r["id"] not in why or why[r["id"]] == "duplicate"]
    while len(picked) < count and rest:
        rest = [r for r in rest if not ((r["title_key"] and r["title_key"] in titles) or closest[r["id"]] >= DUPLICATE_COSINE) or why.setdefault(r["id"], "duplicate") is None]
        if not rest:
            break
        gain = lambda r: score[r["id"]] - MMR_WEIGHT * max(0.0, closest[r["id"]] - MMR_FLOOR) / (1 - MMR_FLOOR)
        top = max(rest, key=gain)  # the first of equals
        rest.remove(top)
        pick(top, "fill")
    left = sorted((r for r in unique if r["id"] not in rel), key=lambda r: (-r["rrf"], place[r["id"]]))
    for r in left:
        if len(picked) >= count:
            break
        pick(r, "leftover")
    chosen = {r["id"] for r in picked}
    final = sorted(unique, key=lambda r: (r["id"] not in chosen, r["id"] not in score, *(by_score(r) if r["id"] in score else (-r["rrf"], place[r["id"]]))))
    return [{"id": r["id"], "selected": r["id"] in chosen, "final_rank": i, "reason": why.get(r["id"]), "score": score.get(r["id"])} for i, r in enumerate(final, 1)]


def select_papers(rows: DataFrame, now: str, count: int, foundational: int, frontier: int, keys: Sequence[str] = ("search_id",)) -> DataFrame:
    """Relevant yet diverse selection for each search: reserves for old and cited, for recent, then a greedy fill.

    ``rows``: keys, id, rerank, rrf, cites, published_at (timestamp), embedding, title, pos (input order). The greedy
    rule is sequential, so each search's candidates meet in one task, in memory that grows with their number; searches run
    in parallel.
    """
    prepared = rows.select(*keys, "id", "rerank", "rrf", "cites", F.unix_millis(F.col("published_at").cast("timestamp")).alias("published_ms"), "embedding", text.title_key(F.col("title")).alias("title_key"), "pos")
    now_ms = pd.Timestamp(now, tz="UTC").timestamp() * 1000
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"id {kinds['id']}, selected boolean, final_rank int, reason string, score double"])

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        records = [{k: (None if not isinstance(v, (list, np.ndarray)) and pd.isna(v) else v) for k, v in r.items()} for r in part.to_dict("records")]
        out = pd.DataFrame(_select(records, count, foundational, frontier, now_ms))
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        return out[[*keys, "id", "selected", "final_rank", "reason", "score"]]

    return prepared.groupBy(*keys).applyInPandas(run, schema)
