"""Entity resolution: normalised records, matching on external ids and titles, merged rows, repointed children."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, numbers, text
from ..tables import drop, durable

EXTERNAL = ("arxiv_id", "doi", "s2_id", "openalex_id")
MIN_TITLE_WORDS = 4


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalize_records(raw: DataFrame) -> DataFrame:
    """Blank text and non-finite numbers become null, ids are normalised; an arXiv DOI is kept as the arXiv id only."""
    doi = ids.doi(F.col("doi"))
    minted = F.coalesce(doi.rlike(r"^10\.48550/arxiv\."), F.lit(False))
    number = lambda c: F.when(numbers.known(F.col(c)), F.col(c))
    return raw.withColumns(
        {
            "title": F.trim(F.coalesce("title", F.lit(""))),
            "norm_title": text.normalize_title(F.col("title")),
            "arxiv_id": F.coalesce(ids.arxiv_id(F.col("arxiv_id")), F.when(minted, ids.arxiv_id(doi))),
            "doi": F.when(~minted, doi),
            "s2_id": blank_to_null(F.col("s2_id")),
            "openalex_id": ids.openalex_id(F.col("openalex_id")),
            "abstract": blank_to_null(F.col("abstract")),
            "year": number("year"),
            "cites": number("cites"),
            "author_last": author_last(F.col("first_author")),
        }
    ).where("title <> ''")


def author_last(name: Column) -> Column:
    before = F.when(F.contains(name, F.lit(",")), F.split_part(name, F.lit(","), F.lit(1))).otherwise(name)
    return F.coalesce(F.try_element_at(F.split(text.normalize_title(before), " "), F.lit(-1)), F.lit(""))


def id_links(records: DataFrame, id_col: str = "id", keys: Sequence[str] = EXTERNAL) -> DataFrame:
    """a < b: each record linked to the smallest that shares an external id (a star for each id, not all pairs)."""
    parts = []
    for k in keys:
        least = records.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min(id_col).alias("a"))
        parts.append(records.select(F.col(id_col).alias("b"), F.col(k).alias("_k")).join(least, "_k").select("a", "b").where("a < b"))
    return reduce(DataFrame.union, parts).distinct()


def title_links(records: DataFrame, id_col: str = "id", keys: Sequence[str] = EXTERNAL) -> DataFrame:
    """a < b: equal normalised title of four words or more, equal first author's last name, years at most one apart, and
    no external id that both have and that differs."""
    able = records.where((F.size(F.split("norm_title", " ")) >= MIN_TITLE_WORDS) & (F.col("author_last") != "") & F.col("year").isNotNull())
    cols = [id_col, "year", *keys]
    x = able.select("norm_title", "author_last", *[F.col(c).alias(f"x_{c}") for c in cols])
    y = able.select("norm_title", "author_last", *[F.col(c).alias(f"y_{c}") for c in cols])
    agree = reduce(lambda p, q: p & q, [F.coalesce(F.col(f"x_{k}") == F.col(f"y_{k}"), F.lit(True)) for k in keys])
    near = F.abs(F.col("x_year") - F.col("y_year")) <= 1
    pairs = x.join(y, ["norm_title", "author_last"]).where((F.col(f"x_{id_col}") < F.col(f"y_{id_col}")) & near & agree)
    return pairs.select(F.col(f"x_{id_col}").alias("a"), F.col(f"y_{id_col}").alias("b"))


def title_stars(records: DataFrame, id_col: str = "id", keys: Sequence[str] = EXTERNAL) -> DataFrame:
    """Links that connect what ``title_links`` connects: records alike in all that it looks at (title, author, year, ids)
    are linked to their smallest, and pairs are made of these representatives only."""
    alike = ["norm_title", "author_last", "year", *keys]
    able = records.where((F.size(F.split("norm_title", " ")) >= MIN_TITLE_WORDS) & (F.col("author_last") != "") & F.col("year").isNotNull())
    least = durable(able.groupBy(*alike).agg(F.min(id_col).alias(id_col)), "alike")
    same = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in alike])
    star = able.select(F.col(id_col).alias("b"), *alike).join(least.select(F.col(id_col).alias("a"), *[F.col(k).alias(f"_{k}") for k in alike]), same)
    return star.where("a < b").select("a", "b").union(title_links(least, id_col, keys))


def components(nodes: DataFrame, links: DataFrame, id_col: str = "id") -> DataFrame:
    """id, keeper: the smallest id that links reach. Labels spread by minimum, and jump to their own label's label, until none moves."""
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = durable(nodes.select(F.col(id_col).alias("id"), F.col(id_col).alias("keeper")), "labels")
    written, step = labels, 0
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("keeper").alias("_k")), "b").groupBy(F.col("a").alias("id")).agg(F.min("_k").alias("_near"))
        new = labels.join(near, "id", "left").select("id", F.col("keeper").alias("_old"), F.least("keeper", "_near").alias("keeper"))
        jump = labels.select(F.col("id").alias("keeper"), F.col("keeper").alias("_next"))
        new = durable(new.join(jump, "keeper", "left").select("id", "_old", F.least("keeper", "_next").alias("keeper")), f"labels{step}")
        done = new.where("keeper <> _old").isEmpty()
        labels = new.select("id", "keeper")
        drop(written)
        written, step = new, step + 1
        if done:
            drop(both)
            return labels


def resolve(records: DataFrame, id_col: str = "id") -> DataFrame:
    """id, keeper (the oldest record of the same work): external ids first, then titles between what they left apart."""
    by_id = components(records, id_links(records, id_col), id_col)
    rows = records.join(by_id.withColumnRenamed("id", id_col), id_col)
    fold = rows.groupBy("keeper").agg(*[F.min(k).alias(k) for k in EXTERNAL], F.min_by("norm_title", id_col).alias("norm_title"), F.min_by("author_last", id_col).alias("author_last"), F.min("year").alias("year"))
    by_title = components(fold, title_stars(fold, "keeper"), "keeper").select(F.col("id").alias("keeper"), F.col("keeper").alias("_final"))
    return by_id.join(by_title, "keeper").select(F.col("id").alias(id_col), F.col("_final").alias("keeper"))


def merge_records(records: DataFrame, resolved: DataFrame, id_col: str = "id") -> DataFrame:
    """One row for each keeper: the first value that is given (by id), highest metrics, any flag, the preferred abstract.

    An abstract from arXiv wins; else the first, unless a longer one comes and no record has an arXiv id.
    """
    rows = records.join(resolved, id_col)
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(id_col))).alias(c)
    from_arxiv = F.min_by("abstract", F.when(F.col("abstract").isNotNull() & (F.col("source") == "arxiv"), F.col(id_col)))
    longest = F.max_by("abstract", F.struct(F.length("abstract"), (-F.col(id_col)) if dict(records.dtypes)[id_col] in ("bigint", "int") else F.lit(0)))
    plain = F.min_by("abstract", F.when(F.col("abstract").isNotNull(), F.col(id_col)))
    return rows.groupBy("keeper").agg(
        *[first(c) for c in ("title", *EXTERNAL, "year")],
        F.max("cites").alias("cites"),
        F.coalesce(from_arxiv, F.when(F.max("arxiv_id").isNull(), longest).otherwise(plain)).alias("abstract"),
        F.count(F.lit(1)).alias("merged"),
    )


def merge_authors(existing: Column, incoming: Column) -> Column:
    """Author lists (struct name, s2_id, h): existing order; gaps filled from incoming authors of the same name, highest h."""

    def one(a: Column) -> Column:
        same = F.get(F.filter(incoming, lambda b: text.normalize_title(b["name"]) == text.normalize_title(a["name"])), F.lit(0))
        return F.struct(a["name"].alias("name"), F.coalesce(a["s2_id"], same["s2_id"]).alias("s2_id"), F.greatest(a["h"], same["h"]).alias("h"))

    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    return F.when(empty(existing), incoming).when(empty(incoming), existing).otherwise(F.transform(existing, one))


def repoint(child: DataFrame, resolved: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """Foreign keys of a child table moved to the keepers."""
    for c in columns:
        moved = resolved.select(F.col(id_col).alias(c), F.col("keeper").alias(f"_to_{c}"))
        child = child.join(moved, c, "left").withColumn(c, F.coalesce(f"_to_{c}", c)).drop(f"_to_{c}")
    return child


def repoint_edges(edges: DataFrame, resolved: DataFrame, src: str = "citing", dst: str = "cited", flag: str = "influential") -> DataFrame:
    """Edges moved to the keepers, one for each pair, without those that became loops."""
    moved = repoint(edges, resolved, [src, dst]).where(F.col(src) != F.col(dst))
    return moved.groupBy(src, dst).agg(F.bool_or(flag).alias(flag))


def logged_lookup(papers: DataFrame, entries: DataFrame) -> DataFrame:
    """id, entry_id: the oldest entry that logs a paper, by arXiv id, else DOI, else URL.

    papers: id, arxiv_id, doi, urls (array); entries: entry_id, url, created.
    """
    tag = lambda prefix, c: F.concat(F.lit(prefix), c)
    of_entry = F.array_compact(F.array(tag("arxiv:", ids.find_arxiv_id(F.col("url"))), tag("doi:", ids.doi(F.col("url"))), tag("url:", ids.url_key(F.col("url")))))
    index = entries.select("entry_id", "created", F.explode(of_entry).alias("_k")).groupBy("_k").agg(F.min_by("entry_id", F.struct("created", "entry_id")).alias("entry_id"))
    urls = F.transform("urls", lambda u: tag("url:", ids.url_key(u)))
    arxiv = F.coalesce(ids.arxiv_id(F.col("arxiv_id")), F.get(F.array_compact(F.transform("urls", ids.find_arxiv_id)), F.lit(0)))
    of_paper = F.array_compact(F.concat(F.array(tag("arxiv:", arxiv), tag("doi:", ids.doi(F.col("doi")))), urls))
    keys = papers.select("id", F.posexplode(of_paper).alias("_p", "_k"))
    return keys.join(index, "_k").groupBy("id").agg(F.min_by("entry_id", "_p").alias("entry_id"))


def violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once although they should be unique (null keys may repeat)."""
    given = reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in keys])
    return df.where(given).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cache_split(wanted: DataFrame, cache: DataFrame, keys: Sequence[str], now: Column, expires: str = "expires_at") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a keyed cache with an expiry time."""
    live = cache.where(F.col(expires) > now)
    return wanted.join(live, list(keys)), wanted.join(live.select(*keys), list(keys), "left_anti")


def delete_guarded(topics: DataFrame, searches: DataFrame, key: str = "topic_id") -> tuple[DataFrame, DataFrame]:
    """(topics that may be deleted, topics refused because a search of theirs is queued or running)."""
    active = searches.where(F.col("status").isin("queued", "running")).select(key)
    return topics.join(active, key, "left_anti"), topics.join(active, key, "left_semi")
