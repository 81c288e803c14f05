"""Records of outside sources, parsed from their JSON or XML payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids

S2 = """paperId string, title string, abstract string, venue string, year int, publicationDate string, externalIds map<string,string>,
    publicationVenue struct<name:string>, journal struct<name:string>, openAccessPdf struct<url:string>, citationCount long,
    influentialCitationCount long, referenceCount long, authors array<struct<name:string,authorId:string,hIndex:long>>"""
OPENALEX = """id string, title string, display_name string, doi string, ids struct<doi:string,openalex:string>, publication_year int, publication_date string,
    cited_by_count long, abstract_inverted_index map<string,array<int>>,
    primary_location struct<landing_page_url:string,pdf_url:string,raw_source_name:string,source:struct<display_name:string>>,
    best_oa_location struct<landing_page_url:string,pdf_url:string>, locations array<struct<landing_page_url:string,pdf_url:string>>,
    authorships array<struct<raw_author_name:string,author:struct<id:string,display_name:string>>>"""
ATOM = """id string, title string, summary string, published string, updated string, author array<struct<name:string>>, doi string, journal_ref string,
    comment string, category array<struct<_term:string>>, primary_category struct<_term:string>, link array<struct<_href:string,_title:string>>"""
MAX_POSITION = 100_000


def tidy(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def http_url(c: Column) -> Column:
    return F.when(tidy(c).rlike("(?i)^https?://"), tidy(c))


def year_of(year: Column, date: Column) -> Column:
    return F.coalesce(year, F.when(date.rlike(r"^\d{4}"), F.substring(date, 1, 4).cast("int")))


def text_of_index(index: Column) -> Column:
    """Text of an inverted index (word to positions), in the row: words in order of position."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.filter(e["value"], lambda p: (p >= 0) & (p < MAX_POSITION)), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return tidy(F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " "))


def parse_s2(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Papers of JSON records; those without a title are dropped. External ids are found whatever their case."""
    r = df.select(F.from_json(json_col, S2).alias("r")).select("r.*")
    ext = lambda k: F.get(F.map_values(F.map_filter("externalIds", lambda key, _: F.lower(key) == k.lower())), F.lit(0))
    arxiv = F.coalesce(ids.arxiv_id(ext("ArXiv")), ids.arxiv_id(ext("DOI")))
    named = F.filter(F.coalesce("authors", F.array().cast("array<struct<name:string,authorId:string,hIndex:bigint>>")), lambda a: tidy(a["name"]).isNotNull())
    authors = F.transform(named, lambda a: F.struct(tidy(a["name"]).alias("name"), tidy(a["authorId"]).alias("s2_id"), a["hIndex"].alias("h")))
    return r.where(tidy(F.col("title")).isNotNull()).select(
        tidy(F.col("title")).alias("title"), tidy(F.col("paperId")).alias("s2_id"), arxiv.alias("arxiv_id"), ids.doi(ext("DOI")).alias("doi"), tidy(F.col("abstract")).alias("abstract"),
        authors.alias("authors"), year_of(F.col("year"), tidy(F.col("publicationDate"))).alias("year"), tidy(F.col("publicationDate")).alias("published_at"),
        F.coalesce(tidy(F.col("venue")), tidy(F.col("publicationVenue.name")), tidy(F.col("journal.name"))).alias("venue"), F.concat(F.lit("https://arxiv.org/abs/"), arxiv).alias("arxiv_url"),
        http_url(F.col("openAccessPdf.url")).alias("pdf_url"), F.col("citationCount").alias("cites"), F.col("influentialCitationCount").alias("influential"),
        F.col("referenceCount").alias("references"), F.array_max(F.transform(authors, lambda a: a["h"])).alias("max_h"),
    )


def parse_openalex(df: DataFrame, json_col: str = "json") -> DataFrame:
    r = df.select(F.from_json(json_col, OPENALEX).alias("r")).select("r.*")
    place = "array<struct<landing_page_url:string,pdf_url:string>>"
    own = lambda c: F.struct(F.col(f"{c}.landing_page_url").alias("landing_page_url"), F.col(f"{c}.pdf_url").alias("pdf_url"))
    places = F.concat(F.array(own("primary_location"), own("best_oa_location")), F.coalesce("locations", F.array().cast(place)))
    doi = F.coalesce("doi", "ids.doi")
    located = F.get(F.array_compact(F.transform(places, lambda x: F.coalesce(ids.find_arxiv_id(x["landing_page_url"]), ids.find_arxiv_id(x["pdf_url"])))), F.lit(0))
    arxiv = F.coalesce(ids.arxiv_id(doi), located)
    pdf = F.coalesce(http_url(F.col("best_oa_location.pdf_url")), http_url(F.col("primary_location.pdf_url")), F.get(F.array_compact(F.transform(places, lambda x: http_url(x["pdf_url"]))), F.lit(0)), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv))
    authors = F.transform(
        F.coalesce("authorships", F.array().cast("array<struct<raw_author_name:string,author:struct<id:string,display_name:string>>>")),
        lambda a: F.struct(F.coalesce(tidy(a["author"]["display_name"]), tidy(a["raw_author_name"])).alias("name"), ids.openalex_id(a["author"]["id"], "A").alias("openalex_id")),
    )
    title = F.coalesce(tidy(F.col("title")), tidy(F.col("display_name")))
    return r.where(title.isNotNull()).select(
        title.alias("title"), ids.openalex_id(F.coalesce("id", "ids.openalex")).alias("openalex_id"), ids.doi(doi).alias("doi"), arxiv.alias("arxiv_id"),
        text_of_index(F.col("abstract_inverted_index")).alias("abstract"), F.filter(authors, lambda a: a["name"].isNotNull()).alias("authors"),
        year_of(F.col("publication_year"), F.col("publication_date")).alias("year"), tidy(F.col("publication_date")).alias("published_at"),
        F.coalesce(tidy(F.col("primary_location.source.display_name")), tidy(F.col("primary_location.raw_source_name"))).alias("venue"), pdf.alias("pdf_url"), F.col("cited_by_count").alias("cites"),
    )


def parse_atom(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Entries of Atom feeds, with rank = start index + place among the entries that are kept, and error entries apart.

    Returns kind (paper, error or dropped), rank, arxiv_id, version, title, abstract, authors, published_at, doi, categories.
    """
    feed = f"startIndex int, totalResults int, entry array<struct<{_ddl(ATOM)}>>"
    rows = df.select(F.monotonically_increasing_id().alias("_feed"), F.from_xml(xml_col, feed, {"ignoreNamespace": "true", "rowTag": "feed"}).alias("f"))
    e = rows.select("_feed", F.col("f.startIndex").alias("start"), F.posexplode("f.entry").alias("_pos", "e")).select("_feed", "start", "_pos", "e.*")
    title, arxiv = tidy(F.col("title")), ids.arxiv_id(F.col("id"))
    kind = F.when(F.col("id").rlike("(?i)/api/errors") | (F.lower(title) == "error"), "error").when(arxiv.isNull() | title.isNull(), "dropped").otherwise("paper")
    from pyspark.sql import Window as W

    e = e.withColumn("kind", kind)
    nth = F.sum(F.when(F.col("kind") == "paper", 1).otherwise(0)).over(W.partitionBy("_feed").orderBy("_pos"))
    link = F.get(F.filter("link", lambda x: x["_title"] == "doi"), F.lit(0))["_href"]
    return e.select(
        "kind", F.when(F.col("kind") == "paper", F.coalesce("start", F.lit(0)) + nth).cast("int").alias("rank"), arxiv.alias("arxiv_id"),
        F.nullif(F.regexp_extract("id", r"v(\d+)$", 1), F.lit("")).cast("int").alias("version"), title.alias("title"), tidy(F.col("summary")).alias("abstract"),
        F.array_compact(F.transform("author", lambda a: tidy(a["name"]))).alias("authors"), F.col("published").alias("published_at"),
        F.coalesce(ids.doi(F.split_part(tidy(F.col("doi")), F.lit(" "), F.lit(1))), ids.doi(link)).alias("doi"), F.array_distinct(F.transform("category", lambda c: F.trim(c["_term"]))).alias("categories"),
    )


def _ddl(schema: str) -> str:
    """The fields of a schema string in the form that stands inside struct<>."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]
