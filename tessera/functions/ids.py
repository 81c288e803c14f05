"""Normalisers of external ids, URLs and slugs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

SLUG_MAX = 60
_NEW = r"^(\d{4}\.\d{4,5})(?:v\d+)?$"
_OLD = r"(?i)^([a-z]+(?:-[a-z]+)*)(?:\.([a-z]{2}))?/(\d{7})(?:v\d+)?$"
# Hosts of blogs and of discussion posts.
BLOG_HOSTS = ("substack.com", "medium.com", "wordpress.com", "blogspot.com", "ghost.io", "svbtle.com", "tumblr.com", "dev.to", "hashnode.dev")
POST_HOSTS = ("lesswrong.com", "alignmentforum.org", "forum.effectivealtruism.org")


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def arxiv_id(raw: Column) -> Column:
    """Versionless id from a bare id, a prefix, an abs, pdf or html URL, or the DOI form; else null."""
    s = F.trim(raw)
    s = F.coalesce(_found(s, r"(?i)10\.48550/arxiv\.(.+)$", 1), s)
    for pattern in (r"(?i)^arxiv:\s*", r"(?i)^https?://(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html|format)/", r"(?i)\.pdf$", r"[?#].*$", r"/+$"):
        s = F.regexp_replace(s, pattern, "")
    subject = F.regexp_extract(s, _OLD, 2)
    old = F.when(
        s.rlike(_OLD),
        F.concat(F.lower(F.regexp_extract(s, _OLD, 1)), F.when(F.length(subject) > 0, F.concat(F.lit("."), F.upper(subject))).otherwise(""), F.lit("/"), F.regexp_extract(s, _OLD, 3)),
    )
    return F.coalesce(_found(s, _NEW, 1), old)


def find_arxiv_id(raw: Column) -> Column:
    """An arXiv id anywhere in a string that mentions arXiv."""
    inner = F.coalesce(_found(raw, r"(?i)arxiv\.org/(?:abs|pdf|html)/([^?#\s]+)", 1), _found(raw, r"(?i)arxiv[:.]\s*([^\s?#]+)", 1))
    return F.coalesce(arxiv_id(raw), arxiv_id(inner))


def doi(raw: Column) -> Column:
    """Lower-cased bare DOI, or null."""
    s = F.trim(raw)
    for pattern in (r"(?i)^doi:\s*", r"(?i)^https?://(?:dx\.)?doi\.org/", r"[?#].*$"):
        s = F.regexp_replace(s, pattern, "")
    s = F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
    s = F.regexp_replace(F.trim(s), r"[.,;]+$", "")
    return F.when(s.rlike(r"^10\.\d{4,9}/\S+$"), F.lower(s))


def openalex_id(raw: Column, letter: str = "W") -> Column:
    """Upper-cased work (W) or author (A) id at the end of a URL or alone."""
    return F.upper(_found(F.trim(raw), rf"(?i)(?:^|/)({letter}\d+)$", 1))


def url_key(raw: Column) -> Column:
    """Host in lower case without www, and path; no scheme, query, fragment or trailing slash."""
    s = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^[a-z][a-z0-9+.-]*://", ""), r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(s, r"^([^/]*)", 1)), r"^www\.", "")
    return F.nullif(F.regexp_replace(F.concat(host, F.regexp_extract(s, r"^[^/]*(/.*)$", 1)), r"/+$", ""), F.lit(""))


def domain(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(raw, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def content_type(host: Column) -> Column:
    """post, blog, video or docs, by host."""
    h = F.lower(host)
    any_end = lambda hosts: h.rlike("(" + "|".join(x.replace(".", r"\.") for x in hosts) + ")$")
    return (
        F.when(any_end(POST_HOSTS), "post")
        .when(any_end(BLOG_HOSTS), "blog")
        .when(h.rlike(r"^(www\.)?(youtube\.com|youtu\.be|vimeo\.com)$"), "video")
        .when(h.rlike(r"(^|\.)(docs?|documentation|developer)\."), "docs")
        .when(h.rlike(r"^blog\.|\.blog$"), "blog")
        .otherwise("docs")
    )


def slug(name: Column) -> Column:
    """ASCII slug of at most 60 characters, cut at a hyphen unless that throws away more than half."""
    s = F.coalesce(name, F.lit(""))
    for pattern, to in (("ß", "ss"), ("(?i)æ", "ae"), ("(?i)ø", "o")):
        s = F.regexp_replace(s, pattern, to)
    base = F.regexp_replace(F.regexp_replace(fold(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.substring(base, 1, SLUG_MAX)
    back = F.instr(F.reverse(cut), "-")
    last = F.when(back > 0, F.length(cut) - back).otherwise(-1)
    short = F.regexp_replace(F.when(last >= SLUG_MAX / 2, F.substring(cut, F.lit(1), last)).otherwise(cut), "-+$", "")
    out = F.when(F.length(base) <= SLUG_MAX, base).otherwise(short)
    return F.when(F.length(out) > 0, out).otherwise("topic")


def ref(raw: Column) -> Column:
    """"p12" or "[P12]" as P12; null if there is none."""
    return F.concat(F.lit("P"), _found(F.upper(F.trim(raw)), r"^\[?P(\d+)\]?$", 1))


def lookup_key(s2: Column, arxiv: Column, doi_: Column) -> Column:
    """The key that a batch lookup takes: the own id, else a prefixed one."""
    return F.coalesce(s2, F.concat(F.lit("ARXIV:"), arxiv), F.concat(F.lit("DOI:"), doi_))


# Words that initials leave out.
INITIALS_STOPWORDS = ("a", "an", "and", "the", "of", "for", "from", "in", "on", "to", "with", "by", "via", "at", "or")


def initials(phrase: Column, skip: bool) -> Column:
    """First letters of the words of a phrase of two words or more, with or without the small words."""
    words = F.filter(F.split(fold(phrase), "[^a-z0-9]+"), lambda w: F.length(w) > 0)
    kept = F.filter(words, lambda w: ~w.isin(*INITIALS_STOPWORDS)) if skip else words
    return F.when(F.size(words) >= 2, F.array_join(F.transform(kept, lambda w: F.substring(w, 1, 1)), ""))


def acronym(name: Column) -> Column:
    """A single token of 2 to 8 letters and digits, lower-cased, without a plural s after capitals."""
    s = F.trim(name)
    single = F.when(s.rlike("^[A-Z0-9]{2,}s$"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    return F.when(s.rlike("^[A-Za-z][A-Za-z0-9]{1,7}$"), F.lower(single))


def name_variants(name: Column) -> Column:
    """The name without what is in parentheses, then each of these."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), r"\s+", " "))
    inner = F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda x: F.trim(x))
    return F.filter(F.concat(F.array(bare), inner), lambda v: F.length(v) > 0)


def acronym_match(a: Column, b: Column) -> Column:
    """Whether one name is an acronym of the other, or both carry the same one."""
    va, vb = name_variants(a), name_variants(b)
    one_way = lambda x, y: F.coalesce((acronym(x) == initials(y, True)) | (acronym(x) == initials(y, False)), F.lit(False))
    same = lambda x, y: F.coalesce(acronym(x) == acronym(y), F.lit(False)) & ((F.size(va) > 1) | (F.size(vb) > 1))
    return F.exists(va, lambda x: F.exists(vb, lambda y: one_way(x, y) | one_way(y, x) | same(x, y)))
