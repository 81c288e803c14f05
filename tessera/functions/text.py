"""Text normalisation and tokenisation as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits, joined by hyphens into a compound.
WORD = r"[\p{L}\p{N}]+(?:[-‐‑][\p{L}\p{N}]+)*"
HYPHEN = "[-‐‑]"

# Stopwords of ranking (English, then academic boilerplate).
STOPWORDS = frozenset(
    """a about above after again against all almost also although always am among an and any
    are aren't around as at be became because become becomes been before being below between
    both but by can cannot could couldn't did didn't do does doesn't doing don't done down
    during each either else etc even ever every few for from further had hadn't has hasn't
    have haven't having he her here hers herself him himself his how however i if in into is
    isn't it it's its itself just least less let like made mainly make makes many may me might
    more most mostly much must my myself neither no nor not now of off often on once one only
    onto or other others otherwise our ours ourselves out over own per perhaps quite rather
    really same several shall she should shouldn't since so some such than that the their
    theirs them themselves then there thereby therefore these they this those though through
    thus to too toward towards under until up upon us use used uses using very via was wasn't
    we well were weren't what when where whether which while who whom whose why will with
    within without would wouldn't yet you your yours yourself yourselves
    abstract achieve achieved achieves approach approaches article based conduct conducted
    contribution contributions demonstrate demonstrated demonstrates effective effectively
    evaluate evaluated experiment experimental experiments extensive finally find findings
    first furthermore introduce introduced introduces method methods moreover new novel
    outperform outperforms paper papers present presented presents problem propose proposed
    proposes provide provided provides recent recently result results second show showed
    shown shows significant significantly state-of-the-art study studies studied superior
    technique techniques three two various work works""".split()
)

# Stopwords of key terms.
TERM_STOPWORDS = frozenset(
    """a about above after again against all also am an and any are as at be because been before being below between
    both but by can could did do does doing down during each either et few for from further had has have having he her
    here hers herself him himself his how however i if in into is it its itself just may me might more most much must my
    myself no nor not now of off on once only or other our ours ourselves out over own per same she should so some such
    than that the their theirs them themselves then there these they this those through thus to too under until up upon
    us very via was we were what when where which while who whom why will with within without would yet you your yours
    al paper papers work works approach approaches method methods propose proposed proposes present presents show shows
    shown result results use used uses using based new novel study studies however furthermore moreover existing
    different various well also first second one two three many several recent recently provide provides task tasks
    problem problems model models performance demonstrate demonstrates achieve achieves state art experiments experimental
    significantly significant introduce introduces address addresses paper's can't don't it's allow allows enable enables""".split()
)

# Plurals that the suffix rules would mangle.
STEM_EXCEPTIONS = {"biases": "bias", "aliases": "alias", "canvases": "canvas"}


def _latin() -> tuple[str, str]:
    """Latin letters that decompose to one base letter, and these bases."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED, _PLAIN = _latin()


def fold(text: Column) -> Column:
    """Lower case without accents: exact for Latin letters, all in the JVM."""
    return F.lower(F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{M}+", ""))


def nfkd(text: Column) -> Column:
    """Full compatibility decomposition without marks, lower-cased, for scripts that ``fold`` does not cover."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.category(c).startswith("M")).lower())

    return run(text)


def nfkc(text: Column) -> Column:
    """Lower-cased compatibility composition, white space collapsed: the key of a topic's name."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).lower().split()))

    return run(text)


def _singular(word: Column) -> Column:
    end = lambda w, n: F.substring(w, 1, F.length(w) - n)
    return (
        F.when(~word.endswith("s"), word)
        .when(word.endswith("ies") & (F.length(word) > 4), F.concat(end(word, 3), F.lit("y")))
        .when(word.endswith("sses"), end(word, 2))
        .when(~F.right(word, F.lit(2)).isin("ss", "us", "is", "as"), end(word, 1))
        .otherwise(word)
    )


def _root(word: Column, singular: Column) -> Column:
    """The stem of ``word``, of which ``singular`` is known. Words that no rule can change are passed over first."""
    end = lambda w, n: F.substring(w, 1, F.length(w) - n)

    def undouble(w: Column) -> Column:
        n = F.length(w)
        double = (F.right(w, F.lit(1)) == F.substring(w, -2, 1)) & (n >= 3)
        ell = w.endswith("ell") & (n >= 6)
        return F.when(double & (~F.right(w, F.lit(1)).isin("l", "s", "z") | ell), end(w, 1)).otherwise(w)

    vowel = lambda w: F.length(F.translate(w, "aeiouy", "")) < F.length(w)
    base = (
        F.when(singular.endswith("ing") & (F.length(singular) >= 6) & vowel(end(singular, 3)), undouble(end(singular, 3)))
        .when(singular.endswith("ed") & ~singular.endswith("eed") & (F.length(singular) >= 5) & vowel(end(singular, 2)), undouble(end(singular, 2)))
        .otherwise(singular)
    )
    for odd, plain in STEM_EXCEPTIONS.items():
        base = F.when(word == odd, plain).otherwise(base)
    able = (F.length(word) > 3) & F.right(word, F.lit(1)).isin("s", "g", "d")
    return F.when(able, F.when(F.length(F.translate(word, "abcdefghijklmnopqrstuvwxyz", "")) == 0, base).otherwise(word)).otherwise(word)


def stem(word: Column) -> Column:
    """Light suffix stemming: plurals, -ing, -ed. Only words of more than three ASCII letters change."""
    return _root(word, _singular(word))


def stem_all(words: Column) -> Column:
    """``stem`` of each word of an array, in two steps, so that the singular is made once."""
    pairs = F.transform(words, lambda w: F.struct(w.alias("w"), _singular(w).alias("s")))
    return F.transform(pairs, lambda x: _root(x["w"], x["s"]))


def surface_terms(text: Column, stopwords: frozenset[str] = STOPWORDS, min_length: int = 2) -> Column:
    """Unstemmed terms in order, repeats kept; a hyphenated compound gives its joined form and its parts."""
    folded = fold(text)
    known = lambda w: w.isin(*sorted(stopwords)) if stopwords else F.lit(False)  # noqa: E731  a hash set, not a scan
    words = F.regexp_extract_all(folded, F.lit(f"({WORD})"), F.lit(1))
    keep = lambda ws: F.filter(ws, lambda w: (F.length(w) >= min_length) & ~known(w))
    parts = lambda w: F.split(w, HYPHEN)
    spread = F.transform(F.filter(words, lambda w: ~known(w)), lambda w: F.when(w.rlike(HYPHEN), F.concat(F.array(F.array_join(parts(w), "")), parts(w))).otherwise(F.array(w)))
    return F.when(folded.rlike(rf"[\p{{L}}\p{{N}}]{HYPHEN}[\p{{L}}\p{{N}}]"), keep(F.flatten(spread))).otherwise(keep(words))


def tokenize(text: Column, stemmed: bool = True, stopwords: frozenset[str] = STOPWORDS, min_length: int = 2) -> Column:
    """Ranking terms of a text."""
    terms = surface_terms(text, stopwords, min_length)
    return stem_all(terms) if stemmed else terms


# Named character references that are decoded, and what they stand for.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "amp": "&"}
TAG = r"</?[a-zA-Z][a-zA-Z0-9-]*(?:\s[^<>]*?)?/?>"
DANGLING = r"</?[a-zA-Z][^<>]*$"


def strip_tags(text: Column) -> Column:
    """Remove what looks like a tag (``<`` and a letter); comparisons such as ``x < y`` stay."""
    return F.regexp_replace(F.regexp_replace(text, TAG, ""), DANGLING, "")


def decode_named(text: Column) -> Column:
    """Decode the named references, each once (``&amp;lt;`` becomes ``&lt;``)."""
    for name, value in ENTITIES.items():
        text = F.regexp_replace(text, f"(?i)&{name};", value.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def clean_text(text: Column) -> Column:
    """Decode references (numeric too), strip tags, twice for doubly encoded markup; collapse blanks."""
    import re

    ref, tag, dangling = re.compile(r"&(#x?[0-9a-fA-F]+|[a-zA-Z]+);"), re.compile(TAG), re.compile(DANGLING)

    def one(m: re.Match) -> str:
        body = m[1]
        if not body.startswith("#"):
            return ENTITIES.get(body.lower(), m[0])
        try:
            code = int(body[2:], 16) if body[1:2] in "xX" else int(body[1:])
        except ValueError:
            return m[0]
        return chr(code) if 32 <= code <= 0x10FFFF else m[0]

    def clean(s: str | None) -> str:
        out = dangling.sub("", tag.sub("", ref.sub(one, s or "")))
        if "<" in out or "&" in out:
            out = dangling.sub("", tag.sub("", ref.sub(one, out)))
        return re.sub("[ \t\xa0]+", " ", out).strip()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(clean)

    return run(text)


def title_key(title: Column) -> Column:
    """Key for equal titles: lower case, anything but letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def normalize_title(title: Column) -> Column:
    """Title key for record linkage: accents, markup and mathematics delimiters go as well."""
    plain = F.regexp_replace(F.coalesce(title, F.lit("")), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(fold(F.regexp_replace(plain, r"[\\{}^_$]", "")), r"[^\p{L}\p{N}]+", " "))


def clip(text: Column, most: int, share: float = 0.6) -> Column:
    """At most ``most`` characters, cut at a word border beyond ``share`` of them, with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.substring(flat, 1, most - 1)
    space = F.length(cut) - F.instr(F.reverse(cut), " ") + 1
    at_word = F.when((F.instr(cut, " ") > 0) & (space - 1 > most * share), F.substring(cut, F.lit(1), space - 1)).otherwise(cut)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(at_word, r"[\s,;:.]+$", ""), F.lit("…")))


def tldr(contribution: Column, abstract: Column, most: int = 280) -> Column:
    """The contribution, else the head of the abstract, cut after a sentence beyond 80 characters, else at a word."""
    c, a = F.trim(contribution), F.trim(F.regexp_replace(abstract, r"\s+", " "))
    head = F.substring(a, 1, most)
    back = F.instr(F.reverse(head), " .")
    stop = F.when(back > 0, F.length(head) - back - 1).otherwise(-1)
    short = F.when(stop > 80, F.substring(head, F.lit(1), stop + 1)).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("…")))
    return F.when(F.length(c) > 0, c).when(F.length(a) == 0, F.lit(None)).when(F.length(a) <= most, a).otherwise(short)


def surname(name: Column) -> Column:
    """Last name: before a comma, else the last token that is no suffix such as Jr or III."""
    n = F.trim(name)
    tokens = F.filter(F.split(n, r"\s+"), lambda t: ~F.lower(t).rlike(r"^(jr|sr|ii|iii|iv)\.?$"))
    return F.when(F.contains(n, F.lit(",")), F.trim(F.split_part(n, F.lit(","), F.lit(1)))).otherwise(F.coalesce(F.try_element_at(tokens, F.lit(-1)), n))


def citation_label(names: Column, year: Column, title: Column) -> Column:
    """"Smith et al. 2023", "Lee 2024", else a short title and the year."""
    known = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.length(F.trim(n)) > 0)
    first = surname(F.get(known, F.lit(0)))
    y = F.when(year.isNotNull(), F.concat(F.lit(" "), year.cast("string"))).otherwise("")
    short = clip(title, 48, 0.5)
    other = F.when(F.length(short) == 0, F.coalesce(year.cast("string"), F.lit(""))).when(year.isNotNull(), F.concat(short, F.lit(", "), year.cast("string"))).otherwise(short)
    return F.when(F.length(first) > 0, F.concat(first, F.when(F.size(known) > 1, " et al.").otherwise(""), y)).otherwise(other)


def query_key(text: Column) -> Column:
    """Order-insensitive bag of words."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0))), " ")


def clean_null(text: Column) -> Column:
    """Null for blanks and for words that stand for no value."""
    t = F.trim(text)
    return F.when((F.length(t) > 0) & ~F.lower(t).isin("null", "none", "n/a", "na", "unknown", "undefined", "-"), t)
