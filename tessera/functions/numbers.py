"""Scores, dates and models of cost as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean month in days.
MONTH_DAYS = 365.25 / 12


def known(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    d = x.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def clamp01(x: Column) -> Column:
    return F.when(known(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit_relevance(logit: Column, center: float = 5.0, temperature: float = 2.0) -> Column:
    return F.when(known(logit), sigmoid((logit - center) / temperature)).otherwise(F.when(logit > 0, 1.0).otherwise(0.0))


def cosine_relevance(cosine: Column, center: float = 0.45, temperature: float = 0.08) -> Column:
    return F.when(known(cosine), sigmoid((cosine - center) / temperature)).otherwise(0.0)


def months_between_exact(later: Column, earlier: Column) -> Column:
    """Mean months between two timestamps."""
    return (F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))) / (MONTH_DAYS * 86_400_000)


def velocity(cites: Column, published: Column, now: Column, floor_months: float = 3.0) -> Column:
    """Citations a year since publication, at least ``floor_months`` ago; null if an input is."""
    return cites / (F.greatest(F.lit(floor_months), months_between_exact(now, published)) / 12)


def year_fraction(published: Column, year: Column) -> Column:
    """Position on a time axis: the middle of the year without a month, the 15th without a day."""
    y, m, d = (F.regexp_extract(published, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", k) for k in (1, 2, 3))
    month = F.least(F.lit(12), F.greatest(F.lit(1), F.when(m != "", m).cast("int")))
    day = F.when(d != "", F.least(F.lit(31), F.greatest(F.lit(1), F.when(d != "", d).cast("int")))).otherwise(15)
    exact = F.when(y != "", F.when(m == "", F.when(y != "", y).cast("int") + 0.5).otherwise(F.when(y != "", y).cast("int") + (month - 1) / 12 + (day - 1) / 365))
    return F.coalesce(exact, year + F.lit(0.5))


def partial_date(published: Column) -> Column:
    """Timestamp of a date of which only the year may be given (then 1 July)."""
    full = F.when(published.rlike(r"^\d{4}$"), F.concat(published, F.lit("-07-01"))).otherwise(published)
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(full, "T", " ")), F.try_to_timestamp(full))


def dual_timestamp(text: Column) -> Column:
    """Timestamp from ISO form or from the form with a blank."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "T", " "), "Z$", ""))


def cost_usd(tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, price_in: Column, price_out: Column) -> Column:
    """Cost of a model call; prices are per million tokens, a cache write costs 1.25 and a read 0.1 of an input."""
    return (tokens_in * price_in + cache_write * price_in * 1.25 + cache_read * price_in * 0.1 + tokens_out * price_out) / 1_000_000


def retry_after(header: Column, now: Column, most: float = 120.0) -> Column:
    """Seconds to wait, from seconds or a date."""
    seconds = F.when(header.rlike(r"^\d+(\.\d+)?$"), header.cast("double"))
    date = (F.unix_millis(F.try_to_timestamp(F.regexp_replace(header, r"^\w+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))) - F.unix_millis(now.cast("timestamp"))) / 1000
    wait = F.coalesce(seconds, date)
    return F.when(wait.isNotNull(), F.least(F.lit(most), F.greatest(F.lit(0.0), wait)))


def backoff(attempt: Column, base: float, jitter: Column) -> Column:
    return 2 * base * F.pow(F.lit(2.0), attempt) + jitter


def compact_count(n: Column, millions: bool = True) -> Column:
    """Whole thousands from 10,000 on, and whole millions if ``millions``; null stays null."""
    n = n.cast("long")
    thousands = F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))
    large = F.when(n >= 1_000_000, F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("M"))).otherwise(thousands) if millions else thousands
    return F.when(n < 10_000, n.cast("string")).otherwise(large)


def dollars(x: Column) -> Column:
    """Two decimals, rounded from the exact binary value; null stays null."""
    return F.concat(F.lit("$"), F.call_function("format_number", x, F.lit("0.00")))


def money(x: Column) -> Column:
    return F.when((x > 0) & (x < 0.01), "<$0.01").otherwise(dollars(x))


def true_modulo_color(idx: Column, colors: int = 10) -> Column:
    return F.pmod(idx, F.lit(colors)) + 1
