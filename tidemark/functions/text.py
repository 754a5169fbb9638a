"""Column expressions over text: white space, tickers, dates, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Venue suffixes that are no share class, and date patterns in the order they are tried.
VENUE_SUFFIXES = ("US", "UN", "UW", "UQ", "LN", "GR", "FP", "JP")
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "dd.MM.yyyy", "yyyy/MM/dd")


def squeeze(c: Column) -> Column:
    """All Unicode white space (and a byte order mark) becomes one blank; null stays null."""
    return F.trim(F.regexp_replace(c, "(?U)[\\s\\uFEFF]+", " "))


def normalize_text(c: Column) -> Column:
    """``squeeze`` with null as the empty text."""
    return F.coalesce(squeeze(c), F.lit(""))


def nan_to_null(c: Column) -> Column:
    """NaN is "missing": Spark orders NaN above all numbers, so it must not reach a comparison."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def canonical_ticker(c: Column) -> Column:
    """One spelling per listing: upper case, no padding, ``$``, market prefix or
    venue suffix; any class separator becomes a dot. Blank becomes null."""
    t = F.upper(squeeze(c))
    t = F.regexp_replace(t, "^\\$+\\s*", "")
    t = F.regexp_replace(t, "^[A-Z]{2,10}\\s*:\\s*", "")
    t = F.regexp_replace(t, f"[\\s.]({'|'.join(VENUE_SUFFIXES)})(\\s+EQUITY)?$", "")
    t = F.regexp_replace(t, "[\\s/_\\-.]+", ".")
    t = F.regexp_replace(t, "^\\.+|\\.+$", "")
    return F.nullif(t, F.lit(""))


#: Listings of one company under another symbol.
TICKER_ALIASES = {"GOOG": "GOOGL", "FB": "META"}


def aliased_ticker(c: Column) -> Column:
    """The canonical ticker under its company's one symbol."""
    t = canonical_ticker(c)
    out = t
    for old, new in TICKER_ALIASES.items():
        out = F.when(t == old, new).otherwise(out)
    return out


def ticker_list(c: Column) -> Column:
    """The distinct tickers of a comma list, in order of first naming; blanks name nobody, null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: aliased_ticker(x))
    return F.array_distinct(F.filter(parts, lambda x: x.isNotNull()))


def parse_day(c: Column) -> Column:
    """A date out of the declared forms (a time of day is dropped); null if none fits."""
    t = squeeze(c)
    t = F.regexp_replace(t, "^(\\d{4}-\\d{2}-\\d{2})[T ].*$", "$1")
    guarded = [F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(f)).cast("date")) for f, shape in zip(DATE_FORMATS, (
        "^\\d{4}-\\d{2}-\\d{2}$", "^\\d{2}/\\d{2}/\\d{4}$", "^\\d{1,2}/\\d{1,2}/\\d{4}$", "^\\d{8}$", "^[A-Za-z]{3} \\d{1,2}, \\d{4}$",
        "^[A-Za-z]{4,} \\d{1,2}, \\d{4}$", "^\\d{1,2} [A-Za-z]{3} \\d{4}$", "^\\d{1,2} [A-Za-z]{4,} \\d{4}$", "^\\d{2}\\.\\d{2}\\.\\d{4}$", "^\\d{4}/\\d{2}/\\d{2}$"))]
    return F.coalesce(*guarded)


def digits_key(c: Column) -> Column:
    """A company number out of its spellings (``CIK0000700011``, ``700011.0``, padded);
    all zeros, blanks and nulls identify nobody and become null."""
    d = F.regexp_replace(F.regexp_replace(squeeze(c), "\\.0+$", ""), "[^0-9]", "")
    return F.nullif(F.regexp_replace(d, "^0+", ""), F.lit(""))


def padded_cik(c: Column) -> Column:
    """A company number as ten digits; null without any digit, ten zeros where all are."""
    d = F.regexp_replace(F.regexp_replace(F.trim(c), "\\.0+$", ""), "[^0-9]", "")
    return F.when(d != "", F.lpad(F.regexp_replace(d, "^0+", ""), 10, "0"))


def text_hash(c: Column) -> Column:
    """sha256 of the lower-cased, squeezed text; blank and null give null."""
    t = F.lower(normalize_text(c))
    return F.when(t != "", F.sha2(t, 256))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def regex_count(c: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(pattern)).cast("bigint")
