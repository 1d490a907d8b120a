"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ACCENTED, IDENTITY_STOP_WORDS, TITLE_STOP_WORDS, UNACCENTED


def bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once: inside nested lambdas an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def casefold(text: Column) -> Column:
    """Lower case with sharp s written out, as full case folding does for the letters in use."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def unmarked(text: Column) -> Column:
    """Accents and other marks off, whether composed or standing by themselves."""
    return F.translate(text, ACCENTED, UNACCENTED)


def index_tokens(text: Column) -> Column:
    """Tokens of the index: lower case, accents off, runs of letters and digits."""
    return F.regexp_extract_all(unmarked(F.lower(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(text: Column) -> Column:
    return F.regexp_extract_all(casefold(text), F.lit("[A-Za-z0-9]{2,}"), F.lit(0))


def phrase_tokens(text: Column) -> Column:
    return F.regexp_extract_all(casefold(text), F.lit("[a-z]{3,}"), F.lit(0))


def identity_tokens(text: Column) -> Column:
    """Distinct names and terms that tell cases apart."""
    words = F.array(*[F.lit(w) for w in IDENTITY_STOP_WORDS])
    return F.array_except(F.regexp_extract_all(casefold(text), F.lit("[a-z][a-z0-9]{2,}"), F.lit(0)), words)


def windows(tokens: Column, width: int) -> Column:
    """Runs of ``width`` neighbouring tokens as strings; none for shorter arrays."""

    def runs(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(t) - (width - 1)), lambda i: F.array_join(F.slice(t, i, width), " "))
        return F.when(F.size(t) >= width, each).otherwise(F.array().cast("array<string>"))

    return bind(tokens, runs)


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z\[])"), lambda s: F.trim(s)), lambda s: s != "")


def citation(text: Column) -> Column:
    return collapse(casefold(text))


def title(text: Column) -> Column:
    """Titles with their variants of `versus` and abbreviations made alike."""
    plain = F.regexp_replace(F.replace(casefold(text), F.lit("versus"), F.lit(" v ")), r"\bu\.?\s*p\.?\b", "uttar pradesh")
    stop = [F.lit(w) for w in TITLE_STOP_WORDS]
    return F.array_join(F.filter(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*stop)), " ")


def canonical_case_id(value: Column) -> Column:
    """`YYYY_N` and `YYYY INSC N` as `YYYY_N` without leading zeros, null for anything else."""
    pattern = r"(?i)^\s*(\d{4})(?:_|\s+INSC\s+)(\d+)\s*$"
    return F.when(value.rlike(pattern), F.concat_ws("_", F.regexp_extract(value, pattern, 1), F.regexp_extract(value, pattern, 2).cast("long")))


def source_id_of_url(url: Column) -> Column:
    """Name of a judgment file at the end of a URL path."""
    found = F.regexp_extract(F.parse_url(url, F.lit("PATH")), r"(?i)([^/]+)_EN\.pdf$", 1)
    return F.when(found != "", found)


def starts_after(text: Column, pattern: str) -> Column:
    """Code points before the first match of a pattern, null without a match."""
    return F.when(text.rlike(pattern), F.char_length(F.element_at(F.split(text, pattern, 2), 1)))
