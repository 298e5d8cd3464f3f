"""Text expressions. All are columns unless they say otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Glyphs of vulgar fractions and what they stand for.
FRACTIONS = {
    "½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5",
    "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⁄": "/",
}


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def plain(x: Column) -> Column:
    """Lower case, collapsed."""
    return F.lower(collapsed(x))


@pandas_udf(StringType())
def canonical(x: pd.Series) -> pd.Series:
    """NFKC, case-folded, collapsed; Spark has no function for the first two."""
    return x.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@pandas_udf(StringType())
def unaccented(x: pd.Series) -> pd.Series:
    """Without combining marks."""
    return x.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def tokens(x: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def excerpt(x: Column, limit: int = 600) -> Column:
    """Collapsed text, cut to ``limit`` characters with an ellipsis."""
    t = collapsed(x)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("…")))


def estimated_tokens(x: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("long")


def reserved_tokens(x: Column) -> Column:
    """An upper bound: UTF-8 bytes and 8 for the wrapping."""
    return (F.octet_length(x) + 8).cast("long")


def ascii_fractions(x: Column) -> Column:
    """Vulgar-fraction glyphs as a/b, a space before them where a digit stands."""
    glyphs = "".join(FRACTIONS)[:-1]
    t = F.regexp_replace(x, f"([0-9])([{glyphs}])", "$1 $2")
    for glyph, value in FRACTIONS.items():
        t = F.replace(t, F.lit(glyph), F.lit(value))
    return t


#: What personal data looks like and what stands in its place, in the order of replacement. A word (``\b``) is
#: one of any alphabet (``whole_words``); white space is ASCII's.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+\d[\d\s\x0B().-]{7,}\d|\b\d{3}[-.\s\x0B]?\d{3}[-.\s\x0B]?\d{4}\b|\(\d{3}\)[\s\x0B]*\d{3}[-.\s\x0B]?\d{4})"
STREETS = "street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|circle|cir|place|pl|terrace|ter|way|plaza|parkway|pkwy"
ADDRESS = rf"(?i)\b\d{{1,6}}[\s\x0B]+[A-Za-z0-9.'-]{{2,}}(?:[\s\x0B]+[A-Za-z0-9.'-]{{2,}}){{0,3}}[\s\x0B]+(?:{STREETS})\b\.?"
NAMED = r"\bmy[\s\x0B]+[A-Z][a-zA-Z'-]{1,40}(?:[\s\x0B]+[A-Z][a-zA-Z'-]{1,40})?"
MARKS = ((EMAIL, "[redacted-email]"), (PHONE, "[redacted-phone]"), (ADDRESS, "[redacted-address]"), (NAMED, "my [redacted-name]"))


def whole_words(pattern: str) -> str:
    """The pattern with ``\\b``, each beside a word character of its own, at words of any alphabet; Java's differs from version to version."""
    w = r"[\p{L}\p{M}\p{N}_]"
    return re.sub(r"\\b(?=\\d|\w)", lambda _: f"(?<!{w})", pattern).replace(r"\b", f"(?!{w})")


def scrubbed(x: Column, limit: int = 500) -> Column:
    """Each kind of personal data replaced by its mark, then cut to ``limit`` characters; null as empty."""
    t = F.coalesce(x, F.lit(""))
    for pattern, mark in MARKS:
        t = F.regexp_replace(t, whole_words(pattern), mark)
    return F.substring(t, 1, limit)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def url_minimal(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def url_key(url: Column) -> Column:
    """Provenance key: scheme and leading ``www.`` dropped, no trailing slash."""
    bare = F.regexp_replace(url_minimal(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"/+$", ""))


def within_domain(host: Column, domain: str) -> Column:
    """The domain itself or a subdomain of it; never another name that only ends alike."""
    return (host == domain) | host.endswith("." + domain)


def first_match(x: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first (label, pattern) whose pattern occurs in ``x``."""
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(x.rlike(pattern), label).otherwise(out)
    return out


def says_word(words: Column, word: Column | str) -> Column:
    """Whether a token list has the word or its plural in s or es."""
    w = F.lit(word) if isinstance(word, str) else word
    return F.exists(words, lambda t: (t == w) | (t == F.concat(w, F.lit("s"))) | (t == F.concat(w, F.lit("es"))))


def singular(x: Column) -> Column:
    """ies -> y, oes -> o, s -> nothing (not ss)."""
    return (
        F.when(x.endswith("ies") & (F.length(x) > 4), F.concat(x.substr(F.lit(1), F.length(x) - 3), F.lit("y")))
        .when(x.endswith("oes") & (F.length(x) > 4), x.substr(F.lit(1), F.length(x) - 2))
        .when(x.endswith("s") & ~x.endswith("ss") & (F.length(x) > 3), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x)
    )
