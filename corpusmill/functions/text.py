"""Column helpers with the text semantics that the operators share. Null in, null out, unless stated."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Unicode white space as the JVM's regular expressions name it.
SPACE = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """Runs of anything but Unicode white space."""
    return F.filter(F.split(col(c), SPACE), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    """Number of words; blank text has 0."""
    return F.when(F.trim(F.regexp_replace(col(c), SPACE, " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(col(c), SPACE, " ")), " ")))


def last_words(c: Column | str, n: int) -> Column:
    """The last n words, joined by single blanks; all of a shorter text."""
    w = words(c)
    return F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), F.lit(n)), " ")


def normal_title(c: Column | str) -> Column:
    """Underscores as blanks, white space collapsed, the first letter in upper case."""
    t = F.trim(F.regexp_replace(F.replace(col(c), F.lit("_"), F.lit(" ")), SPACE, " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full Unicode case folding, which the JVM's lower() is not."""
    return s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Letters without their marks; what has no ASCII form goes."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def slug(c: Column | str, default: str = "section", fold: bool = True) -> Column:
    """Lower-case ASCII letters and digits with hyphens between; `default` where nothing is left."""
    s = F.regexp_replace(F.lower(ascii_fold(col(c)) if fold else col(c)), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def page_url(base: str, title: Column | str) -> Column:
    """Base and percent-encoded title; form encoding is corrected to path encoding."""
    e = F.url_encode(F.replace(col(title), F.lit(" "), F.lit("_")))
    for a, b in (("%2F", "/"), ("%7E", "~"), ("*", "%2A"), ("+", "%20")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return F.concat(F.lit(base), e)


def phrase_pattern(phrase: Column | str) -> Column:
    """A regular expression that finds a phrase between word boundaries, whatever signs it holds, in any case."""
    quoted = F.regexp_replace(col(phrase), r"([\\\[\](){}.*+?^$|#&~-])", r"\\$1")
    return F.concat(F.lit(r"(?iU)(?<!\w)"), quoted, F.lit(r"(?!\w)"))


def mentions(text: Column | str, phrase: Column | str) -> Column:
    return F.regexp_like(col(text), phrase_pattern(phrase))


def first_match(patterns: list[tuple[str, str]], *fields: Column | str) -> Column:
    """The name of the first pattern, in list order, that is found in any field; null if none is."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(col(f).rlike(pattern), F.lit(False))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def strip_header(c: Column | str) -> Column:
    """The text after the first blank line; all of it if there is none."""
    at = F.instr(col(c), "\n\n")
    return F.when(at > 0, F.substring(col(c), at + 2, F.lit(1 << 30))).otherwise(col(c))


def header(title: Column | str, heading: Column | str) -> Column:
    """"title § heading", or the title alone for the lede."""
    return F.when(F.coalesce(col(heading), F.lit("")) == "", col(title)).otherwise(F.concat(col(title), F.lit(" § "), col(heading)))


def prompt_fields(title, heading, kind, text) -> Column:
    """What a model is shown of a chunk: nothing of its provenance, labels or citations."""
    where = F.coalesce(F.nullif(col(heading), F.lit("")), F.lit("(lede)"))
    return F.concat(F.lit("Page: "), col(title), F.lit("\nSection: "), where, F.lit("\nType: "), col(kind), F.lit("\n\n"), strip_header(text))


def truncated(c: Column | str, limit: int, mark: str = " …[truncated]") -> Column:
    t = F.trim(col(c))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit(mark)))


def minutes(seconds: Column | str) -> Column:
    s = F.floor(col(seconds)).cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), s % 60)


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percent of a whole; an empty whole counts as 1."""
    return F.round(F.lit(100.0) * part / F.greatest(whole, F.lit(1)), digits)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 of nothing."""
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within [0, 1]; (0, 0) of nothing."""
    k, n = k.cast("double"), n.cast("double")
    p = k / F.nullif(n, F.lit(0.0))
    den = 1 + z * z / F.nullif(n, F.lit(0.0))
    mid = (p + z * z / (2 * F.nullif(n, F.lit(0.0)))) / den
    half = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0.0)) + z * z / (4 * F.nullif(n * n, F.lit(0.0)))) / den
    zero = F.lit(0.0)
    return F.when(n > 0, F.greatest(zero, mid - half)).otherwise(zero), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(zero)


def fingerprint(c: Column | str, digits: int = 12) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, digits)
