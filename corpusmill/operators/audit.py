"""An audit of how far pages tell which book they belong to: by chapter, category, reference, appearance parameter or mention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from corpusmill.functions import text as T
from corpusmill.operators.labeling import audit_tier

# Infobox parameters that can name the books in which something appears.
APPEARANCE = r"(?im)^[^\S\n]*\|[^\S\n]*(first_?appear\w*|appear\w*|books?|debut|novels?)[^\S\n]*=[^\S\n]*(.*)$"
REFERENCE = r"(?is)<ref[^>/]*>(.*?)</ref>"
TIERS = ("chapter", "category", "reference", "appearance", "mention")


def appearances(text: Column | str) -> Column:
    """The appearance parameters of a text, as an array of (name, value) in order; names in lower case, values trimmed."""
    t = T.col(text)
    names, values = F.regexp_extract_all(t, F.lit(APPEARANCE), F.lit(1)), F.regexp_extract_all(t, F.lit(APPEARANCE), F.lit(2))
    return F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.struct(F.lower(x["n"]).alias("name"), F.trim(x["v"]).alias("value")))


def reference_bodies(text: Column | str) -> Column:
    """The bodies of the reference tags of a text, in any case and over lines; tags that close themselves have none."""
    return F.regexp_extract_all(T.col(text), F.lit(REFERENCE), F.lit(1))


def books_in(text: Column, books: dict[str, Sequence[str]]) -> Column:
    """The names of the books one of whose patterns is found in the text, in the order of `books`."""
    hit = lambda patterns: F.coalesce(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))
    return F.filter(F.array(*[F.when(hit(ps), F.lit(name)) for name, ps in books.items()]), lambda x: x.isNotNull())


def page_audit(pages: DataFrame, books: dict[str, Sequence[str]], categories: str | None = None, chapter_ns: int = 112) -> DataFrame:
    """Rows (pageid, tier, books, words, refs): the first tier that names a book, and the books that it names.

    A chapter's books are those of its title, categories and text together. pages: (pageid, ns, title, wikitext) and, if named, an array of categories.
    """
    body = F.coalesce("wikitext", F.lit(""))
    join = lambda x: F.array_join(x, "\n")
    by_category = books_in(join(F.coalesce(F.col(categories), F.array().cast("array<string>"))), books) if categories else F.array().cast("array<string>")
    found = {
        "category": by_category, "reference": books_in(join(reference_bodies(body)), books), "appearance": books_in(join(F.transform(appearances(body), lambda x: x["value"])), books), "mention": books_in(body, books),
    }
    rows = pages.select("pageid", "ns", F.coalesce("title", F.lit("")).alias("title"), T.word_count(body).alias("words"), F.size(reference_bodies(body)).alias("refs"), *[c.alias(f"_{n}") for n, c in found.items()])
    chapter = F.array_union(F.array_union(books_in(F.col("title"), books), F.col("_category")), F.col("_mention"))
    rows = rows.withColumn("_chapter", F.when(F.col("ns") == chapter_ns, F.when(F.size(chapter) > 0, chapter).otherwise(F.array(F.lit("?")))))
    tier = audit_tier([(t, F.col(f"_{t}")) for t in TIERS])
    named = F.coalesce(*[F.when(F.size(F.coalesce(f"_{t}", F.array().cast("array<string>"))) > 0, F.col(f"_{t}")) for t in TIERS], F.array().cast("array<string>"))
    return rows.select("pageid", "title", tier.alias("tier"), F.filter(named, lambda x: x != "?").alias("books"), "words", "refs")


def tier_report(audit: DataFrame) -> DataFrame:
    """Rows (tier, pages, words, word_share) of all tiers, those without a page too; word_share in percent, to one digit."""
    dim = audit.sparkSession.createDataFrame([(t,) for t in (*TIERS, "none")], "tier string")
    n = dim.join(audit.groupBy("tier").agg(F.count(F.lit(1)).alias("pages"), F.sum("words").cast("long").alias("words")), "tier", "left").na.fill(0)
    return n.select("tier", "pages", "words", T.share(F.col("words"), F.sum("words").over(W.partitionBy(F.lit(1)))).alias("word_share"))  # one row for each tier


def chapter_books(audit: DataFrame) -> DataFrame:
    """Rows (book, pages) of the chapters of each book."""
    return audit.where("tier = 'chapter'").select(F.explode("books").alias("book")).groupBy("book").agg(F.count(F.lit(1)).alias("pages"))


def reference_density(audit: DataFrame) -> DataFrame:
    """One row (pages, median): references per 1000 words of the pages that have words, and the value in the middle, sorted[n // 2]."""
    from corpusmill.operators.profiling import distribution

    rate = audit.where("words > 0").select(F.round(F.col("refs") * 1000.0 / F.col("words"), 6).alias("v"))
    return distribution(rate, "v", quantiles=(0.5,)).select(F.col("n").alias("pages"), F.col("p50").alias("median"))


def no_signal(audit: DataFrame, n: int = 15) -> DataFrame:
    """The longest pages of tier "none"."""
    return audit.where("tier = 'none'").orderBy(F.desc("words"), "pageid").limit(n).select("pageid", "title", "words")


def needs_labels(report: DataFrame, most: float = 15.0) -> bool:
    """Whether pages without a signal hold more than `most` percent of the words."""
    return any(r.word_share > most for r in report.where("tier = 'none'").collect())  # one row
