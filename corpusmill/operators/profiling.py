"""Aggregates that describe a corpus: histograms, percentiles, coverage, inventories of templates and headings, references.

Groups of any size are reduced before they are ordered: a percentile reads the counts of distinct values, never a collected list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from corpusmill.functions import text as T, wikitext
from corpusmill.runtime import ship

#: Ranges of values that the distinct values of a group are ordered in.
RANGES = 1024


def histogram(df: DataFrame, value: str, bounds: list[int]) -> DataFrame:
    """Rows (bucket_no, bucket, n) of half-open buckets, the last one open; empty buckets are kept. Null values are in none."""
    spark = df.sparkSession
    edges = list(zip(bounds, [*bounds[1:], None]))
    dim = spark.createDataFrame([(i, f"{lo}–{hi}" if hi is not None else f"{lo}+") for i, (lo, hi) in enumerate(edges)], "bucket_no int, bucket string")
    no = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(edges):
        no = F.when((F.col(value) >= lo) & ((F.col(value) < hi) if hi is not None else F.lit(True)), F.lit(i)).otherwise(no)
    counts = df.select(no.alias("bucket_no")).groupBy("bucket_no").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "bucket_no", "left").select("bucket_no", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distribution(df: DataFrame, value: str, groups: list[str] = (), quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Rows (groups, n, p50, p90, p99, largest): sorted[min(floor(q * n), n - 1)] of each group. Null values are left out."""
    groups = list(groups)
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    # distinct values are ordered within ranges of values; a range's counts before it are added afterwards
    spans = counted.groupBy(*groups).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("k").alias("n"))
    on = (lambda x: x.crossJoin(F.broadcast(spans))) if not groups else (lambda x: x.join(spans, groups))  # without groups a single row
    part = F.least(F.floor((F.col("v") - F.col("lo")) * RANGES / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))), F.lit(RANGES - 1)).cast("int")
    placed = on(counted).withColumn("part", part)
    parts = placed.groupBy(*groups, "part").agg(F.sum("k").alias("m"))
    before = parts.withColumn("before", F.sum("m").over(W.partitionBy(*(groups or [F.lit(0)])).orderBy("part")) - F.col("m")).drop("m")  # RANGES rows of a group
    placed = placed.join(before, [*groups, "part"]).withColumn("upto", F.col("before") + F.sum("k").over(W.partitionBy(*groups, "part").orderBy("v")))
    # the first value whose running count passes the place
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(float(q)) * F.col("n")), F.col("n") - 1), F.col("v")))
    return placed.groupBy(*groups).agg(F.max("n").alias("n"), *[at(q).alias(f"p{q * 100:g}".replace(".", "_")) for q in quantiles], F.max("v").alias("largest"))


def distribution_grains(df: DataFrame, value: str, group: str) -> DataFrame:
    """The distribution of all rows (group null) and of each group."""
    every = distribution(df, value).select(F.lit(None).cast(dict(df.dtypes)[group]).alias(group), "*")
    return every.unionByName(distribution(df.where(F.col(group).isNotNull()), value, [group]))


def label_coverage(chunks: DataFrame, tiers: list[str]) -> DataFrame:
    """Rows (tier, chunks, chunk_share, words, word_share) of the given tiers and "null", each present even if empty."""
    dim = chunks.sparkSession.createDataFrame([(t,) for t in [*tiers, "null"]], "tier string")
    counts = chunks.groupBy(F.coalesce("label_provenance", F.lit("null")).alias("tier")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.coalesce("word_count", F.lit(0))).cast("long").alias("words"))
    full = dim.join(counts, "tier", "left").select("tier", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("words", F.lit(0)).alias("words"))
    every = W.partitionBy(F.lit(1))  # one row for each tier
    return full.select("tier", "chunks", T.share(F.col("chunks"), F.sum("chunks").over(every)).alias("chunk_share"), "words", T.share(F.col("words"), F.sum("words").over(every)).alias("word_share"))


def _rows(pages: DataFrame, read, schema: str) -> DataFrame:
    """Rows that `read` makes of each page: (page key, ...)."""
    ship(pages.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in read(text):
                    for c, v in zip(columns, (key, *row)):
                        c.append(v)
            kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "))], names)

    return pages.where("wikitext IS NOT NULL").select("pageid", "wikitext").mapInArrow(run, schema)


def template_uses(pages: DataFrame) -> DataFrame:
    """Rows (pageid, seq, name, display, first_param, raw, n_params), nested templates included."""
    read = lambda text: [(i, wikitext.normal_name(t.name), t.name, t.get("1"), t.raw, len(t.params)) for i, t in enumerate(wikitext.templates(text))]
    return _rows(pages, read, "pageid long, seq int, name string, display string, first_param string, raw string, n_params int")


def template_inventory(uses: DataFrame) -> DataFrame:
    """Rows (name, uses, pages, display, example): the commonest spelling, the longest example; ties by the first seen."""
    spelled = uses.groupBy("name", "display").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("pageid", "seq")).alias("first"))
    display = spelled.groupBy("name").agg(F.min_by("display", F.struct(-F.col("k"), "first")).alias("display"))
    totals = uses.groupBy("name").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("pageid").alias("pages"), F.min_by("raw", F.struct(-F.length("raw"), "pageid", "seq")).alias("example"))
    return totals.join(display, "name").select("name", "uses", "pages", "display", "example")


def section_rows(pages: DataFrame) -> DataFrame:
    """Rows (pageid, seq, path, heading, level, words, ref_tags, ref_templates, raw) of the sections of each page."""

    def read(text):
        for s in wikitext.sections(text):
            refs = sum(wikitext.normal_name(t.name) == "ref" for t in wikitext.templates(s.body))
            yield s.seq, s.path, s.path.rpartition(" > ")[2], s.level, len(wikitext.plain(s.body).split()), len(wikitext.references(s.body)), refs

    return _rows(pages, read, "pageid long, seq int, path string, heading string, level int, words int, ref_tags int, ref_templates int")


def heading_inventory(sections: DataFrame, speculative: list[str]) -> DataFrame:
    """Rows (heading, uses, pages, levels, display, speculative), headings compared in lower case."""
    named = sections.where("level > 0").withColumn("h", F.lower(F.trim("heading")))
    levels = named.groupBy("h", "level").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "k")))).alias("levels"))
    shown = named.groupBy("h", "heading").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("pageid", "seq")).alias("first")).groupBy("h").agg(F.min_by("heading", F.struct(-F.col("k"), "first")).alias("display"))
    totals = named.groupBy("h").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("pageid").alias("pages"))
    return totals.join(levels, "h").join(shown, "h").select(F.col("h").alias("heading"), "uses", "pages", "levels", "display", F.col("h").isin(speculative).alias("speculative"))


def reference_behaviour(sections: DataFrame) -> DataFrame:
    """One row: sections, and the percent of them with reference tags, with reference templates and with either; sections beyond 500 and below 50 words."""
    n = F.count(F.lit(1))
    some = lambda c: T.share(F.count_if(c), n)
    tags, tpl = F.col("ref_tags") > 0, F.col("ref_templates") > 0
    return sections.agg(n.alias("sections"), some(tags).alias("with_tag"), some(tpl).alias("with_template"), some(tags | tpl).alias("with_any"), F.count_if(F.col("words") > 500).alias("over_500"), F.count_if((F.col("level") > 0) & (F.col("words") < 50)).alias("under_50"))


def reference_survival(pages: DataFrame, least: float = 0.5) -> DataFrame:
    """One row (refs, survived, share): reference bodies with words, and those of whose words more than `least` are left in the plain text of the body."""

    def read(text):
        for _, body in wikitext.references(text):
            words = (body or "").split()
            if words:
                yield len(words), len(wikitext.plain(body).split())

    rows = _rows(pages, read, "pageid long, words int, kept int")
    kept = F.count_if(F.col("kept") > F.col("words") * least)
    return rows.agg(F.count(F.lit(1)).alias("refs"), kept.alias("survived")).withColumn("share", T.share(F.col("survived"), F.col("refs")))


def reference_histogram(sections: DataFrame, bounds: list[int]) -> DataFrame:
    """Sections by their number of references, tags and templates together."""
    return histogram(sections.select((F.col("ref_tags") + F.col("ref_templates")).alias("refs")), "refs", bounds)


def top_parameters(uses: DataFrame, name: str, n: int = 10) -> DataFrame:
    """Rows (first_param, uses): the commonest first parameters of a template, by count and then in order."""
    return top(uses.where((F.col("name") == name) & F.col("first_param").isNotNull()).groupBy("first_param").agg(F.count(F.lit(1)).alias("uses")), [F.desc("uses"), F.asc("first_param")], n)


def category_leaks(pages: DataFrame, text: str = "wikitext") -> DataFrame:
    """One row (pages): texts in whose plain form a category link's words still stand."""
    leak = F.col(text).rlike(r"(?i)(?<!\[\[)\bcategory:\S")
    return pages.where(F.col(text).isNotNull()).agg(F.count_if(leak).alias("pages"))


def near_empty(pages: DataFrame, words: int = 20, chars: int = 300) -> DataFrame:
    """Rows (pageid, words, chars) of pages that are long as markup and nearly empty as plain text, the emptiest first."""
    rows = _rows(pages, lambda text: [(len(wikitext.plain(text).split()), len(text))], "pageid long, words int, chars int")
    return rows.where((F.col("words") < words) & (F.col("chars") >= chars)).orderBy("words", "pageid")


def residue_windows(df: DataFrame, key: str, text: str, pattern: str, before: int = 80, after: int = 160) -> DataFrame:
    """Rows (key, hits, excerpt) of the texts in which the pattern is found, with a window around its first hit."""
    at = F.regexp_instr(F.col(text), F.lit(pattern))
    rows = df.where(F.col(text).rlike(pattern))
    start = F.greatest(F.lit(1), at - before)
    return rows.select(key, F.regexp_count(F.col(text), F.lit(pattern)).alias("hits"), F.substring(F.col(text), start, at + after - start).alias("excerpt"))


def top(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    """The first n rows in an order without ties; Spark keeps n rows for each task."""
    return df.orderBy(*by).limit(n)


def findings(sections: dict, coverage: dict, templates: dict | None = None, survival: dict | None = None, garbage: dict | None = None) -> list[str]:
    """Conclusions from the one-row aggregates of a profile, as sentences for its report; each holds only where its figures are given.

    templates: uses of the templates quote, ref and infobox, names in all and names used once; garbage: residue_pages, near_empty, category_leaks.
    """
    n = max(sections["sections"], 1)
    rules: list[tuple[bool, str]] = [
        (sections["over_500"] / n < 0.05, f"Few sections are long: {sections['over_500']} of {sections['sections']} exceed 500 words, so most sections are one chunk."),
        (sections["over_500"] / n >= 0.05, f"{sections['over_500']} of {sections['sections']} sections exceed 500 words and need splitting."),
        (sections["under_50"] / n > 0.3, f"{sections['under_50']} sections have fewer than 50 words."),
        (sections["with_any"] < 50, f"References reach {sections['with_any']} % of the sections; labels can't rest on them alone."),
        (bool(coverage.get("null")), f"{coverage.get('null')} chunks have no deterministic label."),
    ]
    if templates:
        rules += [
            (templates.get("quote", 0) >= 5, f"Quote templates are used {templates.get('quote')} times and are worth chunks of their own."),
            (templates.get("infobox", 0) > 0, f"{templates.get('infobox')} infoboxes hold facts that the prose may lack."),
            (templates.get("ref", 0) > 0, f"{templates.get('ref')} reference templates name their source by a code."),
            (templates.get("once", 0) / max(templates.get("names", 1), 1) > 0.5, f"{templates.get('once')} of {templates.get('names')} templates are used once; rules for single templates pay off for the others only."),
        ]
    if survival and survival["refs"]:
        rules.append((survival["survived"] < survival["refs"], f"{survival['refs'] - survival['survived']} of {survival['refs']} reference bodies don't survive the stripping and have to be read before it."))
    if garbage:
        rules += [
            (garbage.get("residue_pages", 0) > 0, f"{garbage.get('residue_pages')} pages keep markup after stripping."),
            (garbage.get("near_empty", 0) > 0, f"{garbage.get('near_empty')} pages are nearly empty once stripped."),
            (garbage.get("category_leaks", 0) > 0, f"Category names leak into the text of {garbage.get('category_leaks')} pages."),
        ]
    return [text for holds, text in rules if holds]
