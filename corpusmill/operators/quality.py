"""Data-quality rules. Each gives rows (check, severity, message, observed); a report is ok if none has failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import text as T

ORDER = ["PASS", "INFO", "WARN", "FAIL"]


def rule(df: DataFrame, check: str, observed: Column, severity: Column, message: str) -> DataFrame:
    """A rule over a one-row aggregate."""
    return df.agg(observed.cast("double").alias("observed")).select(F.lit(check).alias("check"), severity.alias("severity"), F.lit(message).alias("message"), "observed")


def fails_if_any(df: DataFrame, check: str, bad: Column, message: str, severity: str = "FAIL") -> DataFrame:
    return rule(df, check, F.count_if(F.coalesce(bad, F.lit(False))), F.when(F.col("observed") > 0, severity).otherwise("PASS"), message)


def namespace_drift(pages: DataFrame, expected: dict[int, int], tolerance: float = 0.05) -> DataFrame:
    """Counts of each namespace against expected ones: equal passes, a small drift warns, a larger one and an unknown namespace fail."""
    want = pages.sparkSession.createDataFrame(list(expected.items()), "ns int, expected long")
    both = pages.groupBy("ns").agg(F.count(F.lit(1)).alias("n")).join(want, "ns", "full").select("ns", F.coalesce("n", F.lit(0)).alias("n"), "expected")
    drift = F.abs(F.col("n") - F.col("expected")) / F.col("expected")
    severity = F.when(F.col("expected").isNull(), "FAIL").when(F.col("n") == F.col("expected"), "PASS").when(drift <= tolerance, "WARN").otherwise("FAIL")
    return both.select(F.concat(F.lit("namespace "), F.col("ns").cast("string")).alias("check"), severity.alias("severity"), F.lit("pages against expected").alias("message"), F.col("n").cast("double").alias("observed"))


def page_checks(pages: DataFrame, stub: int = 200) -> DataFrame:
    """Duplicate ids, blank and short texts, and whether chapter pages look raw."""
    ids = pages.groupBy("pageid").agg(F.count(F.lit(1)).alias("k"))
    text = F.trim(F.coalesce("wikitext", F.lit("")))
    chapters = pages.where("ns = 112")
    raw = T.ratio(F.count_if(F.contains(F.col("wikitext"), F.lit("{{"))), F.count(F.lit(1)))
    return (
        fails_if_any(ids, "unique page ids", F.col("k") > 1, "page ids that come more than once")
        .unionByName(fails_if_any(pages, "blank pages", text == "", "pages without text"))
        .unionByName(fails_if_any(pages, "stubs", (text != "") & (F.length(text) < stub), f"pages under {stub} characters", "INFO"))
        .unionByName(rule(chapters, "chapters are raw", F.round(raw, 4), F.when(F.col("observed") > 0.5, "PASS").otherwise("FAIL"), "share of chapter pages with templates"))
    )


def first_violation(kinds: list[str], provenances: list[str]) -> Column:
    """The first rule that a chunk breaks, in the order of precedence; null if none."""
    return (
        F.when(F.col("chunk_id").isNull() | F.col("page_id").isNull() | F.col("text").isNull(), "missing field")
        .when(~F.coalesce(F.col("chunk_type").isin(kinds), F.lit(False)), "chunk_type")
        .when(F.col("book_level").isNotNull() & ~F.col("book_level").between(1, 3), "book_level")
        .when(F.col("label_provenance").isNotNull() & ~F.col("label_provenance").isin(provenances), "label_provenance")
        .when(F.trim("text") == "", "blank text")
        .when(F.coalesce(F.col("word_count"), F.lit(0)) <= 0, "word_count")
        .when(F.coalesce(F.col("content_hash") != F.sha2("text", 256), F.lit(True)), "content_hash")
    )


def chunk_checks(chunks: DataFrame, kinds: list[str], provenances: list[str], markup: list[str]) -> DataFrame:
    """Schema rules, unique ids, markup residue, gold on chapters, and sections that were split."""
    v = chunks.withColumn("violation", first_violation(kinds, provenances))
    ids = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("k"))
    chapters = chunks.where("ns = 112")
    return (
        fails_if_any(v, "chunk schema", F.col("violation").isNotNull(), "chunks that break a rule")
        .unionByName(fails_if_any(ids, "unique chunk ids", F.col("k") > 1, "chunk ids that come more than once"))
        .unionByName(fails_if_any(chunks, "no markup", first_literal("text", markup).isNotNull(), "chunks with markup residue"))
        .unionByName(fails_if_any(chapters, "chapters are gold", ~F.coalesce(F.col("label_provenance") == "gold", F.lit(False)), "chapter chunks without a gold label"))
        .unionByName(rule(split_sections(chunks), "split sections", F.count(F.lit(1)), F.when(F.col("observed") == 0, "WARN").otherwise("INFO"), "sections in more than one chunk"))
    )


def first_literal(text: str, literals: list[str]) -> Column:
    """The first of several literal strings, in list order, that a text holds."""
    out = F.lit(None).cast("string")
    for x in reversed(literals):
        out = F.when(F.contains(F.col(text), F.lit(x)), F.lit(x)).otherwise(out)
    return out


def split_sections(chunks: DataFrame) -> DataFrame:
    """Rows (page_id, section, parts) of the sections with more than one prose chunk."""
    prose = chunks.where(F.lower(F.trim("chunk_type")) == "prose")
    return prose.groupBy("page_id", F.substring_index("chunk_id", ":", 2).alias("section")).agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")


def schema_difference(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """The names of columns that only the first and only the second table has."""
    return sorted(set(a.columns) - set(b.columns)), sorted(set(b.columns) - set(a.columns))


def schema_check(df: DataFrame, expected: list[str]) -> DataFrame:
    """Whether a table has exactly the expected columns; observed: how many it lacks or has beyond them."""
    off = sorted(set(df.columns) ^ set(expected))
    row = [("columns", "FAIL" if off else "PASS", "columns that are missing or unexpected" + (f": {', '.join(off)}" if off else ""), float(len(off)))]
    return df.sparkSession.createDataFrame(row, "`check` string, severity string, message string, observed double")


def chapter_checks(pages: DataFrame, book: str = r"\|\s*book", chapter_ns: int = 112) -> DataFrame:
    """Chapters look raw: more than half of them hold templates, and at least one has a book parameter; a corpus without chapters fails."""
    chapters = pages.where(F.col("ns") == chapter_ns)
    raw = T.ratio(F.count_if(F.contains(F.col("wikitext"), F.lit("{{"))), F.count(F.lit(1)))
    enough = F.when(F.col("observed") > 0, "PASS").otherwise("FAIL")
    return report(
        rule(chapters, "chapters", F.count(F.lit(1)), enough, "chapter pages"),
        rule(chapters, "chapters are raw", F.round(raw, 4), F.when(F.col("observed") > 0.5, "PASS").otherwise("FAIL"), "share of chapter pages with templates"),
        rule(chapters, "chapters name books", F.count_if(F.coalesce(F.col("wikitext").rlike(book), F.lit(False))), enough, "chapter pages with a book parameter"),
    )


def spot_checks(chunks: DataFrame, infobox_of: str, quote_of: str, gold_pages: int, garbage: list[str] = (), tolerance: float = 0.05) -> DataFrame:
    """A named page has an infobox, a named page has a quote, the number of gold pages is as expected, and known garbage pages are there."""
    kind = F.lower(F.trim("chunk_type"))
    has = lambda title, k: F.count_if((F.col("page_title") == title) & (kind == k))
    some = F.when(F.col("observed") > 0, "PASS").otherwise("FAIL")
    drift = F.abs(F.col("observed") - gold_pages) / max(gold_pages, 1)
    rows = report(
        rule(chunks, f"infobox of {infobox_of}", has(infobox_of, "infobox"), some, "infobox chunks of the page"),
        rule(chunks, f"quote of {quote_of}", has(quote_of, "quote"), some, "quote chunks of the page"),
        rule(chunks, "gold pages", F.count_distinct(F.when(F.col("label_provenance") == "gold", F.col("page_id"))), F.when(F.col("observed") == gold_pages, "PASS").when(drift <= tolerance, "WARN").otherwise("FAIL"), f"pages with a gold label, {gold_pages} expected"),
    )
    if garbage:
        names = chunks.sparkSession.createDataFrame([(g,) for g in garbage], "page_title string")
        absent = names.join(chunks.select("page_title").distinct(), "page_title", "left_anti")
        rows = rows.unionByName(rule(absent, "known garbage pages", F.count(F.lit(1)), F.when(F.col("observed") == 0, "PASS").otherwise("WARN"), "known garbage pages that are absent"))
    return rows


def distribution_checks(chunks: DataFrame, tiers: list[str]) -> DataFrame:
    """Facts for the reader: chunks of each provenance and kind, and the median and longest chunk."""
    kind = F.coalesce(F.lower(F.trim("chunk_type")), F.lit("null"))
    info = lambda name, rows: rows.select(F.concat(F.lit(f"{name} "), F.col("k")).alias("check"), F.lit("INFO").alias("severity"), F.lit("chunks").alias("message"), F.col("n").cast("double").alias("observed"))
    counted = lambda c: chunks.groupBy(c.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return report(
        info("provenance", counted(F.coalesce("label_provenance", F.lit("null")))), info("kind", counted(kind)),
        rule(chunks, "longest chunk", F.max("word_count"), F.lit("INFO"), "words"), rule(chunks, "unlabelled", F.count_if(~F.coalesce(F.col("label_provenance").isin(tiers), F.lit(False))), F.lit("INFO"), "chunks without a known provenance"),
    )


def kind_of(path: str) -> str:
    """What a file holds, by its name."""
    return "chunks" if "chunk" in path.rstrip("/").rsplit("/", 1)[-1].lower() else "pages"


def report(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def verdict(rows: DataFrame) -> tuple[bool, list[str]]:
    """Whether nothing failed, and the lines in the order pass, info, warning, failure. A report has a row for each rule."""
    lines = sorted(rows.collect(), key=lambda r: (ORDER.index(r.severity), r.check))
    return all(r.severity != "FAIL" for r in lines), [f"{r.severity} {r.check}: {r.message} ({r.observed:g})" for r in lines]
