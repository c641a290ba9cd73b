"""The link graph: classifying and resolving link targets, edges and pairs, and finding the chunks that hold a link or a mention.

Small lookups (titles, redirects) are joined by key, so Spark broadcasts them only under its size threshold. Joins of chunks and
targets are equi joins on the page with the text condition behind them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from corpusmill.functions import text as T, wikitext
from corpusmill.runtime import ship

#: Targets of a page that are looked for together.
PAGE_TARGETS = 4000

# Prefixes of wiki housekeeping namespaces and of links to other wikis, which are never pages of the corpus.
NAMESPACES = ["category", "category talk", "file", "image", "template", "template talk", "user", "user talk", "talk", "help", "mediawiki", "special", "portal", "forum", "board", "thread", "module"]
INTERWIKI = ["wikipedia", "wiktionary", "commons", "meta", "w", "en", "es", "de", "fr", "pl", "pt", "it", "ru", "nl", "ja", "zh", "ko", "sv", "no", "fi", "da", "cs", "hu", "tr", "ar", "he", "uk", "el", "ro", "bg", "hr", "sr", "sk", "sl", "lt", "lv", "et", "vi", "th", "id", "ms", "fa", "hi"]


def link_occurrences(pages: DataFrame) -> DataFrame:
    """Rows (page_id, pos, raw_target, display) of the links of each page in document order."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, t, d) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, (t, d) in enumerate(wikitext.links(text))]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()))], ["page_id", "pos", "raw_target", "display"])

    return pages.where("wikitext IS NOT NULL").select("pageid", "wikitext").mapInArrow(run, "page_id long, pos int, raw_target string, display string")


def classified(links: DataFrame, raw: str = "raw_target") -> DataFrame:
    """Add action (candidate, anchor, namespace, interwiki) and target: the link without its anchor and leading colons."""
    bare = F.trim(F.regexp_replace(F.trim(F.substring_index(F.col(raw), "#", 1)), "^:+", ""))
    prefix = F.lower(F.trim(F.substring_index(bare, ":", 1)))
    has = F.instr(bare, ":") > 0
    action = F.when(bare == "", "anchor").when(has & prefix.isin(NAMESPACES), "namespace").when(has & prefix.isin(INTERWIKI), "interwiki").otherwise("candidate")
    return links.withColumn("target", bare).withColumn("action", F.coalesce(action, F.lit("anchor")))


def resolved(links: DataFrame, titles: DataFrame, redirects: DataFrame | None = None, target: str = "target", fold=F.lower) -> DataFrame:
    """Add target_id and method: exact, normalized, casefold (where one page alone has that form), redirect, or null.

    titles: (page_id, title); of equal titles the highest page_id counts. redirects: (from, to), accepted where `to` is an exact title.
    """
    exact = titles.where("title IS NOT NULL").groupBy("title").agg(F.max("page_id").alias("page_id"))
    folded = exact.groupBy(fold("title").alias("folded")).agg(F.count(F.lit(1)).alias("k"), F.max("page_id").alias("fold_id")).where("k = 1").drop("k")
    redirects = links.sparkSession.createDataFrame([], "`from` string, `to` string") if redirects is None else redirects
    to = redirects.select(F.col("from").alias("from_title"), F.col("to").alias("title")).join(exact, "title").groupBy("from_title").agg(F.max("page_id").alias("redirect_id"))
    out = links.withColumn("_n", T.normal_title(target))
    spaced = F.trim(F.regexp_replace(F.replace(F.col(target), F.lit("_"), F.lit(" ")), T.SPACE, " "))
    out = out.withColumn("_s", spaced).withColumn("_f", fold("_n"))
    out = out.join(exact.select(F.col("title").alias(target), F.col("page_id").alias("exact_id")), target, "left")
    out = out.join(exact.select(F.col("title").alias("_n"), F.col("page_id").alias("normal_id")), "_n", "left")
    out = out.join(folded.withColumnRenamed("folded", "_f"), "_f", "left").join(to.withColumnRenamed("from_title", "_s"), "_s", "left")
    ids = ["exact_id", "normal_id", "fold_id", "redirect_id"]
    method = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("normal_id").isNotNull(), "normalized").when(F.col("fold_id").isNotNull(), "casefold").when(F.col("redirect_id").isNotNull(), "redirect")
    return out.withColumn("target_id", F.coalesce(*ids)).withColumn("method", method).drop("_n", "_s", "_f", *ids)


def unresolved_work_list(links: DataFrame, target: str = "target") -> DataFrame:
    """The distinct normalized targets that no page has, in order."""
    return links.where("action = 'candidate' AND method IS NULL").select(T.normal_title(target).alias("target")).distinct().orderBy("target")


def edges(links: DataFrame) -> DataFrame:
    """Rows (src, dst, links, displays) of resolved links, self links left out, displays in document order."""
    rows = links.where("target_id IS NOT NULL AND target_id <> page_id")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("pos", "display"))), lambda x: x["display"])  # bounded by the links of one page
    return rows.groupBy(F.col("page_id").alias("src"), F.col("target_id").alias("dst")).agg(F.count(F.lit(1)).alias("links"), shown.alias("displays"))


def outcomes(links: DataFrame) -> DataFrame:
    """Rows (outcome, n): what became of each link occurrence."""
    what = F.when(F.col("action") != "candidate", F.concat(F.lit("skipped "), "action")).when(F.col("target_id").isNull(), "unresolved").when(F.col("target_id") == F.col("page_id"), "self link").otherwise(F.col("method"))
    return links.groupBy(what.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def pairs(edge_rows: DataFrame) -> DataFrame:
    """Rows (a, b, directions) of unordered pairs with a < b."""
    return edge_rows.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count_distinct(F.col("src") < F.col("dst")).alias("directions"))


def pair_stats(pair_rows: DataFrame) -> DataFrame:
    return pair_rows.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("directions") == 2).alias("bidirectional"), F.count_if(F.col("directions") == 1).alias("one_directional"))


def coarse_type(categories: Column | str, groups: list[tuple[str, list[str]]], default: str = "Other") -> Column:
    """The first group one of whose keywords is part of a category."""
    c = T.col(categories)
    out = F.lit(default)
    for name, keys in reversed(groups):
        pattern = "|".join(keys)
        hit = F.exists(c, lambda x: F.lower(x).rlike(pattern))  # noqa: B023: built at once
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def page_types(chunks: DataFrame, groups: list[tuple[str, list[str]]]) -> DataFrame:
    """Rows (page_id, page_type), by the categories of the page's first chunk."""
    first = chunks.groupBy("page_id").agg(F.min_by("categories", "chunk_id").alias("categories"))
    return first.select("page_id", coarse_type("categories", groups).alias("page_type"))


def type_crosstab(pair_rows: DataFrame, types: DataFrame) -> DataFrame:
    """Rows (type_a, type_b, pairs) with type_a <= type_b; pages without a type are "Other"."""
    t = lambda x: types.select(F.col("page_id").alias(x), F.col("page_type").alias(f"t_{x}"))
    rows = pair_rows.join(t("a"), "a", "left").join(t("b"), "b", "left").select(F.coalesce("t_a", F.lit("Other")).alias("x"), F.coalesce("t_b", F.lit("Other")).alias("y"))
    return rows.groupBy(F.least("x", "y").alias("type_a"), F.greatest("x", "y").alias("type_b")).agg(F.count(F.lit(1)).alias("pairs"))


class _Phrases:
    """Finds many phrases in a text at once, in lower case by full folding, as whole words."""

    def __init__(self, phrases: set[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p in phrases:
            if low := p.casefold():
                self.automaton.add_word(low, low)
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str) -> set[str]:
        """The folded phrases that stand in the text between signs, spaces or its ends."""
        low = text.casefold()
        word = lambda k: 0 <= k < len(low) and (low[k].isalnum() or low[k] == "_")
        return {p for end, p in self.automaton.iter(low) if p and not word(end + 1) and not word(end - len(p))} if len(self.automaton) else set()


def localized(edge_rows: DataFrame, chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows (chunk_id, source_page_id, target_page_id, target_page_title, direction, match_type) for both directions of each pair.

    For each display of a link, in order, the first chunk of the source page, in chunk order, that is not used yet and holds it is
    a "link" row; every other chunk that holds the target's title is a "text" row, forward if any link goes that way.

    A page's texts and its targets come to one task, in order and each once, and are held in blocks of `PAGE_TARGETS` targets, however
    many a page has; texts pass through while all phrases of a block are looked for at once. What is
    moved is one row for each chunk and block of targets of its page, and one for each target.

    chunks: (chunk_id, page_id, chunk_seq, text); edge_rows: (src, dst, displays); titles: (page_id, title).
    """
    ship(chunks.sparkSession)
    none = F.expr("cast(array() as array<string>)")
    both = edge_rows.select("src", "dst", "displays").unionByName(edge_rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), none.alias("displays")))
    both = both.groupBy("src", "dst").agg(F.max_by("displays", F.size("displays")).alias("displays"))
    named = both.join(titles.select(F.col("page_id").alias("dst"), "title").hint("merge"), "dst")
    blocks = named.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / PAGE_TARGETS).cast("int").alias("k"))
    own = named.join(blocks.hint("merge"), "src").select("src", F.pmod(F.xxhash64("dst"), F.col("k")).cast("int").alias("b"), "dst", "title", "displays")
    texts = chunks.where("text IS NOT NULL").join(blocks.withColumnRenamed("src", "page_id").hint("merge"), "page_id").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    lit = lambda kind: F.lit(None).cast(kind)
    seq = dict(chunks.dtypes)["chunk_seq"]
    rows = own.select("src", "b", F.lit(0).alias("part"), lit(seq).alias("chunk_seq"), lit("string").alias("chunk_id"), lit("string").alias("text"), "dst", "title", "displays").unionByName(
        texts.select(F.col("page_id").alias("src"), "b", F.lit(1).alias("part"), "chunk_seq", "chunk_id", "text", lit("long").alias("dst"), lit("string").alias("title"), lit("array<string>").alias("displays"))
    )
    # targets come before the texts of their page
    rows = rows.repartition("src", "b").sortWithinPartitions("src", "b", "part", "chunk_seq", "chunk_id", "dst").select("src", "b", "chunk_id", "text", "dst", "title", "displays")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, targets, chunks_of, hits = None, [], [], []
        phrases: _Phrases | None = None
        out: list[tuple] = []

        def close() -> None:
            for dst, title, displays in targets:
                used: dict[int, tuple[str, str]] = {}
                for flat in displays:
                    hit = next((k for k, found in enumerate(hits) if flat and k not in used and flat.casefold() in found), None)
                    if hit is not None:
                        used[hit] = ("forward", "link")
                for k, found in enumerate(hits):
                    if k not in used and title and title.casefold() in found:
                        used[k] = ("forward" if displays else "reverse", "text")
                out.extend((chunks_of[k], key[0], dst, title, d, m) for k, (d, m) in used.items())

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 6
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk_id", "source_page_id", "target_page_id", "target_page_title", "direction", "match_type"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["src"], r["b"]) != key:
                    close()
                    key, targets, chunks_of, hits, phrases = (r["src"], r["b"]), [], [], [], None
                if r["dst"] is not None:
                    targets.append((r["dst"], r["title"], [wikitext.plain(d).strip() for d in r["displays"]]))
                    continue
                if phrases is None:
                    phrases = _Phrases({p for _, title, displays in targets for p in (title, *displays) if p})
                chunks_of.append(r["chunk_id"])
                hits.append(phrases.found(r["text"]))
            if len(out) > 20_000:
                yield batch_of()
        close()
        yield batch_of()

    return rows.mapInArrow(run, "chunk_id string, source_page_id long, target_page_id long, target_page_title string, direction string, match_type string")


def resolve_redirects(titles: DataFrame, normalized: DataFrame, redirects: DataFrame, hops: int = 5) -> DataFrame:
    """Rows (from, to): a normalization hop, then at most `hops` redirect hops; only titles with a real redirect are given."""
    at = titles.select(F.col("title").alias("from"), F.col("title").alias("to")).join(normalized.select(F.col("from").alias("to"), F.col("to").alias("_n")), "to", "left")
    at = at.select("from", F.coalesce("_n", "to").alias("to"), F.lit(0).alias("n"))
    step = redirects.select(F.col("from").alias("to"), F.col("to").alias("_r"))
    for _ in range(hops):
        at = at.join(step, "to", "left").select("from", F.coalesce("_r", "to").alias("to"), (F.col("n") + F.col("_r").isNotNull().cast("int")).alias("n"))
    return at.where("n > 0").select("from", "to")


def first_titles(links: DataFrame, per_key: int = 5) -> DataFrame:
    """Rows (target, uses, samples): unresolved targets with the first pages that name them, by page id.

    A page is kept only if it is among the lowest of its target in its part of a hash of the pages, so that no task ranks all of a target's pages.
    """
    rows = links.where("action = 'candidate' AND method IS NULL").groupBy(T.normal_title("target").alias("target"), "page_id").agg(F.count(F.lit(1)).alias("k"))
    part = F.pmod(F.xxhash64("page_id"), F.lit(256))
    few = rows.withColumn("part", part).withColumn("r", F.row_number().over(W.partitionBy("target", "part").orderBy("page_id"))).where(F.col("r") <= per_key)
    first = few.groupBy("target").agg(F.slice(F.array_sort(F.collect_list("page_id")), 1, per_key).alias("samples"))  # 256 * per_key pages at most
    return rows.groupBy("target").agg(F.sum("k").alias("uses")).join(first, "target")


def comentions(rows: DataFrame, per_bucket: int = 20) -> DataFrame:
    """Rows (page_a, page_b, chunks, direct, rank): page pairs by the chunks in which one is mentioned on the other's page, the first of each bucket.

    The buckets are the pairs with a link row and those with text rows only. rows: (chunk_id, source_page_id, target_page_id, match_type).
    """
    pairs = rows.where("source_page_id <> target_page_id").groupBy(F.least("source_page_id", "target_page_id").alias("page_a"), F.greatest("source_page_id", "target_page_id").alias("page_b"))
    pairs = pairs.agg(F.count_distinct("chunk_id").alias("chunks"), F.max(F.col("match_type") == "link").alias("direct"))
    best = [F.desc("chunks"), F.asc("page_a"), F.asc("page_b")]
    top = [pairs.where(F.col("direct") == d).orderBy(*best).limit(per_bucket) for d in (True, False)]  # Spark keeps per_bucket rows for each task
    return top[0].unionByName(top[1]).withColumn("rank", F.row_number().over(W.partitionBy("direct").orderBy(*best)))
