"""Queries of the corpus pipeline's own operators over the project's tables, with the SQL that states each result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.functions import text as T
from corpusmill.operators import audit as au, chunking, embedding as em, evaluation as ev, labeling as lb, links as lk, profiling as pf, quality as dq, questions as qu, sampling as sa
from corpusmill.runtime import read
from corpusmill.streaming import logs

LEVELS = {"TAC": 1, "SOS": 1, "TLW": 2, "TGF": 2, "TBM": 3}
SPECULATIVE = ["speculation", "theories", "possible origins"]
CONFIG = chunking.ChunkConfig(levels=LEVELS, titles={f"book {code.lower()}": code for code in LEVELS}, speculative=tuple(SPECULATIVE), base_url="https://thornreach.example/wiki/")
KEYWORDS = ["ferry", "harbor", "mill", "wedding", "oath", "winter", "bell", "guild"]
SILENT = r"(?i)^(references|notes|trivia|summary)$"
NAVIGATIONAL = ["references", "layout", "known members", "appearances"]
GROUPS = [("Character", ["character"]), ("Location", ["place"]), ("Household", ["household"]), ("Object", ["object"]), ("Group", ["guild"]), ("Chapter", ["chapter"])]
LITERALS = ["[[", "]]", "{{", "}}", "'''", "<ref", "{|", "|}"]
TIERS = ["gold", "citation", "llm"]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with repeated rows once."""
    return read(spark, d, "chunks").where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"])


def pages(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each page of the newest snapshot."""
    p = read(spark, d, "pages")
    new = p.where(F.col("snapshot_no") == p.select(F.max("snapshot_no")).scalar()).groupBy("pageid").agg(F.max_by(F.struct("ns", "title", "revid", "wikitext"), F.struct("revid", "wikitext")).alias("r"))
    return new.select("pageid", "r.*")


def titles(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select(F.col("pageid").alias("page_id"), "title")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return lb.last_wins(read(spark, d, "manual_labels"), "chunk_id", ["labeled_at", "manual_book_level", "seconds_spent"], ["manual_book_level", "seconds_spent", "labeled_at"])


def sample(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "adversarial_sample").where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min(F.lower(F.trim("stratum"))).alias("stratum"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, actual, predicted): the sure manual label of a chunk and its level."""
    sure = labels(spark, d).select("chunk_id", F.expr("try_cast(trim(manual_book_level) as int)").alias("actual")).where("actual IS NOT NULL")
    return sure.join(chunks(spark, d).where("book_level BETWEEN 1 AND 3").select("chunk_id", F.col("book_level").alias("predicted"), "chunk_type", "section_heading"), "chunk_id")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Model-like records made of the manual log: unsure labels have low confidence."""
    m = labels(spark, d).withColumn("book_level_raw", F.coalesce(F.expr("try_cast(trim(manual_book_level) as int)"), F.lit(1))).withColumn("confidence", F.when(F.trim("manual_book_level") == "u", "low").when(F.col("seconds_spent") > 60, "medium").otherwise("high"))
    return lb.conservative(m).select("chunk_id", "book_level_raw", "confidence", "overridden", "book_level")


def link_rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "entity_links").where("source_page_id IS NOT NULL AND target_page_id IS NOT NULL").select("chunk_id", "source_page_id", "target_page_id", "target_page_title", "direction", "match_type", "snapshot_no").distinct()


def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    forward = link_rows(spark, d).where("direction = 'forward' AND match_type = 'link'")
    return forward.where("source_page_id <> target_page_id").groupBy(F.col("source_page_id").alias("src"), F.col("target_page_id").alias("dst")).agg(F.count(F.lit(1)).alias("links"))


def resolved_titles(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "entity_links").where("target_page_title IS NOT NULL").groupBy(F.col("target_page_title").alias("raw_target")).agg(F.count(F.lit(1)).alias("page_id"))
    return lk.resolved(lk.classified(t), titles(spark, d))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def ranks(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", (F.col("id") + 1).alias("target_id"))
    return ev.target_ranks(q.join(v.select(F.col("id").alias("target_id")), "target_id", "left_semi"), v)


def ranks_with_label(spark: SparkSession, d: str) -> DataFrame:
    return ranks(spark, d).join(vectors(spark, d).select(F.col("id").alias("query_id"), "label"), "query_id")


def clearance_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks among the vectors of a label up to 4 only: the filter comes before ranking and reaches the scan."""
    v = vectors(spark, d).where("label <= 4")
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", (F.col("id") + 1).alias("target_id"))
    return ev.target_ranks(q.join(v.select(F.col("id").alias("target_id")), "target_id", "left_semi"), v)


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "chunks").distinct()
    return dq.report(dq.page_checks(pages(spark, d)), dq.chunk_checks(c, ["prose", "infobox", "quote"], TIERS, LITERALS))


def exclusion(kind, heading):
    k = F.lower(F.trim(kind))
    return F.when(k == "infobox", "infobox").when(F.coalesce(F.col(heading).rlike(SILENT), F.lit(False)), "silence-heading")


def question_pool(spark: SparkSession, d: str) -> DataFrame:
    leaf = F.lower(F.trim(F.element_at(F.split("section_heading", ">"), -1)))
    k = F.lower(F.trim("chunk_type"))
    reason = F.when((k == "infobox") & (F.col("ns") == 112), "chapter infobox").when(F.coalesce(F.col("section_heading").rlike(SILENT), F.lit(False)), "silence-heading").when(leaf.isin(NAVIGATIONAL), "navigational")
    return chunks(spark, d).select("chunk_id", "book_level", k.alias("chunk_type"), reason.alias("excluded"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    """The page-level tier: chapter, template, reference, mention, none, as its SQL has them; the README lists what is left out."""
    p = pages(spark, d)
    codes = lambda pattern: F.array_distinct(F.regexp_extract_all("wikitext", F.lit(pattern), F.lit(1)))
    tier = lb.audit_tier([
        ("chapter", F.when(F.col("ns") == 112, F.array(F.lit("chapter")))), ("template", codes(r"\{\{[Rr]ef ?\| ?(TAC|SOS|TLW|TGF|TBM)")), ("reference", codes(r"<ref>Book (TAC|SOS|TLW|TGF|TBM)")), ("mention", codes(r"\b(TAC|SOS|TLW|TGF|TBM)\b")),
    ])
    return p.select("pageid", tier.alias("tier"), T.word_count("wikitext").alias("words"))


BOOKS = {code: [rf"\b{code}\b", rf"(?i)\bbook {code.lower()}\b"] for code in LEVELS}


def full_audit(spark: SparkSession, d: str) -> DataFrame:
    """All six tiers, with the categories of the pages' chunks."""
    held = chunks(spark, d).where("categories IS NOT NULL").groupBy(F.col("page_id").alias("pageid")).agg(F.min_by("categories", "chunk_id").alias("categories"))
    return au.page_audit(pages(spark, d).join(held, "pageid", "left"), BOOKS, "categories")


def letters(alphabet: str):
    """A model for tests of the comparison: counts of letters. It runs on the executors like any other model, and SQL can repeat it."""

    def make():
        import numpy as np

        return lambda texts: (np.array([[t.lower().count(a) for a in alphabet] for t in texts], "float64"), sum(len(t.split()) for t in texts))

    return make


def bakeoff(spark: SparkSession, d: str):
    """Two models over the pages' titles and texts: the question is the title, its target the page."""
    p = pages(spark, d).where("title IS NOT NULL AND wikitext IS NOT NULL")
    asked = p.where("pageid % 20 = 0").select(F.col("pageid").alias("query_id"), F.col("title").alias("question"), F.col("pageid").alias("target_id"), "ns")
    return em.bakeoff(p.select(F.col("pageid").alias("id"), F.col("wikitext").alias("text")), asked, {"letters": (letters("abcdefghijklmnopqrstuvwxyz"), 100, ""), "vowels": (letters("aeiou"), 32, "e: ")}, ["ns"])


def scripted(prompt: str) -> dict:
    """A client for tests of question generation: the first answer for every prompt of even length refers to its source."""
    asked = scripted.__dict__.setdefault("asked", {})
    n = asked[prompt] = asked.get(prompt, 0) + 1
    return {"question": "According to the page, what is it?" if len(prompt) % 2 == 0 and n % 2 else f"What is told in {len(prompt)} letters?", "input_tokens": len(prompt), "cached_tokens": 0, "output_tokens": 7}


def made_questions(spark: SparkSession, d: str) -> DataFrame:
    return qu.questions(chunks(spark, d).where("text IS NOT NULL AND chunk_type IS NOT NULL AND page_title IS NOT NULL"), lambda: scripted)


Q = {
    "label_coverage": lambda s, d: pf.label_coverage(chunks(s, d), TIERS),
    "word_count_histogram": lambda s, d: pf.histogram(documents(s, d).select(T.word_count("text").alias("w")), "w", [0, 50, 100, 230, 380, 500]),
    "chunk_histogram": lambda s, d: pf.histogram(chunks(s, d), "word_count", [0, 50, 100, 230, 380, 500]),
    "dist_stats_by_lang": lambda s, d: pf.distribution(documents(s, d).where("lang IS NOT NULL").select("lang", F.length("text").alias("v")), "v", ["lang"]),
    "dist_stats_grains": lambda s, d: pf.distribution_grains(chunks(s, d).select("ns", "word_count"), "word_count", "ns"),
    "interpolated_percentiles": lambda s, d: chunks(s, d).agg(*[F.round(F.percentile("word_count", q), 6).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))], F.max("word_count").alias("largest")),
    "threshold_counts": lambda s, d: documents(s, d).select(T.word_count("text").alias("w")).agg(F.count_if(F.col("w") > 500).alias("over_500"), F.count_if(F.col("w") < 50).alias("under_50"), F.count("w").alias("n")),
    "namespace_counts": lambda s, d: pages(s, d).groupBy("ns").agg(F.count(F.lit(1)).alias("n")),
    "namespace_drift": lambda s, d: dq.namespace_drift(pages(s, d), {0: 250, 112: 50}),
    "provenance_breakdown": lambda s, d: lb.breakdown(chunks(s, d), "label_provenance"),
    "confidence_distribution": lambda s, d: lb.fixed_counts(records(s, d), "confidence", ["low", "medium", "high"]),
    "link_counters": lambda s, d: link_rows(s, d).groupBy("match_type", "direction").agg(F.count(F.lit(1)).alias("n")),
    "last_label_wins": labels,
    "streaming_last_label": lambda s, d: logs.drain(logs.last_wins(logs.read_stream(s, d, "manual_labels"), "chunk_id", ["labeled_at", "manual_book_level", "seconds_spent"], ["manual_book_level", "seconds_spent", "labeled_at"]), "last_labels"),
    "label_summary": lambda s, d: labels(s, d).join(sample(s, d), "chunk_id", "left").groupBy(F.coalesce("stratum", F.lit("?")).alias("stratum"), F.coalesce(F.trim("manual_book_level"), F.lit("null")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds_spent"), 3).alias("seconds")),
    "unsure_list": lambda s, d: labels(s, d).where("trim(manual_book_level) = 'u'").select("chunk_id"),
    "resume_todo": lambda s, d: lb.to_do(sample(s, d), read(s, d, "manual_labels")),
    "stratum_lookup": lambda s, d: labels(s, d).join(sample(s, d), "chunk_id", "left").select("chunk_id", F.coalesce("stratum", F.lit("?")).alias("stratum")),
    "accuracy_scores": lambda s, d: ev.score_pairs(judged(s, d)),
    "accuracy_refined": lambda s, d: ev.score_pairs(judged(s, d).where(exclusion("chunk_type", "section_heading").isNull())),
    "confusion_matrix": lambda s, d: ev.confusion_matrix(judged(s, d), [1, 2, 3]),
    "gate_verdict": lambda s, d: ev.gate(ev.score_pairs(judged(s, d)), ev.score_pairs(judged(s, d).where(exclusion("chunk_type", "section_heading").isNull()))),
    "disagreements": lambda s, d: judged(s, d).where("actual <> predicted").select("chunk_id", "actual", "predicted"),
    "exclusion_breakdown": lambda s, d: chunks(s, d).groupBy(F.coalesce(exclusion("chunk_type", "section_heading"), F.lit("kept")).alias("category")).agg(F.count(F.lit(1)).alias("n")),
    "low_confidence_override": records,
    "labels_assemble": lambda s, d: lb.assemble(chunks(s, d), records(s, d), checked=False).select("chunk_id", "book_level", "label_provenance", "book_level_raw", "label_confidence"),
    "assemble_contract": lambda s, d: lb.contract(chunks(s, d).where("label_provenance IS NULL"), records(s, d)),
    "label_cascade": lambda s, d: lb.cascade(chunks(s, d).withColumn("gold", F.when(F.col("label_provenance") == "gold", F.col("book_level"))), "gold", "citation_codes", LEVELS).select("chunk_id", "level", "provenance"),
    "token_cost": lambda s, d: lb.costs(documents(s, d).select(T.word_count("text").cast("long").alias("input_tokens"), (T.word_count("text") / 4).cast("long").alias("cached_tokens"), F.lit(60).alias("output_tokens")), 0.75, 0.075, 4.5),
    "cost_estimate": lambda s, d: lb.estimate(chunks(s, d).where("text IS NOT NULL"), "text", 700, 60, 0.75, 4.5),
    "keyword_cluster": lambda s, d: chunks(s, d).select("chunk_id", T.first_match([(k, rf"(?i)\b{k}\b") for k in KEYWORDS], "page_title", "section_heading", F.array_join("categories", " ; ")).alias("keyword")).where("keyword IS NOT NULL"),
    "two_stratum_sample": lambda s, d: sa.two_strata(chunks(s, d).where("NOT is_speculation"), T.first_match([(k, rf"(?i)\b{k}\b") for k in KEYWORDS], "page_title", "section_heading")),
    "floor_stratified_draw": lambda s, d: sa.floor_draw(chunks(s, d).withColumn("chunk_type", F.lower(F.trim("chunk_type"))), {1: 60, 2: 60, 3: None}, {"infobox": 10, "quote": 10}, "prose"),
    "cell_stats": lambda s, d: question_pool(s, d).where("excluded IS NULL").groupBy("book_level", "chunk_type").agg(F.count(F.lit(1)).alias("available")),
    "question_pool": question_pool,
    "tiered_lookup": lambda s, d: resolved_titles(s, d).select("raw_target", "action", "target_id", "method"),
    "lookup_outcomes": lambda s, d: resolved_titles(s, d).groupBy("action", F.coalesce("method", F.lit("none")).alias("method")).agg(F.count(F.lit(1)).alias("n")),
    "unresolved_work_list": lambda s, d: lk.unresolved_work_list(resolved_titles(s, d)),
    "link_edges": edge_rows,
    "link_pairs": lambda s, d: lk.pairs(edge_rows(s, d)),
    "pair_stats": lambda s, d: lk.pair_stats(lk.pairs(edge_rows(s, d))),
    "page_types": lambda s, d: lk.page_types(chunks(s, d), GROUPS),
    "type_crosstab": lambda s, d: lk.type_crosstab(lk.pairs(edge_rows(s, d)), lk.page_types(chunks(s, d), GROUPS)),
    "self_links": lambda s, d: link_rows(s, d).where("source_page_id = target_page_id").groupBy("source_page_id").agg(F.count(F.lit(1)).alias("n")),
    "top_targets": lambda s, d: pf.top(link_rows(s, d).groupBy("target_page_id").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("target_page_id")], 10),
    "spot_check": lambda s, d: pf.top(link_rows(s, d).where("match_type = 'text' AND target_page_title IS NOT NULL").select("chunk_id", "target_page_id", "target_page_title").distinct(), [F.length("target_page_title").asc(), F.asc("target_page_title"), F.asc("chunk_id"), F.asc("target_page_id")], 12),
    "text_mentions": lambda s, d: edge_rows(s, d).join(titles(s, d).select(F.col("page_id").alias("dst"), "title"), "dst").join(chunks(s, d).select(F.col("page_id").alias("src"), "chunk_id", "text"), "src").where(F.contains("text", F.col("title"))).select("chunk_id", "src", "dst"),
    "cosine_rank": ranks,
    "hit_mrr_by_stratum": lambda s, d: ev.retrieval_scores(ranks_with_label(s, d), ["label"]),
    "clearance_rank": clearance_ranks,
    "stale_hashes": lambda s, d: chunks(s, d).where("content_hash IS NOT NULL AND text IS NOT NULL").where(F.col("content_hash") != F.sha2("text", 256)).select("chunk_id"),
    "dup_hash_groups": lambda s, d: documents(s, d).where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
    "duplicate_rows": lambda s, d: read(s, d, "chunks").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
    "residue_scan": lambda s, d: chunks(s, d).select("chunk_id", dq.first_literal("text", LITERALS).alias("literal")).where("literal IS NOT NULL"),
    "residue_windows": lambda s, d: pf.residue_windows(chunks(s, d), "chunk_id", "text", r"\[\[|\]\]|\{\{|\}\}").select("chunk_id", "hits"),
    "banned_terms": lambda s, d: documents(s, d).where(F.col("text").rlike(r"(?i)\b(placeholder|script|error)\b|according to the (author|archive|text)")).select("doc_id"),
    "header_strip": lambda s, d: chunks(s, d).select("chunk_id", T.strip_header("text").alias("body")),
    "prompt_projection": lambda s, d: chunks(s, d).where("text IS NOT NULL AND chunk_type IS NOT NULL").select("chunk_id", T.prompt_fields("page_title", "section_heading", "chunk_type", "text").alias("prompt")),
    "header_mismatch": lambda s, d: chunks(s, d).where("text IS NOT NULL").where(~F.startswith(F.col("text"), T.header("page_title", "section_heading"))).select("chunk_id"),
    "speculation_flags": lambda s, d: chunks(s, d).select("chunk_id", (F.array_contains("quality_flags", "conjecture") | F.exists(F.split(F.coalesce("section_heading", F.lit("")), " > "), lambda p: F.lower(F.trim(p)).isin(SPECULATIVE))).alias("speculative")),
    "speculation_pages": lambda s, d: chunks(s, d).where("is_speculation").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("page_id").alias("pages")),
    "split_sections": lambda s, d: dq.split_sections(chunks(s, d)),
    "quality_report": quality_report,
    "chunk_violations": lambda s, d: chunks(s, d).groupBy(F.coalesce(dq.first_violation(["prose", "infobox", "quote"], TIERS), F.lit("none")).alias("violation")).agg(F.count(F.lit(1)).alias("n")),
    "near_empty_pages": lambda s, d: pages(s, d).where((T.word_count("wikitext") < 60) & (F.length("wikitext") >= 300)).select("pageid"),
    "chapter_rawness": lambda s, d: pages(s, d).where("ns = 112").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.contains("wikitext", F.lit("{{"))).alias("with_templates"), F.count_if(F.col("wikitext").rlike(r"\|\s*book")).alias("with_book")),
    "content_changes": lambda s, d: logs.content_changes(*[read(s, d, "pages").where(f"snapshot_no = {n}").select("pageid", F.sha2("wikitext", 256).alias("h")) for n in (3, 4)], "pageid", "h"),
    "audit_tiers": audit,
    "audit_report": lambda s, d: audit(s, d).groupBy("tier").agg(F.count(F.lit(1)).alias("pages"), F.sum("words").cast("long").alias("words")),
    "citation_levels": lambda s, d: chunks(s, d).select("chunk_id", lb.level_of("citation_codes", LEVELS).alias("level")).where("level IS NOT NULL"),
    "code_counts": lambda s, d: chunks(s, d).select(F.explode("citation_codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")),
    "category_counts": lambda s, d: chunks(s, d).select("page_id", F.explode("categories").alias("category")).groupBy("category").agg(F.count_distinct("page_id").alias("pages")),
    "prompt_fingerprints": lambda s, d: chunks(s, d).where("text IS NOT NULL").select("chunk_id", T.fingerprint("text").alias("fingerprint")),
    "label_times": lambda s, d: labels(s, d).where("seconds_spent IS NOT NULL AND seconds_spent >= 0 AND seconds_spent < 36000").select("chunk_id", T.minutes("seconds_spent").alias("spent")),
    "title_forms": lambda s, d: read(s, d, "entity_links").where("target_page_title IS NOT NULL").select("target_page_title").distinct().select("target_page_title", T.normal_title("target_page_title").alias("normal"), T.slug("target_page_title", fold=False).alias("slug")),
    "title_slugs": lambda s, d: read(s, d, "entity_links").where("target_page_title IS NOT NULL").select("target_page_title").distinct().select("target_page_title", T.slug("target_page_title").alias("slug")),
    "event_windows": lambda s, d: read(s, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")),
    "gold_chunks": lambda s, d: chunks(s, d).where("label_provenance = 'gold'").select("chunk_id", "book_level"),
    "sampling_frame": lambda s, d: chunks(s, d).where("label_provenance IS NULL AND NOT is_speculation").select("chunk_id"),
    "sampling_stats": lambda s, d: sa.draw_stats(chunks(s, d).where("NOT is_speculation"), T.first_match([(k, rf"(?i)\b{k}\b") for k in KEYWORDS], "page_title", "section_heading")),
    "sample_outside_frame": lambda s, d: sa.contained(sample(s, d), chunks(s, d)),
    "sample_overlap": lambda s, d: sa.disjoint(sample(s, d), labels(s, d)),
    "lost_targets": lambda s, d: ev.lost_targets(labels(s, d).select(F.col("chunk_id").alias("query_id"), F.col("chunk_id").alias("target_id")), chunks(s, d).select(F.col("chunk_id").alias("id"))).select("query_id"),
    "sample_joined": lambda s, d: sample(s, d).join(chunks(s, d).select("chunk_id", "book_level", "label_provenance"), "chunk_id", "left").join(labels(s, d).select("chunk_id", "manual_book_level"), "chunk_id", "left").select("chunk_id", "stratum", "manual_book_level", "book_level", "label_provenance"),
    "comention_pairs": lambda s, d: lk.comentions(link_rows(s, d)),
    "appearance_parameters": lambda s, d: pages(s, d).select("pageid", F.explode(au.appearances("wikitext")).alias("a")).select("pageid", "a.name", "a.value"),
    "reference_bodies": lambda s, d: pages(s, d).select("pageid", F.explode(au.reference_bodies("wikitext")).alias("body")),
    "full_audit": lambda s, d: full_audit(s, d).select("pageid", "tier", F.array_join("books", ",").alias("books"), "words", "refs"),
    "full_audit_report": lambda s, d: au.tier_report(full_audit(s, d)),
    "audit_density": lambda s, d: au.reference_density(full_audit(s, d)),
    "audit_no_signal": lambda s, d: au.no_signal(full_audit(s, d)),
    "chapter_quality": lambda s, d: dq.chapter_checks(pages(s, d)),
    "spot_quality": lambda s, d: dq.spot_checks(read(s, d, "chunks").distinct(), "Thornreach", "Thornreach", 26, ["Thornreach", "Nowhere at all"]),
    "distribution_quality": lambda s, d: dq.distribution_checks(chunks(s, d), TIERS),
    "question_violations": lambda s, d: qu.violations(pages(s, d).where("wikitext IS NOT NULL").select("pageid", F.col("wikitext").alias("question"))).select("pageid", "banned_reference"),
    "answer_schema": lambda s, d: qu.parsed(labels(s, d).select("chunk_id", F.to_json(F.struct(F.trim("manual_book_level").alias("level"), F.when(F.col("seconds_spent") > 60, "medium").otherwise("high").alias("confidence"))).alias("answer")), "answer", "level string, confidence string", {"level": ["1", "2", "3"], "confidence": ["low", "medium", "high"]}, ["level"]).select("chunk_id", "violation"),
    "generated_questions": lambda s, d: made_questions(s, d).select("chunk_id", "question", "input_tokens", "output_tokens", "banned_reference"),
    "bakeoff_ranks": lambda s, d: bakeoff(s, d)[1].select("model", "query_id", "rank"),
    "bakeoff_scores": lambda s, d: bakeoff(s, d)[0],
    "streaming_windows": lambda s, d: logs.drain(logs.windowed_counts(logs.read_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day", "1 hour"), "windows").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n"),
    # operators that SQL can't state: checked by tests against brute force and fixtures
    "wikitext_links": lambda s, d: lk.classified(lk.link_occurrences(pages(s, d))),
    "wikitext_edges": lambda s, d: lk.edges(lk.resolved(lk.classified(lk.link_occurrences(pages(s, d))), titles(s, d))),
    "link_outcomes": lambda s, d: lk.outcomes(lk.resolved(lk.classified(lk.link_occurrences(pages(s, d))), titles(s, d))),
    "link_localization": lambda s, d: lk.localized(lk.edges(lk.resolved(lk.classified(lk.link_occurrences(pages(s, d))), titles(s, d))), chunks(s, d).select("page_id", "chunk_id", F.col("chunk_id").alias("chunk_seq"), "text"), titles(s, d)),
    "template_inventory": lambda s, d: pf.template_inventory(pf.template_uses(pages(s, d))),
    "heading_inventory": lambda s, d: pf.heading_inventory(pf.section_rows(pages(s, d)), SPECULATIVE).withColumn("levels", F.to_json("levels")),
    "reference_behaviour": lambda s, d: pf.reference_behaviour(pf.section_rows(pages(s, d))),
    "section_stats": lambda s, d: pf.distribution(pf.section_rows(pages(s, d)).where("level > 0"), "words"),
    "chunk_pages": lambda s, d: chunking.chunk_pages(pages(s, d), CONFIG),
    "page_notes": lambda s, d: chunking.page_notes(pages(s, d), CONFIG),
    "chunk_pack": lambda s, d: chunking.pack_texts(documents(s, d), "doc_id", "text"),
}
QUERIES = Q

_S = r"[\t\n\x0b\x0c\r \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{_S}'), lambda x: x <> ''))"


def _tsplit(c: str) -> str:
    return f"trim(regexp_replace(replace({c}, '_', ' '), '{_S}', ' ', 'g'))"


_C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL)"
_P = "p AS (SELECT pageid, ns, title, revid, wikitext FROM (SELECT *, row_number() OVER (PARTITION BY pageid ORDER BY revid DESC NULLS LAST, wikitext DESC NULLS LAST) k FROM pages WHERE snapshot_no = (SELECT max(snapshot_no) FROM pages)) WHERE k = 1)"
_M = "m AS (SELECT chunk_id, manual_book_level, seconds_spent, labeled_at FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY labeled_at DESC, manual_book_level DESC NULLS LAST, seconds_spent DESC NULLS LAST) k FROM manual_labels WHERE chunk_id IS NOT NULL) WHERE k = 1)"
_A = "a AS (SELECT chunk_id, min(lower(trim(stratum))) AS stratum FROM adversarial_sample WHERE chunk_id IS NOT NULL GROUP BY 1)"
_R = "r AS (SELECT chunk_id, coalesce(try_cast(trim(manual_book_level) AS INT), 1) AS book_level_raw, CASE WHEN trim(manual_book_level) = 'u' THEN 'low' WHEN seconds_spent > 60 THEN 'medium' ELSE 'high' END AS confidence FROM m), rr AS (SELECT *, confidence = 'low' AS overridden, CASE WHEN confidence = 'low' THEN 3 ELSE book_level_raw END AS book_level FROM r)"
_X = "CASE WHEN lower(trim(chunk_type)) = 'infobox' THEN 'infobox' WHEN regexp_full_match(lower(section_heading), 'references|notes|trivia|summary') THEN 'silence-heading' END"
_J = f"j AS (SELECT m.chunk_id, try_cast(trim(m.manual_book_level) AS INT) AS actual, c.book_level AS predicted, {_X} AS x FROM m JOIN c USING (chunk_id) WHERE try_cast(trim(m.manual_book_level) AS INT) IS NOT NULL AND c.book_level BETWEEN 1 AND 3)"
_L = "l AS (SELECT DISTINCT chunk_id, source_page_id, target_page_id::BIGINT AS target_page_id, target_page_title, direction, match_type, snapshot_no FROM entity_links WHERE source_page_id IS NOT NULL AND target_page_id IS NOT NULL)"
_E = "e AS (SELECT source_page_id AS src, target_page_id AS dst, count(*) AS links FROM l WHERE direction = 'forward' AND match_type = 'link' AND source_page_id <> target_page_id GROUP BY 1, 2), pr AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(DISTINCT src < dst) AS directions FROM e GROUP BY 1, 2)"


def _scores(rows: str) -> str:
    return f"""s AS (SELECT count(*) n, count(*) FILTER (actual = predicted) correct, count(*) FILTER (actual = 2) positives, count(*) FILTER (actual = 2 AND predicted >= 2) caught FROM {rows}),
 o AS (SELECT n, correct, coalesce(round(correct / nullif(n, 0)::DOUBLE, 6), 0) AS accuracy,
 coalesce(round(greatest(0, ((correct / n::DOUBLE) + 3.8416 / (2 * n) - 1.96 * sqrt((correct / n::DOUBLE) * (1 - correct / n::DOUBLE) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6), 0) AS low,
 coalesce(round(least(1, ((correct / n::DOUBLE) + 3.8416 / (2 * n) + 1.96 * sqrt((correct / n::DOUBLE) * (1 - correct / n::DOUBLE) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6), 0) AS high,
 positives, caught, coalesce(round(caught / nullif(positives, 0)::DOUBLE, 6), 0) AS recall FROM s)"""


def _first(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in pairs) + " END"


def _key(fields: list[str]) -> str:
    return _first([(k, " OR ".join(rf"coalesce(regexp_matches({f}, '(?i)\b{k}\b'), false)" for f in fields)) for k in KEYWORDS])


def _hist(value: str, source: str) -> str:
    edges = [0, 50, 100, 230, 380, 500]
    rows = ", ".join(f"({i}, '{lo}–{hi}', {lo}, {hi})" if hi else f"({i}, '{lo}+', {lo}, 1000000000)" for i, (lo, hi) in enumerate(zip(edges, [*edges[1:], None])))
    return f"b(bucket_no, bucket, lo, hi) AS (VALUES {rows}), v AS (SELECT {value} AS v FROM {source}) SELECT bucket_no, bucket, count(v) AS n FROM b LEFT JOIN v ON v >= lo AND v < hi GROUP BY ALL"


def _pct(value: str, group: str, source: str) -> str:
    at = lambda q: f"list_sort(list({value}))[least(floor({q}::DOUBLE * count({value})), count({value}) - 1)::INT + 1]"
    return f"SELECT {group + ', ' if group else ''}count({value}) AS n, {at(0.5)} AS p50, {at(0.9)} AS p90, {at(0.99)} AS p99, max({value}) AS largest FROM {source} WHERE {value} IS NOT NULL {'AND ' + group + ' IS NOT NULL GROUP BY ' + group if group else ''}"


_NT = f"(SELECT upper(left(x, 1)) || substr(x, 2) FROM (SELECT {_tsplit('bare')} AS x))"
_T = (
    f"{_P}, raw AS (SELECT DISTINCT target_page_title AS raw_target FROM entity_links WHERE target_page_title IS NOT NULL), k AS (SELECT raw_target, trim(regexp_replace(trim(split_part(raw_target, '#', 1)), '^:+', '')) AS bare FROM raw),"
    f" k2 AS (SELECT raw_target, bare, {_tsplit('bare')} AS sp, CASE WHEN bare = '' THEN 'anchor' WHEN contains(bare, ':') AND lower(trim(split_part(bare, ':', 1))) IN ({', '.join(repr(x) for x in lk.NAMESPACES)}) THEN 'namespace' WHEN contains(bare, ':') AND lower(trim(split_part(bare, ':', 1))) IN ({', '.join(repr(x) for x in lk.INTERWIKI)}) THEN 'interwiki' ELSE 'candidate' END AS action FROM k),"
    " k3 AS (SELECT *, upper(left(sp, 1)) || substr(sp, 2) AS nt FROM k2), ex AS (SELECT title, max(pageid) AS id FROM p WHERE title IS NOT NULL GROUP BY 1), fo AS (SELECT lower(title) AS f, max(id) AS id FROM ex GROUP BY 1 HAVING count(*) = 1),"
    " z AS (SELECT raw_target, action, nt, coalesce(a.id, b.id, g.id) AS target_id, CASE WHEN a.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'normalized' WHEN g.id IS NOT NULL THEN 'casefold' END AS method FROM k3 LEFT JOIN ex a ON a.title = bare LEFT JOIN ex b ON b.title = nt LEFT JOIN fo g ON g.f = lower(nt))"
)
_TYPES = "ty AS (SELECT page_id, " + "CASE " + " ".join(f"WHEN len(list_filter(categories, lambda x: contains(lower(x), '{k[0]}'))) > 0 THEN '{n}'" for n, k in GROUPS) + " ELSE 'Other' END AS page_type FROM (SELECT page_id, arg_min(categories, chunk_id) AS categories FROM c GROUP BY 1))"
_LIT = _first([(x.replace("'", "''"), "contains(text, '" + x.replace("'", "''") + "')") for x in LITERALS])
_V = f"CASE WHEN chunk_id IS NULL OR page_id IS NULL OR text IS NULL THEN 'missing field' WHEN chunk_type IS NULL OR chunk_type NOT IN ('prose', 'infobox', 'quote') THEN 'chunk_type' WHEN book_level NOT BETWEEN 1 AND 3 THEN 'book_level' WHEN label_provenance NOT IN ('gold', 'citation', 'llm') THEN 'label_provenance' WHEN trim(text) = '' THEN 'blank text' WHEN coalesce(word_count, 0) <= 0 THEN 'word_count' WHEN content_hash IS NULL OR content_hash <> sha256(text) THEN 'content_hash' END"
_LV = "list_max(list_transform(list_filter(citation_codes, lambda x: x IN ('TAC', 'SOS', 'TLW', 'TGF', 'TBM')), lambda x: CASE WHEN x IN ('TAC', 'SOS') THEN 1 WHEN x IN ('TLW', 'TGF') THEN 2 ELSE 3 END))"
_VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_RANK = f"{_VEC}, q AS (SELECT a.id, a.label, a.e, round(list_dot_product(a.e, t.e), 9) AS own FROM v a JOIN v t ON t.id = a.id + 1 WHERE a.id % 20 = 0), k AS (SELECT q.id AS query_id, any_value(q.label) AS label, 1 + count(*) FILTER (round(list_dot_product(q.e, v.e), 9) > q.own) AS rank FROM q CROSS JOIN v GROUP BY q.id)"
_HIT = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 4) AS hit_{k}" for k in (1, 3, 5, 10)) + ", round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END), 4) AS mrr"
_AUD = r"au AS (SELECT pageid, CASE WHEN ns = 112 THEN 'chapter' WHEN regexp_matches(wikitext, '\{\{[Rr]ef ?\| ?(TAC|SOS|TLW|TGF|TBM)') THEN 'template' WHEN regexp_matches(wikitext, '<ref>Book (TAC|SOS|TLW|TGF|TBM)') THEN 'reference' WHEN regexp_matches(wikitext, '\b(TAC|SOS|TLW|TGF|TBM)\b') THEN 'mention' ELSE 'none' END AS tier, " + _words("wikitext") + " AS words FROM p)"
_FAIL = lambda n: f"CASE WHEN {n} > 0 THEN 'FAIL' ELSE 'PASS' END"
_LEAF = "lower(trim(list_last(string_split(section_heading, '>'))))"
_POOL = f"qp AS (SELECT chunk_id, book_level, lower(trim(chunk_type)) AS chunk_type, CASE WHEN lower(trim(chunk_type)) = 'infobox' AND ns = 112 THEN 'chapter infobox' WHEN regexp_full_match(lower(section_heading), 'references|notes|trivia|summary') THEN 'silence-heading' WHEN {_LEAF} IN ('references', 'layout', 'known members', 'appearances') THEN 'navigational' END AS excluded FROM c)"
_LAST = f"WITH {_M} SELECT chunk_id, manual_book_level, seconds_spent, labeled_at FROM m"



def _books(expr: str) -> str:
    return "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches({expr}, '\b{c}\b') OR regexp_matches({expr}, '(?i)\bbook {c.lower()}\b') THEN '{c}' END" for c in LEVELS) + "], lambda x: x IS NOT NULL)"


_FULL = (
    rf"{_C}, {_P}, h AS (SELECT page_id, arg_min(categories, chunk_id) AS categories FROM c WHERE categories IS NOT NULL GROUP BY 1), w AS (SELECT p.*, coalesce(categories, []) AS cats, coalesce(wikitext, '') AS t, regexp_extract_all(coalesce(wikitext, ''), '{au.REFERENCE}', 1) AS bodies,"
    r" regexp_extract_all(coalesce(wikitext, ''), '(?im)^[^\S\n]*\|[^\S\n]*(?:first_?appear\w*|appear\w*|books?|debut|novels?)[^\S\n]*=[^\S\n]*(.*)$', 1) AS vals FROM p LEFT JOIN h ON h.page_id = p.pageid), "
    f"b AS (SELECT *, {_books('array_to_string(cats, chr(10))')} AS c1, {_books('array_to_string(bodies, chr(10))')} AS c2, {_books('array_to_string(vals, chr(10))')} AS c3, {_books('t')} AS c4, {_books('coalesce(title, chr(10))')} AS c0 FROM w), "
    "d AS (SELECT *, list_concat(list_concat(c0, list_filter(c1, lambda x: NOT list_contains(c0, x))), list_filter(c4, lambda x: NOT list_contains(c0, x) AND NOT list_contains(c1, x))) AS cc FROM b), "
    "fa AS (SELECT pageid, coalesce(title, '') AS title, CASE WHEN ns = 112 THEN 'chapter' WHEN len(c1) > 0 THEN 'category' WHEN len(c2) > 0 THEN 'reference' WHEN len(c3) > 0 THEN 'appearance' WHEN len(c4) > 0 THEN 'mention' ELSE 'none' END AS tier,"
    " CASE WHEN ns = 112 THEN cc WHEN len(c1) > 0 THEN c1 WHEN len(c2) > 0 THEN c2 WHEN len(c3) > 0 THEN c3 ELSE c4 END AS books, " + _words("t") + " AS words, len(bodies) AS refs FROM d)"
)
_BAKE = f"""{_P}, u AS (SELECT * FROM p WHERE title IS NOT NULL AND wikitext IS NOT NULL), m(model, letters, prefix) AS (VALUES ('letters', 'abcdefghijklmnopqrstuvwxyz', ''), ('vowels', 'aeiou', 'e: ')),
 t AS (SELECT model, pageid AS id, list_transform(string_split(letters, ''), lambda a: (length(wikitext) - length(replace(lower(wikitext), a, '')))::DOUBLE) AS v FROM m, u),
 q AS (SELECT model, pageid AS id, ns, list_transform(string_split(letters, ''), lambda a: (length(prefix || title) - length(replace(lower(prefix || title), a, '')))::DOUBLE) AS v FROM m, u WHERE pageid % 20 = 0),
 tn AS (SELECT model, id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-30)) AS v FROM t), qn AS (SELECT model, id, ns, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-30)) AS v FROM q),
 o AS (SELECT qn.model, qn.id, qn.ns, qn.v, round(list_dot_product(qn.v, tn.v), 9) AS own FROM qn JOIN tn ON tn.model = qn.model AND tn.id = qn.id),
 k AS (SELECT o.model, o.id AS query_id, any_value(o.ns) AS ns, 1 + count(*) FILTER (round(list_dot_product(o.v, tn.v), 9) > own) AS rank FROM o JOIN tn ON tn.model = o.model GROUP BY 1, 2)"""
_BANNED = _first([(w, rf"regexp_matches(lower(wikitext), '\b{w}\b')") for w in qu.BARE])[: -len(" END")] + rf" ELSE nullif(regexp_extract(lower(wikitext), '\b(according to the (?:{'|'.join(qu.NOUNS)}))\b', 1), '') END"

_STRIP = rf"regexp_replace(x, '^{_S}|{_S}$', '', 'g')"
_PACK = f"""WITH RECURSIVE x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
 y AS (SELECT doc_id, i, {_STRIP} AS para FROM x), z AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, para, {_words('para')} AS n FROM y WHERE para <> ''),
 g AS (SELECT doc_id, i, 0 AS part, n AS room FROM z WHERE i = 1 UNION ALL SELECT z.doc_id, z.i, CASE WHEN g.room + z.n > 380 THEN g.part + 1 ELSE g.part END, CASE WHEN g.room + z.n > 380 THEN z.n ELSE g.room + z.n END FROM g JOIN z ON z.doc_id = g.doc_id AND z.i = g.i + 1),
 h AS (SELECT doc_id, part, string_agg(z.para, chr(10) ORDER BY z.i) AS body, list_filter(regexp_split_to_array(string_agg(z.para, ' ' ORDER BY z.i), '{_S}'), lambda w: w <> '') AS ws FROM g JOIN z USING (doc_id, i) GROUP BY 1, 2),
 k AS (SELECT *, lag(ws) OVER (PARTITION BY doc_id ORDER BY part) AS was FROM h)
 SELECT doc_id, part::INT AS part_no, len(ws)::INT AS n_words, least(40, len(coalesce(was, [])))::INT AS overlap_words, CASE WHEN len(coalesce(was, [])) > 0 THEN array_to_string(was[-40:], ' ') || chr(10) || body ELSE body END AS part FROM k"""
_NOCOMMENT = "regexp_replace(wikitext, '(?is)<!--.*?(?:-->|$)|<(nowiki|pre|syntaxhighlight|source|math)\\b[^>]*?/>|<nowiki\\b[^>]*>.*?</nowiki\\s*>|<pre\\b[^>]*>.*?</pre\\s*>|<syntaxhighlight\\b[^>]*>.*?</syntaxhighlight\\s*>|<source\\b[^>]*>.*?</source\\s*>|<math\\b[^>]*>.*?</math\\s*>', '', 'g')"
_WL = (
    f"{_P}, x0 AS (SELECT pageid AS page_id, {_NOCOMMENT} AS t FROM p WHERE wikitext IS NOT NULL), x1 AS (SELECT page_id, regexp_extract_all(t, '\\[\\[(?:[^\\[\\]]|\\[[^\\[\\]]*\\]|\\[\\[[^\\[\\]]*\\]\\])*\\]\\]') AS ms FROM x0), x2 AS (SELECT page_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS a FROM x1),"
    " x3 AS (SELECT page_id, a, 0 AS b, m[3:-3] AS s FROM x2 UNION ALL SELECT page_id, a, generate_subscripts(ms, 1), unnest(ms)[3:-3] FROM (SELECT page_id, a, regexp_extract_all(m[3:-3], '\\[\\[[^\\[\\]]*\\]\\]') AS ms FROM x2)),"
    " wl AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY a, b) - 1)::INT AS pos, trim(split_part(s, '|', 1)) AS raw_target, trim(CASE WHEN contains(s, '|') THEN regexp_extract(s, '\\|((?:[^|\\[\\]]|\\[\\[[^\\[\\]]*\\]\\])*)$', 1) ELSE s END) AS display FROM x3),"
    f" k AS (SELECT *, trim(regexp_replace(trim(split_part(raw_target, '#', 1)), '^:+', '')) AS bare FROM wl), wk AS (SELECT *, {_tsplit('bare')} AS sp, CASE WHEN bare = '' THEN 'anchor' WHEN contains(bare, ':') AND lower(trim(split_part(bare, ':', 1))) IN ({', '.join(repr(x) for x in lk.NAMESPACES)}) THEN 'namespace' WHEN contains(bare, ':') AND lower(trim(split_part(bare, ':', 1))) IN ({', '.join(repr(x) for x in lk.INTERWIKI)}) THEN 'interwiki' ELSE 'candidate' END AS action FROM k),"
    " k3 AS (SELECT *, upper(left(sp, 1)) || substr(sp, 2) AS nt FROM wk), ex AS (SELECT title, max(pageid) AS id FROM p WHERE title IS NOT NULL GROUP BY 1), fo AS (SELECT lower(title) AS f, max(id) AS id FROM ex GROUP BY 1 HAVING count(*) = 1),"
    " wr AS (SELECT page_id, pos, display, action, coalesce(a.id, b.id, g.id) AS target_id, CASE WHEN a.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'normalized' WHEN g.id IS NOT NULL THEN 'casefold' END AS method FROM k3 LEFT JOIN ex a ON a.title = bare LEFT JOIN ex b ON b.title = nt LEFT JOIN fo g ON g.f = lower(nt))"
)

ORACLE = {
    "chunk_pack": _PACK,
    "heading_inventory": f"""WITH {_P}, x0 AS (SELECT pageid, {_NOCOMMENT} AS t FROM p WHERE wikitext IS NOT NULL), x1 AS (SELECT pageid, string_split(t, chr(10)) AS ls FROM x0), x2 AS (SELECT pageid, unnest(ls) AS m, generate_subscripts(ls, 1) AS i FROM x1),
 x3 AS (SELECT pageid, i, length(regexp_extract(m, '^(=+)', 1)) AS level, m FROM x2 WHERE regexp_matches(m, '^={{2,3}}[ \t]*[^= \t].*={{2,3}}[ \t\r]*$')), x4 AS (SELECT pageid, i, level, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '^=+|=+[ \t\r]*$', '', 'g'), '\\[\\[(?:[^|\\[\\]]*\\|)?([^\\[\\]]*)\\]\\]', '\\1', 'g'), '<[^<>]*>', '', 'g'), chr(39) || '+', '', 'g')) AS heading FROM x3 WHERE length(regexp_extract(m, '(=+)[ \t\r]*$', 1)) = level),
 n AS (SELECT *, lower(trim(heading)) AS h FROM x4), l AS (SELECT h, '{{' || string_agg('"' || level || '":' || k, ',' ORDER BY level) || '}}' AS levels FROM (SELECT h, level, count(*) AS k FROM n GROUP BY 1, 2) GROUP BY 1),
 d AS (SELECT h, heading AS display FROM (SELECT h, heading, row_number() OVER (PARTITION BY h ORDER BY count(*) DESC, min((pageid, i))) AS r FROM n GROUP BY 1, 2) WHERE r = 1),
 t AS (SELECT h, count(*) AS uses, count(DISTINCT pageid) AS pages FROM n GROUP BY 1) SELECT t.h AS heading, uses, pages, levels, display, t.h IN ('speculation', 'theories', 'possible origins') AS speculative FROM t JOIN l USING (h) JOIN d USING (h)""",
    "wikitext_links": f"WITH {_WL} SELECT page_id, pos, raw_target, display, bare AS target, action FROM wk",
    "wikitext_edges": f"WITH {_WL} SELECT page_id AS src, target_id AS dst, count(*) AS links, list(display ORDER BY pos) AS displays FROM wr WHERE target_id IS NOT NULL AND target_id <> page_id GROUP BY 1, 2",
    "link_outcomes": f"WITH {_WL} SELECT CASE WHEN action <> 'candidate' THEN 'skipped ' || action WHEN target_id IS NULL THEN 'unresolved' WHEN target_id = page_id THEN 'self link' ELSE method END AS outcome, count(*) AS n FROM wr GROUP BY 1",
    "label_coverage": f"WITH {_C}, t(tier) AS (VALUES ('gold'), ('citation'), ('llm'), ('null')), g AS (SELECT coalesce(label_provenance, 'null') AS tier, count(*) AS n, sum(coalesce(word_count, 0)) AS w FROM c GROUP BY 1), f AS (SELECT t.tier, coalesce(n, 0)::BIGINT AS chunks, coalesce(w, 0)::BIGINT AS words FROM t LEFT JOIN g USING (tier)) SELECT tier, chunks, round(100.0::DOUBLE * chunks / greatest(sum(chunks) OVER (), 1), 1) AS chunk_share, words, round(100.0::DOUBLE * words / greatest(sum(words) OVER (), 1), 1) AS word_share FROM f",
    "word_count_histogram": "WITH " + _hist(_words("text"), "documents"),
    "chunk_histogram": f"WITH {_C}, " + _hist("word_count", "c"),
    "dist_stats_by_lang": _pct("v", "lang", "(SELECT lang, length(text) AS v FROM documents)"),
    "dist_stats_grains": f"WITH {_C} SELECT NULL::INT AS ns, * FROM ({_pct('word_count', '', 'c')}) UNION ALL {_pct('word_count', 'ns', 'c')}",
    "interpolated_percentiles": f"WITH {_C} SELECT round(quantile_cont(word_count::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(word_count::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(word_count::DOUBLE, 0.99), 6) AS p99, max(word_count) AS largest FROM c",
    "threshold_counts": f"SELECT count(*) FILTER (w > 500) AS over_500, count(*) FILTER (w < 50) AS under_50, count(w) AS n FROM (SELECT {_words('text')} AS w FROM documents)",
    "namespace_counts": f"WITH {_P} SELECT ns, count(*) AS n FROM p GROUP BY 1",
    "namespace_drift": f"WITH {_P}, x(ns, e) AS (VALUES (0, 250), (112, 50)), g AS (SELECT ns, count(*) AS n FROM p GROUP BY 1) SELECT 'namespace ' || ns AS \"check\", CASE WHEN e IS NULL THEN 'FAIL' WHEN coalesce(n, 0) = e THEN 'PASS' WHEN abs(coalesce(n, 0) - e) / e::DOUBLE <= 0.05 THEN 'WARN' ELSE 'FAIL' END AS severity, 'pages against expected' AS message, coalesce(n, 0)::DOUBLE AS observed FROM g FULL JOIN x USING (ns)",
    "provenance_breakdown": f"WITH {_C} SELECT coalesce(label_provenance, 'null') AS label_provenance, count(*) AS n FROM c GROUP BY 1",
    "confidence_distribution": f"WITH {_M}, {_R} SELECT count(*) FILTER (confidence = 'low') AS low, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'high') AS high FROM rr",
    "link_counters": f"WITH {_L} SELECT match_type, direction, count(*) AS n FROM l GROUP BY 1, 2",
    "last_label_wins": _LAST,
    "streaming_last_label": _LAST,
    "label_summary": f"WITH {_M}, {_A} SELECT coalesce(stratum, '?') AS stratum, coalesce(trim(manual_book_level), 'null') AS label, count(*) AS n, round(sum(seconds_spent), 3) AS seconds FROM m LEFT JOIN a USING (chunk_id) GROUP BY 1, 2",
    "unsure_list": f"WITH {_M} SELECT chunk_id FROM m WHERE trim(manual_book_level) = 'u'",
    "resume_todo": f"WITH {_A} SELECT chunk_id, stratum FROM a WHERE chunk_id NOT IN (SELECT chunk_id FROM manual_labels WHERE chunk_id IS NOT NULL)",
    "stratum_lookup": f"WITH {_M}, {_A} SELECT chunk_id, coalesce(stratum, '?') AS stratum FROM m LEFT JOIN a USING (chunk_id)",
    "accuracy_scores": f"WITH {_C}, {_M}, {_J}, {_scores('j')} SELECT * FROM o",
    "accuracy_refined": f"WITH {_C}, {_M}, {_J}, {_scores('(SELECT * FROM j WHERE x IS NULL)')} SELECT * FROM o",
    "confusion_matrix": f"WITH {_C}, {_M}, {_J}, g AS (SELECT a.v AS actual, b.v AS predicted FROM (VALUES (1), (2), (3)) a(v), (VALUES (1), (2), (3)) b(v)) SELECT g.actual, g.predicted, count(j.chunk_id) AS n FROM g LEFT JOIN j ON j.actual = g.actual AND j.predicted = g.predicted GROUP BY 1, 2",
    "gate_verdict": f"WITH {_C}, {_M}, {_J} SELECT recall, accuracy, recall >= 0.8 AND accuracy >= 0.9 AS passed FROM (WITH {_scores('j')} SELECT recall FROM o), (WITH {_scores('(SELECT * FROM j WHERE x IS NULL)')} SELECT accuracy FROM o)",
    "disagreements": f"WITH {_C}, {_M}, {_J} SELECT chunk_id, actual, predicted FROM j WHERE actual <> predicted",
    "exclusion_breakdown": f"WITH {_C} SELECT coalesce({_X}, 'kept') AS category, count(*) AS n FROM c GROUP BY 1",
    "low_confidence_override": f"WITH {_M}, {_R} SELECT chunk_id, book_level_raw, confidence, overridden, book_level FROM rr",
    "labels_assemble": f"WITH {_C}, {_M}, {_R} SELECT c.chunk_id, CASE WHEN c.label_provenance IS NULL AND rr.chunk_id IS NOT NULL THEN rr.book_level ELSE c.book_level END AS book_level, CASE WHEN c.label_provenance IS NULL AND rr.chunk_id IS NOT NULL THEN 'llm' ELSE c.label_provenance END AS label_provenance, CASE WHEN c.label_provenance IS NULL THEN rr.book_level_raw END AS book_level_raw, CASE WHEN c.label_provenance IS NULL THEN rr.confidence END AS label_confidence FROM c LEFT JOIN rr USING (chunk_id)",
    "assemble_contract": f"WITH {_C}, {_M}, f AS (SELECT chunk_id FROM c WHERE label_provenance IS NULL) SELECT (SELECT count(*) FROM f WHERE chunk_id NOT IN (SELECT chunk_id FROM m)) AS missing, (SELECT count(*) FROM m WHERE chunk_id NOT IN (SELECT chunk_id FROM f)) AS unexpected",
    "label_cascade": f"WITH {_C}, x AS (SELECT chunk_id, CASE WHEN label_provenance = 'gold' THEN book_level END AS gold, {_LV} AS cited FROM c) SELECT chunk_id, coalesce(gold, cited) AS level, CASE WHEN gold IS NOT NULL THEN 'gold' WHEN cited IS NOT NULL THEN 'citation' END AS provenance FROM x",
    "token_cost": f"WITH u AS (SELECT coalesce(sum(w), 0)::BIGINT AS i, coalesce(sum(w // 4), 0)::BIGINT AS k, count(*) * 60 AS o FROM (SELECT {_words('text')} AS w FROM documents)) SELECT i AS input_tokens, k AS cached_tokens, o AS output_tokens, round(((i - k) * 0.75 + k * 0.075 + o * 4.5) / 1e6, 4) AS cost, round(coalesce(k / nullif(i, 0)::DOUBLE, 0), 4) AS cache_rate FROM u",
    "cost_estimate": f"WITH {_C}, u AS (SELECT count(*) AS calls, sum(ceil(w * 4 / 3::DOUBLE)::BIGINT + 700)::BIGINT AS i FROM (SELECT {_words('text')} AS w FROM c WHERE text IS NOT NULL)) SELECT calls, i AS input_tokens, calls * 60 AS output_tokens, round((i * 0.75 + calls * 60 * 4.5) / 1e6, 4) AS cost FROM u",
    "keyword_cluster": f"WITH {_C} SELECT * FROM (SELECT chunk_id, {_key(['page_title', 'section_heading', chr(97) + 'rray_to_string(categories, ' + repr(' ; ') + ')'])} AS keyword FROM c) WHERE keyword IS NOT NULL",
    "two_stratum_sample": f"WITH {_C}, f AS (SELECT chunk_id, {_key(['page_title', 'section_heading'])} AS matched_keyword FROM c WHERE NOT is_speculation), k AS (SELECT *, row_number() OVER (PARTITION BY matched_keyword IS NULL ORDER BY md5('sample:' || chunk_id), chunk_id) AS r FROM f), n AS (SELECT least(48, count(*) FILTER (matched_keyword IS NOT NULL)) AS n FROM f) SELECT chunk_id, CASE WHEN matched_keyword IS NULL THEN 'random' ELSE 'cluster' END AS stratum, matched_keyword FROM k, n WHERE CASE WHEN matched_keyword IS NULL THEN r <= 80 - n ELSE r <= 48 END",
    "floor_stratified_draw": f"WITH {_C}, x AS (SELECT chunk_id, book_level, lower(trim(chunk_type)) AS chunk_type FROM c WHERE book_level IN (1, 2, 3) AND lower(trim(chunk_type)) IN ('prose', 'infobox', 'quote')), n AS (SELECT book_level, count(*) FILTER (chunk_type = 'infobox') AS i, count(*) FILTER (chunk_type = 'quote') AS q FROM x GROUP BY 1), k AS (SELECT x.*, 60 - least(10, i) - least(10, q) AS rest, row_number() OVER (PARTITION BY x.book_level, x.chunk_type ORDER BY md5('draw:' || chunk_id), chunk_id) AS r FROM x JOIN n USING (book_level)) SELECT chunk_id, book_level, chunk_type FROM k WHERE book_level = 3 OR r <= CASE WHEN chunk_type = 'prose' THEN greatest(rest, 0) ELSE 10 END",
    "cell_stats": f"WITH {_C}, {_POOL} SELECT book_level, chunk_type, count(*) AS available FROM qp WHERE excluded IS NULL GROUP BY 1, 2",
    "question_pool": f"WITH {_C}, {_POOL} SELECT * FROM qp",
    "tiered_lookup": f"WITH {_T} SELECT raw_target, action, target_id, method FROM z",
    "lookup_outcomes": f"WITH {_T} SELECT action, coalesce(method, 'none') AS method, count(*) AS n FROM z GROUP BY 1, 2",
    "unresolved_work_list": f"WITH {_T} SELECT DISTINCT nt AS target FROM z WHERE action = 'candidate' AND method IS NULL",
    "link_edges": f"WITH {_L}, {_E} SELECT * FROM e",
    "link_pairs": f"WITH {_L}, {_E} SELECT * FROM pr",
    "pair_stats": f"WITH {_L}, {_E} SELECT count(*) AS pairs, count(*) FILTER (directions = 2) AS bidirectional, count(*) FILTER (directions = 1) AS one_directional FROM pr",
    "page_types": f"WITH {_C}, {_TYPES} SELECT page_id, page_type FROM ty",
    "type_crosstab": f"WITH {_C}, {_TYPES}, {_L}, {_E}, x AS (SELECT coalesce(t.page_type, 'Other') AS x, coalesce(u.page_type, 'Other') AS y FROM pr LEFT JOIN ty t ON t.page_id = a LEFT JOIN ty u ON u.page_id = b) SELECT least(x, y) AS type_a, greatest(x, y) AS type_b, count(*) AS pairs FROM x GROUP BY 1, 2",
    "self_links": f"WITH {_L} SELECT source_page_id, count(*) AS n FROM l WHERE source_page_id = target_page_id GROUP BY 1",
    "top_targets": f"WITH {_L} SELECT target_page_id, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, target_page_id LIMIT 10",
    "spot_check": f"WITH {_L} SELECT DISTINCT chunk_id, target_page_id, target_page_title FROM l WHERE match_type = 'text' AND target_page_title IS NOT NULL ORDER BY length(target_page_title), target_page_title, chunk_id, target_page_id LIMIT 12",
    "text_mentions": f"WITH {_C}, {_P}, {_L}, {_E} SELECT c.chunk_id, e.src, e.dst FROM e JOIN p ON p.pageid = e.dst JOIN c ON c.page_id = e.src WHERE contains(c.text, p.title)",
    "cosine_rank": f"WITH {_RANK} SELECT query_id, rank FROM k",
    "hit_mrr_by_stratum": f"WITH {_RANK} SELECT 'overall' AS stratum, '' AS value, count(*) AS n, {_HIT} FROM k UNION ALL SELECT 'label', label::VARCHAR, count(*), {_HIT} FROM k GROUP BY label",
    "clearance_rank": f"WITH {_VEC}, w AS (SELECT * FROM v WHERE label <= 4), q AS (SELECT a.id, a.e, round(list_dot_product(a.e, t.e), 9) AS own FROM w a JOIN w t ON t.id = a.id + 1 WHERE a.id % 20 = 0) SELECT q.id AS query_id, 1 + count(*) FILTER (round(list_dot_product(q.e, w.e), 9) > q.own) AS rank FROM q CROSS JOIN w GROUP BY q.id",
    "stale_hashes": f"WITH {_C} SELECT chunk_id FROM c WHERE content_hash <> sha256(text)",
    "dup_hash_groups": "SELECT sha256(text) AS content_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "duplicate_rows": "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1",
    "residue_scan": f"WITH {_C} SELECT * FROM (SELECT chunk_id, {_LIT} AS literal FROM c) WHERE literal IS NOT NULL",
    "residue_windows": rf"WITH {_C} SELECT chunk_id, len(regexp_extract_all(text, '\[\[|\]\]|\{{\{{|\}}\}}'))::INT AS hits FROM c WHERE regexp_matches(text, '\[\[|\]\]|\{{\{{|\}}\}}')",
    "banned_terms": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\b(placeholder|script|error)\b|according to the (author|archive|text)')",
    "header_strip": f"WITH {_C} SELECT chunk_id, CASE WHEN contains(text, chr(10) || chr(10)) THEN substr(text, instr(text, chr(10) || chr(10)) + 2) ELSE text END AS body FROM c",
    "prompt_projection": f"WITH {_C} SELECT chunk_id, 'Page: ' || page_title || chr(10) || 'Section: ' || coalesce(nullif(section_heading, ''), '(lede)') || chr(10) || 'Type: ' || chunk_type || chr(10) || chr(10) || CASE WHEN contains(text, chr(10) || chr(10)) THEN substr(text, instr(text, chr(10) || chr(10)) + 2) ELSE text END AS prompt FROM c WHERE text IS NOT NULL AND chunk_type IS NOT NULL",
    "header_mismatch": f"WITH {_C} SELECT chunk_id FROM c WHERE text IS NOT NULL AND NOT starts_with(text, CASE WHEN coalesce(section_heading, '') = '' THEN page_title ELSE page_title || ' § ' || section_heading END)",
    "speculation_flags": f"WITH {_C} SELECT chunk_id, list_contains(quality_flags, 'conjecture') OR len(list_filter(string_split(coalesce(section_heading, ''), ' > '), lambda x: lower(trim(x)) IN ('speculation', 'theories', 'possible origins'))) > 0 AS speculative FROM c",
    "speculation_pages": f"WITH {_C} SELECT count(*) AS chunks, count(DISTINCT page_id) AS pages FROM c WHERE is_speculation",
    "split_sections": f"WITH {_C} SELECT page_id, split_part(chunk_id, ':', 1) || ':' || split_part(chunk_id, ':', 2) AS section, count(*) AS parts FROM c WHERE lower(trim(chunk_type)) = 'prose' GROUP BY 1, 2 HAVING count(*) > 1",
    "quality_report": f"""WITH {_P}, u AS (SELECT DISTINCT * FROM chunks), n(name, message, v) AS (
 SELECT 'unique page ids', 'page ids that come more than once', (SELECT count(*) FROM (SELECT pageid FROM p GROUP BY 1 HAVING count(*) > 1))
 UNION ALL SELECT 'blank pages', 'pages without text', (SELECT count(*) FROM p WHERE trim(coalesce(wikitext, '')) = '')
 UNION ALL SELECT 'chunk schema', 'chunks that break a rule', (SELECT count(*) FROM u WHERE {_V} IS NOT NULL)
 UNION ALL SELECT 'unique chunk ids', 'chunk ids that come more than once', (SELECT count(*) FROM (SELECT chunk_id FROM u GROUP BY 1 HAVING count(*) > 1))
 UNION ALL SELECT 'no markup', 'chunks with markup residue', (SELECT count(*) FROM u WHERE {_LIT} IS NOT NULL)
 UNION ALL SELECT 'chapters are gold', 'chapter chunks without a gold label', (SELECT count(*) FROM u WHERE ns = 112 AND label_provenance IS DISTINCT FROM 'gold'))
 SELECT name AS "check", {_FAIL('v')} AS severity, message, v::DOUBLE AS observed FROM n
 UNION ALL SELECT 'stubs', CASE WHEN count(*) > 0 THEN 'INFO' ELSE 'PASS' END, 'pages under 200 characters', count(*)::DOUBLE FROM p WHERE trim(coalesce(wikitext, '')) <> '' AND length(trim(wikitext)) < 200
 UNION ALL SELECT 'chapters are raw', CASE WHEN coalesce(avg(CASE WHEN contains(wikitext, '{{{{') THEN 1.0 ELSE 0.0 END), 0) > 0.5 THEN 'PASS' ELSE 'FAIL' END, 'share of chapter pages with templates', round(coalesce(avg(CASE WHEN contains(wikitext, '{{{{') THEN 1.0 ELSE 0.0 END), 0), 4)::DOUBLE FROM p WHERE ns = 112
 UNION ALL SELECT 'split sections', CASE WHEN count(*) = 0 THEN 'WARN' ELSE 'INFO' END, 'sections in more than one chunk', count(*)::DOUBLE FROM (SELECT 1 FROM u WHERE lower(trim(chunk_type)) = 'prose' GROUP BY page_id, split_part(chunk_id, ':', 1), split_part(chunk_id, ':', 2) HAVING count(*) > 1)""",
    "chunk_violations": f"WITH {_C} SELECT coalesce({_V}, 'none') AS violation, count(*) AS n FROM c GROUP BY 1",
    "near_empty_pages": f"WITH {_P} SELECT pageid FROM p WHERE {_words('wikitext')} < 60 AND length(wikitext) >= 300",
    "chapter_rawness": rf"WITH {_P} SELECT count(*) AS pages, count(*) FILTER (contains(wikitext, '{{{{')) AS with_templates, count(*) FILTER (regexp_matches(wikitext, '\|\s*book')) AS with_book FROM p WHERE ns = 112",
    "content_changes": "WITH a AS (SELECT pageid, max(sha256(wikitext)) AS h FROM pages WHERE snapshot_no = 3 GROUP BY 1), b AS (SELECT pageid, max(sha256(wikitext)) AS h FROM pages WHERE snapshot_no = 4 GROUP BY 1) SELECT coalesce(a.pageid, b.pageid) AS pageid, CASE WHEN a.pageid IS NULL THEN 'added' WHEN b.pageid IS NULL THEN 'removed' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.pageid = b.pageid",
    "audit_tiers": f"WITH {_P}, {_AUD} SELECT * FROM au",
    "audit_report": f"WITH {_P}, {_AUD} SELECT tier, count(*) AS pages, sum(words)::BIGINT AS words FROM au GROUP BY 1",
    "citation_levels": f"WITH {_C} SELECT * FROM (SELECT chunk_id, {_LV} AS level FROM c) WHERE level IS NOT NULL",
    "code_counts": f"WITH {_C} SELECT code, count(*) AS n FROM (SELECT unnest(citation_codes) AS code FROM c) GROUP BY 1",
    "category_counts": f"WITH {_C} SELECT category, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(categories) AS category FROM c) GROUP BY 1",
    "prompt_fingerprints": f"WITH {_C} SELECT chunk_id, left(sha256(text), 12) AS fingerprint FROM c WHERE text IS NOT NULL",
    "label_times": f"WITH {_M} SELECT chunk_id, printf('%02d:%02d', (floor(seconds_spent)::INT // 60)::INT, (floor(seconds_spent)::INT % 60)::INT) AS spent FROM m WHERE seconds_spent >= 0 AND seconds_spent < 36000",
    "title_forms": f"SELECT target_page_title, upper(left(x, 1)) || substr(x, 2) AS normal, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT target_page_title, {_tsplit('target_page_title')} AS x, regexp_replace(regexp_replace(lower(target_page_title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM (SELECT DISTINCT target_page_title FROM entity_links WHERE target_page_title IS NOT NULL))",
    "title_slugs": "SELECT target_page_title, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT target_page_title, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(target_page_title), '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM (SELECT DISTINCT target_page_title FROM entity_links WHERE target_page_title IS NOT NULL))",
    "event_windows": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "gold_chunks": f"WITH {_C} SELECT chunk_id, book_level FROM c WHERE label_provenance = 'gold'",
    "sampling_frame": f"WITH {_C} SELECT chunk_id FROM c WHERE label_provenance IS NULL AND NOT is_speculation",
    "sampling_stats": f"WITH {_C}, f AS (SELECT {_key(['page_title', 'section_heading'])} AS k FROM c WHERE NOT is_speculation), n AS (SELECT count(k) AS c, count(*) - count(k) AS r FROM f), x AS (SELECT c, r, least(c, 48) AS cd, least(r, 80 - least(c, 48)) AS rd FROM n) SELECT 'frame' AS stat, '' AS name, c + r AS n FROM x UNION ALL SELECT 'cluster pool', '', c FROM x UNION ALL SELECT 'random pool', '', r FROM x UNION ALL SELECT 'cluster drawn', '', cd FROM x UNION ALL SELECT 'random drawn', '', rd FROM x UNION ALL SELECT 'shortfall', '', 80 - cd - rd FROM x UNION ALL SELECT 'keyword', k, count(*) FROM f WHERE k IS NOT NULL GROUP BY k",
    "sample_outside_frame": f"WITH {_A}, {_C} SELECT chunk_id FROM a WHERE chunk_id NOT IN (SELECT chunk_id FROM c)",
    "sample_overlap": f"WITH {_A}, {_M} SELECT chunk_id FROM a WHERE chunk_id IN (SELECT chunk_id FROM m)",
    "lost_targets": f"WITH {_M}, {_C} SELECT chunk_id AS query_id FROM m WHERE chunk_id NOT IN (SELECT chunk_id FROM c)",
    "sample_joined": f"WITH {_A}, {_M}, {_C} SELECT a.chunk_id, a.stratum, m.manual_book_level, c.book_level, c.label_provenance FROM a LEFT JOIN c USING (chunk_id) LEFT JOIN m ON m.chunk_id = a.chunk_id",
    "comention_pairs": f"WITH {_L}, g AS (SELECT least(source_page_id, target_page_id) AS page_a, greatest(source_page_id, target_page_id) AS page_b, count(DISTINCT chunk_id) AS chunks, coalesce(bool_or(match_type = 'link'), false) AS direct FROM l WHERE source_page_id <> target_page_id GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY direct ORDER BY chunks DESC, page_a, page_b) AS rank FROM g) WHERE rank <= 20",
    "appearance_parameters": rf"WITH {_P}, x AS (SELECT pageid, unnest(regexp_extract_all(wikitext, '(?im)^[^\S\n]*\|[^\S\n]*(first_?appear\w*|appear\w*|books?|debut|novels?)[^\S\n]*=[^\S\n]*(.*)$', 0)) AS m FROM p) SELECT pageid, lower(regexp_extract(m, '(?im)^[^\S\n]*\|[^\S\n]*(\w+)', 1)) AS name, trim(regexp_extract(m, '=[^\S\n]*(.*)$', 1)) AS value FROM x",
    "reference_bodies": rf"WITH {_P} SELECT pageid, unnest(regexp_extract_all(wikitext, '{au.REFERENCE}', 1)) AS body FROM p",
    "chapter_quality": rf"""WITH {_P}, k AS (SELECT * FROM p WHERE ns = 112) SELECT 'chapters' AS "check", CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS severity, 'chapter pages' AS message, count(*)::DOUBLE AS observed FROM k UNION ALL SELECT 'chapters are raw', CASE WHEN coalesce(avg(CASE WHEN contains(wikitext, '{{{{') THEN 1.0 ELSE 0.0 END), 0) > 0.5 THEN 'PASS' ELSE 'FAIL' END, 'share of chapter pages with templates', round(coalesce(avg(CASE WHEN contains(wikitext, '{{{{') THEN 1.0 ELSE 0.0 END), 0), 4)::DOUBLE FROM k UNION ALL SELECT 'chapters name books', CASE WHEN count(*) FILTER (regexp_matches(wikitext, '\|\s*book')) > 0 THEN 'PASS' ELSE 'FAIL' END, 'chapter pages with a book parameter', count(*) FILTER (regexp_matches(wikitext, '\|\s*book'))::DOUBLE FROM k""",
    "spot_quality": """WITH u AS (SELECT DISTINCT * FROM chunks), i AS (SELECT count(*) FILTER (page_title = 'Thornreach' AND lower(trim(chunk_type)) = 'infobox') AS i, count(*) FILTER (page_title = 'Thornreach' AND lower(trim(chunk_type)) = 'quote') AS q, count(DISTINCT page_id) FILTER (label_provenance = 'gold') AS g FROM u), a AS (SELECT count(*) AS n FROM (VALUES ('Thornreach'), ('Nowhere at all')) v(t) WHERE t NOT IN (SELECT page_title FROM u WHERE page_title IS NOT NULL)) SELECT 'infobox of Thornreach' AS "check", CASE WHEN i > 0 THEN 'PASS' ELSE 'FAIL' END AS severity, 'infobox chunks of the page' AS message, i::DOUBLE AS observed FROM i UNION ALL SELECT 'quote of Thornreach', CASE WHEN q > 0 THEN 'PASS' ELSE 'FAIL' END, 'quote chunks of the page', q::DOUBLE FROM i UNION ALL SELECT 'gold pages', CASE WHEN g = 26 THEN 'PASS' WHEN abs(g - 26) / 26.0 <= 0.05 THEN 'WARN' ELSE 'FAIL' END, 'pages with a gold label, 26 expected', g::DOUBLE FROM i UNION ALL SELECT 'known garbage pages', CASE WHEN n = 0 THEN 'PASS' ELSE 'WARN' END, 'known garbage pages that are absent', n::DOUBLE FROM a""",
    "distribution_quality": f"""WITH {_C} SELECT 'provenance ' || coalesce(label_provenance, 'null') AS "check", 'INFO' AS severity, 'chunks' AS message, count(*)::DOUBLE AS observed FROM c GROUP BY 1 UNION ALL SELECT 'kind ' || coalesce(lower(trim(chunk_type)), 'null'), 'INFO', 'chunks', count(*)::DOUBLE FROM c GROUP BY 1 UNION ALL SELECT 'longest chunk', 'INFO', 'words', max(word_count)::DOUBLE FROM c UNION ALL SELECT 'unlabelled', 'INFO', 'chunks without a known provenance', count(*) FILTER (label_provenance IS NULL OR label_provenance NOT IN ('gold', 'citation', 'llm'))::DOUBLE FROM c""",
    "answer_schema": f"WITH {_M} SELECT chunk_id, CASE WHEN trim(coalesce(manual_book_level, '')) = '' THEN 'level' WHEN trim(manual_book_level) NOT IN ('1', '2', '3') THEN 'level' END AS violation FROM m",
    "generated_questions": f"WITH {_C}, q AS (SELECT chunk_id, length('Page: ' || page_title || chr(10) || 'Section: ' || coalesce(nullif(section_heading, ''), '(lede)') || chr(10) || 'Type: ' || chunk_type || chr(10) || chr(10) || CASE WHEN contains(text, chr(10) || chr(10)) THEN substr(text, instr(text, chr(10) || chr(10)) + 2) ELSE text END)::BIGINT AS n FROM c WHERE text IS NOT NULL AND chunk_type IS NOT NULL AND page_title IS NOT NULL) SELECT chunk_id, 'What is told in ' || n || ' letters?' AS question, CASE WHEN n % 2 = 0 THEN 2 * n ELSE n END AS input_tokens, CASE WHEN n % 2 = 0 THEN 14 ELSE 7 END::BIGINT AS output_tokens, NULL::VARCHAR AS banned_reference FROM q",
    "bakeoff_ranks": f"WITH {_BAKE} SELECT model, query_id, rank FROM k",
    "bakeoff_scores": f"WITH {_BAKE} SELECT model, 'overall' AS stratum, '' AS value, count(*) AS n, {_HIT} FROM k GROUP BY model UNION ALL SELECT model, 'ns', ns::VARCHAR, count(*), {_HIT} FROM k GROUP BY model, ns",
    "question_violations": f"WITH {_P} SELECT * FROM (SELECT pageid, {_BANNED} AS banned_reference FROM p WHERE wikitext IS NOT NULL) WHERE banned_reference IS NOT NULL",
    "full_audit": f"WITH {_FULL} SELECT pageid, tier, array_to_string(books, ',') AS books, words, refs FROM fa",
    "full_audit_report": f"WITH {_FULL}, t(tier) AS (VALUES ('chapter'), ('category'), ('reference'), ('appearance'), ('mention'), ('none')), g AS (SELECT t.tier, count(pageid) AS pages, coalesce(sum(words), 0)::BIGINT AS words FROM t LEFT JOIN fa USING (tier) GROUP BY 1) SELECT tier, pages, words, round(100.0::DOUBLE * words / greatest(sum(words) OVER (), 1), 1) AS word_share FROM g",
    "audit_density": f"WITH {_FULL}, r AS (SELECT round(refs * 1000.0::DOUBLE / words, 6) AS v FROM fa WHERE words > 0) SELECT count(*) AS pages, list_sort(list(v))[least(floor(0.5::DOUBLE * count(v)), count(v) - 1)::INT + 1] AS median FROM r",
    "audit_no_signal": f"WITH {_FULL} SELECT pageid, title, words FROM fa WHERE tier = 'none' ORDER BY words DESC, pageid LIMIT 15",
    "streaming_windows": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
