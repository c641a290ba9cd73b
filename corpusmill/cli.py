"""One subcommand for each stage of the pipeline: python -m corpusmill.cli STAGE --input ... --output ..."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time
from dataclasses import fields
from datetime import datetime, timezone
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import SparkSession, functions as F

from corpusmill.functions.text import prompt_fields
from corpusmill.operators import audit as au, chunking, embedding as em, evaluation as ev, labeling as lb, links as lk, profiling as pf, quality as dq, questions as qu, sampling as sa
from corpusmill.plans.reference_queries import NAVIGATIONAL, SILENT, exclusion
from corpusmill.runtime import cut, session
from corpusmill.sources import tables, wiki


def _load(spark: SparkSession, path: str, schema: str):
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else tables.read_jsonl(spark, path, schema)


def chunk_config(path: str) -> chunking.ChunkConfig:
    """A JSON object of ChunkConfig's fields; an error without levels, for unknown fields and for titles of codes without a level."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    if unknown := sorted(given.keys() - {f.name for f in fields(chunking.ChunkConfig)}):
        raise tables.InputError(f"{path}: unknown fields {', '.join(unknown)}")
    if not given.get("levels"):
        raise tables.InputError(f"{path}: no levels")
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
    given |= {"levels": {k.upper(): v for k, v in given["levels"].items()}, "titles": {k.lower(): v.upper() for k, v in given.get("titles", {}).items()}}
    given |= {k: tuple(x.lower() for x in given[k]) for k in ("flags", "speculative", "infoboxes") if k in given}
    if lost := sorted(set(given["titles"].values()) - given["levels"].keys()):
        raise tables.InputError(f"{path}: no levels for {', '.join(lost)}")
    return chunking.ChunkConfig(**given)


def _chunk(spark, a) -> int:
    pages = _load(spark, a.input, tables.PAGES)
    pages = pages.orderBy("pageid").limit(a.limit) if a.limit else pages
    config = chunk_config(a.config) if a.config else chunking.ChunkConfig()
    if not a.config and not pages.where(F.coalesce(F.col("ns") == config.chapter_ns, F.lit(False)) | F.coalesce(F.col("wikitext").rlike(r"(?i)\{\{\s*ref\s*[|}]|<ref\b"), F.lit(False))).isEmpty():
        raise tables.InputError(f"{a.input}: has chapters or citations, whose levels --config must give")
    chunking.chunk_pages(pages, config).write.mode("overwrite").parquet(a.output)
    made = spark.read.parquet(a.output)
    tables.manifest(made.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("page_id").alias("pages"), F.sum("word_count").alias("words")), a.output.rstrip("/") + ".manifest.json", input=a.input)
    return 0 if a.limit else _report(dq.chunk_checks(made, ["prose", "infobox", "quote"], ["gold", "citation", "llm"], ["[[", "]]", "{{", "}}", "'''"]))


def _report(rows) -> int:
    ok, lines = dq.verdict(rows)
    print("\n".join(lines))
    return 0 if ok else 1


def _explore(spark, a) -> int:
    pages = _load(spark, a.input, tables.PAGES)
    sections, uses = cut(pf.section_rows(pages)), cut(pf.template_uses(pages))
    facts, survival = pf.reference_behaviour(sections), pf.reference_survival(pages)
    residue = pf.residue_windows(pages, "title", "wikitext", r"\[\[|\]\]|\{\{|\}\}")
    empty, leaks = pf.near_empty(pages), pf.category_leaks(pages)
    inventory = cut(pf.template_inventory(uses).drop("example"))
    names = inventory.agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("uses") == 1).alias("once"), *[F.coalesce(F.sum(F.when(c, F.col("uses"))), F.lit(0)).alias(n) for n, c in (("quote", F.col("name") == "quote"), ("ref", F.col("name") == "ref"), ("infobox", F.contains("name", F.lit("infobox"))))])
    parts = [
        (inventory.orderBy(F.desc("uses"), "name"), "Templates"), (pf.top_parameters(uses, "ref"), "First parameters of references"), (pf.distribution(sections.where("level > 0"), "words"), "Section words"), (pf.histogram(sections.where("level > 0"), "words", [0, 20, 50, 100, 230, 380, 500]), "Section sizes"),
        (pf.heading_inventory(sections, ["speculation", "theories"]).withColumn("levels", F.to_json("levels")).orderBy(F.desc("uses"), "heading"), "Headings"), (facts, "References"), (pf.reference_histogram(sections, [0, 1, 2, 4, 8, 16]), "References in a section"), (survival, "Reference bodies"), (pf.top(residue, [F.desc("hits"), F.asc("title")], 10), "Markup"), (empty.limit(10), "Nearly empty pages"), (leaks, "Category leaks"),
    ]
    text = "\n".join(tables.markdown_table(df, title) for df, title in parts)
    garbage = {"residue_pages": 0, "near_empty": empty.count(), "category_leaks": leaks.first().pages}
    tables.write_atomic(a.output, text + "\n## Findings\n\n" + "\n".join(f"- {x}" for x in pf.findings(facts.first().asDict(), {}, names.first().asDict(), survival.first().asDict(), garbage)) + "\n")
    return 0


def _checks(spark, a) -> int:
    if (a.kind or dq.kind_of(a.input)) == "pages":
        return _report(dq.page_checks(_load(spark, a.input, tables.PAGES)))
    return _report(dq.chunk_checks(_load(spark, a.input, tables.CHUNKS), ["prose", "infobox", "quote"], ["gold", "citation", "llm"], ["[[", "]]", "{{", "}}", "'''"]))


def _sample(spark, a) -> int:
    frame = _load(spark, a.input, tables.CHUNKS).where("label_provenance IS NULL AND NOT is_speculation")
    words = a.keywords.split(",") if a.keywords else []
    from corpusmill.functions.text import first_match

    tables.write_jsonl(sa.two_strata(frame, first_match([(w, rf"(?iU)\b\Q{w}\E\b") for w in words], "page_title", "section_heading")), a.output, ["stratum", "chunk_id"], ["matched_keyword"])
    return 0


def _validate(spark, a) -> int:
    labels = lb.last_wins(_load(spark, a.labels, tables.MANUAL_LABELS), "chunk_id", ["labeled_at"], ["manual_book_level"])
    chunks = _load(spark, a.input, tables.CHUNKS).select("chunk_id", F.col("book_level").alias("predicted"), "chunk_type", "section_heading")
    pairs = labels.select("chunk_id", F.expr("try_cast(trim(manual_book_level) as int)").alias("actual")).where("actual IS NOT NULL").join(chunks, "chunk_id")
    scores, refined = ev.score_pairs(pairs), ev.score_pairs(pairs.where(exclusion("chunk_type", "section_heading").isNull()))
    verdict = ev.gate(scores, refined).first()
    print(tables.markdown_table(scores, "Scores"), tables.markdown_table(refined, "Refined scores"), tables.markdown_table(ev.confusion_matrix(pairs, [1, 2, 3]), "Confusion"), f"passed: {verdict.passed}", sep="\n")
    return 0 if verdict.passed else 1


def _graph(spark, a) -> int:
    pages = _load(spark, a.input, tables.PAGES)
    titles = pages.select(F.col("pageid").alias("page_id"), "title")
    redirects = tables.read_mapping(spark, a.redirects) if a.redirects else None
    links = lk.resolved(lk.classified(lk.link_occurrences(pages)), titles, redirects)
    edges = lk.edges(links)
    print(tables.markdown_table(lk.outcomes(links), "Links"), tables.markdown_table(lk.pair_stats(lk.pairs(edges)), "Pairs"), sep="\n")
    if not a.dry_run:
        chunks = _load(spark, a.chunks, tables.CHUNKS).withColumn("chunk_seq", F.col("chunk_id"))
        lk.localized(edges, chunks, titles).write.mode("overwrite").parquet(a.output)
        if a.spot_check:
            rows = spark.read.parquet(a.output).where("match_type = 'text'").select("chunk_id", "target_page_title", "target_page_id")
            print(tables.markdown_table(pf.top(rows, [F.length("target_page_title").asc(), F.asc("target_page_title"), F.asc("chunk_id"), F.asc("target_page_id")], a.spot_check), "Spot check"))
    return 0


def _http(url: str, params: dict) -> tuple[int, dict, dict]:
    """One GET request: (status, headers, JSON)."""
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(f"{url}?{urlencode(params)}", headers={"User-Agent": "corpusmill"}), timeout=30) as r:
            return r.status, dict(r.headers), json.loads(r.read())
    except HTTPError as e:
        return e.code, dict(e.headers), {}


def _named(name: str):
    """What `package.module:name` stands for."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _client(a):
    if not a.url:
        raise tables.InputError("--url must name the wiki's API")
    get = _named(a.client) if a.client else _http
    return lambda: wiki.WikiClient(a.url, get, (urlsplit(a.url).hostname,))


def _fetch(spark, a) -> int:
    pages = wiki.fetch_pages(spark, _client(a), [int(n) for n in a.namespaces.split(",")], a.limit, a.categories)
    pages.write.mode("overwrite").parquet(a.output)
    made = spark.read.parquet(a.output)
    tables.manifest(made.agg(F.count(F.lit(1)).alias("pages"), F.max("fetched_at").alias("fetched_at")), a.output.rstrip("/") + ".manifest.json", source=a.url)
    return 0 if a.limit else _report(dq.page_checks(made))


def _redirects(spark, a) -> int:
    pages = _load(spark, a.input, tables.PAGES)
    links = lk.resolved(lk.classified(lk.link_occurrences(pages)), pages.select(F.col("pageid").alias("page_id"), "title"))
    wanted = [r[0] for r in lk.unresolved_work_list(links).collect()]  # asked of the wiki one after another
    found = wiki.fetch_redirects(_client(a)(), wanted, a.output)
    print(f"{len(wanted)} titles, {len(found)} redirects")
    return 0


def _label_manually(spark, a) -> int:
    sample, chunks = _load(spark, a.labels, tables.SAMPLE), _load(spark, a.input, tables.CHUNKS)
    sa.require_contained(sample, chunks)
    done = tables.read_jsonl(spark, a.output, tables.MANUAL_LABELS) if Path(a.output).exists() else spark.createDataFrame([], tables.MANUAL_LABELS)
    todo = sa.shuffled(lb.to_do(sample, done), "session", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    rows = [r.asDict() for r in todo.select("chunk_id", "text").collect()]  # the sample, which a person reads
    with open(a.output, "a", encoding="utf-8") as log:  # a record is written as soon as it is given
        for record in lb.label_by_hand(rows, input, print, time.monotonic, lambda: datetime.now(timezone.utc).isoformat(timespec="seconds")):
            log.write(json.dumps(record) + "\n")
            log.flush()
    labels = lb.last_wins(tables.read_jsonl(spark, a.output, tables.MANUAL_LABELS), "chunk_id", ["labeled_at"], ["manual_book_level", "seconds_spent"])
    print(tables.markdown_table(labels.join(sample.select("chunk_id", "stratum"), "chunk_id", "left").groupBy("stratum", "manual_book_level").agg(F.count(F.lit(1)).alias("n")), "Labels"))
    return 0


def _prompts(chunks):
    return chunks.select("chunk_id", prompt_fields("page_title", "section_heading", "chunk_type", "text").alias("prompt"))


def _label(spark, a) -> int:
    chunks = _load(spark, a.input, tables.CHUNKS)
    frame = chunks.where("label_provenance IS NULL").orderBy("chunk_id")
    frame = frame.limit(a.limit) if a.limit else frame
    if a.dry_run:
        print(tables.markdown_table(lb.estimate(_prompts(frame), "prompt", 700, 60, 0.75, 4.5), "Estimate"))
        return 0
    if not a.client:
        raise tables.InputError("--client must name a client factory")
    fields = "book_level_raw int, confidence string, rationale string, input_tokens long, cached_tokens long, output_tokens long"
    records = cut(lb.conservative(lb.call_model(_prompts(frame), _named(a.client), "chunk_id", "prompt", fields)))
    wrong = qu.schema_violations(records, {"book_level_raw": [1, 2, 3], "confidence": ["low", "medium", "high"]})
    if bad := [r[0] for r in wrong.select("chunk_id").limit(5).collect()]:
        raise tables.InputError(f"answers outside the schema: {', '.join(bad)}")
    records.write.mode("overwrite").parquet(a.output.rstrip("/") + ".records")
    if not a.limit:
        out = lb.assemble(chunks, records)
        lb.require_labelled(chunks, out)
        out.write.mode("overwrite").parquet(a.output)
    facts = lb.costs(records, 0.75, 0.075, 4.5)
    tables.manifest(facts.crossJoin(lb.fixed_counts(records, "confidence", ["low", "medium", "high"])), a.output.rstrip("/") + ".manifest.json", artifact=lb.artifact_hash(records, ["chunk_id", "book_level"]).first().artifact_hash)  # two single rows
    return 0


def _questions(spark, a) -> int:
    chunks = _load(spark, a.input, tables.CHUNKS).withColumn("chunk_type", F.lower(F.trim("chunk_type")))
    leaf = F.lower(F.trim(F.element_at(F.split("section_heading", ">"), -1)))
    excluded = ((F.col("chunk_type") == "infobox") & (F.col("ns") == 112)) | F.coalesce(F.col("section_heading").rlike(SILENT), F.lit(False)) | F.coalesce(leaf.isin(NAVIGATIONAL), F.lit(False))
    pool = chunks.where(~excluded)
    drawn = sa.ordered(sa.floor_draw(pool, {1: 60, 2: 60, 3: None}, {"infobox": 10, "quote": 10}, "prose"))
    sa.require_contained(drawn, pool)
    rows = chunks.join(drawn.select("chunk_id"), "chunk_id", "left_semi")
    rows = rows.orderBy("chunk_id").limit(a.limit) if a.limit else rows
    if a.dry_run:
        print(tables.markdown_table(lb.estimate(_prompts(rows), "prompt", 500, 40, 0.75, 4.5), "Estimate"))
        return 0
    if not a.client:
        raise tables.InputError("--client must name a client factory")
    made = cut(qu.questions(rows, _named(a.client)))
    tables.write_jsonl(made, a.output, ["chunk_id"], ["banned_reference"])
    print(f"{made.where('banned_reference IS NOT NULL').count()} of {made.count()} questions refer to their source")
    return 0


def _bakeoff(spark, a) -> int:
    chunks = _load(spark, a.chunks, tables.CHUNKS).where("chunk_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["chunk_id"])
    asked = _load(spark, a.input, tables.QUESTIONS).where("chunk_id IS NOT NULL AND question IS NOT NULL")
    if a.dry_run:
        print(tables.markdown_table(em.dry_run(chunks, asked, {"small": 0.02, "large": 0.13}), "Estimate"))
        return 0
    if not a.client:
        raise tables.InputError("--client must name a function that gives the candidates")
    numbered = cut(chunks.select("chunk_id", "text").withColumn("id", F.monotonically_increasing_id()))
    targets = numbered.select("chunk_id", F.col("id").alias("target_id"))
    sa.require_contained(asked, numbered)
    questions = cut(asked.join(targets, "chunk_id").withColumn("query_id", F.monotonically_increasing_id()))
    scores, _, used = em.bakeoff(numbered, questions, _named(a.client)(), ["book_level", "chunk_type"])
    scores = cut(scores)
    tables.write_atomic(a.output, em.report(scores, used, {}))
    tables.write_atomic(a.output + ".json", json.dumps([r.asDict() for r in scores.collect()], indent=2) + "\n")  # a row for each model and stratum
    return 0


def _audit(spark, a) -> int:
    books = json.loads(Path(a.config).read_text(encoding="utf-8")) if a.config else {}
    if not books:
        raise tables.InputError("--config must give the patterns of each book")
    pages = _load(spark, a.input, tables.PAGES)
    audit = cut(au.page_audit(pages, books, "categories" if "categories" in pages.columns else None))
    report = au.tier_report(audit)
    parts = [(report, "Tiers"), (au.chapter_books(audit), "Chapters"), (au.reference_density(audit), "References in 1000 words"), (au.no_signal(audit), "Longest pages without a signal")]
    text = "\n".join(tables.markdown_table(df, title) for df, title in parts)
    tables.write_atomic(a.output, text + ("\nMore labels are needed.\n" if au.needs_labels(report) else ""))
    return 0


STAGES = {"chunk": _chunk, "explore": _explore, "checks": _checks, "sample": _sample, "validate": _validate, "graph": _graph, "fetch": _fetch, "redirects": _redirects, "label-manually": _label_manually, "label": _label, "questions": _questions, "bakeoff": _bakeoff, "audit": _audit}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=sorted(STAGES))
    for name in ("--input", "--output", "--labels", "--chunks", "--redirects", "--keywords", "--url"):
        p.add_argument(name)
    p.add_argument("--client", help="module:name of the client or model factory of the stages fetch, redirects, label, questions and bakeoff")
    p.add_argument("--namespaces", default="0,112")
    p.add_argument("--categories", action="store_true", help="fetch: with the pages' categories")
    p.add_argument("--spot-check", type=int, default=0, help="graph: shortest text mentions to print")
    p.add_argument("--config", help="JSON file with the levels, titles, flags, speculative headings, base_url of the stage chunk")
    p.add_argument("--kind", choices=["pages", "chunks"], help="checks: by default told by the file's name")
    p.add_argument("--limit", type=int, help="pages of a smoke run")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    return STAGES[a.stage](SparkSession.getActiveSession() or session("corpusmill"), a)


if __name__ == "__main__":
    sys.exit(main())
