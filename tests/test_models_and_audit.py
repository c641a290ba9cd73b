"""Embedding, comparison of models, questions, audit, labelling by hand, guards of draws and the wiki source's further parts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import audit, embedding as em, evaluation as ev, labeling as lb, links as lk, profiling as pf, quality as dq, questions as qu, sampling as sa
from corpusmill.sources import wiki


# --- embedding and comparison


def test_pooling_and_truncation():
    hidden, mask = np.array([[[1.0, 0], [3, 2], [9, 9]]]), np.array([[1, 1, 0]])
    assert em.pooled(hidden, mask, "cls").tolist() == [[1, 0]] and em.pooled(hidden, mask, "mean").tolist() == [[2, 1]]
    with pytest.raises(ValueError):
        em.LocalModel(None, None, "max")
    seen = []
    model = em.LocalModel(lambda texts, most: (np.ones((len(texts), 9), int), np.ones((len(texts), 9), int)), lambda ids, mask: seen.append(ids.shape) or np.ones((*ids.shape, 4)), "mean", most=5)
    vectors, tokens = model(["a", "b"])
    assert seen == [(2, 5)] and vectors.shape == (2, 4) and tokens == 10


def test_embedding_batches_norm_and_tokens(spark):
    def make():
        def embed(texts):
            assert len(texts) <= 7
            return [[3.0 * len(texts), 4.0 * len(texts)] for _ in texts], 10 * len(texts)

        return embed

    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}", "x") for i in range(40)], "id long, text string, vector string").coalesce(1)
    rows = em.embedded(df, "id", "text", make, 7).collect()
    assert len(rows) == 40 and all(r.vector == pytest.approx([0.6, 0.8]) for r in rows)
    assert sum(r.tokens for r in rows) == 400 and sum(r.tokens > 0 for r in rows) == 6
    assert em.embedded(df.limit(0), "id", "text", make, 7).count() == 0


def test_bakeoff_scores_and_report(spark):
    vectors = {"c0": [1, 0], "c1": [0.9, 0.1], "c2": [0, 1], "q0": [1, 0], "q1": [1, 0], "Q: q0": [1, 0], "Q: q1": [0, 1]}
    make = lambda: lambda texts: ([vectors[t] for t in texts], len(texts))
    corpus = spark.createDataFrame([(0, "c0"), (1, "c1"), (2, "c2")], "id long, text string")
    asked = spark.createDataFrame([(10, "q0", 0, "a"), (11, "q1", 2, "b")], "query_id long, question string, target_id long, level string")
    scores, ranks, used = em.bakeoff(corpus, asked, {"plain": (make, 100, ""), "prefixed": (make, 32, "Q: ")}, ["level"])
    assert {(r.model, r.query_id): r["rank"] for r in ranks.collect()} == {("plain", 10): 1, ("plain", 11): 3, ("prefixed", 10): 1, ("prefixed", 11): 1}
    overall = {r.model: (r.hit_1, r.hit_3, r.mrr) for r in scores.where("stratum = 'overall'").collect()}
    assert overall == {"plain": (0.5, 1.0, 0.6667), "prefixed": (1.0, 1.0, 1.0)}
    text = em.report(scores, used, {"plain": 2e5})
    assert "| plain | 2 | 0.5000 |" in text and "## By level" in text and "| plain | 5 | 1.0000 |" in text
    with pytest.raises(ValueError, match="11"):
        em.bakeoff(corpus.where("id < 2"), asked, {"plain": (make, 100, "")})
    assert {r.model: r.texts for r in em.dry_run(corpus, asked, {"plain": 0.02, "large": 0.13}).collect()} == {"plain": 5, "large": 5}


def test_ranks_and_scores_of_known_cases(spark):
    corpus = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0], 2), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 3)], "query_id long, vector array<double>, target_id long")
    assert {r.query_id: r["rank"] for r in ev.target_ranks(asked, corpus).collect()} == {0: 4, 1: 1, 2: 1}
    row = ev.retrieval_scores(spark.createDataFrame([(1,), (2,), (5,), (11,)], "rank long")).first()
    assert (row.hit_1, row.hit_5, row.hit_10, row.mrr) == (0.25, 0.75, 0.75, round((1 + 0.5 + 0.2) / 4, 4))
    assert ev.retrieval_scores(spark.createDataFrame([], "rank long")).first().mrr == 0
    assert [r.query_id for r in ev.lost_targets(asked, corpus.where("id <> 3")).collect()] == [2]


# --- questions


@pytest.mark.parametrize("text,found", [("What is infobox for it?", "infobox"), ("What is LISTED here?", "listed"), ("According to the wiki, what happened?", "according to the wiki"), ("According to the section, what?", "section"), ("According to the miller, what happened?", None), ("According to Ana, what?", None), ("What did Ana do?", None), ("A sectional map?", None)])
def test_banned_references(spark, text, found):
    assert qu.refers_to_source(text) == found
    assert spark.createDataFrame([(text,)], "q string").select(qu.banned_reference("q")).first()[0] == found


def test_questions_are_asked_again(spark):
    answers = ["According to the page, who?", "Which section?", "Who is Ana?"]

    def client():
        left = list(answers)
        return lambda prompt: {"question": left.pop(0) if left else "What is listed?", "input_tokens": len(prompt), "cached_tokens": 1, "output_tokens": 5}

    df = spark.createDataFrame([("c1", 1, "prose", "Ana", "", "Ana\n\nAna is a miller.", "x"), ("c2", 2, "prose", "Bo", "Life", "Bo § Life\n\nBo.", "x")], "chunk_id string, book_level int, chunk_type string, page_title string, section_heading string, text string, question string").coalesce(1)
    rows = {r.chunk_id: r for r in qu.questions(df, client).collect()}
    assert rows["c1"].question == "Who is Ana?" and rows["c1"].output_tokens == 15 and rows["c1"].banned_reference is None
    assert rows["c2"].question == "What is listed?" and rows["c2"].output_tokens == 20 and rows["c2"].banned_reference == "listed" and rows["c2"].book_level == 2
    assert qu.violations(qu.questions(df, client)).count() == 1


def test_output_schema(spark):
    df = spark.createDataFrame([(1, '{"level": 2, "confidence": "high"}'), (2, '{"level": 7, "confidence": "high"}'), (3, "no json"), (4, '{"level": 1}'), (5, None)], "id int, answer string")
    rows = {r.id: r.violation for r in qu.parsed(df, "answer", "level int, confidence string", {"level": [1, 2, 3], "confidence": ["low", "high"]}).collect()}
    assert rows == {1: None, 2: "level", 3: "json", 4: "confidence", 5: "json"}
    flat = spark.createDataFrame([("a", 2), ("", 2), ("b", 9)], "q string, level int")
    assert [r.violation for r in qu.schema_violations(flat, {"level": [1, 2, 3]}, ["q"]).collect()] == ["q", "level"]


# --- audit


def test_audit_tiers(spark):
    books = {"one": [r"(?i)\bfirst book\b", r"\bFB\b"], "two": [r"(?i)second book"]}
    rows = [
        (1, 112, "Chapter 1 (FB)", "x", None), (2, 0, "a", "x second book", ["First book people"]), (3, 0, "b", "x<REF name=q>The\nFIRST book</REF> second book <ref name=q />", None),
        (4, 0, "c", "{{Character\n| Debut = Second Book \n|other=1}}", []), (5, 0, "d", "in the first book", None), (6, 0, "e", "nothing fb", None), (7, 0, None, None, None), (8, 112, "Chapter 2", "no name", None),
    ]
    out = audit.page_audit(spark.createDataFrame(rows, "pageid long, ns int, title string, wikitext string, categories array<string>"), books, "categories")
    got = {r.pageid: (r.tier, r.books, r.refs) for r in out.collect()}
    assert got == {1: ("chapter", ["one"], 0), 2: ("category", ["one"], 0), 3: ("reference", ["one"], 1), 4: ("appearance", ["two"], 0), 5: ("mention", ["one"], 0), 6: ("none", [], 0), 7: ("none", [], 0), 8: ("chapter", [], 0)}
    report = audit.tier_report(out)
    assert {r.tier: r.pages for r in report.collect()} == {"chapter": 2, "category": 1, "reference": 1, "appearance": 1, "mention": 1, "none": 2}
    assert [(r.book, r.pages) for r in audit.chapter_books(out).collect()] == [("one", 1)]
    assert [r.pageid for r in audit.no_signal(out, 1).collect()] == [6] and not audit.needs_labels(report)
    assert audit.reference_density(out).first().pages == 7


# --- labelling, draws, quality, links


def test_labelling_by_hand_and_its_guards(spark):
    said = iter(["9", "2", "q"])
    clock = iter([0.0, 5.04, 10.0, 11.0])
    shown = []
    out = list(lb.label_by_hand([{"chunk_id": "a", "text": "A"}, {"chunk_id": "b", "text": "B"}, {"chunk_id": "c", "text": "C"}], lambda p: next(said), shown.append, lambda: next(clock), lambda: "now"))
    assert out == [{"chunk_id": "a", "manual_book_level": "2", "seconds_spent": 5.0, "labeled_at": "now"}] and shown == ["A", "B"]
    before = spark.createDataFrame([("a", None), ("b", 1)], "chunk_id string, book_level int")
    lb.require_labelled(before, spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, book_level int"))
    with pytest.raises(lb.ContractError, match="without a level"):
        lb.require_labelled(before, before)
    with pytest.raises(lb.ContractError, match="repeated"):
        lb.require_labelled(before, spark.createDataFrame([("a", 1), ("a", 1)], "chunk_id string, book_level int"))
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert lb.artifact_hash(df, ["k", "v"]).first() == lb.artifact_hash(df.orderBy(F.desc("k")).repartition(3), ["k", "v"]).first() != lb.artifact_hash(df.limit(1), ["k", "v"]).first()


def test_draw_statistics_and_membership(spark):
    frame = spark.createDataFrame([(f"k{i}", "bell" if i < 5 else "mill" if i < 8 else None) for i in range(50)], "chunk_id string, word string")
    stats = {(r.stat, r.name): r.n for r in sa.draw_stats(frame, F.col("word"), 30, 20).collect()}
    assert stats == {("frame", ""): 50, ("cluster pool", ""): 8, ("random pool", ""): 42, ("cluster drawn", ""): 8, ("random drawn", ""): 22, ("shortfall", ""): 0, ("keyword", "bell"): 5, ("keyword", "mill"): 3}
    drawn = spark.createDataFrame([("k1",), ("gone",)], "chunk_id string")
    assert [r[0] for r in sa.contained(drawn, frame).collect()] == ["gone"] and [r[0] for r in sa.disjoint(drawn, frame).collect()] == ["k1"]
    with pytest.raises(ValueError, match="gone"):
        sa.require_contained(drawn, frame)
    sa.require_contained(drawn.where("chunk_id = 'k1'"), frame)


def test_schema_and_spot_checks(spark):
    df = spark.createDataFrame([("P", "Infobox", "gold", 1, 3)], "page_title string, chunk_type string, label_provenance string, page_id long, word_count int")
    assert dq.schema_difference(df, df.drop("page_id").withColumn("x", F.lit(1))) == (["page_id"], ["x"])
    assert dq.schema_check(df, [*df.columns, "y"]).first().severity == "FAIL" and dq.schema_check(df, df.columns).first().severity == "PASS"
    rows = {r.check: r.severity for r in dq.spot_checks(df, "P", "P", 1, ["P", "Q"]).collect()}
    assert rows == {"infobox of P": "PASS", "quote of P": "FAIL", "gold pages": "PASS", "known garbage pages": "WARN"}
    pages = spark.createDataFrame([(112, "{{x| book=1}}"), (112, "raw"), (0, "")], "ns int, wikitext string")
    assert {r.check: r.severity for r in dq.chapter_checks(pages).collect()} == {"chapters": "PASS", "chapters are raw": "FAIL", "chapters name books": "PASS"}
    assert {r.severity for r in dq.chapter_checks(pages.where("ns = 0")).collect()} == {"FAIL"}
    assert dq.kind_of("/x/chunks_labeled.jsonl") == "chunks" and dq.kind_of("data/pages.parquet/") == "pages"


def test_comentions_and_first_titles(spark):
    rows = spark.createDataFrame([("c1", 1, 2, "link"), ("c2", 2, 1, "text"), ("c3", 1, 3, "text"), ("c3", 1, 3, "text"), ("c4", 4, 4, "link")], "chunk_id string, source_page_id long, target_page_id long, match_type string")
    assert {tuple(r) for r in lk.comentions(rows).collect()} == {(1, 2, 2, True, 1), (1, 3, 1, False, 1)}
    links = spark.createDataFrame([(p, "Old mill", "candidate", None) for p in range(900, 0, -1)], "page_id long, target string, action string, method string")
    row = lk.first_titles(links).first()
    assert (row.uses, row.samples) == (900, [1, 2, 3, 4, 5])


def test_profile_parts(spark):
    pages = spark.createDataFrame([(1, "A<ref>one two [[x]]</ref><ref>{{q}}</ref> {{ref|TAC|1}} {{ref|TAC|2}} {{ref|TGF}}"), (2, "{{" + "x" * 400 + "}} few"), (3, "Category:Leak [[Category:fine]]")], "pageid long, wikitext string")
    assert tuple(pf.reference_survival(pages).first()) == (2, 1, 50.0)
    assert [tuple(r) for r in pf.top_parameters(pf.template_uses(pages), "ref").collect()] == [("TAC", 2), ("TGF", 1)]
    assert [r.pageid for r in pf.near_empty(pages).collect()] == [2] and pf.category_leaks(pages).first().pages == 1
    said = pf.findings({"sections": 100, "over_500": 2, "under_50": 40, "with_any": 30}, {"null": 5}, {"quote": 9, "infobox": 3, "ref": 4, "names": 10, "once": 6}, {"refs": 10, "survived": 9}, {"residue_pages": 1, "near_empty": 2, "category_leaks": 3})
    assert len(said) == 12 and len(pf.findings({"sections": 0, "over_500": 0, "under_50": 0, "with_any": 60}, {})) == 1


# --- the wiki source


def test_wiki_categories_redirects_and_model_files(tmp_path):
    def get(url, params):
        if params.get("prop") == "categories":
            pages = [{"pageid": 1, "categories": [{"title": "Category:A"}]}] if "clcontinue" not in params else [{"pageid": 1, "categories": [{"title": "Category:B c"}]}, {"pageid": 2}]
            return 200, {}, {"query": {"pages": pages}, **({} if "clcontinue" in params else {"continue": {"clcontinue": "x", "continue": "||"}})}
        return 200, {}, {"query": {"normalized": [{"from": "a_b", "to": "A b"}], "redirects": [{"from": "A b", "to": "C"}, {"from": "C", "to": "D"}, {"from": "E", "to": "E"}]}}

    client = wiki.WikiClient("https://w.example/api", get, ("w.example",), sleep=lambda s: None)
    assert client.categories([1, 2]) == {1: ["A", "B c"], 2: []}
    assert wiki.fetch_redirects(client, ["a_b", "X"], str(tmp_path / "r.json")) == {"a_b": "D"}
    assert json.loads((tmp_path / "r.json").read_text()) == {"a_b": "D"} and json.loads((tmp_path / "r.json.manifest.json").read_text())["titles"] == 2
    asked = []
    fetch = lambda a: asked.append(a) or (b"w" if a == "u2" else None)
    for _ in range(2):
        assert wiki.download_model(fetch, {"m.onnx": ["u1", "u2"]}, str(tmp_path))["m.onnx"].endswith("m.onnx")
    assert asked == ["u1", "u2"] and (tmp_path / "m.onnx").read_bytes() == b"w"
    with pytest.raises(wiki.InputError):
        wiki.download_model(fetch, {"t.json": ["u1"]}, str(tmp_path))


def test_localization_of_a_hub_in_blocks(spark, monkeypatch):
    """A page's targets are looked for in blocks of any size with the same rows; texts and targets are held once for each block."""
    names = [f"Mill {i}" for i in range(12)]
    edges = spark.createDataFrame([(0, i + 1, 2, [n, f"the [[{n}]]"]) for i, n in enumerate(names)], "src long, dst long, links long, displays array<string>")
    chunks = spark.createDataFrame([(f"0:a:{k}", 0, k, "So " + ", ".join(names[k : k + 5]) + " and MILL 3. Millet 3") for k in range(8)] + [("4:a:0", 4, 0, "The hub, of course"), ("5:a:0", 5, 0, "Subhub")], "chunk_id string, page_id long, chunk_seq int, text string")
    titles = spark.createDataFrame([(0, "Hub")] + [(i + 1, n) for i, n in enumerate(names)], "page_id long, title string")

    def rows(size):
        monkeypatch.setattr(lk, "PAGE_TARGETS", size)
        return sorted(tuple(r) for r in lk.localized(edges, chunks, titles).collect())

    whole = rows(4000)
    assert rows(1) == rows(5) == whole
    assert ("4:a:0", 4, 0, "Hub", "reverse", "text") in whole and not any(r[0] == "5:a:0" for r in whole)
    mine = [r for r in whole if r[2] == 1]
    assert mine == [("0:a:0", 0, 1, "Mill 0", "forward", "link")]
    assert sum(r[2] == 4 and r[5] == "text" for r in whole) == 7 and sum(r[2] == 4 and r[5] == "link" for r in whole) == 1
