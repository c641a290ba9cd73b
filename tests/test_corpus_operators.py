"""Behaviour of the corpus operators on invented fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T, wikitext
from corpusmill.operators import chunking, evaluation as ev, labeling as lb, links as lk, profiling as pf, quality as dq, sampling as sa
from corpusmill.sources import tables, wiki
from corpusmill.streaming import logs

CONFIG = chunking.ChunkConfig(levels={"ONE": 1, "TWO": 2, "SIX": 3}, titles={"the first tale": "ONE", "the second tale": "TWO"}, speculative=("theories",), infoboxes=("person infobox",))


def words(n, w="word"):
    return " ".join(f"{w}{i}" for i in range(n))


def page(text, ns=0, title="Mill", pageid=7, revid=3):
    return {"pageid": pageid, "ns": ns, "title": title, "revid": revid, "wikitext": text}


def chunks(text, **kw):
    return chunking.PageReader(page(text, **kw), CONFIG).chunks()


# --- markup


def test_sections_have_paths():
    got = [(s.path, s.level) for s in wikitext.sections("lede\n== A ==\nx\n=== B ===\ny\n==== deep ====\nz\n== C ==\nw\n<!--\n== hidden ==\n-->")]
    assert got == [("", 0), ("A", 2), ("A > B", 3), ("C", 2)]


def test_nested_templates_links_and_plain_text():
    text = "a {{outer|x={{inner|1}}|[[P|q]]}} [[Mill#top|the mill]] [[Plain]] [[File:x.png|thumb|a [[Z|z]]]] '''b'''&nbsp;<i>c</i><!-- d --> [[broken"
    assert [t.name for t in wikitext.templates(text)] == ["outer", "inner"]
    assert wikitext.templates(text)[0].params == [("x", "{{inner|1}}"), (None, "[[P|q]]")]
    assert ("Mill#top", "the mill") in wikitext.links(text) and ("Plain", "Plain") in wikitext.links(text)
    assert wikitext.plain(text).split() == "a the mill Plain b c [[broken".split()
    assert wikitext.plain(None) == "" and wikitext.links(None) == [] and wikitext.sections(None) == []


def test_deep_nesting_takes_linear_time():
    assert len(wikitext.spans("{{a|" * 5000)) == 0
    assert len(wikitext.spans("{{a}}" * 5000)) == 5000


def test_nesting_of_any_depth_is_matched():
    assert [(s.start, s.end, s.kind) for s in wikitext.spans("{{a|" + "[[x " * 200 + "}}")] == [(0, 806, "template")]
    assert len(wikitext.spans("{{a|" * 3000 + "}}" * 3000)) == 3000
    assert wikitext.plain("a " + "[[x|" * 40 + "b" + "]]" * 40 + "{{c|" * 3000 + "}}" * 3000 + " d") == "a b d"


# --- chunking


def test_lede_sections_and_identity():
    text = f"{words(60)}\n\n== A ==\n{words(60, 'a')}\n\n=== B ===\n{words(60, 'b')}\n\n== C ==\n{words(60, 'c')}"
    got = chunks(text)
    assert [c["section_heading"] for c in got] == ["", "A", "A > B", "C"]
    assert [c["chunk_id"] for c in got] == ["7:lede:0", "7:a:0", "7:a-b:0", "7:c:0"]
    edited = chunks(text.replace("b5", "B5"))
    assert [c["chunk_id"] for c in edited] == [c["chunk_id"] for c in got]
    assert sum(a["content_hash"] != b["content_hash"] for a, b in zip(got, edited)) == 1


def test_near_empty_pages_give_nothing():
    assert chunks("{{Person infobox|name=Ana}}\nshort") == []


def test_split_with_overlap():
    paragraphs = [words(200, x) for x in "abc"]
    got = chunks("== A ==\n" + "\n\n".join(paragraphs) + "\n\n== B ==\nnext " + words(30))
    prose = [c for c in got if c["section_heading"] == "A"]
    assert len(prose) == 3
    assert prose[1]["text"].split("\n\n")[1].split() == paragraphs[0].split()[-40:]
    assert "c199" not in got[-1]["text"]


def test_long_paragraph_stays_whole_and_is_noted():
    reader = chunking.PageReader(page(words(430)), CONFIG)
    assert len(reader.chunks()) == 1 and any("long paragraph" in n for n in reader.notes)


def test_infobox_quote_and_flags():
    got = chunks("{{Odd infobox|name=[[Ana|Anna]]|image=x.png|date=2020}}{{conjecture}}\n" + words(30) + "\n== S ==\n{{quote|Said so.|Ben}}\n" + words(10) + "\n[[Category:People]]")
    assert got[0]["chunk_type"] == "infobox" and got[0]["text"].endswith("Name: Anna")
    quote = next(c for c in got if c["chunk_type"] == "quote")
    assert quote["section_heading"] == "S" and quote["text"].endswith("Said so.\n— Ben")
    assert all(c["is_speculation"] and c["categories"] == ["People"] and c["quality_flags"] == ["conjecture"] for c in got)


def test_citations_belong_to_the_part_that_holds_them():
    got = chunks(f"{words(200)}\n\n{words(190, 'x')}{{{{ref|one}}}}{{{{Ref | TWO }}}}{{{{ref|odd}}}}")
    assert [(c["book_level"], c["citation_codes"]) for c in got] == [(None, []), (2, ["ONE", "TWO", "ODD"])]
    assert got[1]["label_provenance"] == "citation" and "" not in got[1]["text"]
    tag = chunks(words(30) + "<ref>From The Second Tale, leaf 3</ref>")[0]
    assert tag["citation_codes"] == ["TWO"] and "leaf 3" not in tag["text"]


def test_harvest_of_deep_templates():
    deep = "{{a|" * 40 + "{{quote|Said so.|Ben}}{{ref|two}}" + "}}" * 40
    got = chunks(f"{{{{Odd infobox|name=Ana|note={deep}}}}}\n{words(30)}")
    assert [c["chunk_type"] for c in got] == ["infobox", "prose", "quote"]
    assert got[0]["text"].endswith("Name: Ana") and got[2]["text"].endswith("Said so.\n— Ben")


def test_gold_levels_of_chapters():
    assert {c["book_level"] for c in chunks("{{Chapter infobox|book=SIX|n=1}}\n" + words(30), ns=112)} == {3}
    assert {c["label_provenance"] for c in chunks(words(30), ns=112, title="The first tale 3")} == {"gold"}
    assert chunks(words(30), ns=112)[0]["book_level"] is None


def test_the_query_reads_reference_tags_chapters_and_its_speculative_headings():
    from corpusmill.plans.reference_queries import CONFIG as own

    def read(text, **kw):
        reader = chunking.PageReader(page(text, **kw), own)
        return reader.chunks(), reader.notes

    got, _ = read(f'{words(30)}<ref>Book TLW, ch. 9</ref>\n== Possible origins ==\n{words(30)}<ref name="tac2">book tac ch 4</ref><ref name="tac2"/>')
    assert [(c["citation_codes"], c["book_level"], c["label_provenance"], c["is_speculation"]) for c in got] == [(["TLW"], 2, "citation", False), (["TAC"], 1, "citation", True)]
    for kw, text in (({"title": "Chapter:Book TGF, 3"}, words(30)), ({"title": "Chapter:Mill"}, f"{words(30)}<ref>Book TGF, ch. 3</ref>")):
        got, notes = read(text, ns=112, **kw)
        assert {(c["book_level"], c["label_provenance"]) for c in got} == {(2, "gold")} and notes == []
    assert read(words(30), ns=112)[1] == ["chapter without a level"]


def test_duplicate_headings_get_ids_of_their_own():
    assert len({c["chunk_id"] for c in chunks(f"{words(30)}\n== A ==\n{words(5)}\n== A ==\n{words(5)}")}) == 3


def test_chunk_pages_on_dirt(spark):
    rows = [(1, 0, "A", 1, words(40)), (2, 0, None, None, words(40)), (3, 0, "B", 1, None), (None, 0, "C", 1, words(40)), (4, 0, "D", 1, "")]
    df = spark.createDataFrame(rows, "pageid long, ns int, title string, revid long, wikitext string")
    assert chunking.chunk_pages(df.where("title IS NOT NULL"), CONFIG).count() == 1
    assert chunking.chunk_pages(df.limit(0), CONFIG).count() == 0
    assert "dropped: nearly empty" in {r.note for r in chunking.page_notes(df.where("title IS NOT NULL"), CONFIG).collect()}


# --- links


def test_target_classes(spark):
    df = spark.createDataFrame([("Category:X",), ("File:a.png",), ("de:Mühle",), ("Chapter:One",), (":Mill",), ("#top",), ("Mill#a",), ("A: b",)], "raw_target string")
    got = {r.raw_target: (r.action, r.target) for r in lk.classified(df).collect()}
    assert got["Category:X"][0] == got["File:a.png"][0] == "namespace" and got["de:Mühle"][0] == "interwiki"
    assert got["Chapter:One"] == ("candidate", "Chapter:One") and got[":Mill"] == ("candidate", "Mill") and got["#top"][0] == "anchor" and got["Mill#a"] == ("candidate", "Mill") and got["A: b"][0] == "candidate"


def test_resolution_tiers_and_edges(spark):
    titles = spark.createDataFrame([(1, "Old Mill"), (2, "Reed"), (3, "TWIN"), (4, "Twin"), (5, "Home")], "page_id long, title string")
    redirects = spark.createDataFrame([("The Reed", "Reed"), ("Lost", "reed")], "`from` string, `to` string")
    names = ["Old Mill", "old_mill", "OLD MILL", "twin", "The Reed", "Lost", "Home", "TWIN"]
    links = spark.createDataFrame([(5, i, n, n) for i, n in enumerate(names)], "page_id long, pos int, raw_target string, display string")
    got = lk.resolved(lk.classified(links), titles, redirects)
    # "twin" normalizes to "Twin", which is a title
    assert {r.raw_target: (r.target_id, r.method) for r in got.collect()} == {"Old Mill": (1, "exact"), "old_mill": (1, "casefold"), "OLD MILL": (1, "casefold"), "twin": (4, "normalized"), "The Reed": (2, "redirect"), "Lost": (None, None), "Home": (5, "exact"), "TWIN": (3, "exact")}
    edges = lk.edges(got)
    assert {(r.src, r.dst): r.displays for r in edges.collect()} == {(5, 1): ["Old Mill", "old_mill", "OLD MILL"], (5, 2): ["The Reed"], (5, 3): ["TWIN"], (5, 4): ["twin"]}
    assert {r.outcome: r.n for r in lk.outcomes(got).collect()}["self link"] == 1
    assert [r.target for r in lk.unresolved_work_list(got).collect()] == ["Lost"]
    assert [tuple(r) for r in lk.first_titles(got).collect()] == [("Lost", 1, [5])]


def test_ambiguous_fold_stays_unresolved(spark):
    titles = spark.createDataFrame([(3, "TWIN"), (4, "TwIn")], "page_id long, title string")
    links = spark.createDataFrame([(5, 0, "twin", "twin")], "page_id long, pos int, raw_target string, display string")
    assert lk.resolved(lk.classified(links), titles).first().method is None


def test_pairs(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "src long, dst long")
    assert tuple(lk.pair_stats(lk.pairs(e)).first()) == (2, 1, 1)


def test_localization(spark):
    chunks_ = spark.createDataFrame([(f"1:{i}", 1, i, t) for i, t in enumerate(["the reed bends", "Reed again, the reed", "reeds only", None])] + [("2:0", 2, 0, "near the Mill."), ("2:1", 2, 1, "Millers")], "chunk_id string, page_id long, chunk_seq int, text string")
    edges = spark.createDataFrame([(1, 2, ["the reed", "'''the reed'''", "the reed"])], "src long, dst long, displays array<string>")
    titles = spark.createDataFrame([(1, "Mill"), (2, "Reed")], "page_id long, title string")
    got = {(r.chunk_id, r.target_page_id, r.direction, r.match_type) for r in lk.localized(edges, chunks_, titles).collect()}
    assert got == {("1:0", 2, "forward", "link"), ("1:1", 2, "forward", "link"), ("2:0", 1, "reverse", "text")}


def test_redirect_hops(spark):
    frame = lambda rows: spark.createDataFrame(rows, "`from` string, `to` string")
    out = lk.resolve_redirects(spark.createDataFrame([("a_x",), ("n",), ("q",)], "title string"), frame([("a_x", "A x"), ("n", "N")]), frame([("A x", "B"), ("B", "C")]))
    assert {tuple(r) for r in out.collect()} == {("a_x", "C")}


# --- labels, samples, scores


def test_assembly_and_contract(spark):
    c = spark.createDataFrame([("a", 1, "gold"), ("b", None, None), ("c", 2, "citation")], "chunk_id string, book_level int, label_provenance string")
    records = lb.conservative(spark.createDataFrame([("b", 1, "low")], "chunk_id string, book_level_raw int, confidence string"))
    got = {r.chunk_id: (r.book_level, r.label_provenance, r.book_level_raw) for r in lb.assemble(c, records).collect()}
    assert got == {"a": (1, "gold", None), "b": (3, "llm", 1), "c": (2, "citation", None)}
    with pytest.raises(lb.ContractError):
        lb.assemble(c, records.limit(0))


def test_last_wins_and_streaming_agree(spark, tmp_path):
    rows = [("x", "1", 1.0, "2026-01-01"), ("x", "2", 2.0, "2026-01-02"), ("y", "u", None, "2026-01-01"), (None, "3", 1.0, "2026-01-03"), ("x", "2", 2.0, "2026-01-02")]
    df = spark.createDataFrame(rows, tables.MANUAL_LABELS)
    values = ["manual_book_level", "labeled_at"]
    want = {("x", "2", "2026-01-02"), ("y", "u", "2026-01-01")}
    assert {tuple(r) for r in lb.last_wins(df, "chunk_id", ["labeled_at"], values).collect()} == want
    df.write.parquet(str(tmp_path / "manual_labels.parquet"))
    stream = logs.read_stream(spark, str(tmp_path), "manual_labels")
    assert {tuple(r) for r in logs.drain(logs.last_wins(stream, "chunk_id", ["labeled_at"], values), "t_last").collect()} == want


def test_windowed_counts_drop_late_state(spark, tmp_path):
    spark.createDataFrame([("a", "2026-01-01 00:01:00"), ("a", "2026-01-01 00:02:00"), ("b", "2026-01-01 00:11:00")], "k string, t string").select("k", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "ev.parquet"))
    out = logs.drain(logs.windowed_counts(logs.read_stream(spark, str(tmp_path), "ev"), "t", "k", "10 minutes", "5 minutes"), "t_windows")
    assert {(r.k, r.n) for r in out.collect()} == {("a", 2), ("b", 1)}


def test_model_calls_retry_accept_and_give_up(spark):
    def client():
        calls = {"n": 0}

        def ask(message):
            calls["n"] += 1
            if message == "bad" or (message == "flaky" and calls["n"] == 1):
                raise OSError("down")
            return {"answer": "no" if message == "picky" and calls["n"] < 3 else "yes", "input_tokens": 10}

        return ask

    rows = lambda m: spark.createDataFrame([("k", m)], "id string, m string").coalesce(1)
    run = lambda m, **kw: lb.call_model(rows(m), client, "id", "m", "answer string, input_tokens long", backoff=0.0, **kw).collect()
    assert tuple(run("flaky")[0]) == ("k", "yes", 10)
    assert tuple(run("picky", accept=lambda r: r["answer"] == "yes", content_tries=4)[0]) == ("k", "yes", 30)
    with pytest.raises(Exception, match="gave up on k"):
        run("bad")


def test_scores(spark):
    pairs = spark.createDataFrame([(2, 2), (2, 3), (2, 1), (1, 1)], "actual int, predicted int")
    s = ev.score_pairs(pairs).first()
    assert (s.n, s.correct, s.caught, s.positives) == (4, 2, 2, 3) and 0 < s.low < s.accuracy < s.high < 1
    empty = ev.score_pairs(pairs.limit(0)).first()
    assert (empty.accuracy, empty.low, empty.high, empty.recall) == (0, 0, 0, 0)
    assert ev.confusion_matrix(pairs, [1, 2, 3]).count() == 9
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, 4), (4, 20)], "query_id long, rank long")
    r = ev.retrieval_scores(ranks).first()
    assert (r.hit_1, r.hit_5, r.hit_10, r.mrr) == (0.25, 0.75, 0.75, 0.4375)
    assert ev.retrieval_scores(ranks.limit(0)).first().mrr == 0


def test_ranks_against_brute_force(spark):
    rng = random.Random(1)
    vectors = [(i, [round(rng.uniform(-1, 1), 3) for _ in range(4)]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(vectors, "id long, vector array<float>")
    q = df.where("id % 20 = 0 AND vector IS NOT NULL").select(F.col("id").alias("query_id"), "vector", (F.col("id") + 1).alias("target_id"))
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 6)
    v = dict(vectors[:60])
    want = {i: 1 + sum(dot(v[i], x) > dot(v[i], v[i + 1]) for x in v.values()) for i in (0, 20, 40)}
    assert {r.query_id: r.rank for r in ev.target_ranks(q, df, digits=6).collect()} == want


def test_two_strata_fill_up(spark):
    frame = spark.createDataFrame([(f"c{i}", "bell" if i < 10 else None) for i in range(110)], "chunk_id string, k string")
    got = sa.two_strata(frame, F.col("k")).groupBy("stratum").count().collect()
    assert {r.stratum: r["count"] for r in got} == {"cluster": 10, "random": 70}


def test_percentiles_and_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, None)], "v int")
    r = pf.distribution(df, "v").first()
    assert (r.n, r.p50, r.p90, r.p99, r.largest) == (4, 3, 4, 4, 4)
    assert [x.n for x in pf.histogram(df, "v", [0, 2, 10]).orderBy("bucket_no").collect()] == [1, 3, 0]


def test_namespace_drift(spark):
    pages = lambda n: spark.createDataFrame([(0,)] * n, "ns int")
    level = lambda n: dq.namespace_drift(pages(n), {0: 100}).first().severity
    assert [level(100), level(97), level(60)] == ["PASS", "WARN", "FAIL"]


# --- text helpers, sources


def test_text_helpers(spark):
    df = spark.createDataFrame([("a b  c", "éa / Ü~", "x\n\ny\n\nz"), (None, None, None), ("", "", "")], "t string, u string, h string")
    rows = df.select(T.word_count("t").alias("n"), T.last_words("t", 2).alias("w"), T.slug("u").alias("s"), T.page_url("u:", "u").alias("url"), T.strip_header("h").alias("h"), T.truncated("t", 3).alias("cut")).collect()
    assert tuple(rows[0])[:5] == (3, "b c", "ea-u", "u:%C3%A9a_/_%C3%9C~", "y\n\nz") and rows[1].n is None and (rows[2].n, rows[2].s) == (0, "section")
    m = spark.createDataFrame([("The A.B (c) mill", "a.b (c)", True), ("Rothé", "Roth", False)], "t string, p string, want boolean")
    assert all(r.got == r.want for r in m.select("want", T.mentions("t", "p").alias("got")).collect())


def test_jsonl_and_manifest(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"chunk_id": "a", "stratum": "s"}\n\n{"chunk_id": "b"}\n')
    assert tables.read_jsonl_strict(spark, str(path), tables.SAMPLE, ["chunk_id"]).count() == 2
    with pytest.raises(tables.InputError):
        tables.read_jsonl_strict(spark, str(path), tables.SAMPLE, ["stratum"]).count()
    tables.write_jsonl(tables.read_jsonl(spark, str(path), tables.SAMPLE), str(tmp_path / "out"), ["chunk_id"], ["matched_keyword"])
    lines = sorted(x for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"chunk_id": "a", "stratum": "s"}, {"chunk_id": "b", "stratum": None}]
    tables.manifest(spark.range(3).agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "m.json"), tool="t")
    assert json.loads((tmp_path / "m.json").read_text()) == {"n": 3, "tool": "t"}
    assert tables.read_mapping(spark, str(tmp_path / "absent.json")).count() == 0
    with pytest.raises(tables.InputError):
        tables.frozen(spark, str(path), "nothex")


def test_wiki_client(spark):
    asked = []

    def get(url, params):
        asked.append(params)
        if len(asked) == 1:
            return 503, {"Retry-After": "3"}, {}
        if params.get("list"):
            more = {"continue": {"apcontinue": "x", "continue": "-||"}} if "apcontinue" not in params else {}
            return 200, {}, {"query": {"allpages": [{"pageid": 1 if more else 2}]}} | more
        if "pageids" in params:
            return 200, {}, {"query": {"pages": [{"pageid": 2, "missing": True}, {"pageid": 1, "ns": 0, "title": "A", "revisions": [{"revid": 5, "timestamp": "t", "slots": {"main": {"content": "x"}}}]}]}}
        return 200, {}, {"query": {"normalized": [{"from": "a_b", "to": "A b"}], "redirects": [{"from": "A b", "to": "C"}]}}

    waits = []
    client = wiki.WikiClient("https://wiki.example/api.php", get, ("wiki.example",), waits.append)
    ids = list(client.list_pages(0))
    assert ids == [1, 2] and asked[-1]["continue"] == "-||" and waits[0] == 3.0
    assert [p["pageid"] for p in client.contents(ids)] == [1]
    assert client.redirects(["a_b", "plain"]) == {"a_b": "C"}
    with pytest.raises(tables.InputError):
        wiki.WikiClient("https://other.example/", get, ("wiki.example",))


def test_cli_stages(spark, tmp_path, capsys):
    from corpusmill import cli

    rows = [(1, 0, "Mill", 1, "2026-01-01T00:00:00Z", f"{words(40)} [[Reed]] {{{{stub}}}}", "x"), (2, 0, "Reed", 1, "2026-01-01T00:00:00Z", f"{words(40)}\n== A ==\nMill {words(40)}", "x")]
    pages, out = str(tmp_path / "pages.parquet"), str(tmp_path / "chunks.parquet")
    spark.createDataFrame(rows, tables.PAGES).write.parquet(pages)
    assert cli.main(["chunk", "--input", pages, "--output", out]) == 0
    assert cli.main(["checks", "--input", out]) == 0
    assert cli.main(["explore", "--input", pages, "--output", str(tmp_path / "report.md")]) == 0 and "stub" in (tmp_path / "report.md").read_text()
    assert cli.main(["graph", "--input", pages, "--chunks", out, "--output", str(tmp_path / "links.parquet")]) == 0
    assert {(r.source_page_id, r.target_page_id) for r in spark.read.parquet(str(tmp_path / "links.parquet")).collect()} == {(1, 2), (2, 1)}


def test_cli_chunk_takes_its_levels_from_a_file(spark, tmp_path):
    from corpusmill import cli

    texts = [("Mill", 0, f"{words(30)}{{{{ref|one}}}}"), ("Reed", 0, f"{words(30)}<ref>The Second Tale, leaf 3</ref>\n== Rumors ==\n{words(30)}"), ("Chapter:A", 112, f"{{{{Chapter infobox|book=SIX}}}}\n{words(30)}"), ("Chapter:The first tale 2", 112, words(400) + f"\n\n{words(30)}")]
    pages, out, config = (str(tmp_path / x) for x in ("pages.parquet", "chunks.parquet", "config.json"))
    spark.createDataFrame([(i, ns, title, 1, None, text, None) for i, (title, ns, text) in enumerate(texts)], tables.PAGES).write.parquet(pages)
    run = lambda *more: cli.main(["chunk", "--input", pages, "--output", out, *more])
    with pytest.raises(tables.InputError, match="--config"):
        run()
    for bad in ({}, {"levels": {}}, {"levels": {"ONE": 1}, "title": {}}, {"levels": {"ONE": 1}, "titles": {"the second tale": "TWO"}}):
        (tmp_path / "config.json").write_text(json.dumps(bad))
        with pytest.raises(tables.InputError):
            run("--config", config)
    assert not (tmp_path / "chunks.parquet").exists()
    (tmp_path / "config.json").write_text(json.dumps({"levels": {"ONE": 1, "TWO": 2, "SIX": 3}, "titles": {"The First Tale": "ONE", "The Second Tale": "TWO"}, "speculative": ["Rumors"], "base_url": "https://w.example/"}))
    assert run("--config", config) == 0
    got = {(r.page_id, r.book_level, r.label_provenance, r.is_speculation) for r in spark.read.parquet(out).where("chunk_type = 'prose'").collect()}
    assert got == {(0, 1, "citation", False), (1, 2, "citation", False), (1, None, None, True), (2, 3, "gold", False), (3, 1, "gold", False)}
    assert {r.page_url for r in spark.read.parquet(out).where("page_id = 0").collect()} == {"https://w.example/Mill"}


def test_cli_gate_takes_the_refined_scores(spark, tmp_path, capsys):
    from corpusmill import cli

    rows = [(f"c{i}", 2, "prose", "Plot") for i in range(10)] + [("i0", 1, "infobox", ""), ("i1", 1, "infobox", ""), ("n0", 3, "prose", "Notes")]
    chunks_, manual = str(tmp_path / "chunks.parquet"), str(tmp_path / "labels.parquet")
    spark.createDataFrame(rows, "chunk_id string, book_level int, chunk_type string, section_heading string").write.parquet(chunks_)
    spark.createDataFrame([(r[0], "2", 1.0, "2026-01-01") for r in rows], tables.MANUAL_LABELS).write.parquet(manual)
    assert cli.main(["validate", "--input", chunks_, "--labels", manual]) == 0
    assert "passed: True" in capsys.readouterr().out  # 10 of 13 right, 10 of 10 of the refined ones


def test_cli_explore_reports_all_templates(spark, tmp_path):
    from corpusmill import cli

    spark.createDataFrame([(1, 0, "Mill", 1, None, words(30) + "".join(f"{{{{form {i}}}}}" for i in range(250)), None)], tables.PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert cli.main(["explore", "--input", str(tmp_path / "pages.parquet"), "--output", str(tmp_path / "report.md")]) == 0
    assert sum(line.startswith("| form ") for line in (tmp_path / "report.md").read_text().splitlines()) == 250
