"""The stages that ask a wiki, a model or a person."""

import json

import pytest

from corpusmill import cli
from corpusmill.sources import tables


def get(url, params):
    """A wiki of two pages and a redirect."""
    texts = {1: "The mill of [[Old reed]]. " + "word " * 30, 2: "Reed of [[Mill]]. " + "word " * 30}
    if params.get("list") == "allpages":
        return 200, {}, {"query": {"allpages": [{"pageid": i} for i in texts] if params["apnamespace"] == 0 else []}}
    if params.get("prop") == "revisions":
        pages = [{"pageid": i, "ns": 0, "title": "Mill" if i == 1 else "Reed", "revisions": [{"revid": i, "timestamp": "2026-01-01T00:00:00Z", "slots": {"main": {"content": texts[i]}}}]} for i in map(int, params["pageids"].split("|"))]
        return 200, {}, {"query": {"pages": pages}}
    if params.get("prop") == "categories":
        return 200, {}, {"query": {"pages": [{"pageid": i, "categories": [{"title": "Category:First tale"}]} for i in map(int, params["pageids"].split("|"))]}}
    return 200, {}, {"query": {"redirects": [{"from": "Old reed", "to": "Reed"}]}}


def labeller():
    return lambda prompt: {"book_level_raw": 2, "confidence": "low" if "eed" in prompt else "high", "rationale": "r", "input_tokens": 10, "cached_tokens": 0, "output_tokens": 2}


def asker():
    return lambda prompt: {"question": f"Who is {prompt[6:10]}?", "input_tokens": 10, "cached_tokens": 0, "output_tokens": 2}


def candidates():
    count = lambda: lambda texts: ([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], len(texts))
    return {"letters": (count, 100, ""), "asked": (count, 32, "query: ")}


def test_stages_from_the_wiki_to_the_comparison(spark, tmp_path, capsys, monkeypatch):
    at = lambda name: str(tmp_path / name)
    here = "tests.test_cli:"
    run = lambda *a: cli.main(list(a))
    assert run("fetch", "--url", "https://w.example/api", "--client", here + "get", "--output", at("pages.parquet"), "--categories") == 1  # a wiki without chapters fails the checks
    assert spark.read.parquet(at("pages.parquet")).count() == 2
    assert run("fetch", "--url", "https://w.example/api", "--client", here + "get", "--output", at("one.parquet"), "--limit", "1") == 0
    assert spark.read.parquet(at("one.parquet")).count() == 1
    assert run("redirects", "--url", "https://w.example/api", "--client", here + "get", "--input", at("pages.parquet"), "--output", at("redirects.json")) == 0
    assert json.loads((tmp_path / "redirects.json").read_text()) == {"Old reed": "Reed"}
    assert run("chunk", "--input", at("pages.parquet"), "--output", at("chunks.parquet")) == 0
    assert run("graph", "--input", at("pages.parquet"), "--chunks", at("chunks.parquet"), "--redirects", at("redirects.json"), "--output", at("links.parquet"), "--spot-check", "5") == 0
    assert spark.read.parquet(at("links.parquet")).count() == 2
    (tmp_path / "books.json").write_text(json.dumps({"one": ["(?i)first tale"]}))
    assert run("audit", "--input", at("pages.parquet"), "--config", at("books.json"), "--output", at("audit.md")) == 0
    assert "| category | 2 |" in (tmp_path / "audit.md").read_text()

    assert run("label", "--input", at("chunks.parquet"), "--output", at("labeled.parquet"), "--dry-run") == 0 and not (tmp_path / "labeled.parquet").exists()
    with pytest.raises(tables.InputError):
        run("label", "--input", at("chunks.parquet"), "--output", at("labeled.parquet"))
    assert run("label", "--input", at("chunks.parquet"), "--output", at("labeled.parquet"), "--client", here + "labeller") == 0
    assert {r.book_level for r in spark.read.parquet(at("labeled.parquet")).collect()} == {3}  # both prompts name the reed, so confidence is low
    assert json.loads((tmp_path / "labeled.parquet.manifest.json").read_text())["input_tokens"] == 20

    assert run("questions", "--input", at("labeled.parquet"), "--output", at("questions.jsonl"), "--dry-run") == 0
    assert run("questions", "--input", at("labeled.parquet"), "--output", at("questions.jsonl"), "--client", here + "asker") == 0
    assert run("bakeoff", "--chunks", at("labeled.parquet"), "--input", at("questions.jsonl"), "--output", at("bakeoff.md"), "--dry-run") == 0
    assert run("bakeoff", "--chunks", at("labeled.parquet"), "--input", at("questions.jsonl"), "--output", at("bakeoff.md"), "--client", here + "candidates") == 0
    assert "| letters | 2 |" in (tmp_path / "bakeoff.md").read_text() and len(json.loads((tmp_path / "bakeoff.md.json").read_text())) == 6

    ids = [r.chunk_id for r in spark.read.parquet(at("chunks.parquet")).collect()]
    spark.createDataFrame([(i, "random", None) for i in ids], tables.SAMPLE).write.parquet(at("sample.parquet"))
    said = iter(["2", "q", "u"])
    monkeypatch.setattr("builtins.input", lambda prompt="": next(said))
    for _ in range(2):  # the second session takes up the first
        assert run("label-manually", "--input", at("chunks.parquet"), "--labels", at("sample.parquet"), "--output", at("manual.jsonl")) == 0
    assert sorted(json.loads(x)["manual_book_level"] for x in (tmp_path / "manual.jsonl").read_text().splitlines()) == ["2", "u"]
