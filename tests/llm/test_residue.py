"""The passage classifier on held-out forms, what it decides, and the grammar that labels its fitting sample."""

import random

import pytest

from corpusmill.llm import residue

LONG = "word " * 30_000
NOUNS = "river stone bell mill reed harbor kiln widow garden ledger tide fever song gate quarry lantern oath".split()
PLAIN = ["When the ferry copied the quarry, a tavern was inherited once more.", "It is tied to [[Rechipago|the scholar]].{{ref|TAC|3}}", "2 + 3 = 5, C:\\mill\\wheel, a/b/c, [sic], 80%, ~ 5 leagues, x^2.", "The inscription reads [...] and then nothing."]
#: Articles that tell of such things; the fitting articles hold some of these forms, with other words.
TOLD = ["House {n} on the quay is said to be forbidden; nobody living there was found.", "Access to the {w} was denied to Ana for {n} days.", "The server at the {w} was too busy to take many requests.", "In the archive Ana wrote \"please enable the {w}\" on a card, a joke of the clerks.", "The author left the {w} blank in the first draft."]
CASES = ["Lorem ipsum dolor sit amet consectetur adipiscing elit.", "The mill {{{title|}}} stood by the river.", "A stair [INSERT LOFT HERE] was seen.", "Please enable JavaScript to view this page.", "404 Not Found", "TODO: write about the mill", "asdf qwer jkl asdf foo bar", "Seite nicht gefunden", "The tide %(river)s rose.", "Traceback (most recent call last):", "ページが見つかりません。", "xxxxxxxxxxxxxxxxxxxx"]
#: Forms that are in no list of the grammar and in no made record.
HELD = ["Please turn JavaScript on to see this {w}.", "You need a browser with JavaScript to view this {w}.", "The {w} could not be loaded. Try again later.", "Error: the page {w} was not loaded.", "Sorry, this page could not be found.", "403 Forbidden: you do not have permission to view {w}.", "{{{{{{ {w}_text }}}}}}", "{{{{ user.{w} }}}}", "${{{w}}}", "%({w}_name)s", "[INSERT {w} {w} HERE]", "[your {w} here]", "<%= {w} %>", "{{% if {w} %}}", "lorem dolor ipsum sit elit amet", "qwer asdf zxcv asdf qwer", "TODO: describe the {w}", "XXXX {w} XXXX", "undefined {w} of undefined", "This page has been removed."]


def articles(rng, n):
    noun = lambda: rng.choice(NOUNS)
    out = []
    for k in range(n):
        text = " ".join(f"The {noun()} of {rng.choice('ABCDE')}ana was {noun()} and old, though the {noun()} kept it for {rng.randrange(90)} years." for _ in range(rng.randint(1, 9)))
        out.append(text + ("\n" + rng.choice(TOLD).format(w=noun(), n=rng.randrange(999)) if k % 4 == 0 else "\n" + rng.choice(PLAIN) if k % 4 == 1 else ""))
    return out


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    return residue.fit(articles(rng, 1200) + [a + "\n" + rng.choice(CASES) for a in articles(rng, 60)])


def test_grammar_of_trusted_passages():
    assert [t for t in PLAIN + [x.format(w="mill", n=404) for x in TOLD] if residue.certain(t)] == []
    assert [t for t in CASES if not residue.certain(t)] == []
    assert residue.certain("[INSERT " + "x " * 200 + "]") and residue.certain("${" + "x" * 200 + "}")
    assert not residue.certain('He wrote "page not found" on it.') and residue.certain("He saw: page not found.")
    text = "The mill by the river was kept by a widow, {} and the ferry of Bana was old."
    for x in ("lorem ipsum dolor sit amet consectetur", "asdf qwer jkl asdf", "n/a n/a n/a n/a n/a", "xxxxxxxxxxxx"):
        assert residue.certain(text.format(x))


def test_classifier_on_held_out_forms(model):
    rng = random.Random(4)
    held = [(a.split("\n")[0] + "\n" + form.format(w=rng.choice(NOUNS)) if k % 2 else form.format(w=rng.choice(NOUNS)), True) for k, (a, form) in enumerate(zip(articles(rng, 400), HELD * 20))]
    held += [(t, False) for t in articles(rng, 800)]
    found = model.probabilities([t for t, _ in held]) >= residue.THRESHOLD
    hits = sum(bool(f) and y for f, (_, y) in zip(found, held))
    assert hits >= 0.9 * sum(y for _, y in held), sorted({t.split("\n")[-1][:50] for f, (t, y) in zip(found, held) if y and not f})
    assert hits >= 0.9 * found.sum(), [t for f, (t, y) in zip(found, held) if f and not y][:10]


def test_the_classifier_decides(spark, model, tmp_path):
    """Another curve gives other rows: the grammar has no say once the model is fitted. Models are saved and loaded."""
    df = spark.createDataFrame([(1, "404 Not Found"), (2, PLAIN[0])], "id int, t string")
    model.save(str(tmp_path / "model"))
    again = residue.Model.load(str(tmp_path / "model"))
    assert [r.id for r in residue.residue_documents(df, "id", "t", again).collect()] == [1]
    again.curve = again.curve * 0 - 1
    assert residue.residue_documents(df, "id", "t", again).count() == 0


def test_residue_documents_defined_cases(spark):
    rng = random.Random(5)
    docs = [(i, t, "x") for i, t in enumerate(articles(rng, 600))] + [(1000 + i, articles(rng, 1)[0] + "\n" + t, "x") for i, t in enumerate(CASES * 3)]
    docs += [(2000, None, "x"), (2001, "", "x"), (2002, " \n", "x"), (2003, LONG, "x"), docs[600], (None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, probability string")
    rows = [r.doc_id for r in residue.residue_documents(df, "doc_id", "text").collect()]
    assert len(rows) == len(set(rows)) + 1 and set(rows) == {1000 + i for i in range(3 * len(CASES))}
    assert residue.residue_documents(df.limit(0), "doc_id", "text").count() == 0
