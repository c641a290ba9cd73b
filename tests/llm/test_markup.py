"""The block labeller on held-out forms, what it decides, and clean text."""

import random

import pytest

from corpusmill.llm import markup

LONG = "word " * 30_000
WORDS = "river stone bell mill reed harbor kiln widow garden ledger tide fever song gate ferry quarry lantern oath".split()


def plain_texts(rng, n):
    words = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 9)))
    return [" ".join(f"The {words()}." for _ in range(rng.randint(1, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def net():
    return markup.train(plain_texts(random.Random(1), 200), made=3000)


def test_labeller_on_held_out_forms(net):
    """Planted residue of forms that aren't in the fitting list, in texts of which none was fitted, and texts with signs that aren't markup."""
    rng = random.Random(2)
    forms = ["&hellip;", "&#8212;", "<kbd>{0}</kbd>", "<s>{0}</s>", "\\textsc{{{0}}}", "\\mathrm{{{0}}}", "{{{{DISPLAYTITLE:{0}}}}}", "[[:Category:{0}]]", "[[{0}#{1}|{1}]]", "'''''{0}'''''", "<gallery>", "</blockquote>", "\n#### {0}\n", "\n====== {0} ======\n", "\\footnote{{{0} {1}}}", "{{{{{0}|{1}|3}}}}", "<!--{0}-->"]
    signs = ["({0}; 12)", "[{1} {0}]", "{0} = 7", "9 / 3", "{0}: 5 * 4", "~{0}", "D:\\{0}", "{0}#4", "<- {0}", "{0}_{1}", "5 > 4", "'{0}'", "\n- {0}\n", "\n3. {0}\n"]
    held = []
    for texts, inserts, marked in ((plain_texts(rng, 360), forms, True), (plain_texts(rng, 280), signs, False), (plain_texts(rng, 200), [""], False)):
        for k, text in enumerate(texts):
            parts = text.split(" ")
            parts.insert(rng.randint(0, len(parts)), inserts[k % len(inserts)].format(rng.choice(WORDS), rng.choice(WORDS)))
            held.append((" ".join(parts), marked))
    labels = net.label([[markup.block_features(p, b) for p, b in markup.leaf_blocks(t)] for t, _ in held])
    found = [p.max() >= markup.RESIDUE for _, p in labels]
    hits = sum(f and m for f, (_, m) in zip(found, held))
    assert hits >= 0.9 * sum(m for _, m in held), [t for f, (t, m) in zip(found, held) if m and not f][:10]
    assert hits >= 0.9 * sum(found), [t for f, (t, m) in zip(found, held) if f and not m][:10]


def test_the_network_decides(spark, net):
    """Another network gives other rows: the grammar has no say once the network is fitted."""
    df = spark.createDataFrame([(1, "a [[mill|x]] b"), (2, "a plain mill")], "id int, t string")
    assert {r.id for r in markup.residue_blocks(df, "id", "t", net).collect()} == {1}
    never = markup.BlockLabeller()
    never.p = {k: v.copy() for k, v in net.p.items()}
    never.p["bo"][-1] = -100
    assert markup.residue_blocks(df, "id", "t", never).count() == 0


def test_network_is_saved_and_loaded(net, tmp_path):
    markup.save(net, str(tmp_path / "net.npz"))
    again = markup.load(str(tmp_path / "net.npz"))
    assert all((again.p[k] == v).all() for k, v in net.p.items())


def test_blocks_cover_a_text_and_finds_reach_over_them():
    text = "The mill stood. " * 30 + "It was **old. And so it " + "stayed by the river. " * 30 + "was kept** there, 5 . > 3 and . # 5 and . | total = 4."
    lines = markup.leaf_lines(text)
    assert "".join(b for _, _, b, _ in lines) == text and all(text[s : s + len(b)] == b for _, _, b, s in lines) and len(lines) > 2
    found = markup.block_residue(text, lines)
    opened, closed = (next(k for k, (_, _, b, s) in enumerate(lines) if s <= text.index(m) < s + len(b)) for m in ("**old", "kept**"))
    assert found == [1.0 if opened <= k <= closed else 0.0 for k in range(len(lines))]
    assert markup.markup_in("a \\[" + "x + " * 100 + "y\\]") and markup.markup_in("was there, 5 . > 3 and . # 5 and . | total = 4.") is None
    deep = "{{a|\n" * 40 + "x\n" + "}}\n" * 40 + "y"
    assert [p for _, p, b, _ in markup.leaf_lines(deep) if b in "xy"] == ["template", ""]
    assert "".join(b for _, _, b, _ in markup.leaf_lines("y" * 5000)) == "y" * 5000


@pytest.mark.parametrize("text,marked", [("a '''bold''' word", True), ("[[Mill|the mill", True), ("x &nbsp; y", True), ('<span style="font-si', True), ("\\emph{x}", True), ("**x y**", True), ("| a | b |\n|---|---|", True), ("|name = 5", True), ("[3] and [sic] and {unclear}", False), ("left | right 2 + 3 = 5", False), ("5 * 3 * 2 and *one, roughly", False), ("C:\\mill\\item", False), ("- plain\n2. list", False), ("'tis so-called 'mill'", False), ("3 < 7 > 2 <3", False), ("#12 No", False), ("$4 or $6", False), ("a_b_c __ x", False)])
def test_markup_grammar(text, marked):
    assert (markup.markup_in(text) is not None) == marked


def test_clean_text_keeps_structure(net):
    text = "{{stub}}\nThe '''old''' [[Mill|mill]].<ref>x</ref>\n\n== Notes ==\n* one\n* two\n\n<syntaxhighlight lang=\"text\">\nif a > 4: b()\n</syntaxhighlight>\n<math>\\frac{1}{2}</math>\n{{quote|Said so.|Ana}}\n{|\n! a !! b\n|-\n| 1 || 2\n|}\n[[Category:X]]"
    clean = markup.clean_batch(net, [text, "", "plain"])[0]
    assert clean[1:] == ["", "plain"]
    for part in ("The old mill.", "## Notes", "- one\n- two", "```\nif a > 4: b()\n```", "$$\\frac{1}{2}$$", "Said so.\n— Ana", "a; b\n1; 2"):
        assert part in clean[0], (part, clean[0])
    assert "Category" not in clean[0] and "stub" not in clean[0] and "<ref" not in clean[0]


def test_residue_blocks_defined_cases(spark, net):
    df = spark.createDataFrame([("a", None, "x"), ("b", "", "x"), ("c", "plain words here", "x"), ("d", "a [[mill|x]] b", "x"), ("d", "a [[mill|x]] b", "x"), ("e", LONG + "<b>", "x")], "id string, t string, blocks string")
    assert sorted(r.id for r in markup.residue_blocks(df, "id", "t", net).collect()) == ["d", "d", "e"]
    assert {r.id for r in markup.residue_blocks(df, "id", "t").collect()} == {"d", "e"}  # fitted on the few texts of the table
    assert markup.residue_blocks(df.limit(0), "id", "t").count() == 0
