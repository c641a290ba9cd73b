"""Operators of the llm subpackage against brute-force versions, round trips and held-out accuracy, and their defined cases."""

import itertools
import random
import re
from collections import Counter

import pytest

from corpusmill.llm import bpe, cooccurrence, neardup, packing, sampling, splitting

LONG = "word " * 30_000


# --- pair counts


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BLOCK", 8)  # so that large records are cut into blocks
    rng = random.Random(3)
    rows = [(f"r{rng.randrange(40)}", rng.choice([1, 1, rng.randrange(30), -5, None]), "x") for _ in range(1500)] + [(None, 3, "x"), ("lonely", None, "x")]
    sets: dict = {}
    for r, i, _ in rows:
        if r is not None:
            sets.setdefault(r, set()).update([] if i is None else [i])
    n = Counter(i for s in sets.values() for i in s)
    both = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    for least, lift in ((1, 0.0), (5, 1.3)):
        want = {(a, b, k) for (a, b), k in both.items() if k >= least and k * len(sets) >= lift * n[a] * n[b]}
        got = cooccurrence.item_pairs(spark.createDataFrame(rows, "record string, item long, item_a string"), "record", "item", least, lift)
        assert {(r.item_a, r.item_b, r.shared) for r in got.collect()} == want
    row = got.first()
    s, a, b, t = row.shared, row.n_a, row.n_b, row.n_records
    assert row.odds_ratio == pytest.approx((s + 0.5) * (t - a - b + s + 0.5) / ((a - s + 0.5) * (b - s + 0.5)))


def test_pairs_of_strings_and_empty(spark):
    df = spark.createDataFrame([("r", "b"), ("r", "a"), ("q", "a")], "record string, item string")
    assert [(r.item_a, r.item_b, r.shared) for r in cooccurrence.item_pairs(df, "record", "item").collect()] == [("a", "b", 1)]
    assert cooccurrence.item_pairs(df.limit(0), "record", "item").count() == 0


# --- near duplicates


def test_similar_records_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)  # so that large groups are cut into pairs of blocks
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(40)] for _ in range(6)]
    texts = [(None, None), ("n", None), ("e", ""), ("t", "one two"), ("u", "one two three"), ("v", "One, TWO... three!")]
    for k in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        texts.append((f"d{k:02}", " ".join(words)))
    texts += texts[10:20] + [(f"c{k}", texts[12][1]) for k in range(4)]

    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets = {k: g for k, t in texts if k is not None and (g := grams(t))}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(texts, "id string, body string")
    got = [(r.key_a, r.key_b) for r in neardup.similar_records(df, "id", "body", 3, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == want

    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in want:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {r.key: r.group_key for r in neardup.similar_groups(df, "id", "body", 3, 0.6).collect()}
    assert groups == {k: root(k) for k in sets}


def test_similar_records_of_nothing(spark):
    assert neardup.similar_records(spark.createDataFrame([], "id string, body string"), "id", "body").count() == 0


# --- splitting


@pytest.mark.parametrize("most,overlap", [(380, 40), (20, 5)])
def test_pieces_are_spans_within_the_limit(most, overlap):
    rng = random.Random(6)
    for n in (0, 1, most, most + 1, 3 * most, 5000):
        text = "".join(rng.choice(["word", "été", "x.", "end!"]) + rng.choice([" ", " ", "\n", "\n\n", " ", "\t"]) for _ in range(n))
        got = splitting.pieces(text, most, overlap)
        words = text.split()
        assert (len(got) > 1) == (n > most)
        fresh = []
        for k, (a, b, count, again) in enumerate(got):
            own = text[a:b].split()
            assert len(own) == count <= most
            assert again == (min(overlap, len(fresh)) if k else 0)
            assert own[:again] == fresh[len(fresh) - again :]
            fresh += own[again:]
        assert fresh == words


def test_cuts_are_natural_and_local():
    rng = random.Random(7)
    sentences = [" ".join(f"w{rng.randrange(900)}" for _ in range(12)) + "." for _ in range(300)]
    before = [p[:2] for p in splitting.pieces(" ".join(sentences))]
    edited = ["An inserted sentence.", *sentences]
    shift = len("An inserted sentence. ")
    after = [p[:2] for p in splitting.pieces(" ".join(edited))]
    assert all(" ".join(sentences)[b - 1] == "." for _, b in before)
    assert len({(a + shift, b + shift) for a, b in before} & set(after)) >= len(before) // 2


def test_split_texts_defined_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "one", "x"), (5, LONG, "x"), (6, "y" * 100_000, "x")], "id long, t string, piece_no string")
    rows = splitting.split_texts(df.select("id", "t"), ["id"], "t").collect()
    assert {r.id for r in rows} == {4, 5, 6} and max(r.n_words for r in rows) == 380
    assert {r.id for r in splitting.split_texts(df, ["id"], "t", oversized_only=True).collect()} == {5}


# --- proportional samples


def test_sample_quotas_and_report(spark):
    rows = [(f"k{i}", 1, "Prose " if i % 2 else "prose") for i in range(600)] + [(f"q{i}", 2, "quote") for i in range(7)] + [("odd", None, None), (None, 1, "prose")]
    df = spark.createDataFrame(rows + rows[:50], "id string, level int, kind string")
    targets = spark.createDataFrame([(1, "prose", 900, 5), (2, "quote", 100, 20), (3, "infobox", 0, 2), (None, "x", 1, 1)], "book_level int, chunk_type string, target_permille int, min_rows int")
    args = (df, targets, "id", "level", "kind")
    report = {(r.level, r.kind): (r.available, r.needed, r.drawn, r.shortfall) for r in sampling.quota_report(*args).collect()}
    assert report == {(1, "prose"): (600, 54, 54, 0), (2, "quote"): (7, 20, 7, 13), (3, "infobox"): (0, 2, 0, 2)}
    drawn = sampling.draw(*args).collect()
    assert len(drawn) == len({r.k for r in drawn}) == 61 and Counter(r.kind for r in drawn) == {"prose": 54, "quote": 7}
    assert {r.k for r in drawn} == {r.k for r in sampling.draw(*args).collect()}
    assert sampling.draw(df.limit(0), *args[1:]).count() == 0
    assert {(r.needed, r.drawn) for r in sampling.quota_report(df.limit(0), *args[1:]).collect()} == {(5, 0), (20, 0), (2, 0)}


def test_reservoirs_merge_and_are_trimmed(spark, monkeypatch):
    """The sample is that of one reservoir over all rows, however many tasks there are and however often they trim."""
    import hashlib

    monkeypatch.setattr(sampling, "HELD", 40)
    rows = [(f"k{i}", i % 3, "a") for i in range(900)]
    targets = spark.createDataFrame([(0, "a", 300, 0), (1, "A ", 200, 40), (2, "a", 500, 0)], "book_level int, chunk_type string, target_permille int, min_rows int")
    want = {k for level, n in ((0, 27), (1, 40), (2, 45)) for k in sorted((k for k, x, _ in rows if x == level), key=lambda k: hashlib.md5(f"sample:{k}".encode()).hexdigest())[:n]}
    for tasks in (1, 7):
        df = spark.createDataFrame(rows, "id string, level int, kind string").repartition(tasks)
        assert {r.k for r in sampling.draw(df, targets, "id", "level", "kind").collect()} == want


# --- tokens and containers


def test_ids_equal_the_public_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    enc = bpe.encoder()
    rng = random.Random(8)
    texts = ["", " ", "a", "don't WE'LL", "<|endoftext|>", "\r\n\t x\u00a0y\u2003z\u200b", "naïve été ﬁn ½ 𝔗𝔥 🙂👍🏽👩‍👧", "織り手は冬の初めに", "Мельник запер", "x" * 9000, " " * 5000, LONG]
    texts += ["".join(rng.choice("aaabcdef ghi  \n\t'.,!é日本🙂0123\x1c\x85") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    for text in texts:
        assert enc.encode(text) == t.encode(text, add_special_tokens=False).ids
    assert enc.encode(None) == []


def test_encode_documents_keeps_every_row(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x")], "doc_id long, text string, ids string")
    rows = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_documents(df, "doc_id", "text").collect())
    assert rows == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert bpe.encode_documents(df.limit(0), "doc_id", "text").count() == 0


def test_hilbert_neighbours_touch():
    import numpy as np

    side = 1 << 2
    cells = np.array(list(itertools.product(range(side), repeat=3)))
    walk = cells[np.argsort(packing.hilbert_key(cells, 2))]
    assert sorted(packing.hilbert_key(cells, 2)) == list(range(side**3))
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_containers_hold_everything_and_waste_little(spark):
    rng = random.Random(9)
    docs = [(i, "stone river " * rng.choice([1, 5, 60, 300]), "x") for i in range(400)] + [(900, None, "x"), (901, "", "x"), (0, "stone", "x")][:2]
    items = packing.measure(spark.createDataFrame(docs, "doc_id long, text string, item string"), "doc_id", "text")
    rows = packing.pack(items, [("small", 64), ("none", None), ("zero", 0), ("wide", 512)], range_tokens=20_000).collect()
    sizes = {r.item: r.tokens for r in items.collect()}
    for name, capacity in (("small", 64), ("wide", 512)):
        mine = [r for r in rows if r.container_name == name]
        total = Counter()
        whole = Counter()
        for r in mine:
            total[r.container_id] += r.n_tokens
            whole[r.item] += r.n_tokens
        assert max(total.values()) <= capacity and whole == Counter(sizes) and set(whole) == set(sizes)
        assert all(sum(r.item == i for r in mine) == 1 for i, n in list(sizes.items())[:50] if n <= capacity)
        assert len(total) <= 1.05 * sum(sizes.values()) / capacity + 12
    assert {r.container_name for r in rows} == {"small", "wide"}
