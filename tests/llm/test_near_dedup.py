import random
import re

import numpy as np
import pytest

from rillwave.llm import near_dedup
from rillwave.llm import shingles as shingles_module
from rillwave.llm.components import components
from rillwave.llm.shingles import shingle_set


def shingles(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_force(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    ids, parent = sorted(sets), {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed, groups, copies, edits):
    """Groups of copies with random word changes, chains of copies of copies, and loners."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, int(len(text) * edits)))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
            if rng.random() < 0.3:
                base = text
    return rows


def check(spark, rows, k, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, shingle=k, **options).collect()}
    want = brute_force(rows, k)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_matches_brute_force(spark):
    check(spark, corpus(1, 60, 8, 0.06), 2)


def test_large_groups_go_through_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 8)
    monkeypatch.setattr(near_dedup, "PIVOT_TURNS", 1)
    monkeypatch.setattr(near_dedup, "DENSE", 500)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(0, 12)):
            text[rng.randrange(100)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    check(spark, rows, 2)


def pairs_at_the_threshold(n):
    """Pairs of texts whose sets of two-word shingles have exactly 80 of 100 members in common."""
    rng, rows = random.Random(11), []
    for i in range(n):
        common = [f"p{i}w{k}" for k in range(81)]  # 80 shingles in common, 10 more on either side
        rows += [(2 * i, " ".join(common + [f"p{i}a{k}" for k in range(10)])), (2 * i + 1, " ".join(common + [f"p{i}b{k}" for k in range(10)]))]
    one, two = (shingles(t, 2) for _, t in rows[:2])
    assert (len(one & two), len(one | two)) == (80, 100)
    rng.shuffle(rows)
    return rows


def test_pairs_at_the_threshold_are_found(spark):
    check(spark, pairs_at_the_threshold(300), 2)


def test_exact_mode_does_not_depend_on_signatures(spark):
    check(spark, pairs_at_the_threshold(40) + [(1000 + i, t) for i, t in corpus(5, 15, 6, 0.06)], 2, coordinates=8, matches=8, exact=True)
    check(spark, [(1, "only one text of some words")], 2, exact=True)


def test_edges(edge_docs, no_docs):
    got = {}
    for r in near_dedup.near_duplicates(edge_docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(1, 4, True)] and got[8] == [(1, 8, True)]
    assert got[5] == [(1, 5, True)] and got[6] == [(1, 5, False)] * 2 and got[7] == [(1, 5, False)]
    assert got[None] == [(3, None, True)]
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 180)] + [(300, 300), (401, 400), (400, 401)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in [*range(100, 180), 200]} == {100} and got[401] == 400 and 300 not in got


@pytest.mark.parametrize("order", ["up", "down", "shuffled"])
def test_long_chains_take_few_turns(spark, order):
    ids = list(range(1000))
    {"up": lambda: None, "down": ids.reverse, "shuffled": lambda: random.Random(2).shuffle(ids)}[order]()
    turns = []
    got = components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"), turns).collect()
    assert len(turns) <= 12 and len(got) == 1000 and {r["comp"] for r in got} == {0}


def test_long_texts_hash_alike_in_slices(monkeypatch):
    text = ("one TWO\tthree " * 50 + "x" * 300 + " four").encode()
    whole = shingle_set(text, 3)
    monkeypatch.setattr(shingles_module, "SLICE", 7)
    assert np.array_equal(whole, shingle_set(text, 3))


def test_shingle_hashes_agree_with_words():
    for text in ["", " ", "One two\tTWO  one two three", "ÄB äb Äb", "a b a b a b"]:
        assert len(shingle_set(text.encode(), 2)) == len(shingles(text, 2))
    assert np.array_equal(shingle_set(b"A b  C", 2), shingle_set(b"a B c", 2))
