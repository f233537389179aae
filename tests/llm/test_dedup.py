"""Near-duplicates against brute force."""

import random
from itertools import combinations

import numpy as np

from melder.llm import minhash_dedup as M
from melder.llm.components import components


def brute(rows, width, percent):
    sets = {i: set(M.shingle_set(t, width).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(n=150, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.choice([0, 1, 3, 5, 60, 200]))]
        if out and r.random() < 0.6:
            t = out[r.randrange(len(out))].split(" ")
            for _ in range(r.randrange(4)):
                t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t))
    return [(i * 3, t.upper() if i % 9 == 0 else t) for i, t in enumerate(out)]


def test_equals_brute_force(frame):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(frame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == brute(rows, 4, 80)


def test_equals_brute_force_when_nodes_branch_and_groups_are_cut(frame, monkeypatch):
    monkeypatch.setattr(M, "LEAF", 4)
    monkeypatch.setattr(M, "BLOCK_ITEMS", 700)
    rows = corpus(90, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(frame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == brute(rows, 4, 80)


def test_reached_equals_brute_force():
    r = np.random.default_rng(5)
    for _ in range(20):
        base = r.integers(0, 400, 60).astype(np.uint64)
        sets = [np.unique(np.where(r.random(60) < r.choice([0.02, 0.1, 0.6]), r.integers(0, 400, 60), base).astype(np.uint64)) for _ in range(30)]
        for side in (np.full(30, -1), np.arange(30) % 2):
            root = M._reached(sets, side, 80)
            up = list(range(30))
            for a, b in combinations(range(30), 2):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and (side[a] != side[b] or side[a] < 0):
                    old, new = up[b], up[a]
                    up = [new if x == old else x for x in up]
            assert all((root[a] == root[b]) == (up[a] == up[b]) for a, b in combinations(range(30), 2))


def near_copies(n, seed):
    """n texts that differ from a common one in one word each: all pairs are linked."""
    r = random.Random(seed)
    base = [f"v{r.randrange(500)}" for _ in range(120)]
    return [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i, k in ((i, r.randrange(120)) for i in range(n))]


def test_nodes_that_stay_large_are_hung_in_stars(frame, monkeypatch):
    monkeypatch.setattr(M, "LEAF", 6)
    rows = list(enumerate(near_copies(60, 3) + [f"other text {i} of its own words {i * 7}" for i in range(20)]))
    assert M._leaves(frame([(i, M.signature(M.shingle_set(t, 4)).tobytes()) for i, t in rows], "rep long, sig binary"))[1] is not None
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(frame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == brute(rows, 4, 80)


def test_recall_where_nodes_branch(monkeypatch, frame):
    """Pairs close to the threshold, all of whose nodes branch to the last depth."""
    monkeypatch.setattr(M, "LEAF", 1)
    r = np.random.default_rng(9)
    sets = []
    for _ in range(150):
        s = r.integers(0, 2**63, 180).astype(np.uint64)
        sets += [np.sort(s[:162]), np.sort(s[18:])]  # 144 of 180 in common
    stars = M._stars(frame([(i, M.signature(s).tobytes()) for i, s in enumerate(sets)], "rep long, sig binary"), 0.5).collect()
    found = {(min(x), max(x)) for x in stars}
    assert np.mean([(2 * i, 2 * i + 1) in found for i in range(150)]) >= 0.98


def test_keep_one_loses_no_text_of_a_repeated_id(frame, monkeypatch):
    a, b = near_copies(2, 1)
    rows = [(4, a, 1), (4, "quite another text with words of its own", 2), (4, "quite another text with words of its own", 2), (7, b, 3), (8, "a third text that is like no other here", 4), (None, a, 5)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in M.keep_one(frame(rows, "doc_id long, text string, id int")).collect())
    assert kept == sorted([(0, a), (4, a), (4, rows[1][1]), (8, rows[4][1])])
    once = frame([(i, t) for i, t in enumerate(near_copies(5, 2) + [f"text {i} with words of its own {i}" for i in range(30)])], "doc_id long, text string")
    want = sorted(map(tuple, M.keep_one(once).collect()))
    assert len(want) == 31
    monkeypatch.setattr(M, "BROADCAST_IDS", 0)  # the rows that may go are found by a filter and joined
    assert sorted(map(tuple, M.keep_one(once).collect())) == want
    assert M.keep_one(frame([], "doc_id long, text string")).count() == 0


def test_nulls_repeats_and_extra_columns(frame):
    long = " ".join(f"x{i}" for i in range(300_000))
    rows = [(None, "a b c d e", "q"), (1, None, "q"), (2, "", None), (3, " \t\n", "q"), (4, "a b c d e", "q"), (4, "a b c d e", "q"), (5, long, "q"), (6, long, "q")]
    got = M.near_duplicates(frame(rows, "doc_id long, text string, sig string"), 4).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in got) == sorted([(0, 2, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True), (5, 299_997, 5, True), (6, 299_997, 5, False)])
    kept = M.keep_one(frame(rows, "doc_id long, text string, sig string")).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 3, 4, 5] and set(kept[0].asDict()) == {"doc_id", "text", "sig"}


def test_empty(frame):
    assert M.near_duplicates(frame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(frame):
    r = random.Random(3)
    names = r.sample(range(1000), 60)
    edges = [(a, b) for a, b in zip(names[:40], names[1:40], strict=False)] + [(a, b) for a, b in zip(names[40:], names[41:], strict=False)]
    got = {x["id"]: x["component"] for x in components(frame(edges, "a long, b long")).collect()}
    assert got == {n: min(names[:40]) for n in names[:40]} | {n: min(names[40:]) for n in names[40:]}


def test_labels():
    assert M._labels(6, np.array([5, 1]), np.array([3, 5])).tolist() == [0, 1, 2, 1, 4, 1]
