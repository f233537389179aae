"""Tokens as the tokenizer gives them, sequences without gaps, few of them."""

import random
import zlib

import numpy as np
import pytest

from melder.llm import packing as P
from melder.llm.queries import tokenizer


@pytest.fixture(scope="module")
def words():
    return P.Words(tokenizer())


def test_ids_are_the_tokenizers(words):
    r = random.Random(5)
    letters = [chr(c) for c in range(1, 0x250)] + list("̀́Σςİﬁ 　中가😀Ⅰ½՘​")
    texts = ["", " ", "Hello, world's <|endoftext|> x", "I'm they'LL"] + ["".join(r.choice(letters) if r.random() < 0.6 else r.choice(" '\n.aS") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    assert words.encode(texts) == [words._whole(t) for t in texts]


def check(rows, texts, words, length):
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["piece"]), []).append(r)
    for i, t in texts:
        ids = np.append(np.array(words.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4"), np.uint32(0)).astype("<u4")
        for k, at in enumerate(range(0, len(ids), length)):
            r = by_doc[(i, k)].pop()
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(ids[at : at + length]), zlib.crc32(ids[at : at + length].tobytes()))
    assert not any(by_doc.values())
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values(), default=0) <= length
    return ends


def test_pack(frame, words):
    r = random.Random(2)
    texts = [(i, " ".join(r.choice(["alpha", "beta", "x9!", "été"]) for _ in range(r.choice([0, 3, 40, 90, 700])))) for i in range(200)] + [(None, "a b"), (1005, None), (1005, None)]
    rows = P.pack(frame(texts, "doc_id long, text string"), tokenizer(), 64).collect()
    ends = check(rows, texts, words, 64)
    total = sum(x["length"] for x in rows)
    assert len(ends) <= total / 64 * 1.02 + 2
    assert P.pack(frame([], "doc_id long, text string"), tokenizer()).count() == 0


def test_sequences_hold_the_ids(frame, words):
    texts = [(1, "one two three"), (2, "four five"), (3, "six")]
    got = P.sequences(frame(texts, "doc_id long, text string"), tokenizer(), 8).collect()
    whole = sorted(x for r in got for x in r["ids"])
    assert whole == sorted(i for _, t in texts for i in [*words.tokenizer.encode(t, add_special_tokens=False).ids, 0])


def test_place_never_overfills():
    r = random.Random(4)
    for _ in range(30):
        sizes = np.array([r.randint(1, 100) for _ in range(r.randint(0, 120))], dtype=np.int64)
        where, offset = P.place(sizes, 100)
        for b in set(where.tolist()):
            at = 0
            for k in np.flatnonzero(where == b):
                assert offset[k] == at
                at += sizes[k]
            assert at <= 100


def _least(sizes, length, spare):
    """Each item goes where the sum of squared counts of open bins by gap is smallest, by trying all."""
    gaps, where, offset = [], [], []
    for x in sizes:
        options = [g for g in range(len(gaps)) if gaps[g] >= x]
        if not options or not spare:
            options.append(len(gaps))

        def total(b):
            after = [*gaps, length] if b == len(gaps) else list(gaps)
            after[b] -= x
            open_ = [g for g in after if g]
            return sum(open_.count(g) ** 2 for g in set(open_)), b == len(gaps), after[b]

        best = min(options, key=total)
        if best == len(gaps):
            gaps.append(length)
        where.append(best)
        offset.append(length - gaps[best])
        gaps[best] -= x
    return where, offset, sorted(gaps)


@pytest.mark.parametrize("spare", [False, True])
def test_each_choice_is_the_least_sum_of_squares(spare):
    r = random.Random(6)
    for _ in range(40):
        sizes = [r.randint(1, 12) for _ in range(r.randint(1, 40))]
        where, offset = P.place(np.array(sizes, dtype=np.int64), 12, spare)
        _, want, gaps = _least(sizes, 12, spare)
        assert offset.tolist() == want  # bins of an equal gap are alike
        filled = np.bincount(where, weights=sizes).astype(int)
        assert sorted(12 - filled) == gaps


def test_long_texts_clashing_columns_and_repeats(frame, words):
    long = "alpha beta " * 60_000
    texts = [(1, long), (2, "a"), (2, "a"), (2, "b"), (None, "c"), (None, "c")]
    docs = frame([(*t, 5, 6) for t in texts], "doc_id long, text string, piece int, sequence_id int")
    rows = P.pack(docs, tokenizer()).collect()
    assert sum(x["length"] for x in rows if x["doc_id"] == 1) == len(words.tokenizer.encode(long, add_special_tokens=False).ids) + 1
    assert len(rows) == 5 + sum(x["doc_id"] == 1 for x in rows)
    got = P.sequences(docs, tokenizer()).collect()
    assert sorted(i or 0 for x in got for i in x["doc_ids"] if i != 1) == [0, 0, 2, 2, 2]
    assert sum(len(x["ids"]) for x in got) == sum(x["length"] for x in rows)


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    w = P.Words(public_tokenizers.path("byte_bpe_50k.json"))
    assert not w.cuts and P.Words(tokenizer()).cuts
    assert w.encode(["Hello  World"]) == [w._whole("Hello  World")]


@pytest.mark.parametrize("seed", range(6))
def test_further_rounds_keep_sequences_sound(seed):
    r = np.random.default_rng(seed)
    sizes = np.sort(r.integers(1, 101, size=r.integers(0, 400)))[::-1].copy()
    if len(sizes):
        where, offset = P.place_again(sizes, 100)
        assert where.max() <= P.place(sizes, 100)[0].max()
        assert sorted(set(where)) == list(range(where.max() + 1))
        for b in range(where.max() + 1):
            inside = sorted((o, s) for o, s, w in zip(offset, sizes, where, strict=True) if w == b)
            assert all(o == sum(s for _, s in inside[:i]) for i, (o, _) in enumerate(inside)) and sum(s for _, s in inside) <= 100


def test_rows_alike_are_dealt_over_groups(spark, frame, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 50)
    from melder.llm.queries import tokenizer

    done = P.pack(frame([(1, "the same words")] * 400, "doc_id long, text string"), tokenizer())
    assert done.count() == 400 and done.selectExpr("shiftright(sequence_id, 32)").distinct().count() > 4
