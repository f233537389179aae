"""Spelling variants, fill-in-middle and the phrase index against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from melder.llm import fill_middle, phrase_index, queries, spelling

DOCS = "doc_id long, text string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_by_hand(rows, least=6, occurrences=5, every=199):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % every == 0 else low] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= occurrences}


def variants_by_hand(n, ratio=5):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def as_dict(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def spelled(seed=3, size=400):
    r = random.Random(seed)
    out = Counter()
    stems = ["".join(r.choice("abé") for _ in range(r.randrange(6, 12))) for _ in range(size // 8)]
    for s in stems:
        for _ in range(8):
            w = list(s)
            for _ in range(r.randrange(3)):
                i = r.randrange(len(w))
                what = r.randrange(3)
                if what == 0:
                    w[i] = r.choice("abéc")
                elif what == 1 and len(w) > 6:
                    del w[i]
                else:
                    w.insert(i, r.choice("abéc"))
            out["".join(w)] += r.choice([5, 6, 30, 200, 4000])
    return dict(out)


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_near_words_whatever_the_length_of_lists(spark, frame, most):
    n = spelled()
    found = spelling.near_words(frame(list(n.items()), "word string, n long"), most)
    rows = [(r["word"], r["near"], r["near_n"]) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(a, b, n[b]) for a in n for b in n if one_edit(a, b)}


def test_variants_with_chains_and_ties(spark, frame):
    n = spelled(5) | {"chainaa": 5, "chainab": 30, "chainbb": 200, "chainbbb": 2000, "tiedxxa": 5, "tiedxxb": 50, "tiedxxc": 50, "alonexyz": 7}
    assert as_dict(spelling.variants(frame(list(n.items()), "word string, n long"))) == variants_by_hand(n)
    assert variants_by_hand(n)["chainaa"][:2] == ("chainab", "chainbbb")
    assert variants_by_hand(n)["tiedxxa"][0] == "tiedxxb"
    with pytest.raises(ValueError):
        spelling.variants(frame([], "word string, n long"), ratio=1)


def test_short_words_and_none(spark, frame):
    n = {"a": 5, "b": 5, "ab": 40, "abc": 400, "": 6}
    found = spelling.near_words(frame(list(n.items()), "word string, n long"))
    assert {(r["word"], r["near"]) for r in found.collect()} == {(a, b) for a in n for b in n if one_edit(a, b)} - {("", "a"), ("a", ""), ("", "b"), ("b", "")}
    assert spelling.variants(frame([], "word string, n long")).count() == 0


def test_vocabulary_and_query(spark, tmp_path):
    r = random.Random(8)
    texts = [" ".join(r.choice(["Straßen", "straßen", "HÄUSER", "häuser", "kurz", "variant", "variamt", "Variant's", "colour", "color×", "x" * 300]) for _ in range(r.randrange(60))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "variant " * 9), (7, None), (8, ""), (3, texts[3]), (3, texts[3])]
    spark.createDataFrame(rows, DOCS).withColumns({"word": F.lit("w"), "n": F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    n = words_by_hand(rows)
    assert as_dict(queries.op11_spelling_variants(spark, str(tmp_path))) == variants_by_hand(n)
    got = spelling.vocabulary(spark.createDataFrame(rows, DOCS), least=4, occurrences=1, every=3)
    assert {x["word"]: x["n"] for x in got.collect()} == words_by_hand(rows, 4, 1, 3)


# fill-in-middle


def rearranged_by_hand(doc, text):
    text = text or ""
    tokens = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", "a  b", "<", "<P", "x<M>y", "<<S", "😀 😀😀\n𝒳", " nbsp  wide", "P> S> <", "\x1c\x00 a"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 4096])
def test_rearranged_in_chunks_of_any_size(spark, frame, size):
    r = random.Random(size)
    texts = ODD + ["".join(r.choice(["a", "ß", "😀", " ", "\n", "<"]) for _ in range(r.randrange(40))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id text here"), (5, "repeated id"), (5, "repeated id")]
    done = fill_middle.rearrange(frame([(*x, "n", 1) for x in rows], "doc_id long, text string, form string, own int"), size=size)
    assert done.columns[:3] == ["doc_id", "text", "own"]
    got = sorted(map(repr, [(x["doc_id"], x["text"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) for x in done.collect()]))
    assert got == sorted(map(repr, [(*x, *rearranged_by_hand(*x)) for x in rows]))
    back = done.select("text", fill_middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(x["back"] == (x["text"] or "") for x in back)


def test_fill_in_middle_query(spark, tmp_path):
    long = " ".join(f"w{i} \n" for i in range(60_000))
    rows = [(i, (long if i % 5 == 0 else f"one two {i}")[i:]) for i in range(40)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {tuple(x) for x in queries.op12_fill_in_middle(spark, str(tmp_path)).collect()}
    assert got == {(d, *(e := rearranged_by_hand(d, t))[:4], sha(e[4]), sha(t)) for d, t in rows}
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert fill_middle.rearrange(spark.createDataFrame([], DOCS)).count() == 0


# phrases


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def hits_by_hand(docs, bench, width=10):
    windows = defaultdict(set)
    for item, text in bench:
        w = split(text)
        for j in range(len(w) - min(width, len(w)) + 1 if w else 0):
            windows[tuple(w[j : j + width])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, items = split(text), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[s : s + k]))) is not None:
                    hit |= set(range(s, s + k))
                    items |= found - {None}
        listed = ",".join(sorted(map(str, items)))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def planted(seed=2):
    r = random.Random(seed)
    vocab = [f"wort{i}" for i in range(60)] + ["É", "é", "Ab", "aB", "東京"]
    say = lambda k: [r.choice(vocab) for _ in range(k)]
    bench = [(i, " ".join(say(k))) for i, k in enumerate([1, 2, 3, 5, 9, 10, 11, 12, 30, 40, 40, 40])]
    bench += [(100, bench[9][1]), (100, bench[8][1]), (101, "a a a a a a a a a a a a"), (102, "nowhere else seen"), (103, None), (104, " ,. "), (None, bench[7][1])]
    docs = []
    for i in range(200):
        w = say(r.choice([0, 3, 12, 80, 200]))
        for _ in range(r.randrange(3)):
            b = bench[r.randrange(12)][1].split()
            a = r.randrange(len(b))
            w[len(w) // 2 : len(w) // 2] = [x.upper() if x.isascii() and r.random() < 0.3 else x for x in b[a : a + r.randrange(1, 45)]]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    docs += [(500, "a " * 400), (None, bench[9][1]), (None, bench[10][1]), (3, docs[4][1]), (3, docs[4][1]), (7, None), (8, ""), (9, bench[11][1].split(" ", 3)[3])]
    return docs, bench


@pytest.mark.parametrize("by_shuffle", [False, True])
def test_phrases_as_by_hand(spark, tmp_path, monkeypatch, by_shuffle):
    if by_shuffle:
        monkeypatch.setattr(phrase_index, "small_side", lambda df: df)
    docs, bench = planted()
    spark.createDataFrame(docs, DOCS).withColumns({"term": F.lit("t"), "hash": F.lit(0), "n_hit": F.lit(9)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op13_decontamination(spark, str(tmp_path))
    assert sorted(map(repr, [tuple(x)[:6] for x in got.collect()])) == hits_by_hand(docs, bench)


def test_no_benchmark_and_no_documents(spark, frame):
    none = frame([], "item_id long, text string")
    got = phrase_index.contamination(frame([(1, "x y")], DOCS), none).collect()
    assert [(x["n_words"], x["n_hit"], x["contaminated"]) for x in got] == [(2, 0, False)]
    assert phrase_index.contamination(frame([], DOCS), frame([(1, "x y")], "item_id long, text string")).count() == 0


def test_proximity(spark, frame):
    docs = frame([(1, "filler rare0 x x rare2 x rare1 " + "pad " * 30), (2, "rare0 " + "pad " * 30 + "rare1 rare2"), (3, "rare0 rare1 " * 3 + "pad " * 30), (4, "rare0 rare1 rare2"), (5, "pad " * 9)], DOCS)
    got = phrase_index.contamination(docs, frame([(9, "rare0 rare1 rare2 pad pad pad pad pad pad pad")], "item_id long, text string"))
    assert {x["doc_id"]: (x["n_near"], x["n_hit"]) for x in got.collect()} == {1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (1, 0), 5: (0, 0)}


@given(st.text(max_size=30), st.text(max_size=30))
def test_one_edit_by_hand_is_symmetric(a, b):
    assert one_edit(a, b) == one_edit(b, a)
