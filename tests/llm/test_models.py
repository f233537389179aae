"""Held-out accuracy of the classifiers, and the pipeline's effects."""

import zlib

import numpy as np
import pytest

from melder.llm import language_id, minhash_dedup, quality_knn, queries

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def _count(row, s):
    """Phrases of a greedy parse by substring search."""
    n = i = 0
    while i < len(row):
        k = 1
        while i + k <= len(row) and bytes(row[i : i + k]) in s:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


@pytest.mark.parametrize("segment, columns", [(1024, 2048), (7, 2048), (3, 5), (1, 4)])
def test_automaton_and_phrases_by_brute_force(monkeypatch, segment, columns):
    monkeypatch.setattr(language_id, "SEGMENT", segment)
    monkeypatch.setattr(language_id, "COLUMNS", columns)
    r = np.random.default_rng(1)
    texts = [r.integers(1, 5, 60).astype(np.uint8), r.integers(1, 4, 300).astype(np.uint8)]
    tables = [language_id.automaton(x, 6) for x in texts]
    start = np.array([0, tables[0].size], dtype=np.int32)
    flat = np.concatenate([np.where(t < 0, -1, t * 6 + s).ravel() for t, s in zip(tables, start, strict=True)]).astype(np.int32)
    rows = [r.integers(1, 6, n).astype(np.uint8) for n in (0, 1, 7, 40, 200, 1500)] + [np.tile(texts[1][:100], 12)]
    got = language_id.phrases(rows, flat, start)
    for j, x in enumerate(texts):
        assert got[:, j].tolist() == [_count(row.tolist(), bytes(x.tolist())) for row in rows]


def test_rare_letters_are_spelled():
    made, letters = language_id.symbols("Ab가 😀 𐐀b", "ab")
    d = lambda code, n: [language_id.DIGITS + (code >> 4 * (n - 1 - k)) % 16 for k in range(n)]
    f = language_id.FIRST_LETTER
    assert letters and made.tolist() == [f, f + 1, *d(ord("가"), 4), language_id.SPACE, *d(0x10428, 5), f + 1]


def test_many_scripts(frame):
    r = np.random.default_rng(6)
    words = {k: ["".join(chr(r.integers(lo, hi)) for _ in range(r.integers(2, 6))) for _ in range(120)] for k, (lo, hi) in {"ko": (0xAC00, 0xB000), "zh": (0x4E00, 0x5200), "el": (0x3B1, 0x3C9), "xx": (97, 110), "yy": (105, 122)}.items()}
    rows = [(i * 5 + j, " ".join(r.choice(w, 40)), k) for i in range(40) for j, (k, w) in enumerate(words.items())]
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.identify(frame(rows, "doc_id long, text string, lang string")).collect()}
    assert np.mean([got[i] == k for i, _, k in rows]) > 0.99


def test_learning_shares_symbols_over_rows():
    rows = [np.full(n, c, dtype=np.uint8) for c, n in ((17, 10), (18, 5000), (19, 9000))]
    got = language_id._shares(rows, 1000)
    n = [int((got == c).sum()) for c in (17, 18, 19)]
    assert n[0] == 10 and min(n[1:]) > 450 and len(got) <= 1003


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language_id.identify(docs).collect()
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_language_edges(frame):
    rows = [(1, "the cat sat on the mat " * 9, "en"), (2, "der hund und die katze " * 9, "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "de"), (None, "the cat", None), (7, "die katze und der hund", None), (7, "die katze und der hund", None), (8, "the " * 100_000, None)]
    got = language_id.identify(frame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")).collect()
    by = {(r["doc_id"]): r["lang_pred"] for r in got}
    assert len(got) == 9 and by[3] == by[4] == by[5] == "und" and by[7] == "de" and by[8] == "en"
    assert language_id.identify(frame([], "doc_id long, text string, lang string")).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(frame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality_knn.classify(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_cosines_in_blocks_are_exact(monkeypatch):
    r = np.random.default_rng(2)
    x = np.abs(r.standard_normal((50, quality_knn.DIMENSIONS))).astype(np.float32)
    m = quality_knn.Model(x, (r.random(50) > 0.4).astype(np.float32))
    texts = ["some words here", "OTHER!! WORDS!!", "a###", ""]
    whole = m.score(texts)
    monkeypatch.setattr(quality_knn, "BLOCK", 7)
    assert np.allclose(m.score(texts), whole, atol=1e-6)
    z = quality_knn._unit(quality_knn._dense(texts) @ m.axes)
    cos = z @ m.vectors.T
    for i in range(3):
        top = np.argsort(-cos[i], kind="stable")[: quality_knn.NEIGHBOURS]
        w = np.maximum(cos[i][top], 0) ** quality_knn.SHARPNESS
        assert whole[i] == pytest.approx(((w * m.labels[top]).sum() + 0.01 * m.prior) / (w.sum() + 0.01), abs=1e-4)


def test_quality_edges(frame):
    docs = frame([(1, None, 5.0), (2, "", 5.0), (None, "x", 5.0), (3, "good words", 5.0), (3, "good words", 5.0)], "doc_id long, text string, score double")
    labels = frame([(3, 1), (3, None), (None, 0)], "doc_id long, quality int")
    got = quality_knn.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    none = quality_knn.classify(docs, frame([], "doc_id long, quality int")).collect()
    assert all(r["score"] == 0.5 for r in none)
    assert quality_knn.keep_good(docs, labels).columns == ["doc_id", "text", "score"]


def test_quality_of_empty_tables_and_very_long_texts(frame):
    labels = frame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = frame([(i, "fine words of a text " * 5 if i % 2 else "#### $$$$ !!!! " * 9) for i in range(40)] + [(100, "fine words of a text " * 60_000), (101, "#### $$$$ !!!! " * 60_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in quality_knn.classify(docs, labels).collect()}
    assert (got[100], got[101]) == (1, 0)
    assert quality_knn.classify(frame([], "doc_id long, text string"), labels).count() == 0


def test_pipeline(spark, tmp_path):
    """run() against its stages, each by a plain rule over the one before."""
    import corpus_pipeline as cp

    from melder.llm import mixing, packing, secret_scan

    assert [n for n, _ in cp.STAGES] == ["quality classifier", "minhash near-dedup", "secret scans", "mixing", "best-fit packing"]
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (None, "a text without an id " * 30, "en", "src0", 600), (9002, "", "en", None, 0), (9002, "some other text of that id " * 9, "en", "src0", 243)], given.schema)
    given.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path)).collect()

    good = {(r["doc_id"], r["text"]) for r in quality_knn.classify(docs, labels).where("score >= 0.5").collect()}
    rows = [r for r in docs.collect() if (r["doc_id"], r["text"]) in good]
    sets = [set(minhash_dedup.shingle_set(r["text"], 5).tolist()) for r in rows]
    up = list(range(len(rows)))
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0))
    for x, i in enumerate(order):  # a group keeps its smallest doc_id; rows without one stay
        for j in order[:x]:
            if rows[i]["doc_id"] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = up[i], up[j]
                up = [new if u == old else u for u in up]
    rows = [rows[i] for i in range(len(rows)) if up[i] == i]
    masked = {(r["doc_id"], r["text"]): r["redacted"] for r in secret_scan.scan(spark.createDataFrame(rows, given.schema), "source").collect()}
    texts = [(r["doc_id"], masked[(r["doc_id"], r["text"])], r["source"]) for r in rows]
    copies = mixing.mix(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()
    words = packing.Words(queries.tokenizer())
    want = sorted((r["doc_id"] or 0, k, zlib.crc32(part)) for r in copies for k, part in _pieces(words, r["text"]))
    assert sorted((r["doc_id"] or 0, r["piece"], r["ids_crc32"]) for r in got) == want and len(want) > 100

    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    labels.limit(0).write.parquet(f"{empty}/labels.parquet")
    assert cp.run(spark, str(empty)).count() == 0


def _pieces(words, text):
    ids = words._whole(text or "") + b"\0" * 4
    return [(k, ids[at : at + 8192]) for k, at in enumerate(range(0, len(ids), 8192))]


def test_pipeline_dedup_leaves_no_link(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = minhash_dedup.keep_one(docs).select("doc_id", "text").collect()
    sets = [set(minhash_dedup.shingle_set(r["text"], 5).tolist()) for r in kept]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b and len(a & b) > 0)


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 14)) and "pipeline" in queries.QUERIES


def test_one_row_of_each_labelled_id_is_learned_from(spark, frame):
    from melder.llm import quality_knn

    docs = frame([(2, f"text number {i}") for i in range(5000)] + [(3, "another good text")], "doc_id long, text string")
    model = quality_knn.learn(docs, frame([(2, 0), (3, 1), (4, 1)], "doc_id long, quality int"))
    assert len(model.labels) <= 2
