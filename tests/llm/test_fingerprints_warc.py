"""Fingerprints by their definition; archives by round trips."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from melder.llm import imatch, warc


def test_edits_and_order(frame):
    texts = {7: "".join(f"word{i} " for i in range(200)), 2: "", 9: None, 4: "é" * 9, 11: "word1 word2 word3 word4 word5 " * 40, 5: "a"}
    got = {r["doc_id"]: r for r in imatch.stability(frame(list(texts.items()), "doc_id long, text string")).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        own, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        n = len(own) // 4
        want = own[: len(own) - n] + after[:n]
        assert got[i]["n_chars"] == len(own)
        assert got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1


def test_equal_texts_have_equal_fingerprints_and_likeness_falls(frame):
    base = [f"term{i}" for i in range(300)]
    docs = [(i, " ".join(base[i % 40 : 250 + i % 40])) for i in range(60)] + [(100, " ".join(base[:250])), (101, " ".join(base[:250])), (102, " ".join(f"other{i}" for i in range(250)))]
    words = imatch.lexicon(imatch.lexicon_table(frame(docs, "doc_id long, text string"), 1, 1.0))
    f = {i: imatch.fingerprint(t, words) for i, t in docs}
    assert f[100] == f[101]
    some = imatch.fingerprint(" ".join(base[:225] + base[275:]), words)
    many = imatch.fingerprint(" ".join(base[:125] + base[250:]), words)
    assert 1 > imatch.likeness(f[100], some) > imatch.likeness(f[100], many) > imatch.likeness(f[100], f[102])


def test_lexicon_is_the_band(frame):
    docs = [(i, f"all rare{i} " + ("half" if i % 2 else "")) for i in range(10)]
    words = imatch.lexicon(imatch.lexicon_table(frame(docs, "doc_id long, text string"), 2, 0.5))
    inside = lambda w: bool(imatch.held(words, imatch.terms(w))[0])
    assert inside("half") and not inside("all") and not inside("rare3")


def _by_definition(text, words):
    """The kept lists of the whole lexicon and of each subset, by their definition; then their likeness."""
    kept = [t for t in sorted({zlib.crc32(w) for w in (text or "").encode().lower().split()}) if t in words]
    draws = imatch._draws(np.array(kept, dtype=np.uint32))
    return [tuple(kept)] + [tuple(t for t, d in zip(kept, draws[:, k], strict=True) if d < 2 ** (16 - share)) for share in imatch.SHARES for k in range(imatch.EACH)]


def test_fingerprints_by_their_definition():
    r = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = [" ".join(r.choice(vocabulary, n)) for n in r.integers(1, 400, 60)]
    texts += [t[: len(t) * 3 // 4] + " ".join(r.choice(vocabulary, 20)) for t in texts]
    words = np.unique(np.array([zlib.crc32(w.encode()) for w in vocabulary[:700]], dtype=np.uint32))
    inside = set(words.tolist())
    own = [imatch.terms(t) for t in texts]
    marks = imatch.fingerprints_of([x[imatch.held(words, x)] for x in own], own)
    assert marks == [imatch.fingerprint(t, words) for t in texts]
    lists = [_by_definition(t, inside) for t in texts]
    for i in range(len(texts)):
        if not lists[i][0]:
            assert marks[i].startswith("=")
            continue
        cells = [marks[i][:16], *[marks[i][16 + 4 * k : 20 + 4 * k] for k in range(imatch.SUBSETS)]]
        assert [c != "0000" for c in cells[1:]] == [bool(x) for x in lists[i][1:]]
        for j in range(i):
            if not lists[j][0]:
                continue
            other = [marks[j][:16], *[marks[j][16 + 4 * k : 20 + 4 * k] for k in range(imatch.SUBSETS)]]
            same = [a == b for a, b in zip(lists[i], lists[j], strict=True)]
            assert sum((a == b) != s for a, b, s in zip(cells, other, same, strict=True)) <= len(imatch.SHARES)  # hashes of 16 bits may meet, in nested subsets together
            met = equal = 0.0
            for k in range(len(imatch.SHARES)):
                at = [m for m in range(1 + k * imatch.EACH, 1 + (k + 1) * imatch.EACH) if lists[i][m] or lists[j][m]]
                met += len(at) * (imatch.EACH + 1 - len(at)) / imatch.EACH
                equal += sum(same[m] for m in at) * (imatch.EACH + 1 - len(at)) / imatch.EACH
            want = 1.0 if marks[i] == marks[j] else (equal + same[0] / imatch.EACH) / (met + 1 / imatch.EACH)
            assert abs(imatch.likeness(marks[i], marks[j]) - want) < 0.06
    everything = _by_definition(" ".join(vocabulary), inside)
    for k, share in enumerate(imatch.SHARES):  # a subset keeps its share of the lexicon
        assert np.mean([len(x) for x in everything[1 + k * imatch.EACH : 1 + (k + 1) * imatch.EACH]]) == pytest.approx(len(words) / 2**share, rel=0.6, abs=2)


def test_a_lexicon_that_stays_a_table_gives_the_same(frame, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(int(i), " ".join(r.choice([f"w{k}" for k in range(200)], n))) for i, n in enumerate(r.integers(0, 90, 40))] + [(None, None), (None, "w1 w2"), (3, "w1")]
    docs = frame(rows, "doc_id long, text string")
    sent = sorted(map(tuple, imatch.stability(docs).collect()), key=str)
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", -1)
    assert sorted(map(tuple, imatch.stability(docs).collect()), key=str) == sent and len(sent) == len(rows)


def test_very_long_texts(frame):
    long = " ".join(f"term{i}" for i in range(300_000))
    got = {r["doc_id"]: r for r in imatch.stability(frame([(1, long), (2, long), (3, "x y")], "doc_id long, text string")).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1.0 and got[2]["near_next"] == 0.0


def test_null_ids_repeats_and_empty(frame):
    rows = [(None, "x y z"), (3, "same words here"), (3, "same words here"), (3, "another text")]
    got = imatch.stability(frame([(*r, "c") for r in rows], "doc_id long, text string, bucket string")).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 3, 3, 3]
    assert imatch.stability(frame([], "doc_id long, text string")).count() == 0
    one = imatch.stability(frame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0


PAGE = "page_id long, url string, html string"


def want(rows):
    owner = {}
    for i, _, h in rows:
        if i is not None:
            owner[h or ""] = max(i, owner.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        o = owner.get(h or "")
        again = i is not None and o != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", o if again else None))
    return sorted(out, key=str)


def test_round_trip(frame):
    rows = [(i, f"http://e.org/{i}", f"<p>page {i % 40} " + "text " * (i % 50) + "é\r\n\r\nWARC/1.1</p>") for i in range(300)]
    rows += [(500, None, None), (501, "u", ""), (None, "u", "<p>no id</p>"), (502, "u\r\nX: y", "z" * 3_000_000), (502, "again", "z" * 3_000_000)]
    got = warc.round_trip(frame([(*r, 1) for r in rows], PAGE + ", refers_to int")).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == want(rows)
    html = {r["page_id"]: r["html"] for r in got if r["record_type"] == "response"}
    assert all(html[i] == (h or "") for i, _, h in rows if i in html and i is not None)


def test_archive_layout():
    recs = [warc.record(i, "u", (f"<html>{i} " + "common words of all pages " * 20).encode(), None) for i in range(200)]
    w = warc.Writer(recs)
    for r in recs:
        w.add(r)
    data = w.out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE_MAGIC
    n = int.from_bytes(data[4:8], "little")
    assert int.from_bytes(data[8 + n : 12 + n], "little") == warc.FRAME_MAGIC
    assert list(warc.records(data))[1:] == recs
    assert len(data) - n < sum(map(len, recs)) / 8
    for few in (recs[:1], recs[:3], recs[:1] * 9):  # too little to train on: the records themselves are the dictionary
        small = warc.Writer(few)
        for r in few:
            small.add(r)
        data = small.out.getvalue()
        assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE_MAGIC and int.from_bytes(data[4:8], "little") >= 64
        assert list(warc.records(data))[1:] == few


def test_empty_table_and_unreported_archives(spark, frame, tmp_path):
    assert warc.round_trip(frame([], PAGE)).count() == 0
    folder = f"file://{tmp_path}/w"
    done = warc.write(frame([(1, "u", "a"), (2, "u", "b")], PAGE), folder)
    (tmp_path / "w" / "left-behind.warc.zst").write_bytes(b"\x28\xb5\x2f\xfdbroken")
    assert sorted(r["page_id"] for r in warc.read(spark, folder, done).collect()) == [1, 2]


def test_texts_without_lexicon_terms():
    none = np.zeros(0, dtype=np.uint32)
    one, other = imatch.fingerprint("one", none), imatch.fingerprint("other", none)
    assert imatch.fingerprint("", none) == imatch.fingerprint(None, none) == ""
    assert one.startswith("=") and one != other and imatch.likeness(one, other) == 0 and imatch.likeness(one, one) == 1
