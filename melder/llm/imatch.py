"""Document fingerprints by I-Match over randomised lexicon subsets (operator 4).

Terms are 32-bit hashes of words. The lexicon is the set of terms whose document frequency over
the whole corpus lies in a band: neither near-unique nor near-universal. Of n distinct words a
share of about n / 2**32 has a hash in common with another one: 0.1 % of 3 million, 1 % of 45
million. A text's sorted distinct lexicon terms are hashed as a whole, and once for each of
SUBSETS random subsets of the lexicon: the terms of the text that the subset keeps, in order.
Each subset keeps a fixed share of the lexicon, from 1/16 down to 1/2048, whatever the text:
subsets that keep much change with every edit, those that keep little survive many, so the share
of equal hashes falls smoothly with the terms that two texts have in common.

A lexicon of at most BROADCAST_TERMS terms is sent to the workers as a sorted array of 4 bytes a
term; beyond it stays a table, and the texts' terms are joined with it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melder.llm.common import batches_of, written

SHARES = range(4, 12)  # a subset keeps 2 ** -share of the lexicon
EACH = 8  # subsets of each share
SUBSETS = EACH * len(SHARES)
LOWEST_DF = 2
HIGHEST_SHARE = 0.1  # of all documents
BROADCAST_TERMS = 20_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit term hashes."""
    words = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    return np.unique(np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)))


def held(lexicon: np.ndarray, found: np.ndarray) -> np.ndarray:
    """True where the sorted lexicon holds the term."""
    if not len(lexicon):
        return np.zeros(len(found), dtype=bool)
    return lexicon[np.minimum(np.searchsorted(lexicon, found), len(lexicon) - 1)] == found


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(slot, n) summed over a few million terms at a time, so rows and memory stay small. A slot
    is written as a signed number of 32 bits."""

    def summed(parts: list[np.ndarray]) -> pd.DataFrame:
        slot, n = np.unique(np.concatenate(parts), return_counts=True)
        return pd.DataFrame({"slot": slot.view(np.int32), "n": n.astype(np.int32)})

    parts: list[np.ndarray] = []
    held = 0
    for f in frames:
        for t in f["text"]:
            if t:
                parts.append(terms(t))
                held += len(parts[-1])
        if held > 4_000_000:
            yield summed(parts)
            parts, held = [], 0
    if parts:
        yield summed(parts)


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"slots": [f["slot"].to_numpy(np.int32).tobytes()]})


def lexicon_table(docs: DataFrame, lowest: int = LOWEST_DF, highest: float = HIGHEST_SHARE) -> DataFrame:
    """(slot): the terms whose document frequency over all of docs(text) is in the band."""
    batches_of(docs.sparkSession, 512)
    df = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(_count, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n"))
    most = max(lowest, int(highest * docs.count()))
    return written(df.where(F.col("n").between(lowest, most)).select("slot"), "lexicon")


def lexicon(table: DataFrame) -> np.ndarray:
    """The terms of a lexicon table as a sorted array."""
    packed = table.mapInPandas(_pack, "slots binary")
    parts = [np.frombuffer(bytes(r["slots"]), dtype=np.uint32) for r in packed.toLocalIterator()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint32)


def _draws(found: np.ndarray) -> np.ndarray:
    """[term, EACH]: a random number of 16 bits for each of the nested rows of subsets."""
    out = []
    for k in range(EACH // 4):
        x = (found.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D + k)) * _A
        x = (x ^ (x >> np.uint64(29))) * _B
        x ^= x >> np.uint64(32)
        out.append(x)
    return np.stack(out, axis=1).view(np.uint16)


def _listed(found: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """A 64-bit hash of the list of terms in each group, 0 for an empty one. Rows come by group and
    in order; the hash is a polynomial in a fixed factor, so a term counts with its place."""
    out = np.zeros(groups, dtype=np.uint64)
    if not len(found):
        return out
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(starts, len(group)))
    place = np.arange(len(group)) - np.repeat(starts, size)
    power = np.cumprod(np.full(int(size.max()) + 1, _A), dtype=np.uint64)
    mixed = (found.astype(np.uint64) + np.uint64(1)) * _B
    mixed ^= mixed >> np.uint64(31)
    total = np.add.reduceat(mixed * power[place], starts)
    total = (total ^ (total >> np.uint64(30))) * _B
    out[group[starts]] = total ^ (total >> np.uint64(27))
    return out


def fingerprints_of(kept: list[np.ndarray], whole: list[np.ndarray]) -> list[str]:
    """Fingerprints of texts from their sorted lexicon terms (kept) and all their terms (whole):
    the hash of all lexicon terms in 16 hexadecimal digits, and 4 for each subset, 0000 where it
    keeps none of them. A text without a lexicon term is `=` and a hash of all its terms, alike
    only with equal ones; a text without words is empty."""
    n = len(kept)
    found = np.concatenate([np.zeros(0, dtype=np.uint32), *kept])
    own = np.repeat(np.arange(n), [len(k) for k in kept])
    first = _listed(found, own, n)
    columns = []
    draw = _draws(found)
    at, row = np.nonzero(draw < (1 << (16 - SHARES[0])))  # what no subset keeps is left out first
    group = own[at] * EACH + row
    order = np.argsort(group, kind="stable")
    group, value, term = group[order], draw[at, row][order], found[at][order]
    for share in SHARES:
        in_it = value < (1 << (16 - share))
        hashes = _listed(term[in_it], group[in_it], n * EACH)
        columns.append(np.where(hashes > 0, np.maximum(hashes >> np.uint64(48), 1), 0).astype(">u2").reshape(n, EACH))
    rows = np.ascontiguousarray(np.concatenate(columns, axis=1))
    bare = [i for i in range(n) if not len(kept[i]) and len(whole[i])]
    lone = dict(zip(bare, _listed(np.concatenate([np.zeros(0, dtype=np.uint32), *[whole[i] for i in bare]]), np.repeat(np.arange(len(bare)), [len(whole[i]) for i in bare]), len(bare)), strict=True))
    return [f"{first[i]:016x}{rows[i].tobytes().hex()}" if len(kept[i]) else f"={lone[i]:016x}" if i in lone else "" for i in range(n)]


def fingerprint(text: str | None, words: np.ndarray) -> str:
    """The fingerprint of one text under a lexicon."""
    own = terms(text)
    return fingerprints_of([own[held(words, own)]], [own])[0]


def likeness(a: str, b: str) -> float:
    """The weighted share of equal hashes among those of the subsets that keep a term of either text.

    Where all subsets of a share keep some, they keep many, and an edit changes most of them: such
    a share counts less than those that leave part of its subsets empty. The hash of the whole list
    counts least. 1 for equal fingerprints, 0 if a text without a lexicon term differs.
    """
    if a == b:
        return 1.0
    if len(a) != len(b) or len(a) < 20:
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s[16:]), dtype=">u2").reshape(len(SHARES), EACH) for s in (a, b))
    met = (x != 0) | (y != 0)
    n = met.sum(axis=1)
    each = (EACH + 1 - n) / EACH  # of a subset of the share
    return float(((((x == y) & met).sum(axis=1) * each).sum() + (a[:16] == b[:16]) / EACH) / ((n * each).sum() + 1 / EACH))


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 4) code points replaced by the first as many of `following`."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """docs(doc_id, text) with its fingerprint: no row moves. Null is an empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = [terms(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "fingerprint": fingerprints_of([x[held(words, x)] for x in own], own)})

    batches_of(docs.sparkSession, 256)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, fingerprint string")


def _bounds(docs: DataFrame, buckets: int) -> list[float]:
    """Quantiles of doc_id that cut the table into about equal runs."""
    q = docs.where("doc_id is not null").stat.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    return sorted(set(q))


def with_following(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, doc_id, text), dealt by bucket and sorted, such that the row after a
    row is that of the next doc_id. The last row of a bucket is a guest: the first of the next one.

    Buckets are runs of doc_id between quantiles, several for each shuffle partition.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = _bounds(docs, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # null ids come before all others
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    placed = Bucketizer(splits=[float("-inf"), *bounds, float("inf")] if bounds else [float("-inf"), 0.0, float("inf")], inputCol="__key", outputCol="bucket").transform(docs.withColumn("__key", key))
    first = placed.groupBy("bucket").agg(F.min("__key").alias("__key"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"))
    rows = sorted((r["bucket"], r["__key"]) for r in first.collect())  # one for each bucket
    if not rows:
        return placed.select("bucket", F.lit(0).alias("guest"), "doc_id", "text")
    before = {k: rows[i - 1][0] for i, (_, k) in enumerate(rows)}
    starts = F.broadcast(spark.createDataFrame(list(before.items()), "__key double, host double"))
    dealt = placed.join(starts, "__key", "left").select("doc_id", "text", F.explode(F.when(F.col("host").isNull(), F.array(F.struct("bucket", F.lit(0).alias("guest")))).otherwise(F.array(F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))))).alias("at"))
    return dealt.select("at.bucket", "at.guest", "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text")


_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str], list[str], list[str]]]:
    """(ids, texts, edited texts, next texts) of rows dealt by with_following(), batch by batch."""
    before = None  # (bucket, doc_id, text) of the row before
    for f in frames:
        ids, own, new, after = [], [], [], []
        for bucket, guest, doc, text in zip(f["bucket"], f["guest"], f["doc_id"], f["text"], strict=True):
            text = text or ""
            if before is not None and before[0] != bucket:
                before = None
            if guest and before is None:
                continue  # a further guest: the first alone is the next row
            if before is not None:
                ids.append(before[1])
                own.append(before[2])
                new.append(edited(before[2], text))
                after.append(text)
            before = None if guest else (bucket, doc, text)
        yield ids, own, new, after


def _edit_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _compare(words: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, own, new, after in _pairs(frames):
            # the next row's text is most often the next text of the batch
            made: dict[int, np.ndarray] = {}
            every = [made.setdefault(id(t), terms(t)) if id(t) not in made else made[id(t)] for t in [*own, *new, *after]]
            marks = fingerprints_of([x[held(words, x)] for x in every], every)
            n = len(ids)
            a, b, c = marks[:n], marks[n : 2 * n], marks[2 * n :]
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_chars": [len(t) for t in own], "edited_sha256": [_edit_hash(t) for t in new], "fingerprint": a, "edited_fingerprint": b, "near_edited": list(map(likeness, a, b)), "near_next": list(map(likeness, a, c))}, columns=_RESULT)

    return run


def _listed_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each document, text of the three and term, and one with a null term for each of these texts."""
    for ids, own, new, after in _pairs(frames):
        for i, doc in enumerate(ids):
            key = uuid.uuid4().hex
            for kind, text in enumerate((own[i], new[i], after[i])):
                found = terms(text)
                head = pd.DataFrame({"doc_id": pd.array([doc], dtype="Int64"), "n_chars": [len(own[i])], "edited_sha256": [_edit_hash(new[i])], "row": [key], "kind": [kind], "slot": pd.array([None], dtype="Int32"), "whole": [found.tobytes()]})
                yield head
                for k in range(0, len(found), 100_000):
                    part = found[k : k + 100_000].view(np.int32)
                    yield pd.DataFrame({"doc_id": pd.array([None] * len(part), dtype="Int64"), "n_chars": 0, "edited_sha256": None, "row": key, "kind": kind, "slot": pd.array(part, dtype="Int32"), "whole": None})


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for doc, n, sha, kept, whole in zip(f["doc_id"], f["n_chars"], f["edited_sha256"], f["kept"], f["whole"], strict=True):
            k = [np.sort(np.asarray(x, dtype=np.int32).view(np.uint32)) for x in kept]
            a, b, c = fingerprints_of(k, [np.frombuffer(x, dtype=np.uint32) for x in whole])
            out.append((doc, n, sha, a, b, likeness(a, b), likeness(a, c)))
        yield pd.DataFrame(out, columns=_RESULT).astype({"doc_id": "Int64"})


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _by_join(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The same result with a lexicon that stays a table: terms meet it in a join, and come back to
    their documents."""
    every = written(rows.mapInPandas(_listed_terms, "doc_id long, n_chars long, edited_sha256 string, row string, kind int, slot int, whole binary"), "terms")
    kept = every.where("slot is not null").join(table, "slot", "left_semi").groupBy("row", "kind").agg(F.collect_list("slot").alias("kept"))
    heads = every.where("slot is null").drop("slot").join(kept, ["row", "kind"], "left")
    of = lambda c: F.expr(f"transform(array_sort(collect_list(struct(kind, {c} as x))), y -> y.x)")
    whole = heads.withColumn("kept", F.coalesce("kept", F.expr("cast(array() as array<int>)"))).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.max("edited_sha256").alias("edited_sha256"), of("kept").alias("kept"), of("whole").alias("whole"))
    return whole.drop("row").mapInPandas(_joined, _SCHEMA)


def stability(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for
    every row of docs(doc_id, text).

    The next document is that of the next doc_id, after the last one the first; a lone row is
    its own. Null text is empty. Null ids come before all others; rows that repeat an id are
    ordered by text. An empty table gives an empty result.
    """
    table = lexicon_table(docs)
    batches_of(docs.sparkSession, 256)
    rows = with_following(docs)
    if table.count() > BROADCAST_TERMS:
        return _by_join(rows, table)
    return rows.mapInPandas(_compare(lexicon(table)), _SCHEMA)
