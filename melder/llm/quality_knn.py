"""Quality classifier by nearest-neighbour voting in a latent semantic space (operator 1).

A text is a vector of counts: hashed words, three-letter windows over character classes (how
words are cased, decorated and ended), and bins of length and of word variety. Weighted by
inverse document frequency and reduced by a singular value decomposition of the labelled
sample, the labelled vectors are sent to every task; each text's exact cosines with all of them
are computed block by block, and the labels of the nearest vote with their similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melder.llm.common import batches_of, crc32_mod

SAMPLE_ROWS = 3000  # labelled rows that are learned from, at most; with RANK it bounds what is sent
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 4  # power of a similarity in the vote
BLOCK = 1024  # labelled vectors in a block of cosines
FOLDS, HELD_OUT = 3, 1

CLASSES = 16
_WORDS = 4096
_BINS = 64
DIMENSIONS = CLASSES**3 + _WORDS + _BINS


def _class_table() -> bytes:
    """Character class of a UTF-8 byte: blank, line end, lower, upper, digit, beyond ASCII, full
    stop and comma, and single classes for decorations."""
    table = bytearray([15] * 256)
    for c in b" \t\x0b\x0c\r":
        table[c] = 0
    table[ord("\n")] = 1
    for c in range(ord("a"), ord("z") + 1):
        table[c] = 2
        table[c - 32] = 3
    for c in b"0123456789":
        table[c] = 4
    for c in range(128, 256):
        table[c] = 2
    for k, group in enumerate((b".,;:", b"!?", b"#", b"*", b"$%", b"&", b"|", b"<>", b"'\"`", b"-_/\\")):
        for c in group:
            table[c] = 5 + k
    return bytes(table)


_CLASSES = _class_table()


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and dampened counts of a text's features, normalised in each family of features."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
    c = np.frombuffer(raw.translate(_CLASSES), dtype=np.uint8).astype(np.int32)
    at, n = [], []

    def family(base: int, got: np.ndarray, weight: float) -> None:
        hit = np.flatnonzero(got)
        v = np.log1p(got[hit] * (1000.0 / max(1, got.sum())))
        at.append(hit + base)
        n.append(v * (weight / max(1e-9, float(np.sqrt((v * v).sum())))))

    if len(c) >= 3:
        family(0, np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3), 1.0)
    distinct = list(set(words))
    h = np.fromiter(map(zlib.crc32, distinct), dtype=np.int64, count=len(distinct))
    family(CLASSES**3, np.bincount(h % _WORDS, minlength=_WORDS), 0.5)
    bins = np.zeros(_BINS, dtype=np.int64)
    bins[min(15, int(np.log2(len(words))))] = 1
    bins[16 + min(15, int(16 * len(distinct) / len(words)))] = 2
    bins[32 + min(15, int(16 * len(zlib.compress(raw, 1)) / len(raw)))] = 1 if len(words) > 20 else 0
    family(CLASSES**3 + _WORDS, bins, 0.6)
    return np.concatenate(at).astype(np.int32), np.concatenate(n).astype(np.float32)


def _dense(texts: list[str | None]) -> np.ndarray:
    x = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for i, t in enumerate(texts):
        at, n = counts(t)
        x[i, at] = n
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    """Term weights, the latent axes, and the labelled latent vectors. x is changed in place."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        df = np.count_nonzero(x, axis=0)
        self.idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + np.float32(0.1)
        x *= self.idf  # in place: the sample is the driver's largest array
        rank = min(RANK, *x.shape) if len(x) else 0
        if rank:
            rng = np.random.default_rng(3)
            y = x @ rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
            for _ in range(3):
                q, _ = np.linalg.qr(y)
                y = x @ (x.T @ q)
            q, _ = np.linalg.qr(y)
            _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
            latent = np.ascontiguousarray(vt[:rank].T.astype(np.float32))
            self.vectors = _unit(x @ latent).astype(np.float32)
            self.axes = latent * self.idf[:, None]
        else:
            self.axes = np.zeros((DIMENSIONS, 1), dtype=np.float32)
            self.vectors = np.zeros((0, 1), dtype=np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the NEIGHBOURS; the sample's share of it for
        texts without words and without a similar vector."""
        z = _unit(_dense(texts) @ self.axes)
        k = min(NEIGHBOURS, len(self.vectors))
        near = np.zeros((len(texts), 0), dtype=np.float32)
        who = np.zeros((len(texts), 0), dtype=np.int64)
        for b in range(0, len(self.vectors), BLOCK):
            cos = z @ self.vectors[b : b + BLOCK].T
            part = np.argpartition(-cos, min(k, cos.shape[1]) - 1, axis=1)[:, :k] if cos.shape[1] > k else np.tile(np.arange(cos.shape[1]), (len(z), 1))
            near = np.concatenate([near, np.take_along_axis(cos, part, 1)], axis=1)
            who = np.concatenate([who, part + b], axis=1)
        if not k:
            return np.full(len(texts), self.prior)
        top = np.argsort(-near, axis=1, kind="stable")[:, :k]
        w = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARPNESS
        vote = (w * self.labels[np.take_along_axis(who, top, 1)]).sum(axis=1)
        return np.clip((vote + 0.01 * self.prior) / (w.sum(axis=1) + 0.01), 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From at most about SAMPLE_ROWS labelled documents, drawn by a hash of doc_id. Of rows that repeat a
    doc_id the one whose text has the smallest hash is learned from, however many there are."""
    rows = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(crc32_mod("doc_id", FOLDS) != HELD_OUT)
    # repeated labels of a document: the lower one counts
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = rows.count()
    u = F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "doc_id"), 11) / F.lit(float(1 << 53))
    drawn = rows.where(u * n < SAMPLE_ROWS).limit(2 * SAMPLE_ROWS)  # the limit only proves the bound of the broadcast

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [counts(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "quality": f["quality"], "at": [a.tobytes() for a, _ in got], "n": [v.tobytes() for _, v in got]})

    one = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "quality")).alias("m"))
    found = one.select("doc_id", "m.quality", "m.text").mapInPandas(run, "doc_id long, quality int, at binary, n binary").collect()
    found.sort(key=lambda r: r["doc_id"])
    x, quality = np.zeros((len(found), DIMENSIONS), dtype=np.float32), np.zeros(len(found), dtype=np.float32)
    while found:  # rows go as the array fills: the driver holds the sample once
        r = found.pop()
        x[len(found), np.frombuffer(r["at"], dtype=np.int32)] = np.frombuffer(r["n"], dtype=np.float32)
        quality[len(found)] = r["quality"]
    return Model(x, quality)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of docs and held_out, score, predicted, which take the place of columns so named.

    docs has doc_id and text, labels doc_id and quality (0 or 1). Only labelled rows whose
    crc32(doc_id as text) mod 3 is not 1 are learned from, and only whole texts are looked at.
    Null and empty texts get the sample's share of label 1; without any labels the score is 0.5.
    A row without doc_id is held out. Repeated rows get equal scores.
    """
    spark = docs.sparkSession
    batches_of(spark, 256)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(learn(named, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(texts.tolist()))

    held = F.coalesce(crc32_mod("doc_id", FOLDS) == HELD_OUT, F.lit(True))
    own = [docs[c] for c in docs.columns if c not in ("held_out", "score", "predicted")]
    out = docs.select(*own, held.alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted good, with their own columns."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return classify(rows, labels).where("predicted = 1").select("row.*")
