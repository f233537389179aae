"""WARC archives with a Zstandard dictionary (operator 6).

An archive starts with a skippable frame that holds a dictionary trained on the archive's own
first records; then each record is a Zstandard frame of its own, compressed with it. Archives
end after about ARCHIVE_BYTES, so that readers and writers hold one of bounded size.

Spark decides which record is a response and which a revisit; tasks write the archives to the
shared folder, under a name of their own for each attempt. Only archives that a finished task
has reported are read, so a lost executor leaves nothing behind that counts.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melder.llm.common import batches_of, new_path, written

ARCHIVE_BYTES = 16_000_000  # compressed, after which the next record opens a new archive
SAMPLE_BYTES = 2_000_000  # of records from which an archive's dictionary is trained
DICTIONARY_BYTES = 64_000
LEVEL = 3
#: The magic numbers of a skippable frame for dictionaries and of a Zstandard frame.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC headers carry it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = [(k, " ".join(str(v).split())) for k, v in fields]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or without payload a revisit of the page `refers_to`."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    rid = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest(payload))}"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url or "urn:unknown"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length disagrees with its header")
    return fields, rest[:n]


class Writer:
    """One archive: bytes of a skippable frame, then a frame for each record."""

    def __init__(self, samples: list[bytes]):
        self.out = io.BytesIO()
        self.dictionary = _train(samples)
        raw = self.dictionary.as_bytes()
        self.out.write(SKIPPABLE_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=self.dictionary)
        self.add(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]) + b"\r\n\r\n")

    def add(self, data: bytes) -> None:
        self.out.write(self.compressor.compress(data))


def _train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records. Where they are too few or too alike to train one, the end of them
    is the dictionary as it stands."""
    total = sum(map(len, samples))
    size = min(DICTIONARY_BYTES, max(64, total // 8))
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    dictionary, at = None, 0
    if int.from_bytes(archive[:4], "little") == SKIPPABLE_MAGIC:
        n = int.from_bytes(archive[4:8], "little")
        raw, at = archive[8 : 8 + n], 8 + n
        trained = raw[:4] == b"\x37\xa4\x30\xec"
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    view = memoryview(archive)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(archive):
        one = decompressor.decompressobj()
        got = [one.decompress(view[at : at + 65536])]
        at += 65536
        while not one.eof and at < len(archive):
            got.append(one.decompress(view[at : at + 65536]))
            at += 65536
        if not one.eof:
            raise ValueError("an archive ends within a record")
        at = min(at, len(archive)) - len(one.unused_data)
        yield b"".join(got)


def _store(uri: str, data: bytes) -> None:
    """Writes through the file system that the URI names, whichever it is."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path, compression=None) as out:
        out.write(data)


def _write(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[bytes] = []
        size = n = 0
        writer: Writer | None = None

        def close() -> pd.DataFrame:
            nonlocal writer, n
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            _store(path, writer.out.getvalue())
            done = pd.DataFrame({"path": [path], "n_records": [n], "n_bytes": [writer.out.tell()]})
            writer, n = None, 0
            return done

        def flush() -> None:
            nonlocal writer, n, size, waiting
            if writer is None:
                writer = Writer(waiting)
            for x in waiting:
                writer.add(x)
            n += len(waiting)
            waiting, size = [], 0

        for f in frames:
            for page, url, html, to in zip(f["page_id"], f["url"], f["html"], f["refers_to"], strict=True):
                data = record(None if pd.isna(page) else int(page), url, (html or "").encode("utf-8", "surrogatepass"), None if pd.isna(to) else int(to))
                waiting.append(data)
                size += len(data)
                if writer is not None or size >= SAMPLE_BYTES:
                    flush()
                    if writer.out.tell() >= ARCHIVE_BYTES:
                        yield close()
        if waiting:
            flush()
        if writer is not None:
            yield close()

    return run


def revisits(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with refers_to: the largest page_id with the same payload, null
    where that is the row itself. Only (digest, id) pairs meet; payloads move once, by page_id.

    A null html is an empty payload. Rows without page_id are responses. Rows that repeat the
    largest page_id are all responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    ids = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
    ids = written(ids, "digests")
    owner = ids.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    later = ids.join(owner, ["digest", "n"]).where("page_id < refers_to").select("page_id", F.col("digest").alias("d"), "refers_to").distinct()
    mine = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    mine = mine.withColumn("d", F.sha1(F.col("html").cast("binary")))
    return mine.join(later, ["page_id", "d"], "left").drop("d")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """path, n_records, n_bytes of the archives written to `folder` for pages(page_id, url, html)."""
    batches_of(pages.sparkSession, 256)
    return written(revisits(pages).mapInPandas(_write(folder), "path string, n_records long, n_bytes long"), "archives")


_SCHEMA = "archive string, error string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"


def _rows(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=[x.split()[0] for x in _SCHEMA.split(", ")])
    return f.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def _page(archive: str, one: bytes, payloads: bool) -> tuple | None:
    """A row for a response or revisit, whose payload is checked against its digest."""
    fields, block = parse(one)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != named):
        raise ValueError(f"{fields['warc-record-id']}: the payload is not the one that was written")
    page, to = (x.strip("<>").removeprefix("urn:page:") for x in (fields["warc-record-id"], fields.get("warc-refers-to", "")))
    html = payload.decode("utf-8", "surrogatepass") if payloads and kind == "response" else None
    return archive, None, int(page) if page.lstrip("-").isdigit() else None, fields["warc-target-uri"], kind, length, named, int(to) if to else None, html


def _read(payloads: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, data in zip(f["path"], f["content"], strict=True):
                name, rows = path.rsplit("/", 1)[-1], []
                try:
                    for one in records(bytes(data)):
                        row = _page(name, one, payloads)
                        if row is not None:
                            rows.append(row)
                        if len(rows) >= 256:
                            yield _rows(rows)
                            rows = []
                except (ValueError, KeyError, StopIteration, zstandard.ZstdError) as e:
                    # an archive that no finished task has reported may be cut short; its rows go below
                    rows.append((name, f"{name}: {e}", *[None] * 7))
                yield _rows(rows)

    return run


def read(spark: SparkSession, folder: str, reported: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, html of the archives in
    a folder; html is null in revisits, and everywhere without `payloads`.

    With `reported` (path of each archive that counts) any other is left out; one that counts and
    can't be read whole fails the query. A batch holds the archives of one input split.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    rows = found.select("path", "content").mapInPandas(_read(payloads), _SCHEMA)
    if reported is not None:
        rows = rows.join(reported.select(F.substring_index("path", "/", -1).alias("archive")), "archive", "left_semi")
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("record_type"))
    return rows.select("page_id", "url", sound.alias("record_type"), "payload_bytes", "payload_digest", "refers_to", "html")


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Writes pages(page_id, url, html) as archives in the shared folder and reads them again.

    An empty table writes no archive and gives an empty result. Extra columns are not read.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    done = write(pages, folder)
    if done.isEmpty():
        return spark.createDataFrame([], _SCHEMA).drop("archive", "error")
    return read(spark, folder, done, payloads)
