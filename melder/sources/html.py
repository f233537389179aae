"""JSON recovery from raw pages: scripts, state markers, preformatted text, linked data.

Pages are parsed where they are read, in Arrow batches; nothing is executed, and depth, size and
row counts are bounded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_DEPTH, MAX_ROWS = 8_388_608, 12, 20
SCHEMA = "page_id long, ok boolean, kind string, n_records int, record string, error string"


class _Blocks(HTMLParser):
    """Texts of <script> (with its type) and <pre>."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self._open: list[tuple[str, str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "pre"):
            self._open.append((tag, (dict(attrs).get("type") or "").lower(), []))

    def handle_data(self, data: str) -> None:
        if self._open:
            self._open[-1][2].append(data)

    def handle_endtag(self, tag: str) -> None:
        if self._open and self._open[-1][0] == tag:
            name, kind, text = self._open.pop()
            self.found.append((kind if name == "script" else "pre", "".join(text).strip()))


def _json(text: str) -> object | None:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def recordings(value: object, depth: int = 0) -> Iterator[dict]:
    """Linked-data records of a recording, in order, at most MAX_DEPTH deep."""
    if depth > MAX_DEPTH:
        return
    if isinstance(value, list):
        for x in value:
            yield from recordings(x, depth + 1)
    elif isinstance(value, dict):
        kind = value.get("@type")
        if kind == "MusicRecording" or isinstance(kind, list) and "MusicRecording" in kind:
            yield value
        for k in sorted(value):
            yield from recordings(value[k], depth + 1)


def property_object(text: str, name: str) -> object | None:
    """The one top-level value of `"name":` in script-like text; None for none, several or broken ones."""
    found = []
    decoder = json.JSONDecoder()
    at = text.find(f'"{name}":')
    while at != -1:
        start = at + len(name) + 3
        while start < len(text) and text[start].isspace():
            start += 1
        try:
            found.append(decoder.raw_decode(text, start)[0])
        except (ValueError, RecursionError):
            return None
        at = text.find(f'"{name}":', start)
    return found[0] if len(found) == 1 else None


def recover_one(page: str | None) -> tuple[bool, str | None, int, str | None, str | None]:
    """(ok, kind, n_records, record, error): exactly one record, or a reason why there is none."""
    body = (page or "").strip()
    if not body:
        return False, None, 0, None, "empty"
    if len(body.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        return False, None, 0, None, "too_large"
    whole = _json(body) if body[0] in "{[" else None
    if isinstance(whole, dict | list):
        if isinstance(whole, dict) and "error" in whole:
            return False, "json", 0, None, "upstream_error"
        return True, "json", 1, json.dumps(whole, sort_keys=True, ensure_ascii=False), None
    parser = _Blocks()
    parser.feed(body)
    rows: list[tuple[str, object]] = []
    for kind, text in parser.found:
        if kind == "application/ld+json":
            rows += [("schema.org", r) for r in recordings(_json(text))]
        elif kind == "application/json" or kind == "pre" and text[:1] in ("{", "["):
            value = _json(text)
            if value is not None:
                rows.append((kind, value))
        elif (song := property_object(text, "song")) is not None:
            rows.append(("state", song))
    distinct = list(dict.fromkeys((k, json.dumps(v, sort_keys=True, ensure_ascii=False)) for k, v in rows))[:MAX_ROWS]
    if not distinct:
        return False, None, 0, None, "no_data"
    if len(distinct) > 1:
        return False, distinct[0][0], len(distinct), None, "ambiguous"
    return True, distinct[0][0], 1, distinct[0][1], None


def _run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(p, *recover_one(h)) for p, h in zip(f["page_id"], f["html"], strict=True)]
        yield pd.DataFrame(rows, columns=["page_id", "ok", "kind", "n_records", "record", "error"])


def recover(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInPandas(_run, SCHEMA)
