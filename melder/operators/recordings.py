"""Nodes and edges of nested recording records, which hold releases, works, artists and each other."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melder.functions.text import RELATIONSHIPS, ROLES

DEPTH = 4
# Roles in which a relationship to an artist is a credit.
CREDIT_ROLES = [
    "composer", "lyricist", "writer", "librettist", "producer", "co-producer", "executive producer", "engineer", "audio", "sound", "mix", "mastering", "recording", "balance", "programming", "editor", "performer", "instrument", "vocal", "arranger",
    "instrument arranger", "vocal arranger", "orchestrator", "conductor", "chorus master", "concertmaster", "remixer", "translator", "artwork", "design", "photography", "graphic design", "illustration", "liner notes",
]
RELATED = {"artist": "artist", "recording": "recording", "release": "release", "release-group": "release_group", "work": "work", "label": "label"}
SCHEMA = "root string, truncated boolean, nodes array<struct<id: string, type: string, name: string>>, edges array<struct<source: string, target: string, type: string, role: string>>"


def _id(kind: str, record: dict) -> str | None:
    native = record.get("id")
    return f"musicbrainz:{kind}:{native}" if isinstance(native, str) and native else None


def _objects(record: dict, key: str) -> Iterator[dict]:
    value = record.get(key)
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, dict):
            yield x


def _related(node: str, record: dict) -> Iterator[tuple[str, dict, str, str | None, bool]]:
    """(kind, record, edge type, role, reversed) of what a record is related to by name."""
    for r in _objects(record, "relations"):
        raw = r.get("type")
        if not isinstance(raw, str) or not raw:
            continue
        way = r.get("direction")
        for key, kind in RELATED.items():
            for target in _objects(r, key):
                if key == "artist" and raw.lower() in CREDIT_ROLES:
                    yield kind, target, "credit", ROLES.get(raw.lower(), raw.lower().replace(" ", "_")), True
                else:
                    known = RELATIONSHIPS.get(raw.lower(), "relationship") if way in ("forward", "backward") else "relationship"
                    yield kind, target, known, None, way == "backward"


def flatten(kind: str, record: dict) -> tuple[list[tuple], list[tuple], bool]:
    """(nodes, edges, truncated), breadth first, DEPTH levels below the root."""
    nodes: dict[str, tuple] = {}
    edges: dict[tuple, None] = {}
    truncated = False
    waiting = deque([(kind, record, 0)])

    def join(a: str, b: str | None, name: str, role: str | None = None) -> None:
        if b is not None and a != b:
            edges[(a, b, name, role)] = None

    while waiting:
        kind, now, depth = waiting.popleft()
        node = _id(kind, now)
        if node is None:
            continue
        known = nodes.get(node)
        name = now.get("title") or now.get("name") or ""
        nodes[node] = (node, kind, known[2] if known and known[2] else name)
        below: list[tuple[str, dict, str, str | None, bool]] = []
        below += [("release_group", g, "edition_of", None, False) for g in _objects(now, "release-group")]
        below += [("release", r, "appears_on", None, False) for r in _objects(now, "releases")]
        below += [("label", x["label"], "released_by", None, False) for x in _objects(now, "label-info") if isinstance(x.get("label"), dict)]
        below += [("artist", x["artist"], "credit", "primary_artist", True) for x in _objects(now, "artist-credit") if isinstance(x.get("artist"), dict)]
        below += _related(node, now)
        for child_kind, child, edge, role, back in below:
            target = _id(child_kind, child)
            if target is None:
                continue
            if depth == DEPTH:
                truncated = True
                continue
            join(*((target, node) if back else (node, target)), edge, role)
            waiting.append((child_kind, child, depth + 1))
    return list(nodes.values()), list(edges), truncated


def _run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for root, kind, body in zip(f["root"], f["kind"], f["body"], strict=True):
            try:
                record = json.loads(body or "null")
            except (ValueError, RecursionError):
                record = None
            nodes, edges, cut = flatten(kind, record) if isinstance(record, dict) else ([], [], False)
            out.append((root, cut, [dict(zip(("id", "type", "name"), n, strict=True)) for n in nodes], [dict(zip(("source", "target", "type", "role"), e, strict=True)) for e in edges]))
        yield pd.DataFrame(out, columns=["root", "truncated", "nodes", "edges"])


def recording_graph(records: DataFrame) -> DataFrame:
    """root, truncated, nodes, edges of records(root, kind, body): one graph for each record."""
    return records.select(F.col("root").cast("string").alias("root"), "kind", "body").mapInPandas(_run, SCHEMA)
