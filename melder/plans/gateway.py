"""The JSON front end: one object names an operation and its parameters."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.operators.links import PLATFORMS

MAX_BODY = 1 << 20
# The fields that name a track, in the order in which the first one given decides.
DIRECT = ["spotify_id", "youtube_id", "deezer_id", "apple_id", "soundcloud_id", "qobuz_id", "tidal_id", "amazonmusic_id", "bugs_id", "genie_id", "melon_id", "pandora_id", "musicbrainz_id", "jiosaavn_url", "jiosaavn_id"]
TEXTS = ["url", *DIRECT, "isrc", "artist", "title", "album"]
COMMON = ["sources", "debug", "bypass_cache"]
PARAMETERS = {
    "resolve": [*TEXTS, *COMMON], "links": [*TEXTS, *COMMON], "extract": [*TEXTS, *COMMON], "search": ["q", "page", "limit", *COMMON], "albums": ["provider", "id", "limit", "debug"],
    "artists": ["provider", "id", "name", "limit", "debug"], "catalog": ["kind", "id", "limit", "debug"], "bulk": ["queries", *COMMON], "fingerprint": ["fingerprint", "duration", "debug"], "capabilities": [],
}


class BadRequest(ValueError):
    """The request can't be run; its text says why."""


def parse(body: str, default: str = "resolve") -> tuple[str, dict]:
    """(operation, parameters) of one JSON object: keys once and known, values scalar (bulk apart)."""
    if len(body.encode("utf-8", "surrogatepass")) > MAX_BODY:
        raise BadRequest("the request is too large")

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise BadRequest("a parameter occurs twice")
        return dict(pairs)

    try:
        payload = json.loads(body, object_pairs_hook=once)
    except (json.JSONDecodeError, RecursionError) as e:
        raise BadRequest("invalid JSON query") from e
    if not isinstance(payload, dict):
        raise BadRequest("the request must be one JSON object")
    operation = payload.pop("operation", default)
    if not isinstance(operation, str) or operation not in PARAMETERS:
        raise BadRequest("unknown operation")
    for k, v in payload.items():
        if k not in PARAMETERS[operation]:
            raise BadRequest(f"unknown parameter {k}")
        if isinstance(v, dict | list) and k not in ("queries", "sources") or v is None:
            raise BadRequest(f"{k} must be a scalar")
    return operation, payload


def run(body: str, operations: dict[str, Callable[..., DataFrame]]) -> DataFrame:
    """The operation's DataFrame; operations maps names to functions of the parameters."""
    operation, parameters = parse(body)
    if operation not in operations:
        raise BadRequest(f"{operation} is not available")
    return operations[operation](**parameters)


def _given(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) != ""


def validate(requests: DataFrame) -> DataFrame:
    """requests with input_type and error: an id, a link, an ISRC, or artist and title are needed; a
    link stands alone. The first id given, in the order of DIRECT, names the type."""
    has = {c: _given(c) if c in requests.columns else F.lit(False) for c in TEXTS}
    any_id = F.lit(False)
    kind = F.when(has["isrc"], "isrc").otherwise("artist_title")
    for c in reversed(DIRECT):
        any_id = any_id | has[c]
        kind = F.when(has[c], c).otherwise(kind)
    kind = F.when(has["url"], "url").otherwise(kind)
    enough = has["url"] | any_id | has["isrc"] | (has["artist"] & has["title"])
    error = F.when(~enough, "an id, a link, an ISRC, or artist and title are needed").when(has["url"] & (any_id | has["isrc"]), "a link excludes ids and ISRC")
    return requests.withColumns({"input_type": F.when(error.isNull(), kind), "error": error})


def sources(asked: list[str] | str | None, available: set[str]) -> list[str]:
    """Sorted distinct names, compared without case; known but unavailable ones are skipped."""
    names = asked.split(",") if isinstance(asked, str) else asked or PLATFORMS
    wanted = sorted({n.strip().lower() for n in names if n.strip()})
    unknown = [n for n in wanted if n not in PLATFORMS]
    if unknown:
        raise BadRequest(f"unknown source {unknown[0]}")
    return [n for n in wanted if n in available]
