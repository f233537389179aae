"""Stable ids, confidence, identity status and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.functions.text import clean_artist, clean_title, round2

# How far each source's identity is trusted; any other source has DEFAULT_TRUST.
TRUST = {
    "musicbrainz": 1.0, "isrc": 1.0, "applemusic": 0.95, "spotify": 0.95, "deezer": 0.9, "tidal": 0.9, "qobuz": 0.88, "amazonmusic": 0.88,
    "jiosaavn": 0.85, "bugs": 0.85, "genie": 0.85, "melon": 0.85, "ytmusic": 0.8, "pandora": 0.8, "soundcloud": 0.75,
}
DEFAULT_TRUST = 0.85
# What each field adds to completeness.
WEIGHTS = {
    "title": 0.12, "artists": 0.12, "isrc": 0.12, "album": 0.08, "duration_ms": 0.08, "images": 0.08, "genres": 0.07, "credits": 0.07,
    "release_date": 0.05, "preview_url": 0.05, "label": 0.04, "track_number": 0.03, "copyrights": 0.03, "iswc": 0.03, "play_count": 0.03,
}


def _text(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit(""))


def canonical_id(title: str, artist: str, isrc: str, mbid: str, ids: str | None = None, prefix: str = "track_") -> Column:
    """prefix and 16 hexadecimal digits of a SHA-256 of the best key there is: cleaned title and
    first artist, else ISRC, else MusicBrainz id, else the sorted own ids, else the raw title."""

    def cleaned(c: str, clean) -> Column:
        x = clean(F.coalesce(F.col(c), F.lit("")))
        return F.when(x != "", x).otherwise(F.lower(_text(c)))

    t, a = cleaned(title, clean_title), cleaned(artist, clean_artist)
    key = F.when((t != "") & (a != ""), F.concat(F.lit("meta:"), t, F.lit("|"), a)).when(_text(isrc) != "", F.concat(F.lit("isrc:"), F.upper(_text(isrc)))).when(_text(mbid) != "", F.concat(F.lit("mbid:"), _text(mbid)))
    if ids is not None:
        own = F.filter(F.map_entries(ids), lambda e: (e["value"] != "") & ~e["key"].endswith("_url") & ~e["key"].endswith("_track_id"))
        pairs = F.array_sort(F.transform(own, lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
        key = key.when(F.size(pairs) > 0, F.concat(F.lit("ids:"), F.array_join(pairs, "|")))
    key = key.otherwise(F.concat(F.lit("raw:"), F.coalesce(F.col(title), F.lit(""))))
    return F.concat(F.lit(prefix), F.substring(F.sha2(key.cast("binary"), 256), 1, 16))


def trust(provider: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv]), F.lower(provider)), F.lit(DEFAULT_TRUST))


def identity_confidence(provider: Column, score: Column) -> Column:
    return round2(score * trust(provider))


def confidence_level(score: Column, isrc_votes: Column) -> Column:
    return F.when(isrc_votes >= 2, "verified").when(score >= 0.95, "exact").when(score >= 0.85, "high").when(score >= 0.70, "medium").otherwise("low")


def identity_status(score: Column, isrc_votes: Column, has_mbid: Column, has_isrc: Column) -> Column:
    return F.when(score < 0.75, "weak").when(score < 0.85, "probable").when((isrc_votes >= 2) | (has_mbid & has_isrc), "verified").when(score >= 0.90, "strong").otherwise("probable")


def identity_reasons(score: Column, isrc_votes: Column, has_mbid: Column, has_isrc: Column) -> Column:
    named = [(has_isrc, "isrc_match"), (has_mbid, "musicbrainz_match"), (score >= 0.90, "exact_title_artist_match"), (isrc_votes >= 2, "multi_provider_isrc_consensus")]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in named]), lambda x: x.isNotNull())


def completeness(rows: DataFrame) -> Column:
    """Sum of the weights of the fields that rows has and fills, at most 1."""
    total = F.lit(0.0)
    kinds = dict(rows.dtypes)
    for field, weight in WEIGHTS.items():
        if field not in kinds:
            continue
        kind, c = kinds[field], F.col(field)
        filled = F.size(c) > 0 if kind.startswith(("array", "map")) else c > 0 if kind in ("int", "bigint", "double") else F.trim(c) != ""
        total = total + F.when(F.coalesce(filled, F.lit(False)), weight).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def identity_method(direct: Column, isrc_equal: Column, duration_ms: Column) -> Column:
    return F.when(direct, "direct_id").when(isrc_equal, "isrc").when(duration_ms > 0, "title_artist_duration").otherwise("exact_title_artist")


def query_hash(sources: Column, *parts: Column) -> Column:
    """SHA-256 of the sorted distinct lower-cased sources and the request's fields as JSON."""
    names = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.lower(F.trim(s)))))
    return F.sha2(F.concat(F.array_join(names, ","), F.lit("\n"), F.to_json(F.struct(*parts))).cast("binary"), 256)
