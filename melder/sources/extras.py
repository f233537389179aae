"""Artwork, fingerprint lookups, artists' tracks and catalogue requests: landed bodies to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melder.sources.wire import bodies

ARTWORK = "release string, images array<struct<image: string, front: boolean, back: boolean, thumbnails: map<string, string>>>"
LOOKUP = "status string, results array<struct<id: string, score: double, recordings: array<struct<id: string, title: string>>>>"
# The kinds of catalogue requests with the form of their ids.
CATALOGUE = {
    "artist_albums": r"^UC[A-Za-z0-9_-]{20,30}$",
    "artist_singles": r"^UC[A-Za-z0-9_-]{20,30}$",
    "song": r"^[A-Za-z0-9_-]{11}$",
    "credits": r"^MPTC[A-Za-z0-9_-]{11}$",
    "album": r"^MPRE[A-Za-z0-9_-]{1,150}$",
    "artist": r"^UC[A-Za-z0-9_-]{20,30}$",
    "playlist": r"^(OLAK5uy_|PL|RD)[A-Za-z0-9_-]{5,150}$",
}
MBID = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
#: Fields of an artist's tracks by source: id, title, album, duration and the factor to milliseconds.
ARTIST_TRACKS = {
    "deezer": ("id: string, title: string, duration: string, artist: struct<name: string>, album: struct<title: string>", "id", "title", "album.title", "duration", 1000, "array(artist.name)"),
    "applemusic": ("trackId: string, trackName: string, collectionName: string, artistName: string, trackTimeMillis: string", "trackId", "trackName", "collectionName", "trackTimeMillis", 1, "array(artistName)"),
    "musicbrainz": ("id: string, title: string, length: string, `artist-credit`: array<struct<name: string>>", "id", "title", "cast(null as string)", "length", 1, "`artist-credit`.name"),
    "jiosaavn": (
        "id: string, title: string, song: string, album: string, duration: string, more_info: struct<album: string, duration: string, artistMap: struct<primary_artists: array<struct<name: string>>>>",
        "id", "coalesce(nullif(title, ''), song)", "coalesce(nullif(more_info.album, ''), album)", "coalesce(nullif(try_cast(more_info.duration as bigint), 0), try_cast(duration as bigint))", 1000, "more_info.artistMap.primary_artists.name",
    ),
    "ytmusic": ("videoId: string, title: string, duration_seconds: string, album: struct<name: string>, artists: array<struct<name: string>>", "videoId", "title", "album.name", "duration_seconds", 1000, "artists.name"),
}


def art_url(c: Column) -> Column:
    """https addresses; http ones of the archive's hosts become https, others have none."""
    own = r"^(?i:http)://((coverartarchive\.org|archive\.org|[^/?#@:]+\.archive\.org)([/?#].*)?)$"
    safe = F.when(c.rlike(own), F.regexp_replace(c, own, "https://$1")).otherwise(c)
    return F.when(safe.rlike(r"^(?i:https)://[^/?#@\s]+([/?#]|$)"), safe)


def artwork(raw: DataFrame) -> DataFrame:
    """album_id, place, url, type of raw(album_id, body): each image of the release asked for, then its
    thumbnails by the name of their size. Ids that aren't MBIDs and foreign releases have none."""
    df = bodies(raw, ARTWORK).where(F.col("album_id").rlike(MBID) & F.col("b.release").rlike("^https?://musicbrainz[.]org/release/") & (F.substring_index("b.release", "/", -1) == F.col("album_id")))
    kind = "case when i.front then 'cover' when i.back then 'back' else 'artwork' end"
    one = f"concat(array(named_struct('url', i.image, 'type', {kind})), transform(array_sort(map_keys(coalesce(i.thumbnails, map()))), s -> named_struct('url', i.thumbnails[s], 'type', 'thumbnail')))"
    every = df.select("album_id", F.expr(f"flatten(transform(b.images, i -> {one}))").alias("e"))
    found = F.filter(F.transform("e", lambda x: F.struct(art_url(x["url"]).alias("url"), x["type"].alias("type"))), lambda x: x["url"].isNotNull())
    return every.select("album_id", F.posexplode(found).alias("i", "x")).select("album_id", (F.col("i") + 1).cast("long").alias("place"), "x.url", "x.type")


def fingerprint_matches(asked: DataFrame, landed: DataFrame) -> DataFrame:
    """query_id, acoustid, score, recording_id: all candidates of asked(query_id, fingerprint, duration)
    in landed(fingerprint, duration, body). None is selected: sound alone doesn't tell editions apart."""
    valid = asked.where("length(fingerprint) between 1 and 65536 and duration between 1 and 86400")
    ok = bodies(landed, LOOKUP).where("b.status = 'ok'").select("fingerprint", "duration", F.explode("b.results").alias("r"))
    return valid.join(ok, ["fingerprint", "duration"]).select("query_id", F.col("r.id").alias("acoustid"), "r.score", F.explode_outer("r.recordings.id").alias("recording_id"))


def artist_tracks(raw: DataFrame, provider: str, limit: int = 20) -> DataFrame:
    """artist_id, place, id, title, album, duration_ms, artists of raw(artist_id, body), whose body is
    the source's array of tracks: with id and title, the first of each id, the first `limit` (1 to 50)."""
    if not 1 <= limit <= 50:
        raise ValueError("a limit is between 1 and 50")
    schema, id_, title, album, duration, factor, names = ARTIST_TRACKS[provider]
    rows = bodies(raw, f"array<struct<{schema}>>").select("artist_id", F.posexplode("b").alias("i", "r")).select("artist_id", "i", "r.*")
    shown = rows.selectExpr("artist_id", "i", f"{id_} as id", f"{title} as title", f"{album} as album", f"coalesce(try_cast({duration} as bigint), 0) * {factor} as duration_ms", f"filter({names}, n -> coalesce(n, '') <> '') as artists")
    there = shown.where("coalesce(id, '') <> '' and coalesce(title, '') <> ''")
    one = there.groupBy("artist_id", "id").agg(F.min_by(F.struct("i", "title", "album", "duration_ms", "artists"), "i").alias("t")).select("artist_id", "id", "t.*")
    place = F.row_number().over(Window.partitionBy("artist_id").orderBy("i")).cast("long")
    return one.withColumn("place", place).where(F.col("place") <= limit).select("artist_id", "place", "id", "title", "album", "duration_ms", "artists")


def catalogue_requests(requests: DataFrame) -> DataFrame:
    """requests(provider, kind, id, limit) with error (null if sound) and limit, 20 if none is given."""
    fits = F.lit(False)
    for kind, form in CATALOGUE.items():
        fits = fits | ((F.col("kind") == kind) & F.col("id").rlike(form))
    n = F.col("limit").try_cast("int")
    error = (
        F.when(~F.coalesce(F.col("provider") == "ytmusic", F.lit(False)), "unsupported provider")
        .when(~F.coalesce(fits, F.lit(False)), "invalid type or id")
        .when(F.col("limit").isNotNull() & ~F.coalesce(n.between(1, 100), F.lit(False)), "limit must be between 1 and 100")
    )
    return requests.withColumns({"error": error, "limit": F.when(F.col("limit").isNull(), 20).otherwise(n)})
