"""Source records (JSON text) to canonical candidate rows: explicit wire schemas, columns only.

Each reader takes raw(query_id, body) and returns COLUMNS. A body that isn't JSON, is over eight
megabytes, or whose identity disagrees with the request yields no row. Numbers that may come as
text are read as text and cast with try_cast, so large ids never pass through a double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.functions.text import clean_artist, iso_duration_ms, large_image

COLUMNS = ["query_id", "provider", "rank", "native_id", "title", "artist", "album", "duration_ms", "isrc", "release_date", "explicit_status", "label", "genre", "image_url", "track_number", "disc_number", "initial_score"]
MAX_BODY = 8_388_608
TEXT = "string"

APPLE = "resultCount int, results array<struct<wrapperType string, kind string, artistId string, collectionId string, trackId string, artistName string, collectionName string, trackName string, artworkUrl100 string, releaseDate string, trackExplicitness string, primaryGenreName string, isrc string, trackTimeMillis string, trackNumber string, discNumber string>>"
DEEZER = "data array<struct<id string, title string, isrc string, duration string, track_position string, disk_number string, label string, explicit_lyrics string, release_date string, artist struct<id: string, name: string>, album struct<id: string, title: string, cover_xl: string, label: string>, contributors array<struct<id: string, name: string>>>>"
SPOTIFY = "tracks struct<items: array<struct<id: string, name: string, artists: array<struct<id: string, name: string>>, album: struct<id: string, name: string, release_date: string, label: string, images: array<struct<url: string, width: int, height: int>>>, duration_ms: string, explicit: string, external_ids: struct<isrc: string>, track_number: string, disc_number: string>>>"
MUSICBRAINZ = "recordings array<struct<id: string, score: string, title: string, length: string, isrcs: array<string>, `artist-credit`: array<struct<name: string, artist: struct<id: string, name: string>>>, releases: array<struct<id: string, title: string, date: string>>, tags: array<struct<count: int, name: string>>>>"
JIOSAAVN = "results array<struct<id: string, title: string, song: string, album: string, year: string, primary_artists: string, singers: string, music: string, image: string, label: string, duration: string, explicit_content: string, release_date: string, more_info: struct<album: string, duration: string, label: string, music: string, release_date: string>>>"


def bodies(raw: DataFrame, schema: str) -> DataFrame:
    """raw with `b`, its body under the schema; null for broken or oversized ones."""
    return raw.withColumn("b", F.when(F.octet_length("body") <= MAX_BODY, F.from_json("body", schema)))


def rows(raw: DataFrame, schema: str, items: str) -> DataFrame:
    """query_id, rank, r: one row for each item of a body's array, in order."""
    return bodies(raw, schema).select("query_id", F.posexplode(F.col(f"b.{items}")).alias("i", "r")).select("query_id", (F.col("i") + 1).alias("rank"), "r")


def _long(c: Column) -> Column:
    return c.try_cast("bigint")


def _int(c: Column) -> Column:
    return F.nullif(c.try_cast("int"), F.lit(0))


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def explicit(c: Column) -> Column:
    """Three-valued: explicit, clean, or unknown; a plain false says nothing."""
    low = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(low.isin("true", "1", "explicit"), "explicit").when(low.isin("notexplicit", "clean", "cleaned"), "clean").otherwise("unknown")


def _canonical(df: DataFrame, provider: str, limit: int, **c: Column) -> DataFrame:
    made = {k: c.get(k, F.lit(None)) for k in COLUMNS[3:]}
    kinds = {"duration_ms": "bigint", "track_number": "int", "disc_number": "int", "initial_score": "double"}
    out = df.select("query_id", F.lit(provider).alias("provider"), F.col("rank").cast("int").alias("rank"), *[v.cast(kinds.get(k, TEXT)).alias(k) for k, v in made.items()])
    return out.where((F.col("rank") <= limit) & F.col("native_id").isNotNull())


def apple(raw: DataFrame, asked_isrc: Column | None = None) -> DataFrame:
    """Song rows only; dates cut to a day; large artwork; an asked ISRC must be equal."""
    df = rows(raw, APPLE, "results").where("r.kind = 'song'")
    if asked_isrc is not None:
        df = df.where(F.upper(F.trim("r.isrc")) == F.upper(F.trim(asked_isrc)))
    return _canonical(
        df, "applemusic", 5, native_id=F.col("r.trackId"), title=_some(F.col("r.trackName")), artist=_some(F.col("r.artistName")), album=_some(F.col("r.collectionName")), duration_ms=_long(F.col("r.trackTimeMillis")), isrc=_some(F.col("r.isrc")),
        release_date=F.left(F.col("r.releaseDate"), F.lit(10)), explicit_status=explicit(F.col("r.trackExplicitness")), genre=F.col("r.primaryGenreName"), image_url=F.replace(F.col("r.artworkUrl100"), F.lit("100x100"), F.lit("600x600")),
        track_number=_int(F.col("r.trackNumber")), disc_number=_int(F.col("r.discNumber")), initial_score=F.lit(0.9),
    )


def deezer(raw: DataFrame, asked_artist: str | None = None) -> DataFrame:
    """A text search keeps rows whose artist or a contributor is the asked one; seconds to ms."""
    df = rows(raw, DEEZER, "data")
    if asked_artist is not None:
        want = clean_artist(F.lit(asked_artist))
        df = df.where((clean_artist(F.col("r.artist.name")) == want) | F.coalesce(F.exists("r.contributors", lambda c: clean_artist(c["name"]) == want), F.lit(False)))
    return _canonical(
        df, "deezer", 5, native_id=F.col("r.id"), title=_some(F.col("r.title")), artist=_some(F.col("r.artist.name")), album=_some(F.col("r.album.title")), duration_ms=_long(F.col("r.duration")) * 1000, isrc=_some(F.col("r.isrc")),
        release_date=_some(F.col("r.release_date")), explicit_status=explicit(F.col("r.explicit_lyrics")), label=F.coalesce(_some(F.col("r.label")), _some(F.col("r.album.label"))), image_url=F.col("r.album.cover_xl"),
        track_number=_int(F.col("r.track_position")), disc_number=_int(F.col("r.disk_number")), initial_score=F.lit(0.9 if asked_artist else 1.0),
    )


def spotify(raw: DataFrame) -> DataFrame:
    best = F.expr("array_max(transform(r.album.images, x -> struct(x.width * x.height as area, x.url as url))).url")
    return _canonical(
        rows(raw, SPOTIFY, "tracks.items"), "spotify", 10, native_id=F.col("r.id"), title=_some(F.col("r.name")), artist=F.get("r.artists", F.lit(0))["name"], album=_some(F.col("r.album.name")), duration_ms=_long(F.col("r.duration_ms")),
        isrc=_some(F.col("r.external_ids.isrc")), release_date=_some(F.col("r.album.release_date")), explicit_status=explicit(F.col("r.explicit")), label=_some(F.col("r.album.label")), image_url=best,
        track_number=_int(F.col("r.track_number")), disc_number=_int(F.col("r.disc_number")), initial_score=F.lit(0.9),
    )


def musicbrainz(raw: DataFrame) -> DataFrame:
    """The first release is the album; tags with votes are genres; score over 100."""
    first = F.get("r.releases", F.lit(0))
    genre = F.expr("get(transform(filter(r.tags, t -> t.count > 0), t -> t.name), 0)")
    return _canonical(
        rows(raw, MUSICBRAINZ, "recordings"), "musicbrainz", 5, native_id=F.lower("r.id"), title=_some(F.col("r.title")), artist=F.get("r.artist-credit", F.lit(0))["name"], album=first["title"], duration_ms=_long(F.col("r.length")),
        isrc=F.get("r.isrcs", F.lit(0)), release_date=first["date"], explicit_status=F.lit("unknown"), genre=genre, initial_score=F.col("r.score").try_cast("double") / 100,
    )


def jiosaavn(raw: DataFrame) -> DataFrame:
    """Flat fields win, nested ones fill gaps; the artist comes from the first list that has one."""
    flat = lambda a, b: F.coalesce(_some(F.col(f"r.{a}")), _some(F.col(f"r.more_info.{b}")))
    artist = F.coalesce(_some(F.col("r.primary_artists")), _some(F.col("r.singers")), flat("music", "music"), F.lit("Unknown Artist"))
    return _canonical(
        rows(raw, JIOSAAVN, "results"), "jiosaavn", 20, native_id=_some(F.col("r.id")), title=F.coalesce(_some(F.col("r.title")), _some(F.col("r.song"))), artist=artist, album=flat("album", "album"), duration_ms=_long(flat("duration", "duration")) * 1000,
        release_date=F.coalesce(flat("release_date", "release_date"), _some(F.col("r.year"))), explicit_status=explicit(F.when(F.col("r.explicit_content") == "1", "explicit")), label=flat("label", "label"), image_url=large_image(F.col("r.image")), initial_score=F.lit(0.9),
    )


#: Names under which catalogues keep the same field.
ALIASES = {
    "native_id": ["id", "trackId", "asin"], "title": ["title", "name", "trackName"], "artist": ["artist.name", "performer.name", "artistName", "artists[0].name"], "album": ["album.title", "album.name", "albumTitle"],
    "isrc": ["isrc", "ISRC"], "release_date": ["releaseDate", "release_date", "album.releaseDate"], "label": ["label.name", "label", "album.label.name"], "duration": ["duration", "durationSeconds"],
}


def catalogue(raw: DataFrame, provider: str, asked_id: str | None = None) -> DataFrame:
    """Any catalogue whose records use one of the ALIASES: the first path that holds something wins.
    A record with another id than the asked one is no answer."""

    def path(p: str) -> Column:
        return _some(F.get_json_object("body", "$." + p))

    field = {k: F.coalesce(*[path(p) for p in v]) for k, v in ALIASES.items()}
    seconds = field["duration"].try_cast("double")
    ms = F.when(seconds.isNotNull(), F.when((seconds > 0) & (seconds <= 86400), F.round(seconds * 1000))).otherwise(F.nullif(iso_duration_ms(field["duration"]), F.lit(0)))
    df = raw.where(F.octet_length("body") <= MAX_BODY).withColumn("rank", F.lit(1))
    if asked_id is not None:
        df = df.where(field["native_id"] == asked_id)
    return _canonical(df, provider, 10, native_id=field["native_id"], title=field["title"], artist=field["artist"], album=field["album"], duration_ms=ms, isrc=field["isrc"], release_date=field["release_date"], label=field["label"], explicit_status=explicit(F.coalesce(path("explicit"), path("contentRating"))), initial_score=F.lit(1.0 if asked_id else 0.75))


def link_included(raw: DataFrame) -> DataFrame:
    """query_id, relation, type, id, attributes: a JSON:API document's relationships joined with its
    included resources on (type, id)."""
    schema = "data struct<id: string, type: string, relationships: map<string, struct<data: array<struct<id: string, type: string>>>>>, included array<struct<id: string, type: string, attributes: map<string, string>>>"
    b = bodies(raw, schema)
    refs = b.select("query_id", F.explode("b.data.relationships").alias("relation", "x")).select("query_id", "relation", F.explode("x.data").alias("ref")).select("query_id", "relation", "ref.type", "ref.id")
    found = b.select("query_id", F.explode("b.included").alias("x")).select("query_id", "x.type", "x.id", "x.attributes")
    return refs.join(found, ["query_id", "type", "id"])


#: Labels of fields on pages of Korean catalogues.
KOREAN_CREDITS = {"작사": "lyricist", "작사가": "lyricist", "작곡": "composer", "작곡가": "composer", "편곡": "arranger"}
KOREAN = "id string, title string, artists array<struct<id: string, name: string>>, album_id string, album string, image string, duration_ms string, release_date string, isrc string, fields map<string, string>"


def korean(raw: DataFrame, provider: str) -> DataFrame:
    """Records read from pages: labelled fields fill genre, date and label."""
    df = bodies(raw, KOREAN).select("query_id", F.lit(1).alias("rank"), F.col("b").alias("r"))
    field = lambda *names: F.coalesce(*[_some(F.try_element_at("r.fields", F.lit(n))) for n in names])
    date = F.coalesce(_some(F.col("r.release_date")), F.replace(field("발매일", "발매"), F.lit("."), F.lit("-")))
    return _canonical(
        df, provider, 10, native_id=_some(F.col("r.id")), title=_some(F.col("r.title")), artist=F.get("r.artists", F.lit(0))["name"], album=_some(F.col("r.album")), duration_ms=_long(F.col("r.duration_ms")), isrc=_some(F.col("r.isrc")),
        release_date=date, explicit_status=F.lit("unknown"), label=field("기획사", "제작사"), genre=field("장르"), image_url=_some(F.col("r.image")), initial_score=F.lit(0.9),
    )


def korean_credits(raw: DataFrame) -> DataFrame:
    """query_id, name, role from the labelled fields that hold comma-separated names."""
    roles = F.create_map(*[F.lit(x) for kv in KOREAN_CREDITS.items() for x in kv])
    f = bodies(raw, KOREAN).select("query_id", F.explode("b.fields").alias("k", "v")).withColumn("role", F.try_element_at(roles, F.col("k"))).where("role is not null")
    return f.select("query_id", F.explode(F.split("v", ",")).alias("name"), "role").select("query_id", F.trim("name").alias("name"), "role").where("name <> ''")


SOUNDCLOUD = "title string, author_name string, author_url string, thumbnail_url string, html string"


def soundcloud(raw: DataFrame) -> DataFrame:
    """A looked-up track; its native id comes from the player's frame alone. 'T by A' gives way to the
    author's name."""
    df = bodies(raw, SOUNDCLOUD).select("query_id", F.lit(1).alias("rank"), F.col("b").alias("r"))
    frame = F.try_url_decode(F.regexp_extract("r.html", r"src=.([^\x22\x27]+)", 1))
    native = _some(F.regexp_extract(frame, r"api\.soundcloud\.com/tracks/(?:soundcloud:tracks:)?([0-9]+)", 1))
    title = F.regexp_replace(F.col("r.title"), r"\s+by\s+[^\n]*$", "")
    return _canonical(df, "soundcloud", 1, native_id=native, title=_some(title), artist=_some(F.col("r.author_name")), image_url=F.col("r.thumbnail_url"), explicit_status=F.lit("unknown"), initial_score=F.lit(1.0))


READERS: dict[str, Callable[..., DataFrame]] = {"applemusic": apple, "deezer": deezer, "spotify": spotify, "musicbrainz": musicbrainz, "jiosaavn": jiosaavn, "soundcloud": soundcloud}


def read_all(raw: DataFrame) -> DataFrame:
    """Candidates of raw(query_id, provider, body) for every known source: a bag union of one pruned
    scan for each source."""
    parts = [f(raw.where(F.col("provider") == p).select("query_id", "body")) for p, f in READERS.items()]
    parts += [catalogue(raw.where(F.col("provider") == p).select("query_id", "body"), p) for p in ("qobuz", "tidal", "amazonmusic", "pandora")]
    parts += [korean(raw.where(F.col("provider") == p).select("query_id", "body"), p) for p in ("bugs", "genie", "melon")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
