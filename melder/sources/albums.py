"""Album bodies of sources to ordered, completeness-checked albums.

Each reader takes raw(album_id, body) and returns album_id, title, release_date, total, returned,
complete, reason and tracks, an array. An album is one body, so everything is decided within its row
and nothing is shuffled. A body that isn't JSON, is over eight megabytes, is of another album or has
no title yields no row. Tracks without id or title, or repeated ones, are left out and make the
album incomplete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.functions.text import unescaped
from melder.operators.albums import MOST
from melder.session import unfolded
from melder.sources.wire import bodies

TRACKS = "array<struct<track_id: string, recording_id: string, title: string, disc: int, position: int, duration_ms: bigint, isrc: string, artists: array<string>>>"
RELEASE = "id string, title string, date string, barcode string, media array<struct<position: string, title: string, format: string, `track-count`: string, tracks: array<struct<id: string, position: string, number: string, title: string, length: string, recording: struct<id: string, title: string, length: string, isrcs: array<string>>>>>>"
APPLE = "results array<struct<wrapperType: string, collectionId: string, collectionName: string, releaseDate: string, trackId: string, trackName: string, trackNumber: string, discNumber: string, trackTimeMillis: string, trackCount: string, discCount: string>>"
_SONG = "array<struct<id: string, song: string, title: string, albumid: string, duration: string, primary_artists: string, more_info: struct<duration: string, album_id: string, artistMap: struct<primary_artists: array<struct<id: string, name: string>>>>>>"
JIOSAAVN = f"id string, title string, name string, year string, release_date string, list_count string, song_count string, more_info struct<release_date: string, song_count: string>, list {_SONG}, songs {_SONG}"
DEEZER = "id string, title string, release_date string, nb_tracks string"
DEEZER_PAGE = "data array<struct<id: string, title: string, track_position: string, disk_number: string, duration: string, isrc: string, artist: struct<id: string, name: string>, album: struct<id: string>>>, `next` string"
#: Pages of an album, and entries of a page.
PAGES, PAGE = 20, 100


def _track(**parts: str) -> str:
    """SQL of one entry of TRACKS."""
    names = ["track_id", "recording_id", "title", "disc", "position", "duration_ms", "isrc", "artists"]
    return "named_struct(" + ", ".join(f"'{n}', {parts.get(n, 'null')}" for n in names) + ")"


def _kept(clash: str) -> Column:
    """The usable entries of `_all` that don't clash with a kept one before them."""
    usable = "coalesce(x.track_id, '') <> '' and coalesce(x.title, '') <> '' and x.position >= 1"
    return F.expr(f"aggregate(_all, cast(array() as {TRACKS}), (kept, x) -> if({usable} and not exists(kept, k -> {clash}), array_append(kept, x), kept))")


def _finished(albums: DataFrame, limit: int, ordered: bool = False, more: list[str] | None = None) -> DataFrame:
    """albums(album_id, title, release_date, total, valid, _kept) cut to the limit, with its verdict."""
    kept = F.array_sort("_kept", lambda a, b: F.when(a["disc"] != b["disc"], a["disc"] - b["disc"]).otherwise(a["position"] - b["position"])) if ordered else F.col("_kept")
    out = albums.withColumn("tracks", F.slice(kept, 1, limit)).withColumn("returned", F.size("tracks").cast("long"))
    whole = F.coalesce(F.col("valid") & (F.col("total") == F.col("returned")), F.lit(False))
    cut = (F.col("returned") >= limit) & F.coalesce(F.col("total") > F.col("returned"), F.lit(True))
    reason = F.when(whole, F.lit(None)).when(cut, "limit").when(F.col("total").isNotNull(), "incomplete_response").otherwise("unknown_total")
    return out.select("album_id", "title", "release_date", "total", "returned", whole.alias("complete"), reason.alias("reason"), "tracks", *(more or []))


def release(raw: DataFrame, limit: int = MOST) -> DataFrame:
    """A release's media. A track's ISRC counts only if it is the only one; the total is the sum of
    the media's, unknown if one of them is. A medium with more or fewer tracks than it declares, with
    a repeated number or a repeated place makes the album incomplete."""
    entry = _track(
        track_id="t.id", recording_id="t.recording.id", title="coalesce(nullif(t.title, ''), t.recording.title)", disc="try_cast(m.position as int)", position="try_cast(t.position as int)",
        duration_ms="coalesce(nullif(try_cast(t.length as bigint), 0), try_cast(t.recording.length as bigint), 0)", isrc="if(size(t.recording.isrcs) = 1, t.recording.isrcs[0], null)",
    )
    df = bodies(raw, RELEASE).where("b.id = album_id and coalesce(b.title, '') <> ''")
    df = df.withColumn("_all", F.expr(f"cast(flatten(transform(coalesce(b.media, array()), m -> transform(coalesce(m.tracks, array()), t -> {entry}))) as {TRACKS})"))
    df = df.withColumn("_kept", _kept("k.track_id = x.track_id"))
    counts = F.expr("transform(coalesce(b.media, array()), m -> try_cast(m.`track-count` as bigint))")
    sound = F.expr(
        "size(b.media) > 0 and forall(b.media, m -> coalesce(try_cast(m.position as int) >= 1, false) and coalesce(try_cast(m.`track-count` as bigint) = greatest(size(m.tracks), 0), true))"
        " and size(array_distinct(transform(b.media, m -> try_cast(m.position as int)))) = size(b.media)"
        " and size(_kept) = size(_all) and size(array_distinct(transform(_kept, x -> struct(x.disc, x.position)))) = size(_kept)"
    )
    total = F.when(F.expr("size(b.media) > 0") & ~F.exists(counts, lambda n: n.isNull()), F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, n: s + n))
    return _finished(df.select("album_id", F.col("b.title").alias("title"), F.col("b.date").alias("release_date"), total.alias("total"), F.coalesce(sound, F.lit(False)).alias("valid"), "_kept"), limit)


def apple(raw: DataFrame, limit: int = MOST) -> DataFrame:
    """A lookup's rows: one of them describes the album, the others are tracks. Places and ids are
    unique; each disc runs from 1 without gap to what its rows declare alike; discs run from 1 to
    the declared number. All of it is checked before the list is cut."""
    entry = _track(track_id="r.trackId", title="r.trackName", disc="try_cast(r.discNumber as int)", position="try_cast(r.trackNumber as int)", duration_ms="coalesce(try_cast(r.trackTimeMillis as bigint), 0)")
    df = bodies(raw, APPLE).withColumn("_root", F.expr("get(filter(b.results, r -> r.wrapperType = 'collection' and r.collectionId = album_id), 0)")).where("_root is not null")
    df = df.withColumn("_rows", F.expr("filter(b.results, r -> r.wrapperType = 'track')")).withColumn("_own", F.expr("filter(_rows, r -> r.collectionId = album_id)"))
    df = df.withColumn("_all", F.expr(f"cast(transform(_own, r -> {entry}) as {TRACKS})"))
    df = df.withColumn("_kept", F.filter(_kept("x.disc < 1 or x.disc is null or k.track_id = x.track_id or (k.disc = x.disc and k.position = x.position)"), lambda x: x["disc"] >= 1))
    df = df.withColumn("_discs", F.expr("array_sort(array_distinct(transform(_kept, x -> x.disc)))"))
    declared = "array_distinct(filter(transform(filter(_own, r -> try_cast(r.discNumber as int) = d), r -> try_cast(r.trackCount as bigint)), n -> n is not null))"
    sound = F.expr(
        "size(_own) = size(_rows) and size(_kept) = size(_all)"
        " and (size(_discs) = 0 or _discs = sequence(1, size(_discs)))"
        " and forall(filter(array_distinct(concat(array(try_cast(_root.discCount as bigint)), transform(_own, r -> try_cast(r.discCount as bigint)))), n -> n is not null), n -> n = size(_discs))"
        f" and forall(_discs, d -> size({declared}) <= 1 and array_max(transform(filter(_kept, x -> x.disc = d), x -> x.position)) = size(filter(_kept, x -> x.disc = d))"
        f" and coalesce(get({declared}, 0) = size(filter(_kept, x -> x.disc = d)), true))"
    )
    return _finished(
        df.select("album_id", F.col("_root.collectionName").alias("title"), F.col("_root.releaseDate").alias("release_date"), F.col("_root.trackCount").try_cast("bigint").alias("total"), F.coalesce(sound, F.lit(False)).alias("valid"), "_kept"), limit, ordered=True
    )


def jiosaavn(raw: DataFrame, limit: int = MOST) -> DataFrame:
    """Two shapes (`list` or `songs`), the total from the first of three fields that has one. A track
    that names another album, in either of two places, makes the body foreign: no row. Places are
    those of the list; titles and names lose their HTML entities; artists are the main ones."""
    df = bodies(raw, JIOSAAVN).withColumn("_title", unescaped(F.coalesce(F.nullif("b.title", F.lit("")), "b.name"))).where("b.id = album_id and coalesce(_title, '') <> ''")
    df = df.withColumn("_rows", F.expr("coalesce(b.list, b.songs, array())")).where("not exists(_rows, r -> coalesce(r.albumid, '') not in ('', album_id) or coalesce(r.more_info.album_id, '') not in ('', album_id))")
    named = F.transform("_rows", lambda r: F.struct(r["id"].alias("id"), unescaped(F.coalesce(F.nullif(r["song"], F.lit("")), r["title"])).alias("title"), F.coalesce(r["duration"], r["more_info"]["duration"]).alias("duration"), F.transform(F.coalesce(r["more_info"]["artistMap"]["primary_artists"]["name"], F.split(r["primary_artists"], ", "), F.array().cast("array<string>")), unescaped).alias("artists")))
    df = df.withColumn("_rows", named)
    entry = _track(track_id="r.id", title="r.title", disc="1", position="i + 1", duration_ms="coalesce(try_cast(r.duration as bigint), 0) * 1000", artists="r.artists")
    df = df.withColumn("_all", F.expr(f"cast(transform(_rows, (r, i) -> {entry}) as {TRACKS})"))
    df = df.withColumn("_kept", _kept("k.track_id = x.track_id"))
    total = F.coalesce(*[F.col(c).try_cast("bigint") for c in ("b.list_count", "b.more_info.song_count", "b.song_count")])
    date = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("b.more_info.release_date", "b.release_date", "b.year")])
    return _finished(df.select("album_id", F.col("_title").alias("title"), date.alias("release_date"), total.alias("total"), F.expr("size(_kept) = size(_all)").alias("valid"), "_kept"), limit)


_PAGED = "struct<id: string, title: string, disc: int, position: int, duration_ms: bigint, isrc: string, artist: string, place: int>"


def deezer(roots: DataFrame, pages: DataFrame, limit: int = MOST) -> DataFrame:
    """Albums of roots(album_id, body) whose tracks come in pages(album_id, page, body), from page 0; a
    page that couldn't be read has a null body.

    An album has PAGES pages of PAGE entries at most, so its pages are gathered and read in order: up to
    the first that is missing though more is to come, can't be read, is too long, repeats an earlier
    one or has a track of another album. What comes before that stays, with the reason upstream_error.
    Reading ends well with an empty page, with the total that the root declares, or where nothing more
    is announced. Entries without id or title and repeated ones are left out and make the album incomplete.
    """
    # filtered behind an explode: a filter on the body's fields would be pushed below and parse it for each of them
    root = unfolded(bodies(roots, DEEZER).select("album_id", F.array("b").alias("b")), ["album_id"], "b", "b").where("b.id = album_id and coalesce(b.title, '') <> ''")
    root = root.select("album_id", "b.title", "b.release_date", F.col("b.nb_tracks").try_cast("bigint").alias("total"))
    read = bodies(pages.where(F.col("page").between(0, PAGES - 1)), DEEZER_PAGE)
    row = "named_struct('id', r.id, 'title', r.title, 'disc', coalesce(try_cast(r.disk_number as int), 0), 'position', coalesce(try_cast(r.track_position as int), 0), 'duration_ms', coalesce(try_cast(r.duration as bigint), 0) * 1000, 'isrc', r.isrc, 'artist', r.artist.name, 'place', i)"
    foreign = "filter(sequence(0, size(b.data)), i -> i = size(b.data) or coalesce(get(b.data, i).album.id, '') not in ('', album_id))[0]"
    read = read.withColumn("_own", F.when(F.col("b.data").isNotNull(), F.expr(foreign)))
    entry = F.struct("page", F.expr(f"cast(transform(slice(b.data, 1, _own), (r, i) -> {row}) as array<{_PAGED}>)").alias("rows"), F.xxhash64(F.to_json("b.data")).alias("hash"), F.size("b.data").alias("n"), (F.coalesce("b.next", F.lit("")) != "").alias("more"), (F.col("_own") < F.size("b.data")).alias("foreign"))
    one = read.groupBy("album_id", "page").agg(F.min(entry).alias("e")).groupBy("album_id").agg(F.sort_array(F.collect_list("e")).alias("pages"))
    df = root.join(one, "album_id", "left").withColumn("pages", F.coalesce("pages", F.expr(f"cast(array() as array<struct<page: int, rows: array<{_PAGED}>, hash: bigint, n: int, more: boolean, foreign: boolean>>)")))
    # one step a page: the page is asked for while reading goes on and the limit isn't reached. A page that isn't there shows
    # in the next one's number or at the end; a step costs what its page holds, so an album costs what its pages hold
    usable = "size(filter(p.rows, r -> coalesce(r.id, '') <> '' and coalesce(r.title, '') <> ''))"
    bad = f"p.page <> a.at or p.n is null or p.n > {PAGE} or (p.n > 0 and array_contains(a.hashes, p.hash))"
    enough = "p.n = 0 or coalesce(a.n + p.n >= total, false) or (not p.more and (total is null or a.n + p.n >= total))"
    # an entry may come twice at different places, which its key tells apart
    made = _track(track_id="r.id", recording_id="concat(r.id, if(r.position > 0 and r.disc > 0, concat('/', r.disc, '/', r.position), ''))", title="r.title", disc="r.disc", position="if(r.position > 0, r.position, a.n + r.place + 1)", duration_ms="r.duration_ms", isrc="nullif(r.isrc, '')", artists="if(coalesce(r.artist, '') <> '', array(r.artist), cast(array() as array<string>))")
    placed = f"cast(transform(p.rows, r -> {made}) as {TRACKS})"
    taken = f"named_struct('at', a.at + 1, 'n', a.n + p.n, 'usable', a.usable + {usable}, 'hashes', array_append(a.hashes, p.hash), 'rows', concat(a.rows, {placed}), 'done', p.foreign or {enough}, 'failed', p.foreign)"
    broken = "named_struct('at', a.at, 'n', a.n, 'usable', a.usable, 'hashes', a.hashes, 'rows', a.rows, 'done', true, 'failed', true)"
    step = f"case when a.done or a.usable >= {limit} then a when {bad} then {broken} else {taken} end"
    start = f"named_struct('at', 0, 'n', 0, 'usable', 0, 'hashes', cast(array() as array<bigint>), 'rows', cast(array() as {TRACKS}), 'done', false, 'failed', false)"
    end = f"a -> named_struct('rows', a.rows, 'failed', a.failed or (not a.done and a.usable < {limit} and a.at < {PAGES}))"
    df = df.withColumn("_read", F.expr(f"aggregate(pages, {start}, (a, p) -> {step}, {end})"))
    df = df.withColumn("_all", F.col("_read.rows"))
    df = df.withColumn("_kept", _kept("k.recording_id = x.recording_id"))
    df = df.withColumn("_kept", F.transform("_kept", lambda x: x.withField("recording_id", F.lit(None).cast("string"))))
    out = _finished(df.select("album_id", "title", "release_date", "total", (F.expr("size(_kept) = size(_all)") & ~F.col("_read.failed")).alias("valid"), "_kept", F.col("_read.failed").alias("failed")), limit, more=["failed"])
    return out.withColumn("reason", F.when(F.col("failed"), "upstream_error").otherwise(F.col("reason"))).drop("failed")


def on_release(tracks: DataFrame, releases: DataFrame) -> DataFrame:
    """tracks(album_id, recording_id, album, ...) whose release has that id, the same title but for
    case and blanks, and the recording on one of its media."""
    there = releases.select("album_id", F.lower(F.trim("title")).alias("_t"), F.explode("tracks.recording_id").alias("recording_id")).where("coalesce(recording_id, '') <> ''")
    return tracks.join(there.withColumnsRenamed({"album_id": "_i", "recording_id": "_r"}), (F.col("album_id") == F.col("_i")) & (F.col("recording_id") == F.col("_r")) & (F.lower(F.trim("album")) == F.col("_t")), "left_semi")
