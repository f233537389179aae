"""Queries of readers of albums, artwork, fingerprints and artists' tracks: bodies are made of the driver's orders, expectations of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melder.operators import fusion
from melder.plans import projection as P
from melder.queries import _B, _best, query
from melder.session import table
from melder.sources import albums, extras

_LINES = "SELECT l_orderkey AS o, l_linenumber AS line, min(l_suppkey) AS supp, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber"
#: Some tracks lack a title, line 7 repeats the id of line 1, some albums declare one track more.
_ENTRIES = f"""SELECT CAST(o AS STRING) AS album_id, CAST(1 + supp % 2 AS INT) AS disc, row_number() OVER (PARTITION BY o, supp % 2 ORDER BY line) AS position,
  CAST(o AS STRING) || '-' || CAST(CASE WHEN line = 7 THEN 1 ELSE line END AS STRING) AS track_id, CASE WHEN part % 97 <> 0 THEN 'Song ' || CAST(part AS STRING) END AS title,
  CAST(part AS STRING) AS recording_id, supp % 3 AS codes, CASE WHEN o % 5 = 0 THEN 1 ELSE 0 END AS more, line FROM ({_LINES}) l"""
_MARKED = f"""SELECT *, title IS NOT NULL AND row_number() OVER (PARTITION BY album_id, track_id, title IS NULL ORDER BY {{}}) = 1 AS kept FROM ({_ENTRIES}) e"""


def _verdict(order: str, sound: str, extra: str = "") -> str:
    """DuckDB's statement of a reader's verdict; every album is declared to hold its rows and `more`."""
    return f"""SELECT album_id, n + more AS total, returned, sound AND more = 0 AND returned = n AS complete, CASE WHEN NOT (sound AND more = 0 AND returned = n) THEN 'incomplete_response' END AS reason{', ' + extra if extra else ''}
FROM (SELECT album_id, count(*) AS n, max(more) AS more, count(*) FILTER (WHERE kept) AS returned, {sound} AS sound, count(*) FILTER (WHERE kept AND codes = 1) AS n_isrc FROM ({_MARKED.format(order)}) m GROUP BY album_id) x"""


def _releases(spark: SparkSession, sf: str) -> DataFrame:
    e = P.view(spark, sf, _ENTRIES)
    isrcs = F.expr("transform(filter(sequence(0, 2), i -> i < codes), i -> concat('USABC000000', i))")
    track = F.struct(F.col("position"), F.col("track_id").alias("id"), "title", F.struct(F.col("recording_id").alias("id"), isrcs.alias("isrcs")).alias("recording"))
    media = e.groupBy("album_id", "disc").agg(F.array_sort(F.collect_list(track)).alias("tracks"), F.max("more").alias("more"))
    first = F.min("disc").over(Window.partitionBy("album_id"))
    media = media.withColumn("n", F.size("tracks") + F.when(F.col("disc") == first, F.col("more")).otherwise(0))
    medium = F.struct(F.col("disc").alias("position"), F.col("n").alias("track-count"), "tracks")
    one = media.groupBy("album_id").agg(F.array_sort(F.collect_list(medium)).alias("media"))
    return one.select("album_id", F.to_json(F.struct(F.col("album_id").alias("id"), F.concat(F.lit("Album "), "album_id").alias("title"), "media")).alias("body"))


def _shown(df: DataFrame, *more) -> DataFrame:
    return df.select("album_id", "total", "returned", "complete", "reason", *more)


@query(_verdict("disc, position", "true", "n_isrc"))
def release_albums(spark: SparkSession, sf: str) -> DataFrame:
    """Media of releases; an ISRC counts if it is the only one."""
    out = albums.release(_releases(spark, sf))
    return _shown(out, F.size(F.filter("tracks", lambda t: t["isrc"].isNotNull())).cast("long").alias("n_isrc"))


@query(_verdict("line", "min(disc) FILTER (WHERE kept) = 1"))
def apple_albums(spark: SparkSession, sf: str) -> DataFrame:
    """An album row and its tracks in one list."""
    e = P.view(spark, sf, _ENTRIES)
    e = e.withColumn("inDisc", F.count("*").over(Window.partitionBy("album_id", "disc")))
    track = F.struct("line", F.lit("track").alias("wrapperType"), F.col("album_id").alias("collectionId"), F.col("track_id").alias("trackId"), F.col("title").alias("trackName"), F.col("position").alias("trackNumber"), F.col("disc").alias("discNumber"), F.col("inDisc").alias("trackCount"))
    rows = e.groupBy("album_id").agg(F.array_sort(F.collect_list(track)).alias("t"), F.max("more").alias("more"))
    head = F.struct(F.lit("collection").alias("wrapperType"), F.col("album_id").alias("collectionId"), F.concat(F.lit("Album "), "album_id").alias("collectionName"), (F.size("t") + F.col("more")).alias("trackCount"))
    text = F.concat(F.lit('{"results": ['), F.to_json(head), F.lit(", "), F.expr("substring(to_json(t), 2)"), F.lit("}"))
    return _shown(albums.apple(rows.select("album_id", text.alias("body"))))


@query(_verdict("line", "true"))
def jiosaavn_albums(spark: SparkSession, sf: str) -> DataFrame:
    """Two shapes of a list of songs."""
    song = F.struct("line", F.col("track_id").alias("id"), F.col("title").alias("song"), F.col("album_id").alias("albumid"))
    rows = P.view(spark, sf, _ENTRIES).groupBy("album_id").agg(F.array_sort(F.collect_list(song)).alias("t"), F.max("more").alias("more"))
    n = F.size("t") + F.col("more")
    even = F.col("album_id").cast("long") % 2 == 0
    body = F.struct(F.col("album_id").alias("id"), F.lit("Album").alias("title"), F.when(even, F.col("t")).alias("list"), F.when(~even, F.col("t")).alias("songs"), F.when(even, n).alias("list_count"), F.struct(n.alias("song_count")).alias("more_info"))
    return _shown(albums.jiosaavn(rows.select("album_id", F.to_json(body).alias("body"))))


_ASKED = f"SELECT CAST(o AS STRING) AS album_id, line, CAST(part AS STRING) AS recording_id, CASE WHEN line % 4 = 0 THEN 'Other' ELSE ' ALBUM ' || CAST(o AS STRING) END AS album FROM ({_LINES}) l WHERE line <> 2 UNION ALL SELECT CAST(o AS STRING), 100 + line, CAST(part + 1000000000 AS STRING), 'Album ' || CAST(o AS STRING) FROM ({_LINES}) m"


@query(f"SELECT album_id, line FROM ({_ASKED}) a WHERE album <> 'Other' AND (album_id, recording_id) IN (SELECT album_id, recording_id FROM ({_MARKED.format('disc, position')}) m WHERE kept)")
def recordings_on_release(spark: SparkSession, sf: str) -> DataFrame:
    """A recording counts for a release that has its id, its title and the recording on a medium."""
    return albums.on_release(P.view(spark, sf, _ASKED), albums.release(_releases(spark, sf))).select("album_id", "line")


_MBID = "'00000000-0000-0000-0000-' || lpad(CAST(o_orderkey AS STRING), 12, '0')"
_ART = f"SELECT {_MBID} AS album_id, o_orderkey % 4 AS k, CAST(o_orderkey AS STRING) AS o, o_orderkey % 5 <> 0 AS own FROM orders"


@query(f"""SELECT album_id, row_number() OVER (PARTITION BY album_id ORDER BY n) AS place, url, type FROM (
  SELECT album_id, 1 AS n, CASE WHEN k = 1 THEN 'https://coverartarchive.org/' || o ELSE 'https://img.example.org/' || o END AS url, CASE WHEN k = 0 THEN 'cover' WHEN k = 1 THEN 'back' ELSE 'artwork' END AS type FROM ({_ART}) a WHERE own AND k <> 3
  UNION ALL SELECT album_id, 2, 'https://ia.archive.org/1200', 'thumbnail' FROM ({_ART}) a WHERE own UNION ALL SELECT album_id, 3, 'https://ia.archive.org/250', 'thumbnail' FROM ({_ART}) a WHERE own) x""")
def cover_art(spark: SparkSession, sf: str) -> DataFrame:
    """Artwork of the release asked for; one address in four is http on a foreign host."""
    host = F.expr("case k when 1 then 'http://coverartarchive.org/' when 3 then 'http://img.example.org/' else 'https://img.example.org/' end || o")
    thumbs = F.create_map(F.lit("250"), F.lit("http://ia.archive.org/250"), F.lit("1200"), F.lit("https://ia.archive.org/1200"))
    image = F.struct(host.alias("image"), (F.col("k") == 0).alias("front"), (F.col("k") == 1).alias("back"), thumbs.alias("thumbnails"))
    of = F.when(F.col("own"), F.col("album_id")).otherwise(F.lit("another"))
    body = F.to_json(F.struct(F.concat(F.when(F.col("k") == 1, "http").otherwise("https"), F.lit("://musicbrainz.org/release/"), of).alias("release"), F.array(image).alias("images")))
    return extras.artwork(P.view(spark, sf, _ART).select("album_id", body.alias("body")))


@query("""SELECT c_custkey AS query_id, 'a' || n AS acoustid, n / 4.0 AS score, CASE WHEN n = 1 THEN 'r' || c_nationkey ELSE NULL END AS recording_id
FROM (SELECT *, unnest([1, 2]) AS n FROM customer) c WHERE c_custkey % 7 NOT IN (0, 1) AND c_nationkey % 5 <> 0""")
def fingerprint_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate of a fingerprint, none chosen."""
    asked = P.view(spark, sf, "SELECT c_custkey AS query_id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'AQAD' || CAST(c_nationkey AS STRING) END AS fingerprint, CASE WHEN c_custkey % 7 = 1 THEN 86401 ELSE 200 END AS duration FROM customer")
    rec = F.array(F.struct(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("id")))
    results = F.array(F.struct(F.lit("a1").alias("id"), F.lit(0.25).alias("score"), rec.alias("recordings")), F.struct(F.lit("a2").alias("id"), F.lit(0.5).alias("score"), F.lit(None).cast("array<struct<id: string>>").alias("recordings")))
    body = F.to_json(F.struct(F.when(F.col("n_nationkey") % 5 == 0, "error").otherwise("ok").alias("status"), results.alias("results")))
    landed = table(spark, sf, "nation").select(F.concat(F.lit("AQAD"), F.col("n_nationkey").cast("string")).alias("fingerprint"), F.explode(F.array(F.lit(200), F.lit(86401))).alias("duration"), body.alias("body"))
    return extras.fingerprint_matches(asked, landed)


_CATALOGUE = """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'deezer' ELSE 'ytmusic' END AS provider, CASE c_custkey % 4 WHEN 0 THEN 'song' WHEN 1 THEN 'album' WHEN 2 THEN 'playlist' ELSE 'lyrics' END AS kind,
  CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey AS STRING), CASE WHEN c_custkey % 3 = 0 THEN 12 ELSE 11 END, 'x') WHEN 1 THEN 'MPRE' || CAST(c_custkey AS STRING) WHEN 2 THEN 'PL' || lpad(CAST(c_custkey AS STRING), CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 9 END, '0') ELSE 'x' END AS id,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '100' WHEN 2 THEN '101' WHEN 3 THEN 'x' ELSE '1' END AS "limit" FROM customer"""


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'unsupported provider' WHEN c_custkey % 4 = 3 OR (c_custkey % 4 IN (0, 2) AND c_custkey % 3 = 0) THEN 'invalid type or id'
  WHEN c_custkey % 5 IN (2, 3) THEN 'limit must be between 1 and 100' END AS error, CASE c_custkey % 5 WHEN 0 THEN 20 WHEN 1 THEN 100 WHEN 2 THEN 101 WHEN 4 THEN 1 END AS n FROM customer""")
def catalogue_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds, forms of ids and limits."""
    asked = P.view(spark, sf, _CATALOGUE.replace('"limit"', "`limit`"))
    return extras.catalogue_requests(asked).select("c_custkey", "error", F.col("limit").alias("n"))


@query(f"""SELECT provider, artist_id, place, id, title, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY provider, artist_id ORDER BY pos) AS place FROM (
  SELECT p.provider, s.artist_id, s.id, min(s.pos) AS pos, arg_min(s.title, s.pos) AS title, arg_min(s.ms, s.pos) AS duration_ms
  FROM (SELECT CAST(o AS STRING) AS artist_id, CAST(supp % 5 AS STRING) AS id, 'Song ' || line AS title, line AS pos, part * 1000 AS ms FROM ({_LINES}) l WHERE part % 97 <> 0) s, (SELECT unnest(['deezer', 'applemusic', 'musicbrainz', 'jiosaavn', 'ytmusic']) AS provider) p GROUP BY 1, 2, 3) y) x WHERE place <= 3""")
def artist_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """An artist's tracks in the shape of each source, the first three with distinct ids."""
    shapes = {
        "deezer": "'id', i, 'title', t, 'duration', part",
        "applemusic": "'trackId', i, 'trackName', t, 'trackTimeMillis', part * 1000",
        "musicbrainz": "'id', i, 'title', t, 'length', part * 1000, 'artist-credit', array(named_struct('name', 'x'))",
        "jiosaavn": "'id', i, 'song', t, 'more_info', named_struct('duration', cast(part as string))",
        "ytmusic": "'videoId', i, 'title', t, 'duration_seconds', part",
    }
    lines = P.view(spark, sf, _LINES).selectExpr("cast(o as string) as artist_id", "line", "part", "cast(supp % 5 as string) as i", "if(part % 97 = 0, null, concat('Song ', line)) as t")
    out = None
    for provider, shape in shapes.items():
        rows = lines.groupBy("artist_id").agg(F.expr(f"to_json(transform(array_sort(collect_list(struct(line, named_struct({shape}) as r))), x -> x.r))").alias("body"))
        one = extras.artist_tracks(rows, provider, 3).select(F.lit(provider).alias("provider"), "artist_id", "place", "id", "title", "duration_ms")
        out = one if out is None else out.unionByName(one)
    return out


_ASKED_OF = "CASE WHEN query_id % 3 = 0 THEN 'deezer' WHEN query_id % 3 = 1 THEN 'qobuz' END"
_SOURCES = "['spotify', 'applemusic', 'tidal', 'qobuz', 'amazonmusic', 'pandora', 'bugs', 'genie', 'melon', 'musicbrainz', 'deezer', 'soundcloud', 'jiosaavn', 'ytmusic']"


@query(f"""WITH b AS (SELECT query_id, provider, score, album, lower(trim(album)) AS vote, CASE WHEN supp % 6 <> 0 THEN native_id END AS album_id, line, list_position({_SOURCES}, provider) AS place, {_ASKED_OF} AS asked FROM {_B} x WHERE album IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY query_id, vote) AS votes, coalesce(provider = asked AND album_id IS NOT NULL, false) AS own FROM b),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY own DESC, votes DESC, place, score DESC, provider) AS k FROM n) y WHERE k = 1)
SELECT w.query_id, w.album, w.provider, w.line AS track_number, (SELECT string_agg(n.provider || '=' || n.album_id, ',' ORDER BY n.provider) FROM n WHERE n.query_id = w.query_id AND n.vote = w.vote AND n.album_id IS NOT NULL) AS ids FROM w""")
def album_editions(spark: SparkSession, sf: str) -> DataFrame:
    """The edition by votes or of the source asked by id, with its position and ids."""
    rows = _best(spark, sf, "album", "native_id", "supp", "line").select("query_id", "provider", "score", "album", F.expr("if(supp % 6 <> 0, native_id, null)").alias("album_id"), F.col("line").alias("track_number"), F.lit(1).alias("disc_number"), F.expr(_ASKED_OF).alias("q_provider"))
    ids = F.array_join(F.transform(F.array_sort(F.map_entries("ids")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return fusion.album_editions(rows).select("query_id", "album", "provider", "track_number", F.nullif(ids, F.lit("")).alias("ids"))
