"""Queries of links, paged albums and album graphs; expectations are stated case by case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melder.operators import context, graph, links, metadata
from melder.plans import projection as P
from melder.queries import query
from melder.queries_albums import _ENTRIES
from melder.session import table, unfolded
from melder.sources import albums, catalogue_pages

# (link, provider, id): {n} is a number, {s} 22 letters, {v} 11, {u} an id of a recording; no provider: not a track link
_LINK_CASES = [
    ("https://open.spotify.com/track/{s}?si=tracking", "spotify", "{s}"),
    ("spotify:track:{s}", "spotify", "{s}"),
    ("https://open.spotify.com/intl-en/track/{s}", "spotify", "{s}"),
    ("https://open.spotify.com/embed/track/{s}", "spotify", "{s}"),
    ("https://music.youtube.com/watch?v={v}&si=tracking", "ytmusic", "{v}"),
    ("https://youtu.be/{v}?t=30", "ytmusic", "{v}"),
    ("https://www.youtube.com/shorts/{v}", "ytmusic", "{v}"),
    ("https://music.apple.com/us/album/some-album/9{n}?i={n}&ls=1", "applemusic", "{n}"),
    ("https://itunes.apple.com/in/song/some-song/{n}", "applemusic", "{n}"),
    ("https://www.deezer.com/ja/track/{n}?utm_source=share", "deezer", "{n}"),
    ("https://jiosaavn.com/song/some-song/a{n}?utm_source=share#top", "jiosaavn", "https://www.jiosaavn.com/song/some-song/a{n}"),
    ("https://m.soundcloud.com/artist{n}/title?in=user/sets/x", "soundcloud", "artist{n}/title"),
    ("https://musicbrainz.org/recording/047EA202-B98D-46AE-97F7-{u}", "musicbrainz", "047ea202-b98d-46ae-97f7-{u}"),
    ("https://listen.tidal.com/browse/track/{n}", "tidal", "{n}"),
    ("HTTPS://open.qobuz.com/track/{n}/", "qobuz", "{n}"),
    ("  https://www.deezer.com/track/%31{n}  ", "deezer", "1{n}"),
    ("http://open.spotify.com/track/{s}", None, None),
    ("https://open.spotify.com.evil.example/track/{s}", None, None),
    ("https://open.spotify.com@127.0.0.1/track/{s}", None, None),
    ("https://www.deezer.com:443/track/{n}", None, None),
    ("https://open.spotify.com/album/{s}", None, None),
    ("https://music.apple.com/us/album/x/{n}", None, None),
    ("https://music.apple.com/us/artist/x/9?i={n}", None, None),
    ("https://music.apple.com/us/album/x/1?i={n}&i=4", None, None),
    ("https://music.youtube.com/watch?v={v}&v=abcdefghijk", None, None),
    ("https://on.soundcloud.com/short{n}", None, None),
    ("https://soundcloud.com/artist{n}/sets", None, None),
    ("https://soundcloud.com/discover/title{n}", None, None),
    ("https://www.jiosaavn.com/song/name%2Fother/a{n}", None, None),
    ("https://www.jiosaavn.com/song/%2e%2e/a{n}", None, None),
    ("https://musicbrainz.org/artist/047ea202-b98d-46ae-97f7-{u}", None, None),
    ("https://www.deezer.com/track/{n}?x=%zz", None, None),
    ("https://www.deezer.com/en//track/{n}", None, None),
    ("spotify:artist:{s}", None, None),
    ("file:///track/{n}", None, None),
]
_PARTS = {"n": "CAST(1000 + p_partkey AS STRING)", "s": "lpad(CAST(p_partkey AS STRING), 22, 'x')", "v": "lpad(CAST(p_partkey AS STRING), 11, 'v')", "u": "lpad(CAST(p_partkey AS STRING), 12, '0')"}


def _case(which: int) -> str:
    """SQL of the text that a row's case has for its link (0), its provider (1) or its id (2)."""
    def text(template: str | None) -> str:
        x = "'" + template + "'" if template is not None else "CAST(NULL AS STRING)"
        for k, e in _PARTS.items():
            x = x.replace("{" + k + "}", f"' || {e} || '")
        return x

    return f"CASE p_partkey % {len(_LINK_CASES)} " + " ".join(f"WHEN {i} THEN {text(c[which])}" for i, c in enumerate(_LINK_CASES)) + " END"


@query(f"SELECT p_partkey, {_case(0)} AS url, {_case(1)} AS provider, {_case(2)} AS id FROM part")
def recognised_links(spark: SparkSession, sf: str) -> DataFrame:
    """The source and id that a link names, or none."""
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_case(0)).alias("url"))
    return links.recognised(rows).select("p_partkey", "url", "link.provider", "link.id")


# pages of three entries; album o: total unknown (o % 6 = 5), page 1 repeats page 0 (o % 7 = 1), can't be read (2), has a foreign
# track as its second (3); the page after the last is missing (o % 13 = 4), else empty
_PAGED = f"SELECT *, CAST(album_id AS BIGINT) AS o, row_number() OVER (PARTITION BY album_id ORDER BY line) - 1 AS idx, count(*) OVER (PARTITION BY album_id) AS n FROM ({_ENTRIES}) e0"


def _deezer(spark: SparkSession, sf: str) -> DataFrame:
    e = P.view(spark, sf, _ENTRIES)
    o, placed = F.col("album_id").cast("long"), ~F.col("line").isin(1, 7)
    track = F.struct(F.col("track_id").alias("id"), "title", F.when(placed, F.col("position")).alias("track_position"), F.when(placed, F.col("disc")).alias("disk_number"), (100 + F.col("line")).alias("duration"), F.struct(F.concat(F.lit("Singer "), (F.col("line") % 2).cast("string")).alias("name")).alias("artist"))
    # an album's tracks are gathered once, which tells their number and places too, and its pages cut from them
    every = e.groupBy("album_id").agg(F.sort_array(F.collect_list(F.struct("line", track.alias("t")))).alias("every")).withColumns({"o": o, "n": F.size("every")}).withColumn("after", F.floor((F.col("n") + 2) / 3).cast("int"))
    pages = every.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("after") - F.when(F.col("o") % 13 == 4, 1).otherwise(0))))
    again = (F.col("page") == 1) & (F.col("o") % 7 == 1)
    foreign = lambda i: (F.col("o") % 7 == 3) & (F.col("page") == 1) & (i == 1)
    data = F.transform(F.slice("every", 3 * F.when(again, 0).otherwise(F.col("page")) + 1, F.lit(3)), lambda x, i: x["t"].withField("album", F.struct(F.when(foreign(i), "999").otherwise(F.col("album_id")).alias("id"))))
    told = F.to_json(F.struct(data.alias("data"), F.when(~again & ((F.col("page") + 1) * 3 < F.col("n")), "more").alias("next")))
    bodies = pages.select("album_id", "page", F.when(F.col("page") == F.col("after"), F.lit('{"data": []}')).when((F.col("page") == 1) & (F.col("o") % 7 == 2), F.lit(None)).otherwise(told).alias("body"))
    roots = e.groupBy("album_id").agg(F.count("*").alias("n"), F.max("more").alias("more")).withColumn("o", o)
    root = F.to_json(F.struct(F.col("album_id").alias("id"), F.concat(F.lit("Album "), "album_id").alias("title"), F.when(F.col("o") % 6 != 5, F.col("n") + F.col("more")).alias("nb_tracks")))
    return albums.deezer(roots.select("album_id", root.alias("body")), bodies)


_READ = f"""p AS (SELECT *, CASE WHEN o % 7 IN (1, 2) AND n > 3 THEN 3 WHEN o % 7 = 3 AND n > 4 THEN 4 ELSE n END AS got, (o % 7 IN (1, 2) AND n > 3) OR (o % 7 = 3 AND n > 4) OR (more = 1 AND o % 6 <> 5 AND o % 13 = 4) AS failed FROM ({_PAGED}) x),
r AS (SELECT *, title IS NOT NULL AND (line NOT IN (1, 7) OR row_number() OVER (PARTITION BY album_id, track_id, line IN (1, 7), title IS NULL ORDER BY line) = 1) AS kept, CASE WHEN line IN (1, 7) THEN idx + 1 ELSE position END AS place, CASE WHEN line IN (1, 7) THEN 0 ELSE disc END AS on_disc FROM p WHERE idx < got)"""


@query(f"""WITH {_READ}, a AS (SELECT album_id, any_value(CASE WHEN o % 6 <> 5 THEN n + more END) AS total, count(*) FILTER (WHERE kept) AS returned, bool_and(kept) AND NOT bool_or(failed) AS valid, bool_or(failed) AS failed, coalesce(sum(place) FILTER (WHERE kept), 0)::BIGINT AS places FROM r GROUP BY 1)
SELECT album_id, total, returned, coalesce(valid AND total = returned, false) AS complete, CASE WHEN failed THEN 'upstream_error' WHEN valid AND total = returned THEN NULL WHEN total IS NULL THEN 'unknown_total' ELSE 'incomplete_response' END AS reason, places FROM a""")
def deezer_albums(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in order up to the first that repeats another, fails or is of another album."""
    out = _deezer(spark, sf)
    return out.select("album_id", "total", "returned", "complete", "reason", F.aggregate("tracks", F.lit(0).cast("long"), lambda a, t: a + t["position"]).alias("places"))


_GRAPH = f"""WITH {_READ}, k AS (SELECT *, 'deezer:release:' || album_id AS root, 'deezer:track_entry:' || album_id || '/' || on_disc || '/' || place || '/' || track_id AS entry, 'Singer ' || line % 2 AS singer, row_number() OVER (PARTITION BY album_id ORDER BY line) AS i FROM r WHERE kept),
s AS (SELECT *, 'local:artist:' || substr(sha256('deezer' || chr(0) || entry || chr(0) || singer), 1, 24) AS who FROM k),
nodes AS (SELECT DISTINCT 'deezer:release:' || album_id AS root, 'deezer:release:' || album_id AS id, 'release' AS type, 0 AS seq FROM r UNION ALL SELECT root, entry, 'track_entry', i * 1000 FROM s UNION ALL SELECT root, who, 'artist', i * 1000 + 1 FROM s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY seq, id) AS place, count(*) OVER (PARTITION BY root) AS m FROM nodes),
kn AS (SELECT * FROM ranked WHERE place <= 8),
edges AS (SELECT root, entry AS source, root AS target, 'appears_on' AS type, i * 1000 AS seq, place AS position FROM s UNION ALL SELECT root, who, entry, 'credit', i * 1000 + 1, NULL FROM s),
ke AS (SELECT e.*, row_number() OVER (PARTITION BY e.root ORDER BY e.seq) AS k, count(*) OVER (PARTITION BY e.root) AS m FROM edges e JOIN kn a ON a.root = e.root AND a.id = e.source JOIN kn b ON b.root = e.root AND b.id = e.target),
flag AS (SELECT kn.root, bool_or(kn.m > 8) OR coalesce((SELECT bool_or(ke.m > 5) FROM ke WHERE ke.root = kn.root), false) AS truncated FROM kn GROUP BY kn.root)"""


@query(f"{_GRAPH} SELECT kn.root, id, type, place, truncated FROM kn JOIN flag ON kn.root = flag.root")
def album_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """An album's nodes in order of appearance under a cap, with the graph's flag."""
    nodes = unfolded(graph.album_graphs(_deezer(spark, sf), "deezer", 8, 5), ["root", "truncated"], "nodes", "i", "n")
    return nodes.select("root", "n.id", "n.type", (F.col("i") + 1).cast("long").alias("place"), "truncated")


@query(f"{_GRAPH} SELECT ke.root, source, target, type, position, truncated FROM ke JOIN flag ON ke.root = flag.root WHERE k <= 5")
def album_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges between them under a cap of their own."""
    edges = unfolded(graph.album_graphs(_deezer(spark, sf), "deezer", 8, 5), ["root", "truncated"], "edges", "e")
    return edges.select("root", "e.source", "e.target", "e.type", F.col("e.position").cast("long").alias("position"), "truncated")


# a record inside its envelope, in five shapes; the artist's id is the record's own in the third
_NATIVE = "CAST(7000 + c_custkey AS STRING)"
_RECORD = {
    "query_id": "c_custkey", "provider": "CASE c_custkey % 5 WHEN 0 THEN 'deezer' WHEN 1 THEN 'spotify' WHEN 2 THEN 'applemusic' WHEN 3 THEN 'ytmusic' ELSE 'jiosaavn' END", "native_id": _NATIVE, "title": "c_name", "label": "c_mktsegment",
    "body": """CASE c_custkey % 5
 WHEN 0 THEN '{"id": ' || CAST(7000 + c_custkey AS STRING) || ', "title": "' || c_name || '", "explicit_lyrics": false, "access_token": "private", "Stream-URL": {"a": 1}, "mood": {"calm": [1, {"deep": null}], "none": {}}}'
 WHEN 1 THEN '{"request": {"id": "' || CAST(7000 + c_custkey AS STRING) || '"}, "tracks": {"items": [{"id": "wrong", "name": "Wrong"}, {"id": "' || CAST(7000 + c_custkey AS STRING) || '", "name": "' || c_name || '", "explicit": true, "tags": []}]}}'
 WHEN 2 THEN '{"artist": {"id": ' || CAST(7000 + c_custkey AS STRING) || ', "name": "Artist"}, "data": [[{"trackId": ' || CAST(7000 + c_custkey AS STRING) || ', "attributes": {"contentRating": "CLEAN", "segment": "' || c_mktsegment || '"}, "headers": {"x": 1}}]]}'
 WHEN 3 THEN '{"items": [{"videoId": "' || CAST(7000 + c_custkey AS STRING) || '", "from": "items"}], "videoDetails": {"videoId": "' || CAST(7000 + c_custkey AS STRING) || '", "from": "details", "explicit": "true"}}'
 ELSE CASE WHEN c_custkey % 2 = 0 THEN '{"results": [{"id": "other", "perma_url": "https://www.jiosaavn.com/song/name/' || CAST(7000 + c_custkey AS STRING) || '"}]}' ELSE '{"results": [{"id": "other"}], "broken' END END""",
}
_BODIES = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _RECORD.items()) + " FROM customer"


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(*[F.expr(e).alias(n) for n, e in _RECORD.items()])
    return rows.withColumn("ids", F.create_map(F.col("provider"), F.col("native_id"), F.lit("other_track_id"), F.lit("foreign")))


_LEAVES = """SELECT query_id, provider, e.p AS path, e.v AS value FROM (SELECT *, unnest(CASE query_id % 5
 WHEN 0 THEN [{'p': 'id', 'v': native_id}, {'p': 'title', 'v': '"' || title || '"'}, {'p': 'explicit_lyrics', 'v': 'false'}, {'p': 'mood.calm[0]', 'v': '1'}, {'p': 'mood.calm[1].deep', 'v': 'null'}, {'p': 'mood.none', 'v': '{}'}]
 WHEN 1 THEN [{'p': 'id', 'v': '"' || native_id || '"'}, {'p': 'name', 'v': '"' || title || '"'}, {'p': 'explicit', 'v': 'true'}, {'p': 'tags', 'v': '[]'}]
 WHEN 2 THEN [{'p': 'trackId', 'v': native_id}, {'p': 'attributes.contentRating', 'v': '"CLEAN"'}, {'p': 'attributes.segment', 'v': '"' || label || '"'}]
 WHEN 3 THEN [{'p': 'videoId', 'v': '"' || native_id || '"'}, {'p': 'from', 'v': '"details"'}, {'p': 'explicit', 'v': '"true"'}]
 ELSE CASE WHEN query_id % 2 = 0 THEN [{'p': 'id', 'v': '"other"'}, {'p': 'perma_url', 'v': '"https://www.jiosaavn.com/song/name/' || native_id || '"'}] ELSE [] END END) AS e FROM b) x"""


@query(f"WITH b AS ({_BODIES}) " + _LEAVES)
def record_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The entity out of a record of unknown shape, its public facts by path."""
    rows = _bodies(spark, sf).select("query_id", "provider", F.array("native_id").alias("ids"), "body")
    return metadata.leaves(metadata.entities(rows))


@query(f"SELECT query_id, CASE query_id % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'explicit' WHEN 2 THEN 'clean' ELSE 'unknown' END AS explicit_status, CASE query_id % 5 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE CASE WHEN query_id % 2 = 0 THEN 2 ELSE 0 END END + 4 AS n_facts, '{{\"' || provider || '\":\"' || native_id || '\"}}' AS ids FROM ({_BODIES}) b")
def attached_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Every source's facts and the tri-state flag of explicit words beside a result."""
    rows = _bodies(spark, sf)
    out = metadata.public(metadata.attach(rows.select("query_id", F.lit("diagnostic").alias("match_score")), rows.drop("match_score")), metadata.PUBLIC_TRACK, ["query_id"])
    one = F.from_json(F.element_at(F.map_values("provider_data"), 1), "map<string, string>")
    return out.select("query_id", "explicit_status", F.size(one).alias("n_facts"), F.try_element_at(one, F.lit("metadata.ids")).alias("ids"))


# result pages of a catalogue, a row for each line of an order; lines whose part divides by 13 have no title, parts may repeat
_LISTED = "SELECT l_orderkey AS query_id, CASE l_orderkey % 3 WHEN 0 THEN 'bugs' WHEN 1 THEN 'genie' ELSE 'melon' END AS provider, l_linenumber AS line, l_partkey AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey"


@query(f"""SELECT query_id, provider, row_number() OVER (PARTITION BY query_id ORDER BY line, part) AS rank, id, title, artist, album_id FROM (SELECT query_id, provider, line, part, CAST(part AS VARCHAR) AS id, 'Song & ' || part AS title, 'Singer ' || supp AS artist, CAST(part % 100 AS VARCHAR) AS album_id,
row_number() OVER (PARTITION BY query_id, part ORDER BY line) AS k FROM ({_LISTED}) l WHERE part % 13 <> 0) x WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY line, part) <= 10""")
def listed_songs(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of result pages to candidates with distinct ids, in the page's order."""
    rows = P.view(spark, sf, _LISTED)
    part, supp = F.col("part").cast("string"), F.col("supp").cast("string")
    title = F.when(F.col("part") % 13 != 0, F.concat(F.lit("Song &amp; "), part)).otherwise("")
    album = (F.col("part") % 100).cast("string")
    shape = F.when(F.col("provider") == "bugs", F.format_string('<tr trackId="%s"><th><p class="title"><a>%s</a></p></th><td><a href="/artist/%s">Singer %s</a><a class="album" href="/album/%s">A</a></td></tr>', part, title, supp, supp, album))
    shape = shape.when(F.col("provider") == "genie", F.format_string("<tr songid='%s'><td><a class='title'><span class='icon'>TITLE</span>%s</a><a onclick=\"fnViewArtist('%s')\">Singer %s</a><a onclick=\"fnViewAlbumLayer('%s')\">A</a></td></tr>", part, title, supp, supp, album))
    shape = shape.otherwise(F.format_string("<tr><td><button data-song-no='%s'></button><a href=\"javascript:playSong('1',1)\">%s</a><a href=\"javascript:goArtistDetail('%s')\">Singer %s</a><a href=\"javascript:goAlbumDetail('%s')\">A</a>", part, title, supp, supp, album))
    table_rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part", shape.alias("tr")))), lambda x: x["tr"]), "\n")
    pages = rows.groupBy("query_id", "provider").agg(F.concat(F.lit("<html><table>"), table_rows, F.lit("</table></html>")).alias("body"))
    return catalogue_pages.listed_songs(pages).select("query_id", "provider", F.col("rank").cast("long").alias("rank"), "id", "title", F.get("artists", F.lit(0))["name"].alias("artist"), "album_id")


# works link to entities (k % 5 = 0, 1, 2), to an article (3) or to nothing; entities lack a sitelink (k % 7 = 3), articles name another entity (k % 11 = 4) or none (5), or aren't standard (6)
_ARTICLE = "CASE WHEN k % 5 = 4 THEN 'no_data' WHEN k % 11 = 6 THEN 'unavailable' WHEN k % 5 = 3 THEN 'ok' WHEN k % 7 = 3 OR k % 11 = 4 THEN 'unavailable' ELSE 'ok' END"


@query(f"SELECT k AS query_id, {_ARTICLE} AS status, CASE WHEN {_ARTICLE} = 'ok' THEN 'Work ' || k END AS title, CASE WHEN {_ARTICLE} = 'ok' THEN CASE WHEN k % 11 = 4 THEN 'Q1' WHEN k % 11 = 5 AND k % 5 = 3 THEN NULL ELSE 'Q' || (k + 1) END END AS wikidata_id FROM (SELECT c_custkey AS k FROM customer) c")
def work_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Works to entities to articles, which must name the entity back."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    k, q = F.col("k").cast("string"), F.concat(F.lit("Q"), (F.col("k") + 1).cast("string"))
    link = F.when(F.col("k") % 5 < 3, F.concat(F.lit("https://www.wikidata.org/wiki/"), q)).when(F.col("k") % 5 == 3, F.concat(F.lit("https://en.wikipedia.org/wiki/Work%5F"), k, F.lit("?x=1")))
    site = F.when(F.col("k") % 7 == 3, F.lit("{}")).otherwise(F.concat(F.lit('{"enwiki": {"title": "Work '), k, F.lit('"}}')))
    entities = c.select(q.alias("entity_id"), F.concat(F.lit('{"entities": {"'), q, F.lit('": {"sitelinks": '), site, F.lit("}}}")).alias("body"))
    item = F.when(F.col("k") % 11 == 4, "Q1").when(F.col("k") % 11 != 5, q)
    summary = F.to_json(F.struct(F.when(F.col("k") % 11 == 6, "disambiguation").otherwise("standard").alias("type"), item.alias("wikibase_item"), F.concat(F.lit("Work "), k).alias("title"), F.lit("About it.").alias("extract")))
    out = context.articles(c.select(F.col("k").alias("query_id"), link.alias("link")), entities, c.select(F.concat(F.lit("Work_"), k).alias("page"), summary.alias("body")))
    return out.select("query_id", "status", "title", "wikidata_id")


@query("""SELECT s_suppkey AS query_id, CASE s_suppkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'unavailable' ELSE 'no_data' END AS covers, CASE WHEN s_suppkey % 2 = 0 THEN 'ok' ELSE 'no_data' END AS notes, 1 + CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 THEN 1 ELSE 0 END AS n_images,
CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 THEN 'small' ELSE 'own' END AS first, round(0.12 + 0.08, 4)::DOUBLE AS completeness, CASE WHEN s_suppkey % 2 = 0 THEN '{"n":' || s_suppkey || '}' END AS note FROM supplier""")
def enrichment_status(spark: SparkSession, sf: str) -> DataFrame:
    """Independent sources with a status each; a failing one takes nothing from a track."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("title"))
    image = lambda url, size: F.array(F.struct(url.alias("url"), F.lit(size).alias("width"), F.lit(size).alias("height")))
    tracks = s.withColumn("images", image(F.lit("own"), 100))
    url = F.when(F.col("query_id") % 5 == 0, "own").otherwise("small")
    covers = s.where("query_id % 3 < 2").select("query_id", (F.col("query_id") % 3 == 0).alias("ok"), F.lit(None).cast("string").alias("data"), image(url, 10).alias("images"))
    notes = s.where("query_id % 2 = 0").select("query_id", F.lit(True).alias("ok"), F.to_json(F.struct(F.col("query_id").alias("n"))).alias("data"), F.lit(None).alias("images"))
    out = context.enriched(tracks, {"covers": covers, "notes": notes})
    return out.select("query_id", F.col("statuses.covers").alias("covers"), F.col("statuses.notes").alias("notes"), F.size("images").alias("n_images"), F.get("images", F.lit(0))["url"].alias("first"), F.round("completeness", 4).alias("completeness"), F.try_element_at("data", F.lit("notes")).alias("note"))


@query("SELECT c_custkey AS query_id, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE 'id' || c_custkey END AS id, 'Guest' AS second FROM customer WHERE c_custkey % 4 <> 3")
def native_artist_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of artists whose row has the same name and address; two ids for one reject the song."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"))
    k = F.col("query_id").cast("string")
    action = F.concat(F.lit("/artist/"), k)
    row = lambda i, name, path: F.struct(i.alias("id"), name.alias("name"), F.concat(F.lit("https://site.example"), path).alias("perma_url"))
    other = F.when(F.col("query_id") % 4 == 3, F.concat(F.lit("other"), k)).otherwise(F.concat(F.lit("id"), k))
    rows = F.array(row(F.concat(F.lit("id"), k), F.lit("Main"), F.when(F.col("query_id") % 4 == 1, F.lit("/artist/x")).otherwise(action)), row(other, F.lit("Main"), F.when(F.col("query_id") % 4 == 1, F.lit("/artist/y")).otherwise(action)), row(F.lit("g"), F.lit("Guest"), F.lit("")))
    credit = lambda name, role, path: F.struct(F.lit(name).alias("name"), F.lit(role).alias("role"), path.alias("action"))
    songs = c.withColumns({"credits": F.array(credit("Main", "primary_artists", action), credit("Guest", "featured_artists", F.lit(""))), "artists": rows})
    out = context.native_artists(songs, "https://site.example")
    return out.select("query_id", F.get("credits", F.lit(0))["id"].alias("id"), F.when(F.get("credits", F.lit(1))["id"].isNull(), F.get("credits", F.lit(1))["name"]).alias("second"))
