"""Wire records and raw pages."""

import json

import pytest

from melder.sources import html, wire


def raw(spark, body, provider="x"):
    return spark.createDataFrame([(1, provider, body if isinstance(body, str) else json.dumps(body))], "query_id long, provider string, body string")


def test_apple(spark):
    song = {"kind": "song", "trackId": 7, "trackName": "T", "artistName": "A", "trackTimeMillis": 1000, "releaseDate": "2020-01-02T00:00:00Z", "trackExplicitness": "notExplicit", "artworkUrl100": "u/100x100bb.jpg", "trackNumber": 0}
    got = wire.apple(raw(spark, {"results": [{"kind": "album", "trackId": 1}, song]})).collect()
    assert [(r["native_id"], r["duration_ms"], r["release_date"], r["explicit_status"], r["image_url"], r["track_number"]) for r in got] == [("7", 1000, "2020-01-02", "clean", "u/600x600bb.jpg", None)]


def test_deezer_keeps_the_asked_artist(spark):
    body = {"data": [{"id": 12345678901234567890, "title": "T", "duration": 3, "artist": {"name": "Tribute"}}, {"id": 2, "title": "T", "duration": "3", "artist": {"name": "X"}, "contributors": [{"name": "Ánn"}]}]}
    assert [(r["native_id"], r["duration_ms"]) for r in wire.deezer(raw(spark, body), "ann").collect()] == [("2", 3000)]
    assert [r["native_id"] for r in wire.deezer(raw(spark, body)).collect()] == ["12345678901234567890", "2"]


def test_jiosaavn_fills_gaps(spark):
    body = {"results": [{"id": "a", "song": "S", "singers": "Ann", "year": "2001", "image": "i-150x150.jpg", "more_info": {"album": "B", "duration": "60"}}]}
    r = wire.jiosaavn(raw(spark, body)).first()
    assert (r["title"], r["artist"], r["album"], r["duration_ms"], r["release_date"], r["image_url"]) == ("S", "Ann", "B", 60000, "2001", "i-500x500.jpg")


def test_musicbrainz_and_spotify(spark):
    m = wire.musicbrainz(raw(spark, {"recordings": [{"id": "AB", "score": "90", "title": "T", "length": 5, "isrcs": ["I"], "artist-credit": [{"name": "A"}], "releases": [{"title": "R", "date": "1999"}], "tags": [{"count": 0, "name": "no"}, {"count": 2, "name": "yes"}]}]})).first()
    assert (m["native_id"], m["initial_score"], m["album"], m["genre"]) == ("ab", 0.9, "R", "yes")
    s = wire.spotify(raw(spark, {"tracks": {"items": [{"id": "x", "name": "T", "artists": [{"name": "A"}], "album": {"name": "B", "images": [{"url": "small", "width": 1, "height": 1}, {"url": "big", "width": 9, "height": 9}]}, "explicit": False}]}})).first()
    assert (s["image_url"], s["explicit_status"]) == ("big", "unknown")


def test_generic_catalogue(spark):
    body = {"id": "5", "name": "T", "performer": {"name": "P"}, "duration": "PT1M"}
    assert [(r["artist"], r["duration_ms"]) for r in wire.catalogue(raw(spark, body), "tidal", "5").collect()] == [("P", 60000)]
    assert wire.catalogue(raw(spark, body), "tidal", "6").count() == 0


def test_broken_bodies_and_union(spark):
    assert wire.apple(raw(spark, "{not json")).count() == 0
    assert wire.read_all(raw(spark, {"data": [{"id": 1, "title": "T"}]}, "deezer")).count() == 1


def test_json_api_links(spark):
    body = {"data": {"id": "1", "type": "tracks", "relationships": {"artists": {"data": [{"id": "9", "type": "artists"}, {"id": "8", "type": "artists"}]}}}, "included": [{"id": "9", "type": "artists", "attributes": {"name": "Ann"}}]}
    assert [(r["relation"], r["id"], r["attributes"]["name"]) for r in wire.link_included(raw(spark, body)).collect()] == [("artists", "9", "Ann")]


@pytest.mark.parametrize(
    ("page", "ok", "kind", "error"),
    [
        ("", False, None, "empty"),
        ('{"a": 1}', True, "json", None),
        ('{"error": "x"}', False, "json", "upstream_error"),
        ("<p>nothing</p>", False, None, "no_data"),
        ('<script type="application/ld+json">{"@type": "MusicRecording", "name": "S"}</script>', True, "schema.org", None),
        ('<script type="application/ld+json">[{"@type": "MusicRecording", "name": "S"}, {"@type": "MusicRecording", "name": "T"}]</script>', False, "schema.org", "ambiguous"),
        ('<script>window.x = {"song": {"id": 1}, "y": f()}</script>', True, "state", None),
        ('<pre>{"a": 2}</pre>', True, "pre", None),
    ],
)
def test_recover(page, ok, kind, error):
    got = html.recover_one(page)
    assert (got[0], got[1], got[4]) == (ok, kind, error)


def test_korean_fields(spark):
    body = {"id": "3", "title": "T", "artists": [{"id": "1", "name": "A"}], "duration_ms": 5, "fields": {"장르": "발라드", "발매일": "2020.01.02", "기획사": "L", "작사": "X, Y", "작곡가": "X"}}
    r = wire.korean(raw(spark, body), "melon").first()
    assert (r["genre"], r["release_date"], r["label"], r["duration_ms"]) == ("발라드", "2020-01-02", "L", 5)
    assert sorted((c["name"], c["role"]) for c in wire.korean_credits(raw(spark, body)).collect()) == [("X", "composer"), ("X", "lyricist"), ("Y", "lyricist")]


def test_soundcloud_needs_the_players_id(spark):
    body = {"title": "T by A", "author_name": "A", "html": '<iframe src="https://w.soundcloud.com/player/?url=https%3A%2F%2Fapi.soundcloud.com%2Ftracks%2F77&x=1"></iframe>'}
    r = wire.soundcloud(raw(spark, body)).first()
    assert (r["native_id"], r["title"], r["artist"]) == ("77", "T", "A")
    assert wire.soundcloud(raw(spark, {"title": "T", "html": ""})).count() == 0
