"""Artwork, fingerprints and catalogue requests on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from melder.sources import extras

MBID = "0" * 8 + "-0000-0000-0000-" + "0" * 12


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://coverartarchive.org/a", "https://coverartarchive.org/a"),
        ("HTTP://ia1.us.archive.org/a?b#c", "https://ia1.us.archive.org/a?b#c"),
        ("https://x.org/a", "https://x.org/a"),
        ("http://x.org/a", None),
        ("http://archive.org.x.org/a", None),
        ("https://u@x.org/a", None),
        ("ftp://archive.org/a", None),
        ("", None),
        (None, None),
    ],
)
def test_art_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(extras.art_url(F.col("u"))).first()[0] == want


def test_artwork_of_other_releases(spark):
    body = '{"release": "https://musicbrainz.org/release/%s", "images": [{"image": "https://x.org/1"}, {"image": "http://x.org/2"}]}'
    raw = spark.createDataFrame([(MBID, body % MBID), (MBID, body % "other"), ("x", body % "x"), (MBID, None), (MBID, "{")], "album_id string, body string")
    assert [(r["place"], r["url"], r["type"]) for r in extras.artwork(raw).collect()] == [(1, "https://x.org/1", "artwork")]


def test_catalogue_requests(spark):
    rows = [("ytmusic", "song", "a" * 11, None), ("ytmusic", "song", "a" * 11, "0"), ("ytmusic", None, "a", None), (None, "song", "a" * 11, None), ("ytmusic", "album", "MPRE", "3"), ("ytmusic", "song", None, None)]
    got = extras.catalogue_requests(spark.createDataFrame(rows, "provider string, kind string, id string, `limit` string")).collect()
    assert [r["error"] for r in got] == [None, "limit must be between 1 and 100", "invalid type or id", "unsupported provider", "invalid type or id", "invalid type or id"]
    assert got[0]["limit"] == 20


def test_artist_tracks_need_id_and_title(spark):
    body = '[{"id": 1, "title": "a"}, {"id": 1, "title": "b"}, {"title": "c"}, {"id": 2}, {"id": 3, "title": "d", "duration": 2, "artist": {"name": "x"}}]'
    raw = spark.createDataFrame([("9", body), ("9b", None), ("9c", "{")], "artist_id string, body string")
    got = extras.artist_tracks(raw, "deezer").orderBy("place").collect()
    assert [(r["id"], r["title"], r["duration_ms"], r["artists"]) for r in got] == [("1", "a", 0, []), ("3", "d", 2000, ["x"])]
    with pytest.raises(ValueError):
        extras.artist_tracks(raw, "deezer", 51)
