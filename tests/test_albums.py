"""Album bodies of sources, with the faults that make an album incomplete."""

import json

import pytest

from melder.sources import albums


def read(spark, reader, *bodies, **more):
    raw = spark.createDataFrame([("9", b if isinstance(b, str) or b is None else json.dumps(b)) for b in bodies], "album_id string, body string")
    return reader(raw, **more).collect()


def medium(position=1, count=2, tracks=(("a", 1), ("b", 2))):
    return {"position": position, "track-count": count, "tracks": [{"id": i, "position": p, "title": f"T{i}", "recording": {"id": f"r{i}"}} for i, p in tracks]}


def release(*media, **more):
    return {"id": "9", "title": "Album", "media": list(media), **more}


def test_foreign_and_broken_bodies_have_no_row(spark):
    assert read(spark, albums.release, None, "", "{", {"id": "8", "title": "x"}, {"id": "9"}) == []
    assert read(spark, albums.apple, None, "[]", {"results": []}) == []
    assert read(spark, albums.jiosaavn, {"id": "9", "title": "x", "list": [{"id": "1", "song": "s", "albumid": "8"}]}) == []


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (release(medium()), (2, 2, True, None)),
        (release(medium(), medium(2, 1, (("c", 1),))), (3, 3, True, None)),
        (release(medium(count=3)), (3, 2, False, "incomplete_response")),
        (release(medium(count=None)), (None, 2, False, "unknown_total")),
        (release(medium(), medium(1, 1, (("c", 3),))), (3, 3, False, "incomplete_response")),
        (release(medium(tracks=(("a", 1), ("b", 1)))), (2, 2, False, "incomplete_response")),
        (release(medium(tracks=(("a", 1), ("a", 2)))), (2, 1, False, "incomplete_response")),
        (release(), (None, 0, False, "unknown_total")),
        ({"id": "9", "title": "Album"}, (None, 0, False, "unknown_total")),
    ],
)
def test_releases(spark, body, want):
    r = read(spark, albums.release, body)[0]
    assert (r["total"], r["returned"], r["complete"], r["reason"]) == want


def test_the_limit_is_named(spark):
    r = read(spark, albums.release, release(medium()), limit=1)[0]
    assert (r["returned"], r["complete"], r["reason"]) == (1, False, "limit")


def apple(*tracks, total=None, **root):
    head = {"wrapperType": "collection", "collectionId": "9", "collectionName": "Album", "trackCount": total if total is not None else len(tracks), **root}
    return {"results": [head, *({"wrapperType": "track", "collectionId": c, "trackId": i, "trackName": "T", "discNumber": d, "trackNumber": n, "trackCount": m} for i, d, n, m, c in tracks)]}


@pytest.mark.parametrize(
    ("body", "complete", "ids"),
    [
        (apple(("b", 1, 2, 2, "9"), ("a", 1, 1, 2, "9")), True, ["a", "b"]),
        (apple(("a", 1, 1, 1, "9"), ("b", 2, 1, 1, "9"), discCount=2), True, ["a", "b"]),
        (apple(("a", 1, 1, 1, "9"), ("b", 2, 1, 1, "9"), discCount=1), False, ["a", "b"]),
        (apple(("a", 1, 1, 2, "9"), ("b", 1, 3, 2, "9")), False, ["a", "b"]),
        (apple(("a", 1, 1, 2, "9"), ("b", 1, 2, 3, "9")), False, ["a", "b"]),
        (apple(("a", 1, 1, 1, "9"), ("b", 1, 1, 1, "9"), ("b", 1, 2, 1, "9")), False, ["a", "b"]),
        (apple(("a", 1, 1, 1, "9"), ("b", 1, 2, 1, "8"), total=1), False, ["a"]),
        (apple(("a", 0, 1, 1, "9")), False, []),
    ],
)
def test_apple(spark, body, complete, ids):
    r = read(spark, albums.apple, body)[0]
    assert (r["complete"], [t["track_id"] for t in r["tracks"]]) == (complete, ids)


def test_song_lists_in_both_forms(spark):
    from melder.sources import albums

    bodies = [
        ("123", '{"id":"123","title":"A &amp; B","list_count":"1","list":[{"id":"abcdefgh","title":"Song &quot;x&quot;","more_info":{"album_id":"123","duration":"163","artistMap":{"primary_artists":[{"name":"Singer &amp; Co"}]}}}]}'),
        ("124", '{"id":124,"name":"A &amp;amp; B","song_count":1,"songs":[{"id":"abcdefgh","song":"Song","duration":163,"albumid":124,"primary_artists":"Singer, Other"}]}'),
        ("125", '{"id":"125","title":"A","list_count":"1","list":[{"id":"x","title":"Song","more_info":{"album_id":"999"}}]}'),
    ]
    got = {r["album_id"]: r for r in albums.jiosaavn(spark.createDataFrame(bodies, "album_id string, body string")).collect()}
    assert set(got) == {"123", "124"}
    assert [(got[i]["title"], got[i]["complete"], got[i]["tracks"][0]["title"], got[i]["tracks"][0]["duration_ms"], got[i]["tracks"][0]["artists"]) for i in ("123", "124")] == [
        ("A & B", True, 'Song "x"', 163000, ["Singer & Co"]), ("A &amp; B", True, "Song", 163000, ["Singer", "Other"]),
    ]


def test_paged_albums(spark):
    from melder.sources import albums

    root = lambda i, n: (i, f'{{"id": {i}, "title": "A"{"" if n is None else f", {chr(34)}nb_tracks{chr(34)}: {n}"}}}')
    one, two = '{"data":[{"id":1,"title":"One"}],"next":"more"}', '{"data":[{"id":2,"title":"Two"}]}'
    roots = [root("1", 2), root("2", 2), root("3", 2), root("4", None), root("5", 2), ("6", '{"id": 7, "title": "Other"}'), root("8", 0)]
    pages = [("1", 0, one), ("1", 1, two), ("2", 0, one), ("2", 1, one), ("3", 0, one), ("3", 1, None), ("4", 0, one), ("4", 1, two), ("5", 0, one), ("5", 1, '{"data":[{"id":3,"title":"Three","album":{"id":"9"}}]}'), ("8", 0, '{"data":[]}')]
    got = albums.deezer(spark.createDataFrame(roots, "album_id string, body string"), spark.createDataFrame(pages, "album_id string, page int, body string")).collect()
    assert {r["album_id"]: (r["returned"], r["complete"], r["reason"]) for r in got} == {
        "1": (2, True, None), "2": (1, False, "upstream_error"), "3": (1, False, "upstream_error"), "4": (2, False, "unknown_total"), "5": (1, False, "upstream_error"), "8": (0, True, None),
    }
    short = albums.deezer(spark.createDataFrame(roots[:1], "album_id string, body string"), spark.createDataFrame(pages[:1], "album_id string, page int, body string"), 1).first()
    assert (short["returned"], short["complete"], short["reason"]) == (1, False, "limit")
