"""Pages of an album that are missing, repeated or too many, and what reading them costs."""

import json

import __spark_entry__ as entry
from melder.sources import albums


def page(*ids, more=True):
    return json.dumps({"data": [{"id": i, "title": f"T{i}"} for i in ids], **({"next": "more"} if more else {})})


def read(spark, pages, total=None, **kept):
    root = json.dumps({"id": "1", "title": "A", **({} if total is None else {"nb_tracks": total})})
    rows = [("1", n, body) for n, body in pages]
    got = albums.deezer(spark.createDataFrame([("1", root)], "album_id string, body string"), spark.createDataFrame(rows, "album_id string, page int, body string"), **kept).first()
    return [(t["track_id"], t["position"]) for t in got["tracks"]], got["reason"]


def test_reading_ends_at_the_first_page_that_is_missing(spark):
    one, two = [("1", 1), ("2", 2)], [("1", 1), ("2", 2), ("3", 3)]
    assert read(spark, []) == ([], "upstream_error")
    assert read(spark, [(1, page(3))]) == ([], "upstream_error")
    assert read(spark, [(0, page(1, 2))]) == (one, "upstream_error")
    assert read(spark, [(2, page(4)), (0, page(1, 2))]) == (one, "upstream_error")
    assert read(spark, [(0, page(1, 2)), (1, page(3)), (3, page(5)), (4, page(6))]) == (two, "upstream_error")
    assert read(spark, [(0, page(1, 2)), (1, None), (2, page(4))]) == (one, "upstream_error")
    # nothing is asked for behind the end, nor behind the limit
    assert read(spark, [(0, page(1, 2)), (1, page(3, more=False)), (3, page(5))], 3) == (two, None)
    assert read(spark, [(0, page(1, 2)), (1, page())]) == (one, "unknown_total")
    assert read(spark, [(0, page(1, 2)), (2, page(4))], 9, limit=2) == (one, "limit")


def test_copies_of_a_page_count_once_and_no_more_than_all_pages_are_read(spark):
    assert read(spark, [(0, page(1)), (0, page(1)), (1, page(2, more=False)), (0, page(1))], 2) == ([("1", 1), ("2", 2)], None)
    every = [(i, page(100 + i)) for i in range(albums.PAGES + 5)]
    tracks, reason = read(spark, every)
    assert (len(tracks), tracks[-1], reason) == (albums.PAGES, (str(99 + albums.PAGES), albums.PAGES), "unknown_total")


def test_an_album_costs_what_its_pages_hold(spark):
    plan = entry.queries()["deezer_albums"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # the one window gives tracks their positions; places and numbers come from the gathered tracks
    assert len([line for line in plan if "Window [" in line]) == 1
    # the pages that there are are gone through, not a place for each that there might be
    assert not [line for line in plan if "aggregate(transform(" in line]
