"""The recursive graph of nested records."""

import json

from melder.operators import recordings


def test_flatten():
    work = {"id": "w", "title": "Work", "relations": [{"type": "composer", "direction": "backward", "artist": {"id": "c", "name": "Comp"}}]}
    record = {"id": "r", "title": "Rec", "artist-credit": [{"artist": {"id": "a", "name": "Ann"}}], "releases": [{"id": "rel", "title": "R", "release-group": {"id": "g"}}], "relations": [{"type": "performance", "direction": "forward", "work": work}, {"type": "remix", "direction": "backward", "recording": {"id": "r2"}}, {"type": "odd", "recording": {"id": "r3"}}]}
    nodes, edges, cut = recordings.flatten("recording", record)
    m = "musicbrainz:"
    assert not cut and len(nodes) == 8
    assert set(edges) == {
        (m + "artist:a", m + "recording:r", "credit", "primary_artist"), (m + "recording:r", m + "release:rel", "appears_on", None), (m + "release:rel", m + "release_group:g", "edition_of", None),
        (m + "recording:r", m + "work:w", "recording_of", None), (m + "artist:c", m + "work:w", "credit", "composer"), (m + "recording:r2", m + "recording:r", "remix_of", None), (m + "recording:r", m + "recording:r3", "relationship", None),
    }


def test_depth_is_bounded(spark):
    record = {"id": "0"}
    for i in range(1, 9):
        record = {"id": str(i), "relations": [{"type": "edit", "direction": "forward", "recording": record}]}
    rows = spark.createDataFrame([("x", "recording", json.dumps(record)), ("y", "recording", "{broken")], "root string, kind string, body string")
    got = {r["root"]: r for r in recordings.recording_graph(rows).collect()}
    assert got["x"]["truncated"] and len(got["x"]["nodes"]) == 5 and len(got["x"]["edges"]) == 4
    assert not got["y"]["nodes"]
