"""Requests, sources, and walks through JSON."""

import json

import pytest
from pyspark.sql import functions as F

from melder.plans import gateway
from melder.sources import walk


def test_parse():
    assert gateway.parse('{"title": "T", "artist": "A"}') == ("resolve", {"title": "T", "artist": "A"})
    assert gateway.parse('{"operation": "search", "q": "x", "page": 2}') == ("search", {"q": "x", "page": 2})


@pytest.mark.parametrize("body", ["", "[]", "{} {}", '{"operation": "drop"}', '{"x": 1}', '{"title": {"a": 1}}', '{"title": "a", "title": "b"}', '{"title": null}', '{"operation": 3}'])
def test_bad_requests(body):
    with pytest.raises(gateway.BadRequest):
        gateway.parse(body)


def test_run():
    assert gateway.run('{"operation": "search", "q": "x"}', {"search": lambda q: q}) == "x"


def test_validate(spark):
    rows = [("https://x", None, None, None, None), (None, "1", None, None, None), (None, None, "I", None, None), (None, None, None, "A", "T"), (None, None, None, "A", None), ("https://x", "1", None, None, None)]
    got = gateway.validate(spark.createDataFrame(rows, "url string, deezer_id string, isrc string, artist string, title string")).collect()
    assert [r["input_type"] for r in got] == ["url", "deezer_id", "isrc", "artist_title", None, None]
    assert [r["error"] is None for r in got] == [True, True, True, True, False, False]


def test_sources():
    assert gateway.sources("Deezer, spotify,deezer", {"deezer", "spotify"}) == ["deezer", "spotify"]
    assert gateway.sources(["tidal", "deezer"], {"deezer"}) == ["deezer"]
    with pytest.raises(gateway.BadRequest):
        gateway.sources("nowhere", set())


def test_walks(spark):
    doc = {"b": [{"row": {"n": 1}}, {"x": {"row": {"n": 2, "row": {"n": 9}}}}], "a": {"row": {"n": 0}}, "accessToken": "s", "c": {"id": 5, "v": 1}}
    assert [x["n"] for x in walk.named(doc, "row", 10)] == [0, 1, 2]
    assert [x["n"] for x in walk.named(doc, "row", 2)] == [0, 1]
    assert "accessToken" not in walk.cleaned(doc)
    assert walk.entity(doc, {"5"}) == {"id": 5, "v": 1} and walk.entity(doc, {"6"}) is None
    df = spark.createDataFrame([(json.dumps(doc),), ("{broken",), (None,)], "j string")
    got = df.select(walk.find_json(F.col("j"), "row", 1).alias("f"), walk.clean_json(F.col("j")).alias("c")).collect()
    assert [len(r["f"]) for r in got] == [1, 0, 0] and "Token" not in got[0]["c"] and got[1]["c"] is None
