"""Scores, gates, selection, fusion, links, graph and state on small hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from melder.functions import similarity
from melder.operators import albums, fusion, gates, graph, links, selection, state

ROW = "query_id long, provider string, rank int, title string, artist string, album string, isrc string, duration_ms long, q_title string, q_artist string, q_album string, q_isrc string, q_direct boolean, direct boolean"


def cand(provider="spotify", rank=1, title="Song", artist="Ann", album=None, isrc=None, ms=200000, q_title="Song", q_artist="Ann", q_album=None, q_isrc=None, q_direct=False, direct=False, q=1):
    return (q, provider, rank, title, artist, album, isrc, ms, q_title, q_artist, q_album, q_isrc, q_direct, direct)


def scored(spark, *rows):
    return similarity.score(spark.createDataFrame(list(rows), ROW))


def test_scores(spark):
    rows = [
        cand(isrc="USABC1", q_isrc="usabc1"), cand(isrc="USABC1", q_isrc="GBXYZ2"), cand(), cand(direct=True, title="Else", q_direct=True), cand(title="Something Other", artist="Bob"),
    ]
    got = scored(spark, *[(*r[:2], i, *r[3:]) for i, r in enumerate(rows)]).orderBy("rank").collect()
    assert [r["score"] for r in got[:4]] == [1.0, 0.0, 0.96, 1.0]
    assert got[1]["isrc_score"] == 0.0 and got[1]["title_score"] is None
    assert got[2]["album_score"] is None
    assert got[4]["score"] < 0.5


def test_gates(spark):
    rows = [cand(), cand(artist="Other"), cand(title="Song (Live)"), cand(isrc=None, q_isrc="USABC1"), cand(q_title="Song (feat. Bob)", artist="Ann & Bob", title="Song")]
    got = gates.gate(scored(spark, *[(*r[:2], i, *r[3:]) for i, r in enumerate(rows)])).orderBy("rank").collect()
    assert [r["accepted"] for r in got] == [True, False, False, False, True]


@pytest.mark.parametrize(
    ("times", "rejected"),
    [
        ([112939, 112000, 113000, 185000, 0], {"p3"}),
        ([110000, 110000, 185000, 185000], set()),
        ([110000, 185000], set()),
        ([110000, 110000, 115000], set()),
    ],
)
def test_duration_outliers(spark, times, rejected):
    rows = spark.createDataFrame([(1, f"p{i}", 1, t) for i, t in enumerate(times)], "query_id long, provider string, rank int, duration_ms long")
    got = {r["provider"] for r in selection.duration_outliers(rows).where("rejected").collect()}
    assert got == rejected
    one = rows.groupBy("query_id").agg(F.collect_list(F.struct("provider", "duration_ms")).alias("rows"))
    left = {r["provider"] for r in selection.without_outliers(one, "rows").select(F.explode("rows").alias("r")).select("r.*").collect()}
    assert left == {f"p{i}" for i in range(len(times))} - rejected


def test_best_and_fallback(spark):
    rows = spark.createDataFrame([(1, "b", 1, 0.9, True, True, True), (1, "b", 2, 0.9, True, True, True), (1, "a", 1, 0.5, True, True, True), (2, "a", 1, 0.35, False, True, True), (2, "b", 1, 0.2, False, True, True)], "query_id long, provider string, rank int, score double, accepted boolean, artist_ok boolean, identity_ok boolean")
    assert {(r["provider"], r["rank"]) for r in selection.best_per_source(rows.where("query_id = 1")).collect()} == {("a", 1), ("b", 1)}
    assert [(r["query_id"], r["provider"]) for r in selection.global_fallback(rows).collect()] == [(2, "a")]


def test_consensus_and_priority(spark):
    rows = spark.createDataFrame([(1, "spotify", 0.9, "A"), (1, "deezer", 0.8, "b"), (1, "tidal", 0.7, "B ")], "query_id long, provider string, score double, title string")
    by = lambda p: fusion.choose(fusion.long_form(rows, ["title"]), p, ["title"]).first()
    votes = by(fusion.Policy())
    assert (votes["value"], votes["n_votes"], votes["sources"]) == ("B ", 2, ["deezer", "tidal"])
    assert by(fusion.Policy("priority"))["value"] == "A"
    assert by(fusion.Policy("consensus", {"title": ["deezer"]}))["value"] == "b"


@pytest.mark.parametrize("text", ['{"mode": "x"}', '{"mode": "priority", "other": 1}', '{"priorities": {"track_number": ["a"]}}', '{"priorities": {"title": ["a", "A"]}}', '{"mode": "priority", "mode": "consensus"}'])
def test_policy_is_strict(text):
    with pytest.raises(ValueError):
        fusion.Policy.parse(text)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://open.spotify.com/track/4cOdK2wGLETKBW3PvgPWqT?si=x", ("spotify", "4cOdK2wGLETKBW3PvgPWqT")),
        ("https://youtu.be/dQw4w9WgXcQ", ("ytmusic", "dQw4w9WgXcQ")),
        ("https://music.apple.com/us/album/x/1?i=22", ("applemusic", "22")),
        ("http://open.spotify.com/track/4cOdK2wGLETKBW3PvgPWqT", None),
        ("https://open.spotify.com:80/track/4cOdK2wGLETKBW3PvgPWqT", None),
        ("https://soundcloud.com/a%2Fb/c", None),
        ("https://example.com/track/1", None),
    ],
)
def test_recognise(spark, url, want):
    got = links.recognised(spark.createDataFrame([(url,)], "u string"), "u").first()["link"]
    assert (None if got is None else (got["provider"], got["id"])) == want


def test_without_tracking(spark):
    got = spark.createDataFrame([("https://a.b/c?utm_source=x&z=1&b=2&si=q#f",), ("https://a.b/c?si=1",)], "u string").select(links.without_tracking(F.col("u")).alias("x")).collect()
    assert [r["x"] for r in got] == ["https://a.b/c?b=2&z=1#f", "https://a.b/c"]


def test_graph(spark):
    credits = spark.createDataFrame([(1, "deezer", "t1", "9", "Ann", "composer"), (1, "deezer", "t1", None, "ann", "composer"), (1, "deezer", "t1", None, "Bob", "composer"), (1, "tidal", "t2", None, "Bob", "composer")], "root long, provider string, target string, native_artist string, name string, role string")
    edges = graph.credit_edges(credits)
    assert edges.count() == 3 and edges.select("source").distinct().count() == 3
    nodes = spark.createDataFrame([(1, "t1", "track", "deezer", "", 1), (1, "t1", "track", "deezer", "Name", 2)], "root long, id string, type string, provider string, name string, seq int")
    assert graph.upsert(nodes).first()["name"] == "Name"
    assert graph.add_edges(edges, graph.upsert(nodes)).count() == 0  # sources are no nodes here
    back = spark.createDataFrame([(1, "a", "b", "remix_of", "backward"), (1, "a", "b", "remix_of", None)], "root long, source string, target string, type string, direction string")
    assert {tuple(r)[1:] for r in graph.directed(back).collect()} == {("b", "a", "remix_of"), ("a", "b", "relationship")}


def test_album_reasons(spark):
    rows = spark.createDataFrame([(1, 3, 3, True, False, False), (2, 3, None, True, False, False), (3, 2, 5, True, True, False), (4, 2, 5, True, False, True), (5, 2, 5, True, False, False)], "album_id long, returned long, total long, valid boolean, limited boolean, failed boolean")
    assert [r["reason"] for r in albums.completeness(rows).orderBy("album_id").collect()] == [None, "unknown_total", "limit", "upstream_error", "incomplete_response"]


def test_circuit():
    s = ("active", 0, 0.0, 1)
    for at in (1, 2, 3):
        s, ok = state.step(s, at, True)
        assert ok
    assert s[0] == "suspended" and s[3] == 2
    s, ok = state.step(s, 30, False)
    assert not ok
    s, ok = state.step(s, 70, True)  # the probe fails
    assert ok and s[0] == "suspended" and s[2] == 130
    s, ok = state.step(s, 140, True, missing=True)
    assert ok and s == ("active", 0, 0.0, 3)


def test_best_rows_are_shuffled_once_and_narrow(spark, tmp_path):
    """One shuffle of lineitem serves the ranks, the best rows and their fusion; part isn't broadcast."""
    from melder import queries

    spark.createDataFrame([(1, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", datetime(2020, 1, 1))], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "Song", "Ann", "Album")], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    plan = lambda q: queries.QUERIES[q](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    for q in ("global_best_fallback", "consensus_pick", "field_comparison", "platform_links"):
        p = plan(q)
        assert "Broadcast" not in p and "Union" not in p and p.count("FileScan") == 2, q
