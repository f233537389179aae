"""Graphs of albums within their rows."""

from pyspark.sql import functions as F

from melder.operators import graph

TRACKS = "album_id string, title string, tracks array<struct<track_id: string, title: string, disc: int, position: int, artists: array<string>>>"


def test_a_row_gives_what_the_joins_give(spark):
    t = lambda i, place, *artists: (i, f"T{i}", 1, place, list(artists))
    rows = [("1", "A", [t("x", 1, "Ann", "Ben"), t("y", 2, "Ann", "Ann"), t("x", 1, "Ann"), t("z", 3, " ", None)]), ("2", "B", []), ("3", None, None), ("4", "D", [t(str(i), i, *[f"N{j}" for j in range(i)]) for i in range(1, 5)]), ("5", "E", [t("u", 1, *[f"N{j}" for j in range(1002)]), t("v", 2, "Z")])]
    albums = spark.createDataFrame(rows, TRACKS)
    for caps in ((8, 5), (4, 1), (3, 100), (4096, 8192)):
        mine = graph.album_graphs(albums, "deezer", *caps)
        nodes, edges = graph.capped(*graph.album(albums, "deezer"), *caps)
        got = mine.select("root", "truncated", F.posexplode("nodes").alias("i", "n")).select("root", "n.id", "n.type", "n.name", F.col("i") + 1, "truncated")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, nodes.select("root", "id", "type", "name", "place", "truncated").collect())))
        columns = ["source", "target", "type", "disc", "position", "role"]
        got = mine.select("root", "truncated", F.posexplode("edges").alias("i", "e")).select("root", *[f"e.{c}" for c in columns], F.col("i") + 1, "truncated")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, edges.select("root", *columns, "place", "truncated").collect())))
    assert "Exchange" not in graph.album_graphs(albums, "deezer")._jdf.queryExecution().executedPlan().toString()
