"""What the resolution in two passes shuffles: requests alike, candidates and records move no more than they must."""

import pytest
from pyspark.sql import functions as F

from melder import queries_resolve
from melder.operators import enrich, retrieval
from melder.plans import projection as P
from melder.plans import stages
from melder.session import staged
from tests.test_stages import CATALOGUE, DETAIL, REQUEST, SOURCES, request, row

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    catalogue = [row("spotify", "s1", isrc="USAAA1"), row("deezer", "d1"), row("tidal", "t1", isrc="USAAA1")]
    requests = [request(3, "Song", "Ann Lee"), request(1, "song", "ann lee"), request(2, isrc="USAAA1"), request(4, "Song", "Ann Lee", isrc="USAAA1"), request(5, "Song", "Ann Lee", album="Album"), request(6, provider="deezer", native_id="d1")]
    made = (spark.createDataFrame(list(x), s) for x, s in ((requests, REQUEST), (catalogue, CATALOGUE), ([], DETAIL)))
    return [staged(df, "t") for df in made]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_requests_alike_are_resolved_once(tables):
    out = stages.run(*tables, SOURCES, "tokens")
    assert {r["query_id"] for r in out["first"].collect()} == {1, 2, 4, 5, 6}
    rows = stages.of_each(out["rows"], out["alike"]).collect()
    ids = lambda q: sorted(r["native_id"] for r in rows if r["query_id"] == q)
    assert ids(1) == ids(3) == ["d1", "s1", "t1"] and {r["query_id"] for r in rows} == {1, 2, 3, 4, 5, 6}


def test_trusted_candidates_are_told_by_their_tier(tables):
    requests, catalogue, _ = tables
    asked = staged(stages.cleaned(requests), "requests")
    first = stages.first_pass(asked, catalogue, retrieval.Index(catalogue), SOURCES)
    assert "Join" not in plan(first)
    got = {(r["query_id"], r["native_id"]) for r in first.where("trusted").collect()}
    assert got == {(q, i) for q in (1, 3, 5) for i in ("s1", "d1", "t1")} | {(q, i) for q in (2, 4) for i in ("s1", "t1")} | {(6, "d1")}
    assert [(r["query_id"], r["native_id"]) for r in first.where("not trusted").collect()] == [(4, "d1")]


def test_pages_come_from_the_written_catalogue(spark):
    _, catalogue, details = queries_resolve._tables(spark, SMALL)
    assert "Window" not in plan(details) and "Join" not in plan(details)
    assert details.count() == catalogue.where("line <> 6").count() > 0


def test_a_query_meets_its_matches_once(spark):
    seeds = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, title string")
    status = spark.createDataFrame([(1, "tidal", "matched"), (1, "deezer", "below_threshold"), (2, "spotify", "matched"), (2, "deezer", "matched"), (2, "tidal", "matched")], "query_id long, provider string, status string")
    got = enrich.second_pass(seeds.where("query_id < 3 or title = 'c'"), status, seeds, ["spotify", "deezer", "tidal"])
    assert {(r["query_id"], r["provider"], r["title"]) for r in got.collect()} == {(1, "spotify", "a"), (1, "deezer", "a"), *((3, p, "c") for p in ("spotify", "deezer", "tidal"))}
    text = plan(got.where(F.col("query_id") > 0))
    assert "LeftAnti" not in text


def test_carried_candidates_are_those_that_joins_give(tables):
    requests, catalogue, details = tables
    out = stages.run(requests, catalogue, details, SOURCES, "tokens")
    asked = stages.cleaned(requests).join(out["alike"].select(F.col("asked_id").alias("query_id")), "query_id", "left_semi")
    told = staged(stages.compared(asked.where(stages.input_type() != "artist_title"), out["seeds"]), "told")
    told = told.select("query_id", F.struct(*told.columns[1:]).alias("asked"))
    got = stages.carried(out["first"], out["second"], told)
    want = stages.candidates(asked, out["first"], out["second"], out["seeds"], catalogue)
    rows = lambda df: sorted(map(str, df.select(*got.columns).collect()))
    assert rows(got) == rows(want) and {r["pass"] for r in got.collect()} == {1, 2}
    # those of requests by id or ISRC meet their seeds, no other candidate meets anything
    text = plan(got.select("*"))
    assert text.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in text


def test_lines_are_made_one_before_their_texts(spark):
    got, want = P.records(spark, SMALL), P.view(spark, SMALL, P.CATALOGUE)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    moved = lambda df: [x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x]
    got, want = got.select("*"), want.select("*")
    assert len(moved(got)) == len(moved(want)) and "Window" in plan(got)
    below = plan(got)[plan(got).rindex("Exchange hashpartitioning(l_orderkey") :]
    assert "Official Video" not in below and "Official Video" in plan(got)
