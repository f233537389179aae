"""Retrieval and the resolution in two passes on small tables."""

import pytest
from pyspark.sql import functions as F

from melder.operators import enrich, retrieval
from melder.plans import stages
from melder.session import staged

CATALOGUE = "provider string, native_id string, title string, artist string, artists array<string>, album string, album_id string, position int, duration_ms long, isrc string, release_date string, label string"
REQUEST = "query_id long, q_title string, q_artist string, q_album string, q_isrc string, q_provider string, q_id string"
DETAIL = "provider string, native_id string, title string, artist string, isrc string, album_id string, duration_ms long, label string, release_date string"
SOURCES = ["spotify", "deezer", "tidal", "musicbrainz"]


def row(provider, native_id, title="Song", artist="Ann Lee", isrc=None, ms=180000, album="Album", artists=None, label=None):
    return (provider, native_id, title, artist, artists or [artist], album, f"al-{provider}", 1, ms, isrc, None, label)


def request(query_id, title=None, artist=None, isrc=None, provider=None, native_id=None, album=None):
    return (query_id, title, artist, album, isrc, provider, native_id)


def result(spark, catalogue, requests, details=(), **more):
    tables = (spark.createDataFrame(list(x), s) for x, s in ((requests, REQUEST), (catalogue, CATALOGUE), (details, DETAIL)))
    return {r["query_id"]: r for r in stages.resolve_requests(*tables, sources=SOURCES, method="tokens", **more).collect()}


def test_tiers_and_limits(spark):
    catalogue = [row("spotify", f"s{i:02}", isrc="USAAA1") for i in range(15)] + [row("deezer", f"d{i}", title=f"Song {'x ' * i}".strip()) for i in range(4)] + [row("tidal", "t0", artist="Other"), row("tidal", "t1", title=None), row("tidal", "t2", artist="The Lee Ann Band")]
    cat = spark.createDataFrame(catalogue, CATALOGUE)
    wanted = spark.createDataFrame([request(1, "song", "lee", isrc=" usaaa1 "), request(2, None, None, provider="Spotify", native_id="s03"), request(3, "nothing like it", "lee"), request(4, "song", None)], REQUEST)
    wanted = wanted.withColumn("provider", F.explode(F.array(*[F.lit(s) for s in SOURCES])))
    got = retrieval.retrieve(wanted, cat, retrieval.Index(cat)).collect()
    of = lambda q, p: [(r["native_id"], r["tier"]) for r in sorted(got, key=lambda r: r["rank"]) if (r["query_id"], r["provider"]) == (q, p)]
    assert of(1, "spotify") == [(f"s{i:02}", "isrc") for i in range(10)]
    assert of(1, "deezer") == [("d0", "words")] and of(1, "tidal") == [("t2", "words")]
    assert of(2, "spotify") == [("s03", "id")] and {r["query_id"] for r in got} == {1, 2}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_words_whatever_the_size_of_a_block(spark, block):
    titles = [f"{a} {b}" for a in ("red", "blue", "green") for b in ("moon", "sun", "sea")] + ["red moon live", "moon", "red red moon"]
    cat = spark.createDataFrame([row("spotify", f"{i}-{k}", title=t, artist=a) for i, t in enumerate(titles) for k, a in enumerate(("Ann", "Ann and Bob", "Bob"))], CATALOGUE)
    asked = spark.createDataFrame([(t, a) for t in titles for a in ("Ann", "Bob Ann")], "q_title string, q_artist string")
    got = {tuple(r)[:4] for r in retrieval.Index(cat, 0.5, block).similar(asked).collect()}
    words = lambda t: set(t.lower().split())
    names = lambda a: words(a) - {"and"}
    want = {(q, w, t, a) for q in titles for w in ("Ann", "Bob Ann") for t in titles for a in ("Ann", "Ann and Bob", "Bob") if len(words(q) & words(t)) / len(words(q) | words(t)) >= 0.5 and names(w) <= names(a)}
    assert got == want


def test_the_seed_of_an_id_asks_the_other_sources(spark):
    catalogue = [row("deezer", "d1", isrc="USAAA1"), row("spotify", "s1", isrc="usaaa1"), row("spotify", "s2"), row("tidal", "t1", title="Song (Live)", isrc="USAAA1"), row("tidal", "t2"), row("musicbrainz", "m1", title="Else", artist="Else")]
    got = result(spark, catalogue, [request(1, provider="deezer", native_id="d1"), request(2, provider="deezer", native_id="gone"), request(3, isrc="USAAA1")])
    assert set(got) == {1, 3}
    assert got[1]["sources"] == ["deezer", "spotify", "tidal"] and got[1]["cross_resolved"] and got[1]["ids"]["spotify"] == "s1"
    assert got[1]["isrc_votes"] == 3 and got[1]["confidence"] == "verified" and not got[3]["cross_resolved"]


def test_only_the_chosen_isrc_is_vouched_for(spark):
    got = result(spark, [row("spotify", "s1", isrc="USAAA1"), row("deezer", "d1", isrc="GBZZZ9")], [request(1, "Song", "Ann Lee")])
    assert got[1]["isrc_votes"] == 1 and got[1]["isrc"] == "USAAA1" and got[1]["confidence"] == "exact" and got[1]["identity_status"] == "strong"


def test_details_reveal_another_recording(spark):
    times = {"spotify": 112000, "deezer": 0, "tidal": 113000, "musicbrainz": 112500}
    catalogue = [row(p, p[0], ms=t, artists=["Ann Lee", "Bob"] if p == "tidal" else None) for p, t in times.items()]
    details = [("deezer", "d", "SONG ", "ann lee", None, None, 185000, "Found", None)]
    got = result(spark, catalogue, [request(1, "Song", "Ann Lee")], details)
    assert got[1]["sources"] == ["musicbrainz", "spotify", "tidal"] and got[1]["label"] is None and got[1]["artists"] == ["Ann Lee"]
    fine = result(spark, catalogue, [request(1, "Song", "Ann Lee")], [("deezer", "d", "Song", "Ann Lee", None, None, 112900, "Found", None)])
    assert len(fine[1]["sources"]) == 4 and fine[1]["label"] == "Found"


@pytest.mark.parametrize(
    ("change", "state"),
    [({}, "ok"), ({"title": "Other"}, "identity_mismatch"), ({"artist": "Other"}, "identity_mismatch"), ({"isrc": "OTHER"}, "identity_mismatch"), ({"isrc": None}, "identity_mismatch"), ({"duration_ms": 182001}, "identity_mismatch"), ({"duration_ms": 0}, "ok"), ({"album_id": "other"}, "identity_mismatch"), ({"album_id": None}, "ok"), ({"native_id": "2"}, "unavailable")],
)
def test_a_detail_must_be_the_same_record(spark, change, state):
    base = spark.createDataFrame([("deezer", "1", "Song", "Ann", "USAAA1", 180000, "al", "Old", True)], "provider string, native_id string, title string, artist string, isrc string, duration_ms long, album_id string, label string, flag boolean")
    page = dict(zip(("provider", "native_id", "title", "artist", "isrc", "duration_ms", "album_id", "label"), ("deezer", "1", " song", "ANN", "usaaa1", 181000, "al", "New"), strict=True)) | change
    detail = spark.createDataFrame([page], "provider string, native_id string, title string, artist string, isrc string, duration_ms long, album_id string, label string")
    got = enrich.with_detail(base, detail, ["label", "duration_ms"]).first()
    assert (got["hydration"], got["label"], got["title"]) == (state, "New" if state == "ok" else "Old", "Song")
    assert got["duration_ms"] == (181000 if state == "ok" and page["duration_ms"] else 180000)


def test_no_requests_and_no_catalogue(spark):
    assert result(spark, [], [request(1, "Song", "Ann")]) == {}
    assert result(spark, [row("spotify", "s1")], []) == {}


def test_what_grows_isnt_broadcast(spark):
    """However few bytes a table takes in Parquet, requests, records and candidates meet in shuffles."""
    cat = staged(spark.createDataFrame([row("spotify", "s1", isrc="USAAA1"), row("deezer", "d1")], CATALOGUE), "catalogue")
    asked = staged(stages.cleaned(spark.createDataFrame([request(1, "Song", "Ann Lee"), request(2, isrc="USAAA1")], REQUEST)), "requests")
    details = staged(spark.createDataFrame([], DETAIL), "details")
    index = retrieval.Index(cat)
    first = staged(stages.first_pass(asked, cat, index, SOURCES), "first")
    seed = staged(stages.seeds(asked, first, cat), "seeds")
    second = staged(stages.second_pass(seed, first, cat, index, SOURCES), "second")
    rows = stages.run(asked, cat, details, SOURCES, "tokens")["rows"]
    every = stages.candidates(asked, first, second, seed, cat)
    lazy = [stages.first_pass(asked, cat, index, SOURCES), stages.seeds(asked, first, cat), every, enrich.with_detail(every, details, ["label"]), stages.fused(rows)]
    wanted = asked.withColumn("provider", F.lit("spotify"))
    lazy += [retrieval.by_id(wanted, cat), retrieval.by_isrc(wanted, cat), enrich.second_pass(seed, first.withColumn("status", F.lit("matched")), seed, SOURCES)]
    for i, df in enumerate(lazy):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString(), i
