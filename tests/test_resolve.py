"""Which rows a request's resolution keeps."""

from melder.plans.resolve import accepted
from tests.test_engine import ROW, cand


def kept(spark, *rows):
    full = spark.createDataFrame(list(rows), ROW).selectExpr("*", "cast(null as string) as release_date", "cast(null as string) as label")
    return {(r["query_id"], e["provider"]) for r in accepted(full).collect() for e in r["rows"]}


def timed(times, **more):
    return [cand(provider=f"p{i}", ms=t, isrc=more.get("q_isrc"), direct=bool(more.get("q_direct")) and i == 0, **more) for i, t in enumerate(times)]


def test_strays_go_unless_asked_by_isrc(spark):
    times = [112939, 112000, 113000, 185000, 0]
    assert kept(spark, *timed(times)) == {(1, p) for p in ("p0", "p1", "p2", "p4")}
    assert len(kept(spark, *timed(times, q_isrc="USABC1"))) == 5


def test_the_row_asked_for_by_id_sets_the_duration(spark):
    assert kept(spark, *timed([185000, 112000, 113000, 184000], q_direct=True)) == {(1, "p0"), (1, "p3")}
    assert len(kept(spark, *timed([0, 112000, 185000], q_direct=True))) == 3


def test_a_lone_row_below_the_threshold(spark):
    # nothing asked for but an album: any artist scores 0.8 * 0.45 = 0.36
    low = [cand(provider=p, rank=i, q_title=None, q_artist=None, artist="Ann") for i, p in enumerate(["tidal", "deezer"])]
    assert kept(spark, *low) == {(1, "deezer")}
    assert kept(spark, *low, cand(provider="spotify", q_title=None, q_artist=None, artist="Ann", direct=True)) == {(1, "spotify")}
    assert kept(spark, cand(artist="Other"), cand(provider="b", title="Else", artist="Other")) == set()


def test_pairs_too_large_to_broadcast_give_the_same_scores(spark, monkeypatch):
    from melder.functions import similarity
    from melder.operators import gates

    rows = spark.createDataFrame([cand(rank=i, title=t, artist=a, q_artist=None if i == 3 else "Ann") for i, (t, a) in enumerate([("Song", "Ann"), ("Sonk", "Anna"), (None, "Ann"), ("Song", None), ("Song", "Ann")])], ROW)
    shown = lambda: sorted(map(str, gates.judge(rows).collect()))
    small = shown()
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", -1)
    assert shown() == small and len(small) == 5
