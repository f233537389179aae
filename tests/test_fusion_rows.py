"""Fusion within a query's row."""

import random

from pyspark.sql import functions as F

from melder.operators import fusion
from melder.plans.resolve import resolve
from tests.test_engine import ROW, cand

ENTRY = "query_id int, provider string, score double, title string, duration_ms bigint, isrc string, label string, artist string"


def test_a_row_gives_what_the_shuffled_values_give(spark):
    dice = random.Random(5)
    pick = lambda *of: dice.choice([None, *of])
    sources = [*fusion.TITLE, "Tidal2", "other"]
    rows = [(q, p, pick(0.5, 0.9, 0.9), pick("", " ", "Song", " song ", "SONG", "Else"), pick(0, 0, 1000, 2000), pick("A1", "a1", "B2"), pick("L", "l ", "M"), pick("Ann", "ann", "Ben")) for q in range(60) for p in dice.sample(sources, dice.randint(1, 14))]
    rows.append((99, "deezer", 0.5, None, 0, " ", "", None))
    long = spark.createDataFrame(rows, ENTRY)
    names = {"title": "title", "duration_ms": "duration_ms", "isrc": "isrc", "label": "label", "artists": "artist"}
    per = long.groupBy("query_id").agg(F.collect_list(F.struct(*[c for c in long.columns if c != "query_id"])).alias("rows"))
    for policy in (fusion.Policy(), fusion.Policy("priority"), fusion.Policy("consensus", {"isrc": ["other", "bugs"], "artists": ["melon"]})):
        want = fusion.choose(fusion.long_form(long.withColumnRenamed("artist", "artists"), list(names)), policy, list(names))
        want = {(r["query_id"], r["field"], r["value"], r["provider"], r["n_votes"]) for r in want.collect()}
        made = fusion.chosen(per, "rows", policy, names)
        assert made.columns == ["query_id", "rows", *names]
        got = {(r["query_id"], f, *r[f]) for r in made.collect() for f in names if r[f] is not None}
        assert got == want and len(want) > 200


def test_fused_rows_are_not_shuffled(spark):
    rows = [cand(provider=p, rank=i, isrc=isrc, q_isrc=None) for i, (p, isrc) in enumerate([("deezer", "USABC1"), ("tidal", "usabc1"), ("bugs", "GBXYZ1")])]
    full = spark.createDataFrame(rows, ROW).selectExpr("*", "cast(null as string) as release_date", "cast(null as string) as label")
    out = resolve(full)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    r = out.first()
    assert (r["n_sources"], r["isrc"], r["confidence"]) == (3, "usabc1", "verified")
