"""Known answers for normalization, similarity and parsing."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from melder.functions import similarity, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("title", "want"),
    [("Believer (Official Video)", "believer"), ("Bohemian Rhapsody (2011 Remaster)", "bohemian rhapsody"), ("Café de Flore (HD)", "cafe de flore"), ("Song 2011 Remaster", "song 2011"), ("", "")],
)
def test_clean_title(spark, title, want):
    assert one(spark, text.clean_title(F.col("t")), t=title) == want


@pytest.mark.parametrize(("name", "want"), [("Mötley Crüe", "motley crue"), ("AP Dhillon - Topic", "ap dhillon"), ("KatyPerryVEVO", "katyperry")])
def test_clean_artist(spark, name, want):
    assert one(spark, text.clean_artist(F.col("t")), t=name) == want


@pytest.mark.parametrize(
    ("a", "b", "want"), [("Tum Hi Ho", "Tum Hi Ho (Remix)", False), ("Song - Live", "Song (Live at Wembley)", True), ("Live Forever", "Live Forever", True), ("X (Re-Imagined)", "X [reimagining]", True)]
)
def test_version(spark, a, b, want):
    assert one(spark, text.compatible_version(F.col("a"), F.col("b")), a=a, b=b) is want


def test_strip_marks_is_nfd_without_marks(spark):
    words = ["Ångström", "été", "naïve", "ガギ", "łódź", "ø", "Ǆ", "한글", "ﬁ", "Ω", "x̧"]
    got = [r["x"] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(text.strip_marks(F.col("w")).alias("x")).collect()]
    plain = lambda s: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))
    assert got == [plain(w) for w in words]


def test_jaro_winkler_counts_halves():
    assert similarity.jaro_winkler_bytes(b"martha", b"marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.jaro(b"abc", b"") == 0.0
    assert similarity.jaro(b"", b"") == 1.0
    # three of the matched bytes stand elsewhere: one and a half transpositions
    assert similarity.jaro(b"abcdef", b"bcadef") == pytest.approx((1 + 1 + (6 - 1.5) / 6) / 3)


@pytest.mark.parametrize(("t", "want"), [("3:05", 185000), ("1:02:03", 3723000), ("45", 45000), ("x", 0), ("1:2:3:4", 0)])
def test_clock(spark, t, want):
    assert one(spark, text.clock_ms(F.col("t")), t=t) == want


@pytest.mark.parametrize(("t", "want"), [("PT3M5S", 185000), ("PT1H", 3600000), ("PT2.5S", 2500), ("PT25H", 0), ("3M", 0), ("PT", 0)])
def test_iso_duration(spark, t, want):
    assert one(spark, text.iso_duration_ms(F.col("t")), t=t) == want


@pytest.mark.parametrize(("t", "want"), [("1,234 monthly listeners", 1234), ("99 views", 99), ("1.5M subscribers", None), ("", None)])
def test_metric(spark, t, want):
    assert one(spark, text.exact_metric(F.col("t")), t=t) == want


def test_round2_is_half_up_on_the_scaled_value(spark):
    assert spark.range(1).select(text.round2(F.lit(1.005)).alias("x"), text.round2(F.lit(0.125)).alias("y")).first()[:] == (1.0, 0.13)


def test_roles_and_relationships(spark):
    assert one(spark, text.role(F.col("t")), t="작곡가") == "composer"
    assert one(spark, text.role(F.col("t")), t="Lead Guitar") == "lead_guitar"
    assert one(spark, text.relationship(F.col("t")), t="remix") == "remix_of"
    assert one(spark, text.relationship(F.col("t")), t="based on") == "relationship"
