"""Acceptance gates over scored candidates: facts of texts come from their distinct pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.functions.similarity import jaro_winkler, pair_facts, weighted, with_pairs
from melder.functions.text import FEATURED, artist_tokens, artist_words, clean_title, contains_run, qualifiers, same_markers, token_set_ratio, without_article

# Thresholds.
REJECT, REPORT, ARTIST, COMPONENT, TITLE = 0.40, 0.30, 0.45, 0.72, 0.72
SPELLING_JW, SPELLING_RATIO = 0.94, 0.85


def evidence(words: Column, wanted: Column, spelling: bool = True) -> Column:
    """Whether the wanted tokens stand together in a name's, or the names differ by spelling only."""
    found = contains_run(words, wanted)
    if not spelling:
        return found
    a, b = F.array_join(wanted, " "), F.array_join(words, " ")
    return found | ((F.size(wanted) > 0) & (jaro_winkler(a, b) >= SPELLING_JW) & (token_set_ratio(a, b) >= SPELLING_RATIO))


def _title_facts(pairs: DataFrame) -> DataFrame:
    """_version: whether versions agree; _guest: the words of Y where the wanted title is 'X (feat. Y)'
    and X the title, else null."""
    empty = F.lit("")
    rows = pairs.withColumns({"_base": F.trim(F.regexp_extract(F.coalesce("q_title", empty), FEATURED, 1)), "_vq": qualifiers(F.coalesce("q_title", empty)), "_vt": qualifiers(F.coalesce("title", empty))})
    guest = artist_tokens(F.regexp_extract(F.coalesce("q_title", empty), FEATURED, 2))
    same = (F.col("_base") != "") & (clean_title(F.col("_base")) == clean_title(F.col("title")))
    version = F.when((F.col("_vq") == "") & (F.col("_vt") == ""), True).otherwise(same_markers(F.col("_vq"), F.col("_vt")))
    return rows.withColumns({"_version": version, "_guest": F.when(same, guest)}).drop("_base", "_vq", "_vt")


def _artist_facts(pairs: DataFrame, spelling: bool) -> DataFrame:
    """_have: the words of the artist; _evidence: whether they show the wanted one."""
    empty = F.lit("")
    rows = pairs.withColumns({"_want": artist_words(F.coalesce("q_artist", empty)), "_have": artist_words(F.coalesce("artist", empty))})
    rows = rows.withColumns({"_want": without_article(F.col("_want")), "_have": without_article(F.col("_have"))})
    return rows.withColumn("_evidence", evidence(F.col("_have"), F.col("_want"), spelling)).drop("_want")


def gate(rows: DataFrame, spelling: bool = True) -> DataFrame:
    """rows with artist_ok, identity_ok and accepted.

    rows has what functions.similarity.score() makes; q_direct tells whether the query asks for
    an id. A null artist score passes, a null isrc is no isrc. 'X (feat. Y)' passes by title too
    if X is the title and Y is among the artists.
    """
    facts = {("q_title", "title"): _title_facts, ("q_artist", "artist"): lambda pairs: _artist_facts(pairs, spelling)}
    return _decide(with_pairs(rows, facts))


def judge(rows: DataFrame, method: str = "full") -> DataFrame:
    """score() and gate() in one: a pair of texts is looked at once for both."""
    scores = pair_facts(method)
    titles, artists = ("q_title", "title"), ("q_artist", "artist")
    facts = {**scores, titles: lambda p: _title_facts(scores[titles](p)), artists: lambda p: _artist_facts(scores[artists](p), method == "full")}
    return _decide(weighted(with_pairs(rows, facts)).drop("_ts", "_as", "_bs"))


def _decide(rows: DataFrame) -> DataFrame:
    """gate() of rows that have the facts of their pairs."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    q_direct = F.coalesce(F.col("q_direct"), F.lit(False))
    plain = ~q_direct & ~text("q_isrc")
    artist_ok = F.when(~text("q_artist"), True).when(plain & ~F.col("_evidence"), False).otherwise(F.coalesce(F.col("artist_score") >= ARTIST, F.lit(True)))
    same = text("isrc") & (F.upper(F.trim("isrc")) == F.upper(F.trim("q_isrc")))
    featured = F.when(F.col("_guest").isNotNull(), contains_run(F.col("_have"), F.col("_guest"))).otherwise(False)
    title_ok = ~text("q_title") | F.coalesce(F.col("title_score") >= TITLE, F.lit(False)) | featured
    parts = F.coalesce((F.col("title_score") >= COMPONENT) & (F.col("artist_score") >= COMPONENT), F.lit(False))
    identity_ok = F.when(text("q_isrc"), F.coalesce(same, F.lit(False))).when(F.coalesce(F.col("direct"), F.lit(False)), True).when(~F.col("_version") | ~title_ok, False).when(~q_direct, True).otherwise(parts)
    rows = rows.withColumns({"artist_ok": artist_ok, "identity_ok": identity_ok})
    return rows.withColumn("accepted", (F.col("score") >= REJECT) & F.col("artist_ok") & F.col("identity_ok")).drop("_have", "_evidence", "_guest", "_version")


def source_status(rows: DataFrame) -> DataFrame:
    """query_id, provider, n_evaluated, status of gated rows: matched if one is accepted, else
    identity_mismatch if one failed by identity alone, else below_threshold."""
    identity = (F.col("score") >= REJECT) & F.col("artist_ok") & ~F.col("identity_ok")
    return rows.groupBy("query_id", "provider").agg(
        F.count("*").alias("n_evaluated"),
        F.when(F.bool_or("accepted"), "matched").when(F.bool_or(identity), "identity_mismatch").otherwise("below_threshold").alias("status"),
    )
