"""The engine's queries over the driver's tables, each with DuckDB's statement of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melder.functions import similarity, text
from melder.operators import albums, artists, enrich, fusion, gates, graph, identity, links, search, selection, state
from melder.plans import projection as P
from melder.plans.resolve import accepted, resolve
from melder.session import staged, table, unfolded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


C = f"({P.CANDIDATES}) c"
R = f"({P.RANKED}) r"


def _re(p: str) -> str:
    return "'" + p.replace("(?i)", "").replace("'", "''") + "'"


def _fold_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents({x})), '\s+', ' ', 'g'))"


def _clean_title_sql(x: str) -> str:
    for p in text.TITLE_NOISE:
        x = f"regexp_replace({x}, {_re(p)}, '', 'gi')"
    return _fold_sql(f"regexp_replace({x}, {_re(text.EMPTY_BRACKETS)}, '', 'g')")


def _clean_artist_sql(x: str) -> str:
    for p in text.ARTIST_NOISE:
        x = f"regexp_replace({x}, {_re(p)}, '', 'gi')"
    return _fold_sql(x)


def _tokens_sql(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda t: t <> ''))"


def _ratio_sql(a: str, b: str) -> str:
    x, y = _tokens_sql(a), _tokens_sql(b)
    inter = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 1.0 WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE {inter}::DOUBLE / (len({x}) + len({y}) - {inter}) END"


def _round2_sql(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def _qualifier_sql(x: str) -> str:
    return f"array_to_string(regexp_extract_all({x}, {_re(text.QUALIFIER)}, 1, 'i'), ' ')"


def _version_sql(a: str, b: str) -> str:
    return " AND ".join(f"(regexp_matches({_qualifier_sql(a)}, {_re(p)}, 'i') = regexp_matches({_qualifier_sql(b)}, {_re(p)}, 'i'))" for p in text.VERSION_MARKERS)


@query(f"SELECT DISTINCT title, {_clean_title_sql('title')} AS cleaned, {_clean_artist_sql('artist')} AS artist_cleaned, artist FROM {C}")
def clean_title_terms(spark: SparkSession, sf: str) -> DataFrame:
    """cleaned titles and artists."""
    d = P.view(spark, sf, P.CANDIDATES).select("title", "artist").distinct()
    return d.select("title", text.clean_title(F.col("title")).alias("cleaned"), text.clean_artist(F.col("artist")).alias("artist_cleaned"), "artist")


@query("SELECT lang, count(*) AS n, sum(length(strip_accents(text)))::BIGINT AS chars, sum(length(text))::BIGINT AS raw_chars FROM documents GROUP BY lang")
def strip_marks_totals(spark: SparkSession, sf: str) -> DataFrame:
    """F03 over whole documents."""
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length(text.strip_marks(F.col("text")))).alias("chars"), F.sum(F.length("text")).alias("raw_chars"))


@query(f"SELECT DISTINCT q_title, title, {_ratio_sql('q_title', 'title')} AS ratio FROM {C}")
def token_set_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """F06."""
    d = P.view(spark, sf, P.CANDIDATES).select("q_title", "title").distinct()
    return d.withColumn("ratio", text.token_set_ratio(F.col("q_title"), F.col("title")))


@query()
def jaro_winkler_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """F04, F05 on all pairs of distinct part names (64 of them)."""
    n = table(spark, sf, "part").select(F.col("p_name").alias("a")).distinct()
    pairs = n.join(n.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return pairs.withColumn("jw", text.round2(similarity.jaro_winkler(F.col("a"), F.col("b"))))


@query(f"SELECT DISTINCT q_title, title, {_version_sql('q_title', 'title')} AS compatible FROM {C}")
def version_gate(spark: SparkSession, sf: str) -> DataFrame:
    """P15."""
    d = P.view(spark, sf, P.CANDIDATES).select("q_title", "title").distinct()
    return d.withColumn("compatible", text.compatible_version(F.col("q_title"), F.col("title")))


@query(f"SELECT query_id, count(*) AS n FROM {C} WHERE q_isrc IS NOT NULL AND isrc IS NOT NULL AND upper(trim(isrc)) = upper(trim(q_isrc)) GROUP BY query_id")
def isrc_gate(spark: SparkSession, sf: str) -> DataFrame:
    """P11, first branch."""
    d = P.view(spark, sf, P.CANDIDATES).where(F.upper(F.trim("isrc")) == F.upper(F.trim("q_isrc")))
    return d.groupBy("query_id").agg(F.count("*").alias("n"))


_TS, _AS, _BS = (_round2_sql(_ratio_sql(a, b)) for a, b in ((_clean_title_sql("q_title"), _clean_title_sql("title")), (_clean_artist_sql("q_artist"), _clean_artist_sql("artist")), (_clean_title_sql("q_album"), _clean_title_sql("album"))))
_SCORED = f"""
SELECT *, CASE WHEN conflict THEN 0.0 WHEN direct OR same THEN 1.0 ELSE {_round2_sql("CASE WHEN raw >= 0.99 AND NOT both_isrc THEN 0.96 ELSE raw END")} END AS score,
  CASE WHEN conflict THEN NULL WHEN direct OR same THEN 1.0 ELSE ts END AS title_score, CASE WHEN conflict THEN NULL WHEN direct OR same THEN 1.0 ELSE ars END AS artist_score
FROM (SELECT *, CASE WHEN bs IS NULL THEN 0.55 * ts + 0.45 * ars ELSE 0.50 * ts + 0.40 * ars + 0.10 * bs END AS raw
  FROM (SELECT *, q_isrc IS NOT NULL AND isrc IS NOT NULL AS both_isrc,
      coalesce(upper(trim(q_isrc)) <> upper(trim(isrc)), false) AS conflict, coalesce(upper(q_isrc) = upper(isrc), false) AS same,
      {_TS} AS ts, {_AS} AS ars, CASE WHEN album IS NOT NULL THEN {_BS} END AS bs
    FROM {C}) a) b
"""


@query(f"SELECT query_id, provider, rank, title_score, artist_score, score FROM ({_SCORED}) s")
def candidate_score_token(spark: SparkSession, sf: str) -> DataFrame:
    """F07, F09 to F11 with the token ratio alone, which SQL can state."""
    return similarity.score(P.view(spark, sf, P.CANDIDATES), "tokens").select("query_id", "provider", "rank", "title_score", "artist_score", "score")


@query()
def candidate_score(spark: SparkSession, sf: str) -> DataFrame:
    """F09 with Jaro-Winkler."""
    return similarity.score(P.view(spark, sf, P.CANDIDATES)).select("query_id", "provider", "rank", "title_score", "artist_score", "album_score", "isrc_score", "score")


_WORDS = lambda x: rf"list_filter(regexp_split_to_array({_clean_artist_sql(x)}, '[^\p{{L}}\p{{Nd}}]+'), lambda t: t NOT IN ('', 'and', 'feat', 'featuring', 'ft'))"
_EVID = f"(' ' || array_to_string({_WORDS('artist')}, ' ') || ' ') LIKE ('% ' || array_to_string({_WORDS('q_artist')}, ' ') || ' %')"
_GATED = f"""
SELECT *, score >= 0.40 AND artist_ok AND identity_ok AS accepted FROM (
  SELECT *, CASE WHEN NOT q_direct AND q_isrc IS NULL AND NOT ({_EVID}) THEN false ELSE coalesce(artist_score >= 0.45, true) END AS artist_ok,
    CASE WHEN q_isrc IS NOT NULL THEN coalesce(upper(trim(isrc)) = upper(trim(q_isrc)), false) WHEN direct THEN true
      WHEN NOT ({_version_sql('q_title', 'title')}) THEN false WHEN NOT coalesce(title_score >= 0.72, false) THEN false
      WHEN NOT q_direct THEN true ELSE coalesce(title_score >= 0.72 AND artist_score >= 0.72, false) END AS identity_ok
  FROM ({_SCORED}) s) g
"""


@query(f"SELECT query_id, provider, count(*) AS n_evaluated, CASE WHEN bool_or(accepted) THEN 'matched' WHEN bool_or(score >= 0.40 AND artist_ok AND NOT identity_ok) THEN 'identity_mismatch' ELSE 'below_threshold' END AS status FROM ({_GATED}) x GROUP BY query_id, provider")
def source_status(spark: SparkSession, sf: str) -> DataFrame:
    """P09 to P12, A25 on token scores."""
    return gates.source_status(gates.judge(P.view(spark, sf, P.CANDIDATES, costly=True), "tokens"))


@query(f"SELECT query_id, provider, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, provider ORDER BY score DESC, rank) AS n FROM {R}) x WHERE n = 1")
def best_per_source(spark: SparkSession, sf: str) -> DataFrame:
    """A01, W01."""
    return selection.best_per_source(P.view(spark, sf, P.RANKED)).select("query_id", "provider", "score", "rank")


@query(f"SELECT query_id, provider, rank, native_id FROM {C} WHERE rank <= 3")
def top_per_source(spark: SparkSession, sf: str) -> DataFrame:
    """P16, W02."""
    return selection.top_per_source(P.view(spark, sf, P.CANDIDATES), 3).select("query_id", "provider", "rank", "native_id")


@query(f"""SELECT query_id, provider, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, provider, rank) AS n
FROM (SELECT * EXCLUDE (accepted), accepted AND query_id % 2 = 0 AS accepted FROM {R}) y WHERE query_id NOT IN (SELECT query_id FROM {R} WHERE accepted AND query_id % 2 = 0)) x WHERE n = 1 AND score >= 0.30 AND artist_ok AND identity_ok""")
def global_best_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A02; no row of an odd query counts as accepted."""
    rows = P.view(spark, sf, P.RANKED).select("query_id", "provider", "score", "rank", "accepted", "artist_ok", "identity_ok").withColumn("accepted", F.col("accepted") & (F.col("query_id") % 2 == 0))
    return selection.global_fallback(rows).select("query_id", "provider", "score", "rank")


_TIMED = f"(SELECT query_id, provider, duration_ms FROM (SELECT query_id, provider, duration_ms, row_number() OVER (PARTITION BY query_id, provider ORDER BY rank) AS n FROM {C} WHERE duration_ms > 0) t WHERE n = 1)"


@query(f"""WITH t AS {_TIMED}, s AS (SELECT query_id, provider, duration_ms, row_number() OVER (PARTITION BY query_id ORDER BY duration_ms, provider) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS m FROM t),
runs AS (SELECT a.query_id, a.i, any_value(a.m) AS m, count(*) AS n FROM s a JOIN s b ON a.query_id = b.query_id AND b.i >= a.i AND b.duration_ms - a.duration_ms <= greatest(10000, a.duration_ms // 20) GROUP BY a.query_id, a.i),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, i) AS k FROM runs) z WHERE k = 1 AND m >= 3 AND n >= 2 AND n * 2 > m),
anchor AS (SELECT best.query_id, s.duration_ms AS anchor FROM best JOIN s ON s.query_id = best.query_id AND s.i = (best.i + best.i + best.n - 1) // 2)
SELECT t.query_id, t.provider, t.duration_ms, coalesce(abs(t.duration_ms - anchor) > greatest(10000, anchor // 20), false) AS rejected FROM t LEFT JOIN anchor ON t.query_id = anchor.query_id""")
def duration_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """A03, W09."""
    return selection.duration_outliers(P.view(spark, sf, P.CANDIDATES))


@query(f"""WITH c AS (SELECT * FROM {C}), seed AS (SELECT query_id, duration_ms AS seed FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY provider, rank) AS n FROM c WHERE direct AND duration_ms > 0) x WHERE n = 1)
SELECT c.query_id, c.provider, bool_or(abs(duration_ms - seed) > greatest(10000, seed // 20)) AS rejected FROM c JOIN seed ON c.query_id = seed.query_id WHERE NOT direct AND duration_ms > 0 GROUP BY 1, 2""")
def direct_anchor_duration(spark: SparkSession, sf: str) -> DataFrame:
    """A04."""
    return selection.anchored_durations(P.view(spark, sf, P.CANDIDATES))


def _best(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The best row of each query and source with `columns` alone beside its keys: each one is shuffled and sorted."""
    return selection.best_per_source(P.view(spark, sf, P.RANKED).select("query_id", "provider", "score", "rank", *columns))


_B = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, provider ORDER BY score DESC, rank) AS bn FROM {R}) x WHERE bn = 1)"


def _rank_sql(field: str) -> str:
    order = fusion.OWN_ORDER.get(field, fusion.TITLE)
    return "CASE provider " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(order)) + f" ELSE {len(order)} END"


@query(f"SELECT query_id, provider, label AS value FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_rank_sql('label')}, provider) AS n FROM {_B} b WHERE label IS NOT NULL) x WHERE n = 1")
def priority_pick(spark: SparkSession, sf: str) -> DataFrame:
    """A07, A19."""
    return fusion.priority_pick(_best(spark, sf, "label"), "label")


_FUSED = ["title", "album", "duration_ms", "release_date", "isrc", "label"]
_LONG = " UNION ALL ".join(f"SELECT query_id, provider, score, '{f}' AS field, CAST({f} AS VARCHAR) AS value, {_rank_sql(f)} AS pr FROM b WHERE {f} IS NOT NULL" for f in _FUSED)
_CONSENSUS = f"""WITH b AS {_B}, l AS (SELECT *, lower(trim(value)) AS vote FROM ({_LONG}) u),
v AS (SELECT *, count(*) OVER (PARTITION BY query_id, field, vote) AS n_votes FROM l),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY n_votes DESC, pr, score DESC, provider) AS k FROM v),
s AS (SELECT query_id, field, vote, string_agg(provider, ',' ORDER BY provider) AS sources FROM l GROUP BY 1, 2, 3)
SELECT w.query_id, w.field, w.value, w.provider, w.n_votes, s.sources FROM w JOIN s ON w.query_id = s.query_id AND w.field = s.field AND w.vote = s.vote WHERE k = 1"""


@query(_CONSENSUS)
def consensus_pick(spark: SparkSession, sf: str) -> DataFrame:
    """A08, A09, W03 with the voters of each field."""
    won = fusion.choose(fusion.long_form(_best(spark, sf, *_FUSED), _FUSED), fusion.Policy(), _FUSED)
    return won.withColumn("sources", F.array_join("sources", ","))


@query(f"SELECT query_id, native_id, line AS track_number FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN provider = 'spotify' THEN 0 ELSE 1 END, {_rank_sql('album')}, score DESC, provider) AS n FROM {_B} b WHERE album IS NOT NULL) x WHERE n = 1")
def anchored_album_position(spark: SparkSession, sf: str) -> DataFrame:
    """The edition of the source asked for, here spotify, comes first."""
    order = ["spotify", *[p for p in fusion.TITLE if p != "spotify"]]
    rows = _best(spark, sf, "album", "native_id", "line").where("album is not null")
    key = F.struct(fusion.priority(F.col("provider"), order), (-F.col("score")).alias("s"), "provider")
    return rows.groupBy("query_id").agg(F.min_by(F.struct("native_id", F.col("line").alias("track_number")), key).alias("e")).select("query_id", "e.*")


@query(f"SELECT query_id, credit_name AS name, string_agg(role, ',' ORDER BY role) AS roles FROM (SELECT query_id, credit_name, min(role) AS role FROM {_B} b GROUP BY query_id, credit_name, lower(role)) x GROUP BY 1, 2")
def credits_union(spark: SparkSession, sf: str) -> DataFrame:
    """A15."""
    rows = _best(spark, sf, "credit_name", "role").select("query_id", F.col("credit_name").alias("name"), "role")
    return fusion.credits_union(rows).withColumn("roles", F.array_join("roles", ","))


@query(f"SELECT query_id, string_agg(DISTINCT genre, ',' ORDER BY genre) AS genres FROM {_B} b GROUP BY 1")
def genres_union(spark: SparkSession, sf: str) -> DataFrame:
    """A16, U03."""
    return fusion.union_sorted(_best(spark, sf, "genre"), "genre").select("query_id", F.array_join("values", ",").alias("genres"))


@query(f"""SELECT query_id, url, width, height, row_number() OVER (PARTITION BY query_id ORDER BY width * height DESC, url) AS place FROM
(SELECT query_id, image_url AS url, arg_max(width, provider) AS width, arg_max(height, provider) AS height FROM {_B} b GROUP BY 1, 2) x""")
def images_union(spark: SparkSession, sf: str) -> DataFrame:
    """A17."""
    return fusion.images_union(_best(spark, sf, "image_url", "width", "height").withColumnRenamed("image_url", "url"))


@query(f"WITH b AS {_B}, l AS ({_LONG}) SELECT query_id, field, count(DISTINCT provider) AS n_sources, count(DISTINCT value) AS n_values, count(DISTINCT value) > 1 AS different FROM l GROUP BY 1, 2 HAVING count(DISTINCT provider) >= 2")
def field_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """A24."""
    return fusion.comparison(_best(spark, sf, *_FUSED), _FUSED)


@query(f"""SELECT query_id, provider, 'track_' || substr(sha256('meta:' || {_clean_title_sql('title')} || '|' || {_clean_artist_sql('artist')}), 1, 16) AS canonical_id FROM {_B} b""")
def canonical_id(spark: SparkSession, sf: str) -> DataFrame:
    """F16."""
    rows = _best(spark, sf, "title", "artist", "isrc").withColumn("mbid", F.lit(None).cast("string"))
    return rows.select("query_id", "provider", identity.canonical_id("title", "artist", "isrc", "mbid").alias("canonical_id"))


_TRUST = "CASE provider " + " ".join(f"WHEN '{p}' THEN {t}" for p, t in identity.TRUST.items()) + f" ELSE {identity.DEFAULT_TRUST} END"


@query(f"SELECT query_id, provider, {_round2_sql(f'score * CAST({_TRUST} AS DOUBLE)')} AS confidence FROM {_B} b")
def identity_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """F15."""
    return _best(spark, sf).select("query_id", "provider", identity.identity_confidence(F.col("provider"), F.col("score")).alias("confidence"))


_VOTES = f"(SELECT query_id, max(n) AS votes FROM (SELECT query_id, count(*) AS n FROM {_B} b WHERE isrc IS NOT NULL GROUP BY query_id, lower(trim(isrc))) v GROUP BY 1)"
_PER = f"(SELECT p.*, coalesce(votes, 0) AS votes FROM (SELECT query_id, max(score) AS score, bool_or(provider = 'musicbrainz') AS mbid, bool_or(isrc IS NOT NULL) AS has_isrc FROM {_B} b GROUP BY 1) p LEFT JOIN {_VOTES} v ON p.query_id = v.query_id)"


@query(f"""SELECT query_id, CASE WHEN votes >= 2 THEN 'verified' WHEN score >= 0.95 THEN 'exact' WHEN score >= 0.85 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS level,
CASE WHEN score < 0.75 THEN 'weak' WHEN score < 0.85 THEN 'probable' WHEN votes >= 2 OR (mbid AND has_isrc) THEN 'verified' WHEN score >= 0.9 THEN 'strong' ELSE 'probable' END AS status,
concat_ws(',', CASE WHEN has_isrc THEN 'isrc_match' END, CASE WHEN mbid THEN 'musicbrainz_match' END, CASE WHEN score >= 0.9 THEN 'exact_title_artist_match' END, CASE WHEN votes >= 2 THEN 'multi_provider_isrc_consensus' END) AS reasons FROM {_PER} p""")
def identity_status(spark: SparkSession, sf: str) -> DataFrame:
    """The sources that agree on the chosen ISRC count, others with one of their own don't."""
    best = _best(spark, sf, "isrc")
    won = fusion.choose(fusion.long_form(best, ["isrc"]), fusion.Policy(), ["isrc"]).select("query_id", F.col("n_votes").alias("votes"))
    per = best.groupBy("query_id").agg(F.max("score").alias("score"), F.bool_or(F.col("provider") == "musicbrainz").alias("mbid"), F.bool_or(F.col("isrc").isNotNull()).alias("has_isrc")).join(won, "query_id", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    a = (F.col("score"), F.col("votes"), F.col("mbid"), F.col("has_isrc"))
    return per.select("query_id", identity.confidence_level(a[0], a[1]).alias("level"), identity.identity_status(*a).alias("status"), F.array_join(identity.identity_reasons(*a), ",").alias("reasons"))


@query(f"SELECT query_id, provider, round(0.12 + CASE WHEN isrc IS NOT NULL THEN 0.12 ELSE 0 END + CASE WHEN album IS NOT NULL THEN 0.08 ELSE 0 END + CASE WHEN duration_ms > 0 THEN 0.08 ELSE 0 END + 0.05 + CASE WHEN label IS NOT NULL THEN 0.04 ELSE 0 END, 4)::DOUBLE AS completeness FROM {_B} b")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """F14 over the fields that candidates have."""
    rows = _best(spark, sf, "title", "isrc", "album", "duration_ms", "release_date", "label").select("query_id", "provider", "title", "isrc", "album", "duration_ms", "release_date", "label")
    return rows.select("query_id", "provider", F.round(identity.completeness(rows), 4).alias("completeness"))


@query(f"SELECT query_id, provider, CASE WHEN direct THEN 'direct_id' WHEN isrc IS NOT NULL AND upper(isrc) = upper(q_isrc) THEN 'isrc' WHEN duration_ms > 0 THEN 'title_artist_duration' ELSE 'exact_title_artist' END AS method FROM {_B} b")
def identity_method(spark: SparkSession, sf: str) -> DataFrame:
    """F17."""
    same = F.coalesce(F.upper("isrc") == F.upper("q_isrc"), F.lit(False))
    return _best(spark, sf, "direct", "isrc", "q_isrc", "duration_ms").select("query_id", "provider", identity.identity_method(F.col("direct"), same, F.col("duration_ms")).alias("method"))


_LINKED_IDS = """CASE provider WHEN 'ytmusic' THEN lpad(native_id, 11, 'v') WHEN 'spotify' THEN lpad(native_id, 22, 's') WHEN 'amazonmusic' THEN CASE WHEN supp % 2 = 0 THEN lpad(native_id, 10, 'B') ELSE native_id END
 WHEN 'pandora' THEN CASE WHEN supp % 4 < 2 THEN 'TR:' || native_id ELSE native_id END WHEN 'soundcloud' THEN 'artist/' || native_id WHEN 'musicbrainz' THEN 'ABCDEF01-aaaa-BBBB-cccc-' || lpad(native_id, 12, '0') WHEN 'jiosaavn' THEN 'tok_' || native_id
 WHEN 'melon' THEN CASE WHEN supp % 4 < 2 THEN 'x' || native_id ELSE native_id END ELSE native_id END"""
_LINKED_URLS = """CASE provider WHEN 'deezer' THEN CASE supp % 3 WHEN 0 THEN 'https://www.deezer.com/en/track/' || native_id || '?utm_source=x' WHEN 1 THEN 'https://www.deezer.com/track/1' || native_id END WHEN 'tidal' THEN 'https://tidal.com/browse/track/' || native_id
 WHEN 'genie' THEN 'https://www.genie.co.kr/detail/songInfo?xgnm=' || native_id || '&x=1' WHEN 'jiosaavn' THEN 'https://www.jiosaavn.com/song/some-title/tok_' || native_id WHEN 'bugs' THEN 'http://music.bugs.co.kr/track/' || native_id
 WHEN 'applemusic' THEN CASE WHEN supp % 3 = 0 THEN 'https://music.apple.com/us/album/x/9?i=' || native_id || '&uo=4' ELSE 'https://music.apple.com/us/album/x/' || native_id END END"""
_LINKED_NATIVE = "CASE WHEN supp % 3 = 0 THEN CASE provider WHEN 'soundcloud' THEN native_id WHEN 'jiosaavn' THEN 'n' || native_id END END"
# expectations as they follow from the ids above, source by source
_LINKS = f"""SELECT query_id, provider AS platform, CASE WHEN supp % 3 = 0 AND provider = 'soundcloud' THEN native_id WHEN supp % 3 = 0 AND provider = 'jiosaavn' THEN 'n' || native_id ELSE {_LINKED_IDS} END AS id,
  CASE provider WHEN 'ytmusic' THEN 'video_id' WHEN 'amazonmusic' THEN CASE WHEN supp % 2 = 0 THEN 'asin' ELSE 'track_id' END WHEN 'pandora' THEN CASE WHEN supp % 4 < 2 THEN 'music_token' ELSE 'track_id' END WHEN 'musicbrainz' THEN 'recording_mbid'
    WHEN 'soundcloud' THEN CASE WHEN supp % 3 = 0 THEN 'track_id' ELSE 'permalink' END WHEN 'jiosaavn' THEN CASE WHEN supp % 3 = 0 THEN 'track_id' ELSE 'song_token' END ELSE 'track_id' END AS id_type,
  CASE WHEN supp % 3 = 0 AND provider = 'soundcloud' THEN 'artist/' || native_id WHEN supp % 3 = 0 AND provider = 'jiosaavn' THEN 'tok_' || native_id END AS lookup_id,
  CASE provider WHEN 'bugs' THEN 'https://music.bugs.co.kr/track/' || native_id WHEN 'genie' THEN 'https://www.genie.co.kr/detail/songInfo?xgnm=' || native_id WHEN 'melon' THEN 'https://www.melon.com/song/detail.htm?songId=' || native_id
    WHEN 'spotify' THEN 'https://open.spotify.com/track/' || lpad(native_id, 22, 's') WHEN 'ytmusic' THEN 'https://music.youtube.com/watch?v=' || lpad(native_id, 11, 'v')
    WHEN 'applemusic' THEN CASE WHEN supp % 3 = 0 THEN 'https://music.apple.com/us/album/x/9?i=' || native_id ELSE 'https://music.apple.com/us/song/' || native_id END
    WHEN 'deezer' THEN CASE WHEN supp % 3 = 0 THEN 'https://www.deezer.com/en/track/' || native_id ELSE 'https://www.deezer.com/track/' || native_id END WHEN 'tidal' THEN 'https://tidal.com/browse/track/' || native_id
    WHEN 'qobuz' THEN 'https://open.qobuz.com/track/' || native_id WHEN 'amazonmusic' THEN CASE WHEN supp % 2 = 0 THEN 'https://music.amazon.com/?trackAsin=' || lpad(native_id, 10, 'B') END WHEN 'soundcloud' THEN 'https://soundcloud.com/artist/' || native_id
    WHEN 'jiosaavn' THEN 'https://www.jiosaavn.com/song/some-title/tok_' || native_id WHEN 'musicbrainz' THEN 'https://musicbrainz.org/recording/ABCDEF01-aaaa-BBBB-cccc-' || lpad(native_id, 12, '0') END AS url,
  CASE WHEN provider IN ('tidal', 'jiosaavn') OR provider IN ('deezer', 'applemusic') AND supp % 3 = 0 THEN 'provider' WHEN provider = 'pandora' OR provider = 'amazonmusic' AND supp % 2 <> 0 THEN NULL ELSE 'id_template' END AS url_source
FROM {_B} b WHERE provider <> 'melon' OR supp % 4 >= 2"""


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf, "native_id", "supp").select("query_id", F.col("provider").alias("platform"), F.expr(_LINKED_IDS).alias("id"), F.expr(_LINKED_URLS).alias("provider_url"), F.expr(_LINKED_NATIVE).alias("native_id"))


@query(f"WITH l AS ({_LINKS}) SELECT * FROM l UNION ALL SELECT query_id, 'youtube', id, id_type, lookup_id, 'https://www.youtube.com/watch?v=' || id, 'id_template' FROM l WHERE platform = 'ytmusic'")
def platform_links(spark: SparkSession, sf: str) -> DataFrame:
    """Q01 to Q03: ids, kinds and URLs, with the sources' own URLs where they carry the id."""
    return links.build(_ids(spark, sf))


@query(f"""WITH l AS ({_LINKS}), h AS (SELECT query_id, platform FROM l UNION SELECT query_id, 'youtube' FROM l WHERE platform = 'ytmusic'),
q AS (SELECT DISTINCT query_id FROM l), p AS (SELECT unnest(['amazonmusic', 'applemusic', 'bugs', 'deezer', 'genie', 'jiosaavn', 'melon', 'musicbrainz', 'pandora', 'qobuz', 'soundcloud', 'spotify', 'tidal', 'youtube', 'ytmusic']) AS platform)
SELECT q.query_id, coalesce((SELECT string_agg(p.platform, ',' ORDER BY p.platform) FROM p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = q.query_id AND h.platform = p.platform)), '') AS platforms FROM q""")
def unavailable_platforms(spark: SparkSession, sf: str) -> DataFrame:
    """U04."""
    return links.unavailable(links.build(_ids(spark, sf))).withColumn("platforms", F.array_join("platforms", ","))


_QS = r"list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ('uo', 'at', 'ct', 'app', 'si') AND NOT starts_with(string_split(p, '=')[1], 'utm_')))"


@query(f"SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len({_QS}) > 0 THEN '?' || array_to_string({_QS}, '&') ELSE '' END || regexp_extract(url, '(#.*)$', 1) AS clean FROM pages")
def url_strip_tracking(spark: SparkSession, sf: str) -> DataFrame:
    """F25."""
    return table(spark, sf, "pages").select("page_id", links.without_tracking(F.col("url")).alias("clean"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM pages""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    """P02's host and path split."""
    return table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in links.parts(F.col("url")).items()])


@query(f"""SELECT c.query_id, p.provider FROM (SELECT DISTINCT query_id FROM {C}) c CROSS JOIN (SELECT unnest({links.PLATFORMS}) AS provider) p
EXCEPT SELECT query_id, provider FROM {R} WHERE accepted""")
def seed_second_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Sources to ask again with the seed's fields."""
    rows = P.view(spark, sf, P.RANKED)
    seeds = rows.select("query_id").distinct()
    status = rows.where("accepted").select("query_id", "provider", F.lit("matched").alias("status")).distinct()
    return enrich.second_pass(seeds, status, seeds, links.PLATFORMS).select("query_id", "provider")


_DETAIL = f"(SELECT provider, native_id, any_value(label) AS d_label, min(duration_ms) AS d_ms, min(isrc) AS d_isrc FROM (SELECT provider, native_id, 'detail ' || provider AS label, duration_ms + (supp % 3) * 1500 AS duration_ms, isrc FROM {C} WHERE line <= 4) d0 GROUP BY 1, 2)"


@query(f"""SELECT b.query_id, b.provider, CASE WHEN d_ms IS NOT NULL AND ok THEN d_label ELSE label END AS label, CASE WHEN d_ms IS NULL THEN 'no_detail' WHEN ok THEN 'ok' ELSE 'identity_mismatch' END AS hydration
FROM (SELECT b.*, d_label, d_ms, coalesce(upper(trim(isrc)) = upper(trim(d_isrc)), true) AND coalesce(abs(duration_ms - d_ms) <= 2000, true) AS ok FROM {_B} b LEFT JOIN {_DETAIL} d ON b.provider = d.provider AND b.native_id = d.native_id) b""")
def hydrate_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Detail with a check of identity."""
    d = P.view(spark, sf, P.CANDIDATES).where("line <= 4").select("provider", "native_id", F.concat(F.lit("detail "), "provider").alias("label"), (F.col("duration_ms") + (F.col("supp") % 3) * 1500).alias("duration_ms"), "isrc")
    d = d.groupBy("provider", "native_id").agg(F.min("label").alias("label"), F.min("duration_ms").alias("duration_ms"), F.min("isrc").alias("isrc"))
    return enrich.hydrate(_best(spark, sf, "native_id", "label", "isrc", "duration_ms"), d, ["label"]).select("query_id", "provider", "label", "hydration")


@query(f"""WITH b AS {_B}, a AS (SELECT query_id, provider, lower(trim(title)) AS t, lower(trim(artist)) AS a, lower(trim(coalesce(album, ''))) AS l, duration_ms FROM b)
SELECT x.query_id, x.provider, y.query_id || '/' || y.provider AS edition_id FROM a x JOIN a y ON x.t = y.t AND x.a = y.a AND x.l = y.l AND abs(x.duration_ms - y.duration_ms) <= 2000 WHERE x.query_id % 50 = 0""")
def edition_band_join(spark: SparkSession, sf: str) -> DataFrame:
    """Equal folded title, artist and album and a band of durations; every 50th query against all rows."""
    a = _best(spark, sf, "title", "artist", "album", "duration_ms").select("query_id", "provider", "title", "artist", "album", "duration_ms")
    cat = a.select("title", "artist", "album", "duration_ms", F.concat_ws("/", F.col("query_id").cast("string"), "provider").alias("edition_id"))
    return enrich.editions(a.where("query_id % 50 = 0"), cat).select("query_id", "provider", "edition_id")


@query("""SELECT c.user_id AS video_id, e.event_id AS point_id, count(*) OVER (PARTITION BY c.user_id) > 100 AS truncated FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') c
JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events) e ON c.user_id = e.user_id QUALIFY row_number() OVER (PARTITION BY c.user_id ORDER BY epoch_ms(e.ts), e.event_id) <= 100""")
def video_point_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """J12, W07."""
    e = table(spark, sf, "events")
    points = e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("point_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"))
    videos = e.where("event_type = 'signup'").select(F.col("user_id").alias("video_id")).distinct()
    return enrich.video_points(videos, points).select("video_id", "point_id", "truncated")


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    # written once: nodes, structured and loose credits read it
    b = staged(_best(spark, sf, "native_id", "title", "supp", "credit_name", "role"), "best")
    track = graph.node_id(F.col("provider"), F.lit("track"), F.col("native_id"))
    credits = b.select(F.col("query_id").alias("root"), "provider", track.alias("target"), F.when(F.col("supp") % 2 == 0, F.col("supp").cast("string")).alias("native_artist"), F.col("credit_name").alias("name"), text.role(F.col("role")).alias("role"))
    edges = graph.credit_edges(credits)
    nodes = b.select(F.col("query_id").alias("root"), track.alias("id"), F.lit("track").alias("type"), "provider", F.col("title").alias("name"), F.col("rank").alias("seq"))
    people = edges.select("root", F.col("source").alias("id"), F.lit("artist").alias("type"), F.lit("any").alias("provider"), F.lit("").alias("name"), F.lit(1).cast("long").alias("seq"))
    return graph.upsert(nodes.unionByName(people)), edges


_TRACK = "provider || ':track:' || native_id"
_ROLE = "CASE lower(role) WHEN 'music' THEN 'composer' ELSE lower(role) END"
_CREDITS = f"(SELECT DISTINCT query_id AS root, CASE WHEN supp % 2 = 0 THEN provider || ':artist:' || supp ELSE 'local:artist:' || substr(sha256(provider || chr(0) || {_TRACK} || chr(0) || credit_name), 1, 24) END AS source, {_TRACK} AS target, {_ROLE} AS role FROM {_B} b)"


@query(f"SELECT root, source, target, role FROM {_CREDITS} c")
def credit_edges(spark: SparkSession, sf: str) -> DataFrame:
    """G02, G03, F19, J16."""
    nodes, edges = _graph(spark, sf)
    return graph.add_edges(edges, nodes).select("root", "source", "target", F.array_join("attributes", ",").alias("role"))


@query(f"SELECT query_id AS root, {_TRACK} AS id, 'track' AS type FROM {_B} b UNION SELECT root, source, 'artist' FROM {_CREDITS} c")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """G01, G04, G05."""
    nodes, _ = _graph(spark, sf)
    return graph.bounded(nodes, ["id"], graph.MAX_NODES).select("root", "id", "type")


@query(f"SELECT root, count(DISTINCT source) AS contributors FROM {_CREDITS} c GROUP BY root")
def graph_contributors(spark: SparkSession, sf: str) -> DataFrame:
    """G07, J15."""
    nodes, edges = _graph(spark, sf)
    return graph.contributors(nodes, edges).groupBy("root").agg(F.count("*").alias("contributors"))


@query(f"SELECT album_id, disc, position, track_id, place FROM (SELECT DISTINCT album_id, disc, position, track_id, row_number() OVER (PARTITION BY album_id ORDER BY disc, position, track_id) AS place FROM (SELECT DISTINCT * FROM ({P.TRACKS}) t0) t) x WHERE place <= 5")
def album_tracklist(spark: SparkSession, sf: str) -> DataFrame:
    """L01, W06."""
    return albums.tracklist(P.view(spark, sf, P.TRACKS).distinct(), 5)


_COVER = f"""SELECT g.album_id, g.disc, returned, d = returned AND low = 1 AND high = returned AS contiguous, declared, coalesce(d = returned AND low = 1 AND high = returned AND declared = returned, false) AS complete
FROM (SELECT album_id, disc, count(*) AS returned, count(DISTINCT position) AS d, min(position) AS low, max(position) AS high FROM ({P.TRACKS}) t GROUP BY 1, 2) g LEFT JOIN ({P.DECLARED}) e ON g.album_id = e.album_id AND g.disc = e.disc"""


@query(_COVER)
def disc_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """A29."""
    return albums.disc_coverage(P.view(spark, sf, P.TRACKS), P.view(spark, sf, P.DECLARED))


@query(f"""WITH t AS (SELECT album_id, CASE WHEN count(*) FILTER (WHERE declared IS NULL) = 0 THEN sum(declared)::BIGINT END AS total FROM ({P.DECLARED}) d GROUP BY 1),
r AS (SELECT album_id, sum(returned)::BIGINT AS returned, bool_and(contiguous) AS valid FROM ({_COVER}) c GROUP BY 1)
SELECT r.album_id, returned, total, coalesce(valid AND total = returned, false) AS complete, CASE WHEN coalesce(valid AND total = returned, false) THEN NULL WHEN total IS NULL THEN 'unknown_total' ELSE 'incomplete_response' END AS reason FROM r JOIN t ON r.album_id = t.album_id""")
def album_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """A28, L06."""
    declared = P.view(spark, sf, P.DECLARED)
    cover = albums.disc_coverage(P.view(spark, sf, P.TRACKS), declared).groupBy("album_id").agg(F.sum("returned").alias("returned"), F.bool_and("contiguous").alias("valid"))
    rows = cover.join(albums.album_total(declared), "album_id").withColumns({"limited": F.lit(False), "failed": F.lit(False)})
    return albums.completeness(rows).select("album_id", "returned", "total", "complete", "reason")


@query(f"""WITH r AS (SELECT {_clean_artist_sql('name')} AS k, count(DISTINCT id) AS n, min(id) AS one FROM ({P.REFERENCES}) x GROUP BY 1)
SELECT a.name, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN one END AS id, coalesce(n, 0) AS n_candidates FROM ({P.ASKED}) a LEFT JOIN r ON {_clean_artist_sql('a.name')} = r.k""")
def artist_name_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """R02, U02."""
    return artists.resolve_names(P.view(spark, sf, P.ASKED), P.view(spark, sf, P.REFERENCES))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE TRY_CAST(replace(d, ',', '') AS BIGINT) END AS value FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN '1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') ELSE (c_custkey * 7)::VARCHAR END AS d FROM customer) x""")
def metric_parse(spark: SparkSession, sf: str) -> DataFrame:
    """exact numbers out of display texts; abbreviated ones have none."""
    k = F.col("c_custkey")
    shown = F.when(k % 3 == 0, F.concat((k % 10).cast("string"), F.lit(".5M views"))).when(k % 3 == 1, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" monthly listeners"))).otherwise(F.concat((k * 7).cast("string"), F.lit(" Subscribers")))
    return table(spark, sf, "customer").select("c_custkey", text.exact_metric(shown).alias("value"))


@query(f"SELECT query_id, provider, place, total FROM (SELECT query_id, provider, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, provider || native_id, provider) AS place, count(*) OVER (PARTITION BY query_id) AS total FROM {_B} b) x WHERE place > 3 AND place <= 6")
def search_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of three."""
    rows = _best(spark, sf, "native_id").select("query_id", "provider", "score", F.concat("provider", "native_id").alias("canonical_id"), F.array("provider").alias("available_on"))
    return search.page(rows, 2, 3).select("query_id", "provider", "place", "total")


@query(f"SELECT query_id, provider, concat_ws(',', CASE WHEN album IS NOT NULL THEN 'album' END, CASE WHEN isrc IS NOT NULL THEN 'isrc' END, CASE WHEN label IS NOT NULL THEN 'label' END, 'title') AS present, concat_ws(',', CASE WHEN album IS NULL THEN 'album' END, CASE WHEN isrc IS NULL THEN 'isrc' END, CASE WHEN label IS NULL THEN 'label' END) AS missing FROM {_B} b")
def extract_field_presence(spark: SparkSession, sf: str) -> DataFrame:
    """P24, X02."""
    out = search.presence(_best(spark, sf, "title", "album", "isrc", "label"), ["title", "album", "isrc", "label"])
    return out.select("query_id", "provider", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE p_size % 9 <> 0) AS successful, count(*) FILTER (WHERE p_size % 9 = 0) AS failed FROM part")
def bulk_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A26, X04."""
    return search.bulk_totals(table(spark, sf, "part").select(F.when(F.col("p_size") % 9 == 0, "invalid request").alias("error")))


_CIRCUIT = f"""WITH RECURSIVE e AS (SELECT source::BIGINT AS source, epoch_us(ts) / 1e6 AS at, failed, row_number() OVER (PARTITION BY source ORDER BY ts, seq) AS n FROM ({P.HEALTH_EVENTS}) h),
f AS (SELECT DISTINCT source, 0::BIGINT AS n, 0::BIGINT AS allowed, 0::BIGINT AS failures, 'active' AS state, 0.0::DOUBLE AS retry_at, 1::BIGINT AS generation FROM e
UNION ALL SELECT f.source, e.n, f.allowed + CASE WHEN skip THEN 0 ELSE 1 END,
  CASE WHEN skip THEN f.failures WHEN NOT e.failed THEN 0 ELSE f.failures + 1 END, CASE WHEN skip THEN f.state WHEN NOT e.failed THEN 'active' WHEN f.failures + 1 >= 3 THEN 'suspended' ELSE f.state END,
  CASE WHEN skip THEN f.retry_at WHEN NOT e.failed THEN 0.0 WHEN f.failures + 1 >= 3 THEN e.at + 60 ELSE f.retry_at END, CASE WHEN NOT skip AND e.failed AND f.failures + 1 >= 3 THEN f.generation + 1 ELSE f.generation END
  FROM (SELECT f.*, e.at AS e_at, f.state = 'suspended' AND e.at < f.retry_at AS skip FROM f JOIN e ON e.source = f.source AND e.n = f.n + 1) f JOIN e ON e.source = f.source AND e.n = f.n + 1),
last AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC) AS k FROM f)
SELECT source, n AS calls, allowed, failures, state, generation FROM last WHERE k = 1"""


@query(_CIRCUIT)
def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """T01, T02 as a fold over events in order of time."""
    return state.circuit(P.view(spark, sf, P.HEALTH_EVENTS))


@query("""SELECT key, value FROM (SELECT user_id AS key, event_type AS value, epoch_us(ts) / 1e6 + value * 36000 AS expires_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS n FROM events) x
WHERE n = 1 AND expires_at > (SELECT max(epoch_us(ts)) / 1e6 FROM events)""")
def ttl_cache_read(spark: SparkSession, sf: str) -> DataFrame:
    """The latest entry of each key that hasn't expired at the time of the last event."""
    e = table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    cache = e.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), (at + F.col("value") * 36000).alias("expires_at"), F.col("ts").alias("written_at"))
    return state.cache_read(cache, e.agg(F.max(at).alias("now")).first()["now"])


@query("SELECT event_id, least(CASE WHEN event_type = 'error' THEN 30 ELSE 86400 END, CASE WHEN event_type = 'view' AND value > 5 THEN 3600 WHEN event_type = 'view' THEN 300 ELSE 86400 END) AS ttl FROM events")
def adaptive_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """T05."""
    return table(spark, sf, "events").select("event_id", state.ttl(F.col("event_type") == "error", F.col("event_type") == "view", F.col("value") > 5).alias("ttl"))


@query("SELECT event_id AS request_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS leader FROM events")
def single_flight_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """One computation for each key."""
    r = table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"))
    return state.shared(r)[1].select("request_id", "leader")


@query(f"SELECT 'Composer' AS source_role, count(*) AS n FROM {_B} b WHERE lower(role) = 'composer' UNION ALL SELECT 'Lyricist', count(*) FROM {_B} b WHERE lower(role) = 'lyricist'")
def role_counts(spark: SparkSession, sf: str) -> DataFrame:
    """F19."""
    return _best(spark, sf, "role").groupBy(F.initcap(text.role(F.col("role"))).alias("source_role")).agg(F.count("*").alias("n"))


@query()
def resolve_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """One pass of the resolution, with Jaro-Winkler scores."""
    return resolve(P.view(spark, sf, P.CANDIDATES))


@query(f"""WITH g AS MATERIALIZED ({_GATED}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, provider ORDER BY score DESC, rank) AS n FROM g WHERE accepted) x WHERE n = 1),
s AS (SELECT query_id, duration_ms, row_number() OVER (PARTITION BY query_id ORDER BY duration_ms, provider) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS m FROM b WHERE duration_ms > 0 AND q_isrc IS NULL AND NOT q_direct),
runs AS (SELECT x.query_id, x.i, any_value(x.m) AS m, count(*) AS n FROM s x JOIN s y ON x.query_id = y.query_id AND y.i >= x.i AND y.duration_ms - x.duration_ms <= greatest(10000, x.duration_ms // 20) GROUP BY x.query_id, x.i),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, i) AS k FROM runs) z WHERE k = 1 AND m >= 3 AND n >= 2 AND n * 2 > m),
anchor AS (SELECT top.query_id, s.duration_ms AS ms FROM top JOIN s ON s.query_id = top.query_id AND s.i = (top.i + top.i + top.n - 1) // 2
  UNION ALL SELECT query_id, duration_ms FROM b WHERE direct AND duration_ms > 0 AND q_isrc IS NULL),
kept AS (SELECT b.query_id, b.provider, b.rank, b.score FROM b LEFT JOIN anchor ON b.query_id = anchor.query_id WHERE b.direct OR coalesce(b.duration_ms <= 0 OR abs(b.duration_ms - anchor.ms) <= greatest(10000, anchor.ms // 20), true))
SELECT query_id, provider, rank, score FROM kept UNION ALL
SELECT query_id, provider, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, provider, rank) AS n FROM g) x WHERE n = 1 AND score >= 0.30 AND artist_ok AND identity_ok AND query_id NOT IN (SELECT query_id FROM kept)""")
def accepted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A01 to A05 as the resolution combines them, on token scores: the rows that are fused."""
    kept = accepted(P.view(spark, sf, P.CANDIDATES), "tokens")
    return unfolded(kept, ["query_id"], "rows", "r").select("query_id", "r.provider", "r.rank", "r.score")


@query()
def html_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """S24 over raw pages: what JSON they hold, or why none is taken."""
    from melder.sources.html import recover

    return recover(table(spark, sf, "pages"))
