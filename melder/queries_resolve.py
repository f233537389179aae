"""Queries of retrieval and of the resolution in two passes, with DuckDB's statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melder.operators import retrieval
from melder.operators.links import PLATFORMS
from melder.plans import projection as P
from melder.plans import stages
from melder.queries import _clean_artist_sql, _clean_title_sql, _ratio_sql, _rank_sql, _round2_sql, _tokens_sql, _version_sql, query
from melder.session import staged

_NAMES = lambda x: rf"list_filter(regexp_split_to_array({_clean_artist_sql(x)}, '[^\p{{L}}\p{{Nd}}]+'), lambda t: t NOT IN ('', 'and', 'feat', 'featuring', 'ft'))"
_CAT = f"cat AS MATERIALIZED (SELECT * FROM ({P.CATALOGUE}) c)"
# cleaned texts of the catalogue and of requests, once each
_TEXTS = f"""ct AS MATERIALIZED (SELECT *, {_tokens_sql('clean')} AS tw, list_distinct({_NAMES('artist')}) AS aw FROM (SELECT DISTINCT title, artist, {_clean_title_sql('title')} AS clean FROM cat) t)"""


def _retrieved(name: str, asked: str) -> str:
    """CTEs that end in `name`: query_id, provider, native_id, rank, tier; `asked` has a row for each
    request and source."""
    return f"""{name}_id AS (SELECT w.query_id, w.provider, c.native_id, 1::BIGINT AS rank, 'id' AS tier FROM {asked} w JOIN cat c ON c.provider = w.provider AND c.native_id = w.q_id WHERE w.provider = w.q_provider),
{name}_rest AS (SELECT * FROM {asked} WHERE q_provider IS NULL OR provider <> q_provider),
{name}_code AS (SELECT query_id, provider, native_id, rank, 'isrc' AS tier FROM (SELECT w.query_id, w.provider, c.native_id, row_number() OVER (PARTITION BY w.query_id, w.provider ORDER BY c.native_id) AS rank
  FROM {name}_rest w JOIN cat c ON c.provider = w.provider AND upper(trim(c.isrc)) = upper(trim(w.q_isrc))) x WHERE rank <= 10),
{name}_left AS (SELECT * FROM {name}_rest w WHERE q_title <> '' AND q_artist <> '' AND NOT EXISTS (SELECT 1 FROM {name}_code c WHERE c.query_id = w.query_id AND c.provider = w.provider)),
{name}_text AS (SELECT *, {_tokens_sql('clean')} AS tw, list_distinct({_NAMES('q_artist')}) AS aw FROM (SELECT DISTINCT q_title, q_artist, {_clean_title_sql('q_title')} AS clean FROM {name}_left) t),
{name}_pair AS (SELECT q.q_title, q.q_artist, c.title, c.artist, {_ratio_sql('q.clean', 'c.clean')} AS ratio, len(list_intersect(q.aw, c.aw))::DOUBLE / len(list_distinct(list_concat(q.aw, c.aw))) AS artist_ratio
  FROM {name}_text q JOIN ct c ON len(q.aw) > 0 AND len(list_intersect(q.aw, c.aw)) = len(q.aw)),
{name}_words AS (SELECT query_id, provider, native_id, rank, 'words' AS tier FROM (SELECT w.query_id, w.provider, c.native_id, row_number() OVER (PARTITION BY w.query_id, w.provider ORDER BY 0.55 * ratio + 0.45 * artist_ratio DESC, c.native_id) AS rank
  FROM {name}_left w JOIN {name}_pair p ON w.q_title = p.q_title AND w.q_artist = p.q_artist JOIN cat c ON c.title = p.title AND c.artist = p.artist AND c.provider = w.provider WHERE ratio >= 0.72) x WHERE rank <= 10),
{name} AS MATERIALIZED (SELECT * FROM {name}_id UNION ALL SELECT * FROM {name}_code UNION ALL SELECT * FROM {name}_words)"""


_REQ = f"req AS MATERIALIZED (SELECT query_id, {_clean_title_sql('q_title')} AS q_title, {_clean_artist_sql('q_artist')} AS q_artist, q_album, q_isrc, q_provider, q_id FROM ({P.REQUESTS}) r)"
_ASKED = f"asked AS (SELECT req.*, provider FROM req CROSS JOIN (SELECT unnest({PLATFORMS}) AS provider) p WHERE q_provider IS NULL OR q_title IS NOT NULL OR q_isrc IS NOT NULL OR provider = q_provider)"
_FIRST = f"""WITH {_CAT}, {_TEXTS}, {_REQ}, {_ASKED}, {_retrieved('got', 'asked')},
first AS MATERIALIZED (SELECT g.*, CASE WHEN q_provider IS NOT NULL THEN g.provider = q_provider AND g.native_id = q_id WHEN q_isrc IS NOT NULL THEN coalesce(upper(trim(c.isrc)) = upper(trim(q_isrc)), false) ELSE true END AS trusted
  FROM got g JOIN req ON g.query_id = req.query_id JOIN cat c ON c.provider = g.provider AND c.native_id = g.native_id)"""


def _seed_field(f: str) -> str:
    return f"(SELECT query_id, value AS s_{f} FROM (SELECT query_id, {f} AS value, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, {_rank_sql(f)}, provider) AS k FROM (SELECT *, count(*) OVER (PARTITION BY query_id, lower(trim({f}))) AS votes FROM one WHERE trim({f}) <> '') v) x WHERE k = 1)"


_SECOND = f"""{_FIRST},
one AS (SELECT * FROM (SELECT f.query_id, f.provider, title, artist, album, isrc, row_number() OVER (PARTITION BY f.query_id, f.provider ORDER BY f.rank) AS n FROM first f JOIN req ON req.query_id = f.query_id JOIN cat c ON c.provider = f.provider AND c.native_id = f.native_id
  WHERE trusted AND (q_provider IS NOT NULL OR q_isrc IS NOT NULL)) x WHERE n = 1),
seed AS MATERIALIZED (SELECT * FROM {_seed_field('title')} t LEFT JOIN {_seed_field('artist')} a USING (query_id) LEFT JOIN {_seed_field('album')} l USING (query_id) LEFT JOIN {_seed_field('isrc')} i USING (query_id)),
again AS (SELECT query_id, {_clean_title_sql('s_title')} AS q_title, {_clean_artist_sql('s_artist')} AS q_artist, s_isrc AS q_isrc, NULL::VARCHAR AS q_provider, NULL::VARCHAR AS q_id, provider FROM seed CROSS JOIN (SELECT unnest({PLATFORMS}) AS provider) p
  WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.query_id = seed.query_id AND one.provider = p.provider)),
{_retrieved('more', 'again')}"""


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    catalogue = staged(P.records(spark, sf), "catalogue")
    artists = F.when(F.col("guest").isNull(), F.array("artist")).otherwise(F.array("artist", "guest"))
    return P.view(spark, sf, P.REQUESTS), catalogue.withColumn("artists", artists), P.pages(catalogue)


def _indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, retrieval.Index]:
    requests, catalogue, _ = _tables(spark, sf)
    return staged(stages.cleaned(requests), "requests"), catalogue, retrieval.Index(catalogue)


@query(f"{_FIRST} SELECT query_id, provider, native_id, rank, tier, trusted FROM first")
def first_pass_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Requests to candidates by id, ISRC and words, without ready-made pairs."""
    asked, catalogue, index = _indexed(spark, sf)
    return stages.first_pass(asked, catalogue, index)


@query(f"{_SECOND} SELECT query_id, provider, native_id, rank, tier FROM more")
def second_pass_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Sources without a trusted candidate, asked with the seed's texts and ISRC."""
    asked, catalogue, index = _indexed(spark, sf)
    asked = asked.where(stages.input_type() != "artist_title")  # only these have seeds
    first = staged(stages.first_pass(asked, catalogue, index), "first")
    return stages.second_pass(staged(stages.seeds(asked, first, catalogue), "seeds"), first, catalogue, index)


_TS, _AS, _BS = (_round2_sql(_ratio_sql(a, b)) for a, b in ((_clean_title_sql("q_title"), _clean_title_sql("title")), (_clean_artist_sql("q_artist"), _clean_artist_sql("artist")), (_clean_title_sql("q_album"), _clean_title_sql("album"))))
_EVID = f"(' ' || array_to_string({_NAMES('artist')}, ' ') || ' ') LIKE ('% ' || array_to_string({_NAMES('q_artist')}, ' ') || ' %')"
_JUDGED = f"""{_SECOND},
cand AS MATERIALIZED (SELECT g.query_id, g.provider, g.native_id, g.rank, pass, c.title, c.artist, c.guest, c.album, c.album_id, c.position, c.duration_ms, c.isrc, c.release_date, c.label, coalesce(r.q_title, s_title) AS q_title, coalesce(r.q_artist, s_artist) AS q_artist,
  coalesce(r.q_album, s_album) AS q_album, coalesce(r.q_isrc, s_isrc) AS q_isrc, q_provider IS NOT NULL AS q_direct, coalesce(q_provider = g.provider AND q_id = g.native_id, false) AS direct
  FROM (SELECT query_id, provider, native_id, rank, 1 AS pass FROM first WHERE trusted UNION ALL SELECT query_id, provider, native_id, rank, 2 FROM more) g JOIN req r ON r.query_id = g.query_id LEFT JOIN seed s ON s.query_id = g.query_id
  JOIN cat c ON c.provider = g.provider AND c.native_id = g.native_id),
facts AS MATERIALIZED (SELECT *, {_TS} AS ts, {_AS} AS ars, CASE WHEN album IS NOT NULL AND q_album IS NOT NULL THEN {_BS} END AS bs, {_version_sql('q_title', 'title')} AS version, {_EVID} AS evidence FROM (SELECT DISTINCT q_title, title, q_artist, artist, q_album, album FROM cand) d),
scored AS (SELECT *, CASE WHEN conflict THEN 0.0 WHEN direct OR same THEN 1.0 ELSE {_round2_sql("CASE WHEN raw >= 0.99 AND NOT (q_isrc IS NOT NULL AND isrc IS NOT NULL) THEN 0.96 ELSE raw END")} END AS score,
  CASE WHEN conflict THEN NULL WHEN direct OR same THEN 1.0 ELSE ts END AS title_score, CASE WHEN conflict THEN NULL WHEN direct OR same THEN 1.0 ELSE ars END AS artist_score
  FROM (SELECT c.*, ts, ars, version, evidence, CASE WHEN bs IS NULL THEN 0.55 * ts + 0.45 * ars ELSE 0.50 * ts + 0.40 * ars + 0.10 * bs END AS raw, coalesce(upper(q_isrc) <> upper(isrc), false) AS conflict, coalesce(upper(q_isrc) = upper(isrc), false) AS same
    FROM cand c JOIN facts f ON c.q_title IS NOT DISTINCT FROM f.q_title AND c.title = f.title AND c.q_artist IS NOT DISTINCT FROM f.q_artist AND c.artist = f.artist AND c.q_album IS NOT DISTINCT FROM f.q_album AND c.album IS NOT DISTINCT FROM f.album) x),
g AS MATERIALIZED (SELECT *, CASE WHEN NOT q_direct AND q_isrc IS NULL AND NOT evidence THEN false ELSE coalesce(artist_score >= 0.45, true) END AS artist_ok,
  CASE WHEN q_isrc IS NOT NULL THEN coalesce(upper(isrc) = upper(q_isrc), false) WHEN direct THEN true WHEN NOT version THEN false WHEN NOT coalesce(title_score >= 0.72, false) THEN false WHEN NOT q_direct THEN true ELSE coalesce(title_score >= 0.72 AND artist_score >= 0.72, false) END AS identity_ok FROM scored)"""


def _without_strays(name: str, rows: str, extra: str = "") -> str:
    """CTEs that end in `name`: rows without strays of duration, by ISRC all, by id those off the direct one."""
    return f"""{name}_s AS (SELECT query_id, duration_ms, row_number() OVER (PARTITION BY query_id ORDER BY duration_ms, provider) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS m FROM {rows} WHERE duration_ms > 0 AND q_isrc IS NULL AND NOT q_direct),
{name}_runs AS (SELECT x.query_id, x.i, any_value(x.m) AS m, count(*) AS n FROM {name}_s x JOIN {name}_s y ON x.query_id = y.query_id AND y.i >= x.i AND y.duration_ms - x.duration_ms <= greatest(10000, x.duration_ms // 20) GROUP BY x.query_id, x.i),
{name}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, i) AS k FROM {name}_runs) z WHERE k = 1 AND m >= 3 AND n >= 2 AND n * 2 > m),
{name}_anchor AS (SELECT t.query_id, s.duration_ms AS ms FROM {name}_top t JOIN {name}_s s ON s.query_id = t.query_id AND s.i = (t.i + t.i + t.n - 1) // 2 UNION ALL SELECT query_id, duration_ms FROM {rows} WHERE direct AND duration_ms > 0 AND q_isrc IS NULL),
{name} AS MATERIALIZED (SELECT r.* FROM {rows} r LEFT JOIN {name}_anchor a ON r.query_id = a.query_id WHERE r.direct OR coalesce(r.duration_ms <= 0 OR abs(r.duration_ms - a.ms) <= greatest(10000, a.ms // 20), true))"""


_ACCEPTED = f"""{_JUDGED},
best AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, provider ORDER BY score DESC, rank) AS n FROM g WHERE score >= 0.40 AND artist_ok AND identity_ok) x WHERE n = 1),
{_without_strays('near', 'best')},
fallback AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, provider, rank) AS n FROM g) x WHERE n = 1 AND score >= 0.30 AND artist_ok AND identity_ok AND query_id NOT IN (SELECT query_id FROM near)),
taken AS MATERIALIZED (SELECT * FROM near UNION ALL SELECT * FROM fallback)"""
_HYDRATED = f"""{_ACCEPTED},
page AS MATERIALIZED (SELECT * FROM ({P.DETAILS}) d),
fine AS (SELECT t.*, d.native_id IS NOT NULL AS there, d.label AS d_label, d.duration_ms AS d_ms, d.album_id AS d_album,
  coalesce(t.isrc = d.isrc, t.isrc IS NULL) AND NOT coalesce(t.duration_ms > 0 AND abs(t.duration_ms - d.duration_ms) > 2000, false) AND coalesce(t.album_id = d.album_id, true) AND lower(t.title) = lower(d.title) AND t.artist = d.artist AS agrees
  FROM taken t LEFT JOIN page d ON d.provider = t.provider AND d.native_id = t.native_id),
rich AS MATERIALIZED (SELECT * EXCLUDE (there, d_label, d_ms, d_album, agrees, duration_ms, label, album_id), CASE WHEN agrees THEN d_ms ELSE duration_ms END AS duration_ms, CASE WHEN agrees THEN coalesce(d_label, label) ELSE label END AS label, CASE WHEN agrees THEN d_album ELSE album_id END AS album_id,
  CASE WHEN NOT there THEN 'unavailable' WHEN agrees THEN 'ok' ELSE 'identity_mismatch' END AS hydration FROM fine),
{_without_strays('final', 'rich')}"""


@query(f"{_HYDRATED} SELECT query_id, provider, native_id, pass, score, duration_ms, label, album_id, hydration FROM final")
def hydrated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """J01 to J05, A01 to A05 on token scores: both passes, scored, gated, hydrated, durations checked again."""
    out = stages.run(*_tables(spark, sf), method="tokens")
    rows = stages.of_each(out["hydrated"], out["alike"]).select("query_id", F.explode("rows").alias("e")).select("query_id", "e.*")
    return rows.select("query_id", "provider", "native_id", "pass", "score", "duration_ms", "label", "album_id", "hydration")


def _field(f: str) -> str:
    return f"(SELECT query_id, value AS {f}, votes AS {f}_votes FROM (SELECT query_id, {f} AS value, votes, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, {_rank_sql(f)}, score DESC, provider) AS k FROM (SELECT *, count(*) OVER (PARTITION BY query_id, lower(trim({f}))) AS votes FROM final WHERE trim({f}) <> '') v) x WHERE k = 1)"


@query(f"""{_HYDRATED},
top AS (SELECT query_id, max(score) AS match_score, count(*) AS n_sources, bool_or(provider = 'musicbrainz') AS mbid, bool_or(pass = 2) AS cross_resolved, string_agg(provider, ',' ORDER BY provider) AS sources FROM final GROUP BY 1)
SELECT top.query_id, title, isrc, coalesce(isrc_votes, 0) AS isrc_votes, label, match_score, n_sources, sources, cross_resolved,
  CASE WHEN isrc_votes >= 2 THEN 'verified' WHEN match_score >= 0.95 THEN 'exact' WHEN match_score >= 0.85 THEN 'high' WHEN match_score >= 0.7 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN match_score < 0.75 THEN 'weak' WHEN match_score < 0.85 THEN 'probable' WHEN coalesce(isrc_votes, 0) >= 2 OR (mbid AND isrc IS NOT NULL) THEN 'verified' WHEN match_score >= 0.9 THEN 'strong' ELSE 'probable' END AS identity_status
FROM top LEFT JOIN {_field('title')} t USING (query_id) LEFT JOIN {_field('isrc')} i USING (query_id) LEFT JOIN {_field('label')} l USING (query_id)""")
def resolved_requests_token(spark: SparkSession, sf: str) -> DataFrame:
    """Results of both passes on token scores."""
    out = stages.resolve_requests(*_tables(spark, sf), method="tokens")
    return out.select("query_id", "title", "isrc", "isrc_votes", "label", "match_score", F.size("sources").cast("long").alias("n_sources"), F.array_join("sources", ",").alias("sources"), "cross_resolved", "confidence", "identity_status")


@query()
def resolved_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Results of both passes with Jaro-Winkler scores, artists, edition, ids and links."""
    out = stages.resolve_requests(*_tables(spark, sf))
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), " ")
    return out.withColumns({"artists": F.array_join("artists", ", "), "sources": F.array_join("sources", ","), **{m: shown(m) for m in ("ids", "links", "album_ids")}})
