"""Queries of single operators over small roles of the driver's tables, each with DuckDB's statement.

The SQL states expectations literally or by another formulation, not from the operators' own tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melder.functions import similarity, text
from melder.operators import artists, fusion, identity, links, selection, state
from melder.plans import projection as P
from melder.queries import _B, _best, _clean_artist_sql, _ratio_sql, query
from melder.session import table

_SHOWN = """SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_orderkey % 7
  WHEN 0 THEN CAST(o_orderkey % 3 AS STRING) || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') || ':07'
  WHEN 1 THEN CAST(o_orderkey % 50 AS STRING) || ':' || lpad(CAST(o_custkey % 60 AS STRING), 2, '0')
  WHEN 2 THEN CAST(o_orderkey % 500 AS STRING)
  WHEN 3 THEN 'PT' || CAST(o_orderkey % 9 AS STRING) || 'M' || CAST(o_custkey % 60 AS STRING) || '.5S'
  WHEN 4 THEN 'PT' || CAST(o_orderkey % 40 AS STRING) || 'H'
  WHEN 5 THEN 'live' ELSE '' END AS shown FROM orders"""


@query(rf"""SELECT id, CASE WHEN regexp_matches(shown, '^[0-9]+(:[0-9]+)?(:[0-9]+)?$') THEN
    (SELECT coalesce(sum(try_cast(x AS BIGINT) * power(60, n - i)), 0)::BIGINT * 1000 FROM (SELECT unnest(string_split(shown, ':')) AS x, unnest(range(1, len(string_split(shown, ':')) + 1)) AS i, len(string_split(shown, ':')) AS n)) ELSE 0 END AS clock_ms,
  CASE WHEN shown LIKE 'PT%M%S' THEN (regexp_extract(shown, 'PT([0-9]+)M', 1)::BIGINT * 60000 + round(regexp_extract(shown, 'M([0-9.]+)S', 1)::DOUBLE * 1000))::BIGINT
    WHEN shown LIKE 'PT%H' AND regexp_extract(shown, 'PT([0-9]+)H', 1)::BIGINT <= 24 THEN regexp_extract(shown, 'PT([0-9]+)H', 1)::BIGINT * 3600000 ELSE 0 END AS iso_ms
FROM ({_SHOWN}) s""")
def display_durations(spark: SparkSession, sf: str) -> DataFrame:
    """Durations as catalogues show them."""
    d = P.view(spark, sf, _SHOWN)
    return d.select("id", text.clock_ms(F.col("shown")).alias("clock_ms"), text.iso_duration_ms(F.col("shown")).alias("iso_ms"))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(round(CASE WHEN event_id % 5 = 0 THEN -value WHEN event_id % 7 = 0 THEN value * 1e9 ELSE value END * 1000) AS BIGINT) END AS ms FROM events WHERE event_id % 11 = 0 OR (event_id % 5 <> 0 OR value = 0) AND (event_id % 7 <> 0 OR event_id % 5 = 0 OR value <= 1) UNION ALL SELECT event_id, NULL FROM events WHERE NOT (event_id % 11 = 0 OR (event_id % 5 <> 0 OR value = 0) AND (event_id % 7 <> 0 OR event_id % 5 = 0 OR value <= 1))")
def finite_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """seconds that aren't finite, are negative or beyond 1e9 have no milliseconds."""
    v, k = F.col("value").cast("double"), F.col("event_id")
    given = F.when(k % 11 == 0, F.lit(float("nan"))).when(k % 5 == 0, -v).when(k % 7 == 0, v * 1e9).otherwise(v)
    return table(spark, sf, "events").select("event_id", text.finite_seconds_ms(given).alias("ms"))


_CHANNEL = "CASE s_suppkey % 6 WHEN 0 THEN s_name || ' - Topic' WHEN 1 THEN s_name || 'VEVO' WHEN 2 THEN s_name || ' - VEVO' WHEN 3 THEN s_name || ' - Topic and more' WHEN 4 THEN s_name || 'vevo' ELSE ' ' || s_name END"


@query("SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 6 = 4 THEN 'vevo' ELSE '' END AS channel FROM supplier")
def channel_names(spark: SparkSession, sf: str) -> DataFrame:
    """S11."""
    return table(spark, sf, "supplier").select("s_suppkey", text.clean_channel(F.expr(_CHANNEL)).alias("channel"))


_LINKED = """CASE c_custkey % 8 WHEN 0 THEN 'https://open.spotify.com/track/' || c_custkey || '?si=x' WHEN 1 THEN ' ' || c_custkey WHEN 2 THEN 'https://youtu.be/' || c_custkey || '?t=3' WHEN 3 THEN 'https://www.youtube.com/watch?v=' || c_custkey || '&list=y'
 WHEN 4 THEN 'https://soundcloud.com/a/' || c_custkey || '/?in=z' WHEN 5 THEN '/a/' || c_custkey WHEN 6 THEN 'open.spotify.com/track/' || c_custkey || '/' ELSE 'a/' || c_custkey END"""


@query("SELECT c_custkey, CASE WHEN c_custkey % 8 IN (4, 5, 7) THEN 'a/' ELSE '' END || c_custkey AS id FROM customer")
def loose_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids out of links of any form."""
    k, given = F.col("c_custkey") % 8, F.expr(_LINKED)
    found = F.when(k.isin(2, 3), links.loose_id("youtube", given)).when(k.isin(4, 5, 7), links.loose_id("soundcloud", given)).otherwise(links.loose_id("spotify", given))
    return table(spark, sf, "customer").select("c_custkey", found.alias("id"))


_SEEDED = f"SELECT *, CASE WHEN query_id % 3 = 0 THEN 'Spotify' END AS q_provider, CASE WHEN query_id % 3 = 0 AND native_id LIKE '%1' THEN native_id ELSE 'none' END AS q_id FROM ({P.RANKED}) r0"


@query(f"""SELECT query_id, provider, rank, CASE WHEN query_id % 3 = 0 THEN provider = 'spotify' AND native_id LIKE '%1' WHEN q_isrc IS NOT NULL THEN isrc IS NOT NULL AND lower(isrc) = lower(q_isrc) ELSE true END AS trusted,
  CASE WHEN accepted AND NOT (CASE WHEN query_id % 3 = 0 THEN provider = 'spotify' AND native_id LIKE '%1' WHEN q_isrc IS NOT NULL THEN isrc IS NOT NULL AND lower(isrc) = lower(q_isrc) ELSE true END) THEN 'unverified_candidate' END AS reason FROM ({P.RANKED}) r""")
def trusted_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that may seed the second pass, and why others may not."""
    return selection.trusted(P.view(spark, sf, _SEEDED)).select("query_id", "provider", "rank", "trusted", "reason")


_ASKED = "SELECT CAST(p_partkey AS BIGINT) AS query_id, CASE WHEN p_partkey % 2 = 0 THEN 'Deezer' END AS q_provider, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS q_title, CASE WHEN p_partkey % 5 = 0 THEN 'USABC1000001' END AS q_isrc FROM part"


@query("SELECT p_partkey::BIGINT AS query_id, s AS provider FROM part, (SELECT unnest(['spotify', 'deezer', 'tidal']) AS s) x WHERE s = 'deezer' OR p_partkey % 2 <> 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def first_pass_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Whom a request asks first."""
    return selection.asked_sources(P.view(spark, sf, _ASKED), ["spotify", "deezer", "tidal"])


@query(f"SELECT query_id, provider, provider || ',' || provider || '_url' AS keys FROM {_B} b")
def provider_owned_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A source speaks for its own ids alone."""
    p = F.col("provider")
    ids = F.create_map(p, F.col("native_id"), F.concat(p, F.lit("_url")), F.lit("https://e.org"), F.lit("isrc"), F.lit("x"), F.concat(p, F.lit("_other")), F.lit("y"))
    return _best(spark, sf, "native_id").select("query_id", "provider", F.array_join(F.array_sort(F.map_keys(links.owned_ids(p, ids))), ",").alias("keys"))


@query(f"SELECT query_id, provider, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(provider) ORDER BY score DESC, rank) AS n FROM (SELECT query_id, CASE WHEN rank % 2 = 0 THEN upper(provider) ELSE provider END AS provider, score, rank FROM ({P.RANKED}) r0) r) x WHERE n = 1")
def pre_merge_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """One row of each source, whatever the case of its name."""
    rows = P.view(spark, sf, P.RANKED).withColumn("provider", F.when(F.col("rank") % 2 == 0, F.upper("provider")).otherwise(F.col("provider")))
    return fusion.one_per_source(rows.select("query_id", "provider", "score", "rank"))


#: Artists as sources list them: separately, as one display text in several spellings, or others.
_CREDITED = """SELECT CAST(o_custkey AS BIGINT) AS query_id, CASE o_orderkey % 8 WHEN 0 THEN 'spotify' WHEN 1 THEN 'deezer' WHEN 2 THEN 'tidal' WHEN 3 THEN 'qobuz' WHEN 4 THEN 'melon' WHEN 5 THEN 'bugs' WHEN 6 THEN 'genie' ELSE 'ytmusic' END AS provider,
  CAST(o_orderkey % 90 AS DOUBLE) / 100 AS score, CAST(o_orderkey AS BIGINT) AS rank, 'Ann ' || CAST(o_custkey % 7 AS STRING) AS a, 'Bo' AS b, 'C  D' AS c, CAST(o_orderkey % 8 AS INT) AS kind, o_custkey % 3 = 0 AS three FROM orders"""
_LISTS = {  # kind: (names where two artists are meant, names where three are), as SQL for both engines
    0: (("a", "b"), ("a", "b", "c")), 1: (("upper(b)", "a"), ("c", "a", "b")), 2: (("a || ' & ' || b",), ("a || ', ' || b || ' & c d'",)), 3: (("a || ', ' || b",), ("a || ', ' || b || ' and C D'",)),
    4: (("a || ' and ' || b",), ("a || ' & ' || b || ' & c d'",)), 5: (("a",), ("b",)), 6: (("b || ' & ' || a",), ("'nobody & no one'",)), 7: (("lower(a)",), ("'x'",)),
}


def _lists(make: str) -> str:
    arm = lambda names: f"{make}{', '.join(names)}{']' if make.endswith('[') else ')'}"
    return "CASE kind " + " ".join(f"WHEN {k} THEN CASE WHEN three THEN {arm(three)} ELSE {arm(two)} END" for k, (two, three) in _LISTS.items()) + " END"


_FOLDED = r"list_transform(artists, lambda n: lower(trim(regexp_replace(n, '\s+', ' ', 'g'))))"
#: Two lists: a, b under every spelling. 'b & a' is how the list of source 1 is written.
_VOTED = f"""WITH l AS (SELECT *, {_lists('[')} AS artists FROM ({_CREDITED}) x), n AS (SELECT *, {_FOLDED} AS names FROM l),
k AS (SELECT *, '["' || array_to_string(list_sort(names), '","') || '"]' AS own FROM n),
s AS (SELECT DISTINCT query_id, own, unnest(list_concat([array_to_string(names, ' & '), array_to_string(names, ', '), array_to_string(names, ' and ')],
  CASE WHEN len(names) > 2 THEN [array_to_string(names[:-2], ', ') || ' & ' || names[-1], array_to_string(names[:-2], ', ') || ' and ' || names[-1]] ELSE [] END)) AS display FROM k WHERE len(names) > 1),
one AS (SELECT query_id, display, min(own) AS own FROM s GROUP BY 1, 2 HAVING count(DISTINCT own) = 1),
v AS (SELECT k.*, coalesce(one.own, k.own) AS vote FROM k LEFT JOIN one ON len(names) = 1 AND one.query_id = k.query_id AND one.display = names[1])"""


def _voted(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.view(spark, sf, _CREDITED).withColumn("artists", F.expr(_lists("array(")))
    return fusion.artist_votes(rows.withColumn("artist_ids", F.transform("artists", lambda n: F.when(F.length(n) > 2, F.concat(F.col("provider"), F.lit(":"), F.lower(n))))))


@query(f"{_VOTED} SELECT query_id, provider, rank, vote FROM v")
def artist_vote_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A10: a display text votes for the one list that is written so."""
    return _voted(spark, sf).select("query_id", "provider", "rank", "vote")


_PLACE = "list_position(['spotify', 'applemusic', 'tidal', 'qobuz', 'amazonmusic', 'pandora', 'bugs', 'genie', 'melon', 'musicbrainz', 'deezer', 'soundcloud', 'jiosaavn', 'ytmusic'], provider)"
_LONGEST = f"""{_VOTED}, g AS (SELECT *, count(*) OVER (PARTITION BY query_id, vote) AS n_votes FROM v),
w AS (SELECT query_id, vote, n_votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_votes DESC, {_PLACE}, score DESC) AS i FROM g) x WHERE i = 1),
longest AS (SELECT query_id, vote, artists, provider, n_votes FROM (SELECT g.*, row_number() OVER (PARTITION BY g.query_id ORDER BY len(artists) DESC, {_PLACE}, score DESC, array_to_string(artists, '|')) AS i FROM g JOIN w ON g.query_id = w.query_id AND g.vote = w.vote) x WHERE i = 1)"""


@query(f"{_LONGEST} SELECT query_id, vote, provider, n_votes, array_to_string(artists, '|') AS names FROM longest")
def longest_artist_list(spark: SparkSession, sf: str) -> DataFrame:
    """The artists of the winning vote, from its longest list."""
    return fusion.longest_artists(_voted(spark, sf)).select("query_id", "vote", "provider", "n_votes", F.array_join("artists", "|").alias("names"))


@query(f"""{_LONGEST}, m AS (SELECT query_id, vote, unnest(artists) AS name, unnest(range(len(artists))) AS place FROM longest),
o AS (SELECT query_id, vote, provider, rank, unnest(artists) AS name, unnest(range(len(artists))) AS at FROM v)
SELECT query_id, place::INTEGER AS place, name, provider, id FROM (SELECT m.query_id, m.place, m.name, o.provider, o.provider || ':' || lower(o.name) AS id, row_number() OVER (PARTITION BY m.query_id, m.place, m.name, o.provider ORDER BY o.rank, o.at) AS i
FROM m JOIN o ON m.query_id = o.query_id AND m.vote = o.vote AND lower(trim(m.name)) = lower(trim(o.name)) AND length(o.name) > 2) x WHERE i = 1""")
def artist_id_union(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the selected artists from the sources that voted alike."""
    v = _voted(spark, sf)
    return fusion.artist_ids(fusion.longest_artists(v), v)


@query(f"""SELECT query_id, string_agg(k, '; ' ORDER BY k) AS copyrights FROM (SELECT DISTINCT query_id, 'P' || label AS k FROM {_B} b WHERE label IS NOT NULL UNION SELECT query_id, 'C' || artist FROM {_B} c) x GROUP BY 1""")
def copyrights_union(spark: SparkSession, sf: str) -> DataFrame:
    """A18."""
    b = _best(spark, sf, "label", "artist")
    rows = b.select("query_id", F.explode(F.array(F.struct(F.lit("P").alias("type"), F.col("label").alias("text")), F.struct(F.lit("C").alias("type"), F.col("artist").alias("text")))).alias("c")).select("query_id", "c.*")
    return fusion.copyrights_union(rows).select("query_id", F.array_join(F.transform("copyrights", lambda c: F.concat(c["type"], c["text"])), "; ").alias("copyrights"))


@query(f"""SELECT query_id, max(supp::BIGINT * 100) AS play_count, string_agg(provider, ',' ORDER BY provider) AS sources, max(score) AS match_score, arg_min(provider, (-score, provider)) AS top_source,
string_agg(provider || '=' || native_id, ',' ORDER BY provider) AS ids FROM {_B} b GROUP BY 1""")
def fused_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The largest play count, own ids, sources, the highest score and whose it is."""
    b = _best(spark, sf, "supp", "native_id").select("query_id", "provider", "score", "rank", (F.col("supp").cast("long") * 100).alias("play_count"), F.create_map(F.col("provider"), F.col("native_id"), F.lit("isrc"), F.lit("x")).alias("ids"))
    out = fusion.totals(b)
    return out.select("query_id", "play_count", F.array_join("sources", ",").alias("sources"), "match_score", "top_source", F.array_join(F.transform(F.array_sort(F.map_entries("ids")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("ids"))


@query(f"SELECT query_id, provider, id, confidence FROM (SELECT query_id, provider, native_id AS id, score AS confidence, row_number() OVER (PARTITION BY query_id, provider, native_id ORDER BY rank) AS n FROM ({P.RANKED}) r) x WHERE n = 1")
def identity_match_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The first identity match of each source and id."""
    rows = P.view(spark, sf, P.RANKED).select("query_id", "provider", F.col("native_id").alias("id"), F.col("score").alias("confidence"), F.col("rank").alias("seq"))
    return selection.first_matches(rows).drop("seq")


@query(f"SELECT query_id, url FROM (SELECT query_id, image_url AS url, row_number() OVER (PARTITION BY query_id ORDER BY supp % 6 <> 0, width * height DESC, provider) AS n FROM {_B} b) x WHERE n = 1")
def best_image(spark: SparkSession, sf: str) -> DataFrame:
    """Thumbnails first, then the largest."""
    rows = _best(spark, sf, "image_url", "supp", "width", "height").select("query_id", F.col("image_url").alias("url"), F.when(F.col("supp") % 6 == 0, "thumbnail").otherwise("cover").alias("type"), "width", "height", F.col("provider").alias("seq"))
    return fusion.best_image(rows)


_SONGS = "SELECT CAST(o_custkey AS BIGINT) AS artist_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS STRING) END AS id, 'Song' AS name, CAST(o_orderkey AS BIGINT) AS seq FROM orders"


@query(f"SELECT artist_id, id, seq, place FROM (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY seq) AS place FROM (SELECT artist_id, id, min(seq) AS seq FROM ({_SONGS}) s WHERE id IS NOT NULL GROUP BY 1, 2) y) x WHERE place <= 5")
def artist_list_limit(spark: SparkSession, sf: str) -> DataFrame:
    """An artist's first entries with ids of their own."""
    return artists.listed(P.view(spark, sf, _SONGS), 5).select("artist_id", "id", "seq", "place")


_NAMED = "SELECT 'src' || CAST(s_suppkey % 3 AS STRING) AS provider, CASE WHEN s_suppkey % 10 = 0 THEN ' ' ELSE CAST(s_suppkey % 25 AS STRING) END AS id, CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE s_name END AS name, s_suppkey AS seq FROM supplier"


@query(f"SELECT provider, id, name, seq FROM (SELECT *, row_number() OVER (PARTITION BY provider, id ORDER BY seq) AS n FROM ({_NAMED}) s WHERE trim(id) <> '' AND trim(name) <> '') x WHERE n = 1")
def distinct_references(spark: SparkSession, sf: str) -> DataFrame:
    """Valid references, the first of each source and id."""
    return artists.distinct_references(P.view(spark, sf, _NAMED))


_SECTIONS = "SELECT CAST(o_custkey AS BIGINT) AS artist_id, CAST(o_orderkey AS BIGINT) AS seq, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'Part ' || CAST(o_orderkey AS STRING) END AS text FROM orders"


@query(f"SELECT artist_id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS biography FROM ({_SECTIONS}) s WHERE trim(text) <> '' GROUP BY 1")
def biography(spark: SparkSession, sf: str) -> DataFrame:
    """A30."""
    return artists.biography(P.view(spark, sf, _SECTIONS))


@query("SELECT event_type, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """What a load report shows of each operation."""
    e = table(spark, sf, "events").withColumn("v", F.col("value").cast("double"))
    return e.groupBy("event_type").agg(F.percentile("v", 0.5).alias("median"), F.percentile("v", 0.95).alias("p95"), F.max("value").alias("most"))


_HEALTH = "SELECT s_name AS source, CASE s_suppkey % 4 WHEN 0 THEN 'suspended' WHEN 1 THEN 'disabled' ELSE 'active' END AS state, CASE WHEN s_suppkey % 3 = 0 THEN 'public' END AS mode, CAST(s_suppkey AS DOUBLE) AS retry_at, s_suppkey % 8 = 0 AS probing FROM supplier"


@query("SELECT string_agg(s_name || ':' || CASE s_suppkey % 4 WHEN 0 THEN CASE WHEN s_suppkey > 50 THEN 'suspended' WHEN s_suppkey % 8 = 0 THEN 'probing' ELSE 'retry_ready' END WHEN 1 THEN 'disabled' ELSE 'active' END || ':' || CASE WHEN s_suppkey % 3 = 0 THEN 'public' ELSE '' END, '|' ORDER BY s_name) AS signature FROM supplier")
def health_signature(spark: SparkSession, sf: str) -> DataFrame:
    """The part of cache keys that changes with the sources' states."""
    return state.signature(P.view(spark, sf, _HEALTH), now=50.0)


@query("SELECT CASE s_suppkey % 4 WHEN 0 THEN 'suspended' WHEN 1 THEN 'disabled' ELSE 'active' END AS state, count(*) AS n FROM supplier GROUP BY 1")
def health_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A27."""
    return state.states(P.view(spark, sf, _HEALTH))


_CALLS = "SELECT user_id % 50 AS key, CAST(event_id % 977 AS DOUBLE) / 8 AS moment, event_id AS seq FROM events"


@query(f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY moment, seq) AS n FROM ({_CALLS}) x),
f AS (SELECT key, moment, seq, n, 3.0::DOUBLE AS before FROM c WHERE n = 1
UNION ALL SELECT c.key, c.moment, c.seq, c.n, least(3.0, f.before - CASE WHEN f.before >= 1 THEN 1 ELSE 0 END + (c.moment - f.moment) * 0.5) FROM f JOIN c ON c.key = f.key AND c.n = f.n + 1)
SELECT key, moment, seq, before >= 1 AS allowed FROM f""")
def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """Half a call a second, three at once."""
    return state.admitted(P.view(spark, sf, _CALLS).withColumnRenamed("moment", "at"), 0.5, 3).withColumnRenamed("at", "moment")


@query("""SELECT c_custkey, sha256('deezer,spotify' || chr(10) || '{"artist":"' || c_mktsegment || '","title":"' || c_name || '"}') AS hash FROM customer""")
def query_hash(spark: SparkSession, sf: str) -> DataFrame:
    """sources in any order and case, then the request."""
    asked = F.array(F.lit("Spotify"), F.lit(" deezer"), F.lit("SPOTIFY"))
    return table(spark, sf, "customer").select("c_custkey", identity.query_hash(asked, F.col("c_mktsegment").alias("artist"), F.col("c_name").alias("title")).alias("hash"))


@query("""SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 'recording_of' WHEN 1 THEN 'remix_of' WHEN 2 THEN 'edit_of' WHEN 3 THEN 'remaster_of' WHEN 4 THEN 'samples_material' WHEN 5 THEN 'replaced_by' WHEN 6 THEN 'supports_release' ELSE 'relationship' END AS kind FROM supplier""")
def relationship_names(spark: SparkSession, sf: str) -> DataFrame:
    """F20."""
    said = F.expr("CASE s_suppkey % 9 WHEN 0 THEN 'Performance' WHEN 1 THEN ' remix' WHEN 2 THEN 'EDIT' WHEN 3 THEN 'remaster' WHEN 4 THEN 'samples material' WHEN 5 THEN 'replaced by' WHEN 6 THEN 'Supporting Release' WHEN 7 THEN 'tribute' END")
    return table(spark, sf, "supplier").select("s_suppkey", text.relationship(said).alias("kind"))


_MARKED = r"""CASE p_partkey % 7 WHEN 0 THEN p_name || '+' || p_brand WHEN 1 THEN '"' || p_name || '" (live) [x]' WHEN 2 THEN 'AC/DC: ' || p_name || '?' WHEN 3 THEN 'a\b ' || p_name WHEN 4 THEN '{' || p_name || '}^2~*' WHEN 5 THEN '$' || p_name || '!' ELSE 'x && y || ' || p_name || '-z' END"""


@query(rf"""SELECT p_partkey, array_to_string(list_transform(string_split({_MARKED.replace(chr(92), "' || chr(92) || '")}, ''), lambda c: CASE WHEN position(c IN '+-!(){{}}[]^"~*?:/$&|' || chr(92)) > 0 THEN chr(92) || c ELSE c END), '') AS escaped FROM part""")
def lucene_escape(spark: SparkSession, sf: str) -> DataFrame:
    """each of twenty characters behind a backslash."""
    return table(spark, sf, "part").select("p_partkey", text.escape_lucene(F.expr(_MARKED.replace("\\", "\\\\"))).alias("escaped"))


@query("SELECT p_partkey, 'https://c.example.org/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '-500x500.jpg' WHEN 1 THEN '-500x500.png' WHEN 2 THEN '-x50.jpg' ELSE '.jpg' END AS image FROM part")
def image_resize(spark: SparkSession, sf: str) -> DataFrame:
    """F26."""
    given = F.expr("'https://c.example.org/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '-50x50.jpg' WHEN 1 THEN '-150x150.png' WHEN 2 THEN '-x50.jpg' ELSE '.jpg' END")
    return table(spark, sf, "part").select("p_partkey", text.large_image(given).alias("image"))


_WANTED = "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name || ' ' || p_brand END AS wanted, p_name AS one, p_brand || ' - Topic' AS two, p_partkey % 7 = 0 AS none FROM part"


@query(f"SELECT id, CASE WHEN none THEN NULL WHEN wanted IS NULL THEN 0.8 ELSE greatest({_ratio_sql(_clean_artist_sql('wanted'), _clean_artist_sql('one'))}, {_ratio_sql(_clean_artist_sql('wanted'), _clean_artist_sql('two'))}, {_ratio_sql(_clean_artist_sql('wanted'), _clean_artist_sql('(one || chr(32) || two)'))}) END AS score FROM ({_WANTED}) w")
def artist_list_score(spark: SparkSession, sf: str) -> DataFrame:
    """the best of single names and the joined list, by tokens."""
    names = F.when(F.col("none"), F.array().cast("array<string>")).otherwise(F.array("one", "two"))
    return P.view(spark, sf, _WANTED).select("id", similarity.artist_score(names, F.col("wanted"), "tokens").cast("double").alias("score"))
