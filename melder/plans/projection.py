"""Roles for the driver's tables: which table plays queries, candidates, albums, events.

The projections are plain SQL that Spark and DuckDB read alike, so that a query and its oracle
start from the same rows. They define inputs only; operators are written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melder.operators.links import PLATFORMS
from melder.session import spread, table

_PROVIDER = "CASE l_suppkey % 14 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PLATFORMS)) + " END"

CANDIDATES = f"""
SELECT *, CAST(row_number() OVER (PARTITION BY query_id, provider ORDER BY native_id, line, supp, quantity, price, discount, tax, flag, shipped) AS BIGINT) AS rank
FROM (
  SELECT l_partkey AS query_id, {_PROVIDER} AS provider, CAST(l_orderkey AS STRING) AS native_id,
    p_name || CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN ' (Official Video)' WHEN 3 THEN ' [Remastered]' WHEN 4 THEN ' (Live)' WHEN 5 THEN ' - Remix' WHEN 6 THEN ' (feat. Guest)' ELSE ' (2011 Remaster)' END AS title,
    CASE WHEN l_suppkey % 5 = 0 THEN 'Other Name' WHEN l_suppkey % 7 = 0 THEN p_brand || ' - Topic' ELSE p_brand END AS artist,
    CASE WHEN l_linenumber % 4 = 3 THEN NULL WHEN l_suppkey % 13 = 0 THEN 'GREATEST HITS' ELSE p_type END AS album,
    CAST(180000 + CAST(l_quantity AS BIGINT) * 200 + CASE WHEN l_linenumber = 7 THEN 60000 ELSE 0 END AS BIGINT) AS duration_ms,
    CASE WHEN l_suppkey % 3 = 0 THEN 'USABC' || CAST(1000000 + l_partkey AS STRING) WHEN l_suppkey % 11 = 0 THEN 'GBXYZ' || CAST(1000000 + l_partkey AS STRING) END AS isrc,
    substr(CAST(l_shipdate AS STRING), 1, 10) AS release_date,
    CASE WHEN l_suppkey % 4 = 1 THEN NULL ELSE 'Label ' || CAST(l_suppkey % 4 AS STRING) END AS label,
    'genre ' || CAST(l_orderkey % 6 AS STRING) AS genre,
    CASE l_linenumber % 3 WHEN 0 THEN 'Composer' WHEN 1 THEN 'composer' ELSE 'Lyricist' END AS role,
    'writer ' || CAST(l_orderkey % 3 AS STRING) AS credit_name,
    'https://img.example.org/' || CAST(l_orderkey % 9 AS STRING) || '.jpg' AS image_url, CAST(100 * l_linenumber AS INT) AS width, CAST(50 * (1 + l_suppkey % 4) AS INT) AS height,
    l_linenumber AS line, l_suppkey AS supp, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS flag, l_shipdate AS shipped,
    p_name AS q_title, p_brand AS q_artist, p_type AS q_album,
    CASE WHEN l_partkey % 4 = 0 THEN 'usabc' || CAST(1000000 + l_partkey AS STRING) END AS q_isrc,
    l_partkey % 10 = 1 AS q_direct, l_partkey % 10 = 1 AND l_suppkey % 14 = 11 AND l_linenumber <= 2 AS direct
  FROM lineitem JOIN part ON l_partkey = p_partkey) x
"""

#: Scores between 0 and 1 without text comparison, for operators that only order by a score.
RANKED = f"SELECT *, CAST((supp * 37 + line * 11) % 101 AS DOUBLE) / 100 AS score, (supp * 37 + line * 11) % 101 >= 40 AS accepted, supp % 5 <> 0 AS artist_ok, line <> 5 AS identity_ok FROM ({CANDIDATES}) c"

#: Records of sources, none of them paired with a request; one in five search rows has no duration.
CATALOGUE = f"""
SELECT provider, native_id, title, artist, guest, album, album_id, position, CAST(CASE WHEN supp % 5 = 2 THEN 0 ELSE real_ms END AS BIGINT) AS duration_ms, real_ms, isrc, release_date, label, line, supp
FROM (
  SELECT {_PROVIDER} AS provider, CAST(l_orderkey * 10 + l_linenumber AS STRING) AS native_id,
    p_name || CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN ' (Official Video)' WHEN 3 THEN ' [Remastered]' WHEN 4 THEN ' (Live)' WHEN 5 THEN ' - Remix' ELSE ' (2011 Remaster)' END AS title,
    CASE WHEN l_suppkey % 5 = 0 THEN 'Other Name' WHEN l_suppkey % 7 = 0 THEN p_brand || ' - Topic' ELSE p_brand END AS artist,
    CASE WHEN l_suppkey % 4 = 2 THEN 'Guest ' || CAST(l_partkey % 3 AS STRING) END AS guest,
    CASE WHEN l_linenumber % 4 = 3 THEN NULL WHEN l_suppkey % 13 = 0 THEN 'GREATEST HITS' ELSE p_type END AS album, 'al' || CAST(l_partkey % 50 AS STRING) AS album_id, CAST(l_linenumber AS INT) AS position,
    CAST(180000 + CAST(l_quantity AS BIGINT) * 200 + CASE WHEN l_linenumber = 7 THEN 60000 ELSE 0 END AS BIGINT) AS real_ms,
    CASE WHEN l_suppkey % 3 = 0 THEN 'USABC' || CAST(1000000 + l_partkey AS STRING) WHEN l_suppkey % 11 = 0 THEN 'GBXYZ' || CAST(1000000 + l_partkey AS STRING) END AS isrc,
    substr(CAST(l_shipdate AS STRING), 1, 10) AS release_date, CASE WHEN l_suppkey % 4 = 1 THEN NULL ELSE 'Label ' || CAST(l_suppkey % 4 AS STRING) END AS label, l_linenumber AS line, l_suppkey AS supp,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey) x
WHERE k = 1
"""

#: What a source's own page of a record says; some pages are another record's.
DETAILS = f"""
SELECT provider, native_id, CASE WHEN supp % 17 = 4 THEN title || ' II' ELSE upper(title) END AS title, artist, isrc, CASE WHEN supp % 19 = 5 THEN 'other' ELSE album_id END AS album_id,
  CAST(real_ms + (supp % 3) * 1500 AS BIGINT) AS duration_ms, CASE WHEN supp % 2 = 0 THEN 'Detail ' || CAST(supp % 4 AS STRING) END AS label, CAST(NULL AS STRING) AS release_date
FROM ({CATALOGUE}) d0 WHERE line <> 6
"""

#: Requests by ISRC alone, by id alone, and by artist and title.
REQUESTS = f"""
SELECT p_partkey AS query_id, CASE WHEN p_partkey % 4 >= 2 THEN p_name END AS q_title, CASE WHEN p_partkey % 4 >= 2 THEN p_brand END AS q_artist, CASE WHEN p_partkey % 4 = 3 THEN p_type END AS q_album,
  CASE WHEN p_partkey % 4 = 0 THEN 'usabc' || CAST(1000000 + p_partkey AS STRING) END AS q_isrc,
  CASE WHEN p_partkey % 4 = 1 THEN CASE v % 14 {" ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PLATFORMS))} END END AS q_provider,
  CASE WHEN p_partkey % 4 = 1 THEN CAST(CAST((v - v % 14) / 14 AS BIGINT) AS STRING) END AS q_id
FROM part JOIN (SELECT l_partkey AS k, min((l_orderkey * 10 + l_linenumber) * 14 + l_suppkey % 14) AS v FROM lineitem GROUP BY l_partkey) y ON p_partkey = k
"""

TRACKS = "SELECT CAST(l_orderkey AS BIGINT) AS album_id, CAST(1 + l_suppkey % 2 AS INT) AS disc, CAST(l_linenumber AS INT) AS position, CAST(l_partkey AS BIGINT) * 1000 + CAST(l_suppkey AS BIGINT) AS track_id FROM lineitem"
DECLARED = "SELECT CAST(o_orderkey AS BIGINT) AS album_id, d AS disc, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(1 + (o_custkey + d) % 4 AS BIGINT) END AS declared FROM orders CROSS JOIN (SELECT 1 AS d UNION ALL SELECT 2 AS d) dd"
HEALTH_EVENTS = "SELECT user_id % 14 AS source, ts, event_id AS seq, event_type = 'error' AS failed FROM events"
REFERENCES = "SELECT 'src' || CAST(s_suppkey % 3 AS STRING) AS provider, CAST(s_suppkey AS STRING) AS id, 'Artist ' || CAST(s_suppkey % 40 AS STRING) || CASE WHEN s_suppkey % 4 = 0 THEN 'VEVO' ELSE '' END AS name, s_suppkey AS seq FROM supplier"
ASKED = "SELECT DISTINCT 'artist ' || CAST(c_custkey % 60 AS STRING) AS name FROM customer"


def view(spark: SparkSession, sf_dir: str, sql: str, costly: bool = False) -> DataFrame:
    """A projection over the tables that it names, each read once; `costly` is for queries that do much
    work on a row before their first shuffle (see session.spread).

    part, which every projection joins, meets lineitem in a shuffle by its key: a broadcast would grow with
    it, and the rows of a key stay together for what is grouped by query_id, so that only the narrow
    columns of lineitem move and the texts are made behind the shuffle.
    """
    used = {t: spread(table(spark, sf_dir, t)) if costly else table(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "events", "supplier", "customer", "pages") if f" {t}" in sql}
    if "part" in used:
        used["part"] = used["part"].hint("shuffle_hash")
    for name in used:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(sql, **used)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CATALOGUE, whose lines are made one of each place in an order before their texts are: the shuffle
    by place carries a line and its part's three texts, not the nine that are made of them."""
    key = ["l_orderkey", "l_linenumber"]
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]
    lines = view(spark, sf_dir, f"SELECT {', '.join(key + order)}, p_name, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey")
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    one = lines.withColumn("_n", n).where("_n = 1").drop("_n")
    return spark.sql(CATALOGUE.replace("FROM lineitem JOIN part ON l_partkey = p_partkey", "FROM {one}"), one=one)


def pages(catalogue: DataFrame) -> DataFrame:
    """DETAILS of a CATALOGUE that is at hand and so isn't made from the driver's tables again."""
    return catalogue.sparkSession.sql(DETAILS.replace(f"({CATALOGUE})", "{catalogue}"), catalogue=catalogue)
