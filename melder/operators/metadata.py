"""Catalogue records of unknown shape on VARIANT columns: the entity, its public facts, what is shown.

A record's JSON is parsed once; objects and lists are walked level by level with variant_explode, so
every level is a DataFrame over all records at once and no Python worker sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.operators.links import owned_ids
from melder.session import staged

MAX_BODY = 8 << 20
ENTITY_DEPTH, DEPTH = 16, 24
# What holds entities, in this order; what names one.
CONTAINERS = ["videoDetails", "recordings", "results", "data", "tracks", "items"]
NAMES = ["id", "trackId", "videoId"]
# Keys, without - and _ and in lower case, that are never passed on: parts of them, and whole ones.
PRIVATE = ["token", "cookie", "authorization", "password", "secret", "signature", "encryptedmediaurl", "streamingdata", "playback", "tracking", "responsecontext", "logging", "html", "cipher", "streamurl", "streamingurl", "downloadurl"]
PRIVATE_KEYS = ["apikey", "clientkey", "request", "headers"]
# Facts of a fused track that a source's record doesn't carry.
DERIVED = ["canonical_id", "identity_status", "identity_reasons", "identity_matches", "sources", "field_sources", "match_score", "match_breakdown", "confidence", "completeness", "relations", "extensions"]
# What a result shows, and a link, and a search row; diagnostics aren't among them.
PUBLIC_TRACK = [
    "video_annotations", "album_placements", "credit_details", "canonical_id", "identity_status", "title", "artists", "album", "duration_ms", "release_date", "music_graph", "provider_data", "explicit_status", "explicit", "isrc", "iswc",
    "genres", "language", "credits", "images", "preview_url", "track_number", "disc_number", "label", "barcode", "copyrights", "play_count", "ids", "extensions",
]
PUBLIC_LINK = ["id", "id_type", "lookup_id", "url"]
PUBLIC_SEARCH = ["canonical_id", "title", "artists", "album", "images", "available_on"]


def public(rows: DataFrame, shown: list[str], keys: list[str] | None = None) -> DataFrame:
    """The columns that may be shown, of those that rows has, behind the keys; anything else stays inside."""
    return rows.select(*[c for c in [*(keys or []), *shown] if c in rows.columns])


def private(key: Column) -> Column:
    bare = F.lower(F.regexp_replace(key, "[_-]", ""))
    return bare.rlike("|".join(PRIVATE)) | bare.isin(*PRIVATE_KEYS)


def _children(rows: DataFrame, keep: str) -> DataFrame:
    """keep, pos, key and child of the entries of each row's variant v; key is null in lists."""
    return rows.sparkSession.sql(f"SELECT {keep}, e.pos, e.key, e.value AS child FROM {{rows}}, LATERAL variant_explode(v) AS e", rows=rows)


def _text(v: str, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _named(ids: Column) -> Column:
    """Whether v is an object with one of the ids, or with a share link whose token is one."""
    share = F.regexp_extract(_text("v", "perma_url"), r"^https://(?:www\.)?jiosaavn\.com/+song/[^/?#]+/([^/?#]+)/*(?:[?#].*)?$", 1)
    hit = F.array_contains(ids, F.nullif(share, F.lit("")))
    for name in NAMES:
        hit = F.coalesce(hit, F.lit(False)) | F.coalesce(F.array_contains(ids, _text("v", name)), F.lit(False))
    return hit


def entities(records: DataFrame) -> DataFrame:
    """query_id, provider, v of records(query_id, provider, ids, body): the first object that has one of the
    ids, an object before what it holds, containers in their order, lists in theirs, ENTITY_DEPTH levels
    deep. Subobjects that aren't containers (an artist, an album) are never looked into. Bodies that aren't
    JSON or are over MAX_BODY, and those without such an object, give no row; a source has one record a query."""
    keep = ["query_id", "provider", "ids", "path"]
    level = records.where(F.octet_length("body") <= MAX_BODY).select("query_id", "provider", F.filter("ids", lambda x: F.coalesce(x, F.lit("")) != "").alias("ids"), F.array().cast("array<int>").alias("path"), F.try_parse_json("body").alias("v")).where("v is not null")
    found = None
    place = F.when(F.col("key").isNull(), F.col("pos"))
    for i, c in enumerate(CONTAINERS):
        place = place.when(F.col("key") == c, F.lit(i))
    for depth in range(ENTITY_DEPTH + 1):
        level = staged(level.withColumn("hit", _named(F.col("ids"))), "level")
        hits = level.where("hit").select("query_id", "provider", "path", "v")
        found = hits if found is None else found.unionAll(hits)
        rest = level.where("not hit")
        if depth == ENTITY_DEPTH or rest.isEmpty():
            break
        below = _children(rest, ", ".join(keep)).withColumn("place", place).where("place is not null")
        level = below.select("query_id", "provider", "ids", F.concat("path", F.array("place")).alias("path"), F.col("child").alias("v"))
    first = found.groupBy("query_id", "provider").agg(F.min("path").alias("path"))
    return found.join(first, ["query_id", "provider", "path"]).select("query_id", "provider", "v")


def leaves(rows: DataFrame) -> DataFrame:
    """query_id, provider, path, value of rows(query_id, provider, v): every scalar, empty list and empty object
    as JSON under its path, without private keys and without what lies deeper than DEPTH."""
    out = None
    level = rows.select("query_id", "provider", F.lit("").alias("path"), "v")
    for _ in range(DEPTH + 1):
        nested = F.schema_of_variant("v").rlike(r"^(OBJECT|ARRAY)<")
        empty = F.to_json("v").isin("{}", "[]")
        level = staged(level.withColumn("deeper", nested & ~empty), "level")
        done = level.where("not deeper").select("query_id", "provider", "path", F.to_json("v").alias("value"))
        out = done if out is None else out.unionAll(done)
        rest = level.where("deeper")
        if rest.isEmpty():
            break
        below = _children(rest, "query_id, provider, path").where(F.col("key").isNull() | ~private(F.col("key")))
        step = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        level = below.select("query_id", "provider", step.alias("path"), F.col("child").alias("v"))
    return out


def _boolean(v: Column, path: str) -> Column:
    """A value that is true or false itself, not a text that says so."""
    one = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(one) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def explicit(rows: DataFrame) -> DataFrame:
    """query_id, provider, explicit of entities(): true, false, or null where the record doesn't say. Attributes
    stand for the record where it has them; the first statement counts, a parental one before plain flags
    before words."""
    inner = F.try_variant_get("v", "$.attributes", "variant")
    v = F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner).otherwise(F.col("v"))
    out = rows.select("query_id", "provider", v.alias("v"))
    c = F.col("v")
    word = lambda key: F.lower(F.when(F.schema_of_variant(F.try_variant_get(c, f"$.{key}", "variant")) == "STRING", F.try_variant_get(c, f"$.{key}", "string")))
    said = lambda w: F.when(w == "explicit", True).when(w.isin("cleaned", "notexplicit", "clean"), False)
    order = [_boolean(c, "$.parentalSettings.hasExplicitLanguage"), _boolean(c, "$.explicit"), _boolean(c, "$.explicit_lyrics"), said(word("trackExplicitness")), said(word("contentRating"))]
    return out.select("query_id", "provider", F.coalesce(*order).alias("explicit"))


def facts(candidates: DataFrame) -> DataFrame:
    """query_id, provider, path, value of candidates(query_id, provider, ids map, ...): a row for each filled column
    but what is derived of several sources, as JSON under `metadata.`; ids are the source's own."""
    rows = candidates.withColumn("ids", owned_ids(F.col("provider"), F.col("ids")))
    names = [c for c in rows.columns if c not in ("query_id", "provider", "body", *DERIVED)]
    json = lambda n: F.regexp_replace(F.to_json(F.struct(F.col(n).alias("x"))), r'^\{"x":(.*)\}$', "$1")
    entry = lambda n: F.when(F.col(n).isNotNull(), F.struct(F.lit(f"metadata.{n}").alias("path"), json(n).alias("value")))
    return rows.select("query_id", "provider", F.explode(F.filter(F.array(*[entry(n) for n in names]), lambda x: x.isNotNull())).alias("e")).select("query_id", "provider", "e.*")


def placements(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """query_id, album_placements of candidates(query_id, provider, album_id, native_id, disc_number, track_number):
    each source's own album and track, by name, selected if it is the album_from of chosen(query_id, album_from)."""
    there = candidates.where("coalesce(album_id, '') <> '' and coalesce(native_id, '') <> ''").join(chosen.select("query_id", "album_from"), "query_id", "left")
    entry = F.struct("provider", "album_id", F.col("native_id").alias("track_id"), "disc_number", "track_number", F.coalesce(F.col("provider") == F.col("album_from"), F.lit(False)).alias("selected"))
    return there.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("album_placements"))


def attach(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """results(query_id, ...) with provider_data, a map of sources to maps of path to JSON value, and
    explicit_status: explicit if one accepted record says so, clean if one says the opposite, else unknown.

    candidates are the accepted rows of each query: query_id, provider, native_id, ids (a map), body and facts.
    """
    records = candidates.select("query_id", "provider", F.filter(F.map_values(F.map_filter("ids", lambda k, v: ~k.endswith("_url"))), lambda x: x != "").alias("ids"), "body")
    found = staged(entities(records), "entities")
    rows = leaves(found).select("query_id", "provider", F.concat(F.lit("catalog."), "path").alias("path"), "value").unionAll(facts(candidates))
    maps = rows.groupBy("query_id", "provider").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("path", "value")))).alias("m"))
    data = maps.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", F.to_json("m").alias("m"))))).alias("provider_data"))
    known = explicit(found).groupBy("query_id").agg(F.bool_or("explicit").alias("e"))
    status = F.when(F.col("e"), "explicit").when(~F.col("e"), "clean").otherwise("unknown")
    return results.join(data, "query_id", "left").join(known, "query_id", "left").withColumn("explicit_status", status).drop("e")
