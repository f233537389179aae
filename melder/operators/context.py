"""Context of fused records from further sources, each with a status of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melder.operators.identity import completeness
from melder.sources.wire import bodies

ENTITY = "entities map<string, struct<sitelinks: map<string, struct<title: string>>>>"
SUMMARY = "type string, wikibase_item string, revision string, title string, description string, extract string"
IMAGES = "array<struct<url: string, width: int, height: int>>"


def articles(works: DataFrame, entities: DataFrame, summaries: DataFrame) -> DataFrame:
    """query_id, status, title, summary, wikidata_id of works(query_id, link): the English article that a work's
    link leads to, over landed entities(entity_id, body) and summaries(page, body), page a title with `_`.

    A link to an entity takes a second hop over the entity's own sitelink, and the article must name that
    entity or none; a link to an article is one hop. Other links, missing or broken bodies, and pages that
    aren't standard articles with a summary are unavailable; works without a link have no_data. No
    text is searched for.
    """
    w = works.select("query_id", F.col("link"), F.regexp_extract("link", r"^https://www\.wikidata\.org/wiki/(Q[1-9][0-9]*)$", 1).alias("entity_id"), F.regexp_extract("link", r"^https://en\.wikipedia\.org/wiki/([^/?#]+)(?:[?#].*)?$", 1).alias("own"))
    e = bodies(entities, ENTITY).select("entity_id", F.try_element_at(F.try_element_at("b.entities", F.col("entity_id")).getField("sitelinks"), F.lit("enwiki")).getField("title").alias("sitelink"))
    w = w.join(e.groupBy("entity_id").agg(F.min("sitelink").alias("sitelink")), "entity_id", "left")
    page = F.when(F.col("entity_id") != "", F.replace("sitelink", F.lit(" "), F.lit("_"))).when(F.col("own") != "", F.try_url_decode(F.replace("own", F.lit("+"), F.lit("%2B"))))
    s = bodies(summaries, SUMMARY).where("b.type = 'standard' and coalesce(b.title, '') <> '' and trim(coalesce(b.extract, '')) <> ''")
    s = s.groupBy("page").agg(F.min(F.struct("b.title", "b.extract", "b.wikibase_item")).alias("s"))
    out = w.withColumn("page", page).join(s, "page", "left")
    named = F.coalesce(F.nullif("s.wikibase_item", F.lit("")), F.nullif("entity_id", F.lit("")))
    fits = F.col("s").isNotNull() & ((F.col("entity_id") == "") | (named == F.col("entity_id")))
    status = F.when(F.coalesce(F.trim("link"), F.lit("")) == "", "no_data").when(F.coalesce(fits, F.lit(False)), "ok").otherwise("unavailable")
    out = out.withColumn("status", status)
    kept = lambda c, name: F.when(F.col("status") == "ok", c).alias(name)
    return out.select("query_id", "status", kept(F.col("s.title"), "title"), kept(F.col("s.extract"), "summary"), kept(named, "wikidata_id"))


def enriched(tracks: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """tracks(query_id, ..., images) with statuses and data, maps by source, more images and completeness anew.

    results[name] has query_id, ok, data (JSON) and images, one row a query at most: a missing row is
    no_data, one that isn't ok unavailable, and neither takes anything from a track. Images stand once for
    each URL, smallest area first. Sources are united before they meet the tracks, so that their number
    costs no joins.
    """
    names = list(results)
    every = None
    for name, df in results.items():
        one = df.select("query_id", F.lit(name).alias("name"), F.coalesce("ok", F.lit(False)).alias("ok"), "data", F.col("images").cast(IMAGES).alias("images"))
        every = one if every is None else every.unionAll(one)
    good = F.col("ok")
    got = every.groupBy("query_id").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", F.when(good, "ok").otherwise("unavailable").alias("s"))))).alias("_s"),
        F.map_from_entries(F.array_sort(F.collect_set(F.when(good & F.col("data").isNotNull(), F.struct("name", "data"))))).alias("data"),
        F.flatten(F.array_sort(F.collect_list(F.when(good, F.struct("name", F.coalesce("images", F.array().cast(IMAGES)).alias("i"))))).getField("i")).alias("_i"),
    )
    out = tracks.withColumn("images", F.coalesce(F.col("images").cast(IMAGES), F.array().cast(IMAGES))).join(got, "query_id", "left")
    statuses = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.coalesce(F.try_element_at("_s", F.lit(n)), F.lit("no_data")) for n in names]))
    both = F.expr(f"aggregate(concat(images, coalesce(_i, cast(array() as {IMAGES}))), cast(array() as {IMAGES}), (a, x) -> if(exists(a, y -> y.url = x.url), a, array_append(a, x)))")
    by_area = F.expr("array_sort(images, (x, y) -> case when x.width * x.height < y.width * y.height then -1 when x.width * x.height > y.width * y.height then 1 when x.url < y.url then -1 when x.url > y.url then 1 else 0 end)")
    out = out.withColumns({"statuses": statuses, "images": both, "data": F.coalesce("data", F.create_map().cast("map<string, string>"))}).withColumn("images", by_area).drop("_s", "_i")
    return out.withColumn("completeness", completeness(out))


def native_artists(songs: DataFrame, site: str) -> DataFrame:
    """songs(..., credits, artists) whose credits (name, role, action) get the id of the artist row (id, name,
    perma_url) with the same name and address; a song with one name and address under two ids is left
    out, as nobody can tell whom it credits. Credits without such a row keep their name alone."""
    own = F.expr(f"transform(credits, c -> struct(c.name as name, c.role as role, array_distinct(transform(filter(artists, a -> coalesce(c.action, '') <> '' and a.name = c.name and a.perma_url = concat('{site}', c.action) and coalesce(a.id, '') <> ''), a -> a.id)) as ids))")
    out = songs.withColumn("credits", own).where("not exists(credits, c -> size(c.ids) > 1)")
    return out.withColumn("credits", F.transform("credits", lambda c: F.struct(c["name"].alias("name"), c["role"].alias("role"), F.get(c["ids"], F.lit(0)).alias("id"))))
