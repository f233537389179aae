"""Field-wise fusion of accepted records under a priority or consensus policy."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.session import joined

# The sources in order of priority, and where a field's order differs.
TITLE = ["spotify", "applemusic", "tidal", "qobuz", "amazonmusic", "pandora", "bugs", "genie", "melon", "musicbrainz", "deezer", "soundcloud", "jiosaavn", "ytmusic"]
CREDITS = ["musicbrainz", "applemusic", "spotify", "tidal", "qobuz", "amazonmusic", "pandora", "bugs", "genie", "melon", "deezer", "soundcloud", "jiosaavn", "ytmusic"]
ISRC = ["spotify", "musicbrainz", "applemusic", "tidal", "qobuz", "amazonmusic", "pandora", "bugs", "genie", "melon", "deezer", "soundcloud", "jiosaavn", "ytmusic"]
LABEL = ["spotify", "applemusic", "tidal", "qobuz", "amazonmusic", "pandora", "bugs", "genie", "melon", "deezer", "musicbrainz", "jiosaavn"]
PREVIEW = ["spotify", "applemusic", "tidal", "qobuz", "amazonmusic", "deezer"]
FIELDS = ["title", "artists", "album", "duration_ms", "release_date", "isrc", "iswc", "language", "label", "barcode", "preview_url", "explicit"]
OWN_ORDER = {"isrc": ISRC, "label": LABEL, "preview_url": PREVIEW}


class Policy:
    """mode (consensus or priority) and, for single fields, an order of sources that overrides it."""

    def __init__(self, mode: str = "consensus", priorities: dict[str, list[str]] | None = None):
        if mode not in ("consensus", "priority"):
            raise ValueError(f"unknown mode {mode}")
        self.mode, self.priorities = mode, priorities or {}
        for field, names in self.priorities.items():
            if field not in FIELDS:
                raise ValueError(f"no priorities can be given for {field}")
            if len({n.lower() for n in names}) != len(names):
                raise ValueError(f"a source occurs twice for {field}")

    @classmethod
    def parse(cls, text: str) -> Policy:
        """From a JSON object of `mode` and `priorities` and nothing else."""

        def once(pairs: list[tuple]) -> dict:
            if len({k for k, _ in pairs}) != len(pairs):
                raise ValueError("a key occurs twice")
            return dict(pairs)

        raw = json.loads(text, object_pairs_hook=once)
        if not isinstance(raw, dict) or set(raw) - {"mode", "priorities"}:
            raise ValueError("a policy has mode and priorities")
        return cls(raw.get("mode", "consensus"), raw.get("priorities"))

    def order(self, field: str) -> list[str]:
        return self.priorities.get(field, OWN_ORDER.get(field, TITLE))

    def by_votes(self, field: str) -> bool:
        return self.mode == "consensus" and field not in self.priorities


def priority(provider: Column, order: list[str]) -> Column:
    """Place in the order; sources it doesn't name come last, all alike."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.lower(provider))
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")


def filled(c: Column, field: str) -> Column:
    """Whether a row's value of a field is there."""
    text = c.cast("string")
    return text.isNotNull() & (F.trim(text) != "") & (text != "0" if field == "duration_ms" else F.lit(True))


def long_form(rows: DataFrame, fields: list[str], carried: list[str] | None = None) -> DataFrame:
    """query_id, provider, score, field, value, vote: one row for each value that is there.
    `carried` are further columns, alike in all rows of a query."""
    own = ["query_id", *(carried or []), "provider", "score"]
    entries = []
    for f in fields:
        text = F.col(f).cast("string")
        entries.append(F.when(filled(F.col(f), f), F.struct(F.lit(f).alias("field"), text.alias("value"), F.lower(F.trim(text)).alias("vote"))))
    return rows.select(*own, F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("e")).select(*own, "e.*")


def choose(values: DataFrame, policy: Policy, fields: list[str], carried: list[str] | None = None) -> DataFrame:
    """query_id, field, value, provider, n_votes, sources (sorted voters) from long_form().

    Order: votes (unless the field's order overrides them), the source's place in the order, the
    score downwards, the name. Two aggregates on nested keys share one partitioning.
    """
    rank = F.lit(0)
    weigh = F.lit(False)
    for f in fields:
        rank = F.when(F.col("field") == f, priority(F.col("provider"), policy.order(f))).otherwise(rank)
        weigh = F.when(F.col("field") == f, F.lit(policy.by_votes(f))).otherwise(weigh)
    first = F.struct(rank.alias("rank"), (-F.col("score")).alias("score"), "provider", "value")
    key = ["query_id", *(carried or [])]
    groups = values.groupBy(*key, "field", "vote").agg(F.count("*").alias("n_votes"), F.min(first).alias("best"), F.array_sort(F.collect_set("provider")).alias("sources"))
    order = F.struct(F.when(weigh, -F.col("n_votes")).otherwise(F.lit(0)).alias("n"), "best")
    won = groups.withColumn("provider", F.col("best.provider")).groupBy(*key, "field").agg(F.min(F.struct(order.alias("o"), "n_votes", "sources")).alias("w"))
    return won.select(*key, "field", F.col("w.o.best.value").alias("value"), F.col("w.o.best.provider").alias("provider"), F.col("w.n_votes").alias("n_votes"), F.col("w.sources").alias("sources"))


def chosen(per: DataFrame, column: str, policy: Policy, fields: dict[str, str]) -> DataFrame:
    """per with, for each of `fields`, a column of value, provider and n_votes: what choose() takes of the
    entries of the array `column` (one of each source), null where none has a value.

    fields tells what a field is called in the entries. All is decided within the row, so no value is
    shuffled; an entry is compared with the others, of which there are as many as sources.
    """
    voters = {f"_{f}": _voters(column, f, name, policy) for f, name in fields.items()}
    won = {f: _winner(f"_{f}", policy.by_votes(f)) for f in fields}
    return per.withColumns(voters).withColumns(won).drop(*voters)


def _voters(column: str, field: str, name: str, policy: Policy) -> Column:
    """The entries that have a value of the field, as they are compared."""

    def entry(x: Column) -> Column:
        text = x[name].cast("string")
        rank = priority(x["provider"], policy.order(field))
        return F.when(filled(x[name], field), F.struct(rank.alias("rank"), (-x["score"]).alias("score"), x["provider"].alias("provider"), text.alias("value"), F.lower(F.trim(text)).alias("vote")))

    return F.filter(F.transform(column, entry), lambda v: v.isNotNull())


def _winner(voters: str, by_votes: bool) -> Column:
    def alike(v: Column) -> Column:
        return F.size(F.filter(voters, lambda y: y["vote"] == v["vote"])).cast("long")

    # by votes they are counted for each entry, else for the first one alone
    first = F.array_min(F.transform(voters, lambda v: F.struct((-alike(v) if by_votes else F.lit(0)).alias("n"), v.alias("e"))))
    return F.transform(F.array(first), lambda w: F.when(w.isNotNull(), F.struct(w["e"]["value"].alias("value"), w["e"]["provider"].alias("provider"), (-w["n"] if by_votes else alike(w["e"])).alias("n_votes"))))[0]


def fuse(rows: DataFrame, policy: Policy | None = None, fields: list[str] | None = None) -> DataFrame:
    """One row for each query: a column for each field, and field_sources."""
    policy, fields = policy or Policy(), fields or [f for f in FIELDS if f in rows.columns]
    won = choose(long_form(rows, fields), policy, fields)
    pick = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return won.groupBy("query_id").agg(*pick, F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "sources")))).alias("field_sources"))


def priority_pick(rows: DataFrame, field: str, order: list[str] | None = None) -> DataFrame:
    """query_id, provider, value: the first source in the order that has a value."""
    there = rows.where(F.col(field).isNotNull() & (F.trim(F.col(field).cast("string")) != ""))
    key = F.struct(priority(F.col("provider"), order or OWN_ORDER.get(field, TITLE)).alias("p"), "provider", "rank")
    return there.groupBy("query_id").agg(F.min_by("provider", key).alias("provider"), F.min_by(field, key).alias("value"))


def one_per_source(rows: DataFrame) -> DataFrame:
    """One row for each source, whose name is compared without case: the highest score, then rank."""
    row = F.struct(*rows.columns)
    return rows.groupBy("query_id", F.lower("provider").alias("_p")).agg(F.min_by(row, F.struct((-F.col("score")).alias("s"), "rank", "provider")).alias("b")).select("b.*")


def union_sorted(rows: DataFrame, column: str) -> DataFrame:
    """query_id, values: the distinct values of a scalar column, sorted."""
    return rows.where(F.col(column).isNotNull()).groupBy("query_id").agg(F.array_sort(F.collect_set(column)).alias("values"))


def credits_union(rows: DataFrame) -> DataFrame:
    """query_id, name, roles of rows(query_id, name, role): roles once each whatever their case, sorted."""
    one = rows.where(F.coalesce(F.trim("name"), F.lit("")) != "").groupBy("query_id", "name", F.lower("role").alias("r")).agg(F.min("role").alias("role"))
    return one.groupBy("query_id", "name").agg(F.array_sort(F.collect_list("role")).alias("roles"))


def images_union(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """query_id, url, width, height, place of rows(query_id, provider, url, width, height, rank): once
    for each URL (the later source's), by falling area and then URL."""
    from pyspark.sql import Window

    late = F.struct("provider", "rank")
    one = rows.where("url is not null").groupBy("query_id", "url").agg(F.max_by("width", late).alias("width"), F.max_by("height", late).alias("height"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("width") * F.col("height")).desc(), "url")).cast("long")
    return one.withColumn("place", place)


def comparison(rows: DataFrame, fields: list[str]) -> DataFrame:
    """query_id, field, n_sources, n_values, different, for fields that two sources or more have."""
    values = long_form(rows, fields)
    out = values.groupBy("query_id", "field").agg(F.countDistinct("provider").alias("n_sources"), F.countDistinct("value").alias("n_values"))
    return out.where("n_sources >= 2").withColumn("different", F.col("n_values") > 1)


def _names(artists: Column) -> Column:
    """Names of an artist list, lower-cased, their white space reduced to single blanks."""
    return F.transform(artists, lambda a: F.lower(F.trim(F.regexp_replace(a, r"\s+", " "))))


def artist_votes(rows: DataFrame) -> DataFrame:
    """rows(query_id, provider, artists array<string>, ...) with vote: the sorted names as JSON.

    A single display text votes for a list of several artists if it is how exactly one such list of
    the same query is written: with ` & `, `, ` or ` and ` between all, or commas and ` & ` or ` and `
    before the last. Lists are joined by their spellings, so a query's rows never meet in pairs.
    """
    key = F.to_json(F.array_sort(_names(F.col("artists"))))
    named = rows.withColumns({"_n": _names(F.col("artists")), "_k": key})
    head = lambda n: F.array_join(F.slice(n, 1, F.size(n) - 1), ", ")
    n = F.col("_n")
    spelled = F.array(*[F.array_join(n, x) for x in (" & ", ", ", " and ")])
    listed = F.when(F.size(n) > 2, F.array(*[F.concat(head(n), F.lit(x), F.element_at(n, -1)) for x in (" & ", " and ")])).otherwise(F.array().cast("array<string>"))
    lists = named.where(F.size("_n") > 1).select("query_id", F.explode(F.concat(spelled, listed)).alias("_display"), "_k")
    one = lists.groupBy("query_id", "_display").agg(F.min("_k").alias("_one"), F.max("_k").alias("_other")).where("_one = _other").drop("_other")
    out = named.withColumn("_display", F.when(F.size("_n") == 1, F.element_at("_n", 1)))
    out = joined(out, one, ["query_id", "_display"], "left")
    return out.withColumn("vote", F.coalesce("_one", "_k")).drop("_n", "_k", "_display", "_one")


def longest_artists(voted: DataFrame, order: list[str] | None = None) -> DataFrame:
    """query_id, vote, artists, provider, n_votes of artist_votes(): the key with most votes (then the
    source's place in the order, the score, the name) and the longest list within it, the earlier
    source's on ties."""
    rank = priority(F.col("provider"), order or TITLE)
    first = F.struct(rank.alias("r"), (-F.col("score")).alias("s"), "provider")
    long = F.struct((-F.size("artists")).alias("n"), first.alias("f"), "artists")
    keys = voted.where(F.size("artists") > 0).groupBy("query_id", "vote").agg(F.count("*").alias("n_votes"), F.min(first).alias("best"), F.min(long).alias("long"))
    won = keys.groupBy("query_id").agg(F.min(F.struct((-F.col("n_votes")).alias("n"), "best", "vote", "long")).alias("w"))
    return won.select("query_id", "w.vote", F.col("w.long.artists").alias("artists"), F.col("w.long.f.provider").alias("provider"), (-F.col("w.n")).alias("n_votes"))


def artist_ids(selected: DataFrame, voted: DataFrame) -> DataFrame:
    """(query_id, place, name, provider, id): the ids that sources of the same vote give for the
    selected artists, matched by name without case; the first row of a source that has one counts.

    selected is longest_artists(), voted artist_votes() with artist_ids, a list beside artists.
    """
    fold = lambda c: F.lower(F.trim(c))
    mine = selected.select("query_id", "vote", F.posexplode("artists").alias("place", "name")).withColumn("k", fold("name"))
    others = voted.select("query_id", "vote", F.col("provider").alias("source"), "rank", F.posexplode(F.arrays_zip("artists", "artist_ids")).alias("at", "e"))
    others = others.select("query_id", "vote", "source", "rank", "at", fold("e.artists").alias("k"), F.col("e.artist_ids").alias("id")).where("coalesce(id, '') <> ''")
    found = joined(mine, others, ["query_id", "vote", "k"])
    return found.groupBy("query_id", "place", "name", F.col("source").alias("provider")).agg(F.min_by("id", F.struct("rank", "at")).alias("id"))


def album_editions(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """query_id, album, provider, track_number, disc_number, ids of rows(query_id, provider, score, album,
    album_id, track_number, disc_number, q_provider), one of each source.

    The title with most votes wins (then the source's place, the score, the name), but where the
    source asked by id has a title and an id of its own, its edition does. The position is that of the
    edition alone; ids are those that sources of the same title give for their own album.
    """
    there = rows.where(F.coalesce(F.trim("album"), F.lit("")) != "")
    has_id = F.coalesce("album_id", F.lit("")) != ""
    first = F.struct(priority(F.col("provider"), order or TITLE).alias("r"), (-F.col("score")).alias("s"), "provider", "album", "track_number", "disc_number")
    own = F.when((F.col("provider") == F.col("q_provider")) & has_id, first)
    ids = F.array_sort(F.collect_set(F.when(has_id, F.struct("provider", "album_id"))))
    titles = there.groupBy("query_id", F.lower(F.trim("album")).alias("vote")).agg(F.count("*").alias("n"), F.min(first).alias("best"), F.min(own).alias("own"), ids.alias("ids"))
    voted = F.min(F.struct((-F.col("n")).alias("n"), F.col("best").alias("e"), "ids"))
    won = titles.groupBy("query_id").agg(F.min(F.when(F.col("own").isNotNull(), F.struct(F.col("own").alias("e"), "ids"))).alias("a"), voted.alias("v"))
    pick = lambda f: F.when(F.col("a").isNotNull(), F.col(f"a.{f}")).otherwise(F.col(f"v.{f}"))
    chosen = won.select("query_id", pick("e").alias("e"), pick("ids").alias("ids"))
    return chosen.select("query_id", "e.album", "e.provider", "e.track_number", "e.disc_number", F.map_from_entries("ids").alias("ids"))


def copyrights_union(rows: DataFrame) -> DataFrame:
    """query_id, copyrights (type, text): once each, sorted by both joined."""
    one = rows.where("coalesce(text, '') <> ''").groupBy("query_id", "type", "text").agg(F.count("*").alias("n"))
    entry = F.struct(F.concat(F.coalesce("type", F.lit("")), "text").alias("k"), "type", "text")
    return one.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("e")).select("query_id", F.transform("e", lambda e: F.struct(e["type"].alias("type"), e["text"].alias("text"))).alias("copyrights"))


def totals(rows: DataFrame) -> DataFrame:
    """query_id, play_count (the largest), sources (sorted), ids (each source's own keys), match_score
    and the source of the highest score, the first (by score, then provider, then rank) on ties."""
    from melder.operators.links import owned_ids

    own = F.map_entries(owned_ids(F.lower("provider"), F.col("ids")))
    pairs = rows.select("query_id", F.explode(own).alias("e"), "provider", "rank").groupBy("query_id", F.col("e.key").alias("key")).agg(F.max_by("e.value", F.struct("provider", "rank")).alias("value"))
    ids = pairs.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("ids"))
    top = F.struct((-F.col("score")).alias("s"), "provider", "rank")
    out = rows.groupBy("query_id").agg(F.max("play_count").alias("play_count"), F.array_sort(F.collect_set("provider")).alias("sources"), F.max("score").alias("match_score"), F.min(top)["provider"].alias("top_source"))
    return joined(out, ids, "query_id", "left")


def best_image(images: DataFrame) -> DataFrame:
    """query_id, url of images(query_id, url, type, width, height, seq): a thumbnail before any other,
    then the largest area, then the first."""
    order = F.struct(F.when(F.col("type") == "thumbnail", 0).otherwise(1).alias("t"), (-(F.col("width").cast("long") * F.col("height"))).alias("a"), "seq")
    return images.where("coalesce(url, '') <> ''").groupBy("query_id").agg(F.min_by("url", order).alias("url"))
