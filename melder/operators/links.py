"""Catalogue links: recognising, cleaning, building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sources that links exist for.
PLATFORMS = ["bugs", "genie", "melon", "amazonmusic", "applemusic", "deezer", "jiosaavn", "musicbrainz", "pandora", "qobuz", "soundcloud", "spotify", "tidal", "ytmusic"]
UUID = r"[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}"
# What an id must look like, the link it makes, and what kind of id it is.
GRAMMAR = {
    "bugs": (r"^[0-9]+$", "https://music.bugs.co.kr/track/{id}", "track_id"),
    "genie": (r"^[0-9]+$", "https://www.genie.co.kr/detail/songInfo?xgnm={id}", "track_id"),
    "melon": (r"^[0-9]+$", "https://www.melon.com/song/detail.htm?songId={id}", "track_id"),
    "spotify": (r"^[A-Za-z0-9]{22}$", "https://open.spotify.com/track/{id}", "track_id"),
    "ytmusic": (r"^[A-Za-z0-9_-]{11}$", "https://music.youtube.com/watch?v={id}", "video_id"),
    "applemusic": (r"^[0-9]+$", "https://music.apple.com/us/song/{id}", "track_id"),
    "deezer": (r"^[0-9]+$", "https://www.deezer.com/track/{id}", "track_id"),
    "tidal": (r"^[0-9]+$", "https://tidal.com/track/{id}", "track_id"),
    "qobuz": (r"^[0-9]+$", "https://open.qobuz.com/track/{id}", "track_id"),
    "amazonmusic": (r"^[A-Za-z0-9_-]+$", "https://music.amazon.com/?trackAsin={id}", "track_id"),
    "soundcloud": (r"^[A-Za-z0-9_-]+/[A-Za-z0-9_-]+$", "https://soundcloud.com/{id}", "permalink"),
    "musicbrainz": (f"^{UUID}$", "https://musicbrainz.org/recording/{id}", "recording_mbid"),
    "pandora": (r"^(TR:[0-9]+|TR[A-Za-z0-9]{13}|[0-9]+)$", None, "track_id"),
    "jiosaavn": (r"^[A-Za-z0-9_-]+$", None, "song_token"),
}
# Ids of these shapes are of another kind; only an Amazon id of its shape makes a link.
SHAPED = {"amazonmusic": (r"^[A-Z0-9]{10}$", "asin"), "pandora": (r"^TR", "music_token")}
# Query parameters that only track.
TRACKING = ["uo", "at", "ct", "app", "si"]


def without_tracking(url: Column) -> Column:
    """The URL without tracking parameters; the others stay, sorted by name. Fragments stay."""
    head = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    tail = F.regexp_extract(url, r"(#.*)$", 1)
    key = lambda p: F.element_at(F.split(p, "=", 2), 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).isin(*TRACKING) & ~key(p).startswith("utm_")))
    return F.concat(head, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")), tail)


def parts(url: Column) -> dict[str, Column]:
    """scheme, host, path and query of a URL, null where it has none."""
    get = lambda p, i=1: F.nullif(F.regexp_extract(url, p, i), F.lit(""))
    return {
        "scheme": F.lower(get(r"^([A-Za-z][A-Za-z0-9+.-]*):")),
        "host": F.lower(get(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")),
        "path": get(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"),
        "query": get(r"\?([^#]*)"),
    }


#: The request field that a source's link fills.
LINK_FIELDS = {
    "spotify": "spotify_id", "ytmusic": "youtube_id", "applemusic": "apple_id", "deezer": "deezer_id", "jiosaavn": "jiosaavn_url", "soundcloud": "soundcloud_id", "musicbrainz": "musicbrainz_id", "tidal": "tidal_id", "qobuz": "qobuz_id",
}
_NUMBER = "^[0-9]{1,18}$"
_LOCALE = "^[a-zA-Z]{2}(-[a-zA-Z]{2})?$"


def _decoded(c: Column) -> Column:
    """Percent escapes resolved, a plus sign left alone; null for broken escapes."""
    return F.when(~c.rlike("%(?![0-9a-fA-F]{2})"), F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))


def recognised(rows: DataFrame, column: str = "url") -> DataFrame:
    """rows with link, a struct(provider, field, id) of a direct track link; null for any other.

    Only https without port and user, at most 4096 bytes, no control characters, encoded separators, empty
    or dot segments; a parameter that names the track occurs once. Hosts that only redirect, lists
    and albums aren't track links.
    """
    raw = F.trim(F.col(column))
    host = F.lower(F.regexp_extract("_raw", r"(?i)^https://([^/?#]*)", 1))
    path = F.regexp_extract("_raw", r"(?i)^https://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract("_raw", r"(?i)^https://[^/?#]*[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split("_query", "&"), lambda p: p != "")
    named = lambda k: F.filter("_params", lambda p: p["k"] == k)
    out = rows.withColumn("_raw", raw).withColumns({"_host": host, "_path": path, "_query": query})
    # step by step: nested, the expressions would be generated many times over
    out = out.withColumns({"_p": F.split(F.regexp_replace(_decoded(F.col("_path")), "^/+|/+$", ""), "/"), "_params": F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), _decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.lit("")).alias("v")))})
    out = out.withColumns({"_v": named("v"), "_i": named("i")})
    sound = (
        (F.octet_length("_raw") <= 4096) & ~F.col("_raw").rlike(r"[\x00-\x1F\x7F-\x9F]") & F.col("_host").rlike("^[^@:]+$") & ~F.col("_path").rlike(r"(?i)%2f|%5c|\\") & ~F.col("_query").contains(";")
        & ~F.exists("_p", lambda x: x.isin("", ".", "..")) & ~F.exists("_params", lambda p: p["k"].isNull() | p["v"].isNull()) & (F.size("_v") <= 1) & (F.size("_i") <= 1)
    )
    leave = lambda p, test: F.when(test, F.slice(p, 2, 100)).otherwise(p)
    p = F.col("_p")
    at = lambda q, i: F.get(q, F.lit(i))
    tail = F.when(F.col("_host") == "open.spotify.com", leave(p, (at(p, 0) == "embed") | at(p, 0).rlike("^intl-[a-zA-Z]{2}(-[a-zA-Z]{2})?$")))
    tail = tail.when(F.col("_host").isin("deezer.com", "www.deezer.com"), leave(p, (F.size(p) == 3) & at(p, 0).rlike(_LOCALE))).when(F.col("_host").endswith("tidal.com"), leave(p, (F.size(p) == 3) & (at(p, 0) == "browse"))).otherwise(p)
    out = out.withColumns({"_ok": F.coalesce(sound, F.lit(False)), "_t": tail, "_n": F.size("_p")})
    t, n = F.col("_t"), F.col("_n")
    track = (F.size(t) == 2) & (at(t, 0) == "track")
    only = lambda test, value, pattern: F.when(test & value.rlike(pattern), value)
    video = F.when(F.col("_host").isin("youtu.be", "www.youtu.be"), F.when(n == 1, at(p, 0))).when((n == 1) & (at(p, 0) == "watch"), F.get("_v", F.lit(0))["v"]).when((n == 2) & at(p, 0).isin("shorts", "embed", "live"), at(p, 1))
    apple = F.when(n.isin(3, 4) & at(p, 0).rlike(_LOCALE), F.when(at(p, 1) == "song", F.element_at(p, -1)).when(at(p, 1) == "album", F.get("_i", F.lit(0))["v"]))
    part = "^[A-Za-z0-9_-]+$"
    sounds = (n == 2) & at(p, 0).rlike(part) & at(p, 1).rlike(part) & (at(p, 1) != "sets") & ~at(p, 0).isin("discover", "you")
    rules = [
        ("spotify", ["open.spotify.com"], only(track, at(t, 1), "^[A-Za-z0-9]{22}$")),
        ("ytmusic", ["youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "www.youtu.be"], only(F.lit(True), video, "^[A-Za-z0-9_-]{11}$")),
        ("applemusic", ["music.apple.com", "itunes.apple.com"], only(F.lit(True), apple, _NUMBER)),
        ("deezer", ["deezer.com", "www.deezer.com"], only(track, at(t, 1), _NUMBER)),
        ("jiosaavn", ["jiosaavn.com", "www.jiosaavn.com"], F.when((n == 3) & (at(p, 0) == "song") & at(p, 2).rlike("^[A-Za-z0-9_,+-]{1,128}$"), F.concat(F.lit("https://www.jiosaavn.com/"), F.regexp_replace("_path", "^/+|/+$", "")))),
        ("soundcloud", ["soundcloud.com", "www.soundcloud.com", "m.soundcloud.com"], F.when(sounds, F.array_join(p, "/"))),
        ("musicbrainz", ["musicbrainz.org"], F.when((n == 2) & (at(p, 0) == "recording") & at(p, 1).rlike(f"^{UUID}$"), F.lower(at(p, 1)))),
        ("tidal", ["tidal.com", "www.tidal.com", "listen.tidal.com"], only(track, at(t, 1), _NUMBER)),
        ("qobuz", ["open.qobuz.com", "play.qobuz.com"], only(track, at(t, 1), _NUMBER)),
    ]
    uri = F.regexp_extract("_raw", "^spotify:track:([A-Za-z0-9]{22})$", 1)
    named_id = lambda provider, i: F.when(i.isNotNull(), F.struct(F.lit(provider).alias("provider"), F.lit(LINK_FIELDS[provider]).alias("field"), i.alias("id")))
    link = F.when(F.col("_raw").startswith("spotify:track:"), named_id("spotify", F.nullif(uri, F.lit(""))))
    for provider, hosts, i in rules:
        link = link.when(F.col("_ok") & F.col("_host").isin(*hosts), named_id(provider, i))
    return out.withColumn("link", link).drop("_raw", "_host", "_path", "_query", "_p", "_params", "_v", "_i", "_ok", "_t", "_n")


def owned_url(provider: Column, id_: Column, url: Column) -> Column:
    """The URL without tracking parameters if it is a track page of the provider that carries this
    very id; else null. Other parameters than the one that holds the id aren't allowed."""
    clean = without_tracking(url)
    p = parts(clean)
    host, path, query = p["host"], F.trim(F.coalesce(p["path"], F.lit("")), F.lit("/")), F.coalesce(p["query"], F.lit(""))
    last = F.element_at(F.split(path, "/"), -1)
    before = F.try_element_at(F.split(path, "/"), F.lit(-2))
    bare = query == ""
    only = lambda k: query == F.concat(F.lit(f"{k}="), id_)
    track = path == F.concat(F.lit("track/"), id_)
    rules = {
        "bugs": (host == "music.bugs.co.kr") & track & bare,
        "genie": (host == "www.genie.co.kr") & (path == "detail/songInfo") & only("xgnm"),
        "melon": (host == "www.melon.com") & (path == "song/detail.htm") & only("songId"),
        "spotify": (host == "open.spotify.com") & track & bare,
        "ytmusic": (host == "music.youtube.com") & (path == "watch") & only("v"),
        "applemusic": (host == "music.apple.com") & F.when(F.concat(F.lit("/"), path, F.lit("/")).contains("/album/"), only("i")).otherwise(F.concat(F.lit("/"), path, F.lit("/")).contains("/song/") & (last == id_) & (bare | only("i"))),
        "deezer": host.isin("www.deezer.com", "deezer.com") & F.coalesce(before == "track", F.lit(False)) & (last == id_) & bare,
        "qobuz": host.isin("open.qobuz.com", "play.qobuz.com") & track & bare,
        "tidal": host.isin("tidal.com", "listen.tidal.com") & (track | (path == F.concat(F.lit("browse/track/"), id_))) & bare,
        "amazonmusic": (host == "music.amazon.com") & (((path == F.concat(F.lit("tracks/"), id_)) & bare) | (((path == "") | path.startswith("albums/")) & only("trackAsin"))),
        "pandora": (host == "www.pandora.com") & (last == id_) & bare,
        "soundcloud": (host == "soundcloud.com") & (path == id_) & bare,
        "jiosaavn": host.isin("www.jiosaavn.com", "jiosaavn.com") & path.rlike("^song/[^/]*/[^/]*$") & (last == id_) & bare,
        "musicbrainz": (host == "musicbrainz.org") & (path == F.concat(F.lit("recording/"), id_)) & bare,
    }
    plain = url.rlike(r"^https://[^/?#@:]+(?:[/?]|$)") & ~url.contains("#")
    out = F.lit(False)
    for name, rule in rules.items():
        out = F.when(provider == name, rule).otherwise(out)
    return F.when(plain & F.coalesce(out, F.lit(False)), clean)


def build(ids: DataFrame) -> DataFrame:
    """query_id, platform, id, id_type, lookup_id, url, url_source of ids(query_id, platform, id) with
    optional provider_url and native_id: ids that don't fit their platform's grammar are left out.
    A URL of the provider that carries the id goes before the template's; a native id takes the
    place of a permalink or token, which becomes lookup_id; ytmusic brings its youtube twin."""
    i = F.trim("id")
    ok, url, kind = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string")
    for p, (pattern, template, id_type) in GRAMMAR.items():
        mine = F.col("platform") == p
        shape, shaped = SHAPED.get(p, (None, None))
        made = F.replace(F.lit(template), F.lit("{id}"), i) if template else F.lit(None).cast("string")
        ok = F.when(mine, i.rlike(pattern)).otherwise(ok)
        url = F.when(mine, F.when(i.rlike(shape), made) if shape and template else made).otherwise(url)
        kind = F.when(mine, F.when(i.rlike(shape), shaped).otherwise(id_type) if shape else F.lit(id_type)).otherwise(kind)
    none = F.lit(None).cast("string")
    given = owned_url(F.col("platform"), i, F.col("provider_url")) if "provider_url" in ids.columns else none
    native = F.col("native_id") if "native_id" in ids.columns else none
    swap = F.coalesce(F.col("platform").isin("soundcloud", "jiosaavn") & native.rlike(r"^[A-Za-z0-9_-]+$") & ((F.col("platform") != "soundcloud") | native.rlike(r"^[0-9]+$")), F.lit(False))
    own = ids.where(ok).select(
        "query_id", "platform", F.when(swap, native).otherwise(i).alias("id"), F.when(swap, "track_id").otherwise(kind).alias("id_type"), F.when(swap, i).alias("lookup_id"),
        F.coalesce(given, url).alias("url"), F.when(given.isNotNull(), "provider").when(url.isNotNull(), "id_template").alias("url_source"),
    )
    # exploded, not united: the plan below would run once more for the twins
    rest = ["id", "id_type", "lookup_id"]
    row = F.struct("platform", *rest, "url", "url_source")
    twin = F.struct(F.lit("youtube").alias("platform"), *rest, F.concat(F.lit("https://www.youtube.com/watch?v="), "id").alias("url"), F.lit("id_template").alias("url_source"))
    return own.select("query_id", F.explode(F.when(F.col("platform") == "ytmusic", F.array(row, twin)).otherwise(F.array(row))).alias("l")).select("query_id", "l.*")


def loose_id(provider: str, text: Column) -> Column:
    """The id inside a link of any form, cut out by its surroundings; text without them is the id."""
    t = F.trim(text)
    after = lambda mark: F.trim(F.element_at(F.split(F.element_at(F.split(t, mark), 2), r"\?"), 1), F.lit("/"))
    if provider == "spotify":
        return F.when(t.contains("spotify.com/track/"), after("spotify.com/track/")).otherwise(t)
    if provider == "youtube":
        return F.when(t.contains("youtu.be/"), after("youtu[.]be/")).when(t.contains("v="), F.element_at(F.split(F.element_at(F.split(t, "v="), 2), "&"), 1)).otherwise(t)
    if provider == "soundcloud":
        return F.when(t.contains("soundcloud.com/"), after("soundcloud[.]com/")).otherwise(F.regexp_replace(t, "^/", ""))
    raise ValueError(f"no rule for {provider}")


def unavailable(built: DataFrame) -> DataFrame:
    """query_id, platforms: those without a link, sorted."""
    have = built.groupBy("query_id").agg(F.collect_set("platform").alias("have"))
    known = F.array(*[F.lit(p) for p in sorted([*PLATFORMS, "youtube"])])
    return have.select("query_id", F.array_except(known, "have").alias("platforms"))


def owned_ids(provider: Column, ids: Column) -> Column:
    """The entries of an id map that a source may speak for: its own name, its url, its track id."""
    return F.map_filter(ids, lambda k, _: k.isin(provider) | (k == F.concat(provider, F.lit("_url"))) | (k == F.concat(provider, F.lit("_track_id"))))
