"""The bounded property graph: nodes, edges, and credits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melder.session import joined

# Caps of one graph.
MAX_NODES, MAX_EDGES = 4096, 8192


def node_id(provider: Column, kind: Column, native: Column) -> Column:
    return F.concat_ws(":", provider, kind, native)


def local_artist_id(provider: Column, target: Column, name: Column) -> Column:
    """A name's own node below a target: equal names of different sources stay apart."""
    nul = F.lit("\x00")
    return F.concat(F.lit("local:artist:"), F.substring(F.sha2(F.concat(provider, nul, target, nul, name).cast("binary"), 256), 1, 24))


def upsert(nodes: DataFrame) -> DataFrame:
    """root, id, type, provider, name: an entity once, with its first name (by seq) that isn't empty."""
    named = F.when(F.trim("name") != "", F.struct("seq", "name"))
    return nodes.where("id is not null").groupBy("root", "id").agg(F.min_by("type", "seq").alias("type"), F.min_by("provider", "seq").alias("provider"), F.min(named)["name"].alias("name"))


def add_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges (root, source, target, type, attributes) between two nodes that exist."""
    n = nodes.select("root", "id")
    out = edges.where("source <> target").withColumn("attributes", F.array_sort("attributes")).distinct()
    out = joined(out, n.withColumnRenamed("id", "source"), ["root", "source"], "left_semi")
    return joined(out, n.withColumnRenamed("id", "target"), ["root", "target"], "left_semi")


def bounded(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each root's graph and whether others were left out."""
    w = Window.partitionBy("root")
    n = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("n", n).withColumn("truncated", F.count("*").over(w) > most).where(F.col("n") <= most).drop("n")


def capped(nodes: DataFrame, edges: DataFrame, most_nodes: int = MAX_NODES, most_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each root's graph within both caps, with truncated: whether the graph lost any.

    nodes(root, id, seq, ...) and edges(root, source, target, type, seq, ...) may be a union of several
    graphs of a root. The first nodes by first appearance (seq, then id) stay, once each with their first
    row; then the first edges between two of them, equal ones once. A root's graph is cut by its
    rank before anything is gathered, so a hot root costs a sort of its own rows.
    """
    row = F.struct("seq", *[c for c in nodes.columns if c not in ("root", "id", "seq")])
    once = nodes.where("id is not null").groupBy("root", "id").agg(F.min(row).alias("r")).select("root", "id", "r.*")
    w = Window.partitionBy("root")
    ranked = once.withColumns({"place": F.row_number().over(w.orderBy("seq", "id")), "_n": F.count("*").over(w)})
    kept = ranked.where(F.col("place") <= most_nodes).withColumn("_cut", F.col("_n") > most_nodes).drop("_n")
    one = edges.where("source <> target").groupBy("root", "source", "target", "type").agg(F.min(F.struct("seq", *[c for c in edges.columns if c not in ("root", "source", "target", "type", "seq")])).alias("r")).select("root", "source", "target", "type", "r.*")
    for end in ("source", "target"):
        one = one.join(kept.select("root", F.col("id").alias(end)), ["root", end], "left_semi")
    placed = one.withColumns({"place": F.row_number().over(w.orderBy("seq", "source", "target", "type")), "_n": F.count("*").over(w)})
    inside = placed.where(F.col("place") <= most_edges).withColumn("_over", F.col("_n") > most_edges).drop("_n")
    flags = kept.groupBy("root").agg(F.bool_or("_cut").alias("a")).join(inside.groupBy("root").agg(F.bool_or("_over").alias("b")), "root", "left")
    flags = flags.select("root", (F.col("a") | F.coalesce("b", F.lit(False))).alias("truncated"))
    return kept.drop("_cut").join(flags, "root"), inside.drop("_over").join(flags, "root")


def album(albums: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of albums(album_id, title, tracks) as the readers of sources.albums give them: the
    release, its returned track entries, which appear on it at their places, and the artists of each
    entry, who are nodes of their own below it. The root is the release."""
    root = node_id(F.lit(provider), F.lit("release"), F.col("album_id"))
    t = albums.select(root.alias("root"), "album_id", F.posexplode("tracks").alias("i", "t")).select("root", "album_id", ((F.col("i") + 1) * 1000).alias("seq"), "t.*")
    entry = node_id(F.lit(provider), F.lit("track_entry"), F.concat_ws("/", "album_id", F.col("disc").cast("string"), F.col("position").cast("string"), "track_id"))
    t = t.withColumn("entry", entry)
    a = t.select("root", "entry", "seq", F.posexplode("artists").alias("j", "artist")).where("coalesce(trim(artist), '') <> ''").withColumns({"seq": F.col("seq") + F.col("j") + 1, "who": local_artist_id(F.lit(provider), F.col("entry"), F.col("artist"))})
    nodes = albums.select(root.alias("root"), root.alias("id"), F.lit(0).alias("seq"), F.lit("release").alias("type"), F.col("title").alias("name"))
    nodes = nodes.unionAll(t.select("root", "entry", "seq", F.lit("track_entry"), "title")).unionAll(a.select("root", "who", "seq", F.lit("artist"), "artist"))
    edges = t.select("root", F.col("entry").alias("source"), F.col("root").alias("target"), F.lit("appears_on").alias("type"), "seq", "disc", "position", F.lit(None).cast("string").alias("role"))
    none = F.lit(None).cast("int")
    return nodes, edges.unionAll(a.select("root", "who", "entry", F.lit("credit"), "seq", none, none, F.lit("primary_artist")))


def _once(rows: Column, key: Callable[[Column], Column]) -> Column:
    """The entries of an array of structs in their natural order, the first of each key alone."""
    # bound as a one-entry array: an expression that a lambda mentions would be worked out for each entry
    both = F.array(F.struct(rows.alias("rows"), F.transform(rows, key).alias("keys")))
    return F.get(F.transform(both, lambda s: F.filter(s["rows"], lambda x, i: F.array_position(s["keys"], key(x)) == i + 1)), F.lit(0))


def album_graphs(albums: DataFrame, provider: str, most_nodes: int = MAX_NODES, most_edges: int = MAX_EDGES) -> DataFrame:
    """root, nodes, edges and truncated: capped() of album(), for albums that have one row each. An album's
    tracks are bounded, so its graph is made and cut within its row and nothing is shuffled."""
    p = F.lit(provider)
    root = node_id(p, F.lit("release"), F.col("album_id"))
    entry = lambda t: node_id(p, F.lit("track_entry"), F.concat_ws("/", "album_id", t["disc"].cast("string"), t["position"].cast("string"), t["track_id"]))
    named = lambda t: F.filter(F.transform(t["artists"], lambda a, j: F.struct(a.alias("name"), j.alias("j"))), lambda a: F.trim(a["name"]) != "")
    placed = F.transform("tracks", lambda t, i: F.struct(((i + 1) * 1000).alias("seq"), entry(t).alias("entry"), t["title"].alias("title"), t["disc"].alias("disc"), t["position"].alias("position"), named(t).alias("artists")))
    who = lambda e: F.transform(e["artists"], lambda a: F.struct((e["seq"] + a["j"] + 1).alias("seq"), local_artist_id(p, e["entry"], a["name"]).alias("who"), a["name"].alias("name")))
    made = F.transform(placed, lambda e: F.struct(*[e[c].alias(c) for c in ("seq", "entry", "title", "disc", "position")], who(e).alias("artists")))
    out = albums.select(root.alias("root"), "title", F.coalesce(made, F.array()).alias("_made"))
    node = lambda seq, i, kind, name: F.struct(seq.alias("seq"), i.alias("id"), F.lit(kind).alias("type"), name.alias("name"))
    below = lambda e: F.concat(F.array(node(e["seq"], e["entry"], "track_entry", e["title"])), F.transform(e["artists"], lambda a: node(a["seq"], a["who"], "artist", a["name"])))
    nodes = F.concat(F.array(node(F.lit(0), F.col("root"), "release", F.col("title"))), F.flatten(F.transform("_made", below)))
    edge = lambda seq, a, b, kind, disc, position, role: F.struct(seq.alias("seq"), a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), disc.alias("disc"), position.alias("position"), role.alias("role"))
    none = F.lit(None).cast("int")
    ends = lambda e: F.concat(
        F.array(edge(e["seq"], e["entry"], F.col("root"), "appears_on", e["disc"], e["position"], F.lit(None).cast("string"))),
        F.transform(e["artists"], lambda a: edge(a["seq"], a["who"], e["entry"], "credit", none, none, F.lit("primary_artist"))),
    )
    out = out.select("root", F.sort_array(nodes).alias("_nodes"), F.sort_array(F.flatten(F.transform("_made", ends))).alias("_edges"))
    out = out.withColumn("_nodes", _once(F.col("_nodes"), lambda n: n["id"])).withColumn("nodes", F.slice("_nodes", 1, most_nodes))
    inside = F.transform(F.array(F.col("nodes.id")), lambda ids: F.filter("_edges", lambda e: (e["source"] != e["target"]) & F.array_contains(ids, e["source"]) & F.array_contains(ids, e["target"])))
    out = out.withColumn("_edges", F.get(inside, F.lit(0)))
    out = out.withColumn("_edges", _once(F.col("_edges"), lambda e: F.struct(e["source"], e["target"], e["type"])))
    return out.select("root", "nodes", F.slice("_edges", 1, most_edges).alias("edges"), ((F.size("_nodes") > most_nodes) | (F.size("_edges") > most_edges)).alias("truncated"))


def credit_edges(credits: DataFrame) -> DataFrame:
    """source, target, type, attributes of credits(root, provider, target, native_artist, name, role).

    A structured credit hides one that only gives the name.
    """
    structured = credits.where("native_artist is not null").select("root", "target", F.lower(F.trim("name")).alias("k"), "role").distinct()
    loose = joined(credits.where("native_artist is null").withColumn("k", F.lower(F.trim("name"))), structured, ["root", "target", "k", "role"], "left_anti").drop("k")
    both = credits.where("native_artist is not null").unionByName(loose)
    source = F.coalesce(node_id(F.col("provider"), F.lit("artist"), F.col("native_artist")), local_artist_id(F.col("provider"), F.col("target"), F.col("name")))
    source = F.when(F.col("native_artist").isNull(), local_artist_id(F.col("provider"), F.col("target"), F.col("name"))).otherwise(source)
    return both.select("root", source.alias("source"), "target", F.lit("credit").alias("type"), F.array("role").alias("attributes"))


def contributors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes from which a credit edge starts."""
    return joined(nodes, edges.where("type = 'credit'").select("root", F.col("source").alias("id")).distinct(), ["root", "id"], "left_semi")


def directed(edges: DataFrame) -> DataFrame:
    """Relationships read backward swap their ends; those without a direction stay `relationship`."""
    back = F.col("direction") == "backward"
    return edges.select("root", F.when(back, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(back, F.col("source")).otherwise(F.col("target")).alias("target"), F.when(F.col("direction").isin("forward", "backward"), F.col("type")).otherwise(F.lit("relationship")).alias("type"))
