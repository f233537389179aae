"""Benchmark decontamination (operator 13) by a positional inverted index, in DataFrame functions alone.

Test items are cut into windows of consecutive words. One pass over the training texts counts how
often each test word occurs there; a window's rarest words are its anchors, and a second pass stores
the postings (word, document, position) of all anchors. Starting from the postings of the rarest anchor,
lists are intersected: those of the other anchors near enough in the same document make a
proximity match, those at the very offsets a candidate for the phrase, whose other words are then
compared with the document's. A document is one row with its doc_id and text: rows that repeat both
have equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.llm.common import lower_ascii, small_side, written

WINDOW = 10
ANCHORS = 3
#: Words within which a window's anchors count as a proximity match, in any order.
SPAN = 16
#: Neither a letter or digit of ASCII nor beyond ASCII, before A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

DOC = ["doc", "hash"]


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lowered."""
    split = F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN), lambda w: w != "")
    return F.transform(split, lower_ascii)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key of a row: doc and hash, which equal rows share and no others."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("hash"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a digest), words, item_ids: the distinct word lists of benchmark(item_id, text)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    digest = F.md5(F.array_join("words", " ").cast("binary"))
    return rows.select("item_id", "words", digest.alias("item")).groupBy("item").agg(F.first("words").alias("words"), F.collect_set("item_id").alias("item_ids"))


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of terms(term), distinct ones, occurs in docs; others are absent."""
    return docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(small_side(terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def anchors_of(items: DataFrame, counts: DataFrame, width: int = WINDOW, most: int = ANCHORS) -> DataFrame:
    """item, terms, offsets: the distinct anchors of items' windows, rarest first. A window with a word
    that occurs nowhere can't either and has none."""
    each = items.select("item", F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
    lists = each.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("e"))
    wide = f"least({width}, size(e))"
    windows = F.expr(f"transform(sequence(0, size(e) - {wide}), j -> slice(e, j + 1, {wide}))")
    rare = F.transform(F.filter(windows, lambda w: F.forall(w, lambda x: x["n"] > 0)), lambda w: F.slice(F.array_sort(F.transform(w, lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), x["term"].alias("term")))), 1, most))
    one = lists.select("item", F.explode(F.array_distinct(rare)).alias("a"))
    return one.select("item", F.col("a.term").alias("terms"), F.col("a.at").alias("offsets"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: term, doc, hash, pos of terms(term) in keyed() docs, written."""
    each = docs.select(*DOC, F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return written(each.join(small_side(terms), "term").select("term", *DOC, "pos"), "postings")


def intersect(index: DataFrame, sets: DataFrame, most: int = ANCHORS, span: int = SPAN) -> DataFrame:
    """doc, hash, terms, at: places of all words of each of sets(terms), distinct ones with the rarest
    first, within `span` words; `at` are distinct positions in the order of terms.

    The rarest word's postings come first; each next list is met in bands of `span` words, so
    that postings of a frequent word in one long text are never paired with each other.
    """
    found = index.join(small_side(sets.withColumn("term", F.get("terms", F.lit(0)))), "term").select(*DOC, "terms", F.array("pos").alias("at"))
    band = lambda c: F.floor(c / span)
    for k in range(1, most):
        nth = small_side(sets.where(F.size("terms") > k).select(F.get("terms", F.lit(k)).alias("term")).distinct())
        lists = index.join(nth, "term", "left_semi").select("term", *DOC, band(F.col("pos")).alias("band"), "pos")
        reach = F.sequence(band(F.array_max("at") - (span - 1)), band(F.array_min("at") + span - 1))
        near = found.where(F.size("terms") > k).withColumns({"term": F.get("terms", F.lit(k)), "band": F.explode(reach)})
        met = near.join(lists, [*DOC, "term", "band"])
        every = F.concat("at", F.array("pos"))
        met = met.where((F.array_max(every) - F.array_min(every) < span) & ~F.array_contains("at", F.col("pos")))
        found = met.select(*DOC, "terms", every.alias("at")).unionByName(found.where(F.size("terms") <= k))
    return found


def search(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most: int = ANCHORS, span: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scanned, phrases, near, items) of docs(doc_id, text) and benchmark(item_id, text).

    scanned: doc_id, doc, hash, n_words, one row for each of docs. phrases: doc, hash, item, start: an
    item's window of `width` words (all words of a shorter one) occurs at word `start`, and length. near:
    doc, hash, item: anchors of one of the item's windows stand within `span` words. items:
    items_of(benchmark). Null texts have no words. Tables are written on the way.
    """
    d = keyed(docs)
    items = written(items_of(benchmark), "items")
    terms = written(items.select(F.explode("words").alias("term")).distinct(), "terms")
    counts = written(frequencies(d, terms), "counts")
    anchors = written(anchors_of(items, counts, width, most), "anchors")
    index = postings(d, written(anchors.select(F.explode("terms").alias("term")).distinct(), "anchor_terms"))
    sets = written(anchors.select("terms").distinct(), "anchor_sets")
    near = written(intersect(index, sets, most, max(span, width)), "matches").join(small_side(anchors), "terms")

    # at the very offsets: where the item would begin
    aligned = F.expr("forall(sequence(0, size(at) - 1), i -> at[i] - at[0] = offsets[i] - offsets[0])")
    spots = near.where(aligned).select(*DOC, "item", (F.get("at", F.lit(0)) - F.get("offsets", F.lit(0))).alias("begin")).distinct()
    spots = spots.join(small_side(items.select("item", F.size("words").alias("m"))), "item")
    lists = written(spots.groupBy(*DOC).agg(F.collect_list(F.struct("item", "begin", "m")).alias("spots")), "spots")
    seen = d.withColumn("words", words_of(F.col("text"))).join(small_side(lists), DOC, "left")
    piece = "transform(spots, s -> struct(s.item as item, s.begin as begin, slice(words, greatest(s.begin, 0) + 1, s.m + least(s.begin, 0)) as words))"
    scanned = written(seen.select("doc_id", *DOC, F.size("words").cast("long").alias("n_words"), F.expr(piece).alias("pieces")), "scanned")

    spot = scanned.where("pieces is not null").select(*DOC, F.explode("pieces").alias("p")).select(*DOC, "p.item", "p.begin", F.col("p.words").alias("have")).distinct()
    both = spot.join(small_side(items.select("item", "words")), "item")
    equal = F.expr("transform(words, (w, i) -> coalesce(w = get(have, i + least(begin, 0)), false))")
    wide = f"least({width}, size(words))"
    starts = F.expr(f"transform(filter(sequence(0, size(words) - {wide}), j -> forall(slice(equal, j + 1, {wide}), x -> x)), j -> begin + j)")
    phrases = both.withColumn("equal", equal).select(*DOC, "item", F.explode(starts).alias("start"), F.expr(wide).alias("length"))
    return scanned.drop("pieces"), phrases, near.select(*DOC, "item").distinct(), items


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, item_ids (sorted as
    strings), n_near (items with a proximity match), contaminated, for each row of docs.

    Items with a null id or text, and texts without words, take no part in n_items; windows of an item
    whose id is null hit all the same. Repeated rows each get their result; a benchmark or a table
    without rows gives no hits; other columns aren't read.
    """
    scanned, phrases, near, items = search(docs, benchmark, width)
    phrases = written(phrases, "phrases")
    hit = phrases.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    ids = small_side(written(items.select("item", "item_ids"), "item_ids"))
    named = phrases.select(*DOC, "item").distinct().join(ids, "item").select(*DOC, F.explode_outer("item_ids").alias("item_id"))
    listed = named.groupBy(*DOC).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    close = near.join(ids, "item").select(*DOC, F.explode("item_ids").alias("item_id")).groupBy(*DOC).agg(F.countDistinct("item_id").alias("n_near"))
    out = scanned.join(hit, DOC, "left").join(listed, DOC, "left").join(close, DOC, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    found = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("item_ids"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (n_hit > 0).alias("contaminated"))
