"""Candidates for requests out of a catalogue: by native id, by ISRC, by words of title and artist.

A later tier runs only for the requests and sources that an earlier one left empty. Words are found
through an inverted index of the catalogue's distinct texts: its blocks are pairs of an artist's word
and one of the title's rarest words (of those one must be shared, if enough of both titles is),
and a block that many texts share is cut into parts, each met on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melder.functions.text import artist_words, clean_title, tokens, without_article
from melder.session import joined, staged

#: Candidates of one request and source.
MOST = 10
#: Share of common words from which titles are compared further; no accepted title has less.
LEAST = 0.72
#: Texts of an index block beyond which it is cut into parts.
BLOCK_TEXTS = 20_000


def _code(c: str) -> Column:
    return F.upper(F.trim(c))


def _given(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) != ""


def _first(rows: DataFrame, group: list[str], order: list[Column | str], most: int, name: str = "rank") -> DataFrame:
    """The first `most` rows of each group with their place; Spark limits a group before it is shuffled."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    return rows.withColumn(name, n).where(F.col(name) <= most)


def _texts(rows: DataFrame, title: str, artist: str) -> DataFrame:
    """Distinct title and artist of rows, with tw and aw, the distinct words of each."""
    one = rows.select(F.coalesce(title, F.lit("")).alias("title"), F.coalesce(artist, F.lit("")).alias("artist")).distinct()
    # column by column: nested, the expressions would be generated many times over
    one = one.withColumns({"_clean": clean_title(F.col("title")), "aw": artist_words(F.col("artist"))})
    return one.withColumns({"tw": tokens(F.col("_clean")), "aw": F.array_distinct(without_article(F.col("aw")))}).drop("_clean")


def _counted(texts: DataFrame, words: str) -> DataFrame:
    return texts.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("df"))


def _ordered(texts: DataFrame, words: str, counts: DataFrame) -> DataFrame:
    """texts with `words` in the order of counts, rarest first; words that counts lacks come first of all."""
    each = texts.select("title", "artist", F.explode(words).alias("w")).join(counts, "w", "left")
    lists = each.groupBy("title", "artist").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("o"))
    return joined(texts, lists, ["title", "artist"]).withColumn(words, F.col("o.w")).drop("o")


def _prefix(words: Column, least: float) -> Column:
    n = F.size(words)
    return F.slice(words, 1, F.greatest(n - F.ceil(n * least - 1e-9) + 1, F.lit(0)).cast("int"))


class Index:
    """The inverted index of a catalogue's texts, written once for any number of searches.

    texts: title and artist with the words of both, title words rarest first; titles, names: how many
    texts have a word; blocks: (a, t) to texts, a an artist's word and t one of the rarest words of
    the title; large: the blocks that are cut, with their number of parts; about: columns of the catalogue
    that go with the records that are found.
    """

    def __init__(self, catalogue: DataFrame, least: float = LEAST, block: int = BLOCK_TEXTS, about: list[str] | None = None):
        self.least, self.about, self._heads = least, about or [], {}
        # written before it is filtered: a filter pushed down would clean every text once more
        texts = staged(_texts(catalogue, "title", "artist"), "texts").where("size(tw) > 0 and size(aw) > 0")
        self.titles, self.names = staged(_counted(texts, "tw"), "title_words"), staged(_counted(texts, "aw"), "artist_words")
        blocks = _ordered(texts, "tw", self.titles).withColumn("a", F.explode("aw")).withColumn("t", F.explode(_prefix(F.col("tw"), least)))
        self.blocks = staged(blocks, "index")
        large = self.blocks.groupBy("a", "t").agg(F.count("*").alias("c")).where(F.col("c") > block)
        self.large = staged(large.select("a", "t", F.ceil(F.col("c") / block).cast("int").alias("parts")), "blocks")

    def heads(self, catalogue: DataFrame, most: int) -> DataFrame:
        """The first `most` records of each source with the same title and artist, written once."""
        if most not in self._heads:
            same = F.coalesce("title", F.lit("")).alias("title"), F.coalesce("artist", F.lit("")).alias("artist")
            rows = catalogue.select("provider", "native_id", *same, *self.about)
            self._heads[most] = staged(_first(rows, ["provider", "title", "artist"], ["native_id"], most, "head").drop("head"), "heads")
        return self._heads[most]

    def similar(self, asked: DataFrame) -> DataFrame:
        """q_title, q_artist, title, artist, ratio, artist_ratio: the texts with at least the share `least`
        of words common to both cleaned titles, whose artist has all words of the wanted one.
        Texts without words match nothing."""
        want = staged(_texts(asked, "q_title", "q_artist"), "wanted").where("size(tw) > 0 and size(aw) > 0")
        probe = _ordered(_ordered(want, "tw", self.titles), "aw", self.names).withColumn("a", F.get("aw", F.lit(0)))
        probe = probe.withColumn("t", F.explode(_prefix(F.col("tw"), self.least))).withColumnsRenamed({"title": "q_title", "artist": "q_artist", "tw": "q_tw", "aw": "q_aw"})
        parts = F.coalesce("parts", F.lit(1))
        index = self.blocks.join(self.large, ["a", "t"], "left").withColumn("part", F.pmod(F.xxhash64("title", "artist"), parts).cast("int")).drop("parts")
        probe = probe.join(self.large, ["a", "t"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        met = joined(probe, index, ["a", "t", "part"])
        shared = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
        met = met.withColumns({"ratio": shared("q_tw", "tw"), "artist_ratio": shared("q_aw", "aw")})
        return met.where((F.col("ratio") >= self.least) & (F.size(F.array_except("q_aw", "aw")) == 0)).select("q_title", "q_artist", "title", "artist", "ratio", "artist_ratio").distinct()


def by_id(wanted: DataFrame, catalogue: DataFrame, more: list[str] | None = None, about: list[str] | None = None) -> DataFrame:
    """query_id, provider, native_id, rank, wanted's columns `more` and the catalogue's `about`: the record
    asked for by its own source's id, compared with case."""
    own = wanted.where(_given("q_id") & (F.lower("provider") == F.lower(F.col("q_provider")))).select("query_id", "provider", F.col("q_id").alias("native_id"), *(more or []))
    records = catalogue.select("provider", "native_id", *(about or []))
    return joined(own, records, ["provider", "native_id"]).select("query_id", "provider", "native_id", F.lit(1).cast("long").alias("rank"), *(more or []), *(about or []))


def by_isrc(wanted: DataFrame, catalogue: DataFrame, most: int = MOST, more: list[str] | None = None, about: list[str] | None = None) -> DataFrame:
    """The first records, by native id, of each source with the request's ISRC."""
    asked = wanted.where(_given("q_isrc")).select("query_id", "provider", _code("q_isrc").alias("code"), *(more or []))
    heads = _first(catalogue.where(_given("isrc")).select("provider", "native_id", _code("isrc").alias("code"), *(about or [])), ["provider", "code"], ["native_id"], most)
    return joined(asked, heads, ["provider", "code"]).select("query_id", "provider", "native_id", "rank", *(more or []), *(about or []))


def by_words(wanted: DataFrame, catalogue: DataFrame, index: Index, most: int = MOST, more: list[str] | None = None) -> DataFrame:
    """The first records of each source whose title and artist match the request's in words: by the
    weighted share of common words, then native id.

    Texts that requests share are searched once, and records that share a text are cut to the first
    `most` of a source before they meet a request.
    """
    asked = wanted.where(_given("q_title") & _given("q_artist")).select("query_id", "provider", "q_title", "q_artist", *(more or []))
    pairs = index.similar(asked)
    heads = index.heads(catalogue, most)
    order = [(0.55 * F.col("ratio") + 0.45 * F.col("artist_ratio")).desc(), F.col("native_id")]
    found = _first(joined(pairs, heads, ["title", "artist"]), ["q_title", "q_artist", "provider"], order, most)
    return joined(asked, found, ["q_title", "q_artist", "provider"]).select("query_id", "provider", "native_id", "rank", *(more or []), *index.about)


def retrieve(wanted: DataFrame, catalogue: DataFrame, index: Index, most: int = MOST, more: list[str] | None = None) -> DataFrame:
    """query_id, provider, native_id, rank, tier, the index's columns `about` and the columns `more` of wanted(query_id, provider, q_title, q_artist, q_isrc,
    q_provider, q_id), a row for each source to ask, over catalogue(provider, native_id, title, artist, isrc)
    and its Index.

    tier is id, isrc or words. The source whose id is asked for is looked up by it alone. Each tier is
    written before the next looks at what it left.
    """
    key = ["query_id", "provider"]
    own = F.coalesce(_given("q_id") & (F.lower("provider") == F.lower("q_provider")), F.lit(False))
    ids = staged(by_id(wanted, catalogue, more, index.about), "by_id")
    rest = wanted.where(~own)
    codes = staged(by_isrc(rest, catalogue, most, more, index.about), "by_isrc")
    words = staged(by_words(joined(rest, codes.select(*key).distinct(), key, "left_anti"), catalogue, index, most, more), "by_words")
    tiers = [df.select(*key, "native_id", "rank", F.lit(name).alias("tier"), *(more or []), *index.about) for df, name in ((ids, "id"), (codes, "isrc"), (words, "words"))]
    return tiers[0].unionAll(tiers[1]).unionAll(tiers[2])
