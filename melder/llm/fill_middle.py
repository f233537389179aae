"""Fill-in-middle transformation (operator 12) by overlapping chunks.

A text's tokens begin where white space follows something else, so a boundary is seen in two
adjacent characters. A text is cut into chunks that overlap by one character; each chunk's
boundaries are counted on their own, running sums of the counts tell which chunks hold the two
cuts, and only those two chunks are scanned again for the places inside them.

All of it happens in the row that holds the text, which no step moves: the rearranged text is one
row too, so spreading a text's chunks over tasks would send it around for less work than hashing
it takes. Everything is an expression of the JVM; time and memory are linear in a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4096
#: White space, a token, the marks of the output.
BLANK = r"\x20\x09-\x0D"
TOKEN = f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_BOUNDARY = f"[^{BLANK}][{BLANK}]"
_NONE = "cast(null as struct<k: int, rank: int>)"


def chunks(text: Column, size: int = CHUNK) -> Column:
    """Pieces of `size` code points, each with the first one of the next piece at its end."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size + 1}}})).{{1,{size}}}"), F.lit(1))


def _route() -> Column:
    """lo and hi: the chunk (from 0) that owns each cut's boundary, and its rank in that chunk."""
    own = lambda r: f"case when a.seen < __{r} and __{r} <= a.seen + c then struct(a.k as k, cast(__{r} - a.seen as int) as rank) else a.{r} end as {r}"
    start = f"struct(0L as seen, 0 as k, {_NONE} as lo, {_NONE} as hi)"
    return F.expr(f"aggregate(__counts, {start}, (a, c) -> struct(a.seen + c as seen, a.k + 1 as k, {own('lo')}, {own('hi')}))")


def _place(cut: str, size: int) -> Column:
    """Code points before a cut: its owning chunk is scanned again up to the boundary's rank."""
    inside = F.expr(f"aggregate(slice(regexp_extract_all(get(__chunks, __at.{cut}.k), r'{TOKEN}', 0), 1, __at.{cut}.rank), 0, (a, x) -> a + char_length(x))")
    rank = F.col(f"__{cut}")
    return F.when(rank <= 0, 0).when(rank >= F.col("n"), F.char_length("__text")).otherwise(F.col(f"__at.{cut}.k") * size + inside).cast("int")


def restore(output: Column, form: Column) -> Column:
    """The text that a rearranged one was made of, from it and its form alone."""
    at = {mark: F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE)}

    def part(mark: str, until: str | None = None) -> Column:
        begin = at[mark] + len(mark)
        return F.substr(output, begin, (at[until] if until else F.char_length(output) + 1) - begin)

    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE), part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def rearrange(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, size: int = CHUNK) -> DataFrame:
    """docs with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    Cuts, and whether and how a text is rearranged, follow from the seed and doc_id alone. Plain: an
    empty or null text, one that contains a mark, and `percent` of the others; of the rest
    `spm_percent` are spm. A null doc_id draws as an empty one; rows that repeat an id draw alike.
    Columns of docs that carry a name of the result give way to it; an empty table stays empty.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    own = F.struct(*[docs[c] for c in docs.columns if c not in made])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))).cast("binary"), 256)
    df = docs.select(own.alias("__own"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("__text"), digest.alias("__digest"))
    h = [F.conv(F.substring("__digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]

    df = df.withColumn("__chunks", chunks(F.col("__text"), size))
    df = df.withColumn("__counts", F.transform("__chunks", lambda c: F.regexp_count(c, F.lit(_BOUNDARY)).cast("long")))
    df = df.withColumn("n", F.when(F.col("__text") == "", 0).otherwise(F.expr("aggregate(__counts, 1L, (a, c) -> a + c)")).cast("long"))
    plain = (F.col("__text") == "") | (h[2] % 100 >= percent)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(F.col("__text"), F.lit(mark))
    df = df.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm"))
    first, second = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    df = df.withColumns({"__lo": F.least(first, second), "__hi": F.greatest(first, second)})
    cut = F.col("form") != "plain"
    df = df.withColumn("__at", F.when(cut, _route()))
    df = df.withColumns({"__p": F.when(cut, _place("lo", size)), "__m": F.when(cut, _place("hi", size))})
    text = F.col("__text")
    one = F.lit(1)
    prefix, middle, suffix = F.substr(text, one, F.col("__p")), F.substr(text, F.col("__p") + 1, F.col("__m") - F.col("__p")), F.substr(text, F.col("__m") + 1)
    output = F.when(~cut, text).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    return df.select("__own.*", "n", "form", F.col("__p").cast("long").alias("prefix_chars"), (F.col("__m") - F.col("__p")).cast("long").alias("middle_chars"), output.alias("output"))
