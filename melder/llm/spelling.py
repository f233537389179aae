"""Spelling variants (operator 11) by a join on evenly cut halves of words.

Two words that differ by one code point share one half unchanged. Words are indexed by their length
and each of their two halves; words of the same length probe the halves at the same places, words one
longer at the same place (the edit lies behind it) or shifted by one (it lies before). A half that
many words share is a list of its own kind: what is left of its words is cut in two halves again by
the same rule, so no list is ever paired with itself whole. Candidates are verified where they meet,
found ones deduplicated, and each word then looks for its form among its near words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.llm.common import lower_ascii, small_side, written

#: Fixed value: the letters of a run.
LETTERS = r"A-Za-zÀ-ÿ"
#: Words that share a half beyond which their rests are cut again.
LIST = 16
MAX_ROUNDS = 40


def vocabulary(docs: DataFrame, least: int = 6, occurrences: int = 5, every: int = 199) -> DataFrame:
    """word, n of docs(doc_id, text): runs of letters, A-Z lowered, with at least `least` code points
    and `occurrences` occurrences over all rows.

    With h the crc32 of `<doc_id>:<run>`, a run whose h divides by `every` loses code point h modulo
    its length. A null id counts as an empty one, a null text has no words, repeated rows count
    each. Shorter runs can't give a word and aren't taken out of the text; counts are summed up
    before they are shuffled.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    df = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    df = df.select("id", lower_ascii(F.col("run")).alias("run"))
    df = df.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = df.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def _halves(w: Column, shift: Column | int) -> Column:
    """(place, half, rest) of both halves of w; with shift 1 as probes of words one shorter."""
    f = F.floor((F.char_length(w) - shift) / 2).cast("int")
    one = F.lit(1)
    first = F.struct(F.lit(1).alias("place"), F.substr(w, one, f).alias("half"), F.substr(w, f + 1).alias("rest"))
    second = F.struct(F.lit(2).alias("place"), F.substr(w, f + shift + 1).alias("half"), F.substr(w, one, f + shift).alias("rest"))
    return F.array(first, second)


def near_words(words: DataFrame, most: int = LIST) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words(word, n) that differ by exactly one
    inserted, deleted or replaced code point. Each word must occur once in words; null has none."""
    w = F.col("word")
    base = words.where(w.isNotNull()).select("word", "n", F.char_length(w).alias("l"))
    index = base.select("word", "n", "l", F.explode(_halves(w, 0)).alias("x")).select("word", "n", "l", "x.*")
    same = base.select("word", "n", "l", F.lit(0).alias("d"), F.explode(_halves(w, 0)).alias("x"))
    longer = base.where("l > 1").select("word", "n", (F.col("l") - 1).alias("l"), F.lit(1).alias("d"), F.explode(_halves(w, 1)).alias("x"))
    probe = same.unionAll(longer).select("word", "n", "l", "d", "x.*")
    key = ["l", "place", "half"]
    long = written(index.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > most).select(*key, F.lit(True).alias("long")), "lists")
    whole = F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("half"), F.lit("").alias("rest")))

    def keyed(df: DataFrame, shift: Column | int) -> DataFrame:
        again = F.when(F.coalesce("long", F.lit(False)), _halves(F.col("rest"), shift)).otherwise(whole)
        return df.join(long, key, "left").withColumn("y", F.explode(again)).withColumns({"place2": F.col("y.place"), "half2": F.col("y.half")}).drop("y", "long", "rest")

    a = keyed(index, 0)
    b = keyed(probe, F.col("d")).withColumnsRenamed({"word": "word_b", "n": "n_b"})
    one_edit = F.levenshtein(F.col("word"), F.col("word_b"), 1) == 1
    met = a.join(b, [*key, "place2", "half2"]).where(((F.col("d") == 1) | (F.col("word") < F.col("word_b"))) & one_edit)
    pairs = written(met.select("word", "n", "word_b", "n_b").distinct(), "near")
    return pairs.select("word", "n", F.col("word_b").alias("near"), F.col("n_b").alias("near_n")).unionAll(pairs.select("word_b", "n_b", "word", "n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form), whose chains end: each round joins every word's root with that
    word's own, so a chain of length c takes log2(c) rounds."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        further = small_side(now.select(F.col("word").alias("root"), F.col("root").alias("next")))
        step = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now
    raise RuntimeError(f"forms did not settle in {MAX_ROUNDS} rounds")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n).

    form is the near word of largest n (the smallest in code-point order on ties) if that is at least
    `ratio` (over 1) times the word's n, else null; root is the last of the forms' forms, the word
    itself if it has none. Near words of a word are at most as many as one edit can spell.
    """
    if ratio < 2:
        raise ValueError("with a ratio under 2 forms may go round in circles")
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    taken = -F.col("b.m") >= ratio * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("b.near")).alias("form"), F.when(taken, -F.col("b.m")).alias("form_n"))
    out = written(out, "forms")
    roots = _roots(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
