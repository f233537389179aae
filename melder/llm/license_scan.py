"""License scans (operator 9), in DataFrame functions alone.

Two findings for each text: the places of fixed phrases, and an exact set-similarity join of
license templates with the text's blocks. A template's tokens are ordered by their frequency
over all documents, rarest first; a block can hold the needed share of them only if it has one
of the template's prefix (prefix filter), enough tokens of the vocabulary (length filter) and
enough left after the first common one (positional filter). Those that are left are counted.

Templates are constants, so the join's one side is a literal and no row moves: the only shuffle
is the frequency count of the templates' vocabulary, a few hundred rows for each task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    ("under", "the", "mit", "license"): "mit",
    ("apache", "license", "version", "2"): "apache-2",
    ("cc", "by", "nc"): "cc-by-nc",
}

#: License notices, as words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "apache-2",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
]

THRESHOLD = 0.9
#: Not a letter or digit of ASCII, and not beyond ASCII; in a text without lower-casing, and after.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template:
    """A token set in global frequency order, with what the filters need."""

    def __init__(self, label: str, words: str, order: dict[str, tuple[int, str]], threshold: float):
        self.label = label
        self.tokens = sorted(set(words.split()), key=order.__getitem__)
        self.need = math.ceil(threshold * len(self.tokens) - 1e-9)
        self.prefix = self.tokens[: len(self.tokens) - self.need + 1]
        # blocks of twice a power of two, half overlapping: any passage of that power's length lies in one
        self.stride = 1 << max(4, (len(words.split()) - 1).bit_length())


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _words(docs: DataFrame) -> DataFrame:
    """__w: lower-cased words. lower() is exact here but for the two letters that it maps into
    ASCII; texts with one of these are translated letter by letter."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = F.when(t.rlike("[Kİ]"), F.translate(t, upper, low)).otherwise(F.lower(t))
    return docs.withColumn("__w", F.filter(F.split(lowered, BETWEEN), lambda w: w != ""))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of the (constant) vocabulary occurs."""
    hit = _words(docs.select("text")).select(F.explode(F.array_intersect(_array(vocabulary), F.col("__w"))).alias("word"))
    return {r["word"]: r["n"] for r in hit.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _places(words: tuple[str, ...]) -> Column:
    """Indexes at which the words stand consecutively."""
    test = " and ".join(f"get(__w, i + {k}) = '{w}'" for k, w in enumerate(words))
    return F.expr(f"case when array_contains(__w, '{words[-1]}') and size(__w) >= {len(words)} then filter(sequence(0, size(__w) - {len(words)}), i -> {test}) else cast(array() as array<int>) end")


def _blocks_found(t: Template, blocks: str) -> str:
    """SQL for (label, word, share) of the blocks that pass the filters and hold enough of the
    template; `blocks` are (b, word): the vocabulary's tokens in a block, and where it starts."""
    tokens, prefix = (f"array({', '.join(repr(w) for w in x)})" for x in (t.tokens, t.prefix))
    n, need = len(t.tokens), t.need
    # b: a block's tokens of the vocabulary in frequency order; both prefixes must meet
    kept = f"filter({blocks}, y -> size(y.b) >= {need} and arrays_overlap(slice(y.b, 1, greatest(size(y.b) - {need} + 1, 0)), {prefix}))"
    placed = f"filter({kept}, y -> exists(sequence(0, {len(t.prefix) - 1}), i -> array_position(y.b, get({prefix}, i)) > 0 and least({n} - i, size(y.b) - array_position(y.b, get({prefix}, i)) + 1) >= {need}))"
    counts = f"transform({placed}, y -> struct('{t.label}' as label, y.word as word, size(array_intersect({tokens}, y.b)) / {n}D as share))"
    return f"filter({counts}, y -> y.share >= {need} / {n}D)"


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, places and blocks.

    Words are lower-cased runs of ASCII letters and digits and of anything beyond ASCII. places
    holds (label, word index) of each phrase, blocks (label, index of its first word, share) of
    each block with at least `threshold` of a template's distinct tokens. A template's blocks start
    at every stride (a power of two, as long as it at least) and are two strides long. labels adds
    those of blocks. score: 1 with a phrase, else the best block's share, else 0. Null and empty texts have no words, no labels and score 0.
    Repeated rows each get their result. Columns of docs that carry a name of the result give
    way to it.
    """
    vocabulary = sorted({w for _, words in TEMPLATES for w in words.split()})
    seen = frequencies(docs, vocabulary)
    order = {w: (seen.get(w, 0), w) for w in vocabulary}
    templates = [Template(label, words, order, threshold) for label, words in TEMPLATES]
    ordered = sorted(vocabulary, key=order.__getitem__)

    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places", "blocks"]
    own = [c for c in docs.columns if c not in made]
    df = _words(docs.select(F.struct(*[docs[c] for c in own]).alias("__own"), docs["text"].alias("text"))).drop("text")
    starts = F.array(*[F.struct(F.lit(label).alias("label"), _places(words).alias("at")) for words, label in PHRASES.items()])
    df = df.withColumn("n_words", F.size("__w").cast("long")).withColumn("__at", starts)
    # the prefix filter over the whole text, before any block is made
    rare = sorted({w for t in templates for w in t.prefix})
    df = df.withColumn("__maybe", F.arrays_overlap("__w", _array(rare)))
    known = f"array({', '.join(repr(w) for w in ordered)})"
    strides = sorted({t.stride for t in templates})
    for s in strides:
        df = df.withColumn(f"__b{s}", F.expr(f"case when __maybe then transform(sequence(0, greatest(size(__w) - 1, 0), {s}), k -> struct(array_intersect({known}, slice(__w, k + 1, {2 * s})) as b, cast(k as bigint) as word)) else cast(array() as array<struct<b: array<string>, word: bigint>>) end"))
    df = df.drop("__w")
    found = ", ".join(_blocks_found(t, f"__b{t.stride}") for t in templates)
    df = df.withColumn("blocks", F.expr(f"case when __maybe then flatten(array({found})) else cast(array() as array<struct<label: string, word: bigint, share: double>>) end"))
    df = df.withColumn("places", F.expr("flatten(transform(__at, p -> transform(p.at, i -> struct(p.label as label, cast(i as bigint) as word))))"))
    df = df.withColumn("__base", F.expr("array_sort(array_distinct(transform(places, p -> p.label)))"))
    df = df.withColumn("__more", F.expr("transform(blocks, x -> x.label)"))
    best = F.coalesce(F.expr("array_max(transform(blocks, x -> x.share))"), F.lit(0.0))
    return df.select(
        "__own.*",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.expr("array_min(transform(places, p -> p.word))").alias("first_word"),
        F.expr("array_max(transform(places, p -> p.word))").alias("last_word"),
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", "__more")), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        "places",
        "blocks",
    )
