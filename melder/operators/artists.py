"""Resolution of artist names and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melder.functions.text import clean_artist


def resolve_names(asked: DataFrame, references: DataFrame) -> DataFrame:
    """name, status, id, n_candidates of asked(name) against references(provider, id, name).

    One distinct id with the same cleaned name is `found`, several are `ambiguous`, none is
    `not_found`.
    """
    r = references.where("id is not null").select(clean_artist(F.col("name")).alias("k"), "id").distinct().groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    out = asked.withColumn("k", clean_artist(F.col("name"))).join(r, "k", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("name", F.when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("one")).alias("id"), n.alias("n_candidates"))


def distinct_references(references: DataFrame) -> DataFrame:
    """References with valid ids, the first (by seq) of each provider and id."""
    row = F.struct(*references.columns)
    valid = references.where("coalesce(trim(cast(id as string)), '') <> '' and coalesce(trim(name), '') <> ''")
    return valid.groupBy("provider", "id").agg(F.min_by(row, "seq").alias("r")).select("r.*")


def biography(sections: DataFrame) -> DataFrame:
    """artist_id, biography: section texts in order, joined by a blank line."""
    texts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return sections.where("coalesce(trim(text), '') <> ''").groupBy("artist_id").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n").alias("biography"))


def listed(rows: DataFrame, limit: int = 20) -> DataFrame:
    """The first `limit` (1 to 50) of each artist's entries with distinct ids, by seq."""
    if not 1 <= limit <= 50:
        raise ValueError("a limit is between 1 and 50")
    from pyspark.sql import Window

    row = F.struct(*rows.columns)
    one = rows.where("coalesce(trim(cast(id as string)), '') <> ''").groupBy("artist_id", "id").agg(F.min_by(row, "seq").alias("r")).select("r.*")
    n = F.row_number().over(Window.partitionBy("artist_id").orderBy("seq", "id")).cast("long")
    return one.withColumn("place", n).where(F.col("place") <= limit)
