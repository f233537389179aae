"""Mixing sources to target weights by Poisson replication (operator 10).

A document of source s is repeated k times, where k inverts the Poisson distribution with the
source's mean repetition rate at a number that a hash of the document's id seeds: the same rows
give the same mixture on any cluster, in any order. Copies are then dealt by a hash to all
partitions and sorted by another part of it within each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melder.llm.common import written

SEED = "mix-1"
#: Without weights a source's share is its row count to this power: small sources gain, all stay.
TEMPERATURE = 0.7
BROADCAST_BYTES = 16_000_000  # of the sources' distributions; beyond it documents are joined with them by salted keys
SALTS = 64  # parts into which a source is cut then


def _tag(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """(s, rate): the mean number of copies of a row of each source, so that sources reach their
    weights and all copies `total` (the number of rows) on average. A source that `weights`
    doesn't name has weight 0; without weights every source has its rows to the power TEMPERATURE.
    """
    n = docs.groupBy(_tag(F.col("source")).alias("s")).agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow("n", F.lit(TEMPERATURE)))
    else:
        given = docs.sparkSession.createDataFrame([("=" + k, float(v)) for k, v in weights.items()], "s string, w double")
        n = n.join(given, "s", "left").fillna(0.0, ["w"])
    sums = n.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    wanted = F.lit(float(total)) if total is not None else F.col("all_n")
    return n.crossJoin(sums).select("s", F.when(F.col("all_w") > 0, wanted * F.col("w") / F.col("all_w") / F.col("n")).otherwise(F.lit(0.0)).alias("rate"))


def _distributions(rate: DataFrame) -> DataFrame:
    """(s, cdf): cumulative Poisson probabilities from 0 on, as far as a double can tell them from 1."""
    last = F.expr("cast(ceil(rate + 12 * sqrt(rate) + 20) as int)")
    steps = rate.where("rate > 0").select("s", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    ahead = Window.partitionBy("s").orderBy("k")
    p = F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(ahead))
    steps = steps.select("s", "k", p.alias("p")).withColumn("c", F.sum("p").over(ahead))
    some = steps.groupBy("s").agg(F.expr("transform(array_sort(collect_list(struct(k, c))), x -> x.c)").alias("cdf"))
    return some.unionByName(rate.where("not rate > 0").select("s", F.array(F.lit(1.0)).alias("cdf")))


def _with_distribution(rows: DataFrame, cdf: DataFrame) -> DataFrame:
    """rows with the cdf of their source: no row moves while all distributions together are small;
    beyond that a source's rows are dealt to SALTS parts by their document."""
    cdf = written(cdf, "distributions")
    size = cdf.agg(F.sum(8 * F.size("cdf") + F.octet_length("s") + 64).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(cdf), "s")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    return salted.join(cdf.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["s", "salt"]).drop("salt")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: str = SEED) -> DataFrame:
    """docs with copy (1 to k) and mix_key, each row k times, in the order of a global shuffle.

    docs has doc_id and source. A null source is a source of its own, a null doc_id the text
    'null'. Rows that repeat a doc_id share its k. An empty table gives an empty result. Columns
    of docs named copy or mix_key give way.
    """
    own = [docs[c] for c in docs.columns if c not in ("copy", "mix_key")]
    cdf = _distributions(rates(docs.select("source"), weights, total))
    doc = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*own).alias("row"), doc.alias("doc"), _tag(docs["source"]).alias("s"))
    counted = _with_distribution(rows, cdf).withColumn("u", uniform(F.lit(seed), "doc")).withColumn("k", F.expr("size(filter(cdf, c -> c < u))"))
    copies = counted.where("k > 0").select("row", "doc", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "doc", F.col("copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    return copies.select("row.*", "copy", key.alias("mix_key")).repartition("mix_key").sortWithinPartitions("mix_key")


#: DuckDB's statement of mix() over documents with the default weights.
MIX_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n) * pow(n, {TEMPERATURE}) / (SELECT sum(pow(n, {TEMPERATURE})) FROM n) / n AS rate FROM n),
cdf AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM r CROSS JOIN (SELECT unnest(range(0, 120)) AS k)),
u AS (SELECT *, (('0x' || substr(md5('{SEED}|' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM cdf WHERE cdf.source = u.source AND cdf.c < u.u) AS k FROM u)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       ('0x' || substr(md5('{SEED}|' || doc_id || '|' || copy), 1, 15))::BIGINT AS mix_key
FROM (SELECT *, unnest(range(1, k + 1)) AS copy FROM k)
"""
