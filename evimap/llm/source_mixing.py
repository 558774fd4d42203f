"""Mix sources to target weights by Poisson replication, with DataFrame functions only.

A source's rate is its target share of all bytes over its present share. Each
document's number of copies inverts the Poisson distribution of that mean at a point
which a seeded hash of its id gives, so copies never depend on the order or place of
rows. The copies are dealt to partitions and sorted by a hash of id and copy number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "*"
SEED = 7


def _unit(*parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(2**52)


def bucket_of(source: Column, weights: dict[str, float]) -> Column:
    """A source with a weight of its own, else OTHER, which all further sources and null share."""
    return F.when(source.isin([s for s in weights if s != OTHER]), source).otherwise(OTHER)


def rates(df: DataFrame, weights: dict[str, float], source: str = "source", text: str = "text", epochs: float = 1.0) -> DataFrame:
    """(bucket, rate, cdf) for each source that has rows: at most len(weights) + 1.

    cdf holds the Poisson distribution function of the rate up to where no hash reaches.
    Weights are relative to those that have bytes. A weighted source without bytes changes
    no share, so it gets the rate of ``epochs``.
    """
    goal = F.coalesce(*[F.when(F.col("bucket") == s, F.lit(float(w))) for s, w in weights.items()], F.lit(0.0))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("double")
    sums = df.select(bucket_of(F.col(source), weights).alias("bucket"), size.alias("size")).groupBy("bucket").agg(F.sum("size").alias("bytes")).withColumn("goal", goal)
    total = sums.where(F.col("bytes") > 0).agg(F.coalesce(F.sum("bytes"), F.lit(0.0)).alias("all_bytes"), F.coalesce(F.sum("goal"), F.lit(0.0)).alias("all_goals"))
    both = sums.join(F.broadcast(total), F.lit(True))  # one row of sums
    rate = F.expr(f"case when goal = 0 then 0D when bytes = 0 then {epochs}D else {epochs}D * goal / nullif(all_goals, 0) * all_bytes / nullif(bytes, 0) end")
    steps = F.expr("transform(sequence(1, cast(ceil(rate + 12 * sqrt(rate) + 30) as int)), x -> ln(rate) - ln(x))")
    # partial sums of exp(-rate + sum of logs), k = 0, 1, ...
    fold = F.aggregate(steps, F.struct((-F.col("rate")).alias("log"), F.array(F.exp(-F.col("rate"))).alias("cdf")),
                       lambda a, s: F.struct((a["log"] + s).alias("log"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + F.exp(a["log"] + s))).alias("cdf")))
    return both.select("bucket", rate.alias("rate")).withColumn("cdf", F.when(F.col("rate") > 0, fold["cdf"]).otherwise(F.array(F.lit(1.0))))


def mix(df: DataFrame, weights: dict[str, float], id_col: str = "doc_id", source: str = "source", text: str = "text", epochs: float = 1.0,
        seed: int = SEED, copy_col: str = "copy", order_col: str | None = None) -> DataFrame:
    """``df`` with each row as often as its source's rate asks for, globally shuffled, and ``copy_col`` from 0.

    A source without weight shares OTHER's; with no weight for OTHER it goes. Null
    sources belong to OTHER, a null id hashes like the text "null". Rows of one id
    and source get one number of copies; columns named like the added ones are
    replaced. Empty texts count no bytes but are copied like others, by the rate
    ``epochs`` if their source has no bytes at all. Without a weighted source the result is empty.
    """
    kept = [c for c in df.columns if c.lower() not in {copy_col.lower(), (order_col or copy_col).lower()}]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    # one row for each weight at most, so it may be sent to every task
    table = F.broadcast(rates(df, weights, source, text, epochs).select(F.col("bucket").alias("__bucket"), F.col("cdf").alias("__cdf")))
    rows = df.select(*kept).withColumn("__bucket", bucket_of(F.col(source), weights)).join(table, "__bucket")
    copies = F.size(F.filter("__cdf", lambda c: c <= _unit(F.lit(seed), key)))
    out = rows.withColumn("__n", copies).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    out = out.withColumn("__order", F.md5(F.concat_ws(":", F.lit(seed + 1), key, F.col("__copy"))))
    out = out.repartition("__order").sortWithinPartitions("__order")
    more = [F.col("__copy").cast("long").alias(copy_col)] + ([F.col("__order").alias(order_col)] if order_col else [])
    return out.select(*kept, *more)
