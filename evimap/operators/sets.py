"""Merging views, ordered unions, orders, samples and set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimap.functions.text import available_clean, clean_text


def merge_views(views: DataFrame, key: str, order: str, fields: Sequence[str], documents: str | None = None, complete: str | None = None) -> DataFrame:
    """Several views of one ticket to one row.

    Per field the first available value in view order; documents once per
    equal text, in order; complete only if no view says otherwise.
    """
    aggregates = []
    for field in fields:
        value = clean_text(F.col(field))
        aggregates.append(F.min_by(value, F.when(available_clean(value), F.col(order))).alias(field))
    if documents:
        aggregates.append(F.array_distinct(F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(documents), F.array().cast("array<string>")).alias("d")))),
            lambda v: v["d"]))).alias(documents))
    if complete:
        aggregates.append(F.bool_and(F.coalesce(complete, F.lit(True))).alias(complete))
    return views.groupBy(key).agg(*aggregates)


def distinct_union(*lists: Column, limit: int | None = None) -> Column:
    """Ordered union of arrays without repeats."""
    joined = F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))
    return F.slice(joined, 1, limit) if limit else joined


def stable_order(df: DataFrame, *keys: str) -> DataFrame:
    """Total order: score down, pointer up; a range shuffle, no single task."""
    return df.orderBy(F.desc("score"), F.asc("pointer"), *(F.asc(k) for k in keys))


def window_gaps(windows: DataFrame, key: list[str]) -> DataFrame:
    """Windows that do not start inside the one before or repeat its start."""
    order = Window.partitionBy(*key).orderBy("start_token", "end_token")
    previous = windows.withColumn("last_start", F.lag("start_token").over(order)).withColumn("last_end", F.lag("end_token").over(order))
    return previous.where(
        (F.col("last_start").isNull() & (F.col("start_token") != 0))
        | (F.col("start_token") <= F.col("last_start")) | (F.col("start_token") >= F.col("last_end"))
    ).select(*key, "start_token", "last_start", "last_end")


def sample_negatives(items: DataFrame, keys: list[str], label: str = "label", order: Sequence[str] = ("sample_id", "target", "pointer", "start_token"),
                     salts: int = 64) -> DataFrame:
    """All positives and hard negatives, and the first max(2, twice as many) easy ones.

    ``label`` is positive, hard or easy; easy ones are taken in the order of a
    hash of stable keys, so the choice does not depend on row order. Counting
    is combined before the shuffle. A group is one record and target, bounded
    by the record limits; easy rows are still ranked in salted parts first, and
    from each part only as many rows as the group may keep go on.
    """
    kept = items.where(F.col(label) != "easy")
    limit = items.groupBy(*keys).agg(F.greatest(F.lit(2), 2 * F.count_if(F.col(label) != "easy")).alias("limit"))
    easy = items.where(F.col(label) == "easy").withColumn("_hash", F.sha2(F.to_json(F.struct(*order)), 256))
    easy = easy.withColumn("_salt", F.pmod(F.xxhash64("_hash"), F.lit(salts))).join(limit, keys)
    part = Window.partitionBy(*keys, "_salt").orderBy("_hash")
    group = Window.partitionBy(*keys).orderBy("_hash")
    near = easy.withColumn("_turn", F.row_number().over(part)).where(F.col("_turn") <= F.col("limit"))
    first = near.withColumn("_turn", F.row_number().over(group)).where(F.col("_turn") <= F.col("limit"))
    return kept.unionByName(first.select(*items.columns))


def length_batches(items: DataFrame, size: int, seed: int, length: str = "n_tokens", tie: str = "item_hash") -> DataFrame:
    """Batches of similar length in a seeded order: adds (position, batch, batch_order).

    A position is the number of shorter items, plus those of the same length
    with a smaller hash prefix, plus the rank inside that prefix. Counts are
    combined before the shuffle and a common length is split over 65,536
    prefixes, so no task sees all rows of one length.
    """
    cut = items.withColumn("_prefix", F.substring(tie, 1, 4))
    counts = cut.groupBy(length, "_prefix").agg(F.count(F.lit(1)).alias("n"))
    # one row per distinct length, bounded by the longest item
    lengths = counts.groupBy(length).agg(F.sum("n").alias("n"))
    before = Window.orderBy(length).rowsBetween(Window.unboundedPreceding, -1)
    shorter = lengths.select(length, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shorter"))
    inside = Window.partitionBy(length).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(shorter, length).select(
        length, "_prefix", (F.col("_inside") + F.col("_shorter")).alias("_start")
    )
    local = Window.partitionBy(length, "_prefix").orderBy(tie)
    placed = cut.withColumn("_at", F.row_number().over(local)).join(starts, [length, "_prefix"])
    return (
        placed.withColumn("position", F.col("_start") + F.col("_at") - 1)
        .withColumn("batch", F.floor(F.col("position") / size))
        .withColumn("batch_order", F.xxhash64("batch", F.lit(seed))).drop("_prefix", "_at", "_start")
    )


def split_overlap(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split, with the splits."""
    folded = df.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count(F.lit(1)).alias("records"))
    return folded.where(F.size("splits") > 1)


def difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys of the left side without a partner."""
    return left.select(*key).distinct().join(right.select(*key), key, "left_anti")


def joined_or_missing(left: DataFrame, right: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matched rows, left rows without a partner)."""
    return left.join(right, key), left.join(right.select(*key), key, "left_anti")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def split_intersections(df: DataFrame, group: str, split: str = "split", pairs: Sequence[tuple[str, str]] = (
        ("train", "development"), ("train", "frozen-test"), ("development", "frozen-test"))) -> DataFrame:
    """(pair, group) for every two splits that share a group.

    Read from the set of splits per group, so the data is shuffled once.
    """
    folded = df.groupBy(group).agg(F.collect_set(split).alias("splits"))
    shared = F.array_compact(F.array(*(
        F.when(F.array_contains("splits", a) & F.array_contains("splits", b), F.lit(f"{a}/{b}")) for a, b in pairs
    )))
    return folded.select(F.explode(shared).alias("pair"), group)
