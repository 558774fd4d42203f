"""Readers, canonical writers, manifests and the split-partitioned dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap import constants as K
from evimap.functions.jsoncols import canonical_json


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt) of JSON lines with a given schema; blank lines are skipped.

    Nothing is inferred. A line that does not fit is kept as text in the second
    frame instead of failing the table.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    checked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.select("value", F.from_json("value", checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull() | F.try_parse_json("value").isNull()
    return parsed.where(~bad).select(*(F.col(f"r.{f.name}") for f in schema.fields)), parsed.where(bad).select(F.col("value").alias("line"))


def canonical_lines(df: DataFrame) -> Column:
    """One JSON line per row: sorted keys, NULL fields left out by the JSON writer."""
    return canonical_json(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), python=True)


def dataset_digest(lines: DataFrame, column: str = "line") -> DataFrame:
    """(records, digest) of a text column, whatever the order and number of files.

    The digest is a hash of sums over the row hashes, see :func:`folded_digest`.
    """
    return folded_digest(lines.select(F.sha2(F.col(column), 256).alias("h")), [])


LANES, LANE_DIGITS = 5, 15


def folded_digest(hashes: DataFrame, by: list[str]) -> DataFrame:
    """(by, records, digest) of a column ``h`` of row hashes, repeats included.

    Each hash is cut into four 60-bit numbers and its last 16 bits, all summed: sums merge on
    the map side, so neither a task nor a group ever holds a list of hashes.
    """
    lanes = [
        F.sum(F.conv(F.substring("h", 1 + LANE_DIGITS * n, LANE_DIGITS), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"lane{n}")
        for n in range(LANES)
    ]
    sums = hashes.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), *lanes)
    folded = F.sha2(F.concat_ws(":", F.col("records").cast("string"), *(F.col(f"lane{n}") for n in range(LANES))), 256)
    return sums.select(*by, "records", folded.alias("digest"))


def write_canonical(df: DataFrame, path: str, key: str) -> DataFrame:
    """Write sorted canonical JSON lines; returns the (lazy) digest of what lies there."""
    lines = df.select(F.col(key).alias("_key"), canonical_lines(df).alias("value"))
    lines.repartitionByRange("_key").sortWithinPartitions("_key").select("value").write.mode("errorifexists").text(path)
    return dataset_digest(df.sparkSession.read.text(path), "value")


def manifest(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """(by, records, digest) per source."""
    row = F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"})
    return folded_digest(df.select(by, F.sha2(row, 256).alias("h")), [by])


def verify_manifest(actual: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """(by, violation) where counts or digests differ, or one side lacks a source."""
    both = actual.join(expected.withColumnsRenamed({"records": "want_records", "digest": "want_digest"}), by, "full_outer")
    violation = (
        F.when(F.col("want_digest").isNull(), "unexpected_source").when(F.col("digest").isNull(), "missing_source")
        .when(F.col("records") != F.col("want_records"), "count_mismatch").when(F.col("digest") != F.col("want_digest"), "hash_mismatch")
    )
    return both.select(by, violation.alias("violation")).where("violation is not null")


def write_partitions(df: DataFrame, path: str) -> None:
    """One folder per split."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def read_partition(spark: SparkSession, path: str, split: str, promotion: bool = False) -> DataFrame:
    """One split of a partitioned dataset; only its folder is read.

    The frozen part is for promotion only and is refused otherwise.
    """
    if split not in K.SPLITS:
        raise ValueError(f"unknown split: {split}")
    if split == "frozen-test" and not promotion:
        raise PermissionError("the frozen-test partition is read by the promotion evaluation only")
    return spark.read.parquet(path).where(F.col("split") == split)
