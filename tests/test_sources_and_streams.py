"""Storage rules and stream replay."""

import pytest
from pyspark.sql import functions as F

from evimap.sources import records as S
from evimap.streaming import replay


def test_bad_lines_are_kept_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n  \n{"a": "no"\n{"a": 2, "b": "y"}\n')
    good, bad = S.read_records(spark, str(tmp_path / "in"), "a long, b string")
    assert {(r.a, r.b) for r in good.collect()} == {(1, "x"), (2, "y")}
    assert [r.line for r in bad.collect()] == ['{"a": "no"']


def test_digest_ignores_order_and_files(spark, tmp_path):
    rows = spark.range(500).select("id", F.concat(F.lit("v"), "id").alias("v"))
    one = S.write_canonical(rows, str(tmp_path / "one"), "id").first()
    two = S.write_canonical(rows.orderBy(F.desc("id")).repartition(7), str(tmp_path / "two"), "id").first()
    assert one == two and one.records == 500
    assert S.write_canonical(rows.where("id > 0"), str(tmp_path / "three"), "id").first().digest != one.digest


def test_frozen_partition_is_refused(spark, tmp_path):
    path = str(tmp_path / "parts")
    S.write_partitions(spark.createDataFrame([("a", "train"), ("b", "frozen-test")], "id string, split string"), path)
    assert S.read_partition(spark, path, "train").count() == 1
    with pytest.raises(PermissionError):
        S.read_partition(spark, path, "frozen-test")
    plan = S.read_partition(spark, path, "train")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_settled_pages(spark, tmp_path):
    def at(page, ms, signature, complete=True, busy=False):
        return (page, ms, signature, complete, busy)

    rows = [at("a", 0, "x"), at("a", 200, "y"), at("a", 400, "y"), at("b", 0, "x", busy=True), at("b", 300, "x"), at("c", 0, "x", complete=False)]
    schema = "page_id string, ms long, signature string, complete boolean, busy boolean"
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([at("z", 60000, "end")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    snapshots = source.withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    out = replay.run_available(replay.settle_pages(snapshots, 500, 20000, "1 second"), str(tmp_path / "out"))
    assert {(r.page_id, r.signature, r.settled_ms) for r in out.collect()} == {("a", "y", 700), ("b", "x", 800)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, 0, '{"source": {"ip": "192.0.2.%d"}}' % i) for i in range(20)]
    frame = spark.createDataFrame(rows, "incident_id long, doc_index int, raw string")
    frame.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = replay.run_available(replay.flatten_and_score(stream), str(tmp_path / "out")).collect()
    want = replay.flatten_and_score(frame).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) >= 20
