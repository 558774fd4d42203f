"""User models behind their contracts, and streams whose results don't depend on the micro-batches."""

import pytest
from pyspark.sql import functions as F

from evimap import constants as K
from evimap.operators import candidates as C
from evimap.operators import flatten, mapping, models
from evimap.streaming import replay


def _moody():
    def load():  # a local function travels to workers by value
        def model(texts):
            if any("bad" in x for x in texts):
                raise ValueError("bad text")
            return [None if x == "none" else len(x) / 10 for x in texts]

        return model

    return load


def test_rows_in_are_rows_out_and_one_bad_text_fails_alone(spark):
    texts = ["", "a", None, "none", "bad", "ccc", "a"] * 30
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    found = {r.id: (r.answer, r.failure) for r in models.answer_with(rows, "text", "moody", _moody(), kind=float, batch_rows=4).collect()}
    want = {"": (0.0, ""), None: (0.0, ""), "a": (0.1, ""), "none": (None, "no_answer"), "bad": (None, "ValueError: bad text"), "ccc": (0.3, "")}
    assert found == {i: want[x] for i, x in enumerate(texts)}
    assert models.answer_with(rows.limit(0), "text", "moody", _moody()).collect() == []
    with pytest.raises(ValueError):
        models.answer_with(rows.withColumn("failure", F.lit("")), "text", "moody", _moody())


def test_a_model_of_too_few_answers_is_refused(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(5)], "id int, text string")
    short = models.answer_with(rows, "text", "short", lambda: lambda texts: [])
    assert {r.failure for r in short.collect()} == {"ValueError: 0 answers for 1 texts"}


def test_a_worker_opens_a_model_once():
    opened = []
    for _ in range(3):
        models.opened("once", lambda: opened.append(1) or (lambda texts: texts))
    assert opened == [1]


def test_scores_that_cannot_be_used_are_violations(spark):
    rows = [("i1", "t", "f", 0, 1, 1, "aaa"), ("i2", "t", "f", 0, 1, 1, "bad"), ("i3", "t", "f", 0, 1, 1, "a" * 20), ("i4", "t", "f", 0, 1, 1, "none")]
    windows = spark.createDataFrame(rows, "incident_id string, target string, leaf_id string, start_token int, end_token int, total_tokens int, evidence string")
    scored, violations = models.score_with(windows, "moody", _moody())
    assert {r.incident_id: r.violation for r in violations.collect()} == dict.fromkeys(("i2", "i3", "i4"), "invalid_score")
    assert scored.count() == 4


def _answers(spark, rows):
    return spark.createDataFrame(rows, "incident_id long, target string, status string, value string, failure string")


def test_a_mapper_that_breaks_a_rule_unmaps_its_incident_alone(spark):
    good = ("selected", "v", "")
    none = ("no_supported_match", None, "")
    rows = [(1, "a", *good), (1, "b", *none), (2, "a", *good), (3, "a", *good), (3, "a", *good), (3, "b", *none), (4, "a", *good), (4, "b", "sure", "v", ""),
            (5, "a", "selected", None, ""), (5, "b", *none), (6, "a", *good), (6, "b", *none), (6, "x", *none), (7, "a", "selected", "v", "timeout"), (7, "b", *none),
            (8, "a", "tentative", "v", None), (8, "b", *good), (99, "a", *good), (10, None, *good), (10, "a", *good), (10, "b", *none)]
    incidents = spark.createDataFrame([(i, f"own{i}") for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)], "incident_id long, a string")
    mapped = models.map_with(incidents, incidents, lambda docs: _answers(spark, rows), ("a", "b")).collect()
    warned = {r.incident_id: r.warning.removeprefix("Model processing incomplete: ") for r in mapped}
    assert warned == {1: "", 2: "omitted_target", 3: "duplicate_target", 4: "invalid_status", 5: "invalid_value", 6: "unknown_target", 7: "timeout",
                      8: "Tentative best guesses; review order disagreement and alias ambiguity: a.", 9: "omitted_target", 10: "unknown_target"}
    assert {(r.incident_id, r.a, r.b, r.mapped) for r in mapped if r.incident_id in (1, 2, 8)} == {(1, "v", None, True), (2, "own2", None, False), (8, "own8", "v", True)}
    with pytest.raises(ValueError, match="failure"):
        models.map_with(incidents, incidents, lambda docs: _answers(spark, rows).drop("failure"), ("a", "b"))


def test_mapped_values_are_those_of_the_leaves(spark):
    docs = spark.createDataFrame([(1, 0, '{"source": {"ip": "192.0.2.7", "user name": "a\\"\\\\b, é"}, "event": {"time": 1700000000}}')], "incident_id long, doc_index int, raw string")
    texts = {r.pointer: r.value_text for r in flatten.leaves(docs).collect()}
    found = mapping.map_incidents(docs, 0.2).where("pointer is not null").collect()
    assert found and all(r.value == texts[r.pointer] for r in found)


def test_coverage_counts_repeated_values_once(spark):
    docs = spark.createDataFrame([(1, 0, '{"a": "192.0.2.1", "b": "192.0.2.1", "c": "192.0.2.2", "d": "x"}'), (2, 0, "{}")], "incident_id long, doc_index int, raw string")
    rows = {r.target: r for r in C.coverage(flatten.leaves(docs)).where("incident_id = 1").collect()}
    row = rows["sourceIp"]
    assert (row.total_fields, row.eligible, row.distinct_values, row.rejected) == (4, 3, 2, 1) and len(rows) == len(K.TARGET_NAMES)


SNAPSHOT = "page_id string, ms long, signature string, complete boolean, busy boolean"


@pytest.mark.parametrize("cuts", [(), (2,), (1, 3, 4)])
def test_pages_settle_alike_however_their_rows_come(spark, tmp_path, cuts):
    rows = [("a", 1000, "x", True, False), ("a", 1300, "x", True, False), ("a", 1900, "y", True, False), ("b", 2000, "p", False, False), ("a", 2300, "z", True, True), ("b", 7500, "q", True, False)]
    edges = [0, *cuts, len(rows)]
    for number, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        spark.createDataFrame(rows[a:b], SNAPSHOT).coalesce(1).write.parquet(str(tmp_path / "in" / f"{number}"))
    source = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    snapshots, send_end = replay.with_end(source.withColumn("ts", F.timestamp_millis("ms")).drop("ms"), F.expr("timestamp'2100-01-01 00:00:00'"), str(tmp_path / "end"))
    out = replay.run_to_end(replay.settle_pages(snapshots, 500, 5000, "10 seconds"), str(tmp_path / "out"), send_end)
    assert {tuple(r) for r in out.collect()} == {("a", "x", True, 1500, False), ("a", "z", True, 2800, False), ("b", "p", False, 7000, True), ("b", "q", True, 8000, False)}


def test_incidents_are_gathered_over_batches_and_late_ones_come_as_they_are(spark, tmp_path):
    schema = "incident_id long, doc_index int, raw string, ms long, expected int"
    parts = [[(1, 0, "a", 0, 2), (2, 0, "b", 0, 1), (3, 0, "c", 0, 2)], [(1, 0, "a", 10, 2), (None, 0, "n", 10, 1)], [(1, 1, "d", 20, 2)], [(4, 0, "e", 10_000_000, 1)]]
    for number, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{number}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    gathered = replay.gather_incidents(source.withColumn("ts", F.timestamp_millis(F.col("ms") + 1000)).drop("ms"), 60_000, "10 seconds")
    out = replay.run_available(gathered, str(tmp_path / "out")).collect()
    assert {tuple(r) for r in out} == {(1, 0, "a", True), (1, 1, "d", True), (2, 0, "b", True), (3, 0, "c", False), (4, 0, "e", True)}
