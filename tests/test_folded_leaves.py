"""Leaves that no target tells apart are folded before their pairs are formed; results are those of all pairs."""

import json

from pyspark.sql import functions as F

from evimap.operators import candidates as C
from evimap.operators import flatten
from evimap.operators import history as H
from evimap.plans import QUERIES


def _docs(spark):
    values = ["192.0.2.7", "2001:db8::1", "999.1.1.1", "https://a.example/x", "HTTP://b", "2024-01-02T03:04:05Z", "2024-13-02 03:04:05", "1704164645", 1704164645, 1e30, 12.50,
              "", "  ", "　", " host-1 ", "fe", "f:", True, None, "word " * 200, "1", 1, 1.0]
    rows = [(i % 3 if i else None, i, json.dumps({"a": values[i:], "b": {"c": values[i % 7], "v": [values[-i], values[-i]]}})) for i in range(12)]
    return spark.createDataFrame([*rows, (1, 90, "{"), (7, 0, "{}")], "incident_id long, doc_index int, raw string")


def test_folded_pairs_count_all_pairs(spark):
    docs = _docs(spark)
    pairs = C.reject_reasons(flatten.leaves(docs)).cache()
    for key in ("pointer", "incident_id"):
        folded = C.alike(flatten.leaves(docs, named=("pointer",)), key)
        assert folded.groupBy(key).count().where("count > 33").isEmpty()
        got = C.reject_reasons(folded).groupBy(key, "target", "rejection").agg(F.sum("leaves").alias("n"))
        want = pairs.groupBy(key, "target", "rejection").agg(F.count(F.lit(1)).alias("n"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert pairs.count() == 23 * flatten.leaves(docs).count()


def test_coverage_counts_as_all_pairs_do(spark):
    docs = _docs(spark)
    tested = C.with_reasons(flatten.leaves(docs))
    windows = tested.withColumn("windows", C.window_count(F.size(C.value_tokens(F.coalesce("value_text", F.lit(""))))))
    fit = F.col("rejection") == ""
    want = C.reject_reasons(windows).groupBy("incident_id", "target").agg(
        F.count(F.lit(1)).alias("total_fields"), F.count_if(fit).alias("eligible"), F.count_distinct(F.when(fit, F.col("identity"))).alias("distinct_values"),
        F.count_if(~fit).alias("rejected"), F.coalesce(F.sum(F.when(fit, F.col("windows"))), F.lit(0)).alias("windows_evaluated"))
    for rows in (flatten.leaves(docs, named=()), tested):
        got = C.coverage(rows).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_pairs_of_the_queries_are_formed_after_folding(spark, tmp_path):
    import datetime

    events = [(i, datetime.datetime(2024, 1, 1), i % 5, "click", 1.5, "{}") for i in range(40)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("reject_reasons", "leaf_target_cross"):
        frame = QUERIES[name](spark, str(tmp_path))
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate [") < plan.index("posexplode(") < plan.rindex("Aggregate [")


def test_response_texts_are_cleaned_once(spark):
    names = [n for n in H.RESPONSE_TEXTS if n not in ("event_summary",)]
    rows = [("1", *("  N/A ", "a  b", "undefined", "x\n\ny", None)[i % 5:], *("t%d " % i for i in range(len(names)))) for i in range(1)]
    incidents = spark.createDataFrame([(f" {i}", *((["N/A", "a  b ", "undefined", " x \n y", None, "n/a,na", "-"] * 4)[i:])[: len(names) - 1]) for i in range(7)], ", ".join(f"{n} string" for n in names))
    lines = spark.createDataFrame([("1", "1. #2: x")], "ticket_id string, historic string")
    frame = H.render_response(incidents, lines)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == len(names)
    drafts = {r.ticket_id: r.draft for r in frame.collect()}
    assert len(drafts) == 7 and "Incident ID: 1\n" in drafts[" 1"]
    assert "\nIncident: n/a\nAffected entity: a b\n" in drafts[" 0"] and "\nIncident: n/a,na\n" in drafts[" 5"]
