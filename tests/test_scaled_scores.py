"""Scores of all pairs, leaves dealt by incident, shapes of documents and gathering without state."""

from __future__ import annotations

import json
import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from evimap.functions.jsoncols import json_string
from evimap.operators import candidates as C
from evimap.operators import flatten, mapping
from evimap.session import spread
from evimap.streaming import replay

LONG = " ".join(["the customer", *(f"w{i}" for i in range(70)), "Incident name of the case"])


def _docs(spark):
    texts = [
        {"customer": {"name": LONG, "id": 7}, "source": {"ip": "192.0.2.1", "hostname": ""}, "attributes": [{"key": "deviceHostname", "value": "the host name"}]},
        {"event name": "the rule that raised the alert", "x": None, "y": True, "z": 'quote " and \\'},
    ]
    rows = [(i, d, json.dumps(text)) for i in range(3) for d, text in enumerate(texts)]
    return spark.createDataFrame([*rows, (9, 0, '{"cut": ')], "incident_id long, doc_index int, raw string")


def test_all_pairs_score_as_bounded_ones(spark):
    leaves = flatten.leaves(_docs(spark))
    shown = ["incident_id", "pointer", "target", "score", "start_token", "end_token", "windows"]
    every = [tuple(r) for r in C.score_lexical(leaves).select(*shown).collect()]
    bounded = {tuple(r) for r in C.score_lexical(leaves, threshold=1e-9).select(*shown).collect()}
    assert {r for r in every if r[3] > 0} == bounded and len(every) == len({r[:3] for r in every}) > len(bounded)
    assert any(r[6] > 1 and r[4] > 0 for r in every)
    eligible = C.reject_reasons(leaves).where("rejection = ''").count()
    assert eligible == len(every)


def test_one_type_of_targets(spark):
    leaves = flatten.leaves(_docs(spark))
    few = {tuple(r) for r in C.score_lexical(leaves, ["sourceIp"]).select("incident_id", "pointer", "score").collect()}
    assert few == {tuple(r) for r in C.score_lexical(leaves).where("target = 'sourceIp'").select("incident_id", "pointer", "score").collect()} and few


def test_pairs_of_dealt_leaves_are_not_shuffled(spark):
    ranked = mapping.rank_candidates(C.score_lexical(flatten.leaves(_docs(spark), together=True)))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1 and "hashpartitioning(incident_id" in plan
    plain = mapping.rank_candidates(C.score_lexical(flatten.leaves(_docs(spark))))
    key = lambda rows: sorted(tuple(r) for r in rows.select("incident_id", "target", "pointer", "rank", "score").collect())
    assert key(ranked) == key(plain)


def test_windows_of_short_texts(spark):
    texts = ["a " * n + tail for n in (0, 1, 62, 63, 64, 65, 111, 112, 113) for tail in ("", "b", "bb")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        C.text_windows(F.col("t")).alias("quick"), C.window_count(F.size(C.value_tokens(F.col("t")))).alias("split")).collect()
    assert all(r.quick == r.split for r in rows) and {r.quick for r in rows} >= {1, 2}


def test_json_strings(spark):
    texts = ["", "plain", 'q"', "back\\slash", "line\n", "\n", "tab\t", "\x01", "\x7f", "é ", "a\r"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string(F.col("t")).alias("j")).collect()
    assert all(json.loads(r.j) == r.t for r in found)


def test_document_shapes(spark):
    deep = "[" * 40 + "1" + "]" * 40
    wide = json.dumps({"a": list(range(20000)), "b": {}})
    docs = spark.createDataFrame([(1, 0, deep), (2, 0, wide), (3, 0, "7"), (4, 0, "{"), (5, 0, None)], "incident_id long, doc_index int, raw string")
    sizes = flatten.document_sizes(docs)
    assert "ArrowEvalPython" in sizes._jdf.queryExecution().executedPlan().toString()
    assert {r.incident_id: (r.broken, r.nodes, r.depth) for r in sizes.collect()} == {
        1: (False, 41, 40), 2: (False, 20003, 2), 3: (False, 1, 0), 4: (True, 0, 0), 5: (True, 0, 0)}


class _NoState:
    def exists(self):
        return False

    def updateValue(self, *_):
        raise AssertionError("state is written")

    clear = iterator = keys = updateValue


def test_whole_incidents_pass_without_state():
    gather = replay._Gather(1000)
    gather.documents, gather.until, gather.handle = _NoState(), _NoState(), None
    rows = [Row(doc_index=1, raw="b", ms=5, expected=2), Row(doc_index=0, raw="a", ms=5, expected=2), Row(doc_index=1, raw="c", ms=6, expected=2)]
    assert [tuple(r) for r in gather.handleInputRows((4,), iter(rows), None)] == [(4, 0, "a", True), (4, 1, "c", True)]


def test_streams_are_spread(spark):
    stream = spark.readStream.format("rate").load()
    assert "Repartition" in spread(stream)._jdf.queryExecution().logical().toString()


def test_targets_that_can_reach_a_bound(spark):
    labels = [["source", "ip"], ["event", "name"], ["x"], [], ["client", "user", "name", "host"], ["rule"], ["device", "hostname", "b", "c"]]
    every, none = dict.fromkeys(C.VALUE_TYPES, ""), dict.fromkeys(C.VALUE_TYPES, "no")
    rows = [Row(at=i, label=label, reason=Row(**(every | {"text": "no"} if i == 4 else every))) for i, label in enumerate(labels)]
    rows.append(Row(at=len(labels), label=["source", "ip"], reason=Row(**none)))
    frame = spark.createDataFrame(rows, "at int, label array<string>, reason struct<" + ",".join(f"{k}:string" for k in C.VALUE_TYPES) + ">")
    for targets, threshold in ((C.K.TARGET_NAMES, 0.4), (C.K.TARGET_NAMES, 0.05), (("sourceIp", "eventName"), 0.4)):
        got = {(r.at, r.t.place): r.t.name for r in frame.select("at", F.explode(C._named_places(F.col("label"), targets, threshold)).alias("t")).collect()}
        wanted = {}
        for row in rows:
            for place, (name, kind, _) in enumerate(C._catalogue(targets)):
                both, all_ = set(row.label) & set(C._words(name)), set(row.label) | set(C._words(name))
                score = len(both) / len(all_)
                if getattr(row.reason, kind) == "" and (threshold <= 0.1 or both and 0.9 * score + 0.1 >= threshold - 1e-6):
                    wanted[row.at, place] = score
        assert got == wanted and got


def test_words_are_looked_at_only_where_a_target_is_left(spark):
    leaves = flatten.leaves(_docs(spark))
    for scored in (C.score_lexical(leaves, threshold=0.4), C.score_lexical(leaves, ["sourceIp"])):
        lines = scored._jdf.queryExecution().optimizedPlan().toString().split("\n")  # the last step stands first
        unfolded = next(i for i, line in enumerate(lines) if "Generate" in line and "_places#" in line and line.rstrip().endswith("]") and "[_places#" in line)
        assert not any("p{L}" in line for line in lines[unfolded:]) and any("p{L}" in line for line in lines[:unfolded])


def test_hits_equal_scores_over_the_threshold(spark):
    docs = _docs(spark)
    for threshold in (0.05, 0.4, 0.5):
        mapped = {(r.incident_id, r.target): round(r.score, 6) for r in mapping.map_incidents(docs, threshold).where("score is not null").collect()}
        best = C.score_lexical(flatten.leaves(docs)).where(F.col("score") >= threshold).groupBy("incident_id", "target").agg(F.max("score").alias("score"))
        bounded = C.score_lexical(flatten.leaves(docs), threshold=threshold).groupBy("incident_id", "target").agg(F.max("score").alias("score"))
        wanted = {(r.incident_id, r.target): r.score for r in best.collect()}
        assert mapped == wanted == {(r.incident_id, r.target): r.score for r in bounded.collect()} and wanted
