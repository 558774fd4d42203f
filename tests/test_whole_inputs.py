"""Nothing of a document or page is lost because it is deep or wide."""

import time
import json

from pyspark.sql import functions as F

from evimap.functions.text import bounded_text
from evimap.operators import extraction, flatten, history, mapping


def docs_of(spark, *values):
    return spark.createDataFrame([(i, 0, json.dumps(v)) for i, v in enumerate(values)], "incident_id long, doc_index int, raw string")


def nested(levels, leaf):
    for _ in range(levels):
        leaf = {"x": leaf}
    return leaf


def test_deep_documents_keep_every_leaf_and_path(spark):
    docs = docs_of(spark, {"a": 1, "deep": nested(60, {"source": {"ip": "192.0.2.7"}})})
    assert {(r.depth, r.value_text) for r in flatten.leaves(docs).collect()} == {(1, "1"), (63, "192.0.2.7")}
    assert {r.path for r in flatten.sanitize_json(docs).collect()} == {"a", "deep." + "x." * 60 + "source.ip"}
    found = {r.target: r.status for r in mapping.map_incidents(docs, threshold=0.3).collect()}
    assert found["sourceIp"] == "selected"


def test_wide_documents_keep_every_pair(spark):
    docs = docs_of(spark, {f"k{chr(97 + i % 26)}x{i}": "v" for i in range(12000)}, {"list": [f"v{i}" for i in range(150)]})
    counts = {r.incident_id: r["count"] for r in flatten.json_pairs(docs).groupBy("incident_id").count().collect()}
    assert counts == {0: 12000, 1: 150}
    limited = flatten.json_pairs(docs, max_keys=200, max_items=100).groupBy("incident_id").count().collect()
    assert {r.incident_id: r["count"] for r in limited} == {0: 200, 1: 100}


def test_event_rows_append_to_a_first_list_and_skip_headers(spark):
    rows = [
        (1, "json events", 0, []), (1, "json events", 1, ["k", '["a", "b"]']), (1, "json events", 2, ["k", "x"]), (1, "json events", 3, ["k", '["c"]']),
        (1, "source events", 1, ["e", "[]"]), (1, "source events", 2, ["e", "y"]), (1, "source events", 3, ["s", "p"]), (1, "source events", 4, ["s", "q"]),
        (1, "source events", 5, ["o", "[1]"]),
        *[(2, "json events", i, [f"n{i}", "v"]) for i in range(1500)], (2, "source events", 0, ["k", "v"]),
    ]
    frame = spark.createDataFrame(rows, "page_id int, section string, ord int, cells array<string>")
    got = {(r.page_id, r.section): r for r in extraction.event_documents(frame).collect()}
    assert json.loads(got[1, "json events"].document) == {"k": ["a", "b", "x", ["c"]]}
    assert json.loads(got[1, "source events"].document) == {"e": ["y"], "s": ["p", "q"], "o": [1]}
    assert len(json.loads(got[2, "json events"].document)) == 1500 and all(r.complete for r in got.values())
    cut = {(r.page_id, r.section): r for r in extraction.event_documents(frame, max_rows=1000).collect()}
    assert len(json.loads(cut[2, "json events"].document)) == 1000 and not cut[2, "json events"].complete


def test_pages_may_nest_deep_and_leave_cells_open(spark):
    deep = "<div>" * 3000 + "<h1>far down</h1>" + "</div>" * 3000
    open_cells = "<table><tr><td>Name<td>A<tr><td>Host<td>B</table>"
    pages = spark.createDataFrame([(1, deep), (2, open_cells), (3, None)], "page_id int, html string")
    got = {(r.page_id, r.source, r.label, r.value) for r in extraction.label_pairs(pages).collect()}
    assert got == {(1, "h1", "", "far down"), (2, "row", "Name", "A"), (2, "row", "Host", "B")}


def test_limits_are_off_unless_given(spark):
    docs = spark.createDataFrame([(1, i, f"{i} " + "x" * 1000) for i in range(130)] + [(1, 130, "y" * 200000), (1, 131, "y" * 200000)], "incident_id int, ord int, raw string")
    got = extraction.budget_documents(docs).collect()
    assert sorted(r.ord for r in got) == list(range(131)) and all(r.complete for r in got)
    assert extraction.budget_documents(docs, max_candidates=100).count() == 100
    raw = json.dumps({f"k{i:02d}": "v" * 300 for i in range(12)})
    leaf = flatten.sibling_context(flatten.leaves(spark.createDataFrame([(1, 0, raw)], "incident_id int, doc_index int, raw string"))).first()
    assert len(leaf.context) == 11 and {len(s.value) for s in leaf.context} == {300} and (leaf.omitted_siblings, leaf.shortened_siblings) == (0, 0)
    grid = spark.createDataFrame([(1, i, ["id"], [str(i)], ["https://p.example.com/1"]) for i in range(30)], "search_id int, ord int, headers array<string>, cells array<string>, links array<string>")
    assert extraction.result_rows(grid, "https://p.example.com").where("not truncated").count() == 30
    incidents = spark.createDataFrame([(1, "t" * 900, True)], "incident_id int, note string, documents_complete boolean")
    many = docs.select("incident_id", F.col("ord").alias("doc_index"), F.to_json(F.struct("raw")).alias("raw"))
    row = extraction.evidence(incidents, many, {"note": "note"}).first()
    assert row.reason == "" and len(row.current["note"]) == 900 and len(row.documents) == 132
    facts = spark.range(1).select(history.distinct_facts(F.array(*(F.lit(f"fact {i}") for i in range(15)))).alias("f")).first().f
    assert len(facts) == 15
    assert extraction.result_rows(grid, "https://p.example.com", 5).where("truncated").count() == 5
    assert len(spark.range(1).select(bounded_text(F.lit("z" * 900)).alias("t")).first().t) == 900
    rows = [(str(i), i, "t", "n", "r" if i % 2 else "", None, None, i) for i in range(60)]
    past = spark.createDataFrame(rows, "ticket_id string, order_key long, tenant_name string, incident_name string, historical_recommendations string, close_notes string, incident_outcome string, created long")
    matches = history.historic_matches(past).collect()
    want = {(t, n + 1, h) for t in map(str, range(60)) for n, h in enumerate(str(i) for i in range(59, 0, -2) if str(i) != t)}
    assert {(r.ticket_id, r.rank, r.historic_id) for r in matches} == want and len(matches) == len(want)
    assert history.historic_matches(past, 25).where("rank > 25").isEmpty()


def test_walk_of_a_wide_document(spark):
    """Steps follow the levels of a text, not its brackets."""
    from evimap.operators import flatten

    raw = json.dumps([{"a": i, "b": "x]["} for i in range(100_000)])
    began = time.time()
    found = flatten.leaves(spark.createDataFrame([(1, 0, raw)], "incident_id long, doc_index int, raw string"))
    assert found.where("vtype = 'string'").count() == 100_000 and time.time() - began < 60


def test_walk_depth_ignores_strings(spark):
    from evimap.functions.jsoncols import depth_text

    cases = {'{"a": "[[[", "b": [1, {"c": "\\\\"}]}': 3, '["\\\\", "]]]\\"[[["]': 1, "3": 0, '"{["': 0, "[" * 70 + "]" * 70: 70}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").selectExpr("raw", f"{depth_text('raw')} as depth").collect()
    assert {r.raw: r.depth for r in rows} == cases


def test_pairs_follow_the_text(spark):
    """Keys in the order of the text, array indexes first; one walk in the plan."""
    from evimap.operators import extraction, flatten

    raw = '{"zeta":{"hostname":"first"},"alpha":{"hostname":"second"},"10":{"k":"b"},"9":{"k":"a"},"l":[{"y":"1","x":["2",{"w":"3"}]}]}'
    docs = spark.createDataFrame([(1, 0, raw)], "incident_id long, doc_index int, raw string")
    pairs = flatten.json_pairs(docs)
    assert [r.value for r in pairs.orderBy("ordinal").collect()] == ["a", "b", "first", "second", "1", "2", "3"]
    assert {(r.field, r.value) for r in extraction.resolve_aliases(pairs).collect()} == {("deviceHostname", "first")}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 2 * plan.count("inline(") and plan.count("inline(") == 1
    assert [r.value for r in flatten.json_pairs(docs, max_nodes=5).orderBy("ordinal").collect()] == ["a", "b"]
