"""The walk and the number printer by Arrow batches give what the expressions of the JVM give, and stand once in a plan."""

import json
import random

from pyspark.sql import functions as F

from evimap.functions import jsoncols as J
from evimap.operators import flatten

HARD = [
    '{"a~b": {"c/d": [1, 2.50, -0.0, 1e400, 12345678901234567890123, 1e-7]}, "": {"": ""}, "key": 5, "value": "x"}',
    '{"attributes": [{"key": "host", "value": "dev"}, {"value": 7, "key": "n"}], "box": {}, "list": [], "none": null, "on": true, "off": false}',
    '  ["\\ud800", "\\ud83d\\ude00", "\\u0000", "tab\\t\\"q\\"", [[[]]], {"10": 1, "9": 2, "b": 3}]\n',
    '{"a": 1, "a": 2}', '{"a": NaN}', '[1, 2', "", "7", '"alone"', "null", "[" * 300 + '"deep"' + "]" * 300, None,
]


def _docs(spark, texts):
    return spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "incident_id long, doc_index int, raw string")


def test_walk_equals_the_expression(spark):
    docs = _docs(spark, HARD)
    parsed = docs.select("incident_id", "doc_index", "raw", F.try_parse_json("raw").alias("doc"))
    plain = parsed.select("incident_id", "doc_index", F.inline(J.walk("raw", "doc", "doc_index")))
    names = ["incident_id", "doc_index", "pointer", "ancestry", "key", "position", "role", "children", "container"]
    value = F.to_json("value").alias("value")
    rows = lambda df: sorted(map(str, df.select(*names, value).collect()))
    assert rows(flatten.nodes(docs)) == rows(plain)
    typed = flatten._typed(plain.where("container is null")).select("incident_id", "pointer", "vtype", "value_text", "value_num")
    found = flatten.leaves(docs).select("incident_id", "pointer", "vtype", "value_text", "value_num")
    assert sorted(map(str, found.collect())) == sorted(map(str, typed.collect()))


def test_printed_numbers_equal_the_expression(spark):
    rng = random.Random(4)
    numbers = [f"{rng.choice(['', '-'])}{rng.randint(0, 10 ** rng.randint(1, 22))}{rng.choice(['', '.0', '.125', '.' + str(rng.random())[2:]])}{rng.choice(['', 'e5', 'E-9', 'e21', 'e-300'])}" for _ in range(300)]
    texts = [*HARD, *(json.dumps({"n": "1.50e3"})[:-1] + f', "m": [{n}, "-0"]}}' for n in numbers), '{"a": "Infinity", "b": 1e999}', "1e999", '["x", -1e999]']
    for python in (False, True):
        rows = _docs(spark, texts).select("raw", J.canonical_json(F.col("raw"), python).alias("a"), J.nested_canonical_json(F.col("raw"), python).alias("b")).collect()
        assert [r for r in rows if r.a != r.b] == []


def test_documents_are_walked_and_printed_outside_interpreted_lambdas(spark):
    docs = _docs(spark, HARD)
    for frame in (flatten.leaves(docs), flatten.nodes(docs), flatten.json_pairs(docs)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan and plan.count("ArrowEvalPython") == 1
    printed = docs.select(J.canonical_json(F.col("raw")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in printed and printed.count("parseJson") == 1


def test_redacted_documents_equal_the_expression(spark):
    texts = [
        *HARD, '{"10": 1, "b": {"9": [], "01": 2, "4294967295": 3, "٣": 4, "2": {"pass-word": 1}}, "API_KEY": [1, {"x": 2}], "\\u212aey": 0, "toKen": null, "a\\"\\u001f\\n": "\\u007f\\u2028\\b\\u0000"}',
        '[[], [[1, [2.50, []], "a"], {}], {"secret": [[1]], "s": [[], [{"cookie": 1, "n": 1E-7}]]}, false]', "1e400", "[-0.0, 1e3, 123456789012345678, 0.00001]",
    ]
    docs = _docs(spark, texts)
    walked = F.filter(J.walk("raw", "doc", "doc_index", paths=True), lambda n: ~flatten.sensitive_ancestry(n["ancestry"], n["key"]))
    in_order = F.array_sort(walked, lambda a, b: F.when(a["ordinal"] < b["ordinal"], -1).when(a["ordinal"] > b["ordinal"], 1).otherwise(0))
    parsed = docs.withColumn("doc", F.try_parse_json("raw"))
    want = {r.incident_id: r.raw for r in parsed.select("incident_id", F.when(F.col("doc").isNotNull(), J.rebuilt(in_order)).alias("raw")).collect()}
    frame = flatten.without_sensitive(docs)
    got = {r.incident_id: r.raw for r in frame.collect()}
    assert [(got[k], want[k]) for k in want if got[k] != want[k]] == [] and len(got) == len(texts)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("ArrowEvalPython") == 1
