"""Ratings that the walk gives leaves, and incidents decided where they pass, against the expressions of the JVM."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evimap.functions.ratings import _rounded
from evimap.operators import candidates as C
from evimap.operators import flatten, mapping

LONG = " ".join(["the customer", *(f"w{i}" for i in range(70)), "Incident name of the case", *("x" * 60), "closure notes"])


def _docs(spark):
    texts = [
        {"customer": {"name": LONG, "id": 7.50, "12\n": {"name": "Ärger der Name ½ Σ"}}, "source": {"ip": "192.0.2.1", "hostname": ""}, "attributes": [{"key": "deviceHostname", "value": "the host name"}]},
        {"event name": "the rule that raised the alert", "x": None, "y": True, "source~ip/": {"0": ["192.0.2.9", "::1"]}, "SourceIp": "192.0.2.1", "z": 'quote " and \\', "time": 1704067200},
        {"source": {"ip": "192.0.2.1"}, "sourceIp": "192.0.2.1", "event": {"Name": "event name of the display", "name": "event name"}, "n": 1e300, "clientHostname": 9.0},
    ]
    rows = [(i if i < 3 else None, d, json.dumps(text)) for i in range(4) for d, text in enumerate(texts)]
    return spark.createDataFrame([*rows, (9, 0, '{"cut": '), (8, 0, "7"), (2, 1, rows[2][2])], "incident_id long, doc_index int, raw string")


def _rows(df, *shown):
    return sorted(map(str, df.select(*shown).collect()))


@pytest.mark.parametrize("targets", [C.K.TARGET_NAMES, ("sourceIp", "eventName", "deviceHostname")])
def test_ratings_equal_scores(spark, targets):
    docs, shown = _docs(spark), ("incident_id", "doc_index", "pointer", "target", "score", "start_token", "end_token", "windows", "identity")
    plain = C.score_lexical(flatten.leaves(docs), targets)
    rated = C.score_lexical(flatten.leaves(docs, extra=C.Rating(targets)), targets)
    assert _rows(rated, *shown) == _rows(plain, *shown) and rated.where("windows > 1 and start_token > 0").count()
    # no list is gone through by a lambda, and the leaves of a threshold are the same
    assert "lambda" not in rated.select("pointer", "target", "score")._jdf.queryExecution().optimizedPlan().toString()
    for threshold in (0.11, 0.4, 0.5):
        few = C.score_lexical(flatten.leaves(docs, extra=C.Rating(targets, threshold)), targets, threshold)
        assert _rows(few, *shown) == _rows(plain.where(F.col("score") >= threshold), *shown) and few.count()


def test_scores_are_rounded_as_in_the_jvm(spark):
    raw = [0.9 * (a / b) + 0.1 * (c / d) for b in range(1, 30) for a in range(b + 1) for d in (1, 2, 3, 7, 16, 31, 64) for c in range(min(d, 8) + 1)]
    found = spark.createDataFrame([(x,) for x in raw], "x double").select("x", F.round("x", 6).alias("y")).collect()
    assert all(_rounded(r.x) == r.y for r in found)


def test_incidents_decided_where_they_pass(spark):
    docs = _docs(spark)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for threshold, rows in ((0.11, "3"), (0.4, "10000"), (0.5, "1")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            mapped = mapping.map_incidents(docs, threshold)
            got = _rows(mapped, *mapped.columns)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        wanted = mapping._map_by_rows(docs, threshold, C.K.TARGET_NAMES)
        assert mapped.columns == wanted.columns and got == _rows(wanted, *wanted.columns)
        assert {r.status for r in wanted.collect()} == {"selected", "tentative", "no_supported_match"} or threshold == 0.5
    assert "ObjectHashAggregate" not in mapped._jdf.queryExecution().executedPlan().toString()


def test_leaves_grouped_before_they_are_unfolded(spark):
    docs, chooser = _docs(spark), mapping.best_above(0.4)
    pairs, rated = C.score_lexical(flatten.leaves(docs)), C.score_leaves(flatten.leaves(docs, True, extra=C.Rating()))
    for of in (mapping.value_groups, lambda x: mapping.representatives(x, chooser)):
        wanted, got = of(pairs), of(rated)
        assert wanted.columns == got.columns and _rows(got, *wanted.columns) == _rows(wanted, *wanted.columns)
    found = {(r.members > 1, r.endorsed, r.contested) for r in mapping.representatives(rated, chooser).collect()}
    assert found >= {(False, True, False), (True, False, False), (True, True, True)}


def test_only_contenders_are_folded(spark):
    docs, chooser = _docs(spark), mapping.best_above(0.4)
    rows = [(1, "sourceIp", f"f{i:02}", f"/p{i:02}", f"v{i % 5}", (i * 7 % 20) / 20 if i % 9 else 0.95) for i in range(40)]
    many = spark.createDataFrame(rows, "incident_id long, target string, leaf_id string, pointer string, identity string, score double")
    for scored in (C.score_lexical(flatten.leaves(docs)), many, many.where("score < 0.4")):
        for group_values in (True, False):
            wanted = mapping.select_candidates(scored, lambda shown: chooser(shown), group_values).where("pointer is not null")
            got = mapping.select_candidates(scored, chooser, group_values, supported=True)
            assert wanted.columns == got.columns and _rows(got, *wanted.columns) == _rows(wanted, *wanted.columns)
    lists = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 15, 16, 17, 31, 40)], "ids array<int>")
    ordered = F.transform("ids", lambda i: F.struct(i.cast("string").alias("leaf_id"), i.cast("string").alias("pointer"), F.lit("v").alias("identity"), (i % 7 / F.lit(10.0)).alias("score"),
                                                    F.lit(None).cast("string").alias("group_id"), F.lit(True).alias("endorsed"), F.lit(False).alias("contested")).cast(mapping.CANDIDATE))
    both = lists.select(mapping.sweep(ordered, chooser).alias("a"), mapping._fold(ordered, chooser, C.K.BUCKET).alias("b")).collect()
    assert all(r.a == r.b for r in both) and sum(r.a is not None for r in both) == 5


def test_least_group(spark):
    ids = ["g" + hex_ for hex_ in ("0" * 20, "f" * 20, "00000000ff0000000001", "00000000ff0000000000", "a" * 10 + "0" * 10, "a" * 10 + "0" * 9 + "1", "9" * 20)]
    rows = spark.createDataFrame([(i % n, x) for n in (1, 2, 3, 7) for i, x in enumerate(ids)] + [(90 + i, x) for i, x in enumerate(ids)], "k int, group_id string")
    found = rows.groupBy("k").agg(mapping.least_group().alias("a"), F.min("group_id").alias("b"))
    assert all(r.a == r.b for r in found.collect())
    plan = rows.groupBy("k").agg(mapping.least_group().alias("a"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_paths_of_the_walk_and_longest_aliases(spark):
    from evimap.functions.text import normalize_json_path
    from evimap.operators import extraction

    text = {"Source IP": "a", "x": {"Client~Host": {"Host/name": "b", "hostname": "c"}, "[12]": {"Device [3] DNS Name": "d", "4": "e"}}, "İd Kind": "f", "a\n.b": [["g", {"Type": "h"}]], "Case Type": "i",
            "Description": {"Description": "j", "Description Long": "k"}, " ": "l", "É": {"7": "m"}}
    docs = spark.createDataFrame([(1, 0, json.dumps(text)), (1, 2, json.dumps(text)), (2, 0, '"Type"')], "incident_id long, doc_index int, raw string")
    pairs = flatten.json_pairs(docs)
    leaves = flatten.leaves(docs)
    names = normalize_json_path(F.array_join(F.concat(F.slice("ancestry", 3, F.size("ancestry")), F.array("key")), "."))
    wanted = leaves.where(F.size("ancestry") > 1).select("pointer", names.alias("path")).where("path <> ''").distinct()
    assert _rows(pairs.select("pointer", "path").distinct(), "pointer", "path") == _rows(wanted, "pointer", "path") and pairs.count() > 20
    assert "ancestry" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    labels = (("one", ("Type", "Hostname")), ("two", ("Case Type", "Host Hostname", "Client Host Hostname")), ("three", ("Type",)))
    best: dict = {}
    for row in pairs.collect():
        parts = row.path.split(".")
        for field, aliases in labels:
            for rank, alias in enumerate(aliases):
                path = ".".join(alias.lower().split())
                if path in (".".join(parts[i:]) for i in range(len(parts))):
                    key = (rank, row.path != path, row.doc_index, row.ordinal, row.value)
                    best[row.incident_id, field] = min(best.get((row.incident_id, field), key), key)
    found = extraction.resolve_aliases(pairs, labels)
    assert {(r.incident_id, r.field): r.value for r in found.collect()} == {k: v[-1] for k, v in best.items()} and len(best) == 3
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
