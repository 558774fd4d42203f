"""Small golden and brute-force cases for the rules."""

import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from evimap import constants as K
from evimap.functions import eligibility as E
from evimap.functions import text as X
from evimap.functions import times as T
from evimap.functions import urls as U
from evimap.operators import candidates as C
from evimap.operators import contest, curation, extraction, flatten, history, mapping, sets


def docs(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "incident_id long, doc_index int, raw string")


def test_clean_text_and_placeholders(spark):
    values = ["  a   b\t c \n\n  d  ", " N/A ", "na", "-", "none", "Null", "undefined", "nano", None, ""]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select(
        "i", X.clean_text(F.col("v")).alias("c"), X.is_available(F.col("v")).alias("a")).orderBy("i").collect()
    assert rows[0].c == "a b c\nd"
    assert [r.a for r in rows] == [True, False, False, False, False, False, False, True, False, False]


def test_query_template_is_not_expanded_twice(spark):
    row = spark.range(1).select(*(c.alias(n) for n, c in zip("qe", X.render_query(F.lit('x {tenantName} "q" \\'), F.lit("T"))))).first()
    assert row.q == 'name:"x {tenantName} \\"q\\" \\\\" and tenantname:"T"' and row.e is None
    row = spark.range(1).select(*(c.alias(n) for n, c in zip("qe", X.render_query(F.lit("x" * 2100), F.lit("T"))))).first()
    assert row.q is None and row.e == "invalid_query"


def test_addresses_agree_with_python(spark):
    random.seed(3)
    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
             "::ffff:1.2.3.4", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", ":1", "1:", "::1.2.3.4", "1::1.2.3.4", "1:2:3:4:5::1.2.3.4"]
    for _ in range(300):
        groups = ["%x" % random.randrange(70000) for _ in range(random.randrange(1, 9))]
        text = ":".join(groups)
        texts += [text, text.replace(":", "::", 1)]

    def valid(t):
        try:
            ipaddress.ip_address(t)
            return True
        except ValueError:
            return False

    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", E.eligible_ip(F.col("t")).alias("ok")).collect()
    assert [(r.t, r.ok) for r in found if r.ok != valid(r.t)] == []


def test_times(spark):
    cases = {
        "2024-02-29T00:00:00Z": 1709164800000000, "2023-02-29T00:00:00Z": None, "2024-01-01 24:00:00": None, "2024-01-01 23:59:60": None,
        "2024-01-01T10:00:00.123456789+02:30": 1704094200123456, "2024-01-01": None, "2024-01-01T00:00:00": 1704067200000000,
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, want long").select("t", "want", T.iso_micros(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in rows if r.got != r.want] == []
    units = spark.createDataFrame([(1.7e9,), (1.7e12,), (1.7e15,), (1.7e18,)], "x double").select(T.epoch_micros(F.col("x")).alias("m")).collect()
    assert {r.m for r in units} == {1700000000000000}


def test_flatten_pointers_types_and_limits(spark):
    text = '{"a/b": {"c~d": [1, 1.0, "x", null, true, {}, []]}, "z": {"key": "role", "value": 5}}'
    rows = {r.pointer: (r.vtype, r.value_text, r.role) for r in flatten.leaves(docs(spark, text)).collect()}
    assert rows == {
        "/documents/0/a~1b/c~0d/0": ("number", "1", None), "/documents/0/a~1b/c~0d/1": ("number", "1", None), "/documents/0/a~1b/c~0d/2": ("string", "x", None),
        "/documents/0/a~1b/c~0d/3": ("null", None, None), "/documents/0/a~1b/c~0d/4": ("boolean", "true", None),
        "/documents/0/z/key": ("string", "role", None), "/documents/0/z/value": ("number", "5", "role"),
    }
    deep = "[" * 40 + "1" + "]" * 40
    wide = json.dumps(list(range(10001)))
    big = json.dumps("x" * (96 * 1024))
    found = {r.incident_id: r.violation for r in flatten.complexity(docs(spark, text, deep, wide, big, "{", '{"a":1,"a":2}')).collect()}
    assert found == {0: "", 1: "too_complex", 2: "too_complex", 3: "too_large", 4: "unparseable_document", 5: "unparseable_document"}


def test_object_order_does_not_matter(spark):
    a = '{"source": {"ip": "192.0.2.1", "hostname": "h"}, "client": {"ip": "192.0.2.1"}}'
    b = '{"client": {"ip": "192.0.2.1"}, "source": {"hostname": "h", "ip": "192.0.2.1"}}'
    rows = mapping.map_incidents(docs(spark, a, b), 0.4).collect()
    first = {r.target: (r.status, r.pointer, r.score) for r in rows if r.incident_id == 0}
    assert first == {r.target: (r.status, r.pointer, r.score) for r in rows if r.incident_id == 1}
    assert first["sourceIp"] == ("selected", "/documents/0/source/ip", 0.9)
    assert len(first) == 23 and first["occurred"][0] == "no_supported_match"


def _pool(spark, count, seed):
    random.seed(seed)
    rows = [(1, "t", f"f{i}", f"/p{random.randrange(10**6):06d}", f"v{random.randrange(max(2, count // 2))}", random.randrange(6) / 5) for i in range(count)]
    return spark.createDataFrame(rows, "incident_id long, target string, leaf_id string, pointer string, identity string, score double"), rows


@pytest.mark.parametrize("count,seed", [(1, 1), (2, 2), (15, 3), (16, 4), (17, 5), (47, 6), (80, 7)])
def test_fold_fast_path_and_plugged_chooser_agree(spark, count, seed):
    pool, rows = _pool(spark, count, seed)
    slow = mapping.select_candidates(pool, mapping.best_above(0.5)).first()
    fast = mapping.select_best(pool, 0.5).first()
    if fast is None:
        assert slow.pointer is None and slow.status == "no_supported_match"
    else:
        assert (slow.pointer, slow.status, slow.value_agreement, slow.pointer_agreement) == (
            fast.pointer, fast.status, fast.value_agreement, fast.pointer_agreement)

    def chooser(_, shown):
        looked = shown[:5]
        best = max(looked, key=lambda c: c["score"])
        return contest.Choice(best["leaf_id"] if best["score"] >= 0.5 else None, len(looked))

    for group_values in (True, False):
        column = mapping.select_candidates(pool, mapping.best_above(0.5), group_values).first()
        picked, met = contest.select_with(pool, chooser, group_values)
        row = picked.first()
        assert [row[c] for c in ("pointer", "status", "forward", "reverse", "value_agreement", "pointer_agreement", "failure")] == [
            *(column[c] for c in ("pointer", "status", "forward", "reverse", "value_agreement", "pointer_agreement")), ""]
    seen = {c for r in met.where("pass = 'forward'").collect() for c in r.candidates}
    assert seen == {f"f{i}" for i in range(count)} and all(len(r.candidates) <= 5 for r in met.where("pass <> 'adjudication'").collect())


def test_contest_streams_groups_larger_than_a_batch(spark):
    """A chooser that depends on order: the last shown but one wins; compared with a plain loop over all candidates."""
    rows = [(g, "t", f"f{g}_{i:05d}", f"/p{i:05d}", f"v{i}", 1 - (i % 1000) / 1000) for g, n in ((1, 30_000), (2, 17), (3, 1)) for i in range(n)]
    pool = spark.createDataFrame(rows, "incident_id long, target string, leaf_id string, pointer string, identity string, score double")

    def chooser(_, shown):
        return contest.Choice(shown[max(0, len(shown) - 2)]["leaf_id"] if len(shown) % 7 else None)

    met = contest.one_pass(pool, ["incident_id", "target"], chooser, "forward").collect()
    for g in (1, 2, 3):
        ordered = [r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[5], r[3]))]
        winner, at, steps = None, 0, []
        while at < len(ordered):
            shown = ([winner] if winner else []) + ordered[at : at + 16 - bool(winner)]
            at += len(shown) - bool(winner)
            winner = shown[max(0, len(shown) - 2)] if len(shown) % 7 else None
            steps.append((shown, winner or K.NONE))
        mine = sorted((r for r in met if r.incident_id == g), key=lambda r: r.step)
        assert [(r.candidates, r.choice) for r in mine if not r.last] == steps and (mine[-1].winner.leaf_id if mine[-1].winner else None) == winner


@pytest.mark.parametrize(("answer", "failure"), [
    (lambda shown: contest.Choice("?"), "unknown_choice"), (lambda shown: contest.Choice(shown[0]["leaf_id"], 0), "no_progress"),
    (lambda shown: contest.Choice(shown[0]["leaf_id"], 1), "no_progress"), (lambda shown: contest.Choice(None, None, {K.NONE: 1.0}), "invalid_distribution"),
    (lambda shown: contest.Choice(None, None, {K.NONE: 0.1} | {c["leaf_id"]: 0.9 / len(shown) for c in shown}), "choice_not_maximal"),
    (lambda shown: 1 / 0, "chooser_failed: division by zero"),
])
def test_a_bad_chooser_fails_its_group_only(spark, answer, failure):
    pool, _ = _pool(spark, 5, 3)
    both = pool.union(pool.withColumn("target", F.lit("good")))
    picked, _ = contest.select_with(both, lambda target, shown: contest.Choice(shown[0]["leaf_id"]) if target == "good" else answer(shown))
    rows = {r.target: r for r in picked.collect()}
    assert (rows["t"].status, rows["t"].pointer, rows["t"].failure) == ("incomplete", None, failure)
    assert rows["good"].status in ("selected", "tentative") and rows["good"].failure == ""


def test_a_bucket_without_a_winner_clears_the_carried_one(spark):
    pool, _ = _pool(spark, 40, 8)
    plain = pool.withColumn("group_id", F.lit(None).cast("string")).withColumn("endorsed", F.lit(True)).withColumn("contested", F.lit(False))
    picky = lambda shown: F.when(F.size(shown) == 16, F.get(shown, F.lit(15)))
    row = plain.groupBy("target").agg(mapping._ordered().alias("pool")).select(mapping.sweep(F.col("pool"), picky).alias("w")).first()
    assert row.w is None  # 16, then 15 with the winner, then 9 with the winner: ten are shown, none chosen


def test_windows_cover_every_token(spark):
    rows = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 64, 65, 112, 113, 500)], "n int, t string")
    found = {}
    for r in C.value_windows(rows, "t").collect():
        found.setdefault(r.n, []).append((r.start_token, r.end_token))
    for n, windows in found.items():
        windows.sort()
        assert windows[0][0] == 0 and windows[-1][1] == n
        assert all(b[0] == a[0] + 48 and b[0] < a[1] for a, b in zip(windows, windows[1:]))


def test_top_k_with_a_hot_key_and_itself_excluded(spark):
    rows = [(str(i), i, "hot" if i % 3 else f"t{i % 7}", "n", "r" if i % 2 else "", None, None) for i in range(600)]
    incidents = spark.createDataFrame(rows, "ticket_id string, order_key long, tenant_name string, incident_name string, historical_recommendations string, close_notes string, incident_outcome string").withColumn(
        "created", F.col("order_key"))
    got = {}
    for r in history.topk_resolutions(incidents, 3).collect():
        got.setdefault(r.ticket_id, []).append((r.rank, r.historic_id))
    for ticket, _, tenant, *_ in rows:
        want = [x[0] for x in sorted(rows, key=lambda x: -x[1]) if x[2] == tenant and x[4] and x[0] != ticket][:3]
        assert [h for _, h in sorted(got.get(ticket, []))] == want


def test_search_cap_counts_before_the_resolved_filter(spark):
    rows = [(str(i), i, "t", "n", "" if i > 5 else "r", None, None) for i in range(10)]
    incidents = spark.createDataFrame(rows, "ticket_id string, order_key long, tenant_name string, incident_name string, historical_recommendations string, close_notes string, incident_outcome string").withColumn(
        "created", F.col("order_key"))
    assert history.topk_resolutions(incidents, 3, search_cap=4).count() == 0
    assert history.topk_resolutions(incidents, 3, search_cap=5).where("ticket_id = '9'").first().historic_id == "5"


def test_labels_and_rows_of_a_page(spark):
    html = """<div class="fieldId-sourceip field-wrapper"><label title="Source IP">Source IP</label><div class="value-wrapper">
      <span class="text-field-display-value" title=" 192.0.2.9 ">192...</span></div></div>
      <div class="field-wrapper"><label>Tenant Name</label><div class="value-wrapper"><button>Edit</button>Contoso</div></div>
      <div class="field-wrapper" style="display: none"><label>Rule Name</label><div class="value-wrapper">hidden</div></div>
      <div class="field-wrapper"><label>Account Short Name</label><div class="value-wrapper">Short</div></div>
      <table><tr><td>Event Name</td><td>Logon</td></tr><tr><td>Source-IP</td><td>10.0.0.1</td></tr></table>"""
    pairs = extraction.label_pairs(spark.createDataFrame([(1, html)], "page_id long, html string"))
    fields = {r.field: (r.shown, r.tabled) for r in extraction.field_values(pairs).collect()}
    assert fields["sourceIp"] == ("192.0.2.9", "10.0.0.1")
    assert fields["tenantName"][0] == "Short"
    assert fields["eventName"] == (None, "Logon") and "ruleName" not in fields


def test_greedy_budget(spark):
    random.seed(5)
    rows = [(g, i, "x" * random.randrange(1, 60) + str(i % 9)) for g in range(6) for i in range(30)]
    got = {(r.incident_id, r.ord) for r in extraction.budget_documents(spark.createDataFrame(rows, "incident_id int, ord int, raw string"), 300).collect()}
    want = set()
    for g in range(6):
        used, seen = 0, set()
        for _, i, raw in (r for r in rows if r[0] == g):
            if raw not in seen:
                seen.add(raw)
                if used + len(raw) <= 300:
                    used += len(raw)
                    want.add((g, i))
    assert got == want


def test_sensitive_keys_are_dropped_at_any_depth(spark):
    raw = '{"a": {"Api-Key": 1, "b": [{"sessionToken": "x", "c": 2}]}, "password": {"d": 1}, "pass": 3}'
    row = flatten.without_sensitive(docs(spark, raw)).first()
    assert json.loads(row.raw) == {"a": {"b": [{"c": 2}]}, "pass": 3}
    left = {r.pointer for r in flatten.drop_sensitive_leaves(flatten.leaves(docs(spark, raw))).collect()}
    assert left == {"/documents/0/a/b/0/c", "/documents/0/pass"}


def test_negative_sampling_by_brute_force(spark):
    rows = [(i % 2, "t", str(i), i, ["positive", "hard", "easy", "easy", "easy", "easy", "easy", "easy", "easy"][i % 9]) for i in range(300)]
    items = spark.createDataFrame(rows, "sample_id int, target string, pointer string, start_token int, label string")
    kept = sets.sample_negatives(items, ["sample_id", "target"], salts=5).collect()
    for sample in (0, 1):
        strong = sum(r[0] == sample and r[4] != "easy" for r in rows)
        assert sum(r.sample_id == sample and r.label != "easy" for r in kept) == strong
        assert sum(r.sample_id == sample and r.label == "easy" for r in kept) == min(2 * strong, sum(r[0] == sample and r[4] == "easy" for r in rows))


def test_scans(spark):
    texts = [("a", "see 10.0.0.1 and 8.8.8.8 x1.2.3.4"), ("b", "at 10:11:12"), ("c", "1.2.3.4"), ("d", "mail a@corp.io b@x.example"), ("e", "fe80::1 2001:db8::1 2606::1")]
    rows = spark.createDataFrame([(k, t, "productVersion" if k == "c" else "n") for k, t in texts], "k string, t string, n string")
    assert {(r.k, r.code, r.match) for r in curation.scan_addresses(rows, "k", "t", "n").collect()} == {
        ("a", "routable_address", "8.8.8.8"), ("e", "routable_address", "2606::1")}
    assert {(r.k, r.match) for r in curation.scan_identities(rows, "k", "t").collect()} == {("d", "corp.io")}


def test_links(spark):
    cases = {
        "https://P.example.com:443/incident/7": True, "http://p.example.com/incident/7": False, "https://p.example.com/incident/7?x=1": False,
        "https://u@p.example.com/incident/7": False, "https://p.example.com/incident2/7/overview": True, "https://p.example.com/Custom/L/7?x=1#y": True,
        "https://p.example.com.evil.test/incident/7": False, "nonsense": False,
    }
    rows = spark.createDataFrame([(u, w) for u, w in cases.items()], "u string, w boolean").select(
        "u", "w", U.trusted_url(F.col("u"), F.lit("https://p.example.com")).alias("g")).collect()
    assert [r.u for r in rows if r.g != r.w] == []


def test_catalogue_is_whole():
    assert len(K.TARGETS) == 23 and len(K.FIELD_LABELS) == 22
