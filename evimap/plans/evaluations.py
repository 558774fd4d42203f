"""Bindings: judged outcomes, metrics, comparison, gate, orders and set checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimap.operators import candidates as C
from evimap.operators import evaluation as V
from evimap.operators import flatten, sets
from evimap.plans.mappings import SCORED
from evimap.plans.registry import query
from evimap.plans.scalars import available_sql, clean_sql

JUDGED = """WITH joined AS (SELECT r.*, e.family, e.split, e.state, e.preferred, e.alternative, e.expected_value FROM [runs] r JOIN [expected] e
    ON r.case_id = e.case_id AND r.target = e.target),
hits AS (SELECT *, coalesce(actual = preferred OR actual = alternative, false) AS correct, actual IS NULL AND status = 'no_supported_match' AS no_match FROM joined),
judged AS (SELECT *, state <> 'unlabelled' AS scored,
    CASE state WHEN 'mapped' THEN coalesce(actual = preferred, false) WHEN 'absent' THEN no_match END AS exact,
    CASE state WHEN 'mapped' THEN correct WHEN 'absent' THEN no_match END AS accepted_answer,
    CASE state WHEN 'mapped' THEN actual IS NOT NULL AND coalesce(value = expected_value, false) WHEN 'absent' THEN no_match END AS value_correct,
    CASE state WHEN 'mapped' THEN actual IS NOT NULL AND NOT correct WHEN 'absent' THEN actual IS NOT NULL END AS wrong,
    CASE state WHEN 'mapped' THEN actual IS NULL WHEN 'absent' THEN false END AS missed,
    CASE state WHEN 'mapped' THEN false WHEN 'absent' THEN actual IS NOT NULL END AS false_absent FROM hits)"""

METRICS = JUDGED + """, t AS (SELECT coalesce(experiment, 'all') AS experiment, count(*) AS targets, count(*) FILTER (exact) AS exact,
    count(*) FILTER (accepted_answer) AS accepted, count(*) FILTER (value_correct) AS values_correct, count(*) FILTER (wrong) AS wrong,
    count(*) FILTER (missed) AS missed, count(*) FILTER (false_absent) AS false_absent, count(*) FILTER (disagreement) AS disagreements,
    count(*) FILTER (status = 'tentative') AS tentative, count(*) FILTER (status = 'tentative' AND accepted_answer) AS tentative_accepted,
    count(*) FILTER (value_agreement = 'disagreed') AS value_disagreements FROM judged WHERE scored GROUP BY ROLLUP (experiment)),
c AS (SELECT coalesce(experiment, 'all') AS experiment, count(*) FILTER (NOT complete) AS incomplete_runs, CAST(sum(total_ms) AS BIGINT) AS elapsed_ms,
    CAST(sum(eligible) AS BIGINT) AS eligible, CAST(sum(assessed) AS BIGINT) AS final_assessed FROM judged GROUP BY ROLLUP (experiment)),
metrics AS (SELECT t.*, c.incomplete_runs, c.elapsed_ms, c.eligible, c.final_assessed FROM t JOIN c ON t.experiment = c.experiment)"""

_FLAGS = ("exact", "accepted_answer", "value_correct", "wrong", "missed", "false_absent")


def judged(t):
    expected = t.expected.withColumn("accepted", F.array_compact(F.array("preferred", "alternative"))).drop("alternative")
    return V.outcomes(expected, t.runs)


@query("score_outcomes", JUDGED + f" SELECT case_id, experiment, run, target, scored, {', '.join(_FLAGS)} FROM judged")
def _(t):
    return judged(t).select("case_id", "experiment", "run", "target", "scored", *_FLAGS)


@query("mapping_metrics", METRICS + " SELECT * FROM metrics")
def _(t):
    return V.metrics(judged(t))


@query("subgroup_accuracy", JUDGED + """, p AS (SELECT 'selection' AS phase, CASE state WHEN 'mapped' THEN 'positive' ELSE 'none' END AS answer, target, family,
    accepted_answer AS correct FROM judged WHERE scored),
g AS (SELECT 'phase' AS subgroup, phase AS key, correct FROM p UNION ALL SELECT 'answer', answer, correct FROM p UNION ALL SELECT 'target', target, correct FROM p
  UNION ALL SELECT 'family', family, correct FROM p UNION ALL SELECT 'all', 'all', correct FROM p)
SELECT subgroup, key, count(*) FILTER (correct) AS correct, count(*) AS sequences, count(*) FILTER (correct) / count(*) AS accuracy FROM g GROUP BY ALL""")
def _(t):
    return V.subgroup_accuracy(V.prediction_rows(judged(t)))


@query("warm_performance", "SELECT experiment, avg(total_ms) AS mean_ms, max(peak_bytes) AS peak_bytes FROM [runs] WHERE runtime_state = 'warm' GROUP BY experiment")
def _(t):
    return V.warm_performance(t.runs)


@query("case_target_hash", """
WITH c AS (SELECT experiment, case_id, sha256('{"id":"' || case_id || '","targets":["' || string_agg(DISTINCT target, '","' ORDER BY target) || '"]}') AS h FROM [runs] GROUP BY experiment, case_id)
SELECT experiment, count(*) AS cases, sha256(count(*) || ':' || CAST(sum(CAST('0x' || substring(h, 1, 15) AS BIGINT)) AS STRING) || ':' || CAST(sum(CAST('0x' || substring(h, 16, 15) AS BIGINT)) AS STRING) || ':' || CAST(sum(CAST('0x' || substring(h, 31, 15) AS BIGINT)) AS STRING) || ':' || CAST(sum(CAST('0x' || substring(h, 46, 15) AS BIGINT)) AS STRING) || ':' || CAST(sum(CAST('0x' || substring(h, 61, 15) AS BIGINT)) AS STRING)) AS digest FROM c GROUP BY experiment""")
def _(t):
    return V.case_target_hash(t.runs, ["experiment"])


@query("reload_determinism", """
SELECT case_id, target, count(*) AS runs FROM [runs] GROUP BY case_id, target HAVING count(DISTINCT coalesce(actual, '') || '|' || status) > 1""")
def _(t):
    return V.nondeterministic(t.runs, ["case_id", "target"])


_COMPARED = JUDGED + """, base AS (SELECT * FROM judged WHERE experiment = 'baseline' AND case_id % 101 <> 7 AND scored),
cand AS (SELECT * FROM judged WHERE experiment = 'grouped' AND case_id % 103 <> 9 AND scored)"""


def _sides(t):
    rows = judged(t).where("scored")
    return rows.where("experiment = 'baseline' AND case_id % 101 <> 7"), rows.where("experiment = 'grouped' AND case_id % 103 <> 9")


@query("run_comparison_join", _COMPARED + """
SELECT coalesce(b.case_id, c.case_id) AS case_id, coalesce(b.run, c.run) AS run, coalesce(b.target, c.target) AS target, b.actual AS before_actual, c.actual AS after_actual,
  CASE WHEN b.case_id IS NULL THEN 'only_after' WHEN c.case_id IS NULL THEN 'only_before' ELSE 'both' END AS side
FROM base b FULL OUTER JOIN cand c ON b.case_id = c.case_id AND b.run = c.run AND b.target = c.target""")
def _(t):
    base, candidate = _sides(t)
    return V.compare_runs(base, candidate, ["case_id", "run", "target"]).select("case_id", "run", "target", "before_actual", "after_actual", "side")


@query("compare_experiments", _COMPARED + """, pairs AS (SELECT b.case_id, b.run, b.target, b.actual AS before, c.actual AS after,
    b.accepted_answer AS ba, c.accepted_answer AS ca, b.value_correct AS bv, c.value_correct AS cv
  FROM base b JOIN cand c ON b.case_id = c.case_id AND b.run = c.run AND b.target = c.target)
SELECT case_id, run, target, before, after, 'pointer_gain' AS change FROM pairs WHERE NOT ba AND ca
UNION ALL SELECT case_id, run, target, before, after, 'pointer_regression' FROM pairs WHERE ba AND NOT ca
UNION ALL SELECT case_id, run, target, before, after, 'value_gain' FROM pairs WHERE NOT bv AND cv
UNION ALL SELECT case_id, run, target, before, after, 'value_regression' FROM pairs WHERE bv AND NOT cv""")
def _(t):
    base, candidate = _sides(t)
    return V.changes(base, candidate, ["case_id", "run", "target"])


_NAMES = ["targets", "accepted", "false_absent", "disagreements", "incomplete_runs"]


@query("recompute_metrics", METRICS + """
SELECT experiment, 'accepted' AS metric, accepted + 1 AS reported, accepted AS recomputed FROM metrics WHERE experiment = 'grouped'
UNION ALL SELECT 'lost', m, 0, NULL FROM (SELECT unnest(['targets', 'accepted', 'false_absent', 'disagreements', 'incomplete_runs']) AS m)""")
def _(t):
    made = V.metrics(judged(t)).select("experiment", *_NAMES)
    wrong = made.withColumn("accepted", F.when(F.col("experiment") == "grouped", F.col("accepted") + 1).otherwise(F.col("accepted")))
    lost = made.where("experiment = 'all'").select(F.lit("lost").alias("experiment"), *(F.lit(0).cast("bigint").alias(n) for n in _NAMES))
    return V.metric_drift(wrong.unionByName(lost), made, "experiment", _NAMES)


@query("run_completeness", """
WITH present AS (SELECT case_id, experiment, run FROM [runs] WHERE NOT (case_id % 61 = 8 AND run = 2)
  UNION ALL SELECT case_id, experiment, run FROM [runs] WHERE case_id % 83 = 2 AND run = 1),
n AS (SELECT case_id, experiment, run, count(*) AS n FROM present GROUP BY ALL)
SELECT r.case_id, r.experiment, r.run, CASE WHEN n IS NULL THEN 'missing' ELSE 'duplicated' END AS problem
FROM [runs] r LEFT JOIN n ON r.case_id = n.case_id AND r.experiment = n.experiment AND r.run = n.run WHERE n IS NULL OR n > 1""")
def _(t):
    runs = t.runs.select("case_id", "experiment", "run")
    present = runs.where("NOT (case_id % 61 = 8 AND run = 2)").unionByName(runs.where("case_id % 83 = 2 AND run = 1"))
    return V.missing_runs(t.expected, present, ["baseline", "grouped"], 2)


@query("coverage_check", """
SELECT case_id, experiment, run, eligible AS scored, assessed, eligible FROM [runs] WHERE assessed <> eligible""")
def _(t):
    rows = t.runs.withColumn("scored", F.col("eligible"))
    return V.coverage_failures(rows).select("case_id", "experiment", "run", "scored", "assessed", "eligible")


# promotion: every family is a candidate measured against the baseline
_GATE = JUDGED + """, f AS (SELECT family AS candidate,
    count(*) FILTER (experiment = 'grouped' AND scored) AS n, count(*) FILTER (experiment = 'grouped' AND accepted_answer) AS acc,
    count(*) FILTER (experiment = 'grouped' AND false_absent) AS fa, count(*) FILTER (experiment = 'baseline' AND false_absent) AS bfa,
    count(*) FILTER (experiment = 'baseline' AND accepted_answer) AS bacc, count(*) FILTER (experiment = 'grouped' AND NOT complete) AS inc,
    count(*) FILTER (experiment = 'grouped' AND disagreement) AS dis, count(*) FILTER (experiment = 'baseline' AND disagreement) AS bdis,
    avg(total_ms) FILTER (experiment = 'grouped') AS ms, avg(total_ms) FILTER (experiment = 'baseline') AS bms, max(peak_bytes) AS peak,
    count(*) FILTER (experiment = 'grouped' AND wrong) AS wrong FROM judged GROUP BY family)"""


def _gate(t):
    rows = judged(t)
    new, old = F.col("experiment") == "grouped", F.col("experiment") == "baseline"
    per = rows.groupBy(F.col("family").alias("candidate")).agg(
        F.count_if(new & F.col("scored")).alias("n"), F.count_if(new & F.col("accepted_answer")).alias("acc"),
        F.count_if(new & F.col("false_absent")).alias("fa"), F.count_if(old & F.col("false_absent")).alias("bfa"),
        F.count_if(old & F.col("accepted_answer")).alias("bacc"), F.count_if(new & ~F.col("complete")).alias("inc"),
        F.count_if(new & F.col("disagreement")).alias("dis"), F.count_if(old & F.col("disagreement")).alias("bdis"),
        F.avg(F.when(new, F.col("total_ms"))).alias("ms"), F.avg(F.when(old, F.col("total_ms"))).alias("bms"), F.max("peak_bytes").alias("peak"),
        F.count_if(new & F.col("wrong")).alias("wrong"),
    )
    number = F.regexp_extract("candidate", "([0-9]+)", 1).cast("int")
    return per.select(
        "candidate", F.when(number % 2 == 0, F.lit(47)).otherwise(F.col("n")).alias("fixed_targets"), F.col("acc").alias("fixed_accepted"),
        F.col("fa").alias("fixed_false_absent"), F.col("bfa").alias("base_fixed_false_absent"), F.col("inc").alias("fixed_incomplete"),
        F.col("dis").alias("fixed_disagreements"), F.col("bdis").alias("base_fixed_disagreements"), F.col("bacc").alias("base_fixed_accepted"),
        F.lit(19).alias("robust_targets"), (F.col("acc") % 12).alias("robust_accepted"), F.lit(0).alias("robust_incomplete"),
        F.col("wrong").alias("new_wrong"), F.lit(0).alias("unassessed_correct"), F.lit(5).alias("signin_targets"), (F.lit(5) - number % 2).alias("signin_accepted"),
        (number % 3 != 0).alias("signin_customer_none"), F.col("inc").alias("frozen_incomplete"), F.lit(0).alias("frozen_coverage_failures"),
        (number % 4 != 1).alias("reload_equal"), F.lit(2).alias("reload_passes"), F.col("acc").alias("frozen_accepted"), F.col("bacc").alias("base_frozen_accepted"),
        F.col("fa").alias("frozen_false_absent"), F.col("bfa").alias("base_frozen_false_absent"),
        (F.col("ms") * (1 + (number % 4) * 0.1)).alias("mean_ms"), F.col("bms").alias("base_mean_ms"),
        (F.col("peak") * (1 + (number % 3) * 0.1)).alias("peak_bytes"), F.col("peak").alias("base_peak_bytes"),
        F.when(number % 5 == 0, F.array(F.lit("warmTime"))).otherwise(F.array().cast("array<string>")).alias("allowed"),
    )


@query("promotion_gate", _GATE + """, g AS (SELECT *, CAST(regexp_extract(candidate, '([0-9]+)', 1) AS INT) AS k FROM f),
r AS (SELECT candidate, 'frozen_incomplete' AS failure, inc <> 0 AS hit FROM g UNION ALL SELECT candidate, 'reload_not_equal', k % 4 = 1 FROM g
  UNION ALL SELECT candidate, 'frozen_regression', acc < bacc FROM g UNION ALL SELECT candidate, 'frozen_false_absent', fa > bfa FROM g
  UNION ALL SELECT candidate, 'fixed_accepted', (k % 2 <> 0 AND n <> 47) OR acc < 24 FROM g UNION ALL SELECT candidate, 'fixed_false_absent', fa > 3 FROM g
  UNION ALL SELECT candidate, 'false_absent_not_reduced', bfa > 0 AND fa >= bfa FROM g UNION ALL SELECT candidate, 'fixed_incomplete', inc <> 0 FROM g
  UNION ALL SELECT candidate, 'robustness', acc % 12 < 8 FROM g UNION ALL SELECT candidate, 'new_wrong', wrong > 0 FROM g
  UNION ALL SELECT candidate, 'order_disagreement', dis > bdis AND acc <= bacc FROM g UNION ALL SELECT candidate, 'signin_case', k % 2 <> 0 FROM g
  UNION ALL SELECT candidate, 'signin_customer', k % 3 = 0 FROM g
  UNION ALL SELECT candidate, 'warm_time', ms * (1 + (k % 4) * 0.1) > bms * 1.15 AND k % 5 <> 0 FROM g
  UNION ALL SELECT candidate, 'peak_ram', peak * (1 + (k % 3) * 0.1) > peak * 1.15 FROM g)
SELECT candidate, coalesce(string_agg(failure, ',' ORDER BY failure) FILTER (hit), '') AS failures, NOT bool_or(hit) AS eligible,
  CASE WHEN bool_or(hit) THEN 'ship-pinned-base-assets' ELSE 'candidate-may-enter-manual-promotion-review' END AS fallback FROM r GROUP BY candidate""")
def _(t):
    gate = _gate(t)
    return V.eligible_candidates(gate, V.gate_failures(gate))


_REPORTS = """SELECT event_type AS report_set, user_id AS report, 'src' || CAST(user_id % CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS STRING) AS source_hash,
    'ckpt' || CASE WHEN event_type = 'view' AND event_id % 500 = 3 THEN 'x' ELSE '' END AS checkpoint, 'rt-' || event_type AS runtime FROM [events]"""


@query("identity_match", f"""
WITH r AS ({_REPORTS})
SELECT report_set, part FROM (SELECT report_set, 'source_hash' AS part, count(DISTINCT source_hash) AS n FROM r GROUP BY 1
  UNION ALL SELECT report_set, 'checkpoint', count(DISTINCT checkpoint) FROM r GROUP BY 1 UNION ALL SELECT report_set, 'runtime', count(DISTINCT runtime) FROM r GROUP BY 1) WHERE n > 1""")
def _(t):
    return V.identity_mismatch(t.sql(_REPORTS), ["source_hash", "checkpoint", "runtime"], "report_set")


@query("training_complete", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'steps' WHEN p_size % 7 = 2 THEN 'epochs' WHEN p_partkey % 11 = 3 THEN 'reload_choices'
  WHEN p_partkey % 13 = 4 THEN 'reload_drift' WHEN p_size % 10 = 0 THEN 'probe_count' END AS broken_rule,
  NOT (p_partkey % 5 = 1 OR p_size % 7 = 2 OR p_partkey % 11 = 3 OR p_partkey % 13 = 4 OR p_size % 10 = 0) AS complete FROM [part]""")
def _(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    runs = t.part.select(
        "p_partkey", (F.lit(100) - F.when(key % 5 == 1, 1).otherwise(0)).alias("optimizer_steps"), F.lit(100).alias("expected_steps"),
        F.when(size % 7 == 2, 2).otherwise(3).alias("epochs"), F.lit(3).alias("planned_epochs"), (key % 11 != 3).alias("choices_equal"), F.lit(True).alias("finite_state"),
        F.when(key % 13 == 4, 0.5).otherwise(0.0).alias("max_logit_delta"), (F.lit(50) + F.when(size % 10 == 0, 1).otherwise(0)).alias("probe_sequences"),
        F.lit(50).alias("development_sequences"), F.lit(False).alias("promotion_eligible"),
    )
    return V.training_complete(runs).select("p_partkey", "broken_rule", "complete")


# --- merging, orders, sets -----------------------------------------------------------------
_VIEWS = """SELECT CAST(floor(order_key / 3) AS BIGINT) AS ticket, order_key AS view_order, customer_name, device_hostname, close_notes, incident_outcome,
    classification || CASE WHEN order_key % 2 = 0 THEN '' ELSE 'x' END AS doc, order_key % 29 <> 4 AS documents_complete FROM [incidents]"""


@query("merge_views", f"""
WITH v AS ({_VIEWS}), d AS (SELECT ticket, doc, min(view_order) AS first_seen FROM v GROUP BY ALL),
docs AS (SELECT ticket, string_agg(doc, '|' ORDER BY first_seen) AS documents FROM d GROUP BY ticket),
f AS (SELECT ticket, {', '.join(f"arg_min({clean_sql(c)}, view_order) FILTER ({available_sql(c)}) AS {c}" for c in ('customer_name', 'device_hostname', 'close_notes', 'incident_outcome'))},
  bool_and(documents_complete) AS documents_complete FROM v GROUP BY ticket)
SELECT f.*, documents FROM f JOIN docs ON f.ticket = docs.ticket""")
def _(t):
    views = t.sql(_VIEWS).withColumn("documents", F.array("doc"))
    merged = sets.merge_views(views, "ticket", "view_order", ["customer_name", "device_hostname", "close_notes", "incident_outcome"], "documents", "documents_complete")
    return merged.withColumn("documents", F.array_join("documents", "|"))


@query("running_window_check", """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM [documents]),
s AS (SELECT doc_id, len(words) AS total, unnest(range(0, CAST(greatest(1, ceil((len(words) - 16) / 48.0)) AS BIGINT))) * 48 AS start_token FROM w),
k AS (SELECT doc_id, start_token, least(total, start_token + 64) AS end_token FROM s WHERE NOT (doc_id % 3 = 1 AND (start_token / 48) % 4 = 2)),
l AS (SELECT *, lag(start_token) OVER (PARTITION BY doc_id ORDER BY start_token) AS last_start, lag(end_token) OVER (PARTITION BY doc_id ORDER BY start_token) AS last_end FROM k)
SELECT doc_id, start_token, last_start, last_end FROM l WHERE (last_start IS NULL AND start_token <> 0) OR start_token >= last_end""")
def _(t):
    windows = C.value_windows(t.documents.select("doc_id", "text"), "text").select("doc_id", "start_token", "end_token")
    holed = windows.where("NOT (doc_id % 3 = 1 AND (start_token / 48) % 4 = 2)")
    return sets.window_gaps(holed, ["doc_id"])


@query("stage_one_rank", SCORED + """, want AS (SELECT incident_id, 'sourceIp' AS target, CASE WHEN incident_id % 2 = 0 THEN '/documents/0/source/ip' ELSE '/documents/0/client/ip' END AS preferred
  FROM (SELECT DISTINCT incident_id FROM parsed))
SELECT w.incident_id, w.target, r.rank FROM want w JOIN ranked r ON w.incident_id = r.incident_id AND w.target = r.target AND w.preferred = r.pointer""")
def _(t):
    expected = t.events.select(
        F.col("event_id").alias("incident_id"), F.lit("sourceIp").alias("target"),
        F.when(F.col("event_id") % 2 == 0, "/documents/0/source/ip").otherwise("/documents/0/client/ip").alias("preferred"),
    )
    return V.rank_of(C.score_lexical(flatten.leaves(t.alert_docs), ["sourceIp"]), expected)


_ITEMS = """SELECT l_orderkey AS sample_id, l_returnflag AS target, l_linenumber AS pointer, l_partkey AS start_token, l_suppkey AS part_no,
    CASE WHEN l_quantity < 4 THEN 'positive' WHEN l_quantity < 7 THEN 'hard' ELSE 'easy' END AS label FROM [lineitem]"""


@query("negative_sampling", f"""
WITH i AS ({_ITEMS}), h AS (SELECT *, sha256('{{"sample_id":' || sample_id || ',"target":"' || target || '","pointer":' || pointer || ',"start_token":' || start_token || ',"part_no":' || part_no || '}}') AS h FROM i),
r AS (SELECT *, greatest(2, 2 * count(*) FILTER (label <> 'easy') OVER (PARTITION BY sample_id, target)) AS allowed,
  row_number() OVER (PARTITION BY sample_id, target, label ORDER BY h) AS turn FROM h)
SELECT sample_id, target, pointer, start_token, part_no, label FROM r WHERE label <> 'easy' OR turn <= allowed""")
def _(t):
    return sets.sample_negatives(t.sql(_ITEMS), ["sample_id", "target"], order=("sample_id", "target", "pointer", "start_token", "part_no"))


@query("length_buckets", """
WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, sha256(CAST(doc_id AS STRING))) - 1 AS position FROM [documents])
SELECT doc_id, n_chars, position, CAST(floor(position / 16) AS BIGINT) AS batch FROM o""")
def _(t):
    items = t.documents.select("doc_id", "n_chars", F.sha2(F.col("doc_id").cast("string"), 256).alias("item_hash"))
    return sets.length_batches(items, 16, 7, "n_chars").select("doc_id", "n_chars", "position", "batch")


@query("stable_order", "SELECT o_orderkey, o_totalprice AS score, o_orderpriority AS pointer FROM [orders] ORDER BY score DESC, pointer, o_orderkey")
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("pointer"))
    return sets.stable_order(rows, "o_orderkey")


@query("distinct_union", """
WITH u AS (SELECT ticket_id, list_concat([tenant_name, incident_name], [incident_name, classification, tenant_name]) AS v FROM [incidents])
SELECT ticket_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS merged FROM u""")
def _(t):
    merged = sets.distinct_union(F.array("tenant_name", "incident_name"), F.array("incident_name", "classification", "tenant_name"))
    return t.incidents.select("ticket_id", F.array_join(merged, "|").alias("merged"))


@query("set_difference", "SELECT DISTINCT doc_id FROM [documents] EXCEPT SELECT doc_id FROM [labels]")
def _(t):
    return sets.difference(t.documents, t.labels, ["doc_id"])


@query("accepted_pointer_semi", JUDGED + """
SELECT case_id, experiment, run, actual IN (preferred, alternative) AS in_list FROM judged WHERE state = 'mapped' AND actual IS NOT NULL
  AND coalesce(actual = preferred OR actual = alternative, false)""")
def _(t):
    accepted = t.expected.where("state = 'mapped'").select("case_id", "target", F.explode(F.array_compact(F.array("preferred", "alternative"))).alias("actual"))
    kept = t.runs.join(accepted, ["case_id", "target", "actual"], "left_semi")
    return kept.select("case_id", "experiment", "run", F.lit(True).alias("in_list"))
