"""Bindings: candidates, scores, selection and statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimap import constants as K
from evimap.operators import candidates as C
from evimap.operators import contest, flatten, mapping, models
from evimap.plans.registry import query
from evimap.plans.scalars import TESTED
from evimap.session import dealt

THRESHOLD = 0.4


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]" if values else "CAST([] AS VARCHAR[])"


TARGETS_SQL = "(VALUES " + ", ".join(
    f"('{name}', '{kind}', {_list(C._words(name))}, {_list(C._words(text))}, {i})" for i, (name, kind, text, _) in enumerate(K.TARGETS)
) + ") AS targets(target, value_type, tokens, description, place)"

PAIRS = TESTED + f""", pairs AS (SELECT s.*, targets.*,
    CASE targets.value_type WHEN 'ip' THEN r_ip WHEN 'url' THEN r_url WHEN 'timestamp' THEN r_timestamp WHEN 'text' THEN r_text ELSE r_identifier END AS rejection
    FROM tested s CROSS JOIN {TARGETS_SQL})"""


def _tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''))"


SCORED = PAIRS + f""", named AS (
    SELECT p.*, list_filter(string_split(p.pointer, '/')[4:-2], lambda a: NOT regexp_matches(a, '^[0-9]+$')) AS names, r.value_text AS role
    FROM (SELECT * FROM pairs WHERE rejection = '') p
    LEFT JOIN (SELECT incident_id, parent, value_text FROM leaves WHERE key = 'key' AND vtype = 'string') r
      ON p.incident_id = r.incident_id AND p.parent = r.parent AND p.key = 'value'),
worded AS (SELECT *, {_tokens_sql("coalesce(names[-1], '') || ' ' || coalesce(role, key)")} AS label,
    list_filter(string_split_regex(value_text, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM named),
windowed AS (SELECT *, unnest(range(0, CAST(greatest(1, ceil((len(words) - 16) / 48.0)) AS BIGINT))) AS w FROM worded),
scored AS (SELECT *, w * 48 AS start_token, least(len(words), w * 48 + 64) AS end_token, len(words) AS total_tokens,
    list_distinct(list_transform(words[w * 48 + 1 : w * 48 + 64], lambda x: lower(x))) AS seen FROM windowed),
rated AS (SELECT *, '["' || vtype || '",' || CASE WHEN vtype = 'string' THEN CAST(to_json(value_text) AS STRING) ELSE value_text END || ']' AS identity,
    round(0.9 * (len(list_intersect(label, tokens)) / len(list_distinct(list_concat(label, tokens))))
    + 0.1 * (len(list_intersect(seen, description)) / greatest(1, len(seen))), 6) AS score FROM scored),
best AS (SELECT *, row_number() OVER (PARTITION BY incident_id, pointer, target ORDER BY score DESC, start_token) AS turn,
    count(*) OVER (PARTITION BY incident_id, pointer, target) AS windows FROM rated),
ranked AS (SELECT *, row_number() OVER (PARTITION BY incident_id, target ORDER BY score DESC, pointer) AS rank,
    'f' || substring(sha256(pointer), 1, 20) AS leaf_id, 'g' || substring(sha256(identity), 1, 20) AS group_id FROM best WHERE turn = 1)"""

# the argmax chooser's outcome in SQL: best per value, then best over values
CHOSEN = SCORED + f""", strong AS (SELECT * FROM ranked WHERE score >= {THRESHOLD}),
tops AS (SELECT *, max(score) OVER (PARTITION BY incident_id, target) AS top,
    max(score) OVER (PARTITION BY incident_id, target, group_id) AS group_top FROM strong),
groups AS (SELECT incident_id, target, group_id, any_value(group_top) AS score, any_value(top) AS top,
    min(pointer) AS pointer, min(pointer) <> max(pointer) AS contested
    FROM tops WHERE score = group_top GROUP BY incident_id, target, group_id),
finals AS (SELECT incident_id, target, any_value(top) AS score, min(pointer) AS pointer, max(pointer) AS last_pointer,
    min(pointer) <> max(pointer) AS disagreement, arg_min(contested, pointer) AS contested FROM groups WHERE score = top GROUP BY incident_id, target),
everyone AS (SELECT incident_id, target, place, count(*) AS total_fields, count(*) FILTER (rejection = '') AS eligible,
    count(DISTINCT CASE WHEN rejection = '' THEN vtype || chr(0) || value_text END) AS distinct_values,
    count(*) FILTER (rejection <> '') AS rejected FROM pairs GROUP BY incident_id, target, place),
mapped AS (SELECT e.*, f.pointer, f.score, f.last_pointer, coalesce(f.disagreement OR f.contested, false) AS disagreements,
    CASE WHEN f.pointer IS NULL THEN 'none' WHEN f.disagreement THEN 'disagreed' ELSE 'agreed' END AS value_agreement,
    CASE WHEN f.pointer IS NULL THEN 'none' WHEN f.disagreement OR f.contested THEN 'disagreed' ELSE 'agreed' END AS pointer_agreement,
    CASE WHEN f.pointer IS NULL THEN 'no_supported_match' WHEN f.disagreement OR f.contested THEN 'tentative' ELSE 'selected' END AS status
    FROM everyone e LEFT JOIN finals f ON e.incident_id = f.incident_id AND e.target = f.target)"""


def _scored(t, together: bool = True):
    return C.score_lexical(flatten.leaves(t.alert_docs, together, extra=C.Rating()))


def _rated(t):
    """Scores of all pairs, a list for each leaf."""
    return C.score_leaves(flatten.leaves(t.alert_docs, True, extra=C.Rating()))


def _strong(t):
    """Pairs that reach the threshold."""
    return C.score_lexical(flatten.leaves(t.alert_docs, extra=C.Rating(least=THRESHOLD)), threshold=THRESHOLD)


@query("reject_reasons", PAIRS + """
SELECT pointer, target, rejection, count(*) AS n, min(incident_id) AS first_incident, max(incident_id) AS last_incident FROM pairs GROUP BY ALL""")
def _(t):
    seen = F.min("incident_id").alias("first_incident"), F.max("incident_id").alias("last_incident")
    return C.reject_reasons(C.alike(flatten.leaves(t.alert_docs, named=("pointer",)), "pointer", *seen)).groupBy("pointer", "target", "rejection").agg(
        F.sum("leaves").alias("n"), F.min("first_incident").alias("first_incident"), F.max("last_incident").alias("last_incident")
    )


@query("leaf_target_cross", PAIRS + """
SELECT incident_id, target, count(*) AS pairs, count(*) FILTER (rejection = '') AS eligible FROM pairs GROUP BY ALL""")
def _(t):
    # pairs of an incident follow one another, so they meet in a part of the hash table that is at hand
    rows = dealt(C.alike(flatten.leaves(t.alert_docs, named=()), "incident_id"), "incident_id").sortWithinPartitions("incident_id")
    return C.reject_reasons(rows).groupBy("incident_id", "target").agg(
        F.sum("leaves").alias("pairs"), F.sum(F.when(F.col("rejection") == "", F.col("leaves")).otherwise(0)).alias("eligible")
    )


@query("value_windows", """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM [documents]),
s AS (SELECT doc_id, words, len(words) AS total_tokens, unnest(range(0, CAST(greatest(1, ceil((len(words) - 16) / 48.0)) AS BIGINT))) * 48 AS start_token FROM w)
SELECT doc_id, start_token, least(total_tokens, start_token + 64) AS end_token, total_tokens,
  sha256(array_to_string(words[start_token + 1 : start_token + 64], ' ')) AS evidence FROM s""")
def _(t):
    return C.value_windows(t.documents, "text").select(
        "doc_id", "start_token", "end_token", "total_tokens", F.sha2(F.array_join("window_tokens", " "), 256).alias("evidence")
    )


@query("score_pairs", SCORED + """
SELECT pointer, target, score, count(*) AS n, sum(start_token) AS starts, sum(windows) AS windows FROM best WHERE turn = 1 GROUP BY ALL""")
def _(t):
    return _scored(t, False).groupBy("pointer", "target", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start_token").alias("starts"), F.sum("windows").alias("windows")
    )


# windows as rows, from whole texts: the leaf is the text, the target its topic
_TEXT_WINDOWS = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM [documents]),
s AS (SELECT doc_id, words, unnest(range(0, CAST(greatest(1, ceil((len(words) - 16) / 48.0)) AS BIGINT))) * 48 AS start_token FROM w),
r AS (SELECT doc_id, start_token, least(len(words), start_token + 64) AS end_token, len(words) AS total_tokens,
  (length(array_to_string(words[start_token + 1 : start_token + 64], '')) % 97) / 97.0 AS score FROM s)"""


def _text_windows(t):
    rows = C.value_windows(t.documents.select("doc_id", "text"), "text")
    score = (F.length(F.array_join("window_tokens", "")) % 97) / F.lit(97.0)
    return rows.select(
        F.col("doc_id").alias("incident_id"), F.lit("descriptionLong").alias("target"), F.lit("f").alias("leaf_id"),
        "start_token", "end_token", "total_tokens", score.alias("score"),
    )


@query("best_window", _TEXT_WINDOWS + """, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start_token) AS turn,
  count(*) OVER (PARTITION BY doc_id) AS windows FROM r)
SELECT doc_id, round(score, 9) AS score, start_token, end_token, windows FROM b WHERE turn = 1""")
def _(t):
    return C.best_window(_text_windows(t)).select(
        F.col("incident_id").alias("doc_id"), F.round("score", 9).alias("score"), "start_token", "end_token", "windows"
    )


# damage some of the windows, then list the decisions that must be refused
@query("validate_scores", _TEXT_WINDOWS + """, damaged AS (
  SELECT doc_id, start_token, CASE WHEN doc_id % 11 = 3 THEN end_token + 1 ELSE end_token END AS end_token, total_tokens,
    CASE WHEN doc_id % 13 = 4 AND start_token = 0 THEN 1.5 ELSE score END AS score FROM r
  WHERE NOT (doc_id % 17 = 5) AND NOT (doc_id % 7 = 2 AND start_token = 48)),
tops AS (SELECT doc_id, max(score) + CASE WHEN doc_id % 19 = 6 THEN 0.01 ELSE 0 END AS item_score FROM r GROUP BY doc_id),
facts AS (SELECT d.doc_id, bool_or(end_token > total_tokens) AS over, bool_or(score > 1) AS wild, min(start_token) AS first_start, max(end_token) AS last_end,
    max(total_tokens) AS total, max(score) AS top, max(item_score) AS item_score, count(*) AS n, max(start_token) AS last_start
  FROM damaged d JOIN tops USING (doc_id) GROUP BY d.doc_id)
SELECT a.doc_id, CASE WHEN f.doc_id IS NULL THEN 'omitted_decision' WHEN wild THEN 'invalid_score' ELSE 'invalid_windows' END AS violation
FROM [documents] a LEFT JOIN facts f ON a.doc_id = f.doc_id
WHERE f.doc_id IS NULL OR wild OR over OR first_start <> 0 OR last_end <> total OR abs(item_score - top) > 1e-6 OR (last_start / 48) + 1 <> n""")
def _(t):
    good = _text_windows(t)
    doc = F.col("incident_id")
    top = good.groupBy("incident_id").agg((F.max("score") + F.when(doc % 19 == 6, 0.01).otherwise(0.0)).alias("item_score"))
    damaged = (
        good.where(~(doc % 17 == 5) & ~((doc % 7 == 2) & (F.col("start_token") == 48)))
        .withColumn("end_token", F.when(doc % 11 == 3, F.col("end_token") + 1).otherwise(F.col("end_token")))
        .withColumn("score", F.when((doc % 13 == 4) & (F.col("start_token") == 0), 1.5).otherwise(F.col("score")))
        .join(top, "incident_id")
    )
    requests = t.documents.select(F.col("doc_id").alias("incident_id"), F.lit("descriptionLong").alias("target"), F.lit("f").alias("leaf_id"))
    return C.invalid_scores(requests, damaged).select(F.col("incident_id").alias("doc_id"), "violation")


def _load_length_scorer():
    """A stand-in for a model: scores by length, refuses some texts and goes out of range on others."""
    def model(texts: list[str]) -> list[float]:
        sizes = [len(x.replace(" ", "")) for x in texts]
        if any(n % 31 == 7 for n in sizes):
            raise ValueError("refused")
        return [1.5 if n % 29 == 5 else n % 97 / 97 for n in sizes]

    return model


@query("model_scores", """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM [documents]),
s AS (SELECT doc_id, words, unnest(range(0, CAST(greatest(1, ceil((len(words) - 16) / 48.0)) AS BIGINT))) * 48 AS start_token FROM w),
r AS (SELECT doc_id, start_token, least(len(words), start_token + 64) AS end_token, length(array_to_string(words[start_token + 1 : start_token + 64], '')) AS n FROM s),
b AS (SELECT *, bool_or(n % 31 = 7 OR n % 29 = 5) OVER (PARTITION BY doc_id) AS bad, count(*) FILTER (n % 31 = 7) OVER (PARTITION BY doc_id) AS failures, count(*) OVER (PARTITION BY doc_id) AS windows,
  row_number() OVER (PARTITION BY doc_id ORDER BY n % 97 DESC, start_token) AS turn FROM r)
SELECT doc_id, CASE WHEN NOT bad THEN round((n % 97) / 97.0, 9) END AS score, CASE WHEN NOT bad THEN start_token END AS start_token, CASE WHEN NOT bad THEN end_token END AS end_token,
  windows, failures, CASE WHEN bad THEN 'invalid_score' ELSE '' END AS violation FROM b WHERE turn = 1""")
def _(t):
    rows = C.value_windows(t.documents.select("doc_id", "text"), "text").select(
        F.col("doc_id").alias("incident_id"), F.lit("descriptionLong").alias("target"), F.lit("f").alias("leaf_id"),
        "start_token", "end_token", "total_tokens", F.array_join("window_tokens", " ").alias("evidence"))
    scored, violations = models.score_with(rows, "length-scorer", _load_length_scorer, batch_rows=32)
    failures = scored.groupBy("incident_id").agg(F.count_if(F.col("failure") != "").alias("failures"))
    best = C.best_window(scored).join(violations.select("incident_id", "violation"), "incident_id", "left").join(failures, "incident_id")
    sound = F.col("violation").isNull()
    return best.select(F.col("incident_id").alias("doc_id"), *(F.when(sound, F.round("score", 9) if c == "score" else F.col(c)).alias(c) for c in ("score", "start_token", "end_token")),
                       "windows", "failures", F.coalesce("violation", F.lit("")).alias("violation"))


@query("validate_choices", """
WITH p AS (SELECT event_id, (user_id % 5) / 10.0 AS a, 0.3 AS b, CASE WHEN event_id % 9 = 0 THEN 0.1 ELSE 0.7 - (user_id % 5) / 10.0 END AS c,
  CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN '__none__' ELSE 'x' END AS choice FROM [events])
SELECT event_id, CASE WHEN choice = 'x' OR abs(a + b + c - 1) > 0.002 THEN 'invalid_distribution'
  WHEN (CASE choice WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END) < greatest(a, b, c) THEN 'choice_not_maximal' ELSE '' END AS violation FROM p""")
def _(t):
    event, user = F.col("event_id"), F.col("user_id")
    a = (user % 5) / F.lit(10.0)
    spread = F.array(a, F.lit(0.3), F.when(event % 9 == 0, 0.1).otherwise(F.lit(0.7) - a))
    pick = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("__none__"), F.lit("x")), (event % 4 + 1).cast("int"))
    return t.events.select("event_id", C.choice_violation(F.array(F.lit("a"), F.lit("b"), F.lit("__none__")), spread, pick).alias("violation"))


@query("rank_candidates", SCORED + """
SELECT target, pointer, rank, count(*) AS n, min(score) AS least, max(score) AS most FROM ranked GROUP BY ALL""")
def _(t):
    return mapping.rank_candidates(_scored(t)).groupBy("target", "pointer", "rank").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most")
    )


@query("value_groups", SCORED + """, g AS (SELECT incident_id, target, group_id, string_agg(pointer, ' ' ORDER BY rank) AS pointers, count(*) AS members
  FROM ranked GROUP BY ALL)
SELECT target, pointers, members, count(*) AS n, min(group_id) AS least FROM g GROUP BY ALL""")
def _(t):
    return (
        mapping.value_groups(_rated(t))
        .select("target", F.array_join("member_pointers", " ").alias("pointers"), F.size("member_ids").alias("members"), "group_id")
        .groupBy("target", "pointers", "members").agg(F.count(F.lit(1)).alias("n"), mapping.least_group().alias("least"))
    )


@query("coverage", CHOSEN + """, w AS (SELECT incident_id, target, sum(windows) AS windows_evaluated FROM ranked GROUP BY ALL)
SELECT e.incident_id, e.target, total_fields, eligible, distinct_values, rejected, CAST(coalesce(windows_evaluated, 0) AS BIGINT) AS windows_evaluated
FROM everyone e LEFT JOIN w ON e.incident_id = w.incident_id AND e.target = w.target""")
def _(t):
    return C.coverage(flatten.leaves(t.alert_docs, named=()))


@query("sweep", CHOSEN + """
SELECT incident_id, target, CASE WHEN count(*) FILTER (score = top) > 0 THEN min(pointer) FILTER (score = top) END AS forward,
  max(pointer) FILTER (score = top) AS reverse FROM tops GROUP BY ALL""")
def _(t):
    chooser = mapping.best_above(THRESHOLD)
    scored = mapping.contenders(_scored(t), chooser).withColumn("group_id", F.lit(None).cast("string")).withColumn("endorsed", F.lit(True)).withColumn("contested", F.lit(False))
    folded = scored.groupBy("incident_id", "target").agg(mapping._ordered().alias("pool"))
    return folded.select(
        "incident_id", "target", mapping.sweep(F.col("pool"), chooser)["pointer"].alias("forward"),
        mapping.sweep(F.reverse("pool"), chooser)["pointer"].alias("reverse"),
    ).where("forward is not null")


@query("two_pass_select", CHOSEN + """
SELECT incident_id, target, pointer, round(score, 6) AS score, status, value_agreement, pointer_agreement FROM mapped WHERE pointer IS NOT NULL""")
def _(t):
    picked = mapping.select_candidates(_scored(t), mapping.best_above(THRESHOLD), supported=True)
    return picked.select(
        "incident_id", "target", "pointer", F.round("score", 6).alias("score"), "status", "value_agreement", "pointer_agreement"
    )


def _first_best(target: str, shown: list[dict]) -> contest.Choice:
    """User code that looks at no more than five candidates and gives its probabilities."""
    looked = shown[:5]
    best = max(looked, key=lambda c: c["score"])
    rest = [K.NONE, *(c["leaf_id"] for c in looked if c is not best)]
    return contest.Choice(best["leaf_id"], len(looked), {best["leaf_id"]: 0.6} | {name: 0.4 / len(rest) for name in rest})


@query("chooser_select", CHOSEN + """
SELECT incident_id, target, pointer, round(score, 6) AS score, status, value_agreement, pointer_agreement FROM mapped WHERE pointer IS NOT NULL""")
def _(t):
    picked, _ = contest.select_with(_strong(t), _first_best)
    return picked.select("incident_id", "target", "pointer", F.round("score", 6).alias("score"), "status", "value_agreement", "pointer_agreement")


# scores of some incidents are left out, out of range or asked for twice: their targets are incomplete
@query("fail_closed_statuses", CHOSEN + """, refused AS (SELECT DISTINCT incident_id, target, CASE WHEN incident_id % 23 = 5 THEN 'duplicate_decision'
    WHEN incident_id % 17 = 3 THEN 'omitted_decision' ELSE 'invalid_score' END AS failure FROM strong WHERE incident_id % 17 = 3 OR incident_id % 19 = 4 OR incident_id % 23 = 5)
SELECT m.incident_id, m.target, CASE WHEN failure IS NULL THEN status ELSE 'incomplete' END AS status, CASE WHEN failure IS NULL THEN pointer END AS pointer,
  CASE WHEN failure IS NULL THEN value_agreement ELSE 'none' END AS value_agreement, coalesce(failure, '') AS failure FROM mapped m LEFT JOIN refused r ON m.incident_id = r.incident_id AND m.target = r.target""")
def _(t):
    incident = F.col("incident_id")
    asked = _strong(t).select("incident_id", "target", "leaf_id", "score")
    answers = asked.where(incident % 17 != 3).select(
        "incident_id", "target", "leaf_id", F.lit(0).alias("start_token"), F.lit(1).alias("end_token"), F.lit(1).alias("total_tokens"),
        F.when(incident % 19 == 4, 1.5).otherwise(F.col("score")).alias("score"), F.when(incident % 19 == 4, 1.5).otherwise(F.col("score")).alias("item_score"))
    requests = asked.select("incident_id", "target", "leaf_id")
    refused = C.invalid_scores(requests.union(requests.where(incident % 23 == 5)), answers)
    return contest.fail_closed(mapping.map_incidents(t.alert_docs, THRESHOLD), refused).select("incident_id", "target", "status", "pointer", "value_agreement", "failure")


@query("alias_representatives", SCORED + f""", sized AS (SELECT *, count(*) OVER (PARTITION BY incident_id, target, group_id) AS members,
    max(score) OVER (PARTITION BY incident_id, target, group_id) AS top FROM ranked),
g AS (SELECT incident_id, target, group_id, any_value(members) AS members, any_value(top) AS top, min(pointer) AS pointer,
    any_value(members) = 1 OR any_value(top) >= {THRESHOLD} AS endorsed,
    any_value(top) >= {THRESHOLD} AND min(pointer) <> max(pointer) AS contested FROM sized WHERE score = top GROUP BY incident_id, target, group_id)
SELECT target, pointer, members, endorsed, contested, count(*) AS n FROM g GROUP BY ALL""")
def _(t):
    return mapping.representatives(_rated(t), mapping.best_above(THRESHOLD)).groupBy(
        "target", "pointer", "members", "endorsed", "contested"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("statuses", CHOSEN + """
SELECT incident_id, target, status, pointer, round(score, 6) AS score, value_agreement, pointer_agreement, disagreements,
  total_fields, eligible, distinct_values, rejected FROM mapped""")
def _(t):
    return mapping.map_incidents(t.alert_docs, THRESHOLD).drop("windows_evaluated", "value").withColumn("score", F.round("score", 6))


def _wide(complete: str) -> str:
    """One row per mapped incident: the selected text of each target, and which are tentative."""
    chosen = ", ".join(f"""max(CASE WHEN target = '{n}' AND status = 'selected' THEN value_text END) AS "_{n}\"""" for n in K.TARGET_NAMES)
    return f"""values_of AS (SELECT m.incident_id, m.target, m.place, m.status, l.value_text FROM mapped m
    LEFT JOIN leaves l ON m.incident_id = l.incident_id AND m.pointer = l.pointer),
wide AS (SELECT incident_id, {complete} AS complete, {chosen}, coalesce(string_agg(target, ', ' ORDER BY place) FILTER (status = 'tentative'), '') AS tentative
  FROM values_of GROUP BY incident_id)"""


def _applied_sql(kept: dict[str, str]) -> str:
    return ", ".join(f"""CASE WHEN complete AND "_{n}" IS NOT NULL THEN "_{n}" ELSE {kept.get(n, 'NULL')} END AS "{n}\"""" for n in K.TARGET_NAMES)


_ANY = "(" + " OR ".join(f'"_{n}" IS NOT NULL' for n in K.TARGET_NAMES) + ")"
_KEPT = {"sourceIp": "'kept'", "occurred": "CAST(ts AS STRING)"}


def _kept(t):
    return t.events.select(F.col("event_id").alias("incident_id"), F.lit("kept").alias("sourceIp"), F.col("ts").cast("string").alias("occurred"))


@query("apply_mapping", CHOSEN + f""", {_wide("incident_id % 10 <> 3")}
SELECT e.event_id AS incident_id, {_applied_sql(_KEPT)}, coalesce(complete AND {_ANY}, false) AS mapped, coalesce(tentative, '') AS tentative
FROM [events] e LEFT JOIN wide w ON e.event_id = w.incident_id""")
def _(t):
    mappings = mapping.map_incidents(t.alert_docs, THRESHOLD).select("incident_id", "target", "status", "value")
    return mapping.apply_mapping(_kept(t), mappings.withColumn("complete", F.col("incident_id") % 10 != 3), K.TARGET_NAMES)


# a mapper that fails for some incidents, leaves a target out or gives one twice: those stay as they were
@query("mapper_hook", CHOSEN + f""", {_wide("NOT (incident_id % 23 = 5 OR incident_id % 19 = 4 OR incident_id % 17 = 3)")}
SELECT e.event_id AS incident_id, {_applied_sql(_KEPT)}, coalesce(complete AND {_ANY}, false) AS mapped, CASE WHEN complete THEN tentative ELSE '' END AS tentative,
  CASE WHEN w.incident_id IS NULL THEN 'Model processing incomplete: omitted_target'
    WHEN NOT complete THEN 'Model processing incomplete: ' || CASE WHEN event_id % 23 = 5 THEN 'timeout' WHEN event_id % 19 = 4 THEN 'duplicate_target' ELSE 'omitted_target' END
    WHEN tentative <> '' THEN 'Tentative best guesses; review order disagreement and alias ambiguity: ' || tentative || '.' ELSE '' END AS warning
FROM [events] e LEFT JOIN wide w ON e.event_id = w.incident_id""")
def _(t):
    incident = F.col("incident_id")

    def mapper(docs):
        copies = F.when((incident % 17 == 3) & (F.col("target") == "occurred"), 0).when((incident % 19 == 4) & (F.col("target") == "sourceIp"), 2).otherwise(1)
        rows = mapping.map_incidents(docs, THRESHOLD).withColumn("failure", F.when((incident % 23 == 5) & (F.col("target") == "sourceIp"), "timeout").otherwise(""))
        return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies)))

    return models.map_with(_kept(t), t.alert_docs, mapper)


@query("mapping_warnings", CHOSEN + """, folded AS (SELECT incident_id, string_agg(target, ', ' ORDER BY place) FILTER (status = 'tentative') AS unsure FROM mapped GROUP BY incident_id)
SELECT incident_id, concat_ws(' ', CASE WHEN incident_id % 3 = 0 THEN 'Source-document coverage was incomplete.' END,
  CASE WHEN incident_id % 5 = 0 THEN 'Model processing incomplete: timeout' END,
  'Tentative best guesses; review order disagreement and alias ambiguity: ' || unsure || '.') AS warning FROM folded""")
def _(t):
    statuses = mapping.map_incidents(t.alert_docs, THRESHOLD).where("status = 'tentative' or target = 'occurred'")
    unsure = statuses.groupBy("incident_id").agg(F.collect_set(F.when(F.col("status") == "tentative", F.col("target"))).alias("names"))
    ordered = F.filter(F.array(*(F.lit(n) for n in K.TARGET_NAMES)), lambda n: F.array_contains(F.col("names"), n))
    incident = F.col("incident_id")
    return unsure.select("incident_id", mapping.mapping_warnings(
        incident % 3 != 0, F.when(incident % 5 == 0, "timeout").otherwise(""), ordered).alias("warning"))
