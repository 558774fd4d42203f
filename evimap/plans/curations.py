"""Bindings: curation of drafts, scans of whole texts, hashes, items, storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimap import constants as K
from evimap.operators import candidates as C
from evimap.operators import curation as D
from evimap.operators import flatten, sets
from evimap.plans.mappings import SCORED
from evimap.plans.registry import query
from evimap.sources import records as S

# the documented roles of these families, and the families with an account role
SOURCE_FROM_CLIENT = ("fam.src2", "fam.src3")
CLIENT_FROM_SOURCE = ("fam.src4",)
TIERS_SQL = "(VALUES ('fam.src6', 'clientUserName'), ('fam.src7', 'sourceUsername')) AS tiers(family, production_target)"


def tiers(t):
    return t.sql(f"SELECT family, production_target FROM {TIERS_SQL}")


def drafts(t):
    """Drafts with label and alternative maps, overrides and approvals."""
    rows = t.draft_labels
    entry = F.struct("source_target", F.struct("pointer", "original_type", "status"))
    others = F.struct("source_target", F.filter(F.split("alternatives", "\\|"), lambda p: p != "").alias("v"))
    maps = rows.groupBy("record_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("labels"), F.map_from_entries(F.collect_list(others)).alias("alternatives"))
    base = t.drafts.join(maps, "record_id").join(
        tiers(t).select("family", F.col("production_target").alias("tier_target"), F.lit("accountUpn").alias("tier_source")), "family", "left")
    kind = "map<string,struct<source_target:string,pointer:string,accepted:array<string>,original_type:string>>"

    def override(target: str, source: str):
        return F.create_map(F.lit(target), F.struct(
            F.lit(source).alias("source_target"), F.lit(None).cast("string").alias("pointer"),
            F.lit(None).cast("array<string>").alias("accepted"), F.lit(None).cast("string").alias("original_type"))).cast(kind)

    overrides = F.when(F.col("family").isin(*SOURCE_FROM_CLIENT), override("sourceIp", "clientIp")).when(
        F.col("family").isin(*CLIENT_FROM_SOURCE), override("clientIp", "sourceIp"))
    approval = F.when(F.col("tier_target").isNotNull(), F.map_from_arrays(F.array("tier_target"), F.array(F.struct(
        F.col("tier_source").alias("source_target"), F.lit("reviewed account").alias("finding")))))
    return base.withColumn("overrides", F.coalesce(overrides, F.expr(f"cast(map() as {kind})"))).withColumn(
        "approvals", F.coalesce(approval, F.expr("cast(map() as map<string,struct<source_target:string,finding:string>>)")))


_TARGET_LIST = "(VALUES " + ", ".join(
    f"('{n}', {repr(dict(K.DIRECT_TARGETS)[n]) if n in dict(K.DIRECT_TARGETS) else 'NULL'}, {i})" for i, n in enumerate(K.TARGET_NAMES)
) + ") AS names(target, direct, place)"

DECIDED = f"""WITH wide AS (SELECT d.*, names.target, names.place,
    CASE WHEN family IN ('fam.src2', 'fam.src3') AND names.target = 'sourceIp' THEN 'clientIp' WHEN family = 'fam.src4' AND names.target = 'clientIp' THEN 'sourceIp'
         WHEN (family = 'fam.src6' AND names.target = 'clientUserName') OR (family = 'fam.src7' AND names.target = 'sourceUsername') THEN 'accountUpn' ELSE names.direct END AS source,
    names.target IN ('clientUserName', 'sourceUsername') AS account FROM [drafts] d CROSS JOIN {_TARGET_LIST}),
labelled AS (SELECT w.*, l.pointer, l.original_type, l.status, l.alternatives,
    json_extract_string(alert, l.pointer) AS value, json_type(alert, l.pointer) AS kind FROM wide w LEFT JOIN [draft_labels] l ON w.record_id = l.record_id AND w.source = l.source_target),
decisions AS (SELECT *, CASE WHEN source IS NULL THEN NULL WHEN status = 'matched' AND (kind IS NULL OR (alternatives = '/host' AND false)) THEN 'pointer_unresolved'
      WHEN status = 'matched' AND kind <> 'VARCHAR' THEN 'pointer_type_mismatch' WHEN status = 'matched' AND alternatives = '/host' THEN 'alternative_changes_value'
      WHEN status = 'invalid-type' THEN 'invalid_type' END AS error FROM labelled),
states AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN source IS NULL THEN 'unlabelled' WHEN status = 'matched' THEN 'mapped'
      WHEN status IN ('no-match', 'missing') AND pointer IS NULL AND NOT account THEN 'absent' ELSE 'unlabelled' END AS state FROM decisions)"""


@query("derive_decisions", DECIDED + """
SELECT record_id, target, state, CASE WHEN state = 'mapped' THEN '/documents/0' || pointer END AS primary_pointer,
  CASE WHEN state = 'mapped' THEN '/documents/0' || pointer || CASE WHEN alternatives = '/dup|/ip' THEN '|/documents/0/dup' ELSE '' END END AS accepted,
  CASE WHEN state = 'mapped' THEN value END AS value, CASE WHEN state = 'mapped' AND account THEN 'reviewed account' END AS finding, error FROM states""")
def _(t):
    return D.derive_decisions(drafts(t)).select(
        "record_id", "target", "state", "primary_pointer", F.array_join("accepted", "|").alias("accepted"), "value", "finding", "error")


JUDGEMENTS = """WITH judged AS (SELECT l.record_id, d.review_required, l.source_target AS source, d.split, d.family,
    CASE l.source_target WHEN 'occurredAt' THEN 0 WHEN 'sourceIp' THEN 1 WHEN 'destinationIp' THEN 2 WHEN 'clientIp' THEN 3 WHEN 'clientHostname' THEN 4 ELSE 5 END AS place,
    CASE WHEN status = 'matched' AND (json_extract_string(alert, pointer) IS NULL OR json_extract_string(alert, pointer) = 'not-an-ip') THEN 'invalid'
         WHEN status = 'matched' THEN 'positive' WHEN status IN ('no-match', 'missing') THEN 'none' WHEN status = 'invalid-type' THEN 'invalid' ELSE 'other' END AS judgement
  FROM [draft_labels] l JOIN [drafts] d ON l.record_id = d.record_id WHERE l.source_target <> 'accountUpn')"""


@query("preflight_counts", JUDGEMENTS + """
SELECT 'decisions' AS measure, count(*) AS n FROM judged WHERE NOT review_required
UNION ALL SELECT 'positives', count(*) FILTER (judgement = 'positive') FROM judged WHERE NOT review_required
UNION ALL SELECT 'explicit_none_or_missing', count(*) FILTER (judgement = 'none') FROM judged WHERE NOT review_required
UNION ALL SELECT 'invalid_type', count(*) FILTER (judgement = 'invalid') FROM judged WHERE NOT review_required
UNION ALL SELECT 'tier_positive', count(*) FROM [drafts] WHERE NOT review_required AND family IN ('fam.src6', 'fam.src7')""")
def _(t):
    return D.preflight_counts(drafts(t))


QUARANTINE = JUDGEMENTS + ", " + DECIDED.removeprefix("WITH ") + """, invalid AS (SELECT record_id, string_agg(source, ', ' ORDER BY place) AS invalid
    FROM judged WHERE judgement = 'invalid' AND NOT review_required GROUP BY record_id),
errors AS (SELECT record_id, arg_min(error || ': ' || target, place) AS error FROM states WHERE error IS NOT NULL GROUP BY record_id),
reasons AS (SELECT d.record_id, d.split, d.family, CASE WHEN i.invalid IS NOT NULL THEN 'invalid-type direct label: ' || i.invalid
    WHEN r.record_id IS NULL AND d.review_required THEN 'factory review-required draft' WHEN r.record_id IS NULL THEN 'explicit independent-model review required'
    WHEN r.gate = 'releaseCandidate' AND d.review_required THEN 'review-required draft in a release candidate' ELSE e.error END AS reason
  FROM [drafts] d LEFT JOIN invalid i ON d.record_id = i.record_id LEFT JOIN [reviews] r ON d.record_id = r.record_id LEFT JOIN errors e ON d.record_id = e.record_id)"""


def _judged(t):
    rows = drafts(t)
    return D.judge_drafts(rows, D.derive_decisions(rows), t.reviews.select("record_id", "gate"))


@query("quarantine", QUARANTINE + " SELECT record_id, split, coalesce(reason, '') AS reason FROM reasons")
def _(t):
    return _judged(t).select("record_id", "split", F.coalesce("reason", F.lit("")).alias("reason"))


@query("ingest_report", QUARANTINE + """
SELECT 'input' AS section, split AS key, count(*) AS n FROM reasons GROUP BY split UNION ALL SELECT 'emitted', split, count(*) FROM reasons WHERE reason IS NULL GROUP BY split
UNION ALL SELECT 'quarantined', split, count(*) FROM reasons WHERE reason IS NOT NULL GROUP BY split
UNION ALL SELECT 'reason', reason, count(*) FROM reasons WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'families', 'all', count(DISTINCT family) FROM reasons""")
def _(t):
    return D.ingest_report(_judged(t))


@query("review_scope", """
WITH r AS (SELECT v.*, d.split FROM [reviews] v LEFT JOIN [drafts] d ON v.record_id = d.record_id)
SELECT record_id, 'invalid_gate' AS violation FROM r WHERE gate = 'someGate' UNION ALL SELECT record_id, 'reviewer_model' FROM r WHERE reviewer_model = 'other-1' AND gate <> 'someGate'
UNION ALL SELECT record_id, 'prompt_hash' FROM r WHERE prompt_hash = 'abc' UNION ALL SELECT record_id, 'not_blind' FROM r WHERE gate <> 'trainingOnly' AND NOT blind
UNION ALL SELECT record_id, 'unknown_record' FROM r WHERE split IS NULL UNION ALL SELECT record_id, 'frozen_record' FROM r WHERE gate = 'trainingOnly' AND split = 'frozen-test'""")
def _(t):
    return D.review_violations(t.reviews, t.drafts)


@query("provenance_join", """
WITH p AS (SELECT DISTINCT 'prov' || CAST(p_partkey % 25 AS STRING) AS provenance_id FROM [part])
SELECT d.record_id, 'missing_provenance' AS violation FROM [drafts] d LEFT JOIN p ON d.provenance_id = p.provenance_id WHERE p.provenance_id IS NULL AND d.provenance_id NOT LIKE 'local.entra.%'
UNION ALL SELECT record_id, 'no_ambiguity_note' FROM [drafts] WHERE review_required AND trim(note) = '' AND doc_id % 5 <> 0
UNION ALL SELECT record_id, 'pointer_without_match' FROM [drafts] WHERE doc_id % 11 = 3""")
def _(t):
    known = t.part.select(F.concat(F.lit("prov"), (F.col("p_partkey") % 25).cast("string")).alias("provenance_id"))
    return D.draft_violations(drafts(t), known)


@query("duplicate_provenance", """
SELECT provenance_id, count(*) AS n FROM [drafts] GROUP BY provenance_id HAVING count(*) > 1""")
def _(t):
    return sets.duplicate_keys(t.drafts, ["provenance_id"])


@query("approvals_join", """
SELECT r.record_id, 'unknown_record' AS side FROM [reviews] r LEFT JOIN [drafts] d ON r.record_id = d.record_id WHERE d.record_id IS NULL
UNION ALL SELECT d.record_id, CASE WHEN r.record_id IS NULL THEN 'unreviewed' ELSE 'approved' END FROM [drafts] d LEFT JOIN [reviews] r ON d.record_id = r.record_id""")
def _(t):
    rows, reviews = t.drafts.select("record_id"), t.reviews.select("record_id")
    approved, unreviewed = sets.joined_or_missing(rows, reviews, ["record_id"])
    _, unknown = sets.joined_or_missing(reviews, rows, ["record_id"])
    return (
        approved.withColumn("side", F.lit("approved")).unionByName(unreviewed.withColumn("side", F.lit("unreviewed")))
        .unionByName(unknown.withColumn("side", F.lit("unknown_record")))
    )


@query("label_join", f"""
SELECT d.record_id, x.production_target, l.pointer FROM [drafts] d JOIN {TIERS_SQL.replace('AS tiers', 'AS x')} ON d.family = x.family
JOIN [draft_labels] l ON d.record_id = l.record_id AND l.source_target = 'accountUpn' AND l.status = 'matched'""")
def _(t):
    upn = t.draft_labels.where("source_target = 'accountUpn' and status = 'matched'")
    return t.drafts.join(tiers(t), "family").join(upn, "record_id").select("record_id", "production_target", "pointer")


_TRACES = """SELECT event_id AS trace_id, 'r' || CAST(event_id % 1300 AS STRING) AS record_id,
    CASE event_id % 4 WHEN 0 THEN 'sourceIp' WHEN 1 THEN 'destinationIp' WHEN 2 THEN 'ruleName' ELSE 'noTarget' END AS target FROM [events]"""


@query("trace_source_join", DECIDED + f""", traces AS ({_TRACES})
SELECT trace_id, CASE WHEN s.record_id IS NULL THEN 'unknown_source_or_target' WHEN s.state = 'unlabelled' THEN 'unlabelled_target' WHEN s.state IS NULL THEN 'refused_decision' ELSE '' END AS problem
FROM traces x LEFT JOIN states s ON x.record_id = s.record_id AND x.target = s.target""")
def _(t):
    known = D.derive_decisions(drafts(t)).select("record_id", "target", "state", F.lit(True).alias("known"))
    rows = t.sql(_TRACES).join(known, ["record_id", "target"], "left")
    problem = (
        F.when(F.col("known").isNull(), "unknown_source_or_target").when(F.col("state") == "unlabelled", "unlabelled_target")
        .when(F.col("state").isNull(), "refused_decision").otherwise("")
    )
    return rows.select("trace_id", problem.alias("problem"))


@query("role_overrides", """
SELECT record_id, 'sourceIp' AS target, 'clientIp' AS source_target FROM [drafts] WHERE family IN ('fam.src2', 'fam.src3')
UNION ALL SELECT record_id, 'clientIp', 'sourceIp' FROM [drafts] WHERE family = 'fam.src4' UNION ALL SELECT '', 'absent family', 'fam.none'""")
def _(t):
    absent = D.absent_families(t.drafts, [*SOURCE_FROM_CLIENT, *CLIENT_FROM_SOURCE, "fam.none"])
    return D.role_overrides(t.drafts, SOURCE_FROM_CLIENT, CLIENT_FROM_SOURCE).unionByName(
        absent.select(F.lit("").alias("record_id"), F.lit("absent family").alias("target"), F.col("family").alias("source_target")))


@query("review_artifact", """
SELECT record_id, split, 'approved' AS status, concat_ws('; ', 'Reviewed the complete ' || variant_kind || ' record for ' || family || ' against ' || provenance_id,
  CASE WHEN review_required THEN 'Ambiguous draft reviewed explicitly: ' || note END,
  CASE WHEN family IN ('fam.src2', 'fam.src3') THEN 'sourceIp is reviewed from the draft clientIp role' END,
  CASE WHEN family = 'fam.src4' THEN 'clientIp is reviewed from the draft sourceIp role' END) AS findings,
  CASE WHEN family IN ('fam.src2', 'fam.src3') THEN 'sourceIp<-clientIp' WHEN family = 'fam.src4' THEN 'clientIp<-sourceIp' END AS override,
  CASE family WHEN 'fam.src6' THEN 'clientUserName' WHEN 'fam.src7' THEN 'sourceUsername' END AS approved_target
FROM [drafts] WHERE split IN ('train', 'development')""")
def _(t):
    return D.review_artifact(drafts(t), tiers(t), SOURCE_FROM_CLIENT, CLIENT_FROM_SOURCE).withColumn("findings", F.array_join("findings", "; "))


@query("pointer_prefix", """
SELECT record_id, source_target, '/documents/0' || pointer AS pointer,
  CASE WHEN alternatives = '' THEN '' WHEN alternatives = '/host' THEN '/documents/0/host' ELSE '/documents/0/dup|/documents/0/ip' END AS alternatives FROM [draft_labels]""")
def _(t):
    others = F.array_distinct(F.transform(F.filter(F.split("alternatives", "\\|"), lambda p: p != ""), D.prefixed))
    return t.draft_labels.select("record_id", "source_target", D.prefixed(F.col("pointer")).alias("pointer"), F.array_join(others, "|").alias("alternatives"))


# --- records --------------------------------------------------------------------------------
HASHED = """WITH r AS (SELECT *, '"decisions":{"sourceIp":"' || family || '"},"documents":[' || alert || ']' AS head,
    '"sampleId":"' || record_id || '","schemaVersion":2,"sourceFamily":"' || family || '","split":"' || split || '","splitUnit":{"templateFamily":"' || family || '"},"synthetic":true}' AS tail FROM [drafts]),
h AS (SELECT record_id AS sample_id, doc_id, sha256('[' || alert || ']') AS raw_hash, sha256('{' || head || ',' || tail) AS normalized_hash,
    sha256('{' || head || ',"provenance":{"id":"' || provenance_id || '"},' || tail) AS record_hash FROM r),
hashed AS (SELECT *, sha256('{"recordHash":"' || record_hash || '","review":{"state":"approved"}}') AS certification_hash FROM h)"""


def _records(t):
    return t.drafts.select(
        F.col("record_id").alias("sample_id"), "doc_id", F.col("family").alias("source_family"), "split", F.array("alert").alias("documents"),
        F.concat(F.lit('{"templateFamily": "'), "family", F.lit('"}')).alias("split_unit"), F.concat(F.lit('{"sourceIp": "'), "family", F.lit('"}')).alias("decisions"),
        F.concat(F.lit('{"id": "'), "provenance_id", F.lit('"}')).alias("provenance"), F.lit('{"state": "approved"}').alias("review"),
    )


@query("record_hashes", HASHED + " SELECT sample_id, raw_hash, normalized_hash, record_hash, certification_hash FROM hashed")
def _(t):
    return D.with_hashes(_records(t)).select("sample_id", "raw_hash", "normalized_hash", "record_hash", "certification_hash")


@query("verify_hashes", """
SELECT 'r' || CAST(doc_id AS STRING) AS sample_id, unnest(['raw_hash', 'normalized_hash', 'record_hash', 'certification_hash']) AS violation FROM [documents] WHERE doc_id % 10 = 6
UNION ALL SELECT 'r' || CAST(doc_id AS STRING), 'certification_hash' FROM [documents] WHERE doc_id % 10 = 4""")
def _(t):
    stored = D.with_hashes(_records(t)).withColumn("certification_hash", F.when(F.col("doc_id") % 10 == 4, F.lit("0")).otherwise(F.col("certification_hash")))
    tampered = stored.withColumn("documents", F.when(F.col("doc_id") % 10 == 6, F.array(F.lit('{"other":1}'))).otherwise(F.col("documents")))
    return D.hash_mismatches(tampered)


@query("validate_records", """
WITH b AS (SELECT doc_id, 'r' || CAST(doc_id AS STRING) AS s FROM [documents])
SELECT s AS sample_id, 'schema' AS violation FROM b WHERE doc_id % 23 = 1 UNION ALL SELECT s, 'split' FROM b WHERE doc_id % 29 = 2
UNION ALL SELECT s, 'split_unit' FROM b WHERE doc_id % 31 = 3 UNION ALL SELECT s, 'provenance_keys' FROM b WHERE doc_id % 37 = 4
UNION ALL SELECT s, 'contract' FROM b WHERE doc_id % 41 = 5 UNION ALL SELECT s, 'review_state' FROM b WHERE doc_id % 43 = 6
UNION ALL SELECT s, 'review_blind' FROM b WHERE doc_id % 47 = 7 UNION ALL SELECT s, 'review_model' FROM b WHERE doc_id % 53 = 8 UNION ALL SELECT s, 'reviewer_identity' FROM b WHERE doc_id % 53 = 8
UNION ALL SELECT s, 'decision_targets' FROM b WHERE doc_id % 59 = 9 UNION ALL SELECT s, 'resolved_value' FROM b WHERE doc_id % 61 = 10
UNION ALL SELECT s, 'ineligible' FROM b WHERE doc_id % 13 = 5 UNION ALL SELECT s, 'hard_negative' FROM b WHERE doc_id % 67 = 11
UNION ALL SELECT s, 'semantic_review' FROM b WHERE doc_id % 71 = 12 UNION ALL SELECT s, 'evidence_without_mapping' FROM b WHERE doc_id % 73 = 13
UNION ALL SELECT s, 'accepted_pointers' FROM b WHERE doc_id % 79 = 14""")
def _(t):
    doc = F.col("doc_id")

    def hit(n: int, k: int):
        return doc % n == k

    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def decision(state, pointer=none, accepted=no_list, vtype=none, value=none, hard=no_list, reviewed=F.lit(True)):
        return F.struct(state.alias("state"), pointer.alias("primary_pointer"), accepted.alias("accepted"), vtype.alias("value_type"), value.alias("value"),
                        hard.alias("hard_negatives"), reviewed.alias("reviewed"), F.lit(False).alias("critical"))

    ip, client = F.get_json_object("alert", "$.ip"), F.get_json_object("alert", "$.client.ip")
    at = F.lit("/documents/0/ip")
    made = {
        "sourceIp": decision(F.lit("mapped"), at, F.when(hit(79, 14), F.array(F.lit("/documents/0/dup"))).otherwise(F.array(F.lit("/documents/0/dup"), at)), F.lit("string"),
                             F.when(hit(61, 10), "192.0.2.250").otherwise(ip), F.when(hit(67, 11), F.array(F.lit("/documents/0/host")))),
        "clientIp": decision(F.lit("mapped"), F.lit("/documents/0/client/ip"), F.array(F.lit("/documents/0/client/ip")), F.lit("string"), client),
        "occurred": decision(F.lit("mapped"), F.lit("/documents/0/time"), F.array(F.lit("/documents/0/time")), F.lit("string"), F.get_json_object("alert", "$.time")),
        "destinationIp": decision(F.lit("absent"), reviewed=~hit(71, 12)),
    }
    entries = [
        F.struct(F.lit(n).alias("k"), made.get(n, decision(F.lit("unlabelled"), F.when(hit(73, 13) & F.lit(n == "caseType"), at))).alias("v")) for n in K.TARGET_NAMES
    ]
    decisions = F.map_from_entries(F.filter(F.array(*entries), lambda e: ~(hit(59, 9) & (e["k"] == "eventName"))))
    model = F.lit("gpt-6-x")
    provenance = F.map_from_arrays(
        F.filter(F.array(*(F.lit(k) for k in K.PROVENANCE_KEYS)), lambda k: ~(hit(37, 4) & (k == "seed"))),
        F.filter(F.array(*(
            F.when(hit(41, 5), "old").otherwise(K.CONTRACT) if k == "targetCatalogVersion" else F.lit(K.COMPILER_VERSION) if k == "compilerVersion"
            else F.lit("gpt-6-x") if k == "blindReviewerModel" else F.when(hit(37, 4) & F.lit(k == "seed"), F.lit(None)).otherwise(F.lit("0f" * 32)) for k in K.PROVENANCE_KEYS)),
            lambda v: v.isNotNull()),
    )
    records = t.drafts.select(
        F.col("record_id").alias("sample_id"), F.when(hit(23, 1), 1).otherwise(2).alias("schema_version"), F.lit(True).alias("synthetic"), F.array("alert").alias("documents"),
        F.when(hit(29, 2), "other").otherwise(F.col("split")).alias("split"),
        F.struct(*(F.when(hit(31, 3) & F.lit(k == "product"), "").otherwise(F.col("family")).alias(k) for k in K.GROUP_KEYS)).alias("split_unit"),
        provenance.alias("provenance"), decisions.alias("decisions"),
        F.struct(F.when(hit(43, 6), "open").otherwise("approved").alias("state"), (~hit(47, 7)).alias("blind"), F.lit("releaseCandidate").alias("gate"),
                 F.lit("independent-model").alias("kind"), F.when(hit(53, 8), "other").otherwise(model).alias("model"), F.lit("0f" * 32).alias("prompt_hash")).alias("review"),
    )
    return D.record_violations(records)


@query("split_leakage", """
SELECT family, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS records FROM [drafts] GROUP BY family HAVING count(DISTINCT split) > 1""")
def _(t):
    return sets.split_overlap(t.drafts, "family").withColumn("splits", F.array_join("splits", ","))


@query("split_intersection", """
SELECT 'train/development' AS pair, family FROM (SELECT family FROM [drafts] WHERE split = 'train' INTERSECT SELECT family FROM [drafts] WHERE split = 'development')
UNION ALL SELECT 'train/frozen-test', family FROM (SELECT family FROM [drafts] WHERE split = 'train' INTERSECT SELECT family FROM [drafts] WHERE split = 'frozen-test')
UNION ALL SELECT 'development/frozen-test', family FROM (SELECT family FROM [drafts] WHERE split = 'development' INTERSECT SELECT family FROM [drafts] WHERE split = 'frozen-test')""")
def _(t):
    return sets.split_intersections(t.drafts, "family")


# --- scans over whole texts, with some identities appended ------------------------------------
_SCANNED = """SELECT doc_id, lang, text || CASE doc_id % 9 WHEN 1 THEN ' Password: abcdefgh12' WHEN 2 THEN ' ' || 'AK' || 'IA' || repeat('A1', 8) || ' ' WHEN 3 THEN ' Bearer ' || repeat('ab12', 5) ELSE '' END
    || ' mail user@' || CASE doc_id % 3 WHEN 0 THEN 'corp-' || lang || '.io' WHEN 1 THEN 'mail.example.org' ELSE 'a.test' END
    || CASE doc_id % 4 WHEN 0 THEN ' see acme.onmicrosoft.com' WHEN 1 THEN ' see example.onmicrosoft.com' ELSE '' END
    || CASE WHEN doc_id % 11 = 0 THEN ' tenantId: 12345678-1234-4234-9234-123456789abc' ELSE '' END
    || ' at 10:11:12 from ' || CASE doc_id % 5 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '8.8.4.4' WHEN 2 THEN '300.1.1.1' WHEN 3 THEN '2001:db8::7' ELSE '2606:4700::1111' END || ' end' AS text FROM [documents]"""

SECRETS_SQL = f"""SELECT doc_id, 'secret_1' AS code, '' AS match FROM s WHERE regexp_matches(text, '{K.SECRET_PATTERNS[0]}')
UNION ALL SELECT doc_id, 'secret_2', '' FROM s WHERE regexp_matches(text, '{K.SECRET_PATTERNS[1]}') UNION ALL SELECT doc_id, 'secret_3', '' FROM s WHERE regexp_matches(text, '{K.SECRET_PATTERNS[2]}')
UNION ALL SELECT doc_id, 'secret_4', '' FROM s WHERE regexp_matches(text, '{K.SECRET_PATTERNS[3]}') UNION ALL SELECT doc_id, 'secret_5', '' FROM s WHERE regexp_matches(text, '{K.SECRET_PATTERNS[4]}')"""
IDENTITIES_SQL = f"""SELECT DISTINCT doc_id, 'email_domain' AS code, d AS match FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{K.EMAIL_PATTERN}', 1))) AS d FROM s)
  WHERE NOT regexp_matches(d, '(^|\\.)(example\\.com|example\\.net|example\\.org|example|test|invalid|localhost)$')
UNION ALL SELECT DISTINCT doc_id, 'tenant_domain', d FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{K.TENANT_DOMAIN_PATTERN}', 0))) AS d FROM s)
  WHERE d NOT IN ('example.onmicrosoft.com', 'synthetic.onmicrosoft.com', 'test.onmicrosoft.com')
UNION ALL SELECT doc_id, 'tenant_id', '' FROM s WHERE regexp_matches(text, '{K.TENANT_ID_PATTERN}')"""
_NETS = ((0, 8), (10 << 24, 8), (127 << 24, 8), (0xA9FE0000, 16), (0xAC100000, 12), (0xC0000000, 24), (0xC0000200, 24), (0xC0A80000, 16), (0xC6120000, 15),
         (0xC6336400, 24), (0xCB007100, 24), (0xF0000000, 4))
_QUIET_SQL = " OR ".join(f"n BETWEEN {base} AND {base + 2 ** (32 - bits) - 1}" for base, bits in _NETS)
ADDRESSES_SQL = f"""SELECT DISTINCT doc_id, CASE WHEN n IS NULL THEN 'invalid_address' ELSE 'routable_address' END AS code, token AS match FROM (
  SELECT *, CASE WHEN regexp_matches(token, '^{K.IPV4}$') THEN CAST(split_part(token, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(token, '.', 2) AS BIGINT) * 65536
    + CAST(split_part(token, '.', 3) AS BIGINT) * 256 + CAST(split_part(token, '.', 4) AS BIGINT) END AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_:])((?:\\d{{1,3}}\\.){{3}}\\d{{1,3}})(?:[^\\p{{L}}\\p{{N}}_:]|$)', 1)) AS token FROM s))
  WHERE n IS NULL OR NOT ({_QUIET_SQL})
UNION ALL SELECT doc_id, 'routable_address', '2606:4700::1111' FROM s WHERE doc_id % 5 = 4"""


@query("scan_secrets", f"WITH s AS ({_SCANNED}) {SECRETS_SQL}")
def _(t):
    return D.scan_secrets(t.sql(_SCANNED), "doc_id", "text")


@query("scan_email_tenant", f"WITH s AS ({_SCANNED}) {IDENTITIES_SQL}")
def _(t):
    return D.scan_identities(t.sql(_SCANNED), "doc_id", "text")


@query("scan_ip", f"WITH s AS ({_SCANNED}) {ADDRESSES_SQL}")
def _(t):
    return D.scan_addresses(t.sql(_SCANNED), "doc_id", "text")


REPORT = f"""WITH s AS ({_SCANNED}), f AS (SELECT * FROM ({SECRETS_SQL}) UNION ALL SELECT * FROM ({IDENTITIES_SQL}) UNION ALL SELECT * FROM ({ADDRESSES_SQL})),
l AS (SELECT doc_id, string_agg(DISTINCT code || CASE WHEN match <> '' THEN ': ' || match ELSE '' END, '; ' ORDER BY code || CASE WHEN match <> '' THEN ': ' || match ELSE '' END) AS findings FROM f GROUP BY doc_id),
report AS (SELECT d.doc_id, coalesce(findings, '') AS findings, findings IS NULL AS approved FROM [documents] d LEFT JOIN l ON d.doc_id = l.doc_id)"""


def _findings(t):
    rows = t.sql(_SCANNED)
    return D.scan_secrets(rows, "doc_id", "text").unionByName(D.scan_identities(rows, "doc_id", "text")).unionByName(D.scan_addresses(rows, "doc_id", "text"))


@query("review_report", REPORT + " SELECT doc_id, findings, approved FROM report")
def _(t):
    return D.review_report(t.documents, "doc_id", _findings(t))


@query("review_summary", REPORT + " SELECT count(*) AS records, count(*) FILTER (approved) AS approved, count(*) FILTER (NOT approved) AS failures FROM report")
def _(t):
    return D.review_summary(D.review_report(t.documents, "doc_id", _findings(t)))


# --- traces and items ------------------------------------------------------------------------
_GOLD = """SELECT event_id AS incident_id, 'sourceIp' AS target, CASE WHEN event_id % 10 = 4 THEN 'unlabelled' WHEN event_id % 10 = 7 THEN 'absent' ELSE 'mapped' END AS state,
    CASE WHEN event_id % 10 NOT IN (4, 7) THEN CASE WHEN event_id % 6 = 0 THEN '/documents/0/gone' ELSE '/documents/0/source/ip' END END AS primary_pointer FROM [events]"""
TRACED = SCORED + f""", gold AS ({_GOLD}), traced AS (SELECT r.* EXCLUDE (label, turn), g.primary_pointer, g.state,
    g.state = 'mapped' AND r.pointer IN (coalesce(g.primary_pointer, ''), '/documents/1/Source IP') AS positive,
    CASE WHEN g.state = 'mapped' AND r.pointer IN (coalesce(g.primary_pointer, ''), '/documents/1/Source IP') THEN 'positive' WHEN r.pointer = '/documents/0/client/ip' THEN 'hard' ELSE 'easy' END AS label
  FROM ranked r JOIN gold g ON r.incident_id = g.incident_id AND r.target = g.target WHERE g.state <> 'unlabelled')"""


def _traced(t):
    gold = t.sql(_GOLD).withColumn("accepted", F.when(F.col("state") == "mapped", F.array("primary_pointer", F.lit("/documents/1/Source IP")))).withColumn(
        "hard_negatives", F.array(F.lit("/documents/0/client/ip")))
    scored = C.score_lexical(flatten.leaves(t.alert_docs), ["sourceIp"])
    return D.trace_labels(scored, gold)


@query("trace_labels", TRACED + " SELECT incident_id, target, pointer, label FROM traced")
def _(t):
    return _traced(t).select("incident_id", "target", "pointer", "label")


@query("gold_choices", TRACED + """, p AS (SELECT *, row_number() OVER (PARTITION BY incident_id, target ORDER BY CASE WHEN pointer = primary_pointer THEN 0 ELSE 1 END, rank) AS pick FROM traced WHERE positive)
SELECT DISTINCT x.incident_id, x.target, coalesce(p.leaf_id, '__none__') AS choice FROM traced x LEFT JOIN p ON x.incident_id = p.incident_id AND x.target = p.target AND p.pick = 1""")
def _(t):
    return D.gold_choices(_traced(t))


_CLASSED = """CASE doc_id % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'positive' WHEN 2 THEN 'hard' ELSE 'easy' END"""


@query("compile_items", f"""
WITH w AS (SELECT doc_id, source, list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM [documents]),
s AS (SELECT doc_id, source, {_CLASSED} AS label, len(words) AS total, greatest(1, ceil((len(words) - 16) / 48.0)) AS n,
  unnest(range(0, CAST(greatest(1, ceil((len(words) - 16) / 48.0)) AS BIGINT))) * 48 AS start_token FROM w),
i AS (SELECT *, least(total, start_token + 64) AS end_token, label = 'positive' AND (n = 1 OR (doc_id % 5 = 0 AND start_token = 48)) AS good FROM s WHERE NOT (label = 'positive' AND n > 1 AND doc_id % 5 = 1)),
h AS (SELECT *, sha256('{{"endToken":' || end_token || ',"label":' || CASE WHEN good THEN 1 ELSE 0 END || ',"pointer":"/documents/0/text","sampleId":"d' || doc_id || '","startToken":' || start_token || ',"target":"descriptionLong"}}') AS item_hash FROM i)
SELECT 'd' || doc_id AS sample_id, start_token, end_token, CASE WHEN good THEN 1 ELSE 0 END AS label_index, CASE WHEN good THEN 'positive' WHEN label = 'hard' THEN 'hard' ELSE 'easy' END AS item_label, item_hash FROM h
UNION ALL SELECT DISTINCT 'd' || doc_id, NULL, NULL, NULL, 'refused', NULL FROM s WHERE label = 'positive' AND n > 1 AND doc_id % 5 = 1""")
def _(t):
    rows = C.value_windows(t.documents.select("doc_id", "text"), "text").drop("window_tokens", "text")
    doc = F.col("doc_id")
    label = F.when(doc % 5 < 2, "positive").when(doc % 5 == 2, "hard").otherwise("easy")
    windows = rows.select(
        F.concat(F.lit("d"), doc.cast("string")).alias("sample_id"), F.lit("descriptionLong").alias("target"), F.lit("/documents/0/text").alias("pointer"),
        label.alias("label"), "start_token", "end_token", C.window_count(F.col("total_tokens")).alias("total_windows"),
        F.when(doc % 5 == 0, F.array(F.struct(F.lit(48).alias("start_token"), F.least(F.col("total_tokens"), F.lit(112)).alias("end_token")))).alias("reviewed"),
    )
    items, refused = D.compile_items(windows)
    good = items.select("sample_id", "start_token", "end_token", "label_index", "item_label", "item_hash")
    null = F.lit(None)
    return good.unionByName(refused.select("sample_id", null.cast("int").alias("start_token"), null.cast("int").alias("end_token"), null.cast("int").alias("label_index"),
                                           F.lit("refused").alias("item_label"), null.cast("string").alias("item_hash")))


@query("pilot_check", DECIDED + """, a AS (SELECT record_id FROM [reviews] WHERE gate = 'trainingOnly'), p AS (SELECT record_id FROM [drafts] WHERE doc_id % 6 = 0)
SELECT record_id AS item, 'not_in_pilot' AS problem, NULL AS n FROM (SELECT record_id FROM a EXCEPT ALL SELECT record_id FROM p)
UNION ALL SELECT record_id, 'not_approved', NULL FROM (SELECT record_id FROM p EXCEPT ALL SELECT record_id FROM a)
UNION ALL SELECT 'direct_decisions', 'count', count(*) FILTER (target IN ('occurred', 'sourceIp', 'destinationIp', 'clientIp', 'clientHostname', 'customerName')) FROM states
UNION ALL SELECT 'direct_positive', 'count', count(*) FILTER (state = 'mapped' AND NOT account) FROM states
UNION ALL SELECT 'direct_none', 'count', count(*) FILTER (state = 'absent') FROM states UNION ALL SELECT 'identity_positive', 'count', count(*) FILTER (state = 'mapped' AND account) FROM states""")
def _(t):
    ids = D.pilot_check(t.reviews.where("gate = 'trainingOnly'"), t.drafts.where("doc_id % 6 = 0"))
    counts = D.decision_counts(D.derive_decisions(drafts(t)))
    return ids.select(F.col("record_id").alias("item"), "problem", F.lit(None).cast("bigint").alias("n")).unionByName(
        counts.select(F.col("measure").alias("item"), F.lit("count").alias("problem"), "n"))


# --- storage ------------------------------------------------------------------------------------
MANIFEST = """WITH h AS (SELECT source, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce(CAST(to_json(lang) AS STRING), 'null') || ',"n_chars":' || n_chars || ',"source":' || coalesce(CAST(to_json(source) AS STRING), 'null') || ',"text":' || coalesce(CAST(to_json(text) AS STRING), 'null') || '}') AS h FROM [documents]),
m AS (SELECT source, count(*) AS records, sha256(count(*) || ':' || CAST(sum(CAST('0x' || substring(h, 1, 15) AS BIGINT)) AS STRING) || ':' || CAST(sum(CAST('0x' || substring(h, 16, 15) AS BIGINT)) AS STRING) || ':' || CAST(sum(CAST('0x' || substring(h, 31, 15) AS BIGINT)) AS STRING) || ':' || CAST(sum(CAST('0x' || substring(h, 46, 15) AS BIGINT)) AS STRING) || ':' || CAST(sum(CAST('0x' || substring(h, 61, 15) AS BIGINT)) AS STRING)) AS digest FROM h GROUP BY source)"""


@query("dataset_manifest", MANIFEST + " SELECT * FROM m")
def _(t):
    return S.manifest(t.documents, "source", "doc_id", "lang", "n_chars", "source", "text")


@query("verify_manifest", MANIFEST + """
SELECT 'src1' AS source, 'count_mismatch' AS violation UNION ALL SELECT 'src2', 'hash_mismatch' UNION ALL SELECT 'src3', 'unexpected_source' UNION ALL SELECT 'src99', 'missing_source'""")
def _(t):
    actual = S.manifest(t.documents, "source", "doc_id", "lang", "n_chars", "source", "text")
    expected = actual.where("source <> 'src3'").withColumn("records", F.when(F.col("source") == "src1", F.col("records") + 1).otherwise(F.col("records"))).withColumn(
        "digest", F.when(F.col("source") == "src2", "x").otherwise(F.col("digest")))
    extra = actual.where("source = 'src3'").withColumn("source", F.lit("src99"))
    return S.verify_manifest(actual, expected.unionByName(extra), "source")


def _scratch(t, name: str) -> str:
    """A new folder below the session's checkpoint folder."""
    import uuid

    from evimap.session import checkpoint_root

    return f"{checkpoint_root(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("partitioned_dataset", "SELECT record_id, family FROM [drafts] WHERE split = 'train'")
def _(t):
    folder = _scratch(t, "partitions")
    S.write_partitions(t.drafts.select("record_id", "family", "split"), folder)
    return S.read_partition(t.spark, folder, "train").select("record_id", "family")


@query("read_records", """
SELECT doc_id, lang, source, sha256(text) AS digest FROM [documents]""")
def _(t):
    folder = _scratch(t, "records")
    S.write_canonical(t.documents, folder, "doc_id")
    good, _ = S.read_records(t.spark, folder, "doc_id long, lang string, n_chars long, source string, text string")
    return good.select("doc_id", "lang", "source", F.sha2("text", 256).alias("digest"))


@query("write_canonical_jsonl", """
WITH h AS (SELECT sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce(CAST(to_json(lang) AS STRING), 'null') || ',"n_chars":' || n_chars || ',"source":' || coalesce(CAST(to_json(source) AS STRING), 'null') || ',"text":' || coalesce(CAST(to_json(text) AS STRING), 'null') || '}') AS h FROM [documents])
SELECT count(*) AS records, sha256(count(*) || ':' || CAST(sum(CAST('0x' || substring(h, 1, 15) AS BIGINT)) AS STRING) || ':' || CAST(sum(CAST('0x' || substring(h, 16, 15) AS BIGINT)) AS STRING) || ':' || CAST(sum(CAST('0x' || substring(h, 31, 15) AS BIGINT)) AS STRING) || ':' || CAST(sum(CAST('0x' || substring(h, 46, 15) AS BIGINT)) AS STRING) || ':' || CAST(sum(CAST('0x' || substring(h, 61, 15) AS BIGINT)) AS STRING)) AS digest FROM h""")
def _(t):
    return S.write_canonical(t.documents.select("doc_id", "source", "lang", "n_chars", "text"), _scratch(t, "canonical"), "doc_id")
