"""Dataset curation: decisions, quarantine, validation, scans, hashes, items.

Bad input never fails a table: it becomes a row with a violation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimap import constants as K
from evimap.functions import eligibility as E
from evimap.functions import jsoncols as J
from evimap.functions.text import trim_all
from evimap.functions.times import event_micros, event_number

STRINGS = "array<string>"


# --- pointers --------------------------------------------------------------------------
def prefixed(pointer: Column) -> Column:
    """A draft pointer as record pointer; NULL unless it is rooted."""
    return F.when(F.startswith(pointer, F.lit("/")), F.concat(F.lit("/documents/0"), pointer))


def places(documents: str) -> Column:
    """MAP<pointer, STRUCT<vtype, type, text, number>> of all scalars of ARRAY<STRING> documents.

    Built inside the row: a record holds at most 16 documents of 96 KiB.
    """
    walked = J.walk_text("d.raw", "d.doc", "i")
    nodes = F.expr(
        f"flatten(transform(transform({documents}, s -> named_struct('raw', s, 'doc', try_parse_json(s))), (d, i) -> coalesce({walked}, array())))"
    )
    scalars = F.filter(nodes, lambda n: n["container"].isNull())
    entries = F.transform(scalars, lambda n: F.struct(n["pointer"].alias("pointer"), F.struct(
        J.variant_kind(n["value"]).alias("vtype"), J.json_type(n["value"]).alias("type"),
        F.try_variant_get(n["value"], "$", "string").alias("text"),
        F.when(J.variant_kind(n["value"]) == "number", F.try_variant_get(n["value"], "$", "double")).alias("number"))))
    return F.map_from_entries(entries)


def same_value(a: Column, b: Column) -> Column:
    """Equal type and value; numbers by value, not by spelling."""
    return (a["vtype"] == b["vtype"]) & F.when(a["vtype"] == "number", a["number"] == b["number"]).otherwise(a["text"].eqNullSafe(b["text"]))


def fits(place: Column, value_type: Column) -> Column:
    """The strict structural test of curation."""
    raw = F.coalesce(place["text"], F.lit(""))
    text = F.when(place["vtype"] == "null", F.lit("")).otherwise(trim_all(raw))
    moment = event_micros(place["vtype"], raw, event_number(place["vtype"], raw, place["number"], strict=True))
    return E.reason_of(E.reasons(place["vtype"], text, moment, strict=True), value_type) == ""


# --- decisions ----------------------------------------------------------------------------
def derive_decisions(drafts: DataFrame, targets: Sequence[str] = K.TARGET_NAMES) -> DataFrame:
    """One row per (record, target): mapped, absent, unlabelled, or an error.

    ``drafts`` has record_id, family, alert, labels MAP<source, STRUCT<pointer,
    original_type, status>>, alternatives MAP<source, ARRAY>, overrides
    MAP<target, STRUCT<source_target, pointer, accepted ARRAY, original_type>>,
    approvals MAP<target, STRUCT<source_target, finding>>, and the family's
    tier_target / tier_source (NULL when it has none).
    """
    direct = dict(K.DIRECT_TARGETS)
    entries = F.array(*(
        F.struct(F.lit(name).alias("target"), F.lit(direct.get(name)).cast("string").alias("source")) for name in targets
    ))
    rows = drafts.withColumn("places", places("array(alert)")).withColumn("t", F.explode(entries)).select(
        "record_id", F.col("t.target").alias("target"), F.col("t.source").alias("direct"), "places", "labels", "alternatives",
        F.try_element_at("overrides", F.col("t.target")).alias("override"), F.try_element_at("approvals", F.col("t.target")).alias("approval"),
        "tier_target", "tier_source",
    )
    tiered = F.coalesce((F.col("tier_target") == F.col("target")) & (F.col("approval.source_target") == F.col("tier_source")), F.lit(False))
    rows = rows.withColumn("tiered", tiered).withColumn(
        "source", F.coalesce("override.source_target", F.when(F.col("tiered"), F.col("tier_source")), "direct")
    ).withColumn("label", F.try_element_at("labels", F.col("source")))
    rows = rows.withColumn("pointer", F.coalesce("override.pointer", "label.pointer")).withColumn(
        "status", F.when(F.col("override.pointer").isNotNull(), "matched").otherwise(F.col("label.status"))
    )
    override_list = F.when(F.size("override.accepted") > 0, F.col("override.accepted"))
    others = F.coalesce(override_list, F.try_element_at("alternatives", F.col("source")), F.array().cast(STRINGS))
    rows = rows.withColumn("accepted", F.array_distinct(F.transform(F.concat(F.array("pointer"), others), prefixed)))
    rows = rows.withColumn("resolved", F.try_element_at("places", prefixed(F.col("pointer"))))
    matched = (F.col("status") == "matched") & F.col("pointer").isNotNull()
    wanted = F.coalesce("override.original_type", "label.original_type")
    unresolved = F.exists("accepted", lambda p: p.isNull() | F.try_element_at("places", p).isNull())
    changed = F.exists("accepted", lambda p: ~same_value(F.try_element_at("places", p), F.col("resolved")))
    needs_tier = F.col("target").isin("clientUserName", "sourceUsername") & (F.col("source") == "accountUpn") & ~F.col("tiered")
    unauthorised = F.col("approval").isNotNull() & ~F.col("tiered")
    error = (
        F.when(unauthorised, "target_approval_not_authorised")
        .when(needs_tier, "tier_approval_required")
        .when(F.col("source").isNull(), F.lit(None))
        .when(F.col("label").isNull(), "missing_label")
        .when(matched & unresolved, "pointer_unresolved")
        .when(matched & ~J.matches_json_type(F.col("resolved.type"), wanted), "pointer_type_mismatch")
        .when(matched & changed, "alternative_changes_value")
        .when(~matched & (F.col("status") == "invalid-type"), "invalid_type")
    )
    rows = rows.withColumn("error", error)
    absent = F.col("status").isin("no-match", "missing") & F.col("pointer").isNull() & ~F.col("tiered")
    state = (
        F.when(F.col("error").isNotNull(), F.lit(None)).when(F.col("source").isNull(), "unlabelled")
        .when(matched, "mapped").when(absent, "absent").otherwise("unlabelled")
    )
    rows = rows.withColumn("state", state)
    is_mapped = F.col("state") == "mapped"
    return rows.select(
        "record_id", "target", "state", F.when(is_mapped, prefixed(F.col("pointer"))).alias("primary_pointer"),
        F.when(is_mapped, F.col("accepted")).alias("accepted"), F.when(is_mapped, F.col("resolved.vtype")).alias("value_type"),
        F.when(is_mapped, F.col("resolved.text")).alias("value"), F.when(is_mapped & F.col("tiered"), F.col("approval.finding")).alias("finding"), "error",
    )


def direct_judgements(drafts: DataFrame) -> DataFrame:
    """The six direct labels of each draft: positive, none, invalid or other."""
    entries = F.array(*(
        F.struct(F.lit(name).alias("target"), F.lit(source).alias("source"), F.lit(K.TARGET_TYPE[name]).alias("value_type"), F.lit(at).alias("at"))
        for at, (name, source) in enumerate(K.DIRECT_TARGETS)
    ))
    rows = drafts.withColumn("places", places("array(alert)")).withColumn("t", F.explode(entries))
    label = F.try_element_at("labels", F.col("t.source"))
    place = F.try_element_at("places", prefixed(label["pointer"]))
    sound = F.coalesce(fits(place, F.col("t.value_type")), F.lit(False))
    judged = (
        F.when(label["status"] == "matched", F.when(sound, "positive").otherwise("invalid"))
        .when(label["status"].isin("no-match", "missing"), "none").when(label["status"] == "invalid-type", "invalid").otherwise("other")
    )
    return rows.select("record_id", "review_required", F.col("t.source").alias("source"), F.col("t.at").alias("at"), judged.alias("judgement"))


def preflight_counts(drafts: DataFrame) -> DataFrame:
    """(measure, n) over drafts that need no review."""
    ready = drafts.where(~F.col("review_required"))
    direct = direct_judgements(ready).agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("judgement") == "positive").alias("positives"),
        F.count_if(F.col("judgement") == "none").alias("explicit_none_or_missing"), F.count_if(F.col("judgement") == "invalid").alias("invalid_type"),
    )
    tier = ready.agg(F.count_if(
        F.col("tier_source").isNotNull() & (F.try_element_at("labels", F.col("tier_source"))["status"] == "matched")).alias("tier_positive"))
    names = ["decisions", "positives", "explicit_none_or_missing", "invalid_type"]
    return direct.unpivot([], names, "measure", "n").unionByName(tier.unpivot([], ["tier_positive"], "measure", "n"))


def judge_drafts(drafts: DataFrame, decisions: DataFrame, approved: DataFrame) -> DataFrame:
    """(record_id, split, family, reason): NULL for a valid draft, else why it is refused.

    The first that applies: an invalid direct label, no approval (two texts),
    a derivation error. ``approved`` has (record_id, gate).
    """
    invalid = direct_judgements(drafts.where(~F.col("review_required"))).where("judgement = 'invalid'").groupBy("record_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda s: s["source"]), ", ").alias("invalid"))
    place = F.array_position(F.array(*(F.lit(name) for name in K.TARGET_NAMES)), F.col("target"))
    errors = decisions.where("error is not null").groupBy("record_id").agg(F.min_by(F.concat_ws(": ", "error", "target"), place).alias("error"))
    rows = (
        drafts.select("record_id", "split", "family", "review_required").join(invalid, "record_id", "left")
        .join(approved.withColumn("_approved", F.lit(True)), "record_id", "left").join(errors, "record_id", "left")
    )
    reason = (
        F.when(F.col("invalid").isNotNull(), F.concat(F.lit("invalid-type direct label: "), "invalid"))
        .when(F.col("_approved").isNull() & F.col("review_required"), "factory review-required draft")
        .when(F.col("_approved").isNull(), "explicit independent-model review required")
        .when((F.col("gate") == "releaseCandidate") & F.col("review_required"), "review-required draft in a release candidate")
        .otherwise(F.col("error"))
    )
    return rows.select("record_id", "split", "family", reason.alias("reason"))


def quarantine(drafts: DataFrame, decisions: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, refused) drafts, see :func:`judge_drafts`."""
    judged = judge_drafts(drafts, decisions, approved)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def ingest_report(judged: DataFrame) -> DataFrame:
    """(section, key, n): input, emitted and quarantined counts, in one pass over judged drafts."""
    def entry(section: str, key: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), key.alias("key"))

    good = F.col("reason").isNull()
    entries = F.array_compact(F.array(
        entry("input", F.col("split")), F.when(good, entry("emitted", F.col("split"))), F.when(~good, entry("quarantined", F.col("split"))),
        F.when(~good, entry("reason", F.col("reason"))), entry("families", F.col("family")),
    ))
    counted = judged.select(F.inline(entries)).groupBy("section", "key").agg(F.count(F.lit(1)).alias("n"))
    # a family counts once, whatever its number of drafts
    family = F.col("section") == "families"
    return counted.groupBy("section", F.when(family, "all").otherwise(F.col("key")).alias("key")).agg(
        F.sum(F.when(family, F.lit(1)).otherwise(F.col("n"))).alias("n"))


# --- reviews -------------------------------------------------------------------------------
def review_violations(reviews: DataFrame, drafts: DataFrame) -> DataFrame:
    """(record_id, violation) of review rows that may not be used.

    ``reviews`` has record_id, gate, status, reviewer_kind, reviewer_model,
    prompt_hash, blind.
    """
    dup = reviews.groupBy("record_id").agg(F.count(F.lit(1)).alias("times"))
    known = drafts.select("record_id", "split", F.lit(True).alias("known"))
    rows = reviews.join(dup, "record_id").join(known, "record_id", "left")
    strong = F.col("gate").isin("trainingOnly", "releaseCandidate")
    rules = (
        ("invalid_gate", ~F.col("gate").isin(*K.REVIEW_GATES)),
        ("not_approved", F.col("status") != "approved"),
        ("not_independent", F.col("reviewer_kind") != "independent-model"),
        ("reviewer_model", strong & ~F.startswith(F.lower("reviewer_model"), F.lit(K.REVIEW_MODEL_PREFIX))),
        ("prompt_hash", ~F.coalesce(F.col("prompt_hash"), F.lit("")).rlike(K.HASH_PATTERN)),
        ("disclosure", (F.col("gate") == "trainingOnly") & F.col("blind")),
        ("not_blind", (F.col("gate") != "trainingOnly") & ~F.col("blind")),
        ("duplicate_review", F.col("times") > 1),
        ("unknown_record", F.col("known").isNull()),
        ("frozen_record", (F.col("gate") == "trainingOnly") & (F.col("split") == "frozen-test")),
    )
    return _violations(rows, "record_id", rules).distinct()


def draft_violations(drafts: DataFrame, provenance: DataFrame) -> DataFrame:
    """(record_id, violation) of drafts offered for review."""
    known = provenance.select("provenance_id", F.lit(True).alias("known")).distinct()
    rows = drafts.join(known, "provenance_id", "left")
    labels = F.map_values("labels")
    ambiguous = F.exists(labels, lambda l: l["status"] == "ambiguous")
    rules = (
        ("missing_provenance", F.col("known").isNull() & ~F.startswith("provenance_id", F.lit("local.entra."))),
        ("no_ambiguity_note", F.col("review_required") & (trim_all(F.coalesce("note", F.lit(""))) == "") & ~ambiguous),
        ("invalid_status", F.exists(labels, lambda l: ~l["status"].isin(*K.DRAFT_STATUSES))),
        ("pointer_without_match", F.exists(labels, lambda l: (l["status"] != "matched") & l["pointer"].isNotNull())),
    )
    return _violations(rows, "record_id", rules)


def _violations(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules)))
    return rows.select(key, F.explode(found).alias("violation"))


def role_overrides(drafts: DataFrame, source_from_client: Sequence[str] = K.SOURCE_FROM_CLIENT_FAMILIES,
                   client_from_source: Sequence[str] = K.CLIENT_FROM_SOURCE_FAMILIES) -> DataFrame:
    """(record_id, target, source_target) for families with a documented role."""
    both = F.array_compact(F.array(
        F.when(F.col("family").isin(*source_from_client), F.struct(F.lit("sourceIp").alias("target"), F.lit("clientIp").alias("source_target"))),
        F.when(F.col("family").isin(*client_from_source), F.struct(F.lit("clientIp").alias("target"), F.lit("sourceIp").alias("source_target"))),
    ))
    return drafts.select("record_id", F.inline(both))


def absent_families(drafts: DataFrame, families: Sequence[str]) -> DataFrame:
    """Listed families that no draft has."""
    listed = drafts.sparkSession.createDataFrame([(f,) for f in families], "family string")
    return listed.join(drafts.select("family").distinct(), "family", "left_anti")


def review_artifact(drafts: DataFrame, tiers: DataFrame, source_from_client: Sequence[str], client_from_source: Sequence[str]) -> DataFrame:
    """One approval row per train or development record."""
    rows = drafts.where(F.col("split").isin("train", "development")).join(tiers, "family", "left")
    upn = F.try_element_at("labels", F.lit("accountUpn"))
    approved = F.col("production_target").isNotNull() & (upn["status"] == "matched")
    findings = F.array_compact(F.array(
        F.concat(F.lit("Reviewed the complete "), "variant_kind", F.lit(" record for "), "family", F.lit(" against "), "provenance_id"),
        F.when(F.col("review_required"), F.concat(F.lit("Ambiguous draft reviewed explicitly: "),
               F.when(F.col("note") != "", F.col("note")).otherwise("one or more draft targets remain unlabelled"))),
        F.when(F.col("family").isin(*source_from_client), "sourceIp is reviewed from the draft clientIp role"),
        F.when(F.col("family").isin(*client_from_source), "clientIp is reviewed from the draft sourceIp role"),
    ))
    return rows.select(
        "record_id", "split", F.lit("approved").alias("status"), findings.alias("findings"),
        F.when(F.col("family").isin(*source_from_client), "sourceIp<-clientIp").when(F.col("family").isin(*client_from_source), "clientIp<-sourceIp").alias("override"),
        F.when(approved, F.col("production_target")).alias("approved_target"),
    )


# --- records ---------------------------------------------------------------------------------
def canonical_struct(**columns: Column) -> Column:
    """Canonical JSON of an object with these members (a NULL member is null)."""
    body = F.struct(*(columns[name].alias(name) for name in sorted(columns)))
    return J.canonical_json(F.to_json(body, {"ignoreNullFields": "false"}), python=True)


def raw_hash(documents: Column) -> Column:
    """Hash of the canonical document list."""
    inner = F.array_join(F.transform(documents, lambda d: J.nested_canonical_json(d, python=True)), ",")
    return F.sha2(F.concat(F.lit("["), inner, F.lit("]")), 256)


def object_hash(**members: Column) -> Column:
    """Hash of an object whose members are given as canonical JSON text."""
    parts = []
    for at, name in enumerate(sorted(members)):
        parts += [F.lit(("," if at else "{") + f'"{name}":'), F.coalesce(members[name], F.lit("null"))]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def with_hashes(records: DataFrame) -> DataFrame:
    """Adds raw_hash, normalized_hash, record_hash and certification_hash.

    ``records`` has sample_id, source_family, split, split_unit, documents
    ARRAY<STRING>, decisions, provenance and review (JSON text each).
    """
    text = {name: J.canonical_json(F.col(name), python=True) for name in ("split_unit", "decisions", "provenance", "review")}
    documents = F.concat(F.lit("["), F.array_join(F.transform("documents", lambda d: J.nested_canonical_json(d, python=True)), ","), F.lit("]"))
    common = dict(
        schemaVersion=F.lit("2"), sampleId=J.json_string(F.col("sample_id")), synthetic=F.lit("true"), sourceFamily=J.json_string(F.col("source_family")),
        split=J.json_string(F.col("split")), splitUnit=text["split_unit"], documents=documents, decisions=text["decisions"],
    )
    hashed = records.withColumn("raw_hash", raw_hash(F.col("documents"))).withColumn("normalized_hash", object_hash(**common))
    hashed = hashed.withColumn("record_hash", object_hash(**common, provenance=text["provenance"]))
    return hashed.withColumn("certification_hash", object_hash(recordHash=J.json_string(F.col("record_hash")), review=text["review"]))


def hash_mismatches(stored: DataFrame, names: Sequence[str] = ("raw_hash", "normalized_hash", "record_hash", "certification_hash")) -> DataFrame:
    """(sample_id, violation) where a stored hash differs from the recomputed one."""
    kept = stored.withColumnsRenamed({name: f"stored_{name}" for name in names})
    fresh = with_hashes(kept)
    return _violations(fresh, "sample_id", [(name, ~F.col(name).eqNullSafe(F.col(f"stored_{name}"))) for name in names])


def record_violations(records: DataFrame, decisions: str = "decisions") -> DataFrame:
    """(sample_id, violation) by the rule table of source records.

    ``records`` has sample_id, schema_version, synthetic, documents, split,
    split_unit STRUCT, provenance MAP, review STRUCT<state, blind, gate, kind,
    model, prompt_hash>, and ``decisions`` MAP<target, STRUCT<state,
    primary_pointer, accepted, value_type, value, hard_negatives, reviewed,
    critical>>. Pointer rules look up the record's own scalars inside the row.
    """
    d = F.col(decisions)
    each = F.map_entries(d)
    kinds = F.map_from_arrays(F.array(*(F.lit(n) for n in K.TARGET_NAMES)), F.array(*(F.lit(K.TARGET_TYPE[n]) for n in K.TARGET_NAMES)))
    # the look-up tables become columns first, so that each is built once per record
    rows = records.withColumn("places", places("documents")).withColumn("_kinds", kinds).withColumn("_each", each)

    def any_decision(rule) -> Column:
        return F.exists("_each", lambda e: F.coalesce(rule(e["key"], e["value"]), F.lit(False)))

    def place(p: Column) -> Column:
        return F.try_element_at("places", p)

    def differs(v: Column) -> Column:
        number = v["value"].try_cast("double")
        return F.exists(v["accepted"], lambda p: place(p).isNull() | (place(p)["vtype"] != v["value_type"]) | F.when(
            v["value_type"] == "number", ~place(p)["number"].eqNullSafe(number)).otherwise(~place(p)["text"].eqNullSafe(v["value"])))

    def unfit(t: Column, pointers: Column) -> Column:
        return F.exists(pointers, lambda p: ~F.coalesce(fits(place(p), F.try_element_at("_kinds", t)), F.lit(False)))

    mapped = lambda v: v["state"] == "mapped"
    accepted = lambda v: F.coalesce(v["accepted"], F.array().cast(STRINGS))
    hard = lambda v: F.coalesce(v["hard_negatives"], F.array().cast(STRINGS))
    review, prov = F.col("review"), F.col("provenance")
    strong = review["gate"].isin("trainingOnly", "releaseCandidate")
    size = F.octet_length(F.array_join(F.transform("documents", lambda d: J.nested_canonical_json(d, python=True)), ",")) + 2
    rules = (
        ("schema", (F.col("schema_version") != 2) | ~F.col("synthetic")),
        ("sample_id", F.coalesce("sample_id", F.lit("")) == ""),
        ("documents", (F.size("documents") < 1) | (F.size("documents") > K.MAX_DOCUMENTS) | (size > K.MAX_DOCUMENT_BYTES)),
        ("split", ~F.col("split").isin(*K.SPLITS)),
        ("split_unit", F.greatest(*(F.coalesce(F.col(f"split_unit.{k}"), F.lit("")) == "" for k in K.GROUP_KEYS))),
        ("provenance_keys", F.size(F.array_except(F.array(*(F.lit(k) for k in K.PROVENANCE_KEYS)), F.map_keys(prov))) > 0),
        ("contract", (prov["targetCatalogVersion"] != K.CONTRACT) | (prov["compilerVersion"] != K.COMPILER_VERSION)),
        ("review_state", F.coalesce((review["state"] != "approved") | ~review["gate"].isin(*K.REVIEW_GATES) | (review["kind"] != "independent-model")
                                    | review["blind"].isNull() | ~review["prompt_hash"].rlike(K.HASH_PATTERN), F.lit(True))),
        ("review_blind", (review["gate"] != "trainingOnly") & ~review["blind"]),
        ("review_model", strong & ~F.startswith(F.lower(review["model"]), F.lit(K.REVIEW_MODEL_PREFIX))),
        ("reviewer_identity", (review["model"] != prov["blindReviewerModel"]) | (review["prompt_hash"] != prov["blindReviewPromptHash"])),
        ("provenance_hash", ~prov["reviewArtifactSha256"].rlike(K.HASH_PATTERN) | ~prov["additionalDraftsSha256"].rlike(K.HASH_PATTERN)),
        ("decision_targets", F.size(F.array_except(F.array(*(F.lit(n) for n in K.TARGET_NAMES)), F.map_keys(d))) + F.size(
            F.array_except(F.map_keys(d), F.array(*(F.lit(n) for n in K.TARGET_NAMES)))) > 0),
        ("decision_state", any_decision(lambda t, v: ~v["state"].isin("mapped", "absent", "unlabelled"))),
        ("accepted_pointers", any_decision(lambda t, v: mapped(v) & (
            (F.size(accepted(v)) == 0) | (F.size(F.array_distinct(accepted(v))) != F.size(accepted(v))) | ~F.array_contains(accepted(v), v["primary_pointer"])))),
        ("resolved_value", any_decision(lambda t, v: mapped(v) & differs(v))),
        ("ineligible", any_decision(lambda t, v: mapped(v) & unfit(t, accepted(v)))),
        ("evidence_without_mapping", any_decision(lambda t, v: ~mapped(v) & ((F.size(accepted(v)) > 0) | v["primary_pointer"].isNotNull() | v["value"].isNotNull()))),
        ("hard_negative", any_decision(lambda t, v: F.arrays_overlap(hard(v), accepted(v)) | unfit(t, hard(v)))),
        ("semantic_review", any_decision(lambda t, v: ((v["state"] == "absent") | (mapped(v) & t.isin(*K.NARRATIVE_TARGETS)) | F.coalesce(v["critical"], F.lit(False))
                                                       | (F.size(accepted(v)) > 1)) & ~F.coalesce(v["reviewed"], F.lit(False)))),
    )
    return _violations(rows, "sample_id", rules)


# --- mechanical scans -----------------------------------------------------------------------
def _unicode(pattern: str) -> str:
    """Word characters and digits as the published rule sees them."""
    return "(?U)" + pattern


def scan_secrets(df: DataFrame, key: str, text: str) -> DataFrame:
    hits = F.array_compact(F.array(*(F.when(F.col(text).rlike(_unicode(p)), F.lit(f"secret_{n}")) for n, p in enumerate(K.SECRET_PATTERNS, 1))))
    return df.select(key, F.explode(hits).alias("code")).withColumn("match", F.lit(""))


def fictional_domain(domain: Column) -> Column:
    value = F.regexp_replace(F.lower(domain), r"\.+$", "")
    return value.isin(*K.FICTIONAL_DOMAINS) | F.greatest(*(F.endswith(value, F.lit("." + d)) for d in K.FICTIONAL_DOMAINS))


def scan_identities(df: DataFrame, key: str, text: str) -> DataFrame:
    """E-mail domains and tenants that are not fictional; (key, code, match) once each."""
    def found(pattern: str, group: int) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(_unicode(pattern)), F.lit(group)), lambda m: F.lower(m)))

    def coded(values: Column, code: str) -> Column:
        return F.transform(values, lambda m: F.struct(F.lit(code).alias("code"), m.alias("match")))

    mails = F.filter(found(K.EMAIL_PATTERN, 1), lambda d: ~fictional_domain(d))
    tenants = F.filter(found(K.TENANT_DOMAIN_PATTERN, 0), lambda m: ~F.substring_index(m, ".onmicrosoft.com", 1).isin(*K.FICTIONAL_TENANTS))
    ids = F.when(F.col(text).rlike(_unicode(K.TENANT_ID_PATTERN)), F.array(F.lit(""))).otherwise(F.array().cast(STRINGS))
    every = F.concat(coded(mails, "email_domain"), coded(tenants, "tenant_domain"), coded(ids, "tenant_id"))
    return df.select(key, F.inline(every))


def ipv4_number(address: Column) -> Column:
    """Dotted text to a number, NULL when it is no address (leading zeros included)."""
    parts = F.split(address, "\\.")
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + F.coalesce(p.try_cast("bigint"), F.lit(0)))
    return F.when(address.rlike(f"^{K.IPV4}$"), value)


def _quiet_v4(number: Column) -> Column:
    def base(text: str) -> int:
        value = 0
        for part in text.split("."):
            value = value * 256 + int(part)
        return value

    return F.greatest(*(
        (number >= base(first)) & (number < base(first) + 2 ** (32 - bits)) for first, bits in K.QUIET_IPV4_NETWORKS
    ))


def _quiet_v6(address: Column) -> Column:
    """Unspecified, loopback, mapped, private, link-local, discard, protocol and documentation ranges."""
    lowered = F.lower(address)
    return lowered.rlike(
        "^(?:::1?|::ffff:.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|100::[^:]*|2002:.*|3fff:0?[0-9a-f]{0,3}:.*|0*64:ff9b:0*1:.*|2001:(?:0*db8|0{0,3}[01]?[0-9a-f]{0,2}):.*|2001::.*)$"
    )


def scan_addresses(df: DataFrame, key: str, text: str, name: str | None = None) -> DataFrame:
    """Address-shaped text that is malformed or routable; (key, code, match) once each.

    ``name`` is the column with the semantic key of the value: dotted versions
    under such a key are no addresses; clock times never are.
    """
    shaped = F.array_distinct(F.concat(
        F.regexp_extract_all(F.col(text), F.lit(_unicode(K.IPV4_SHAPE)), F.lit(0)), F.regexp_extract_all(F.col(text), F.lit(_unicode(K.IPV6_SHAPE)), F.lit(0))))
    tokens = F.filter(shaped, lambda m: ~m.rlike(K.CLOCK_TIME))
    if name is not None:
        version = F.lower(F.coalesce(F.col(name), F.lit(""))).contains("version") & F.col(text).rlike(K.DOTTED_VERSION)
        tokens = F.when(version, F.array().cast(STRINGS)).otherwise(tokens)
    rows = df.select(key, F.explode(tokens).alias("match")).withColumn("number", ipv4_number(F.col("match")))
    valid6 = F.col("match").rlike(f"^{K.IPV6}$")
    code = (
        F.when(F.col("number").isNull() & ~valid6, "invalid_address")
        .when(F.col("number").isNotNull() & ~_quiet_v4(F.col("number")), "routable_address")
        .when(valid6 & ~_quiet_v6(F.col("match")), "routable_address")
    )
    return rows.select(key, code.alias("code"), "match").where("code is not null")


def review_report(records: DataFrame, key: str, findings: DataFrame) -> DataFrame:
    """Per record its distinct findings in order, '' when approved."""
    listed = findings.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", "code", F.when(F.col("match") != "", F.col("match"))))), "; ").alias("findings"))
    return records.select(key).join(listed, key, "left").select(key, F.coalesce("findings", F.lit("")).alias("findings"), F.col("findings").isNull().alias("approved"))


def review_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("records"), F.count_if("approved").alias("approved"), F.count_if(~F.col("approved")).alias("failures"))


# --- traces and items -----------------------------------------------------------------------
def trace_labels(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Gold label of each candidate leaf: positive, hard negative or easy.

    ``decisions`` has (incident_id, target, state, primary_pointer, accepted,
    hard_negatives); unlabelled targets leave no trace.
    """
    rows = candidates.join(decisions.where("state <> 'unlabelled'"), ["incident_id", "target"])
    positive = F.coalesce(F.array_contains("accepted", F.col("pointer")), F.lit(False))
    hard = F.coalesce(F.array_contains("hard_negatives", F.col("pointer")), F.lit(False))
    return rows.withColumn("positive", positive).withColumn("label", F.when(positive, "positive").when(hard, "hard").otherwise("easy"))


def gold_choices(labelled: DataFrame) -> DataFrame:
    """Per (incident, target): the primary candidate, else the best accepted, else none."""
    order = F.struct((F.col("pointer") != F.col("primary_pointer")).cast("int").alias("a"), (-F.col("score")).alias("b"), "pointer")
    return labelled.groupBy("incident_id", "target").agg(F.min_by("leaf_id", F.when(F.col("positive"), order)).alias("choice")).withColumn(
        "choice", F.coalesce("choice", F.lit(K.NONE)))


def compile_items(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, refused): a training label per window.

    ``windows`` has sample_id, target, pointer, label (of the leaf),
    start_token, end_token, total_windows and reviewed ARRAY<STRUCT<start_token,
    end_token>>. A positive of several windows needs reviewed ones.
    """
    positive = F.col("label") == "positive"
    listed = F.exists(F.coalesce("reviewed", F.expr("cast(array() as array<struct<start_token:int,end_token:int>>)")),
                      lambda w: (w["start_token"] == F.col("start_token")) & (w["end_token"] == F.col("end_token")))
    refused = positive & (F.col("total_windows") > 1) & (F.coalesce(F.size("reviewed"), F.lit(0)) <= 0)
    window_label = F.when(positive & ((F.col("total_windows") == 1) | listed), "positive").when(F.col("label") == "hard", "hard").otherwise("easy")
    rows = windows.withColumn("_refused", refused).withColumn("item_label", window_label)
    identity = canonical_struct(sampleId=F.col("sample_id"), target=F.col("target"), pointer=F.col("pointer"), startToken=F.col("start_token"),
                                endToken=F.col("end_token"), label=(F.col("item_label") == "positive").cast("int"))
    items = rows.where(~F.col("_refused")).withColumn("vector", F.when(F.col("item_label") == "positive", F.array(F.lit(0.0), F.lit(1.0))).otherwise(
        F.array(F.lit(1.0), F.lit(0.0)))).withColumn("label_index", (F.col("item_label") == "positive").cast("int")).withColumn("item_hash", F.sha2(identity, 256))
    refused_rows = rows.where("_refused").select("sample_id", "target", "pointer").distinct()
    return items.drop("_refused", "label", "reviewed"), refused_rows


def pilot_check(approved: DataFrame, pilot: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, problem) where the approved ids are not exactly the pilot's."""
    extra = approved.select(key).exceptAll(pilot.select(key)).withColumn("problem", F.lit("not_in_pilot"))
    lacking = pilot.select(key).exceptAll(approved.select(key)).withColumn("problem", F.lit("not_approved"))
    return extra.unionByName(lacking)


def decision_counts(decisions: DataFrame) -> DataFrame:
    """(measure, n) that a reviewed pilot is compared by."""
    direct = F.col("target").isin(*(name for name, _ in K.DIRECT_TARGETS))
    identity = F.col("target").isin("clientUserName", "sourceUsername")
    counts = decisions.agg(
        F.count_if(direct).alias("direct_decisions"), F.count_if(direct & (F.col("state") == "mapped")).alias("direct_positive"),
        F.count_if(direct & (F.col("state") == "absent")).alias("direct_none"), F.count_if(identity & (F.col("state") == "mapped")).alias("identity_positive"),
    )
    return counts.unpivot([], counts.columns, "measure", "n")
