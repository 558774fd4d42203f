"""Scoring mapping results against reviewed labels, comparing runs, the promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimap import constants as K
from evimap.sources.records import folded_digest

CASE = ("case_id", "target")


def outcomes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One judged row per answer.

    ``expected`` has (case_id, target, state, preferred, accepted ARRAY,
    expected_value); an unlabelled target is kept with ``scored`` FALSE.
    """
    joined = actual.join(expected, list(CASE))
    mapped, absent = F.col("state") == "mapped", F.col("state") == "absent"
    none = F.col("actual").isNull()
    correct = F.coalesce(F.array_contains("accepted", F.col("actual")) | (F.col("actual") == F.col("preferred")), F.lit(False))
    no_match = none & (F.col("status") == "no_supported_match")

    def scored(mapped_rule: Column, absent_rule: Column) -> Column:
        return F.when(mapped, mapped_rule).when(absent, absent_rule)

    return joined.select(
        "*", (F.col("state") != "unlabelled").alias("scored"),
        scored(F.coalesce(F.col("actual") == F.col("preferred"), F.lit(False)), no_match).alias("exact"),
        scored(correct, no_match).alias("accepted_answer"),
        scored(~none & F.coalesce(F.col("value") == F.col("expected_value"), F.lit(False)), no_match).alias("value_correct"),
        scored(~none & ~correct, ~none).alias("wrong"),
        scored(none, F.lit(False)).alias("missed"),
        scored(F.lit(False), ~none).alias("false_absent"),
    )


COUNTED = {
    "exact": "exact", "accepted": "accepted_answer", "values_correct": "value_correct", "wrong": "wrong", "missed": "missed",
    "false_absent": "false_absent", "disagreements": "disagreement",
}


def metrics(judged: DataFrame, by: str = "experiment") -> DataFrame:
    """Counts per experiment and overall ('all'), by one rollup.

    Case-level figures (incomplete, elapsed, eligible, assessed) are taken once
    per (case, experiment, run), whatever its number of targets.
    """
    scored = judged.where("scored")
    counted = [F.count_if(F.col(column)).alias(name) for name, column in COUNTED.items()]
    tentative = F.col("status") == "tentative"
    targets = scored.rollup(by).agg(
        F.count(F.lit(1)).alias("targets"), *counted, F.count_if(tentative).alias("tentative"),
        F.count_if(tentative & F.col("accepted_answer")).alias("tentative_accepted"),
        F.count_if(F.col("value_agreement") == "disagreed").alias("value_disagreements"),
    )
    cases = judged.groupBy("case_id", by, "run").agg(
        F.bool_and("complete").alias("complete"), F.max("total_ms").alias("ms"), F.sum("eligible").alias("eligible"), F.sum("assessed").alias("assessed")
    ).rollup(by).agg(
        F.count_if(~F.col("complete")).alias("incomplete_runs"), F.sum("ms").alias("elapsed_ms"),
        F.sum("eligible").alias("eligible"), F.sum("assessed").alias("final_assessed"),
    )
    name = F.coalesce(F.col(by), F.lit("all"))
    return targets.withColumn(by, name).join(cases.withColumn(by, name), by)


def subgroup_accuracy(predictions: DataFrame) -> DataFrame:
    """correct / sequences by phase, answer, target, family and overall, in one pass.

    ``predictions`` has (phase, answer, target, family, correct BOOLEAN).
    """
    dims = ["phase", "answer", "target", "family"]
    folded = predictions.groupingSets([[d] for d in dims] + [[]], *dims).agg(
        F.grouping_id(*dims).alias("g"), F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("sequences")
    )
    subgroup = F.lit("all")
    for at, name in enumerate(dims):
        subgroup = F.when(F.col("g") == 15 - (8 >> at), name).otherwise(subgroup)
    return folded.select(
        subgroup.alias("subgroup"), F.coalesce(*dims, F.lit("all")).alias("key"), "correct", "sequences",
        (F.col("correct") / F.col("sequences")).alias("accuracy"),
    )


def warm_performance(cases: DataFrame, by: str = "experiment") -> DataFrame:
    return cases.where("runtime_state = 'warm'").groupBy(by).agg(F.avg("total_ms").alias("mean_ms"), F.max("peak_bytes").alias("peak_bytes"))


def case_target_hash(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Order-free digest of which targets each case has."""
    by = by or []
    per_case = cases.groupBy(*by, "case_id").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    entry = F.concat(F.lit('{"id":"'), F.col("case_id").cast("string"), F.lit('","targets":["'), F.array_join("targets", '","'), F.lit('"]}'))
    return folded_digest(per_case.select(*by, F.sha2(entry, 256).alias("h")), by).withColumnRenamed("records", "cases")


def nondeterministic(answers: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose runs do not all give one output."""
    output = F.struct(F.coalesce("actual", F.lit("")), F.col("actual").isNull(), F.col("status"))
    folded = answers.groupBy(*key).agg(F.min(output).alias("least"), F.max(output).alias("most"), F.count(F.lit(1)).alias("runs"))
    return folded.where("least <> most").select(*key, "runs")


# --- comparing runs --------------------------------------------------------------------
def compare_runs(base: DataFrame, candidate: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join of two experiments; ``side`` tells where a row is missing."""
    def renamed(frame: DataFrame, prefix: str) -> DataFrame:
        return frame.select(*key, *(F.col(c).alias(f"{prefix}_{c}") for c in ("actual", "accepted_answer", "value_correct")), F.lit(True).alias(f"in_{prefix}"))

    both = renamed(base, "before").join(renamed(candidate, "after"), key, "full_outer")
    side = F.when(F.col("in_before").isNull(), "only_after").when(F.col("in_after").isNull(), "only_before").otherwise("both")
    return both.withColumn("side", side).drop("in_before", "in_after")


def changes(base: DataFrame, candidate: DataFrame, key: list[str]) -> DataFrame:
    """Pointer and value gains and regressions of the candidate."""
    rows = compare_runs(base, candidate, key).where("side = 'both'")
    kinds = F.array_compact(F.array(
        F.when(~F.col("before_accepted_answer") & F.col("after_accepted_answer"), F.lit("pointer_gain")),
        F.when(F.col("before_accepted_answer") & ~F.col("after_accepted_answer"), F.lit("pointer_regression")),
        F.when(~F.col("before_value_correct") & F.col("after_value_correct"), F.lit("value_gain")),
        F.when(F.col("before_value_correct") & ~F.col("after_value_correct"), F.lit("value_regression")),
    ))
    return rows.select(*key, F.col("before_actual").alias("before"), F.col("after_actual").alias("after"), F.explode(kinds).alias("change"))


def metric_drift(reported: DataFrame, recomputed: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, metric, reported, recomputed) wherever they differ or one is missing."""
    def long(frame: DataFrame, name: str) -> DataFrame:
        return frame.unpivot(key, names, "metric", name)

    both = long(reported, "reported").join(long(recomputed, "recomputed"), [key, "metric"], "full_outer")
    return both.where(~F.col("reported").eqNullSafe(F.col("recomputed")))


def missing_runs(cases: DataFrame, present: DataFrame, experiments: list[str], runs: int) -> DataFrame:
    """(case_id, experiment, run, problem): planned runs that lack or repeat.

    The plan is a fixed array per case, so it is unfolded, not crossed.
    """
    plan = cases.select("case_id").distinct().withColumn("experiment", F.explode(F.array(*(F.lit(e) for e in experiments)))).withColumn(
        "run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("planned", F.lit(True))
    seen = present.groupBy("case_id", "experiment", "run").agg(F.count(F.lit(1)).alias("n"))
    both = plan.join(seen, ["case_id", "experiment", "run"], "full_outer")
    problem = F.when(F.col("planned").isNull(), "unplanned").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicated")
    return both.select("case_id", "experiment", "run", problem.alias("problem")).where("problem is not null")


def coverage_failures(coverage: DataFrame) -> DataFrame:
    """(incident, target) rows whose scored, assessed and eligible counts differ."""
    return coverage.where((F.col("scored") != F.col("eligible")) | (F.col("assessed") != F.col("eligible")))


def identity_mismatch(reports: DataFrame, parts: list[str], by: str | None = None) -> DataFrame:
    """Identity parts in which the reports (of a group) do not all agree."""
    folded = reports.groupBy(*([by] if by else [])).agg(*(
        (F.min(F.coalesce(p, F.lit(""))) != F.max(F.coalesce(p, F.lit("")))).alias(p) for p in parts
    ))
    names = F.array_compact(F.array(*(F.when(F.col(p), F.lit(p)) for p in parts)))
    return folded.select(*([by] if by else []), F.explode(names).alias("part"))


def training_complete(runs: DataFrame) -> DataFrame:
    """Adds ``complete`` and the first broken rule of a training run."""
    rules = (
        ("steps", F.col("optimizer_steps") == F.col("expected_steps")),
        ("epochs", F.col("epochs") == F.col("planned_epochs")),
        ("reload_choices", F.col("choices_equal")), ("reload_finite", F.col("finite_state")),
        ("reload_drift", F.col("max_logit_delta") == 0), ("probe_count", F.col("probe_sequences") == F.col("development_sequences")),
        ("promotion_flag", ~F.col("promotion_eligible")),
    )
    broken = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        broken = F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(broken)
    return runs.withColumn("broken_rule", broken).withColumn("complete", broken.isNull())


# --- promotion ----------------------------------------------------------------------------
def gate_failures(gate: DataFrame) -> DataFrame:
    """Rule table over one row per candidate: (candidate, failure).

    Columns: fixed_* and robust_* counts of the candidate, base_* of the base,
    new_wrong, unassessed_correct, signin_targets, signin_accepted,
    signin_customer_none, frozen_*, base_frozen_*, reload_passes,
    reload_equal, mean_ms, base_mean_ms, peak_bytes, base_peak_bytes and
    ``allowed``: resources a review has excepted (warmTime, peakRam).
    """
    c = F.col

    def slower(name: str, allowed: str) -> Column:
        return (c(f"base_{name}") > 0) & (c(name) > c(f"base_{name}") * K.GATE_RESOURCE_RATIO) & ~F.array_contains("allowed", allowed)

    rules = (
        ("frozen_incomplete", (c("frozen_incomplete") != 0) | (c("frozen_coverage_failures") != 0)),
        ("reload_not_equal", ~c("reload_equal") | (c("reload_passes") < 2)),
        ("frozen_regression", c("frozen_accepted") < c("base_frozen_accepted")),
        ("frozen_false_absent", c("frozen_false_absent") > c("base_frozen_false_absent")),
        ("fixed_accepted", (c("fixed_targets") != K.GATE_FIXED_TARGETS) | (c("fixed_accepted") < K.GATE_FIXED_ACCEPTED)),
        ("fixed_false_absent", c("fixed_false_absent") > K.GATE_FALSE_ABSENT),
        ("false_absent_not_reduced", (c("base_fixed_false_absent") > 0) & (c("fixed_false_absent") >= c("base_fixed_false_absent"))),
        ("fixed_incomplete", c("fixed_incomplete") != 0),
        ("robustness", (c("robust_targets") != K.GATE_ROBUST_TARGETS) | (c("robust_accepted") < K.GATE_ROBUST_ACCEPTED) | (c("robust_incomplete") != 0)),
        ("new_wrong", c("new_wrong") > 0),
        ("correct_not_assessed", c("unassessed_correct") > 0),
        ("order_disagreement", (c("fixed_disagreements") > c("base_fixed_disagreements")) & (c("fixed_accepted") <= c("base_fixed_accepted"))),
        ("signin_case", (c("signin_targets") != K.GATE_SIGNIN_TARGETS) | (c("signin_accepted") != c("signin_targets"))),
        ("signin_customer", ~c("signin_customer_none")),
        ("no_measurements", (c("mean_ms") <= 0) | (c("base_mean_ms") <= 0) | (c("peak_bytes") <= 0) | (c("base_peak_bytes") <= 0)),
        ("warm_time", slower("mean_ms", "warmTime")),
        ("peak_ram", slower("peak_bytes", "peakRam")),
    )
    failed = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules)))
    return gate.select("candidate", F.explode(failed).alias("failure"))


def eligible_candidates(gate: DataFrame, failures: DataFrame) -> DataFrame:
    """(candidate, eligible, failures, fallback)."""
    listed = failures.groupBy("candidate").agg(F.array_join(F.array_sort(F.collect_set("failure")), ",").alias("failures"))
    joined = gate.select("candidate").join(listed, "candidate", "left")
    good = F.col("failures").isNull()
    return joined.select("candidate", good.alias("eligible"), F.coalesce("failures", F.lit("")).alias("failures"),
                         F.when(good, "candidate-may-enter-manual-promotion-review").otherwise("ship-pinned-base-assets").alias("fallback"))


# --- ranks ---------------------------------------------------------------------------------
def rank_of(scored: DataFrame, expected: DataFrame) -> DataFrame:
    """1-based rank of the expected pointer among the candidates of its target.

    Counted, not sorted: the rank is one plus the candidates that come before.
    """
    own = scored.join(expected, ["incident_id", "target"]).where(F.col("pointer") == F.col("preferred")).select(
        "incident_id", "target", F.col("score").alias("own_score"), F.col("pointer").alias("own_pointer")
    )
    before = (F.col("score") > F.col("own_score")) | ((F.col("score") == F.col("own_score")) & (F.col("pointer") < F.col("own_pointer")))
    return scored.join(own, ["incident_id", "target"]).groupBy("incident_id", "target").agg((F.count_if(before) + 1).alias("rank"))


def prediction_rows(judged: DataFrame) -> DataFrame:
    """Judged answers in the shape :func:`subgroup_accuracy` reads."""
    return judged.where("scored").select(
        F.lit("selection").alias("phase"), F.when(F.col("state") == "mapped", "positive").otherwise("none").alias("answer"),
        "target", "family", F.col("accepted_answer").alias("correct"),
    )


def ranked_window(df: DataFrame, keys: list[str], order: list, k: int, predicate: Column | None = None) -> DataFrame:
    """First k rows per key in an order, filtered before ranking."""
    rows = df if predicate is None else df.where(predicate)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
