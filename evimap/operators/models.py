"""Hooks for user models: scorers, enrichers and mappers, each behind a contract that fails closed.

A scorer or enricher is opened once per worker and sees micro-batches; what it can't
answer becomes a ``failure`` of its own row. A mapper is a DataFrame function; what it
leaves out or says twice unmaps the incident with a warning, never the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap import constants as K
from evimap.operators import candidates as C
from evimap.operators import mapping

#: texts in, one answer per text out
Model = Callable[[list[str]], Sequence]

_open: dict[str, Model] = {}  # models of this worker, by name


def opened(name: str, load: Callable[[], Model]) -> Model:
    """The worker's model of that name; ``load`` runs at the first use in a worker."""
    if name not in _open:
        _open[name] = load()
    return _open[name]


def _asked(model: Model, texts: list[str], kind: type) -> list[tuple[object, str]]:
    """(answer, failure) of each text; a micro-batch that fails is asked text by text."""
    try:
        given = [None if a is None else kind(a) for a in model(texts)]
        if len(given) != len(texts):
            raise ValueError(f"{len(given)} answers for {len(texts)} texts")
    except Exception as error:  # user code: its row fails, the job goes on
        if len(texts) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        return [pair for text in texts for pair in _asked(model, [text], kind)]
    return [(a, "" if a is not None else "no_answer") for a in given]


def answer_with(rows: DataFrame, text: str, name: str, load: Callable[[], Model], answer: str = "answer", kind: type = str, batch_rows: int = 64) -> DataFrame:
    """``rows`` with the model's ``answer`` (text, or double with ``kind=float``) and ``failure``, each row once.

    Rows of an Arrow batch are put to the model by length, ``batch_rows`` at a time, so
    texts of one micro-batch need little padding. A null text is an empty one. A model that
    cannot be opened fails the job; one that fails on a text fails its row.
    """
    if {answer, "failure"} & set(rows.columns):
        raise ValueError(f"columns {answer} and failure are added, they may not stand in the input")
    schema = T.StructType([*rows.schema.fields, T.StructField(answer, T.DoubleType() if kind is float else T.StringType()), T.StructField("failure", T.StringType())])
    made = pa.float64() if kind is float else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(name, load)
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            found: list[tuple] = [(None, "")] * len(texts)
            for at in range(0, len(order), batch_rows):
                part = order[at : at + batch_rows]
                for i, pair in zip(part, _asked(model, [texts[i] for i in part], kind), strict=True):
                    found[i] = pair
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in found], made), pa.array([f for _, f in found], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def score_with(windows: DataFrame, name: str, load: Callable[[], Model], text: str = "evidence", batch_rows: int = 64) -> tuple[DataFrame, DataFrame]:
    """(scored windows, violations) of a model scorer.

    ``windows`` has (incident_id, target, leaf_id, start_token, end_token, total_tokens) and the text to
    score. Scored: with ``score`` and ``failure``. Violations: the decisions that cannot be used, as
    :func:`candidates.invalid_scores` names them; :func:`contest.fail_closed` takes them. The model runs once
    for each of the two results; write the first and call :func:`refused` where it is dear.
    """
    scored = answer_with(windows, text, name, load, "score", float, batch_rows)
    return scored, refused(windows, scored)


def refused(windows: DataFrame, scored: DataFrame) -> DataFrame:
    """Decisions of ``windows`` whose scores are missing, doubled, out of range or for other windows."""
    key = ["incident_id", "target", "leaf_id"]
    told = scored.withColumn("item_score", F.max("score").over(Window.partitionBy(*key)))
    return C.invalid_scores(windows.select(*key).distinct(), told)


def enrich_with(evidence_rows: DataFrame, text: str, name: str, load: Callable[[], Model], batch_rows: int = 8) -> DataFrame:
    """(ticket_id, answer, failure) of an enricher over evidence texts; ``extraction.validate_enrichment`` judges the answers.

    A failed text has a null answer, which the check refuses as ``not_json``.
    """
    return answer_with(evidence_rows.select(F.col("incident_id").alias("ticket_id"), F.col(text).alias("__text")), "__text", name, load, "answer", str, batch_rows).drop("__text")


STATUSES = ("selected", "tentative", "no_supported_match")
#: columns of a mapper's result beside incident_id
MAPPER_COLUMNS = ("target", "status", "value", "failure")


def mapper_verdicts(incidents: DataFrame, answers: DataFrame, targets: Sequence[str] = K.TARGET_NAMES) -> DataFrame:
    """(incident_id, violation) of each incident: '' or the first rule its answers break.

    One row for each of ``targets``, no other target, a known status, a value exactly where one is
    selected or tentative. The mapper's own ``failure`` comes before all.
    """
    known = F.coalesce(F.col("target").isin(*targets), F.lit(False))
    status_ok = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    value_ok = F.coalesce(F.col("value"), F.lit("")) != ""
    per_target = answers.groupBy("incident_id", "target").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.coalesce("failure", F.lit("")) != "", F.col("failure"))).alias("failure"),
        F.bool_and(status_ok).alias("status_ok"), F.bool_and((F.col("status") != "no_supported_match") == value_ok).alias("value_ok"))
    facts = per_target.groupBy("incident_id").agg(
        F.min("failure").alias("failure"), F.bool_or(~known).alias("unknown"), F.max("n").alias("most"), F.count_if(known).alias("told"),
        F.bool_and("status_ok").alias("status_ok"), F.bool_and(F.coalesce("value_ok", F.lit(False))).alias("value_ok"))
    violation = (
        F.when(F.col("told").isNull(), "omitted_target").when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("unknown"), "unknown_target")
        .when(F.col("most") > 1, "duplicate_target").when(F.col("told") < len(set(targets)), "omitted_target")
        .when(~F.col("status_ok"), "invalid_status").when(~F.col("value_ok"), "invalid_value").otherwise("")
    )
    return incidents.select("incident_id").distinct().join(facts, "incident_id", "left").select("incident_id", violation.alias("violation"))


def map_with(incidents: DataFrame, docs: DataFrame, mapper: Callable[[DataFrame], DataFrame], targets: Sequence[str] = K.TARGET_NAMES) -> DataFrame:
    """``incidents`` with the values that a user's mapper selects, ``mapped``, ``tentative`` and ``warning``.

    ``mapper(docs)`` gives (incident_id, target, status, value, failure); other columns are ignored, missing ones
    raise at once. An incident whose answers break a rule keeps its own values, is not mapped and says so in its
    warning. Answers for unknown incidents are dropped.
    """
    answers = mapper(docs)
    missing = [c for c in ("incident_id", *MAPPER_COLUMNS) if c not in answers.columns]
    if missing:
        raise ValueError(f"the mapper's result lacks {', '.join(missing)}")
    answers = answers.select("incident_id", *(F.col(c).cast("string").alias(c) for c in MAPPER_COLUMNS))
    verdicts = mapper_verdicts(incidents, answers, targets)
    sound = answers.join(verdicts.where("violation = ''"), "incident_id", "left_semi").drop("failure").withColumn("complete", F.lit(True))
    applied = mapping.apply_mapping(incidents, sound, targets).join(verdicts, "incident_id", "left")
    unsure = F.filter(F.split("tentative", ", "), lambda x: x != "")
    return applied.withColumn("warning", mapping.mapping_warnings(F.lit(True), F.col("violation"), unsure)).drop("violation")
