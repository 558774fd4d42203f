"""Selection by a chooser that is user code: two ordered passes, adjudication, a record of every comparison.

A pass is an ordered fold. Rows stream through it sorted by group and rank; between Arrow
batches it keeps one group's open comparison, at most ``bucket`` candidates, so a group may be larger
than a batch or than memory. A chooser that fails, or answers against the contract, fails its
group and no other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap import constants as K
from evimap.operators.mapping import with_status
from evimap.session import checkpoint_root

FIELDS = ("leaf_id", "pointer", "identity", "score")
ENTRY = "struct<leaf_id:string,pointer:string,identity:string,score:double>"


@dataclass(frozen=True)
class Choice:
    """A chooser's answer: the id of a candidate or None, how many candidates it looked at (all if None), and optionally each one's probability (K.NONE among them)."""

    choice: str | None
    consumed: int | None = None
    probabilities: dict[str, float] | None = None


Chooser = Callable[[str, list[dict]], Choice]


def fault(answer: Choice, shown: list[dict]) -> str:
    """'' or what is wrong with an answer about ``shown``."""
    looked = len(shown) if answer.consumed is None else answer.consumed
    if not min(2, len(shown)) <= looked <= len(shown):
        return "no_progress"
    options = [c["leaf_id"] for c in shown[:looked]] + [K.NONE]
    picked, odds = answer.choice or K.NONE, answer.probabilities
    if picked not in options:
        return "unknown_choice"
    if odds is None:
        return ""
    if set(odds) != set(options) or any(not math.isfinite(p) or not 0 <= p <= 1 for p in odds.values()) or abs(sum(odds.values()) - 1) > 0.002:
        return "invalid_distribution"
    return "" if odds[picked] >= max(odds.values()) else "choice_not_maximal"


@dataclass
class Group:
    """One group's state in a pass: the champion, who waits to meet it, and what was compared."""

    target: str
    chooser: Chooser
    champion: dict | None = None
    waiting: list[dict] = field(default_factory=list)
    met: list[tuple[list[str], str]] = field(default_factory=list)
    failure: str = ""

    def compare(self, shown: list[dict]) -> int:
        """Ask the chooser; its pick is the champion. How many were looked at."""
        try:
            answer = self.chooser(self.target, shown)
            self.failure = fault(answer, shown)
        except Exception as error:  # user code: its group fails, the job goes on
            self.failure = f"chooser_failed: {error}"
        if self.failure:
            return 0
        looked = len(shown) if answer.consumed is None else answer.consumed
        self.met.append(([c["leaf_id"] for c in shown[:looked]], answer.choice or K.NONE))
        self.champion = next((c for c in shown[:looked] if c["leaf_id"] == answer.choice), None)
        return looked

    def settle(self, least: int, bucket: int) -> None:
        """Compare as long as ``least`` candidates or more stand, the champion counted, and one of them waits."""
        while self.waiting and not self.failure:
            held = [] if self.champion is None else [self.champion]
            if len(held) + len(self.waiting) < least:
                return
            shown = held + self.waiting[: bucket - len(held)]
            self.waiting = self.waiting[max(0, self.compare(shown) - len(held)) :]


def _batches(rows: Iterator[tuple], schema: T.StructType, arrow: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)


def _schema(df: DataFrame, keys: list[str], added: str) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(added).fields])


def _run(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """``fn`` from a task's rows to rows of ``schema``, streamed by batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(fn(row for batch in batches for row in batch.to_pylist()), schema, arrow)

    return df.mapInArrow(run, schema)


def one_pass(pool: DataFrame, keys: list[str], chooser: Chooser, label: str, backwards: bool = False, bucket: int = K.BUCKET) -> DataFrame:
    """(keys, pass, step, candidates, choice, last, winner, failure): the comparisons of each group, the last one with the outcome."""
    order = [F.asc("score"), F.desc("pointer")] if backwards else [F.desc("score"), F.asc("pointer")]
    rows = pool.select(*keys, *(F.col(c) if c != "score" else F.col(c).cast("double").alias(c) for c in FIELDS))
    # by a column of its own: a partitioning by the keys, left over from a join, may be given up when that join is planned anew
    ranked = rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    schema = _schema(ranked, keys, f"pass string, step int, candidates array<string>, choice string, last boolean, winner {ENTRY}, failure string")

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        current, group, told = None, None, 0

        def report(done: bool) -> Iterator[tuple]:
            nonlocal told
            for candidates, choice in group.met:
                yield (*current, label, told, candidates, choice, False, None, "")
                told += 1
            group.met = []
            if done:
                yield (*current, label, told, None, None, True, None if group.failure else group.champion, group.failure)

        for row in rows:
            key = tuple(row[k] for k in keys)
            if key != current:
                if group:
                    group.settle(1, bucket)
                    yield from report(True)
                current, group, told = key, Group(row["target"], chooser), 0
            if not group.failure:
                group.waiting.append({c: row[c] for c in FIELDS})
                group.settle(bucket, bucket)
                yield from report(False)
        if group:
            group.settle(1, bucket)
            yield from report(True)

    return _run(ranked, fold, schema)


def _adjudicated(split: DataFrame, keys: list[str], chooser: Chooser, label: str) -> DataFrame:
    """Both orders of two nominees (one may be missing) put to the chooser; votes, then score, then pointer decide."""
    schema = _schema(split, keys, f"met array<struct<candidates:array<string>,choice:string>>, settled {ENTRY}, fault string")

    def judge(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            nominees = [c for c in (row["forward"], row["reverse"]) if c]
            group, votes = Group(row["target"], chooser), {c["leaf_id"]: 0 for c in nominees}
            for shown in (nominees, nominees[::-1]):
                if not group.failure and group.compare(shown) != len(shown) and not group.failure:
                    group.failure = "nominees_not_compared"
                if not group.failure and group.champion:
                    votes[group.champion["leaf_id"]] += 1
            best = min(nominees, key=lambda c: (-votes[c["leaf_id"]], -c["score"], c["pointer"]))
            yield (*(row[k] for k in keys), [{"candidates": c, "choice": x} for c, x in group.met], None if group.failure else best, group.failure)

    return _run(split.select(*keys, "forward", "reverse"), judge, schema)


def decide(pool: DataFrame, keys: list[str], chooser: Chooser, prefix: str = "", bucket: int = K.BUCKET) -> tuple[DataFrame, DataFrame]:
    """Forward pass, reverse pass and adjudication of each group: (outcomes, comparisons).

    Outcomes: keys, forward, reverse, selected, disagreement, value_agreed, failure.
    """
    checkpoint_root(pool.sparkSession)
    passes = one_pass(pool, keys, chooser, prefix + "forward", False, bucket).union(one_pass(pool, keys, chooser, prefix + "reverse", True, bucket)).checkpoint()
    ends = passes.where("last")
    of = lambda name: F.max_by("winner", F.col("pass") == prefix + name)
    both = ends.groupBy(*keys).agg(of("forward").alias("forward"), of("reverse").alias("reverse"), F.max("failure").alias("failure"))
    same = F.coalesce("forward.leaf_id", F.lit("")) == F.coalesce("reverse.leaf_id", F.lit(""))
    both = both.withColumn("disagreement", ~same & (F.col("failure") == ""))
    judged = _adjudicated(both.where("disagreement"), keys, chooser, prefix).checkpoint()
    found = both.join(judged, keys, "left")
    failure = F.when(F.col("failure") != "", F.col("failure")).otherwise(F.coalesce("fault", F.lit("")))
    agreed = F.when(F.col("forward").isNotNull() & F.col("reverse").isNotNull(), F.col("forward.identity") == F.col("reverse.identity")).otherwise(
        F.col("forward").isNull() & F.col("reverse").isNull())
    outcomes = found.select(*keys, "forward", "reverse", F.when(failure == "", F.when(F.col("disagreement"), F.col("settled")).otherwise(F.col("forward"))).alias("selected"),
                            "disagreement", agreed.alias("value_agreed"), failure.alias("failure"))
    met = judged.select(*keys, F.lit(prefix + "adjudication").alias("pass"), F.posexplode("met").alias("step", "m")).select(*keys, "pass", "step", "m.candidates", "m.choice")
    return outcomes, passes.where("not last").select(*keys, "pass", "step", "candidates", "choice").union(met)


def select_with(scored: DataFrame, chooser: Chooser, group_values: bool = True, bucket: int = K.BUCKET) -> tuple[DataFrame, DataFrame]:
    """The outcome of each (incident, target) and every comparison that led to it.

    ``scored`` has (incident_id, target, leaf_id, pointer, identity, score). With ``group_values``
    the leaves of one value first choose a representative; a value that no one endorses keeps its
    best-ranked leaf and makes the outcome tentative. A failed group makes its target ``incomplete``.
    """
    pair = ["incident_id", "target"]
    # read by every pass and join below: kept once, thin, instead of walking the documents again for each
    checkpoint_root(scored.sparkSession)
    scored = scored.select(*pair, *FIELDS).checkpoint()
    if group_values:
        keys = [*pair, "identity_key"]
        pool = scored.select(*pair, F.sha2("identity", 256).alias("identity_key"), *FIELDS)
        sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.min(F.struct((-F.col("score")).alias("down"), "pointer", "leaf_id", "identity", "score")).alias("top"))
        first = F.struct(*(F.col(f"top.{c}").cast("double" if c == "score" else "string").alias(c) for c in FIELDS)).alias("first")
        outcomes, within = decide(pool.join(sizes.where("members > 1").select(*keys), keys, "left_semi"), keys, chooser, "aliases:", bucket)
        groups = sizes.select(*keys, first).join(outcomes.select(*keys, "selected", "disagreement", F.col("failure"), F.lit(True).alias("asked")), keys, "left")
        groups = groups.select(*keys, F.coalesce("selected", "first").alias("kept"), (F.col("selected").isNotNull() | F.col("asked").isNull()).alias("endorsed"),
                               F.coalesce("disagreement", F.lit(False)).alias("contested"), F.coalesce("failure", F.lit("")).alias("failure")).checkpoint()
        pool = groups.select(*pair, "kept.*")
        found, final = decide(pool, pair, chooser, "", bucket)
        traits = groups.select(*pair, F.col("kept.leaf_id").alias("leaf_id"), "endorsed", "contested")
        broken = groups.groupBy(*pair).agg(F.max("failure").alias("broken"))
        found = found.withColumn("leaf_id", F.col("selected.leaf_id")).join(traits, [*pair, "leaf_id"], "left").drop("leaf_id").join(broken, pair, "left")
        comparisons = within.withColumn("group_id", F.concat(F.lit("g"), F.substring("identity_key", 1, 20))).select(*pair, "group_id", "pass", "step", "candidates", "choice") \
            .union(final.select(*pair, F.lit("").alias("group_id"), "pass", "step", "candidates", "choice"))
    else:
        found, final = decide(scored, pair, chooser, "", bucket)
        found = found.withColumns({"endorsed": F.lit(True), "contested": F.lit(False), "broken": F.lit("")})
        comparisons = final.select(*pair, F.lit("").alias("group_id"), "pass", "step", "candidates", "choice")
    failure = F.greatest("failure", F.coalesce("broken", F.lit("")))
    rows = with_status(found.select(
        *pair, F.when(failure == "", F.col("selected.pointer")).alias("pointer"), "selected.leaf_id", "selected.identity", "selected.score",
        F.coalesce("forward.leaf_id", F.lit(K.NONE)).alias("forward"), F.coalesce("reverse.leaf_id", F.lit(K.NONE)).alias("reverse"),
        "disagreement", "value_agreed", F.coalesce("contested", F.lit(False)).alias("contested"), F.coalesce("endorsed", F.lit(True)).alias("endorsed"), failure.alias("failure")))
    return closed(rows), comparisons


def closed(selected: DataFrame) -> DataFrame:
    """Outcomes with a ``failure`` are ``incomplete`` and select nothing."""
    bad = F.col("failure") != ""
    none = {c: F.when(~bad, F.col(c)) for c in ("pointer", "leaf_id", "identity", "score") if c in selected.columns}
    return selected.withColumns({**none, "status": F.when(bad, "incomplete").otherwise(F.col("status")),
                                 "value_agreement": F.when(bad, "none").otherwise(F.col("value_agreement")), "pointer_agreement": F.when(bad, "none").otherwise(F.col("pointer_agreement"))})


def fail_closed(mapped: DataFrame, violations: DataFrame) -> DataFrame:
    """``mapped`` (one row per incident and target) with the targets of refused scores or choices made ``incomplete``.

    ``violations`` has (incident_id, target, .., violation), as ``candidates.invalid_scores`` gives them; only their first kind by name travels.
    """
    first = violations.groupBy("incident_id", "target").agg(F.min("violation").alias("failure"))
    return closed(mapped.join(first, ["incident_id", "target"], "left").withColumn("failure", F.coalesce("failure", F.lit(""))))
