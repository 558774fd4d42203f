"""Leaf x target pairs: structural rejection, scoring and coverage.

The catalogue is a fixed list of 23 rows, so pairs come from an array that is
unfolded per leaf: no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimap import constants as K
from evimap.functions import eligibility as E
from evimap.functions.jsoncols import _let, identity_text
from evimap.functions.ratings import Rating as Rating
from evimap.functions.text import name_tokens, value_tokens
from evimap.functions.times import event_micros, event_number
from evimap.operators.flatten import trimmed_text


VALUE_TYPES = ("ip", "url", "timestamp", "text", "identifier")


def _words(text: str) -> list[str]:
    import re

    spaced = re.sub("([a-z0-9])([A-Z])", r"\1 \2", text)
    return list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", spaced.lower()) if w))


def _strings(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def target_array(targets: Sequence[str] = K.TARGET_NAMES) -> Column:
    """The catalogue as ARRAY<STRUCT<target, value_type, tokens, description>>."""
    unknown = set(targets) - set(K.TARGET_NAMES)
    if unknown:
        raise ValueError(f"unsupported target: {sorted(unknown)}")
    wanted = set(targets)
    return F.array(*(
        F.struct(
            F.lit(name).alias("target"), F.lit(kind).alias("value_type"),
            _strings(_words(name)).alias("tokens"), _strings(_words(description)).alias("description"),
        )
        for name, kind, description, _ in K.TARGETS if name in wanted
    ))


def _with_fits(leaf_rows: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``_fits``, all tests of a leaf as one number; text and time are columns of their own, so that each is worked out once."""
    moment = F.col("value_text") if strict else F.col("_text")
    return (
        leaf_rows.withColumn("_text", trimmed_text(F.col("vtype"), F.col("value_text")))
        .withColumn("_numeric", event_number(F.col("vtype"), moment, F.col("value_num"), strict))
        .withColumn("_micros", event_micros(F.col("vtype"), moment, F.col("_numeric")))
        .withColumn("_fits", E.fits(F.col("vtype"), F.col("_text"), F.col("_micros"), strict))
        .drop("_text", "_numeric", "_micros")
    )


def with_reasons(leaf_rows: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``reason`` (one entry per value type) and ``identity``."""
    return (
        _with_fits(leaf_rows, strict).withColumn("reason", E.reasons_of(F.col("_fits")))
        .withColumn("identity", identity_text(F.col("vtype"), F.col("value_text"))).drop("_fits")
    )


def alike(leaf_rows: DataFrame, key: str, *sums: Column) -> DataFrame:
    """All leaves, those with one ``key`` and the same reasons as one row with their number, ``leaves``, and any ``sums``.

    No target tells such leaves apart, so their pairs are formed once and counted; a key has at most 33 such rows.
    """
    folded = _with_fits(leaf_rows).groupBy(key, "_fits").agg(F.count(F.lit(1)).alias("leaves"), *sums)
    return folded.withColumn("reason", E.reasons_of(F.col("_fits"))).drop("_fits")


def reject_reasons(leaf_rows: DataFrame, targets: Sequence[str] = K.TARGET_NAMES) -> DataFrame:
    """All (leaf, target) pairs with '' for eligible ones, else why not; of leaves, or of those that are :func:`alike`."""
    tested = leaf_rows if "reason" in leaf_rows.columns else with_reasons(leaf_rows)
    # a list of one of the reasons per target, made once per leaf; the pairs of it and the catalogue compare no texts
    kinds = {name: kind for name, kind, _ in _catalogue(targets)}
    given = target_array(targets)
    rejections = F.array(*(F.col(f"reason.{kind}") for kind in kinds.values()))
    pairs = tested.withColumn("_rejections", rejections).select("*", F.posexplode(given).alias("_at", "t"))
    return (
        pairs.withColumn("rejection", F.get("_rejections", F.col("_at"))).drop("_rejections", "_at")
        .withColumn("target", F.col("t.target"))
        .drop("reason")
    )


# --- windows over value tokens ---------------------------------------------------
def windows_of(tokens: Column, size: int = K.WINDOW_TOKENS, overlap: int = K.WINDOW_OVERLAP) -> Column:
    """ARRAY<STRUCT<start_token, end_token, total_tokens>> covering all tokens."""
    total = F.size(tokens)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((total - overlap) / F.lit(step)).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        (i * step).alias("start_token"), F.least(total, i * step + size).alias("end_token"), total.alias("total_tokens"),
    ))


def window_count(total: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil((total - K.WINDOW_OVERLAP) / F.lit(K.WINDOW_TOKENS - K.WINDOW_OVERLAP)).cast("int"))


def text_windows(text: Column) -> Column:
    """How many windows a text has; one of fewer characters than words and gaps of a window take has one, and needs no splitting."""
    return F.when(F.length(text) < 2 * K.WINDOW_TOKENS, 1).otherwise(window_count(F.size(value_tokens(text))))


def value_windows(rows: DataFrame, text: str = "value_text", tokenizer: Callable[[Column], Column] = value_tokens) -> DataFrame:
    """One row per window with the words it holds, for scorers that need rows."""
    return (
        rows.withColumn("_tokens", tokenizer(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_window", F.explode(windows_of(F.col("_tokens"))))
        .withColumn("window_tokens", F.expr("slice(_tokens, _window.start_token + 1, greatest(1, _window.end_token - _window.start_token))"))
        .select("*", "_window.start_token", "_window.end_token", "_window.total_tokens")
        .drop("_tokens", "_window")
    )


# --- the built-in scorer --------------------------------------------------------
def label_tokens(key: Column, ancestry: Column, role: Column | None = None) -> Column:
    """Words that name a leaf: its parent's name and its own key.

    The ``value`` of a key/value record is named by the sibling ``key``.
    """
    own = key if role is None else F.coalesce(role, key)
    named = F.filter(F.slice(ancestry, 3, F.size(ancestry)), lambda a: ~a.rlike("^[0-9]+$"))
    parent = F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(""))
    return name_tokens(F.concat_ws(" ", parent, own))


def _common(words: Column, known: Column) -> Column:
    """How many of a few ``known`` words, each there once, are among ``words``; for such short lists looking beats building sets."""
    return F.size(F.filter(known, lambda w: F.array_contains(words, w)))


def name_score(shared: Column, label: Column, tokens: Column) -> Column:
    """Shared words over all words; both sides hold each word once."""
    return shared / (F.size(label) + F.size(tokens) - shared)


def seen_windows(words: Column, lowered: Column) -> Column:
    """Windows with their distinct lower-case words, worked out once per leaf."""
    return F.transform(windows_of(words), lambda w: F.struct(
        w["start_token"].alias("start_token"), w["end_token"].alias("end_token"),
        F.array_distinct(F.slice(lowered, w["start_token"] + 1, F.greatest(F.lit(1), w["end_token"] - w["start_token"]))).alias("seen"),
    ))


def _vocabulary(words: Column, texts: Iterable[str]) -> Column:
    """Those of the ``words`` that stand in any of the catalogue's texts: few, and mostly none."""
    known = sorted({w for text in texts for w in _words(text)})
    return F.filter(words, lambda w: w.isin(known))


def _catalogue(targets: Sequence[str]) -> list[tuple[str, str, str]]:
    return [(name, kind, text) for name, kind, text, _ in K.TARGETS if name in set(targets)]


def _fitting_places(targets: Sequence[str]) -> Column:
    """Places in :func:`_catalogue` of the targets whose value type the leaf satisfies."""
    known, groups = _catalogue(targets), []
    for kind in VALUE_TYPES:
        places = [F.lit(i) for i, (_, k, _) in enumerate(known) if k == kind]
        if places:
            groups.append(F.when(F.col(f"reason.{kind}") == "", F.array(*places)).otherwise(F.array().cast("array<int>")))
    return F.concat(*groups)


def _fitting_bits(targets: Sequence[str]) -> Column:
    """:func:`_fitting_places` as bits of one number."""
    bits = F.lit(0).cast("bigint")
    for kind in VALUE_TYPES:
        mask = sum(1 << i for i, (_, k, _) in enumerate(_catalogue(targets)) if k == kind)
        if mask:
            bits = bits.bitwiseOR(F.when(F.col(f"reason.{kind}") == "", F.lit(mask).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def _sharing_bits(label: Column, targets: Sequence[str]) -> Column:
    """Bits of the targets that share a word with the label; a word stands in few names, so most targets are never looked at."""
    masks: dict[str, int] = {}
    for i, (name, _, _) in enumerate(_catalogue(targets)):
        for word in _words(name):
            masks[word] = masks.get(word, 0) | 1 << i
    table = F.map_from_arrays(_strings(masks), F.array(*(F.lit(m).cast("bigint") for m in masks.values())))
    return F.aggregate(label, F.lit(0).cast("bigint"), lambda bits, word: bits.bitwiseOR(F.coalesce(F.try_element_at(table, word), F.lit(0).cast("bigint"))))


def _named_places(label: Column, targets: Sequence[str], threshold: float) -> Column:
    """ARRAY<STRUCT<place, name>>: fitting targets with their name score, without those that cannot reach the threshold.

    The value part adds at most 0.1, so the bound is exact; above that, a target needs a word of the label.
    """
    bounded = threshold > 0.1

    def scored(place: Column) -> Column:
        tokens = _tokens_at(place, targets)
        name = _let(_common(label, tokens), lambda shared: name_score(shared, label, tokens))
        return F.struct(place.alias("place"), name.alias("name"))

    def named(bits: Column) -> Column:
        places = F.filter(F.array(*(F.lit(i) for i in range(len(_catalogue(targets))))), lambda i: F.getbit(bits, i) == 1)
        rows = F.transform(places, scored)
        rows = F.filter(rows, lambda t: 0.9 * t["name"] + 0.1 >= threshold - 1e-6) if bounded else rows
        return F.when(bits == 0, F.array().cast("array<struct<place:int,name:double>>")).otherwise(rows)

    fitting = _fitting_bits(targets)
    return _let(fitting.bitwiseAND(_sharing_bits(label, targets)) if bounded else fitting, named)


def _kept(rows: DataFrame, name: str, values: Column) -> DataFrame:
    """``values`` as an array column, without the rows where it is empty.

    Unfolding an array of one keeps it from being worked out again by a filter.
    """
    return rows.withColumn(name, F.explode(_let(values, lambda v: F.filter(F.array(v), lambda x: F.size(x) > 0))))


def _label() -> Column:
    return label_tokens(F.col("key"), F.col("ancestry"), F.col("role"))


def _value_windows(targets: Sequence[str]) -> Column:
    """:func:`known_windows` of the leaf's text; the words are lowered in one go, a call per word would dominate."""
    lowered = lambda words: F.split(F.lower(F.array_join(words, "\n")), "\n")
    return _let(value_tokens(F.coalesce("value_text", F.lit(""))), lambda words: _let(lowered(words), lambda low: known_windows(words, low, targets)))


def _window_entry(name: Column, place: Column, window: Column, targets: Sequence[str]) -> Column:
    """STRUCT<score, early, end_token>: mostly the name; a little for words of the target's description in the value."""
    told = _common(window["known"], _described_at(place, targets)) / F.greatest(F.lit(1), window["distinct"])
    # rounding goes by decimals, which costs more than all the rest
    score = F.when((name == 0) & (F.size(window["known"]) == 0), 0.0).otherwise(F.round(0.9 * name + 0.1 * told, 6))
    return F.struct(score.alias("score"), (-window["start_token"]).alias("early"), window["end_token"].alias("end_token"))


def _tokens_at(place: Column, targets: Sequence[str]) -> Column:
    return F.get(F.array(*(_strings(_words(name)) for name, _, _ in _catalogue(targets))), place)


def _described_at(place: Column, targets: Sequence[str]) -> Column:
    """Words of a target's description."""
    return F.get(F.array(*(_strings(_words(text)) for _, _, text in _catalogue(targets))), place)


def _name_at(place: Column, targets: Sequence[str]) -> Column:
    """Name score of the target at a place of the catalogue."""
    tokens = _tokens_at(place, targets)
    return F.when(F.size("named") == 0, 0.0).otherwise(_let(_common(F.col("named"), tokens), lambda shared: name_score(shared, F.col("label"), tokens)))


def known_windows(words: Column, lowered: Column, targets: Sequence[str]) -> Column:
    """Windows with the number of their distinct lower-case words and those that stand in a target's description."""
    described = [text for _, _, text in _catalogue(targets)]

    def window(start: Column, end: Column, seen: Column) -> Column:
        return F.struct(start.alias("start_token"), end.alias("end_token"), F.size(seen).alias("distinct"), _vocabulary(seen, described).alias("known"))

    # most values are one window: no slices, and no sequence of windows to go through
    several = F.transform(seen_windows(words, lowered), lambda w: window(w["start_token"], w["end_token"], w["seen"]))
    return F.when(F.size(words) <= K.WINDOW_TOKENS, F.array(window(F.lit(0), F.size(words), F.array_distinct(lowered)))).otherwise(several)


def _score_all(tested: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Every eligible pair with its ``best`` window, scored as rows, with ``windows``.

    Few words of a leaf stand in the catalogue at all; they are looked for once per leaf, so that most pairs have nothing to compare.
    """
    names = [name for name, _, _ in _catalogue(targets)]
    prepared = (
        _kept(tested, "_places", _fitting_places(targets))
        .withColumn("label", _label())
        .withColumn("named", _vocabulary(F.col("label"), names))
        .withColumn("words", value_tokens(F.coalesce("value_text", F.lit(""))))
        .withColumn("lowered", F.split(F.lower(F.array_join("words", "\n")), "\n"))
        .withColumn("wins", known_windows(F.col("words"), F.col("lowered"), targets)).drop("words", "lowered")
    )
    pairs = prepared.withColumn("place", F.explode("_places")).withColumn("_name", _name_at(F.col("place"), targets))
    scored = lambda w: _window_entry(F.col("_name"), F.col("place"), w, targets)
    return (
        pairs.withColumn("best", F.when(F.size("wins") == 1, scored(F.get("wins", F.lit(0)))).otherwise(F.array_max(F.transform("wins", scored))))
        .withColumn("target", F.get(F.array(*(F.lit(name) for name in names)), F.col("place")))
        .withColumn("windows", F.size("wins")).drop("place", "_places", "_name", "named")
    )


def fitting_masks(targets: Sequence[str]) -> list[int]:
    """For each number that :func:`E.fits` gives, bits of the targets (places in :func:`_catalogue`) that such a leaf fits."""
    kinds = [list(E.REASONS).index(kind) for _, kind, _ in _catalogue(targets)]
    return [*(sum(1 << i for i, kind in enumerate(kinds) if fits >> kind & 1) for fits in range(E.EMPTY)), 0]


def _score_rated(leaf_rows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Eligible pairs of leaves with the columns of a :class:`Rating`; no step goes through a list by a lambda."""
    masks = fitting_masks(targets)
    words = F.when(F.col("vtype") == "number", F.size(value_tokens("value_text")))
    identity = identity_text(F.col("vtype"), F.col("value_text"))
    made = [c for c in ("rates", "starts", "ends", "windows", "words") if c in leaf_rows.columns]
    if "words" not in made:  # a threshold left few targets in the list
        rows = _with_fits(leaf_rows.where(F.size("rates") > 0)).withColumn("r", F.explode("rates"))
        fitting = F.get(F.array(*(F.lit(m).cast("bigint") for m in masks)), F.col("_fits"))
        rows = rows.where(F.getbit(fitting, F.col("r.place")) == 1)
        place, score, start, windows, end = F.col("r.place"), F.col("r.score"), F.col("r.start"), F.col("r.windows"), F.coalesce(words, F.col("r.end"))
    else:
        rows = _with_fits(leaf_rows).withColumn("r", F.explode(fitting_places(targets)))
        place, score, windows = F.col("r"), F.get("rates", F.col("r")), F.col("windows")
        start = F.coalesce(F.get("starts", F.col("r")), F.lit(0))
        end = F.coalesce(F.get("ends", F.col("r")), words, F.col("words"))
    kept = [c for c in leaf_rows.columns if c not in made]
    return rows.select(*kept, identity.alias("identity"), target_at(place, targets).alias("target"), windows.alias("windows"), score.alias("score"),
                       start.alias("start_token"), end.alias("end_token"))


def score_leaves(leaf_rows: DataFrame) -> DataFrame:
    """All leaves with the columns of a :class:`Rating` and no threshold, ``identity`` and ``_fits``: :func:`score_lexical` of every target, not yet unfolded.

    ``rank_candidates``, ``value_groups`` and ``representatives`` unfold them after they have grouped the leaves.
    """
    return _with_fits(leaf_rows).withColumn("identity", identity_text(F.col("vtype"), F.col("value_text")))


def fitting_places(targets: Sequence[str] = K.TARGET_NAMES) -> Column:
    """Places of the targets that a leaf's ``_fits`` tells it fits, picked from a fixed list."""
    return F.get(F.array(*(F.array(*(F.lit(i) for i in range(m.bit_length()) if m >> i & 1)).cast("array<int>") for m in fitting_masks(targets))), F.col("_fits"))


def target_at(place: Column, targets: Sequence[str] = K.TARGET_NAMES) -> Column:
    return F.get(F.array(*(F.lit(name) for name, _, _ in _catalogue(targets))), place)


def score_lexical(leaf_rows: DataFrame, targets: Sequence[str] = K.TARGET_NAMES, threshold: float = 0.0) -> DataFrame:
    """Eligible pairs with the best window of the built-in scorer, all in the row.

    No windows are unfolded: the earliest best one is the maximum of an array.
    A threshold above 0.1 needs a shared name word, so other pairs are not
    even formed; the result is the same as filtering by score afterwards.
    Leaves that the walk has given their :class:`Rating`, of the same targets and threshold, are only unfolded.
    """
    if "rates" in leaf_rows.columns:
        return _score_rated(leaf_rows, targets)
    tested = with_reasons(leaf_rows)
    if threshold <= 0:
        return _score_all(tested, targets).select("*", F.col("best.score").alias("score"), (-F.col("best.early")).alias("start_token"), "best.end_token").drop(
            "best", "wins", "label", "reason")
    # words of a value are looked at only where a target is left
    few = _kept(tested.withColumn("label", _label()), "_places", _named_places(F.col("label"), targets, threshold))
    pairs = few.withColumn("wins", _value_windows(targets)).withColumn("t", F.explode("_places"))
    every = F.transform("wins", lambda w: _window_entry(F.col("t.name"), F.col("t.place"), w, targets))
    # the one-element array keeps the filter on the score from being worked out twice
    best = pairs.withColumn("best", F.explode(F.filter(F.array(F.array_max(every)), lambda b: b["score"] >= threshold)))
    names = F.array(*(F.lit(name) for name, _, _ in _catalogue(targets)))
    return (
        best.withColumn("target", F.get(names, F.col("t.place"))).withColumn("windows", F.size("wins"))
        .select("*", F.col("best.score").alias("score"), (-F.col("best.early")).alias("start_token"), "best.end_token")
        .drop("best", "t", "_places", "wins", "label", "reason")
    )


def strong_hits(targets: Sequence[str], threshold: float) -> Column:
    """Array of this leaf's targets that reach the threshold; its value is cut into words only if there may be one."""
    names = F.array(*(F.lit(name) for name, _, _ in _catalogue(targets)))
    none = F.array().cast("array<struct<down:double,pointer:string,identity:string,target:string>>")

    def hits(met: Column) -> Column:
        scored = lambda wins: F.transform(met, lambda t: F.struct(
            (-F.array_max(F.transform(wins, lambda w: _window_entry(t["name"], t["place"], w, targets)))["score"]).alias("down"),
            F.col("pointer").alias("pointer"), F.col("identity").alias("identity"), F.get(names, t["place"]).alias("target")))
        return F.when(F.size(met) > 0, F.filter(_let(_value_windows(targets), scored), lambda h: h["down"] <= -threshold)).otherwise(none)

    return _let(_label(), lambda label: _let(_named_places(label, targets, threshold), hits))


def best_window(scored: DataFrame) -> DataFrame:
    """Highest window per (incident, target, leaf), the earliest on a tie."""
    rank = F.struct(F.col("score"), -F.col("start_token"))
    return scored.groupBy("incident_id", "target", "leaf_id").agg(
        F.max("score").alias("score"),
        F.max_by(F.struct("start_token", "end_token"), rank).alias("window"),
        F.count(F.lit(1)).alias("windows"),
    ).select("incident_id", "target", "leaf_id", "score", "window.start_token", "window.end_token", "windows")


# --- coverage --------------------------------------------------------------------


def coverage(leaf_rows: DataFrame, targets: Sequence[str] = K.TARGET_NAMES) -> DataFrame:
    """Per (incident, target): fields, eligible, distinct values, rejected, windows.

    Eligibility depends on the value type alone, so leaves are folded once per
    incident for the five types and only then unfolded to the targets.
    """
    given = "reason" in leaf_rows.columns
    tested = with_marks(leaf_rows.withColumn("_fits", _bits_of("reason")) if given else _with_fits(leaf_rows))
    # equal values meet first, so no list of an incident's values is ever held; being equal, they fit the same types and have as many windows
    values = tested.groupBy("incident_id", "_mark", "_fits", "_windows").agg(F.count(F.lit(1)).alias("n"))
    fitting = {kind: E.fits_kind(F.col("_fits"), kind) for kind in VALUE_TYPES}
    totals = values.groupBy("incident_id").agg(F.sum("n").alias("total_fields"), *(c for kind, fit in fitting.items() for c in (
        F.sum(F.when(fit, F.col("n")).otherwise(0)).alias(f"eligible_{kind}"), F.count_if(fit).alias(f"distinct_{kind}"),
        F.sum(F.when(fit, F.col("n") * F.col("_windows")).otherwise(0)).alias(f"windows_{kind}"))))
    return per_target(totals, targets)


def _bits_of(reason: str) -> Column:
    """The number that gives these reasons."""
    bits = (F.when(F.col(f"{reason}.{kind}") == "", F.lit(1 << i)).otherwise(F.lit(0)) for i, kind in enumerate(E.REASONS))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def with_marks(tested: DataFrame) -> DataFrame:
    """Adds the number of windows and a mark that leaves of one type and value share."""
    counted = F.size("wins") if "wins" in tested.columns else text_windows(F.coalesce("value_text", F.lit("")))
    return tested.withColumn("_windows", counted).withColumn("_mark", F.xxhash64("vtype", F.when(F.col("vtype") != "null", F.col("value_text"))))


def coverage_sums() -> list[Column]:
    """Aggregates per incident, three for each value type."""
    sums = [F.count(F.lit(1)).alias("total_fields")]
    for kind in VALUE_TYPES:
        fits = F.col(f"reason.{kind}") == ""
        sums += [
            F.count_if(fits).alias(f"eligible_{kind}"),
            F.size(F.collect_set(F.when(fits, F.col("_mark")))).alias(f"distinct_{kind}"),
            F.coalesce(F.sum(F.when(fits, F.col("_windows"))), F.lit(0)).alias(f"windows_{kind}"),
        ]
    return sums


def per_target(totals: DataFrame, targets: Sequence[str], *extra: Column) -> DataFrame:
    """Unfold sums per value type to one row per target."""
    # arrays in the order of VALUE_TYPES, made once per incident: a target picks by place, with no text compared
    listed = {name: F.array(*(F.col(f"{name}_{kind}").cast("bigint") for kind in VALUE_TYPES)).alias(f"_{name}") for name in ("eligible", "distinct", "windows")}
    unknown = set(targets) - set(K.TARGET_NAMES)
    if unknown:
        raise ValueError(f"unsupported target: {sorted(unknown)}")
    names = F.array(*(F.struct(F.lit(name).alias("target"), F.lit(VALUE_TYPES.index(kind)).alias("kind")) for name, kind, _ in _catalogue(targets)))
    by_kind = lambda name: F.get(F.col(f"_{name}"), F.col("t.kind"))
    return totals.select("*", *listed.values()).withColumn("t", F.explode(names)).select(
        "incident_id", F.col("t.target").alias("target"), "total_fields",
        by_kind("eligible").alias("eligible"), by_kind("distinct").alias("distinct_values"),
        (F.col("total_fields") - by_kind("eligible")).alias("rejected"), by_kind("windows").alias("windows_evaluated"),
        *extra,
    )


# --- checks on scores that came from outside ---------------------------------------
def invalid_scores(requests: DataFrame, windows: DataFrame) -> DataFrame:
    """(incident_id, target, leaf_id, violation) of decisions that cannot be used.

    ``requests`` has one row per decision, ``windows`` (incident_id, target,
    leaf_id, start_token, end_token, total_tokens, score, item_score).
    """
    from pyspark.sql import Window

    key = ["incident_id", "target", "leaf_id"]
    order = Window.partitionBy(*key).orderBy("start_token", "end_token")
    before_start, before_end = F.lag("start_token").over(order), F.lag("end_token").over(order)
    steps = windows.withColumn(
        "bad_bounds",
        (F.col("start_token") < 0) | (F.col("end_token") < F.col("start_token")) | (F.col("end_token") > F.col("total_tokens"))
        | F.coalesce((F.col("start_token") <= before_start) | (F.col("start_token") >= before_end), F.lit(False)),
    ).withColumn("bad_score", F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1))
    items = steps.groupBy(*key).agg(
        F.bool_or("bad_bounds").alias("bad_bounds"), F.bool_or("bad_score").alias("bad_score"),
        F.min("start_token").alias("first_start"), F.max("end_token").alias("last_end"),
        F.min("total_tokens").alias("least"), F.max("total_tokens").alias("most"),
        F.max("score").alias("top"), F.max("item_score").alias("item_score"), F.count_distinct("item_score").alias("item_scores"),
    )
    asked = requests.groupBy(*key).agg(F.count(F.lit(1)).alias("asked"))
    both = asked.join(items.withColumn("answered", F.lit(1)), key, "full_outer")
    violation = (
        F.when(F.col("asked").isNull(), F.lit("unknown_decision"))
        .when(F.col("asked") > 1, F.lit("duplicate_decision"))
        .when(F.col("answered").isNull(), F.lit("omitted_decision"))
        .when(F.col("bad_score") | (F.col("item_scores") != 1), F.lit("invalid_score"))
        .when(
            F.col("bad_bounds") | (F.col("first_start") != 0) | (F.col("least") != F.col("most"))
            | (F.col("last_end") != F.col("most")) | (F.abs(F.col("item_score") - F.col("top")) > 1e-6),
            F.lit("invalid_windows"),
        )
    )
    return both.withColumn("violation", violation).where("violation is not null").select(*key, "violation")


def choice_violation(options: Column, probabilities: Column, choice: Column) -> Column:
    """'' when a distribution over options is sound and the choice is its maximum."""
    position = F.array_position(options, choice)
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + p)
    outside = F.exists(probabilities, lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1))
    return (
        F.when(F.size(options) != F.size(probabilities), F.lit("invalid_distribution"))
        .when((position == 0) | outside | (F.abs(total - 1) > 0.002), F.lit("invalid_distribution"))
        .when(F.try_element_at(probabilities, position.cast("int")) < F.array_max(probabilities), F.lit("choice_not_maximal"))
        .otherwise(F.lit(""))
    )
