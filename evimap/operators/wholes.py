"""Whole incidents by Arrow batches: rows dealt and sorted by incident, each incident's coverage and best hits worked out at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap.functions import eligibility as E
from evimap.operators import candidates as C

NUMBERS = ("total_fields", "eligible", "distinct_values", "rejected", "windows_evaluated")
DECIDED = "pointer string, identity string, score double, disagreement boolean, value_agreed boolean, contested boolean"


def _changes(column: pa.Array) -> np.ndarray:
    """Places where a value differs from the one before; NULL is a value."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(codes[1:] != codes[:-1]) + 1


def _joined(batches: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that the rows of one key, which follow one another, are in one batch."""
    held: list[pa.RecordBatch] = []  # rows of the last key, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        if held and held[-1].column(key)[0].as_py() != column[0].as_py():
            yield _joined(held)
            held = []
        cuts = _changes(column)
        if len(cuts):
            yield _joined([*held, batch.slice(0, cuts[-1])])
            held, batch = [], batch.slice(cuts[-1])
        held.append(batch)
    if held:
        yield _joined(held)


def _coverage(batch: pa.RecordBatch, group: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
    """(incidents, value types) tables: leaves that fit, their distinct values and windows."""
    fits = batch.column("_fits").to_numpy()
    table = np.array([[number >> i & 1 for i in range(len(E.REASONS))] for number in range(E.EMPTY)] + [[0] * len(E.REASONS)], np.int64)
    fit, marks = table[fits], batch.column("_mark").to_numpy()
    order = np.lexsort((fits, marks, group))
    first = np.ones(len(order), bool)
    first[1:] = np.any([x[order][1:] != x[order][:-1] for x in (group, marks, fits)], axis=0)
    once = order[first]  # one leaf of each value
    return {
        "eligible": np.add.reduceat(fit, begin, axis=0), "windows_evaluated": np.add.reduceat(fit * batch.column("_windows").to_numpy()[:, None].astype(np.int64), begin, axis=0),
        "distinct_values": np.add.reduceat(fit[once], np.searchsorted(group[once], np.arange(len(begin))), axis=0),
    }


def _decided(batch: pa.RecordBatch, group: np.ndarray, masks: np.ndarray, width: int, size: int) -> list[pa.Array]:
    """Columns of DECIDED for each incident and target: the best hit, the first pointer on a tie, and whether others tie."""
    rates, fits = batch.column("rates"), batch.column("_fits").to_numpy()
    leaf = np.repeat(np.arange(len(group)), pc.fill_null(pc.list_value_length(rates), 0).to_numpy(zero_copy_only=False))
    flat = rates.flatten()
    place, score = (flat.field(name).to_numpy() for name in ("place", "score"))
    fitting = masks[fits[leaf]] >> place & 1 == 1
    leaf, key, score = leaf[fitting], (group[leaf] * width + place)[fitting], score[fitting]
    order = np.lexsort((-score, key))
    leaf, key, score = leaf[order], key[order], score[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    tied = score == np.repeat(score[at], np.diff(np.append(at, len(key))))
    ties = np.add.reduceat(tied.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    best = leaf[at].copy()
    other_value, other_place = np.zeros(len(at), bool), np.zeros(len(at), bool)
    pointers, identities = batch.column("pointer"), batch.column("identity")
    for i in np.flatnonzero(ties > 1):
        # the best of a key stand first, so its ties are the next ones
        tops = [(pointers[j].as_py(), identities[j].as_py(), j) for j in leaf[at[i] : at[i] + ties[i]].tolist()]
        pointer, identity, best[i] = min(tops)
        other_value[i] = any(x[1] != identity for x in tops)
        other_place[i] = any(x[1] == identity and x[0] != pointer for x in tops)
    found = np.full(size, -1)
    found[key[at]] = np.arange(len(at))
    take = pa.array(found, mask=found < 0)
    split, contested = (np.zeros(size, bool) for _ in range(2))
    split[key[at]], contested[key[at]] = other_value, other_place
    return [pointers.take(pa.array(best)).take(take), identities.take(pa.array(best)).take(take), pa.array(score[at]).take(take), pa.array(split), pa.array(~split), pa.array(contested)]


def decide_wholes(rated: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row per (incident, target): NUMBERS and DECIDED.

    ``rated`` has (incident_id, _mark, _fits, _windows, rates, pointer, identity) of each leaf, ``rates`` as a
    :class:`Rating` lists them for a threshold. Rows stream through sorted by incident; one incident's leaves are held at a time.
    """
    known = C._catalogue(targets)
    kinds, masks = np.array([list(E.REASONS).index(kind) for _, kind, _ in known]), np.array(C.fitting_masks(targets), np.int64)
    names = [name for name, _, _ in known]
    columns = ["incident_id", "_mark", "_fits", "_windows", "rates", "pointer", "identity"]
    schema = T.StructType([rated.schema["incident_id"], *T.StructType.fromDDL("target string, " + ", ".join(f"{c} bigint" for c in NUMBERS) + ", " + DECIDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches, "incident_id"):
            begin = np.concatenate([[0], _changes(batch.column("incident_id"))]).astype(np.int64)
            counts = np.diff(np.append(begin, batch.num_rows))
            group, width, size = np.repeat(np.arange(len(begin)), counts), len(names), len(begin) * len(names)
            told = {name: table[:, kinds].ravel() for name, table in _coverage(batch, group, begin).items()}
            told["total_fields"] = np.repeat(counts, width)
            told["rejected"] = told["total_fields"] - told["eligible"]
            ids = batch.column("incident_id").take(pa.array(np.repeat(begin, width)))
            every = pa.array(names).take(pa.array(np.tile(np.arange(width), len(begin))))
            yield pa.RecordBatch.from_arrays([ids, every, *(pa.array(told[name].astype(np.int64)) for name in NUMBERS), *_decided(batch, group, masks, width, size)], names=schema.names)

    return rated.select(*columns).repartition(F.col("incident_id")).sortWithinPartitions("incident_id").mapInArrow(run, schema)
