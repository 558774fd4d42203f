"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its own features and those of both neighbours give the
state scores, two weights give the transitions. The field is fitted to labelled
documents whose lines take the document's label. Forward-backward gives each
line's chance to be good; the score of a document is their mean by line length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap.llm.common import coded_words, per_row, text_buffer, with_arrow
from evimap.llm.statistics import DIGIT, KINDS, LOWER, OTHER, REST, SPACE, SYMBOL, UPPER, in_repeated_window

#: the most labelled documents that a fit reads
SAMPLE_ROWS = 6_000
OWN = 11
THRESHOLD = 0.3


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all \\n-split lines with those of both neighbours, lines' lengths, each row's offsets."""
    data, at = text_buffer(column)
    breaks = np.flatnonzero(data == 10)
    per_text = per_row((data == 10).astype(np.int64), at) + 1
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    # a line runs from a row's start or the byte behind a break to the next break or the row's end
    first, last = np.zeros(offsets[-1], np.int64), np.zeros(offsets[-1], np.int64)
    row_of_break = np.searchsorted(at, breaks, side="right") - 1
    place = np.arange(len(breaks)) + row_of_break
    first[offsets[:-1]] = at[:-1]
    first[place + 1], last[place] = breaks + 1, breaks
    last[offsets[1:] - 1] = at[1:]
    kinds = KINDS[data]

    def count(bits: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kinds & bits > 0)])
        return (total[last] - total[first]).astype(np.float64)

    points = (last - first) - count(REST)
    spaces, symbols, upper, lower, digits, marks = (count(k) for k in (SPACE, SYMBOL, UPPER, LOWER, DIGIT, OTHER))
    chars = np.maximum(points - spaces, 1)
    # a line's words by how often a space or line end follows a character
    letter = np.concatenate([kinds != SPACE, [False]])
    ends = np.concatenate([[0], np.cumsum(letter[:-1] & ~letter[1:])])
    words = np.maximum(ends[last] - ends[first], 1).astype(np.float64)
    lines = pc.split_pattern(pc.fill_null(column.cast(pa.large_string()), ""), "\n").flatten()
    codes, _, word_at = coded_words(lines)
    repeated = per_row(in_repeated_window(codes, word_at[offsets]), word_at)
    bangs = np.concatenate([[0], np.cumsum(data == 33)])
    dots = np.concatenate([[0], np.cumsum(np.isin(data, (46, 63)))])
    empty = (points - spaces <= 0).astype(np.float64)
    own = np.column_stack([
        np.minimum(symbols / words, 4), np.minimum((bangs[last] - bangs[first]) / words, 4), upper / np.maximum(upper + lower, 1), digits / chars,
        np.minimum(marks / words, 4), np.log1p(points) / 5, chars / words / 10, (dots[last] - dots[first]) / words * 5, empty, np.log1p(words) / 5, repeated / words,
    ])
    n = len(own)
    above, below = np.zeros_like(own), np.zeros_like(own)
    above[1:], below[:-1] = own[:-1], own[1:]
    edges = np.zeros((n, 2))
    above[offsets[:-1]], below[offsets[1:] - 1] = 0, 0
    edges[offsets[:-1], 0], edges[offsets[1:] - 1, 1] = 1, 1
    return np.column_stack([own, above, below, edges, np.ones(n)]), np.maximum(points, 1), offsets


WIDTH = 3 * OWN + 3


@dataclass
class Field:
    """Weights of the good state's score and of the transition between unequal and equal neighbours."""

    state: np.ndarray
    stay_good: float
    stay_bad: float

    def marginals(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(line is good) by forward-backward, all rows of a batch together, line by line."""
        return _forward_backward(x @ self.state, offsets, self.stay_good, self.stay_bad)[0]


def _forward_backward(score: np.ndarray, offsets: np.ndarray, good: float, bad: float) -> tuple[np.ndarray, ...]:
    """Marginals, and for each line but a row's first the chances of good-good and bad-bad."""
    sizes, n = np.diff(offsets), len(score)
    order = np.argsort(-sizes, kind="stable")
    alive = np.array([np.searchsorted(-sizes[order], -k, side="left") for k in range(int(sizes.max(initial=0)))], np.int64)
    # log odds of good against bad: forward (own score included) and backward (own score left out)
    ahead, behind = np.zeros(n), np.zeros(n)
    lift = lambda z: np.logaddexp(z + good, 0) - np.logaddexp(z, bad)  # noqa: E731  odds after one transition
    for k, m in enumerate(alive):
        at = offsets[order[:m]] + k
        ahead[at] = score[at] + (lift(ahead[at - 1]) if k else 0)
    for k in range(len(alive) - 2, -1, -1):
        at = offsets[order[: alive[k + 1]]] + k
        behind[at] = lift(behind[at + 1] + score[at + 1])
    z = np.clip(ahead + behind, -60, 60)
    inner = np.ones(n, bool)
    inner[offsets[:-1]] = False
    at = np.flatnonzero(inner)
    after = score[at] + behind[at]
    joint = np.stack([ahead[at - 1] + good + after, np.full(len(at), bad), ahead[at - 1], after])
    joint = np.exp(joint - joint.max(axis=0))
    joint /= joint.sum(axis=0)
    return 1 / (1 + np.exp(-z)), joint[0], joint[1], inner


def fit(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, steps: int = 250, penalty: float = 1e-3, rate: float = 0.1) -> Field:
    """Maximise the documents' conditional likelihood with Adam; classes weigh alike."""
    w = np.zeros(WIDTH + 2)
    if not len(y) or len(np.unique(y)) < 2:
        w[WIDTH - 1] = 0 if not len(y) else (3 if y[0] else -3)
        return Field(w[:WIDTH], 0.0, 0.0)
    sizes = np.diff(offsets)
    line_y = np.repeat(y, sizes)
    weight = np.repeat(np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) / sizes, sizes)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p, both_good, both_bad, inner = _forward_backward(x @ w[:WIDTH], offsets, w[-2], w[-1])
        e, k = (line_y - p) * weight, weight[inner]
        up = np.concatenate([x.T @ e, [((line_y[inner] == 1) - both_good) @ k, ((line_y[inner] == 0) - both_bad) @ k]]) - penalty * w
        m, v = 0.9 * m + 0.1 * up, 0.999 * v + 0.001 * up**2
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[-2:] = np.clip(w[-2:], 0, 3)
    return Field(w[:WIDTH], float(w[-2]), float(w[-1]))


def fit_on(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Field:
    """Fit on the labelled rows of ``labels``, at most ``sample_rows`` of them, those of least hash of the id.

    Only the numbers of the sample's lines reach the driver.
    """
    named = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("double").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isin(0.0, 1.0)) \
        .groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    # the sample is bounded by its parameter, so it may be sent to every task
    rows = df.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(named), "__id").withColumnRenamed("__y", "__label")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        x, lengths, offsets = line_features(batch.column("__text"))
        lists = lambda v, k: pa.ListArray.from_arrays(pa.array(offsets * k, pa.int32()), pa.array(v))
        return [lists(x.astype(np.float32).ravel(), WIDTH), lists(lengths.astype(np.float32), 1)]

    added = [T.StructField("__x", T.ArrayType(T.FloatType())), T.StructField("__n", T.ArrayType(T.FloatType()))]
    table = with_arrow(rows, ["__id", "__text", "__label"], added, run, dropped=("__text",)).toArrow().to_pandas().sort_values("__id")
    if not len(table):
        return fit(np.zeros((0, WIDTH)), np.zeros(0), np.zeros(0), np.zeros(1, np.int64))
    offsets = np.concatenate([[0], np.cumsum([len(n) for n in table["__n"]])])
    x = np.concatenate(list(table["__x"])).reshape(-1, WIDTH).astype(np.float64)
    return fit(x, table["__label"].to_numpy(np.float64), np.concatenate(list(table["__n"])).astype(np.float64), offsets)


def line_quality(df: DataFrame, field: Field, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted, line_good: each line's chance to be good) of each row.

    Null and empty texts are one empty line and get its score. Rows are scored
    one by one, so repeated rows agree; an empty table gives an empty result.
    """
    model = df.sparkSession.sparkContext.broadcast(field)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        x, lengths, offsets = line_features(batch.column(text))
        p = model.value.marginals(x, offsets)
        score = per_row(p * lengths, offsets) / per_row(lengths, offsets)
        return [pa.array(np.clip(score, 0, 1)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(p.astype(np.float32)))]

    added = [T.StructField("score", T.DoubleType()), T.StructField("line_good", T.ArrayType(T.FloatType()))]
    out = with_arrow(df, [id_col, text], added, run, dropped=(text,))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
