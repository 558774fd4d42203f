"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are grown with numpy from a bounded sample of labelled rows and kept as
flat node arrays; scoring walks all rows of a batch down all trees at once. Chosen
features are monotone: a split whose leaf values would run against the direction
is refused, and bounds keep both subtrees on their side of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap.llm.common import SMALL_SLICE, with_arrow
from evimap.llm.statistics import text_statistics

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: feature -> direction of the score: -1 never rises, +1 never falls, 0 free
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0,
    "digit_share": 0, "mark_share": 0, "distinct_share": 0, "end_share": 1, "line_words": 0,
}
#: the most labelled rows that a fit reads
SAMPLE_ROWS = 20_000
MIN_SCORE = 0.3


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / s["n_lines"], s["n_repeat_words"] / words,
        s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / chars, s["n_distinct"] / words, s["n_sentence_ends"] / words, s["n_words"] / s["n_lines"],
    ]).astype(np.float64)


@dataclass
class Trees:
    """Node arrays of equal depth-first trees: feature -1 marks a leaf, whose children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = np.where(x[rows, np.maximum(feature[node], 0)] <= threshold[node], left[node], right[node])
            total += value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _grow(bins, cuts, grad, hess, directions, depth, rate, penalty, least):
    size = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    left, right = np.arange(size), np.arange(size)
    todo = [(0, np.arange(len(grad)), -np.inf, np.inf, 0)]
    while todo:
        node, rows, low, high, level = todo.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        value[node] = rate * np.clip(-g / (h + penalty), low, high)
        if level == depth or len(rows) < 2 * least:
            continue
        best = (1e-6, None)
        for f, direction in enumerate(directions):
            count = np.bincount(bins[rows, f], minlength=len(cuts[f]) + 1)[:-1].cumsum()
            gl = np.bincount(bins[rows, f], grad[rows], len(cuts[f]) + 1)[:-1].cumsum()
            hl = np.bincount(bins[rows, f], hess[rows], len(cuts[f]) + 1)[:-1].cumsum()
            vl, vr = np.clip(-gl / (hl + penalty), low, high), np.clip(-(g - gl) / (h - hl + penalty), low, high)
            gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
            gain[(count < least) | (len(rows) - count < least) | (direction * (vr - vl) < 0)] = 0
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (gain[i], (f, i, (vl[i] + vr[i]) / 2))
        if best[1] is None:
            continue
        f, i, middle = best[1]
        feature[node], threshold[node], left[node], right[node] = f, cuts[f][i], 2 * node + 1, 2 * node + 2
        below = bins[rows, f] <= i
        sides = {-1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high)), 0: ((low, high), (low, high))}[directions[f]]
        todo += [(2 * node + 1, rows[below], *sides[0], level + 1), (2 * node + 2, rows[~below], *sides[1], level + 1)]
    return feature, threshold, left, right, value


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, penalty: float = 2.0, least: int = 5) -> Trees:
    """Boosted trees by the logistic loss; without rows of both classes every score is that class's share."""
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) if len(y) else np.zeros(0) for f in range(len(FEATURES))]
    bins = np.column_stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(len(FEATURES))]) if len(y) else np.zeros((0, len(FEATURES)), int)
    grown, total = [], np.full(len(y), start)
    for _ in range(trees if len(np.unique(y)) > 1 else 0):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(bins, cuts, p - y, p * (1 - p), list(FEATURES.values()), depth, rate, penalty, least)
        grown.append(tree)
        node = np.zeros(len(y), np.int64)
        for _ in range(depth):
            node = np.where(x[np.arange(len(y)), np.maximum(tree[0][node], 0)] <= tree[1][node], tree[2][node], tree[3][node])
        total += tree[4][node]
    arrays = [np.array([t[i] for t in grown]) if grown else np.zeros((0, 1), int) for i in range(5)]
    return Trees(*arrays, start, depth)


def fit_on(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on labelled rows, at most ``sample_rows`` of them, those of least hash of the id."""
    named = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("double").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isin(0.0, 1.0)) \
        .groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    # the sample is bounded by its parameter, so it may be sent to every task
    rows = df.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(named), "__id").withColumnRenamed("__y", "__label")
    vector = [T.StructField(f, T.DoubleType()) for f in FEATURES]
    table = with_arrow(rows, ["__text", "__label", "__id"], vector, lambda b: [pa.array(c) for c in features(text_statistics(b.column("__text"))).T], dropped=("__text",)).toArrow().to_pandas()
    table = table.sort_values(["__id", *FEATURES])
    return fit(table[list(FEATURES)].to_numpy(np.float64), table["__label"].to_numpy(np.float64))


def judge(df: DataFrame, trees: Trees, id_col: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE, carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, five base counts, score, base_failed, kept) of each row.

    base_failed: fewer than 10 words, or over a fifth of them in repeated 5-word
    windows. kept: not base_failed and a score of ``min_score`` or more. Null and
    empty texts have no words, so they fail. Rows are judged one by one: repeated
    rows and ids each give a row, an empty table gives none.
    """
    model = df.sparkSession.sparkContext.broadcast(trees)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        s = text_statistics(batch.column(text))
        return [*(pa.array(s[c].astype(np.int64)) for c in BASE), pa.array(model.value.score(features(s)))]

    columns = [id_col, *(c for c in carried if c != id_col)]
    added = [T.StructField(c, T.LongType()) for c in BASE] + [T.StructField("score", T.DoubleType())]
    out = with_arrow(df, [*dict.fromkeys([*columns, text])], added, run, dropped=() if text in columns else (text,), most=SMALL_SLICE)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score))
