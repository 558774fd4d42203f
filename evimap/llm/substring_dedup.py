"""Removal of passages that an earlier document has, by repeated-phrase automata.

1. Every text gives fingerprints: of each 50-word window the least hash of its
   25-word phrases (winnowing), so two equal windows share a phrase that both select.
2. Equal word sequences are one text; phrases that two texts select are recurring.
3. A slice of a task's texts is a shard: its recurring phrases are compiled to one Aho-Corasick
   automaton over word numbers, and all the shard's texts are streamed through it.
4. Windows around the places found are confirmed by 128-bit digests across all shards;
   a window that starts in a document with a smaller id is removed.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap.llm.common import SMALL_SLICE, coded_words, grams, kept_table, split_words, window_starts, with_arrow, word_hashes

WINDOW = 50
PHRASE = 25


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """Best of each ``width`` consecutive values, by doubling."""
    size, out = 1, values
    while size * 2 <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(values) - width + 1], out[width - size : len(values) - size + 1]) if width > size else out


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values))


def _fingerprints(column: pa.Array, window: int, phrase: int) -> tuple[pa.Array, pa.Array]:
    hashes, offsets = word_hashes(column)
    starts, _ = window_starts(offsets, window)
    n, reach = len(offsets) - 1, window - phrase + 1
    if not len(starts):
        return (_lists(np.zeros(0, t), np.zeros(0, np.int64), n) for t in (np.int64, np.int32))
    phrases = grams(hashes, phrase) | np.uint64(1)
    least = np.zeros(len(phrases) + reach - 1, np.uint64)  # of windows by start, 0 where none lies within a text
    least[starts + reach - 1] = _slide(phrases, reach, np.minimum)[starts]
    at = np.flatnonzero(_slide(least, reach, np.maximum) == phrases)
    rows = np.searchsorted(offsets, at, side="right") - 1
    return _lists(phrases[at].view(np.int64), rows, n), _lists((at - offsets[rows]).astype(np.int32), rows, n)


def _joined(column: pa.Array) -> list[bytes]:
    return [b" ".join(x.encode().split()) if x else b"" for x in column.to_pylist()]


def fingerprints(df: DataFrame, id_col: str, text: str, window: int, phrase: int) -> DataFrame:
    """(__id, __text: hash of the text, n_words, words_sha256, prints, places) of each row."""
    rows = df.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__text"), F.col(text).alias("__body"))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column("__body")
        sizes = np.diff(split_words(column)[1])
        return [pa.array(sizes.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in _joined(column)]), *_fingerprints(column, window, phrase)]

    added = [T.StructField("n_words", T.LongType()), T.StructField("words_sha256", T.StringType()), T.StructField("prints", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType()))]
    return with_arrow(rows, ["__id", "__text", "__body"], added, run, dropped=("__body",), most=SMALL_SLICE)


def _automaton(codes: np.ndarray, offsets: np.ndarray, places: list, phrase: int):
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for first, of_row in zip(offsets, places, strict=False):
        for p in of_row or ():
            found.add_word(tuple(codes[first + p : first + p + phrase].tolist()), 1)
    if len(found):
        found.make_automaton()
    return found


def _located(column: pa.Array, places: list, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat starts of all windows that hold a recurring phrase of the shard, their rows, and the rows' offsets."""
    codes, _, offsets = coded_words(column)
    found = _automaton(codes, offsets, places, phrase)
    holds = np.zeros(len(codes) + 2, np.int64)
    if len(found):
        for a, b in zip(offsets, offsets[1:], strict=False):
            if b - a >= window:
                ends = np.fromiter((e for e, _ in found.iter(tuple(codes[a:b].tolist()))), np.int64)
                at = a + ends - phrase + 1
                np.add.at(holds, np.maximum(at - (window - phrase), 0), 1)
                np.add.at(holds, at + 1, -1)
    held = np.cumsum(holds)[: len(codes)] > 0
    starts, rows = window_starts(offsets, window)
    return starts[held[starts]], rows[held[starts]], offsets


def _windows(column: pa.Array, places: list, window: int, phrase: int) -> list[pa.Array]:
    starts, rows, offsets = _located(column, places, window, phrase)
    hashes, n = word_hashes(column)[0], len(offsets) - 1
    digest = [grams(hashes, window, seed)[starts].view(np.int64) if len(starts) else np.zeros(0, np.int64) for seed in (1, 2)]
    return [_lists((starts - offsets[rows]).astype(np.int32), rows, n), *(_lists(d, rows, n) for d in digest)]


def _cut(text: str, starts, window: int) -> tuple[str, int, str]:
    """The text without its words in windows from ``starts``, how many went, and the digest of what is left."""
    words = text.encode().split()
    gone = np.zeros(len(words) + 1, np.int64)
    at = np.asarray(starts, np.int64)
    np.add.at(gone, at, 1)
    np.add.at(gone, np.minimum(at + window, len(words)), -1)
    gone = np.cumsum(gone)[:-1] > 0
    left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
    return left.decode(), int(gone.sum()), hashlib.sha256(left).hexdigest()


def removals(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(id, text_hash, n_words, n_removed, kept_sha256, kept_text) of each row.

    A word goes if it lies in a ``window`` of words that also starts in a document with
    a smaller id; all are judged on the input. kept_text: the words left, joined by a
    space, null where no word or every word went. Null and empty texts have no words. A
    row with a null id loses nothing and makes no other lose any. Rows with one id are
    not smaller than each other; repeated rows have equal results. An empty table gives
    an empty result; other columns are not read.
    """
    table = kept_table(fingerprints(df, id_col, text, window, phrase), "prints")
    long = table.where(F.col("__id").isNotNull() & (F.col("n_words") >= window))
    # copies are one text, that of the smallest id
    texts = kept_table(long.groupBy("words_sha256").agg(F.min("__id").alias("first"), F.min_by(F.struct("__text", "prints", "places"), F.struct("__id", "__text")).alias("of")), "texts")
    one = texts.select("words_sha256", F.col("first").alias("__id"), F.col("of.__text").alias("__text"))
    prints = texts.select(F.col("first").alias("__id"), F.col("of.__text").alias("__text"), F.explode(F.arrays_zip("of.prints", "of.places")).alias("p")) \
        .select("__id", "__text", F.col("p.prints").alias("print"), F.col("p.places").alias("place"))
    # a written table, so the join reads two plain shuffles and a hot phrase can be split
    recurring = prints.groupBy("print").agg(F.min("__id").alias("least"), F.max("__id").alias("most")).where("least < most").select("print")
    recurs = prints.join(kept_table(recurring, "recurring"), "print").groupBy("__id", "__text").agg(F.collect_set("place").alias("recurring"))
    rows = df.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__text"), F.col(text).alias("__body")).where(F.col("__id").isNotNull())
    streamed = rows.join(one.join(recurs, ["__id", "__text"], "left"), ["__id", "__text"])

    added = [T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("high", T.ArrayType(T.LongType())), T.StructField("low", T.ArrayType(T.LongType()))]
    found = with_arrow(streamed, ["__id", "__text", "__body", "words_sha256", "recurring"], added,
                       lambda b: _windows(b.column("__body"), b.column("recurring").to_pylist(), window, phrase), dropped=("recurring",), most=SMALL_SLICE)
    found = kept_table(found.where(F.size("starts") > 0), "windows")
    windows = found.select("__id", "__text", F.explode(F.arrays_zip("starts", "high", "low")).alias("w")).select("__id", "__text", "w.*")
    firsts = windows.groupBy("high", "low").agg(F.min("__id").alias("least"), F.max("__id").alias("most")).where("least < most").drop("most")
    later = windows.join(firsts, ["high", "low"]).where(F.col("__id") > F.col("least")).groupBy("__id", "__text").agg(F.collect_set("starts").alias("gone"))

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        done = [_cut(x, s, window) for x, s in zip(batch.column("__body").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
        return [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]

    made = [T.StructField("kept_text", T.StringType()), T.StructField("n_gone", T.LongType()), T.StructField("kept_sha", T.StringType())]
    parts = with_arrow(found.select("__id", "__text", "__body", "words_sha256").join(later, ["__id", "__text"]), ["words_sha256", "__body", "gone"], made, cut, dropped=("__body", "gone"), most=SMALL_SLICE).dropDuplicates(["words_sha256"])
    known = texts.select("words_sha256", "first").join(parts, "words_sha256", "left")
    joined = table.select("__id", "__text", "n_words", "words_sha256").join(known, "words_sha256", "left")
    whole = F.coalesce(F.col("__id") > F.col("first"), F.lit(False)) | (F.col("n_gone") == F.col("n_words"))
    mine = F.col("__id").isNotNull()
    return joined.select(
        F.col("__id").alias(id_col), F.col("__text").alias("text_hash"), "n_words",
        F.when(mine & whole, F.col("n_words")).when(mine, F.coalesce("n_gone", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(mine & whole, F.sha2(F.lit(""), 256)).when(mine, F.coalesce("kept_sha", "words_sha256")).otherwise(F.col("words_sha256")).alias("kept_sha256"),
        F.when(mine & ~whole, F.col("kept_text")).alias("kept_text"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with the removed words cut out of ``text``; rows of which no word is left go, others keep their text as it is."""
    found = removals(df, id_col, text, **options).dropDuplicates([id_col, "text_hash"]).select(
        F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"), F.col("n_words").alias("__words"), F.col("n_removed").alias("__gone"), F.col("kept_text").alias("__left"))
    joined = df.join(found, df[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(df[text]) == F.col("__hash")))
    kept = joined.where((F.col("__gone") == 0) | (F.col("__gone") < F.col("__words")))
    return kept.select(*[F.coalesce("__left", df[c]).alias(c) if c == text else df[c] for c in df.columns])
