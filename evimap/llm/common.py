"""What several corpus operators share: shared-folder tables, words and text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="evimap-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: text bytes that numpy works on at once
SLICE_BYTES = 4 << 20
#: the same where many numbers are made of each byte
SMALL_SLICE = 2 << 20


def sliced(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of text and of list items, one row at least, so memory doesn't follow Spark's batch size.

    A piece's arrays are copies that start at their buffers' beginning, so no caller meets a cut array.
    """
    size = np.zeros(batch.num_rows, np.int64)
    todo = list(batch.columns)
    for column in todo:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            size += 4 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_struct(column.type):
            todo.extend(column.flatten())
    part = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch if b - a == batch.num_rows else pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, b - a)]) for c in batch.columns], schema=batch.schema)


def release_memory() -> None:
    """Give free memory back to the system: a worker lives on from stage to stage, what it once needed shouldn't."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def with_arrow(df: DataFrame, columns: list[str], added: list[T.StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]],
               dropped: tuple[str, ...] = (), most: int = SLICE_BYTES) -> DataFrame:
    """Columns of ``df`` and those that ``fn`` makes of each Arrow batch, in one pass without a shuffle."""
    kept = [c for c in columns if c not in dropped]
    schema = T.StructType([df.schema[c] for c in kept] + added)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, most):
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + fn(piece), names=names)
            batch = piece = None  # not held while the next one is read, nor by an idle worker
            release_memory()

    return df.select(*columns).mapInArrow(run, schema)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n+1 offsets of its rows; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space (bytes 20, 09 to 0D) and the n+1 offsets of each row's words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    full = pc.not_equal(values, "")
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return values.filter(full), before[offsets - offsets[0]]


def coded_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words as numbers into their dictionary, the dictionary, and each row's offsets."""
    words, offsets = split_words(column)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, offsets


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and each row's offsets."""
    codes, dictionary, offsets = coded_words(column)
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in dictionary.to_pylist()), np.uint64, len(dictionary))
    return table[codes] if len(codes) else np.zeros(0, np.uint64), offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def grams(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Order-sensitive hash of every ``width`` consecutive hashes of one flat array, by doubling."""
    base, size, part, out = np.uint64(0x9E3779B97F4A7C15), 1, mix(hashes + np.uint64(seed)), None
    done, left = 0, width
    while len(hashes) >= width:
        if left & 1:
            tail = part[done : done + len(hashes) - width + 1]
            out = tail if out is None else mix(out * base + tail)
            done += size
        left >>= 1
        if not left:
            return out
        part = mix(part[:-size] * base + part[size:])
        size *= 2
    return np.zeros(0, np.uint64)


def window_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions where a window lies within one row, and the rows they belong to."""
    sizes = np.maximum(np.diff(offsets) - width + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return offsets[:-1][rows] + np.arange(sizes.sum()) - first[rows], rows


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets, empty rows included."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def ascii_lower(column):
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
