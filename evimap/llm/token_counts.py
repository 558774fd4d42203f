"""Token counts of whole texts by a two-tier lookup, without a shuffle of pre-tokens.

A pre-token is a run of characters between ASCII white space. The tokenizer drops
white space before it merges, so the count of a text is the sum over its runs.

Tier 1  lengths of the frequent runs, a broadcast table of ``table_size`` entries at most
Tier 2  each worker's bounded cache; what it lacks is encoded by the tokenizers library
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap.llm.common import per_row, sliced, split_words, with_arrow

TABLE_SIZE = 16384
CACHE_SIZE = 200_000
LONGEST_CACHED = 64

_tokenizers: dict = {}
_caches: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _lengths(path: str, runs: list[str]) -> list[int]:
    return [len(e) for e in _tokenizer(path).encode_batch(runs, add_special_tokens=False)]


def _pruned(words: np.ndarray, counts: np.ndarray, size: int) -> dict[str, int]:
    """A frequent-items summary: less the count that ranks ``size`` + 1, so at most ``size`` are left."""
    if len(counts) > size:
        counts = counts - np.partition(counts, -size - 1)[-size - 1]
        words, counts = words[counts > 0], counts[counts > 0]
    return dict(zip(words.tolist(), counts.tolist(), strict=True))


def _merged(a: dict[str, int], b: dict[str, int], size: int) -> dict[str, int]:
    out = dict(a)
    for word, n in b.items():
        out[word] = out.get(word, 0) + n
    if len(out) <= size:
        return out
    return _pruned(np.array(list(out), object), np.array(list(out.values()), np.int64), size)


def frequent_runs(df: DataFrame, text: str = "text", size: int = TABLE_SIZE) -> list[str]:
    """Runs that may be more frequent than one in ``size`` of all runs of all texts.

    Each task keeps one mergeable summary of ``size`` counters; the summaries
    meet in a tree, so neither a task nor the driver ever holds more than a few.
    Every run with a share above 1 / ``size`` is in the result.
    """
    schema = T.StructType([T.StructField("runs", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in (piece for whole in batches for piece in sliced(whole)):
            found = pc.value_counts(split_words(batch.column(0))[0])
            counts = found.field("counts").to_numpy(zero_copy_only=False)
            if len(counts) > size:
                least = np.partition(counts, -size - 1)[-size - 1]
                above = np.flatnonzero(counts > least)
                part = dict(zip(found.field("values").take(pa.array(above)).to_pylist(), (counts[above] - least).tolist(), strict=True))
            else:
                part = dict(zip(found.field("values").to_pylist(), counts.tolist(), strict=True))
            total = _merged(total, part, size)
        yield pa.RecordBatch.from_pydict({"runs": [list(total)], "counts": [list(total.values())]}, schema=pa.schema(
            [("runs", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))

    parts = df.select(text).mapInArrow(summaries, schema).rdd.map(lambda r: dict(zip(r[0], r[1], strict=True)))
    found = parts.treeAggregate({}, lambda a, b: _merged(a, b, size), lambda a, b: _merged(a, b, size), depth=3)
    return sorted(found)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 2048,
                 table_size: int = TABLE_SIZE, cache_size: int = CACHE_SIZE) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, as the tokenizers library counts.

    ``path`` names a tokenizer whose pre-tokens never span white space. Special
    strings inside a text count as the library counts them. Null and empty texts
    have no bytes and no tokens. Repeated rows and ids are counted row by row;
    an empty table gives an empty result; other columns are not read.
    """
    runs = frequent_runs(df, text, table_size)
    tier = df.sparkSession.sparkContext.broadcast((runs, np.array(_lengths(path, runs), np.int32)))

    def count(batch: pa.RecordBatch) -> list[pa.Array]:
        known, lengths = pa.array(tier.value[0], pa.large_string()), tier.value[1]
        cache = _caches.setdefault(path, {})
        words, offsets = split_words(batch.column(text))
        coded = words.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=known)
        missing = found.is_null().to_numpy(zero_copy_only=False)
        size = np.zeros(len(missing), np.int64)
        size[~missing] = lengths[found.drop_null().to_numpy(zero_copy_only=False)]
        runs = coded.dictionary.filter(pa.array(missing)).to_pylist()
        counts = [cache.get(r) for r in runs]
        new = [r for r, n in zip(runs, counts, strict=True) if n is None]
        fresh = iter(_lengths(path, new))
        for i, n in enumerate(counts):
            if n is None:
                counts[i] = n = next(fresh)
                if len(runs[i]) <= LONGEST_CACHED:
                    if len(cache) >= cache_size:
                        cache.clear()
                    cache[runs[i]] = n
        size[missing] = counts
        tokens = per_row(size[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64), offsets)
        return [pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64()), pa.array(tokens, pa.int64())]

    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    out = with_arrow(df, [id_col, text], added, count, dropped=(text,))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
