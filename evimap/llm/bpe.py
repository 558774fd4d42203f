"""Byte-level BPE over whole texts: merges by a priority queue, decoding by vocabulary strings.

A pre-token starts as a doubly linked list of byte symbols. The queue holds
rank and place of each mergeable pair as one number; an entry is stale if the pair at
its place has another rank by now, and is then skipped. Equal pre-tokens are merged once in each
worker while a bounded cache holds them.
"""

from __future__ import annotations

import json
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evimap.llm.common import with_arrow

# fixed value: the split of byte-level BPE
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: entries of each of a worker's two generations of runs, about 200 bytes each, and of its table of parts of runs
CACHE_SIZE, PARTS_SIZE = 100_000, 50_000
LONGEST_CACHED = 64
#: bits of a queue entry that hold the place; the rank lies above them
PLACE = (1 << 40) - 1

_loaded: dict[str, Bpe] = {}
_strings: dict[str, pa.Array] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(prints))
    letter = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


class Bpe:
    """A vocabulary file of the tokenizers library with byte-level pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.of_byte = [vocab[x] for x in letters]
        self.width = max(vocab.values()) + 1
        self.rank: dict[int, int] = {}  # of the pair a, b under a * width + b
        self.made: list[int] = []  # the symbol that the merge of a rank makes
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.rank[vocab[a] * self.width + vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(PRE_TOKEN)
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, pre_token: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers."""
        symbols = [self.of_byte[b] for b in pre_token.encode("utf-8")]
        n, rank_of, width, made = len(symbols), self.rank.get, self.width, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [rank_of(a * width + b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]  # of the pair at each place now
        ranks.append(-1)
        queue = [r << 40 | i for i, r in enumerate(ranks) if r >= 0]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & PLACE
            if ranks[i] != entry >> 40:
                continue  # stale
            symbols[i] = merged = made[entry >> 40]
            j = after[i]
            after[i] = k = after[j]
            symbols[j] = ranks[j] = ranks[i] = -1
            if k < n:
                before[k] = i
                ranks[i] = r = rank_of(merged * width + symbols[k], -1)
                if r >= 0:
                    heappush(queue, r << 40 | i)
            if (h := before[i]) >= 0:
                ranks[h] = r = rank_of(symbols[h] * width + merged, -1)
                if r >= 0:
                    heappush(queue, r << 40 | h)
        return array("I", [s for s in symbols if s >= 0]).tobytes()

    def _plain(self, text: str) -> bytes:
        return self._joined(self.pattern.findall(text))

    def _joined(self, pre_tokens: list[str]) -> bytes:
        parts, words = [], self.words
        for word in pre_tokens:
            ids = words.get(word)
            if ids is None:
                ids = self.merge(word)
                if len(word) <= LONGEST_CACHED:
                    if len(words) >= PARTS_SIZE:
                        words.clear()
                    words[word] = ids
            parts.append(ids)
        return b"".join(parts)

    def _run(self, run: str) -> bytes:
        """Ids of a space and the run behind it, which no other pre-token touches."""
        ids = self.old.get(run)
        if ids is None:
            parts = self.pattern.findall(" " + run)
            ids = self.merge(parts[0]) if len(parts) == 1 else self._joined(parts)
        if len(run) <= LONGEST_CACHED:
            if len(self.young) >= CACHE_SIZE:
                self.old, self.young = self.young, {}
            self.young[run] = ids
        return ids

    def _piece(self, text: str) -> bytes:
        """A text without special strings, cut at each space that stands alone between two runs."""
        first, *runs = text.split(" ")
        parts, open_part = [], first
        young = self.young
        for run in runs:
            if open_part is None:
                ids = young.get(run)
                if ids is not None:
                    parts.append(ids)
                    continue
                if run and not run[0].isspace() and not run[-1].isspace():
                    parts.append(self._run(run))
                    young = self.young
                    continue
                # white space beside the space: whatever follows it up to a clean cut is split as a whole
                open_part = " " + run
                continue
            if run and open_part and not run[0].isspace() and not open_part[-1].isspace():
                parts.append(self._plain(open_part))
                open_part = None
                if run[-1].isspace():
                    open_part = " " + run
                else:
                    parts.append(self._run(run))
                    young = self.young
                continue
            open_part += " " + run
        if open_part is not None:
            parts.append(self._plain(open_part))
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        if self.split_special is None or not any(s in text for s in self.special):
            return self._piece(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._piece(p) for p in self.split_special.split(text) if p)


def loaded(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def vocabulary(path: str) -> pa.Array:
    """The bytes of each id, all that decoding needs."""
    if path not in _strings:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {x: b for b, x in enumerate(byte_letters())}
        strings = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for word, i in vocab.items():
            strings[i] = bytes(byte_of[x] for x in word)
        for word, i in special.items():
            strings[i] = word.encode()
        _strings[path] = pa.array(strings, pa.large_binary())
    return _strings[path]


def encoded(column: pa.Array, path: str) -> pa.Array:
    """Token ids of each text of an Arrow column."""
    bpe = loaded(path)
    parts = [bpe.encode(x) if x else b"" for x in column.to_pylist()]
    offsets = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def decoded(ids: pa.Array, path: str) -> pa.Array:
    """Text of each row of ids: the vocabulary strings of all rows at once, cut at the rows' ends."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    strings = vocabulary(path).take(ids.flatten())
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(strings).to_numpy(zero_copy_only=False))]).astype(np.int64)
    cuts = ends[np.concatenate([[0], np.cumsum(sizes)])]
    whole = memoryview(b"" if strings.buffers()[2] is None else strings.buffers()[2])
    return pa.array([str(whole[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)], pa.string())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with the token ids of each whole text in column ``ids`` (array of int).

    Equal to the tokenizers library without added special tokens; special
    strings inside a text become their ids. Null and empty texts have no ids.
    Rows are encoded one by one, so ties and repeated rows keep their number; a
    column already named ``ids`` is replaced; an empty table stays empty.
    """
    columns = [c for c in df.columns if c.lower() != ids.lower()]

    return with_arrow(df.select(*columns), columns, [T.StructField(ids, T.ArrayType(T.IntegerType()))], lambda batch: [encoded(batch.column(text), path)])


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ids: their vocabulary strings, one after another, read as UTF-8.

    Null ids give an empty text; a column already named ``text`` is replaced.
    """
    columns = [c for c in df.columns if c.lower() != text.lower()]

    return with_arrow(df.select(*columns), columns, [T.StructField(text, T.StringType())], lambda batch: [decoded(batch.column(ids), path)])
