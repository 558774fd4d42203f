"""Exact statistics of whole texts, computed on a batch's bytes and word numbers with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evimap.llm.common import coded_words, grams, mix, per_row, text_buffer, window_starts

# fixed values: characters that count as symbols
SYMBOLS = b"#*$%&|<>"
SPACE, SYMBOL, UPPER, LOWER, DIGIT, OTHER, REST = 1, 2, 4, 8, 16, 32, 64


def byte_kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[[32, *range(9, 14)]] = SPACE
    kind[list(SYMBOLS)] = SYMBOL
    kind[ord("A") : ord("Z") + 1] = UPPER
    kind[ord("a") : ord("z") + 1] = LOWER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[0x80:0xC0] = REST  # inside a code point
    kind[0xC0:] = LOWER  # starts a letter beyond ASCII, mostly
    return kind


KINDS = byte_kinds()


def in_repeated_window(codes: np.ndarray, offsets: np.ndarray, width: int = 5) -> np.ndarray:
    """For each word, 1 if it lies in a ``width``-word window found twice or more in its row.

    Windows are sorted by hash; neighbours of equal hash are compared word by
    word, and a chance collision makes the batch fall back to comparing words.
    """
    flags = np.zeros(len(codes) + 1, np.int64)
    starts, rows = window_starts(offsets, width)
    if len(starts):
        hashes = mix(grams(mix(codes.astype(np.uint64) + np.uint64(1)), width)[starts] + mix(rows.astype(np.uint64)))
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        a, b = starts[order][:-1][same], starts[order][1:][same]
        equal = (rows[order][:-1][same] == rows[order][1:][same]) & np.all([codes[a + i] == codes[b + i] for i in range(width)], axis=0)
        if not equal.all():
            whole = np.column_stack([rows, *(codes[starts + i] for i in range(width))])
            _, which, times = np.unique(whole, axis=0, return_inverse=True, return_counts=True)
            found = starts[times[which.ravel()] > 1]
        else:
            found = np.unique(np.concatenate([a, b]))
        np.add.at(flags, found, 1)
        np.add.at(flags, found + width, -1)
    return (np.cumsum(flags)[:-1] > 0).astype(np.int64)


def duplicate_lines(column: pa.Array) -> np.ndarray:
    """For each row, its lines with a word that equal an earlier line of the row."""
    lists = pc.split_pattern(pc.fill_null(column.cast(pa.large_string()), ""), "\n")
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    lines = lists.flatten().dictionary_encode()
    worded = pc.match_substring_regex(lines.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    codes = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pairs = rows * (len(worded) + 1) + codes
    _, first = np.unique(pairs, return_index=True)
    later = np.ones(len(codes), bool)
    later[first] = False
    return per_row((later & worded[codes]).astype(np.int64) if len(codes) else np.zeros(0, np.int64), offsets)


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each row's whole text; a null is an empty text."""
    data, at = text_buffer(column)
    kinds = KINDS[data]
    of = lambda bits: per_row((kinds & bits > 0).astype(np.int64), at)
    codes, dictionary, offsets = coded_words(column)
    ends = np.zeros(len(dictionary), bool)
    if len(dictionary):
        ends = pc.match_substring_regex(dictionary, r"[.!?]$").to_numpy(zero_copy_only=False)
    flat_rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    distinct = np.bincount(np.unique(flat_rows * (len(dictionary) + 1) + codes) // (len(dictionary) + 1), minlength=len(offsets) - 1)
    code_points = per_row((kinds != REST).astype(np.int64), at)
    spaces = of(SPACE)
    return {
        "n_words": np.diff(offsets), "word_chars": code_points - spaces, "n_symbols": of(SYMBOL), "n_dup_lines": duplicate_lines(column),
        "n_repeat_words": per_row(in_repeated_window(codes, offsets), offsets), "n_lines": per_row((data == 10).astype(np.int64), at) + 1,
        "n_upper": of(UPPER), "n_lower": of(LOWER), "n_digits": of(DIGIT), "n_marks": of(OTHER), "n_distinct": distinct,
        "n_sentence_ends": per_row(ends[codes].astype(np.int64) if len(codes) else np.zeros(0, np.int64), offsets),
    }
