"""What the built-in scorer gives walked scalars, by Arrow batches.

A target's score comes from the words of a leaf's name and, for a little, from those of its value. The
name's part is worked out once for a pointer and role of a batch of documents; only values that hold a word of the
catalogue are looked at by windows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa

from evimap import constants as K

_CAMEL = re.compile("([a-z0-9])([A-Z])")
_OTHERS = re.compile("[^a-z0-9]+")
_LOW_WORDS = re.compile("[0-9a-z]+").findall
_PLAIN_WORDS = re.compile("[0-9A-Za-z]+").findall
#: as the pattern ``^[0-9]+$`` of the JVM, which also ends before a last line end
_NUMERIC = re.compile(r"[0-9]+(?:\r\n|[\n\r\x85  ])?\Z").match
#: names whose scores are kept at once
KEPT = 1 << 14


class _Breaks(dict):
    """Letters and numbers as they are, all else a blank."""

    def __missing__(self, c: int) -> int:
        self[c] = found = c if unicodedata.category(chr(c))[0] in "LN" else 32
        return found


_BREAKS = _Breaks()


def name_words(text: str) -> list[str]:
    """Distinct lower-case word parts, as ``text.name_tokens``."""
    return list(dict.fromkeys(w for w in _OTHERS.split(_CAMEL.sub(r"\1 \2", text).lower()) if w))


def value_words(text: str) -> list[str]:
    """Words of a value, as ``text.value_tokens``."""
    return _PLAIN_WORDS(text) if text.isascii() else text.translate(_BREAKS).split()


def label_of(pointer: str, role: str | None) -> list[str]:
    """Words that name a leaf, as ``candidates.label_tokens``."""
    parts = pointer.split("/")[2:]
    if "~" in pointer:
        parts = [p.replace("~1", "/").replace("~0", "~") for p in parts]
    parent = next((p for p in parts[-2:0:-1] if not _NUMERIC(p)), "")
    return name_words(f"{parent} {parts[-1] if role is None else role}")


@lru_cache(maxsize=1 << 14)
def _rounded(score: float) -> float:
    """To six places, half up, by the decimals that a double prints."""
    return float(Decimal(repr(score)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


class Rating:
    """Adds columns to walked scalars, see :attr:`ddl`; places are those of ``targets`` in the order of the catalogue.

    With ``least`` above 0.1, ``rates`` lists the targets that reach it, and no value is looked at where none can; else it has
    the score of every target, whether the leaf fits its type or not. ``starts`` and ``ends`` (of the best window of each)
    are NULL for a value of one window, which starts at 0 and has all its ``words``; those of a number, whose text is
    printed later, are not counted.
    """

    def __init__(self, targets: Sequence[str] = K.TARGET_NAMES, least: float = 0.0):
        known = [(name, text) for name, _, text, _ in K.TARGETS if name in set(targets)]
        self.tokens = [set(name_words(name)) for name, _ in known]
        self.described = [set(name_words(text)) for _, text in known]
        self.vocabulary = set().union(*self.described)
        self.told_by = {word: [i for i, words in enumerate(self.described) if word in words] for word in self.vocabulary}
        self.least, self.few = least, least > 0.1
        self.ddl = ("rates array<struct<place:int,score:double,start:int,end:int,windows:int>>" if self.few
                    else "rates array<double>, starts array<int>, ends array<int>, windows int, words int")
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str | tuple[str, str], int] = {}
        self.names: list[list[float]] = []
        self.scores: list[list[float]] = []
        self.reach: list[list[tuple[int, float]]] = []
        self.matrix = np.zeros((0, len(self.tokens)))

    def _named(self, pointer: str, role: str | None) -> int:
        """Number of a name's scores."""
        label, names = set(label_of(pointer, role)), []
        for tokens in self.tokens:
            shared = len(label & tokens)
            names.append(shared / (len(label) + len(tokens) - shared) if shared else 0.0)
        self.names.append(names)
        self.scores.append([_rounded(0.9 * name) for name in names])
        self.reach.append([(i, self.scores[-1][i]) for i, name in enumerate(names) if name and 0.9 * name + 0.1 >= self.least - 1e-6])
        self.at[pointer if role is None else (pointer, role)] = found = len(self.names) - 1
        return found

    def _windows(self, words: list[str], lowered: list[str]) -> list[tuple[int, int, set[str], int]]:
        """(start, end, known words, distinct words) of each window."""
        total, step = len(words), K.WINDOW_TOKENS - K.WINDOW_OVERLAP
        found = []
        for start in range(0, max(1, total - K.WINDOW_OVERLAP), step):
            end = min(total, start + K.WINDOW_TOKENS)
            seen = set(lowered[start : max(start + 1, end)])
            found.append((start, end, seen & self.vocabulary, max(1, len(seen))))
        return found

    def _best(self, number: int, windows: list) -> tuple[list[float], list[int], list[int]]:
        """Each target's score and the bounds of its earliest best window; a word told adds to the name's part and takes nothing."""
        scores, names = list(self.scores[number]), self.names[number]
        starts, ends = [windows[0][0]] * len(scores), [windows[0][1]] * len(scores)
        for start, end, known, distinct in windows:
            told: dict[int, int] = {}
            for word in known:
                for place in self.told_by[word]:
                    told[place] = told.get(place, 0) + 1
            for place, count in told.items():
                score = _rounded(0.9 * names[place] + 0.1 * (count / distinct))
                if score > scores[place]:
                    scores[place], starts[place], ends[place] = score, start, end
        return scores, starts, ends

    def _told(self, text: str | None) -> tuple[int, list | None]:
        """How many words a value has, and its windows if they are several or hold a word of the catalogue."""
        if text and text.isascii():
            words = lowered = _LOW_WORDS(text.lower())
        else:
            words = value_words(text) if text else []
            lowered = "\n".join(words).lower().split("\n")
        if len(words) <= K.WINDOW_TOKENS and self.vocabulary.isdisjoint(lowered):
            return len(words), None
        return len(words), self._windows(words, lowered)

    def __call__(self, columns: Sequence[Sequence]) -> list[pa.Array]:
        """The columns that belong to those of walked rows, which begin with pointer, key, position, role, type and text."""
        if len(self.names) > KEPT:
            self._clear()
        pointers, _, _, roles, kinds, texts = columns[:6]
        get, named = self.at.get, self._named
        numbers = []
        for pointer, role in zip(pointers, roles, strict=True):
            number = get(pointer if role is None else (pointer, role))
            numbers.append(named(pointer, role) if number is None else number)
        return self._listed(numbers, kinds, texts) if self.few else self._all(numbers, kinds, texts)

    def _listed(self, numbers: list[int], kinds: Sequence[str], texts: Sequence[str | None]) -> list[pa.Array]:
        reach, least = self.reach, self.least
        sizes, flat = [0] * len(numbers), []
        for i, number in enumerate(numbers):
            if not (near := reach[number]):
                continue
            before = len(flat)
            total, windows = (0, None) if kinds[i] == "number" else self._told(texts[i])
            if windows is None:
                flat.extend((place, score, 0, total, 1) for place, score in near if score >= least)
            else:
                scores, first, last = self._best(number, windows)
                flat.extend((place, scores[place], first[place], last[place], len(windows)) for place, _ in near if scores[place] >= least)
            sizes[i] = len(flat) - before
        types = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
        listed = list(zip(*flat, strict=True)) if flat else [()] * 5
        rows = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(listed, types, strict=True)], names=["place", "score", "start", "end", "windows"])
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), rows)]

    def _all(self, numbers: list[int], kinds: Sequence[str], texts: Sequence[str | None]) -> list[pa.Array]:
        count, width = len(numbers), len(self.tokens)
        words, several, starts, ends, own = [0] * count, {}, {}, {}, {}
        for i, text in enumerate(texts):
            if text and kinds[i] != "number":
                words[i], windows = self._told(text)
                if windows is not None:
                    own[i], first, last = self._best(numbers[i], windows)
                    if len(windows) > 1:
                        several[i], starts[i], ends[i] = len(windows), first, last
        if len(self.matrix) < len(self.scores):
            self.matrix = np.array(self.scores, np.float64)
        scores = self.matrix[np.array(numbers, np.int64)] if count else np.zeros((0, width))
        for i, rated in own.items():
            scores[i] = rated
        windows = np.ones(count, np.int32)
        windows[list(several)] = list(several.values())
        rates = pa.ListArray.from_arrays(pa.array(np.arange(0, (count + 1) * width, width), pa.int32()), pa.array(scores.ravel(), pa.float64()))
        bounds = [pa.array([of.get(i) for i in range(count)], pa.list_(pa.int32())) if of else pa.nulls(count, pa.list_(pa.int32())) for of in (starts, ends)]
        return [rates, *bounds, pa.array(windows), pa.array(words, pa.int32())]
