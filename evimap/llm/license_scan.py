"""License scan by diagonal voting, with DataFrame functions only.

Each text and template becomes its words. Hashes of all rolling k-grams of the text
meet those of the templates in a join; hits vote for the diagonal text place less
template place. Runs on one diagonal and on neighbouring ones are merged to spans,
and a span is verified by the share of the template's k-grams it covers; one changed
word never costs a template its label, unless it is one of the words that tell licenses apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evimap.llm.common import ascii_lower, kept_table

# fixed value: what stands between words
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: diagonals at most so far apart are neighbours: words put in or left out
REACH = 3
#: the least share of a template's k-grams that a span must cover
MIN_COVER = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False
    #: grams that a span must have: the words that tell this license from others
    needed: tuple[str, ...] = ()


# fixed values: notices that name a license, and the base phrases
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("gpl-3", "licensed under the gnu general public license version 3", needed=("gnu general public", "license version 3")),
    Template("gpl-2", "under the terms of the gnu general public license version 2", needed=("gnu general public", "license version 2")),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl-3", "gnu affero general public license version 3", needed=("gnu affero general", "license version 3")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", needed=("mozilla public license", "v 2 0")),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", needed=("creative commons attribution", "attribution 4 0")),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", needed=("commons attribution sharealike", "sharealike 4 0")),
    Template("cc0", "creative commons zero v1 0 universal public domain dedication", needed=("creative commons zero",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("epl-1", "made available under the terms of the eclipse public license v1 0", needed=("eclipse public license", "license v1 0")),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", needed=("eclipse public license", "license 2 0")),
    Template("epl-2", "made available under the terms of the eclipse public license v 2 0", needed=("eclipse public license", "v 2 0")),
    Template("lgpl", "gnu library general public license"),
)
_FSF = "under the terms of the gnu{} general public license as published by the free software foundation"
#: the header of the Free Software Foundation, in its two usual forms
HEADERS = tuple(
    Template(label, f"{_FSF.format(kind)} {tail}", needed=(f"gnu{kind} general" + ("" if kind else " public"), gram))
    for label, kind, version in (("gpl-2", "", "2"), ("gpl-3", "", "3"), ("agpl-3", " affero", "3"))
    for tail, gram in ((f"either version {version}", f"either version {version}"), (f"version {version} of the license", f"version {version} of")))
_NAMES = (
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl", "lgpl 2 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl-3", "agpl 3 0"), ("bsd", "bsd 2 clause"),
    ("bsd", "bsd 3 clause"), ("mpl-2", "mpl 2 0"), ("cc-by", "cc by 3 0"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 3 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc0", "cc0 1 0"), ("isc", "isc"), ("unlicense", "unlicense"),
    ("epl-1", "epl 1 0"), ("epl-2", "epl 2 0"),
)


def _whole(label: str, text: str) -> Template:
    """A short form of which every gram is needed."""
    words = text.split()
    return Template(label, text, needed=tuple(" ".join(words[i : i + GRAM]) for i in range(len(words) - GRAM + 1)))


#: SPDX lines, and the short names of Creative Commons licenses by themselves
SHORT = tuple(_whole(label, f"spdx license identifier {name}") for label, name in _NAMES) + tuple(_whole(label, name) for label, name in _NAMES if name.startswith("cc"))
TEMPLATES = PHRASES + NOTICES + HEADERS + SHORT


#: the gram that stands for a text itself, so that texts without a hit keep a row
MARK = ""


def words_of(text: Column) -> Column:
    """Lower-cased words; a null is an empty text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _grams(words: Column, k: int) -> Column:
    """Structs of k consecutive words, from place 0, and behind them one of nulls."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    mark = F.array(F.struct(*[F.lit(None).cast("string").alias(f"w{i}") for i in range(k)]))
    return F.concat(F.arrays_zip(*[F.slice(words, i + 1, n).alias(f"w{i}") for i in range(k)]), mark)


def template_grams(spark: SparkSession, templates: tuple[Template, ...], k: int = GRAM) -> DataFrame:
    """(template, label, exact, grams, at, gram): one row for each k-gram of each template."""
    rows, names = [], ("template", "label", "exact", "grams", "at", "gram")
    for number, t in enumerate(templates):
        words = t.text.split()
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {t.text}")
        rows += [(number, t.label, t.exact, len(words) - k + 1, i, " ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    rows.append((-1, "", False, 0, 0, MARK))
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs))).withColumn("__w", F.split(F.nullif("gram", F.lit(MARK)), " ")).withColumn("hash", F.xxhash64(*[F.get("__w", i) for i in range(k)])).drop("__w")


def hits(df: DataFrame, templates: tuple[Template, ...], id_col: str, text: str, k: int) -> DataFrame:
    """Each text's k-grams that occur in a template, with both places, and one marking row (template -1) for each text."""
    # as many rows as the templates have k-grams: bounded by a parameter
    table = F.broadcast(template_grams(df.sparkSession, templates, k))
    words = df.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__text"), words_of(F.col(text)).alias("__words"))
    places = words.select("__id", "__text", F.size("__words").alias("n_words"), F.posexplode(_grams(F.col("__words"), k)).alias("__place", "__gram"))
    parts = [F.col(f"__gram.w{i}") for i in range(k)]
    return places.withColumn("hash", F.xxhash64(*parts)).join(table, "hash").where(F.concat_ws(" ", *parts) == F.col("gram"))


KEYS = ("__id", "__text", "template", "label", "exact", "grams")


def _votes(found: DataFrame) -> DataFrame:
    """Hits added up for each diagonal; a mark keeps the number of its text's rows and words."""
    return found.withColumn("diagonal", F.when(F.col("template") >= 0, F.col("__place") - F.col("at"))).groupBy(*KEYS, "diagonal").agg(
        F.min("__place").alias("low"), F.max("__place").alias("high"), F.collect_set("at").alias("ats"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("rows"))


def spans(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text: str = "text", k: int = GRAM,
          reach: int = REACH, min_cover: float = MIN_COVER) -> DataFrame:
    """(id, text_hash, template, label, exact, first_word, last_word, cover): verified spans of each text.

    An exact template must have all its k-grams on one diagonal, word for word; one
    span is given for each place. Other templates gather neighbouring diagonals and
    need ``min_cover`` of their k-grams, or all but the k that one changed word costs if
    that is less and some are left, and all that the template needs. Repeated rows give their spans once.
    """
    votes = _votes(hits(df, templates, id_col, text, k)).where("template >= 0")
    return _merged(votes, templates, k, reach, min_cover).select(F.col("__id").alias(id_col), F.col("__text").alias("text_hash"), "template", "label", "exact", "first_word", "last_word", "cover")


def _least(template: Template, k: int, min_cover: float) -> int:
    """How many of its k-grams a span of a template must cover."""
    grams = len(template.text.split()) - k + 1
    enough = math.ceil(min_cover * grams - 1e-9)
    return grams if template.exact else min(enough, grams - k) if grams > k else enough


def _needed(template: Template, k: int) -> list[int]:
    """Places of the k-grams that hold a needed phrase, or a part of it where it is longer than they are."""
    words = template.text.split()
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return [i for i, gram in enumerate(grams) if any(f" {x} " in f" {gram} " or f" {gram} " in f" {x} " for x in template.needed)]


def _merged(votes: DataFrame, templates: tuple[Template, ...], k: int, reach: int, min_cover: float) -> DataFrame:
    order = Window.partitionBy(*KEYS).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    # each place of an exact template is a span of its own
    begins = F.col("exact") | gap.isNull() | (gap > reach)
    chained = votes.withColumn("begins", begins.cast("int")).withColumn("chain", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # template places are numbered, so a set of them is as short as the template
    merged = chained.withColumn("at", F.explode("ats")).groupBy(*KEYS, "chain").agg(
        F.min("low").alias("first_word"), (F.max("high") + (k - 1)).alias("last_word"), F.collect_set("at").alias("covered"))
    least = F.get(F.array(*[F.lit(_least(t, k, min_cover)) for t in templates]), F.col("template"))
    needed = F.get(F.array(*[F.array(*[F.lit(i) for i in _needed(t, k)]).cast("array<int>") for t in templates]), F.col("template"))
    return merged.where((F.size("covered") >= least) & (F.size(F.array_except(needed, "covered")) == 0)).withColumn("cover", F.size("covered") / F.col("grams"))


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text: str = "text", k: int = GRAM,
         reach: int = REACH, min_cover: float = MIN_COVER) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row.

    n_base: places of exact templates; first_word and last_word: their smallest and
    largest start; labels: of all verified spans, sorted and joined by commas; score:
    the best cover, 0 without a span. Null and empty texts have no words and no
    span. Repeated rows each give a row with equal values, null ids too; an empty
    table gives none, other columns are not read. Texts are read once.
    """
    # kept: two readers with filters of their own would make Spark read all texts twice
    votes = kept_table(_votes(hits(df, templates, id_col, text, k)), "license-votes")
    marks = votes.where("template < 0").select("__id", "__text", F.col("n_words"), "rows")
    found = _merged(votes.where("template >= 0"), templates, k, reach, min_cover).select("__id", "__text", "label", "exact", "first_word", "cover")
    exact = F.col("exact")
    merged = marks.unionByName(found, allowMissingColumns=True).groupBy("__id", "__text").agg(
        F.max("n_words").cast("long").alias("n_words"), F.max("rows").alias("rows"), F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("first_word"))).cast("long").alias("first_word"), F.max(F.when(exact, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(exact, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"))
    copies = merged.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return copies.select(F.col("__id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
