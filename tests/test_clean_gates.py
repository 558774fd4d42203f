"""The cheap looks at a text's ends and inside it leave out no text that the patterns would change."""

import random

from pyspark.sql import functions as F

from evimap import constants as K
from evimap.functions import text as T

_TRIM = f"^[{K.SPACES}]+|[{K.SPACES}]+$"


def _rows(spark):
    rng = random.Random(9)
    pieces = ["a", "Z9", "-", "~", "!", "é", "٣", "\U0001f600", " ", "  ", "\t", "\n", "\r", "\x0b", "\x0c", " ", "\u0085", " ", "　", "﻿", "\x00", "\x7f", "\x1f"]
    texts = {"".join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(3000)}
    return spark.createDataFrame([(t,) for t in sorted(texts)] + [(None,)], "t string")


def test_gated_cleaning_equals_the_patterns(spark):
    given = F.coalesce("t", F.lit(""))
    spaced = F.regexp_replace(F.translate(given, " ", " "), "[ \t]+", " ")
    cleaned = F.regexp_replace(F.regexp_replace(spaced, f"[{K.SPACES}]*\n[{K.SPACES}]*", "\n"), _TRIM, "")
    ends = f"^[{K.SPACES}]|[{K.SPACES}]$"
    cleaned = F.when(given.rlike(f"[\t\n ]|  |{ends}"), cleaned).otherwise(given)
    rows = _rows(spark).select(
        "t", T.trim_all(F.col("t")).alias("trim"), F.regexp_replace("t", _TRIM, "").alias("trim_"),
        T.clean_text(F.col("t")).alias("clean"), cleaned.alias("clean_"),
        T.bounded_text(F.col("t")).alias("bounded"), F.regexp_replace(F.translate(given, "\x00", ""), _TRIM, "").alias("bounded_"),
    ).collect()
    assert [r for r in rows if (r.trim, r.clean, r.bounded) != (r.trim_, r.clean_, r.bounded_)] == []
    assert any(r.clean != r.t for r in rows) and len(rows) > 1000
