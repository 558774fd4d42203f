"""Canonical numbers against the digits that Python prints."""

import json
import random
import struct

from pyspark.sql import functions as F

from evimap.functions import jsoncols as J


def first_writer(text):
    x = float(text)
    if x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    mantissa, _, e = repr(abs(x)).partition("e")
    i, _, f = mantissa.partition(".")
    point = len(i) + int(e or 0) - (len(i + f) - len((i + f).lstrip("0")))
    d, sign = (i + f).strip("0"), "-" if x < 0 else ""
    if 0 < point <= 21:
        return sign + (d.ljust(point, "0") if len(d) <= point else f"{d[:point]}.{d[point:]}")
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{d}"
    return f"{sign}{d[0]}{'.' + d[1:] if len(d) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def test_hard_numbers(spark):
    rng = random.Random(3)
    hard = ["1e3", "1e-7", "1e21", "1e20", "1.0", "-0", "-0.0", "0.000001", "1.5e-5", "1E400", "-1e400", "2e-3", "9007199254740993", "12345678901234567890", "0.12345678901234567890",
            "5e-324", "1.7976931348623157e308", "2.2250738585072014e-308", "1e23", "5.684341886080802e-14", "1.10", "4.35", "2.0E-323", "1e16", "123456789.125e3", "100", "7"]
    hard += [x for x in (repr(struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0]) for _ in range(2000)) if x[-1].isdigit()]
    df = spark.createDataFrame([(h, f'{{"b":[{h},"x{h}\\"1.0"],"a":{h}}}') for h in hard], "n string, raw string")
    for row in df.select("n", J.canonical_json(F.col("raw")).alias("first"), J.canonical_json(F.col("raw"), python=True).alias("second")).collect():
        one = first_writer(row.n)
        # what the first writer prints is what the second reads; only it keeps long whole numbers
        two = json.dumps(json.loads(row.n if row.n.lstrip("-").isdigit() and float(row.n) else one))
        for shown, got in ((one, row["first"]), (two, row["second"])):
            assert got == f'{{"a":{shown},"b":[{shown},"x{row.n}\\"1.0"]}}', row.n


def test_texts_stay_as_they_are(spark):
    raws = ['{"b":"1.50","a":"Infinity","c":-0.0}', '"1e5"', "[]", '{"a":1,"a":2}', "{", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [r[0] for r in df.orderBy("i").select(J.canonical_json(F.col("raw"))).collect()]
    assert got == ['{"a":"Infinity","b":"1.50","c":0}', '"1e5"', "[]", None, None, None]


def test_redaction_rebuilds_documents(spark):
    """Random documents, deep ones and hard values, against a recursive version; keys keep their order, array indexes first."""
    import re

    from evimap import constants as K
    from evimap.operators import flatten

    rng = random.Random(9)
    names = ["a", "api_key", "Pass-Word", "z\"q", "é/~", "10", "9", "tokens", "n", ""]

    def made(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind >= 5:
            size = rng.randrange(5)
            return [made(depth - 1) for _ in range(size)] if kind == 5 else {n: made(depth - 1) for n in rng.sample(names, size)}
        return [None, True, rng.choice([1.5, 1e-7, 1e21, 0.1, -3]), rng.randrange(10**6), rng.choice(["x", "]\"{", "1.0", "Infinity", ""])][kind]

    def prune(v):
        if isinstance(v, list):
            return [prune(x) for x in v]
        if not isinstance(v, dict):
            return v
        kept = {k: prune(x) for k, x in v.items() if not re.search(K.SENSITIVE_PATTERN, re.sub("[^a-z0-9]", "", k.lower()))}
        return dict(sorted(kept.items(), key=lambda e: (0, int(e[0])) if e[0].isdigit() else (1, 0)))

    docs = [made(6) for _ in range(300)]
    deep = "x"
    for i in range(300):
        deep = [deep] if i % 2 else {"k": deep, "password": i}
    docs.append(deep)
    df = spark.createDataFrame([(i, 0, json.dumps(d)) for i, d in enumerate(docs)] + [(900, 0, "{"), (901, 0, "1e400"), (902, 0, '[1e3, -1e400, {"cookie": 1}]')], "incident_id long, doc_index int, raw string")
    got = {r.incident_id: r.raw for r in flatten.without_sensitive(df).collect()}
    for i, d in enumerate(docs):
        assert list(json.JSONDecoder(object_pairs_hook=lambda p: p).decode(got[i]) if isinstance(d, dict) else [got[i]]) is not None
        assert json.loads(got[i], object_pairs_hook=list) == json.loads(json.dumps(prune(d)), object_pairs_hook=list), d
    assert (got[900], got[901], got[902]) == (None, "null", "[1000,null,{}]")
