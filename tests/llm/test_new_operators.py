"""WARC archives, phrase collocations and Merkle manifests against brute force and exact round trips."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from evimap.llm import collocations, merkle_manifest, warc
from evimap.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
PAGES = [(1, "http://a\n\x07b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (1, "z", "x"), (5, "é", "WARC/1.1\r\n\r\n é" * 3000), (9, "", "x" * 100_000), (7, "u", "x" * 100_000)]


def archived(page, least):
    """(id, bytes, digest, type, refers to) of each page."""
    firsts = {}
    for i, _, html in page:
        if i is not None:
            firsts[html or ""] = min(firsts.get(html or "", i), i)
    out = []
    for i, _, html in page:
        data = (html or "").encode()
        again = i is not None and len(data) >= least and i > firsts[html or ""]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", firsts[html or ""] if again else None))
    return sorted(out, key=str)


def read_back(spark, path):
    rows = warc.read(spark, path, [("record_type", "in", ["response", "revisit"])])
    size = F.when(F.col("record_type") == "revisit", F.col("http_headers")["content-length"].cast("long")).otherwise(F.length("payload"))
    got = rows.select(warc.page_of(F.col("record_id"), pages_type()), size, F.substring("payload_digest", 6, 32), "record_type", warc.page_of(F.col("refers_to"), pages_type()))
    return sorted(map(tuple, got.collect()), key=str)


def pages_type():
    from pyspark.sql.types import LongType

    return LongType()


@pytest.mark.parametrize("least", [0, 1, 1000])
def test_archive_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload int").repartition(3)
    path = str(tmp_path / "archive")
    warc.archive_pages(pages, path, least_bytes=least, splitbytes=200, filebytes=5000)
    assert read_back(spark, path) == archived(PAGES, least)
    payloads = warc.read(spark, path, [("record_type", "=", "response")], split_bytes=300)
    assert payloads.rdd.getNumPartitions() > 2
    for row in payloads.collect():
        assert base64.b32encode(hashlib.sha1(row.payload).digest()).decode() == row.payload_digest[5:]
    assert {r.target_uri for r in payloads.collect()} >= {"http://a%0A%07b", "é"}


def test_archive_predicates(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.archive_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    everything = warc.read(spark, path).collect()
    cases = [(("record_type", "=", "revisit"), lambda r: r.record_type == "revisit"), (("target_uri", "not in", ["u"]), lambda r: r.target_uri not in (None, "u")),
             (("target_uri", "null", None), lambda r: r.target_uri is None), (("warc-profile", "starts with", "http"), lambda r: "warc-profile" in r.headers),
             (("refers_to", "in", ("<urn:page:1>", "?")), lambda r: r.refers_to == "<urn:page:1>"), (("target_uri", "contains", "%"), lambda r: "%" in (r.target_uri or ""))]
    for case, keep in cases:
        got = warc.read(spark, path, [case], payload=False).collect()
        assert sorted(r.record_id for r in got) == sorted(r.record_id for r in everything if keep(r)) and all(r.payload is None for r in got)
    spark.conf.set(warc.PUSHDOWN, "true")
    try:
        pushed = warc.read(spark, path, pushdown=True).where((F.col("record_type") == "revisit") & ~F.col("refers_to").isin("q", "z"))
        assert "Filter" not in pushed._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
        assert pushed.count() == sum(r.record_type == "revisit" for r in everything)
    finally:
        spark.conf.unset(warc.PUSHDOWN)


def test_foreign_archives(spark, tmp_path):
    """Plain files, one gzip member for all records, and members without lengths, none with an index; a task's lost files are not read."""
    records = [("a", b"abc"), ("b", b""), ("c", b"x\r\n\r\nWARC/1.1\r\n" * 3000)]
    blocks = [warc.record([("WARC-Type", k), ("WARC-Record-ID", k), ("Content-Type", "text/plain")], body) for k, body in records]
    (tmp_path / "plain.warc").write_bytes(b"".join(blocks))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(blocks)))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(map(gzip.compress, blocks)))
    (tmp_path / "told.warc.gz").write_bytes(b"".join(map(warc.member, blocks)))
    got = warc.read(spark, str(tmp_path)).collect()
    assert Counter((r.record_type, bytes(r.payload)) for r in got) == {r: 4 for r in records}
    assert sorted(r.length for r in warc.read(spark, str(tmp_path), [("record_type", "=", "c")], payload=False).collect()) == [len(records[2][1])] * 4
    assert warc.skip_length(gzip.compress(b"x")) is None and warc.skip_length(warc.member(b"x")) == len(warc.member(b"x"))
    path = tmp_path / "archive"
    warc.archive_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"), str(path))
    (path / "part-lost.warc.gz").write_bytes(warc.member(blocks[0])[:-20])
    assert read_back(spark, str(path)) == archived(PAGES, 0)


def test_empty_archive(spark, tmp_path):
    warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none"), [("record_type", "=", "response")]).count() == 0


TEXTS = [
    ("en", "New York city. New York city, new york\tCITY! new  york city"), ("en", "a b c d e a b c d e a b c d"), ("en", None), (None, "x y x y x y. x"), ("und", "x y x y"), ("de", ""), ("de", " . ,\n"),
    ("en", "new york; york new\nnew\x0byork"), ("fr", "Été été Été été"), ("en", "w " * 200), ("en", "a b c d e a b c d e a b c d"), ("x", "q" * 5000),
]


def brute_collocations(texts, least, share, top):
    counts, words_of = {}, Counter()
    for lang, text in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = tuple(w for w in re.split("[\x20\x09]+", piece) if w)
            words_of[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang or "und", Counter())[words[i : i + k]] += 1
    out = []
    for lang, f in counts.items():
        found, kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, []
        for p, a in found.items():
            score, _, left, right = min(((2_000_000 * a) // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = (b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if not any(Fraction(b, a) >= Fraction(share, 100) for b in inside):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words_of[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "cells"), [(2, 2000, 1 << 16), (2, 3, 1 << 12), (1, 2000, 1 << 14), (3, 2000, 1 << 20), (300, 5, 1 << 12)])
def test_collocations(spark, least, top, cells):
    df = spark.createDataFrame([(t, g, "n", "w", 7) for g, t in TEXTS * 2], "text string, lang string, n string, phrase string, w1 int").repartition(5)
    got = collocations.collocations(df, least=least, top=top, cells=cells)
    assert sorted(map(tuple, got.collect())) == brute_collocations(TEXTS * 2, least, 80, top)
    assert collocations.collocations(df.limit(0), cells=cells).count() == 0


def test_collocations_with_full_cells(spark, docs_small):
    """Cells that overflow shorten nothing, and the result is the same."""
    texts = [(r.lang, r.text) for r in docs_small.select("lang", "text").collect()]
    got = [sorted(map(tuple, collocations.collocations(docs_small, least=5, cells=cells).collect())) for cells in (1 << 12, 1 << 22)]
    assert got[0] == got[1] == brute_collocations(texts, 5, 80, 2000)


@pytest.fixture(scope="module")
def docs_small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def brute_manifest(rows, fanout):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        proofs = [[] for _ in nodes]
        for level in range(100):
            if len(nodes) == 1:
                return nodes[0], proofs
            for i, proof in enumerate(proofs):
                at = i // fanout**level
                start = at - at % fanout
                proof.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + fanout])))
            nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], digest("".join(map(field, row)))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = [tree([leaf for _, leaf in groups[g]]) for g in names]
    root, upper = tree([s for s, _ in subs])
    return sorted(((i, g, leaf, sub, root, tuple(p + u)) for g, (sub, proofs), u in zip(names, subs, upper, strict=True) for (i, leaf), p in zip(groups[g], proofs, strict=True)), key=str)


@pytest.mark.parametrize(("fanout", "levels", "sizes"), [(2, 1, [1, 2, 3, 5, 11, 37]), (3, 1, [40, 1, 9]), (8, 1, [600, 65, 64]), (2, 2, [21]), (8, 4, [30]), (2, 1, [1])])
def test_manifest(spark, fanout, levels, sizes):
    rng = random.Random(fanout)
    rows = [(i if i != 4 else None, (None, "aé", "-", "=", "", "z")[g], None if i % 5 == 0 else "x" * (i % 7)) for g, n in enumerate(sizes) for i in rng.sample(range(1000), n)]
    rows += rows[:2] if len(rows) > 1 else []
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, lang string, text string, key string").repartition(5)
    got = merkle_manifest.manifest(df, ["doc_id", "lang", "text"], carried={"leafless": F.length("text")}, fanout=fanout, levels=levels).cache()
    assert sorted(((r.doc_id, r.lang, r.leaf, r.subroot, r.root, tuple((p.before, p.after) for p in r.proof)) for r in got.collect()), key=str) == brute_manifest(rows, fanout)
    assert got.where(merkle_manifest.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert merkle_manifest.manifest(df.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("name", ["op11_warc", "op12_phrase_collocations", "op13_merkle_manifest"])
def test_sql(spark, name):
    from check import compare, connect

    assert compare(spark, connect(SMALL), SMALL, name, QUERIES[name], ORACLES[name]) [0] == ""
