"""Each corpus operator against a brute-force version, on small hard cases and on whole small tables."""

import hashlib
import html
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from evimap.llm import bpe, license_scan, near_dedup, quality_crf, quality_rules, source_mixing, statistics, substring_dedup, token_counts, topk_search, url_reputation

from evimap.llm.common import sliced

LONG = " ".join(f"w{i}" for i in range(300))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, class_id string"
TEXTS = [
    (1, LONG), (2, LONG), (3, "x " * 40 + " ".join(f"w{i}" for i in range(100, 170)) + " tail"), (4, None), (5, ""), (6, "  \n\t "), (7, "short text"),
    (8, "under the MIT-License; under the mit license. Licensed under CC BY-NC 4.0.\n\nAPACHE license,  version 2.0"), (9, "a" * 3000), (10, "na\u00efve \u03a3\u03a3 \u4f60\u597d <|endoftext|> it's  two\n\nlines \u00a0x\x1cy "),
    (11, "same line\nsame line\n\n\nother#$%&|<> line"), (12, LONG.replace("w150 ", "changed ")), (12, LONG.replace("w150 ", "changed ")), (None, LONG), (13, "a b c d e a b c d e a b c d e"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None if i == 3 else f"s{(i or 0) % 3}", None, "x", "y", "z") for i, t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_token_counts(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2) for i, t in TEXTS]
    for size in (4, 1000):
        got = token_counts.count_tokens(docs, path, limit=2, table_size=size, cache_size=5)
        assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_bpe_round_trip(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(docs, path, ids="score"), path, ids="score", text="n_words")
    want = []
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert rows(got, "doc_id", "score", "n_words") == sorted(want, key=str)
    assert bpe.encode(empty, path).count() == 0


def test_bpe_workers_hold_little(spark, monkeypatch):
    import corpus_pipeline

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encoded(pa.array(["some words", None]), path)
    monkeypatch.setattr(bpe, "_loaded", {})
    assert bpe.decoded(ids, path).to_pylist() == ["some words", ""] and not bpe._loaded  # decoding needs no merges
    docs = spark.createDataFrame([(1, "some words", "en", "a"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    both = corpus_pipeline.encode(spark, docs, "")
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # a task feeds one worker
    assert sorted((r.doc_id, r.round_trip, len(r.token_ids) == r.n_tokens) for r in both.collect()) == [(1, True, True), (2, True, True)]


@pytest.mark.parametrize("text", [" a  b", "a \n b", "\n\n a", "a\t b ", "  ", " <|endoftext|> <|endoftext|>x", "don't  'RE we've", "x" * 200 + " y", "\u00a0 a \u2003b", "1 23  4.5 !?"])
def test_bpe_white_space(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = np.frombuffer(bpe.loaded(path).encode(text), "<u4").tolist()
    assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(k, k + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 14)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    trees = quality_rules.fit_on(docs, labels)
    got = quality_rules.judge(docs, trees).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == sorted(((i, *base_counts(t)) for i, t in TEXTS), key=str)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed and r.score >= 0.3) for r in got)
    assert quality_rules.judge(empty, quality_rules.fit_on(empty, labels)).count() == 0


def test_trees_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality_rules.FEATURES)))
    y = ((x[:, 2] < 0.4) ^ (rng.random(600) < 0.1)).astype(float)
    trees = quality_rules.fit(x, y, trees=20)
    grid = np.repeat(x[:50], 30, axis=0)
    grid[:, 2] = np.tile(np.linspace(0, 1, 30), 50)
    score = trees.score(grid).reshape(50, 30)
    assert (np.diff(score, axis=1) <= 1e-12).all() and ((trees.score(x) > 0.5) == (y == 1)).mean() > 0.85


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(2)
    score, offsets, good, bad = rng.normal(size=9), np.array([0, 4, 5, 9]), 0.7, 0.3
    got = quality_crf._forward_backward(score, offsets, good, bad)[0]
    for a, b in zip(offsets, offsets[1:], strict=False):
        total, on = 0.0, np.zeros(b - a)
        for path in range(2 ** (b - a)):
            s = [path >> k & 1 for k in range(b - a)]
            w = math.exp(sum(v * z for v, z in zip(s, score[a:b], strict=True)) + sum((good if p else bad) * (p == q) for p, q in zip(s, s[1:], strict=False)))
            total, on = total + w, on + w * np.array(s)
        assert np.allclose(got[a:b], on / total)


def test_quality_classifier(spark, docs, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality_crf.fit_on(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    got = quality_crf.line_quality(docs, field).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.doc_id: len(r.line_good) for r in got}[11] == 5
    held = quality_crf.line_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), field).join(labels.where("crc32(cast(doc_id as string)) % 5 = 0"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    none = quality_crf.fit_on(empty, labels)
    assert quality_crf.line_quality(empty, none).count() == 0


def test_url_filters(spark):
    from evimap.llm.queries import RULES

    urls = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", "x://example.org/en/2#y", "http://a.com/fr/", "http://com/de/1", "nothing", None, "http://notcom/fr/", "http://b.net?a/b", "http://example.org", "://h/p"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z"), (None, "http://b.net/x", "z")], "page_id long, url string, host string")
    good = spark.createDataFrame([(i, int(i != 8)) for i in range(len(urls))] + [(8, None)], "page_id long, good int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, good, RULES).collect()}
    assert [(got[i].host, got[i].path, got[i]["rule"]) for i in range(len(urls))] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("a.com", "/fr/", "com/fr/"),
        ("com", "/de/1", "com/de/"), ("", "", None), ("", "", None), ("notcom", "/fr/", None), ("b.net", "", None), ("example.org", "", None), ("h", "/p", None)]
    assert [got[i].verdict for i in range(5)] == ["block", "block", "allow", "allow", "block"] and got[8].verdict == "block"
    assert url_reputation.judge_urls(pages.limit(0), good, RULES).count() == 0
    assert url_reputation.judge_urls(pages, good.limit(0), RULES).count() == len(urls) + 2


def test_shrinking_goes_towards_the_domain(spark):
    rows = [(f"h{i}.bad.com", int(j == 0)) for i in range(20) for j in range(5)] + [(f"h{i}.good.com", 1) for i in range(20) for _ in range(5)] + [("new.bad.com", None), ("new.good.com", None)]
    got = {r.host: r for r in url_reputation.reputations(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert got["new.bad.com"].mean < 0.4 < 0.8 < got["new.good.com"].mean and all(r.bound <= r["mean"] for r in got.values())


def test_outcomes_follow_the_page_text(spark):
    texts = ["A & B <i>\n\nc d", "other\ttext", "it's \"3\" &amp;", None]
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[1] + "\n")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (7, 1)], "doc_id long, quality int")
    article = "<nav>other text</nav><!-- <article>no</article --><article class='x'><h1>A &amp; B</h1><p>A &amp; B\n&lt;i&gt;<br>c <b>d<script>var t='</p>';</script></article><p>more"
    pages = spark.createDataFrame([(1, article), (2, "<p>other</p> text<style>p{}</style>"), (5, "<article>it&#x27;s &quot;3&quot; &amp;amp;</article>"), (3, "<p>unknown</p>"), (0, None)], "page_id long, html string")
    got = url_reputation.content_outcomes(pages, docs, labels)
    assert rows(got, "page_id", "good") == [(1, 1.0), (2, 0.5), (5, 1.0)]
    pages, docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "documents", "labels"))
    own = {r.page_id: r.good for r in url_reputation.content_outcomes(pages, docs, labels).collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    clean = lambda t: "".join(t.split())
    known = {clean(r.text): quality[r.doc_id] for r in docs.collect() if r.doc_id in quality}
    want = {}
    for r in pages.collect():
        body = re.search(r"<article><h1>.*?</h1>(.*)</article>", r.html, re.S)[1]
        key = clean(html.unescape(re.sub(r"<[^>]*>", "", body)))
        if key in known:
            want[r.page_id] = known[key]
    assert own == want and len(want) > 90


def test_hosts_are_blocked_only_below_the_overall_rate(spark):
    urls = [(i, f"http://{h}/") for i, h in enumerate(["bad.a.com"] * 40 + ["good.b.com"] * 200 + ["few.b.com"] * 2 + ["new.c.com"])]
    good = [(i, int(i % 8 == 0)) for i in range(40)] + [(i, int(i % 10 > 0)) for i in range(40, 240)] + [(240, 1), (241, 0)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.host: r.verdict for r in url_reputation.judge_urls(pages, spark.createDataFrame(good, "page_id long, good int"), ()).collect()}
    assert got == {"bad.a.com": "block", "good.b.com": "allow", "few.b.com": "allow", "new.c.com": "allow"}
    none = url_reputation.judge_urls(pages, spark.createDataFrame([], "page_id long, good int"), ()).collect()
    assert len(none) == len(urls) and {r.verdict for r in none} == {"allow"}


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_source_mixing(spark, docs, empty):
    weights = {"s0": 3.0, "s1": 1.0, source_mixing.OTHER: 2.0}
    bucket = {i: f"s{(i or 0) % 3}" if i != 3 and (i or 0) % 3 < 2 else "*" for i, _ in TEXTS}
    size = Counter()
    for i, t in TEXTS:
        size[bucket[i]] += len((t or "").encode())
    rate = {b: weights[b] / 6 * sum(size.values()) / size[b] for b in size}
    want = []
    for i, t in TEXTS:
        u = int(hashlib.md5(f"7:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        want += [(i, t, c) for c in range(poisson(u, rate[bucket[i]]))]
    got = source_mixing.mix(docs, weights, copy_col="score")
    assert rows(got, "doc_id", "text", "score") == sorted(want, key=str)
    assert source_mixing.mix(empty, weights).count() == 0 and source_mixing.mix(docs, {"none": 1.0}).count() == 0


def test_source_mixing_equals_its_sql(spark):
    import __spark_entry__ as entry
    import check

    folder, name = "/root/testdata/sf0.001", "op6_source_mixing"
    problem, n = check.compare(spark, check.connect(folder), folder, name, entry.queries()[name], entry.oracle_sql()[name])
    assert not problem and n > 100


def test_a_source_without_bytes_keeps_its_rows(spark):
    source = {0: "full", 1: "blank", 2: None}
    docs = spark.createDataFrame([(i, source[i % 3], ("x" * 10, "", None)[i % 3]) for i in range(300)], "doc_id long, source string, text string")
    got = Counter(r.source for r in source_mixing.mix(docs, {"full": 1.0, "blank": 1.0, source_mixing.OTHER: 1.0}).collect())
    def unit(i):
        return int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) / 2**52
    assert got == Counter(source[i % 3] for i in range(300) for _ in range(poisson(unit(i), 1.0)))
    assert {r.source for r in source_mixing.mix(docs, {"full": 1.0, "blank": 1.0}).collect()} == {"full", "blank"}
    blank = docs.where("source = 'blank'")
    assert source_mixing.mix(blank, {"blank": 1.0}).count() == got["blank"] and source_mixing.mix(docs, {"none": 1.0}).count() == 0


def test_license_scan(docs, empty):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = []
    for i, t in TEXTS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        found = [(k, p.label) for p in license_scan.PHRASES for q in [p.text.split()] for k in range(len(words)) if words[k : k + len(q)] == q]
        at = [k for k, _ in found]
        want.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    got = license_scan.scan(docs)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=str)
    assert license_scan.scan(empty).count() == 0


def test_license_spans_bridge_a_changed_word(spark):
    text = "x y redistribution and use in source and binary forms with or without any modification are permitted provided that the following conditions are met z"
    got = license_scan.scan(spark.createDataFrame([(1, text), (2, "redistribution and use in source")], "doc_id int, text string")).collect()
    assert {r.doc_id: r.labels for r in got} == {1: "bsd", 2: ""} and {r.doc_id: r.score for r in got}[1] > 0.8


def test_usual_license_notices_are_found(spark):
    fsf = "under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or"
    cases = [
        (fsf.format("", 3), "gpl-3"), (fsf.format("", 2), "gpl-2"), (fsf.format("Affero ", 3), "agpl-3"), (fsf.format("", 3).replace("published", "issued"), "gpl-3"), (fsf.format("Lesser ", 3), "lgpl"),
        ("under the terms of the GNU General Public License version 3", "gpl-3"), ("under the terms of the GNU General Public License version 2", "gpl-2"),
        ("licensed under the Creative Commons Attribution 4.0 International License", "cc-by"), ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
        ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ""), ("CC BY 4.0", "cc-by"), ("CC BY-SA 4.0", "cc-by-sa"), ("CC BY-NC 4.0", "cc-by-nc"),
        ("// SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2"), ("SPDX-License-Identifier: LGPL-2.1", "lgpl"), ("SPDX-License-Identifier: AGPL-3.0", "agpl-3"), ("SPDX license", ""),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"), ("made available under the terms of the Eclipse Public License 2.0", "epl-2"), ("free software of the public", ""),
    ]
    got = license_scan.scan(spark.createDataFrame([(i, f"x y {t} z") for i, (t, _) in enumerate(cases)], "doc_id int, text string")).collect()
    assert {cases[r.doc_id][0]: r.labels for r in got} == dict(cases)


def cut(texts, window=50):
    first = {}
    for i, t in texts:
        words = (t or "").encode().split()
        for k in range(len(words) - window + 1):
            if i is not None:
                first[tuple(words[k : k + window])] = min(i, first.get(tuple(words[k : k + window]), i))
    for i, t in texts:
        words = (t or "").encode().split()
        gone = {z for k in range(len(words) - window + 1) if i is not None and first[tuple(words[k : k + window])] < i for z in range(k, k + window)}
        yield i, len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()


def test_substring_dedup(docs, empty):
    got = substring_dedup.removals(docs)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(cut(TEXTS), key=str)
    kept = substring_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and {1, 3, 4} <= {r.doc_id for r in kept.collect()} and 2 not in {r.doc_id for r in kept.collect()}
    assert substring_dedup.removals(empty).count() == 0


def truth(texts):
    bags = [(i, near_dedup.bag(t)) for i, t in texts if i is not None]
    group = {i: i for i, _ in bags}
    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            if near_dedup.similarity(a, b) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = {k: low if v == high else v for k, v in group.items()}
    return group


def test_near_dedup(docs, empty):
    group = truth(TEXTS)
    assert {(r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect()} == {(i, group.get(i)) for i, _ in TEXTS}
    assert near_dedup.classes(empty).count() == 0 and near_dedup.deduplicate(docs).columns == docs.columns


def test_one_id_with_two_texts_is_two_documents(spark):
    rows_ = [(1, LONG), (2, LONG), (2, "a text of its own"), (2, "a text of its own"), (3, "a text of its own"), (4, None), (4, "last"), (None, LONG)]
    got = near_dedup.deduplicate(spark.createDataFrame(rows_, "doc_id long, text string"))
    assert rows(got, "doc_id", "text") == sorted([(1, LONG), (2, "a text of its own"), (4, None), (4, "last"), (None, LONG)], key=str)


def test_near_dedup_chain(spark):
    words = [f"t{i}" for i in range(400)]
    texts = []
    for i in range(12):  # each differs a little from the one before, the ends a lot
        words[i * 12] = words[i * 12] + "x"
        texts.append((i, " ".join(words)))
    assert {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(texts, "doc_id int, text string")).collect()} == truth(texts)


def test_cross_pairs_spare_the_largest_class(spark):
    """One large class and few others: settled pair by pair, every pair across classes given once, none within a class."""
    of = {i: 1 if i <= 60 else 61 + (i - 61) // 2 for i in range(1, 63)}
    many = {i: i for i in range(101, 141)}
    placed = spark.createDataFrame([(7, i, c, 10) for i, c in of.items()] + [(8, i, c, 10) for i, c in many.items()] + [(9, 1, 1, 10), (9, 2, 1, 10)], "bucket long, id long, class long, weight long")
    mixed = near_dedup._mixed(placed)
    assert {(r["bucket"], r["few"], r["shingles"], r["outside"]) for r in mixed.collect()} == {(7, True, 620, 20), (8, False, 400, 390)}
    got = rows(near_dedup._crossed(placed.join(mixed, "bucket"), 0.8), "a", "b", "class_a", "class_b")
    want = [(a, b, x[a], x[b]) for x in (of, many) for a in x for b in x if a < b and x[a] != x[b]]
    assert got == sorted(want, key=str)


def test_near_dedup_of_a_large_family(spark, monkeypatch):
    """Hundreds of changed copies of one text, some linked and some not, in buckets that are settled in many blocks."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(400):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 12)):
            words[at] = f"n{rng.integers(0, 10**6)}"
        texts.append((i, " ".join(words)))
    monkeypatch.setattr(near_dedup, "CHUNK", 37 * 150)
    monkeypatch.setattr(near_dedup, "SMALL", 0)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = truth(texts)
    assert len(set(want.values())) > 5 and {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()} == want
    kept = [r.doc_id for r in near_dedup.deduplicate(df).collect()]  # its ids are structs
    of_class = sorted(want[i] for i in kept)
    assert of_class == sorted(set(want.values()))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    values = rng.integers(1, 2**62, 60).astype(np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    rows_of = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    s = near_dedup.signatures(rows_of, np.concatenate([values[a > 0], values[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def brute_search(texts, k):
    """The k best of each text by BM25, equal scores by id."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [(i, Counter(x for x in (w.decode().strip(topk_search.MARKS) for w in (t or "").translate(lower).encode().split()) if x)) for i, t in texts if i is not None]
    n, average = len(bags), sum(b.total() for _, b in bags) / len(bags)
    of = Counter(t for _, b in bags for t in b)
    want = {}
    for q, asked in bags:
        scores = [(sum(math.log(1 + (n - of[t] + 0.5) / (of[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * b.total() / average)) for t in asked if t in b), i) for i, b in bags]
        best = sorted((-round(s, 9), i) for s, i in scores if s > 0)[:k]
        if best:
            want[q] = [(i, -s) for s, i in best]
    return want


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r.doc_id, round(r.score, 9)))
    return got


def ids(of):
    return {q: [i for i, _ in v] for q, v in of.items()}


def test_topk_search(docs, empty):
    assert ids(found(topk_search.search(docs, docs, k=3, block_terms=200))) == ids(brute_search(TEXTS, 3))
    assert topk_search.search(empty, empty).count() == 0


@pytest.mark.parametrize(("shard_bytes", "block", "partitions"), [(300, 2, 1), (2000, 4, 2), (1 << 24, 8, 1)])
def test_topk_search_over_many_shards(spark, monkeypatch, shard_bytes, block, partitions):
    """One Arrow batch is cut into many shards and many pieces of queries; marks, upper case, nulls and bytes beyond ASCII between the cuts."""
    rng = np.random.default_rng(5)
    vocabulary = [f"Wörd{i}," if i % 3 else f"w{i}" for i in range(400)]
    texts = [(i, None if i % 41 == 7 else " ".join(vocabulary[min(int(x), 399)] for x in rng.zipf(1.4, rng.integers(0, 60)))) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartitionByRange(partitions, "doc_id")
    monkeypatch.setattr(topk_search, "sliced", lambda batch, most=500, cut=topk_search.sliced: cut(batch, min(most, 1 << 24)))
    got = found(topk_search.search(df, df, k=5, shard_bytes=shard_bytes, block=block))
    want = brute_search(texts, 5)
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in v]) for q, v in want.items())
    assert ids(got) == ids(want)


def test_slices_start_at_their_own_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["aB", None, "CD", "é", ""]), pa.array([[1], [2, 3], None, [], [4]])], names=["t", "l"])
    pieces = list(sliced(batch, 2))
    assert len(pieces) > 2 and pa.Table.from_batches(pieces).to_pydict() == batch.to_pydict()
    assert all(c.offset == 0 for p in pieces for c in p.columns)


def test_statistics_fall_back_on_equal_hashes(monkeypatch):
    codes, offsets = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 9]), np.array([0, 11])
    want = statistics.in_repeated_window(codes, offsets).tolist()
    monkeypatch.setattr(statistics, "mix", lambda h: h * np.uint64(0))
    assert statistics.in_repeated_window(codes, offsets).tolist() == want == [1] * 10 + [0]


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.kept_table(stage(spark, docs, folder), "test")
        seen[name] = (before, docs)
        assert name == "bpe" or docs.columns == before.columns
    before, after = seen["near_dedup"]
    group = truth([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == set(group.values())
    before, after = seen["substring_dedup"]
    left = {r.doc_id: hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() for r in after.collect()}
    assert left == {i: h for i, n, gone, h in cut([(r.doc_id, r.text) for r in before.collect()]) if not n or gone < n}
    before, after = seen["bpe"]
    assert after.count() == before.count() and after.where("not round_trip").isEmpty()
    assert corpus_pipeline.run(spark, folder).count() == after.count()
