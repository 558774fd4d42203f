"""The ten operators bound to the test tables with production parameters."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap.llm import bpe, collocations, license_scan, merkle_manifest, near_dedup, quality_crf, quality_rules, source_mixing, substring_dedup, token_counts, topk_search, url_reputation, warc
from evimap.llm.common import ascii_lower, documents, with_arrow

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out)
    field = quality_crf.fit_on(documents(spark, folder), labels)
    return quality_crf.line_quality(documents(spark, folder), field).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trees = quality_rules.fit_on(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return quality_rules.judge(documents(spark, folder), trees)


def _digests(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    return [pa.array(np.diff(offsets).astype(np.int64)), pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(offsets, offsets[1:], strict=False)], pa.string()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts.to_pylist()], pa.string())]


@query
def op8_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded and decoded in one pass, so ids and texts don't travel between Spark and Python."""
    path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        ids = bpe.encoded(batch.column("text"), path)
        return _digests(ids, bpe.decoded(ids, path))

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return with_arrow(documents(spark, folder), ["doc_id", "text"], added, run, dropped=("text",))


RULES = (
    url_reputation.Rule("org", "/", "allow"), url_reputation.Rule("example.org", "/es/", "block"), url_reputation.Rule("example.org", "/en/1", "block"),
    url_reputation.Rule("com", "/fr/", "allow"), url_reputation.Rule("com", "/de/", "block"),
)


@query
def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """A page's outcome is the quality label of the documents with its text."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    outcomes = url_reputation.content_outcomes(pages, documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return url_reputation.judge_urls(pages, outcomes, RULES)


#: twice as much of the first sources as of the rest together
WEIGHTS = {"src0": 0.2, "src1": 0.15, "src2": 0.1, "src3": 0.05, source_mixing.OTHER: 0.5}


@query
def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = source_mixing.mix(documents(spark, folder), WEIGHTS, order_col="place")
    return mixed.select("doc_id", "source", "copy", "place", F.octet_length("text").cast("long").alias("n_bytes"))


@query
def op10_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(documents(spark, folder))


@query
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.removals(documents(spark, folder)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.classes(documents(spark, folder))


@query
def op9_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """Queries: every document whose id is divisible by 100."""
    rows = documents(spark, folder)
    return topk_search.search(rows, rows.where(F.col("doc_id") % 100 == 0))


@query
def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Responses are read with their payloads and measured anew; revisits are read by their headers alone."""
    pages, path = spark.read.parquet(f"{folder}/pages.parquet"), warc.archive_folder(spark)
    warc.archive_pages(pages, path)
    kind = pages.schema["page_id"].dataType
    page = warc.page_of(F.col("record_id"), kind).alias("page_id")
    full = warc.read(spark, path, [("record_type", "=", "response")]).select(
        page, F.length("payload").cast("long").alias("payload_bytes"), warc.base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    again = warc.read(spark, path, [("record_type", "=", "revisit")], payload=False).select(
        page, F.col("http_headers")["content-length"].cast("long").alias("payload_bytes"), F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type",
        warc.page_of(F.col("refers_to"), kind).alias("refers_to"))
    return full.union(again)


@query
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder))


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose id's checksum 3 divides are checked after their text was lower-cased."""
    bound = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle_manifest.leaf_digest([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in bound])
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered)
    rows = merkle_manifest.manifest(documents(spark, folder), bound, carried={"changed": changed})
    rows = rows.withColumn("folded_root", merkle_manifest.folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: op6 over the whole table: the number of copies is how many values of the distribution function are not above the hash
ORACLES["op6_source_mixing"] = """WITH w AS (SELECT * FROM (VALUES ('src0', 0.2::DOUBLE), ('src1', 0.15), ('src2', 0.1), ('src3', 0.05), ('*', 0.5)) v(bucket, goal)),
d AS (SELECT doc_id, source, text, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN source ELSE '*' END AS bucket, coalesce(octet_length(encode(text)), 0)::DOUBLE AS size FROM documents),
b AS (SELECT bucket, sum(size) AS bytes, any_value(goal) AS goal FROM d JOIN w USING (bucket) GROUP BY bucket),
t AS (SELECT sum(bytes) AS all_bytes, sum(goal) AS all_goals FROM b WHERE bytes > 0),
r AS (SELECT bucket, CASE WHEN bytes = 0 THEN 1.0 ELSE goal / all_goals * all_bytes / bytes END AS rate FROM b, t),
p AS (SELECT bucket, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY bucket ORDER BY k) AS cdf FROM r, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 31) AS BIGINT))) x(k)),
u AS (SELECT *, CAST('0x' || substring(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496 AS u FROM d),
n AS (SELECT doc_id, source, text, (SELECT count(*) FROM p WHERE p.bucket = u.bucket AND p.cdf <= u.u) AS n FROM u)
SELECT doc_id, source, copy, md5('8:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy) AS place, octet_length(encode(text)) AS n_bytes
FROM n, unnest(range(0, n)) y(copy)"""

#: op12 over whole texts: all contiguous phrases are listed and counted
ORACLES["op12_phrase_collocations"] = """WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, greatest(len(words) - k + 2, 1)), lambda i: words[i:i + k - 1])))) AS words FROM w),
f AS (SELECT lang, words, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(words) = 1 GROUP BY lang),
c AS (SELECT lang, words, f AS a FROM f WHERE len(words) > 1 AND f >= 30),
k AS (SELECT c.lang, c.words, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.words = c.words[1:k] JOIN f y ON y.lang = c.lang AND y.words = c.words[k + 1:]),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
h AS (SELECT lang, unnest(flatten(list_transform(range(2, len(words)), lambda m: list_transform(range(1, len(words) - m + 2), lambda i: words[i:i + m - 1])))) AS words, a AS longer FROM c WHERE len(words) > 2),
m AS (SELECT lang, words, max(longer) AS longer FROM h GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.words, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN m USING (lang, words) WHERE longer IS NULL OR 100 * longer < 80 * a),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM s JOIN n USING (lang) WHERE rank <= 2000"""

ORACLES["op11_warc"] = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY digest, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(digest, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM q"""

#: op13 over all columns of all rows: a tree for each language and one over their roots, level by level; crc32 bit by bit
ORACLES["op13_merkle_manifest"] = """WITH RECURSIVE v AS (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
  || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)::BIGINT[]),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc FROM documents),
l AS (SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS changed FROM v),
t(level, lang, pos, h, n) AS (SELECT 0, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1, leaf, count(*) OVER (PARTITION BY lang) FROM l
  UNION ALL SELECT level + 1, lang, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM t WHERE n > 1 GROUP BY level, lang, pos // 8),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, pos, h, n) AS (SELECT 0, pos, subroot, n FROM s UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM u WHERE n > 1 GROUP BY level, pos // 8),
p(level, doc_id, lang, leaf, changed, spot, n, siblings, folded) AS (
  SELECT 0, doc_id, lang, leaf, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1, count(*) OVER (PARTITION BY lang), '', coalesce(changed, leaf) FROM l
  UNION ALL SELECT p.level + 1, doc_id, p.lang, leaf, changed, spot // 8, (p.n + 7) // 8, siblings || x.b || x.a, sha256(x.b || folded || x.a)
  FROM p, LATERAL (SELECT coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < p.spot), '') AS b, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > p.spot), '') AS a
    FROM t WHERE t.level = p.level AND t.lang IS NOT DISTINCT FROM p.lang AND t.pos // 8 = p.spot // 8) x WHERE p.n > 1),
q(level, doc_id, lang, leaf, subroot, spot, n, siblings, folded) AS (
  SELECT 0, doc_id, p.lang, leaf, subroot, s.pos, s.n, siblings, folded FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
  UNION ALL SELECT q.level + 1, doc_id, lang, leaf, subroot, spot // 8, (q.n + 7) // 8, siblings || x.b || x.a, sha256(x.b || folded || x.a)
  FROM q, LATERAL (SELECT coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < q.spot), '') AS b, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > q.spot), '') AS a
    FROM u WHERE u.level = q.level AND u.pos // 8 = q.spot // 8) x WHERE q.n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM u WHERE n = 1) AS verified FROM q WHERE n = 1"""
