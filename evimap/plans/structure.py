"""Bindings: flattening and structural checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimap import constants as K
from evimap.functions import jsoncols as J
from evimap.operators import flatten
from evimap.plans.registry import query

# Nodes and leaves as DuckDB sees them, for the statements below.
NODES = """WITH RECURSIVE parsed AS (
    SELECT incident_id, doc_index, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS doc FROM [alert_docs]),
nodes(incident_id, doc_index, pointer, parent, key, position, depth, v, ord) AS (
    SELECT incident_id, doc_index, '/documents/' || doc_index, '/documents', CAST(doc_index AS STRING), -1, 0, doc, ''
    FROM parsed WHERE doc IS NOT NULL
    UNION ALL
    SELECT n.incident_id, n.doc_index, n.pointer || '/' || replace(replace(e.key, '~', '~0'), '/', '~1'), n.pointer, e.key,
      CASE WHEN json_type(n.v) = 'ARRAY' THEN CAST(e.key AS INT) ELSE -1 END, n.depth + 1, e.value,
      n.ord || CASE WHEN json_type(n.v) = 'ARRAY' OR (regexp_matches(e.key, '^(0|[1-9][0-9]{0,9})$') AND TRY_CAST(e.key AS BIGINT) < 4294967295)
        THEN '0' || lpad(e.key, 10, '0') ELSE '1' || lpad(CAST(e.id AS STRING), 10, '0') END
    FROM nodes n, json_each(n.v) e WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')),
leaves AS (
    SELECT incident_id, doc_index, pointer, parent, key, position, depth, ord,
      CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS vtype,
      CASE WHEN json_type(v) IN ('DOUBLE') AND floor(CAST(v AS DOUBLE)) = CAST(v AS DOUBLE)
           THEN CAST(CAST(CAST(v AS DOUBLE) AS BIGINT) AS STRING) ELSE json_extract_string(v, '$') END AS value_text,
      CASE WHEN json_type(v) NOT IN ('VARCHAR', 'BOOLEAN', 'NULL') THEN CAST(v AS DOUBLE) END AS value_num
    FROM nodes WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY'))
"""


@query("flatten_leaves", NODES + """
SELECT incident_id, pointer, key, vtype, value_text, value_num FROM leaves""")
def _(t):
    return flatten.leaves(t.alert_docs).select("incident_id", "pointer", "key", "vtype", "value_text", "value_num")


@query("leaf_id", NODES + """
SELECT pointer, 'f' || substring(sha256(pointer), 1, 20) AS leaf_id, count(*) AS n FROM leaves GROUP BY pointer""")
def _(t):
    return flatten.leaves(t.alert_docs).groupBy("pointer", "leaf_id").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_pointer", NODES + """, requests AS (
    SELECT incident_id, '/documents/0/source/ip' AS pointer FROM parsed
    UNION ALL SELECT incident_id, '/documents/1/a.b/1/x~1y' FROM parsed WHERE doc_index = 0
    UNION ALL SELECT incident_id, '/documents/0/attributes' FROM parsed WHERE doc_index = 0)
SELECT r.incident_id, r.pointer, n.v IS NOT NULL AS found,
  CASE json_type(n.v) WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END AS kind,
  CASE WHEN json_type(n.v) = 'VARCHAR' THEN json_extract_string(n.v, '$') END AS value_text
FROM requests r LEFT JOIN nodes n ON r.incident_id = n.incident_id AND r.pointer = n.pointer""")
def _(t):
    docs = t.alert_docs
    first = docs.where("doc_index = 0")
    requests = (
        docs.select("incident_id", F.lit("/documents/0/source/ip").alias("pointer"))
        .unionByName(first.select("incident_id", F.lit("/documents/1/a.b/1/x~1y").alias("pointer")))
        .unionByName(first.select("incident_id", F.lit("/documents/0/attributes").alias("pointer")))
    )
    return flatten.resolve_pointers(requests, docs)


@query("complexity_limits", NODES + """, sizes AS (
    SELECT incident_id, count(*) AS documents, sum(coalesce(strlen(regexp_replace(CAST(json(doc) AS STRING), '([0-9])\\.0([,}}])', '\\1\\2', 'g')), 0)) + count(*) + 1 AS bytes,
      bool_or(doc IS NULL) AS broken FROM parsed GROUP BY incident_id),
shape AS (SELECT incident_id, count(*) AS nodes, max(depth) AS depth FROM nodes GROUP BY incident_id)
SELECT s.incident_id, documents, CAST(bytes AS BIGINT) AS bytes, coalesce(nodes, 0) AS nodes, coalesce(depth, 0) AS depth,
  CASE WHEN broken THEN 'unparseable_document' WHEN documents > 16 THEN 'too_many_documents' WHEN bytes > 98304 THEN 'too_large'
       WHEN depth > 30 OR nodes > 10000 THEN 'too_complex' ELSE '' END AS violation
FROM sizes s LEFT JOIN shape h ON s.incident_id = h.incident_id""")
def _(t):
    return flatten.complexity(t.alert_docs)


@query("sibling_context", NODES + """, pairs AS (
    SELECT a.incident_id, a.pointer, a.key, b.key AS other, b.vtype, b.value_text,
      row_number() OVER (PARTITION BY a.incident_id, a.pointer
        ORDER BY CASE WHEN a.key = 'value' AND b.key = 'key' THEN 0 ELSE 1 END, b.position, b.key) AS rank
    FROM leaves a JOIN leaves b ON a.incident_id = b.incident_id AND a.parent = b.parent AND a.pointer <> b.pointer),
folded AS (
    SELECT incident_id, pointer, string_agg(other || '=' || coalesce(substring(value_text, 1, 256), 'null'), '|' ORDER BY rank) FILTER (rank <= 8) AS context,
      greatest(0, count(*) - 8) AS omitted_siblings,
      count(*) FILTER (rank <= 8 AND vtype = 'string' AND length(value_text) > 256) AS shortened_siblings
    FROM pairs GROUP BY incident_id, pointer)
SELECT l.incident_id, l.pointer, coalesce(context, '') AS context, coalesce(omitted_siblings, 0) AS omitted_siblings,
  coalesce(shortened_siblings, 0) AS shortened_siblings
FROM leaves l LEFT JOIN folded f ON l.incident_id = f.incident_id AND l.pointer = f.pointer""")
def _(t):
    shown = F.transform("context", lambda s: F.concat(s["key"], F.lit("="), F.coalesce(s["value"], F.lit("null"))))
    return flatten.sibling_context(flatten.leaves(t.alert_docs), 8, 256).select(
        "incident_id", "pointer", F.array_join(shown, "|").alias("context"), "omitted_siblings", "shortened_siblings"
    )


@query("json_type_check", NODES + """
SELECT pointer, CASE WHEN json_type(v) IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN json_type(v) = 'DOUBLE' THEN 'number'
    WHEN json_type(v) = 'VARCHAR' THEN 'string' ELSE lower(json_type(v)) END AS json_type,
  json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS fits_number, count(*) AS n
FROM nodes WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY') GROUP BY ALL""")
def _(t):
    kind = J.json_type(F.col("value"))
    # a whole DECIMAL such as 12.0 prints as BIGINT in a variant: the text decides
    return (
        flatten.nodes(t.alert_docs).where("container is null")
        .groupBy("pointer", kind.alias("json_type"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("fits_number", J.matches_json_type(F.col("json_type"), F.lit("number")))
    )


@query("sanitize_json", """WITH RECURSIVE parsed AS (
    SELECT incident_id, doc_index, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS doc FROM [alert_docs]),
nodes(incident_id, doc_index, path, v) AS (
    SELECT incident_id, doc_index, '', doc FROM parsed WHERE doc IS NOT NULL
    UNION ALL
    SELECT n.incident_id, n.doc_index,
      CASE WHEN json_type(n.v) = 'ARRAY' THEN n.path
           ELSE CASE WHEN n.path = '' THEN '' ELSE n.path || '.' END || replace(replace(e.key, '\\', '\\\\'), '.', '\\.') END, e.value
    FROM nodes n, json_each(n.v) e WHERE json_type(n.v) IN ('OBJECT', 'ARRAY'))
SELECT DISTINCT incident_id, doc_index, CASE WHEN path = '' THEN '$' ELSE path END AS path, '[REDACTED]' AS value
FROM nodes WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY') OR (path <> '' AND CAST(v AS STRING) IN ('{}', '[]'))""")
def _(t):
    return flatten.sanitize_json(t.alert_docs)


@query("drop_sensitive_keys", """WITH RECURSIVE parsed AS (
    SELECT incident_id, doc_index, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS doc FROM [alert_docs]),
nodes(incident_id, pointer, v) AS (
    SELECT incident_id, '/documents/' || doc_index, doc FROM parsed WHERE doc IS NOT NULL
    UNION ALL
    SELECT n.incident_id, n.pointer || '/' || replace(replace(e.key, '~', '~0'), '/', '~1'), e.value
    FROM nodes n, json_each(n.v) e WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')
      AND NOT regexp_matches(regexp_replace(lower(e.key), '[^a-z0-9]', '', 'g'),
        'authorization|cookie|password|passwd|secret|privatekey|apikey|token|credential'))
SELECT incident_id, pointer FROM nodes WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')""")
def _(t):
    return flatten.drop_sensitive_leaves(flatten.leaves(t.alert_docs)).select("incident_id", "pointer")
