"""Bindings: captured pages, JSON pairs, aliases, documents, links, evidence."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from evimap import constants as K
from evimap.operators import extraction as X
from evimap.operators import flatten, models
from evimap.plans.registry import query
from evimap.plans.scalars import LINKS, TICKET_SQL, TRUSTED_SQL, available_sql, clean_sql, first_sql, origin, trim_sql
from evimap.plans.structure import NODES


def _decoded(x: str) -> str:
    return clean_sql(f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')")


@query("read_pages", "SELECT page_id, url, length(html) AS characters, sha256(html) AS digest FROM [pages]")
def _(t):
    from evimap.sources.records import read_pages

    pages = read_pages(t.spark, f"{t.folder}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").alias("characters"), F.sha2("html", 256).alias("digest"))


@query("extract_label_pairs", f"""
SELECT page_id, 'title' AS source, '' AS label, {_decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS value FROM [pages]
UNION ALL SELECT page_id, 'h1', '', {_decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} FROM [pages]
UNION ALL SELECT page_id, 'link', {_decoded('label')}, {_decoded('href')} FROM (SELECT page_id,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM [pages])""")
def _(t):
    return X.label_pairs(t.pages).select("page_id", "source", "label", "value")


# two-cell rows of two sections per order, some broken
_ROWS = """SELECT l_orderkey AS page_id, CASE WHEN l_linenumber % 2 = 0 THEN 'Source Events' ELSE 'JSON Events' END AS heading,
    l_linenumber * 1000000 + l_partkey AS ord, 'k' || CAST(l_partkey % 3 AS STRING) AS k,
    CASE l_suppkey % 4 WHEN 0 THEN '{"q": ' || CAST(l_suppkey AS STRING) || '}' WHEN 1 THEN '["a", "' || l_returnflag || '"]'
         WHEN 2 THEN ' {broken} ' ELSE 'text "' || l_linestatus || '"' END AS v, l_quantity = 7 AS wide, l_quantity = 9 AS blank, l_quantity = 11 AS header FROM [lineitem]"""


@query("event_table_documents", f"""
WITH r AS ({_ROWS}), placed AS (SELECT *, lower(heading) AS section, row_number() OVER (PARTITION BY page_id, heading ORDER BY ord, v) AS place,
  NOT wide AND NOT blank AS good, {trim_sql('v')} AS cell FROM r WHERE NOT header),
vals AS (SELECT *, CASE WHEN json_valid(cell) AND cell <> '{{broken}}' AND (cell LIKE '{{%' OR cell LIKE '[%') THEN CAST(json(cell) AS STRING) ELSE CAST(to_json(cell) AS STRING) END AS val FROM placed),
keyed AS (SELECT page_id, section, k, min(place) FILTER (good) AS place, count(*) FILTER (good) AS n, string_agg(val, ',' ORDER BY place) FILTER (good) AS vals, arg_min(val, place) FILTER (good) AS one FROM vals GROUP BY ALL),
docs AS (SELECT page_id, section, '{{' || string_agg('"' || k || '":' || CASE WHEN n = 1 THEN vals WHEN one = '[]' THEN '[' || substring(vals, 4) || ']' WHEN one LIKE '[%' THEN '[' || substring(one, 2, length(one) - 2) || substring(vals, length(one) + 1) || ']' ELSE '[' || vals || ']' END, ',' ORDER BY place) || '}}' AS document
  FROM keyed WHERE n > 0 GROUP BY page_id, section),
flags AS (SELECT page_id, bool_and(good) AND count(DISTINCT section) = 2 AS complete FROM vals GROUP BY page_id),
sections AS (SELECT DISTINCT page_id, section FROM vals)
SELECT s.page_id, s.section, d.document, f.complete FROM sections s LEFT JOIN docs d ON s.page_id = d.page_id AND s.section = d.section
JOIN flags f ON s.page_id = f.page_id""")
def _(t):
    rows = t.sql(_ROWS).select(
        "page_id", F.lower("heading").alias("section"), F.struct("ord", "v").alias("ord"),
        F.when(F.col("header"), F.expr("cast(array() as array<string>)")).when(F.col("wide"), F.array("k", "v", F.lit("x"))).when(F.col("blank"), F.array(F.lit(" "), "v")).otherwise(F.array("k", "v")).alias("cells"),
    )
    return X.event_documents(rows)


@query("json_pairs", NODES + f""", named AS (SELECT *, string_split(pointer, '/')[4:] AS parts FROM leaves),
paths AS (SELECT incident_id, pointer, array_to_string(list_filter(string_split_regex(replace(lower(array_to_string(parts, '.')), '~1', '/'), '[^a-z0-9]+'),
  lambda p: p <> '' AND NOT regexp_matches(p, '^[0-9]+$')), '.') AS path, {clean_sql("coalesce(value_text, 'null')")} AS value FROM named)
SELECT incident_id, path, value FROM paths WHERE path <> '' AND {available_sql('value')}""")
def _(t):
    return _json_pairs(t).select("incident_id", "path", "value")


def _json_pairs(t):
    return flatten.json_pairs(t.alert_docs)


_ALIASES = "(VALUES " + ", ".join(
    f"('{field}', {rank}, '{'.'.join(p for p in ''.join(c if c.isalnum() else ' ' for c in alias.lower()).split())}')"
    for field, aliases in K.FIELD_LABELS for rank, alias in enumerate(aliases)
) + ") AS aliases(field, alias_rank, alias)"

RESOLVED = NODES + f""", named AS (SELECT *, string_split(pointer, '/')[4:] AS parts FROM leaves),
paths AS (SELECT incident_id, doc_index, ord, array_to_string(list_filter(string_split_regex(replace(lower(array_to_string(parts, '.')), '~1', '/'), '[^a-z0-9]+'),
  lambda p: p <> '' AND NOT regexp_matches(p, '^[0-9]+$')), '.') AS path, {clean_sql("coalesce(value_text, 'null')")} AS value FROM named),
hits AS (SELECT incident_id, field, value, row_number() OVER (PARTITION BY incident_id, field
    ORDER BY alias_rank, CASE WHEN path = alias THEN 0 ELSE 1 END, doc_index, ord) AS turn
  FROM paths JOIN {_ALIASES} ON path = alias OR ends_with(path, '.' || alias) WHERE path <> '' AND {available_sql('value')}),
resolved AS (SELECT incident_id, field, value FROM hits WHERE turn = 1)"""


@query("resolve_aliases", RESOLVED + " SELECT * FROM resolved")
def _(t):
    return X.resolve_aliases(_json_pairs(t))


# keys that stand against their sorted order, keys that are numbers, and repeats within lists
_ORDERED = """SELECT event_id AS incident_id, 0 AS doc_index, '{"zeta": {"hostname": "z' || CAST(user_id % 7 AS STRING) || '"}, "alpha": {"hostname": "a"}, "b": [{"client ip": "192.0.2.'
    || CAST(user_id % 200 AS STRING) || '", "Source IP": "' || CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE '198.51.100.9' END || '"}, {"Source IP": "203.0.113.7"}], "10": {"user name": "ten"}, "9": {"user name": "nine"}, "'
    || event_type || '": {"event name": "last"}, "c": {"event name": "' || event_type || '"}}' AS raw FROM [events]"""


@query("alias_text_order", RESOLVED.replace("[alert_docs]", f"({_ORDERED})") + " SELECT * FROM resolved")
def _(t):
    return X.resolve_aliases(flatten.json_pairs(t.sql(_ORDERED)))


_FIELDS = ("sourceIp", "clientIp", "sourceUsername", "clientUserName", "deviceHostname", "eventName", "tenantName")


@query("combine_sources", RESOLVED + f""", wide AS (SELECT incident_id, {', '.join(f"max(CASE WHEN field = '{f}' THEN value END) AS j_{f}" for f in _FIELDS)}
  FROM resolved GROUP BY incident_id),
shown AS (SELECT event_id AS incident_id, CASE WHEN event_id % 4 = 1 THEN '10.0.0.' || user_id WHEN event_id % 4 = 2 THEN 'N/A' END AS d_sourceIp,
  CASE WHEN event_id % 5 = 0 THEN 'Acme ' END AS d_tenantName, event_type AS t_eventName, 'user' || user_id AS t_clientUserName FROM [events])
SELECT s.incident_id, {first_sql('d_sourceIp', 'j_sourceIp', 'j_clientIp')} AS "sourceIp", {first_sql('j_clientIp')} AS "clientIp",
  {first_sql('j_sourceUsername', 'j_clientUserName', 't_clientUserName')} AS "sourceUsername", {first_sql('j_clientUserName', 't_clientUserName')} AS "clientUserName",
  {first_sql('j_deviceHostname')} AS "deviceHostname", {first_sql('j_eventName', 't_eventName')} AS "eventName", {first_sql('d_tenantName', 'j_tenantName')} AS "tenantName"
FROM shown s LEFT JOIN wide w ON s.incident_id = w.incident_id""")
def _(t):
    found = X.resolve_aliases(_json_pairs(t))
    wide = found.groupBy("incident_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"j_{f}") for f in _FIELDS))
    key, user = F.col("event_id"), F.col("user_id").cast("string")
    shown = t.events.select(
        key.alias("incident_id"),
        F.when(key % 4 == 1, F.concat(F.lit("10.0.0."), user)).when(key % 4 == 2, "N/A").alias("d_sourceIp"),
        F.when(key % 5 == 0, "Acme ").alias("d_tenantName"), F.col("event_type").alias("t_eventName"), F.concat(F.lit("user"), user).alias("t_clientUserName"),
    )
    both = shown.join(wide, "incident_id", "left")

    def source(prefix: str, field: str):
        name = f"{prefix}_{field}"
        return F.col(name) if name in both.columns else F.lit(None).cast("string")

    fields = both.select("incident_id", *(X.combine_sources(source("d", f), source("j", f), source("t", f)).alias(f) for f in _FIELDS))
    return X.with_role_fallbacks(fields)


# 40 texts per incident; the budget is reached in many of them
_BUNDLES = """SELECT CAST(floor(doc_id / 40) AS BIGINT) AS incident_id, doc_id AS ord,
    CASE WHEN doc_id % 10 = 7 THEN lang || source ELSE text END AS raw FROM [documents]"""


@query("dedupe_documents", f"""
WITH b AS ({_BUNDLES}), firsts AS (SELECT *, row_number() OVER (PARTITION BY incident_id, raw ORDER BY ord) AS turn FROM b)
SELECT incident_id, ord, sha256(raw) AS digest, true AS complete FROM firsts WHERE turn = 1""")
def _(t):
    return X.budget_documents(t.sql(_BUNDLES)).select("incident_id", "ord", F.sha2("raw", 256).alias("digest"), "complete")


# a result grid per customer; some foreign links and a row of the wrong width
_GRID = """SELECT o_custkey AS search_id, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN '#' ELSE '' END || CAST(o_orderkey % 40 AS STRING) AS id_text,
    CASE WHEN o_orderkey % 14 = 0 THEN 'https://other.example.com/incident/1' ELSE 'https://portal.example.com/incident/1' END AS href,
    o_orderpriority AS name, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'tenant ' || o_orderstatus END AS tenant, o_orderkey % 10 = 4 AS narrow FROM [orders]"""


@query("extract_result_rows", f"""
WITH g AS ({_GRID}), ok AS (SELECT *, replace(id_text, '#', '') AS ticket_id FROM g WHERE NOT narrow AND href LIKE 'https://portal.%'),
ids AS (SELECT search_id, ticket_id, min(ord) AS first_ord, arg_min(tenant, ord) FILTER (tenant <> '') AS tenant, arg_min(name, ord) FILTER (tenant <> '') AS name
  FROM ok GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY first_ord) AS rank, false AS truncated FROM ids)
SELECT search_id, ticket_id, rank, tenant, name, truncated FROM ranked""")
def _(t):
    rows = t.sql(_GRID).select(
        "search_id", "ord", F.array(F.lit("Name"), F.lit(" Ticket ID"), F.lit("Tenant  Name")).alias("headers"),
        F.when(F.col("narrow"), F.array("name", "id_text")).otherwise(F.array("name", "id_text", "tenant")).alias("cells"), F.array("href").alias("links"),
    )
    return X.result_rows(rows, "https://portal.example.com").select("search_id", "ticket_id", "rank", "tenant", "name", "truncated")


_PAGING = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '1 - ' || CAST(o_custkey AS STRING) || ' of 700'
    WHEN 1 THEN 'Showing incidents 1 to ' || CAST(o_custkey AS STRING) || ' out of 1,000' WHEN 2 THEN 'loading' WHEN 3 THEN '' ELSE '1,001-1,050 of 1,050' END AS message, o_custkey FROM [orders]"""


@query("paging_state", f"""
WITH p AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey WHEN 4 THEN 1050 ELSE 0 END AS page_end,
  CASE o_orderkey % 5 WHEN 0 THEN 700 WHEN 1 THEN 1000 WHEN 4 THEN 1050 ELSE 0 END AS page_total FROM ({_PAGING}))
SELECT o_orderkey, page_end, page_total, o_orderkey % 5 IN (0, 1, 4) AND page_end >= page_total AS complete, o_orderkey % 5 = 2 AS unknown,
  page_end < page_total OR o_orderkey % 5 = 2 OR o_custkey % 10 > 5 AS truncated FROM p""")
def _(t):
    rows = t.sql(_PAGING).withColumn("state", X.paging_state(F.col("message")))
    return rows.select("o_orderkey", "state.*", X.truncated(F.col("state"), F.col("o_custkey") % 10, 5).alias("truncated"))


@query("trusted_links", f"""
WITH own AS (SELECT page_id, link AS url, {TICKET_SQL} AS ticket_id FROM ({LINKS})),
tabs AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '<a href="([^"]*)"', 1),
  ['/incident9/' || page_id || '/overview', '/incident9/' || page_id || '/overview', 'https://portal.example.com/incident/' || page_id, '/incident/' || (page_id + 1),
   'https://other.example.com/incident/' || page_id])) AS href FROM [pages]),
abs AS (SELECT DISTINCT o.page_id, o.ticket_id AS own_ticket, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
  WHEN href LIKE '/%' AND href NOT LIKE '//%' THEN regexp_replace(regexp_replace(lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)), '//[^@/]*@', '//'), ':443$', '') || href END AS link
  FROM own o JOIN tabs t ON o.page_id = t.page_id)
SELECT page_id, link FROM abs WHERE {TRUSTED_SQL} AND {TICKET_SQL} = own_ticket""")
def _(t):
    page = F.col("page_id").cast("string")
    extra = F.array(
        F.concat(F.lit("/incident9/"), page, F.lit("/overview")), F.concat(F.lit("/incident9/"), page, F.lit("/overview")),
        F.concat(F.lit("https://portal.example.com/incident/"), page), F.concat(F.lit("/incident/"), (F.col("page_id") + 1).cast("string")),
        F.concat(F.lit("https://other.example.com/incident/"), page),
    )
    pages = t.sql(LINKS).withColumnRenamed("link", "url").join(t.pages.select("page_id", "html"), "page_id")
    return X.trusted_links(pages, F.concat(X.hrefs(F.col("html")), extra), origin())


# all twenty fields; every fifth value of a field is blank, so it is left out
_EVIDENCE = """SELECT event_id, event_id % 9 <> 4 AS documents_complete, """ + ", ".join(
    f"CASE WHEN (event_id + {i}) % 5 = 0 THEN '  ' ELSE ' ' || " + {"ticketId": "CAST(event_id AS STRING)", "eventName": "event_type", "eventInfo": "props"}.get(name, f"'{name} ' || CAST(user_id + {i} AS STRING)")
    + f" END AS {name}" for i, name in enumerate(K.EVIDENCE_FIELDS)) + " FROM [events]"
_SHOWN = " || ".join(f"CASE WHEN trim({name}) = '' THEN '' ELSE '{name}=' || trim({name}) || '|' END" for name in K.EVIDENCE_FIELDS)


@query("bounded_evidence", NODES + f""", docs AS (SELECT incident_id, count(*) AS n, bool_or(doc IS NULL) AS broken FROM parsed GROUP BY incident_id),
kept AS (SELECT incident_id, count(*) AS leaves_left FROM leaves WHERE pointer NOT LIKE '%/api_key' GROUP BY incident_id),
judged AS (SELECT e.*, CASE WHEN NOT documents_complete THEN 'incomplete' WHEN n IS NULL THEN 'no_documents' WHEN broken THEN 'unparseable_document' ELSE '' END AS reason
  FROM ({_EVIDENCE}) e LEFT JOIN docs d ON e.event_id = d.incident_id)
SELECT event_id AS incident_id, reason, CASE WHEN reason = '' THEN {_SHOWN} END AS current, CASE WHEN reason = '' THEN leaves_left END AS leaves_left
FROM judged j LEFT JOIN kept k ON j.event_id = k.incident_id""")
def _(t):
    incidents = t.sql(_EVIDENCE).withColumnRenamed("event_id", "incident_id")
    rows = X.evidence(incidents, t.alert_docs, {name: name for name in K.EVIDENCE_FIELDS})
    shown = F.array_join(F.transform(F.map_entries("current"), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("|"))), "")
    left = flatten.leaves(rows.select("incident_id", F.posexplode("documents").alias("doc_index", "raw")), named=()).groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("leaves_left"))
    return rows.join(left, "incident_id", "left").select("incident_id", "reason", shown.alias("current"), "leaves_left")


# whole documents after redaction: key order, numbers and nesting
_SECRETS = """SELECT event_id AS incident_id, 0 AS doc_index, '{"z": {"Api-Key": "k' || CAST(user_id AS STRING) || '", "n": ' || CAST(event_id AS STRING) || '.50, "t": "a]{b"}, "a": [1e3, null, {"password": {"deep": [1]}, "b": true}], "token": "x", "9": '
    || CAST(user_id AS STRING) || 'e-9, "e": "' || event_type || '"}' AS raw FROM [events]"""


@query("redacted_documents", f"""WITH d AS ({_SECRETS}) SELECT incident_id, '{{"9":' || CASE WHEN u = 0 THEN '0' WHEN length(rtrim(u::STRING, '0')) = 1 THEN rtrim(u::STRING, '0') ELSE (u::STRING)[1:1] || '.' || (rtrim(u::STRING, '0'))[2:] END
    || CASE WHEN u = 0 THEN '' ELSE 'e-' || (10 - length(u::STRING)) END || ',"z":{{"n":' || incident_id || '.5,"t":"a]{{b"}},"a":[1000,null,{{"b":true}}],"e":"' || event_type || '"}}' AS raw
FROM d JOIN (SELECT event_id AS incident_id, user_id AS u, event_type FROM [events]) USING (incident_id)""")
def _(t):
    return flatten.without_sensitive(t.sql(_SECRETS)).select("incident_id", "raw")


_ANSWERS = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '{"eventSummary": " A ' || event_type || ' ", "observedFacts": ["one", " two "]}'
    WHEN 1 THEN '{"eventSummary": "x"}' WHEN 2 THEN 'no json' WHEN 3 THEN '{"eventSummary": 5, "observedFacts": []}'
    WHEN 4 THEN '{"eventSummary": "x", "observedFacts": ["' || repeat('y', 590 + CAST(user_id % 20 AS INT)) || '"]}'
    WHEN 5 THEN '{"eventSummary": "", "observedFacts": []}' WHEN 6 THEN '{"eventSummary": "x", "observedFacts": [" "]}'
    ELSE '{"eventSummary": "x", "observedFacts": [], "more": 1}' END AS answer, user_id, event_type FROM [events]"""


@query("validate_enrichment", f"""
SELECT event_id AS ticket_id, CASE event_id % 8 WHEN 1 THEN 'wrong_keys' WHEN 2 THEN 'not_json' WHEN 3 THEN 'invalid_summary'
  WHEN 4 THEN CASE WHEN user_id % 20 > 10 THEN 'invalid_facts' ELSE '' END WHEN 6 THEN 'invalid_facts' WHEN 7 THEN 'wrong_keys' ELSE '' END AS violation,
  CASE event_id % 8 WHEN 0 THEN 'A ' || event_type WHEN 4 THEN CASE WHEN user_id % 20 <= 10 THEN 'x' END WHEN 5 THEN '' END AS event_summary,
  CASE event_id % 8 WHEN 0 THEN 'one|two' WHEN 4 THEN CASE WHEN user_id % 20 <= 10 THEN repeat('y', 590 + CAST(user_id % 20 AS INT)) END WHEN 5 THEN '' END AS facts
FROM [events]""")
def _(t):
    answers = t.sql(_ANSWERS).select(F.col("event_id").alias("ticket_id"), "answer")
    valid, quarantine = X.validate_enrichment(answers)
    good = valid.select("ticket_id", F.lit("").alias("violation"), "event_summary", F.array_join("observed_facts", "|").alias("facts"))
    bad = quarantine.select("ticket_id", "violation", F.lit(None).cast("string").alias("event_summary"), F.lit(None).cast("string").alias("facts"))
    return good.unionByName(bad)


def _load_summarizer():
    """A stand-in for a model: a summary of the event type, bad JSON for errors, no answer for signups."""
    def model(texts: list[str]) -> list[str]:
        if "signup" in texts:
            raise TimeoutError("no answer")
        return ["{" if x == "error" else json.dumps({"eventSummary": f" {x} ", "observedFacts": [x, x.upper()]}) for x in texts]

    return model


@query("enrich", """
SELECT event_id AS ticket_id, CASE event_type WHEN 'signup' THEN 'TimeoutError: no answer' ELSE '' END AS failure, CASE WHEN event_type IN ('signup', 'error') THEN 'not_json' ELSE '' END AS violation,
  CASE WHEN event_type NOT IN ('signup', 'error') THEN event_type END AS event_summary, CASE WHEN event_type NOT IN ('signup', 'error') THEN event_type || '|' || upper(event_type) END AS facts FROM [events]""")
def _(t):
    answers = models.enrich_with(t.events.select(F.col("event_id").alias("incident_id"), "event_type"), "event_type", "summarizer", _load_summarizer)
    valid, quarantine = X.validate_enrichment(answers)
    good = valid.select("ticket_id", F.lit("").alias("violation"), "event_summary", F.array_join("observed_facts", "|").alias("facts"))
    bad = quarantine.select("ticket_id", "violation", F.lit(None).cast("string").alias("event_summary"), F.lit(None).cast("string").alias("facts"))
    return answers.select("ticket_id", "failure").join(good.unionByName(bad), "ticket_id")


@query("incident_identity", f"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id * 10 AS STRING) ELSE {TICKET_SQL} END AS ticket_id,
  CASE WHEN page_id % 2 = 0 THEN {clean_sql("'Alert ' || page_id || ' - Incident info'")} ELSE 'Alert  - ' || page_id END AS name_raw,
  CASE WHEN page_id % 2 = 0 THEN 'Alert ' || page_id ELSE 'Alert - ' || page_id END AS incident_name FROM ({LINKS})""".replace(
    "CASE WHEN page_id % 2 = 0 THEN " + clean_sql("'Alert ' || page_id || ' - Incident info'") + " ELSE 'Alert  - ' || page_id END AS name_raw,\n  ", ""))
def _(t):
    page = F.col("page_id").cast("string")
    header = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Incident #"), (F.col("page_id") * 10).cast("string"), F.lit(" open 7"))).otherwise("none")
    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Alert  "), page, F.lit(" - Incident info"))).otherwise(F.concat(F.lit("Alert  - "), page))
    identity = X.incident_identity(header, F.col("link"), title, F.lit(" Incident Info "))
    return t.sql(LINKS).select("page_id", identity.alias("i")).select("page_id", "i.ticket_id", "i.incident_name")
