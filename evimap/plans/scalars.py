"""Bindings: text, URL, time and eligibility functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimap import constants as K
from evimap.functions import jsoncols as J
from evimap.functions import text as X
from evimap.functions import times as T
from evimap.functions import urls as U
from evimap.operators import flatten
from evimap.operators.candidates import with_reasons
from evimap.plans.registry import query
from evimap.plans.structure import NODES

# --- the same rules in DuckDB's words ------------------------------------------
WS = K.SPACES


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def clean_sql(x: str) -> str:
    blanks = f"regexp_replace(replace(coalesce({x}, ''), ' ', ' '), '[ \t]+', ' ', 'g')"
    return trim_sql(f"regexp_replace({blanks}, '[{WS}]*\n[{WS}]*', '\n', 'g')")


def available_sql(x: str) -> str:
    return f"lower({clean_sql(x)}) NOT IN ('', 'n/a', 'na', 'none', 'null', 'undefined', '-')"


def first_sql(*xs: str) -> str:
    cases = ", ".join(f"CASE WHEN {available_sql(x)} THEN {clean_sql(x)} END" for x in xs)
    return f"coalesce({cases}, '')"


@query("clean_text", f"""
SELECT doc_id, sha256({clean_sql("'  ' || text || chr(10) || '  　'")}) AS cleaned FROM [documents]""")
def _(t):
    padded = F.concat(F.lit("  "), "text", F.lit("\n  　"))
    return t.documents.select("doc_id", F.sha2(X.clean_text(padded), 256).alias("cleaned"))


@query("is_available", f"""
SELECT ticket_id, {available_sql('close_notes')} AS notes, {available_sql('incident_outcome')} AS outcome,
  {available_sql('device_hostname')} AS device, {available_sql('historical_recommendations')} AS advice FROM [incidents]""")
def _(t):
    return t.incidents.select(
        "ticket_id", X.is_available(F.col("close_notes")).alias("notes"), X.is_available(F.col("incident_outcome")).alias("outcome"),
        X.is_available(F.col("device_hostname")).alias("device"), X.is_available(F.col("historical_recommendations")).alias("advice"),
    )


@query("first_available", f"""
SELECT ticket_id, {first_sql('historical_recommendations', 'close_notes', 'incident_outcome')} AS value FROM [incidents]""")
def _(t):
    cols = [F.col(c) for c in ("historical_recommendations", "close_notes", "incident_outcome")]
    return t.incidents.select("ticket_id", X.first_available(*cols).alias("value"))


@query("normalize_label", f"""
SELECT doc_id, sha256(regexp_replace(lower({clean_sql('text')}), '[{WS}]+', ' ', 'g')) AS label,
  sha256(trim(regexp_replace(lower({clean_sql('text')}), '[^a-z0-9]+', ' ', 'g'))) AS key FROM [documents]""")
def _(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id", F.sha2(X.normalize_label(text), 256).alias("label"), F.sha2(X.normalize_key(text), 256).alias("key")
    )


@query("normalize_json_path", f"""
SELECT page_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower({clean_sql("url || '[12].user_name[*]'")}),
    '\\[(?:[0-9]+|\\*)\\]', '.', 'g'), '[^a-z0-9]+'), lambda p: p <> '' AND NOT regexp_matches(p, '^[0-9]+$')), '.') AS path
FROM [pages]""")
def _(t):
    return t.pages.select("page_id", X.normalize_json_path(F.concat("url", F.lit("[12].user_name[*]"))).alias("path"))


def _escape_sql(x: str) -> str:
    return f"replace(replace({clean_sql(x)}, '\\', '\\\\'), '\"', '\\\"')"


@query("render_query", f"""
WITH q AS (SELECT ticket_id, {available_sql('incident_name')} AND {available_sql('tenant_name')} AS identified,
  'name:"' || {_escape_sql('incident_name')} || '" and tenantname:"' || {_escape_sql('tenant_name')} || '"' AS query FROM [incidents])
SELECT ticket_id, CASE WHEN identified THEN query END AS query, CASE WHEN NOT identified THEN 'missing_identity' END AS error FROM q""")
def _(t):
    text, error = X.render_query(F.col("incident_name"), F.col("tenant_name"))
    return t.incidents.select("ticket_id", text.alias("query"), error.alias("error"))


@query("user_query_expression", f"""
WITH q AS (SELECT ticket_id, {available_sql('incident_name')} AND {available_sql('tenant_name')} AS identified,
  'ticket<>' || ticket_id || ' name:"' || incident_name || '"' || CASE WHEN order_key % 9 = 0 THEN chr(10) ELSE '' END AS query FROM [incidents])
SELECT ticket_id, CASE WHEN identified AND NOT contains(query, chr(10)) THEN query END AS query,
  CASE WHEN NOT identified THEN 'missing_identity' WHEN contains(query, chr(10)) THEN 'invalid_query' END AS error FROM q""")
def _(t):
    text, error = X.user_query(
        "concat('ticket<>', ticket_id, ' name:\"', incident_name, '\"', if(order_key % 9 = 0, '\\n', ''))",
        F.col("incident_name"), F.col("tenant_name"),
    )
    return t.incidents.select("ticket_id", text.alias("query"), error.alias("error"))


# one link per page: the page's own, an overview route, a foreign or an insecure one
LINKS = """SELECT page_id, CASE
    WHEN page_id % 4 = 0 THEN 'https://Portal.Example.com:443/incident' || CAST(page_id % 3 AS STRING) || '/' || CAST(page_id AS STRING) || '/overview/'
    WHEN page_id % 4 = 1 THEN 'https://portal.example.com/Custom/Layout/' || CAST(page_id AS STRING) || '?tab=a#b'
    WHEN page_id % 8 = 2 THEN 'https://user@portal.example.com/incident/' || CAST(page_id AS STRING)
    WHEN page_id % 8 = 6 THEN 'https://portal.example.com/INCIDENT/' || CAST(page_id AS STRING) ELSE url END AS link FROM [pages]"""
_PARTS = "regexp_extract(link, '{p}', {n})".replace("{p}", K.URL_PARTS)


def part_sql(n: int) -> str:
    return _PARTS.replace("{n}", str(n))


_PATH = f"CASE WHEN {part_sql(3)} = '' THEN '/' ELSE {part_sql(3)} END"
_ORIGIN = (
    f"CASE WHEN {part_sql(1)} <> '' THEN lower({part_sql(1)}) || '://' || "
    f"regexp_replace(regexp_replace(lower({part_sql(2)}), '^[^@]*@', ''), CASE WHEN lower({part_sql(1)}) = 'https' THEN ':(443)?$' ELSE ':(80)?$' END, '') END"
)
_QUERY = f"CASE WHEN length({part_sql(4)}) > 1 THEN {part_sql(4)} ELSE '' END"
_HASH = f"CASE WHEN length({part_sql(5)}) > 1 THEN {part_sql(5)} ELSE '' END"
TRUSTED_SQL = (
    f"(lower({part_sql(1)}) = 'https' AND NOT contains({part_sql(2)}, '@') AND {_ORIGIN} = 'https://portal.example.com' AND "
    f"(regexp_matches({_PATH} || {_QUERY} || {_HASH}, '{K.INCIDENT_PATTERN}') OR ({_QUERY} = '' AND {_HASH} = '' AND "
    f"(regexp_matches({_PATH}, '{K.RESULT_ROUTE}') OR regexp_matches({_PATH}, '{K.OVERVIEW_ROUTE}')))))"
)
TICKET_SQL = (
    f"CASE WHEN regexp_extract({_PATH}, '{K.OVERVIEW_ROUTE}', 1) <> '' THEN regexp_extract({_PATH}, '{K.OVERVIEW_ROUTE}', 1) "
    f"ELSE regexp_extract({_PATH}, '{K.LAST_NUMBER}', 1) END"
)
def origin():
    return F.lit("https://portal.example.com")


@query("trusted_url", f"""
SELECT page_id, link, {TRUSTED_SQL} AS trusted FROM ({LINKS})""")
def _(t):
    return t.sql(LINKS).select("page_id", "link", U.trusted_url(F.col("link"), origin()).alias("trusted"))


@query("ticket_id_from_url", f"""
SELECT page_id, {TICKET_SQL} AS ticket_id, {_ORIGIN} AS origin FROM ({LINKS})""")
def _(t):
    return t.sql(LINKS).select("page_id", U.ticket_id_from_url(F.col("link")).alias("ticket_id"), U.url_origin(F.col("link")).alias("origin"))


@query("build_incident_url", f"""
SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN 'https://portal.example.com/Custom/GenericLayout/' || page_id END AS url,
  CASE WHEN regexp_matches({_PATH}, '/\\d+/?$') AND regexp_replace({_PATH}, '/\\d+(/?)$', '/' || (page_id + 1) || '\\1') <> {_PATH}
    THEN {_ORIGIN} || regexp_replace({_PATH}, '/\\d+(/?)$', '/' || (page_id + 1) || '\\1') END AS historic
FROM ({LINKS})""")
def _(t):
    ticket = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("x"), F.col("page_id").cast("string"))).otherwise(F.col("page_id").cast("string"))
    return t.sql(LINKS).select(
        "page_id", U.build_incident_url(ticket, origin()).alias("url"),
        U.build_historic_url(F.col("link"), (F.col("page_id") + 1).cast("string")).alias("historic"),
    )


@query("search_url", f"""
WITH s AS (SELECT ticket_id, {clean_sql('tenant_name')} AS q FROM [incidents]),
u AS (SELECT ticket_id, q, 'https://portal.example.com/incidents' || CASE WHEN q = '' THEN '' ELSE
  '?q=' || replace(replace(replace(url_encode(q), '%20', '+'), '~', '%7E'), '%2A', '*') END AS url FROM s)
SELECT ticket_id, url, CAST(ticket_id AS BIGINT) % 2 = 0 AS kept FROM u""")
def _(t):
    made = U.search_url(origin(), "/incidents", "q", F.col("tenant_name"))
    rows = t.incidents.select("ticket_id", "tenant_name", made.alias("url"))
    moved = F.when(F.col("ticket_id").cast("bigint") % 2 == 0, F.col("url")).otherwise(F.replace("url", F.lit("/incidents"), F.lit("/home")))
    return rows.select("ticket_id", "url", U.search_url_kept(moved, origin(), "/incidents", "q", F.col("tenant_name")).alias("kept"))


@query("canonical_json", """
WITH d AS (SELECT event_id, '{"type": "' || event_type || '", "id": ' || event_id || ', "a": {"z": null, "b": "x\\"y"}, "flag": true}' AS raw, props FROM [events])
SELECT event_id, '{"a":{"b":"x\\"y","z":null},"flag":true,"id":' || event_id || ',"type":"' || json_extract_string(raw, '$.type') || '"}' AS canonical,
  sha256(CAST(json(props) AS STRING)) AS digest FROM d""")
def _(t):
    raw = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "id": '), "event_id", F.lit(', "a": {"z": null, "b": "x\\"y"}, "flag": true}'))
    return t.events.select("event_id", J.canonical_json(raw).alias("canonical"), J.sha256_json(F.col("props")).alias("digest"))


# numbers of all sizes, plain and with exponents, next to a text that looks like one
_NUMBERS = """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CAST(l_partkey AS STRING) || '.' || CAST(l_suppkey AS STRING) || 'e' || CAST(l_orderkey % 60 - 30 AS STRING)
    WHEN 1 THEN CAST(l_partkey + 1 AS STRING) || '000' || CAST(l_orderkey AS STRING) || '000000000' WHEN 2 THEN '-0.' || repeat('0', CAST(l_orderkey % 9 AS INT)) || CAST(l_partkey AS STRING)
    ELSE CAST(l_suppkey AS STRING) || '.50' END AS n FROM [lineitem]"""
_PRINTED = f"""WITH t AS ({_NUMBERS}), a AS (SELECT *, CAST(CAST(n AS DOUBLE) AS STRING) AS p FROM t),
b AS (SELECT *, ltrim(split_part(split_part(p, 'e', 1), '.', 1), '-') AS i, split_part(split_part(p, 'e', 1), '.', 2) AS f, coalesce(TRY_CAST(split_part(p, 'e', 2) AS INT), 0) AS e FROM a),
c AS (SELECT *, trim(i || f, '0') AS d, length(i) + e - (length(i || f) - length(ltrim(i || f, '0'))) AS spot FROM b),
j AS (SELECT *, length(d) AS k, CASE WHEN p LIKE '-%' THEN '-' ELSE '' END AS s, d[1:1] || CASE WHEN length(d) > 1 THEN '.' || d[2:] ELSE '' END || 'e' AS m FROM c),
r AS (SELECT *, CASE WHEN d = '' THEN '0' WHEN k <= spot AND spot <= 21 THEN s || d || repeat('0', spot - k) WHEN 0 < spot AND spot <= 21 THEN s || d[1:spot] || '.' || d[spot + 1:]
    WHEN -6 < spot AND spot <= 0 THEN s || '0.' || repeat('0', -spot) || d ELSE s || m || CASE WHEN spot > 0 THEN '+' ELSE '-' END || abs(spot - 1) END AS shown,
  CASE WHEN d = '' THEN '0' WHEN regexp_matches(n, '^[0-9]{{1,21}}$') THEN n WHEN k <= spot AND spot <= 21 THEN s || d || repeat('0', spot - k) WHEN 0 < spot AND spot <= 21 THEN s || d[1:spot] || '.' || d[spot + 1:]
    WHEN -4 < spot AND spot <= 0 THEN s || '0.' || repeat('0', -spot) || d ELSE s || m || CASE WHEN spot > 0 THEN '+' || (spot - 1) ELSE '-' || lpad(CAST(1 - spot AS STRING), CAST(greatest(2, length(CAST(1 - spot AS STRING))) AS INT), '0') END END AS python FROM j)"""


@query("canonical_numbers", _PRINTED + """ SELECT l_orderkey, l_linenumber, '{"a":[' || shown || ',"' || n || '"],"b":' || shown || '}' AS canonical,
  sha256('{"a":[' || python || ',"' || n || '"],"b":' || python || '}') AS digest FROM r""")
def _(t):
    n = F.col("n")
    raw = F.concat(F.lit('{"b": '), n, F.lit(', "a": ['), n, F.lit(', "'), n, F.lit('"]}'))
    return t.sql(_NUMBERS).select("l_orderkey", "l_linenumber", J.canonical_json(raw).alias("canonical"), J.sha256_json(raw, python=True).alias("digest"))


@query("bounded_text", f"""
SELECT doc_id, sha256({trim_sql("replace(text, chr(0), '')")}) AS evidence FROM [documents]""")
def _(t):
    return t.documents.select("doc_id", F.sha2(X.bounded_text(F.col("text")), 256).alias("evidence"))


def epoch_sql(x: str) -> str:
    return (
        f"CASE WHEN abs({x}) >= 1e17 THEN floor({x} / 1e3) WHEN abs({x}) >= 1e14 THEN floor({x}) "
        f"WHEN abs({x}) >= 1e11 THEN floor({x} * 1e3) ELSE floor({x} * 1e6) END"
    )


@query("epoch_to_ts", f"""
WITH e AS (SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN floor(epoch_us(ts) / 1000000) WHEN 1 THEN floor(epoch_us(ts) / 1000)
  WHEN 2 THEN epoch_us(ts) ELSE CAST(epoch_us(ts) AS HUGEINT) * 1000 END AS DOUBLE) AS x FROM [events])
SELECT event_id, CAST({epoch_sql('x')} AS BIGINT) AS micros FROM e""")
def _(t):
    rows = t.sql("""SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN floor(<micros(ts)> / 1000000) WHEN 1 THEN floor(<micros(ts)> / 1000)
        WHEN 2 THEN <micros(ts)> ELSE CAST(<micros(ts)> AS DECIMAL(38,0)) * 1000 END AS DOUBLE) AS x FROM [events]""")
    return rows.select("event_id", T.epoch_micros(F.col("x")).alias("micros"))


@query("parse_iso_ts", """
WITH e AS (SELECT event_id, ts FROM [events])
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN epoch_us(ts) WHEN event_id % 6 = 1 THEN epoch_us(ts) - 9000000000
  WHEN event_id % 6 = 2 THEN epoch_us(ts) WHEN event_id % 6 = 3 THEN epoch_us(date_trunc('second', ts)) + 12300000000 END AS micros FROM e""")
def _(t):
    rows = t.sql("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(ts AS STRING) || '' WHEN 1 THEN replace(CAST(ts AS STRING), ' ', 'T') || '+02:30'
        WHEN 2 THEN replace(CAST(ts AS STRING), ' ', 'T') || 'Z' WHEN 3 THEN substring(CAST(ts AS STRING), 1, 19) || '-03:25'
        WHEN 4 THEN '2023-02-30T' || substring(CAST(ts AS STRING), 12, 8) ELSE substring(CAST(ts AS STRING), 1, 10) || 'T24:00:00' END AS x FROM [events]""")
    return rows.select("event_id", T.iso_micros(F.col("x")).alias("micros"))


# --- eligibility, once per leaf ------------------------------------------------
TEXT_SQL = f"CASE WHEN vtype = 'null' THEN '' ELSE {trim_sql('value_text')} END"
ISO_SQL = "'^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}(?:\\.\\d{1,9})?(?:Z|[+-]\\d{2}:\\d{2})?$'"
MOMENT_SQL = f"""CASE WHEN vtype = 'number' OR (vtype = 'string' AND regexp_matches(txt, '^\\d+(?:\\.\\d+)?$'))
    THEN {epoch_sql("TRY_CAST(txt AS DOUBLE)")}
    WHEN vtype = 'string' AND regexp_matches(txt, {ISO_SQL})
    THEN epoch_us(TRY_CAST(regexp_replace(txt, 'Z$', '') AS TIMESTAMP)) END"""
TESTED = NODES + f""", texts AS (SELECT *, {TEXT_SQL} AS txt FROM leaves), tested AS (SELECT *,
    CASE WHEN txt = '' THEN 'empty_value' WHEN regexp_matches(txt, '{K.IP_ANY}') THEN '' ELSE 'invalid_ip' END AS r_ip,
    CASE WHEN txt = '' THEN 'empty_value' WHEN regexp_matches(lower(txt), '^https?://[^/?# ]+') THEN '' ELSE 'invalid_url' END AS r_url,
    CASE WHEN txt = '' THEN 'empty_value' WHEN coalesce({MOMENT_SQL} >= 946684800000000 AND {MOMENT_SQL} < 4102444800000000, false)
      THEN '' ELSE 'invalid_event_time' END AS r_timestamp,
    CASE WHEN txt = '' THEN 'empty_value' WHEN vtype = 'string' THEN '' ELSE 'requires_text' END AS r_text,
    CASE WHEN txt = '' THEN 'empty_value' WHEN vtype IN ('string', 'number') THEN '' ELSE 'requires_text_or_number' END AS r_identifier
    FROM texts)"""


def _tested(t):
    return with_reasons(flatten.leaves(t.alert_docs))


@query("eligible_ip", TESTED + " SELECT pointer, r_ip AS reason, count(*) AS n, max(value_text) AS sample FROM tested GROUP BY ALL")
def _(t):
    return _tested(t).groupBy("pointer", F.col("reason.ip").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.max("value_text").alias("sample"))


@query("eligible_url", TESTED + " SELECT pointer, r_url AS reason, count(*) AS n, max(value_text) AS sample FROM tested GROUP BY ALL")
def _(t):
    return _tested(t).groupBy("pointer", F.col("reason.url").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.max("value_text").alias("sample"))


@query("eligible_timestamp", TESTED + " SELECT incident_id, pointer, r_timestamp AS reason FROM tested")
def _(t):
    return _tested(t).select("incident_id", "pointer", F.col("reason.timestamp").alias("reason"))


@query("eligible_text", TESTED + " SELECT incident_id, pointer, r_text AS text_reason, r_identifier AS identifier_reason FROM tested")
def _(t):
    return _tested(t).select(
        "incident_id", "pointer", F.col("reason.text").alias("text_reason"), F.col("reason.identifier").alias("identifier_reason")
    )
