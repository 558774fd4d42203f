"""Bindings: history search, response text, readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimap.operators import history as H
from evimap.plans.registry import query
from evimap.plans.scalars import available_sql, clean_sql, first_sql

MATCHES = f"""
WITH keyed AS (SELECT *, lower({clean_sql('tenant_name')}) AS tk, lower({clean_sql('incident_name')}) AS nk,
    {first_sql('historical_recommendations', 'close_notes', 'incident_outcome')} AS resolution,
    {clean_sql('historical_recommendations')} <> '' OR {clean_sql('close_notes')} <> '' OR {clean_sql('incident_outcome')} <> '' AS resolved
    FROM [incidents]),
matches AS (SELECT a.ticket_id, b.ticket_id AS historic_id, b.resolution,
    row_number() OVER (PARTITION BY a.ticket_id ORDER BY b.created DESC, b.order_key DESC) AS rank
    FROM keyed a JOIN keyed b ON a.tk = b.tk AND a.nk = b.nk AND a.ticket_id <> b.ticket_id WHERE a.tk <> '' AND a.nk <> '' AND b.resolved)"""

LINES = MATCHES + """, told AS (SELECT ticket_id, historic_id, resolution, row_number() OVER (PARTITION BY ticket_id ORDER BY rank) AS n
    FROM matches WHERE rank <= 3 AND resolution <> ''),
lines AS (SELECT ticket_id, string_agg(n || '. #' || historic_id || ': ' || resolution, chr(10) ORDER BY n) AS historic, count(*) AS lines FROM told GROUP BY ticket_id)"""


@query("historic_matches", MATCHES + " SELECT ticket_id, historic_id, rank FROM matches WHERE rank <= 20")
def _(t):
    return H.historic_matches(t.incidents, 20)


@query("historic_matches_lookback", MATCHES.replace("AND b.resolved", "AND b.resolved AND b.created >= TIMESTAMP '1998-01-01 00:00:00'") + """
SELECT ticket_id, historic_id, rank FROM matches WHERE rank <= 20""")
def _(t):
    return H.historic_matches(t.incidents, 20, since=F.expr("timestamp_ntz'1998-01-01 00:00:00'"))


@query("topk_resolutions", MATCHES + " SELECT ticket_id, rank, historic_id, resolution FROM matches WHERE rank <= 3")
def _(t):
    return H.topk_resolutions(t.incidents, 3)


@query("historic_resolution", MATCHES + " SELECT ticket_id, resolution, resolved FROM keyed")
def _(t):
    return t.incidents.select("ticket_id", H.historic_resolution().alias("resolution"), H.has_resolution().alias("resolved"))


@query("historic_lines", LINES + " SELECT ticket_id, historic, lines FROM lines")
def _(t):
    return H.historic_lines(H.topk_resolutions(t.incidents, 3))


def _na(*cols: str) -> str:
    return f"coalesce(nullif({first_sql(*cols)}, ''), 'n/a')"


@query("affected_entity", f"""
SELECT ticket_id, {_na('device_hostname', 'source_hostname', 'source_username', 'client_user_name')} AS entity FROM [incidents]""")
def _(t):
    return t.incidents.withColumn("client_hostname", F.lit("")).select("ticket_id", H.affected_entity().alias("entity"))


_RULE = "-" * 65
_CONTACT = ("If you require further details or you would like to discuss this incident, please contact our 24x7 team and quote the Ticket ID."
            "\n\nKind regards,")


@query("render_response", LINES + f"""
SELECT i.ticket_id, sha256(CASE WHEN {available_sql('customer_name')} THEN 'Hello ' || {clean_sql('customer_name')} || ',\n' ELSE '' END
  || 'Incident ID: ' || i.ticket_id || '\nIncident: ' || {_na('incident_name')}
  || '\nAffected entity: ' || {_na('device_hostname', 'source_hostname', 'source_username', 'client_user_name')}
  || '\nRecorded classification: ' || {_na('classification')} || '\n{_RULE}\n\nEvent info breakdown is as follows:\n\nTime Stamp: ' || {_na('occurred')}
  || '\nUser: ' || {_na('source_username', 'client_user_name')} || '\nSource: ' || {_na('source_username', 'client_user_name')}
  || '\nDestination: n/a\nClient Hostname: ' || {_na('device_hostname')} || '\nEvent Detail: n/a\nEvent Record URL: n/a\nError / Service Message: n/a\n{"-" * 58}\n\n'
  || 'Processed Incident Data\nEvent Summary: ' || CASE WHEN i.order_key % 3 = 0 THEN 'Order of ' || i.total_price ELSE 'No additional source facts were extracted.' END
  || '\nObserved Facts:\n' || CASE WHEN i.order_key % 3 = 0 THEN '- status ' || i.classification || '\n- seen' ELSE 'No additional source facts were extracted.' END
  || '\n-----\n\n{_CONTACT}\n\nHistoric\n' || coalesce(historic, 'No matching historic resolutions were found.')) AS draft
FROM [incidents] i LEFT JOIN lines l ON i.ticket_id = l.ticket_id""")
def _(t):
    incidents = t.incidents
    lines = H.historic_lines(H.topk_resolutions(incidents, 3))
    enriched = incidents.where("order_key % 3 = 0").select(
        "ticket_id", F.concat(F.lit("Order of "), F.col("total_price").cast("string")).alias("event_summary"),
        F.array(F.concat(F.lit("status  "), "classification"), F.lit("N/A"), F.lit("seen"), F.lit(" seen")).alias("observed_facts"),
    )
    return H.render_response(incidents, lines, enriched).select("ticket_id", F.sha2("draft", 256).alias("draft"))


@query("readiness", f"""
WITH r AS (SELECT ticket_id, concat_ws(',', CASE WHEN NOT ({available_sql('incident_name')}) THEN 'incident_name' END,
    CASE WHEN NOT ({available_sql('tenant_name')}) THEN 'tenant_name' END) AS missing_required,
  concat_ws(',', CASE WHEN NOT ({available_sql('customer_name')}) THEN 'customer_name' END,
    CASE WHEN NOT ({available_sql('device_hostname')}) THEN 'device_hostname' END) AS missing_preferred,
  {available_sql('close_notes')} OR {available_sql('incident_outcome')} AS any_ready, order_key % 10 <> 0 AS documents_ready FROM [incidents])
SELECT *, missing_required = '' AND any_ready AND documents_ready AS ready FROM r""")
def _(t):
    checked = H.readiness(t.incidents, ["incident_name", "tenant_name"], ["close_notes", "incident_outcome"],
                          ["customer_name", "device_hostname"], F.col("order_key") % 10 != 0)
    return checked.select("ticket_id", F.array_join("missing_required", ",").alias("missing_required"),
                          F.array_join("missing_preferred", ",").alias("missing_preferred"), "any_ready", "documents_ready", "ready")


@query("lookup_warnings", MATCHES + """, found AS (SELECT ticket_id, count(*) FILTER (rank <= 3) AS found FROM matches GROUP BY ticket_id)
SELECT i.ticket_id, concat_ws(' ', CASE WHEN i.order_key % 4 = 0 THEN 'Historic incident #1 could not be read: gone.' END,
  CASE WHEN i.order_key % 3 = 0 AND coalesce(found, 0) < 3 THEN 'Historic search results were incomplete; older matches may be omitted.' END) AS warning
FROM [incidents] i LEFT JOIN found f ON i.ticket_id = f.ticket_id""")
def _(t):
    incidents = t.incidents
    found = H.topk_resolutions(incidents, 3).groupBy("ticket_id").agg(F.count(F.lit(1)).alias("found"))
    gone = F.lit("Historic incident #1 could not be read: gone.")
    failures = F.when(F.col("order_key") % 4 == 0, F.array(gone, gone)).otherwise(F.array().cast("array<string>"))
    joined = incidents.select("ticket_id", "order_key").join(found, "ticket_id", "left")
    return joined.select("ticket_id", H.lookup_warning(failures, F.col("order_key") % 3 == 0, F.coalesce("found", F.lit(0)), 3).alias("warning"))


@query("processing_mode", """
SELECT CASE WHEN order_key % 2 = 0 AND order_key % 3 = 0 THEN 'Field mapping + local enrichment' WHEN order_key % 2 = 0 THEN 'Field mapping'
  WHEN order_key % 3 = 0 THEN 'Deterministic extraction + local enrichment' ELSE 'Deterministic extraction' END AS mode, count(*) AS n
FROM [incidents] GROUP BY ALL""")
def _(t):
    key = F.col("order_key")
    return t.incidents.groupBy(H.processing_mode(key % 2 == 0, key % 3 == 0).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
