"""Earlier incidents with the same tenant and name, and the rendered response."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimap import constants as K
from evimap.functions.text import available_clean, clean_text, first_available, is_available

RESOLUTION = ("historical_recommendations", "close_notes", "incident_outcome")


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by unfolding an array of one, so that a filter on them stays above and does not work them out again."""
    made = rows.withColumn("_once", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return made.withColumns({name: F.col(f"_once.{name}") for name in columns}).drop("_once")


def with_identity(incidents: DataFrame) -> DataFrame:
    """Adds the compared tenant and name; '' where there is none.

    A search row's identity (``row_tenant_name``, ``row_name``) wins over the
    page's; a page that shows another identity is not a match at all.
    """
    names = [n for n in ("tenant_name", "row_tenant_name", "incident_name", "row_name") if n in incidents.columns]
    read = incidents.withColumns({f"_read_{n}": F.lower(clean_text(F.col(n))) for n in names})

    def key(page: str, row: str) -> Column:
        own = F.col(f"_read_{page}")
        if row not in names:
            return own
        shown = F.col(f"_read_{row}")
        return F.when(shown == "", own).when((own == "") | (own == shown), shown).otherwise(F.lit(""))

    keyed = _once(read, tenant_key=key("tenant_name", "row_tenant_name"), name_key=key("incident_name", "row_name"))
    return keyed.drop(*(f"_read_{n}" for n in names))


def has_resolution() -> Column:
    return F.greatest(*(clean_text(F.col(c)) != "" for c in RESOLUTION))


def historic_resolution() -> Column:
    """Recommendations, else close notes, else outcome; '' when none says anything."""
    return first_available(*(F.col(c) for c in RESOLUTION))


def latest_per_key(incidents: DataFrame, k: int | None, order: str = "created", tie: str = "order_key",
                   search_cap: int | None = None, since: Column | None = None) -> DataFrame:
    """At most k+1 resolved incidents per (tenant, name), newest first; all without k.

    One more than k, because an incident's own row is taken out later. The
    rank filter is applied on the map side too, so a key that holds a third of
    all rows sends only k+1 of them from each task.
    """
    rows = with_identity(incidents).where((F.col("tenant_key") != "") & (F.col("name_key") != ""))
    if since is not None:
        rows = rows.where(F.col(order) >= since)
    by_key = Window.partitionBy("tenant_key", "name_key").orderBy(F.desc(order), F.desc(tie))
    if search_cap is not None:
        rows = rows.withColumn("found", F.row_number().over(by_key)).where(F.col("found") <= search_cap)
    said = rows.withColumns({f"_clean_{c}": clean_text(F.col(c)) for c in RESOLUTION})
    cleaned = [F.col(f"_clean_{c}") for c in RESOLUTION]
    told = F.coalesce(*(F.when(available_clean(c), c) for c in cleaned), F.lit(""))
    resolved = _once(said, _resolved=F.greatest(*(c != "" for c in cleaned)), resolution=told).where("_resolved").select(
        "tenant_key", "name_key", order, tie, F.col("ticket_id").alias("historic_id"), "resolution"
    )
    placed = resolved.withColumn("place", F.row_number().over(by_key))
    return placed if k is None else placed.where(F.col("place") <= k + 1)


def topk_resolutions(incidents: DataFrame, k: int | None = 3, search_cap: int | None = None, since: Column | None = None) -> DataFrame:
    """(ticket_id, rank, historic_id, resolution): the first k per incident, or all, itself excluded.

    Each key becomes one short list; incidents meet their list by an equi-join
    whose hot keys adaptive execution may split, since a list is tiny.
    """
    if k is not None and k < 1:
        raise ValueError("k must be at least 1, or None for all")
    latest = latest_per_key(incidents, k, search_cap=search_cap, since=since)
    asking = with_identity(incidents).select("ticket_id", "tenant_key", "name_key").where("tenant_key <> '' and name_key <> ''")
    if k is None:  # all matches: pairs of rows, never a list of a whole key
        own = Window.partitionBy("ticket_id", "tenant_key", "name_key").orderBy("place")
        pairs = asking.join(latest, ["tenant_key", "name_key"]).where(F.col("historic_id") != F.col("ticket_id"))
        return pairs.select("ticket_id", F.dense_rank().over(own).alias("rank"), "historic_id", "resolution")
    lists = latest.groupBy("tenant_key", "name_key").agg(
        F.array_sort(F.collect_list(F.struct("place", "historic_id", "resolution"))).alias("latest")
    )
    others = F.filter("latest", lambda h: h["historic_id"] != F.col("ticket_id"))
    return (
        asking.join(lists, ["tenant_key", "name_key"])
        .select("ticket_id", F.posexplode(others if k is None else F.slice(others, 1, k)).alias("at", "h"))
        .select("ticket_id", (F.col("at") + 1).alias("rank"), "h.historic_id", "h.resolution")
    )


def historic_matches(incidents: DataFrame, k: int | None = None, search_cap: int | None = None, since: Column | None = None) -> DataFrame:
    """The self-join alone: (ticket_id, historic_id, rank)."""
    return topk_resolutions(incidents, k, search_cap, since).select("ticket_id", "historic_id", "rank")


def historic_lines(matches: DataFrame) -> DataFrame:
    """``n. #ticket: resolution`` per incident, numbered over those that say something."""
    told = matches.where(F.col("resolution") != "")
    row = F.struct("rank", F.when(F.coalesce("historic_id", F.lit("")) == "", "unknown").otherwise(F.col("historic_id")).alias("id"), "resolution")
    ordered = told.groupBy("ticket_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lines = F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". #"), r["id"], F.lit(": "), r["resolution"]))
    return ordered.select("ticket_id", F.array_join(lines, "\n").alias("historic"), F.size("rows").alias("lines"))


def affected_entity(names: Mapping[str, str] | None = None) -> Column:
    """Device, source and client host, then source and client user."""
    order = names or {}
    cols = ("device_hostname", "source_hostname", "client_hostname", "source_username", "client_user_name")
    value = first_available(*(F.col(order.get(c, c)) for c in cols))
    return F.when(value == "", "n/a").otherwise(value)


def distinct_facts(facts: Column, limit: int | None = None) -> Column:
    cleaned = F.transform(facts, clean_text)
    distinct = F.array_distinct(F.filter(cleaned, available_clean))
    return distinct if limit is None else F.slice(distinct, 1, limit)


# Fixed text of the response; {name} is filled from the incident.
RESPONSE_LAYOUT = (
    ("Incident ID: ", "ticket"),
    ("\nIncident: ", "name"),
    ("\nAffected entity: ", "entity"),
    ("\nRecorded classification: ", "classification"),
    ("\n-----------------------------------------------------------------\n\nEvent info breakdown is as follows:\n\nTime Stamp: ", "occurred"),
    ("\nUser: ", "user"),
    ("\nSource: ", "source"),
    ("\nDestination: ", "destination"),
    ("\nClient Hostname: ", "client_host"),
    ("\nEvent Detail: ", "event"),
    ("\nEvent Record URL: ", "url"),
    ("\nError / Service Message: ", "message"),
    ("\n----------------------------------------------------------\n\nProcessed Incident Data\nEvent Summary: ", "summary"),
    ("\nObserved Facts:\n", "facts"),
    ("\n-----\n\n", "contact"),
    ("\n\nHistoric\n", "historic"),
)
RESPONSE_TEXTS = (
    "ticket_id", "incident_name", "device_hostname", "source_hostname", "client_hostname", "source_username", "client_user_name", "classification", "occurred",
    "source_ip", "destination_ip", "event_name", "detection_url", "service_message", "event_info", "error_message", "event_summary", "customer_name",
)
NO_FACTS = "No additional source facts were extracted."
NO_HISTORY = "No matching historic resolutions were found."


def render_response(incidents: DataFrame, lines: DataFrame, enrichment: DataFrame | None = None,
                    template: Mapping[str, str] | None = None) -> DataFrame:
    """(ticket_id, draft): one text per incident.

    ``lines`` comes from :func:`historic_lines`; ``enrichment`` has (ticket_id,
    event_summary, observed_facts). Absent columns read as not available.
    """
    words = {**K.RESPONSE_TEMPLATE, **(template or {})}
    joined = incidents.join(lines.select("ticket_id", "historic"), "ticket_id", "left")
    if enrichment is not None:
        joined = joined.join(enrichment, "ticket_id", "left")

    # each text is cleaned once, and small steps keep their methods such as the JVM compiles
    texts = [n for n in RESPONSE_TEXTS if n in joined.columns]
    joined = joined.withColumns({f"_clean_{n}": clean_text(F.col(n)) for n in texts})
    joined = joined.withColumns({f"_said_{n}": F.when(available_clean(F.col(f"_clean_{n}")), F.col(f"_clean_{n}")) for n in texts})

    def said(*names: str) -> Column:
        return F.coalesce(*(F.col(f"_said_{n}") for n in names if n in texts), F.lit(""))

    def or_na(*names: str) -> Column:
        return F.coalesce(*(F.col(f"_said_{n}") for n in names if n in texts), F.lit("n/a"))

    facts = distinct_facts(F.coalesce(F.col("observed_facts"), F.array().cast("array<string>"))) if enrichment is not None else F.array().cast("array<string>")
    summary = said("event_summary")
    signature = "\n".join(w for w in (words["signOff"], words["analystName"], words["analystTitle"] if words["analystName"] else "") if w)
    fields = {
        "ticket": or_na("ticket_id"),
        "name": or_na("incident_name"),
        "entity": or_na("device_hostname", "source_hostname", "client_hostname", "source_username", "client_user_name"),
        "classification": or_na("classification"),
        "occurred": or_na("occurred"),
        "user": or_na("source_username", "client_user_name"),
        "source": or_na("source_ip", "source_username", "client_user_name"),
        "destination": or_na("destination_ip"),
        "client_host": or_na("client_hostname", "device_hostname"),
        "event": or_na("event_name"),
        "url": or_na("detection_url"),
        "message": or_na("service_message", "event_info", "error_message"),
        "summary": F.when(summary == "", F.lit(NO_FACTS)).otherwise(summary),
        "facts": F.when(F.size(facts) > 0, F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n")).otherwise(F.lit(NO_FACTS)),
        "contact": F.lit(words["contactText"] + ("\n\n" + signature if signature else "")),
        "historic": F.coalesce("historic", F.lit(NO_HISTORY)),
    }
    customer = said("customer_name")
    greeting = F.when(customer == "", F.lit("")).otherwise(F.concat(F.lit(words["greeting"] + " "), customer, F.lit(",\n")))
    pieces = [part for text, name in RESPONSE_LAYOUT for part in (F.lit(text), fields[name])]
    return joined.select("ticket_id", F.concat(greeting, *pieces).alias("draft"))


def missing_fields(names: list[str]) -> Column:
    """Names of columns without an available value, in the given order."""
    return F.array_compact(F.array(*(F.when(~is_available(F.col(n)), F.lit(n)) for n in names)))


def readiness(incidents: DataFrame, required: list[str], any_of: list[str], preferred: list[str], documents_complete: Column | None = None) -> DataFrame:
    """Whether a view holds what it must, and what is missing."""
    any_ready = F.greatest(*(is_available(F.col(n)) for n in any_of), F.lit(False)) if any_of else F.lit(True)
    documents = F.coalesce(documents_complete, F.lit(False)) if documents_complete is not None else F.lit(True)
    return (
        incidents.withColumn("missing_required", missing_fields(required))
        .withColumn("missing_preferred", missing_fields(preferred))
        .withColumn("any_ready", any_ready).withColumn("documents_ready", documents)
        .withColumn("ready", (F.size("missing_required") == 0) & F.col("any_ready") & F.col("documents_ready"))
    )


def lookup_warning(failures: Column, truncated: Column, found: Column, k: int) -> Column:
    """Distinct failures, then the truncation note when too few were found."""
    note = F.when(truncated & (found < k), F.lit("Historic search results were incomplete; older matches may be omitted."))
    return F.array_join(F.array_distinct(F.array_compact(F.concat(failures, F.array(note)))), " ")


# Fixed names of the processing modes: (mapped, enriched) -> label.
MODES = {
    (True, True): "Field mapping + local enrichment",
    (True, False): "Field mapping",
    (False, True): "Deterministic extraction + local enrichment",
    (False, False): "Deterministic extraction",
}


def processing_mode(mapped: Column, enriched: Column) -> Column:
    return (
        F.when(mapped & enriched, MODES[True, True]).when(mapped, MODES[True, False])
        .when(enriched, MODES[False, True]).otherwise(MODES[False, False])
    )
