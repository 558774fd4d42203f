"""Trusted-link rules for incident and search URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evimap import constants as K
from evimap.functions.text import clean_text


def url_part(col: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with '?', 5 fragment with '#'."""
    return F.regexp_extract(col, K.URL_PARTS, group)


def url_origin(col: Column) -> Column:
    """scheme://host with a lower-case host, the default port dropped."""
    scheme = F.lower(url_part(col, 1))
    host = F.regexp_replace(F.lower(url_part(col, 2)), "^[^@]*@", "")
    standard = F.when(scheme == "https", F.lit(":443")).otherwise(F.lit(":80"))
    host = F.when(F.endswith(host, standard), F.substring(host, F.lit(1), F.length(host) - F.length(standard))).otherwise(
        F.regexp_replace(host, ":$", "")
    )
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host))


def _path(col: Column) -> Column:
    path = url_part(col, 3)
    return F.when(path == "", F.lit("/")).otherwise(path)


def _tail(col: Column, group: int) -> Column:
    """Query or fragment; a lone '?' or '#' counts as none."""
    part = url_part(col, group)
    return F.when(F.length(part) > 1, part).otherwise(F.lit(""))


def trusted_url(col: Column, origin: Column, pattern: str = K.INCIDENT_PATTERN) -> Column:
    """TRUE when the link is an incident page of the given origin."""
    path, query, fragment = _path(col), _tail(col, 4), _tail(col, 5)
    routed = (query == "") & (fragment == "") & (path.rlike(K.RESULT_ROUTE) | path.rlike(K.OVERVIEW_ROUTE))
    allowed = F.concat(path, query, fragment).rlike(pattern) | routed
    trusted = (
        (F.lower(url_part(col, 1)) == "https")
        & ~F.contains(url_part(col, 2), F.lit("@"))
        & (url_origin(col) == origin)
        & allowed
    )
    return F.coalesce(trusted, F.lit(False))


def ticket_id_from_url(col: Column) -> Column:
    overview = F.regexp_extract(_path(col), K.OVERVIEW_ROUTE, 1)
    return F.when(overview != "", overview).otherwise(F.regexp_extract(_path(col), K.LAST_NUMBER, 1))


def build_incident_url(ticket: Column, origin: Column, template: str = K.INCIDENT_TEMPLATE) -> Column:
    """URL of a ticket, NULL unless the id is numeric."""
    before, after = template.split("{id}")
    return F.when(ticket.rlike("^[0-9]+$"), F.concat(origin, F.lit(before), ticket, F.lit(after)))


def build_historic_url(current: Column, ticket: Column) -> Column:
    """The current page's URL with its last path number replaced.

    NULL when the id is not numeric, the path does not end in a number, or
    nothing would change.
    """
    path = _path(current)
    replaced = F.regexp_replace(path, F.lit(r"/\d+(/?)$"), F.concat(F.lit("/"), ticket, F.lit("$1")))
    return F.when(ticket.rlike("^[0-9]+$") & (replaced != path), F.concat(url_origin(current), replaced))


def search_url(origin: Column, path: str, parameter: str, query: Column) -> Column:
    text = clean_text(query)
    base = F.concat(origin, F.lit(path))
    return F.when(text == "", base).otherwise(F.concat(base, F.lit(f"?{parameter}="), F.url_encode(text)))


def search_url_kept(url: Column, origin: Column, path: str, parameter: str, expected: Column) -> Column:
    """TRUE when a page kept the search path and the expected query."""
    value = F.regexp_extract(_tail(url, 4), rf"[?&]{parameter}=([^&]*)", 1)
    same_path = F.regexp_replace(_path(url), "(.)/+$", "$1") == (path.rstrip("/") or "/")
    return F.coalesce(
        (F.lower(url_part(url, 1)) == "https") & (url_origin(url) == origin) & same_path
        & (clean_text(F.try_url_decode(value)) == clean_text(expected)),
        F.lit(False),
    )
