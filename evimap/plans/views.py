"""Relations derived from the driver tables, as SQL text both engines read.

Each view is a template: ``[name]`` stands for a table or another view and
``<macro(...)>`` style differences between the engines go through MACROS. The
Spark side opens a view as a DataFrame; the check side gets it as a CTE.
"""

from __future__ import annotations

import hashlib
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from evimap.session import spread

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # one incident per order; tenant and name come in several spellings
    "incidents": """
        SELECT CAST(o.o_orderkey AS STRING) AS ticket_id, o.o_orderkey AS order_key, o.o_orderdate AS created,
          CASE WHEN o.o_orderkey % 11 = 0 THEN upper(c.c_mktsegment) || '   ' || n.n_name
               WHEN o.o_orderkey % 13 = 0 THEN ' ' || lower(c.c_mktsegment) || '\u00a0' || n.n_name
               ELSE c.c_mktsegment || ' ' || n.n_name END AS tenant_name,
          CASE WHEN o.o_orderkey % 17 = 0 THEN lower(o.o_orderpriority) || ' '
               WHEN o.o_orderkey % 19 = 0 THEN '' ELSE o.o_orderpriority END AS incident_name,
          CASE WHEN o.o_orderkey % 5 = 0 THEN 'Advise team ' || CAST(o.o_custkey % 7 AS STRING)
               WHEN o.o_orderkey % 5 = 1 THEN 'N/A' ELSE '' END AS historical_recommendations,
          CASE WHEN o.o_orderstatus = 'F' THEN 'Closed for ' || c.c_name || ' \n by desk ' || CAST(o.o_custkey % 9 AS STRING)
               WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 2 = 0 THEN '-' END AS close_notes,
          CASE WHEN o.o_orderstatus = 'O' AND o.o_orderkey % 3 = 0 THEN 'none'
               WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 4 = 1 THEN 'Resolved\tautomatically' ELSE '' END AS incident_outcome,
          CASE WHEN o.o_orderkey % 6 = 0 THEN 'undefined' ELSE c.c_name END AS customer_name,
          CASE WHEN o.o_orderkey % 4 = 0 THEN 'host-' || CAST(o.o_custkey % 50 AS STRING) ELSE 'NA' END AS device_hostname,
          CASE WHEN o.o_orderkey % 4 = 1 THEN 'src-' || CAST(o.o_custkey % 50 AS STRING) ELSE '' END AS source_hostname,
          CASE WHEN o.o_orderkey % 4 = 2 THEN 'user' || CAST(o.o_custkey AS STRING) END AS source_username,
          CASE WHEN o.o_orderkey % 8 = 3 THEN 'client' || CAST(o.o_custkey AS STRING) ELSE 'null' END AS client_user_name,
          CAST(o.o_orderdate AS STRING) AS occurred, o.o_orderstatus AS classification, o.o_totalprice AS total_price
        FROM [orders] o JOIN [customer] c ON o.o_custkey = c.c_custkey JOIN [nation] n ON c.c_nationkey = n.n_nationkey""",
    # one or two JSON documents per event; a few are cut short and do not parse
    "alert_docs": """
        SELECT event_id AS incident_id, 0 AS doc_index,
          CASE WHEN event_id % 997 = 5 THEN '{"event": {"id": ' ELSE
          '{"event": {"id": "E' || CAST(event_id AS STRING) || '", "type": "' || event_type || '", "time": '
          || CASE WHEN event_id % 5 = 0 THEN '"' || CAST(ts AS STRING) || '"'
                  WHEN event_id % 5 = 1 THEN CAST(CAST(floor(<micros(ts)> / 1000000) AS BIGINT) AS STRING)
                  WHEN event_id % 5 = 2 THEN CAST(CAST(floor(<micros(ts)> / 1000) AS BIGINT) AS STRING)
                  WHEN event_id % 5 = 3 THEN '"' || CAST(<micros(ts)> AS STRING) || '"'
                  ELSE '"' || replace(CAST(ts AS STRING), ' ', 'T') || 'Z"' END
          || '}, "source": {"ip": "' || CASE WHEN event_id % 7 = 0 THEN '198.51.100.' || CAST(user_id AS STRING)
                  WHEN event_id % 23 = 0 THEN '999.1.2.' || CAST(user_id AS STRING)
                  WHEN event_id % 29 = 0 THEN '2001:db8::' || CAST(user_id % 100 AS STRING)
                  ELSE '192.0.2.' || CAST(user_id AS STRING) END
          || '", "hostname": "host-' || CAST(user_id % 40 AS STRING) || '", "user name": "user' || CAST(user_id AS STRING) || '"}, "client": {"ip": "'
          || CASE WHEN event_id % 3 = 0 THEN '192.0.2.' || CAST(user_id AS STRING) ELSE '203.0.113.' || CAST(user_id AS STRING) END
          || '"}, "attributes": [{"key": "deviceHostname", "value": "dev/' || CAST(user_id % 30 AS STRING) || '"}, {"key": "score", "value": '
          || CAST(value AS STRING) || '}], "api_key": "k~' || CAST(event_id % 4 AS STRING) || '", "flags": {"seen": '
          || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
          || ', "empty": "", "none": null, "list": [], "box": {}}, "props": ' || props || '}' END AS raw
        FROM [events]
        UNION ALL
        SELECT event_id, 1, '{"Source IP": "192.0.2.' || CAST(user_id AS STRING) || '", "Event Name": "' || event_type
          || CASE WHEN event_id % 8 = 0 THEN ' seen' ELSE '' END
          || '", "Detection URL": "' || CASE WHEN event_id % 6 = 0 THEN 'ftp://alerts.example.com/' ELSE 'https://alerts.example.com/e/' END
          || CAST(event_id AS STRING) || '", "a.b": [[1, 2], {"x\\\\/y": "' || event_type || '"}]}'
        FROM [events] WHERE event_id % 4 = 0""",
}

# curation: one draft per text, its source labels, and reviews from the quality labels
VIEWS["drafts"] = """
    SELECT 'r' || CAST(doc_id AS STRING) AS record_id, doc_id, 'fam.' || source AS family,
      CASE WHEN doc_id % 313 = 7 THEN 'development' WHEN CAST(substring(source, 4, 9) AS INT) % 5 = 0 THEN 'frozen-test'
           WHEN CAST(substring(source, 4, 9) AS INT) % 5 = 1 THEN 'development' ELSE 'train' END AS split,
      CASE WHEN doc_id % 37 = 3 THEN 'local.entra.' || CAST(doc_id AS STRING) ELSE 'prov' || CAST(doc_id % 30 AS STRING) END AS provenance_id,
      doc_id % 4 = 0 AS review_required, CASE WHEN doc_id % 8 = 0 THEN 'role is unclear' ELSE ' ' END AS note, 'kind' || CAST(doc_id % 3 AS STRING) AS variant_kind,
      '{"client":{"ip":"' || CASE WHEN doc_id % 13 = 5 THEN 'not-an-ip' ELSE '203.0.113.' || CAST(doc_id % 250 AS STRING) END || '"},"dup":"192.0.2.' || CAST(doc_id % 200 AS STRING)
        || '","host":"host-' || CAST(doc_id % 50 AS STRING) || '","ip":"192.0.2.' || CAST(doc_id % 200 AS STRING) || '","n":' || CAST(doc_id AS STRING) || ',"org":"Org ' || lang
        || '","time":"2024-01-0' || CAST(1 + doc_id % 9 AS STRING) || 'T10:00:00Z","upn":"user' || CAST(doc_id AS STRING) || '@example.com"}' AS alert
    FROM [documents]"""


def _label(source: str, pointer: str, kind: str, status: str, alternatives: str = "''") -> str:
    return (f"SELECT 'r' || CAST(doc_id AS STRING) AS record_id, '{source}' AS source_target, {pointer} AS pointer, '{kind}' AS original_type, "
            f"{status} AS status, {alternatives} AS alternatives FROM [documents]")


VIEWS["draft_labels"] = "\n UNION ALL ".join((
    _label("occurredAt", "CASE WHEN doc_id % 11 = 3 THEN '/n' ELSE '/time' END", "string", "CASE WHEN doc_id % 11 = 3 THEN 'invalid-type' ELSE 'matched' END"),
    _label("sourceIp", "'/ip'", "string", "'matched'", "CASE WHEN doc_id % 2 = 0 THEN '/dup|/ip' WHEN doc_id % 17 = 1 THEN '/host' ELSE '' END"),
    _label("destinationIp", "NULL", "string", "'no-match'"),
    _label("clientIp", "'/client/ip'", "string", "'matched'"),
    _label("clientHostname", "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 41 = 6 THEN '/gone' ELSE '/host' END", "string", "CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'matched' END"),
    _label("customerOrOrganization", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '/org' END", "string", "CASE WHEN doc_id % 5 = 0 THEN 'ambiguous' ELSE 'matched' END"),
    _label("accountUpn", "'/upn'", "string", "'matched'"),
))

VIEWS["reviews"] = """
    SELECT 'r' || CAST(doc_id + CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 100000000 ELSE 0 END AS STRING) AS record_id, doc_id,
      CASE WHEN doc_id % 50 = 9 THEN 'someGate' WHEN doc_id % 3 = 0 THEN 'trainingOnly' ELSE 'releaseCandidate' END AS gate, 'approved' AS status,
      'independent-model' AS reviewer_kind, CASE WHEN doc_id % 43 = 2 THEN 'other-1' ELSE 'GPT-6-x' END AS reviewer_model,
      CASE WHEN doc_id % 47 = 5 THEN 'abc' ELSE repeat('0f', 32) END AS prompt_hash, doc_id % 3 <> 0 AS blind
    FROM [labels] WHERE quality = 1"""

# evaluation: one case per event, its expected pointer, and four runs of answers
VIEWS["expected"] = """
    SELECT event_id AS case_id, 'family' || CAST(user_id % 12 AS STRING) AS family,
      CASE WHEN user_id % 3 = 0 THEN 'evaluation' ELSE 'development' END AS split,
      CASE event_type WHEN 'click' THEN 'sourceIp' WHEN 'view' THEN 'clientIp' WHEN 'error' THEN 'customerName' WHEN 'signup' THEN 'occurred' ELSE 'clientHostname' END AS target,
      CASE WHEN event_id % 6 = 0 THEN 'absent' WHEN event_id % 31 = 4 THEN 'unlabelled' ELSE 'mapped' END AS state,
      CASE WHEN event_id % 6 <> 0 AND event_id % 31 <> 4 THEN '/documents/0/a' END AS preferred,
      CASE WHEN event_id % 6 <> 0 AND event_id % 31 <> 4 AND event_id % 2 = 1 THEN '/documents/0/b' END AS alternative,
      'v' || CAST(user_id AS STRING) AS expected_value
    FROM [events]"""


def _run(experiment: str, run: int, shift: int) -> str:
    kind = f"(event_id * 7 + user_id * 3 + {shift}) % 9"
    return f"""SELECT event_id AS case_id, '{experiment}' AS experiment, {run} AS run, CASE WHEN event_id = 0 THEN 'cold' ELSE 'warm' END AS runtime_state,
      CASE event_type WHEN 'click' THEN 'sourceIp' WHEN 'view' THEN 'clientIp' WHEN 'error' THEN 'customerName' WHEN 'signup' THEN 'occurred' ELSE 'clientHostname' END AS target,
      CASE WHEN {kind} < 4 THEN '/documents/0/a' WHEN {kind} < 6 THEN '/documents/0/b' WHEN {kind} = 6 THEN '/documents/0/c' END AS actual,
      CASE WHEN {kind} > 6 THEN 'no_supported_match' WHEN {kind} IN (3, 5) THEN 'tentative' ELSE 'selected' END AS status,
      CASE WHEN {kind} < 6 THEN 'v' || CAST(user_id AS STRING) WHEN {kind} = 6 THEN 'other' END AS value,
      {kind} IN (3, 5) AS disagreement, CASE WHEN {kind} > 6 THEN 'none' WHEN {kind} = 5 THEN 'disagreed' ELSE 'agreed' END AS value_agreement,
      event_id % 211 <> 17 AS complete, CAST(100 + event_id % 50 + {shift} AS BIGINT) AS total_ms, CAST(1000000 + user_id * 1000 AS BIGINT) AS peak_bytes,
      CAST(user_id % 9 AS BIGINT) AS eligible, CAST(user_id % 9 AS BIGINT) - CASE WHEN event_id % 97 = 3 THEN 1 ELSE 0 END AS assessed FROM [events]"""


VIEWS["runs"] = "\n UNION ALL ".join(
    _run(experiment, run, shift) for experiment, run, shift in (("baseline", 1, 0), ("baseline", 2, 0), ("grouped", 1, 2), ("grouped", 2, 2))
)

MACROS = {
    "spark": {"micros": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {0})"},
    "duckdb": {"micros": "epoch_us({0})"},
}

_NAME = re.compile(r"\[(" + "|".join((*BASE_TABLES, *VIEWS)) + r")\]")
_MACRO = re.compile(r"<([a-z_]+)\(([^()<>]*)\)>")


def expand(sql: str, engine: str) -> str:
    """Replace the engine macros."""
    return _MACRO.sub(lambda m: MACROS[engine][m.group(1)].format(m.group(2)), sql)


def view_text(name: str, engine: str) -> str:
    text = expand(VIEWS[name], engine)
    if engine == "spark":
        # the SQL reader of Spark unescapes backslashes inside string literals
        return text
    return text.replace("\\\\", "\\")


def needed(sql: str) -> list[str]:
    """Views a text uses, each after those it uses itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def oracle(sql: str) -> str:
    """A self-contained DuckDB statement: the used views become CTEs."""
    body = expand(sql, "duckdb")
    parts = [f"{name} AS ({_NAME.sub(r'\1', view_text(name, 'duckdb'))})" for name in needed(sql)]
    body = _NAME.sub(r"\1", body)
    if not parts:
        return body
    stripped = body.lstrip()
    lowered = stripped.lower()
    if lowered.startswith("with recursive"):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + stripped[len("with recursive"):]
    if lowered.startswith("with"):
        return "WITH " + ",\n".join(parts) + ",\n" + stripped[len("with"):]
    return "WITH " + ",\n".join(parts) + "\n" + stripped


class Tables:
    """The driver tables and derived views of one folder, opened lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    @cached_property
    def _prefix(self) -> str:
        return "evimap_" + hashlib.sha256(self.folder.encode()).hexdigest()[:10] + "_"

    def base(self, name: str) -> DataFrame:
        # one small file is one task: give it to all cores; a large table is left as it is
        return spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def sql(self, text: str) -> DataFrame:
        """Run a statement in which ``[name]`` names tables and views."""
        for name in set(_NAME.findall(text)):
            self._open(name)
        return self.spark.sql(_NAME.sub(lambda m: self._prefix + m.group(1), expand(text, "spark")))

    def _open(self, name: str) -> None:
        frame = self.base(name) if name in BASE_TABLES else self.sql(view_text(name, "spark"))
        frame.createOrReplaceTempView(self._prefix + name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if name in VIEWS:
            return self.sql(f"SELECT * FROM [{name}]")
        raise AttributeError(name)
