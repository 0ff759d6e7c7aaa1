"""Record types as DDL; results are never read with inferred schemas, since absent optional keys would vanish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

RESPONSES = """host STRING, vantage STRING, kind STRING, path STRING, seq INT, url STRING, final_url STRING, status INT,
headers MAP<STRING,STRING>, content_type STRING, body BINARY, bytes BIGINT, sha256 STRING, redirects INT,
cross_origin_hit BOOLEAN, www_redirect BOOLEAN, error STRING, elapsed_ms BIGINT"""

PROBE = """path: STRING, artifact: STRING, status: INT, final_url: STRING, content_type: STRING, bytes: BIGINT, sha256: STRING,
redirects: INT, cross_origin_hit: BOOLEAN, www_redirect: BOOLEAN, elapsed_ms: BIGINT, error: STRING, simhash: STRING,
nx_similarity: DOUBLE, soft404: BOOLEAN, card_spec: STRING, hsts: STRING, cache_control: STRING, body_file: STRING,
valid: BOOLEAN, reasons: ARRAY<STRING>"""

HYGIENE = """source: STRING, kind: STRING, card_spec: STRING,
endpoint: STRUCT<url: STRING, https: BOOLEAN, status: INT, error: STRING, reachable: BOOLEAN>,
endpoint_third_party_hosted: BOOLEAN,
prm_lookups: ARRAY<STRUCT<url: STRING, location: STRING, status: INT, valid: BOOLEAN, error: STRING>>,
authorization_servers: ARRAY<STRUCT<issuer: STRING, https: BOOLEAN, metadata_url: STRING, status: INT, error: STRING,
resolves: BOOLEAN, issuer_match: BOOLEAN, pkce_advertised: BOOLEAN, third_party_hosted: BOOLEAN>>,
has_authorization_servers: BOOLEAN, bearer_query_allowed: BOOLEAN, hsts: STRING, cache_control: STRING, notes: ARRAY<STRING>"""

HOST_RESULTS = f"""host STRING, rank INT, registrable_domain STRING, vantage STRING, ts STRING, crawler_version STRING,
blocked STRUCT<blocked: BOOLEAN, reason: STRING, counts: MAP<STRING,BIGINT>>, redirect_only BOOLEAN,
fingerprint STRUCT<homepage_status: INT, homepage_final_url: STRING, homepage_error: STRING, server: STRING,
powered_by: STRING, generator: STRING, platforms: ARRAY<STRING>, primary: STRING, cdn: STRING, hints: ARRAY<STRING>,
signals: ARRAY<STRING>>,
nx_baselines ARRAY<STRUCT<path: STRING, status: INT, sha256: STRING, simhash: STRING, content_type: STRING, bytes: BIGINT, error: STRING>>,
mcp_card_path STRING, probe_order ARRAY<STRING>, probes ARRAY<STRUCT<{PROBE}>>, hygiene ARRAY<STRUCT<{HYGIENE}>>, duration_ms BIGINT"""

HANDSHAKE = """host STRING, rank INT, source STRING, card_path STRING, endpoint STRING, ts STRING, status INT, error STRING,
final_url STRING, content_type STRING, elapsed_ms BIGINT,
www_authenticate STRUCT<raw: STRING, scheme: STRING, realm: STRING, resource_metadata: STRING, error: STRING, error_description: STRING, scope: STRING>,
mcp_session_id_present BOOLEAN, body_kind STRING, jsonrpc BOOLEAN,
result STRUCT<protocol_version: STRING, server_info: STRUCT<name: STRING, version: STRING>, capabilities_keys: ARRAY<STRING>, instructions_present: BOOLEAN>,
jsonrpc_error STRUCT<code: BIGINT, message: STRING, data_keys: ARRAY<STRING>>, classification STRING"""

LABELS_CACHE = """host STRING, rank INT, fetched_at STRING, status STRING, radar_rank INT, bucket STRING,
categories ARRAY<STRUCT<id: INT, name: STRING, superCategoryId: INT>>, source STRING, error STRING"""

MANIFEST = "domain STRING, linked BOOLEAN, canary BOOLEAN, cell_label STRING, tokens MAP<STRING,STRING>"
TRIALS = "agent STRING, domain STRING, task_id STRING, start_ms BIGINT, end_ms BIGINT, answer STRING, model STRING, reported_urls ARRAY<STRING>, error STRING"
HITS = "host STRING, ts BIGINT, path STRING, ua STRING, status INT"

# The canonical paths, their kinds of document, in canonical order.
PROBE_SPECS = [
    (0, "/llms.txt", "llms_txt", "markdown", False),
    (1, "/llms-full.txt", "llms_full_txt", "markdown", False),
    (2, "/.well-known/mcp-server-card", "mcp_server_card", "json", False),
    (3, "/.well-known/mcp/server-card.json", "mcp_server_card_legacy", "json", True),
    (4, "/.well-known/oauth-protected-resource", "oauth_protected_resource", "json", False),
    (5, "/.well-known/oauth-authorization-server", "oauth_authorization_server", "json", False),
    (6, "/.well-known/agent-card.json", "a2a_agent_card", "json", False),
    (7, "/.well-known/agent.json", "a2a_agent_json", "json", False),
    (8, "/.well-known/openid-configuration", "openid_configuration", "json", False),
    (9, "/openapi.json", "openapi_json", "openapi", False),
    (10, "/openapi.yaml", "openapi_yaml", "openapi", False),
    (11, "/.well-known/ai-catalog.json", "ai_catalog", "json", False),
    (12, "/.well-known/security.txt", "security_txt", "text", False),
    (13, "/ai.txt", "ai_txt", "text", False),
]
MCP_CARDS = ("mcp_server_card", "mcp_server_card_legacy")
A2A_CARDS = ("a2a_agent_card", "a2a_agent_json")
CARDS = MCP_CARDS + A2A_CARDS
OPENAPI = ("openapi_json", "openapi_yaml")
OAUTH = ("oauth_protected_resource", "oauth_authorization_server", "openid_configuration")
SECURITY_PATH = "/.well-known/security.txt"
ARTIFACT_PATHS = {
    "llms": ("/llms.txt", "/llms-full.txt"),
    "card": ("/.well-known/mcp-server-card", "/.well-known/mcp/server-card.json"),
    "openapi": ("/openapi.json", "/openapi.yaml"),
    "a2a": ("/.well-known/agent-card.json", "/.well-known/agent.json"),
}


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def probe_specs(spark: SparkSession) -> DataFrame:
    """The canonical paths as a table of 14 rows."""
    return spark.createDataFrame(PROBE_SPECS, "pos INT, path STRING, artifact STRING, kind STRING, legacy BOOLEAN")
