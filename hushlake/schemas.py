"""Schemas of the stored tables."""

USAGE = "struct<input bigint, output bigint, total bigint, cached bigint>"
ENTITY = "struct<type string, replacement string, confidence double, sources array<string>>"
AUDIT_ENTITY = (
    "struct<type string, replacement string, masked string, confidence double, sources array<string>>"
)
FIELD = f"struct<path string, original_masked string, redacted string, entities array<{AUDIT_ENTITY}>>"
RAW_REQUEST = "struct<method string, url string, headers map<string,array<string>>, body string>"
RAW_RESPONSE = "struct<status bigint, headers map<string,array<string>>, body string>"

REQUESTS = (
    "id string, timestamp timestamp, upstream_id string, profile_id string, operation_id string, "
    "model string, protection_mode string, gateway_type string, target_host string, method string, "
    "path string, status_code bigint, duration_ms bigint, streaming boolean, request_bytes bigint, "
    f"response_bytes bigint, entity_count bigint, token_usage {USAGE}, error_code string"
)
DETAIL = f"{REQUESTS}, fields array<{FIELD}>, raw_request {RAW_REQUEST}, raw_response {RAW_RESPONSE}"

CLIENT_LOG = (
    "timestamp string, kind string, message string, stack string, component_stack string, source string"
)
VAULT = "scope_id string, placeholder string, type string, value string"
