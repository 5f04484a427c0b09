"""Row shapes of the engine's tables."""

FACTS = "id string, kind string, component_id string, value_json string, evidence_ids array<string>, rule_id string"
LOCATOR = "struct<kind:string,start:bigint,end:bigint,key:string>"
EVIDENCE = f"id string, repository_id string, snapshot_id string, relative_path string, source_hash string, locator {LOCATOR}, rule_id string"
SNAPSHOTS = "id string, repository_id string, requested_ref string, resolved_ref string, commit_oid string, capture_mode string, content_hash string, dirty boolean, captured_at timestamp"
ENTRIES = "repository_id string, relative_path string, object_id string, size bigint, mode string, kind string"
FILES = "repository_id string, relative_path string, content binary, size bigint, mode string, kind string"
NODES = "id string, type string, label string, environment string, fact_ids array<string>"
EDGES = "id string, `from` string, `to` string, type string, environment string, scenario_id string, status string, fact_ids array<string>, evidence_ids array<string>, rule_id string, limitations array<string>"
DIAGNOSTICS = "id string, severity string, code string, scope string, message string, evidence_ids array<string>, suggested_action string"
CHUNKS = (
    "id string, run_id string, repository_id string, ref string, commit string, document_path string, document_type string, section_type string, heading string, "
    "endpoint struct<method:string,path:string>, symbols array<string>, source_paths array<string>, layers array<string>, roles array<string>, evidence_ids array<string>, "
    "confidence_states array<string>, outgoing_links array<string>, content string, sha256 string"
)
LINKS = "`from` string, `to` string, type string, status string, fact_ids array<string>, evidence_ids array<string>"
