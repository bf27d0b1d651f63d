"""Closed vocabularies and table schemas of a code graph."""

from __future__ import annotations

SCHEMA_VERSION = 1
# The vocabularies that stored graphs use.
CONFIDENCES = ("resolved", "ambiguous", "inferred")
STRUCTURAL_KINDS = ("contains", "in_subsystem", "guides", "emits_finding")
ANCHORED_KINDS = ("calls", "references", "imports", "implements", "decorates", "inherits_from", "derives")
RELATION_KINDS = ("decorates", "derives", "implements", "inherits_from")
FINDING_KINDS = ("defect", "fact", "classification", "metric", "suggestion")
SEVERITIES = ("INFO", "WARN", "ERROR", "CRITICAL", "NONE")
FINDING_STATUSES = ("open", "acknowledged", "suppressed", "promoted_to_issue")
RUN_STATUSES = ("running", "skipped_no_plugins", "completed", "failed")
IDENTITY_STATUSES = ("alive", "orphaned", "superseded")
LINEAGE_EVENTS = ("born", "locator_changed", "moved", "orphaned", "superseded")
SCOPE_RANKS = {"project": 1, "subsystem": 2, "package": 3, "module": 4, "class": 5, "function": 6}
ROOT_TAGS = ("entry-point", "http-route", "test", "data-model", "cli-command", "exported-api", "public-surface", "allow-dead-code", "wardline:external_boundary", "wardline:trusted")
BARRIER_TAGS = ("dynamic-dispatch", "reflection")
EXCLUDED_TAGS = ("framework-handler", "plugin-hook")
NON_CODE_KINDS = ("file", "project", "subsystem", "guidance")
CONTAINER_KINDS = ("module", "impl")
RESERVED_KINDS = ("file", "subsystem", "guidance")


# Table schemas, as DDL that Spark readers take.
ENTITIES = "id string, plugin_id string, kind string, name string, short_name string, parent_id string, source_file_path string, source_line_start long, source_line_end long, content_hash string, properties string, summary string, signature string"
EDGES = "kind string, from_id string, to_id string, confidence string, properties string, source_file_id string, source_byte_start long, source_byte_end long"
TAGS = "entity_id string, plugin_id string, tag string"
SITES = "caller_entity_id string, caller_content_hash string, site_key string, site_ordinal long, callee_expr string, source_byte_start long"
FINDINGS = "id string, run_id string, rule_id string, kind string, severity string, status string, entity_id string, message string, confidence double, issue_id string, suppression_reason string, created_at string, updated_at string"
RUNS = "id string, started_at string, completed_at string, status string, analyzed_at_commit string, heartbeat_at string"
BINDINGS = "sei string, current_locator string, body_hash string, signature string, status string, born_run_id string"
LINEAGE = "seq long, sei string, event string, old_locator string, new_locator string, run_id string"
TAINT_FACTS = "entity_id string, sei string, fact_json string, updated_at string, ingest_seq long"
EMBEDDINGS = "entity_id string, content_hash string, model_id string, vec array<float>"
