"""Tables, enumerations and fixed values of the code graph."""

from __future__ import annotations

DEFAULT_NAMESPACE = "default"

# Names that stored graphs and annotations already use.
NODE_KINDS = ("file", "package", "class", "function", "type", "test")
CALL_KINDS = ("calls", "fallback_calls")
EDGE_KINDS = ("calls", "fallback_calls", "imports_from", "inherits", "implements", "contains", "tested_by", "depends_on", "references")
CROSS_REF_KIND = "cross_ref"
TAG_KINDS = ("param", "return", "see", "intent", "domainRule", "sideEffect", "mutates", "requires", "ensures", "index", "throws", "typedef")
LINK_SCHEME = "ccg://"

#: Schemas as DDL: importing this module needs no session.
NODES = "node_id LONG, namespace STRING, kind STRING, name STRING, qualified_name STRING, file_path STRING, start_line INT, end_line INT, hash STRING, language STRING, updated_at TIMESTAMP"
EDGES = "edge_id LONG, namespace STRING, from_node_id LONG, to_node_id LONG, kind STRING, file_path STRING, line INT, fingerprint STRING"
ANNOTATIONS = "node_id LONG, summary STRING, context STRING, tags ARRAY<STRUCT<kind STRING, type STRING, name STRING, value STRING, ordinal INT>>, updated_at TIMESTAMP"
REASONS = "namespace STRING, node_id LONG, content STRING"
HUNKS = "file_path STRING, start_line INT, end_line INT"
CROSS_REFS = "from_namespace STRING, from_node_id LONG, raw STRING, to_namespace STRING, to_path STRING, to_symbol STRING, resolved_node_id LONG, status STRING"
PUSH_EVENT = "ref STRING, after STRING, deleted BOOLEAN, repository STRUCT<full_name: STRING, clone_url: STRING>"

#: Order of rows that are equal otherwise.
IDENTITY = ("file_path", "qualified_name", "kind", "namespace", "start_line")
#: Order of answers.
PLACE = ("file_path", "start_line", "qualified_name", "node_id")
