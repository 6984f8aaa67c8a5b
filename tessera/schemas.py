"""Schemas of the fact tables. Every query filters project_id and revision first, so both are partition columns."""

from __future__ import annotations

FILES = "project_id string, revision long, path string, sha256 string, size long, language string"
BLOBS = "sha256 string, content string, size long"
SYMBOLS = (
    "path string, symbol_id string, name string, qualname string, kind string, scope string, start_line int, end_line int, "
    "column int, signature string, parameters array<string>, return_type string"
)
SCOPES = "path string, qualname string, kind string, parent string, globals array<string>, nonlocals array<string>"
BINDINGS = "path string, name string, scope string, kind string, line int, annotation string, value string"
IMPORTS = (
    "path string, module string, imported_name string, local_name string, line int, scope string, level int, "
    "type_only boolean, conditional boolean, is_static boolean"
)
REFERENCES = (
    "path string, name string, kind string, line int, scope string, source_qualname string, column int, type_only boolean, "
    "conditional boolean, arity int, execution_context string, execution_scope string"
)
RELATIONS = (
    "fact_order long, source_path string, kind string, name string, line int, column int, source_symbol_id string, "
    "source_qualname string, target_path string, target_symbol_id string, target_qualname string, target_module string, "
    "resolution string, evidence string, type_only boolean, conditional boolean, execution_context string, execution_scope string"
)
FLOW_EDGES = "path string, source string, target string, kind string, resolution string, line int, column int, basis string"

RELATION_KINDS = ("IMPORT", "REFERENCE", "CALL", "TYPE_REFERENCE", "INHERITANCE", "INSTANTIATION", "DECORATOR", "CONTAINS", "IMPLEMENTS")
CLASS_KINDS = ("class", "interface", "enum", "record", "annotation")
CALLABLE_KINDS = ("function", "method", "constructor")
