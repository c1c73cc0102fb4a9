"""Explicit schemas of the evidence model (version 1 of each)."""

from __future__ import annotations

PROVIDER = "struct<id:string,version:string,determinism:string>"
REPOSITORY = "struct<source:string,commitSha:string>"
ENTITY = "struct<id:string,kind:string>"
SOURCE = "struct<path:string,span:string>"
RANGE = "struct<startLine:bigint,startColumn:bigint,endLine:bigint,endColumn:bigint>"

#: One subject-predicate-object row with provenance; ``providerNative`` is JSON text.
OBSERVATION = f"schemaVersion int, subject {ENTITY}, predicate string, object struct<entity:{ENTITY},value:string>, provider {PROVIDER}, repository {REPOSITORY}, source {SOURCE}, determinism string, providerNative string"
#: As written in JSON artifacts, where the object is an entity or {"value": ...}.
OBSERVATION_JSON = f"schemaVersion int, subject {ENTITY}, predicate string, object struct<id:string,kind:string,value:string>, provider {PROVIDER}, repository {REPOSITORY}, source {SOURCE}, determinism string, providerNative string"
ENTITY_INPUT = f"provider {PROVIDER}, repository {REPOSITORY}, id string, kind string, path string, span string, range {RANGE}, rangeBase string, name string, qualifiedName string, signature string, aliases array<string>, providerNative string"
#: What the matrix works on: one row per normalized or unsupported fact. ``group_key``: repository, subject and predicate;
#: ``logical_key``: the same, where the fact can be compared; ``exact_key``: with its object.
DESCRIPTOR = f"repository {REPOSITORY}, provider {PROVIDER}, fact_class string, group_key string, logical_key string, exact_key string, status string, fact_id string, evidence_id string"

WIRING = "nodes array<struct<id:string,name:string,kind:string,path:string,span:string,signature:string,exported:boolean,origin:string>>, edges array<struct<source:string,target:string,relation:string,confidence:string>>, meta struct<version:string,nodeCount:bigint,edgeCount:bigint,languages:array<string>>"
SCIP = "documents array<struct<relative_path:string,occurrences:array<struct<range:array<bigint>,symbol:string,symbol_roles:bigint>>,symbols:array<struct<symbol:string,relationships:array<struct<symbol:string,is_implementation:boolean,is_type_definition:boolean>>>>>>"

# Fixed values of the evidence model.
PREDICATES = ("defines", "references", "calls", "imports", "exports", "extends", "implements", "type-of", "reads", "writes", "flows-to", "depends-on")
RULES = ("same-repository-revision", "same-path", "same-range", "same-kind", "same-qualified-name", "same-alias", "same-name", "same-signature")
RELATIONS = ("calls", "imports", "extends", "implements", "references")
STATUSES = ("matched", "probable", "ambiguous", "unmatched")
DETERMINISM = ("deterministic", "non-deterministic")
VERSION = "0.0.1"
