"""Schemas of the index's tables. Every table is a Parquet folder; keys are repository-relative POSIX paths and dotted qualified names."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "files": "path string, language string, hash string, mtime double, size long, role string, parsed_at timestamp",
    "symbols": "file string, qualified_name string, name string, kind string, signature string, params string, returns string, description string, role string, line int, end_line int, language string, bases array<string>, body string, docstring string, seq int",
    "imports": "file string, source string, names array<string>, seq int",
    "refs": "src_file string, dst_file string, symbol string, count long",
    "changes": "run_id long, seq long, ts timestamp, file string, symbol string, change_type string, old_value string, new_value string, detail string",
    "raw_calls": "file string, src_qname string, callee_raw string, line int, seq int",
    "resolved": "file string, src_qname string, callee_raw string, line int, seq int, dst_qname string",
    "grams": "gram string, file string",
    "sizes": "file string, symbols long, length long",
    "call_edges": "src_qname string, dst_qname string, count long",
    "pages": "page_id string, file string, version string, granularity string, loaded_at timestamp, load_count long, index_version long",
    "working_set": "page_id string, session_id string, plan_id string, batch_id string, loaded_at timestamp, last_access_at timestamp, pinned boolean, tokens long, origin string",
}

#: The key by whose hash a table is cut into buckets; an update writes the buckets that it touches. Other tables are written whole.
BUCKETED = {"files": "path", "symbols": "file", "imports": "file", "raw_calls": "file", "resolved": "file", "refs": "src_file", "call_edges": "src_qname", "grams": "file", "sizes": "file"}
#: How a bucket's rows lie, where a search skips by it.
SORTED = {"grams": "gram"}

KINDS = ("function", "class", "method", "interface", "type_alias")
CHANGE_TYPES = ("added", "removed", "signature_changed", "signature_stable", "renamed")
ROLES = ("controller", "service", "model", "util", "test", "entry", "module", "component")


def migrated(df, name: str):
    """Rows of an older version of a table in today's form: keys that it lacks are those of the global scope, other columns are null."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    keys = ("session_id", "plan_id", "batch_id")
    fields = T._parse_datatype_string(TABLES[name]).fields
    column = lambda f: F.col(f.name) if f.name in df.columns else F.lit("" if f.name in keys else None)
    return df.select(*[column(f).cast(f.dataType).alias(f.name) for f in fields])
