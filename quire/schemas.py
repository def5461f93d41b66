"""Schemas of the engine's tables: one row per source, unit, block, asset, warning, job or result."""

from __future__ import annotations

from pyspark.sql import types as T

LOCATION = "struct<source_path:string,page:int,spine_index:int,selector:string,confidence:double>"
UNITS = f"document_id string, pos int, unit_id string, title string, path string, source {LOCATION}, markdown string"
ASSETS = f"document_id string, asset_id string, path string, bytes binary, mime_type string, alt_text string, width double, height double, source {LOCATION}"
WARNINGS = f"document_id string, seq int, code string, message string, severity string, location {LOCATION}"
SOURCES = "path string, relative_path string, format string, document_name string, content binary, size long"
BLOCKS = "unit_id string, path array<int>, kind string, level int, ordered boolean, item_count int, rows int, columns int, language string, text string"
USAGE = "struct<no_cache:bigint,cache_read:bigint,output:bigint>"
RESULTS = f"unit_id string, unit_title string, unit_path string, status string, model string, duration_ms long, usage {USAGE}, cost_usd double, markdown string, translated_title string, error string, warnings array<string>"
CACHE = f"key string, unit_id string, markdown string, translated_title string, usage {USAGE}, cost_usd double, duration_ms long, model string"
SKELETON = "struct<blocks:array<struct<kind:string,level:int,ordered:boolean,item_count:int,rows:int,columns:int,language:string>>,links:array<string>,images:array<string>>"
MANIFEST = (
    "schemaVersion int, id string, title string, language string, direction string, source struct<format:string,path:string,size:double>, "
    "units array<struct<id:string,title:string,path:string,source:struct<sourcePath:string,page:int,spineIndex:int,selector:string,confidence:double>>>, "
    "assets array<struct<id:string,path:string,mimeType:string,altText:string,width:double,height:double>>, templates struct<base:string,styles:string>"
)
MANIFEST_VERSION = 1


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
