"""Tables of the code graph, and the closed vocabularies of their text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


SYMBOLS = (
    "id bigint, name string, qualified_name string, kind string, sub_kind string, file_path string, line int, `column` int, end_line int, "
    "is_definition boolean, return_type string, parameters string, access string, attributes string, project_id string"
)
CALLS = "id bigint, caller_id bigint, callee_id bigint, file_path string, line int, `column` int, is_virtual boolean, is_indirect boolean"
INCLUDES = "id bigint, source_file string, target_file string, line int, is_system boolean, resolved_path string"
REFERENCES = "id bigint, symbol_id bigint, file_path string, line int, `column` int, ref_kind string"
INHERITANCE = "id bigint, derived_id bigint, base_id bigint, access string, is_virtual boolean"
FILES = "file_path string, last_modified bigint, content_hash string, parse_status string, error_message string, symbol_count bigint, parse_time_ms bigint"

#: Calls whose ends nothing has answered so far, by name.
UNRESOLVED = "file string, ordinal int, caller string, callee string, file_path string, line int, `column` int, is_virtual boolean, is_indirect boolean"

TABLES = {
    "symbols": SYMBOLS,
    "call_relations": CALLS,
    "include_relations": INCLUDES,
    "reference_relations": REFERENCES,
    "inheritance_relations": INHERITANCE,
    "file_info": FILES,
    "unresolved_calls": UNRESOLVED,
}
#: Columns that identify a row; later rows replace earlier ones on them.
KEYS = {
    "symbols": ("qualified_name", "file_path", "line"),
    "call_relations": ("id",),
    "include_relations": ("id",),
    "reference_relations": ("id",),
    "inheritance_relations": ("id",),
    "file_info": ("file_path",),
    "unresolved_calls": ("file", "ordinal"),
}

#: Vocabularies, and what an unknown value is read as.
KINDS = ("function", "variable", "type", "macro")
ACCESS = ("public", "protected", "private")
REF_KINDS = ("read", "write", "address", "call", "type")
STATUSES = ("success", "failed", "skipped")
DEFAULTS = {"kind": (KINDS, "function"), "access": (ACCESS, "public"), "ref_kind": (REF_KINDS, "read"), "parse_status": (STATUSES, "skipped")}

#: One file's extraction result, as a JSON document.
EXTRACTION = """
symbols array<struct<name:string,qualified_name:string,kind:string,sub_kind:string,file_path:string,line:int,`column`:int,end_line:int,
  is_definition:boolean,return_type:string,parameters:string,access:string,attributes:string>>,
calls array<struct<caller:string,callee:string,file:string,line:int,`column`:int,is_virtual:boolean,is_indirect:boolean>>,
includes array<struct<source_file:string,target_file:string,line:int,is_system:boolean,resolved_path:string>>,
inherits array<struct<derived:string,base:string,access:string,is_virtual:boolean>>,
references array<struct<symbol_name:string,file:string,line:int,`column`:int,ref_kind:string>>
"""
#: A long result may come in parts: rows of one file with a column `part`, from 0, each with so many rows of a kind at most.
PART_ROWS = 10_000
#: Fields that an extraction result must have; the others may be absent.
REQUIRED = {
    "symbols": ("name", "qualified_name", "kind", "file_path", "line", "column", "is_definition"),
    "calls": ("caller", "callee", "file", "line", "column", "is_virtual", "is_indirect"),
    "includes": ("source_file", "target_file", "line", "is_system"),
    "inherits": ("derived", "base", "access", "is_virtual"),
    "references": ("symbol_name", "file", "line", "column", "ref_kind"),
}


def struct_of(table: str) -> T.StructType:
    return _schema(TABLES[table])


def decoded(column: str) -> Column:
    """A vocabulary column read leniently: an unknown value is the default, null stays null."""
    known, default = DEFAULTS[column]
    value = F.col(column)
    return F.when(value.isNull(), F.lit(None)).when(value.isin(*known), value).otherwise(F.lit(default)).alias(column)
