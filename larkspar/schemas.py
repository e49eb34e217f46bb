"""Explicit schemas of the tables and interchange files. Nothing is inferred."""

from pyspark.sql import types as T

_s, _l, _i, _f = T.StringType(), T.LongType(), T.IntegerType(), T.FloatType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


PROJECTS = _struct(("id", _l, False), ("name", _s), ("root_path", _s, False), ("language", _s), ("last_indexed_at", T.TimestampType()))
CODE_UNITS = _struct(("qualified_name", _s, False), ("project_id", _l), ("file_path", _s), ("kind", _s), ("range_start", _i), ("range_end", _i), ("content_hash", _s), ("structure_hash", _s), ("embedding", T.ArrayType(_f)), ("group_id", _l))
SIMILAR_PAIRS = _struct(("id", _l, False), ("unit_a", _s, False), ("unit_b", _s, False), ("similarity", _f), ("status", _s), ("trigger_reason", _s))
GROUPS = _struct(("id", _l, False), ("project_id", _l), ("name", _s), ("reason", _s), ("pattern", _s))
TABLES = {"projects": PROJECTS, "code_units": CODE_UNITS, "similar_pairs": SIMILAR_PAIRS, "similarity_groups": GROUPS}

#: A function as it is extracted from source, before hashing and embedding.
RAW_UNIT = _struct(("qualified_name", _s), ("file_path", _s), ("kind", _s), ("range_start", _i), ("range_end", _i), ("body", _s), ("selection_line", _i), ("selection_column", _i))
#: Symbol dump: a file's symbol tree, flattened; parent_id is null at the top, ord is the preorder place.
SYMBOLS = _struct(("file_path", _s), ("symbol_id", _i), ("parent_id", _i), ("ord", _i), ("name", _s), ("kind", _s), ("start_line", _i), ("end_line", _i), ("selection_line", _i), ("selection_column", _i))
#: Call dump: one edge for each reported call, in the order reported.
CALLS = _struct(("src_file", _s), ("src_line", _i), ("dst_file", _s), ("dst_line", _i), ("dst_name", _s), ("ord", _i))
NODES = _struct(("file_path", _s), ("line", _i), ("name", _s))
HOOK_EVENT = _struct(("hook_event_name", _s), ("tool_name", _s), ("tool_input", _struct(("file_path", _s), ("content", _s))), ("cwd", _s))
MATCH = _struct(("current_name", _s), ("current_file", _s), ("current_line", _i), ("similar_name", _s), ("similar_file", _s), ("similar_line", _i), ("similarity", _f), ("is_cross_project", T.BooleanType()))

PAIR_STATUSES = ("new", "confirmed", "redundant", "ignored")


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
