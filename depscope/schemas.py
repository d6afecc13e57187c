"""Row types shared by the operators."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype, null) for name, dtype, null in fields])


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

EDGE_COLUMNS = ["from", "to", "rel"]

EDGE = _struct(("from", _S, False), ("to", _S, False), ("rel", _S, False))
FILE = _struct(("path", _S, False), ("content", _S, True), ("length", _L, True), ("mtime", T.TimestampType(), True))
METADATA = _struct(("path", _S, False), ("key", _S, False), ("value", _S, True), ("version", _L, False))
MOUNT = _struct(
    ("kind", _S, False), ("ord", _I, False), ("at", _S, False), ("bucket", _S, True), ("prefix", _S, True),
    ("url", _S, True), ("path", _S, True), ("cache", _S, True), ("ttl", _L, True), ("writable", _B, True),
)
BLOB = _struct(("path", _S, False), ("hash", _S, False), ("backend", _S, False), ("uploaded_at", _L, False))
CACHE_ENTRY = _struct(
    ("s3_key", _S, False), ("etag", _S, True), ("content_type", _S, True),
    ("content_length", _L, False), ("cached_at", _L, False),
)
FILE_EVENT = _struct(("path", _S, False), ("event_type", _S, False), ("ts", T.TimestampType(), False))
RULE = _struct(("name", _S, False), ("description", _S, True), ("query", _S, False))
WALK = _struct(("root", _S, True), ("path", _S, True), ("relation", _S, True), ("depth", _I, True))
HOOK_RESULT = _struct(
    ("hook", _S, False), ("priority", _I, False), ("kind", _S, False), ("path", _S, True),
    ("target", _S, True), ("relation", _S, True), ("key", _S, True), ("value", _S, True), ("message", _S, True),
)
