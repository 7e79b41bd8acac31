"""Table schemas and the error codes that violation rows carry."""

from __future__ import annotations

from pyspark.sql import types as T

CHANGE_LOG = T.StructType([
    T.StructField("chain_id", T.LongType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("filename", T.StringType()),
    T.StructField("previous_hash", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("body", T.StringType()),
])

APPLIED_LOG = T.StructType([
    T.StructField("target_id", T.LongType()),
    T.StructField("chain_id", T.LongType()),
    T.StructField("filename", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("previous_hash", T.StringType()),
    T.StructField("applied_at", T.TimestampType()),
])

TARGETS = T.StructType([
    T.StructField("target_id", T.LongType()),
    T.StructField("chain_id", T.LongType()),
])

CANDIDATES = T.StructType([
    T.StructField("chain_id", T.LongType()),
    T.StructField("body", T.StringType()),
])

SNIPPETS = T.StructType([
    T.StructField("chain_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("text", T.StringType()),
])

BINDINGS = T.StructType([
    T.StructField("chain_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
])

STAMPS = T.StructType([
    T.StructField("snapshot_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("modified_ms", T.LongType()),
    T.StructField("size", T.LongType()),
])

# One row per key that a change writes: the modelled row effect of a change body.
EFFECTS = T.StructType([
    T.StructField("chain_id", T.LongType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

STATE = T.StructType([
    T.StructField("target_id", T.LongType()),
    T.StructField("chain_id", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])

VIOLATIONS = T.StructType([
    T.StructField("chain_id", T.LongType()),
    T.StructField("target_id", T.LongType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("filename", T.StringType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("detail", T.StringType()),
])

# A six-digit file name can number this many changes.
MAX_VERSION = 999_999

# The message each error code stands for.
ERRORS = {
    "E01": "file name is not six digits and .sql",
    "E02": "file cannot be read",
    "E03": "header after a blank line",
    "E04": "header without a colon",
    "E05": "second Previous header",
    "E06": "previous hash is not 64 hex digits",
    "E07": "second Hash header",
    "E08": "hash is not 64 hex digits",
    "E09": "unknown header",
    "E10": "no headers",
    "E11": "body is empty",
    "E12": "no Hash header",
    "E13": "recorded hash differs from the computed one",
    "E14": "versions are not contiguous",
    "E15": "first change names a previous hash",
    "E16": "previous hash is not the hash of the change before",
    "E17": "filename occurs more than once",
    "E18": "hash occurs more than once",
    "E19": "filename or hash is missing",
    "E20": "more changes applied than committed",
    "E21": "applied history differs from the committed one",
    "E30": "candidate is empty",
    "E31": "candidate holds header lines",
    "E32": "include cycle",
    "E33": "fragment included twice",
    "E34": "included fragment does not exist",
    "E35": "include leaves the fragment folder",
    "E36": "placeholder has no binding",
    "E37": "sequence limit reached",
    "E38": "candidate kept in a folder",
    "E40": "nothing to uncommit",
    "E41": "last change is already applied",
    "E42": "candidate is not empty",
    "E43": "state differs from that of a clean rebuild",
    "E50": "applied log is missing and not managed",
    "E51": "rebuild not confirmed",
    "E60": "interpolation is not terminated",
    "E61": "interpolation has no name",
    "E62": "variable is not set and has no default",
    "E63": "not a valid identifier",
    "E64": "not a valid binding name",
    "E65": "name bound to different values",
}

# Order in which one file is checked; the lowest number is the one to report first.
CHECK_ORDER = {
    "E01": 1, "E02": 2,
    "E03": 3, "E04": 3, "E05": 3, "E06": 3, "E07": 3, "E08": 3, "E09": 3,
    "E10": 4, "E11": 5, "E12": 6,
    "E13": 7, "E14": 8, "E15": 9, "E16": 10, "E17": 11,
}
