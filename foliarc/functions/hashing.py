"""Canonical JSON, content hashes and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters whose \u escape contains a letter: to_json writes capitals, the
# canonical form is lower case.
_HEX_ESCAPES = ["0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"]


def canonical_json(value: Column) -> Column:
    """JSON of a struct whose fields are already in alphabetical order: no spaces, NULLs kept."""
    text = F.to_json(value, {"ignoreNullFields": "false"})
    fixed = text
    for code in _HEX_ESCAPES:
        fixed = F.regexp_replace(fixed, r"(?<!\\)((?:\\\\)*)\\u00" + code, r"$1\\u00" + code.lower())
    return F.when(text.rlike(r"\\u00[01][A-F]"), fixed).otherwise(text)


def canonical_hash(value: Column) -> Column:
    return F.sha2(canonical_json(value), 256)


def content_hash(text: Column) -> Column:
    """SHA-256 of the exact UTF-8 text."""
    return F.sha2(text, 256)


def chunk_id(document_id: Column, index_hash: Column, position: Column) -> Column:
    return F.sha2(F.concat_ws(":", document_id.cast("string"), index_hash, position.cast("string")), 256)
