"""Content hashes and stable ids, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical_json(value: Column) -> Column:
    """JSON text with object keys sorted, so that equal values have equal text."""
    return F.to_json(F.parse_json(value))


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def content_hash(value_json: Column) -> Column:
    return sha256(canonical_json(value_json))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 24 digits of the hash of the parts, as a JSON array."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(sha256(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))), 1, 24))


def field(value_json: str | Column, *names: str) -> Column:
    """The first of the fields that a JSON value has, as text."""
    return F.coalesce(*(F.get_json_object(value_json, f"$.{n}") for n in names))
