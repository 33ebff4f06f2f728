"""Digests of documents that don't depend on the order of keys or on fields that only say when something was fetched.

A JSON document has any depth, which expressions over columns can't walk; a small Python function does it for Arrow batches.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each kind of digest leaves out: keys of `provenance`, keys at any depth, and lists that are put in order of `mbid`.
KINDS = {
    "bundle": (("cache_age",), (), ("recordings", "release_groups")),
    "resolver": (("fetched_at_utc", "cache_age_s"), (), ()),
    "drift": ((), ("fetched_at", "fetched_at_utc", "created_at", "updated_at"), ()),
}


def without(value, keys: tuple[str, ...]):
    """A JSON value without these keys at any depth."""
    if isinstance(value, dict):
        return {k: without(v, keys) for k, v in value.items() if k not in keys}
    return [without(v, keys) for v in value] if isinstance(value, list) else value


def canonical_text(text: str | None, kind: str) -> str | None:
    """The document with sorted keys and no white space, other than ASCII characters escaped; null for null and for what isn't JSON."""
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if value is None:
        return None
    provenance, anywhere, ordered = KINDS[kind]
    if isinstance(value, dict):
        if isinstance(value.get("provenance"), dict):
            value = value | {"provenance": {k: v for k, v in value["provenance"].items() if k not in provenance}}
        by_id = lambda x: str(x.get("mbid", "")) if isinstance(x, dict) else ""
        value = {k: sorted(v, key=by_id) if k in ordered and isinstance(v, list) else v for k, v in value.items()}
    return json.dumps(without(value, anywhere), sort_keys=True, separators=(",", ":"))


def canonical_hash(document: Column | str, kind: str) -> Column:
    """SHA-256 of the canonical form of JSON text; kind is one of KINDS."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")

    def digests(texts: pd.Series) -> pd.Series:
        made = (canonical_text(t, kind) for t in texts)
        return pd.Series([None if m is None else hashlib.sha256(m.encode()).hexdigest() for m in made], dtype="object")

    return F.pandas_udf(digests, "string")(document)
