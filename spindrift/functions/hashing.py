"""Content hashes over canonical JSON."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def content_hash(value) -> str:
    """sha256 of JSON with sorted keys, no spaces, ASCII only."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str).encode()).hexdigest()


def stable_hash(value) -> str:
    """sha256 of JSON with sorted keys and the default separators."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def _hash_udf(fn):
    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                return fn(json.loads(t))
            except (TypeError, ValueError):
                return None

        return text.map(one)

    return run


content_hash_udf = _hash_udf(content_hash)
stable_hash_udf = _hash_udf(stable_hash)


def combined_hash(names_and_digests) -> Column:
    """sha256 over each file's base name and raw digest, of an array of struct(path, sha256) ordered by path."""
    ordered = F.array_sort(names_and_digests)
    parts = F.transform(ordered, lambda f: F.concat(F.hex(F.encode(F.element_at(F.split(f["path"], "/"), -1), "UTF-8")), f["sha256"]))
    return F.sha2(F.unhex(F.array_join(parts, "")), 256)
