"""Identities: canonical JSON hashes, frozen files, atomic writes, schema pins."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bounded import json_of


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def verify_frozen(values: Mapping[str, Any], pinned: Mapping[str, str]) -> list[str]:
    """Names whose content no longer has the pinned hash, or that are missing."""
    return sorted(k for k, h in pinned.items() if k not in values or canonical_hash(values[k]) != h)


def write_atomic(path: str, value: Any) -> None:
    """Write JSON beside the target and rename it, so that readers see the old or the new file."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, suffix=".part") as out:
        out.write(canonical_json(value))
    os.replace(out.name, path)


class Cache:
    """Content-addressed JSON results; an entry is fresh if its versions are those asked for."""

    def __init__(self, folder: str, versions: Mapping[str, str]):
        self.folder, self.versions = folder, dict(versions)

    def path(self, key: Any) -> str:
        return os.path.join(self.folder, canonical_hash(key) + ".json")

    def read(self, key: Any) -> Any | None:
        if not os.path.exists(self.path(key)):
            return None
        with open(self.path(key)) as f:
            entry = json.load(f)
        return entry["value"] if entry["versions"] == self.versions else None

    def write(self, key: Any, value: Any) -> None:
        write_atomic(self.path(key), {"value": value, "versions": self.versions})


def object_hash(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of an object of columns: names sorted, no blanks."""
    parts = [F.concat(F.lit(json.dumps(name) + ":"), json_of(fields[name])) for name in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)
