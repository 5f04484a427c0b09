"""Configuration of repositories, an older manifest's way into it, and editor workspaces. All of these are files of the driver."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.vault import atomic_write
from .files import parse_manifest

MOST_BYTES, MOST_WORKSPACE_BYTES = 1 << 20, 2 << 20
REPOSITORIES = "repository_id string, path string, root string, enabled boolean, default_branch string"
DECISIONS = "source_key string, destination_key string, decision string, value string"


def _text(path: str, most: int) -> str:
    raw = Path(path).read_bytes()
    if len(raw) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    return raw.decode("utf-8")


def _checked(value: Any, root: Path) -> dict[str, Any]:
    """A configuration whose repositories have ids of their own, and whose state and vault lie in no repository."""
    if not isinstance(value, dict) or value.get("schema_version") != 3 or not isinstance(value.get("repositories"), list):
        raise ValueError("no configuration of schema version 3")
    seen: set[str] = set()
    places = [(root / (value.get(k) or default)).resolve() for k, default in (("state_path", ".knowledge"), ("vault_path", "vault"))]
    for r in value["repositories"]:
        if not isinstance(r, dict) or not isinstance(r.get("id"), str) or not isinstance(r.get("path"), str):
            raise ValueError("a repository needs an id and a path")
        if r["id"] in seen:
            raise ValueError(f"repository {r['id']} is there twice")
        seen.add(r["id"])
        own = (root / r["path"]).resolve()
        if any(p == own or p.is_relative_to(own) for p in places):
            raise ValueError(f"state or vault lie in repository {r['id']}")
    if places[0] == places[1]:
        raise ValueError("state and vault are one folder")
    return value


def read_config(spark: SparkSession, path: str) -> tuple[dict[str, Any], DataFrame]:
    """The configuration and its repositories as a table (REPOSITORIES)."""
    root = Path(path).resolve().parent
    value = _checked(parse_manifest("config.yaml", _text(path, MOST_BYTES)), root)
    rows = [(r["id"], r["path"], str((root / r["path"]).resolve()), bool(r.get("enabled", True)), r.get("default_branch")) for r in value["repositories"]]
    return value, spark.createDataFrame(rows, REPOSITORIES)


def write_config(path: str, value: dict[str, Any]) -> None:
    """Writes a configuration as a whole file or not at all. JSON is YAML too."""
    _checked(value, Path(path).resolve().parent)
    atomic_write(Path(path), json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def legacy_plan(spark: SparkSession, path: str) -> tuple[dict[str, Any], DataFrame, list[str]]:
    """An older manifest as (configuration, decisions, conflicts): what moves where. Addresses aren't carried over, only that there
    was one."""
    data = parse_manifest("legacy.yaml", _text(path, MOST_BYTES))
    repositories, rows, conflicts = [], [], []
    for i, item in enumerate((data or {}).get("repositories") or []):
        name, at, branch = (item.get(k) if isinstance(item.get(k), str) else None for k in ("name", "path", "branch"))
        own = {"id": name or f"repository-{i}", "path": at or "", "enabled": item.get("enabled") is True, "default_branch": branch}
        if not at:
            conflicts.append(f"repositories[{i}].path")
        repositories.append(own)
        for old, new in (("name", "id"), ("path", "path"), ("enabled", "enabled"), ("branch", "default_branch")):
            rows.append((f"repositories[{i}].{old}", f"repositories[{i}].{new}", "migrate", None if own[new] is None else str(own[new])))
        if "url" in item:
            rows.append((f"repositories[{i}].url", "migration_history.remote_url", "historical", "[redacted]"))
    config = {"schema_version": 3, "setup_status": "configuration_pending", "workspace_file": None, "vault_path": "./boveda", "repositories": repositories}
    return config, spark.createDataFrame(rows, DECISIONS), conflicts


def read_workspace(spark: SparkSession, path: str) -> DataFrame:
    """(name, path): the folders of an editor's workspace, absolute; comments and commas at the end are allowed in it."""
    value = parse_manifest("workspace.jsonc", _text(path, MOST_WORKSPACE_BYTES))
    folders = value.get("folders") if isinstance(value, dict) else None
    if not isinstance(folders, list) or not all(isinstance(f, dict) and isinstance(f.get("path"), str) and f["path"] for f in folders):
        raise ValueError("a workspace needs folders, and each folder a path")
    root = Path(path).resolve().parent
    return spark.createDataFrame([(f.get("name"), str((root / f["path"]).resolve())) for f in folders], "name string, path string")


def write_workspace(path: str, roots: dict[str, str], existing: dict[str, Any] | None = None) -> None:
    """A workspace of these folders; what else an existing one says stays."""
    value = {**(existing or {}), "folders": [{"name": n, "path": p} for n, p in roots.items()], "managed": {"schema_version": 3}}
    atomic_write(Path(path), json.dumps(value, ensure_ascii=False, indent=2) + "\n")
