"""Source catalogue: parse, check, select."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from ..config import ConfigError


@dataclass(frozen=True)
class Source:
    name: str
    root: str
    kind: str


def parse_sources(items) -> list[Source]:
    if not isinstance(items, list) or not items:
        raise ConfigError("sources must be a non-empty list")
    found = []
    for i, item in enumerate(items):
        fields = {k: str((item or {}).get(k) or "").strip() for k in ("name", "root", "kind")}
        if lacking := [k for k, v in fields.items() if not v]:
            raise ConfigError(f"sources[{i}] lacks {', '.join(lacking)}")
        found.append(Source(**fields))
    names = [s.name for s in found]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ConfigError(f"duplicate source names: {', '.join(twice)}")
    return found


def select_sources(sources: list[Source], names: list[str] | None) -> list[Source]:
    """In catalogue order; unknown names are an error."""
    if not names:
        return sources
    if unknown := sorted(set(names) - {s.name for s in sources}):
        raise ConfigError(f"unknown sources: {', '.join(unknown)}")
    return [s for s in sources if s.name in names]


def root_problem(source: Source, allowed: list[str] | None) -> str | None:
    """Why a source cannot be scanned, or None; what is in another file system
    is found out by its scan, and allowed if a root of ``allowed`` begins it."""
    if "://" in source.root and not source.root.startswith("file://"):
        inside = allowed is None or any(source.root.rstrip("/") == a.rstrip("/") or source.root.startswith(a.rstrip("/") + "/") for a in allowed)
        return None if inside and "/../" not in source.root + "/" else f"source '{source.name}' denied: {source.root} is outside the allowed roots"
    at = Path(source.root.removeprefix("file://")).expanduser().resolve()
    if not at.is_dir():
        return f"source '{source.name}' root does not exist or is not a directory: {at}"
    if allowed is not None and not root_allowed(str(at), allowed):
        return f"source '{source.name}' denied: {at} is outside the allowed roots"
    return None


def root_allowed(root: str, allowed: list[str]) -> bool:
    at = Path(root).resolve()
    return any(at.is_relative_to(Path(a).resolve()) for a in allowed)
