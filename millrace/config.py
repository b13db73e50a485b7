"""Typed configuration: defaults, deep merge, coercion and validation."""

from __future__ import annotations

import copy
from dataclasses import dataclass
from pathlib import Path
from typing import Any

# Names and codes that results must carry as they are.
SCHEMES = ("obsidian_v1", "fixed_window_v1")
MEMORY_TYPES = ("preference", "project_state", "constraint", "workflow_rule", "user_fact")
MEMORY_SOURCES = ("manual", "derived_from_evidence")
HEADING_STRATEGIES = ("prefix", "exact", "ignore")
READ_FLOOR, READ_DEFAULT, READ_CAP = 200, 12_000, 200_000

# The settings and their defaults.
DEFAULTS: dict[str, Any] = {
    "model": "", "model_fast": None, "model_big": None, "prefer_fast": True,
    "big_triggers": ["deep", "long", "essay", "synthesize", "thorough", "in depth", "detailed", "analysis"],
    "max_chars_full_read": READ_CAP, "workroot": None, "base_url": "http://127.0.0.1:11434",
    "max_tokens": 800, "max_tokens_big_second": 4500, "temperature": 0.2, "timeout_s": 300, "timeout_s_big_second": 600,
    "security": {"allowed_roots": None, "allowed_exts": [".md", ".txt", ".json"], "deny_absolute_paths": True, "deny_hidden_paths": True, "allow_any_path": False, "auto_create_allowed_roots": False, "roots_must_be_within_security_root": True},
    "index": {"sources": [], "chunking": {"scheme": "obsidian_v1", "max_chars": 1200, "overlap": 120}},
    "embed": {"provider": "digest", "model_id": "digest-64", "preprocess": "obsidian_v1", "dim": 64, "batch_size": 64, "chunk_preprocess_sig": "", "query_preprocess_sig": ""},
    "retrieve": {"lexical_k": 20, "vector_k": 20, "vector_fetch_k": 0, "rel_path_prefix": "", "fusion": "simple_union"},
    "evidence": {"top_n": 8, "max_total_chars": 200_000, "max_excerpt_chars": 1200},
    "citations": {"enabled": True, "strict": False, "require_in_snapshot": True, "heading_match": "prefix", "normalize_heading": True},
    "memory": {"enabled": True}, "runs": {"log_evidence_excerpts": True},
}


class ConfigError(ValueError):
    """CONFIG_ERROR."""


def merge(base: dict, over: dict | None) -> dict:
    """Mappings merge by key at every depth; anything else, lists too, replaces."""
    out = dict(base)
    for k, v in (over or {}).items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def as_bool(value: Any, default: bool) -> bool:
    if isinstance(value, bool):
        return value
    word = value.strip().lower() if isinstance(value, str) else ""
    return True if word in ("true", "1", "yes", "on") else False if word in ("false", "0", "no", "off") else default


def as_int(value: Any, default: int) -> int:
    """A bool is no integer; text is read as one if it can be."""
    if isinstance(value, bool):
        return default
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


@dataclass(frozen=True)
class Chunking:
    scheme: str = "obsidian_v1"
    max_chars: int = 1200
    overlap: int = 120

    def __post_init__(self):
        if self.scheme not in SCHEMES:
            raise ConfigError(f"scheme must be one of: {', '.join(SCHEMES)}")
        check_window(self.max_chars, self.overlap)


def check_window(max_chars: int, overlap: int) -> None:
    if max_chars <= 0:
        raise ConfigError("max_chars must be > 0")
    if not 0 <= overlap < max_chars:
        raise ConfigError("overlap must be >= 0 and < max_chars")


def load(over: dict | None = None) -> dict:
    """Defaults merged with ``over`` and checked."""
    cfg = merge(copy.deepcopy(DEFAULTS), over)
    Chunking(**{k: cfg["index"]["chunking"][k] for k in ("scheme", "max_chars", "overlap")})
    if as_int(cfg["embed"]["batch_size"], 0) <= 0:
        raise ConfigError("embed.batch_size must be > 0")
    if cfg["retrieve"]["fusion"] != "simple_union":
        raise ConfigError("retrieve.fusion must be simple_union")
    if cfg["citations"]["heading_match"] not in HEADING_STRATEGIES:
        raise ConfigError(f"citations.heading_match must be one of: {', '.join(HEADING_STRATEGIES)}")
    return cfg


def resolve_root(config_file: str | None, cfg: dict, workroot: str | None = None, environment: str | None = None, cwd: str | None = None) -> str:
    """The folder that relative paths start from: the workroot named on the
    command line, else in the environment, else in the settings; without one
    the folder of the settings (its parent, if it is called ``configs``), else
    the current one.  A relative workroot starts from there as well."""
    base = Path(cwd or ".").resolve()
    if config_file:
        folder = Path(config_file).resolve().parent
        base = folder.parent if folder.name.lower() == "configs" else folder
    named = next((str(x).strip() for x in (workroot, environment, cfg.get("workroot")) if x and str(x).strip()), None)
    return str((base / Path(named).expanduser()).resolve()) if named else str(base)


def under(root: str, cfg: dict) -> dict:
    """``cfg`` with the relative roots of sources and of the allow-list put under ``root``."""
    place = lambda p: p if "://" in p else str((Path(root) / Path(p).expanduser()).resolve())
    sources = [x | {"root": place(str(x["root"]))} if isinstance(x, dict) and x.get("root") else x for x in cfg["index"]["sources"] or []]
    allowed = cfg["security"]["allowed_roots"]
    security = cfg["security"] | {"security_root": root, "allowed_roots": None if allowed is None else [place(a) for a in allowed]}
    return cfg | {"index": cfg["index"] | {"sources": sources}, "security": security}


def trigger_words(cfg: dict) -> list[str]:
    """An empty list is no triggers; without a list the defaults hold."""
    found = cfg.get("big_triggers")
    return [str(t).strip().lower() for t in (found if isinstance(found, list) else DEFAULTS["big_triggers"]) if str(t).strip()]


def select_models(cfg: dict, question: str, force_big: bool = False, force_fast: bool = False) -> tuple[str, str]:
    """(model of the first pass, model of the second) for a question."""
    name = lambda k: (cfg.get(k) or "").strip() or None if isinstance(cfg.get(k), str) else None
    base, fast, big = name("model") or DEFAULTS["model"], name("model_fast"), name("model_big")
    if force_fast:
        return (fast or base or big,) * 2
    order = (fast, big) if as_bool(cfg.get("prefer_fast"), True) else (big, fast)
    first = second = next((m for m in order if m), base)
    if as_bool(cfg.get("prefer_fast"), True) and big and any(t in question.lower() for t in trigger_words(cfg)):
        second = big
    if force_big:
        second = big or second
    return first, second
