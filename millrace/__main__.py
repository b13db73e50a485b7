"""python -m millrace --root DIR [--config FILE] index|query|index-search|rank|read|embed|ask|chat|prompt|memory|doctor|summary ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import config, models
from .engine import Engine, EngineError
from .session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("--root", required=True)
    p.add_argument("--config", help="settings, JSON or YAML")
    p.add_argument("--workroot", help="where relative roots start; else $MILLRACE_WORKROOT, the settings, their folder")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("index")
    s.add_argument("--source", action="append")
    s.add_argument("--rebuild", action="store_true")
    s = sub.add_parser("query")
    s.add_argument("text")
    s.add_argument("--limit", type=int, default=5)
    sub.add_parser("index-search")
    s = sub.add_parser("rank")
    s.add_argument("text")
    s.add_argument("--limit", type=int, default=20)
    s = sub.add_parser("read")
    s.add_argument("path")
    s.add_argument("--max-chars", type=int, default=12_000)
    s = sub.add_parser("embed")
    s.add_argument("--rebuild", action="store_true")
    s.add_argument("--limit", type=int)
    s.add_argument("--dry-run", action="store_true")
    s.add_argument("--no-prune", action="store_true")
    s = sub.add_parser("prompt")
    s.add_argument("question")
    s = sub.add_parser("ask")
    s.add_argument("question")
    speed = s.add_mutually_exclusive_group()
    speed.add_argument("--big", action="store_true")
    speed.add_argument("--fast", action="store_true")
    s = sub.add_parser("chat")
    s.add_argument("prompt")
    sub.add_parser("summary")
    s = sub.add_parser("memory")
    s.add_argument("action", choices=("add", "list", "delete", "export"))
    s.add_argument("--id")
    s.add_argument("--type", default="preference")
    s.add_argument("--content", default="")
    s.add_argument("--memory-source", default="manual")
    s.add_argument("--chunk-key", action="append", default=[])
    s = sub.add_parser("doctor")
    s.add_argument("--check-endpoint", action="store_true")
    s.add_argument("--require-embeddings", action="store_true")
    s.add_argument("--no-smoke", action="store_true", help="leave out the retrieval that must find a stored vector")
    return p


def model(engine: Engine, big: bool) -> models.HttpChat:
    c = engine.cfg
    return models.HttpChat(c["base_url"], max(c["timeout_s"], c["timeout_s_big_second"]) if big else c["timeout_s"], c["temperature"], c["max_tokens_big_second"] if big else c["max_tokens"])


def run(engine: Engine, args: argparse.Namespace, answer=None):
    """What a command prints: text, or data for JSON."""
    if args.command == "index":
        return engine.index(args.source, rebuild=args.rebuild)
    if args.command == "query":
        return engine.render(args.text, args.limit)
    if args.command == "index-search":
        return engine.index_search()
    if args.command == "rank":
        return [r.asDict() for r in engine.rank(args.text, args.limit).collect()]
    if args.command == "read":
        return engine.read(args.path, args.max_chars)
    if args.command == "embed":
        return engine.embed(args.rebuild, args.limit, args.dry_run, not args.no_prune)
    if args.command == "prompt":
        return engine.ground(args.question).prompt.first()["prompt"]
    if args.command == "ask":
        out = engine.ask(args.question, answer or model(engine, True), args.big, args.fast)
        if not out.ok:
            raise EngineError(out.error_code, f"Citation validation failed {out.footer}.")
        return f"{out.text}\n{out.footer}" if out.footer else out.text
    if args.command == "chat":
        return engine.chat(args.prompt, answer or model(engine, False))
    if args.command == "summary":
        return engine.evidence_summary().first().asDict()
    if args.command == "doctor":
        return [r.asDict() for r in engine.doctor(args.require_embeddings, not args.no_smoke, args.check_endpoint).collect()]
    if args.action == "add":
        return {"memory_id": engine.remember(args.type, args.content, args.memory_source, args.chunk_key)}
    if args.action == "delete":
        return {"deleted": engine.forget(args.id or "")}
    if args.action == "export":
        return engine.export_memories()
    return [r.asDict() for r in engine.memories().collect()]


def settings(path: str | None) -> dict:
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise EngineError("CONFIG_ERROR", f"{path}: the settings must be a mapping")
    return found


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        cfg = settings(args.config)
        workroot = config.resolve_root(args.config, cfg, args.workroot, os.environ.get("MILLRACE_WORKROOT"))
        out = run(Engine(session(args.master), args.root, cfg, workroot), args)
    except EngineError as e:
        print(json.dumps({"ok": False, "error_code": e.code, "error_message": str(e)}, ensure_ascii=False))
        return 1
    print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, indent=2))
    return int(args.command == "doctor" and any(r["status"] == "fail" for r in out))


if __name__ == "__main__":
    sys.exit(main())
