"""Path policy: which file a request may read.

``resolve`` decides for one request against the file system; ``resolve_all``
decides for a table of requests against a table of files.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PathError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Policy:
    roots: tuple[str, ...]
    workspace: str = "."
    exts: tuple[str, ...] = (".md", ".txt", ".json")
    deny_absolute: bool = True
    deny_hidden: bool = True
    allow_any: bool = False


def configure(roots: list[str], workspace: str, within: str | None = None, create: bool = False, **rules) -> Policy:
    """Roots that exist, resolved; a root outside ``within``, or none left, raises."""
    found = []
    for r in roots:
        at = (Path(workspace) / r).resolve()
        if within and not at.is_relative_to(Path(within).resolve()):
            raise ValueError(f"root is outside the security root: {r}")
        if create:
            at.mkdir(parents=True, exist_ok=True)
        if at.is_dir() and str(at) not in found:
            found.append(str(at))
    if not found:
        raise ValueError("no valid roots")
    return Policy(tuple(found), str(Path(workspace).resolve()), **rules)


def _file(p: Path) -> str:
    if not p.exists():
        raise PathError("FILE_NOT_FOUND", f"no such file: {p}")
    if p.is_dir():
        raise PathError("PATH_IS_DIRECTORY", f"a directory: {p}")
    return str(p)


def resolve(request: str, policy: Policy) -> str:
    """The file's real path, or PathError.  A bare name is looked up in every
    root; a path is taken from the workspace."""
    if policy.allow_any:
        return _file(Path(os.path.abspath(os.path.expanduser(request))))
    if policy.deny_absolute and (os.path.isabs(os.path.expanduser(request)) or re.match(r"^([A-Za-z]:|\\\\|//)", request)):
        raise PathError("PATH_DENIED", f"absolute paths are denied: {request}")
    bare = "/" not in request and "\\" not in request
    matches, missing, escaped, inside = [], False, False, False
    for root in map(Path, policy.roots):
        at = Path(os.path.abspath((root if bare else Path(policy.workspace)) / request))
        if not at.is_relative_to(root):
            continue
        inside = True
        if policy.exts and at.suffix.lower() not in policy.exts:
            raise PathError("PATH_DENIED", f"extension {at.suffix or '<none>'} is denied")
        if policy.deny_hidden and any(p.startswith(".") for p in at.relative_to(root).parts):
            raise PathError("PATH_DENIED", "hidden paths are denied")
        if not at.exists():
            missing = True
        elif not (real := at.resolve()).is_relative_to(root):
            escaped = True
        else:
            matches.append(_file(real))
            if not bare:
                break
    found = sorted(set(matches))
    if len(found) == 1:
        return found[0]
    if found:
        raise PathError("AMBIGUOUS_PATH", f"several files are named {request}: {', '.join(found)}")
    if escaped:
        raise PathError("PATH_DENIED", "the path leads out of the roots")
    if missing or (bare and inside):
        raise PathError("FILE_NOT_FOUND", f"no such file in the roots: {request}")
    raise PathError("PATH_DENIED", f"outside the roots: {request}")


def resolve_all(requests: DataFrame, files: DataFrame, policy: Policy) -> DataFrame:
    """``requests`` (request) plus status and path; ``files``: root, rel_path.

    A request with a separator is ``root/rel_path``; the rules come in the
    order of ``resolve``: the first that applies decides.
    """
    r = F.col("request")
    bare = ~r.contains("/") & ~r.contains("\\")
    ext = F.lower(F.regexp_extract(r, r"[^/\\](\.[^./\\]+)$", 1))
    hidden = F.exists(F.split(r, r"[/\\]"), lambda p: p.startswith(".") & ~p.isin(".", ".."))
    up = F.exists(F.split(r, r"[/\\]"), lambda p: p == "..")
    files = files.select("root", "rel_path", F.concat("root", F.lit("/"), "rel_path").alias("full"))
    names = files.where(~F.col("rel_path").contains("/")).groupBy(F.col("rel_path").alias("request")).agg(F.count("*").alias("n"), F.min("full").alias("one"))
    direct = files.select(F.col("full").alias("request"), F.lit(1).cast("long").alias("n"), F.col("full").alias("one"))
    known = names.unionByName(direct.join(names, "request", "left_anti"))
    in_root = F.lit(False)
    for root in policy.roots:
        in_root = in_root | r.startswith(root + "/")
    status = (
        F.when(r.startswith("/") & F.lit(policy.deny_absolute) | r.rlike(r"^([A-Za-z]:|\\\\)"), "PATH_DENIED")
        .when(up | ~(bare | in_root), "PATH_DENIED")
        .when(~ext.isin(*policy.exts), "PATH_DENIED").when(hidden & F.lit(policy.deny_hidden), "PATH_DENIED")
        .when(F.col("n") > 1, "AMBIGUOUS_PATH").when(F.col("n") == 1, "OK").otherwise("FILE_NOT_FOUND")
    )
    rows = requests.join(known, "request", "left").withColumn("status", status)
    return rows.withColumn("path", F.when(F.col("status") == "OK", F.col("one"))).drop("n", "one")
