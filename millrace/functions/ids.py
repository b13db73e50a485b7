"""Content-derived identities: SHA-256 over UTF-8, cut to 32 hex digits."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Fixed values that enter signatures.
CHUNKER_IMPL = "phase2_chunking_v1"
PREPROCESS = "obsidian_v1"
STEPS = "normalize_newlines=\\n;strip_trailing_whitespace_per_line=true;utf8_replace=true"
CHUNK_FRAMING, QUERY_FRAMING = "prefix=rel_path+heading_path", "prefix=none"


def sha256(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def short(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def chunk_key(rel_path, scheme, heading_path, section_ordinal, chunk_ordinal, chunk_sha) -> Column:
    parts = [col(rel_path), col(scheme), F.coalesce(col(heading_path), F.lit("")), col(section_ordinal).cast("string"), col(chunk_ordinal).cast("string"), col(chunk_sha)]
    return short(F.concat_ws("|", *parts))


def embed_sig(key, chunk_sha, model_id, dim, preprocess_sig) -> Column:
    as_col = lambda v: F.lit(str(v)) if isinstance(v, (int, str)) and not isinstance(v, Column) else v.cast("string")
    return short(F.concat_ws("|", col(key), col(chunk_sha), as_col(model_id), as_col(dim), as_col(preprocess_sig)))


def _short(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:32]


def chunker_sig(scheme: str, max_chars: int, overlap: int) -> str:
    return _short(json.dumps({"chunker_impl": CHUNKER_IMPL, "max_chars": max_chars, "overlap": overlap, "scheme": scheme}, separators=(",", ":")))


def preprocess_sig(framing: str, name: str = PREPROCESS) -> str:
    if name != PREPROCESS:
        raise ValueError(f"unknown preprocessing: {name}")
    return _short(f"name={name}\nsteps={STEPS};{framing}\n")


def runtime_fingerprint(**params) -> str:
    """Of a provider's parameters, independent of their order."""
    return _short(json.dumps(params, sort_keys=True, separators=(",", ":"), default=str))


def model_files_fingerprint(root: str, whole_below: int = 32 << 20) -> str:
    """Of a model folder: names, sizes and contents (head, tail and size of large files)."""
    digest = hashlib.sha256()
    for p in sorted(x for x in Path(root).rglob("*") if x.is_file()):
        size = p.stat().st_size
        digest.update(f"{p.relative_to(root).as_posix()}|{size}|".encode())
        with p.open("rb") as f:
            if size <= whole_below:
                digest.update(f.read())
            else:
                digest.update(f.read(1 << 20))
                f.seek(-(1 << 20), 2)
                digest.update(f.read())
    return digest.hexdigest()[:32]
