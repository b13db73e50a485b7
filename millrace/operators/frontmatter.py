"""Front-matter: split, extract, parse, typedness flags.

``split_body`` (for chunking) treats an unclosed block as body; ``read_block``
(for metadata) reports it as present and not closed.  Flags are nullable: null
is "unknown", not "no".
"""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # the key-value parser then decides
    yaml = None

RESULT = "yaml_present int, yaml_parse_ok int, yaml_error string, required_keys_present int, frontmatter_json string"
NOT_CLOSED, NOT_MAPPING, NOT_ALL = "frontmatter block is not closed", "frontmatter must be a mapping", "fallback frontmatter parser could not parse all lines"
REQUIRED = "uuid"


def _fences(text: str) -> tuple[list[str], int | None]:
    """Lines without a BOM and the number of the closing fence: None if the
    text does not open with one, -1 if it is not closed."""
    lines = text.removeprefix("﻿").splitlines(keepends=True)
    if not lines or lines[0].strip() != "---":
        return lines, None
    return lines, next((i for i, line in enumerate(lines) if i and line.strip() == "---"), -1)


def split_body(text: str) -> str:
    """The text behind a closed block, less one newline; else the text without BOM."""
    lines, end = _fences(text)
    if end is None or end < 0:
        return "".join(lines)
    body = "".join(lines[end + 1 :])
    return body[1:] if body.startswith("\n") else body


def read_block(text: str) -> tuple[int, str, str | None]:
    """(present, block, structural error)."""
    lines, end = _fences(text)
    if end is None:
        return 0, "", None
    return (1, "".join(lines[1:]), NOT_CLOSED) if end < 0 else (1, "".join(lines[1:end]), None)


def scalar(token: str):
    """null, true, false, quoted text, int, float, or the text itself."""
    t = token.strip()
    words = {"": None, "null": None, "~": None, "true": True, "false": False}
    if t.lower() in words:
        return words[t.lower()]
    if len(t) > 1 and t[0] == t[-1] and t[0] in "'\"":
        return t[1:-1]
    for kind in (int, float):
        try:
            if kind is float or t.removeprefix("-").isdigit():
                return kind(t)
        except ValueError:
            pass
    return t


def key_values(block: str) -> tuple[dict, int]:
    """Top-level ``key: value`` lines, and how many lines are something else."""
    found, other = {}, 0
    for line in block.splitlines():
        if not line.strip() or line.strip().startswith("#"):
            continue
        key, colon, value = line.partition(":")
        if line[0] in " \t" or not colon or not key.strip():
            other += 1
        else:
            found[key.strip()] = scalar(value)
    return found, other


def jsonable(value):
    """Keys as text; what JSON has no form for (dates) as text."""
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, list):
        return [jsonable(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def parse(text: str) -> tuple:
    """The fields of ``RESULT``."""
    present, block, error = read_block(text or "")
    if not present:
        return 0, None, None, None, "{}"
    dump = lambda d: json.dumps(d, sort_keys=True, ensure_ascii=False)
    loaded = None
    if error is None and yaml is not None:
        try:
            loaded = yaml.safe_load(block)
            loaded = {} if loaded is None else loaded
            if not isinstance(loaded, dict):
                return 1, 0, NOT_MAPPING, None, "{}"
            loaded = jsonable(loaded)
        except Exception as e:  # any YAML failure is data
            error, loaded = str(e), None
    if loaded is None:
        loaded, other = key_values(block)
        if error is None and other:
            error = NOT_ALL
        if error is not None:
            return 1, 0, error, None, dump(loaded)
    required = int(loaded.get(REQUIRED) is not None and bool(str(loaded[REQUIRED]).strip()))
    return 1, 1, None, required, dump(loaded)


def _parse_series(texts: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([parse(t) for t in texts], columns=[x.split()[0] for x in RESULT.split(", ")])
    return out.astype({n: "Int32" for n in ("yaml_present", "yaml_parse_ok", "required_keys_present")})


def parse_column(text: Column) -> Column:
    """struct of ``RESULT``; text without an opening fence never reaches Python."""
    plain = F.struct(F.lit(0).alias("yaml_present"), F.lit(None).cast("int").alias("yaml_parse_ok"), F.lit(None).cast("string").alias("yaml_error"), F.lit(None).cast("int").alias("required_keys_present"), F.lit("{}").alias("frontmatter_json"))
    return F.when(F.ltrim(F.regexp_replace(text, "^﻿", "")).startswith("---"), F.pandas_udf(_parse_series, RESULT)(text)).otherwise(plain)


def _body_series(texts: pd.Series) -> pd.Series:
    return texts.map(split_body, na_action="ignore")


def body_column(text: Column) -> Column:
    """``split_body`` of a column; text without an opening fence never reaches Python."""
    plain = F.regexp_replace(text, "^﻿", "")
    return F.when(F.ltrim(plain).startswith("---"), F.pandas_udf(_body_series, "string")(text)).otherwise(plain)
