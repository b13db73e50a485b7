"""Tool calls in answer text, and redaction of what is logged."""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = "name string, args string, trailing_text string"
PREVIEW = 800


def strict_call(text: Column) -> Column:
    """struct<name, args> if the whole text is one tool-call object, else null."""
    t = F.regexp_replace(text, r"^\s+|\s+\z", "")
    get = lambda p: F.get_json_object(t, p)
    ok = (get("$.type") == "tool_call") & (F.trim(get("$.name")) != "") & get("$.args").startswith("{")
    return F.when(ok, F.struct(get("$.name").alias("name"), get("$.args").alias("args")))


def parse_call(text: str) -> tuple[str, dict, str] | None:
    """(name, args, trailing text) of a tool call that opens the text."""
    t = (text or "").strip()
    if not t.startswith("{"):
        return None
    try:
        found, end = json.JSONDecoder().raw_decode(t)
    except json.JSONDecodeError:
        return None
    name, args = found.get("name"), found.get("args")
    if found.get("type") != "tool_call" or not isinstance(name, str) or not name.strip() or not isinstance(args, dict):
        return None
    return name, args, t[end:].strip()


def _call_series(texts: pd.Series) -> pd.DataFrame:
    rows = [parse_call(t) for t in texts]
    return pd.DataFrame([(r[0], json.dumps(r[1], sort_keys=True, ensure_ascii=False), r[2]) if r else (None, None, None) for r in rows], columns=["name", "args", "trailing_text"])


def prefix_call(text: Column) -> Column:
    """struct<name, args, trailing_text> of a tool call that opens the text."""
    return F.pandas_udf(_call_series, CALL)(text)


def preview(text: Column, size: int = PREVIEW) -> Column:
    return F.substring(text, 1, size)
