"""JSON verdicts: fences, strict parsing, normalisation."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import constants as K
from auditloom.functions.ecmascript import WHITE, trim

VERDICT = "status string, message string, suggestion string, issues array<struct<line:double,severity:string,message:string,suggestion:string>>"
_BRACES = re.compile(r"\{[\s\S]*\}")


def strip_fences(text: Column) -> Column:
    """Without code fences, trimmed."""
    text = F.regexp_replace(text, rf"(?i)```json[{WHITE}]*", "")
    return trim(F.regexp_replace(text, rf"```[{WHITE}]*", ""))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _loads(text: str) -> object:
    """Strict JSON; of repeated keys the last wins. A lone null is a failure, as nothing can be read from it."""
    value = json.loads(text, parse_constant=_no_constant)
    if value is None:
        raise ValueError("null")
    return value


def _error(message: str) -> dict:
    return {"status": "ERROR", "message": message, "suggestion": None, "issues": []}


def normalise(value: object) -> dict:
    if not isinstance(value, dict) or value.get("status") not in K.STATUSES:
        return _error(K.BAD_FORMAT)
    issues = []
    for x in value["issues"] if isinstance(value.get("issues"), list) else ():
        if not isinstance(x, dict) or not isinstance(x.get("message"), str):
            continue
        line = x.get("line")
        fine = isinstance(line, int | float) and not isinstance(line, bool) and line > 0 and math.isfinite(line)
        suggestion = x.get("suggestion")
        issues.append({"line": float(line) if fine else 1.0, "severity": x["severity"] if x.get("severity") in K.SEVERITIES else "WARNING", "message": x["message"], "suggestion": suggestion if isinstance(suggestion, str) and suggestion else None})
    text = lambda k: value[k] if isinstance(value.get(k), str) else None
    return {"status": value["status"], "message": text("message"), "suggestion": text("suggestion"), "issues": issues}


def parse(text: str | None) -> dict:
    """The verdict in a text without fences: the whole of it, else what its first and last braces hold."""
    text = text or ""
    for candidate in (text, (m := _BRACES.search(text)) and m.group()):
        if candidate is not None:
            try:
                return normalise(_loads(candidate))
            except (ValueError, RecursionError):
                continue
    return _error(K.PARSE_FAILED)


def _parse(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t) for t in texts], columns=["status", "message", "suggestion", "issues"])


def parse_verdicts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct ``verdict``. Strict JSON isn't what the built-in readers do, so this is an Arrow UDF."""
    udf = F.pandas_udf(VERDICT)(_parse)
    return df.withColumn("verdict", udf(strip_fences(F.coalesce(F.col(text), F.lit("")))))
