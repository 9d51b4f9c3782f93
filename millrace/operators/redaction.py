"""Secrets and machine paths in source text: masking that keeps files parseable, and the scan that gates publication."""

from __future__ import annotations

import re
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of secrets, key blocks, path prefixes, and the masks put in their place.
_ASSIGNED = re.compile(r"""(?ix) (?<![a-z0-9]) (?P<name>api[_-]?key|token|secret|password|passwd|pwd) (?P<sep>["']?[ \t]*[:=][ \t]*)
    (?: (?P<quote>["']) (?P<text>[^"'\s]{6,}) (?P=quote) | (?P<bare>[a-z0-9_\-]+) (?![\w\-.\[(]) )""")
_SK = re.compile(r"sk-[A-Za-z0-9]{10,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*?-----END [A-Z ]*PRIVATE KEY-----")
_HOME = re.compile(r"/home/[\w.-]+|/Users/[\w.-]+|[A-Za-z]:[\\/]+Users[\\/]+[\w.-]+", re.A)
_DRIVE = re.compile(r"(?:/mnt/[a-z]/|[A-Za-z]:[\\/]+)(?![\\/])")
_MASK, _KEY_MASK, _SK_MASK, _ROOT = "***", "***PRIVATE_KEY***", "sk-***", "/workspace"
# Forms of credentials by rule.
SCAN_RULES = {
    "openai_key": r"sk-(?:ant-)?[A-Za-z0-9_-]{10,}",
    "aws_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "github_token": r"\bgithub_pat_[A-Za-z0-9_]{20,}|\bgh[pousr]_[A-Za-z0-9]{20,}",
    "gitlab_token": r"\bglpat-[A-Za-z0-9_-]{16,}",
    "slack_token": r"\bxox[abpres]-[A-Za-z0-9-]{10,}",
    "google_key": r"\bAIza[0-9A-Za-z_-]{30,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{5,}",
    "database_url": r"\b[a-z][a-z0-9+]*://[^\s:/@]+:[^\s:/@]{3,}@",
    "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{16,}",
}
#: Paths of a document that the scan leaves out, in full.
UNSCANNED = ("grader.key_lines", "metadata.validity_issues")


def parses(text: str, path: str | None) -> bool | None:
    """Whether Python accepts the text; null for other files and for text that gives no verdict."""
    if not (path or "").lower().endswith((".py", ".pyi")):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "case", "exec", dont_inherit=True)
    except SyntaxError:
        return False
    except (ValueError, RecursionError, MemoryError):
        return None
    return True


def bare_secret(value: str) -> bool:
    """Whether an unquoted value is more likely a secret than code: a digit and six characters, or sixteen; no number, no plain name."""
    if value.isdigit() or not re.search(r"\d", value) and value.isidentifier():
        return False
    return len(value) >= (6 if re.search(r"\d", value) else 16)


def _mask_assignments(text: str, wide: bool) -> str:
    def one(m: re.Match) -> str:
        if m["quote"]:
            return m["name"] + m["sep"] + m["quote"] + _MASK + m["quote"]
        masked = len(m["bare"]) >= 3 if wide else bare_secret(m["bare"])
        return m["name"] + m["sep"] + _MASK if masked else m[0]

    return _SK.sub(_SK_MASK, _ASSIGNED.sub(one, text))


def mask_secrets(text: str, wide: bool = False) -> str:
    """Secret assignments, `sk-` keys and private-key blocks masked; quotes stay. ``wide`` takes any bare value of three characters."""
    return _PEM.sub(_KEY_MASK, _mask_assignments(text, wide))


def mask_source(text: str, path: str | None) -> str:
    """``mask_secrets`` of a file that still parses if it parsed before.

    Where masking a whole file breaks it, each line is masked by itself if the file survives that; a key block that cannot go
    without breaking the file stays, and the scan reports it. Only files with a parser get the wide rule.
    """
    sound = parses(text, path) is True
    out = _mask_assignments(text, sound)
    if sound and parses(out, path) is False:
        lines = text.splitlines(keepends=True)
        for i, line in enumerate(lines):
            lines[i] = _mask_assignments(line, True)
            if lines[i] != line and parses("".join(lines), path) is False:
                lines[i] = line
        out = "".join(lines)
    whole = _PEM.sub(_KEY_MASK, out)
    return out if sound and parses(whole, path) is False else whole


def mask_paths(text: str, path: str | None) -> str:
    """Home folders and drive roots as ``/workspace``; a Python file that would stop parsing stays as it is."""
    out = _DRIVE.sub(_ROOT + "/", _HOME.sub(_ROOT, text))
    return text if out != text and parses(text, path or "x.py") and parses(out, path or "x.py") is False else out


def _udf(f):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t, p) for t, p in zip(texts, paths)], dtype=object)

    return run


redact_source = _udf(mask_source)
redact_paths = _udf(mask_paths)


@F.pandas_udf(T.StringType())
def redact_secrets(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else mask_secrets(t) for t in texts], dtype=object)


def scan_text(text: Column) -> Column:
    """Names of the rules that a text breaks, sorted; fixed forms, then assignments whose value is no code. Empty for null."""
    t = F.coalesce(text, F.lit(""))
    fixed = [F.when(t.rlike(rule), name) for name, rule in SCAN_RULES.items()]
    quoted = t.rlike(r"""(?i)(?<![a-z0-9])(?:api[_-]?key|token|secret|password|passwd|pwd)["']?[ \t]*[:=][ \t]*(["'])(?!\*\*\*)[^"'\s]{6,}\1""")
    bare = t.rlike(r"(?i)(?<![a-z0-9])(?:api[_-]?key|token|secret|password|passwd|pwd)[\"']?[ \t]*[:=][ \t]*(?=[\w-]*\d)(?=[\w-]*[a-z_-])[\w-]{6,}(?![\w\-.\[(])")
    return F.array_sort(F.array_compact(F.array(*fixed, F.when(quoted | bare, "assignment"))))


def scan_documents(documents: DataFrame, key: str, leaves: str) -> DataFrame:
    """``(key, rule, findings)`` over the text leaves of documents, an array of ``(path, value)`` structs; the two exempt
    paths are left out with all below them."""
    rows = documents.select(key, F.explode(leaves).alias("leaf")).select(key, "leaf.path", "leaf.value")
    exempt = F.lit(False)
    for p in UNSCANNED:
        exempt = exempt | (F.col("path") == p) | F.col("path").startswith(p + ".") | F.col("path").startswith(p + "[")
    hits = rows.where(~exempt).select(key, F.explode(scan_text(F.col("value"))).alias("rule"))
    return hits.groupBy(key, "rule").agg(F.count("*").alias("findings"))


def json_leaves(text: Column) -> Column:
    """Array of ``(path, value)`` of all string leaves of a JSON text, paths as `a.b[0].c`; empty for bad JSON."""

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        import json

        def walk(v, path: str, out: list) -> list:
            if isinstance(v, dict):
                for k, x in v.items():
                    walk(x, f"{path}.{k}" if path else k, out)
            elif isinstance(v, list):
                for i, x in enumerate(v):
                    walk(x, f"{path}[{i}]", out)
            elif isinstance(v, str):
                out.append({"path": path, "value": v})
            return out

        def one(t):
            try:
                return walk(json.loads(t), "", [])
            except (TypeError, ValueError, RecursionError):
                return []

        return texts.map(one)

    return run(text)
