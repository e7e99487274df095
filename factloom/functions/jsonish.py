"""JSON that models write: with prose around it, smart quotes, trailing commas, Python literals. Pure Python, for pandas UDFs."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import functions as F

_PAIRS = {"{": "}", "[": "]"}
_QUOTES = str.maketrans({"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'"})


def balanced_block(text: str, start: int = 0) -> tuple[str, int, int]:
    """(block, start, end) of the first balanced {...} or [...] from start on, minding strings and escapes; ("", -1, -1) if none."""
    at = start
    while at < len(text):
        at = min((i for i in (text.find("{", at), text.find("[", at)) if i >= 0), default=-1)
        if at < 0:
            break
        depth: list[str] = []
        quoted = escaped = False
        for i in range(at, len(text)):
            c = text[i]
            if quoted:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in _PAIRS:
                depth.append(_PAIRS[c])
            elif depth and c == depth[-1]:
                depth.pop()
                if not depth:
                    return text[at : i + 1], at, i + 1
        at += 1
    return "", -1, -1


def repaired(raw: str) -> str:
    """Straight quotes, quoted [Chunk n] values, no trailing commas."""
    s = raw.translate(_QUOTES)
    s = re.sub(r"(:\s*)(\[\s*[Cc]hunk\s+[^\]\"]*\])", r'\1"\2"', s)
    return re.sub(r",(\s*[}\]])", r"\1", s)


def parse_any(text: str | None):
    """The value of the first JSON in a text: as it is, as a Python literal, or repaired; None if there is none."""
    if not text:
        return None
    s = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
    for candidate in (s, balanced_block(s)[0]):
        if not candidate.strip():
            continue
        for read in (json.loads, ast.literal_eval, lambda x: json.loads(repaired(x)), lambda x: ast.literal_eval(repaired(x))):
            try:
                return read(candidate.strip())
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                continue
    return None


def fact_rows(text: str | None, default_confidence: float = 0.76) -> list[dict]:
    """Facts of an answer: {"facts": [...]}, a list, one fact, or one fact a line; those without subject, predicate or object are left out."""
    parsed = parse_any(text)
    rows = parsed.get("facts", [parsed]) if isinstance(parsed, dict) else parsed if isinstance(parsed, list) else []
    if isinstance(parsed, dict) and "facts" not in parsed and text and text.count("\n") and text.lstrip().startswith("{"):
        lines = [parse_any(x) for x in text.splitlines() if x.strip().startswith("{")]
        rows = [x for x in lines if isinstance(x, dict)] if len([x for x in lines if x]) > 1 else rows
    out = []
    for r in rows if isinstance(rows, list) else []:
        if not isinstance(r, dict):
            continue
        f = {k: " ".join(str(r.get(k) if r.get(k) is not None else "").split()) for k in ("subject", "predicate", "object", "value", "unit", "timeframe")}
        if not (f["subject"] and f["predicate"] and f["object"]):
            continue
        try:
            c = float(r.get("confidence", default_confidence))
        except (TypeError, ValueError):
            c = default_confidence
        f["confidence"] = min(1.0, max(0.0, c)) if c == c else default_confidence
        out.append(f)
    return out


def entity_list(text: str | None, most: int = 24) -> list[str]:
    """entities or key_entities of an answer, without repetition in any case."""
    parsed = parse_any(text)
    names = (parsed.get("entities") or parsed.get("key_entities") or []) if isinstance(parsed, dict) else []
    out: dict[str, str] = {}
    for n in names if isinstance(names, list) else []:
        s = " ".join(str(n).split())
        if s:
            out.setdefault(s.lower(), s)
    return list(out.values())[:most]


FACTS = "array<struct<subject: string, predicate: string, object: string, value: string, unit: string, timeframe: string, confidence: double>>"


def facts_udf(x, default_confidence: float = 0.76):
    """The facts of answers as a column. Made when it is used, since workers import this module without a session."""
    return F.pandas_udf(lambda s: s.map(lambda t: fact_rows(t, default_confidence)), FACTS)(x)


def entities_udf(x):
    return F.pandas_udf(lambda s: s.map(entity_list), "array<string>")(x)


def _rows(x, label: str = "label") -> list[dict]:
    """Rows with label and value out of a list of objects, or an object of names and values."""
    if isinstance(x, dict):
        inner = next((x[k] for k in ("data", "values", "figures", "hero_figures") if isinstance(x.get(k), (list, dict))), None)
        if inner is not None:
            return _rows(inner)
        if "label" in x and "value" in x:
            return [x]
        return [{"label": str(k), "value": v} for k, v in x.items() if isinstance(v, (int, float, str)) and k not in ("type", "title")]
    return [r for r in x if isinstance(r, dict) and r.get("label") not in (None, "") and r.get("value") not in (None, "")] if isinstance(x, list) else []


def _take(text: str, tag: str, label: str) -> tuple[str, object]:
    """(text without it, parsed) of an artifact in <tag>...</tag>, in an open tag, or after "Label:"."""
    m = re.search(rf"(?is)<{tag}>(.*?)(?:</{tag}>|$)", text)
    if m:
        return (text[: m.start()] + text[m.end() :]).strip(), parse_any(m[1])
    m = re.search(rf"(?i){label}\s*:\s*(?=[\[{{])", text)
    if m:
        block, at, end = balanced_block(text, m.end())
        if block:
            return (text[: m.start()] + text[end:]).strip(), parse_any(block)
    return text, None


def artifacts(text: str | None) -> dict:
    """{content, viz_type, viz_title, viz (label, value), figures (label, value, delta, source)} of an answer."""
    body, viz = _take(text or "", "visualization", "visualization")
    body, heroes = _take(body, "hero_figures", "hero figures")
    for _ in range(12):  # payloads that were left in the text
        block, at, end = balanced_block(body)
        parsed = parse_any(block) if block else None
        if not isinstance(parsed, dict) or not ({"data", "hero_figures", "figures", "visualization"} & set(parsed) or {"label", "value"} <= set(parsed)):
            break
        viz = viz if viz is not None else parsed.get("visualization", parsed if "data" in parsed else None)
        heroes = heroes if heroes is not None else parsed.get("hero_figures", parsed.get("figures"))
        body = (body[:at] + body[end:]).strip()
    rows = _rows(viz) if viz is not None else []
    figures = [{k: str(r.get(k, "") if r.get(k) is not None else "") for k in ("label", "value", "delta", "source")} for r in (_rows(heroes) if heroes is not None else [])]
    return {
        "content": re.sub(r"\n{3,}", "\n\n", re.sub(r"```(?:json)?\s*```", "", body)).strip(), "viz_type": str(viz.get("type", "bar")) if isinstance(viz, dict) else "",
        "viz_title": str(viz.get("title", "")) if isinstance(viz, dict) else "", "viz": [{"label": str(r["label"]), "value": str(r["value"])} for r in rows], "figures": figures[:4],
    }


ARTIFACTS = "struct<content: string, viz_type: string, viz_title: string, viz: array<struct<label: string, value: string>>, figures: array<struct<label: string, value: string, delta: string, source: string>>>"


def artifacts_udf(x):
    names = ["content", "viz_type", "viz_title", "viz", "figures"]

    def take(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([artifacts(t) for t in s], columns=names)

    take.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(take, ARTIFACTS)(x)


def is_chartable(viz: F.Column, least: int = 2, share: float = 0.6) -> F.Column:
    """Whether at least two values of a payload, and 60 % of them, are numbers (and no phone numbers)."""
    numeric = F.size(F.filter(viz, lambda r: F.regexp_replace(r["value"], "[,%$€£ ]", "").try_cast("double").isNotNull() & ~r["value"].rlike(r"^\+?\d[\d -]{9,}$")))
    return (numeric >= least) & (numeric >= F.size(viz) * share)
