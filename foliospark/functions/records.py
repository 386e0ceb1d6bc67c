"""JSON as records: strict reading, one canonical form, identity keys, and JSON that stands inside pages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 8 << 20  # fixed value: larger records are refused


def _no_constant(name: str):
    raise ValueError(name)


def _unique(pairs):
    made = dict(pairs)
    if len(made) < len(pairs):
        raise ValueError("a key twice")
    return made


def canonical(text: str | None, separators: tuple[str, str] = (",", ":")) -> str | None:
    """The object in text with sorted keys and ASCII only; None unless it is one object of unique keys and finite numbers."""
    if text is None or len(text.encode("utf-8", "surrogatepass")) > MOST_BYTES:
        return None
    try:
        value = json.loads(text, parse_constant=_no_constant, object_pairs_hook=_unique)
        return json.dumps(value, sort_keys=True, separators=separators, allow_nan=False) if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        return None


def canonical_json(text: Column, spaced: bool = False) -> Column:
    """canonical() of a column; spaced: a blank after commas and colons."""
    separators = (", ", ": ") if spaced else (",", ":")

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: canonical(t, separators))

    return F.pandas_udf(run, "string")(text)


def export_key(payload: Column) -> Column:
    """SHA-256 of a JSON payload, the same for any order of its keys; null for what is no record."""
    return F.sha2(canonical_json(payload, spaced=True), 256)


def _chapters(html: str | None, key: str):
    at = (html or "").find(key)
    if at < 0:
        return None
    try:
        volumes, _ = json.JSONDecoder().raw_decode(html, at + len(key))
    except (ValueError, RecursionError):
        return None
    if not isinstance(volumes, list) or not all(isinstance(v, list) for v in volumes):
        return None
    pairs = [(c.get("itemId"), c.get("title")) if isinstance(c, dict) else (None, None) for v in volumes for c in v]
    valid = all(isinstance(i, str) and i.isdigit() and isinstance(t, str) for i, t in pairs)
    return [{"item": i, "title": t} for i, t in pairs] if pairs and valid else None


def embedded_chapters(html: Column, key: str = '"chapterListWithVolume":') -> Column:
    """[(item, title)] of the volumes, lists of objects itemId and title, whose JSON follows key in a page; null if any is malformed or there are none."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _chapters(t, key))

    return F.pandas_udf(run, "array<struct<item:string,title:string>>")(html)
