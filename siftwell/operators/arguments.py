"""Tolerant coercion of arguments that come as text, JSON or lists."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any


def as_int(value: Any, default: int, low: int, high: int) -> int:
    """An integer within bounds; what is none is the default."""
    try:
        return min(max(int(value), low), high)
    except (TypeError, ValueError):
        return default


def as_float(value: Any, default: float, low: float, high: float) -> float:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return default
    return default if number != number else min(max(number, low), high)


def as_bool(value: Any, default: bool) -> bool:
    if isinstance(value, str):
        word = value.strip().lower()
        return True if word in ("true", "1", "yes", "y", "on") else False if word in ("false", "0", "no", "n", "off") else default
    return default if value is None else bool(value)


def as_mode(value: Any, default: str = "all") -> str:
    word = str(value or "").strip().lower()
    return word if word in ("all", "loose") else default


def as_terms(value: Any, default: Sequence[str]) -> tuple[str, ...]:
    """Terms from a comma list or a sequence; the default where none is left."""
    parts = value.split(",") if isinstance(value, str) else value if isinstance(value, (list, tuple)) else []
    return tuple(t for t in (str(p).strip() for p in parts) if t) or tuple(default)


def as_object(raw: Any) -> dict[str, Any]:
    """A JSON object; anything else is held under ``result``."""
    if isinstance(raw, dict):
        return raw
    try:
        found = json.loads(raw)
    except (TypeError, ValueError):
        return {"result": raw}
    return found if isinstance(found, dict) else {"result": raw}


def as_queries(value: Any) -> dict[str, list[str]]:
    """Queries by company from an object or its JSON text; single texts become lists."""
    found = as_object(value) if value else {}
    return {str(k): [v] if isinstance(v, str) else [str(x) for x in v] for k, v in found.items() if isinstance(v, (str, list, tuple)) and k != "result"}
