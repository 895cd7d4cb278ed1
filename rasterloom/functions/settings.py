"""Nested settings, as plain dictionaries on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any


def with_value(settings: Mapping[str, Any], path: Sequence[str], value: Any) -> dict[str, Any]:
    """A copy with the value at a path of keys; levels that are missing, or no mapping, are made."""
    if not path:
        raise ValueError("a path has one key at least")
    first, *rest = path
    inner = settings.get(first)
    return {**settings, first: with_value(inner if isinstance(inner, Mapping) else {}, rest, value) if rest else value}


def merged(base: Mapping[str, Any], changes: Mapping[str, Any]) -> dict[str, Any]:
    """base with the changes: mappings level by level, anything else replaced."""
    both = lambda k: isinstance(base.get(k), Mapping) and isinstance(changes[k], Mapping)
    return {**base, **{k: merged(base[k], changes[k]) if both(k) else changes[k] for k in changes}}


def valued(settings: Mapping[str, Any], text: str, separator: str = ".") -> Any:
    """The value at a path written as text, or None."""
    at: Any = settings
    for k in text.split(separator):
        at = at.get(k) if isinstance(at, Mapping) else None
    return at
