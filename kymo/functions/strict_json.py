"""Strict JSON documents and JSON Pointers, for the small files that a driver reads."""

from __future__ import annotations

import json
import math
from typing import Any

from kymo.errors import ConfigurationError, KymoError


def parse_strict(data: bytes | str, error: type[KymoError] = ConfigurationError, where: str = "document") -> Any:
    """JSON in declaration order; a repeated key at any depth and numbers that aren't finite are errors."""

    def unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise error("duplicate_key", f"{where}: a key is repeated among {[k for k, _ in pairs]}")
        return out

    def finite(text: str) -> float:
        value = float(text)
        if not math.isfinite(value):
            raise error("non_finite", f"{where}: {text} is no finite number")
        return value

    def never(text: str) -> Any:
        raise error("non_finite", f"{where}: {text} is no JSON number")

    try:
        return json.loads(data, object_pairs_hook=unique, parse_float=finite, parse_constant=never)
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise error("invalid_json", f"{where}: {e}") from e


def compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def pretty(value: Any) -> bytes:
    return (json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n").encode()


def same_json(a: Any, b: Any) -> bool:
    """Equality of JSON values: an integer never equals a float, nor a number a boolean."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same_json(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same_json, a, b))
    return a == b


def pointer_segments(pointer: str) -> tuple[str, ...] | None:
    """Segments of a JSON Pointer; None where it is none. The root pointer is no parameter."""
    if not pointer.startswith("/"):
        return None
    out = []
    for part in pointer[1:].split("/"):
        if any(t[:1] not in ("0", "1") for t in part.split("~")[1:]):
            return None
        out.append(part.replace("~1", "/").replace("~0", "~"))
    return tuple(out)


def pointer_of(segments: tuple[str, ...]) -> str:
    return "".join("/" + s.replace("~", "~0").replace("/", "~1") for s in segments)


def conflict(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Equal, or one leads to the other."""
    n = min(len(a), len(b))
    return a[:n] == b[:n]


def flatten(document: dict[str, Any]) -> dict[tuple[str, ...], Any]:
    """Leaves depth first; arrays and empty objects are leaves."""
    out: dict[tuple[str, ...], Any] = {}
    stack = [((k,), v) for k, v in reversed(document.items())]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict) and value:
            stack.extend(((*path, k), v) for k, v in reversed(value.items()))
        else:
            out[path] = value
    return out


def rebuild(leaves: dict[tuple[str, ...], Any]) -> dict[str, Any]:
    """The nested document of leaves, in their order."""
    out: dict[str, Any] = {}
    for path, value in leaves.items():
        at = out
        for part in path[:-1]:
            at = at.setdefault(part, {})
        at[path[-1]] = value
    return out
