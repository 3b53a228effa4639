"""Configuration: JSON files, overrides from the environment, and device layouts in words."""

from __future__ import annotations

import json
from collections.abc import Mapping

KINDS = ("mirror", "parity", "parity1")


def from_env(env: Mapping[str, str], prefix: str = "TIDELOG") -> dict:
    """PREFIX__A__B=x as {"a": {"b": x}}; values that are JSON are read as such."""
    result: dict = {}
    for name, text in sorted(env.items()):
        if name.startswith(f"{prefix}__"):
            *path, last = name[len(prefix) + 2 :].lower().split("__")
            at = result
            for part in path:
                at = at.setdefault(part, {})
            try:
                at[last] = json.loads(text)
            except ValueError:
                at[last] = text
    return result


def merge(base: dict, over: dict) -> dict:
    """base with the values of over, dictionaries merged."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def parse_layout(text: str) -> list[dict]:
    """Devices in words: paths before any keyword stand alone, a keyword (mirror, parity) starts a group."""
    result: list[dict] = []
    group = None
    for word in text.split():
        if word in KINDS:
            group = {"kind": "parity" if word == "parity1" else word, "paths": []}
            result.append(group)
        elif group is None:
            result.append({"kind": "leaf", "paths": [word]})
        else:
            group["paths"].append(word)
    for g in result:
        if g["kind"] == "parity" and len(g["paths"]) < 3 or not g["paths"]:
            raise ValueError(f"too few devices for {g['kind']}")
    return result


def format_layout(groups: list[dict]) -> str:
    return " ".join(" ".join(([] if g["kind"] == "leaf" else [g["kind"]]) + g["paths"]) for g in groups)
