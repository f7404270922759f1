"""Project manifests: path aliases, the module path of a Go project, autoload folders of a PHP project. All are small files on the driver."""

from __future__ import annotations

import json
import posixpath
import re


def _relaxed(text: str) -> dict:
    """JSON with comments and trailing commas."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r",\s*([}\]])", r"\1", text))


def tsconfig_aliases(text: str) -> list[tuple[str, str]]:
    """(alias, first target) of compilerOptions.paths; targets are under baseUrl."""
    options = _relaxed(text).get("compilerOptions") or {}
    base = options.get("baseUrl") or "."
    return [(alias, posixpath.join(base, targets[0]) if base not in (".", "./") else targets[0]) for alias, targets in (options.get("paths") or {}).items() if targets]


def match_alias(raw: str, alias: str, target: str) -> str | None:
    """The target for a raw import, or None. At most one star on each side, and as many on both."""
    if alias.count("*") > 1 or alias.count("*") != target.count("*"):
        return None
    if "*" not in alias:
        return target if raw == alias else None
    head, _, tail = alias.partition("*")
    if len(raw) < len(head) + len(tail) or not raw.startswith(head) or not raw.endswith(tail):
        return None
    return target.replace("*", raw[len(head) : len(raw) - len(tail)])


def nearest(folder: str, known: dict[str, object]) -> object | None:
    """What the nearest folder at or above `folder` holds."""
    while True:
        if folder in known:
            return known[folder]
        if not folder:
            return None
        folder = posixpath.dirname(folder)


def go_module(text: str) -> str | None:
    m = re.search(r"^\s*module\s+(\S+)", text, re.M)
    return m[1] if m else None


def psr4_mappings(text: str) -> list[tuple[str, str]]:
    """(namespace, folder) of autoload and autoload-dev; of a list of folders the first."""
    data, out = json.loads(text), []
    for section in ("autoload", "autoload-dev"):
        for space, folder in ((data.get(section) or {}).get("psr-4") or {}).items():
            folder = folder[0] if isinstance(folder, list) and folder else folder
            if isinstance(folder, str):
                out.append((space, folder if not folder or folder.endswith("/") else folder + "/"))
    return out
