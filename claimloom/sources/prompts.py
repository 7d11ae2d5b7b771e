"""Prompt catalogues: a YAML list of entries with name, content and optional role and user_prompt."""

from __future__ import annotations

import re
from collections.abc import Iterable


def parse(text: str) -> dict[str, dict[str, str]]:
    """Entries by name, from the part of YAML such files use: a list of flat mappings with plain, quoted and block values."""
    out: dict[str, dict[str, str]] = {}
    entry: dict[str, str] = {}
    lines = text.splitlines()
    i = 0
    while i < len(lines):
        m = re.match(r"^(\s*)(- )?([A-Za-z_]\w*):\s*(.*)$", lines[i])
        if not m:
            i += 1
            continue
        if m[2]:
            entry = {}
        indent = len(m[1]) + len(m[2] or "")
        value = m[4].strip()
        i += 1
        if re.fullmatch(r"[|>][+-]?", value):
            block = []
            while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip()) > indent):
                block.append(lines[i])
                i += 1
            depth = min((len(x) - len(x.lstrip()) for x in block if x.strip()), default=0)
            body = [x[depth:] for x in block]
            joined = "\n".join(body) if value[0] == "|" else " ".join(x.strip() for x in body)
            value = joined.rstrip("\n") + ("" if value.endswith("-") else "\n")
        elif len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        entry[m[3]] = value
        if "name" in entry:
            out[entry["name"]] = entry
    return out


def required(prompts: dict[str, dict[str, str]], names: Iterable[str]) -> dict[str, dict[str, str]]:
    """The prompts, if all of the names are there."""
    missing = [n for n in names if n not in prompts]
    if missing:
        raise KeyError(f"missing prompts: {', '.join(missing)}")
    return prompts


def named(prompts: dict[str, dict[str, str]], name: str) -> dict[str, str] | None:
    return prompts.get(name)
