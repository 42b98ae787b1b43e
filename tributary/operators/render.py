"""Lineage trees as text, JSON, XML and flat maps."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from .resolver import Column


def title(c: Column) -> str:
    if c.kind == "unknown":
        return f"{c.name} : Unknown Not found in schema"
    label = f" AS {c.label}" if c.label and c.label != c.name else ""
    return f"{c.path}{label}" + (f" : {c.type}" if c.type else "")


def to_text(columns: list[Column]) -> str:
    lines = []

    def put(c: Column, lead: str, last: bool, top: bool) -> None:
        lines.append(("" if top else lead + ("└─ " if last else "├─ ")) + title(c))
        for k, x in enumerate(c.children):
            put(x, "" if top else lead + ("   " if last else "│  "), k == len(c.children) - 1, False)

    for c in columns:
        put(c, "", True, True)
    return "\n".join(lines)


def to_dict(c: Column, brief: bool = False) -> dict:
    told = {"name": c.name, "table": c.table, "kind": c.kind, "type": c.type, "label": c.label}
    if brief:
        told = {k: v for k, v in told.items() if v}
    children = [to_dict(x, brief) for x in c.children]
    return told | ({"children": children} if children or not brief else {})


def to_json(columns: list[Column], brief: bool = False) -> str:
    return json.dumps([to_dict(c, brief) for c in columns], indent=None if brief else 2)


def to_xml(columns: list[Column]) -> str:
    def put(c: Column) -> str:
        told = " ".join(f"{k}={quoteattr(str(v))}" for k, v in (("name", c.name), ("table", c.table), ("kind", c.kind), ("label", c.label)) if v)
        inner = "".join(map(put, c.children))
        return f"<column {told}>{inner}</column>" if inner else f"<column {told}/>"

    return "<columns>" + "".join(map(put, columns)) + "</columns>"


def to_map(columns: list[Column]) -> dict[str, set[str]]:
    return {c.label: {x.path for x in c.leaves()} for c in columns}
