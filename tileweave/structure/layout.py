"""Structure definitions and the registry that finds them.

A definition is a mapping (or YAML) with ``meta`` (id, endian), ``seq`` (fields) and
``types`` (nested definitions).  A field has an id and a type (``str``, ``u1`` to
``u8``, ``s1`` to ``s8``, ``f4``, ``f8``, a nested type's name, or none for bytes),
and may have size, size-eos, encoding, if, repeat (expr, until, eos), doc and enum.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from .expression import parse

_NUMBER = re.compile(r"^([usf])([12348])(?:le|be)?$")


class LayoutError(ValueError):
    """A definition that can't be used."""


@dataclass(frozen=True)
class Field:
    id: str
    type: str | None = None
    size: str | None = None
    eos: bool = False
    encoding: str = ""
    condition: str | None = None
    repeat: str | None = None
    repeat_by: str | None = None
    doc: str = ""
    enum: str | None = None
    pad: str = " "

    @property
    def number(self) -> tuple[str, int] | None:
        m = _NUMBER.match(self.type or "")
        return (m[1], int(m[2])) if m else None


@dataclass(frozen=True)
class Layout:
    id: str
    fields: tuple[Field, ...]
    little: bool = False
    types: Mapping[str, "Layout"] = field(default_factory=dict)
    enums: Mapping[str, Mapping[int, str]] = field(default_factory=dict)


def _field(raw: Mapping) -> Field:
    if "id" not in raw:
        raise LayoutError("a field without an id")
    text = lambda k: None if raw.get(k) is None else str(raw[k])
    repeat = raw.get("repeat")
    made = Field(
        str(raw["id"]), text("type"), text("size"), bool(raw.get("size-eos")), str(raw.get("encoding", "")), text("if"), repeat,
        text("repeat-expr") if repeat == "expr" else text("repeat-until"), str(raw.get("doc", "")), text("enum"), "0" if str(raw.get("encoding", "")).upper() in ("BCS-N", "BCS-NPI") else " ",
    )
    for expression in (made.size, made.condition, made.repeat_by):
        if expression is not None:
            parse(expression)
    return made


def load(raw: Mapping | str) -> Layout:
    """A definition from a mapping or YAML text; references to unknown types are refused."""
    if isinstance(raw, str):
        import yaml

        raw = yaml.safe_load(raw)

    def build(raw: Mapping, id: str, little: bool, outer: Mapping[str, Layout]) -> Layout:
        types: dict[str, Layout] = dict(outer)
        waiting = dict(raw.get("types") or {})
        for name in list(waiting):  # types may refer to each other in any order
            types[name] = Layout(name, ())
        for name, inner in waiting.items():
            types[name] = build(inner, name, little, types)
        fields = tuple(_field(f) for f in raw.get("seq") or ())
        for f in fields:
            if f.type and f.type not in ("str", "strz") and not f.number and not re.match(r"^b\d+$", f.type) and f.type not in types:
                raise LayoutError(f"{id}.{f.id}: no type {f.type}")
        enums = {k: {int(n): str(v if not isinstance(v, Mapping) else v.get("id")) for n, v in e.items()} for k, e in (raw.get("enums") or {}).items()}
        return Layout(id, fields, little, types, enums)

    meta = raw.get("meta") or {}
    return build(raw, str(meta.get("id", "")), str(meta.get("endian", "be")) == "le", {})


class Registry:
    """Definitions by name, the case and outer spaces of which don't count; those added at run time win over search paths, and these over built-in ones."""

    def __init__(self, builtin: Mapping[str, Layout] | None = None, paths: Iterable[str] = ()):
        self.added: dict[str, Layout] = {}
        self.found: dict[str, Layout] = {}
        self.builtin = {k.strip().lower(): v for k, v in (builtin or {}).items()}
        for path in paths:
            self.search(path)

    def add(self, name: str, definition: Layout | Mapping | str) -> None:
        self.added[name.strip().lower()] = definition if isinstance(definition, Layout) else load(definition)

    def search(self, folder: str) -> None:
        """Adds every definition file of a folder; later folders win."""
        from pathlib import Path

        for file in sorted([*Path(folder).rglob("*.ksy"), *Path(folder).rglob("*.yaml")]):
            self.found[file.stem.lower()] = load(file.read_text())

    def get(self, name: str) -> Layout | None:
        key = name.strip().lower()
        for source in (self.added, self.found, self.builtin):
            for candidate in (key, f"tre_{key}", f"des_{key}"):
                if candidate in source:
                    return source[candidate]
        return None

    def names(self) -> list[str]:
        return sorted({*self.added, *self.found, *self.builtin})
