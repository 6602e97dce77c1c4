"""Definitions of common tagged records, one YAML file each; others are loaded from files by the registry."""

from __future__ import annotations

from importlib import resources

from .layout import load

_FILES = sorted((resources.files(__package__) / "definitions").iterdir(), key=lambda f: f.name)
TAGGED = {f.name.removesuffix(".yaml").upper(): load(f.read_text()) for f in _FILES if f.name.endswith(".yaml")}
