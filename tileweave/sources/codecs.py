"""Codec plug-ins by name, and the choice of a format."""

from __future__ import annotations

import json

from . import formats
from .formats import coded, dted, jpeg, nitf, plugin, png, register_codec, registered_codecs, tiff, using

FORMATS = {"nitf": nitf, "nsif": nitf, "tiff": tiff, "png": png, "dted": dted, "j2k": coded, "jpeg": jpeg}


def codec_json(name: str, configuration: dict) -> str:
    """A codec as JSON: its name and configuration."""
    return json.dumps({"name": name, "configuration": configuration}, sort_keys=True)


def codec_of_json(text: str) -> tuple[str, dict]:
    made = json.loads(text)
    return made["name"], made.get("configuration", {})


def sniffed(data: bytes) -> str:
    """Format by the first bytes."""
    if bytes(data[:9]) in nitf.MAGIC:
        return "nitf" if data[:4] == b"NITF" else "nsif"
    if data[:2] in (b"II", b"MM"):
        return "tiff"
    if data[:8] == png.SIGNATURE:
        return "png"
    if data[:3] == b"UHL":
        return "dted"
    if data[:2] == b"\xff\x4f" or data[:12] == coded.JP2:
        return "j2k"
    if data[:2] == b"\xff\xd8":
        return "jpeg"
    raise formats.FormatError("unknown format")


__all__ = ["FORMATS", "codec_json", "codec_of_json", "plugin", "register_codec", "registered_codecs", "sniffed", "using"]
