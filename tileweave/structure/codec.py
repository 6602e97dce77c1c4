"""Reading and writing bytes by a layout."""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping

from .expression import ExpressionError, evaluate
from .layout import Field, Layout


class StructureError(ValueError):
    """Bytes that end early, a missing field, or a value that doesn't fit."""


def _count(expression: str, values: Mapping) -> int:
    n = evaluate(expression, values)
    if isinstance(n, str):
        n = int(n.strip() or 0)
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise StructureError(f"{expression} gives no count")
    return n


def _holds(field: Field, values: Mapping) -> bool:
    if field.condition is None:
        return True
    try:
        return evaluate(field.condition, values) is True
    except ExpressionError:
        return True  # a condition that can't be evaluated doesn't hide its field


def _code(kind: str, size: int, little: bool) -> str:
    return ("<" if little else ">") + {"u": {1: "B", 2: "H", 4: "I", 8: "Q"}, "s": {1: "b", 2: "h", 4: "i", 8: "q"}, "f": {4: "f", 8: "d"}}[kind][size]


def read(layout: Layout, data: bytes, at: int = 0, offsets: dict | None = None, outer: Mapping | None = None) -> tuple[dict, int]:
    """Values of the present fields, and the place after the last; ``offsets`` gets (place, length) by field."""
    values: dict = {}
    scope = _Scope(values, {} if outer is None else outer)

    def one(field: Field, at: int):
        if field.number:
            kind, size = field.number
            part = data[at : at + size]
            if len(part) < size:
                raise StructureError(f"{layout.id}.{field.id}: the data end early")
            if size == 3:
                return int.from_bytes(part, "little" if layout.little else "big", signed=kind == "s"), at + 3
            return struct.unpack(_code(kind, size, layout.little), part)[0], at + size
        if field.type in layout.types:
            end = at + _count(field.size, scope) if field.size else len(data)
            inner, stop = read(layout.types[field.type], data[:end] if field.size else data, at, None, scope)
            return inner, end if field.size else stop
        size = len(data) - at if field.eos else _count(field.size, scope) if field.size else 0
        part = data[at : at + size]
        if len(part) < size:
            raise StructureError(f"{layout.id}.{field.id}: {size} bytes wanted, {len(part)} there")
        return (part.decode("utf-8" if field.encoding.upper() == "UTF-8" else "latin-1", "replace") if field.type == "str" else part), at + size

    for field in layout.fields:
        if not _holds(field, scope):
            continue
        start = at
        if field.repeat:
            items: list = []
            wanted = _count(field.repeat_by, scope) if field.repeat == "expr" else None
            while len(items) < wanted if wanted is not None else at < len(data):
                value, at = one(field, at)
                items.append(value)
                if field.repeat == "until" and evaluate(field.repeat_by, {**scope.all(), "_": value}) is True:
                    break
            values[field.id] = items
        else:
            values[field.id], at = one(field, at)
            if field.enum and values[field.id] in layout.enums.get(field.enum, {}):
                values[field.id] = layout.enums[field.enum][values[field.id]]
        if offsets is not None:
            offsets[field.id] = (start, at - start)
    return values, at


class _Scope(dict):
    """Fields of a structure over those of the one around it."""

    def __init__(self, own: dict, outer: Mapping):
        super().__init__()
        self.own, self.outer = own, outer

    def __contains__(self, key) -> bool:
        return key in self.own or key in self.outer

    def __getitem__(self, key):
        return self.own[key] if key in self.own else self.outer[key]

    def all(self) -> dict:
        return {**(self.outer.all() if isinstance(self.outer, _Scope) else dict(self.outer)), **self.own}


def fitted(value, width: int, pad: str = " ") -> bytes:
    """Text of a value in a fixed field: numbers to the right, text to the left; decimals are cut to the width, and what still doesn't fit is refused."""
    if isinstance(value, bytes):
        out = value
    elif isinstance(value, bool):
        out = b"1" if value else b"0"
    elif isinstance(value, (int, float)):
        shown = repr(value)
        if len(shown) > width and isinstance(value, float):
            shown = f"{value:.{max(0, width - len(str(int(value))) - 1 - (value < 0 and int(value) == 0))}f}"[:width].rstrip(".")
        sign = "-" if shown.startswith("-") and pad == "0" else ""
        out = (sign + shown[len(sign) :].rjust(width - len(sign), pad)).encode()
    else:
        text = str(value)
        out = (text.rjust(width, "0") if pad == "0" and text.strip().lstrip("+-").replace(".", "", 1).isdigit() else text.ljust(width)).encode("latin-1")
    if len(out) > width:
        raise StructureError(f"{value!r} doesn't fit {width} characters")
    return out.ljust(width, b" " if pad == " " else pad.encode())


def write(layout: Layout, values: Mapping, outer: Mapping | None = None) -> bytes:
    """Bytes of a structure; names match in any case, and only fields whose condition is false may be missing."""
    given = {k.lower(): v for k, v in values.items()}
    done: dict = {}
    scope = _Scope(done, {} if outer is None else outer)
    out = bytearray()

    def one(field: Field, value) -> bytes:
        if field.number:
            kind, size = field.number
            try:
                if size == 3:
                    return int(value).to_bytes(3, "little" if layout.little else "big", signed=kind == "s")
                return struct.pack(_code(kind, size, layout.little), float(value) if kind == "f" else int(value))
            except (struct.error, OverflowError) as e:
                raise StructureError(f"{layout.id}.{field.id}: {e}") from None
        if field.type in layout.types:
            return write(layout.types[field.type], value, scope)
        if field.eos or field.size is None:
            return value if isinstance(value, bytes) else str(value).encode("latin-1")
        width = _count(field.size, scope)
        if field.type == "str":
            return fitted(value, width, field.pad)
        if len(value) != width:
            raise StructureError(f"{layout.id}.{field.id}: {width} bytes wanted, {len(value)} given")
        return bytes(value)

    for field in layout.fields:
        if not _holds(field, scope):
            continue
        if field.id.lower() not in given:
            if field.condition is not None:
                continue
            raise StructureError(f"{layout.id}.{field.id} is missing")
        value = given[field.id.lower()]
        many = value if field.repeat else [value]
        if field.repeat == "expr" and len(many) != _count(field.repeat_by, scope):
            raise StructureError(f"{layout.id}.{field.id}: another number of items than {field.repeat_by}")
        parts = [one(field, v) for v in many]
        out += b"".join(parts)
        as_read = [p.decode("latin-1") if field.type == "str" else v for p, v in zip(parts, many)]
        done[field.id] = as_read if field.repeat else as_read[0]
    return bytes(out)


def member(values: Mapping, path: str):
    """Value at a path ``A.B``; a step into a list gives the list of members."""
    now = values
    for name in path.split("."):
        if isinstance(now, list):
            now = [x[name] for x in now]
        elif name in now:
            now = now[name]
        else:
            raise StructureError(f"no field {path}")
    return now


def to_json(value):
    """A value as JSON has it: text without trailing spaces, other bytes as lower hex, NaN and infinities left out."""
    if isinstance(value, str):
        return value.rstrip(" ")
    if isinstance(value, bytes):
        try:
            return value.decode().rstrip(" ")
        except UnicodeDecodeError:
            return value.hex()
    if isinstance(value, Mapping):
        return {k: j for k, v in value.items() if (j := to_json(v)) is not None}
    if isinstance(value, list):
        return [to_json(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def records(data: bytes) -> list[tuple[str, bytes]]:
    """Tagged records (six characters of tag, five digits of length, data) until the end; trailing spaces and zeros end them."""
    out, at = [], 0
    while at < len(data) and data[at:].strip(b" \0"):
        tag, size = data[at : at + 6].decode("latin-1"), data[at + 6 : at + 11]
        if not all(c.isalnum() or c in " _" for c in tag) or not size.isdigit():
            raise StructureError(f"no tagged record at {at}")
        end = at + 11 + int(size)
        if end > len(data):
            raise StructureError(f"record {tag.strip()} is cut")
        out.append((tag.strip(), data[at + 11 : end]))
        at = end
    return out


def record(tag: str, data: bytes) -> bytes:
    if len(tag) > 6 or len(data) > 99_999:
        raise StructureError(f"record {tag} is too long")
    return f"{tag:<6}{len(data):05d}".encode() + data


def split_by_size(items: list[tuple[str, bytes]], limit: int) -> tuple[list[tuple[str, bytes]], list[tuple[str, bytes]]]:
    """Records that fit a limit, in order, later small ones included, and the others."""
    fits, over, used = [], [], 0
    for tag, data in items:
        if used + 11 + len(data) <= limit:
            fits.append((tag, data))
            used += 11 + len(data)
        else:
            over.append((tag, data))
    return fits, over


def parsed_records(data: bytes, registry) -> dict:
    """Fields of each record by its tag, the last one of a tag; unknown tags give their raw bytes, malformed ones a warning."""
    out: dict = {}
    for tag, body in records(data):
        layout = registry.get(tag)
        if layout is None:
            out[tag] = {"_raw": body.hex(), "_length": len(body)}
            continue
        try:
            out[tag] = to_json(read(layout, body)[0])
        except (StructureError, ExpressionError) as e:
            out[tag] = {"_raw": body.hex(), "_length": len(body), "_warning": str(e)}
    return out
