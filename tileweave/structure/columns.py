"""Structure definitions and their expressions compiled to Spark Columns.

``compiled`` turns an expression's syntax tree into a Column over typed fields, and
``parsed`` a definition into the fields of a binary column: both run wholly in the JVM.
A field's place follows from those before it.  As long as sizes are constant, places are
constants; a field whose size or presence the data decide makes the next place a value
that is bound once, and repeated structures are folded over a struct of place and items.

Kinds are told when an expression is compiled: int, float, str, bool, bytes, list or
struct.  What is an error for a row (an unknown number, a division by zero, an index out
of range) is null there: a condition that is null doesn't hide its field, and a size that is
null is an error of its field.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import read_float, read_signed, read_unsigned
from .expression import ExpressionError, parse
from .layout import Field, Layout

#: Fixed value: floats that differ by less are equal.
EPSILON = 2.220446049250313e-16
_EMPTY = None  # no Column yet: a kind alone


@dataclass(frozen=True)
class Typed:
    """A Column and the kind of its values; of a list also the kind of its items, of a struct its fields'."""

    column: Column | None
    kind: str
    item: Typed | None = None
    fields: Mapping[str, Typed] = field(default_factory=dict)

    def at(self, column: Column) -> Typed:
        """The same kind of another Column."""
        return Typed(column, self.kind, self.item, {k: v.at(column[k]) for k, v in self.fields.items()})


def _null(kind: str) -> Typed:
    return Typed(F.lit(None).cast({"int": "bigint", "float": "double", "str": "string", "bool": "boolean", "bytes": "binary"}.get(kind, "string")), kind)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbers(a: Typed, b: Typed) -> bool:
    return a.kind in ("int", "float") and b.kind in ("int", "float")


def _equal(a: Typed, b: Typed) -> Column:
    if _numbers(a, b):
        return a.column == b.column if a.kind == b.kind == "int" else F.abs(a.column.cast("double") - b.column.cast("double")) < EPSILON
    known = a.column.isNotNull() & b.column.isNotNull()
    return a.column == b.column if a.kind == b.kind and a.kind not in ("list", "struct") else F.when(known, F.lit(False))


def _binary(op: str, a: Typed, b: Typed) -> Typed:
    call = lambda name, kind, *args: Typed(F.call_function(name, *args), kind)
    x, y = a.column, b.column
    if op in ("==", "!="):
        same = _equal(a, b)
        return Typed(same if op == "==" else ~same, "bool")
    if op == "+" and a.kind == b.kind == "str":
        return Typed(F.concat(x, y), "str")
    if op in ("|", "^", "&", "%", "<<", ">>"):
        if not a.kind == b.kind == "int":
            return _null("int")
        if op == "%":
            return Typed(F.when(y != 0, F.try_mod(x, y)), "int")
        if op in ("<<", ">>"):
            inside = (y >= 0) & (y < 64)
            return Typed(F.when(inside, F.call_function("shiftleft" if op == "<<" else "shiftright", x, y.cast("int"))), "int")
        return Typed({"|": x.bitwiseOR, "^": x.bitwiseXOR, "&": x.bitwiseAND}[op](y), "int")
    if not _numbers(a, b):
        return _null("bool" if op in ("<", "<=", ">", ">=") else "int")
    whole = a.kind == b.kind == "int"
    if not whole:
        x, y = x.cast("double"), y.cast("double")
    if op in ("<", "<=", ">", ">="):
        return Typed({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")
    if op == "/":
        if not whole:
            return Typed(F.try_divide(x, y), "float")
        least = F.lit(-(1 << 63))
        return Typed(F.when((y != 0) & ~((x == least) & (y == -1)), F.call_function("div", x, y)), "int")
    return call({"+": "try_add", "-": "try_subtract", "*": "try_multiply"}[op], "int" if whole else "float", x, y)


def _method(name: str, v: Typed) -> Typed:
    if name == "to_i":
        if v.kind == "str":
            return Typed(F.trim(v.column).try_cast("bigint"), "int")
        if v.kind in ("int", "float"):
            return Typed(v.column.try_cast("bigint"), "int")
    elif name == "to_s":
        return v if v.kind == "str" else Typed(v.column.cast("string"), "str")
    elif name in ("length", "size") and v.kind in ("str", "bytes", "list"):
        return Typed((F.array_size(v.column) if v.kind == "list" else F.length(v.column)).cast("bigint"), "int")
    elif name == "strip" and v.kind == "str":
        return Typed(F.trim(v.column), "str")
    if name in v.fields:
        return v.fields[name]
    if v.kind == "list" and v.item is not None and name in v.item.fields:
        return Typed(F.transform(v.column, lambda x: x[name]), "list", v.item.fields[name])
    raise ExpressionError(f"{name} of {v.kind}")


def compiled(text: str, fields: Mapping[str, Typed]) -> Typed:
    """An expression over typed fields as a Column; an unknown field or operator is refused here, not row by row."""

    def of(node) -> Typed:
        kind = node[0]
        if kind == "value":
            v = node[1]
            known = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "str"
            return Typed(F.lit(v).cast("bigint") if known == "int" else F.lit(v), known)
        if kind == "name":
            if node[1] not in fields:
                raise ExpressionError(f"no field {node[1]}")
            return fields[node[1]]
        if kind == "member":
            return _method(node[1], of(node[2]))
        if kind == "index":
            whole, at = of(node[1]), of(node[2])
            if whole.kind != "list" or whole.item is None or at.kind != "int":
                raise ExpressionError("only lists have an index, and it is an integer")
            return whole.item.at(F.when(at.column >= 0, F.get(whole.column, at.column.cast("int"))))
        if kind == "unary":
            op, v = node[1], of(node[2])
            if op == "not":
                return Typed(~v.column, "bool") if v.kind == "bool" else _null("bool")
            if op == "-" and v.kind in ("int", "float"):
                return Typed(F.call_function("try_subtract", F.lit(0).cast("bigint"), v.column) if v.kind == "int" else -v.column, v.kind)
            return Typed(F.bitwise_not(v.column), "int") if op == "~" and v.kind == "int" else _null("int")
        op, left, right = node[1], of(node[2]), of(node[3])
        if op in ("and", "or"):
            if left.kind != "bool":
                return _null("bool")
            decided = left.column == F.lit(op == "or")  # the right side doesn't count, not even its errors
            return Typed(F.when(decided, left.column).when(left.column.isNotNull(), right.column if right.kind == "bool" else F.lit(None).cast("boolean")), "bool")
        return _binary(op, left, right)

    return of(parse(text))


# --- definitions --------------------------------------------------------------


@dataclass
class _State:
    """What a definition has given so far: values, places, the next place, and the first error."""

    values: dict[str, Typed]
    places: dict[str, Column]
    at: Column
    error: Column


def _decoded(part: Column, f: Field) -> Column:
    return F.make_valid_utf8(part.cast("string")) if f.encoding.upper() == "UTF-8" else F.decode(part, "ISO-8859-1")


def _number(data: Column, at: Column, f: Field, little: bool) -> Typed:
    kind, size = f.number
    if kind == "f":
        return Typed(read_float(data, at, size, little), "float")
    return Typed((read_signed if kind == "s" or size == 8 else read_unsigned)(data, at, size, little).cast("bigint"), "int")


def _count(expression: str, scope: Mapping[str, Typed]) -> Column:
    """A size or count; null if it isn't a whole number of 0 or more."""
    n = compiled(expression, scope)
    if n.kind == "str":
        n = Typed(F.when(F.trim(n.column) == "", F.lit(0).cast("bigint")).otherwise(F.trim(n.column).try_cast("bigint")), "int")
    return F.when(n.column >= 0, n.column) if n.kind == "int" else F.lit(None).cast("bigint")


def _constant(expression: str | None) -> int | None:
    tree = parse(expression) if expression is not None else None
    return tree[1] if tree and tree[0] == "value" and isinstance(tree[1], int) and not isinstance(tree[1], bool) else None


def _one(layout: Layout, f: Field, data: Column, at: Column, scope: Mapping[str, Typed]) -> tuple[Typed, Column, Column]:
    """Value, size and error (or null) of a plain field at a place."""
    whole = F.octet_length(data).cast("bigint")
    early = F.lit(f"{layout.id}.{f.id}: the data end early")
    if f.number:
        size = F.lit(f.number[1]).cast("bigint")
        return _number(data, at.cast("int"), f, layout.little), size, F.when(at + size > whole, early)
    size = whole - at if f.eos else _count(f.size, scope) if f.size else F.lit(0).cast("bigint")
    part = F.substr(data, (at + 1).cast("int"), size.cast("int"))
    value = Typed(_decoded(part, f), "str") if f.type == "str" else Typed(part, "bytes")
    error = F.when(size.isNull(), F.lit(f"{layout.id}.{f.id}: {f.size} gives no count")).when((size < 0) | (at + size > whole), early)
    return value, size, error


def _item(layout: Layout, f: Field, data: Column, at: Column, scope: Mapping[str, Typed], kind: str) -> Column:
    """Struct of value, size and error of a field, plain or a structure of its own, at a place."""
    shown = lambda value, size, error: F.struct(value.cast(kind).alias("value"), size.alias("size"), error.alias("error"))
    if f.type not in layout.types:
        value, size, error = _one(layout, f, data, at, scope)
        return shown(_named(layout, f, value.column), size, error)
    inner = layout.types[f.type]
    if not f.size:
        return let(_record(inner, data, at, scope), lambda r: shown(r["value"], r["end"] - at, r["error"]))

    def sized(size: Column) -> Column:
        part = F.substr(data, F.lit(1), (at + size).cast("int"))
        wrong = F.when(size.isNull(), F.lit(f"{layout.id}.{f.id}: {f.size} gives no count"))
        return let(_record(inner, part, at, scope), lambda r: shown(r["value"], size, F.coalesce(wrong, r["error"])))

    return let(_count(f.size, scope), sized)


def _named(layout: Layout, f: Field, column: Column) -> Column:
    """A number by its name in the field's enumeration; one without a name as text."""
    if not f.enum or f.repeat or f.enum not in layout.enums:
        return column
    names = F.create_map(*[F.lit(x) for n, name in layout.enums[f.enum].items() for x in (n, name)])
    return F.coalesce(F.try_element_at(names, column.cast("int")), column.cast("string"))


def _shape(layout: Layout, outer: Mapping[str, Typed]) -> Typed:
    """The kinds of a definition's fields."""
    fields: dict[str, Typed] = {}
    for f in layout.fields:
        if f.number:
            one = Typed(_EMPTY, "float" if f.number[0] == "f" else "int")
        elif f.type in layout.types:
            one = _shape(layout.types[f.type], {**outer, **fields})
        else:
            one = Typed(_EMPTY, "str" if f.type == "str" else "bytes")
        if f.enum and not f.repeat and f.enum in layout.enums:
            one = Typed(_EMPTY, "str")
        fields[f.id] = Typed(_EMPTY, "list", one) if f.repeat else one
    return Typed(_EMPTY, "struct", None, fields)


def _sql_type(t: Typed) -> str:
    if t.kind == "list":
        return f"array<{_sql_type(t.item)}>"
    if t.kind == "struct":
        return "struct<" + ", ".join(f"`{k}`: {_sql_type(v)}" for k, v in t.fields.items()) + ">"
    return {"int": "bigint", "float": "double", "str": "string", "bool": "boolean", "bytes": "binary"}[t.kind]


def _repeated(layout: Layout, f: Field, data: Column, at: Column, scope: Mapping[str, Typed], shape: Typed) -> Column:
    """Struct of items, end and error of a repeated field, folded over places."""
    kind = _sql_type(shape)
    start = F.struct(at.cast("bigint").alias("at"), F.lit(None).cast(f"array<{kind}>").alias("items"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("done"))
    whole = F.octet_length(data).cast("bigint")
    none = F.lit(None).cast("string")
    wanted = _count(f.repeat_by, scope) if f.repeat == "expr" else None
    # Every item of an open repetition takes a byte at least; one that takes none ends it with an error.
    turns = F.least(wanted, whole + 1) if wanted is not None else F.greatest(whole - at, F.lit(0).cast("bigint"))
    bare = Field(f.id, f.type, f.size, f.eos, f.encoding)

    def step(a: Column, _: Column) -> Column:
        made = _item(layout, bare, data, a["at"], scope, kind)

        def after(m: Column) -> Column:
            last = F.lit(False)
            if f.repeat == "until":
                last = F.coalesce(compiled(f.repeat_by, {**scope, "_": shape.at(m["value"])}).column, F.lit(False))
            elif f.repeat == "eos":
                last = a["at"] + m["size"] >= whole
            stuck = F.when((m["size"] <= 0) & F.lit(f.repeat != "expr"), F.lit(f"{layout.id}.{f.id}: an item without bytes"))
            wrong = F.coalesce(m["error"], stuck)
            one = F.array(m["value"])
            return F.struct((a["at"] + m["size"]).alias("at"), F.when(a["items"].isNull(), one).otherwise(F.concat(a["items"], one)).alias("items"), wrong.alias("error"), (last | wrong.isNotNull()).alias("done"))

        return F.when(a["done"], a).otherwise(let(made, after))

    count = F.coalesce(turns, F.lit(0).cast("bigint")).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(places, start, step)
    empty = F.array().cast(f"array<{kind}>")

    def shown(a: Column) -> Column:
        unknown = F.when(wanted.isNull(), F.lit(f"{layout.id}.{f.id}: {f.repeat_by} gives no count")) if wanted is not None else none
        short = F.when(F.coalesce(F.array_size(a["items"]).cast("bigint"), F.lit(0)) < wanted, F.lit(f"{layout.id}.{f.id}: the data end early")) if wanted is not None else none
        return F.struct(F.coalesce(a["items"], empty).alias("items"), a["at"].alias("end"), F.coalesce(unknown, a["error"], short).alias("error"))

    return let(folded, shown)


def _record(layout: Layout, data: Column, at: Column, outer: Mapping[str, Typed]) -> Column:
    """Struct of value, place (start and length by field), end and error of a definition at a place."""
    shapes = _shape(layout, outer).fields
    return _fields(layout, list(layout.fields), data, _State({}, {}, at.cast("bigint"), F.lit(None).cast("string")), outer, shapes)


def _fields(layout: Layout, left: list[Field], data: Column, state: _State, outer: Mapping[str, Typed], shapes: Mapping[str, Typed]) -> Column:
    """The rest of a definition's fields; values that later ones need are bound once where the data decide."""
    while left:
        f, left = left[0], left[1:]
        scope = {**outer, **state.values}
        shape = shapes[f.id]
        kind = _sql_type(shape)
        steady = f.condition is None and not f.repeat and f.type not in layout.types and (f.number is not None or _constant(f.size) is not None)
        if steady:  # its place and size are known without its value
            value, _, error = _one(layout, f, data, state.at, scope)
            width = f.number[1] if f.number else _constant(f.size)
            failed = F.coalesce(state.error, error)
            held = shape.at(F.when(failed.isNull(), _named(layout, f, value.column).cast(kind)))
            state = _State({**state.values, f.id: held}, {**state.places, f.id: F.when(failed.isNull(), F.struct(state.at.alias("start"), F.lit(width).cast("bigint").alias("length")))}, state.at + width, failed)
            continue
        if f.repeat:
            at_now = state.at
            made = _repeated(layout, f, data, at_now, scope, shape.item)
            full = let(made, lambda r: F.struct(r["items"].alias("value"), (r["end"] - at_now).alias("size"), r["error"].alias("error")))
        else:
            full = _item(layout, f, data, state.at, scope, kind)
        nothing = F.lit(None).cast(f"struct<value: {kind}, size: bigint, error: string>")
        there = F.lit(True) if f.condition is None else F.coalesce(compiled(f.condition, scope).column, F.lit(True))
        chosen = F.when(there & state.error.isNull(), full).otherwise(nothing)
        given, before, rest, at, failed = state.values, state.places, left, state.at, state.error

        def bound(m: Column) -> Column:
            place = F.when(m.isNotNull() & m["error"].isNull(), F.struct(at.alias("start"), m["size"].alias("length")))
            after = F.coalesce(at + m["size"], at)
            return let(after, lambda end: _fields(layout, rest, data, _State({**given, f.id: shape.at(F.when(m["error"].isNull(), m["value"]))}, {**before, f.id: place}, end, F.coalesce(failed, m["error"])), outer, shapes))

        return let(chosen, bound)
    values = [t.column.cast(_sql_type(shapes[name])).alias(name) for name, t in state.values.items()]
    return F.struct(F.struct(*values).alias("value"), F.struct(*[c.alias(name) for name, c in state.places.items()]).alias("place"), state.at.alias("end"), state.error.alias("error"))


def record(layout: Layout, data: Column, at: int | Column = 0) -> Column:
    """Struct of a definition's fields in a binary column: value, place (start and length of each), end and error.

    An absent field has a null value and place; after an error the fields that follow are null.
    """
    start = F.lit(at) if isinstance(at, int) else at
    return let(data, lambda d: F.when(d.isNotNull(), _record(layout, d, start, {})))


def parsed(df: DataFrame, layout: Layout, data: str, to: str = "record") -> DataFrame:
    """``df`` with a definition's record of its binary column ``data`` in ``to``."""
    return df.withColumn(to, record(layout, F.col(data)))


def scope(columns: Mapping[str, tuple[Column, str]]) -> dict[str, Typed]:
    """Typed fields of Columns by name: (column, kind)."""
    cast = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean", "bytes": "binary"}
    return {name: Typed(c.cast(cast[kind]), kind) for name, (c, kind) in columns.items()}
