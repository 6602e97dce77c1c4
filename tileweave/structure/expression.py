"""The expression language of structure definitions.

Precedence from loose to tight: or; and; comparisons; |; ^; &; + -; * / % << >>; not,
- and ~; methods (to_i, to_s, length, strip), members and indexes.  Integer division
truncates toward zero, and a remainder has the dividend's sign.  Values of different
kinds are never equal, and only numbers are ordered.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import lru_cache

_LEX = re.compile(r"\s*(?:(0[xX][0-9a-fA-F_]+|\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(<<|>>|<=|>=|==|!=|[-+*/%<>|^&~().\[\],]))")
_LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">="), ("|",), ("^",), ("&",), ("+", "-"), ("*", "/", "%", "<<", ">>"))


class ExpressionError(ValueError):
    """A malformed expression, an unknown field, or operands of the wrong kind."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _LEX.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character in {text!r} at {at}")
        out.append((("number", "text", "name", "op")[m.lastindex - 1], m[m.lastindex]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.text = _tokens(text), 0, text

    def next(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.next(wanted):
            raise ExpressionError(f"{wanted!r} is missing in {self.text!r}")

    def level(self, i: int = 0):
        if i == len(_LEVELS):
            return self.unary()
        left = self.level(i + 1)
        while op := self.next(*_LEVELS[i]):
            left = ("binary", op, left, self.level(i + 1))
        return left

    def unary(self):
        if op := self.next("not", "-", "~"):
            return ("unary", op, self.unary())
        return self.postfix()

    def postfix(self):
        node = self.primary()
        while True:
            if self.next("."):
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name":
                    raise ExpressionError(f"a name is missing in {self.text!r}")
                self.at += 1
                if self.next("("):
                    self.need(")")
                node = ("member", name, node)
            elif self.next("["):
                node = ("index", node, self.level())
                self.need("]")
            else:
                return node

    def primary(self):
        if self.next("("):
            node = self.level()
            self.need(")")
            return node
        if self.at == len(self.tokens):
            raise ExpressionError(f"{self.text!r} ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return ("value", float(value) if "." in value else int(value.replace("_", ""), 0 if value[:2].lower() == "0x" else 10))
        if kind == "text":
            return ("value", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "name":
            return ("value", value == "true") if value in ("true", "false") else ("name", value)
        raise ExpressionError(f"unexpected {value!r} in {self.text!r}")


@lru_cache(maxsize=4096)
def parse(text: str):
    """Syntax tree of an expression."""
    parser = _Parser(text)
    tree = parser.level()
    if parser.at != len(parser.tokens):
        raise ExpressionError(f"{text!r} goes on after its end")
    return tree


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _same(a, b) -> bool:
    if _number(a) and _number(b):
        return a == b if isinstance(a, int) and isinstance(b, int) else abs(a - b) < 2.220446049250313e-16
    return type(a) is type(b) and a == b


def _ints(op: str, a, b) -> None:
    if not (_number(a) and _number(b) and isinstance(a, int) and isinstance(b, int)):
        raise ExpressionError(f"{op} needs integers")


def _apply(op: str, a, b):
    if op in ("==", "!="):
        return _same(a, b) == (op == "==")
    if op == "+" and isinstance(a, str) and isinstance(b, str):
        return a + b
    if op in ("|", "^", "&", "%", "<<", ">>"):
        _ints(op, a, b)
        if op == "%":
            if b == 0:
                raise ExpressionError("remainder of a division by zero")
            return abs(a) % abs(b) * (-1 if a < 0 else 1)
        if op in ("<<", ">>") and not 0 <= b < 64:
            raise ExpressionError("a shift beyond 63 bits")
        return a | b if op == "|" else a ^ b if op == "^" else a & b if op == "&" else a << b if op == "<<" else a >> b
    if not (_number(a) and _number(b)):
        raise ExpressionError(f"{op} needs numbers")
    if op == "/":
        if b == 0:
            raise ExpressionError("division by zero")
        return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1) if isinstance(a, int) and isinstance(b, int) else a / b
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


def _method(name: str, v):
    if name == "to_i":
        if isinstance(v, str):
            try:
                return int(v.strip())
            except ValueError:
                raise ExpressionError(f"{v!r} is no integer") from None
        if _number(v):
            return int(v)
    elif name == "to_s":
        return v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    elif name in ("length", "size") and isinstance(v, (str, bytes, list)):
        return len(v)
    elif name == "strip" and isinstance(v, str):
        return v.strip()
    if isinstance(v, Mapping):
        if name in v:
            return v[name]
        raise ExpressionError(f"no field {name}")
    raise ExpressionError(f"{name} of {type(v).__name__}")


def evaluate(text: str, fields: Mapping):
    """Value of an expression over the fields read so far."""

    def of(node):
        kind = node[0]
        if kind == "value":
            return node[1]
        if kind == "name":
            if node[1] not in fields:
                raise ExpressionError(f"no field {node[1]}")
            return fields[node[1]]
        if kind == "member":
            return _method(node[1], of(node[2]))
        if kind == "index":
            whole, at = of(node[1]), of(node[2])
            if not isinstance(whole, list) or not isinstance(at, int) or not 0 <= at < len(whole):
                raise ExpressionError("an index out of range")
            return whole[at]
        if kind == "unary":
            v = of(node[2])
            if node[1] == "not" and isinstance(v, bool):
                return not v
            if node[1] == "-" and _number(v):
                return -v
            if node[1] == "~" and isinstance(v, int) and not isinstance(v, bool):
                return ~v
            raise ExpressionError(f"{node[1]} of {type(v).__name__}")
        op, left = node[1], of(node[2])
        if op in ("and", "or"):
            if not isinstance(left, bool):
                raise ExpressionError(f"{op} needs booleans")
            if left == (op == "or"):
                return left
            right = of(node[3])
            if not isinstance(right, bool):
                raise ExpressionError(f"{op} needs booleans")
            return right
        return _apply(op, left, of(node[3]))

    return of(parse(text))
