import pytest
from hypothesis import given
from hypothesis import strategies as st

from tileweave.structure.codec import StructureError, fitted, member, parsed_records, read, record, records, split_by_size, to_json, write
from tileweave.structure.expression import ExpressionError, evaluate
from tileweave.structure.layout import LayoutError, Registry, load

LAYOUT = """
meta: {id: demo, endian: be}
seq:
  - {id: N, type: str, size: 3, encoding: BCS-NPI}
  - {id: items, type: item, repeat: expr, repeat-expr: N.to_i}
  - {id: flag, type: u1}
  - {id: extra, type: u2, if: flag == 1}
  - {id: rest, size-eos: true}
types:
  item:
    seq:
      - {id: size, type: u1}
      - {id: body, type: str, size: size}
"""


@pytest.mark.parametrize(("text", "value"), [
    ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("-7 / 2", -3), ("-7 % 3", -1), ("7 / 2.0", 3.5), ("1 << 3 + 1", 9), ("6 & 3 | 8", 10), ("5 ^ 1", 4), ("~5", -6),
    ("a == 'x' and b > 2", True), ("a == 1", False), ("a != 1", True), ("not (b < 2) or c", True), ("' 12 '.to_i + 1", 13), ("a + 'y'", "xy"), ("list[1]", 20), ("list.length", 2), ("s.strip.length", 2), ("0x1F", 31), ("inner.v", 4),
])
def test_expressions(text, value):
    fields = {"a": "x", "b": 3, "c": False, "list": [10, 20], "s": " hi ", "inner": {"v": 4}}
    assert evaluate(text, fields) == value


@pytest.mark.parametrize("text", ["1 +", "nope", "1 / 0", "1 % 0", "'a' < 'b'", "1 and true", "''.to_i", "1 << 64", "list[5]", "1 2", "$"])
def test_bad_expressions(text):
    with pytest.raises(ExpressionError):
        evaluate(text, {"list": [1]})


def test_short_circuit():
    assert evaluate("false and nope", {}) is False
    assert evaluate("true or nope", {}) is True


def test_read_write_identity():
    layout = load(LAYOUT)
    values = {"n": 2, "items": [{"size": 2, "body": "ab"}, {"size": 0, "body": ""}], "flag": 1, "extra": 515, "rest": b"tail"}
    data = write(layout, values)
    offsets: dict = {}
    got, end = read(layout, data, 0, offsets)
    assert end == len(data) and got["N"] == "002" and got["extra"] == 515 and member(got, "items.body") == ["ab", ""]
    assert offsets["extra"] == (8, 2)
    assert write(layout, got) == data
    del values["extra"]
    assert "extra" not in read(layout, write(layout, values | {"flag": 0}))[0]


def test_missing_and_short():
    layout = load(LAYOUT)
    with pytest.raises(StructureError):
        write(layout, {"N": 0})
    with pytest.raises(StructureError):
        read(layout, b"001\x05ab")
    with pytest.raises(LayoutError):
        load({"meta": {"id": "x"}, "seq": [{"id": "a", "type": "nowhere"}]})


@given(st.lists(st.tuples(st.text("ABCDEF0123456789", min_size=1, max_size=6), st.binary(max_size=40)), max_size=8))
def test_records_round_trip(items):
    assert records(b"".join(record(t, d) for t, d in items)) == items


def test_split_keeps_later_small_records():
    items = [("A", b"x" * 50), ("B", b"x" * 80), ("C", b"x" * 10)]
    fits, over = split_by_size(items, 100)
    assert [t for t, _ in fits] == ["A", "C"] and [t for t, _ in over] == ["B"]


def test_registry_and_records():
    registry = Registry({"tre_demo": load(LAYOUT)})
    data = record("DEMO", b"000\x00zz") + record("OTHER", b"\xff\x00") + record("DEMO", b"000\x00yy")
    parsed = parsed_records(data, registry)
    assert parsed["OTHER"] == {"_raw": "ff00", "_length": 2} and parsed["DEMO"]["rest"] == "yy"
    registry.add(" Demo ", {"meta": {"id": "d"}, "seq": [{"id": "all", "size-eos": True}]})
    assert parsed_records(data, registry)["DEMO"] == {"all": "000\x00yy"}
    assert registry.names() == ["demo", "tre_demo"]


def test_json_and_fields():
    assert to_json({"a": "x  ", "b": b"\xff", "c": float("nan"), "d": [1.5]}) == {"a": "x", "b": "ff", "d": [1.5]}
    assert fitted(5, 3, "0") == b"005" and fitted(-5, 4, "0") == b"-005" and fitted("ab", 4) == b"ab  " and fitted(3.14159, 4) == b"3.14"
    with pytest.raises(StructureError):
        fitted(12345, 3)


def test_builtin_records():
    from tileweave.structure.tagged import TAGGED

    sizes = {name: sum(int(f.size) * int(f.repeat_by or 1) for f in layout.fields) for name, layout in TAGGED.items()}
    assert sizes == {"RPC00B": 1041, "ICHIPB": 224, "BLOCKA": 123, "USE00A": 107, "AIMIDB": 89, "STDIDC": 89}
    values = {f.id: ["+0.0"] * 20 if f.repeat else 1 for f in TAGGED["RPC00B"].fields}
    got = parsed_records(record("RPC00B", write(TAGGED["RPC00B"], values)), Registry(TAGGED))["RPC00B"]
    assert got["LINE_OFF"] == "000001" and got["SAMP_DEN_COEFF"][19] == "+0.0"
