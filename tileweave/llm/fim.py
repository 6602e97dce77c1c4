"""Fill-in-middle transformation on a piece table (operator 13).

A document is a list of descriptors (buffer, start, length) over two immutable buffers,
the bytes of its text and those of the sentinels.  Cutting splits a descriptor in two, an
arrangement permutes descriptors and puts sentinels between them, and bytes are only
copied when a result is written; digests are streamed descriptor by descriptor.
Restoring makes a piece table over the output, cuts it at the sentinels, and applies the
inverse permutation.

Cuts stand after lines and are drawn from a digest of the seed and the document's id, so a
document's form doesn't depend on its neighbours, on partitions or on attempts.

Defined results: a null text counts as empty, and the empty text stays plain, as does one
that contains a sentinel (it couldn't be restored).  A null id is drawn as an empty one.
Texts are read whole, as bytes; a line ends with its ``\\n``.  Repeated rows get equal
results, an empty table gives an empty one.  Extra columns pass through, whatever their
names, unless they carry a result's name, in which case the result replaces them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, with_results

SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Forms but ``plain``: the parts (0 prefix, 1 middle, 2 suffix) in the output's order.
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: The sentinel that stands before each part.
_BEFORE = (0, 2, 1)
TEXT, MARKS = 0, 1


@dataclass(frozen=True)
class Piece:
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over immutable buffers; every change makes a new table over the same buffers."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, buffers: tuple[bytes, ...], pieces: list[Piece] | None = None):
        self.buffers = buffers
        self.pieces = [Piece(TEXT, 0, len(buffers[TEXT]))] if pieces is None else pieces

    def cut(self, at: int) -> PieceTable:
        """The table with a descriptor boundary at ``at`` bytes; a boundary may stand between descriptors already, then an empty one joins."""
        out, place, done = [], 0, False
        for p in self.pieces:
            if not done and place <= at <= place + p.length:
                out += [Piece(p.buffer, p.start, at - place), Piece(p.buffer, p.start + at - place, p.length - at + place)]
                done = True
            else:
                out.append(p)
            place += p.length
        return PieceTable(self.buffers, out)

    def permuted(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def marked(self, before: list[Piece]) -> PieceTable:
        """The table with a descriptor of ``before`` ahead of each of its own."""
        return PieceTable(self.buffers, [x for pair in zip(before, self.pieces) for x in pair])

    def unmarked(self) -> PieceTable:
        return PieceTable(self.buffers, self.pieces[1::2])

    def views(self) -> Iterator[memoryview]:
        for p in self.pieces:
            yield memoryview(self.buffers[p.buffer])[p.start : p.start + p.length]

    def digest(self) -> str:
        """SHA-256 of the bytes, streamed descriptor by descriptor."""
        state = hashlib.sha256()
        for view in self.views():
            state.update(view)
        return state.hexdigest()

    def written(self) -> bytes:
        return b"".join(self.views())

    def characters(self, i: int) -> int:
        """Code points of a descriptor: its bytes but those that continue one."""
        p = self.pieces[i]
        held = np.frombuffer(self.buffers[p.buffer], np.uint8, p.length, p.start) if p.length else np.empty(0, np.uint8)
        return int(np.count_nonzero((held & 0xC0) != 0x80))


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(sorted(range(len(order)), key=order.__getitem__))


def line_ends(text: bytes) -> np.ndarray:
    """Places in bytes after each line; the last line may have no line break."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.append(ends, len(text)) if text and not text.endswith(b"\n") else ends


def draws(doc_id: str, seed: int = SEED) -> list[int]:
    """The document's four draws of 32 bits."""
    found = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return [int.from_bytes(found[i : i + 4], "big") for i in range(0, 16, 4)]


@dataclass
class Arranged:
    table: PieceTable
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None


def arranged(doc_id: str, text: bytes, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, sentinels: tuple[str, str, str] = SENTINELS) -> Arranged:
    """The document's table in its drawn form."""
    marks = [s.encode() for s in sentinels]
    ends = line_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    table = PieceTable((text, b"".join(marks)))
    if not text or any(m in text for m in marks) or h3 % 100 >= fim_percent:
        return Arranged(table, n, "plain", None, None)
    form = "spm" if h4 % 100 < spm_percent else "psm"
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    place = lambda units: int(ends[units - 1]) if units else 0
    cut = table.cut(place(high)).cut(place(low))
    starts = np.cumsum([0, *map(len, marks)])
    order = ARRANGEMENTS[form]
    before = [Piece(MARKS, int(starts[_BEFORE[part]]), len(marks[_BEFORE[part]])) for part in order]
    return Arranged(cut.permuted(order).marked(before), n, form, cut.characters(0), cut.characters(1))


def restored(output: bytes, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> PieceTable:
    """The table of the exact text, from an output and its form alone."""
    table = PieceTable((output,))
    if form == "plain":
        return table
    order = ARRANGEMENTS[form]
    at = 0
    for part in order:
        mark = sentinels[_BEFORE[part]].encode()
        at = output.index(mark, at)
        table = table.cut(at).cut(at + len(mark))
        at += len(mark)
    # An empty piece of the cut at 0, then sentinel and part in turn.
    return PieceTable(table.buffers, table.pieces[1:]).unmarked().permuted(inverse(order))


#: Texts that a task holds in several forms at once.
AT_ONCE = 500


def _parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[tuple[pd.Series, pd.Series]]:
    for a, b in batches:
        for i in range(0, len(a), AT_ONCE):
            yield a[i : i + AT_ONCE], b[i : i + AT_ONCE]


def with_fim(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """``df`` with n (lines), form, prefix_chars, middle_chars, output (text) and output_sha256."""

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output binary, output_sha256 string")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in _parts(batches):
            found = [arranged(i, t, seed, fim_percent, spm_percent, sentinels) for i, t in zip(ids, texts)]
            yield pd.DataFrame({
                "n": pd.Series([a.n for a in found], dtype="int64"), "form": pd.Series([a.form for a in found], dtype=object),
                "prefix_chars": pd.array([a.prefix_chars for a in found], dtype="Int64"), "middle_chars": pd.array([a.middle_chars for a in found], dtype="Int64"),
                "output": pd.Series([a.table.written() for a in found], dtype=object), "output_sha256": pd.Series([a.table.digest() for a in found], dtype=object),
            })

    found = made(text_or_empty(doc_id), text_or_empty(text).cast("binary"))
    names = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    both = with_results(df, found, names)
    return both.withColumn("output", F.col("output").cast("string"))


def with_restored(df: DataFrame, output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``df`` with restored (the exact text, rebuilt from output and form) and restored_sha256; a null form counts as plain."""

    @F.pandas_udf("restored binary, restored_sha256 string")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in _parts(batches):
            found = [restored(o, f, sentinels) for o, f in zip(outputs, forms)]
            yield pd.DataFrame({"restored": pd.Series([t.written() for t in found], dtype=object), "restored_sha256": pd.Series([t.digest() for t in found], dtype=object)})

    found = made(text_or_empty(output).cast("binary"), F.coalesce(F.col(form), F.lit("plain")))
    return with_results(df, found, ["restored", "restored_sha256"]).withColumn("restored", F.col("restored").cast("string"))
