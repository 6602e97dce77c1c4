"""Byte-level BPE encoding and decoding (operator 10).

Bytes are mapped to Latin-1 so that one Aho-Corasick automaton over the vocabulary
finds every token in a piece.  The encoder takes the longest match at each place and
backtracks to shorter prefixes, accepting a token only if it is compatible with the
one before: merging the two tokens' bytes by rank must give just those two.  That
relation is memoised, so a piece costs linear time, and the result equals the one
that the merges give.

Defined results: a null text counts as empty; the empty text has no tokens and its
digests are those of the empty string.  Texts are never cut.  Repeated rows get
equal results, an empty table an empty one, and extra columns pass through unless they carry a result's name,
in which case the result replaces them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, text_or_empty, with_results, without_cycles

#: A space between two visible characters always starts a piece, whatever stands before it.
_SAFE_CUT = re.compile(r" (?<=\S )(?=\S)")
#: Entries of a memo's generation: pieces and runs (of no more than ``LONGEST_KEPT`` characters), pairs of tokens.
MEMO_ENTRIES, MEMO_PAIRS = 150_000, 400_000
LONGEST_KEPT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes by rank from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE: join the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class BytePairCodec:
    """Encoder and decoder for one vocabulary of ranks and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes_of, self.said_of, self.length, self.shorter = [b""] * size, [""] * size, [0] * size, [-1] * size
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
            self.bytes_of[i], self.said_of[i], self.length[i] = token, str(i), len(token)
            self.shorter[i] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        self.automaton.make_automaton()
        self.compatible = Memo(self._compatible, MEMO_PAIRS)
        self.halves = Memo(self._halves, 100_000)
        self.pieces = Memo(self._piece, MEMO_ENTRIES, LONGEST_KEPT)
        self.runs = Memo(lambda run: self._run(" " + run), MEMO_ENTRIES, LONGEST_KEPT)

    def _halves(self, token: int) -> tuple[int, ...]:
        """The tokens whose merge gives ``token``: two, or another number if no last merge does."""
        lower = {t: i for t, i in self._inside(self.bytes_of[token]) if i < token}
        return tuple(merge_by_rank(self.bytes_of[token], lower)) if self.length[token] > 1 else (token,)

    def _inside(self, data: bytes):
        return ((part, self.ranks[part]) for n in range(1, len(data)) for i in range(len(data) - n + 1) if (part := data[i : i + n]) in self.ranks)

    def _compatible(self, pair: int) -> bool:
        """Whether merging the bytes of both tokens gives just these tokens.

        A token's edge towards the other grew by merges of rising rank.  Stepping back
        through both edges in time, no pair across the border may have a rank at which
        it would have been merged before either side grew on; at equal ranks the
        leftmost merge comes first.
        """
        left, right = whole = pair >> 32, pair & 0xFFFFFFFF
        left_next = right_next = 1 << 60  # rank of the merge that used the part up
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < left_next and across <= right_next:
                return False
            if self.length[left] == self.length[right] == 1:
                return True
            back_left = self.length[left] > 1 and (left > right or self.length[right] == 1)
            halves = self.halves[left if back_left else right]
            if len(halves) != 2:
                return merge_by_rank(self.bytes_of[whole[0]] + self.bytes_of[whole[1]], self.ranks) == [*whole]
            if back_left:
                left_next, left = left, halves[1]
            else:
                right_next, right = right, halves[0]

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one piece of the split pattern."""
        data = piece.encode("utf-8")
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        length, shorter, compatible, longest, mapped = self.length, self.shorter, self.compatible, self.automaton.iter_long, data.decode("latin-1")
        # The longest match at each place; where neighbours don't go together, the search goes on from there.
        found = [token for _, token in longest(mapped)]
        if sum([length[t] for t in found]) != len(data):
            raise ValueError("the vocabulary lacks a byte of this piece")
        n, last = 0, found[0]
        for token in found[1:]:
            n += 1
            if not compatible[last << 32 | token]:
                break
            last = token
        else:
            return found
        token = shorter[token]
        del found[n:]
        at, shut = sum([length[t] for t in found]), set()  # shut: places from which no way leads on
        while at < len(data):
            last = found[-1] if found else -1
            while token >= 0:
                end = at + length[token]
                if end not in shut and (last < 0 or compatible[last << 32 | token]):
                    break
                token = shorter[token]
            if token >= 0:
                found.append(token)
                at = end
                if at < len(data):
                    token = next(longest(mapped, at))[1]
            else:
                shut.add(at)
                token = found.pop()
                at -= length[token]
        return found

    def _piece(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece)).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids, four bytes each, of some whole pieces."""
        pieces = self.split(run)
        return self.pieces[pieces[0]] if len(pieces) == 1 else b"".join([self.pieces[p] for p in pieces])

    def encode(self, text: str) -> list[int]:
        first, *rest = _SAFE_CUT.split(text)
        ids = array("I", self._run(first))
        ids.frombytes(b"".join(map(self.runs.__getitem__, rest)))
        return ids.tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids and digest of the bytes that they decode to."""
        ids = self.encode(text)
        shown = " ".join(map(self.said_of.__getitem__, ids))
        return len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec per worker process, kept between tasks."""
    return BytePairCodec(read_ranks(path), pattern)


def with_token_ids(df: DataFrame, path: str, pattern: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """``df`` with the array of token ids of each whole text in column ``to``."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = codec(path, pattern).encode
        yield from without_cycles(batches, lambda batch: pd.Series([encode(t) for t in batch], dtype=object))

    return df.withColumn(to, ids(text_or_empty(text)))


def with_decoded(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for in column ``to``; null ids give no bytes."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = codec(path, pattern).decode
        yield from without_cycles(batches, lambda batch: pd.Series([decode(i) for i in batch], dtype=object))

    return df.withColumn(to, decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def with_token_digest(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = codec(path, pattern).digest
        yield from without_cycles(batches, lambda batch: pd.DataFrame([of(t) for t in batch], columns=["n_tokens", "ids_sha256", "decoded_sha256"]))

    return with_results(df, digest(text_or_empty(text)), ["n_tokens", "ids_sha256", "decoded_sha256"])
