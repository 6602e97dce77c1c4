"""Token counts (operator 1): greedy longest-match word pieces by a linear automaton.

The vocabulary's byte trie gets a failure link and a count of popped tokens per node.
Reading a piece's bytes once then gives the number of tokens of its greedy
longest-match-first split; no token is ever built.  A piece that no sequence of
tokens covers counts as one unknown token.

Defined results: a null text counts as empty and has no tokens; texts are never cut;
repeated rows get equal counts, an empty table an empty result; extra columns pass through unless they carry a
result's name, in which case the result replaces them.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONGEST_KEPT, MEMO_ENTRIES, read_ranks
from .common import Memo, text_or_empty, with_results, without_cycles

_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


class LongestMatchCounter:
    """Counts the tokens of greedy longest matches without listing them."""

    def __init__(self, vocabulary, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        step: dict[int, int] = {}
        ends, parent_of = [False], [(0, 0)]
        for token in vocabulary:
            at = 0
            for byte in token:
                key = at << 8 | byte
                if (to := step.get(key)) is None:
                    to = step[key] = len(ends)
                    ends.append(False)
                    parent_of.append((at, byte))
                at = to
            ends[at] = at > 0
        children: dict[int, list[int]] = {}
        for node in range(1, len(ends)):
            children.setdefault(parent_of[node][0], []).append(node)
        fail, popped = [-1] * len(ends), [0] * len(ends)
        queue = deque(children.get(0, []))
        while queue:
            node = queue.popleft()
            queue.extend(children.get(node, []))
            if ends[node]:
                fail[node], popped[node] = 0, 1
                continue
            above, byte = parent_of[node]
            at, count = fail[above], popped[above]
            while at >= 0 and (at << 8 | byte) not in step:
                count += popped[at]
                at = fail[at]
            if at >= 0:
                fail[node], popped[node] = step[at << 8 | byte], count
        self.step, self.fail, self.popped = step, fail, popped
        self.runs = Memo(self._run, MEMO_ENTRIES)

    def count_piece(self, data: bytes) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        at = count = 0
        for byte in data:
            while (to := step.get(at << 8 | byte, -1)) < 0:
                if (back := fail[at]) < 0:
                    return 1
                count += popped[at]
                at = back
            at = to
        while at:
            if (back := fail[at]) < 0:
                return 1
            count += popped[at]
            at = back
        return count

    def _run(self, run: str) -> tuple[int, int]:
        pieces = self.split(run)
        return len(pieces), sum(self.count_piece(p.encode()) for p in pieces)

    def count(self, text: str) -> tuple[int, int]:
        """Number of pieces of the split pattern and of tokens in the whole text."""
        pieces = tokens = lead = 0
        for run in _SAFE_CUT.split(text):
            run = " " + run if lead else run
            lead = 1
            p, t = self.runs[run] if len(run) <= LONGEST_KEPT else self._run(run)
            pieces += p
            tokens += t
        return pieces, tokens


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> LongestMatchCounter:
    return LongestMatchCounter(read_ranks(path), pattern)


def with_token_counts(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_pieces`` and ``n_tokens`` of each whole text."""

    @F.pandas_udf("n_pieces long, n_tokens long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = counter(path, pattern).count
        yield from without_cycles(batches, lambda batch: pd.DataFrame([of(t) for t in batch], columns=["n_pieces", "n_tokens"], dtype="int64"))

    return with_results(df, counted(text_or_empty(text)), ["n_pieces", "n_tokens"])
