"""Language identification by rank-order profiles (operator 12).

A profile is the list of the most frequent n-grams, one to three characters of words
with a space at either end, by falling frequency.  Languages' profiles are counted over all
texts that teach; each task sums its own counts before they are shuffled.  A document's
profile is compared with every language's by the out-of-place distance: each of its
n-grams adds the difference of its two ranks, or the most that can be where the language's
profile lacks it.  The least distance wins.

An n-gram's code points are packed into one long, so n-grams are compared exactly.
Profiles are broadcast in blocks of ``BLOCK`` languages (``SIZE`` n-grams each); a table with more
languages is compared block by block, and the least distance over all blocks is kept.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is
every text if nothing teaches.  The score is the share of the greatest possible distance that
the prediction doesn't use: 1 for the very profile, 0 where nothing is common.  N-grams of
equal frequency are ordered by their code points; at equal distances the language that comes
first by name wins.  Letters are folded to lower case, marks belong to words, and whatever else parts
words.  Texts are read whole, long ones in pieces whose counts are merged.  Languages may have any
names but null.  Repeated rows get equal results, an empty table gives an empty one.  Extra columns
pass through, whatever their names, unless they carry a result's name, in which case the
result replaces them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, packed, text_or_empty, without_cycles

#: N-grams of a profile; longest n-gram.
SIZE, LONGEST = 400, 3
#: Languages whose profiles are broadcast together.
BLOCK = 500
#: Documents whose remainder is this one teach nothing.
HELD_OUT_OF, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Code points of a text that are counted in one go, and different n-grams that a task holds before it passes them on.
PIECE, HELD = 1 << 20, 1 << 21
_BITS = 21


class Grams:
    """Counts of a text's n-grams."""

    def __init__(self) -> None:
        self.kinds = np.zeros(0x110000, np.uint8)  # of code points: 0 not seen, 1 between words, 2 a mark, 3 a letter

    def kind(self, points: np.ndarray) -> np.ndarray:
        found = self.kinds[points]
        if not found.all():
            for p in np.unique(points[found == 0]):
                category = unicodedata.category(chr(p))[0]
                self.kinds[p] = {"L": 3, "M": 2}.get(category, 1)
            found = self.kinds[points]
        return found

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Different n-grams in rising order, and how often each stands; nothing for a text without letters."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
        parts, letters = [], False
        for start in range(0, max(1, len(points) - 1), PIECE):
            piece = points[start : start + PIECE + LONGEST - 1]
            kind = self.kind(piece)
            letters = letters or bool((kind == 3).any())
            part_of_word = kind > 1
            codes = np.where(part_of_word, piece, 32).astype(np.int64)
            own = min(PIECE, len(piece))  # n-grams that start in this piece
            found = [codes[:own][part_of_word[:own]]]
            two = codes[:-1] << _BITS | codes[1:]
            found.append(two[:own][(part_of_word[:-1] | part_of_word[1:])[:own]])
            three = codes[:-2] << 2 * _BITS | codes[1:-1] << _BITS | codes[2:]
            found.append(three[:own][part_of_word[1:-1][:own]])
            parts.append(np.unique(np.concatenate(found), return_counts=True))
        if not letters:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return parts[0] if len(parts) == 1 else merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    count = np.zeros(len(gram), np.int64)
    np.add.at(count, where, np.concatenate([c for _, c in parts]))
    return gram, count


def ranked(gram: np.ndarray, count: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent n-grams, falling; those of equal frequency by their code points."""
    return gram[np.argsort(-count, kind="stable")[:size]]


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, gram and n: how often each n-gram stands in all texts of a language."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Grams().counts
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def rows() -> Iterator[pd.DataFrame]:
            for name, parts in held.items():
                gram, count = merged(parts)
                yield pd.DataFrame({"lang": name, "gram": gram, "n": count})
            held.clear()

        for batch in batches:
            for name, body in zip(batch["lang"], batch["text"]):
                part = counts(body)
                held.setdefault(name, []).append(part)
                size += len(part[0])
                if size > HELD:
                    held.update({k: [merged(v)] for k, v in held.items()})
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > HELD // 2:
                        yield from rows()
                        size = 0
        yield from rows()

    teaching = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text_or_empty(text).alias("text"))
    return teaching.mapInPandas(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = SIZE) -> DataFrame:
    """lang, rank (from 0) and gram of each language's ``size`` most frequent n-grams."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    placed = gram_counts(docs, lang, text).withColumn("rank", F.row_number().over(order))
    return placed.where(F.col("rank") <= size).select("lang", (F.col("rank") - 1).alias("rank"), "gram")  # tasks cut their rows to ``size`` before the shuffle


class Comparer:
    """Distances of texts to a block of languages' profiles."""

    def __init__(self, names: list[str], grams: list[np.ndarray], size: int = SIZE):
        self.names, self.size, self.counts = names, size, Grams().counts
        self.known = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.int64)
        self.rank = np.full((len(self.known) + 1, len(names)), -1, np.int64)
        for i, g in enumerate(grams):
            self.rank[np.searchsorted(self.known, g), i] = np.arange(len(g))

    def nearest(self, text: str) -> tuple[str, float]:
        """Language of least distance, and the share of the greatest distance that it leaves."""
        own = ranked(*self.counts(text), self.size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, own)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != own)] = len(self.known)
        rank = self.rank[at]
        distance = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        return self.names[best], 1.0 - float(distance[best]) / (self.size * len(own))


def _nearest(shared, size: int):
    """A UDF of the nearest language in a broadcast block, and its score."""

    @F.pandas_udf("lang string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compared = Memo(Comparer(*shared.value, size).nearest, 300, 20_000)  # copies often stand close to each other

        def of(batch: pd.Series) -> pd.DataFrame:
            found = [compared[t] for t in batch]
            return pd.DataFrame({"lang": pd.Series([n for n, _ in found], dtype=object), "score": pd.Series([s for _, s in found], dtype="float64")})

        yield from without_cycles(batches, of)

    return nearest


def with_language(docs: DataFrame, found: DataFrame, text: str = "text", lang_to: str = "lang_pred", score_to: str = "score", size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """``docs`` with the predicted language of each whole text and its score; ``found`` is a table of ``profiles``."""
    spark = docs.sparkSession
    names = found.select("lang").distinct()
    blocks = max(1, -(-names.count() // block))
    numbered = names.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(blocks)))
    best = packed(docs).withColumn("best", F.lit(None).cast("struct<lang string, score double>"))
    for b in range(blocks):
        wanted = found.join(numbered.where(F.col("block") == b), "lang", "left_semi")
        lists = sorted((row.lang, [p.gram for p in sorted(row.p)]) for row in wanted.groupBy("lang").agg(F.collect_list(F.struct("rank", "gram")).alias("p")).collect())
        shared = spark.sparkContext.broadcast(([n for n, _ in lists], [np.array(g, np.int64) for _, g in lists]))  # some ``block`` languages of ``size`` numbers
        if not lists and blocks > 1:
            continue

        both = best.withColumn("here", _nearest(shared, size)(text_or_empty(f"row.`{text}`")))
        better = F.col("best").isNull() | (F.col("here.score") > F.col("best.score")) | ((F.col("here.score") == F.col("best.score")) & (F.col("here.lang") < F.col("best.lang")))
        best = both.select("row", F.when(better, F.col("here")).otherwise(F.col("best")).alias("best"))
    results = {lang_to: "best.lang", score_to: "best.score"}
    columns = [*docs.columns, *[c for c in results if c not in docs.columns]]
    return best.select(*[F.col(results.get(c, f"row.`{c}`")).alias(c) for c in columns])
