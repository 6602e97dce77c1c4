"""Exact deduplication by content-defined chunk recipes (operator 9).

A normalised text is cut into lines (overlong lines into cells); a line whose hash
has its low bits clear ends a chunk, so boundaries follow the content.  Hashes are
counted; the bytes of those that occur again move once, to the group of their hash,
where they are compared: a hash with one text is a verified identifier, and where
several texts share a hash the chunk itself stands beside it.  Documents are then
compared by their ordered lists of identifiers, which are short however long the
documents are.

Defined results: a null text counts as empty, and all empty texts are equal.  Texts
are equal when identical after lower-casing A-Z only.  Of equal texts the row with
the largest doc_id stays; repeated rows with that very doc_id all report it, and all
of them count as kept.  A null doc_id never stays while another doc_id is there.  An
empty table gives an empty result.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, dropped, filter_bits, let, may_be_among, spread_join, staged, text_or_empty

#: A line with its end, or a cell of an overlong line.
PIECE = r"[^\n]{0,1023}\n|[^\n]{1,1024}"
#: A chunk ends at a line whose hash has these bits clear: eight lines on average.
BOUNDARY_BITS = 7


def normalised(text: str = "text") -> Column:
    return F.translate(text_or_empty(text), UPPER, LOWER)


def _chunks(norm: Column) -> Column:
    """Chunks whose concatenation is the text."""

    def cut(pieces: Column) -> Column:
        n = F.size(pieces)
        marks = F.transform(pieces, lambda piece: F.xxhash64(piece).bitwiseAND(F.lit(BOUNDARY_BITS)) == 0)
        ends = F.when(n > 0, let(marks, lambda m: F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.get(m, i - 1)))).otherwise(F.array().cast("array<int>"))

        def joined(at: Column) -> Column:
            start = lambda k: F.when(k > 0, F.get(at, k - 1)).otherwise(0)
            return F.transform(at, lambda end, k: F.array_join(F.slice(pieces, start(k) + 1, end - start(k)), ""))

        return let(ends, joined)

    return let(F.regexp_extract_all(norm, F.lit(PIECE), F.lit(0)), cut)


def recipes(docs: DataFrame, keep: list[str], text: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """``keep`` columns, ``text_sha256`` and ``recipe``: equal recipes if and only if equal texts."""
    cut = docs.select(*keep, normalised(text).alias("norm"))
    cut = cut.select(*keep, F.sha2("norm", 256).alias("text_sha256"), _chunks(F.col("norm")).alias("chunks"))
    hashes = F.transform("chunks", lambda c: hash_of(c).cast("bigint"))
    named = staged(cut.select(*keep, "text_sha256", hashes.alias("recipe")), "recipes")
    # Only the bytes of hashes that occur again move to be compared.
    again = staged(named.select(F.explode("recipe").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated-hashes")
    rows = cut.select(F.explode("chunks").alias("chunk")).select(hash_of("chunk").cast("bigint").alias("hash"), "chunk")
    likely = may_be_among(rows, F.col("hash"), again, bits=filter_bits(again.count())).where("_maybe").select("hash", "chunk")
    shared = staged(likely.distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "shared-hashes")
    dropped(again)
    if shared.isEmpty():
        return named
    # Where texts share a hash, the identifier is the hash with the chunk itself beside it.
    marked = staged(cut.select(*keep, "text_sha256", hashes.alias("recipe"), "chunks").withColumn("_row", F.monotonically_increasing_id()), "shared-recipes")
    rows = marked.select("_row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("hash", hash_of("chunk").cast("bigint"))
    told = rows.join(shared.select("hash"), "hash", "left_semi").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("told"))
    return staged(marked.join(told, "_row", "left").withColumn("recipe", F.struct("recipe", "told")).drop("_row", "told", "chunks"), "recipes")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    named = recipes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", hash_of)
    groups = named.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    joined = spread_join(named, groups, ["recipe"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(F.col("doc_id").alias(doc_id), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
