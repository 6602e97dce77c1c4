"""Benchmark decontamination by spaced-seed hashing (operator 6).

Fixed masks pick five of some neighbouring token positions and ignore the others, so a
seed survives substituted words (items of fewer than ten tokens have masks of four, those of fewer than five are one seed).  Seeds of the benchmark and of the training texts are
joined by their hash.  A hit names a diagonal: an item, a text and the shift between
them.  On every diagonal with a hit the two token sequences are compared position by
position over the item's whole length, and of all overlaps that begin and end with
equal tokens, have ``MIN_OVERLAP`` tokens or more (the whole item, if it is shorter) and
of which four in five agree, the one with most equal tokens is reported, then the
shortest, then the first.  If there is such an overlap, the text has a leak.

The masks were chosen so that every pattern of substitutions that still is a leak
is hit, from five to 24 tokens (tested for all patterns), so nothing is lost before the
comparison.  One tolerance holds for items of all lengths: four in five, so an item of five to nine tokens is found with one
word replaced inside it, and a shorter one as it is.

Seeds are counted first.  Up to ``BLOCK_SEEDS`` are broadcast; more are joined by a
shuffle behind a bitmap of bounded size, in one pass over the texts.  Texts are judged
once however many copies there are, and texts without hits don't move.

Defined results: tokens are runs of letters and digits, lower-cased; null or empty
texts have none and leak nothing.  Texts and items are read whole.  There is one row
for each different document (doc_id and text; null ids are documents, too) and item_id,
the best one where an item_id repeats.  Empty
tables give an empty result.  Extra columns are ignored by ``leaks`` and pass through
``without_leaks``, whatever their names; that keeps or drops rows by their text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, filter_bits, let, may_be_among, packed, spread_join, staged, text_or_empty

#: Which of some neighbouring tokens a seed is made of; the same for items of fewer than ``SHORT`` tokens, and of fewer than ``TINY``.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 2, 5, 6), (0, 1, 3, 6, 7))
SHORT, SHORT_MASKS = 10, ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
TINY = 5
WAYS = (*MASKS, *SHORT_MASKS, *[tuple(range(n)) for n in range(1, TINY)])
#: At least so many tokens, of which four in five agree.
MIN_OVERLAP = 13
#: Seeds that are broadcast, at most: a hash, an item and a place each.
BLOCK_SEEDS = 100_000


def tokens(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+"), "")


def _hashed(text: str) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _masked(way: Column, array: Column, at: Column, n: Column, ways: list[int]) -> Column:
    """The seed at a place by ``way``, one of ``ways``; null where its mask reaches beyond the end."""
    seed = F.lit(None).cast("long")
    for w in ways:
        made = F.xxhash64(F.lit(w), *[F.get(array, at + offset) for offset in WAYS[w]])
        seed = F.when((way == w) & (at + WAYS[w][-1] < n), made).otherwise(seed)
    return seed


def _items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item (number of an item), item_id, its tokens and n, one row per different item."""
    held = items.select(F.xxhash64(item_id, text).alias("item"), F.col(item_id).alias("item_id"), _hashed(text).alias("own"))
    return held.withColumn("n", F.size("own")).where("n > 0").distinct()


def seeds_of(held: DataFrame) -> DataFrame:
    """seed, item, at (place) and way (number of the mask) of each seed of each item of ``_items``."""
    first = len(MASKS) + len(SHORT_MASKS)
    some = lambda numbers: F.array(*[F.lit(w) for w in numbers])
    ways = F.when(F.col("n") >= SHORT, some(range(len(MASKS)))).when(F.col("n") >= TINY, some(range(len(MASKS), first))).otherwise(F.array(F.col("n") + first - 1))
    placed = held.select("item", "own", "n", F.explode(ways).alias("way")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    return placed.select(_masked(F.col("way"), F.col("own"), F.col("at"), F.col("n"), list(range(len(WAYS)))).alias("seed"), "item", "at", "way").where("seed IS NOT NULL")


def _diagonals(docs: DataFrame, seeds: DataFrame, text: str) -> DataFrame:
    """node (digest of a text), item and shift of each diagonal with a seed in common."""
    total, used = seeds.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("way"))).first()  # of len(WAYS) ways
    ways = max(1, len(used))
    hashed = docs.select(digest(text).alias("node"), _hashed(text).alias("t")).withColumn("len", F.size("t")).where("len > 0")
    placed = hashed.select("node", "t", "len", F.explode(F.sequence(F.lit(0), F.col("len") * ways - 1)).alias("k"))
    at = F.expr(f"k div {ways}").cast("int")
    way = F.get(F.array(*[F.lit(w) for w in used or [0]]), F.col("k") % ways)
    placed = placed.select("node", at.alias("p"), _masked(way, F.col("t"), at, F.col("len"), used).alias("seed"))
    sought = seeds.select("seed", "item", "at")
    if total <= BLOCK_SEEDS:
        hits = placed.join(F.broadcast(sought), "seed")  # at most BLOCK_SEEDS rows
    else:
        likely = may_be_among(placed.where("seed IS NOT NULL"), F.col("seed"), sought, bits=filter_bits(total)).where("_maybe").drop("_maybe")
        hits = spread_join(staged(likely, "likely-seeds"), sought, ["seed"])
    return hits.select("node", "item", (F.col("p") - F.col("at")).alias("shift")).distinct()


def _best(doc: Column, own: Column, shift: Column) -> Column:
    """agreed, overlap and place of the best overlap on a diagonal; null if there is no leak.

    Overlaps begin and end where runs of equal tokens do.  With surplus for 5 x equal - 4 x all
    tokens up to a place, four in five agree if the surplus at its end is not less than at its
    start; for starts from left to right, the farthest such end only moves right.
    """
    first = F.greatest(F.lit(0), -shift)  # the item's first token that has a partner
    last = F.least(F.size(own), F.size(doc) - shift) - 1
    equal = F.transform(F.sequence(first, last), lambda k: F.get(own, k) == F.get(doc, k + shift))
    least = F.least(F.size(own), F.lit(MIN_OVERLAP))
    edges = lambda g, other: F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda k: F.get(g, k) & ~F.coalesce(F.get(g, k + other), F.lit(False)))

    def of_runs(starts: Column, ends: Column) -> Column:
        runs = F.size(starts)
        zero = F.array(F.lit(0))
        upto = F.aggregate(F.sequence(F.lit(0), runs - 1), zero, lambda sums, k: F.concat(sums, F.array(F.get(sums, k) + F.get(ends, k) - F.get(starts, k) + 1)))

        def of_sums(upto: Column) -> Column:
            begins = F.transform(starts, lambda s, k: F.get(upto, k) * 5 - s * 4)
            stops = F.transform(ends, lambda e, k: F.get(upto, k + 1) * 5 - (e + 1) * 4)
            later = F.aggregate(F.reverse(stops), F.array().cast("array<int>"), lambda most, x: F.concat(F.array(F.greatest(x, F.coalesce(F.get(most, 0), x))), most))

            def step(s: Column, begins: Column, stops: Column, later: Column) -> Column:
                i, j = s["i"], s["j"]
                on = (i < runs) & (j < runs)
                right = on & (F.get(later, j) >= F.get(begins, i))
                agreed, size = F.get(upto, j + 1) - F.get(upto, i), F.get(ends, j) - F.get(starts, i) + 1
                better = right & (F.get(stops, j) >= F.get(begins, i)) & (size >= least) & ((agreed > s["agreed"]) | ((agreed == s["agreed"]) & (size < s["overlap"])))
                return F.struct(
                    F.when(on & ~right, i + 1).otherwise(i).alias("i"), F.when(right, j + 1).otherwise(j).alias("j"), F.when(better, agreed).otherwise(s["agreed"]).alias("agreed"),
                    F.when(better, size).otherwise(s["overlap"]).alias("overlap"), F.when(better, first + F.get(starts, i) + shift).otherwise(s["place"]).alias("place"),
                )

            start = F.struct(*[F.lit(0).alias(c) for c in ("i", "j", "agreed", "overlap", "place")])
            shown = lambda s: F.when(s["agreed"] > 0, F.struct(s["agreed"].alias("agreed"), s["overlap"].alias("overlap"), s["place"].alias("place")))
            walked = lambda b, e, m: F.aggregate(F.sequence(F.lit(1), runs * 2), start, lambda s, _: step(s, b, e, m), shown)
            return let(begins, lambda b: let(stops, lambda e: let(later, lambda m: walked(b, e, m))))

        return F.when(runs > 0, let(upto, of_sums))

    judged = lambda g: let(edges(g, -1), lambda starts: let(edges(g, 1), lambda ends: of_runs(starts, ends)))
    return F.when(last - first + 1 >= least, let(equal, judged))


def _leaky_texts(docs: DataFrame, items: DataFrame, text: str, item_text: str, item_id: str) -> DataFrame:
    """node, item_id, overlap, agreed and place of each text that leaks an item."""
    held = staged(_items(items, item_id, item_text), "benchmark-items")
    seeds = staged(seeds_of(held), "benchmark-seeds")
    found = staged(_diagonals(docs, seeds, text), "diagonals")
    nodes = found.select("node").distinct()
    texts = may_be_among(docs.select(digest(text).alias("node"), F.col(text).alias("text")), F.xxhash64("node"), nodes).where("_maybe").drop("_maybe")
    texts = texts.dropDuplicates(["node"]).select("node", _hashed("text").alias("t"))
    joined = spread_join(found, texts, ["node"]).join(held.select("item", "item_id", "own"), "item")
    judged = joined.select("node", "item_id", _best(F.col("t"), F.col("own"), F.col("shift")).alias("o")).where("o IS NOT NULL")
    best = F.max_by("o", F.struct("o.agreed", F.negate("o.overlap"), F.negate("o.place"))).alias("o")
    return judged.groupBy("node", "item_id").agg(best).select("node", "item_id", "o.overlap", "o.agreed", "o.place")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, overlap (tokens), agreed (equal ones) and place (first token in the document) of the best overlap of each leak."""
    found = staged(_leaky_texts(docs, items, text, item_text, item_id), "leaky-texts")
    likely = may_be_among(docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("node")), F.xxhash64("node"), found.select("node")).where("_maybe").drop("_maybe")
    return spread_join(staged(likely.distinct(), "leaky-documents"), found, ["node"]).drop("node")


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` without the rows whose text holds a leak."""
    found = staged(_leaky_texts(docs, items, text, item_text, item_id).select("node").distinct(), "leaky-texts")
    marked = may_be_among(packed(docs).withColumn("node", digest(f"row.`{text}`")), F.xxhash64("node"), found)
    judged = spread_join(staged(marked.where("_maybe").select("row", "node"), "likely-leaky"), found, ["node"], "left_anti")
    return marked.where(~F.col("_maybe")).select("row").unionByName(judged.select("row")).select("row.*")
