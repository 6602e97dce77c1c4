"""Near-duplicate detection by ProbMinHash, banding and verification (operator 2).

Every text is a weighted set of shingles of five words; a shingle weighs 1 + ln(occurrences).
Each shingle's arrivals form a Poisson process whose rate is its weight; an arrival falls
on a random slot, and a slot keeps the shingle that arrives first.  A shingle stops
as soon as its next arrival is later than the latest slot, so long texts cost about
one arrival a shingle.  Two texts agree in a slot with the probability that is
their probability Jaccard: over the common shingles d, the sum of 1 / sum over all shingles e of max(x_e / x_d, y_e / y_d).

Slots are cut into bands.  Texts that share a band are candidates: each is held against
one of its bands' first texts, then against those of other classes.  Then all pairs across
classes among the texts of bands that hold several classes are compared, whatever a
band's size, save those that exact filters (prefixes of sets, bits of their parity) show to
be unlike, so no link of two texts that share a band is missed.  A link is a pair whose probability Jaccard
is ``SIMILARITY`` or more, computed exactly from the weights of the whole texts: what the sketches estimate is
what links are decided by.  For texts that repeat no shingle it is the Jaccard similarity of their sets.  Classes are the connected components.

Equal texts are one node from the start.  Bands are aggregated, never gathered.  The
sets of texts that share a band are made once and stored; keys that hold much of a
table are dealt out to several tasks in every join.

Defined results: words are runs of letters, digits and underscores, lower-cased; a
text of fewer than five words is one shingle; a text without words (null counts as
empty) is like equal texts only.  The class id is the least doc_id of the class (null
only if all are), and that document stays; repeated rows of it count as one.  An empty
table gives an empty result.  Extra columns, whatever their names, pass through
``without_near_copies`` as they are; ``near_classes`` ignores them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, digest, dropped, filter_bits, may_be_among, packed, spread_join, staged, text_or_empty, without_cycles
from .components import components, joined_components

WORDS, SIMILARITY = 5, 0.8
#: Bands of so many slots: a pair at the threshold is missed by all bands once in 300,000 times.
BANDS, ROWS = 42, 6
SLOTS = BANDS * ROWS
#: Bits of a set's mark.
MARK_BITS = 512
#: Shingles of texts that are sketched in one go.
TOGETHER = 1 << 17
#: Texts whose sets a task passes on in one go.
AT_ONCE = 500
_WORD = re.compile(r"\w+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of a text's shingles."""

    def __init__(self) -> None:
        import xxhash

        self.words = Memo(lambda w: xxhash.xxh3_64_intdigest(w), 60_000)

    def shingles(self, text: str) -> np.ndarray:
        coded = np.array([self.words[w] for w in _WORD.findall(text.lower())], dtype=np.uint64)
        if not len(coded):
            return coded
        n = max(1, len(coded) - WORDS + 1)
        total = np.zeros(n, np.uint64)
        for i in range(min(WORDS, len(coded))):
            total += coded[i : i + n] * _FACTORS[i]
        return _mix(total)


def weighed(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles in rising order, and how often each occurs."""
    one, times = np.unique(shingles, return_counts=True)
    return one, times.astype(np.uint32)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """Of each weighted set (``weighed``) the shingle that arrives first in each slot; the sets must not be empty and should be of like sizes."""
    element = np.concatenate([one for one, _ in sets])
    owner = np.repeat(np.arange(len(sets)), [len(one) for one, _ in sets])
    rate = 1.0 + np.log(np.concatenate([times for _, times in sets]))
    first = np.full(len(sets) * slots, np.inf)
    holder = np.zeros(len(sets) * slots, np.uint64)
    clock, drawn = np.zeros(len(element)), 0
    while len(element):
        many = max(1, -(-2 * slots * len(sets) // len(element)))  # arrivals drawn at once for each shingle
        ticks = _GOLDEN * np.arange(drawn + 1, drawn + many + 1, dtype=np.uint64)
        random = _mix(element[:, None] + ticks[None, :])
        arrival = clock[:, None] + np.cumsum(-np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / rate[:, None]
        slot = (owner[:, None] * slots + (_mix(random ^ _GOLDEN) % np.uint64(slots)).astype(np.int64)).ravel()
        flat = arrival.ravel()
        np.minimum.at(first, slot, flat)
        won = np.flatnonzero(flat == first[slot])
        holder[slot[won]] = element[won // many]
        clock, drawn = arrival[:, -1], drawn + many
        going = clock < first.reshape(-1, slots).max(axis=1)[owner]
        element, rate, clock, owner = element[going], rate[going], clock[going], owner[going]
    return holder.reshape(-1, slots)


def signature(shingles: np.ndarray, slots: int = SLOTS) -> np.ndarray | None:
    """The shingle that arrives first in each slot; nothing for no shingles."""
    return signatures([weighed(shingles)], slots)[0] if len(shingles) else None


def bands_of(sketches: np.ndarray) -> np.ndarray:
    """One key for each band of each sketch."""
    keys = (sketches.reshape(-1, BANDS, ROWS) * _FACTORS[:ROWS]).sum(axis=2, dtype=np.uint64) + _GOLDEN * np.arange(1, BANDS + 1, dtype=np.uint64)
    return _mix(keys).view(np.int64)


def bands_of_texts(texts, shingles) -> list[np.ndarray]:
    """Bands of each text; texts of like length are sketched together, ``TOGETHER`` shingles at once."""
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    waiting: dict[int, tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]] = {}

    def sketch(size: int) -> None:
        at, sets = waiting.pop(size)
        for i, keys in zip(at, bands_of(signatures(sets))):
            found[i] = keys

    for i, text in enumerate(texts):
        held = weighed(shingles(text))
        if len(held[0]):
            size = len(held[0]).bit_length()
            at, sets = waiting.setdefault(size, ([], []))
            at.append(i)
            sets.append(held)
            if len(at) >= max(1, TOGETHER >> size):
                sketch(size)
    for size in list(waiting):
        sketch(size)
    return found


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node (digest of the text) and bands of each document."""

    @F.pandas_udf("array<long>")
    def bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingles = Shingler().shingles

        def of(batch: pd.Series) -> pd.Series:
            different = batch.drop_duplicates()  # copies often stand close to each other
            keys = dict(zip(different, bands_of_texts(different, shingles)))
            return pd.Series([keys[t] for t in batch], dtype=object)

        yield from without_cycles(batches, of)

    return docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("node"), bands(text_or_empty(text)).alias("bands"))


def parity_mark(shingles: np.ndarray) -> np.ndarray:
    """``MARK_BITS`` bits, each the parity of the shingles that fall on it, as longs: two marks differ in no more bits than their sets in shingles."""
    odd = np.bincount((shingles & np.uint64(MARK_BITS - 1)).astype(np.int64), minlength=MARK_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """node, n, set (sorted shingles), counts (of them; null if all are 1), even (whether they are), norm (sum of the weights) and mark of the texts whose digests are in ``nodes``."""

    @F.pandas_udf("set array<long>, counts array<int>, even boolean, norm double, mark array<long>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingles = Shingler().shingles

        def of(batch: pd.Series) -> pd.DataFrame:
            sets = [weighed(shingles(t)) for t in batch]
            return pd.DataFrame({
                "set": [s.view(np.int64) for s, _ in sets], "counts": pd.Series([c.astype(np.int32) if (c > 1).any() else None for _, c in sets], dtype=object),
                "even": [bool((c == 1).all()) for _, c in sets], "norm": [float((1.0 + np.log(c)).sum()) for _, c in sets], "mark": [parity_mark(s) for s, _ in sets],
            })

        yield from without_cycles((batch[i : i + AT_ONCE] for batch in batches for i in range(0, len(batch), AT_ONCE)), of)

    likely = may_be_among(docs.select(digest(text).alias("node"), text_or_empty(text).alias("text")), F.xxhash64("node"), nodes).where("_maybe").drop("_maybe")
    wanted = likely.dropDuplicates(["node"]).join(nodes, "node", "left_semi")
    return wanted.select("node", held("text").alias("h")).select("node", F.size("h.set").alias("n"), "h.set", "h.counts", "h.even", "h.norm", "h.mark")


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard of two sets of sorted shingles and their weights.

    For a common shingle of weights (x, y) the inner sum is 1 / x times the sum of max(x_e, y_e x / y): shingles whose
    ratio of weights is greater count with their first weight, others with their second one.
    """
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    u, v = x[i], y[j]
    ratio = u / v
    order = np.argsort(ratio, kind="stable")
    u, v, ratio = u[order], v[order], ratio[order]
    from_here = np.cumsum(u[::-1])[::-1]
    before = np.concatenate([[0.0], np.cumsum(v)[:-1]])
    inner = (x.sum() - u.sum()) + from_here + ratio * (y.sum() - v.sum() + before)
    return float((u / inner).sum())


def _of(df: DataFrame, side: str) -> DataFrame:
    """``df`` with its node called ``side`` and its other columns named after it."""
    return df.withColumnsRenamed({c: f"{side}_{c}" for c in df.columns if c != "node"}).withColumnRenamed("node", side)


def _marks_allow(x: str, y: str):
    """Whether two texts can be similar enough by their marks and sums of weights (see ``possible_pairs``)."""
    differ = sum(F.bit_count(F.get(f"{x}_mark", i).bitwiseXOR(F.get(f"{y}_mark", i))) for i in range(MARK_BITS // 64))
    total = F.col(f"{x}_norm") + F.col(f"{y}_norm")
    sets = differ <= total * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 2e-6
    return F.when(F.col(f"{x}_even") & F.col(f"{y}_even"), sets).otherwise(differ <= F.greatest(f"{x}_norm", f"{y}_norm") * (1 / SIMILARITY - 1) + 1e-6)


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``sets`` of both ends; only sets of a pair's end move."""
    bits = filter_bits(pairs.count())
    likely = lambda side: may_be_among(sets, F.xxhash64("node"), pairs, F.xxhash64(side), bits).where("_maybe").drop("_maybe")
    return spread_join(pairs, _of(likely("a"), "a"), ["a"]).join(_of(likely("b"), "b"), "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose ``sets`` (see ``shingle_sets``) are similar enough; ``pairs`` should be a table.

    Pairs that their marks exclude are told without their sets.  Of the rest, pairs of texts without repeated shingles
    are compared as sets in the JVM, the others with their weights.
    """
    flags = sets.select("node", "even", "norm", "mark")
    told = spread_join(pairs.select("a", "b"), _of(flags, "a"), ["a"]).join(_of(flags, "b"), "b").where(_marks_allow("a", "b"))
    told = staged(told.select("a", "b", (F.col("a_even") & F.col("b_even")).alias("even")), "told-pairs")
    even, odd = told.where("even").drop("even"), told.where("NOT even").drop("even")

    both = with_sets(even, sets.where("even").select("node", "n", "set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    alike = (F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * SIMILARITY) & (common >= (F.col("a_n") + F.col("b_n") - common) * SIMILARITY)
    found = both.where(alike).select("a", "b")
    if odd.isEmpty():
        return found

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights = lambda s, c: np.ones(len(s)) if c is None else 1.0 + np.log(np.asarray(c))
        for batch in batches:
            yield pd.Series([probability_jaccard(a, weights(a, x), b, weights(b, y)) >= SIMILARITY - 1e-12 for a, x, b, y in zip(*batch)], dtype="bool")

    both = with_sets(odd, sets.select("node", "set", "counts"))
    return found.unionByName(both.where(near("a_set", "a_counts", "b_set", "b_counts")).select("a", "b"))


def possible_pairs(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``apart`` (node, root) of different roots, without those whose ``sets`` can't be similar enough.

    If shares p and q of two texts' weights lie outside what they have in common, their probability Jaccard is
    1 / (1 + p) + 1 / (1 + q) - 1 at most.  Shingles are put in one order, rare ones first; what stands before the first
    common one lies outside, which bounds p and q by its place in either text, and their marks differ in
    (1 / S - 1) of the greater sum of weights at most, S being the similarity; two texts of x and y shingles, none of them
    repeated, have S / (1 + S) (x + y) in common at least.  The conditions of the join are exact, however many
    texts share a shingle.
    """
    id_ = F.xxhash64("node").alias("id")
    texts = staged(apart.join(sets.select("node", "even", "norm", "mark"), "node").select(id_, "node", "root", "even", "norm", "mark"), "apart-texts")
    # A count, null for one, travels with a shingle; its share of the text's weights is made of it where the text is together again.
    pieces = F.transform("set", lambda x, i: F.struct(x.alias("shingle"), F.nullif(F.get("counts", i), F.lit(1)).alias("count")))
    likely = may_be_among(sets.select("node", "set", "counts"), F.xxhash64("node"), apart, bits=filter_bits(apart.count())).where("_maybe").join(apart, "node", "left_semi")
    rows = staged(likely.select(id_, F.explode(pieces).alias("p")).select("id", "p.shingle", "p.count"), "apart-shingles")
    # Shingles that one text alone holds join nothing; they stand first in the order.
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    weight = 1.0 + F.log(F.coalesce("count", F.lit(1)))
    from_here = F.sum(weight).over(Window.partitionBy("id").orderBy(F.desc("holders"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0))
    placed = spread_join(rows, shared, ["shingle"]).select("id", "shingle", from_here.alias("weight")).join(texts, "id")
    placed = placed.withColumn("rest", F.col("weight") / F.col("norm"))  # share of the weights from this shingle on
    firsts = placed.where(F.col("rest") >= 2 - 1 / SIMILARITY - 1e-9).select("node", "root", "even", "norm", "mark", "rest", "shingle")  # with nothing outside on the other side
    firsts = staged(firsts, "first-shingles")
    dropped(texts, rows)
    # Nothing is compared within the class that holds a shingle most often.
    hubs = firsts.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("holders")).groupBy("shingle").agg(F.max(F.struct("holders", "root"))["root"].alias("hub"), F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes")
    named = lambda df, side: df.withColumnsRenamed({c: f"{side}_{c}" for c in ("node", "root", "even", "norm", "mark", "rest")})
    x, y = named(spread_join(firsts, hubs, ["shingle"]).where("root <> hub"), "x"), named(firsts, "y")
    alike = 1 / (2 - F.col("x_rest")) + 1 / (2 - F.col("y_rest")) >= 1 + SIMILARITY - 1e-9
    # Of texts that repeat no shingle the common part is as heavy in both, which says more.
    common = (F.col("x_norm") + F.col("y_norm")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    both_even = F.least(F.col("x_rest") * F.col("x_norm"), F.col("y_rest") * F.col("y_norm")) >= common
    alike = F.when(F.col("x_even") & F.col("y_even"), both_even).otherwise(alike) & _marks_allow("x", "y")
    met = spread_join(staged(x, "first-shingles"), y, ["shingle"]).where(((F.col("y_root") == F.col("hub")) | (F.col("x_root") < F.col("y_root"))) & alike)
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def with_root(rows: DataFrame, roots: DataFrame, name: str, to: str) -> DataFrame:
    """``rows`` with the root of the node in column ``name``; a node without one is its own."""
    found = spread_join(rows, roots.select(F.col("node").alias(name), F.col("root").alias(to)), [name], "left")
    return found.withColumn(to, F.coalesce(to, name))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node, class_id, class_size (documents) and kept, one row per document."""
    base = staged(sketched(docs, doc_id, text), "sketches")
    # Every band of every text moves once, with 64 bits of the text's digest; the digests move with bands that several texts share.
    ids = base.select(F.xxhash64("node").alias("id"), F.explode("bands").alias("band"))
    shared = staged(ids.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("band"), "shared-bands")
    places = base.select("node", F.explode("bands").alias("band"))
    likely = staged(may_be_among(places, F.col("band"), shared, bits=filter_bits(shared.count())).where("_maybe").drop("_maybe").distinct(), "likely-members")
    heads = likely.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").drop("last")
    members = staged(spread_join(likely, heads, ["band"]), "band-members")
    dropped(likely, shared)
    sets = staged(shingle_sets(docs, members.select("node").distinct(), text), "shingle-sets")
    # Each text against the least of its bands' first texts, then against those of other classes.
    pairs = staged(members.where("node <> head").groupBy(F.col("node").alias("b")).agg(F.min("head").alias("a")), "pairs")
    roots = staged(components(verified(pairs, sets)), "roots")
    rooted = staged(with_root(members, roots, "node", "root"), "rooted-members")
    other = with_root(rooted, roots, "head", "head_root").where("root <> head_root").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    more = staged(other.join(pairs, ["a", "b"], "left_anti"), "pairs")
    dropped(rooted)
    roots = joined_components(roots, staged(verified(more, sets), "links"))
    # Whatever that left apart: every pair across classes of the bands that hold several, if it can be similar enough.
    rooted = staged(with_root(members.select("band", "node"), roots, "node", "root"), "rooted-members")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("band")
    apart = staged(spread_join(rooted, mixed, ["band"], "left_semi").select("node", "root").distinct(), "apart")
    if not apart.isEmpty():
        tested = pairs.select("a", "b").unionByName(more)
        new = staged(possible_pairs(apart, sets).join(tested, ["a", "b"], "left_anti"), "pairs")
        roots = joined_components(roots, staged(verified(new, sets), "links"))
    dropped(members, sets, pairs, more, rooted, apart)
    rooted = staged(with_root(base.select("doc_id", "node"), roots, "node", "root"), "rooted")
    classes = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).getField("node").alias("keeper")).where("class_size > 1")
    joined = spread_join(rooted, classes, ["root"], "left")
    alone = F.col("class_size").isNull()
    return joined.select(
        "doc_id", "node", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("keeper")))).alias("kept"),
    )


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class, all columns as they are."""
    gone = staged(near_classes(docs, doc_id, text).where(~F.col("kept")).select(F.xxhash64("doc_id", "node").alias("key"), F.col("doc_id").alias("gone"), "node").distinct(), "near-copies")
    rows = packed(docs).withColumn("node", digest(f"row.`{text}`")).withColumn("key", F.xxhash64(F.col(f"row.`{doc_id}`"), "node"))
    marked = may_be_among(rows, F.col("key"), gone, bits=filter_bits(gone.count()))
    safe = marked.where(~F.col("_maybe")).select("row")
    told = marked.where("_maybe").select("row", "node").alias("r").join(gone.alias("g"), (F.col("r.node") == F.col("g.node")) & F.col(f"r.row.`{doc_id}`").eqNullSafe(F.col("g.gone")), "left_anti")
    return safe.unionByName(told.select("row")).select("row.*")


def estimated_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of slots in which two signatures agree: an estimate of the probability Jaccard."""
    return float(np.mean(a == b)) if len(a) else math.nan
