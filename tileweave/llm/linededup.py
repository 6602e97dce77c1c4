"""Line deduplication by content-defined line chunks (operator 8).

Lines are hashed, and a rolling hash runs over the hashes of two neighbouring lines.
Where it is a multiple of ``CUT`` a chunk ends: boundaries follow two lines alone, so what stands before doesn't shift
them.  Chunks of ``LINES`` lines or more that stand at an earlier place (doc_id, then
place), too, are removed, after a comparison of their lines' bytes.

A repeated passage starts and ends inside chunks, and a short one holds no whole chunk.
So what is left is extended line by line: any ``LINES`` neighbouring lines that aren't inside a
removed chunk are compared in the same way.  A window inside a removed
chunk stands in the chunk's first copy as well, so nothing is lost by leaving those out, and each
bulk of copies is compared chunk by chunk, once.  Together: every run of ``LINES`` lines
or more that stands at an earlier place is removed, wherever boundaries fall.  Runs must stand
there as a whole: lines whose neighbours differ in all other places stay, however often they occur.

Lines are folded at every ``WIDTH`` words, as a page would fold them, so a paragraph on one line
is compared as several; only lines that are removed from end to end go.

A text is read once for the hashes of its lines; chunks and windows are made of these.  The lines of all pieces
that occur again are then compared by their bytes, each different line once for each task: should two lines share a
hash, they are told apart by their bytes and the pieces are cut again.

Defined results: a null text counts as empty and stays null; the empty text is one
blank line and keeps it.  Blank lines are in no chunk; those inside a removed run go
along.  Repeated rows (same doc_id and text) are one document: they keep and lose the
same lines.  A null doc_id comes first; at equal doc_ids the hash of the text decides.  A
text that loses all its lines becomes empty.  An empty table gives an empty result.  Time is linear
in the lines of a text.  Extra columns pass through, whatever their names, but ``n_lines`` and
``n_removed`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, filter_bits, let, may_be_among, packed, spread_join, staged, text_or_empty

#: Words after which a line is folded, lines of the least run that is removed, and lines of a mean chunk.
WIDTH, LINES, CUT = 16, 3, 4


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n")) == ""


def _units(text: Column) -> Column:
    """Folded lines of a text that aren't blank."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"(?:[^ \\n]*+ ){{{WIDTH}}}|[^\\n]+"), F.lit(0)), lambda u: ~_blank(u))


def _folded(text: Column) -> Column:
    """line (its number), part (of it) and parts of each of ``_units``."""
    def of(line: Column, i: Column) -> Column:
        return let(F.size(_units(line)), lambda n: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(i.alias("line"), k.alias("part"), n.alias("parts"))))

    return F.flatten(F.transform(_lines(text), of))


def _piece(hashes: Column, start: Column, end: Column) -> Column:
    """A piece: its first and last folded line, the hashes of its lines, and one of all of them."""
    own = F.slice(hashes, start + 1, end - start + 1)
    return F.struct(start.alias("start"), end.alias("end"), own.alias("lines"), F.xxhash64(own).alias("hash"))


def _chunks(hashes: Column) -> Column:
    """Every chunk of ``LINES`` lines or more."""
    gaps = F.when(F.size(hashes) > 1, F.sequence(F.lit(0), F.size(hashes) - 2)).otherwise(F.array().cast("array<int>"))
    ends = F.concat(F.filter(gaps, lambda j: F.pmod(F.xxhash64(F.get(hashes, j), F.get(hashes, j + 1)), F.lit(CUT)) == 0), F.array(F.size(hashes) - 1))
    spans = let(ends, lambda ends: F.transform(ends, lambda e, n: F.struct(F.coalesce(F.get(ends, n - 1) + 1, F.lit(0)).alias("start"), e.alias("end"))))
    many = F.filter(spans, lambda s: s["end"] - s["start"] >= LINES - 1)
    return F.transform(many, lambda s: _piece(hashes, s["start"], s["end"]))


def _windows(hashes: Column, removed: Column) -> Column:
    """As ``_chunks``, for every ``LINES`` neighbouring lines that don't all lie inside one run of ``removed`` (sorted starts and ends)."""
    # Starts of windows: those from the end of one removed chunk to the start of the next, windows that reach into either included.
    last = F.size(hashes) - LINES
    nth = lambda n, side, otherwise: F.coalesce(F.get(removed, n)[side], otherwise)
    between = F.transform(
        F.sequence(F.lit(0), F.coalesce(F.array_size(removed), F.lit(0))),
        lambda n: F.struct(F.when(n == 0, F.lit(0)).otherwise(nth(n - 1, "end", F.lit(0)) - LINES + 2).alias("from"), F.least(nth(n, "start", last + 1) - 1, last).alias("to")),
    )
    starts = F.flatten(F.transform(F.filter(between, lambda s: s["from"] <= s["to"]), lambda s: F.sequence(s["from"], s["to"])))
    return F.transform(starts, lambda j: _piece(hashes, j, j + LINES - 1))


def _repeated(sketches: DataFrame, pieces: Column, name: str) -> DataFrame:
    """key, start, end and owner (the first place) of the pieces whose hash occurs again."""
    rows = sketches.select("key", F.explode(pieces).alias("p")).select("key", "p.*")
    often = staged(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), f"repeated-{name}")
    likely = staged(may_be_among(rows, F.col("hash"), often, bits=filter_bits(often.count())).where("_maybe").drop("_maybe"), f"likely-{name}")
    again = likely.groupBy("hash", "lines").agg(F.min(F.struct("key", "start")).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = staged(spread_join(likely, again, ["hash", "lines"]), f"found-{name}")
    dropped(often, likely)
    return found


def _sharing(texts: DataFrame, pieces: DataFrame, hash_of) -> DataFrame | None:
    """hash and bytes of the lines of ``pieces`` whose hash other bytes have, too; nothing if there are none.

    Copies of a line meet in their tasks before they move.
    """
    hashes = staged(pieces.select(F.explode("lines").alias("hash")).distinct(), "compared-hashes")
    lines = texts.select(F.explode(_units(F.col("body"))).alias("u"))
    compared = may_be_among(lines, hash_of(F.col("u")), hashes, F.col("hash"), filter_bits(hashes.count())).where("_maybe")
    different = compared.select(hash_of(F.col("u")).alias("hash"), "u").distinct()
    shared = staged(different.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "shared-hashes")
    told = None if shared.isEmpty() else staged(different.join(shared, "hash", "left_semi"), "shared-hashes")
    dropped(hashes, shared)
    return told


def _runs(pieces: DataFrame, join: bool) -> DataFrame:
    """key and runs (sorted starts and ends) of pieces; ``join``: runs that overlap or touch are one."""
    if join:
        before = Window.partitionBy("key").orderBy("start", "end")
        open_ = pieces.withColumn("reached", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
        island = F.sum(F.when(F.col("start") <= F.col("reached") + 1, 0).otherwise(1)).over(before)
        pieces = open_.withColumn("island", island).groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))  # no more than a document's lines


def _with_runs(keyed: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``keyed`` (key, ...) that may have runs, with them, and the others, which needn't move."""
    marked = may_be_among(keyed, F.xxhash64("key"), runs, bits=filter_bits(runs.count()))
    found = marked.where("_maybe").drop("_maybe").join(runs.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")), "left").drop("of")
    return found, marked.where(~F.col("_maybe")).drop("_maybe")


def _key(doc_id: str, text: str) -> Column:
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(text_or_empty(text)).alias("hash"))


RUNS = "array<struct<start:int,end:int>>"


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """key (of a document) and runs (of its folded lines) that stand at an earlier place."""
    texts = docs.select(_key(doc_id, text).alias("key"), text_or_empty(text).alias("body"))
    named = None
    while True:
        sketches = staged(_sketches(texts, hash_of, named), "line-hashes")
        chunks = _repeated(sketches, _chunks(F.col("hashes")), "chunks")
        later = lambda found: found.where(~F.struct("key", "start").eqNullSafe(F.col("owner"))).select("key", "start", "end").distinct()
        whole = staged(_runs(later(chunks), False), "removed-chunks")
        found, others = _with_runs(sketches, whole)
        left = found.unionByName(others.withColumn("runs", F.lit(None).cast(RUNS)))
        windows = _repeated(left, _windows(F.col("hashes"), F.col("runs")), "windows")
        both = chunks.unionByName(windows)
        shared = None if named is not None else _sharing(texts, both, hash_of)
        if shared is None:
            break
        # Different lines share a hash: such lines are named by their bytes, and the pieces cut again.
        named = shared
        dropped(sketches, chunks, whole, windows)
    gone = staged(_runs(later(both), True), "removed-runs")
    dropped(sketches, chunks, whole, windows)
    return gone


def _sketches(texts: DataFrame, hash_of, named: DataFrame | None) -> DataFrame:
    """key and hashes of the folded lines; lines among ``named`` (hash, u) get a number of their own instead of their hash."""
    if named is None:
        return texts.select("key", F.transform(_units(F.col("body")), lambda u: hash_of(u)).alias("hashes"))
    own = named.select("u", F.concat_ws("\0", "hash", "u").alias("name"))  # a name holds the bytes, so it is unlike all others
    lines = texts.select("key", F.posexplode(_units(F.col("body"))).alias("j", "u"))
    told = lines.join(own, "u", "left").select("key", "j", F.when(F.col("name").isNull(), hash_of(F.col("u"))).otherwise(F.xxhash64(F.lit(1), "name")).alias("h"))
    return told.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("j", "h"))).alias("hs")).select("key", F.transform("hs", lambda x: x["h"]).alias("hashes"))


def without_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines_to: str = "n_lines", removed_to: str = "n_removed") -> DataFrame:
    """``docs`` with ``text`` freed of repeated runs of lines, and numbers of lines in ``lines_to`` and ``removed_to``."""
    keyed = packed(docs).withColumn("key", _key(f"row.`{doc_id}`", f"row.`{text}`"))
    found, whole = _with_runs(keyed, repeated_runs(docs, doc_id, text))
    body = text_or_empty(f"row.`{text}`")

    def of_lines(held: Column) -> Column:
        """Runs of whole lines: a line that is cut inside stays."""
        first = lambda x: F.when(x["part"] == 0, x["line"]).otherwise(x["line"] + 1)
        last = lambda x: F.when(x["part"] == x["parts"] - 1, x["line"]).otherwise(x["line"] - 1)
        spans = F.transform("runs", lambda r: F.struct(first(F.get(held, r["start"])).alias("start"), last(F.get(held, r["end"])).alias("end")))
        return F.filter(spans, lambda r: r["start"] <= r["end"])

    cut = found.select("row", "runs", F.when(F.col("runs").isNotNull(), let(_folded(body), of_lines)).alias("gone"), _lines(body).alias("lines"))
    n = F.array_size("gone")
    between = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((F.coalesce(F.get("gone", k - 1)["end"], F.lit(-1)) + 1).alias("from"), F.coalesce(F.get("gone", k)["start"], F.size("lines")).alias("to")))
    kept = F.array_join(F.flatten(F.transform(between, lambda s: F.slice("lines", s["from"] + 1, s["to"] - s["from"]))), "\n")
    removed = F.aggregate("gone", F.lit(0), lambda a, r: a + r["end"] - r["start"] + 1).cast("long")
    cut = cut.select("row", F.when(n > 0, kept).otherwise(F.col(f"row.`{text}`")).alias("kept"), F.size("lines").cast("long").alias("lines"), F.coalesce(removed, F.lit(0)).alias("removed"))
    whole = whole.select("row", F.col(f"row.`{text}`").alias("kept"), F.size(_lines(body)).cast("long").alias("lines"), F.lit(0).cast("long").alias("removed"))
    result = {text: F.col("kept"), lines_to: F.col("lines"), removed_to: F.col("removed")}
    names = [*docs.columns, *[c for c in (lines_to, removed_to) if c not in docs.columns]]
    return cut.unionByName(whole).select(*[(result[c] if c in result else F.col(f"row.`{c}`")).alias(c) for c in names])
