"""Near and exact copies, line chunks, leaks, shards and the pipeline against brute force."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tileweave.llm import common, components, decontaminate, exactdedup, linededup, neardup, queries, sharding
from tileweave.llm.common import may_be_among

from ..compare import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- exact copies -------------------------------------------------------------


def test_exact_edges(spark):
    long = "line one\nline two\n" * 3000 + "x" * 5000
    rows = [(1, "Ab\nc"), (2, "aB\nC"), (3, None), (4, ""), (5, long), (6, long.upper()), (7, "É"), (8, "é"), (9, "z"), (9, "z"), (None, "z")]
    got = {(r["doc_id"], i): r for i, r in enumerate(exactdedup.exact_groups(frame(spark, rows)).collect())}
    by = collections.defaultdict(list)
    for (doc, _), r in got.items():
        by[doc].append((r["keep_id"], r["group_size"], r["kept"]))
    assert by[1] == [(2, 2, False)] and by[2] == [(2, 2, True)] and by[3] == [(4, 2, False)] and by[5] == [(6, 2, False)]
    assert by[7] == [(7, 1, True)] and by[8] == [(8, 1, True)] and by[9] == [(9, 3, True)] * 2 and by[None] == [(9, 3, False)]
    assert exactdedup.exact_groups(frame(spark, [])).count() == 0


def test_exact_with_shared_hashes(spark):
    """Identifiers stay right when texts share a hash."""
    rows = [(i, f"text {i // 2}\nmore {i // 2}") for i in range(40)]
    few = lambda c: F.pmod(F.length(c), F.lit(3)).cast("bigint")
    got = exactdedup.exact_groups(frame(spark, rows), hash_of=few).collect()
    assert len(got) == 40 and all(r["keep_id"] == r["doc_id"] // 2 * 2 + 1 and r["group_size"] == 2 for r in got)


def test_exact_long_and_extra_columns(spark):
    long = "\n".join(f"row {i}" for i in range(60_000))
    rows = [(1, long, "k"), (2, long.upper(), "k"), (3, long + "!", "k"), (4, long[:-1], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, recipe string").selectExpr("*", "1 AS hash", "2 AS chunks", "3 AS keep_id")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exactdedup.exact_groups(docs).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    """A join whose left side holds one key in most rows gives the same rows, and no partition holds them all."""
    monkeypatch.setattr(common, "ONE_TASK", 10)
    left = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.lit(7)).alias("k"), "id")
    right = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.range(1).selectExpr("7L", "70L"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = common.spread_join(left, right, ["k"], how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, ["k"], how).select(*got.columns).collect()), key=str)


# --- near copies --------------------------------------------------------------


def shingle_weights(rows):
    shingler = neardup.Shingler()
    return {d: {s: 1 + math.log(n) for s, n in collections.Counter(shingler.shingles(t or "").tolist()).items()} for d, t in rows}


def brute_similarity(x, y):
    """Probability Jaccard by its definition."""
    if all(w == 1 for w in x.values()) and all(w == 1 for w in y.values()):
        return len(x.keys() & y.keys()) / max(1, len(x.keys() | y.keys()))  # what the definition gives for equal weights
    every = x.keys() | y.keys()
    a, b = (np.array([w.get(e, 0.0) for e in every]) for w in (x, y))
    return sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero((a > 0) & (b > 0)))


def brute_classes(rows):
    sets, root = shingle_weights(rows), {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    text = dict(rows)
    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            some = len(sets[a].keys() & sets[b].keys()) > 0.3 * max(len(sets[a]), len(sets[b]))  # too few can't weigh enough here
            if (text[a] or "") == (text[b] or "") or (some and brute_similarity(sets[a], sets[b]) >= 0.8):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in ids}


def edited(words, changes, seed):
    rng = np.random.default_rng(seed)
    out = list(words)
    for i in rng.choice(len(words), changes, replace=False):
        out[i] = f"new{seed}w{i}"
    return " ".join(out)


def test_near_classes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [[f"w{rng.integers(5000)}" for _ in range(n)] for n in (300, 300, 120, 40, 12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for k, w in enumerate(base):
        for j in range(12):
            rows.append((100 * (k + 1) + j, edited(w, max(1, len(w) * j // 250), 100 * k + j)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE, two!"), (904, "..."), (905, " ".join(base[0][:200] + base[1][:200]))]
    got = {r["doc_id"]: r for r in neardup.near_classes(frame(spark, rows)).collect()}
    assert {d: r["class_id"] for d, r in got.items()} == brute_classes(rows)
    sizes = collections.Counter(r["class_id"] for r in got.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (d == r["class_id"]) for d, r in got.items())
    kept = neardup.without_near_copies(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(sizes)


def of_templates(templates, others, alike=1):
    """Families of texts with a few own words in a common template; only the first of each is like the next ``alike``, and what they share is the template."""
    rows = []
    for t in range(templates):
        words = [f"t{t}w{i}" for i in range(400)]
        rows += [(1000 * t + i, edited(words, 2 if i == 0 else 6 if i <= alike else 8, 1000 * t + i)) for i in range(others + alike + 1)]
    return rows


@pytest.mark.parametrize(("templates", "others"), [(3, 120)])
def test_links_in_mixed_bands(spark, templates, others):
    rows = of_templates(templates, others)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_links_in_bands_that_shrink(spark):
    """Bands whose pairs across classes get fewer with the merges."""
    rows = of_templates(8, 60, 4)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_exact_filters_lose_no_pair(spark):
    """Every pair at or above the threshold, whatever its sizes and common shingles, is among the possible ones."""
    rng = np.random.default_rng(12)
    sets = []
    for family in range(6):
        pool = rng.integers(1 << 63, size=int(rng.integers(3, 90)), dtype=np.int64).astype(np.uint64)
        for _ in range(25):
            own = rng.integers(1 << 63, size=int(rng.integers(0, max(2, len(pool) // 5))), dtype=np.int64).astype(np.uint64)
            sets.append(np.unique(np.concatenate([pool[rng.random(len(pool)) < rng.uniform(0.8, 1)], own])))
    sets = [s for s in sets if len(s)]
    rng2 = np.random.default_rng(13)
    counts = [np.where(rng2.random(len(s)) < 0.2, rng2.integers(2, 9, len(s)), 1) if i % 3 else np.ones(len(s), int) for i, s in enumerate(sets)]
    weights = [1 + np.log(c) for c in counts]
    rows = [(bytearray([0, i]), len(s), s.view(np.int64).tolist(), c.tolist() if (c > 1).any() else None, bool((c == 1).all()), float(w.sum()), neardup.parity_mark(s).tolist()) for i, (s, c, w) in enumerate(zip(sets, counts, weights))]
    held = spark.createDataFrame(rows, "node binary, n int, set array<long>, counts array<int>, even boolean, norm double, mark array<long>")
    roots = [bytes([1, i]) if i % 3 else bytes([2, i % 7]) for i in range(len(sets))]  # some classes of many, some of one
    apart = spark.createDataFrame([(r[0], bytearray(root)) for r, root in zip(rows, roots)], "node binary, root binary")
    got = {(bytes(r["a"])[1], bytes(r["b"])[1]) for r in neardup.possible_pairs(apart, held).collect()}
    like = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if brute_similarity(dict(zip(sets[i].tolist(), weights[i])), dict(zip(sets[j].tolist(), weights[j]))) >= 0.8]
    wanted = {(i, j) for i, j in like if roots[i] != roots[j]}
    pairs = sum(roots[i] != roots[j] for i in range(len(sets)) for j in range(i + 1, len(sets)))
    assert wanted and wanted <= got and len(got) < pairs / 3
    every = spark.createDataFrame([(rows[i][0], rows[j][0]) for i in range(len(sets)) for j in range(i + 1, len(sets))], "a binary, b binary")
    assert {(bytes(r["a"])[1], bytes(r["b"])[1]) for r in neardup.verified(every, held).collect()} == set(like)


def test_only_sets_of_possible_pairs_move(spark, monkeypatch):
    """Pairs that marks exclude are told without their sets, and sets of no pair stay out of the joins."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(1 << 63, size=200, dtype=np.int64).astype(np.uint64)) for _ in range(300)]
    sets[1] = np.sort(np.concatenate([sets[0][:195], sets[1][:5]]))
    rows = [(bytearray(divmod(i, 256)), len(s), s.view(np.int64).tolist(), None, True, float(len(s)), neardup.parity_mark(s).tolist()) for i, s in enumerate(sets)]
    held = spark.createDataFrame(rows, "node binary, n int, set array<long>, counts array<int>, even boolean, norm double, mark array<long>")
    pairs = spark.createDataFrame([(rows[0][0], rows[1][0]), (rows[2][0], rows[3][0])], "a binary, b binary")
    moved, join = [], neardup.spread_join
    monkeypatch.setattr(neardup, "spread_join", lambda left, right, *a: (moved.append(right.count()) if "a_set" in right.columns else None, join(left, right, *a))[1])
    found = [(bytes(r["a"]), bytes(r["b"])) for r in neardup.verified(pairs, held).collect()]
    assert found == [(bytes(rows[0][0]), bytes(rows[1][0]))] and moved == [1]


def test_weights_decide_links(spark):
    """Texts of equal sets that repeat different parts aren't alike, and a passage that both repeat binds them."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words[:12] * 40)), (3, " ".join(words + words[40:52] * 40)), (4, " ".join(words + words[:12] * 38))]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows) and got[4] == got[2] != got[3]
    sets = {d: set(w) for d, w in shingle_weights(rows).items()}
    assert len(sets[2] & sets[3]) / len(sets[2] | sets[3]) < 0.8 < len(sets[1] & sets[2]) / len(sets[1] | sets[2]) or got[1] != got[2]


def test_recall_of_hard_families(spark):
    """Pairs just above the threshold share a band nearly always: recall of links against brute force."""
    rng, pairs, found = np.random.default_rng(21), 0, 0
    for k in range(300):
        pool = rng.integers(1 << 63, size=260, dtype=np.int64).astype(np.uint64)
        counts = np.where(rng.random(260) < 0.2, rng.integers(2, 6, 260), 1)
        cut = int(rng.integers(20, 24))
        x, y = (np.unique(pool[:-cut], return_index=True), np.unique(pool[cut:], return_index=True))
        cx, cy = counts[:-cut][x[1]], counts[cut:][y[1]]
        if neardup.probability_jaccard(x[0], 1 + np.log(cx), y[0], 1 + np.log(cy)) >= 0.8:
            pairs += 1
            a, b = neardup.bands_of(neardup.signatures([(x[0], cx), (y[0], cy)]))
            found += bool(set(a.tolist()) & set(b.tolist()))
    assert pairs > 100 and found >= 0.99 * pairs


def test_bands_of_texts_are_those_of_single_sketches():
    shingles = neardup.Shingler().shingles
    texts = ["", "one", "a b c d e f g"] + [" ".join(f"w{i % 97}x{k}" for i in range(k * 7)) for k in range(1, 60)] + ["word " * 50_000]
    together = neardup.bands_of_texts(texts, shingles)
    for text, keys in zip(texts, together):
        alone = neardup.signature(shingles(text))
        assert (list(keys) == []) if alone is None else (list(keys) == list(neardup.bands_of(alone)[0]))


def test_repeated_shingles_hide_no_link(spark):
    rows = []
    for k in range(25):
        words = [f"p{k}w{i}" for i in range(200)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, edited(words, 4, k) + " " + " ".join(words[:100] * 100))]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_edges(spark):
    assert neardup.near_classes(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    got = neardup.near_classes(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["class_size"]) for r in got) == [(0, 1, 3), (1, 1, 3), (1, 1, 3), (2, 2, 1)]


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(1 << 62, size=600).astype(np.uint64)
    a, b = np.concatenate([pool[:400], pool[:50]]), pool[100:600]
    wa, wb = collections.Counter(a.tolist()), collections.Counter(b.tolist())
    wa, wb = ({k: 1 + math.log(v) for k, v in w.items()} for w in (wa, wb))
    exact = sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in {**wa, **wb}) for d in wa if d in wb)
    guess = neardup.estimated_similarity(neardup.signature(a, 4096), neardup.signature(b, 4096))
    assert abs(guess - exact) < 0.035
    assert neardup.signature(np.empty(0, np.uint64)) is None
    one = neardup.signature(np.array([7], np.uint64))
    assert (one == 7).all()


def test_components(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(60)] + [(b"x", b"y"), (b"z", b"y"), (b"q", b"q")]
    got = {bytes(r["node"]): bytes(r["root"]) for r in components.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert got == {bytes([i]): b"\0" for i in range(1, 61)} | {b"y": b"x", b"z": b"x"}
    roots = components.components(spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f")], "a string, b string"))
    more = components.joined_components(roots, spark.createDataFrame([("b", "d"), ("g", "f")], "a string, b string"))
    assert {r["node"]: r["root"] for r in more.collect()} == {"b": "a", "c": "a", "d": "a", "f": "e", "g": "e"}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_filter_keeps_every_partner(spark):
    left, right = spark.range(1000), spark.range(0, 1000, 7)
    marked = may_be_among(left, F.xxhash64("id"), right).where("_maybe")
    assert marked.join(right, "id").count() == 143 and marked.count() < 160


# --- line chunks --------------------------------------------------------------


def test_repeated_passages_are_removed(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    passage = words("shared", 60)
    block = "\n".join(f"boiler {i} plate" for i in range(30))
    rows = [(i, f"{words(f'own{i}a', 9)}\n{passage}\n{words(f'own{i}b', 9)}") for i in range(5)]
    rows += [(10 + i, f"{words(f'head{i}', 8)}\n{block}\n{words(f'tail{i}', 8)}") for i in range(4)]
    rows += [(20, "a short line\nunique end twenty"), (21, "a short line\nunique end twentyone"), (22, None), (23, ""), (24, "\n\n")]
    got = {r["doc_id"]: r for r in linededup.without_repeated_chunks(frame(spark, rows)).collect()}
    assert passage in got[0]["text"] and got[0]["n_removed"] == 0
    for i in range(1, 5):
        assert passage not in got[i]["text"] and f"own{i}a0" in got[i]["text"] and f"own{i}b8" in got[i]["text"]
    for i in range(11, 14):
        assert got[i]["text"].count("boiler") < 12 and f"head{i - 10}0" in got[i]["text"]
    assert got[10]["text"] == rows[5][1] and got[20]["text"] == rows[9][1] and got[21]["text"] == rows[10][1]
    assert got[22]["text"] is None and got[23]["text"] == "" and got[24]["text"] == "\n\n"


def brute_folded(text):
    """(line, part, parts, bytes) of the folded lines that aren't blank."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        if line.strip(" \t\r\n"):
            words = re.findall("[^ ]* |[^ ]+", line)
            cuts = ["".join(words[k : k + linededup.WIDTH]) for k in range(0, len(words), linededup.WIDTH)]
            cuts = [c for c in cuts if c.strip(" \t\r\n")]
            out += [(i, k, len(cuts), c) for k, c in enumerate(cuts)]
    return out


def brute_passages(rows):
    """Runs of three folded lines or more that stand at an earlier place, window by window; nothing of chunks."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        held, gone = brute_folded(text), set()
        for j in range(len(held) - linededup.LINES + 1):
            window = tuple(x[3] for x in held[j : j + linededup.LINES])
            if window in seen:
                gone |= set(range(j, j + linededup.LINES))
            seen.add(window)
        lines, dropped = (text or "").split("\n"), set()
        for j in sorted(gone):
            if j - 1 not in gone:
                start = held[j][0] + (held[j][1] > 0)
            if j + 1 not in gone:
                dropped |= set(range(start, held[j][0] + (held[j][1] == held[j][2] - 1)))
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in dropped)
    return out


def test_lines_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["text"] for r in linededup.without_repeated_chunks(frame(spark, rows)).collect()}
    assert got == brute_passages(rows)


def test_short_passages_go_whole(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(10 * size + i, f"own {size} {i}\n" + "\n\n".join(words(f"p{size}x{k}y", 20) for k in range(size)) + f"\nend {size} {i}\nlone") for size in range(1, 8) for i in range(3)]
    rows += [(100, "a\na\na\na"), (101, "a\nb"), (102, "x\na\na\ny"), (103, None), (104, "")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    brute = brute_passages(rows)
    assert {d: r["n_chars"] for d, r in got.items() if d != 103} == {d: len(t) for d, t in brute.items() if d != 103}
    assert {r["doc_id"]: r["text"] or "" for r in linededup.without_repeated_chunks(frame(spark, rows)).collect()} == brute
    assert brute[31] == "own 3 1\nend 3 1\nlone"


def test_lines_stay_unless_their_run_stands_elsewhere(spark):
    """A, B and C stand in pairs elsewhere, but never all three together."""
    rows = [(1, "A\nB\nx"), (2, "y\nB\nC\nz"), (3, "p\nA\nB\nC\nq"), (4, "r\nA\n\nB\nC\ns")]
    got = {r["doc_id"]: r["text"] for r in linededup.without_repeated_chunks(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "r\ns"}
    # A passage on one long line is folded; a line that a run only reaches into stays.
    long = " ".join(f"w{i}" for i in range(70))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, f"e\n{long} and more\nf"), (4, f"{long}  \n \n\n{long}")]
    got = {r["doc_id"]: r["text"] for r in linededup.without_repeated_chunks(frame(spark, rows)).collect()}
    assert got == brute_passages(rows) and got[2] == "c\nd" and got[3] == rows[2][1]


@pytest.mark.parametrize("cut", [1, 2, 4, 1000])
def test_boundaries_change_no_result(spark, monkeypatch, cut):
    """Whatever the mean chunk, the same lines go: what chunks miss, their extension finds."""
    rng = np.random.default_rng(cut)
    rows = [(i, "\n".join(f"line {w}" if w else "" for w in rng.integers(0, 9, rng.integers(0, 40)))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + "\ntail") for i in range(20)] + [(200, None), (201, ""), (None, rows[3][1])]
    monkeypatch.setattr(linededup, "CUT", cut)
    got = {r["doc_id"]: r["text"] or "" for r in linededup.without_repeated_chunks(frame(spark, rows)).collect()}
    assert got == brute_passages(rows)


def test_lines_that_share_hashes_are_told_apart(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "\n".join("abcdefgh"[w] * (1 + w % 3) for w in rng.integers(0, 8, 25))) for i in range(30)] + [(50, "q\nw\ne"), (51, "z\nq\nw\ne")]
    few = lambda c: F.length(c).cast("bigint")
    gone = {r["key"]["id"]: r["runs"] for r in linededup.repeated_runs(frame(spark, rows), hash_of=few).collect()}
    right = {r["key"]["id"]: r["runs"] for r in linededup.repeated_runs(frame(spark, rows)).collect()}
    assert gone == right and 51 in gone


def test_copies_of_many_lines_take_linear_time(spark):
    import time

    took = []
    for n in (30_000, 300_000):
        text = "\n".join(f"line {i * 7919 % 1000003}" for i in range(n))
        began = time.time()
        got = linededup.without_repeated_chunks(frame(spark, [(1, text), (2, "head\n" + text), (3, text[: len(text) // 2])])).select("doc_id", "n_lines", "n_removed").collect()
        took.append(time.time() - began)
        by = {r["doc_id"]: r["n_removed"] for r in got}
        assert by[1] == 0 and by[2] == n and abs(by[3] - n // 2) < n // 50
    assert took[1] < took[0] * 12


def test_line_edges(spark):
    docs = frame(spark, [(1, "a\nb\nc\nd", "k"), (1, "a\nb\nc\nd", "k"), (None, "q", "k")], "doc_id long, text string, chunk string")
    got = linededup.without_repeated_chunks(docs)
    assert got.count() == 3 and got.columns[:3] == ["doc_id", "text", "chunk"]
    assert linededup.without_repeated_chunks(docs.limit(0)).count() == 0
    names = docs.selectExpr("doc_id", "text", "'k' AS key", "1 AS lines", "2 AS row", "3 AS dropped", "9 AS n_lines", "4 AS _maybe")
    got = linededup.without_repeated_chunks(names)
    assert got.columns == [*names.columns, "n_removed"]
    assert {(r["key"], r["lines"], r["row"], r["dropped"], r["_maybe"]) for r in got.collect()} == {("k", 1, 2, 3, 4)} and {r["n_lines"] for r in got.collect()} == {1, 4}


def test_very_long_texts_and_ties_of_lines(spark):
    long = "\n".join(f"line {i % 5000} of it" for i in range(20_000))
    rows = [(1, long), (2, "before\n" + long[:100_000]), (3, None), (3, "x\ny\nz"), (3, "x\ny\nz\nw")]
    got = sorted((r["doc_id"], r["text"] or "") for r in linededup.without_repeated_chunks(frame(spark, rows)).collect())
    assert got[0][1].split("\n")[:5000] == long.split("\n")[:5000] and len(got[0][1].split("\n")) == 5000
    assert got[1][1].startswith("before") and len(got[1][1]) < 40
    assert sum(t.count("x\ny\nz") for d, t in got if d == 3) == 1


# --- leaks --------------------------------------------------------------------


def brute_overlaps(docs, items):
    """Best overlap of each document and item by the operator's rule, over every shift: (agreed, overlap, place)."""
    tokens = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    owns = {i: tokens(item) for i, item in items}
    found = {}
    for d, text in docs:
        doc = tokens(text)
        where = collections.defaultdict(list)
        for p, w in enumerate(doc):
            where[w].append(p)
        for i, own in owns.items():
            least = min(13, len(own))
            shifts = {p - k for k, w in enumerate(own) for p in where[w]}
            for shift in shifts:
                at = range(max(0, -shift), min(len(own), len(doc) - shift))
                equal = [own[k] == doc[k + shift] for k in at]
                if len(equal) < least:
                    continue
                for start in (x for x, e in enumerate(equal) if e):
                    agreed = sum(equal[start : start + least - 1])
                    for end in range(start + least - 1, len(equal)):
                        agreed += equal[end]
                        size = end - start + 1
                        if equal[end] and agreed >= 0.8 * size - 1e-9:
                            found[d, i] = max(found.get((d, i), (0, 0, 0)), (agreed, -size, -(at[0] + start + shift)))
    return {pair: (agreed, -size, -place) for pair, (agreed, size, place) in found.items()}


def brute_leaks(docs, items):
    return set(brute_overlaps(docs, items))


def shown_leaks(found):
    return {(r["doc_id"], r["item_id"]): (r["agreed"], r["overlap"], r["place"]) for r in found.collect()}


def test_masks_hit_every_tolerated_pattern():
    for size in range(5, 21):
        masks = decontaminate.MASKS if size >= decontaminate.SHORT else decontaminate.SHORT_MASKS
        for k in range(size // 5 + 1):
            for wrong in itertools.combinations(range(1, size - 1), k):
                assert any(not any(o + m in wrong for m in mask) for mask in masks for o in range(size - mask[-1]))
    assert all(mask[-1] >= 5 for mask in decontaminate.MASKS)  # each ignores a place


def test_short_items_tolerate_one_word(spark):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 13)]
    docs = []
    for n, text in items:
        for k in range(n):
            words = text.split()
            words[k] = "other"
            docs.append((n * 100 + k, "before it " + " ".join(words) + " after"))
        docs.append((n * 100 + 99, text.upper()))
    got = shown_leaks(decontaminate.leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")))
    assert got == brute_overlaps(docs, items)
    assert {(904, 9), (501, 5), (503, 5), (499, 4), (199, 1)} <= set(got) and not {(401, 4), (500, 5), (908, 9)} & set(got)


def test_leaks_equal_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 4000").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = shown_leaks(decontaminate.leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")))
    wanted = brute_overlaps(docs, items)
    assert got == wanted and wanted


def test_substituted_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"v{w}" for w in rng.integers(60, size=n))) for i, n in enumerate((5, 7, 9, 10, 11, 13, 15, 20, 40, 90))]
    docs = []
    for d in range(160):
        own = items[d % len(items)][1].split()
        for at in rng.choice(len(own), int(rng.integers(0, max(2, len(own) // 3))), replace=False):
            own[at] = f"other{d}x{at}"
        around = [f"v{w}" for w in rng.integers(60, size=30)]
        docs.append((d, " ".join(around[:15] + own[int(rng.integers(0, 3)) :] + around[15:])))
    got = shown_leaks(decontaminate.leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")))
    wanted = brute_overlaps(docs, items)
    assert got == wanted


def test_long_leaks_are_told_whole(spark):
    item = [f"b{i}" for i in range(300)]
    agree = lambda places: " ".join(w if i in places else f"z{i}" for i, w in enumerate(item[:25]))
    docs = [(1, " ".join(["x"] * 5 + item)), (2, agree({0, 1, 2, 4, 7, 9, *range(12, 25)})), (3, agree({*range(12, 25)})), (4, agree({*range(13, 25)})), (None, " ".join(item)), (None, "clean words here")]
    items = frame(spark, [(0, " ".join(item)), (None, " ".join(item[100:130])), (None, " ".join(item[200:230]))], "item_id long, text string")
    got = shown_leaks(decontaminate.leaks(frame(spark, docs), items))
    assert got[1, 0] == (300, 300, 5) and got[2, 0][0] >= 13 and got[3, 0] == (13, 13, 12) and (4, 0) not in got
    assert got[1, None] == (30, 30, 105) and got[None, 0] == (300, 300, 0)
    kept = decontaminate.without_leaks(frame(spark, docs).selectExpr("doc_id", "text", "1 AS node", "2 AS _maybe", "3 AS row"), items)
    assert kept.columns == ["doc_id", "text", "node", "_maybe", "row"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(4, docs[3][1], 1, 2, 3), (None, "clean words here", 1, 2, 3)], key=str)


def test_leaks_with_substitutions(spark):
    item = [f"b{i}" for i in range(40)]
    around = [f"d{i}" for i in range(30)]
    changed = lambda every: [f"x{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
    docs = [
        (1, " ".join(around + item + around)), (2, " ".join(around + changed(8) + around)), (3, " ".join(around + item[:20])), (4, " ".join(around + item[:9])), (5, " ".join(changed(2))),
        (6, None), (7, ""), (8, " ".join(around).upper()), (9, "Tiny Item, here!"), (10, "tiny thing here"), (1, " ".join(around + item + around)), (None, " ".join(item)),
    ]
    items = frame(spark, [(0, " ".join(item)), (1, "tiny item here"), (2, None), (3, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(frame(spark, docs), items).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (9, 1), (None, 0)}
    assert (got[1, 0]["place"], got[1, 0]["agreed"]) == (30, 34) or got[1, 0]["agreed"] >= 34
    kept = [r["doc_id"] for r in decontaminate.without_leaks(frame(spark, docs), items).collect()]
    assert sorted(kept) == [4, 5, 6, 7, 8, 10]
    assert decontaminate.leaks(frame(spark, []), items).count() == 0
    assert decontaminate.leaks(frame(spark, docs), items.limit(0)).count() == 0


def test_leak_that_only_a_later_hit_proves(spark):
    rows = []
    for k in range(15):
        words = [f"b{i}" for i in range(15)]
        words[k] = "other"
        rows.append((k, " ".join(["before"] * 5 + words + ["after"] * 5)))
    items = frame(spark, [(0, " ".join(f"b{i}" for i in range(15)))], "item_id long, text string")
    got = {r["doc_id"]: (r["overlap"], r["agreed"]) for r in decontaminate.leaks(frame(spark, rows), items).collect()}
    assert got[11] == (15, 14) and all(o >= 13 and a == 14 for o, a in got.values())


def test_leaks_in_blocks(spark, monkeypatch):
    item = " ".join(f"b{i}" for i in range(40))
    docs, items = frame(spark, [(1, item), (2, "nothing here")]), frame(spark, [(0, item), (1, item + " more")], "item_id long, text string")
    whole = decontaminate.leaks(docs, items).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 20)
    assert sorted(decontaminate.leaks(docs, items).collect()) == sorted(whole)


# --- shards -------------------------------------------------------------------


def test_shards(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op7_sharding(spark, sf_dir).collect()
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"key"}
    slots = collections.defaultdict(list)
    for r in rows:
        body = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 16, zlib.crc32(body))
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_shard(key, tree, spark):
    """The shard by an independent walk of the tree; only the hash is taken from Spark, by one query for each name."""
    asked = {}

    def draws(name, n):
        for i in range(n):
            asked.setdefault(f"{name}/{i}", None)

    regions = [[[w for _, w in rack] for rack in region] for region in tree]
    draws("root", len(tree))
    for g, region in enumerate(tree):
        draws(f"root/{g}", len(region))
        for r, rack in enumerate(region):
            draws(f"root/{g}/{r}", len(rack))
    row = spark.range(1).select(*[F.xxhash64(F.lit(name), F.lit(key).cast("long")).alias(str(i)) for i, name in enumerate(asked)]).first()
    hashes = dict(zip(asked, row))

    def least(name, weights):
        if len(weights) == 1:
            return 0
        return min(range(len(weights)), key=lambda i: -math.log((((hashes[f"{name}/{i}"] % (1 << 64)) >> 11) + 0.5) / (1 << 53)) / weights[i])

    g = least("root", [sum(map(sum, region)) for region in regions])
    r = least(f"root/{g}", [sum(rack) for rack in regions[g]])
    return tree[g][r][least(f"root/{g}/{r}", regions[g][r])][0]


def test_shards_equal_an_independent_draw(spark):
    for tree in (sharding.hash_tree(40), sharding.hash_tree(40, 1), [[[(0, 1.0), (1, 3.0)]], [[(2, 4.0)], [(3, 0.5), (4, 2.0)]]]):
        got = {r["id"]: r["s"] for r in spark.range(60).select("id", sharding.tree_shard(F.col("id"), tree).alias("s")).collect()}
        assert all(brute_shard(key, tree, spark) == s for key, s in list(got.items())[:25])


def test_many_copies_get_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LOT", 7)
    docs = frame(spark, [(7, "same")] * 300 + [(8, "x")]).withColumns({"_bucket": F.lit(1), "slot": F.lit(2)})
    got = sharding.shard_digest(docs, 2).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 301 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_balance_and_movement(spark):
    keys = spark.range(40_000)
    placed = keys.select(sharding.tree_shard(F.col("id"), sharding.hash_tree(40)).alias("old"), sharding.tree_shard(F.col("id"), sharding.hash_tree(40, 1)).alias("new"))
    count = dict(placed.groupBy("old").count().collect())
    assert set(count) == set(range(40)) and max(count.values()) < 1200 and min(count.values()) > 800
    moved = placed.where("old <> new")
    assert moved.where("new <> 40").count() == 0 and 800 < moved.count() < 1200
    heavy = [[[(0, 1.0), (1, 3.0)]], [[(2, 4.0)]]]
    share = dict(keys.select(sharding.tree_shard(F.col("id"), heavy).alias("s")).groupBy("s").count().collect())
    assert abs(share[1] / share[0] - 3) < 0.3 and abs(share[2] / 40_000 - 0.5) < 0.02


def test_shard_edges(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (2, ""), (3, "é" * 100_000)] + [(7, "same")] * 50
    got = sharding.shard_digest(frame(spark, rows), 40).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["size"] for r in got if r["doc_id"] is None} == {16}
    assert sharding.shard_digest(frame(spark, []), 40).count() == 0


# --- pipeline -----------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.staged(stage(spark, before, sf_dir), "test")
        assert name == "encode" or after.columns == docs.columns
        kept[name] = after
        before = after
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = {r["doc_id"] for r in kept["quality"].collect()}
    assert all((d in good) == bool(q) for d, q in labels.items())
    rows = [(r["doc_id"], r["text"]) for r in kept["quality"].collect()]
    lines = {r["doc_id"]: r["text"] for r in kept["line_dedup"].collect()}
    assert lines == brute_passages(rows)
    classes = brute_classes(list(lines.items()))
    near = {r["doc_id"]: r["text"] for r in kept["near_dedup"].collect()}
    assert set(near) == set(classes.values())
    clean = {r["doc_id"] for r in kept["decontaminate"].collect()}
    leaky = {d for d, _ in brute_leaks([x for x in near.items() if len(x[1]) < 4000], [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])}
    assert clean.isdisjoint(leaky) and all(d in clean for d, t in near.items() if len(t) < 4000 and d not in leaky)
    assert {r["doc_id"] for r in kept["encode"].collect()} == clean
    held = common.staged_now(spark)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, kept["encode"].collect()))
    assert len(common.staged_now(spark) - held) == 1  # the last stage's input; all else is gone


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables in every stage."""
    own = "score int, n_lines int, n_removed int, row int, node int, key int, _maybe int, found int, gone int, of int"
    names = [c.split()[0] for c in own.split(", ")]
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, words("a", 30)), (1, words("a", 30)), (2, None), (3, ""), (None, words("a", 30) + " more"), (None, None), (4, words("long", 150_000)), (5, "one"), (6, "x y\nz w\nown six"), (7, "x y\nz w\nown seven")]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {own}"
    docs = spark.createDataFrame([(d, t, None, None, None if t is None else len(t), *range(len(names))) for d, t in rows], schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        got = stage(spark, docs, sf_dir)
        kept[name] = got.collect()
        if name != "encode":
            assert got.columns == docs.columns
            assert all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in kept[name])
    texts = {name: sorted((r["doc_id"] or -1, r["text"] or "") for r in found) for name, found in kept.items() if name != "encode"}
    everything = sorted((d or -1, t or "") for d, t in rows)
    assert set(texts["quality"]) <= set(everything)
    assert [t for t in texts["line_dedup"] if t[0] != 7] == [t for t in everything if t[0] != 7] and (7, "own seven") in texts["line_dedup"]
    assert texts["near_dedup"] == sorted([(1, rows[0][1]), (1, rows[0][1]), (2, ""), (4, rows[6][1]), (5, "one"), (6, rows[8][1]), (7, rows[9][1])])
    assert texts["decontaminate"] == everything
    assert len(kept["encode"]) == len(rows) and sum(r["n_tokens"] == 0 for r in kept["encode"]) == 3
    assert sum(r["text"] is None for r in kept["line_dedup"]) == 2
