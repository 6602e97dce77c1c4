"""Whitening, language identification, fill-in-middle and staging against brute force."""

import collections
import hashlib
import os
import subprocess
import sys
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileweave.llm import fim, langid, queries, whitening

# --- whitening ----------------------------------------------------------------


def whitened_rows(df, k=whitening.COMPONENTS):
    rows = df.select("*", whitening.quantised(F.col("embedding")).alias("vector")).where("vector is not null")
    fit = whitening.fit_list(rows)
    model = whitening.fit_whitening(fit)
    return model, whitening.identity_error(fit, model, k), whitening.with_whitened(rows, model, k=k).collect()


def brute_whitening(vectors):
    x = sorted({tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[a - s / n for a, s in zip(v, sums)] for v in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], axes[:, ::-1].T


def test_whitening_of_the_table(spark, sf_dir):
    source = {r.vec_id: [float(c) for c in r.embedding] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    n, sums, values, axes = brute_whitening(source.values())
    got = queries.op11_whitening(spark, sf_dir).collect()
    assert len(got) == 4 * len(source)
    signs = {}
    for r in got:
        x = [int(np.floor(256 * c)) for c in source[r.vec_id]]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums)) and r.identity_error < 1e-10
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10)
        wanted = (np.array(x) - np.array(sums) / n) @ axes[r.component - 1] / np.sqrt(values[r.component - 1])
        sign = signs.setdefault(r.component, np.sign(wanted) * np.sign(r.whitened))
        assert r.whitened * sign == pytest.approx(wanted, rel=1e-6, abs=1e-8)


def test_whitening_edges(spark):
    rng = np.random.default_rng(1)
    good = [[float(c) for c in v] for v in rng.normal(size=(40, 6)) * [8, 4, 2, 1, 0.5, 0.25]]
    odd = [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [], [1.0, 2.0]]
    rows = [(i, v, "own", 7) for i, v in enumerate([*good, *odd, *[good[0]] * 500])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, x int")
    model, error, got = whitened_rows(df)
    n, sums, values, axes = brute_whitening(good)
    assert (model.n, model.sums) == (n, sums) and len(got) == 540 and error < 1e-10  # copies count once
    assert np.allclose(model.eigenvalues, values) and np.allclose(np.abs((model.components * axes).sum(axis=1)), 1)
    assert got[0].x == 7 and len(got[0].whitened) == 4  # a clashing column is replaced where it stands
    one = {tuple(r.whitened) for r in got if r.vec_id == 0 or r.vec_id >= 46}
    assert len(one) == 1
    for rows in ([], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(9)], [(1, None)], [(1, [])]):
        model, error, got = whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert len(model.eigenvalues) == 0 and error == 0 and all(len(r.whitened) == 0 for r in got)


def test_whitening_of_great_numbers(spark):
    rows = [(0, [1e300, 3.0]), (1, [-1e300, 1.0]), (2, [2.0**40, 2.0]), (3, [5.0, 9.0])]
    model, _, got = whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [[2**63 - 1, 768], [-(2**63), 256], [2**48, 512], [1280, 2304]]
    assert model.sums == [sum(v[0] for v in x), sum(v[1] for v in x)]
    assert all(r.deviation is None for r in got)  # beyond a long
    rows = [(i, [2.0**20 * i, 1.0]) for i in range(50)]
    model, _, got = whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    s = sum(2**28 * i for i in range(50))
    assert {r.vec_id: r.deviation for r in got} == {i: d if (d := (50 * 2**28 * i - s) ** 2) < 2**63 else None for i in range(50)}


def test_factor_and_rotations():
    rng = np.random.default_rng(5)
    for size, rank in ((1, 1), (2, 2), (7, 7), (30, 12), (65, 65)):
        axes = np.linalg.qr(rng.normal(size=(size, size)))[0][:, :rank]
        values = np.sort(10.0 ** rng.uniform(-6, 6, rank))[::-1]
        a = axes * values @ axes.T
        factor = whitening.pivoted_cholesky((a + a.T) / 2)
        assert np.allclose(factor @ factor.T, a, rtol=0, atol=1e-9 * values[0])
        found, components = whitening.one_sided_jacobi(factor)
        assert np.allclose(components @ components.T, np.eye(len(found)), atol=1e-12)
        big = values > values[0] * 1e-8
        assert np.allclose(found[: big.sum()], values[big], rtol=1e-6)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
    met = [set(zip(i, j)) for i, j in whitening.rounds_of_pairs(7)]
    assert sum(map(len, met)) == 21 and len(set().union(*met)) == 21 and all(len({c for p in m for c in p}) == 2 * len(m) for m in met)


# --- languages ----------------------------------------------------------------


def brute_grams(text):
    """N-grams of one to three characters by plain loops over words."""
    folded = (text or "").lower()
    if not any(unicodedata.category(c)[0] == "L" for c in folded):
        return collections.Counter()
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in folded).split()
    found = collections.Counter()
    for w in words:
        padded = f" {w} "
        found.update(w)
        found.update(padded[i : i + 2] for i in range(len(padded) - 1))
        found.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return found


def brute_profile(counts, size=langid.SIZE):
    packed = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], packed(g)))[:size]


def brute_language(learned, text, size=langid.SIZE):
    own = brute_profile(brute_grams(text), size)
    if not own or not learned:
        return "und", 0.0
    place = {name: {g: i for i, g in enumerate(p)} for name, p in learned.items()}
    far = {name: sum(abs(i - p[g]) if g in p else size for i, g in enumerate(own)) for name, p in place.items()}
    best = min(far, key=lambda name: (far[name], name))
    return best, 1 - far[best] / (size * len(own))


SAYINGS = {
    "en": ["the quick brown fox jumps over the lazy dog", "there is nothing that this would not do with them"],
    "fr": ["les enfants jouent dans la cour de l'école", "nous ne savons pas où est la bibliothèque"],
    "hi": ["यह एक वाक्य है", "हिंदी में लिखा हुआ पाठ"],
    "zh": ["我们今天去北京", "天气很好"],
}
TEXTS = [None, "", "12 34 !!", "THE Dog", "nous sommes là", "हिंदी", "北京", "é", "x", "́", "İstanbul", "the " * 3000, "naïve 𝔘𝔫𝔦 𐐀𐐁 text", "áb"]


@pytest.mark.parametrize("block", [500, 1])
def test_languages_equal_brute_force(spark, block):
    rows = [(name, t, None) for name, texts in SAYINGS.items() for t in texts]
    teach = spark.createDataFrame([*rows, (None, "nobody learns this", None), ("und2", None, None)], "lang string, text string, gram string")
    found = langid.profiles(teach)
    learned = {name: brute_profile(sum((brute_grams(t) for t in texts), collections.Counter())) for name, texts in SAYINGS.items()}
    by = collections.defaultdict(dict)
    for r in found.collect():
        by[r.lang][r.rank] = r.gram
    assert {k: [v[i] for i in range(len(v))] for k, v in by.items()} == {k: [sum(ord(c) << 21 * i for i, c in enumerate(reversed(g))) for g in p] for k, p in learned.items()}
    df = spark.createDataFrame([(i, t, "kept", "old") for i, t in enumerate(TEXTS)], "row int, text string, best string, score string")
    got = langid.with_language(df, found, block=block)
    assert got.columns == ["row", "text", "best", "score", "lang_pred"]
    assert {r.row: (r.lang_pred, r.score, r.best) for r in got.collect()} == {i: (*brute_language(learned, t), "kept") for i, t in enumerate(TEXTS)}


def test_languages_of_empty_tables(spark):
    nothing = langid.profiles(spark.createDataFrame([], "lang string, text string"))
    some = spark.createDataFrame([(1, "a text")], "id int, text string")
    assert [(r.lang_pred, r.score) for r in langid.with_language(some, nothing).collect()] == [("und", 0.0)]
    assert langid.with_language(some.limit(0), nothing).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    text = "Der Fluß, née à Zürich. " * 40 + "ö"
    whole = dict(zip(*map(np.ndarray.tolist, langid.Grams().counts(text))))
    for piece in (1, 2, 3, 7, 100, 479):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert dict(zip(*map(np.ndarray.tolist, langid.Grams().counts(text)))) == whole
    assert sum(whole.values()) == sum(brute_grams(text).values())


def test_held_out_languages():
    """What is held out is told well: the languages of documents that taught nothing."""
    import zlib

    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    counts = collections.defaultdict(list)
    for name, text in zip(docs.lang[~held], docs.text[~held]):
        counts[name].append(langid.Grams().counts(text or ""))
    compared = langid.Comparer(sorted(counts), [langid.ranked(*langid.merged(counts[n])) for n in sorted(counts)])
    right = [compared.nearest(t or "")[0] == name for name, t in zip(docs.lang[held], docs.text[held])]
    assert np.mean(right) >= 0.97


# --- fill in the middle -------------------------------------------------------

FORMS = ["", None, "one line", "a\nb\nc\n", "a\nb\nc", "\n", "\n\n\n", "has <P> in it\nx", "<S>", "x<M>", "<p>\n<s>", "é\n日本\n𝔘\n", "<\nP>\n<", "x\n" * 50_000, "no break " * 20_000]


def test_forms(spark):
    rows = [(i, t, "own", "kept") for i, t in enumerate(FORMS * 5)] + [(None, "a\nb\n", "own", "kept"), (0, "", "own", "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, row string")
    made = fim.with_restored(fim.with_fim(df))
    assert made.columns == ["doc_id", "text", "output", "row", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored", "restored_sha256"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    seen = collections.Counter()
    for r in made.collect():
        text = r.text or ""
        assert r.restored == text and r.restored_sha256 == sha(text) and r.output_sha256 == sha(r.output) and r.row == "kept"
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + [x for x in lines[-1:] if x]
        assert r.n == len(lines)
        h = hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, _, h4 = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
        plain = not text or any(s in text for s in fim.SENTINELS)
        form = "plain" if plain else "spm" if h4 % 100 < 50 else "psm"
        seen[form] += 1
        assert r.form == form
        if plain:
            assert r.output == text and r.prefix_chars is None and r.middle_chars is None
        else:
            low, high = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
            p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
            assert (r.prefix_chars, r.middle_chars) == (len(p), len(m))
            assert r.output == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert min(seen.values()) > 5 and len(seen) == 3
    assert fim.with_restored(fim.with_fim(df.limit(0))).count() == 0


def test_rates_and_seeds(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd\n").alias("text"))
    forms = collections.Counter(r.form for r in fim.with_fim(df, fim_percent=40, spm_percent=25).collect())
    assert abs(forms["plain"] - 240) < 50 and abs(forms["spm"] - 40) < 25
    assert [r.output for r in fim.with_fim(df, seed=8).collect()] != [r.output for r in fim.with_fim(df).collect()]


def test_piece_tables():
    text = b"0123456789"
    table = fim.PieceTable((text, b"[]"))
    cut = table.cut(7).cut(3)
    assert [(p.start, p.length) for p in cut.pieces] == [(0, 3), (3, 4), (7, 3)] and cut.written() == text
    assert [(p.start, p.length) for p in table.cut(0).cut(10).pieces] == [(0, 0), (0, 10), (10, 0)]
    order = (2, 0, 1)
    turned = cut.permuted(order)
    assert turned.written() == b"7890123456" and turned.permuted(fim.inverse(order)).written() == text
    assert turned.digest() == hashlib.sha256(b"7890123456").hexdigest()
    assert turned.marked([fim.Piece(1, 0, 1)] * 3).unmarked().written() == turned.written() and table.buffers[0] is cut.buffers[0]


# --- staging ------------------------------------------------------------------

PLAIN = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master(sys.argv[1]).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", sys.argv[2]).getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from tileweave.llm import common, neardup
docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "q")], "doc_id long, text string")
assert sorted((r.doc_id, r.class_id) for r in neardup.near_classes(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
assert common.shared_dir(spark) == common.shared_dir(spark)
print("folder", common.shared_dir(spark))
"""


@pytest.mark.parametrize("master", ["local[2]", "local-cluster[2,1,1024]"])
def test_a_session_without_a_checkpoint_folder(tmp_path, master):
    """Operators stage tables in a session that names no folder, whatever the machine's own settings."""
    (tmp_path / "conf").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": root, "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_SCALA_VERSION": "2.13"}
    home = os.environ.get("SPARK_HOME") or os.path.dirname(__import__("pyspark").__file__)
    (tmp_path / "home").mkdir()
    for name in os.listdir(home):  # workers keep their logs in Spark's home
        if name != "work":
            os.symlink(f"{home}/{name}", tmp_path / "home" / name)
    env["SPARK_HOME"] = str(tmp_path / "home")
    ran = subprocess.run([sys.executable, "-c", PLAIN, master, str(tmp_path / "warehouse")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert ("warehouse" in ran.stdout) == master.startswith("local-cluster")
