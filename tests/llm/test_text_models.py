"""Token counts, BPE, URL rules, HTML and quality against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import regex
import tiktoken

from tileweave.llm import bpe, htmltext, quality, queries, tokencount, urlfilter

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "a", "  a  b ", "don't  stop\n\n x\t y", "ab" * 3000, "x" * 5000, "é\x1c\x85 z", "日本語" * 300, "\U0001f600" * 40, "'s'S 're", "\r\n \r\n"]


def texts(n=600):
    rng = random.Random(5)
    letters = " \n\t\x0b'sdltrevm1٢Ⅷ½aé日 　\x1c\x85_-!😀́ABC"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_bpe_equals_the_library(documents):
    codec = bpe.codec(PATH, P.PATTERN)
    for text in texts() + documents:
        ids = codec.encode(text)
        assert ids == TIKTOKEN.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_compatibility_is_what_merging_says():
    codec, rng = bpe.codec(PATH, P.PATTERN), random.Random(2)
    ids = list(RANKS.values())
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids[:3000])
        merged = bpe.merge_by_rank(codec.bytes_of[a] + codec.bytes_of[b], RANKS)
        assert codec.compatible[a << 32 | b] == (merged == [a, b])


def test_bpe_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op10_byte_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = TIKTOKEN.encode_ordinary(r["text"])
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_bpe_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "hi", None)], "doc_id int, text string, n_tokens string")
    rows = bpe.with_token_digest(df, PATH, P.PATTERN).collect()
    assert [r["n_tokens"] for r in rows] == [0, 0, 0, 1]
    assert rows[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.with_token_digest(df.limit(0), PATH, P.PATTERN).count() == 0
    both = bpe.with_decoded(bpe.with_token_ids(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert [bytes(r["decoded"]) for r in both] == [b"", b"", b"", b"hi"]


def greedy(data, vocabulary, longest):
    at = n = 0
    while at < len(data):
        end = next((e for e in range(min(len(data), at + longest), at, -1) if data[at:e] in vocabulary), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_token_counts(spark, sf_dir, documents):
    counter, pattern = tokencount.counter(PATH, P.PATTERN), regex.compile(P.PATTERN)
    for text in texts() + documents[:60]:
        pieces = pattern.findall(text)
        assert counter.count(text) == (len(pieces), sum(greedy(p.encode(), RANKS, 128) for p in pieces))
    small = tokencount.LongestMatchCounter([b"a", b"abcdx", b"b", b"cd", b"bcd", b"ab"], r"\S+")
    for word in (b"abcdx", b"abcd", b"abcz", b"aabcdabcdx", b"c", b"abcdcd", b"bcdabcd"):
        assert small.count_piece(word) == greedy(word, {b"a", b"abcdx", b"b", b"cd", b"bcd", b"ab"}, 5), word
    df = spark.createDataFrame([(None,), ("",), ("two words",)], "text string")
    assert [r["n_pieces"] for r in tokencount.with_token_counts(df, PATH, P.PATTERN).collect()] == [0, 0, 2]
    assert queries.op1_token_counts(spark, sf_dir).count() == len(documents)


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://A.Example.com/en/x?q", "a.example.com", "/en/x", "example.com/en/", "block"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("https://x.com/", "x.com", "/", "com/", "allow"),
    ("https://x.com", "x.com", "", None, "allow"), ("ftp://a.net/es/1#f", "a.net", "/es/1", "net/es/", "block"), ("http://a.net/de/", "a.net", "/de/", None, "allow"), (None, "", "", None, "allow"), ("no scheme/casino", "", "", None, "block"),
    ("http://a.org/casino-x", "a.org", "/casino-x", None, "block"), ("http://a.org/casinox", "a.org", "/casinox", None, "allow"), ("http://a.org/bet/bet", "a.org", "/bet/bet", None, "allow"), ("http://a.org/bet/free", "a.org", "/bet/free", None, "block"),
    ("http://porn.com/x", "porn.com", "/x", "com/", "allow"), ("http://notcom/x", "notcom", "/x", None, "allow"), ("http://É.ORG?x://y", "É.org", "", None, "allow"),
])
def test_url_rules(url, host, path, rule, verdict):
    judge = urlfilter.UrlJudge(queries.URL_RULES, urlfilter.read_vocabulary())
    assert judge.judge(url)[:4] == (host, path, rule, verdict)


def test_url_edges(spark, sf_dir):
    df = spark.createDataFrame([(1, None, "h"), (2, "http://a.net/es/", "h"), (2, "http://a.net/es/", "h")], "page_id int, url string, host string")
    assert [r["verdict"] for r in urlfilter.with_url_verdict(df, queries.URL_RULES).collect()] == ["allow", "block", "block"]
    assert urlfilter.with_url_verdict(df.limit(0), queries.URL_RULES).count() == 0


def brute_url_hits(url, vocabulary):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    found = {t: w for t, w in vocabulary if regex.search(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(t)}(?![\p{{L}}\p{{N}}])", low)}
    soft = [w for w in found.values() if w < 100]
    return len(found) - len(soft), len(soft), sum(soft)


def test_url_hits_equal_brute_force(spark):
    rng, vocabulary = random.Random(8), urlfilter.read_vocabulary()
    words = [t for t, _ in vocabulary] + ["a", "é", "١", "CASINO", "Sex", "ſex", "İ", "x1"]
    urls = ["http://h.org/" + "".join(rng.choice(words) + rng.choice(["", "-", "/", "é", "²", "_", "?", "."]) for _ in range(rng.randint(0, 9))) for _ in range(800)]
    urls += ["http://h.org/" + "clean/" * 200_000 + "casino", "http://h.org/" + "casino" * 50_000]
    judge = urlfilter.UrlJudge(queries.URL_RULES, vocabulary)
    for url in urls:
        assert judge.hits(url) == brute_url_hits(url, vocabulary)
    own = urlfilter.vocabulary_of(spark.createDataFrame([("bad", 100), ("odd", 40), ("mad", 60), (None, 1), ("", 3)], "term string, weight int"))
    judge = urlfilter.UrlJudge((), own)
    assert [judge.judge(f"http://h.org/{p}")[3] for p in ("bad", "odd", "odd-mad", "odd-odd", "mad")] == ["block", "allow", "block", "allow", "allow"]


def test_vocabulary_decides(spark, tmp_path):
    """Of URLs that no rule fits, thousands of terms block many and leave many, and the query says what its SQL does."""
    from ..compare import assert_same

    own = urlfilter.read_vocabulary()
    terms = dict(urlfilter.compounds(own))
    assert len(terms) > 5000 and sum(w < urlfilter.STRICT for w in terms.values()) > 500 and all(terms[t] == w for t, w in own)
    rng = random.Random(4)
    names, plain = sorted(terms), ["news", "garden", "sussex", "essex", "scrap", "cranberry", "alphabet", "shopping", "weather"]
    urls = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(3)] + rng.sample(names, i % 3)
        rng.shuffle(words)
        urls.append((i, f"http://{'-'.join(words[:2])}.org/{rng.choice('/_-+').join(words[2:])}{rng.choice(['', 's', '?x=1', '.html'])}"))
    pd.DataFrame(urls, columns=["page_id", "url"]).to_parquet(tmp_path / "pages.parquet")
    assert_same(spark, str(tmp_path), queries.QUERIES["op4_url_filter"], queries.ORACLE_SQL["op4_url_filter"])
    got = collections.Counter(r["verdict"] for r in queries.op4_url_filter(spark, str(tmp_path)).where("rule IS NULL").collect())
    assert got["block"] > 150 and got["allow"] > 150
    soft = urlfilter.with_url_verdict(spark.createDataFrame([(1, "http://a.org/free/bet/now"), (2, "http://a.org/free"), (3, "http://a.org/freebet"), (4, "http://a.org/mycasino"), (5, "http://a.org/casinov")], "page_id int, url string"), (), vocabulary=terms.items())
    assert {r["page_id"]: r["verdict"] for r in soft.collect()} == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow"}


def test_url_columns_clash(spark):
    df = spark.createDataFrame([(1, "http://a.org/casino", "h", "f", "r")], "page_id int, url string, host string, found string, row string")
    got = urlfilter.with_url_verdict(df, queries.URL_RULES)
    assert got.columns == ["page_id", "url", "host", "found", "row", "path", "rule", "verdict", "strict_terms", "soft_terms", "soft_weight"]
    assert tuple(got.first())[:5] == (1, "http://a.org/casino", "a.org", "f", "r")


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("<p>One &amp; two", "One & two"), ("<article><h1>T</h1><p><b>a<br><p>b c</p></article><footer>f</footer>", "T\n\na\n\nb c"),
    ("<nav>n</nav><div class='ad'>Buy, now.</div><article><p>x\n  y</p><div class=\"comments\">No!</div></article>", "x y"),
    ("<body><div id=menu>m</div><div class=content><p>Long text, with stops. And more.</p><p>s</p></div><div class=sidebar>Related, here.</div></body>", "Long text, with stops. And more.\n\ns"),
    ("<script>var t='</p>';</script><p>ok</p><style>p{}</style><form><p>no</p></form>", "ok"), ("<article><p>a<!-- <p>b --></article><aside>z</aside>", "a"), ("<p>a<p>b</div>c", "a\n\nb\n\nc"),
])
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_main_text_of_pages(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        text = htmltext.main_text(r["html"])
        body = r["html"][r["html"].index("<article>") :].split("</article>")[0]
        assert text and "\n\n\n" not in text and "<" not in text.replace("< ", "")
        assert abs(len(text.split()) - len(regex.sub("<[^>]*>", " ", body).split())) <= 2
    df = spark.createDataFrame([(1, None), (2, "<p>hi</p>")], "page_id int, html string")
    assert [(r["text"], r["n_chars"]) for r in htmltext.with_main_text(df).collect()] == [("", 0), ("hi", 2)]
    assert htmltext.with_main_text(df.limit(0)).count() == 0


_ARTICLE = "<p>A long first paragraph, with some words. And more.</p><p>Second one, also here.</p>"
_TEXT = "A long first paragraph, with some words. And more.\n\nSecond one, also here."


@pytest.mark.parametrize(("page", "text"), [
    (f"<nav>Home, here.</nav><article class='post tags'>{_ARTICLE}</article><div class=ad>Buy, now.</div>", _TEXT), (f"<div class='has-sidebar'>{_ARTICLE}<div class=sidebar>Related, here.</div></div>", _TEXT),
    (f"<div><div>{_ARTICLE}</div><div class=comments><p>{'I say, so it is. ' * 30}</p></div></div>", _TEXT), ("<p title=it's>one, two</p><p>x's three. four</p>", "one, two\n\nx's three. four"),
    ("<!--><p>shown, yes.</p>", "shown, yes."), ("<!---><p>shown, yes.</p>", "shown, yes."), ("<p>a<!-- <p>no --!> b.</p>", "a b."), ("<p>" + "İ" * 40 + "</p><script>no</script><p>next, yes.</p>", "İ" * 40 + "\n\nnext, yes."),
    ("<p>a <math><mi>x</mi>+<mn>2</mn></math> b <object>o</object> <canvas>c</canvas> d.</p>", "a x+2 b o c d."), ("<p>&<b>amp;</b> &lt;x", "&amp; <x"), ("<p a='x>y' b=\"z>\">in, q.</p>", "in, q."),
    ("<p>1 < 2 and 3 > 2.</p></><p>k.</p>", "1 < 2 and 3 > 2.\n\nk."), ("<template><p>hid, den.</p></template><p>seen, yes.</p>", "seen, yes."), ("<p>cut <a href='x", "cut"), ("<SCRIPT>if (a</b) {}</ScRiPt ><p>after, it.</p>", "after, it."),
])
def test_pages_that_mislead(page, text):
    assert htmltext.main_text(page) == text


def brute_content(found):
    """Nodes above the threshold, by the rule of the docstring, with paths as tuples of steps."""
    steps_of = {}
    for path, _ in found:
        steps, step = [], path
        while step is not None:
            steps.append(step)
            step = step.parent
        steps_of[path] = tuple(reversed(steps))
    most = [max(getattr(p, what) for p in steps_of) + 1 for what in ("chars", "marks")]
    ratio = {p: math.sqrt((p.chars + 1) / most[0] * (p.marks + 1) / most[1]) for p in steps_of}
    mean = sum(ratio.values()) / len(ratio)
    least = htmltext.SPREAD * math.sqrt(sum((r - mean) ** 2 for r in ratio.values()) / len(ratio))

    def score(path):
        steps = steps_of[path]
        last = max([i for i, s in enumerate(steps) if s.side < 1], default=0)
        return max(ratio.get(s, 0.0) for s in steps[last:]) * math.prod(s.side for s in steps)

    best = 0.6 * max(map(score, steps_of))
    least = best if len({(p.chars, p.marks) for p in steps_of}) == 1 else min(best, least)
    return [text for p, text in found if score(p) >= least - 1e-12]


def test_content_equals_brute_force(spark, sf_dir):
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rng = random.Random(3)
    tags = ["<div>", "</div>", "<p>", "</p>", "<div class=ad>", "<article>", "</article>", "<ul><li>", "</ul>", "<h2>", "</h2>", "<footer>", "</footer>", "<b>", "</b>", "<td>", "<a>", "</a>", "<div class='share tags'>"]
    pages += ["".join(rng.choice(tags) + rng.choice(["", "Word.", "some words here, and there.", "x" * 80]) for _ in range(40)) for _ in range(300)]
    for page in pages:
        found = htmltext.nodes(page)
        assert htmltext.main_text(page) == ("\n\n".join(brute_content(found)) if found else "")


def test_ratios_decide(spark, sf_dir, monkeypatch):
    """Neither constant ratios nor a drop by words alone give the result."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    right = [htmltext.main_text(p) for p in pages]
    for page, text in zip(pages, right):  # the article's blocks, whole
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", page, re.S)
        assert text == "\n\n".join(t for _, t in htmltext.nodes(inner[1]))
    long = "An article's own paragraph, with a comma and more. " * 6
    own = [f"<article><p>{long}</p><p>{long}</p><div class='{c}'><p>{long}</p></div></article>" for c in ("search-result", "share", "tags", "social", "header")]
    beside = f"<div><a href=x>One</a> <a href=y>Two</a></div><div>Buy now.</div><article><p>{long}</p><p>{long}</p></article>"  # no word tells it
    small = f"<article><p>{long}</p></article><div class=tags>red, green</div>"
    assert all(htmltext.main_text(p).count("paragraph") == 18 for p in own)
    assert htmltext.main_text(beside) == htmltext.main_text(small + f"<article><p>{long}</p></article>") == "\n\n".join([long.strip()] * 2)
    assert htmltext.main_text(f"<article><p>{long}</p><h2>Short</h2><ul><li>one</li><li>two</li></ul></article>").endswith("Short\n\none\n\ntwo")
    monkeypatch.setattr(htmltext, "path_ratios", lambda paths: dict.fromkeys(paths, 1.0))
    assert sum(htmltext.main_text(p) != t for p, t in zip(pages, right)) > 0.9 * len(pages)


def test_no_depth_is_cut():
    deep = "<div>" * 3000
    long = "Some text, and more. " * 20
    assert htmltext.main_text(f"{deep}<template><p>{long}</p></template><p>seen</p>") == "seen"
    a, b = "one two three four five", "one two three four six"
    found = htmltext.nodes(f"<div class='{a}'><p>x</p></div><div class='{b} comments'><p>y</p></div>")
    assert found[0][0] is not found[1][0]


def test_page_columns_clash(spark):
    df = spark.createDataFrame([(1, "<p>hi", 2.5, "r")], "page_id int, html string, n_chars double, row string")
    got = htmltext.with_main_text(df)
    assert got.columns == ["page_id", "html", "n_chars", "row", "text"] and tuple(got.first()) == (1, "<p>hi", 2, "r", "hi")


@pytest.mark.parametrize("piece", ["<div>", "<b>", "<x-a><p>t.", "<div><p>t.", "<b><div><i>", "<i></b>", "<td>", "<li><x-a>"])
def test_deep_pages_take_linear_time(piece):
    began = time.process_time()
    htmltext.main_text(piece * 50_000 + "x")
    assert time.process_time() - began < 20


@pytest.mark.parametrize("page", ["<" * 50_000, '<p class="' * 5000, "<div>" * 5000 + "x", "<b>x" * 5000, "<script>" * 5000, '<a "' * 5000])
def test_hostile_pages(page):
    htmltext.main_text(page)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def brute_score(text, w):
    """The score by plain dictionaries: share of each feature in its group times its weight."""
    words = text.split()
    if not words:
        return 1 / (1 + math.exp(-w[-1]))
    wrap = lambda x: x % (1 << 64)
    mix = 0x9E3779B97F4A7C15
    slot = lambda key: (wrap((key ^ (key >> 31)) * mix) >> 40) & quality._MASK
    crc, shape = [zlib.crc32(x.encode()) for x in words], [quality._shape(x) for x in words]
    groups = [[slot(wrap(c * 3)) for c in crc]]
    if len(words) > 1:
        groups.append([slot(wrap(wrap(wrap(a * mix) + b) * 3 + 1)) for a, b in itertools.pairwise(crc)])
        groups.append([slot(wrap(wrap((a * 1024 + b) * 2 + (crc[i] == crc[i + 1])) * 3 + 2)) for i, (a, b) in enumerate(itertools.pairwise(shape))])
    total = float(w[-1]) + sum(n / len(g) * float(w[f]) for g in groups for f, n in collections.Counter(g).items())
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))


def brute_ftrl(rows, epochs):
    """FTRL-proximal by its published formulas, one coordinate at a time."""
    z, n, bias = collections.defaultdict(float), collections.defaultdict(float), 1 << quality.BITS

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for index, value, label in rows:
            x = {int(i): 4.0 * v for i, v in zip(index, value)} | {bias: 0.25}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) * (0.25 if i == bias else 4.0) for i in z}


def test_scores_equal_brute_force(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    w = weights.astype(np.float32)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "one"), (-4, "long words. " * 100_000)], "doc_id long, text string")
    for r in quality.with_quality(docs.unionByName(extra), weights).collect():
        assert abs(r["score"] - brute_score(r["text"] or "", w)) < 1e-6
    sparse = quality.Featurizer().sparse
    rows = [(*sparse(t), i % 2) for i, t in enumerate(documents[:60])]
    fitted = quality.fit_ftrl(rows)
    assert all(abs(fitted[i] - v) < 1e-6 for i, v in brute_ftrl(rows, quality.EPOCHS).items())


def test_quality_of_any_ids(spark):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    docs = spark.createDataFrame([(f"id{i}", words(i), "k") for i in range(30)] + [("id1", words(99), "k")] * 5, "doc_id string, text string, _id string")
    labels = spark.createDataFrame([(f"id{i}", i % 2) for i in range(30)], "doc_id string, quality int")
    weights = quality.fit_quality(docs, labels, max_rows=10)
    got = quality.with_quality(docs, weights)
    assert got.columns == ["doc_id", "text", "_id", "score"] and got.count() == 35 and np.count_nonzero(weights)


def test_counts_and_digests_keep_columns(spark):
    df = spark.createDataFrame([(1, "two words", "a", "b", "c")], "doc_id int, text string, row string, found string, _digest string")
    got = bpe.with_token_digest(df, PATH, P.PATTERN)
    assert got.columns == [*df.columns, "n_tokens", "ids_sha256", "decoded_sha256"] and tuple(got.first())[2:6] == ("a", "b", "c", 2)
    got = tokencount.with_token_counts(df.withColumnRenamed("_digest", "_counts"), PATH, P.PATTERN)
    assert tuple(got.first()) == (1, "two words", "a", "b", "c", 2, 2)
    assert tokencount.with_token_counts(df.limit(0), PATH, P.PATTERN).count() == 0


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "fine words here", "x"), (2, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    weights = quality.fit_quality(docs, labels)
    assert [r["score"] for r in quality.with_quality(docs, weights).collect()] == [0.5] * 4
    assert quality.with_quality(docs.limit(0), weights).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit_quality(docs, one).shape == (quality._MASK + 2,)
