"""URL filter (operator 4): a weighted vocabulary searched by Aho-Corasick, under explicit rules.

One automaton finds every vocabulary term in the lower-cased (A-Z) URL.  A hit counts if
no letter or digit stands on either side, and a term counts once.  One strict term (of
weight ``STRICT`` or more), or soft terms whose weights add up to ``STRICT``, block the
URL; a soft term alone never does.  The vocabulary is a file of lines ``term weight``
(``read_vocabulary``) or a table (``vocabulary_of``), widened to thousands of terms by a rule (``compounds``) if wanted.  Rules (host, path) come first: a
rule fits its host and all subdomains if the URL's path starts with the rule's, and the
longest wins; of equal rules the first.

Defined results: a null URL, or one without ``://``, has an empty host and path; no
rule fits an empty host, and the vocabulary is still looked for in what there is.
Long URLs are read whole.  Repeated rows get equal results, an empty table an empty
one; extra columns pass through, whatever their names, unless they carry a result's
name, in which case the result replaces them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, with_results

#: Weight from which on a term blocks alone, and which soft terms must reach together.
STRICT = 100
#: Rows that ``vocabulary_of`` takes from a table, at most: they go to every worker.
MOST_TERMS = 1_000_000
OWN_VOCABULARY = os.path.join(os.path.dirname(os.path.abspath(__file__)), "url_vocabulary.txt")
_TO_LOWER = str.maketrans(UPPER, LOWER)


def read_vocabulary(path: str = OWN_VOCABULARY) -> tuple[tuple[str, int], ...]:
    """Terms and weights from a file; empty lines and those that start with # are skipped."""
    with open(path, encoding="utf-8") as lines:
        pairs = (line.split() for line in lines if line.strip() and not line.startswith("#"))
        return tuple((term, int(weight)) for term, weight in pairs)


#: Words that strict terms are joined with in host names.
AFFIXES = tuple("4u 24 69 all best big blog chat city club daily direct easy fan forum free guide hd home hot hub king land list live mania my now online open planet play plus portal pro real review shop site star store super the time top tube tv vip web win world zone".split())
#: Digits that stand for letters.
DIGITS = str.maketrans("aeiost", "431057")


def compounds(vocabulary) -> tuple[tuple[str, int], ...]:
    """A vocabulary with the spellings that host names have, thousands of terms by a rule.

    Strict terms joined with ``AFFIXES`` at either end, and written with digits, weigh as they do; two soft terms
    written as one weigh what both do together.  Terms of the vocabulary itself keep their weights.
    """
    own = dict(vocabulary)
    strict, soft = [t for t, w in own.items() if w >= STRICT], [t for t, w in own.items() if w < STRICT]
    made = {a + b: own[t] for t in strict for x in AFFIXES for a, b in ((t, x), (x, t))}
    made |= {t.translate(DIGITS): own[t] for t in strict}
    made |= {a + b: own[a] + own[b] for a in soft for b in soft if a != b}
    return tuple((made | own).items())


def vocabulary_of(terms: DataFrame) -> tuple[tuple[str, int], ...]:
    """Terms and weights from a table (term, weight) of at most ``MOST_TERMS`` rows."""
    found = terms.select(F.col("term").cast("string"), F.col("weight").cast("int")).where("term <> '' AND weight IS NOT NULL").limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"the vocabulary has more than {MOST_TERMS} terms")
    return tuple(map(tuple, found))


class UrlJudge:
    """Rules and vocabulary compiled once."""

    def __init__(self, rules, vocabulary):
        import ahocorasick

        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for action, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, action))
        self.weight = dict(vocabulary)
        self.automaton = ahocorasick.Automaton()
        for term in self.weight:
            self.automaton.add_word(term, term)
        self.automaton.make_automaton()

    @staticmethod
    def parts(url: str | None) -> tuple[str, str]:
        """Host and path; the query and the fragment belong to neither."""
        _, found, rest = (url or "").partition("://")
        if not found:
            return "", ""
        ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
        cut = min(ends, default=len(rest))
        tail = rest[cut:]
        return rest[:cut].translate(_TO_LOWER), tail[: min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))]

    def rule(self, host: str, path: str) -> tuple[str, str] | tuple[None, None]:
        best: tuple[str | None, str | None] = (None, None)
        while host:
            for start, action in self.by_host.get(host, ()):
                if path.startswith(start) and len(host + start) > len(best[0] or ""):
                    best = host + start, action
            host = host.partition(".")[2]
        return best

    def hits(self, url: str | None) -> tuple[int, int, int]:
        """Number of different strict terms, and number and weight of different soft ones, that stand alone."""
        low = (url or "").translate(_TO_LOWER)
        found = set()
        for last, term in self.automaton.iter(low) if low else ():
            start = last + 1 - len(term)
            if not (start and low[start - 1].isalnum()) and not low[last + 1 : last + 2].isalnum():
                found.add(term)
        soft = [w for term in found if (w := self.weight[term]) < STRICT]
        return len(found) - len(soft), len(soft), sum(soft)

    def judge(self, url: str | None):
        host, path = self.parts(url)
        rule, action = self.rule(host, path)
        strict, soft, weight = self.hits(url)
        return host, path, rule, action or ("block" if strict or weight >= STRICT else "allow"), strict, soft, weight


@lru_cache(maxsize=2)
def _judge(rules, vocabulary) -> UrlJudge:
    return UrlJudge(rules, vocabulary)


def with_url_verdict(df: DataFrame, rules, url: str = "url", vocabulary=None) -> DataFrame:
    """``df`` with host, path, rule, verdict, strict_terms, soft_terms and soft_weight.

    ``rules``: (``allow`` or ``block``, ``host/path``); ``vocabulary``: (term, weight), by default
    the file that lies beside this module.
    """
    terms = dict(read_vocabulary() if vocabulary is None else vocabulary)
    given = tuple(map(tuple, rules)), tuple(terms.items())
    names = ["host", "path", "rule", "verdict", "strict_terms", "soft_terms", "soft_weight"]
    types = {c: object for c in names[:4]} | {c: "int32" for c in names[4:]}

    @F.pandas_udf("host string, path string, rule string, verdict string, strict_terms int, soft_terms int, soft_weight int")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = _judge(*given).judge
        for batch in batches:
            yield pd.DataFrame([of(u) for u in batch], columns=names).astype(types)

    return with_results(df, judged(F.col(url).cast("string")), names)
