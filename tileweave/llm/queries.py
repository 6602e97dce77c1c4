"""One thin query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exactdedup, fim, htmltext, langid, linededup, neardup, quality, sharding, tokencount, urlfilter, whitening
from .common import LOWER, UPPER, dealt, staged, table

RANKS = "byte_bpe_50k.tiktoken"
QUALITY_THRESHOLD = 0.3
SHARDS = 40
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokencount.with_token_counts(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return neardup.near_classes(docs).drop("node")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    weights = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_quality(docs, weights)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % quality.HELD_OUT_OF == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.with_url_verdict(pages, URL_RULES, vocabulary=urlfilter.compounds(urlfilter.read_vocabulary())).drop("url")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = dealt(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return htmltext.with_main_text(pages).drop("html")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), SHARDS)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = linededup.without_repeated_chunks(docs)
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe.with_token_digest(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whitening.quantised(F.col("embedding")).alias("vector")).where(F.col("vector").isNotNull())
    rows = dealt(rows)
    fit = staged(whitening.fit_list(rows), "fit-list")
    model = whitening.fit_whitening(fit)
    error = whitening.identity_error(fit, model)
    projected = whitening.with_whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues[: whitening.COMPONENTS]]).cast("array<double>")
    return projected.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "place").alias("explained"), F.lit(error).alias("identity_error")
    )


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % langid.HELD_OUT_OF == langid.HELD_OUT
    found = staged(langid.profiles(dealt(docs.where(~F.coalesce(held_out, F.lit(False))))), "profiles")
    rows = dealt(docs.select("doc_id", held_out.alias("held_out"), "text"))
    return langid.with_language(rows, found).select("doc_id", "held_out", "lang_pred", "score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = fim.with_restored(fim.with_fim(docs))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality": op3_quality,
    "op4_url_filter": op4_url_filter,
    "op5_main_text": op5_main_text,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_whitening": op11_whitening,
    "op12_language": op12_language,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def _url_sql() -> str:
    """The URL contract in SQL: longest fitting rule, else the vocabulary's verdict."""
    fits = [(rule, action, *rule.split("/", 1)) for action, rule in URL_RULES]
    longest = "CASE " + " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule}'" for rule, _, host, path in sorted(fits, key=lambda r: -len(r[0]))
    ) + " END"
    action = "CASE rule " + " ".join(f"WHEN '{rule}' THEN '{action}'" for rule, action, *_ in fits) + " END"
    terms = ", ".join(f"('{term}', {weight})" for term, weight in urlfilter.compounds(urlfilter.read_vocabulary()))
    low = lambda column: f"translate({column}, '{UPPER}', '{LOWER}')"
    return f"""
WITH cut AS (SELECT row_number() OVER () AS i, page_id, {low("coalesce(url, '')")} AS low,
    coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
parts AS (SELECT i, page_id, low, {low("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
vocabulary(term, weight) AS (VALUES {terms}),
words AS (SELECT DISTINCT i, unnest(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}]+')) AS term FROM cut),
hits AS (SELECT i, count(*) FILTER (weight >= {urlfilter.STRICT}) AS strict_terms, count(*) FILTER (weight < {urlfilter.STRICT}) AS soft_terms,
    sum(weight) FILTER (weight < {urlfilter.STRICT}) AS soft_weight FROM words JOIN vocabulary USING (term) GROUP BY i),
ruled AS (SELECT parts.*, {longest} AS rule, coalesce(strict_terms, 0) AS strict_terms, coalesce(soft_terms, 0) AS soft_terms, coalesce(soft_weight, 0) AS soft_weight
    FROM parts LEFT JOIN hits ON parts.i = hits.i)
SELECT page_id, host, path, rule, coalesce({action}, CASE WHEN strict_terms > 0 OR soft_weight >= {urlfilter.STRICT} THEN 'block' ELSE 'allow' END) AS verdict,
    strict_terms::INT AS strict_terms, soft_terms::INT AS soft_terms, soft_weight::INT AS soft_weight FROM ruled
"""


#: CRC-32 of an id as text, a byte at a time and a bit at a time.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

#: Words' n-grams packed as numbers, ranks by document and by language, and the least out-of-place distance.
_LANGUAGE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, lang, {_CRC_SQL} % {langid.HELD_OUT_OF} = {langid.HELD_OUT} AS held_out, lower(coalesce(text, '')) AS low FROM documents),
w AS (SELECT i, w, count(*) AS n FROM (SELECT i, unnest(regexp_extract_all(low, '[\\p{{L}}\\p{{M}}]+')) AS w FROM d WHERE regexp_matches(low, '\\p{{L}}')) GROUP BY ALL),
v AS (SELECT DISTINCT w, list_transform(range(0, length(w) + 2), lambda k: unicode(substr(' ' || w || ' ', k + 1, 1))::BIGINT) AS u FROM w),
g AS (SELECT w, unnest(list_concat(u[2:len(u) - 1], list_transform(range(1, len(u)), lambda k: u[k] * 2097152 + u[k + 1]),
    list_transform(range(1, len(u) - 1), lambda k: (u[k] * 2097152 + u[k + 1]) * 2097152 + u[k + 2]))) AS gram FROM v),
k AS (SELECT w, gram, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT i, gram, sum(w.n * k.n) AS n FROM w JOIN k USING (w) GROUP BY ALL),
own AS (SELECT i, gram, row_number() OVER (PARTITION BY i ORDER BY n DESC, gram) - 1 AS rank FROM c QUALIFY rank < {langid.SIZE}),
learned AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS rank FROM c JOIN d USING (i)
    WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, gram QUALIFY rank < {langid.SIZE}),
far AS (SELECT i, lang, sum(coalesce(abs(own.rank - learned.rank), {langid.SIZE})) AS distance, count(*) AS n
    FROM own CROSS JOIN (SELECT DISTINCT lang FROM learned) LEFT JOIN learned USING (lang, gram) GROUP BY i, lang),
best AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY i ORDER BY distance, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, '{langid.UNKNOWN}') AS lang_pred, coalesce(1.0::DOUBLE - distance::DOUBLE / ({langid.SIZE} * n), 0.0::DOUBLE) AS score FROM d LEFT JOIN best USING (i)
"""

_FIM_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines, sha256('{fim.SEED}:' || doc_id) AS h FROM documents),
u AS (SELECT *, len(lines) AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS low, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= {fim.FIM_PERCENT} THEN 'plain' WHEN r[4] % 100 < {fim.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(lines[1:low], '') AS prefix, array_to_string(lines[low + 1:high], '') AS middle, array_to_string(lines[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM p
"""

ORACLE_SQL: dict[str, str] = {
    "op12_language": _LANGUAGE_SQL,
    "op13_fill_in_middle": _FIM_SQL,
    "op4_url_filter": _url_sql(),
    "op9_exact_dedup": f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM n
""",
}
