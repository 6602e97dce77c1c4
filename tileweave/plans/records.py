"""Queries over records in binary columns, each with its SQL: expressions and definitions compiled to Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import write_signed, write_unsigned
from ..operators import chains, segments
from ..structure import columns
from ..structure.layout import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- expressions --------------------------------------------------------------

#: Name, expression, and the same in SQL; q and k are whole, p is not, f and s are text.
EXPRESSIONS = (
    ("sums", "k + q * 3 - 7", "k + q * 3 - 7"),
    ("mixed_sum", "p + q", "p + q"),
    ("joined", "f + s", "f || s"),
    ("whole_division", "(q - 25) / 7", "CAST(trunc((q - 25) / 7.0) AS BIGINT)"),
    ("division", "p / 4 - 1.5", "p / 4 - 1.5"),
    ("no_division", "k / (q - q)", "CAST(NULL AS BIGINT)"),
    ("remainder", "(q - 25) % 7", "(q - 25) % 7"),
    ("no_remainder", "k % (q - q)", "CAST(NULL AS BIGINT)"),
    ("bits", "k & 255 | q << 3 ^ 5", "(k & 255) | xor(q << 3, 5)"),
    ("shifted", "k >> 2 << 1", "(k >> 2) << 1"),
    ("not_shifted", "k << 64", "CAST(NULL AS BIGINT)"),
    ("inverted", "~q - -3", "-q - 1 + 3"),
    ("ordered", "q > 10 and p <= 50000.5 or f == 'R'", "(q > 10 AND p <= 50000.5) OR f = 'R'"),
    ("not_ordered", "f < 3", "CAST(NULL AS BOOLEAN)"),
    ("short_cut", "q < 60 or f < 3", "q < 60 OR CAST(NULL AS BOOLEAN)"),
    ("negated", "not (f != 'A')", "f = 'A'"),
    ("other_kinds", "f == q", "false"),
    ("near", "q == 10.0", "q = 10"),
    ("to_number", "s.to_i + f.length", "CAST(trim(s) AS BIGINT) + length(f)"),
    ("no_number", "f.to_i", "CAST(NULL AS BIGINT)"),
    ("to_text", "q.to_s + s.strip", "CAST(q AS VARCHAR) || trim(s)"),
)

_LINES_SQL = "(SELECT l_orderkey, l_linenumber, l_orderkey AS k, CAST(l_quantity AS BIGINT) AS q, l_extendedprice AS p, l_returnflag AS f, '  ' || l_linenumber || ' ' AS s FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(f'{sql} AS {name}' for name, _, sql in EXPRESSIONS)} FROM {_LINES_SQL}")
def compiled_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operator and method of the expression language over the lines of orders."""
    given = columns.scope({
        "k": (F.col("l_orderkey"), "int"), "q": (F.col("l_quantity"), "int"), "p": (F.col("l_extendedprice"), "float"), "f": (F.col("l_returnflag"), "str"),
        "s": (F.concat(F.lit("  "), F.col("l_linenumber").cast("string"), F.lit(" ")), "str"),
    })
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[columns.compiled(text, given).column.alias(name) for name, text, _ in EXPRESSIONS])


# --- definitions --------------------------------------------------------------

ORDER = load("""
meta: {id: order, endian: be}
enums: {states: {0: none, 1: one, 2: two}}
seq:
  - {id: kind, type: u1}
  - {id: state, type: u1, enum: states}
  - {id: wide, type: str, size: 2}
  - {id: priority, type: str, size: wide.to_i}
  - {id: customer, type: u4, if: kind & 1 == 1}
  - {id: count, type: u2}
  - {id: marks, type: mark, repeat: expr, repeat-expr: count}
  - {id: days, type: s4}
  - {id: steps, type: u1, repeat: until, repeat-until: _ == 0}
  - {id: head, type: head}
  - {id: rest, size-eos: true}
types:
  mark: {seq: [{id: size, type: u1}, {id: name, type: str, size: size - 1}]}
  head: {seq: [{id: low, type: u3}, {id: high, type: s2, if: low % 2 == 0}]}
""")


def order_bytes() -> Column:
    """The record of an order, as ``ORDER`` has it; every sixteenth by its last digits is cut."""
    key, text = F.col("o_orderkey"), F.col("o_orderpriority")
    mark = lambda i: F.concat(write_unsigned(i + 2, 1), F.encode(F.repeat("o_orderstatus", i + 1), "UTF-8"))
    joined = lambda parts: F.unhex(F.array_join(F.transform(parts, F.hex), ""))
    marks = F.when(key % 4 > 0, F.sequence(F.lit(0), (key % 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    steps = F.sequence((key % 3).cast("int"), F.lit(0), F.lit(-1))
    whole = F.concat(
        write_unsigned(key % 8, 1), write_unsigned(key % 5, 1), F.encode(F.lpad(F.length(text).cast("string"), 2, "0"), "UTF-8"), F.encode(text, "UTF-8"),
        F.when(key % 2 == 1, write_unsigned(F.col("o_custkey"), 4)).otherwise(F.lit(b"")), write_unsigned(key % 4, 2), joined(F.transform(marks, mark)),
        write_signed(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")), 4), joined(F.transform(steps, lambda i: write_unsigned(i, 1))),
        write_unsigned(key, 3), F.when(key % 2 == 0, write_signed(-(key % 30000), 2)).otherwise(F.lit(b"")), F.encode("o_orderstatus", "UTF-8"),
    )
    return F.when(key % 16 == 5, F.substr(whole, F.lit(1), F.octet_length(whole) - 7)).otherwise(whole)


@query("""
WITH o AS (SELECT *, o_orderkey AS k, o_orderkey % 16 = 5 AS cut, length(o_orderpriority) AS wide, o_orderkey % 4 AS n FROM orders),
p AS (SELECT *, 4 + wide + CASE WHEN k % 2 = 1 THEN 4 ELSE 0 END + 2 AS marks_at, CAST(n * (n + 1) // 2 + n AS BIGINT) AS marks_len FROM o)
SELECT k AS o_orderkey, k % 8 AS kind, CASE k % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE CAST(k % 5 AS VARCHAR) END AS state, o_orderpriority AS priority,
    CASE WHEN k % 2 = 1 THEN o_custkey END AS customer, n AS count, CASE n WHEN 0 THEN '' WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderstatus || ',' || repeat(o_orderstatus, 2)
        ELSE o_orderstatus || ',' || repeat(o_orderstatus, 2) || ',' || repeat(o_orderstatus, 3) END AS marks,
    CASE WHEN NOT cut OR k % 3 = 2 THEN CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) END AS days,
    CASE WHEN NOT cut THEN array_to_string(list_reverse(range(k % 3 + 1)), '') WHEN k % 3 = 2 THEN '' END AS steps, CASE WHEN NOT cut THEN k % 16777216 END AS low,
    CASE WHEN NOT cut AND k % 2 = 0 THEN -(k % 30000) END AS high, CASE WHEN NOT cut THEN o_orderstatus END AS rest,
    marks_at AS marks_start, marks_len AS marks_length, CASE WHEN k % 2 = 1 THEN 4 + wide END AS customer_start,
    CASE WHEN cut THEN CASE k % 3 WHEN 2 THEN 'head.low: the data end early' ELSE 'order.days: the data end early' END END AS error FROM p
""")
def parsed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of orders written as bytes and parsed by a definition, wholly in the JVM; cut ones tell where they end."""
    made = read(spark, sf_dir, "orders").select("o_orderkey", order_bytes().alias("data"))
    found = columns.parsed(made, ORDER, "data").select("o_orderkey", "record.*")
    one = lambda name: F.col(f"value.{name}")
    return found.select(
        "o_orderkey", one("kind"), one("state"), one("priority"), one("customer"), one("count"), F.array_join(F.transform(one("marks"), lambda m: m["name"]), ",").alias("marks"), one("days"),
        F.array_join(F.transform(one("steps"), lambda s: s.cast("string")), "").alias("steps"), one("head.low"), one("head.high"), F.decode(one("rest"), "UTF-8").alias("rest"),
        F.col("place.marks.start").alias("marks_start"), F.col("place.marks.length").alias("marks_length"), F.col("place.customer.start").alias("customer_start"), "error",
    )


# --- chains of records --------------------------------------------------------


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, rpad(upper(substr(o_orderpriority, 3, 4)), 6, ' ') AS tag, o_orderstatus || o_orderkey AS data FROM orders),
p AS (SELECT *, row_number() OVER w - 1 AS place, sum(11 + length(data)) OVER w - 11 - length(data) AS start, sum(11 + length(data)) OVER (PARTITION BY o_custkey) AS whole,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS last FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, CAST(place AS INT) AS place, CAST(start AS BIGINT) AS start, CASE WHEN NOT (last AND o_custkey % 5 = 0) THEN rtrim(tag) END AS tag, CASE WHEN NOT (last AND o_custkey % 5 = 0) THEN data END AS data,
    CASE WHEN last AND o_custkey % 5 = 0 THEN 'the record is cut' END AS error FROM p
""")
def record_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as one chain of tagged records, walked by their lengths; every fifth chain ends inside its last record."""
    tag = F.upper(F.substring("o_orderpriority", 3, 4))
    made = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", segments.record(tag, F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))).alias("record"))
    chains = made.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "record"))).alias("r"))
    chain = F.encode(F.array_join(F.transform("r", lambda x: x["record"]), ""), "UTF-8")
    cut = F.when(F.col("o_custkey") % 5 == 0, F.substr(chain, F.lit(1), F.octet_length(chain) - 1)).otherwise(chain)
    walked = chains.select("o_custkey", F.posexplode(segments.walked_records(cut)).alias("place", "r"))
    return walked.select("o_custkey", "place", F.col("r.at").alias("start"), "r.tag", F.decode("r.data", "UTF-8").alias("data"), "r.error")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, 12 + CAST(l_quantity AS BIGINT) AS len FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
q AS (SELECT *, 4 + sum(len) OVER w - len AS off, row_number() OVER w - 1 AS place, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1 AS last FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, CAST(place AS INT) AS place, CAST(off AS BIGINT) AS off, CASE WHEN NOT (last AND l_orderkey % 7 = 3) THEN l_partkey % 65536 END AS tile, CASE WHEN NOT (last AND l_orderkey % 7 = 3) THEN CAST(l_linenumber AS BIGINT) END AS part,
    CASE WHEN last AND l_orderkey % 7 = 5 THEN len + 2 WHEN NOT (last AND l_orderkey % 7 = 3) THEN len END AS len, CASE WHEN last AND l_orderkey % 7 = 3 THEN 'the tile part is longer than the codestream' END AS error, NOT (last AND l_orderkey % 7 IN (3, 5)) AS told FROM q
""")
def tile_part_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codestreams of an order's lines, walked part by part and compared with the table of their lengths; some miss their last byte and some tell no length of their last part."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("tile"), (F.max("l_quantity").cast("bigint") + 12).alias("len"))
    parts = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "tile", "len"))).alias("p"))
    last = lambda i: i == F.size("p") - 1
    shown = lambda i, n: F.when(last(i) & (F.col("l_orderkey") % 7 == 5), F.lit(0)).otherwise(n)
    part = lambda x, i: F.concat(F.lit("FF90000A"), F.hex(write_unsigned(x["tile"] % 65536, 2)), F.hex(write_unsigned(shown(i, x["len"]), 4)), F.hex(write_unsigned(x["l_linenumber"], 1)), F.lit("01"), F.repeat(F.lit("AB"), (x["len"] - 12).cast("int")))
    whole = F.unhex(F.concat(F.lit("FF4F0000"), F.array_join(F.transform("p", part), ""), F.lit("FFD9")))
    cut = F.when(F.col("l_orderkey") % 7 == 3, F.substr(whole, F.lit(1), F.octet_length(whole) - 3)).otherwise(whole)
    table = chains.running_places(F.transform("p", lambda x: x["len"]), F.lit(4))
    walk = parts.select("l_orderkey", F.posexplode(F.arrays_zip(chains.walked_tile_parts(cut, F.lit(4)).alias("w"), table.alias("t"))).alias("place", "z"))
    told = (F.col("z.w.at") == F.col("z.t.off")) & F.coalesce(F.col("z.w.length") == F.col("z.t.len"), F.lit(False))
    return walk.select("l_orderkey", "place", F.col("z.w.at").alias("off"), "z.w.tile", "z.w.part", F.col("z.w.length").alias("len"), "z.w.error", told.alias("told"))
