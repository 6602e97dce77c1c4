"""Helpers shared by the text operators: inputs, staging tables, bounded memos."""

from __future__ import annotations

import uuid
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its files are fewer; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_or_empty(name: str = "text"):
    """The column as a string in which null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value, body):
    """``body`` of ``value`` as one expression in which ``value`` is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: The folder of each application that names none, so that one application uses one folder.
_CHOSEN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a local master gets a
    temporary folder and any other master a folder in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _CHOSEN:
            master = spark.sparkContext.master
            local = master.startswith("local") and not master.startswith("local-cluster")
            _CHOSEN[app] = "file://" + mkdtemp(prefix="tileweave-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
        found = _CHOSEN[app]
    return found.rstrip("/")


#: Paths of staged tables by application.
_LIVE: dict[str, list[str]] = {}


def _file(spark: SparkSession, path: str):
    """The JVM's file system and path of a folder."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the steps before.
    The table goes when the session's driver ends, or earlier by ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tileweave-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    system, place = _file(spark, path)
    system.deleteOnExit(place)
    _LIVE.setdefault(spark.sparkContext.applicationId, []).append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_at = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``staged`` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path is not None:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    system, place = _file(spark, path)
    system.delete(place, True)
    live = _LIVE.get(spark.sparkContext.applicationId, [])
    if path in live:
        live.remove(path)


def staged_now(spark: SparkSession) -> set[str]:
    """The tables that ``staged`` has written and nothing has dropped."""
    return set(_LIVE.get(spark.sparkContext.applicationId, []))


def drop_newer(spark: SparkSession, before: set[str], *kept: DataFrame) -> None:
    """Deletes what was staged since ``before`` was taken, but for ``kept``: a step's own tables, once its result is written."""
    held = before | {getattr(df, "_staged_at", None) for df in kept}
    for path in staged_now(spark) - held:
        _delete(spark, path)


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` as one struct column, so that no column of the user's can clash with one of an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_results(df: DataFrame, found, names: list[str], to: list[str] | None = None) -> DataFrame:
    """``df`` with the fields ``names`` of the struct ``found``, called ``to``; a column of a result's name is replaced where it stands."""
    to = to or names
    result = dict(zip(to, names))
    both = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), found.alias("found"))
    columns = [*df.columns, *[c for c in to if c not in df.columns]]
    return both.select(*[F.col(f"found.{result[c]}" if c in result else f"row.`{c}`").alias(c) for c in columns])


def digest(text: str):
    """128 bits that tell texts apart; null counts as the empty text."""
    return F.unhex(F.md5(text_or_empty(text).cast("binary")))


#: A filter that ``may_be_among`` broadcasts has at most so many bits, a row of two numbers for each 64.
MOST_FILTER_BITS = 1 << 25
FILTER_BITS = 1 << 22


def filter_bits(keys: int) -> int:
    """Bits for so many keys: a power of two, few false positives, within a fixed bound."""
    return min(MOST_FILTER_BITS, max(1 << 16, 1 << (64 * max(keys, 1) - 1).bit_length()))


def may_be_among(df: DataFrame, key, keys: DataFrame, key_of_keys=None, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with the boolean ``_maybe``: false only if the long ``key`` is none of ``keys``.

    The keys are folded into a bitmap of fixed size, so a join need not move the rows
    that can't have a partner.  With more than some 30 million keys a bitmap of
    ``MOST_FILTER_BITS`` rules out less and less, and the join moves what a plain one would: results are the same.
    """
    bit = lambda k: F.pmod(k, F.lit(bits))
    folded = keys.select(bit(key if key_of_keys is None else key_of_keys).alias("_bit"))
    words = folded.groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_bits"))
    marked = df.withColumn("_bit", bit(key)).withColumn("_at", F.shiftright("_bit", 6))
    joined = marked.join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")  # at most bits / 64 rows
    return joined.withColumn("_maybe", F.coalesce(F.expr("getbit(_bits, cast(_bit & 63 as int)) = 1"), F.lit(False))).drop("_bit", "_at", "_word", "_bits")


#: A key that holds more than this share of a side's rows is dealt out to several tasks; a side of ``ONE_TASK`` rows is no more than a task's work.
HOT_SHARE, ONE_TASK = 1 / 128, 10_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (``how``: inner, left, left_semi or left_anti), hot keys of ``left`` dealt out.

    Rows are counted by key first (``left`` should be a table, for it is read twice).  Fewer
    than 1 / ``HOT_SHARE`` keys can be hot, which bounds what is broadcast; a hot key is cut
    into parts in proportion to its rows, and its rows of ``right`` are copied to each part.
    """
    rows = left.count()
    if rows <= ONE_TASK:
        return left.join(right, on, how)
    least = max(1, int(rows * HOT_SHARE))
    hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > least)
    hot = F.broadcast(hot.select(*[F.col(c).alias(f"_hot{i}") for i, c in enumerate(on)], F.ceil(F.col("_rows") / least).cast("int").alias("_parts")))

    def marked(df: DataFrame, part) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"_hot{i}")) for i, c in enumerate(on)]
        cond = same[0]
        for s in same[1:]:
            cond = cond & s
        return df.join(hot, cond, "left").withColumn("_part", part(F.coalesce("_parts", F.lit(1)))).drop("_parts", *[f"_hot{i}" for i in range(len(on))])

    dealt = marked(left, lambda n: F.pmod(F.xxhash64(*[c for c in left.columns]), n).cast("int"))
    copied = marked(right, lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.join(copied, [*on, "_part"], how).drop("_part")


class Memo(dict):
    """A dict that computes missing values.

    It keeps two generations of at most ``limit`` entries each, so its size is bounded
    and entries in use survive.  Keys longer than ``longest`` aren't kept.
    """

    def __init__(self, make, limit: int, longest: int | None = None):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def without_cycles(batches, work):
    """``work`` over each batch with the cycle collector off: it would only walk the memos again and again."""
    import gc

    gc.disable()
    try:
        for batch in batches:
            yield work(batch)
    finally:
        gc.enable()
