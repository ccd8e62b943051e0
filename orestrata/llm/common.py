"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. A local master without one gets a folder beside its warehouse;
    on a cluster executors couldn't see such a folder, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints")
    return sc.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames that are made and run within leave no shuffle files: Spark deletes them when the action ends.

    A loop of many shuffles would else fill the disks until the driver happens to collect its garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Used where a small derived table is read several times, or where a loop
    would grow the plan. The shuffles behind ``df`` are dropped.
    """
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_int(*parts: Column) -> Column:
    """A 32-bit number from md5 of the parts joined by '|', which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def hash_below(h_of_63_bits: Column, size: int, n: int) -> Column:
    """Whether a hash lies in the share ``size / n`` of its 63 bits, however small that share is."""
    return h_of_63_bits < F.lit(min((1 << 63) - 1, (size << 63) // max(1, n)))


def hash_63(*keys: Column | str, seed: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 1)


def sample(rows: DataFrame, n: int, size: int, *keys: Column | str, seed: str) -> DataFrame:
    """The ``size`` of about ``n`` rows whose ``keys`` have the least hashes, so reruns agree.

    A task keeps ``size`` rows at most. Rows far above the share that is wanted
    are left out before anything is sorted; if ``n`` was far too high, so that
    too few are left, all rows are looked at. A table that has rows never gives
    an empty sample.
    """
    hashed = rows.withColumn("_sample_h", hash_63(*keys, seed=seed))
    least = lambda d: cut(d.orderBy("_sample_h").limit(size).drop("_sample_h"))
    if n > 2 * size:
        picked = least(hashed.where(hash_below(F.col("_sample_h"), 2 * size, n)))
        if picked.count() >= size // 2:
            return picked
    return least(hashed)


def small_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bound the bytes of an Arrow batch, so that very long texts don't fill a Python worker.

    The setting is the session's; a lower one that is there already stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not (str(now).isdigit() and 0 < int(now) <= mb << 20):
        spark.conf.set(name, str(mb << 20))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again. The shuffles behind it are dropped."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote and that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, few: DataFrame, key: str, n: str = "n", chunk: int = 4096, most_keys: int = 1_000_000) -> DataFrame:
    """``rows`` joined with ``few``, which has one row a key and in ``n`` how many of ``rows`` may have it.

    Rows of a key that more than ``chunk`` rows have are dealt into parts, and the
    key's row is copied to each part, so no task gets all rows of a key. The keys
    that need it are few, one in ``chunk`` rows; they are broadcast up to
    ``most_keys`` (24 bytes each), and beyond that the join is left to the
    engine's own splitting of skewed partitions.
    """
    parts = F.when(F.col(n) > chunk, F.ceil(F.col(n) / chunk).cast("int")).otherwise(1)
    hot = cut(few.where(F.col(n) > chunk).select(key, parts.alias("_s_parts")))
    if not 0 < hot.count() <= most_keys:
        return rows.join(few, key)
    left = rows.join(F.broadcast(hot), key, "left")
    left = left.withColumn("_s_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_s_parts", F.lit(1))).cast("int"))
    copies = few.withColumn("_s_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(copies, [key, "_s_part"]).drop("_s_part", "_s_parts")
