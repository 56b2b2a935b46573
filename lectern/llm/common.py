"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the blanks that separate words (space, tab to carriage return).
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text: maximal runs without blanks; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What `body` makes of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    Only where the setting is missing and the master is this machine, as in
    tests, a temporary folder stands in for it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of the queries run inside as soon as each one ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as written to the shared folder and read again, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again.

    A lost executor then costs one reread, never a recomputation.
    """
    return written(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written step that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_small(left: DataFrame, right: DataFrame, on: Column, how: str, most: int = 10_000) -> DataFrame:
    """Join with a side that is broadcast only if it has at most `most` rows.

    Beyond that Spark plans an ordinary join, whose hot partitions adaptive
    execution splits.
    """
    if right.limit(most + 1).count() <= most:
        right = F.broadcast(right)
    return left.join(right, on, how)


#: Bits of a filter of ids, which bound the table that is broadcast: one row for 64 of them.
FILTER_BITS = 1 << 23


def with_maybe(df: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """df with `_maybe`, whether a row's id may be among ids: true for all that are, and for few others as long as ids fill a small part of FILTER_BITS.

    Both have the column `name`.  The filter is a table of at most
    FILTER_BITS / 64 rows, so that df need not shuffle to meet it.
    """
    place = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    word = F.shiftright(place, 6)
    bits = ids.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    met = df.join(F.broadcast(bits), word == F.col("_word"), "left")
    return met.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of x > 0, by Stirling's series eight places further up."""
    z = x + 8
    steps = F.lit(0.0)
    for k in range(8):
        steps = steps + F.log(x + k)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - steps
