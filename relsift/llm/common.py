"""Helpers shared by the operators: shared-storage tables and SQL word patterns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a session with a plain local master (driver and executors are one
    process, as in tests) may leave it unset; it then gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="relsift-llm-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut,
    readable after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/relsift-llm/{name}-{uuid.uuid4().hex}"
    for paths in _scopes:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Lists of the tables written since each open ``scratch`` scope began.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the paths of the tables ``written`` inside. Results read them lazily, so
    they may be ``dropped`` only when what was made of them is itself written."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes[:] = [p for p in _scopes if p is not paths]


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the tables at ``paths`` and empties the list. A path that is gone is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    paths.clear()


#: Bits of the membership filter: 65,536 words of 64 bits, whatever the data.
FILTER_BITS = 1 << 22


def maybe_member(df: DataFrame, key: list[Column], members: DataFrame, member_key: list[Column], out: str) -> DataFrame:
    """``df`` with a boolean column ``out``: where it is false, the key is surely not one
    of ``members``; where it is true, a join has to tell.

    It keeps rows without a partner out of a shuffle. The filter is a bitmap of a fixed
    size, one row per word, so its broadcast has a fixed bound; with very many members it
    lets more through, which costs time and changes no result."""
    def spot(columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns, F.lit("member")), F.lit(FILTER_BITS))

    bits = members.select(spot(member_key).alias("_spot"))
    words = bits.groupBy(F.shiftright("_spot", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_spot & 63 as int))")).alias("_bits"))
    here = F.expr("shiftright(_bits, cast(_at & 63 as int)) & 1")
    return (df.withColumn("_at", spot(key)).join(F.broadcast(words), F.shiftright("_at", 6) == F.col("_word"), "left")
            .withColumn(out, F.coalesce(here == 1, F.lit(False))).drop("_at", "_word", "_bits"))
