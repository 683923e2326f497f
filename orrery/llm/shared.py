"""What the operators of this subpackage share: scratch tables that outlive executors, and small plan helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts: the blank and the five controls 0x09 to 0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's reader (the folder may be in a store that only Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the checkpoint folder that the context was given.

    Only a session without executors of its own gets a temporary folder; on a cluster that would be another one on each machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is executed inside deletes its shuffle files as it ends: what is written needs them no more."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables written under the shared folder. A written table cuts lineage and survives the loss of an executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back with the same schema."""
        with shuffles_end(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete these tables."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_but(self, *names: str) -> None:
        """Delete all tables but these."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)
        self.drop(*({f.getPath().getName() for f in found} - set(names)))


#: Rows of a table that may be broadcast: about 100 bytes each.
BROADCAST_ROWS = 1 << 18


def join_left(left: DataFrame, right: DataFrame, keys: list[str], weight: str, bound: int | None = None) -> DataFrame:
    """left with its row of right (a written table of distinct keys), if there is one. The `bound` rows of right (BROADCAST_ROWS by default) that most rows of left look
    for, by the column `weight`, are broadcast, so that no hot key meets in one task; only where there are more, the other rows of left are shuffled."""
    bound = BROADCAST_ROWS if bound is None else bound
    if right.count() <= bound:
        return left.join(F.broadcast(right), keys, "left")
    order = [F.desc(weight), *keys]
    hot = F.broadcast(right.orderBy(*order).limit(bound))
    rest = right.join(hot.select(*keys), keys, "left_anti")
    return left.join(hot, keys).unionByName(left.join(hot.select(*keys), keys, "left_anti").join(rest, keys, "left"))


def hashable(df: DataFrame) -> list[Column]:
    """The columns of df that have hashes: those without maps."""

    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return all(plain(f.dataType) for f in kind)
        return plain(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))

    return [F.col(f"`{f.name}`") for f in df.schema if plain(f.dataType)]


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has: the pieces between white space runs, but empty ones at the ends."""

    def inner(pieces: Column) -> Column:
        n = F.size(pieces)
        return n - (F.get(pieces, F.lit(0)) == "").cast("int") - ((n > 1) & (F.get(pieces, n - 1) == "")).cast("int")

    pieces = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.element_at(F.transform(F.array(pieces), inner), 1).cast(T.LongType())


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
