"""Intermediate tables in the folder the cluster shares, and small DataFrame helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on one machine and an error on a cluster, whose executors would not share it."""
    got = spark.conf.get("spark.checkpoint.dir", None) or None
    if got is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = tempfile.mkdtemp(prefix="linequarry-")
        spark.sparkContext.setCheckpointDir(got)
        got = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return got


def small_batches(spark: SparkSession, bytes_: int = 4 << 20) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch (64 MB by default), so that whole texts or sets come in pieces that fit a small worker; one row may be larger. Narrow rows still come in batches of many."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64m").lower() in ("67108864b", "67108864", "64m"):  # a bound that the user chose stays
        spark.conf.set(name, str(bytes_))


class Scratch:
    """Tables written by one run of an operator.

    ``keep(df)`` writes ``df`` as Parquet and reads it back, which cuts the
    lineage: a lost executor only costs the tasks that read the table.
    ``drop`` removes a table that later steps no longer need; the rest goes
    when the session ends.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._remove(t._scratch_path)


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000, bytes_: int | None = None) -> DataFrame:
    """Marks a table for broadcast after counting it (and, if its rows have no fixed width, the bytes of its written form); a larger one is left to a shuffled join."""
    if bytes_ is not None and written_bytes(df) > bytes_:
        return df
    return F.broadcast(df) if df.count() <= rows else df


def written_bytes(table: DataFrame) -> int:
    """Size of the files of a table that ``Scratch.keep`` returned."""
    jvm = table.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    return p.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def unused(columns, *names: str) -> tuple[str, ...]:
    """Names like ``names`` that differ from all ``columns`` (in any letter case) and from each other."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def one_text(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) of the rows with neither null, and a table (id, digest) of the ids with different texts, None if there are none.

    Of an id's different texts only the one with the least hash is kept.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    digests = base.select("id", F.xxhash64("text").alias("d")).groupBy("id").agg(F.min("d").alias("digest"), F.max("d").alias("most")).where("digest <> most")
    several = scratch.keep(digests.select("id", "digest"))
    if not several.head(1):
        return base, None
    joined = base.join(broadcast_if_small(several.withColumnRenamed("id", "_of")), F.col("id") == F.col("_of"), "left")
    return joined.where("digest is null or digest = xxhash64(text)").select("id", "text"), several
