"""Column picking, shared storage and scratch tables for the text operators."""

from __future__ import annotations

import os
import uuid

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

#: Largest build side, in bytes of rows, that is broadcast; beyond it the same join is shuffled.
BROADCAST_BYTES = 32 << 20


def pick(df: DataFrame, **cols: tuple[str, str] | str) -> DataFrame:
    """Select columns by exact name and cast them: ``pick(df, doc_id="bigint", text="string")``.

    Columns are found by position, so extra columns whose names clash with ours, or differ
    from ours in case alone, neither matter nor make a reference ambiguous. Of several columns
    with one name the first counts. A missing column raises ValueError.
    """
    importable(df.sparkSession)
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    out = []
    for name, spec in cols.items():
        source, kind = spec if isinstance(spec, tuple) else (name, spec)
        if source not in names:
            raise ValueError(f"column {source!r} is missing; the input has {names}")
        out.append(F.col(f"c{names.index(source)}").cast(kind).alias(name))
    return plain.select(*out)


class Masked:
    """A frame with its columns renamed by position (``c0``, ``c1`` ...), so that helper columns can't clash."""

    def __init__(self, df: DataFrame):
        importable(df.sparkSession)
        self.names = df.columns
        self.df = df.toDF(*(f"c{i}" for i in range(len(self.names))))
        self.cols = self.df.columns

    def __getitem__(self, name: str):
        if name not in self.names:
            raise ValueError(f"column {name!r} is missing; the input has {self.names}")
        return F.col(f"c{self.names.index(name)}")

    def restore(self, df: DataFrame) -> DataFrame:
        """Drop helper columns and give back the names."""
        return df.select(*self.cols).toDF(*self.names)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset a folder is made only for a local master (tests); on a cluster that is an
    error, since executors on other machines could not read a driver's own folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    at = "file://" + tempfile.mkdtemp(prefix="orbweave-")
    spark.conf.set("spark.checkpoint.dir", at)
    spark.sparkContext.setCheckpointDir(at)
    return at


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/orbweave/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: the lineage ends there,
    so the loss of an executor costs no recomputation of what was stored."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._orbweave_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing will read again."""
    delete(df.sparkSession, df._orbweave_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession, path: str) -> str:
    """Send a file of the driver's machine to all executors once; the name that :func:`shipped` takes."""
    name = os.path.basename(path)
    if not any(x.rpartition("/")[2] == name for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


def shipped(name: str) -> str:
    """Where a file sent by :func:`ship` lies on this machine."""
    return SparkFiles.get(name)


#: Bytes that a task of a shuffle whose size is known should get; more partitions than the session's default are made for more.
PART_BYTES = 64 << 20


def spread(df: DataFrame, size: int, *on: str) -> DataFrame:
    """Hash-partition by ``on``: as the session says, or into more partitions if ``size`` bytes ask for them."""
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = -(-size // PART_BYTES)
    return df.repartition(n, *on) if n > default else df.repartition(*on)


def small(df: DataFrame, row_bytes: int) -> tuple[DataFrame, bool]:
    """A stored frame, and whether its rows fit the broadcast limit."""
    return df, df.count() * row_bytes <= BROADCAST_BYTES


def join_checked(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Join with a stored ``right``: broadcast if its counted size is under the limit, else by shuffle."""
    right, fits = small(right, row_bytes)
    return left.join(F.broadcast(right) if fits else right, on, how)
