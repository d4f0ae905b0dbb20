"""What the corpus operators share: the shared folder, tables that cut lineage, components of a link graph."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session whose executors are threads of the driver, as in tests, gets a temporary folder; on a
    cluster that is an error, since executors would not share it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}-{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that nothing will read again."""
    for t in tables:
        path = getattr(t, "_tessera_path", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Gives freed memory back to the system, so that a worker between tasks holds little beside a full executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run, a function over Arrow batches, with release() after each batch and at its end."""

    def wrapped(batches):
        try:
            for b in run(batches):
                yield b
                release()
        finally:
            release()

    return wrapped


def file_system(uri: str):
    """(file system, path) by which Python on an executor reaches the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table, root being the smallest node of its component.

    Alternates large-star and small-star steps until no edge changes, so a component of any diameter takes
    about log^2 rounds. Edges stay distributed. A star step takes the minimum neighbour by a partial
    aggregate, writes it and joins it back, so no neighbourhood is ever gathered as one list, and adaptive execution can
    split the join where a node has very many neighbours. Null ends and loops are ignored; an empty table gives an
    empty table.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    e = stored(e, "edges")

    held: list[DataFrame] = []

    def star(x: DataFrame) -> DataFrame:
        """x: (u, n) directed; every n of u (u too) is linked with the smallest of them."""
        m = stored(x.groupBy("u").agg(F.least(F.min("n"), F.first("u")).alias("m")), "least")
        held.append(m)
        return x.join(m, "u")

    last = None
    for _ in range(rounds):
        # large star: neighbours larger than u go to the smallest neighbour of u
        both = e.select("u", F.col("v").alias("n")).union(e.select(F.col("v").alias("u"), F.col("u").alias("n")))
        large = star(both).where("n > u").select(F.col("n").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of these
        s = star(large.select("u", F.col("v").alias("n")))
        small = s.select(F.col("n").alias("u"), F.col("m").alias("v")).union(s.select("u", F.col("m").alias("v")))
        new = stored(small.where("u <> v").distinct(), "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(e, *held)
        e = new
        held.clear()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
