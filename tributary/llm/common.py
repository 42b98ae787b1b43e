"""Shared helpers of the training-data operators: reading tables, cutting lineage, naming internals."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words, as the inside of a regular-expression class.
SPACE_CLASS = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a data folder, through Spark's own reader (any store that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed to internal names, so that further columns of the input can't clash.

    A column that occurs twice in the input (apart from case) is an ambiguity that Spark reports.
    """
    return frame.select(*(F.col(f"`{source}`").alias(target) for target, source in columns.items()))


def cut(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint in the shared folder that the session names.

    `spark.checkpoint.dir` is read from the session; only where it is unset and driver and executors are one
    process (tests) a folder of our own is used. Checkpoint files outlive executors.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    done = frame.checkpoint(eager=True)
    tidy(frame.sparkSession)
    return done


def tidy(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect garbage where its heap has grown past half of its bound.

    Shuffle files and plans of lineage that was cut go only when the driver collects; it hardly does by itself while
    executors do the work, so that its heap and the executors' disks would fill.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > 0.5 * runtime.maxMemory():
        spark.sparkContext._jvm.System.gc()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store its path names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """`body(value)` where `value` is evaluated once for each row: a one-element transform binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def wide_hash(*columns: Column) -> Column:
    """128 bits from two chained xxhash64 runs with different seeds, as a struct of two longs."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(0x5BD1E995), *columns).alias("b"))


def hex_hash(hashed: Column) -> Column:
    """A wide hash as 32 lower-case hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(hashed["a"]), 16, "0"), F.lpad(F.hex(hashed["b"]), 16, "0")))
