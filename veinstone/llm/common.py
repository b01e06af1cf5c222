"""What the corpus operators share: table access, shared storage, words and hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sound

#: A word is a run of anything but these (space and 0x09 to 0x0D).
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sound(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see. Sets one of its own only in a local session that names none; a cluster that names none is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="veinstone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def remove(spark: SparkSession, place: str) -> None:
    """Deletes a folder, wherever Spark has it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Sealed:
    """A table under names of its own, so that no column of the caller's, whatever its name, meets one of an operator's.

    ``df`` has the columns of ``names`` as ``in_0``, ``in_1`` and so on; ``of`` finds a column by its name: as written, else
    in any case; null of type ``kind`` where it may be absent. ``opened`` gives the caller's columns back under their names
    and in their order, with ``results`` in place of those named alike, and then the other results.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"in_{i}" for i in range(len(self.names))])

    def place(self, name: str) -> int | None:
        alike = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        return alike[0] if alike else None

    def of(self, name: str, kind: str | None = None) -> Column:
        at = self.place(name)
        if at is not None:
            return F.col(f"in_{at}")
        if kind is None:
            raise ValueError(f"no column {name}")
        return F.lit(None).cast(kind)

    def opened(self, df: DataFrame, results: dict[str, Column] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
        results = dict(results or {})
        gone = {self.place(n) for n in without}
        at = {self.place(n): n for n in results}
        own = [(results.pop(at[i]) if i in at else F.col(f"in_{i}")).alias(n) for i, n in enumerate(self.names) if i not in gone]
        return df.select(*own, *[v.alias(n) for n, v in results.items()])


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later stages survive lost executors without recomputing all before."""
    shared_folder(sound(df.sparkSession))
    return df.checkpoint(eager=True)


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and binds it in ``body``: lambda variables are never inlined again by the optimiser."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """The text without white space at its ends; empty for null."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))


def words(text: Column) -> Column:
    """array<string> of the words of a text; empty for null."""
    inked = strip(text)
    return F.when(inked == "", F.array().cast("array<string>")).otherwise(F.split(inked, f"[{SPACES}]+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def release() -> None:
    """Gives memory that a task has freed back to the machine, as a worker process outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit counter-based generator; maps uint64 to uint64 one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
