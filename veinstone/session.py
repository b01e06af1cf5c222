"""Settings of a session that right results depend on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Fixed names and values. Spark 4.1 takes the partitioning of a union's parts for that of the union; where adaptive execution
#: has given the parts different partitions, groups and joins on top of it then mix up rows.
SETTINGS = {"spark.sql.unionOutputPartitioning": "false"}


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own that all executors see, below what the session names for checkpoints; only a local session may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}"
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, place: str) -> None:
    """Deletes a folder, wherever Spark has it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sound(spark: SparkSession) -> SparkSession:
    """The session, with the settings made."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark
