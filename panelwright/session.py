"""Session builder and the shared folder that holds written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; for tests, benches and notebooks."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    } | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else a new temporary one for this session (tests, local mode)."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="panelwright-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Writes intermediate tables to the shared folder and reads them back.

    A written table cuts the lineage and survives the loss of executors. Tables that are no longer
    needed are removed with drop(); what is left goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        self._at: dict[int, str] = {}

    def write(self, df: DataFrame, counts: dict | None = None) -> tuple[DataFrame, dict]:
        """df as a written table, and the given aggregates of its rows, taken while it is written."""
        at = f"{self.root}/{self._n}"
        self._n += 1
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in (counts or {}).items()]).write.parquet(at)
        got = self.spark.read.schema(df.schema).parquet(at)
        self._at[id(got)] = at
        return got, {k: v or 0 for k, v in seen.get.items()}

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if at := self._at.pop(id(t), None):
                self._fs.delete(self._path(at), True)
