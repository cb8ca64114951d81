"""Session settings, table loading and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster passes its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lexiloom")
    builder = builder.config(map=DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g"} | conf)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster has
    to name one, since no local folder is visible to all its executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_written: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later stages and
    recomputations after a lost executor start from these files."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Removes the intermediate tables that this process has written, once no
    result that reads them is needed any more; tells how many there were."""
    paths, hadoop = [_written.pop() for _ in range(len(_written))], spark._jvm.org.apache.hadoop.fs
    for name in paths:
        path = hadoop.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where a scan has fewer parts than these: a
    table of one row group would else be worked on by one task. Larger tables
    stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Caps the rows of an Arrow batch, for operators that hand whole texts to
    Python: the default of 10,000 long documents is more than a worker needs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Caps the bytes of an Arrow batch, for operators that turn whole texts into
    others row by row: what a Python worker holds then follows neither from the
    table's size nor from how long its texts are, one text aside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > size:
        spark.conf.set(key, str(size))
