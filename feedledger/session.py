"""Session settings the engine relies on, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# What outlives a job, a batch's staged rows and the tables, is written with this codec: half of the texts are
# hexadecimal digits, of which the default codec saves nothing.
DENSE = "zstd"

# A write's shuffle files go when the write ends; otherwise they stay until the driver's garbage collector finds them.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# UTC instants, and JSON objects whose last repeated key wins; the rest is execution.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows with a page body each are long: what a Python worker holds is bounded in bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    # Inferring filters from the classifier's many aliased CASE expressions multiplies without
    # bound; join keys that must not be null are filtered explicitly instead.
    "spark.sql.constraintPropagation.enabled": "false",
    # Methods past 8,000 bytes are never compiled to machine code by the JVM; a stage that
    # needs one runs operator by operator instead, with its code split into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator assumes to an existing session."""
    for key, value in REQUIRED_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("feedledger")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it.

    A temporary folder is made only when the session names none and runs on one machine, as in
    the tests; on a cluster every executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    made = tempfile.mkdtemp(prefix="feedledger-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


_area: ContextVar[str | None] = ContextVar("staging_area", default=None)


@contextmanager
def staging_area(spark: SparkSession, label: str):
    """A folder for everything staged inside the block, removed when the block succeeds.

    After a failure it stays, so that what was staged can be looked at.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    token = _area.set(path)
    try:
        yield path
    finally:
        _area.reset(token)
    discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing will read again."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Every job begun inside the block removes its shuffle files when it ends."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later jobs start from files, so a lost executor costs one task, not the whole
    lineage, and each reader prunes the columns it does not need. Inside a staging area, where
    everything stays until the block ends, the dense codec is the default.
    """
    spark = df.sparkSession
    area = _area.get()
    codec = codec or (DENSE if area else None)
    path = f"{area or shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
