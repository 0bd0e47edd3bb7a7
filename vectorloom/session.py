"""Session helpers: test session, shared scratch folder, shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[str] = []
_PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vectorloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def attach(spark: SparkSession) -> SparkSession:
    """Ship this package to the Python workers, once per application.

    Equivalent to submitting with ``--py-files``; needed because the Arrow stages
    run functions of this package inside executors.
    """
    sc = spark.sparkContext
    if getattr(sc, "_vectorloom_attached", False):
        return spark
    archive = os.path.join(tempfile.mkdtemp(prefix="vectorloom-pkg-"), "vectorloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as bundle:
        for folder, _, files in os.walk(_PACKAGE_DIR):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE_DIR)))
    sc.addPyFile(archive)
    sc._vectorloom_attached = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one machine, falls back to
    a fresh temporary folder; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vectorloom-scratch-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below :func:`shared_dir`, in a folder of this application that is
    removed when the driver's JVM ends."""
    sc = spark.sparkContext
    home = getattr(sc, "_vectorloom_scratch", None)
    if home is None:
        home = f"{shared_dir(spark).rstrip('/')}/vectorloom-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        folder = sc._jvm.org.apache.hadoop.fs.Path(home)
        files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)  # only what exists can be marked
        sc._vectorloom_scratch = home
    path = f"{home}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Remove the stored intermediate tables of this process, once a job's results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        folder = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        folder.getFileSystem(conf).delete(folder, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Cuts the lineage at data that survives lost executors. Used where a frame is
    read more than once and recomputing it is either expensive (model calls) or
    could give other values (partition ids). It also gives the optimizer the true size:
    a join with the stored frame is broadcast only if it is below
    ``spark.sql.autoBroadcastJoinThreshold``, and otherwise a shuffle join that adaptive
    execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core before a Python stage.

    A large table already has many input splits and is returned as it is, so no
    text is shuffled; only an input of few splits is dealt out round-robin.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
