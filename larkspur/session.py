"""Session construction and shared storage locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Where streams keep their state; ``transformWithState`` runs with no other store.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "larkspur",
              shuffle_partitions: int | None = None,
              driver_memory: str | None = None) -> SparkSession:
    """Return (or create) a session with the settings the operators assume.

    Master, driver memory and partition counts come from the submitter unless
    an argument (or LARKSPUR_MASTER, LARKSPUR_DRIVER_MEMORY) asks for others.
    """
    master = master or os.environ.get("LARKSPUR_MASTER")
    driver_memory = driver_memory or os.environ.get("LARKSPUR_DRIVER_MEMORY")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(map=STATE_STORE)
    )
    if master is not None:
        builder = builder.master(master)
    if driver_memory is not None:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, also in a session that
    ``get_spark`` did not make; the session's own settings are put back."""
    before = {k: spark.conf.getAll.get(k) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Folder of a local session for which none was configured, by application.
_OWN: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, set by whoever runs
    the cluster.  Only when it is unset - local tests - a private temporary
    folder takes its place for the life of the application."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = _OWN.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="larkspur-")
        _OWN[sc.applicationId] = base
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A folder under the shared one.  Unique folders belong to the application
    (``release`` deletes them); others are kept for later applications."""
    base = shared_base(spark)
    if not unique:
        return "/".join([base, *parts])
    return "/".join([base, _scratch(spark), *parts, uuid.uuid4().hex])


def _scratch(spark: SparkSession) -> str:
    return f"larkspur-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes the application's intermediate tables.  Frames that read them
    cannot be used afterwards: call it when all results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_base(spark)}/{_scratch(spark)}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (never local): survives executor loss."""
    shared_base(spark or df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``larkspur`` importable in the Python workers (the ``--py-files``
    mechanism): the package is zipped once per SparkContext and added with
    ``addPyFile``, which Spark distributes to every executor."""
    import zipfile

    import larkspur

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(larkspur.__file__))
    fd, path = tempfile.mkstemp(prefix="larkspur-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(path)
    _SHIPPED.add(key)
