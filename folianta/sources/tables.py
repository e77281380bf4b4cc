"""Parquet tables and intermediate tables in the shared folder.

``load`` reads one table of a library folder. ``materialise`` writes an
intermediate result that several later stages read, so that neither a lost
executor nor a second consumer recomputes the expensive stage before it. The
folder is the one the cluster names in ``spark.checkpoint.dir``; only where that
setting is absent and the session is local (a laptop) a temporary folder is used.
On a cluster without the setting ``SharedFolderMissing`` is raised, as executors
would write to their own disks. ``release`` deletes what has been written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of each application that names none.
_own: dict[str, str] = {}
#: The intermediate tables of each application, and what it has built for its whole life.
_written: dict[str, list[str]] = {}
_lasting: dict[tuple, object] = {}
#: Tables whose label begins so make up an index and outlive ``release``.
INDEX = "index-"
#: Shuffle files of a write go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class SharedFolderMissing(RuntimeError):
    """The cluster names no folder that all executors share."""


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` (one parquet file or a folder of them)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a temporary one where none is set and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise SharedFolderMissing("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="folianta-")
    return _own[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def release(spark: SparkSession, everything: bool = False) -> int:
    """Deletes the intermediate tables written so far, once the results made from them have been read; returns how many.

    The tables of an index stay, unless ``everything`` goes.
    """
    app = spark.sparkContext.applicationId
    if everything:
        for key in [key for key in _lasting if key[0] == app]:
            del _lasting[key]
    gone = [path for path in _written.get(app, []) if everything or not path.rsplit("/", 1)[-1].startswith(INDEX)]
    for path in gone:
        files, where = _hadoop(spark, path)
        files.delete(where, True)
    _written[app] = [path for path in _written.get(app, []) if path not in set(gone)]
    return len(gone)


def lasting(spark: SparkSession, key: tuple, make: Callable[[], object]):
    """What ``make`` builds, once for an application and ``key``; anew if someone has cleared the shared folder."""
    app = spark.sparkContext.applicationId
    tables = [path for path in _written.get(app, []) if path.rsplit("/", 1)[-1].startswith(INDEX)]
    if not all(files.exists(where) for files, where in (_hadoop(spark, path) for path in tables)):
        for old in [old for old in _lasting if old[0] == app]:
            del _lasting[old]
        _written[app] = [path for path in _written[app] if path not in tables]
    if (app, *key) not in _lasting:
        _lasting[app, *key] = make()
    return _lasting[app, *key]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back as a table; what was shuffled for it is deleted.

    Empty input gives an empty table with the same schema.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
