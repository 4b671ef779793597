"""Session helpers: table access, lineage cuts in the shared folder, size checks."""

from __future__ import annotations

import atexit
import functools
import logging
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only if its counted rows stay under this; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: ``spark.checkpoint.dir`` where the session names one.

    Only where it is unset (tests, a laptop) a temporary folder of this machine is used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="loomdex-")
        atexit.register(_remove_own, _own_dirs[app])
    return _own_dirs[app]


def _remove_own(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below a folder of this application."""
    return f"{shared_dir(spark)}/loomdex/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage cut that
    survives the loss of executors and, unlike ``checkpoint()``, is compressed and prunable.
    The tables stay until :func:`clear_cuts`, as results may still be read from them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_cuts(spark: SparkSession) -> None:
    """Remove all tables that :func:`cut` wrote for this application; DataFrames that still read
    them cannot be used afterwards."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomdex/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where neither PYTHONPATH nor the working folder
    leads to it: Spark sends it along with the tasks, once per application."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    if app in _shipped or home in [os.path.abspath(p or ".") for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]]:
        return
    import shutil

    made = tempfile.mkdtemp(prefix="loomdex-ship-")  # on the driver, which serves the archive
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(made, "loomdex"), "zip", home, "loomdex"))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where a scan has fewer tasks than there are cores (its rows are costly in
    Python, however few bytes they are); a scan of as many tasks or more is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def timed(f):
    """Log how long a call takes; of a lazy operator that is its planning and its cuts."""

    @functools.wraps(f)
    def run(*args, **kw):
        start = time.perf_counter()
        try:
            return f(*args, **kw)
        finally:
            logging.getLogger("loomdex").info("%s took %.3f s", f.__qualname__, time.perf_counter() - start)

    return run


def builder(app: str = "loomdex", cores: int | str = "*", checkpoint_dir: str | None = None) -> SparkSession.Builder:
    """Local session used by tests, bench and the examples. ``checkpoint_dir`` becomes
    ``spark.checkpoint.dir``; without it a new folder of this machine does, which goes at exit."""
    if checkpoint_dir is None:
        checkpoint_dir = "file://" + tempfile.mkdtemp(prefix="loomdex-")
        atexit.register(_remove_own, checkpoint_dir)
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", checkpoint_dir)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
