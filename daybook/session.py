"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

_READY: set[str] = set()
_SECONDS: dict[str, float] = {}  # what each stage took to build, without the stages it needed
_INNER: list[float] = []
_LOCAL_ROOT: dict[str, str] = {}


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("daybook")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="daybook-"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="daybook-")
        spark.sparkContext.setCheckpointDir(_LOCAL_ROOT[app])
    return _LOCAL_ROOT[app]


def _listing(spark: SparkSession, data_dir: str) -> str:
    """The folder's tables with their sizes and times, so that changed data is another folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(data_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return data_dir
    return data_dir + "".join(sorted(f"/{x.getPath().getName()} {x.getLen()} {x.getModificationTime()}" for x in fs.listStatus(path)))


def _stage_path(spark: SparkSession, data_dir: str, name: str) -> str:
    tag = hashlib.sha1(_listing(spark, data_dir).encode()).hexdigest()[:12]
    return f"{shared_root(spark)}/daybook/{spark.sparkContext.applicationId}/{tag}/{name}"


def stage(spark: SparkSession, data_dir: str, name: str, build: Callable[[], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Write ``build()`` once per application and state of the input folder, then read it back.

    Later plans start from a Parquet table (statistics, column pruning, pushdown; with ``by`` also one folder per
    value) and an executor loss replays at most the step in flight, never the whole chain.
    """
    path = stage_folder(spark, data_dir, name, lambda p: build().write.mode("overwrite").partitionBy(*by).parquet(p))
    return spark.read.parquet(path)


def stage_folder(spark: SparkSession, data_dir: str, name: str, build: Callable[[str], None]) -> str:
    """A folder that ``build(path)`` fills once per application and state of the input folder."""
    path = _stage_path(spark, data_dir, name)
    if path not in _READY:
        start = time.time()
        _INNER.append(0.0)
        build(path)
        spent = time.time() - start
        _SECONDS[name] = spent - _INNER.pop()
        if _INNER:
            _INNER[-1] += spent
        _READY.add(path)
    return path


def ready(spark: SparkSession, data_dir: str, name: str) -> bool:
    """Whether the stage has been built."""
    return _stage_path(spark, data_dir, name) in _READY


def stage_seconds() -> dict[str, float]:
    """Seconds that each stage has taken, each without the stages it needed."""
    return dict(_SECONDS)


def forget_stages() -> None:
    """Build stage tables anew from now on; for timing."""
    _READY.clear()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared root for one run's table or stream checkpoint."""
    return f"{shared_root(spark)}/daybook/{spark.sparkContext.applicationId}/run/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: for a result that several branches of a plan consume."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
