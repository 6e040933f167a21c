"""Session defaults and the shared folder that lineage cuts go to."""

from __future__ import annotations

import atexit
import pathlib
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Settings that every keyloom job wants; all may be overridden by the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("keyloom")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions or cores))
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed where it is on the driver's path only; harmless where it is installed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_keyloom_shipped", False):
        return
    home = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="keyloom-code-")) / "keyloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(target))
    sc._keyloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is taken on one machine, as in tests;
    on a cluster it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="keyloom-shared-")
        sc.setCheckpointDir(named)
    p, fs = file_system(spark, named)
    return fs.makeQualified(p).toString()  # with its scheme, as workers read and write it by other means too


_scratch: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    """Delete what :func:`scratch` named, if its session still runs."""
    for spark, path in _scratch:
        try:
            if spark.sparkContext._jsc is not None:
                p, fs = file_system(spark, path)
                fs.delete(p, True)
        except (Py4JError, OSError, AttributeError):
            pass
    _scratch.clear()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends: results that were not yet computed read it until then."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_sweep)
    _scratch.append((spark, path))
    return path


def cut(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder, parted into folders ``by`` the given columns.

    Unlike a reliable ``checkpoint()`` the rows are kept as Parquet, so later
    reads stay columnar and prunable; the files survive any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.mode("error").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_system(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop sees them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """A file's content, read by the driver; for small files such as manifests and models."""
    p, fs = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def publish_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> bool:
    """Write a small file so that readers see all of it or nothing; false if it is there already and must not be overwritten.

    The file is written under another name and then renamed.  Of several
    writers that must not overwrite exactly one succeeds, where the file system
    renames atomically, as distributed ones do.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    p, fs = file_system(spark, path)
    tmp, _ = file_system(spark, f"{p.getParent()}/_{p.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(tmp, True)
    stream.write(bytearray(data))
    stream.close()
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    how = gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE if overwrite else kinds.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, p, how)
    except Py4JJavaError as e:
        fs.delete(tmp, False)
        if not overwrite and "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True
